"""File operations on whatever file system a path names."""

from __future__ import annotations

from pyspark.sql import SparkSession


def _resolve(spark: SparkSession, path: str):
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration()), hadoop_path


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _resolve(spark, path)
    return fs.exists(p)


def is_file(spark: SparkSession, path: str) -> bool:
    fs, p = _resolve(spark, path)
    return fs.exists(p) and fs.getFileStatus(p).isFile()


def list_names(spark: SparkSession, directory: str) -> list[str]:
    """Names of the direct children of a directory, sorted; none if it is missing."""
    fs, p = _resolve(spark, directory)
    if not fs.exists(p):
        return []
    return sorted(status.getPath().getName() for status in fs.listStatus(p))


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """Write a small text as one file, replacing what is there."""
    fs, p = _resolve(spark, path)
    out = fs.create(p, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()


def delete(spark: SparkSession, path: str) -> None:
    fs, p = _resolve(spark, path)
    fs.delete(p, True)


def make_parent(spark: SparkSession, path: str) -> None:
    fs, p = _resolve(spark, path)
    fs.mkdirs(p.getParent())


def statuses(spark: SparkSession, path: str) -> list[tuple[str, int, int]]:
    """Name, bytes and time of change of a file, or of all files below a directory, sorted."""
    fs, p = _resolve(spark, path)
    base, found = fs.makeQualified(p).toString(), []
    listed = fs.listFiles(p, True)
    while listed.hasNext():
        status = listed.next()
        found.append((status.getPath().toString().removeprefix(base), status.getLen(), status.getModificationTime()))
    return sorted(found)


def read_text(spark: SparkSession, path: str) -> str | None:
    """A small text file; null if it is missing."""
    fs, p = _resolve(spark, path)
    if not fs.exists(p):
        return None
    stream = fs.open(p)
    try:
        return bytes(spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
    finally:
        stream.close()


def _rename(fs, source, target) -> None:
    if not fs.rename(source, target):
        raise OSError(f"{source.toString()} was not renamed to {target.toString()}")


def publish(spark: SparkSession, source: str, target: str) -> None:
    """Put a finished directory in the place of what is at the target, by renames.

    What was there is set aside under a name that readers skip, and deleted last;
    if the second rename fails, it is put back, and if the driver is lost between
    the two, the next call does so.
    """
    fs, new = _resolve(spark, source)
    _, place = _resolve(spark, target)
    aside = spark._jvm.org.apache.hadoop.fs.Path(place.getParent(), f".{place.getName()}.before")
    if fs.exists(aside):
        if fs.exists(place):
            fs.delete(aside, True)
        else:
            _rename(fs, aside, place)
    fs.mkdirs(place.getParent())
    if not fs.exists(place):
        _rename(fs, new, place)
        return
    _rename(fs, place, aside)
    try:
        _rename(fs, new, place)
    except BaseException:
        _rename(fs, aside, place)
        raise
    fs.delete(aside, True)


def move(spark: SparkSession, source: str, target: str) -> None:
    """Rename; an existing file of the target's name is replaced in the same step.

    A directory of that name, as another layout leaves it, is deleted first.
    """
    fs, p = _resolve(spark, target)
    _, s = _resolve(spark, source)
    if fs.exists(p) and fs.getFileStatus(p).isDirectory():
        fs.delete(p, True)
    hadoop = spark._jvm.org.apache.hadoop.fs
    rename = getattr(hadoop, "Options$Rename")
    options = spark.sparkContext._gateway.new_array(rename, 1)
    options[0] = rename.OVERWRITE
    context = hadoop.FileContext.getFileContext(fs.getUri(), spark._jsc.hadoopConfiguration())
    context.rename(fs.makeQualified(s), fs.makeQualified(p), options)
