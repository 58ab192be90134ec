"""Near-duplicate texts by a join of parity sketches.

A text's set of shingles is spread over the parts of a sketch by a hash, and each
part is the exclusive or of its shingles' hashes. A shingle that one of two sets
lacks changes one part, so the number of parts that differ is at most the size of
the symmetric difference. A similarity bounds that size; with more parts than the
bound, two similar sets have an equal part. So texts that share no part need not
be compared. The number of parts goes by bands of set sizes, the bound by a
text's own size. Parts of a single shingle are no keys, because passages that many
texts share would make them hot; a text that has too few other parts gets further
sketches by other hashes, until one has enough. Of enough parts, those first in an
order that all texts share are its keys: some more than the bound, because what
comes before the first part that two similar sets share differs between them.

Texts are compared with the first of those that share a key; most of a group of near
copies become one component by that. A key whose sets still have more than ``CROWD``
others in other components, on average, is crowded. A text that has more keys than
the bound even without its crowded ones needs none of these: whatever else is similar
to it shares one of the others. Texts that lack them in a band get a second, finer sketch
for it among themselves, and only what is crowded there too is compared by crowded keys.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from tsukiori.llm import textbytes as tb
from tsukiori.llm.components import components
from tsukiori.scratch import stage

#: Bits of the small sketch that two texts are compared by before their sets are.
SKETCH_BITS = 1024
#: Ratio of the bounds of a size band.
BAND = 1.5
#: Sketches of a text at most; after them all parts of the last are keys.
ROUNDS = 64
#: Sets of other components that a set of a key has, on average; beyond that the key is crowded.
CROWD = 24
#: Texts of a block of a crowded key; a task compares the sketches of two blocks.
BLOCK = 4096

_U = np.uint64
_GOLD = _U(0x9E3779B97F4A7C15)


@dataclass
class Bands:
    """Bands of sizes, and what holds for pairs whose smaller set is in a band."""

    percent: int
    first: np.ndarray  # least size
    last: np.ndarray  # greatest size
    reach: np.ndarray  # greatest size of the larger set
    parts: np.ndarray
    strong: np.ndarray  # shingles that a part must have to be a key

    def bound(self, level: np.ndarray, size: np.ndarray) -> np.ndarray:
        """The greatest symmetric difference of a set of some size and a similar one, as a pair of the band."""
        other = np.where(size > self.last[level], self.last[level], size * 100 // self.percent)
        return (100 - self.percent) * (size + other) // (100 + self.percent)


def bands(percent: int) -> Bands:
    """Bands for a Jaccard similarity of ``percent`` hundredths at least."""
    if not 60 <= percent <= 100:
        raise ValueError("similarities from 60 to 100 hundredths")
    first, size = [], 1
    while size < 1 << 31:
        first.append(size)
        size = max(size + 1, int(size * BAND))
    low = np.array(first, np.int64)
    high = np.append(low[1:], size) - 1
    none = np.zeros_like(low)
    grid = Bands(percent, low, high, high * 100 // percent, none, none.copy())
    for level in range(len(low)):
        grid.parts[level], grid.strong[level] = _parts(grid, level)
    return grid


def fine(grid: Bands) -> Bands:
    """The same bands with as many parts as leave most with one shingle at least."""
    most = grid.bound(np.arange(len(grid.first)), grid.last)
    parts = np.maximum(np.ceil(0.6 * grid.first), most + 2).astype(np.int64)
    return Bands(grid.percent, grid.first, grid.last, grid.reach, parts, np.ones_like(parts))


def _more(bound: np.ndarray) -> np.ndarray:
    """Keys beyond those that the bound asks for, at most: so many crowded ones can be ignored."""
    return 1 + bound // 10


def _parts(grid: Bands, level: int) -> tuple[int, int]:
    """How many parts, and shingles of a strong one, so that sets of all sizes are expected to have strong parts enough.

    The fewest by a margin, else those by which the least margin is greatest; of
    two shingles if that leaves most sets with enough in a few sketches.
    """
    size = np.array([grid.first[level], grid.last[level], grid.reach[level]])
    bound = grid.bound(np.full(3, level), size)
    choices = np.unique(np.maximum(bound.max() + 1, np.ceil(size[1] * np.linspace(0.2, 1.2, 101)))).astype(np.int64)[:, None]
    mean = size / choices
    for strong in (2, 1):
        expected = choices * (1 - np.exp(-mean) * (1 + mean * (strong > 1)))
        enough = ((expected - bound - 1) / np.sqrt(bound + 1)).min(axis=1)
        ample = np.flatnonzero(((expected - bound - 1 - _more(bound)) / np.sqrt(bound + 1)).min(axis=1) >= 0.7)
        best = int(ample[0] if len(ample) else enough.argmax())
        if strong == 1 or enough[best] >= -0.25:
            break
    return int(choices[best, 0]), strong


@dataclass
class Sets:
    """Distinct shingles of the texts of a batch: those of text i are ``hashes[bounds[i]:bounds[i + 1]]``, ascending."""

    hashes: np.ndarray
    bounds: np.ndarray

    @property
    def sizes(self) -> np.ndarray:
        return np.diff(self.bounds)

    def totals(self, salt: int) -> np.ndarray:
        """A hash of each set, whatever its order."""
        sums = np.concatenate([[_U(0)], np.cumsum(tb.mix(self.hashes + _U(salt)), dtype=_U)])
        return sums[self.bounds[1:]] - sums[self.bounds[:-1]]


def shingles(rolling: tb.Rolling, data: np.ndarray, offsets: np.ndarray, size: int) -> Sets:
    """Shingles of words lower-cased in A-Z and separated by ASCII white space."""
    data = tb.LOWER[data]
    starts, ends = tb.runs(tb.SOLID[data], offsets)
    bounds = tb.owners(starts, offsets)
    n_words = np.diff(bounds)
    words = rolling.between(rolling.prefix(data), starts, ends)
    n_shingles = np.where(n_words >= size, n_words - size + 1, np.minimum(n_words, 1))
    doc = np.repeat(np.arange(len(n_words)), n_shingles)
    at = bounds[doc] + np.arange(len(doc)) - np.repeat(np.cumsum(n_shingles) - n_shingles, n_shingles)
    held = np.minimum(n_words[doc], size)
    hashes = held.astype(_U)
    for k in range(size):  # a text of fewer words has one shingle of them all
        word = words[np.minimum(at + k, max(len(words) - 1, 0))] if len(words) else hashes
        hashes = np.where(k < held, tb.mix(hashes * _GOLD + word), hashes)
    order = np.lexsort((hashes, doc))
    hashes, doc = hashes[order], doc[order]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (hashes[1:] != hashes[:-1])
    return Sets(hashes[new], np.concatenate([[0], np.cumsum(np.bincount(doc[new], minlength=len(n_words)))]))


def _ragged(first: np.ndarray, count: np.ndarray) -> np.ndarray:
    return np.repeat(first - (np.cumsum(count) - count), count) + np.arange(int(count.sum()))


@dataclass
class Keys:
    """Keys of the texts of a batch. Similar texts that are not equal share one."""

    key: np.ndarray
    doc: np.ndarray
    level: np.ndarray  # the band for whose pairs the key is
    spare: np.ndarray  # how many of the text's keys for that band can be ignored


def keys(sets: Sets, grid: Bands, rounds: range = range(ROUNDS)) -> Keys:
    sizes = sets.sizes
    own = np.searchsorted(grid.first, sizes, "right") - 1
    docs, levels = [], []
    level = own.copy()
    going = np.flatnonzero(sizes > 0)
    while len(going):  # as the smaller set in its own band, as the larger in bands below
        some = going[grid.bound(level[going], sizes[going]) > 0]
        docs.append(some)
        levels.append(level[some])
        level[going] -= 1
        going = going[level[going] >= 0]
        going = going[sizes[going] <= grid.reach[level[going]]]
    doc = np.concatenate([np.zeros(0, np.int64), *docs])
    level = np.concatenate([np.zeros(0, np.int64), *levels])
    made = [(np.zeros(0, _U), *[np.zeros(0, np.int64)] * 3)]
    for round_ in rounds:
        if not len(doc):
            break
        count, parts, bound = sizes[doc], grid.parts[level], grid.bound(level, sizes[doc])
        hashes = sets.hashes[_ragged(sets.bounds[doc], count)]
        place = tb.mix(hashes + tb.random_words(round_, 1)) >> _U(32)
        place = (place * np.repeat(parts, count).astype(_U) >> _U(32)).astype(np.int64)
        base = np.cumsum(parts) - parts
        place += np.repeat(base, count)
        total = int(parts.sum())
        held = np.bincount(place, minlength=total)
        sketch = np.zeros(total, _U)
        np.bitwise_xor.at(sketch, place, hashes)
        strong = held >= np.repeat(grid.strong[level], parts)
        spare = np.minimum(np.add.reduceat(strong, base, dtype=np.int64) - bound - 1, _more(bound))
        enough = spare >= 0
        if round_ == rounds[-1]:
            strong |= np.repeat(~enough, parts)
        unit = np.repeat(np.arange(len(doc)), parts)[strong]
        part = np.flatnonzero(strong) - base[unit]
        salt = tb.mix((level[unit].astype(_U) << _U(40)) + (part.astype(_U) << _U(8)) + _U(round_))
        key = tb.mix(sketch[strong] ^ salt)
        order = np.lexsort((key, unit))  # the first keys of each unit
        key, unit = key[order], unit[order]
        place = np.arange(len(unit)) - np.searchsorted(unit, unit)
        kept = ~enough[unit] | (place <= (bound + spare)[unit])
        key, unit = key[kept], unit[kept]
        made.append((key, doc[unit], level[unit], np.where(enough, spare, -1)[unit]))
        doc, level = doc[~enough], level[~enough]
    return Keys(*(np.concatenate(x) for x in zip(*made, strict=True)))


_KEYED = "key long, id long, unit long"


def _key_rows(ids: np.ndarray, found: Keys) -> pa.RecordBatch:
    """``unit`` has the band and the keys that can be ignored, in one number."""
    unit = found.level << 32 | found.spare + 1
    return pa.RecordBatch.from_arrays(
        [pa.array(found.key.view(np.int64)), pa.array(ids[found.doc], pa.int64()), pa.array(unit, pa.int64())], names=["key", "id", "unit"]
    )


def _signatures(docs: DataFrame, size: int) -> DataFrame:
    """Of each text: the size of its set, two hashes of it, and its small sketch."""

    def make() -> tb.Work:
        rolling = tb.Rolling(11)
        words = SKETCH_BITS // 64

        def work(data: np.ndarray, offsets: np.ndarray) -> list[pa.Array]:
            sets = shingles(rolling, data, offsets, size)
            count = len(sets.sizes)
            doc = np.repeat(np.arange(count), sets.sizes)
            bit = tb.mix(sets.hashes ^ _GOLD) & _U(SKETCH_BITS - 1)
            odd = np.bincount(doc * SKETCH_BITS + bit.astype(np.int64), minlength=count * SKETCH_BITS) & 1
            packed = np.packbits(odd.astype(bool), bitorder="little").view(np.int64)
            return [
                pa.array(sets.sizes, pa.int64()),
                pa.array(sets.totals(1).view(np.int64), pa.int64()),
                pa.array(sets.totals(2).view(np.int64), pa.int64()),
                tb.lists(packed, np.full(count, words), pa.int64()),
            ]

        return work

    fields = [T.StructField(name, T.LongType()) for name in ("n", "f1", "f2")]
    return tb.per_document(docs, "text", ["id"], [*fields, T.StructField("sketch", T.ArrayType(T.LongType()))], make)


def _keyed(docs: DataFrame, size: int, grid: Bands) -> DataFrame:
    """A row per key and text. Of equal sets, a task passes on one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rolling, seen = tb.Rolling(11), set()
        for batch in batches:
            for start, stop in tb.slices(batch.column(1)):
                part = batch.slice(start, stop - start)
                sets = shingles(rolling, *tb.utf8(part.column(1)), size)
                names = list(zip(sets.totals(1).tolist(), sets.totals(2).tolist(), sets.sizes.tolist(), strict=True))
                new = np.zeros(len(names), bool)
                for i, name in enumerate(names):
                    new[i] = name not in seen
                    seen.add(name)
                kept = sets.sizes * new
                sets = Sets(sets.hashes[np.repeat(new, sets.sizes)], np.concatenate([[0], np.cumsum(kept)]))
                yield _key_rows(part.column(0).to_numpy(), keys(sets, grid))

    return docs.select("id", "text").mapInArrow(run, _KEYED)


def _keyed_again(contents: DataFrame, grid: Bands) -> DataFrame:
    """A row per key of a finer sketch and set, of the bands in ``levels``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held, levels = batch.column(1), batch.column(2)
            counts = np.array(held.value_lengths())
            values = held.flatten().to_numpy(zero_copy_only=False).view(_U)
            sets = Sets(values, np.concatenate([[0], np.cumsum(counts)]))
            found = keys(sets, grid, range(ROUNDS, ROUNDS + 1))
            wanted = np.zeros((len(counts), len(grid.first)), bool)
            wanted[np.repeat(np.arange(len(counts)), np.array(levels.value_lengths())), levels.flatten().to_numpy(zero_copy_only=False)] = True
            kept = wanted[found.doc, found.level]
            found = Keys(found.key[kept], found.doc[kept], found.level[kept], found.spare[kept])
            yield _key_rows(batch.column(0).to_numpy(), found)

    return contents.select("id", "held", "levels").mapInArrow(run, _KEYED)


def _shared(keyed: DataFrame) -> DataFrame:
    """The rows of keys of several ids, and how many they have."""
    key = Window.partitionBy("key")
    several = keyed.withColumns({"least": F.min("id").over(key), "most": F.max("id").over(key)}).where("least != most")
    return several.select("key", "id", "unit")


def _crowds(still: DataFrame) -> DataFrame:
    """Sets that cannot do without their crowded keys, and the bands for whose pairs, by what they can ignore for a band."""
    crowded = still.where("crowded").groupBy("rep", "unit").count()
    return crowded.where(F.col("count") > F.col("unit").bitwiseAND(F.lit((1 << 32) - 1)) - 1).groupBy("rep").agg(
        F.collect_set(F.shiftright("unit", 32)).alias("levels")
    )


def _placed(rows: DataFrame) -> DataFrame:
    """Distinct sets by key, numbered, for keys of several."""
    key = Window.partitionBy("key")
    one = rows.groupBy("key", "rep", "unit").agg(F.lit(1).alias("one"))
    placed = one.withColumns({"place": F.row_number().over(key.orderBy("rep")), "m": F.count("*").over(key)})
    return placed.where("m > 1").drop("one", "m")


def _sets(docs: DataFrame, size: int) -> DataFrame:
    def make() -> tb.Work:
        rolling = tb.Rolling(11)

        def work(data: np.ndarray, offsets: np.ndarray) -> list[pa.Array]:
            sets = shingles(rolling, data, offsets, size)
            return [tb.lists(sets.hashes.view(np.int64), sets.sizes, pa.int64())]

        return work

    return tb.per_document(docs, "text", ["id"], [T.StructField("held", T.ArrayType(T.LongType()))], make)


def _similar(both: Column, one: Column, other: Column, percent: int) -> Column:
    return 100 * both >= percent * (one + other - both)


def _plausible(percent: int) -> Column:
    """Can sets ``a`` and ``b`` of these sizes and sketches be similar?"""
    apart = F.aggregate(F.zip_with("a_sketch", "b_sketch", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)
    sizes = F.col("a_n") + F.col("b_n")
    bound = F.floor((100 - percent) * sizes / (100 + percent))
    return (F.abs(F.col("a_n") - F.col("b_n")) <= bound) & (apart <= bound)


def link_groups(
    docs: DataFrame, *, size: int = 4, percent: int = 85, id_col: str = "doc_id", text: str = "text"
) -> DataFrame:
    """For each document, the size of its set of shingles and its group of similar ones.

    Words are lower-cased in A-Z and separated by ASCII white space; a text's
    set has each run of ``size`` words, or all its words as one if there are
    fewer. Two documents are linked if the Jaccard similarity of their sets is
    at least ``percent`` hundredths. Returns ``id_col``, ``n_shingles`` (long)
    and ``component_id`` (long): the least id that links lead to, its own included.

    Documents without words have an empty set and no links; nor has one with a
    null id, whose component is null. Rows of one id are one document, whose
    links are those of all its texts; each row has its own set size. Without
    documents there are no rows. Other columns are not looked at.

    Equal sets are found by a 128-bit hash and stand for each other, so copies
    are never paired. Texts that share a key are compared with the first of
    those with the key, then, while a key still holds more than one component,
    with those of the others; what a sketch of fixed size or the sizes rule out is
    not compared by sets. No pair of texts that share a key, and may need it, is left
    out if it ends in different components.
    """
    grid = bands(percent)
    source = docs.select(docs[f"`{id_col}`"].cast("long").alias("id"), docs[f"`{text}`"].cast("string").alias("text"))
    signed = stage(_signatures(source, size), "signatures")
    named = signed.where("id IS NOT NULL AND n > 0")
    same = ["n", "f1", "f2"]
    classes = stage(named.groupBy(*same).agg(F.min("id").alias("rep"), F.first("sketch").alias("sketch")), "classes")
    member = stage(named.join(classes.select(*same, "rep"), same).select("id", "rep", "n").distinct(), "members")
    sets = classes.select("rep", "n", "sketch")

    shared = stage(_shared(_keyed(source.where("id IS NOT NULL"), size, grid)), "shared-keys")
    first = stage(_placed(shared.join(member.select("id", "rep"), "id")), "first-keys")
    texts = source.join(first.select("rep").distinct(), source["id"] == F.col("rep"), "left_semi")
    contents = stage(_sets(texts, size).where(F.size("held") > 0), "contents")
    near = stage(_verified(_nearest_first(first, sets, percent), contents, percent), "verified")
    roots = components(near)
    still = _open_keys(first, roots)
    more = stage(_verified(_open_pairs(still, sets, percent), contents, percent), "verified")
    # a document of several sets links them
    edges = member.where(F.col("id") != F.col("rep")).select(F.col("id").alias("a"), F.col("rep").alias("b"))
    links = near.union(more).union(edges)

    crowded = stage(_crowds(still), "crowded")
    if not crowded.isEmpty():
        again = _keyed_again(contents.join(crowded, contents["id"] == crowded["rep"]), fine(grid))
        second = stage(_placed(again.withColumnRenamed("id", "rep")), "second-keys")
        near = stage(_verified(_nearest_first(second, sets, percent), contents, percent), "verified")
        links = links.union(near)
        still = _open_keys(second, components(links))
        pairs = _open_pairs(still, sets, percent).union(_dense_pairs(still, sets, percent)).distinct()
        links = links.union(stage(_verified(stage(pairs, "pairs"), contents, percent), "verified"))
        roots = components(links)
    elif not more.isEmpty() or not edges.isEmpty():
        roots = components(links)
    return signed.join(roots, signed["id"] == roots["node"], "left").select(
        F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.coalesce("root", "id").alias("component_id")
    )


def _with_sketches(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    for side in ("a", "b"):
        pairs = pairs.join(sets.select(F.col("rep").alias(side), F.col("n").alias(f"{side}_n"), F.col("sketch").alias(f"{side}_sketch")), side)
    return pairs


def _nearest_first(held: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """For each set, of the first ones of its keys the one it shares most keys with."""
    first = held.where("place = 1").select("key", F.col("rep").alias("a"))
    pairs = held.where("place > 1").select("key", F.col("rep").alias("b")).join(first, "key").groupBy("a", "b").count()
    plausible = _with_sketches(pairs, sets).where(_plausible(percent))
    place = F.row_number().over(Window.partitionBy("b").orderBy(F.desc("count"), "a"))
    return plausible.select("a", "b", "count").withColumn("place", place).where("place = 1").select("a", "b")


def _open_keys(held: DataFrame, roots: DataFrame) -> DataFrame:
    """The rows of keys that hold more than one component.

    ``main`` is the component of most sets of the key. The sets of a key that is
    not crowded have ``CROWD`` others in other components on average, so the pairs of
    them are in proportion to the rows, however large its components are.
    """
    known = held.join(roots, held["rep"] == roots["node"], "left").select("key", "rep", "unit", F.coalesce("root", "rep").alias("root"))
    key = Window.partitionBy("key")
    sizes = known.withColumn("m", F.count("*").over(key)).withColumn("own", F.count("*").over(Window.partitionBy("key", "root")))
    still = sizes.where("own < m").withColumn("main", F.max(F.struct("own", "root")).over(key)["root"])
    still = still.withColumn("crowded", F.avg(F.col("m") - F.col("own")).over(key) > CROWD)
    return stage(still.select("key", "rep", "unit", "root", "main", "crowded"), "open-keys")


def _open_pairs(still: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Plausible pairs of sets that share a key that is not crowded, in different components."""
    few = still.where("NOT crowded")
    one = few.where("root != main").select("key", F.col("rep").alias("one"), F.col("root").alias("one_root"))
    apart = F.col("root") != F.col("one_root")
    pairs = one.join(few, "key").where(apart & ((F.col("root") == F.col("main")) | (F.col("rep") > F.col("one"))))
    pairs = pairs.select(F.least("one", "rep").alias("a"), F.greatest("one", "rep").alias("b")).distinct()
    return _with_sketches(pairs, sets).where(_plausible(percent)).select("a", "b")


def _dense_pairs(still: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The same for crowded keys, of sets that need them. A key's sets are cut into blocks, and a task has two of them."""
    key = Window.partitionBy("key")
    many = still.where("crowded").join(_crowds(still), "rep", "left_semi").select("key", "rep", "root")
    many = many.withColumns({"place": F.row_number().over(key.orderBy("rep")), "most": F.count("*").over(key)})
    blocks = F.floor((F.col("most") - 1) / BLOCK).cast("int")
    block = F.floor((F.col("place") - 1) / BLOCK).cast("int")
    rows = many.join(sets, "rep").select(
        "key", "rep", "root", "n", "sketch", block.alias("block"), F.explode(F.sequence(F.lit(0), blocks)).alias("other")
    ).withColumns({"low": F.least("block", "other"), "high": F.greatest("block", "other")})

    def run(group: pd.DataFrame) -> pd.DataFrame:
        low, high = int(group["low"].iloc[0]), int(group["high"].iloc[0])
        rep, root, n = (group[name].to_numpy() for name in ("rep", "root", "n"))
        sketch = np.stack(group["sketch"].to_numpy()).view(_U)
        at = [np.flatnonzero(group["block"].to_numpy() == k) for k in (low, high)]
        found = []
        for i in at[0]:
            others = at[1][at[1] != i]
            bound = (100 - percent) * (n[i] + n[others]) // (100 + percent)
            likely = (root[others] != root[i]) & (np.abs(n[others] - n[i]) <= bound)
            others, bound = others[likely], bound[likely]
            apart = np.bitwise_count(sketch[others] ^ sketch[i]).sum(axis=1, dtype=np.int64)
            near = rep[others[apart <= bound]]
            found.append(np.stack([np.minimum(near, rep[i]), np.maximum(near, rep[i])], axis=1))
        return pd.DataFrame(np.unique(np.concatenate(found), axis=0), columns=["a", "b"])

    return rows.groupBy("key", "low", "high").applyInPandas(run, "a long, b long")


def _verified(pairs: DataFrame, contents: DataFrame, percent: int) -> DataFrame:
    """Of the pairs, those whose sets are similar."""
    one = contents.select(F.col("id").alias("a"), F.col("held").alias("a_held"))
    other = contents.select(F.col("id").alias("b"), F.col("held").alias("b_held"))
    both = F.size(F.array_intersect("a_held", "b_held"))
    return pairs.join(one, "a").join(other, "b").where(_similar(both, F.size("a_held"), F.size("b_held"), percent)).select("a", "b").distinct()
