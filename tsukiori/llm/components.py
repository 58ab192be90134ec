"""Connected components of a graph given as a table of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tsukiori.scratch import stage


def components(edges: DataFrame) -> DataFrame:
    """``node`` and ``root``, the least node it is connected with, for each node of the edges ``a, b``.

    Each round, a node takes the least root among its neighbours', then its
    root's root. Edges and roots are written each round, so a round does not
    depend on executors that ran earlier ones. Rounds grow with the logarithm of
    long paths; stars take three.
    """
    links = stage(edges.select("a", "b").union(edges.select("b", "a")).distinct(), "links")
    roots = stage(links.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("least")).select("node", F.least("node", "least").alias("root")), "roots")
    while True:
        near = links.join(roots.select(F.col("node").alias("b"), "root"), "b").groupBy(F.col("a").alias("node")).agg(F.min("root").alias("near"))
        stepped = stage(
            roots.join(near, "node").select("node", F.col("root").alias("before"), F.least("root", "near").alias("root")), "roots"
        )
        far = stepped.select(F.col("node").alias("root"), F.col("root").alias("far"))
        jumped = stage(stepped.join(far, "root", "left").select("node", "before", F.coalesce("far", "root").alias("root")), "roots")
        roots = jumped.select("node", "root")
        if jumped.where(F.col("root") != F.col("before")).isEmpty():
            return roots
