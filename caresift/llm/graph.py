"""Connected components of link tables as joins and groupings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caresift.llm._support import cut, forget


#: Links that one task reads at least, as far as there are enough: rounds over few links are many small tasks otherwise.
TASK_LINKS = 250_000


def _few_tasks(links: DataFrame, rows: int) -> DataFrame:
    return links.coalesce(rows // TASK_LINKS + 4)


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, component) for all ends of the links (a long, b long): the least node that can be reached.

    Alternating large and small stars: each round hangs a node's larger neighbours, then its smaller ones, under the least
    of them, so that every component shrinks to one star.  Links with a null end and loops are left out.
    """
    at = cut(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    at, mark = _few_tasks(at, at.count()), None
    for turn in range(rounds):
        if not turn % 3:
            forget(edges.sparkSession)
        both = at.unionByName(at.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        lower = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(lower, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        at = cut(small.unionByName(lower.select("a", F.col("m").alias("b"))).distinct())
        seen = at.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first()
        if seen == mark:
            break
        at, mark = _few_tasks(at, seen[0]), seen
    else:
        raise RuntimeError(f"links still change after {rounds} rounds")
    roots = at.select(F.col("b").alias("node")).distinct()
    return at.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots.select("node", F.col("node").alias("component")))
