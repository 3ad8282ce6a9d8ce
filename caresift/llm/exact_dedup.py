"""Exact duplicates by digest, with a lane of their own for frequent digests.  DataFrame and SQL functions only.

A Misra-Gries summary of the digests (the weighted form of Anderson et al., 2017, "A High-Performance Algorithm for
Identifying Frequent Items in Data Streams", which Spark has as ``approx_top_k``) names at most ``HEAVY`` candidates.  They
are counted exactly, and the verified winners are broadcast: rows of frequent digests are told apart in the map tasks and
never meet in one.  The other digests, of which none holds more than twice the summary's error, are shuffled as usual.

Texts count as equal when their SHA-256 is equal.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from caresift.llm._support import cut, documents, small

#: Counters of one summary.  A digest with over 0.05 % of the rows is always found; the summary takes about 1 MB.
COUNTERS = 10_000
#: Most winners that are broadcast, about 100 bytes each.
HEAVY = 10_000
#: Summaries that one task merges: they meet in two steps, so that neither step gathers those of all partitions.
FAN = 256

MADE = ("keep_id", "group_size", "kept", "text_sha256")


def same(text: Column) -> Column:
    return text


def digest(text: Column, normal: Callable[[Column], Column] = same) -> Column:
    """SHA-256 of the normalised text in UTF-8; null counts as empty."""
    return F.unhex(F.sha2(normal(F.coalesce(text, F.lit(""))).cast("binary"), 256))


def frequent(rows: DataFrame, column: str) -> DataFrame:
    """At most HEAVY values of a binary column that may be frequent; all that are, and perhaps others."""
    # both steps group by a key: without one, a partition without rows would hand on a summary without a type
    tracked = f"approx_top_k_accumulate(hex({column}), {COUNTERS})"
    parts = rows.groupBy((F.spark_partition_id() % FAN).alias("__part")).agg(F.expr(tracked).alias("__summary"))
    whole = parts.groupBy(F.lit("all")).agg(F.expr(f"approx_top_k_combine(__summary, {COUNTERS})").alias("__summary"))
    found = whole.select(F.explode(F.expr(f"approx_top_k_estimate(__summary, {HEAVY})")).alias("__x"))
    return found.select(F.unhex("__x.item").alias(column))


def winners(rows: DataFrame) -> DataFrame:
    """(__digest, __best, __n) of the frequent digests that occur twice at least: the exact count, and the row that stays.

    ``rows``: __digest, __key, __row.  At most HEAVY rows.
    """
    asked = F.broadcast(cut(frequent(rows, "__digest")))  # HEAVY rows at most
    counted = rows.join(asked, "__digest").groupBy("__digest").agg(F.max(F.struct("__key", "__row")).alias("__best"), F.count("*").alias("__n"))
    return cut(counted.where("__n > 1"))


def slim(df: DataFrame, text: str, key: str, normal: Callable[[Column], Column] = same) -> DataFrame:
    """__digest, __key and a number __row of each row, written once: texts are read a single time."""
    return cut(df.select(digest(F.col(text), normal).alias("__digest"), F.col(key).alias("__key"), F.monotonically_increasing_id().alias("__row")))


def label(df: DataFrame, text: str = "text", key: str = "doc_id", normal: Callable[[Column], Column] = same) -> DataFrame:
    """``key`` of each row, with keep_id (the key of the row that stays of its group), group_size, kept and text_sha256.

    Of equal texts, the row with the largest key stays; a null key is the least.  Of rows that share text and key exactly
    one is kept, whichever.  A null text equals an empty one, keep_id is null where all keys of a group are null, and an
    empty table gives an empty table.  Other columns are not looked at.
    """
    if key in MADE:
        raise ValueError(f"the key can't be called {key}")
    rows = slim(df, text, key, normal)
    heavy = F.broadcast(winners(rows))  # HEAVY rows at most
    group = Window.partitionBy("__digest")
    light = rows.join(heavy.select("__digest"), "__digest", "left_anti")
    light = light.withColumns({"__best": F.max(F.struct("__key", "__row")).over(group), "__n": F.count("*").over(group)})
    both = rows.join(heavy, "__digest").select(light.columns).unionByName(light)
    return both.select(F.col("__key").alias(key), F.col("__best.__key").alias("keep_id"), F.col("__n").alias("group_size"), (F.col("__best.__row") == F.col("__row")).alias("kept"), F.lower(F.hex("__digest")).alias("text_sha256"))


def drop_copies(df: DataFrame, text: str = "text", key: str = "doc_id", normal: Callable[[Column], Column] = same) -> DataFrame:
    """The rows of ``df`` that stay, with all their columns.  Nulls, ties and repeats as in ``label``.

    Rows without a copy go through map tasks alone as long as the repeated digests can be broadcast; texts are shuffled
    beyond that only, and frequent digests never are.
    """
    rows = slim(df, text, key, normal)
    heavy = winners(rows)
    light = rows.join(F.broadcast(heavy.select("__digest")), "__digest", "left_anti")
    light = light.groupBy("__digest").agg(F.max(F.struct("__key", "__row")).alias("__best"), F.count("*").alias("__n")).where("__n > 1")
    columns = df.columns
    whole = df.select(F.struct(*columns).alias("__whole"), F.col(key).alias("__key"), digest(F.col(text), normal).alias("__digest"))

    def settled(found: DataFrame) -> DataFrame:
        """One of the rows with the best key; ``first`` is taken in the map tasks already."""
        own = found.where(F.col("__key").eqNullSafe(F.col("__best.__key")))
        return own.groupBy("__digest").agg(F.first("__whole").alias("__whole")).select("__whole")

    often = F.broadcast(heavy)  # HEAVY rows at most
    first = settled(whole.join(often, "__digest"))
    rest = whole.join(often.select("__digest"), "__digest", "left_anti").join(small(cut(light)), "__digest", "left")
    alone = rest.where("__n is null").select("__whole")
    return first.unionByName(settled(rest.where("__n is not null"))).unionByName(alone).select("__whole.*")


def query(spark, sf_dir: str) -> DataFrame:
    return label(documents(spark, sf_dir)).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


ORACLE_SQL = """
WITH d AS (SELECT doc_id, sha256(coalesce(text, '')) AS h FROM documents),
g AS (SELECT h, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY h)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, h AS text_sha256 FROM d JOIN g USING (h)
"""
