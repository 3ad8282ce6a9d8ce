"""Rendezvous hashing of stable record keys over weighted shards.

Every shard scores every key, and the best score wins.  A shard's score depends on the key and the shard alone, so a new
shard takes rows only into itself and a removed one gives away only its own.  DataFrame functions only.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Parts of the key space within which rows of a shard are numbered; their counts are the only table that is broadcast.
BUCKETS = 4096


def place(key: Column, shards: Mapping[int, float]) -> Column:
    """The shard of a key.

    ``shards`` maps shard numbers to weights over 0.  A shard gets a part of the keys near its part of the weights: the
    score is ``ln(u) / weight`` for a fraction u hashed from key and shard; equal scores go by hash, then number.
    A null key is a key of its own.
    """
    if not shards or min(shards.values()) <= 0:
        raise ValueError("shards need weights over 0")
    text = F.coalesce(key.cast("string"), F.lit("null"))
    table = F.array(*[F.struct(F.lit(int(s)).alias("shard"), F.lit(float(w)).alias("weight")) for s, w in sorted(shards.items())])

    def scored(s: Column) -> Column:
        hashed = F.md5(F.concat(text, F.lit(":"), s["shard"].cast("string")))
        part = (F.conv(F.substring(hashed, 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)
        return F.struct((F.log(part) / s["weight"]).alias("score"), hashed.alias("hashed"), s["shard"].alias("shard"))

    return F.array_max(F.transform(table, scored))["shard"]


def number(df: DataFrame, shard: str, key: str, slot: str) -> DataFrame:
    """Adds ``slot``: 0, 1, 2 ... within each shard, by hash bucket of the key and then by key.

    No task sees a whole shard: rows are numbered in a shard's buckets, and each bucket starts where the counts of those
    before it end.  Rows with equal keys get neighbouring slots in any order.
    """
    hashed = F.md5(F.coalesce(F.col(key).cast("string"), F.lit("null")))
    bucket = F.conv(F.substring(hashed, 1, 3), 16, 10).cast("int")
    counts = df.select(F.col(shard).alias("__shard"), bucket.alias("__bucket")).groupBy("__shard", "__bucket").agg(F.count("*").alias("__n"))
    before = Window.partitionBy("__shard").orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("__shard", "__bucket", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start"))
    # at most BUCKETS rows a shard, whatever the input
    own = Window.partitionBy("__shard", "__bucket").orderBy(F.col(key).asc_nulls_first())
    rows = df.withColumns({"__shard": F.col(shard), "__bucket": bucket})
    rows = rows.withColumn("__own", F.row_number().over(own) - 1)
    return rows.join(F.broadcast(starts), ["__shard", "__bucket"]).withColumn(slot, (F.col("__start") + F.col("__own")).cast("long")).drop("__shard", "__bucket", "__own", "__start")


def shard_rows(df: DataFrame, key: str, shards: Mapping[int, float], grown: Mapping[int, float] | None = None) -> DataFrame:
    """``df`` with ``shard int``, ``slot long`` and, if ``grown`` is given, ``grown_shard int`` under those shards.

    Nulls in any column are kept; an empty table gives an empty table; columns of these names are replaced.
    """
    out = df.withColumn("shard", place(F.col(key), shards).cast("int"))
    out = out.withColumn("grown_shard", place(F.col(key), grown).cast("int")) if grown else out
    return number(out, "shard", key, "slot")


def query(spark, sf_dir: str) -> DataFrame:
    from caresift.llm._support import documents

    text = F.coalesce(F.col("text"), F.lit(""))
    rows = documents(spark, sf_dir).select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.lit("key").alias("law"))
    out = shard_rows(rows, "doc_id", {s: 1.0 for s in range(16)}, {s: 1.0 for s in range(17)})
    return out.select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")


ORACLE_SQL = """
WITH tab AS (
    SELECT list(list_reduce([n::BIGINT, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, x: xor(c >> 1, (c & 1) * 3988292384)) ORDER BY n) AS t FROM range(256) AS r(n)
), docs AS (
    SELECT doc_id, octet_length(encode(coalesce(text, ''))) AS n, hex(encode(coalesce(text, ''))) AS h FROM documents
), crc AS (
    SELECT doc_id, n, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(regexp_extract_all(h, '..'), lambda x: ('0x' || x)::BIGINT)),
        lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) AS text_crc32 FROM docs, tab
), scored AS (
    SELECT doc_id, s, md5(doc_id::VARCHAR || ':' || s) AS h FROM documents, range(17) AS r(s)
), placed AS (
    SELECT doc_id, arg_max(s, h) FILTER (WHERE s < 16) AS shard, arg_max(s, h) AS grown_shard FROM scored GROUP BY doc_id
)
SELECT doc_id, (n + 1)::BIGINT AS size, text_crc32::BIGINT AS text_crc32, 'key' AS law, shard::INT AS shard,
    row_number() OVER (PARTITION BY shard ORDER BY substr(md5(doc_id::VARCHAR), 1, 3), doc_id) - 1 AS slot, grown_shard::INT AS grown_shard
FROM crc JOIN placed USING (doc_id)
"""
