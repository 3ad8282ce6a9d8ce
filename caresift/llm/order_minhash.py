"""Order MinHash fingerprints: sketches of texts that follow edit distance.

A text's k-mers are numbered by occurrence, so that the third "abcde" differs from the first.  In each of ``signs``
independent orders of theirs the ``picks`` least are taken, put back into text order, and hashed as a tuple: one sign of the
signature.  Equal tuples need equal k-mers in equal order.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from caresift.llm._support import documents
from caresift.llm._words import U, mix


@dataclass(frozen=True)
class MinHashConfig:
    k: int = 6  #: code points of a k-mer; a shorter text is one k-mer
    signs: int = 64  #: of a signature: orders of the numbered k-mers
    picks: int = 2  #: k-mers in a tuple


@functools.lru_cache(4)
def orders(signs: int) -> tuple[np.ndarray, np.ndarray]:
    """A mask and an odd factor for each order: hashes are compared after both."""
    seed = mix(np.arange(1, 2 * signs + 1, dtype=U) * U(0xA0761D6478BD642F))
    return seed[:signs], seed[signs:] | U(1)


def numbered(points: np.ndarray, k: int) -> np.ndarray:
    """A hash of each k-mer and of how often it stood before; a shorter text is one k-mer."""
    n = max(min(len(points), 1), len(points) - k + 1)
    hashed = np.zeros(n, U)
    for j in range(min(k, len(points))):
        hashed = (hashed ^ points[j : j + n]) * U(0x9E3779B97F4A7C15)
        hashed ^= hashed >> U(29)
    hashed = mix(hashed + U(len(points) if len(points) < k else 0))
    order = np.argsort(hashed, kind="stable")
    run = hashed[order]
    new = np.flatnonzero(np.concatenate([np.ones(min(n, 1), bool), run[1:] != run[:-1]]))
    number = np.empty(n, U)  # of the occurrence, in text order
    number[order] = np.arange(n, dtype=U) - np.repeat(new, np.diff(np.append(new, n))).astype(U)
    return mix(hashed + number * U(0xD1B54A32D192ED03))


def signature(points: np.ndarray, config: MinHashConfig = MinHashConfig()) -> np.ndarray:
    """``signs`` unsigned 32-bit numbers of a text's code points; all 0 for an empty text.

    A text with fewer k-mers than ``picks`` has all of them in each tuple.
    """
    out = np.zeros(config.signs, np.uint32)
    if not len(points):
        return out
    hashed = numbered(points, config.k)
    n, take = len(hashed), min(len(hashed), config.picks)
    rows = np.empty((config.signs, take), np.int64)
    value = np.empty(n, U)
    for s, (mask, factor) in enumerate(zip(*orders(config.signs), strict=True)):
        np.bitwise_xor(hashed, mask, out=value)
        np.multiply(value, factor, out=value)
        for p in range(take):
            rows[s, p] = least = int(value.argmin())
            value[least] = U((1 << 64) - 1)
    rows.sort(axis=1)
    folded = np.full(config.signs, mix(np.array([take], U))[0])
    for p in range(take):
        folded = mix(folded * U(3) + hashed[rows[:, p]])
    return (folded >> U(32)).astype(np.uint32) | np.uint32(1)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Equal signs among those that either signature has; 1 for two empty ones."""
    either = (a != 0) | (b != 0)
    n = int(either.sum())
    return float(((a == b) & either).sum() / n) if n else 1.0


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(U)


def fingerprint(df: DataFrame, text: str = "text", out: str = "fingerprint", config: MinHashConfig = MinHashConfig()) -> DataFrame:
    """``df`` with ``out string``, the signature in hex; a null text is empty, and an empty one has only zeros."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [signature(_points(x.as_py() or ""), config).tobytes().hex() for x in batch.column(batch.schema.get_field_index(text))]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(made, pa.string())], [*batch.schema.names, out])

    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema if f.name != out)
    return df.drop(out).mapInArrow(run, f"{kept}, {out} string")


def ordered(df: DataFrame, key: str, text: str) -> DataFrame:
    """span int, at long, guest boolean, key, text: rows in key order within each span of keys, and spans in key order.

    A span ends with the rows of the next one's least key as guests (the last span with those of the first), so that a
    row's successor is in its own span.  Only the edges of spans, as many as there are partitions, go through the driver.
    Null keys come first; keys have to be whole numbers.
    """
    spark = df.sparkSession
    if not isinstance(df.schema[key].dataType, IntegralType):
        raise ValueError("keys have to be whole numbers")
    spans = max(2, 4 * int(spark.conf.get("spark.sql.shuffle.partitions")))
    rows = df.select(F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    rows = rows.withColumn("at", F.coalesce(F.col("key").cast("long"), F.lit(-(1 << 63))))
    cuts = rows.agg(F.percentile_approx("at", [i / spans for i in range(1, spans)], 10_000).alias("cuts")).first()["cuts"] or []
    edges = F.array(*[F.lit(x).cast("long") for x in sorted(set(cuts))]) if cuts else F.array().cast("array<bigint>")
    span = F.size(F.filter(edges, lambda e: e <= F.col("at")))
    heads = sorted((r["span"], r["head"]) for r in rows.select(span.alias("span"), "at").groupBy("span").agg(F.min("at").alias("head")).collect())
    if not heads:
        return rows.select(F.lit(0).alias("span"), "at", F.lit(False).alias("guest"), "key", "text")
    before = [heads[-1][0], *(s for s, _ in heads[:-1])]  # the span that each head is a guest of
    # only the head's key and span are looked up, in a map of as many entries as there are spans
    guest = F.element_at(F.create_map(*[F.lit(x) for (_, head), s in zip(heads, before, strict=True) for x in (head, s)]), F.col("at"))
    own = F.struct(span.alias("span"), F.lit(False).alias("guest"))
    extra = F.struct(guest.cast("int").alias("span"), F.lit(True).alias("guest"))
    placed = rows.withColumn("in", F.explode(F.when(guest.isNull(), F.array(own)).otherwise(F.array(own, extra))))
    placed = placed.select("in.span", "at", "in.guest", "key", "text")
    return placed.repartition(max(1, min(spans, len(heads))), "span").sortWithinPartitions("span", "guest", "at", "text")


def with_next(df: DataFrame, config: MinHashConfig = MinHashConfig(), key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The edited text has the last floor(n_chars / 4) code points replaced by the first as many of the next text, by key,
    then text (after the last: the first); ``near_next`` compares with that next text.  A null text is empty.  A text
    alone in its table is its own next one.  Rows of the first key in a span that aren't its first are guests too, but only
    the least of them is anyone's next.
    """
    names = ["key", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: tuple | None = None  # span, key, text, code points, signature
        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                out = []
                batch = whole.slice(at, 500)
                for span, guest, own, said in zip(*(batch.column(i).to_pylist() for i in (0, 2, 3, 4)), strict=True):
                    if guest and (waiting is None or waiting[0] != span):
                        waiting = None
                        continue  # only the first guest follows anyone
                    points = _points(said)
                    made = signature(points, config)
                    if waiting is not None and waiting[0] == span:
                        _, last, text_, before, signed = waiting
                        n = len(before) // 4
                        edited = text_[: len(before) - n] + said[:n]
                        other = signature(_points(edited), config)
                        out.append((last, len(before), sha256(edited.encode()).hexdigest(), signed.tobytes().hex(), other.tobytes().hex(), likeness(signed, other), likeness(signed, made)))
                    waiting = None if guest else (span, own, said, points, made)
                if out:
                    columns = list(zip(*out, strict=True))
                    yield pa.RecordBatch.from_arrays([pa.array(columns[0], whole.schema.field(3).type), *map(pa.array, columns[1:])], names)

    rows = ordered(df, key, text)
    kind = rows.schema["key"].dataType.simpleString()
    return rows.mapInArrow(run, f"key {kind}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double").withColumnRenamed("key", key)


def query(spark, sf_dir: str) -> DataFrame:
    return with_next(documents(spark, sf_dir))
