"""Best-fit packing of tokenised texts into sequences with several capacities.

A piece is a vector of demands: its tokens, one document, and its attention cost (tokens squared).  All three follow from
its length, so pieces of one length are alike, and the plan needs only the count of each length: at most ``tokens``
numbers, however large the corpus.  The plan puts whole runs of like pieces into whole groups of like sequences, and each
piece finds its place from its rank among the pieces of its length.
"""

from __future__ import annotations

import base64
import functools
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from caresift.llm._support import BROADCAST_ROWS, cut, documents, flat, slices
from caresift.llm._words import pieces

#: Parts of one length that are ranked apart, at most: with ``capacity.tokens`` lengths that bounds the table of their starts.
SALTS = 1024
#: Words whose ids a worker keeps between slices.
KEPT_WORDS = 300_000


@dataclass(frozen=True)
class Capacity:
    """Of one sequence.  None: without bound."""

    tokens: int = 1024
    documents: int | None = None
    attention: int | None = None  #: of the sum of squared lengths
    score: str = "dot"  #: "dot": largest weighted dot product of demand and residual, both of unit length; "norm": least weighted residual norm
    weights: tuple[float, float, float] = (1.0, 0.05, 0.05)


#: Of the registered uses: all three demands count in the score, and only the tokens can bind (a piece has one token at least,
#: and a sum of squares is at most the square of the sum).
FULL = Capacity(1024, 1024, 1024 * 1024)
#: The added token of the vocabulary: its text and id.
ADDED, ADDED_ID = b"<|endoftext|>", 50256


@functools.lru_cache(2)
def _encoder(path: str):
    import public_tokenizers
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def token_ids(body: np.ndarray, at: np.ndarray, path: str, kept: dict[str, list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """The ids of all texts, one after another, and where each text's begin.  Each distinct word is encoded once."""
    encode = _encoder(path).encode_ordinary
    joined, hashed, first, last, bounds = pieces(body, at)
    _, where, which = np.unique(hashed, return_index=True, return_inverse=True)
    own = []
    for i, j in zip(first[where].tolist(), last[where].tolist(), strict=True):
        word = joined[i:j]
        if (ids := kept.get(word)) is None:
            ids = encode(word)
            if len(kept) < KEPT_WORDS and j - i < 64:
                kept[word] = ids
        own.append(ids)
    sizes = np.fromiter(map(len, own), np.int64, len(own))
    table = np.fromiter((x for ids in own for x in ids), np.uint32, int(sizes.sum()))
    begin = np.zeros(len(own) + 1, np.int64)
    np.cumsum(sizes, out=begin[1:])
    each = sizes[which]
    place = np.zeros(len(each) + 1, np.int64)
    np.cumsum(each, out=place[1:])
    flat = table[np.repeat(begin[which] - place[:-1], each) + np.arange(place[-1])] if len(each) else np.empty(0, np.uint32)
    return flat, place[bounds]


def _with_added(said: bytes, path: str, kept: dict[str, list[int]]) -> np.ndarray:
    ids, bounds = token_ids(*flat(pa.array([x.decode() for x in said.split(ADDED)])), path, kept)
    return np.insert(ids, bounds[1:-1], np.uint32(ADDED_ID))


def cut_pieces(df: DataFrame, path: str, tokens: int, end: int, key: str = "doc_id", text: str = "text", added: bool = False) -> DataFrame:
    """key, piece, start, length, ids_crc32 of each text's ids and the ``end`` id.

    Only texts of more than ``tokens`` ids are cut; all their pieces but the first have ``tokens``.  A null text is empty.
    ``path``: the tokenizer's rank file.  ``added``: its added token, where a text holds it, is one id, as in the library's
    plain call; else it is read as any text.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict[str, list[int]] = {}
        for batch, body, at in slices(batches, "text"):
            ids, bounds = token_ids(body, at, path, kept)
            whole = body.tobytes()
            some = added and ADDED in whole
            out: list[tuple[int, int, int, int, int]] = []
            for row, (i, j) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)):
                said = whole[at[row] : at[row + 1]] if some else b""
                own = np.append(_with_added(said, path, kept) if ADDED in said else ids[i:j], np.uint32(end)).astype("<u4")
                head = (len(own) - 1) % tokens + 1
                edges = [0, *range(head, len(own) + 1, tokens)]
                out += [(row, n, a, b - a, zlib.crc32(own[a:b])) for n, (a, b) in enumerate(zip(edges, edges[1:], strict=False))]
            rows, number, start, length, crc = (pa.array(x) for x in zip(*out, strict=True))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(rows), number.cast(pa.int32()), start, length, crc], ["key", "piece", "start", "length", "ids_crc32"])

    made = df.select(F.col(key).alias("key"), F.col(text).alias("text"))
    return made.mapInArrow(run, f"key {made.schema['key'].dataType.simpleString()}, piece int, start long, length long, ids_crc32 long").withColumnRenamed("key", key)


def sequences(steps: list[tuple[int, int, int, int, int]]) -> int:
    """How many sequences a plan takes."""
    return max((first + end - start for _, start, end, first, _ in steps), default=0)


def plan(counts: dict[int, int], capacity: Capacity) -> list[tuple[int, int, int, int, int]]:
    """(length, first rank, end rank, first sequence, offset): pieces of these ranks open or join consecutive sequences.

    Of two plans, the one of fewer sequences: by the weighted score alone, and with the score only between fills of one
    token residual.  So the other demands never cost a sequence against tokens alone while they can't bind.
    """
    return min((_plan(counts, capacity, first) for first in (False, True)), key=sequences)


def _plan(counts: dict[int, int], capacity: Capacity, tokens_first: bool) -> list[tuple[int, int, int, int, int]]:
    """Lengths go from the longest down.  The open sequences of one fill are one group; a length takes, again and again, the
    group that scores best among those with room under every capacity, and the rest of the length opens new ones.
    """
    most = np.array([capacity.tokens, capacity.documents or np.inf, capacity.attention or np.inf], float)
    scale = np.where(np.isfinite(most), most, 1.0)
    weight = np.array(capacity.weights) * np.isfinite(most)
    groups: list[tuple[tuple[int, int, int], int, int]] = []  # fill, first sequence, count
    out, opened = [], 0
    for length in sorted(counts, reverse=True):
        rank, left = 0, counts[length]
        need = np.array([length, 1, length * length], float)
        alone = max(1, min(int(m // n) for m, n in zip(most, need, strict=True) if np.isfinite(m)))
        while left:
            best = None
            if groups:
                room = most - np.array([g[0] for g in groups], float)
                fits = np.flatnonzero((room >= need).all(axis=1))
                if len(fits):
                    part = np.where(np.isfinite(room[fits]), room[fits], 0.0) / scale
                    demand = np.where(np.isfinite(most), need / scale, 0.0)
                    score = ((part - demand) ** 2 * weight).sum(axis=1)
                    if capacity.score == "dot":
                        # of the cosine, or the emptiest sequence would always win; equal ones go by the residual norm
                        cosine = (part * demand * weight).sum(axis=1) / np.sqrt((part**2 * weight).sum(axis=1) * (demand**2 * weight).sum())
                        score = np.where(cosine >= cosine.max() - 1e-9, score, np.inf) if not tokens_first else np.where(np.isfinite(score), score, 0.0)
                    best = int(fits[np.lexsort((score, room[fits, 0]))[0] if tokens_first else np.argmin(score)])
            if best is None:
                take = -(-left // alone)
                groups.append(((0, 0, 0), opened, take))
                opened += take
                best = len(groups) - 1
            fill, first, count = groups.pop(best)
            take = min(left, count)
            out.append((length, rank, rank + take, first, fill[0]))
            rank, left = rank + take, left - take
            if take < count:
                groups.append((fill, first + take, count - take))
            full = (fill[0] + length, fill[1] + 1, fill[2] + length * length)
            if full[0] < most[0] and full[1] < most[1] and full[2] < most[2]:
                groups.append((full, first, take))
    return out


def pack(parts: DataFrame, capacity: Capacity = Capacity(), key: str = "doc_id") -> DataFrame:
    """``parts`` (key, piece, length and more) with ``sequence_id long`` and ``offset long``.

    Every row is placed; a length over a capacity is an error, as it fits nowhere.  Equal rows are placed each for itself,
    an empty table gives an empty one.  ``parts`` is read twice: pass a checkpointed one if it is costly.
    """
    spark = parts.sparkSession
    salts = min(max(16, int(spark.conf.get("spark.sql.shuffle.partitions"))), SALTS)
    rows = parts.withColumn("__salt", F.pmod(F.xxhash64(key, "piece"), F.lit(salts)))
    counts = rows.groupBy("length", "__salt").agg(F.count("*").alias("__n"))
    before = Window.partitionBy("length").orderBy("__salt").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.withColumn("__start", F.coalesce(F.sum("__n").over(before), F.lit(0)))  # a row for each length and salt
    totals = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("__n").alias("n")).collect()}  # at most capacity.tokens rows
    if totals and (max(totals) > capacity.tokens or min(totals) < 1 or max(totals) ** 2 > (capacity.attention or np.inf)):
        raise ValueError("a piece is longer than a sequence may be, or empty")
    steps: dict[int, list[tuple[int, int, int, int]]] = {}
    for length, *step in plan(totals, capacity):
        steps.setdefault(length, []).append(tuple(step))
    kind = "array<struct<a:bigint,b:bigint,first:bigint,at:bigint>>"
    table = spark.createDataFrame([(n, s) for n, s in steps.items()], f"length long, __steps {kind}")
    own = Window.partitionBy("length", "__salt").orderBy(F.col(key).asc_nulls_first(), F.col("piece"))
    ranked = rows.withColumn("__own", F.row_number().over(own) - 1).join(F.broadcast(starts.drop("__n")) if capacity.tokens * salts <= BROADCAST_ROWS else starts.drop("__n"), ["length", "__salt"]).withColumn("__rank", F.col("__start") + F.col("__own"))
    placed = ranked.join(F.broadcast(table), "length")
    step = F.filter("__steps", lambda s: (s["a"] <= F.col("__rank")) & (F.col("__rank") < s["b"]))[0]
    placed = placed.withColumn("__step", step)
    return placed.select(*parts.columns, (F.col("__step.first") + F.col("__rank") - F.col("__step.a")).alias("sequence_id"), F.col("__step.at").alias("offset"))


def pack_documents(df: DataFrame, path: str, capacity: Capacity = Capacity(), end: int = 2, key: str = "doc_id", text: str = "text", added: bool = False) -> DataFrame:
    """Texts tokenised, cut and packed: key, piece, start, length, ids_crc32, sequence_id, offset."""
    return pack(cut(cut_pieces(df, path, capacity.tokens, end, key, text, added)), capacity, key)


def query(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    out = pack_documents(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.tiktoken"), FULL, added=True)
    return out.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
