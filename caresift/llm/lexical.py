"""Ranked lexical search over bit-sliced Bloom signatures.

The index holds blocks of documents.  A document's signature is a Bloom filter of its (term, level) pairs, where level j is
set when the term occurs ``LEVELS[j]`` times at least; a block stores the signatures of its documents sliced by bit, each
slice a bitmap over the block's documents.  A query term's bitmaps, each the conjunction of a few slices, overestimate
where it occurs and how often, so weighted sums of them are upper bounds of scores.  A search

1. takes the documents of the highest bounds, scores them exactly, and so knows a score that the last of the best reach,
2. scores exactly every document whose bound reaches it: what is left out is proven to be beneath.

Documents of like size share a block, so that a block's number of bits fits all of them.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from caresift.llm._support import cut, documents, give_back, remove, written
from caresift.llm._words import U, mix

LEVELS = (1, 2, 3, 4, 6, 8, 12, 16, 24, 32, 48, 64)
#: Slices of a pair, and bits for each pair of the block's largest document.
HASHES, BITS = 3, 10
#: Most documents of a block, and most cells (documents times bits) of one with more than 8.
ROWS, CELLS = 2048, 16_000_000
#: Bytes of one text that are split at once.
PIECE = 4_000_000
#: (item, term) pairs that are searched for at once; more items go in further rounds.
ASKED = 200_000
#: Items that a task takes at once for a block, and (item, document) candidates up to which they are broadcast.
ITEMS, CANDIDATES = 32, 1_000_000

#: Letters of terms: A-Z in lower case, a-z, 0-9, and all bytes of code points over 127; all else separates.
_TERM = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c > 127 else 32 for c in range(256))
_SEPARATORS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def counted(text: str | None) -> Counter:
    """Each term of a text and how often it occurs; the text is split in pieces, no term is cut."""
    data = (text or "").encode("utf-8").translate(_TERM)
    out: Counter = Counter()
    at = 0
    while at < len(data):
        end = len(data) if at + PIECE >= len(data) else data.find(b" ", at + PIECE)
        end = len(data) if end < 0 else end
        out.update(data[at:end].split())
        at = end
    return out


def places(hashed: np.ndarray, level: int, bits: int) -> np.ndarray:
    """The HASHES slices of each term at a level."""
    x = mix(hashed + U((level + 1) * 0x9E3779B97F4A7C15 % (1 << 64)))
    first, step = x & U(0xFFFFFFFF), (x >> U(32)) | U(1)
    return np.stack([((first + U(i) * step) % U(bits)).astype(np.int64) for i in range(HASHES)])


def block(docs: list[tuple[np.ndarray, np.ndarray]]) -> tuple[int, np.ndarray]:
    """Bits and packed slices (bits x documents / 8) of documents given as term hashes and counts."""
    wide = -(-len(docs) // 8) * 8
    bits = max(64, BITS * max(pairs_of(f) for _, f in docs))
    cells = np.zeros(bits * wide, bool)
    hashed, often = np.concatenate([h for h, _ in docs]), np.concatenate([f for _, f in docs])
    column = np.repeat(np.arange(len(docs)), [len(h) for h, _ in docs])
    for level, least in enumerate(LEVELS):
        own = often >= least
        if not own.any():
            break
        for place in places(hashed[own], level, bits):
            cells[place * wide + column[own]] = True
    return bits, np.packbits(cells.reshape(bits, wide), axis=1)


def pairs_of(often: np.ndarray) -> int:
    return int(np.searchsorted(LEVELS, often, "right").sum())


@dataclass
class Index:
    """``blocks``: keys, lengths, bits, slices, and terms and dfs (of a batch of documents, in one of its blocks)."""

    blocks: DataFrame
    docs: int  #: with a term at least
    length: int  #: of all documents, in terms

    def drop(self) -> None:
        """Deletes the index's table."""
        remove(self.blocks)


def build(df: DataFrame, key: str = "doc_id", text: str = "text") -> Index:
    """An index of every row of ``df`` in the shared folder; it knows no queries.  Rows without terms are in it and never found."""
    kind = df.schema[key].dataType
    rows = df.select(F.col(key).alias("key"), F.col(text).alias("text"))
    schema = f"keys array<{kind.simpleString()}>, lengths array<long>, bits int, slices binary, terms array<string>, dfs array<long>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[bytes, int] = {}

        def number(word: bytes) -> int:
            if len(known) > 1_000_000:
                known.clear()
            known[word] = x = xxhash.xxh64_intdigest(word)
            return x

        for batch in batches:
            held, docs = [], Counter()
            for i, text in enumerate(batch.column(1)):
                found = counted(text.as_py())
                docs.update(found.keys())
                often = np.fromiter(found.values(), np.int64, len(found))
                hashed = np.fromiter((known.get(w) or number(w) for w in found), U, len(found))
                held.append((pairs_of(often), i, int(often.sum()), hashed, often))
            held.sort(key=lambda x: x[:2])
            at = 0
            while at < len(held):
                end = at + 1
                while end < len(held) and end - at < ROWS and (end + 1 - at <= 8 or (end + 1 - at) * BITS * held[end][0] <= CELLS):
                    end += 1
                part = held[at:end]
                bits, slices = block([(h, f) for *_, h, f in part])
                keys = pa.ListArray.from_arrays(pa.array([0, len(part)], pa.int32()), batch.column(0).take(pa.array([i for _, i, *_ in part])))
                words = [w.decode("utf-8") for w in docs] if not at else []
                yield pa.RecordBatch.from_arrays([keys, pa.array([[n for _, _, n, *_ in part]], pa.list_(pa.int64())), pa.array([bits], pa.int32()), pa.array([slices.tobytes()], pa.binary()), pa.array([words], pa.list_(pa.string())), pa.array([list(docs.values()) if not at else []], pa.list_(pa.int64()))], names=["keys", "lengths", "bits", "slices", "terms", "dfs"])
                del slices
                at = end
            held.clear()
            give_back()

    blocks = written(rows.mapInArrow(run, schema))
    long = lambda x: x.cast("long")
    told = blocks.agg(F.sum(F.size(F.filter("lengths", lambda n: n > 0))).alias("docs"), F.sum(F.aggregate("lengths", long(F.lit(0)), lambda a, n: a + n)).alias("length")).first()
    return Index(blocks, told.docs or 0, told.length or 0)


@dataclass
class Asked:
    """Items as arrays: ``terms`` with weight and hash, and of each item its terms' numbers."""

    terms: list[bytes]
    weight: np.ndarray
    hashed: np.ndarray
    flat: np.ndarray
    start: np.ndarray
    rows: np.ndarray  #: the items' numbers
    docs: int
    length: int

    def unit(self, lengths: np.ndarray) -> np.ndarray:
        return np.array([100 - 50 + 50 * int(n) * self.docs // self.length for n in lengths], np.int64)


def bounds(asked: Asked, lengths: np.ndarray, bits: int, slices: bytes) -> Iterator[tuple[int, np.ndarray]]:
    """Of each item its position and, for all documents of a block, an upper bound of the score."""
    wide = -(-len(lengths) // 8)
    table = np.frombuffer(slices, np.uint8).reshape(bits, wide)
    unit = asked.unit(lengths)
    gain = np.zeros((len(LEVELS) + 1, len(lengths)), np.int64)
    for j in range(len(LEVELS)):
        most = np.minimum(LEVELS[j + 1] - 1, lengths) if j + 1 < len(LEVELS) else lengths
        gain[j + 1] = 1_000_000_000 * most // (1000 * most + 20 * unit)
    column = np.arange(len(lengths))
    ends = np.append(asked.start[1:], len(asked.flat))
    for low in range(0, len(asked.start), ITEMS):
        high = min(low + ITEMS, len(asked.start))
        own, inside = np.unique(asked.flat[asked.start[low] : ends[high - 1]], return_inverse=True)
        level = np.zeros((len(own), len(lengths)), np.uint8)
        alive, now = np.arange(len(own)), None
        for j in range(len(LEVELS)):
            for place in places(asked.hashed[own[alive]], j, bits):
                now = table[place] if now is None else now & table[place]
            some = now.any(1)
            alive, now = alive[some], now[some]
            if not len(alive):
                break
            level[alive] += np.unpackbits(now, axis=1)[:, : len(lengths)]
        worth = gain[level, column] * asked.weight[own][:, None]
        for i in range(low, high):
            yield i, worth[inside[asked.start[i] - asked.start[low] : ends[i] - asked.start[low]]].sum(0)


def _asked(index: Index, part: DataFrame) -> Asked | None:
    """``part``: __item, term, at most about ASKED rows, which come to the driver."""
    part = cut(part)
    words = F.broadcast(part.select("term").distinct())  # ASKED rows at most
    df = index.blocks.where(F.size("terms") > 0).select(F.explode(F.arrays_zip("terms", "dfs")).alias("x")).select(F.col("x.terms").alias("term"), F.col("x.dfs").alias("df"))
    known = {r.term.encode(): r.df for r in df.join(words, "term").groupBy("term").agg(F.sum("df").alias("df")).collect()}
    weight = {w: math.floor(1000 * math.log((2 * index.docs + 2) / (2 * n + 1))) for w, n in known.items()}
    number = {w: i for i, w in enumerate(weight)}
    rows = [(r["__item"], number[r.term.encode()]) for r in part.collect() if r.term.encode() in number]
    if not rows:
        return None
    item, flat = np.array(sorted(rows), np.int64).T
    start = np.flatnonzero(np.append(True, np.diff(item) > 0))
    return Asked(list(weight), np.array(list(weight.values()), np.int64), np.array([xxhash.xxh64_intdigest(w) for w in weight], U), flat, start, item[start], index.docs, index.length)


def _round(index: Index, rows: DataFrame, asked: Asked, best: int) -> DataFrame:
    """__item, key, score of the best documents of each item.  ``rows``: key, text."""
    spark = rows.sparkSession
    kind = index.blocks.schema["keys"].dataType.elementType.simpleString()
    sent = spark.sparkContext.broadcast(asked)
    blocks = index.blocks.select("keys", "lengths", "bits", "slices")

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, np.ndarray, int, bytes]]:
        for batch in batches:
            for i in range(batch.num_rows):
                yield batch.column(0)[i].values, batch.column(1)[i].values.to_numpy(zero_copy_only=False), batch.column(2)[i].as_py(), batch.column(3)[i].as_py()
            give_back()

    def highest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, lengths, bits, slices in parts(batches):
            items, values, taken = [], [], []
            for i, bound in bounds(sent.value, lengths, bits, slices):
                top = np.argpartition(bound, len(bound) - best)[len(bound) - best :] if len(bound) > best else np.arange(len(bound))
                top = top[bound[top] > 0]
                items.append(np.full(len(top), i, np.int32))
                values.append(bound[top])
                taken.append(top)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(items)), pa.array(np.concatenate(values)), keys.take(pa.array(np.concatenate(taken)))], names=["item", "bound", "key"])

    def reaching(least: np.ndarray):
        known = spark.sparkContext.broadcast(least)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for keys, lengths, bits, slices in parts(batches):
                items, taken = [], []
                for i, bound in bounds(sent.value, lengths, bits, slices):
                    found = np.flatnonzero(bound >= known.value[i])
                    items.append(np.full(len(found), i, np.int32))
                    taken.append(found)
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(items)), keys.take(pa.array(np.concatenate(taken)))], names=["item", "key"])

        return run

    def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked, number = sent.value, {w: i for i, w in enumerate(sent.value.terms)}
        for batch in batches:
            items, scores, taken = [], [], []
            for i in range(batch.num_rows):
                found = counted(batch.column(1)[i].as_py())
                unit = int(asked.unit(np.array([found.total()]))[0])
                worth = np.zeros(len(asked.terms), np.int64)
                for w in found.keys() & number.keys():
                    worth[number[w]] = asked.weight[number[w]] * (1_000_000_000 * found[w] // (1000 * found[w] + 20 * unit))
                own = batch.column(2)[i].values.to_numpy()
                score = np.add.reduceat(worth[asked.flat], asked.start)[own]
                items.append(own[score > 0])
                scores.append(score[score > 0])
                taken.append(np.full(len(items[-1]), i))
            if items:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(items).astype(np.int32)), batch.column(0).take(pa.array(np.concatenate(taken))), pa.array(np.concatenate(scores))], names=["item", "key", "score"])
            give_back()

    def scored(pairs: DataFrame) -> DataFrame:
        """Exact scores of all rows with the key of a pair: a superset of the pairs where keys repeat."""
        by_key = cut(pairs.groupBy("key").agg(F.collect_set("item").alias("items")))  # a key has each item once
        few = (by_key.agg(F.sum(F.size("items"))).first()[0] or 0) <= CANDIDATES
        by_key = F.broadcast(by_key) if few else by_key.hint("merge")
        joined = rows.join(by_key.withColumnRenamed("key", "__key"), F.col("key").eqNullSafe(F.col("__key"))).select("key", "text", "items")
        return joined.mapInArrow(exact, f"item int, key {kind}, score long")

    place = F.row_number().over(Window.partitionBy("item").orderBy(F.col("bound").desc(), "key"))
    pilots = blocks.mapInArrow(highest, f"item int, bound long, key {kind}").withColumn("__n", place).where(F.col("__n") <= best)
    place = F.row_number().over(Window.partitionBy("item").orderBy(F.col("score").desc(), "key"))
    reached = scored(pilots.select("item", "key")).withColumn("rank", place).where(F.col("rank") <= best)
    least = np.ones(len(asked.start), np.int64)
    for r in reached.where(F.col("rank") == best).select("item", "score").collect():  # a row for each item at most
        least[r.item] = max(1, r.score)
    found = scored(blocks.mapInArrow(reaching(least), f"item int, key {kind}"))
    out = cut(found.withColumn("rank", place).where(F.col("rank") <= best))
    names = spark.createDataFrame([(i, int(x)) for i, x in enumerate(asked.rows)], "item int, __item long")
    return out.join(F.broadcast(names), "item").select("__item", "rank", "key", "score")


def search(index: Index, df: DataFrame, items: DataFrame, best: int = 50, key: str = "doc_id", text: str = "text", item: str = "item_id", asked: str = "text") -> DataFrame:
    """``item``, rank, ``key``, score: the ``best`` rows of ``df``, whose index is ``index``, for each row of ``items``.

    A term's weight is floor(1000 ln((2 N + 2) / (2 df + 1))); a document's score sums weight * (10^9 tf div (1000 tf +
    20 m)) over the item's terms, once each, with m = 50 + 50 n N div L.  Equal scores go by ascending key, a null key
    first.  Null and empty texts are never found; items without a known term have no rows; repeated rows count each,
    documents and items alike; an empty table gives an empty table; other columns are not looked at.
    """
    words = F.array_distinct(F.filter(F.split(F.translate(F.coalesce(F.col(asked), F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), _SEPARATORS), lambda w: w != ""))
    queries = cut(items.select(F.col(item).alias("__name"), words.alias("__terms"), F.monotonically_increasing_id().alias("__item")))
    pairs = queries.agg(F.sum(F.size("__terms"))).first()[0] or 0
    rounds = -(-pairs // ASKED)
    rows = df.select(F.col(key).alias("key"), F.col(text).alias("text"))
    out = None
    for i in range(rounds if index.docs else 0):
        part = _asked(index, queries.where(F.pmod(F.xxhash64("__item"), F.lit(rounds)) == i).select("__item", F.explode("__terms").alias("term")))
        if part is not None:
            found = _round(index, rows, part, best)
            out = found if out is None else out.unionByName(found)
    if out is None:
        out = queries.limit(0).select("__item", F.lit(0).alias("rank"), F.lit(None).cast(df.schema[key].dataType).alias("key"), F.lit(0).cast("long").alias("score"))
    return out.join(queries.select("__item", "__name"), "__item").select(F.col("__name").alias(item), "rank", F.col("key").alias(key), "score")


def query(spark, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    index = build(docs)
    out = cut(search(index, docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")))
    index.drop()
    return out


ORACLE_SQL = r"""
WITH d AS (
    SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents
), s AS (SELECT count(*) AS n_docs, sum(len(w))::BIGINT AS l FROM d WHERE len(w) > 0
), q AS (
    SELECT item_id, unnest(list_distinct(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'))) AS term FROM benchmark
), t AS (SELECT doc_id, len(w) AS n, unnest(w) AS term FROM d
), f AS (SELECT doc_id, n, term, count(*) AS tf FROM t SEMI JOIN q USING (term) GROUP BY ALL
), w AS (SELECT term, floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * df + 1)::DOUBLE))::BIGINT AS weight FROM (SELECT term, count(*) AS df FROM f GROUP BY term), s
), c AS (SELECT doc_id, term, weight * ((1000000000 * tf) // (1000 * tf + 20 * (100 - 50 + (50 * n * n_docs) // l))) AS worth FROM f JOIN w USING (term), s
), x AS (SELECT item_id, doc_id, sum(worth)::BIGINT AS score FROM q JOIN c USING (term) GROUP BY ALL
), r AS (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INT AS rank, doc_id, score FROM x WHERE score > 0)
SELECT * FROM r WHERE rank <= 50
"""
