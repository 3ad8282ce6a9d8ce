"""Exact self-join of texts by the Jaccard likeness of their word n-gram sets.

1. Texts with equal sets become one node.
2. Candidates.  Two sets that link differ in few n-grams, so they agree on some small part, and in little of their size.
   Nodes that agree on a part are chained by size as far as neighbours may link, and the components of that graph bound
   where links can be.
3. T-occurrence search.  Within blocks of candidates an inverted index is searched for every set: short lists are merged,
   long ones probed (DivideSkip), and sets that occur on enough lists are compared in full.
"""

from __future__ import annotations

import heapq
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import groupby

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caresift.llm._support import BROADCAST_ROWS, cut, documents, forget, give_back, slices, small
from caresift.llm._words import U, mix, shingles, words
from caresift.llm.graph import components

#: Counters of the frequency table, of a fixed size whatever the corpus, and in how many slices it is summed.
COUNTERS, COUNTER_SLICES = 1 << 24, 64
#: Signatures that one reducer's bucket should hold, and text bytes whose signatures are sent at once.
BUCKET_SIGNATURES, CHUNK_BYTES = 500_000, 4_000_000
#: Sets in one block of the search.
BLOCK_SETS = 2_000
LEADERS = 8
#: Steps of the size scale for each factor of 100 / percent.
FINE = 16


@dataclass(frozen=True)
class JoinConfig:
    """``percent``: two sets link when 100 * intersection >= percent * union."""

    words: int = 5
    percent: int = 80
    block: int = BLOCK_SETS

    @property
    def by_parts(self) -> bool:
        """High thresholds leave parts of several n-grams; lower ones go by the rarest n-grams of a set."""
        return self.percent >= 88


def node_of(own: np.ndarray) -> int:
    """A 64-bit number of a set of 64-bit hashes, the same for equal sets; signed, for a long column."""
    with np.errstate(over="ignore"):
        total = np.add.reduce(mix(own)) ^ U(len(own))
        other = np.bitwise_xor.reduce(mix(own * U(0xD6E8FEB86659FD93) + U(len(own)))) if len(own) else U(0)
    return int(mix(np.array([total], U) + np.array([other], U) * U(3)).astype(np.int64)[0])


def sets(body: np.ndarray, at: np.ndarray, k: int) -> Iterator[np.ndarray]:
    hashed, _, _, bounds = words(body, at)
    made, where = shingles(hashed, bounds, k)
    for i, j in zip(where[:-1], where[1:], strict=True):
        yield np.unique(made[i:j])


def bands(percent: int, upto: int) -> list[int]:
    """The least size of each band: sets that link are of one band or of neighbouring ones."""
    lows = [1]
    while lows[-1] <= upto:
        lows.append(max(lows[-1] + 1, 100 * (lows[-1] - 1) // percent + 1))
    return lows


def part_signatures(own: np.ndarray, lows: list[int], percent: int) -> np.ndarray:
    """Hashes of a set's parts, for the band of its size and, as the smaller set of a pair, for the next one.

    A pair whose larger set is of a band differs in at most ``most`` n-grams.  The n-grams are dealt into ``most + 1 +
    spare`` parts by hash, so at least ``spare + 1`` parts are equal.  Parts of under two n-grams say little, and a set
    with at most ``spare`` of them leaves them out; then so does, or sends more, any set it shares all of those with.
    """
    out = []
    band = int(np.searchsorted(lows, len(own), "right")) - 1
    for group in (band, band + 1):
        most = 2 * (lows[group + 1] - 1) * (100 - percent) // (100 + percent)
        if not most:
            continue  # only equal sets
        spare = min(4, most // 12)
        count = most + 1 + spare
        part = ((own >> U(32)) % U(count)).astype(np.int64)
        size = np.bincount(part, minlength=count)
        hashed = np.zeros(count, U)
        np.add.at(hashed, part, mix(own + U(group)))
        full = size >= 2
        chosen = full if count - full.sum() <= spare else np.ones(count, bool)
        out.append(mix(mix(hashed + size.astype(U)) + U(group) * U(0x100000001B3) + np.arange(count, dtype=U))[chosen])
    return np.concatenate(out) if out else np.empty(0, U)


def rare_signatures(own: np.ndarray, counters: np.ndarray, percent: int) -> np.ndarray:
    """The set's rarest n-grams: so many that two sets that link have one of them in common.  One order for all sets."""
    need = len(own) - -(-percent * len(own) // 100) + 1
    order = np.lexsort((own, counters[(own >> U(40)).astype(np.int64)]))
    return own[order[:need]]


def size_step(n: int, percent: int) -> int:
    """The size on a scale on which sets that link are at most FINE + 1 apart."""
    return int(np.log(n) / np.log(100 / percent) * FINE) if percent < 100 else 0


def chained(found: np.ndarray, low: np.ndarray, high: np.ndarray, nodes: np.ndarray) -> tuple[np.ndarray, ...]:
    """Runs of one signature whose size ranges leave no gap that a link can't bridge: their signature, low, high and least
    node; and the links (node, least node) in them.

    Two sets that link are in one run: all sizes between theirs are as near as theirs.
    """
    order = np.lexsort((nodes, low, found))
    found, low, high, nodes = found[order], low[order], high[order], nodes[order]
    if not len(found):
        return found, low, high, nodes, np.empty((0, 2), np.int64)
    _, group = np.unique(found, return_inverse=True)
    span = np.int64(1) << 20
    reach = np.maximum.accumulate(group * span + high) - group * span  # of those before in the signature
    new = np.ones(len(found), bool)
    new[1:] = (found[1:] != found[:-1]) | (low[1:] > reach[:-1] + FINE + 1)
    first = np.flatnonzero(new)
    heads = np.minimum.reduceat(nodes, first)
    each = heads[np.cumsum(new) - 1]
    links = np.unique(np.stack([nodes, each], 1)[nodes != each], axis=0)
    return found[first], low[first], np.maximum.reduceat(high, first), heads, links


def count_ngrams(docs: DataFrame, config: JoinConfig) -> np.ndarray:
    """How often n-grams of each of COUNTERS hash classes are in the sets of all texts, as 8 * log2(1 + n); of a fixed size."""
    width = COUNTERS // COUNTER_SLICES

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        low, carried = np.zeros(COUNTERS, np.uint16), Counter()  # the lower 16 bits of each counter, and what few carry over
        for _, body, at in slices(batches):
            name, n = np.unique(np.concatenate([*sets(body, at, config.words), np.empty(0, U)]) >> U(40), return_counts=True)
            name, total = name.astype(np.int64), n + low[name.astype(np.int64)]
            low[name] = total & 0xFFFF
            carried.update({int(k): int(v) for k, v in zip(name[total > 0xFFFF], total[total > 0xFFFF] >> 16, strict=True)})
        parts = []
        for i, x in enumerate(np.split(low, COUNTER_SLICES)):
            x = x.astype(np.float32)
            for k, v in carried.items():
                if k // width == i:
                    x[k % width] += np.float32(v * 65536)
            parts.append(pa.compress(_logarithm(x).tobytes(), codec="zstd", asbytes=True))  # mostly zeros
        del low
        give_back()
        yield pa.RecordBatch.from_arrays([pa.array(range(COUNTER_SLICES), pa.int32()), pa.array(parts, pa.binary())], ["slice", "counts"])

    def add(rows: pd.DataFrame) -> pd.DataFrame:
        total = np.zeros(width, np.float32)
        for x in rows["counts"]:
            total += _POWERS[np.frombuffer(pa.decompress(x, width, codec="zstd", asbytes=True), np.uint8)]
        return pd.DataFrame({"slice": [rows["slice"].iloc[0]], "counts": [pa.compress(_logarithm(total).tobytes(), codec="zstd", asbytes=True)]})

    each = docs.select("text").mapInArrow(count, "slice int, counts binary").withColumn("part", F.spark_partition_id() % 512)
    summed = each.groupBy("slice", "part").applyInPandas(add, "slice int, counts binary") if each.rdd.getNumPartitions() > 512 else each.drop("part")
    done = summed.groupBy("slice").applyInPandas(add, "slice int, counts binary").collect()  # COUNTER_SLICES rows of a fixed size
    out = np.zeros(COUNTERS, np.uint8)
    for r in done:
        out[r["slice"] * width : (r["slice"] + 1) * width] = np.frombuffer(pa.decompress(r["counts"], width, codec="zstd", asbytes=True), np.uint8)
    del each, summed
    forget(docs.sparkSession)
    return out


_POWERS = (np.exp2(np.arange(256) / 8) - 1).astype(np.float32)


def _logarithm(counts: np.ndarray) -> np.ndarray:
    return np.minimum(np.rint(8 * np.log2(1 + counts.astype(np.float32))), 255).astype(np.uint8)


def candidate_links(docs: DataFrame, config: JoinConfig, largest: int, buckets: int) -> DataFrame:
    """(a, b): nodes that share a signature and may link by their sizes, each with the least node of its run.

    Each chunk of texts sends a run of a signature once, with its least node, and links the rest itself: a hot signature
    reaches its reducer a few times from each chunk.
    """
    lows = bands(config.percent, largest)
    lows += [100 * lows[-1] // config.percent + 2]
    shared = None if config.by_parts else docs.sparkSession.sparkContext.broadcast(count_ngrams(docs, config))  # COUNTERS numbers

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        size = 0

        def chunk() -> pa.RecordBatch:
            sizes = [len(x) for x, _ in held.values()]
            nodes = np.repeat(np.fromiter(held, np.int64, len(held)), sizes)
            steps = np.repeat(np.array([n for _, n in held.values()], np.int64), sizes)
            found, low, high, nodes, links = chained(np.concatenate([*(x for x, _ in held.values()), np.empty(0, U)]), steps, steps, nodes)
            bucket = (mix(found) % U(buckets)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            named, first = np.unique(bucket[order], return_index=True)
            edges = [*first, len(found)]
            cuts = [order[i:j] for i, j in zip(edges, edges[1:], strict=False)]
            blob = lambda x: pa.array([x[c].tobytes() for c in cuts], pa.binary())
            columns = [pa.array(named, pa.int64()), blob(found), blob(nodes), blob(low.astype(np.uint16)), blob(high.astype(np.uint16))]
            columns.append(pa.array([links[i :: len(cuts)].tobytes() for i in range(len(cuts))], pa.binary()))
            held.clear()
            return pa.RecordBatch.from_arrays(columns, ["bucket", "signatures", "nodes", "low", "high", "links"])

        for _, body, at in slices(batches):
            for own in sets(body, at, config.words):
                if len(own) and (node := node_of(own)) not in held:
                    made = part_signatures(own, lows, config.percent) if shared is None else rare_signatures(own, shared.value, config.percent)
                    held[node] = made, size_step(len(own), config.percent)
            size += len(body)
            if size >= CHUNK_BYTES:
                yield chunk()
                size = 0
        if held:
            yield chunk()

    def meet(rows: pd.DataFrame) -> pd.DataFrame:
        found, nodes, low, high = (np.concatenate([np.frombuffer(x, k) for x in rows[c]]) for c, k in (("signatures", U), ("nodes", np.int64), ("low", np.uint16), ("high", np.uint16)))
        links = chained(found, low.astype(np.int64), high.astype(np.int64), nodes)[-1]
        own = np.unique(np.concatenate([links, *[np.frombuffer(x, np.int64).reshape(-1, 2) for x in rows.links if x]]), axis=0)
        del found, nodes, low, high, links
        give_back()
        return pd.DataFrame({"a": own[:, 0], "b": own[:, 1]})

    sent = docs.select("text").mapInArrow(send, "bucket long, signatures binary, nodes binary, low binary, high binary, links binary")
    return sent.groupBy("bucket").applyInPandas(meet, "a long, b long")


def divide_skip(index: list[np.ndarray], queries: list[np.ndarray], percent: int, same: np.ndarray) -> list[tuple[int, int]]:
    """(query, index place) links that join sets of different classes.

    ``same``: class numbers of the index's sets, then of the queries'; they are merged as links are found, so that of all
    links between classes one is given.  A query of T needed occurrences splits its lists: the long ones, fewer than T,
    are probed only for sets that occur often enough on the short ones.
    """
    sizes = np.array([len(x) for x in index])
    keys = np.concatenate([*index, np.empty(0, U)])
    owner = np.repeat(np.arange(len(index)), sizes)
    order = np.argsort(keys, kind="stable")
    keys, owner = keys[order], owner[order]
    out = []
    for q, own in enumerate(queries):
        n, me = len(own), len(index) + q
        need = -(-percent * n // 100)
        low, high = np.searchsorted(keys, own, "left"), np.searchsorted(keys, own, "right")
        there = high > low
        low, high = low[there], high[there]
        if len(low) < need:
            continue
        order = np.argsort(high - low, kind="stable")
        low, high = low[order], high[order]
        longest = int(high[-1] - low[-1])
        long = min(need - 1, int(need / (0.01 * np.log2(longest) + 1)))
        split = len(low) - long
        if (total := int((high[:split] - low[:split]).sum())) <= 256:
            merged = [(k, len(list(g))) for k, g in groupby(heapq.merge(*[owner[i:j].tolist() for i, j in zip(low[:split], high[:split], strict=True)]))]
            found, count = np.array([k for k, _ in merged], np.int64), np.array([c for _, c in merged], np.int64)
        else:
            run = np.repeat(low[:split] - np.cumsum(high[:split] - low[:split]) + (high[:split] - low[:split]), high[:split] - low[:split]) + np.arange(total)
            found, count = np.unique(owner[run], return_counts=True)
        keep = (count >= need - long) & (same[found] != same[me]) & (100 * sizes[found] >= percent * n) & (100 * n >= percent * sizes[found])
        found, count = found[keep], count[keep]
        for done, (i, j) in enumerate(zip(low[split:], high[split:], strict=True)):
            if not len(found):
                break
            place = np.searchsorted(owner[i:j], found)
            count = count + (owner[i:j][np.minimum(place, j - i - 1)] == found)
            if not done % 16:
                keep = count + (long - done - 1) >= need
                found, count = found[keep], count[keep]
        for y in found[100 * count >= percent * (n + sizes[found] - count)]:
            if same[y] != same[me]:
                out.append((q, int(y)))
                same[same == same[y]] = same[me]
    return out


def _search(rows: pd.DataFrame, percent: int) -> pd.DataFrame:
    """rows: node, own, indexed, asked, class.  Links (a, b) between nodes."""
    own = [np.frombuffer(x, U) for x in rows.own]
    index, asked = np.flatnonzero(rows.indexed), np.flatnonzero(rows.asked)
    nodes = rows.node.to_numpy()
    _, same = np.unique(np.concatenate([rows["class"].to_numpy()[index], rows["class"].to_numpy()[asked]]), return_inverse=True)
    found = divide_skip([own[i] for i in index], [own[i] for i in asked], percent, same)
    del own
    give_back()
    return pd.DataFrame({"a": [nodes[asked[q]] for q, _ in found], "b": [nodes[index[y]] for _, y in found]}, dtype="int64")


def links(docs: DataFrame, rows: DataFrame, config: JoinConfig, key: str) -> DataFrame:
    """(a, b): links between nodes, enough of them to join all that link, in exact comparison of the whole sets.

    ``docs``: key, text; ``rows``: key, n, node, checkpointed.
    """
    spark = docs.sparkSession
    stats = rows.agg(F.max("n").alias("largest"), F.sum("n").alias("total")).first()
    empty = spark.range(0).select(F.col("id").alias("a"), F.col("id").alias("b"))
    if not stats["largest"]:
        return empty
    expected = stats["total"] * (0.3 if config.by_parts else (100 - config.percent) / 100) + 1
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), int(expected // BUCKET_SIGNATURES) + 1)
    near = cut(components(candidate_links(docs, config, stats["largest"], buckets)))
    forget(spark)

    # one text for each node that has candidates
    block = config.block
    counts = cut(near.groupBy("component").agg(F.count("*").alias("count")))
    most = counts.agg(F.max("count").alias("most"), F.sum(F.when(F.col("count") <= block, F.col("count"))).alias("few")).first()
    if not most["most"]:
        return empty
    members = rows.join(small(cut(near.join(counts, "component"))), "node").groupBy("node").agg(F.min(key).alias("__key"), F.first("component").alias("component"), F.first("count").alias("count"), F.first("n").alias("n"))
    members = members.select("node", "component", "count", _band(F.col("n"), bands(config.percent, stats["largest"])).alias("band"), "__key")
    members = small(cut(members))
    text = docs.select(F.col(key).alias("__own"), "text").join(members, F.col("__own").eqNullSafe(F.col("__key")))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, body, at in slices(batches):
            made = list(sets(body, at, config.words))
            fits = pa.array([len(x) > 0 and node_of(x) == n for x, n in zip(made, batch.column(1).to_pylist(), strict=True)])  # not another text under a repeated key
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array([x.tobytes() for x in made], pa.binary())], ["node", "component", "count", "band", "own"]).filter(fits)

    full = lambda wanted: text.where(wanted).select("text", "node", "component", "count", "band").mapInArrow(read, "node long, component long, count long, band int, own binary")
    few = full(F.col("count") <= block)
    groups = max(1, (most["few"] or 0) // block)
    kinds = "a long, b long"
    search = lambda pdf: _search(pdf, config.percent)
    yes, no = F.lit(True), F.lit(False)
    columns = ["group", "node", "own", "indexed", "asked", "class"]
    inside = few.select(F.pmod(F.xxhash64("component"), F.lit(groups)).alias("group"), "node", "own", yes.alias("indexed"), yes.alias("asked"), F.col("node").alias("class"))
    search_all = lambda df: df.select(columns).groupBy("group").applyInPandas(search, kinds)
    if most["most"] <= block:
        return search_all(inside)
    # A component over one block is dealt by size: a set is compared with those of its own band and the next smaller one.
    many = cut(full(F.col("count") > block))
    units = small(cut(many.groupBy("component", "band").agg(F.ceil(F.count("*") / block).cast("int").alias("parts"))))
    own = many.join(units, ["component", "band"]).withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))

    def dealt(index: DataFrame, queries: DataFrame, split: bool) -> DataFrame:
        """Each query set meets the index sets of its band and its neighbours; the other way round alike where all sets ask.

        ``split``: the index by its parts and both neighbours, else as a whole and the smaller one.
        """
        bands_near = F.array(*[F.col("band") + i for i in ((-1, 0, 1) if split else (-1, 0))])
        aim = queries.withColumnRenamed("part", "other").drop("parts").withColumn("aim", F.explode(bands_near))
        aim = aim.join(units.withColumnRenamed("band", "aim"), ["component", "aim"]).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)) if split else F.lit(0))
        there = small(cut(aim.select("component", "aim", "band", "other").distinct().withColumnRenamed("band", "from")))
        met = index.withColumnRenamed("band", "aim").withColumn("part", F.col("part") if split else F.lit(0)).join(there, ["component", "aim"])
        group = F.xxhash64("component", "aim", "from", "part", "other").alias("group")
        return met.select(group, "node", "own", yes.alias("indexed"), no.alias("asked"), "class").unionByName(aim.withColumnRenamed("band", "from").select(group, "node", "own", no.alias("indexed"), yes.alias("asked"), "class"))

    # First against a few sets of each band ...
    fresh = own.withColumn("class", F.col("node"))
    leaders = many.groupBy("component", "band", F.pmod(F.xxhash64("node", F.lit(1)), F.lit(LEADERS)).alias("turn")).agg(F.min("node").alias("node")).select("node")
    leaders = small(cut(leaders))
    found = cut(search_all(inside.unionByName(dealt(fresh.join(leaders, "node"), fresh, False))))
    # ... then, whatever isn't in its component's largest class yet, against all sets
    known = small(cut(components(found).withColumnRenamed("component", "class")))
    forget(spark)
    classed = own.join(known, "node", "left").withColumn("class", F.coalesce("class", "node"))
    top = classed.groupBy("component", "class").agg(F.count("*").alias("size")).groupBy("component").agg(F.max_by("class", F.struct("size", "class")).alias("main"))
    rest = classed.join(F.broadcast(top) if most["most"] <= BROADCAST_ROWS else top, "component").where("class <> main").drop("main")
    return found.unionByName(search_all(dealt(classed, rest, True)))


def _band(size: Column, lows: list[int]) -> Column:
    return F.size(F.filter(F.array(*[F.lit(x) for x in lows]), lambda low: low <= size))


def with_nodes(df: DataFrame, config: JoinConfig = JoinConfig(), text: str = "text", out: str = "node") -> DataFrame:
    """``df`` with the number of each text's set as ``out``, null for an empty set."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, body, at in slices(batches, text):
            yield batch.append_column(out, pa.array([node_of(x) if len(x) else None for x in sets(body, at, config.words)], pa.int64()))

    return df.mapInArrow(read, df.withColumn(out, F.lit(None).cast("long")).schema)


def grouped(df: DataFrame, config: JoinConfig = JoinConfig(), key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``join_texts``, with ``node``, the number of the text's set, and ``root``, that of its component.

    Both are null for an empty set.
    """
    docs = df.select(F.col(key), F.col(text).alias("text"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, body, at in slices(batches):
            made = [(len(x), node_of(x) if len(x) else None) for x in sets(body, at, config.words)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([n for n, _ in made], pa.int64()), pa.array([x for _, x in made], pa.int64())], [key, "n", "node"])

    rows = cut(docs.mapInArrow(read, f"`{key}` {docs.schema[key].dataType.simpleString()}, n long, node long"))
    known = components(links(docs, rows, config, key)).withColumnRenamed("component", "root")
    placed = rows.join(known, "node", "left").withColumn("root", F.coalesce("root", "node"))
    least = placed.where("root is not null").groupBy("root").agg(F.min(key).alias("__least"))
    return placed.join(least, "root", "left").select(key, F.col("n").alias("n_shingles"), F.when(F.col("root").isNull(), F.col(key)).otherwise(F.col("__least")).alias("component_id"), "node", "root")


def join_texts(df: DataFrame, config: JoinConfig = JoinConfig(), key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_shingles long, component_id: the least key that can be reached by links, one's own included.

    Texts are lower-cased (A-Z) and cut into words at blanks and the bytes 9 to 13.  A text of fewer words than
    ``config.words`` has its whole sequence as its one n-gram.  A null text, or one without words, has an empty set, which
    links with nothing.  Every row gives one row; rows of one key are told apart by their texts; a null key is no least key
    unless its whole component has none.
    """
    return grouped(df, config, key, text).select(key, "n_shingles", "component_id")


def query(spark, sf_dir: str) -> DataFrame:
    return join_texts(documents(spark, sf_dir), JoinConfig(words=3, percent=90))
