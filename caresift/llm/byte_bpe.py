"""Byte-level BPE with the merges as Spark higher-order functions over a rank map in two arrays.

Texts are split by the tokenizer's pattern.  The words of the whole corpus are counted, and the most frequent ones, a
bounded number, are folded once in the JVM: each word's bytes are an array, and the adjacent pair of least rank is merged,
again and again.  Their ids go to all tasks.  Each block of texts then sends only the distinct words that are not among
them to the same fold.  Blocks keep every step in one stage without a shuffle, and memory follows the block.
"""

from __future__ import annotations

import base64
import functools
import json
from array import array
from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caresift.llm._support import cut, documents, give_back, slices
from caresift.llm._words import pieces

#: Slots of the rank map, and lists of its keys that share a displacement; both are primes.
SLOTS, LISTS = 393_241, 98_317
#: The columns of the rank map beside each block of words.
TABLE, TABLE_TYPES = ("slots", "moved"), "slots array<bigint>, moved array<bigint>"
#: Stands before and after each word's bytes; no pair has it.
EDGE = 65_535
#: Text bytes, and words to fold, in one block.
BLOCK_BYTES, BLOCK_WORDS = 4_000_000, 20_000
#: Words that are folded once for all blocks, and their longest length in bytes: some 12 MB of numbers in each task.
COMMON_WORDS, COMMON_BYTES = 500_000, 64
#: Distinct words that a task holds while it counts.
COUNTED_WORDS = 100_000
#: Longer words fold outside the JVM, by the same rule with a heap: the fold copies the word at each merge.
LONG_WORD = 512


@functools.lru_cache(4)
def read_ranks(path: str) -> dict[bytes, int]:
    return {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}


def pair_ranks(path: str) -> dict[int, int]:
    """left rank * 65536 + right rank: the rank of the two pieces joined."""
    ranks = read_ranks(path)
    if max(ranks.values()) >= EDGE:
        raise ValueError("ranks have to be under 65535")
    out = {}
    for piece, rank in ranks.items():
        for i in range(1, len(piece)):
            left, right = ranks.get(piece[:i]), ranks.get(piece[i:])
            if left is not None and right is not None:
                out[left * 65536 + right] = rank
    return out


def _slots(path: str) -> tuple[list[int], list[int]]:
    """The rank map's slots and displacements.

    Spark looks through a map literal from its start, so the map is two arrays: a key's list tells the displacement, key
    and displacement tell the slot, and the slot holds ``key * 65536 + rank``.  Lists are placed from the longest down.
    """
    lists: dict[int, list[int]] = {}
    pairs = pair_ranks(path)
    for key in pairs:
        lists.setdefault(key % LISTS, []).append(key)
    slots, moved = [(1 << 47) - 1] * SLOTS, [0] * LISTS
    taken = bytearray(SLOTS)
    for number, keys in sorted(lists.items(), key=lambda x: (-len(x[1]), x[0])):
        move = 0
        while True:
            places = {(key ^ move) % SLOTS for key in keys}
            if len(places) == len(keys) and not any(taken[x] for x in places):
                break
            move = (move * 6364136223846793005 + 1442695040888963407) % (1 << 40)
        moved[number] = move
        for key in keys:
            slots[(key ^ move) % SLOTS] = key * 65536 + pairs[key]
            taken[(key ^ move) % SLOTS] = 1
    return slots, moved


@functools.lru_cache(4)
def _names(path: str) -> str:
    """JSON of the pieces' hex by rank."""
    ranks = read_ranks(path)
    named = [""] * (max(ranks.values()) + 1)
    for piece, rank in ranks.items():
        named[rank] = piece.hex()
    return json.dumps(named)


def bound(value: Column, body) -> Column:
    """``body(value)`` with the value computed once."""
    return F.transform(F.array(value), body)[0]


@functools.lru_cache(4)
def rank_arrays(path: str) -> tuple[np.ndarray, np.ndarray]:
    """The rank map's slots and displacements, 4 MB of numbers, made once in the driver and broadcast.

    Tasks add them to each block of words.  As literals they would stand in the driver's plans, once for each stage and in
    each description of a plan, and in the heap of each task as single objects.
    """
    slots, moved = _slots(path)
    return np.array(slots, np.int64), np.array(moved, np.int64)


def piece_list(path: str) -> Column:
    return F.from_json(F.lit(_names(path)), "array<string>")


def fold_word(word: Column, table: tuple[Column, Column]) -> Column:
    """array<int>: what is left of a word's pieces, an array<bigint> with EDGE at both ends, when no pair can be merged.

    The state is one array: for each piece, the rank of the pair it begins and, in the low 16 bits, the piece.
    """
    slots, moved = table
    whole = F.lit(65536).cast("long")

    def pair(left: Column, right: Column) -> Column:
        """The state of ``left`` before ``right``; its rank is over EDGE if the two have none: then the slot's key differs."""
        key = left * whole + right
        slot = key.bitwiseXOR(F.get(moved, (key % LISTS).cast("int"))) % SLOTS
        return F.least(F.get(slots, slot.cast("int")).bitwiseXOR(key * whole), whole) * whole + left

    def piece(state: Column, place: Column) -> Column:
        return F.get(state, place).bitwiseAND(F.lit(65535))

    def merged(state: Column, p: Column, new: Column) -> Column:
        made = F.array(pair(piece(state, p - 2), new), pair(new, piece(state, p + 1)))
        return F.concat(F.slice(state, F.lit(1), p - 2), made, F.slice(state, p + 2, F.lit(1 << 20)))

    def step(state: Column, _: Column) -> Column:
        def act(least: Column) -> Column:
            return F.when(least >= EDGE * 65536, state).otherwise(bound(F.array_position(state, least).cast("int"), lambda p: merged(state, p, F.shiftright(least, 16))))

        return bound(F.array_min(state), act)

    start = F.zip_with(word, F.slice(word, F.lit(2), F.size(word)), lambda left, right: pair(left, F.coalesce(right, F.lit(EDGE).cast("long"))))
    folded = F.transform(F.aggregate(F.sequence(F.lit(1), F.size(word) - 2), start, step), lambda x: x.bitwiseAND(F.lit(65535)))
    return F.filter(F.when(F.size(word) <= 3, word).otherwise(folded), lambda x: x < EDGE).cast("array<int>")


def fold_words(words: Column, table: tuple[Column, Column]) -> Column:
    """array<array<int>>: every word of an array folded.  ``table``: the columns of the rank map."""
    return F.transform(words, lambda w: fold_word(w, table))


def fold_long(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The same merges for one long word: a heap of pairs and links between what is left."""
    from heapq import heapify, heappop, heappush

    if word in ranks:
        return [ranks[word]]
    n = len(word)
    part: list[bytes | None] = [word[i : i + 1] for i in range(n)]
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    heap = [(r, i, word[i : i + 2]) for i in range(n - 1) if (r := ranks.get(word[i : i + 2])) is not None]
    heapify(heap)
    while heap:
        _, i, pair = heappop(heap)
        j = after[i]
        if part[i] is None or j >= n or part[i] + part[j] != pair:
            continue
        part[i], part[j] = pair, None
        after[i] = after[j]
        if after[i] < n:
            before[after[i]] = i
        for a, b in ((before[i], i), (i, after[i])):
            if a >= 0 and b < n and (r := ranks.get(part[a] + part[b])) is not None:
                heappush(heap, (r, a, part[a] + part[b]))
    return [ranks[p] for p in part if p is not None]


def _parts(said: list[bytes], ranks: dict[bytes, int]) -> tuple[pa.ListArray, pa.Array]:
    """The words' bytes as arrays of ranks with EDGE at both ends, and the words that are too long for the fold.

    A word that is a piece is that piece, whatever the merges would give.
    """
    single = np.array([ranks[bytes([b])] for b in range(256)], np.int64)
    size = np.fromiter(map(len, said), np.int64, len(said))
    whole = np.fromiter((ranks.get(b, -1) for b in said), np.int64, len(said))
    long = (size > LONG_WORD) & (whole < 0)
    size = np.where(long, 0, size)
    flat = single[np.frombuffer(b"".join(b for b, n in zip(said, size.tolist(), strict=True) if n), np.uint8)]
    ends = np.concatenate([[0], np.cumsum(np.where(whole >= 0, 1, size) + 2)])
    parts = np.full(ends[-1], EDGE)
    merge = np.flatnonzero((whole < 0) & (size > 0))
    begin = np.concatenate([[0], np.cumsum(size)])[:-1]
    place = lambda start: np.repeat(start - np.cumsum(size[merge]) + size[merge], size[merge]) + np.arange(size[merge].sum())
    parts[place(ends[merge] + 1)] = flat[place(begin[merge])]
    parts[ends[:-1][whole >= 0] + 1] = whole[whole >= 0]
    return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(parts)), pa.array([w if n else None for w, n in zip(said, long.tolist(), strict=True)], pa.binary())


def _as_one(values: pa.Array) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)


def _words_of(batches: Iterator[pa.RecordBatch], text: str) -> Iterator[tuple]:
    """Of runs of rows: their batch, the joined text, each distinct word's hash, first and last sign and count, each word's place among them, each row's range of words."""
    for batch, body, at in slices(batches, text, most=250_000):
        joined, hashed, first, last, bounds = pieces(body, at)
        name, where, which, n = np.unique(hashed, return_index=True, return_inverse=True, return_counts=True)
        yield batch, len(body), joined, name, first[where], last[where], n, which, bounds


def word_counts(df: DataFrame, text: str = "text") -> DataFrame:
    """word binary, hash long, n long: how often the words of at most COMMON_BYTES occur in all texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, int] = {}
        hashes, counts = array("Q"), array("q")

        def rows() -> pa.RecordBatch:
            said = [w.encode() for w in seen]
            short = pa.array([len(w) <= COMMON_BYTES for w in said])
            out = pa.RecordBatch.from_arrays([pa.array(said, pa.binary()), pa.array(np.array(hashes, np.uint64).astype(np.int64)), pa.array(np.array(counts, np.int64))], ["word", "hash", "n"])
            seen.clear()
            del hashes[:], counts[:]
            return out.filter(short)

        for _, _, joined, name, first, last, n, _, _ in _words_of(batches, text):
            for h, i, j, c in zip(name.tolist(), first.tolist(), last.tolist(), n.tolist(), strict=True):
                own = seen.setdefault(joined[i:j], len(seen))
                if own == len(hashes):
                    hashes.append(h)
                    counts.append(c)
                else:
                    counts[own] += c
            if len(seen) > COUNTED_WORDS:
                yield rows()
        if seen:
            yield rows()

    made = df.select(F.col(text).alias("text")).mapInArrow(run, "word binary, hash long, n long")
    return made.groupBy("word").agg(F.first("hash").alias("hash"), F.sum("n").alias("n"))


def common_words(df: DataFrame, path: str, most: int = COMMON_WORDS, text: str = "text") -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes, in order, of the most frequent words, where the ids of each begin, and the ids.

    At most ``most`` words, and all of those that occur equally often or none, so only numbers of a fixed size reach the
    driver: a count for each of a few thousand frequencies, then the words' ids.
    """
    counts = cut(word_counts(df, text))
    floor = F.pow(F.lit(2.0), F.greatest(F.lit(0), F.floor(F.log2("n")) - 8)).cast("long")  # frequencies to 9 binary digits
    several = counts.groupBy((F.floor(F.col("n") / floor).cast("long") * floor).alias("n")).agg(F.count("*").alias("words")).collect()
    least, total = None, 0
    for r in sorted(several, key=lambda r: -r["n"]):
        if (total := total + r["words"]) > most:
            break
        least = r["n"]
    if least is None:
        return np.empty(0, np.uint64), np.zeros(1, np.int32), np.empty(0, np.uint16)
    chosen = counts.where(F.col("n") >= least)
    twice = chosen.groupBy("hash").count().where("count > 1").select("hash")  # words of one hash stay with their blocks
    chosen = chosen.join(twice, "hash", "left_anti").select("hash", "word")

    table = df.sparkSession.sparkContext.broadcast(rank_arrays(path))

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks = read_ranks(path)
        for whole in batches:
            for at in range(0, whole.num_rows, BLOCK_WORDS):
                batch = whole.slice(at, BLOCK_WORDS)
                yield pa.RecordBatch.from_arrays([_as_one(batch.column(0)), _as_one(_parts(batch.column(1).to_pylist(), ranks)[0]), *(_as_one(pa.array(x)) for x in table.value)], ["hashes", "words", *TABLE])

    made = chosen.mapInArrow(listed, f"hashes array<bigint>, words array<array<bigint>>, {TABLE_TYPES}")
    made = made.select("hashes", fold_words(F.col("words"), tuple(map(F.col, TABLE))).alias("ids")).toArrow()  # COMMON_WORDS words at most
    hashed = np.concatenate([np.empty(0, np.int64), *(x.values.to_numpy(zero_copy_only=False) for x in made["hashes"])]).astype(np.uint64)
    sizes, ids = [np.empty(0, np.int64)], [np.empty(0, np.uint16)]
    for x in made["ids"]:
        sizes.append(np.diff(x.values.offsets.to_numpy()))
        ids.append(x.values.flatten().to_numpy(zero_copy_only=False).astype(np.uint16))
    size, flat = np.concatenate(sizes), np.concatenate(ids)
    order = np.argsort(hashed)
    begin = np.cumsum(size) - size
    ends = np.concatenate([[0], np.cumsum(size[order])])
    return hashed[order], ends.astype(np.int32), flat[np.repeat(begin[order] - ends[:-1], size[order]) + np.arange(ends[-1])]


def encode(df: DataFrame, path: str, key: str = "doc_id", text: str = "text", common: int = COMMON_WORDS) -> DataFrame:
    """key, ids array<int>, ids_sha256 (of the ids as little-endian unsigned 32-bit integers).

    Every row gives one row; a null text is empty.  ``path``: a rank file of byte pieces.  ``key`` passes as it is.
    ``common``: so many of the most frequent words at most are folded once for all.  Words are known by 64-bit hashes there.
    """
    found, *listed = common_words(df, path, common, text)  # COMMON_WORDS words at most, as all of this table
    context = df.sparkSession.sparkContext
    names, shared, table = context.broadcast(found), context.broadcast(listed), context.broadcast(rank_arrays(path))

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks = read_ranks(path)
        known = names.value
        other: dict[str, int] = {}
        held: list[tuple[pa.Array, list[bytes], np.ndarray]] = []
        size = 0

        def block() -> pa.RecordBatch:
            parts, long = _parts([w.encode() for w in other], ranks)
            rows = pa.StructArray.from_arrays([pa.concat_arrays([h[0] for h in held]), pa.array([x for h in held for x in h[1]], pa.binary()), pa.array(np.concatenate([h[2] for h in held]), pa.int32())], ["key", "places", "n"])
            other.clear()
            held.clear()
            return pa.RecordBatch.from_arrays([_as_one(rows), _as_one(parts), _as_one(long), *(_as_one(pa.array(x)) for x in table.value)], ["rows", "words", "long", *TABLE])

        for batch, n, joined, name, first, last, _, which, bounds in _words_of(batches, "text"):
            own = np.minimum(np.searchsorted(known, name), max(len(known) - 1, 0)).astype(np.int32)
            lone = np.flatnonzero(known[own] != name) if len(known) else np.arange(len(name))
            for i, a, b in zip(lone.tolist(), first[lone].tolist(), last[lone].tolist(), strict=True):
                own[i] = len(known) + other.setdefault(joined[a:b], len(other))
            place = own[which]
            held.append((batch.column(0), [pa.compress(place[i:j].tobytes(), codec="lz4_raw", asbytes=True) for i, j in zip(bounds[:-1], bounds[1:], strict=True)], np.diff(bounds)))
            size += n
            if size >= BLOCK_BYTES or len(other) > BLOCK_WORDS:
                yield block()
                size = 0
        if held:
            yield block()

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks = read_ranks(path)
        known, known_ids = shared.value
        for batch in batches:
            for k in range(batch.num_rows):
                rows, ids, long = (batch.column(i).slice(k, 1).flatten() for i in range(3))
                sizes = np.diff(ids.offsets.to_numpy())
                table = ids.flatten().to_numpy(zero_copy_only=False).astype("<u4")
                if long.null_count < len(long):
                    split = np.split(table, np.cumsum(sizes)[:-1])
                    for i, w in enumerate(long.to_pylist()):
                        if w is not None:
                            split[i] = np.array(fold_long(w, ranks), "<u4")
                    sizes, table = np.array([len(x) for x in split]), np.concatenate(split)
                begin = np.concatenate([known, known[-1] + np.cumsum(sizes)])
                table = np.concatenate([known_ids, table.astype(np.uint16)])
                keys, places, counts = rows.field(0), rows.field(1), rows.field(2)
                for a in range(0, len(keys), 500):
                    out, hashed = [], []
                    for p, n in zip(places.slice(a, 500).to_pylist(), counts.slice(a, 500).to_pylist(), strict=True):
                        which = np.frombuffer(pa.decompress(p, 4 * n, codec="lz4_raw", asbytes=True), np.int32)
                        each = begin[which + 1] - begin[which]
                        ends = np.cumsum(each)
                        own = table[np.repeat(begin[which] - ends + each, each) + np.arange(ends[-1] if len(ends) else 0)].astype("<u4")
                        out.append(own)
                        hashed.append(sha256(own.tobytes()).hexdigest())
                    at = np.concatenate([[0], np.cumsum([len(x) for x in out])]).astype(np.int32)
                    flat = np.concatenate(out).astype(np.int32) if out else np.empty(0, np.int32)
                    yield pa.RecordBatch.from_arrays([keys.slice(a, 500), pa.ListArray.from_arrays(pa.array(at), pa.array(flat)), pa.array(hashed)], ["key", "ids", "ids_sha256"])
            give_back()

    made = df.select(F.col(key).alias("key"), F.col(text).alias("text"))
    kind = made.schema["key"].dataType.simpleString()
    split = made.mapInArrow(blocks, f"rows array<struct<key:{kind},places:binary,n:int>>, words array<array<bigint>>, long array<binary>, {TABLE_TYPES}")
    folded = split.select("rows", fold_words(F.col("words"), tuple(map(F.col, TABLE))).alias("ids"), "long")
    return folded.mapInArrow(gather, f"key {kind}, ids array<int>, ids_sha256 string").withColumnRenamed("key", key)


def decode(ids: Column, path: str) -> Column:
    """binary: the pieces of an array of ids, joined; an id without a piece gives nothing, null gives null."""
    names = piece_list(path)
    return F.unhex(F.array_join(F.transform(ids, lambda i: F.get(names, i)), ""))


def query(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    out = encode(documents(spark, sf_dir), path)
    return out.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids_sha256", F.sha2(decode(F.col("ids"), path), 256).alias("decoded_sha256"))
