"""Repeated byte strings across all texts, by an enhanced suffix array of the places that can hold them.

1. Copies of a whole text are known by its digest.
2. Every string of ``least`` bytes holds a minimizer, the least hash of its 32-byte runs, at the same place wherever it
   stands.  Only minimizers that occur twice can lie in a repeat; their surroundings (``least - 32`` bytes each way) are
   cut out and meet by minimizer.
3. Surroundings that are equal are settled by order.  The others of a block go into one suffix array; a stack scan of its
   common-prefix intervals gives the maximal repeats, those whose occurrences differ to the left and to the right, with
   all occurrences, and each occurrence but the first is a removed span.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import sha256

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from caresift.llm._support import cut, documents, forget, slices, small
from caresift.llm._words import U, byte_values, mix, powers

SEED = 32  #: bytes that a minimizer hashes
NO_HASH = U((1 << 64) - 1)
#: Surroundings in one reducer's bucket, and minimizers in one that only counts.
BUCKET_PLACES, BUCKET_HASHES = 40_000, 500_000
#: Bytes in one suffix array, of text that is hashed at once, and of text whose minimizers are sent together.
BLOCK_BYTES, SLICE_BYTES, CHUNK_BYTES = 600_000, 500_000, 3_000_000
#: Hot minimizers that the driver hears of, at most.
HOT_LIST = 4_000_000


@dataclass(frozen=True)
class RepeatConfig:
    least: int = 100  #: bytes of the shortest repeat, over SEED
    hot: int = 200_000  #: a minimizer with more occurrences is settled by hashes of its strings
    block: int = BLOCK_BYTES  #: about so many bytes in one suffix array


def _slide(values: np.ndarray, width: int, op, fill) -> np.ndarray:
    n = len(values)
    padded = np.full(-(-n // width) * width, fill, values.dtype)
    padded[:n] = values
    block = padded.reshape(-1, width)
    before = op.accumulate(block, axis=1).ravel()
    after = op.accumulate(block[:, ::-1], axis=1)[:, ::-1].ravel()
    return op(after[: n - width + 1], before[width - 1 : n])


def prefix_sums(body: np.ndarray) -> np.ndarray:
    total = np.zeros(len(body) + 1, U)
    np.cumsum(byte_values()[body] * powers(len(body) + 1)[0][: len(body)], out=total[1:])
    return total


def seed_hashes(body: np.ndarray, at: np.ndarray, total: np.ndarray) -> np.ndarray:
    """Of the run of SEED bytes at each place; NO_HASH if it ends in another text."""
    down = powers(len(body) + 1)[1]
    hashed = mix((total[SEED:] - total[:-SEED]) * down[: max(0, len(body) - SEED + 1)])
    for e in at[1:-1]:
        hashed[max(0, e - SEED + 1) : e] = NO_HASH
    return hashed


def minimizers(body: np.ndarray, at: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash and place of every run of SEED bytes that is the least of some ``least`` bytes around it.

    Runs across texts have no hash; windows across texts may add places, never take one.
    """
    n, width = len(body), least - SEED + 1
    if n < least:
        return np.empty(0, U), np.empty(0, np.int64)
    hashed = seed_hashes(body, at, prefix_sums(body))
    low = _slide(hashed, width, np.minimum, NO_HASH)
    edge = np.zeros(width - 1, U)
    chosen = _slide(np.concatenate([edge, low, edge]), width, np.maximum, U(0))
    place = np.flatnonzero((chosen == hashed) & (hashed != NO_HASH))
    return hashed[place], place


def suffix_order(body: np.ndarray, at: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, dict[int, np.ndarray]]:
    """Suffixes of ``least`` bytes or more in order, the bytes left after each place, and names of the runs there.

    Prefix doubling: runs of 7 symbols are numbers, and pairs of names name runs of twice the length, until three runs
    reach the end of the longest string.  Past a string's end stands a symbol of its own.
    """
    n = len(body)
    left = np.repeat(at[1:], np.diff(at)) - np.arange(n)
    longest = int(left.max(initial=0))
    symbol = np.concatenate([body.astype(np.int64) + 1, np.zeros(7, np.int64)])
    packed = np.zeros(n, np.int64)
    for k in range(7):
        packed = packed * 512 + np.where(left > k, symbol[k : k + n], 0)

    def named(values: np.ndarray) -> np.ndarray:
        return np.unique(values, return_inverse=True)[1].astype(np.int32)

    def after(place: np.ndarray, h: int) -> np.ndarray:
        return np.where(left[place] > h, names[size][np.minimum(place + h, n - 1)] + 1, 0)

    size, every = 7, np.arange(n)
    names = {7: named(packed)}
    while 3 * size < longest:
        double = named(names[size] * np.int64(n + 1) + after(every, size))
        size *= 2
        names[size] = double
    wanted = np.flatnonzero(left >= least)
    head = named(names[size][wanted] * np.int64(n + 1) + after(wanted, size))
    return wanted[np.argsort(head * np.int64(n + 1) + after(wanted, 2 * size), kind="stable")], left, names


def common_prefixes(order: np.ndarray, left: np.ndarray, names: dict[int, np.ndarray], body: np.ndarray) -> np.ndarray:
    """Bytes that each suffix of ``order`` shares with the one before it; 0 for the first."""
    out = np.zeros(len(order), np.int64)
    a, b, n = order[:-1], order[1:], len(body)
    size = np.zeros(len(a), np.int64)
    most = np.minimum(left[a], left[b])
    top = max(names)
    for h in [top, top, *sorted(names, reverse=True), *[1] * 6]:
        name = names.get(h, body)
        i, j = np.minimum(a + size, n - 1), np.minimum(b + size, n - 1)
        size += np.where((size + h <= most) & (name[i] == name[j]), h, 0)
    out[1:] = size
    return out


def maximal_repeats(body: np.ndarray, at: np.ndarray, least: int) -> Iterator[tuple[int, np.ndarray]]:
    """(length, places) of the maximal repeats of at least ``least`` bytes within and across the strings.

    Common-prefix intervals are found by a stack scan.  One counts if the bytes before its suffixes differ; the start of a
    string differs from all.  Intervals whose outermost one of ``least`` bytes has one byte before all are passed over
    first, as none inside can count.
    """
    order, left, names = suffix_order(body, at, least)
    if len(order) < 2:
        return
    shared = common_prefixes(order, left, names, body)
    before = np.where(np.isin(order, at), -1 - np.arange(len(order)), body[np.maximum(order - 1, 0)].astype(np.int64))
    head = shared < least
    run = np.cumsum(head) - 1
    differs = np.zeros(len(order), bool)
    differs[1:] = ~head[1:] & (before[1:] != before[:-1])
    wanted = np.zeros(run[-1] + 1, bool)
    wanted[run[differs]] = True
    starts = np.append(np.flatnonzero(head), len(order))
    changes = np.concatenate([[0], np.cumsum(differs)])  # differences up to each place, within runs
    for r in np.flatnonzero(wanted):
        first, last = int(starts[r]), int(starts[r + 1])
        stack: list[tuple[int, int]] = []  # (length, first place of the interval)
        for i, size in enumerate([*shared[first + 1 : last].tolist(), 0], first + 1):
            opened = i - 1
            while stack and stack[-1][0] > size:
                length, opened = stack.pop()
                if changes[i] - changes[opened + 1]:
                    yield length, order[opened:i]
            if size and (not stack or stack[-1][0] < size):
                stack.append((size, opened))


def _pack(x: bytes) -> bytes:
    return pa.compress(x, codec="zstd", asbytes=True)


def merged(first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Spans as maximal runs without overlap; touching ones are one."""
    if not len(first):
        return first, last
    order = np.argsort(first, kind="stable")
    first, last = first[order], np.maximum.accumulate(last[order])
    new = np.ones(len(first), bool)
    new[1:] = first[1:] > last[:-1]
    return first[new], last[np.append(np.flatnonzero(new)[1:] - 1, len(first) - 1)]


def _spans_of(ref: np.ndarray, first: np.ndarray, last: np.ndarray) -> pd.DataFrame:
    order = np.argsort(ref, kind="stable")
    ref, first, last = ref[order], first[order], last[order]
    names, begin = np.unique(ref, return_index=True)
    edges = [*begin, len(ref)]
    blobs = [np.stack(merged(first[i:j], last[i:j]), 1).astype("<i8").tobytes() for i, j in zip(edges, edges[1:], strict=False)]
    return pd.DataFrame({"ref": names, "spans": blobs})


def _halves(own: np.ndarray, low: np.ndarray, high: np.ndarray, seed: np.ndarray, least: int) -> list[tuple]:
    """Surroundings of one minimizer as two sets of shorter ones: by how many bytes a string has before the minimizer."""
    most, fewest = seed[own] - low, np.maximum(0, least - (high - seed[own]))
    if most.max() == fewest.min():
        return []  # one string each, and all differ
    middle = (int(most.max()) + int(fewest.min())) // 2
    out = []
    for a, b in ((np.maximum(low, seed[own] - middle), high), (low, np.minimum(high, seed[own] - middle - 1 + least))):
        full = b - a >= least
        out.append((own[full], a[full], b[full]))
    return out


def _gathered(body: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all spans, one after another, and where each begins."""
    sizes = high - low
    at = np.concatenate([[0], np.cumsum(sizes)])
    return body[np.repeat(low - at[:-1], sizes) + np.arange(at[-1])], at


def _span_hashes(body: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Of each span's bytes; a bounded part of the spans is copied at a time."""
    out, ends = np.empty(len(low), U), np.cumsum(high - low)
    i = 0
    while i < len(low):
        j = max(i + 1, int(np.searchsorted(ends, (ends[i - 1] if i else 0) + SLICE_BYTES, "right")))
        text, at = _gathered(body, low[i:j], high[i:j])
        total = prefix_sums(text)
        out[i:j] = mix((total[at[1:]] - total[at[:-1]]) * powers(len(text) + 1)[1][at[:-1]])
        i = j
    return out


def _equal(own, low, high, body, begin, lead, doc, ref, start) -> tuple[np.ndarray, tuple]:
    """Spans of surroundings that equal an earlier one, and the others."""
    shape = mix(_span_hashes(body, low, high) + (high - low).astype(U) * U(3) + (begin[own] + lead[own] - low).astype(U) * U(0x9E3779B1))
    at = start[own] + low - begin[own]
    order = np.lexsort((at, ref[own], doc[own], shape))
    new = np.ones(len(order), bool)
    new[1:] = shape[order][1:] != shape[order][:-1]
    again, first = order[~new], order[new]
    return np.stack([ref[own][again], at[again], at[again] + (high - low)[again]], 1), (own[first], low[first], high[first])


def settle(rows: pd.DataFrame, least: int, block: int = BLOCK_BYTES) -> pd.DataFrame:
    """Spans to remove, by ref, among surroundings that met: columns as ``_cut_places`` sends them.

    Suffix arrays are of about ``block`` bytes.  A minimizer with more has its strings split by their place around it,
    again and again; halves that become equal are settled by order, so few bytes are left.  Strings of hot minimizers come
    each for itself, known by its hash and without bytes (``lead`` is negative).
    """
    join = lambda name, kind: np.concatenate([np.frombuffer(x, kind) for x in rows[name]])
    doc, ref, start = join("doc", np.int64), join("ref", np.int64), join("start", np.int64)
    kmer, shape, size, lead = join("kmer", U), join("shape", U), join("size", np.int64), join("lead", np.int64)
    gone = np.concatenate([np.frombuffer(x, np.int64).reshape(-1, 3) for x in rows.gone if x] or [np.empty((0, 3), np.int64)])
    body = np.frombuffer(b"".join(pa.decompress(x, n, codec="zstd", asbytes=True) for x, n in zip(rows.body, rows.body_size, strict=True)), np.uint8)
    held = np.where(lead < 0, 0, size)
    begin = np.cumsum(held) - held
    order = np.lexsort((start, ref, doc, shape, kmer))
    new = np.ones(len(order), bool)
    new[1:] = (kmer[order][1:] != kmer[order][:-1]) | (shape[order][1:] != shape[order][:-1])
    copies = order[~new]
    copies = copies[size[copies] >= least]
    out = [gone, np.stack([ref[copies], start[copies], start[copies] + size[copies]], 1)]
    kept = order[new]
    kept = kept[lead[kept] >= 0]
    _, group = np.unique(kmer[kept], return_inverse=True)
    kmer_group = np.full(len(kmer), -1)
    kmer_group[kept] = group
    several = np.bincount(group)[group] > 1 if len(kept) else np.empty(0, bool)
    kept, group = kept[several & (size[kept] >= least)], group[several & (size[kept] >= least)]
    ends = np.cumsum(size[kept])
    edge = 0
    while edge < len(kept):  # whole groups, as many as make a block
        stop = int(np.searchsorted(ends, (ends[edge - 1] if edge else 0) + block, "right"))
        stop = max(stop, edge + 1)
        while stop < len(kept) and stop > edge + 1 and group[stop] == group[stop - 1] and group[edge] != group[stop]:
            stop -= 1
        while stop < len(kept) and group[stop] == group[stop - 1]:
            stop += 1
        own = kept[edge:stop]
        edge = stop
        waiting = [(own, begin[own], begin[own] + size[own])]
        while waiting:
            own, low, high = waiting.pop()
            if len(own) > 1 and (high - low).sum() > block and group[edge - 1] == kmer_group[own[0]]:
                for half in _halves(own, low, high, begin + lead, least):
                    again, half = _equal(*half, body, begin, lead, doc, ref, start)
                    out.append(again)
                    if len(half[0]) > 1:
                        waiting.append(half)
                continue
            text, at = _gathered(body, low, high)
            from_ = start[own] + low - begin[own]
            for length, places in maximal_repeats(text, at, least):
                which = np.searchsorted(at, places, "right") - 1
                here = own[which]
                place = from_[which] + places - at[which]
                first = np.lexsort((place, ref[here], doc[here]))[0]
                later = (ref[here] != ref[here[first]]) | (place != place[first])
                out.append(np.stack([ref[here][later], place[later], place[later] + length], 1))
    every = np.concatenate(out)
    return _spans_of(every[:, 0], every[:, 1], every[:, 2])


def _repeated_places(docs: DataFrame, config: RepeatConfig, buckets: int, hot: int) -> DataFrame:
    """ref, places array<binary>: minimizers of a text (int64 places) whose hash occurs twice in the corpus.

    A chunk sends each hash once, with its count; what occurs twice in it is known already and is dealt evenly to its rows.
    The row of the null ref, if there is one, has the hashes with more than ``hot`` occurrences instead.
    """

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        size = 0

        def chunk() -> pa.RecordBatch:
            hashed, ref, place = (np.concatenate(x) for x in zip(*held, strict=True))
            order = np.argsort(hashed, kind="stable")
            hashed, ref, place = hashed[order], ref[order], place[order]
            new = np.ones(len(hashed), bool)
            new[1:] = hashed[1:] != hashed[:-1]
            count = np.bincount(np.cumsum(new) - 1)[np.cumsum(new) - 1] if len(hashed) else np.empty(0, np.int64)
            known = np.stack([ref[count > 1], place[count > 1]], 1)
            hashed, ref, place, count = hashed[new], ref[new], place[new], count[new].astype(np.uint32)
            bucket = (mix(hashed) % U(buckets)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            names, begin = np.unique(bucket[order], return_index=True)
            edges = [*begin, len(order)]
            cuts = [order[i:j] for i, j in zip(edges, edges[1:], strict=False)]
            blob = lambda values: pa.array([values[c].tobytes() for c in cuts], pa.binary())
            known = known[np.argsort(known[:, 0], kind="stable")]  # a text's places stay together
            near = pa.array([x.tobytes() for x in np.array_split(known, len(cuts))], pa.binary()) if cuts else pa.array([], pa.binary())
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), blob(hashed), blob(ref), blob(place.astype(np.int64)), blob(count), near], ["bucket", "hashed", "refs", "places", "counts", "known"])

        for batch, body, at in slices(batches, most=SLICE_BYTES):
            hashed, place = minimizers(body, at, config.least)
            which = np.searchsorted(at, place, "right") - 1
            held.append((hashed, batch.column(0).to_numpy()[which], place - at[which]))
            size += len(body)
            if size >= CHUNK_BYTES:
                yield chunk()
                size = 0
        if held:
            yield chunk()

    def meet(rows: pd.DataFrame) -> pd.DataFrame:
        hashed, ref, place, own = (np.concatenate([np.frombuffer(x, k) for x in rows[c]]) for c, k in (("hashed", U), ("refs", np.int64), ("places", np.int64), ("counts", np.uint32)))
        name, which, chunks = np.unique(hashed, return_inverse=True, return_counts=True)
        again = (chunks[which] > 1) & (own == 1)  # the others are known already
        many = name[np.bincount(which, own, len(name)) > hot]
        known = np.concatenate([np.frombuffer(x, np.int64).reshape(-1, 2) for x in rows.known if x] or [np.empty((0, 2), np.int64)])
        ref, place = np.concatenate([ref[again], known[:, 0]]), np.concatenate([place[again], known[:, 1]])
        order = np.argsort(ref, kind="stable")
        names, begin = np.unique(ref[order], return_index=True)
        edges = [*begin, len(ref)]
        out = pd.DataFrame({"ref": names, "places": [place[order[i:j]].tobytes() for i, j in zip(edges, edges[1:], strict=False)]}, dtype=object)
        return pd.concat([out, pd.DataFrame({"ref": [None], "places": [many.tobytes()]}, dtype=object)]) if len(many) else out

    sent = docs.select("ref", "text").mapInArrow(send, "bucket long, hashed binary, refs binary, places binary, counts binary, known binary")
    found = sent.groupBy("bucket").applyInPandas(meet, "ref long, places binary")
    return found.groupBy("ref").agg(F.collect_list("places").alias("places"))  # of one text, by its length at most


def _cut_places(config: RepeatConfig, buckets: int, hot: Broadcast):
    """Surroundings of a text's places, by bucket of the minimizer; of equal ones in a chunk, the first.

    A surrounding holds all strings of ``least`` bytes whose minimizer is this one, and no more bytes than they have.  That
    of a hot minimizer, one of the sorted array ``hot``, is sent as its strings, each by its own hash and without bytes.
    """
    reach = config.least - SEED

    def surroundings(batch: pa.RecordBatch, body: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, ...]:
        """kmer, shape, doc, ref, start, size, lead, low (place in ``body``)."""
        named = hot.value
        refs, docs = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        own = [np.unique(np.concatenate([np.frombuffer(b, np.int64) for b in x.as_py()])) for x in batch.column(3)]
        which = np.repeat(np.arange(len(own)), [len(x) for x in own])
        place = at[which] + np.concatenate([*own, np.empty(0, np.int64)])
        low, high = np.maximum(place - reach, at[which]), np.minimum(place + config.least, at[which + 1])
        # only strings whose leftmost least hash is here: those up to the next place of one as low, or lower
        down = powers(len(body) + 1)[1]
        total = prefix_sums(body)
        hashed = np.concatenate([seed_hashes(body, at, total), np.full(SEED, NO_HASH)])
        mine = hashed[place]
        before, after = np.ones(len(place), bool), np.ones(len(place), bool)
        for k in range(1, reach + 1):
            hit = before & (place - k >= low) & (hashed[np.maximum(place - k, 0)] <= mine)
            low[hit] = place[hit] - k + 1
            before &= ~hit
            hit = after & (place + k + SEED <= high) & (hashed[np.minimum(place + k, len(body))] < mine)
            high[hit] = place[hit] + k + SEED - 1
            after &= ~hit
        full = high - low >= config.least
        which, place, low, high = which[full], place[full], low[full], high[full]
        span = lambda i, j: mix((total[j] - total[i]) * down[i])
        kmer, lead = span(place, place + SEED), place - low
        shape = mix(span(low, high) + (high - low).astype(U) * U(3) + lead.astype(U) * U(0x9E3779B1))
        if len(named):
            many = named[np.minimum(np.searchsorted(named, kmer), len(named) - 1)] == kmer
            strings = (high - low)[many] - config.least + 1
            first = np.repeat(low[many] - np.cumsum(strings) + strings, strings) + np.arange(strings.sum())
            each = span(first, first + config.least)
            size = np.full(len(first), config.least)
            join = lambda a, b: np.concatenate([a[~many], b])
            which, kmer, shape = join(which, np.repeat(which[many], strings)), join(kmer, mix(each + U(29))), join(shape, each)
            lead, high, low = join(lead, np.full(len(first), -1)), join(high, first + size), join(low, first)
        return kmer, shape, docs[which], refs[which], low - at[which], high - low, lead, low

    def distinct(rows: tuple[np.ndarray, ...]) -> tuple[np.ndarray, np.ndarray]:
        """Places of the first of equal surroundings, and of the others."""
        kmer, shape, doc, ref, start = rows[:5]
        order = np.lexsort((start, ref, doc, shape, kmer))
        new = np.ones(len(order), bool)
        new[1:] = (kmer[order][1:] != kmer[order][:-1]) | (shape[order][1:] != shape[order][:-1])
        return order[new], order[~new]

    def spans(rows: tuple[np.ndarray, ...], again: np.ndarray) -> np.ndarray:
        ref, start, size = rows[3][again], rows[4][again], rows[5][again]
        made = _spans_of(ref, start, start + size)
        found = [np.insert(np.frombuffer(s, "<i8").reshape(-1, 2), 0, r, axis=1) for r, s in zip(made.ref, made.spans, strict=True)]
        return np.concatenate(found) if found else np.empty((0, 3), np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        texts: list[np.ndarray] = []
        gone: list[np.ndarray] = []
        size = 0

        def chunk() -> pa.RecordBatch:
            rows = tuple(np.concatenate(x) for x in zip(*held, strict=True))
            body = np.concatenate(texts)
            length = np.where(rows[6] < 0, 0, rows[5])
            begin = np.cumsum(length) - length
            first, again = distinct(rows)
            lost = np.concatenate([*gone, spans(rows, again)])
            bucket = (mix(rows[0][first] + U(11)) % U(buckets)).astype(np.int64)
            turn = np.argsort(bucket, kind="stable")
            names, edge = np.unique(bucket[turn], return_index=True)
            edges = [*edge, len(turn)]
            cuts = [first[turn[i:j]] for i, j in zip(edges, edges[1:], strict=False)]
            packed = [_gathered(body, begin[c], begin[c] + length[c])[0].tobytes() for c in cuts]
            columns = [pa.array(names, pa.int64()), *(pa.array([x[c].tobytes() for c in cuts], pa.binary()) for x in rows)]
            columns += [pa.array([_pack(x) for x in packed], pa.binary()), pa.array([len(x) for x in packed], pa.int64())]
            lost = lost[np.argsort(lost[:, 0], kind="stable")]
            columns.append(pa.array([x.tobytes() for x in np.array_split(lost, len(cuts))], pa.binary()) if cuts else pa.array([], pa.binary()))
            for x in (held, texts, gone):
                x.clear()
            return pa.RecordBatch.from_arrays(columns, [f.split()[0] for f in PLACES.split(", ")])

        for batch, body, at in slices(batches, "text", SLICE_BYTES):
            *rows, low = surroundings(batch, body, at)
            first, again = distinct(tuple(rows))
            gone.append(spans(tuple(rows), again))
            held.append(tuple(x[first] for x in rows))
            low, length = low[first], np.where(rows[6][first] < 0, 0, rows[5][first])
            texts.append(_gathered(body, low, low + length)[0])
            size += len(body)
            if size >= CHUNK_BYTES:
                yield chunk()
                size = 0
        if held:
            yield chunk()

    return run


PLACES = "bucket long, kmer binary, shape binary, doc binary, ref binary, start binary, size binary, lead binary, body binary, body_size long, gone binary"


def removed_spans(df: DataFrame, config: RepeatConfig = RepeatConfig(), key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, text, spans array<binary> (pairs of int64 byte places), copy boolean, rest; one row for each row of ``df``.

    A byte is in a span if it is covered by a string of ``least`` bytes that also starts earlier: in a text of a smaller
    key, or before in the same text.  ``copy`` texts are such from end to end: copies of whole texts of ``least`` bytes
    or more.  Texts of one key are ordered by a hash, one of rows equal in key and text stays, and null keys come first.
    A null text is empty.  ``rest`` is a struct of ``df``'s columns but the text; rows equal in key and text share one.
    The key has to be a whole number, as it says which text comes earlier; any other raises an error.
    """
    if not isinstance(df.schema[key].dataType, IntegralType):
        raise ValueError(f"{key} has to be a column of whole numbers")
    spark = df.sparkSession
    rows = df.select(F.col(key).alias("__key"), F.coalesce(F.col(text), F.lit("")).alias("text"), F.struct(*[F.col(f"`{c}`") for c in df.columns if c != text]).alias("rest"))
    rows = rows.withColumns({"doc": F.coalesce(F.col("__key").cast("long"), F.lit(-(1 << 63))), "digest": F.unhex(F.md5("text"))})
    rows = rows.withColumn("ref", F.xxhash64("__key", "digest"))
    long = rows.where(F.octet_length("text") >= config.least)
    # the first of each text, and whole rows that repeat
    counts = cut(long.groupBy("digest", "doc", "ref").agg(F.count("*").alias("rows"), F.first(F.octet_length("text")).alias("n")))
    heads = counts.groupBy("digest").agg(F.min(F.struct("doc", "ref")).alias("head"), F.sum("rows").alias("rows"))
    several = small(cut(heads.where("rows > 1").select("digest", F.col("head.ref").alias("head"))))
    met = counts.join(several, "digest").select("ref", (F.col("head") == F.col("ref")).alias("is_head"), "rows")
    met = cut(met.groupBy("ref").agg(F.max("is_head").alias("is_head"), F.max(F.col("is_head") & (F.col("rows") > 1)).alias("twice")))
    copies = small(met.select("ref", "is_head"))
    marked = rows.join(copies, "ref", "left")
    texts = marked.where((F.octet_length("text") >= config.least) & F.coalesce("is_head", F.lit(True))).select("ref", "doc", "text")
    size = counts.agg(F.sum(F.col("n") * F.col("rows")).alias("bytes")).first()["bytes"] or 0
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    many = max(config.hot, size // 30 // HOT_LIST)
    places = cut(_repeated_places(texts, config, max(partitions, size // 30 // BUCKET_HASHES + 1), many))
    forget(spark)  # the minimizers' shuffle, before the texts are shuffled
    held = F.aggregate("places", F.lit(0).cast("long"), lambda a, x: a + F.octet_length(x))
    total = places.agg(F.sum(held).alias("bytes")).first()["bytes"] or 0
    buckets = max(partitions, total // 8 // BUCKET_PLACES + 1)
    named = [np.frombuffer(b, U) for r in places.where("ref is null").collect() for b in r["places"]]  # HOT_LIST numbers at most
    hot = spark.sparkContext.broadcast(np.sort(np.concatenate([*named, np.empty(0, U)])))
    near = places.where("ref is not null").hint("merge")  # at any size alike: texts meet their places, and later their spans, by a shuffle
    met_places = texts.join(near, "ref").select("ref", "doc", "text", "places").mapInArrow(_cut_places(config, buckets, hot), PLACES)
    spans = met_places.groupBy("bucket").applyInPandas(lambda pdf: settle(pdf, config.least, config.block), "ref long, spans binary")
    spans = cut(spans.groupBy("ref").agg(F.collect_list("spans").alias("spans"))).hint("merge")
    del places, near, met_places
    forget(spark)  # the places, and the shuffles of texts and surroundings, before the texts are shuffled again
    # one row of each head stays: rows that repeat it whole are copies
    again = met.where("twice").select("ref", "twice")
    if not again.take(1):
        lone = marked.select("ref", "__key", "text", "rest", (~F.coalesce("is_head", F.lit(True))).alias("copy"))
        out = lone.join(spans, "ref", "left")
        return out.select(F.col("__key").alias(key), "text", F.when(~F.col("copy"), F.col("spans")).alias("spans"), "copy", "rest")
    joined = marked.join(small(again), "ref", "left")
    lone = joined.where("twice is null").select("ref", "__key", "text", "rest", (~F.coalesce("is_head", F.lit(True))).alias("copy"))
    turn = F.struct(F.col("twice"))
    repeated = joined.where("twice").groupBy("ref").agg(F.count(turn).alias("n"), F.first("__key").alias("__key"), F.first("text").alias("text"), F.first("rest").alias("rest"))
    repeated = repeated.withColumn("i", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n")))).select("ref", "__key", "text", "rest", (F.col("i") > 1).alias("copy"))
    out = lone.unionByName(repeated).join(spans, "ref", "left")
    return out.select(F.col("__key").alias(key), "text", F.when(~F.col("copy"), F.col("spans")).alias("spans"), "copy", "rest")


def kept_of(body: bytes, spans: list[bytes] | None, copy: bool) -> tuple[bytes, int, int]:
    """The remaining bytes, the number of removed ones and of maximal removed runs."""
    if copy:
        return b"", len(body), 1
    if not spans:
        return body, 0, 0
    every = np.concatenate([np.frombuffer(s, "<i8").reshape(-1, 2) for s in spans])
    first, last = merged(every[:, 0], every[:, 1])
    edges = [0, *np.stack([first, last], 1).ravel().tolist(), len(body)]
    kept = b"".join(body[i:j] for i, j in zip(edges[::2], edges[1::2], strict=True))
    return kept, len(body) - len(kept), len(first)


def query(spark, sf_dir: str) -> DataFrame:
    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                batch = whole.slice(at, 512)
                out = []
                for text, spans, copy in zip(*(batch.column(i).to_pylist() for i in (1, 2, 3)), strict=True):
                    body = text.encode()
                    kept, n, runs = kept_of(body, spans, copy)
                    out.append((len(body), n, runs, sha256(kept).hexdigest()))
                yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x) for x in zip(*out, strict=True))], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return removed_spans(documents(spark, sf_dir)).drop("rest").mapInArrow(digest, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def drop_repeats(df: DataFrame, config: RepeatConfig = RepeatConfig(), key: str = "doc_id", text: str = "text") -> DataFrame:
    """``df`` with the text without its removed spans; a sign that a span cuts in two goes as a whole; null becomes empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (whole.slice(at, 512) for whole in batches for at in range(0, whole.num_rows, 512)):
            kept = [kept_of(t.encode(), s, c)[0].decode("utf-8", "ignore") for t, s, c in zip(*(batch.column(i).to_pylist() for i in (0, 1, 2)), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(kept, pa.string()), batch.column(3)], ["kept", "rest"])

    out = removed_spans(df, config, key, text).select("text", "spans", "copy", "rest")
    out = out.mapInArrow(run, f"kept string, rest {out.schema['rest'].dataType.simpleString()}")
    return out.select(*[F.col("kept").alias(text) if c == text else F.col("rest").getField(c).alias(c) for c in df.columns])
