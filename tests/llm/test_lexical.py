import math
import random
import re
from collections import Counter

import numpy as np
import pytest
import xxhash

from caresift.llm import lexical as lx


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(rows, items, best):
    docs = [(key, Counter(words(t))) for key, t in rows]
    live = [d for _, d in docs if d]
    n, length = len(live), sum(d.total() for d in live)
    df = Counter(w for d in live for w in d)
    out = []
    for item, text in items:
        found = []
        for key, d in docs:
            m = 100 - 50 + 50 * d.total() * n // length if d else 0
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[w] + 1))) * (10**9 * d[w] // (1000 * d[w] + 20 * m)) for w in set(words(text)) if d[w])
            found += [(score, key)] if score > 0 else []
        found.sort(key=lambda x: (-x[0], x[1] is not None, x[1] or 0))
        out += [(item, i, key, score) for i, (score, key) in enumerate(found[:best], 1)]
    return sorted(out, key=str)


def corpus(seed, n=400):
    r = random.Random(seed)
    names = [f"w{i}" for i in range(300)] + ["Ünï", "日本語", "a1", "THE", "the"]
    weights = [100 / (i + 1) for i in range(len(names))]
    text = lambda most: " ".join(r.choices(names, weights, k=r.randint(0, most)))
    rows = [(i, text(120)) for i in range(n)]
    rows += [(n, None), (n + 1, ""), (n + 2, "!?"), (n + 3, "w7 " * 5000 + "w250"), (n + 4, text(9000)), (n + 4, text(50)), (None, text(60)), (None, text(60))]
    rows += [(n + 10 + i, rows[3][1]) for i in range(70)]
    items = [(i, text(25)) for i in range(12)] + [(90, None), (91, "nowhere else"), (92, rows[3][1]), (92, "w1 W1 w1"), (None, "w250 日本語"), (93, " ".join(names))]
    return rows, items


@pytest.mark.parametrize(("best", "asked"), [(50, 200_000), (3, 60)])
def test_against_every_score(spark, monkeypatch, best, asked):
    monkeypatch.setattr(lx, "ASKED", asked)
    monkeypatch.setattr(lx, "CANDIDATES", 100 if best == 3 else 1_000_000)
    rows, items = corpus(4)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    index = lx.build(df)
    got = lx.search(index, df, spark.createDataFrame(items, "item_id long, text string"), best)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted((tuple(x) for x in got.collect()), key=str) == brute(rows, items, best)
    index.drop()


def test_bounds_are_never_too_low():
    rows, items = corpus(8, 90)
    docs = [Counter(words(t)) for _, t in rows]
    pairs = [(np.array([xxhash.xxh64_intdigest(w.encode()) for w in d], np.uint64), np.array(list(d.values()), np.int64)) for d in docs]
    bits, slices = lx.block(pairs)
    known = sorted({w for d in docs for w in d})
    number = {w: i for i, w in enumerate(known)}
    own = [sorted({number[w] for w in words(t) if w in number}) for _, t in items]
    own = [x for x in own if x]
    n, length = sum(bool(d) for d in docs), sum(d.total() for d in docs)
    asked = lx.Asked([w.encode() for w in known], np.arange(1, len(known) + 1), np.array([xxhash.xxh64_intdigest(w.encode()) for w in known], np.uint64), np.concatenate(own), np.cumsum([0, *map(len, own[:-1])]), np.arange(len(own)), n, length)
    lengths = np.array([d.total() for d in docs])
    seen, near = 0, 0
    for i, bound in lx.bounds(asked, lengths, bits, slices.tobytes()):
        for d, high in zip(docs, bound, strict=True):
            m = 50 + 50 * d.total() * n // length
            score = sum((t + 1) * (10**9 * d[known[t]] // (1000 * d[known[t]] + 20 * m)) for t in own[i] if d[known[t]])
            assert high >= score
            seen, near = seen + 1, near + (high <= 1.25 * score)
    assert near > 0.6 * seen


def test_long_text_other_keys_empty_tables_and_clashing_names(spark):
    rows = [("k1", "ab " * 2_000_000 + "cd", 1, "x"), ("k2", "cd ef", 2, "y"), ("k3", "ab", 3, "z"), ("k4", "none", 4, "z")]
    df = spark.createDataFrame(rows, "doc_id string, text string, score int, item string")
    items = spark.createDataFrame([(1, "ab cd", 5)], "item_id long, text string, rank int")
    index = lx.build(df)
    got = sorted((tuple(x) for x in lx.search(index, df, items).collect()), key=str)
    assert got == brute([r[:2] for r in rows], [(1, "ab cd")], 50)
    assert lx.search(index, df, items.limit(0)).count() == 0
    none = lx.build(df.limit(0))
    assert lx.search(none, df.limit(0), items).count() == 0


def test_pieces(monkeypatch):
    text = "Ab é-日本 x9" * 50
    whole = lx.counted(text)
    monkeypatch.setattr(lx, "PIECE", 7)
    assert lx.counted(text) == whole == Counter(w.encode() for w in words(text))
