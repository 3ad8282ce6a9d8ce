import random
import re

import numpy as np
import pytest

from caresift.llm import ngram_join as nj
from caresift.llm._words import mix


def brute(rows, k, percent):
    """key -> (set size, least key reachable)."""
    made = {}
    for key, text in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        made[key] = {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())
    up = {key: key for key in made}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    keys = sorted(made)
    for i, a in enumerate(keys):
        for b in keys[:i]:
            both = len(made[a] & made[b])
            if made[a] and 100 * both >= percent * (len(made[a]) + len(made[b]) - both):
                x, y = find(a), find(b)
                up[max(x, y)] = min(x, y)
    return {key: (len(made[key]), find(key)) for key in keys}


def corpus(seed, near):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdefg") for _ in range(r.randint(1, 5)))
    out, passage = [], [word() for _ in range(40)]
    for size in (0, 1, 2, 3, 5, 8, 12, 20, 40, 80, 150):
        base = [word() for _ in range(size)]
        if size == 80:
            base[10:10] = passage
        for edits in (0, 0, 1, 1, 2, 3, 5, 8):
            copy = list(base)
            for _ in range(edits):
                if copy:
                    copy[r.randrange(len(copy))] = word()
            out.append(" ".join(copy))
    base = [word() for _ in range(90)]
    for _ in range(near):
        copy = list(base)
        for _ in range(r.randint(0, 7)):
            copy[r.randrange(len(copy))] = word()
        out.append(" \t".join(copy).upper())
    r.shuffle(out)
    return [(i, x) for i, x in enumerate([None, "", " \n", *out])]


@pytest.mark.parametrize(("k", "percent", "block"), [(3, 90, 2000), (3, 90, 12), (5, 80, 15), (5, 80, 2000)])
def test_same_as_brute_force(spark, k, percent, block):
    rows = corpus(k * percent, 70)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in nj.join_texts(df, nj.JoinConfig(k, percent, block)).collect()}
    assert got == brute(rows, k, percent)


def test_nulls_repeats_and_empty_tables(spark):
    schema = "doc_id long, text string, node long, component_id string"
    assert nj.join_texts(spark.createDataFrame([], schema)).count() == 0
    text = "one two three four five six seven"
    df = spark.createDataFrame([(None, text, 1, "x"), (4, text, None, None), (4, text, 1, "x"), (5, None, 1, "x"), (None, "", 2, "y")], schema)
    got = sorted(map(str, (tuple(r) for r in nj.join_texts(df).collect())))
    assert got == sorted(map(str, [(None, 3, 4), (4, 3, 4), (4, 3, 4), (5, 0, 5), (None, 0, None)]))


def test_parts_of_linked_sets_meet():
    r = np.random.default_rng(5)
    for percent in (88, 90, 95):
        lows = nj.bands(percent, 4000)
        lows += [100 * lows[-1] // percent + 2]
        for _ in range(150):
            a = np.unique(mix(r.integers(0, 1 << 62, r.integers(5, 700)).astype(np.uint64)))
            cut = int(len(a) * (100 - percent) / 100 * r.random())
            b = np.unique(np.concatenate([a[cut:], mix(r.integers(0, 1 << 62, r.integers(0, 40)).astype(np.uint64))]))
            both = len(np.intersect1d(a, b))
            if 100 * both >= percent * (len(a) + len(b) - both) and len(both * [0]) < max(len(a), len(b)):
                assert np.intersect1d(nj.part_signatures(a, lows, percent), nj.part_signatures(b, lows, percent)).size
