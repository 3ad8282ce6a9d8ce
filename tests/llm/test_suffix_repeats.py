import random
from hashlib import sha256

import numpy as np
import pytest

from caresift.llm import suffix_repeats as sr


def brute(rows, least):
    """key -> (removed, kept): bytes covered by a string that starts earlier."""
    seen, out = set(), {}
    for key, text in sorted(rows, key=lambda r: r[0]):
        body = (text or "").encode()
        gone = bytearray(len(body))
        for i in range(len(body) - least + 1):
            s = body[i : i + least]
            if s in seen:
                gone[i : i + least] = b"\1" * least
            seen.add(s)
        out[key] = bytes(c for c, g in zip(body, gone, strict=True) if not g)
    return out


def corpus(seed):
    r = random.Random(seed)
    word = lambda n: "".join(r.choice("abcdeé ") for _ in range(n))
    passages = [word(r.randint(90, 400)) for _ in range(6)]
    out = [None, "", "short", "x" * 700, "ab" * 300, passages[0], passages[0]]
    for _ in range(40):
        parts = [word(r.randint(0, 150))]
        for _ in range(r.randint(0, 3)):
            p = r.choice(passages)
            i = r.randint(0, 40)
            parts += [p[i : len(p) - r.randint(0, 40)], word(r.randint(0, 80))]
        out.append("".join(parts))
    base = word(900)
    for _ in range(25):
        copy = list(base)
        for _ in range(r.randint(0, 4)):
            copy[r.randrange(len(copy))] = "z"
        out.append("".join(copy))
    r.shuffle(out)
    return list(enumerate(out))


@pytest.mark.parametrize(("seed", "hot", "block"), [(1, 1_000_000, sr.BLOCK_BYTES), (2, 8, sr.BLOCK_BYTES), (3, 1_000_000, 600)])
def test_same_as_brute_force(spark, seed, hot, block):
    rows = corpus(seed)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    want = brute(rows, 100)
    got = {r["doc_id"]: sr.kept_of(r["text"].encode(), r["spans"], r["copy"])[0] for r in sr.removed_spans(df, sr.RepeatConfig(hot=hot, block=block)).collect()}
    assert {k: sha256(v).hexdigest() for k, v in got.items()} == {k: sha256(v).hexdigest() for k, v in want.items()}


def test_maximal_repeats_have_all_occurrences():
    r = random.Random(4)
    parts = [bytes(r.choice(b"ab") for _ in range(r.randint(20, 60))) for _ in range(30)]
    at = np.concatenate([[0], np.cumsum([len(p) for p in parts])])
    body = np.frombuffer(b"".join(parts), np.uint8)
    got = {(n, tuple(sorted(x.tolist()))) for n, x in sr.maximal_repeats(body, at, 8)}
    places: dict = {}
    for p, start in zip(parts, at, strict=False):
        for i in range(len(p)):
            for n in range(8, len(p) - i + 1):
                places.setdefault(p[i : i + n], []).append((int(start) + i, p[i - 1 : i], p[i + n : i + n + 1]))
    want = set()
    for s, found in places.items():
        before, after = {x[1] or x[0] for x in found}, {x[2] or x[0] for x in found}
        if len(found) > 1 and len(before) > 1 and len(after) > 1:
            want.add((len(s), tuple(sorted(x[0] for x in found))))
    assert got == want


def test_repeated_rows_and_clashing_columns(spark):
    text = "q" + "abcdefghij" * 20
    schema = "doc_id long, text string, ref string, spans int, copy string, rest int"
    df = spark.createDataFrame([(1, text, "a", 1, "b", 2), (1, text, "a", 1, "b", 2), (None, "tail", None, None, None, None), (2, text, "c", 0, "d", 3)], schema)
    out = sr.drop_repeats(df).collect()
    assert out[0].__fields__ == schema.replace(" long", "").replace(" string", "").replace(" int", "").split(", ")
    kept = sorted((str(r["doc_id"]), r["text"]) for r in out)
    assert [k for k, _ in kept] == ["1", "1", "2", "None"] and kept[2][1] == "" and kept[3][1] == "tail"
    assert sorted(len(t) for k, t in kept if k == "1")[0] == 0
    assert sr.drop_repeats(spark.createDataFrame([], schema)).count() == 0


def test_keys_that_are_no_numbers_raise(spark):
    with pytest.raises(ValueError, match="whole numbers"):
        sr.removed_spans(spark.createDataFrame([("a", "text")], "doc_id string, text string"))
