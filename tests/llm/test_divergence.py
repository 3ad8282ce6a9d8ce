import random
import re
from collections import Counter, defaultdict

import pytest

from caresift.llm import divergence as dv


def brute(rows, audit):
    lower = lambda t: re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
    n, docs, groups = defaultdict(Counter), defaultdict(Counter), set()
    for text, lang, source in rows:
        words = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", lower(text))
        n[lang or "", source or ""].update(words)
        docs[lang or ""].update(set(words))
        groups.add((lang or "", source or ""))
    out = []
    for lang, source in groups:
        kept = [t for t, c in docs[lang].items() if c >= audit.least_docs]
        share = lambda c, total: 1 + audit.scale * (c + audit.smooth) // (total + audit.smooth * len(kept))
        total = lambda s: sum(n[lang, s][t] for t in kept)
        others = [s for g, s in groups if g == lang]
        mine, whole = total(source), sum(total(s) for s in others)
        pair = [(sum(abs(share(n[lang, source][t], mine) - share(n[lang, s][t], total(s))) for t in kept), s) for s in others if s != source]
        term = [(share(n[lang, source][t], mine) - share(sum(n[lang, s][t] for s in others), whole), t) for t in kept if n[lang, source][t]]
        for part, found in (("pair", pair), ("term", [x for x in term if x[0] > 0])):
            ranked = sorted(found, key=lambda x: (-x[0], x[1].encode()))
            out += [(lang, source, part, item, value, i) for i, (value, item) in enumerate(ranked, 1) if part == "pair" or i <= audit.top]
    return sorted(out)


def corpus(seed):
    r = random.Random(seed)
    words = ["The", "the", "über", "İx", "a1b", "no-go", "日本", *(f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(90))]
    rows = []
    for lang, sources in (("en", ["s0", "s1", "s2", None, "ß", "lonely"]), ("de", ["s0", "s1"]), (None, ["s0", "x"]), ("few", ["a", "b"])):
        for source in sources:
            for _ in range(2 if lang == "few" else 25 if source == "s0" else 8):
                rows.append((" ".join(r.choices(words, weights=[300 / (i + 1) for i in range(len(words))], k=r.randint(0, 60))), lang, source))
    rows += [(None, "en", "s1"), ("", "en", "void"), ("42 !", "de", "void"), ("hapax", "solo", "one"), rows[0], rows[0]]
    return rows


@pytest.mark.parametrize(("terms", "groups"), [(256, 32), (7, 2)])
def test_against_counts(spark, monkeypatch, terms, groups):
    monkeypatch.setattr(dv, "TERMS", terms)
    monkeypatch.setattr(dv, "GROUPS", groups)
    audit = dv.Audit(least_docs=9, top=6)
    rows = corpus(11)
    df = spark.createDataFrame(rows, "text string, lang string, source string").repartition(5)
    assert sorted(tuple(x) for x in dv.audit_sources(df, audit=audit).collect()) == brute(rows, audit)


def test_long_text_empty_table_and_clashing_names(spark):
    audit = dv.Audit(least_docs=1, top=3)
    rows = [("ab cd " * 300_000, "en", "s"), ("ab", "en", "t"), ("zz" * 50_000, "en", "t")]
    df = spark.createDataFrame([(*x, "q", 5) for x in rows], "text string, lang string, source string, term string, share int")
    assert sorted(tuple(x) for x in dv.audit_sources(df, audit=audit).collect()) == brute(rows, audit)
    assert dv.audit_sources(df.limit(0)).count() == 0


def test_counts_beyond_64_bits(spark):
    from pyspark.sql import functions as F

    big = 9_000_000_000_000
    row = spark.range(1).select(dv.share(F.lit(big), F.lit(3 * big), F.lit(10).cast("long"), dv.Audit()).alias("p")).first()
    assert row.p == 1 + 10**9 * (big + 5) // (3 * big + 50)


def test_tiles_and_pieces(monkeypatch):
    import pandas as pd

    r = random.Random(5)
    rows = [(f"s{g}", g % 2, f"t{t}", n := r.randint(1, 6), 100 * n + g) for g in range(5) for t in range(40) if r.random() < 0.6]
    rows += [(f"s{g}", g % 2, None, 0, g) for g in range(5)]
    pdf = pd.DataFrame(rows, columns=["source", "block", "term", "n", "share"]).assign(lang="en", lo=0, hi=1)
    own = {(s, t): p for s, _, t, _, p in rows}
    for tile in (1024, 3):
        monkeypatch.setattr(dv, "TILE", tile)
        got = {(x.source, x.other): x.value for x in dv.product(pdf).itertuples()}
        words = {t for _, _, t, _, _ in rows if t}
        assert got == {(a, b): sum(abs(own.get((a, t), own[a, None]) - own.get((b, t), own[b, None])) for t in words) for a in ("s0", "s2", "s4") for b in ("s1", "s3")}
    text = "Ab é-日本 x" * 50
    whole = [w for part in dv.terms(text) for w in part]
    monkeypatch.setattr(dv, "PIECE", 7)
    assert [w for part in dv.terms(text) for w in part] == whole
