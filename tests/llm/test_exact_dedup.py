import hashlib
import random

import pytest

from caresift.llm import exact_dedup as xd


def brute(rows):
    """(key, keep_id, group_size, sha256) of each row, and the texts of which one row stays."""
    groups = {}
    for key, text in rows:
        groups.setdefault(text or "", []).append(key)
    best = {t: max((k for k in keys if k is not None), default=None) for t, keys in groups.items()}
    return [(key, best[text or ""], len(groups[text or ""]), hashlib.sha256((text or "").encode()).hexdigest()) for key, text in rows]


def order(rows):
    return sorted(rows, key=str)


@pytest.mark.parametrize("counters", [16, 10_000])
def test_against_groups(spark, monkeypatch, counters):
    monkeypatch.setattr(xd, "COUNTERS", counters)
    monkeypatch.setattr(xd, "HEAVY", counters)
    r = random.Random(3)
    texts = ["copy"] * 400 + ["other copy é"] * 150 + [None] * 20 + [""] * 20 + [f"twice {i}" for i in range(60)] * 2 + [f"once {i}" for i in range(300)] + ["x" * 300_000] * 3
    r.shuffle(texts)
    rows = [(i, t) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    got = xd.label(df).collect()
    assert order([(g.doc_id, g.keep_id, g.group_size, g.text_sha256) for g in got]) == order(brute(rows))
    assert all(g.kept == (g.doc_id == g.keep_id) for g in got)
    left = xd.drop_copies(df).collect()
    assert order(tuple(x) for x in left) == order((g.doc_id, rows[g.doc_id][1]) for g in got if g.kept)


def test_null_and_repeated_keys_leave_one_row(spark):
    rows = [(None, "a")] * 30 + [(5, "b"), (5, "b"), (None, "b"), (4, "b")] + [(7, "c"), (7, "d")] + [(None, None), (None, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = xd.label(df).collect()
    assert order([(g.doc_id, g.keep_id, g.group_size, g.text_sha256) for g in got]) == order(brute(rows))
    for text in ("a", "b", "c", "d", ""):
        own = [g for g in got if g.text_sha256 == hashlib.sha256(text.encode()).hexdigest()]
        assert sum(g.kept for g in own) == 1
        assert [g.doc_id for g in own if g.kept] == [own[0].keep_id]
    left = xd.drop_copies(df).collect()
    assert order((x.doc_id, x.text or "") for x in left) == order([(None, "a"), (5, "b"), (7, "c"), (7, "d"), (None, "")])


def test_empty_table_clashing_names_and_normal_forms(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert xd.label(empty).count() == 0 and xd.drop_copies(empty).count() == 0
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(1, "A", 9, "x", "r"), (2, "a ", 8, "y", "s")], "doc_id int, text string, kept int, __digest string, group_size string")
    assert [x.kept for x in xd.label(df).orderBy("doc_id").collect()] == [True, True]
    folded = xd.drop_copies(df, normal=lambda c: F.lower(F.trim(c)))
    assert folded.columns == df.columns and [tuple(x) for x in folded.collect()] == [(2, "a ", 8, "y", "s")]
    with pytest.raises(ValueError):
        xd.label(df.withColumnRenamed("doc_id", "keep_id"), key="keep_id")


def test_no_python_in_the_plan(spark, sf_dir):
    plan = xd.query(spark, sf_dir)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "InPandas" not in plan


def test_more_partitions_than_rows(spark):
    held = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "211")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        rows = [(i, "same" if i % 3 else f"t{i}") for i in range(60)]
        df = spark.createDataFrame(rows, "doc_id long, text string").repartition(50)
        assert order((g.doc_id, g.keep_id, g.group_size, g.text_sha256) for g in xd.label(df).collect()) == order(brute(rows))
    finally:
        for k, v in held.items():
            spark.conf.set(k, v)
