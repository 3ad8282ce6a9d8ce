import random
from collections import Counter, defaultdict

import duckdb
import pytest
from pyspark.sql import functions as F

from caresift.operators import contacts
from caresift.plans import adt_queries, registry


@pytest.mark.parametrize("granularity", ["ward", "room", "bed"])
def test_contacts_with_open_ends(spark, sf_dir, granularity):
    by_unit = defaultdict(list)
    for s in adt_queries._forward(spark, sf_dir)[1].collect():
        by_unit[tuple(s[g] for g in ("ward", "room", "bed")[: ("ward", "room", "bed").index(granularity) + 1])].append(s)
    ends = {s["segment_id"]: s["end_ts"] for rows in by_unit.values() for s in rows}
    before = lambda t, end: end is None or t < end
    want = Counter((x["segment_id"], y["segment_id"]) for rows in by_unit.values() for x in rows for y in rows if x["patient_key"] != y["patient_key"] and before(y["start_ts"], x["end_ts"]) and before(x["start_ts"], y["end_ts"]))
    got = Counter(tuple(r) for r in registry.queries()[f"adt_contacts_all_{granularity}"](spark, sf_dir).select("segment_id", "other_id").collect())
    assert got == want and any(ends[x] is None for x, _ in got) and any(ends[x] is None and ends[y] is None for x, y in got)
    assert Counter(tuple(r) for r in registry.queries()[f"adt_contacts_{granularity}"](spark, sf_dir).select("segment_id", "other_id").collect()) == got
    db = duckdb.connect()
    db.sql(f"CREATE VIEW events AS SELECT * FROM '{sf_dir}/events.parquet'")
    assert Counter(db.sql(f"SELECT segment_id, other_id FROM ({registry.oracle_sql()[f'adt_contacts_all_{granularity}']})").fetchall()) == got


def test_contacts_of_long_and_odd_segments(spark):
    """Short, long and open segments, touching ones, ones of no length, and nulls, against all pairs."""
    r = random.Random(3)
    rows = []
    for i in range(400):
        start = r.randint(0, 80 * 86_400)
        end = None if r.random() < 0.1 else start + r.choice([0, 60, 3600, 5 * 86_400, 16 * 86_400, 40 * 86_400, r.randint(1, 90_000)])
        rows.append((f"s{i}", r.choice(["p1", "p2", "p3", "p4", None]), r.choice(["W1", "W2"]), start, end))
    kind = "segment_id string, patient_key string, ward string, a long, b long"
    df = spark.createDataFrame(rows, kind).select("segment_id", "patient_key", "ward", F.lit(None).cast("string").alias("room"), F.lit(None).cast("string").alias("bed"), F.timestamp_seconds("a").alias("start_ts"), F.timestamp_seconds("b").alias("end_ts"))
    got = Counter(tuple(x) for x in contacts.pairs(df, "bed").collect())
    ends = lambda t, end: end is None or t < end
    want = Counter((x[0], y[0]) for x in rows for y in rows if x[1] and y[1] and x[1] != y[1] and x[2] == y[2] and ends(y[3], x[4]) and ends(x[3], y[4]))
    assert got == want and contacts.pairs(df.limit(0)).count() == 0


def test_counts_without_pairs(spark):
    """Counts against the pairs, with points, open ends, ends before starts, several segments of a patient, and nulls."""
    r = random.Random(5)
    rows = []
    for i in range(500):
        start = r.randint(0, 3 * 86_400) // r.choice([1, 3600]) * r.choice([1, 1, 3600]) % (4 * 86_400)
        end = None if r.random() < 0.1 else start + r.choice([0, 0, 60, 3600, -1800, 86_400, r.randint(1, 90_000)])
        rows.append((f"s{i}", r.choice(["p1", "p2", "p3", "p4", "p5", None]), r.choice(["W1", "W2", None]), start if r.random() < 0.98 else None, end))
    kind = "segment_id string, patient_key string, ward string, a long, b long"
    df = spark.createDataFrame(rows, kind).select("segment_id", "patient_key", "ward", F.lit(None).cast("string").alias("room"), F.lit(None).cast("string").alias("bed"), F.timestamp_seconds("a").alias("start_ts"), F.timestamp_seconds("b").alias("end_ts"))
    want = Counter(x[0] for x in contacts.pairs(df, "bed").collect())
    assert {x["segment_id"]: x["n"] for x in contacts.counts(df, "bed").collect()} == dict(want) and contacts.counts(df.limit(0)).count() == 0


def _plan(df):
    return df._jdf.queryExecution().sparkPlan().toString()


def test_no_side_of_contacts_goes_to_the_driver(spark, sf_dir):
    """Tables look small to Spark, as their files are compressed and rows are multiplied later."""
    g = adt_queries._forward(spark, sf_dir)[1]
    for df in (contacts.pairs(g, "bed"), contacts.counts(g, "bed")):
        assert "SortMergeJoin" in _plan(df) and "Broadcast" not in _plan(df)


def _segments(spark, rows):
    df = spark.createDataFrame(rows, "segment_id string, patient_key string, ward string, a long, b long")
    return df.select("segment_id", "patient_key", "ward", F.lit(None).cast("string").alias("room"), F.lit(None).cast("string").alias("bed"), F.timestamp_seconds("a").alias("start_ts"), F.timestamp_seconds("b").alias("end_ts"))


def test_contacts_of_many_blocks(spark, monkeypatch):
    """Blocks of a few rows, with open ends, points, ends before starts and long segments, against all pairs."""
    monkeypatch.setattr(contacts, "BLOCK", 3)
    r = random.Random(7)
    rows = []
    for i in range(300):
        start = r.randint(0, 40 * 86_400)
        end = None if r.random() < 0.3 else start + r.choice([0, 60, -1800, 3600, 86_400, 20 * 86_400, 50 * 86_400])
        rows.append((f"s{i}", f"p{r.randint(1, 40)}", r.choice(["W1", "W2"]), start, end))
    ends = lambda t, end: end is None or t < end
    want = Counter((x[0], y[0]) for x in rows for y in rows if x[1] != y[1] and x[2] == y[2] and ends(y[3], x[4]) and ends(x[3], y[4]))
    assert Counter(tuple(x) for x in contacts.pairs(_segments(spark, rows)).collect()) == want


def test_written_pairs_take_little_disk(spark, tmp_path):
    """Pairs that are written next to each other share their ids, so a pair is a fraction of a byte."""
    rows = [(f"1234{i}-98765{i}", f"p{i}", f"W{i % 2}", i * 1000, None if i % 4 else i * 1000 + 30_000) for i in range(2000)]
    contacts.pairs(_segments(spark, rows)).write.parquet(f"{tmp_path}/pairs")
    n = spark.read.parquet(f"{tmp_path}/pairs").count()
    assert n > 1_000_000 and sum(f.stat().st_size for f in tmp_path.glob("pairs/*.parquet")) < 0.8 * n
