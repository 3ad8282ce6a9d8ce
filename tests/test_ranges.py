import random
from datetime import UTC, datetime

from pyspark.sql import Window
from pyspark.sql import functions as F

from caresift.functions import hl7
from caresift.operators import contacts, metrics, sighting, stays

SEGMENT = "segment_id string, start_ts timestamp, end_ts timestamp, start_provenance string, end_provenance string"


def at(seconds):
    return None if seconds is None else datetime.fromtimestamp(seconds, UTC).replace(tzinfo=None)


def test_ranges_against_all_pairs(spark):
    r = random.Random(2)
    segs = []
    for i in range(300):
        a = r.choice([0, 1_700_000_000]) + r.randrange(400) * r.choice([1, 60, 86_400])
        b = None if i % 11 == 0 else a + r.choice([0, 0, 1, -50, 5, 3600, 86_400, 4**9, 10**8])
        segs.append((f"s{i}", a, b))
    spans = []
    for i in range(120):
        f = r.choice([0, 1_700_000_000]) + r.randrange(400) * r.choice([1, 60, 86_400])
        spans.append((i, f, None if i % 13 == 0 else f + r.choice([0, 1, 2, -10, 600, 86_400, 10**8])))
    want = sorted((i, s) for i, f, t in spans for s, a, b in segs if (t is None or a < t) and (b is None or b > f))
    frame = spark.createDataFrame([(s, at(a), at(b), "event", None) for s, a, b in segs] + [("none", None, at(5), None, None)], SEGMENT)
    ranges = spark.createDataFrame([(i, at(f), at(t)) for i, f, t in spans] + [(-1, None, at(9))], "range_id int, from_ts timestamp, to_ts timestamp")
    assert sorted(tuple(x) for x in contacts.in_ranges(frame, ranges).collect()) == want
    estimated = frame.withColumn("start_provenance", F.lit("estimated"))
    assert contacts.in_ranges(estimated, ranges, include_estimated=False).count() == 0


def test_rolling_percentiles_in_small_blocks(spark):
    r = random.Random(3)
    rows = [(r.choice(["a", "a", "a", None]), i, None if i % 17 == 0 else float(r.randrange(50))) for i in range(500)]
    df = spark.createDataFrame(rows, "g string, i int, v double")
    got = {x["i"]: x["p50"] for x in metrics.rolling_percentiles(df, "v", ["g"], ["i"], rows=7, block=20, levels=(0.5,)).collect()}
    assert len(got) == 500
    for g in ("a", None):
        own = [x for x in rows if x[0] == g]
        for n, (_, i, _) in enumerate(own):
            last = sorted(v for _, _, v in own[max(0, n - 6) : n + 1] if v is not None)
            rank = (len(last) - 1) * 0.5
            want = None if not last else last[int(rank)] + (rank % 1) * (last[min(int(rank) + 1, len(last) - 1)] - last[int(rank)])
            assert got[i] == want, i


def test_keys_of_a_site(spark):
    text = "MSH|^~\\&|A|B\rPID|1||X1^^^^MR~X2^^^LAB^MR~^^^LAB^MR~X3^^^LAB^PI\rPV1|1|I|W|" + "|" * 15 + "V7^^^^VN"
    df = spark.createDataFrame([(text,), (None,), ("PID|1|| ",), ("PID|1||X9",)], "text string")
    ask = lambda c: [(list(x.k), x.c) for x in df.select(hl7.patient_keys(F.col("text"), config=c).alias("k"), hl7.patient_class(F.col("text"), hl7.patient_keys(F.col("text"), config=c), c).alias("c")).collect()]
    assert ask(hl7.KeyConfig()) == [(["LAB|X2"], "keyed"), ([], "patientless"), ([], "patientless"), ([], "unresolved")]
    assert ask(hl7.KeyConfig(authority="ME"))[0] == (["LAB|X2", "ME|X1"], "keyed")
    assert ask(hl7.KeyConfig(segment="PV1", field=19, wanted="VN", authority="VISIT"))[0] == (["VISIT|V7"], "keyed")


def test_markers_that_are_rare(spark):
    day = 86_400
    made = spark.createDataFrame([(1, "A", "closed", "P", at(day), at(0)), (2, "C", "open", "Q", at(0), None), (3, "A", "closed", "R", at(0), at(90 * day))], "stay_id long, pattern string, status string, patient_key string, opened_event_ts timestamp, closed_event_ts timestamp")
    rows = [(1, "1-1", "ST", day, 0, "event", "A01"), (2, "2-1", "ST", 0, 2 * day, "event", "A04"), (2, "2-2", "ST", 2 * day, None, "event", "A02"), (3, "3-1", "ITS1", 0, 59 * day, "event", "A01"), (3, "3-2", "ITS1", 0, 61 * day, "event", "A02"), (3, "3-3", "ST", 0, 15 * day, "estimated", "A02"), (3, "3-4", "ST", 0, 15 * day, "event", "A02")]
    segs = spark.createDataFrame([(s, g, w, at(a), at(b), p, t) for s, g, w, a, b, p, t in rows], "stay_id long, segment_id string, ward string, start_ts timestamp, end_ts timestamp, start_provenance string, trigger string").withColumn("end_provenance", F.lit("event"))
    got = {(x.ref_id, x.kind) for x in stays.plausibility(made, segs).collect()}
    assert got == {("1-1", "negative_duration"), ("1", "implausible_order"), ("2-1", "excessive_duration"), ("2", "orphan_transfer"), ("3-2", "excessive_duration"), ("3-4", "excessive_duration")}


def test_times_that_are_held(spark):
    text = lambda t: f"MSH|^~\\&|A|B|C|D|20240101||ADT^A01|m{t}|P|2.5\rEVN|A01|20240101||||{t}\rPID|1||X^^^H^MR"
    rows = [(i, datetime(2024, 1, 2), text(t)) for i, t in enumerate(["20240101", "garbage", "18500101", "21000101", "20240230"])]
    got = {x.receipt_id: (x.kind, x.reason) for x in sighting.sight(spark.createDataFrame(rows, "receipt_id long, received_ts timestamp, text string"), "2024-01-03").collect()}
    assert got[0][0] == "usable" and {got[1], got[4]} == {("hold_timequality", "unreadable time")} and {got[2], got[3]} == {("hold_timequality", "absurd time")}


def test_rolling_percentiles_are_those_of_spark_without_a_frame_of_rows(spark):
    value = F.when(F.col("i") % 11 == 0, None).when(F.col("i") % 97 == 0, float("inf")).when(F.col("i") % 89 == 0, float("nan")).otherwise((F.col("i") * 7919) % 101 / 8)
    df = spark.range(1, 400).select(F.when(F.col("id") % 3 > 0, F.col("id") % 3).alias("g"), F.col("id").alias("i"), F.array("id").alias("more")).withColumn("v", F.when(F.col("i") > 30, value))
    frame = Window.partitionBy("g").orderBy("i").rowsBetween(-6, 0)
    levels = (0.0, 0.5, 0.95, 1.0)
    want = df.select("g", "i", "more", "v", *[F.round(F.percentile("v", q).over(frame), 4).alias(f"p{100 * q:g}") for q in levels])
    got = metrics.rolling_percentiles(df, "v", ["g"], ["i"], rows=7, block=20, levels=levels)
    assert got.columns == want.columns and sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    plans = [x._jdf.queryExecution().toString() for x in (got, metrics.rolling_percentile(df, "v", ["g"], ["i"], 7))]
    assert not any("percentile(" in plan for plan in plans)  # which would go through each row's whole frame
