import pytest

from caresift.operators.fold import Event, PatientFold, event_from, event_text, stay_from, stay_text

H = 3600


def chain():
    return [Event(1, "A01", 8 * H, 8 * H, "m1", place=("KAR", "KAR", "", "")), Event(2, "A02", 9 * H, 9 * H, "m2", place=("IMC", "IMC", "", "")), Event(3, "A03", 10 * H, 10 * H, "m3")]


def run(events, now=11 * H):
    fold = PatientFold()
    for e in events:
        fold.stays = {n: stay_from(stay_text(x)) for n, x in fold.stays.items()}  # the state survives the store
        fold.apply(event_from(event_text(e)))
    fold.finish(now)
    return fold


def retro(n, trigger, target, kind, at, action="CANCELS", own=12 * H):
    return Event(n, trigger, own, 12 * H, f"m{n}", zst=(action, target, kind, at))


def segs(fold):
    return [(s.place[1], s.start, s.end) for s in stay(fold).segments]


def stay(fold, n=0):
    return list(fold.stays.values())[n]


def test_forward():
    fold = run(chain())
    assert [(s.pattern, s.status) for s in fold.stays.values()] == [("A", "closed")] and segs(fold) == [("KAR", 8 * H, 9 * H), ("IMC", 9 * H, 10 * H)]


@pytest.mark.parametrize(
    ("event", "status", "want"),
    [
        (retro(4, "A11", "m1", "A01", 8 * H), "cancelled", []),
        (retro(4, "A12", "m2", "A02", 9 * H), "closed", [("KAR", 8 * H, 10 * H)]),
        (retro(4, "A13", "m3", "A03", 10 * H), "open", [("KAR", 8 * H, 9 * H), ("IMC", 9 * H, None)]),
        (retro(4, "A08", "m2", "A02", 9 * H, "UPDATES", 9 * H + 1800), "closed", [("KAR", 8 * H, 9 * H + 1800), ("IMC", 9 * H + 1800, 10 * H)]),
    ],
)
def test_retro(event, status, want):
    fold = run([*chain(), event])
    assert stay(fold).status == status and segs(fold) == want
    assert sum(r["kind"] == "change" for r in PatientFold(out=fold.out).out) == 1


def test_held_and_waiting():
    bad = run([*chain(), Event(5, "A11", 12 * H, 12 * H, "m5")])
    assert bad.out[-2]["status"] == "held_failclosed" and stay(bad).status == "closed"
    a01, a02, a03 = chain()
    early = retro(4, "A12", "m2", "A02", 9 * H)
    fold = PatientFold()
    for e in (a01, early, a02, a03):
        fold.apply(e)
    assert not fold.waiting and segs(fold) == [("KAR", 8 * H, 10 * H)]
    late = PatientFold()
    late.apply(early)
    late.finish(12 * H + 8 * 86400)
    assert late.waiting[4][1] == "expired" and late.out[-1]["status"] == "expired"


def test_patterns_and_late_transfer():
    er = Event(1, "A04", 0, 0, "m1", place=("AMB", "AMB", "", ""))
    assert stay(run([er], 7 * H)).pattern == "C"
    joined = run([er, Event(2, "A01", H, H, "m2", place=("ST1", "ST1", "", ""))])
    assert len(joined.stays) == 1 and stay(joined).pattern == "B"
    late = run([*chain(), Event(4, "A02", 9 * H + 600, 12 * H, "m4", place=("ITS", "ITS", "", ""))])
    assert segs(late) == [("KAR", 8 * H, 9 * H), ("IMC", 9 * H, 9 * H + 600), ("ITS", 9 * H + 600, 10 * H)]
    assert run([Event(1, "A03", H, H, "m1")]).out[0]["status"] == "deferred"


def test_what_falls_due_between_polls():
    fold = PatientFold()
    fold.apply(Event(1, "A04", 0, 0, "m1"))
    fold.finish(6 * H - 1)
    assert stay(fold).pattern == "pending"
    fold.finish(6 * H)
    assert (stay(fold).pattern, stay(fold).revision) == ("C", 2)
    fold.apply(Event(2, "A03", 48 * H, 48 * H, "m2"))
    fold.finish(90 * H)
    assert (stay(fold).pattern, stay(fold).status, stay(fold).revision) == ("C", "closed", 3)
    target = Event(5, "A01", 0, 9 * 86400, "m5")
    fold.apply(retro(4, "A11", "m5", "A01", 0))
    fold.finish(8 * 86400)
    fold.apply(target)
    told = [(r["receipt_id"], r["kind"], r["status"]) for r in fold.out if r["receipt_id"] == 4]
    assert told == [(4, "event", "waiting"), (4, "finding", "expired"), (4, "change", "revoke_stay"), (4, "event", "applied")]
    assert not fold.waiting and not fold.awaited


def test_a_long_history_stays_linear():
    """Each cancel finds its target by key: 20,000 events of one patient in a few seconds."""
    import time

    fold, began = PatientFold(), time.time()
    for n in range(5000):
        fold.apply(Event(4 * n, "A01", n * H, n * H, f"a{n}"))
        fold.apply(Event(4 * n + 1, "A03", n * H + 60, n * H + 60, f"b{n}"))
        fold.apply(retro(4 * n + 2, "A13", f"b{n}", "A03", n * H + 60))
        fold.apply(retro(4 * n + 3, "A11", f"a{n}", "A01", n * H))
        fold.finish(n * H)
    assert time.time() - began < 20 and not fold.opened and len(fold.stays) == 5000


def test_a_small_file_makes_many_tasks_and_no_table_goes_to_the_driver(spark, sf_dir):
    """One file of a few bytes is one partition; messages and joined tables look small to Spark, and grow with the input."""
    from caresift.operators import fold, sighting, stays
    from caresift.plans import history_queries
    from caresift.sources import synth

    assert synth.adt_histories(spark, sf_dir).rdd.getNumPartitions() >= 8
    events = sighting.events(history_queries._sighted(spark, sf_dir))
    rows = fold.reconstruct(events, synth.AS_OF, poll_seconds=600)
    late = stays.overdue(fold.stays_of(rows), fold.segments_of(rows), events.select("receipt_id", "msh10"), synth.AS_OF)
    plan = late._jdf.queryExecution().sparkPlan().toString()
    assert "Join" in plan and "MapInArrow" in plan and not [line for line in plan.splitlines() if "BroadcastHashJoin" in line and "stay_id" in line]
    only = fold.reconstruct(events, synth.AS_OF, poll_seconds=600, kinds=("stay", "finding"))
    assert sorted(map(str, only.collect())) == sorted(map(str, rows.where("kind in ('stay', 'finding')").collect()))


def test_the_fold_reads_its_events_once(spark, sf_dir):
    """Events without a patient or a time come out of the same pass, and parsed fields keep their values."""
    from caresift.operators import fold, sighting
    from caresift.plans import history_queries
    from caresift.sources import synth

    rows = fold.reconstruct(sighting.events(history_queries._sighted(spark, sf_dir)), synth.AS_OF)
    assert "Union" not in rows._jdf.queryExecution().sparkPlan().toString()
    assert rows.where("status = 'unassigned' and kind = 'finding' and patient_key is null").count() == 38
    text = "MSH|^~\\&|A|F|H|H|20240102||ADT^A11|m1|P|2.5\rEVN|A11|20240102||||2024010203\rPID|1||x^^^H^MR\rPV1|1|I|W1\rZST|cancels|m0|ADT^A01|20240101"
    m = spark.createDataFrame([(1, text)], "receipt_id long, text string").selectExpr("receipt_id", "timestamp'2024-01-02' as received_ts", "text")
    e = sighting.events(sighting.sight(m, synth.AS_OF)).first()
    assert (e["zst"]["action"], str(e["zst"]["target_ts"]), str(e["event_ts"]), e["patient_key"]) == ("CANCELS", "2024-01-01 00:00:00", "2024-01-02 03:00:00", "H|x")


def test_segments_are_read_without_a_list_of_all(spark):
    """Odd blanks, bare segments and repeated lines give the fields that the list of segments gives; the fold's batches hold one kind of row."""
    from pyspark.sql import functions as F

    from caresift.functions import hl7
    from caresift.operators import sighting
    from caresift.sources import synth

    texts = ["", None, "PV1", "\r \xa0PV1 |a", " PV1\x0b\rPV1|b", "PV1X|a\rPV1||x y|\x85", "MSH|^~\\&|A|F|\n\r　PV1|1| I |W^ R \r\nPV1|2", "PID|1||x^^^H^MR\rPIDX|1\rPID|1||y^^^H^MR~ z^^^H^MR ", "PID|1|| x ^^^H^ MR\rPV1"]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    whole = hl7.joined(F.col("text"))
    read = hl7.fields_of(whole, hl7.loose(whole), "PV1")
    own = [hl7.tidy(hl7.field(read, n), hl7.loose(whole)).alias(f"n{n}") for n in range(4)]
    listed = F.coalesce(hl7.first_segment(hl7.segments(F.col("text")), "PV1")["fields"], F.array().cast("array<string>"))
    want = [hl7.strip(hl7.field(listed, n)).alias(f"n{n}") for n in range(4)]
    assert df.select("id", *own).collect() == df.select("id", *want).collect()
    assert [r[0] for r in df.select(hl7.patient_keys(F.col("text"))).collect()][-2:] == [["H|x", "H|y", "H|z"], ["H|x"]]
    assert "__segs" not in sighting.classify(df.select(F.col("id").alias("receipt_id"), "text"), synth.AS_OF).columns


def test_plain_messages_are_read_as_all_others(spark):
    from pyspark.sql import functions as F

    from caresift.functions import hl7

    pids = ["PID|1||X^^^H^MR", "PID|1||X^^^H^MR~Y^^^H^MR", "PID|1||X^^^^MR", "PID|1||^^^H^MR", "PID|1||X^^^H^PI", "PID|1", "PID", "PIDX|1||X^^^H^MR", "", " PID|1||X^^^H^MR", "PID|1|| X ^^^H^MR", "PID|1||Ä^^^H^MR", "PID|1||X^^^H^MR\rPID|1||Z^^^H^MR", "PID|1||X^^^H^MR\nPID"]
    rows = spark.createDataFrame([(n, f"MSH|^~\\&|A|B\r{p}\rPV1|1") for n, p in enumerate(pids)] + [(-1, None), (-2, ""), (-3, pids[0])], "n long, text string")
    for config in (hl7.KeyConfig(), hl7.KeyConfig(authority="ME"), hl7.KeyConfig(segment="PV1", field=1, wanted="", authority="V")):
        read = hl7.with_patient_keys(rows, "keys", config=config)
        assert read.columns == ["n", "text", "keys"]
        assert read.where(~F.col("keys").eqNullSafe(hl7.patient_keys(F.col("text"), config=config))).count() == 0
    times = ["20240229123456", "20230229123456", "00000101000000", "20240101240000", "20240101235960", "20240101", "202401011", " 20240101120000", "20240101120000+0100", "20240101120000.5", "x", "", None, "00010101000000"]
    read = spark.createDataFrame([(t,) for t in times], "t string").select(F.date_format(hl7.timestamp(F.col("t")), "yyyyMMddHHmmss").alias("t"))
    day = "20240101"
    assert [r.t for r in read.collect()] == ["20240229123456", None, None, None, None, f"{day}000000", f"{day}000000", *[f"{day}120000"] * 3, None, None, None, "00010101000000"]


def test_runs_read_messages_once(spark, sf_dir):
    from pyspark.sql import functions as F

    from caresift.functions import hl7
    from caresift.operators import estimates, sighting
    from caresift.plans import late_queries
    from caresift.sources import synth

    kept = late_queries.sighted(spark, sf_dir)
    assert "text" not in kept.columns and kept.where("kind = 'hold_timequality'").count() > 0
    seen = sighting.sight(synth.adt_histories(spark, sf_dir, synth.LATE_HISTORIES), synth.AS_OF)
    want, got = sighting.events(seen), sighting.events(kept)
    assert got.columns == want.columns and got.exceptAll(want).count() == 0 and got.count() == want.count()
    want, got = estimates.candidates(seen, hl7.patient_keys(F.col("text"))), estimates.candidates(kept)
    assert got.exceptAll(want).count() == 0 and got.count() == want.count() > 0


def test_rows_of_other_kinds_are_not_made():
    told = PatientFold(kinds=frozenset({"stay"}))
    told.apply(Event(1, "A01", 0, 0, "m1"))
    told.apply(Event(2, "A11", 5, 5, "m2", zst=("CANCELS", "m1", "A01", 0)))
    told.apply(Event(3, "A12", 6, 6, "m3", zst=("CANCELS", "m9", "A02", 7)))
    assert told.out == [] and [(r["kind"], r["status"], r["revision"]) for r in told.rows()] == [("stay", "cancelled", 2)]


def test_messages_read_once_give_what_two_passes_give(spark, sf_dir):
    """Repeats, incomplete markers and unread times included; of a run whose log nobody reads, no log is made."""
    from pyspark.sql import functions as F

    from caresift.functions import hl7
    from caresift.operators import sighting
    from caresift.plans import late_queries
    from caresift.sources import synth

    def msg(n, marker="A|H", kind="ADT^A01", number="1", at="20240101100000", pid="X^^^H^MR"):
        return n, f"MSH|^~\\&|{marker}|||20240101||{kind}|{number}|P\rEVN|A01|{at}\rPID|1||{pid}\rPV1|1|I|W^R^B\rZST|cancels|m|ADT^A02|{at}"

    rows = [msg(1), msg(2), msg(3, marker="A|"), msg(4, marker="A|"), msg(5, kind="ORU^R01"), msg(6, number="2", at=" 20240101"), msg(7, number="2"), msg(8, number="3", pid="Y^^^H^PI"), msg(9, number="4", at="x"), msg(10, number="5", pid="Y^^^H^MR~Z^^^H^MR"), (11, ""), (12, None)]
    msgs = spark.createDataFrame(rows, "receipt_id long, text string").withColumn("received_ts", F.lit("2024-01-01").cast("timestamp"))
    want, got = sighting.details(sighting.sight(msgs, synth.AS_OF)).where("kind <> 'ignored'"), sighting.seen(msgs, synth.AS_OF)
    assert got.columns == want.columns and sorted(map(repr, got.collect())) == sorted(map(repr, want.collect()))
    assert [r.receipt_id for r in got.where("kind = 'suppressed_duplicate'").orderBy("receipt_id").collect()] == [2, 7]
    times = spark.createDataFrame([(t,) for t in ("20240229123456", " 20240101120000", "20230229123456", "00000101000000", "2024010112", "x", "", None)], "t string")
    assert hl7.with_timestamps(times, {"s": F.col("t")}).where(~F.col("s").eqNullSafe(hl7.timestamp(F.col("t")))).count() == 0
    _, first, second, _ = late_queries.runs(spark, sf_dir, told=False)
    assert second.findings.count() > 0 and "changes" not in vars(first) and "changes" not in vars(second)
