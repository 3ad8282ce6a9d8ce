import pytest
from pyspark.sql import functions as F

from caresift.operators import erase


def tables(spark):
    make = spark.createDataFrame
    return {
        "keys": make([(1, "P"), (2, "P"), (2, "Q"), (3, "R"), (9, "P"), (4, None)], "receipt_id long, patient_key string"),
        "events": make([(1, "keyed"), (2, "keyed"), (3, "keyed"), (9, "keyed"), (4, "unresolved")], "receipt_id long, pkey_status string"),
        "stays": make([(1, "P"), (3, "R")], "stay_id long, patient_key string"),
        "segments": make([(1, "1-1"), (1, "1-2"), (3, "3-3")], "stay_id long, segment_id string"),
        "estimates": make([(9, None, "P"), (8, None, "R")], "receipt_id long, stay_id long, patient_key string"),
        "notifications": make([("n1", 9, None), ("n2", 3, 3)], "notification_id string, receipt_id long, audit_id long"),
        "delays": make([(1, 5), (3, 6)], "receipt_id long, seconds int"),
    }


def test_held_messages_and_estimates_go_too(spark):
    own = tables(spark)
    keys = spark.createDataFrame([("P",), ("P",), ("nobody",), (None,)], "patient_key string")
    left, counts = erase.cascade(own, keys)
    rows = lambda n: sorted(tuple(r) for r in left[n].collect())
    assert rows("estimates") == [(8, None, "R")] and rows("stays") == [(3, "R")] and rows("segments") == [(3, "3-3")] and rows("notifications") == [("n2", 3, 3)]
    assert rows("events") == [(3, "keyed"), (4, "unresolved")] and left["delays"].count() == 2
    assert {r["table"]: r["deleted"] for r in counts.where("patient_key = 'P'").collect()} == {"stays": 1, "events": 3, "segments": 2, "estimates": 1, "notifications": 1}
    told = {r.patient_key: (r.deleted, r.unresolvable, r.status) for r in erase.cascade_result(keys.where("patient_key is not null"), counts, own["events"]).collect()}
    assert told == {"P": (8, 1, "incomplete_uncertain"), "nobody": (0, 1, "incomplete_uncertain")}


def test_a_row_of_two_patients_counts_for_each(spark):
    own = tables(spark)
    _, counts = erase.cascade(own, spark.createDataFrame([("P",), ("Q",)], "patient_key string"))
    assert {(r.patient_key, r.deleted) for r in counts.where("table = 'events'").collect()} == {("P", 3), ("Q", 1)}


def test_no_keys_and_wrong_graphs(spark):
    own = tables(spark)
    left, counts = erase.cascade(own, spark.createDataFrame([], "patient_key string"))
    assert counts.count() == 0 and all(left[n].count() == own[n].count() for n in own)
    with pytest.raises(ValueError):
        erase.cascade({"segments": own["segments"]}, own["keys"].select(F.col("patient_key")))


def test_snapshot_walks_what_its_tables_hang_on(spark, sf_dir, monkeypatch):
    """Tables that are not published and name nothing are not made; without them the same rows go."""
    from caresift.operators import erase
    from caresift.plans import late_queries

    walked = []
    monkeypatch.setattr(erase, "cascade", lambda tables, *a, of=erase.cascade: walked.append(set(tables)) or of(tables, *a))
    rows = {r["table"]: r["n"] for r in late_queries.erase_snapshot(spark, sf_dir).collect()}
    names = {"stays", "segments", "notifications"}
    assert walked == [names | {"keys", "audits"}] and set(rows) == names
    gives = {c for n in walked[0] for c in erase.GRAPH[n].gives}
    assert all(set(erase.GRAPH[n].by) <= gives | {"patient_key"} for n in names)
