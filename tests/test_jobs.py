import os

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from caresift.operators import fold, sighting
from caresift.plans import adt_queries, registry
from caresift.sources import files, synth
from caresift.streaming import jobs

NAMES = [
    "v2_reports", "v2_effective_severity", "v2_effective_severity_join", "v2_audit_events", "fhir_losses_german", "fhir_reports", "fhir_rare_findings", "adt_sighting", "adt_segments", "adt_fold_segments", "adt_contact_counts", "adt_segment_containing",
    "adt_erase_result", "v2_stream_rates", "adt_stream_changes", "adt_retro_stays", "adt_retro_segments", "adt_retro_statuses", "adt_retro_estimated_segments", "adt_best_open_stay",
]


@pytest.mark.parametrize("name", NAMES)
def test_same_as_sql(spark, sf_dir, name):
    db = duckdb.connect()
    for t in ("orders", "lineitem", "events", "documents", "customer"):
        db.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    want = db.sql(registry.oracle_sql()[name])
    got = registry.queries()[name](spark, sf_dir)
    assert sorted(got.columns) == sorted(want.columns)
    row = lambda r, names: tuple(str(r[c]) for c in names)
    names = sorted(got.columns)
    order = [want.columns.index(c) for c in names]
    assert sorted(row(r, names) for r in got.collect()) == sorted(tuple(str(r[i]) for i in order) for r in want.fetchall())


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0 and set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_order_of_input_does_not_matter(spark, sf_dir):
    events = sighting.events(sighting.sight(adt_queries.full_messages(spark, sf_dir), synth.AS_OF)).cache()
    one = fold.reconstruct(events, synth.AS_OF).where("kind in ('stay', 'segment')")
    two = fold.reconstruct(events.orderBy(F.xxhash64("receipt_id")), synth.AS_OF).where("kind in ('stay', 'segment')")
    assert one.exceptAll(two).count() == 0 and two.exceptAll(one).count() == 0


def test_no_patient_in_changes(spark, sf_dir):
    rows = fold.changes_of(fold.reconstruct(sighting.events(sighting.sight(synth.adt_full(spark, sf_dir), synth.AS_OF)), synth.AS_OF))
    assert "patient_key" not in rows.columns and not any("HOSP|" in r["after_json"] for r in rows.collect())


def test_publish_and_read(spark, tmp_path):
    a = spark.range(3)
    files.publish({"stay": a, "segment": a.where("id > 0")}, str(tmp_path), "v1")
    files.publish({"stay": a, "segment": a}, str(tmp_path), "v2")
    version, tables = files.published(spark, str(tmp_path))
    assert version == "v2" and tables["segment"].count() == 3
    files.publish({"stay": a}, str(tmp_path), "v10")
    assert files.published(spark, str(tmp_path))[0] == "v10"


def stream(spark, df, path, job, mode="append"):
    df.write.parquet(f"{path}/in")
    source = spark.readStream.schema(df.schema).parquet(f"{path}/in")
    out = []
    query = job(source).writeStream.outputMode(mode).option("checkpointLocation", f"{path}/check").trigger(availableNow=True).foreachBatch(lambda b, n: out.extend(b.collect())).start()
    query.awaitTermination(120)
    return out


def test_streamed_inspection_and_dedup(spark, sf_dir, tmp_path):
    msgs = synth.oru_messages(spark, sf_dir).limit(200)
    got = stream(spark, msgs, f"{tmp_path}/a", lambda s: jobs.inspect(s).select("receipt_id", "total_losses"))
    assert len(got) == msgs.count()
    twice = synth.adt_full(spark, sf_dir).limit(100)
    twice = twice.unionByName(twice.withColumn("receipt_id", F.col("receipt_id") + 10_000))
    got = stream(spark, twice, f"{tmp_path}/b", lambda s: jobs.first_of_marker(sighting.classify(s, synth.AS_OF)).select("receipt_id"))
    assert len(got) == 100


def test_streamed_stays_equal_the_batch(spark, sf_dir, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    spark.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "false")  # else batches for timers never end under availableNow
    events = adt_queries.simple_events(spark, sf_dir).limit(60).cache()
    got = stream(spark, events, f"{tmp_path}/c", jobs.stays, "update")
    want = fold.stays_of(fold.reconstruct(events, synth.AS_OF)).count()
    assert len({r["stay_id"] for r in got if r["kind"] == "stay"}) == want


def test_change_feed_in_any_order(spark, tmp_path):
    run, path = jobs.merge_changes(str(tmp_path)), str(tmp_path)
    rows = [(1, 2, "b"), (1, 1, "a"), (2, 1, "x"), (1, 2, "b")]
    for n, part in enumerate((rows[:1], rows[1:], rows[:2])):
        run(spark.createDataFrame(part, "stay_id long, revision long, after_json string"), n)
    assert sorted(tuple(r) for r in jobs.current(spark, path).select("stay_id", "revision", "after_json").collect()) == [(1, 2, "b"), (2, 1, "x")]


def test_only_the_last_step_is_kept_to_run_again(spark, monkeypatch):
    from caresift.plans import stream_queries

    told, copies = [], []
    monkeypatch.setattr(stream_queries, "kept", lambda df: copies.append(files.kept(df)) or copies[-1])
    rows = spark.range(6).select("id", F.timestamp_seconds(F.col("id") * 86_400).alias("received_ts")).repartition(1)
    stream_queries._grown(spark, rows, ["1970-01-03", "1970-01-05", "1970-02-01"], lambda batch, number: told.append((number, sorted(r.id for r in batch.collect()))))
    assert told == [(0, [0, 1]), (1, [0, 1, 2, 3]), (2, [0, 1, 2, 3, 4, 5]), (2, [0, 1, 2, 3, 4, 5])]
    assert len(copies) == 1


def test_audit_passes_over_receipts_that_were_told(spark, sf_dir, tmp_path):
    """A message that comes again in a later batch is not inspected and written again; a batch that runs again gives the same."""
    rows, run = synth.oru_messages(spark, sf_dir).limit(300).cache(), jobs.audit(str(tmp_path / "log"))
    for batch, number in ((rows.where("receipt_id % 3 = 0"), 0), (rows, 1), (rows, 1)):
        run(batch, number)
    told = files.read_parts(spark, str(tmp_path / "log"), "value string", form="text").select("batch", F.get_json_object("value", "$.receipt_id").cast("long").alias("receipt_id")).collect()
    once = jobs.audit(str(tmp_path / "one"))
    once(rows, 0)
    read = lambda at: {(r["receipt_id"], r["total_losses"], r["forward_decision"]) for r in files.read_audit(spark, str(tmp_path / at), "receipt_id long, total_losses int, forward_decision string").collect()}
    assert len(told) == len({r["receipt_id"] for r in told}) > 100 and {r["receipt_id"] % 3 for r in told if r["batch"] == 0} == {0}
    assert read("log") == read("one")


def test_sighting_of_a_batch_leaves_its_tables_only(spark, sf_dir, tmp_path, monkeypatch):
    """What a batch keeps for itself is gone when it is done, and holds no text but that of held messages."""
    copies = []
    monkeypatch.setattr(files, "kept", lambda df, of=files.kept: copies.append(of(df)) or copies[-1])
    msgs = synth.adt_histories(spark, sf_dir).limit(400).cache()
    run = jobs.sight(str(tmp_path / "s"), synth.AS_OF)
    for batch, number in ((msgs.where("receipt_id % 20 = 0"), 0), (msgs, 1), (msgs, 1)):
        run(batch, number)
    left = [df for df in copies if os.path.exists(df.kept_at.removeprefix("file:"))]
    assert copies and not left and not any("text" in df.columns for df in copies)
    parts = lambda name: files.read_parts(spark, str(tmp_path / "s" / name), jobs.SIGHTED[name])
    held = parts("holds")
    assert parts("dispositions").count() == msgs.count() and held.count() == parts("dispositions").where("kind = 'hold_timequality'").count() > 0 and held.where("text is null or pkey_status is null").count() == 0
