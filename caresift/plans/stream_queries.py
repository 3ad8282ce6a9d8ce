"""The streaming jobs over tables of messages, run until all that is there has been read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from caresift.operators import fold, sighting
from caresift.plans import adt_queries, history_queries, v2_queries
from caresift.sources import synth
from caresift.sources.files import CODEC, dropped, forget, kept, new_folder, read_audit, read_parts
from caresift.streaming import jobs


#: Files of a step of a replayed stream.
FILES = 4


def _streamed(rows: DataFrame) -> DataFrame:
    """``rows`` as a table in the shared folder, read as a stream."""
    folder = new_folder(rows.sparkSession)
    rows.write.parquet(folder)
    return rows.sparkSession.readStream.schema(rows.schema).parquet(folder)


def reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = jobs.inspect(_streamed(synth.oru_messages(spark, sf_dir))).select("receipt_id", "message_type", "total_losses", "n_critical", "n_warning")
    return jobs.run_available(out, new_folder(spark))


def rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages a second by type, over seven days, from each day on."""
    out = jobs.rates(jobs.inspect(_streamed(synth.oru_messages(spark, sf_dir))), ["message_type"], "7 days", "1 day")
    rows = jobs.run_available(out, new_folder(spark), "complete")
    return rows.select(F.col("window.start").alias("start"), "message_type", "n", F.round("rate", 9).alias("rate"))


def loss_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Losses a second by pattern, over windows of one day."""
    rows = jobs.inspect(_streamed(synth.oru_messages(spark, sf_dir))).select("received_ts", F.explode("findings.pattern").alias("pattern"))
    out = jobs.run_available(jobs.rates(rows, ["pattern"], "1 day", "1 day"), new_folder(spark), "complete")
    return out.select(F.col("window.start").alias("start"), "pattern", "n", F.round("rate", 9).alias("rate"))


def markers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each complete marker passes once, whichever of its messages came first."""
    rows = sighting.classify(_streamed(adt_queries.full_messages(spark, sf_dir)), adt_queries.AS_OF)
    out = jobs.first_of_marker(rows).select(F.col("marker.msh10").alias("msh10"), "kind", "trigger")
    return jobs.run_available(out, new_folder(spark))


def changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table that a consumer of the change feed keeps: the highest revision of each stay."""
    feed = fold.changes_of(history_queries._rows(spark, sf_dir, "change")).select("stay_id", "revision", "after_json")
    folder = new_folder(spark)
    write = _streamed(feed).writeStream.option("checkpointLocation", f"{folder}-cursor").foreachBatch(jobs.merge_changes(folder))
    write.trigger(availableNow=True).start().awaitTermination()
    return jobs.current(spark, folder).select("stay_id", "revision", F.get_json_object("after_json", "$.stay.status").alias("status"))


def _stay_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fold's rows of the scripted histories, read as a stream in four steps of arrival; the clock is the watermark.

    A last row of no known patient carries the clock past all that falls due.
    """
    events = sighting.events(history_queries._sighted(spark, sf_dir)).drop("patient_keys")
    end = events.limit(1).select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in events.schema if f.name not in ("receipt_id", "arrival_ts")], F.lit(-1).cast("long").alias("receipt_id"), F.lit("2024-03-15").cast("timestamp").alias("arrival_ts"))
    folder, rows = new_folder(spark), kept(events.unionByName(end))
    cuts = rows.agg(F.percentile_approx("arrival_ts", [0.25, 0.5, 0.75])).first()[0]
    step = sum((F.col("arrival_ts") > F.lit(c)).cast("int") for c in cuts)
    for n in range(len(cuts) + 1):  # files are read in the order of writing, so many at a time
        rows.where(step == n).repartition(FILES).write.mode("append").parquet(folder)
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", FILES).parquet(folder)
    wanted = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider", "spark.sql.streaming.noDataMicroBatches.enabled": "true"}
    held = {k: spark.conf.get(k) for k in wanted}
    for k, v in wanted.items():
        spark.conf.set(k, v)
    try:
        return jobs.run_available(jobs.stays(stream, poll_seconds=600, late="1 hour"), new_folder(spark))
    finally:
        for k, v in held.items():
            spark.conf.set(k, v)


def stays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each stay as its last revision has it, with its wards in order."""
    rows = _stay_rows(spark, sf_dir)
    last = Window.partitionBy("stay_id")
    rows = rows.where("kind in ('stay', 'segment')").withColumn("last", F.max("revision").over(last)).where("revision = last")
    wards = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("kind") == "segment", F.struct("seq", "ward")))), lambda s: s["ward"]), ",")
    one = lambda c: F.max(F.when(F.col("kind") == "stay", F.col(c)))
    return rows.groupBy("stay_id").agg(F.max("revision").cast("int").alias("revision"), one("pattern").alias("pattern"), one("status").alias("status"), F.max("patient_key").alias("patient_key"), F.timestamp_seconds(one("start_s")).alias("opened_event_ts"), F.timestamp_seconds(one("end_s")).alias("closed_event_ts"), wards.alias("wards"))


def stay_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the stream told of events: statuses, findings and changes."""
    rows = _stay_rows(spark, sf_dir).where("kind in ('event', 'finding', 'change')")
    return rows.where("receipt_id >= 0").select("receipt_id", "kind", "status", F.when(F.col("kind") == "change", F.col("revision")).alias("revision"))


def _grown(spark: SparkSession, rows: DataFrame, cuts: list[str], job) -> None:
    """Runs ``job`` (for ``foreachBatch``) over a folder that grows: each time, all rows received before a cut are added once
    more, and the stream takes up what is new in the folder.  The last batch then runs again, as after a lost executor.  Kept
    ``rows`` go when all of them are in the folder."""
    folder, held, last = new_folder(spark), {}, cuts[-1]

    def remembered(batch: DataFrame, number: int) -> None:
        job(batch, number)
        if cut == last:  # of the steps before, no batch runs again
            held["last"] = kept(batch), number

    for cut in cuts:
        rows.where(F.col("received_ts") < cut).write.mode("append").parquet(folder, compression=CODEC)
        if cut == last:
            dropped(rows)
        stream = spark.readStream.schema(rows.schema).parquet(folder)
        stream.writeStream.option("checkpointLocation", f"{folder}-cursor").foreachBatch(remembered).trigger(availableNow=True).start().awaitTermination()
        forget(spark)
    job(*held["last"])
    dropped(held["last"][0])


def _incremental(spark: SparkSession, sf_dir: str) -> str:
    """The folder of an incremental sighting of the scripted histories, with late copies of every 50th message."""
    m = synth.adt_histories(spark, sf_dir)
    late = m.where("receipt_id % 50 = 0").withColumns({"receipt_id": F.col("receipt_id") + 1_000_000_000_000, "received_ts": F.col("received_ts") + F.expr("interval 20 days")})
    folder = new_folder(spark)
    _grown(spark, kept(m.unionByName(late)), ["2024-01-12", "2024-01-25", "2025-01-01"], jobs.sight(folder, adt_queries.AS_OF))
    return folder


def increment_dispositions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_parts(spark, f"{_incremental(spark, sf_dir)}/dispositions", jobs.SIGHTED["dispositions"]).select("receipt_id", "kind", "trigger")


def increment_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of each table of the incremental sighting, by kind where it has one."""
    folder = _incremental(spark, sf_dir)
    out = None
    for name in ("markers", "holds", "findings", "events"):
        rows = read_parts(spark, f"{folder}/{name}", jobs.SIGHTED.get(name, "receipt_id long, patient_key string"))
        kind = F.col("kind") if "kind" in rows.columns else F.lit("")
        own = rows.groupBy(F.lit(name).alias("table"), kind.alias("kind")).agg(F.count("*").alias("n"), F.count_distinct("receipt_id").alias("receipts"))
        out = own if out is None else out.unionByName(own)
    return out


def audit_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The durable audit log, read back: with losses, messages that can't be inspected, and failed forwards."""
    m = synth.oru_messages(spark, sf_dir)
    lost = m.where("receipt_id % 100 = 0").withColumns({"receipt_id": -F.col("receipt_id") - 1, "text": F.lit(None).cast("string")})
    failed = F.when(F.col("receipt_id") % 40 == 7, "forward-failed").when(F.col("has_critical"), "blocked").otherwise("forwarded")
    path = new_folder(spark)
    _grown(spark, kept(m.unionByName(lost)), ["1994-01-01", "1996-01-01", "2100-01-01"], jobs.audit(path, lambda rows: failed))
    schema = "receipt_id long, message_type string, control_id string, uninspectable boolean, total_losses int, forward_decision string, ack_code string, audit_events array<struct<id:string,severity:string>>"
    rows = read_audit(spark, path, schema)
    return rows.select("receipt_id", "message_type", "control_id", "uninspectable", "total_losses", "forward_decision", "ack_code", F.size("audit_events").alias("n_events"), F.coalesce(F.get("audit_events", F.size("audit_events") - 1)["id"], F.lit("")).alias("last_id"))


QUERIES = {
    "adt_increment_dispositions": increment_dispositions, "adt_increment_tables": increment_tables, "v2_audit_sink": audit_sink,
    "adt_stream_stays": stays, "adt_stream_stay_log": stay_log,
    "v2_stream_reports": reports, "v2_stream_rates": rates, "v2_stream_loss_rates": loss_rates, "adt_stream_markers": markers, "adt_stream_changes": changes,
}

ORACLE = {
    "v2_stream_reports": v2_queries._sql("SELECT k AS receipt_id, message_type, total::INT AS total_losses, crit::INT AS n_critical, warn::INT AS n_warning FROM rep"),
    "v2_stream_rates": v2_queries._sql("SELECT ts::DATE::TIMESTAMP - d * INTERVAL 1 DAY AS start, message_type, count(*) AS n, round(count(*) / 604800.0::DOUBLE, 9) AS rate FROM msg, range(7) r(d) GROUP BY ALL"),
    "v2_stream_loss_rates": v2_queries._sql("SELECT ts::DATE::TIMESTAMP AS start, pattern, count(*) AS n, round(count(*) / 86400.0::DOUBLE, 9) AS rate FROM found JOIN msg USING (k) GROUP BY ALL"),
    "adt_stream_markers": adt_queries._FULL + "SELECT 'E' || event_id AS msh10, kind, trig AS trigger FROM k",
    "adt_stream_changes": history_queries._H + "SELECT stay_id, revision::BIGINT AS revision, sa AS status FROM change",
    "adt_stream_stays": history_queries._H + "SELECT stay_id, revision, pattern, status, patient_key, opened AS opened_event_ts, closed AS closed_event_ts, coalesce((SELECT string_agg(ward, ',' ORDER BY seq) FROM seg WHERE seg.stay_id = stay.stay_id), '') AS wards FROM stay",
    "adt_stream_stay_log": "SELECT receipt_id, kind, status, NULL::BIGINT AS revision FROM (" + history_queries.ORACLE["adt_retro_statuses"] + ") WHERE kind <> 'tombstone' UNION ALL SELECT receipt_id, 'change', change, revision FROM (" + history_queries.ORACLE["adt_retro_changes"] + ")",
    "adt_increment_dispositions": history_queries._H + "SELECT receipt_id, CASE WHEN mv IS NULL THEN 'hold_timequality' ELSE 'usable' END AS kind, trig AS trigger FROM m UNION ALL SELECT receipt_id + 1000000000000, 'suppressed_duplicate', trig FROM m WHERE receipt_id % 50 = 0",
    "adt_increment_tables": history_queries._H
    + """SELECT "table", kind, count(*) AS n, count(*) AS receipts FROM (SELECT 'markers' AS "table", '' AS kind FROM m UNION ALL SELECT 'holds', 'hold_timequality' FROM m WHERE mv IS NULL UNION ALL SELECT 'findings', 'hold_timequality' FROM m WHERE mv IS NULL
    UNION ALL SELECT 'findings', 'unassigned' FROM m WHERE s = 22 AND mv IS NOT NULL UNION ALL SELECT 'events', '' FROM m WHERE s <> 22 AND mv IS NOT NULL) GROUP BY ALL""",
    "v2_audit_sink": v2_queries._sql(
        """SELECT k AS receipt_id, message_type, 'M' || k AS control_id, false AS uninspectable, total::INT AS total_losses, CASE WHEN k % 40 = 7 THEN 'forward-failed' WHEN crit > 0 THEN 'blocked' ELSE 'forwarded' END AS forward_decision, CASE WHEN crit > 0 THEN 'AE' ELSE 'AA' END AS ack_code,
        (crit + warn)::INT AS n_events, CASE WHEN crit + warn > 0 THEN k || '-' || (crit + warn - 1)::BIGINT ELSE '' END AS last_id FROM rep WHERE crit > 0 OR warn > 0 OR k % 40 = 7
        UNION ALL SELECT -k - 1, 'UNPARSEABLE', '', true, NULL, CASE WHEN (-k - 1) % 40 = 7 THEN 'forward-failed' ELSE 'forwarded' END, 'AA', 0, '' FROM msg WHERE k % 100 = 0"""
    ),
}
