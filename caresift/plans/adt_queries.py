"""Queries over patient movements made from events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from caresift.functions import hl7
from caresift.operators import contacts, erase, estimates, fold, sighting, stays
from caresift.sources import synth
from caresift.sources.files import kept

AS_OF = synth.AS_OF


def simple_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sighting.events(sighting.sight(synth.adt_simple(spark, sf_dir), AS_OF))


def full_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With a second copy of every 50th message, and documents that are no messages at all."""
    m = synth.adt_full(spark, sf_dir)
    again = m.where("receipt_id % 50 = 0").withColumn("receipt_id", F.col("receipt_id") + 1_000_000_000)
    return m.unionByName(again)


def _forward(spark, sf_dir):
    return stays.forward(simple_events(spark, sf_dir))


def sighted(spark, sf_dir):
    return sighting.sight(full_messages(spark, sf_dir), AS_OF).select("receipt_id", "kind", "trigger", "time_provenance")


def dispositions(spark, sf_dir):
    docs = synth.table(spark, sf_dir, "documents").select((F.col("doc_id") + 2_000_000_000).alias("receipt_id"), F.lit(AS_OF).cast("timestamp").alias("received_ts"), "text")
    oru = synth.oru_messages(spark, sf_dir).withColumn("receipt_id", F.col("receipt_id") + 3_000_000_000)
    return sighting.sight(full_messages(spark, sf_dir).unionByName(docs).unionByName(oru), AS_OF).groupBy("kind").agg(F.count("*").alias("n"))


def held(spark, sf_dir):
    return sighting.holds(sighting.sight(full_messages(spark, sf_dir), AS_OF)).select("receipt_id", "kind", "trigger", F.array_join("patient_keys", ",").alias("keys"), "pkey_status")


def dq_findings(spark, sf_dir):
    return sighting.quality_findings(sighting.sight(full_messages(spark, sf_dir), AS_OF)).groupBy("trigger", "reason").agg(F.count("*").alias("n"))


def event_rows(spark, sf_dir):
    rows = sighting.events(sighting.sight(full_messages(spark, sf_dir), AS_OF))
    return rows.select("receipt_id", "patient_key", "trigger", "patient_class", "ward", "room", "bed", "event_ts", F.col("zst.action").alias("zst_action"), F.col("zst.target_msh10").alias("zst_target"))


def forward_stays(spark, sf_dir):
    return _forward(spark, sf_dir)[0].drop("visit_id")


def forward_segments(spark, sf_dir):
    return _forward(spark, sf_dir)[1].select("stay_id", "segment_id", "seq", "ward", "room", "bed", "start_ts", "start_provenance", "end_ts", "end_provenance", "is_open")


def simple_lane(spark, sf_dir):
    return stays.simple_patients(sighting.events(sighting.sight(full_messages(spark, sf_dir), AS_OF))).union(stays.simple_patients(simple_events(spark, sf_dir))).agg(F.count("*").alias("n"))


def delay_log(spark, sf_dir):
    return stays.delay_log(simple_events(spark, sf_dir)).groupBy("trigger", "window").agg(F.count("*").alias("n"), F.sum("delay_seconds").alias("delay"))


def overdue(spark, sf_dir):
    s, g = _forward(spark, sf_dir)
    return stays.overdue(s, g, simple_events(spark, sf_dir), AS_OF).drop("ward")


def markers(spark, sf_dir):
    s, g = _forward(spark, sf_dir)
    return stays.plausibility(s, g, ["W0", "W1", "W2", "W3"])


def contract_segments(spark, sf_dir):
    s, g = _forward(spark, sf_dir)
    return stays.contract_segments(g, stays.plausibility(s, g, ["W0", "W1", "W2", "W3"])).select("stay_id", "segment_id", "seq", "is_open", "segment_markers")


def contract_stays(spark, sf_dir):
    s, g = _forward(spark, sf_dir)
    return stays.contract_stays(s, stays.plausibility(s, g)).select("stay_id", "pattern", "status", "opened_event_ts", "closed_event_ts", "stay_markers")


def exported(spark, sf_dir):
    s, g = _forward(spark, sf_dir)
    return stays.export(s, g, stays.plausibility(s, g)).select("stay_id", F.size("segments").alias("n_segments"), F.array_join(F.transform("segments", lambda x: x["ward"]), ",").alias("wards"))


def contact_pairs(granularity: str):
    """With the segments of patients who are still present: their open end has no bound."""
    return lambda spark, sf_dir: contacts.pairs(_forward(spark, sf_dir)[1], granularity)


def contact_counts(spark, sf_dir):
    return contacts.counts(_forward(spark, sf_dir)[1], "bed")


def in_range(spark, sf_dir):
    return contacts.in_range(_forward(spark, sf_dir)[1], "2024-01-10 00:00:00", "2024-01-11 00:00:00").select("segment_id")


def containing(spark, sf_dir):
    """The segment at the start of each event's hour, at the event, and at the end of its segment."""
    g = _forward(spark, sf_dir)[1]
    at = F.explode(F.array(F.date_trunc("hour", "start_ts"), F.col("start_ts"), F.col("end_ts")))
    points = g.select(F.col("segment_id").alias("point_id"), "patient_key", at.alias("at")).where("at is not null")
    return contacts.containing(g, points).select("point_id", "at", "segment_id")


def erased(spark, sf_dir):
    """The result row of erasing one patient of the intake table, as a dry run."""
    intake = synth.adt_full(spark, sf_dir).withColumn("patient_keys", hl7.patient_keys(F.col("text")))
    intake = intake.withColumn("pkey_status", hl7.patient_class(F.col("text"), F.col("patient_keys")))
    keys = spark.range(1).select(F.lit("HOSP|U7").alias("patient_key"))
    return erase.result(intake, keys)


def kept_after_erasure(spark, sf_dir):
    intake = synth.adt_full(spark, sf_dir).withColumn("patient_keys", hl7.patient_keys(F.col("text")))
    keys = spark.range(3).select(F.concat(F.lit("HOSP|U"), F.col("id").cast("string")).alias("patient_key"))
    return erase.without(intake, keys, ["receipt_id"]).select("receipt_id")


def fold_segments(spark, sf_dir):
    """The fold on the simple lane: the same segments as by windows."""
    rows = fold.segments_of(fold.reconstruct(simple_events(spark, sf_dir), AS_OF))
    return rows.select("stay_id", "segment_id", "seq", "ward", "room", "bed", "start_ts", "start_provenance", "end_ts", "end_provenance", "is_open")


def _full_rows(spark, sf_dir, poll=None):
    return fold.reconstruct(sighting.events(sighting.sight(full_messages(spark, sf_dir), AS_OF)), AS_OF, poll_seconds=poll)


def fold_stays(spark, sf_dir):
    return fold.stays_of(_full_rows(spark, sf_dir)).drop("visit_id")


def fold_changes(spark, sf_dir):
    return fold.latest_changes(fold.changes_of(_full_rows(spark, sf_dir, 3600)))


def fold_statuses(spark, sf_dir):
    rows = _full_rows(spark, sf_dir)
    return rows.where("kind in ('event', 'finding', 'tombstone')").groupBy("kind", "status", "reason").agg(F.count("*").alias("n"))


def _estimates(spark, sf_dir):
    sighted_rows = kept(sighting.sight(full_messages(spark, sf_dir), AS_OF))
    segs = fold.segments_of(kept(fold.reconstruct(sighting.events(sighted_rows), AS_OF)))
    return segs, estimates.bounds(estimates.candidates(sighted_rows, hl7.patient_keys(F.col("text"))), segs)


def estimated(spark, sf_dir):
    return _estimates(spark, sf_dir)[1]


def estimated_segments(spark, sf_dir):
    segs, found = _estimates(spark, sf_dir)
    return estimates.apply(segs, found).select("stay_id", "segment_id", "seq", "ward", "start_ts", "start_provenance", "end_ts", "end_provenance")


QUERIES = {
    "adt_fold_segments": fold_segments, "adt_fold_stays": fold_stays, "adt_fold_changes": fold_changes, "adt_fold_statuses": fold_statuses, "adt_estimates": estimated, "adt_estimated_segments": estimated_segments,
    "adt_sighting": sighted, "adt_dispositions": dispositions, "adt_holds": held, "adt_quality_findings": dq_findings, "adt_events": event_rows, "adt_stays": forward_stays, "adt_segments": forward_segments, "adt_simple_lane": simple_lane, "adt_delay_log": delay_log,
    "adt_overdue": overdue, "adt_markers": markers, "adt_contract_segments": contract_segments, "adt_contract_stays": contract_stays, "adt_export": exported, "adt_contacts_ward": contact_pairs("ward"), "adt_contacts_room": contact_pairs("room"), "adt_contacts_bed": contact_pairs("bed"),
    "adt_contacts_all_ward": contact_pairs("ward"), "adt_contacts_all_room": contact_pairs("room"), "adt_contacts_all_bed": contact_pairs("bed"),
    "adt_contact_counts": contact_counts, "adt_segments_in_range": in_range, "adt_segment_containing": containing, "adt_erase_result": erased, "adt_erase_kept": kept_after_erasure,
}

_SIMPLE = """
WITH e AS (
    SELECT event_id, date_trunc('second', ts) AS ts, 'HOSP|U' || user_id || 'D' || strftime(ts, '%Y%m%d') AS patient,
        'W' || (event_id % 5) AS ward, 'B' || (event_id % 3) AS bed, ts AS raw FROM events
), w AS (
    SELECT *, row_number() OVER o AS n, lead(event_id) OVER o AS next_id, lead(ts) OVER o AS next_ts, first_value(event_id) OVER o AS stay_id, count(*) OVER (PARTITION BY patient) AS cnt FROM e WINDOW o AS (PARTITION BY patient ORDER BY ts, event_id)
), t AS (
    SELECT *, CASE WHEN n = 1 THEN 'A01' WHEN next_id IS NULL THEN 'A03' ELSE 'A02' END AS trig, CASE WHEN n = cnt - 1 THEN 'event' WHEN n < cnt - 1 THEN 'measured' END AS end_prov FROM w
), seg AS (
    SELECT stay_id, patient, stay_id || '-' || event_id AS segment_id, n AS seq, ward, 'R1' AS room, bed, ts AS start_ts, CASE WHEN trig = 'A01' THEN 'event' ELSE 'measured' END AS start_provenance,
        next_ts AS end_ts, end_prov AS end_provenance, next_ts IS NULL AS is_open FROM t WHERE trig <> 'A03'
), stay AS (
    SELECT stay_id, max(patient) AS patient_key, max(cnt)::INT AS revision, min(ts) AS opened, max(CASE WHEN trig = 'A03' THEN ts END) AS closed FROM t GROUP BY stay_id
)
"""
_FULL = """
WITH e AS (
    SELECT event_id, date_trunc('second', ts) AS ts, user_id, event_type FROM events
), b AS (SELECT *, lag(event_id) OVER o AS before, lag(ts) OVER o AS before_ts, lag(event_type) OVER o AS before_type FROM e WINDOW o AS (PARTITION BY user_id ORDER BY ts, event_id)
), t AS (
    SELECT *, CASE WHEN event_id % 17 = 0 THEN 'A08' WHEN event_type = 'error' THEN CASE event_id % 3 WHEN 0 THEN 'A11' WHEN 1 THEN 'A13' ELSE 'A12' END
        WHEN event_type = 'click' THEN 'A02' WHEN event_type = 'purchase' THEN 'A01' WHEN event_type = 'signup' THEN 'A03' ELSE 'A04' END AS trig FROM b
), k AS (
    SELECT *, CASE WHEN event_id % 23 = 0 AND trig = 'A02' THEN 'hold_timequality' ELSE 'usable' END AS kind,
        CASE WHEN event_id % 23 = 0 THEN 'recorded_substitute' WHEN trig = 'A02' THEN 'measured' ELSE 'event' END AS prov FROM t
), all_ AS (
    SELECT event_id AS receipt_id, kind, trig, prov, event_id, user_id FROM k
    UNION ALL SELECT event_id + 1000000000, 'suppressed_duplicate', trig, prov, event_id, user_id FROM k WHERE event_id % 50 = 0
)
"""
_ALL_PAIRS = "SELECT x.segment_id, y.segment_id AS other_id FROM seg x JOIN seg y ON x.ward = y.ward {more} AND x.patient <> y.patient AND (x.end_ts IS NULL OR y.start_ts < x.end_ts) AND (y.end_ts IS NULL OR x.start_ts < y.end_ts)"

ORACLE = {
    "adt_sighting": _FULL + "SELECT receipt_id, kind, trig AS trigger, CASE WHEN kind <> 'hold_timequality' AND NOT (trig = 'A02' AND event_id % 23 = 0) THEN prov END AS time_provenance FROM all_",
    "adt_dispositions": _FULL + "SELECT kind, count(*) AS n FROM (SELECT kind FROM all_ UNION ALL SELECT CASE WHEN a <> '' AND b <> '' AND c <> '' AND row_number() OVER (PARTITION BY a, b, c ORDER BY doc_id) > 1 THEN 'suppressed_duplicate' ELSE 'hold_malformed' END FROM (SELECT doc_id, trim(split_part(l, '|', 3)) AS a, trim(split_part(l, '|', 4)) AS b, trim(split_part(l, '|', 10)) AS c FROM (SELECT doc_id, split_part(text, chr(10), 1) AS l FROM documents)) UNION ALL SELECT 'ignored' FROM orders) GROUP BY kind",
    "adt_holds": _FULL + "SELECT receipt_id, kind, trig AS trigger, 'HOSP|U' || user_id AS keys, 'keyed' AS pkey_status FROM all_ WHERE kind = 'hold_timequality'",
    "adt_quality_findings": _FULL + "SELECT trig AS trigger, 'no time' AS reason, count(*) AS n FROM all_ WHERE kind = 'hold_timequality' GROUP BY ALL",
    "adt_events": _FULL + "SELECT event_id AS receipt_id, 'HOSP|U' || user_id AS patient_key, trig AS trigger, CASE WHEN event_id % 4 = 0 THEN 'O' ELSE 'I' END AS patient_class, 'W' || (event_id % 5) AS ward, 'R1' AS room, 'B' || (event_id % 3) AS bed, ts AS event_ts, CASE WHEN before IS NOT NULL AND trig IN ('A08', 'A11', 'A12', 'A13') THEN CASE WHEN trig = 'A08' THEN 'UPDATES' ELSE 'CANCELS' END END AS zst_action, CASE WHEN trig IN ('A08', 'A11', 'A12', 'A13') THEN 'E' || before END AS zst_target FROM k WHERE kind = 'usable'",
    "adt_stays": _SIMPLE + "SELECT stay_id, revision, 'A' AS pattern, CASE WHEN closed IS NULL THEN 'open' ELSE 'closed' END AS status, patient_key, opened AS opened_event_ts, closed AS closed_event_ts FROM stay",
    "adt_segments": _SIMPLE + "SELECT stay_id, segment_id, seq::INT AS seq, ward, room, bed, start_ts, start_provenance, end_ts, end_provenance, is_open FROM seg",
    "adt_fold_segments": _SIMPLE + "SELECT stay_id, segment_id, seq::INT AS seq, ward, room, bed, start_ts, start_provenance, end_ts, end_provenance, is_open FROM seg",
    "adt_simple_lane": _FULL + ", lane AS (SELECT bool_and(CASE WHEN n = 1 THEN trig = 'A01' ELSE trig = 'A02' OR (trig = 'A03' AND n = c) END) AS fits FROM (SELECT user_id, trig, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n, count(*) OVER (PARTITION BY user_id) AS c FROM k WHERE kind = 'usable') GROUP BY user_id) SELECT count(*) FILTER (WHERE fits) + (SELECT count(DISTINCT (user_id, strftime(ts, '%Y%m%d'))) FROM e) AS n FROM lane",
    "adt_delay_log": _SIMPLE + "SELECT trig AS trigger, CASE WHEN trig = 'A01' THEN 'join' ELSE 'jitter' END AS window, count(*) AS n, 0::BIGINT AS delay FROM t GROUP BY ALL",
    "adt_overdue": _SIMPLE + "SELECT stay_id, segment_id, 'stationary' AS duration_class, (epoch(TIMESTAMP '2024-02-15') - epoch(start_ts))::BIGINT AS age_seconds, 'E' || stay_id AS msh10 FROM seg WHERE is_open AND epoch(TIMESTAMP '2024-02-15') - epoch(start_ts) > 14 * 86400",
    "adt_markers": _SIMPLE + "SELECT stay_id, 'segment' AS scope, segment_id AS ref_id, 'unknown_ward' AS kind FROM seg WHERE ward = 'W4' UNION ALL SELECT stay_id, 'segment', segment_id, 'zero_duration' FROM seg WHERE start_ts = end_ts",
    "adt_contract_segments": _SIMPLE + "SELECT stay_id, segment_id, seq::INT AS seq, is_open, nullif(concat_ws(',', CASE WHEN ward = 'W4' THEN 'unknown_ward' END, CASE WHEN start_ts = end_ts THEN 'zero_duration' END), '') AS segment_markers FROM seg",
    "adt_contract_stays": _SIMPLE + "SELECT stay_id, 'A' AS pattern, CASE WHEN closed IS NULL THEN 'open' ELSE 'closed' END AS status, opened AS opened_event_ts, closed AS closed_event_ts, NULL::VARCHAR AS stay_markers FROM stay",
    "adt_export": _SIMPLE + "SELECT stay_id, count(*)::INT AS n_segments, string_agg(ward, ',' ORDER BY seq) AS wards FROM seg GROUP BY stay_id",
    "adt_contacts_ward": _SIMPLE + _ALL_PAIRS.format(more=""),
    "adt_contacts_room": _SIMPLE + _ALL_PAIRS.format(more="AND x.room = y.room"),
    "adt_contacts_bed": _SIMPLE + _ALL_PAIRS.format(more="AND x.bed = y.bed"),
    "adt_contacts_all_ward": _SIMPLE + _ALL_PAIRS.format(more=""),
    "adt_contacts_all_room": _SIMPLE + _ALL_PAIRS.format(more="AND x.room = y.room"),
    "adt_contacts_all_bed": _SIMPLE + _ALL_PAIRS.format(more="AND x.bed = y.bed"),
    "adt_contact_counts": _SIMPLE + "SELECT x.segment_id, count(*) AS n FROM seg x JOIN seg y ON x.ward = y.ward AND x.bed = y.bed AND x.patient <> y.patient AND (x.end_ts IS NULL OR y.start_ts < x.end_ts) AND (y.end_ts IS NULL OR x.start_ts < y.end_ts) GROUP BY x.segment_id",
    "adt_segments_in_range": _SIMPLE + "SELECT segment_id FROM seg WHERE start_ts < TIMESTAMP '2024-01-11' AND (end_ts IS NULL OR end_ts > TIMESTAMP '2024-01-10')",
    "adt_segment_containing": _SIMPLE + "SELECT point_id, mv AS \"at\", max_by(segment_id, (start_ts, segment_id)) AS segment_id FROM (SELECT DISTINCT p.segment_id AS point_id, p.mv, g.segment_id, g.start_ts FROM (SELECT segment_id, patient, unnest([date_trunc('hour', start_ts), start_ts, end_ts]) AS mv FROM seg) p JOIN seg g ON g.patient = p.patient AND g.start_ts <= p.mv AND (g.end_ts IS NULL OR p.mv < g.end_ts)) GROUP BY point_id, mv",
    "adt_erase_result": "SELECT 'HOSP|U7' AS patient_key, count(*) FILTER (WHERE user_id = 7) AS deleted, 0::BIGINT AS unresolvable, 'complete' AS status, true AS dry_run FROM events",
    "adt_erase_kept": "SELECT event_id AS receipt_id FROM events WHERE user_id NOT IN (0, 1, 2)",
}
