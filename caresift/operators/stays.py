"""Stays and location segments: window functions where a patient's messages run forward, and what is derived from them."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from caresift.sources.files import large


@dataclass(frozen=True)
class Windows:
    """Seconds of arrival time."""

    jitter: int = 300
    join: int = 6 * 3600
    tombstone: int = 7 * 24 * 3600
    stationary: int = 14 * 24 * 3600
    intensive: int = 60 * 24 * 3600
    ambulatory: int = 24 * 3600
    intensive_wards: tuple[str, ...] = ("ITS", "IMC")


def simple_patients(events: DataFrame) -> DataFrame:
    """Patients whose events are one A01, first, then A02s, then at most one A03, last: the lane of ``forward``."""
    order = Window.partitionBy("patient_key").orderBy("event_ts", "receipt_id")
    rows = events.where("patient_key is not null").select("patient_key", "trigger", F.row_number().over(order).alias("n"), F.lead("receipt_id").over(order).isNull().alias("last"))
    fits = F.when(F.col("n") == 1, F.col("trigger") == "A01").otherwise((F.col("trigger") == "A02") | ((F.col("trigger") == "A03") & F.col("last")))
    return rows.groupBy("patient_key").agg(F.bool_and(fits).alias("fits")).where("fits").select("patient_key")


def forward(events: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(stays, segments) of patients in the simple lane; one shuffle by patient, all windows over it."""
    order = Window.partitionBy("patient_key").orderBy("event_ts", "receipt_id")
    whole = Window.partitionBy("patient_key")
    rows = events.withColumns(
        {
            "seq": F.row_number().over(order),
            "end_ts": F.lead("event_ts").over(order),
            "end_provenance": F.lead("provenance").over(order),
            "end_receipt": F.lead("receipt_id").over(order),
            "stay_id": F.first("receipt_id").over(order),
            "closed_ts": F.max(F.when(F.col("trigger") == "A03", F.col("event_ts"))).over(whole),
            "visit": F.first("visit_id", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)),
            "n_events": F.count("*").over(whole),
        }
    )
    segments = rows.where("trigger <> 'A03'").select(
        "stay_id", "patient_key", F.col("n_events").cast("int").alias("revision"), F.concat_ws("-", "stay_id", "receipt_id").alias("segment_id"), "seq", "pv1_3_raw", "ward", "room", "bed", F.col("event_ts").alias("start_ts"), F.col("provenance").alias("start_provenance"),
        F.col("receipt_id").alias("start_receipt"), "trigger", "end_ts", "end_provenance", "end_receipt", F.col("end_ts").isNull().alias("is_open"),
    )
    stays = rows.where("seq = 1").select("stay_id", F.col("n_events").cast("int").alias("revision"), F.lit("A").alias("pattern"), F.when(F.col("closed_ts").isNull(), "open").otherwise("closed").alias("status"), "patient_key", F.col("visit").alias("visit_id"), F.col("event_ts").alias("opened_event_ts"), F.col("closed_ts").alias("closed_event_ts"))
    return stays, segments


def delay_log(events: DataFrame) -> DataFrame:
    """Whole seconds from event to arrival, and the window that waits for it."""
    return events.where("event_ts is not null").select("receipt_id", "trigger", "event_ts", "arrival_ts", (F.unix_timestamp("arrival_ts") - F.unix_timestamp("event_ts")).alias("delay_seconds"), F.when(F.col("trigger").isin("A01", "A04"), "join").otherwise("jitter").alias("window"))


def duration_limit(pattern: Column, ward: Column, windows: Windows = Windows()) -> tuple[Column, Column]:
    """Class and seconds from which an open segment is overdue, or a closed one too long."""
    short, intensive = pattern.isin("pending", "C"), F.lit(False)
    for prefix in windows.intensive_wards:
        intensive = intensive | F.startswith(ward, F.lit(prefix))
    pick = lambda a, b, c: F.when(short, F.lit(a)).when(intensive, F.lit(b)).otherwise(F.lit(c))
    return pick("ambulatory", "intensive", "stationary"), pick(windows.ambulatory, windows.intensive, windows.stationary)


def overdue(stays: DataFrame, segments: DataFrame, events: DataFrame, as_of: str, flagged: DataFrame | None = None, windows: Windows = Windows()) -> DataFrame:
    """Open segments older than their class allows, with the opening message's control id; each once (not in ``flagged``)."""
    kind, limit = duration_limit(F.col("pattern"), F.col("ward"), windows)
    rows = segments.where("is_open").join(large(stays.select("stay_id", "pattern")), "stay_id").join(large(events.select(F.col("receipt_id").alias("start_receipt"), "msh10")), "start_receipt", "left")
    age = F.unix_timestamp(F.lit(as_of).cast("timestamp")) - F.unix_timestamp("start_ts")
    out = rows.withColumns({"duration_class": kind, "age_seconds": age}).where(age > limit).select("stay_id", "segment_id", "ward", "duration_class", "age_seconds", "msh10")
    return out.join(large(flagged.select("segment_id")), "segment_id", "left_anti").select(out.columns) if flagged is not None else out


def plausibility(stays: DataFrame, segments: DataFrame, known_wards: list[str] | None = None, windows: Windows = Windows()) -> DataFrame:
    """stay_id, scope, ref_id, kind: the seven markers of the present state; durations only of bounds that aren't estimated."""
    exact = (F.coalesce("start_provenance", F.lit("")) != "estimated") & (F.coalesce("end_provenance", F.lit("")) != "estimated")
    rows = segments.join(large(stays.select("stay_id", "pattern")), "stay_id")
    _, limit = duration_limit(F.col("pattern"), F.col("ward"), windows)
    length = F.unix_timestamp("end_ts") - F.unix_timestamp("start_ts")
    strange = (F.col("ward") != "") & ~F.col("ward").isin(*known_wards) if known_wards is not None else F.lit(False)
    marks = F.array_compact(F.array(F.when(strange, "unknown_ward"), F.when(exact & (length < 0), "negative_duration"), F.when(exact & (length == 0), "zero_duration"), F.when(exact & (length > limit), "excessive_duration")))
    own = rows.select("stay_id", F.lit("segment").alias("scope"), F.col("segment_id").alias("ref_id"), F.explode(marks).alias("kind"))
    still = F.sum(F.when(F.col("status") == "open", 1).otherwise(0)).over(Window.partitionBy("patient_key"))
    moved = segments.groupBy("stay_id").agg(F.bool_or(F.col("trigger") == "A02").alias("moved"))
    whole = stays.withColumn("n_open", still).join(large(moved), "stay_id", "left")
    marks = F.array_compact(F.array(F.when((F.col("status") == "closed") & (F.col("closed_event_ts") < F.col("opened_event_ts")), "implausible_order"), F.when((F.col("status") == "open") & (F.col("n_open") > 1), "overlapping_open_stays"), F.when(F.col("pattern").isin("pending", "C") & F.col("moved"), "orphan_transfer")))
    return own.unionByName(whole.select("stay_id", F.lit("stay").alias("scope"), F.col("stay_id").cast("string").alias("ref_id"), F.explode(marks).alias("kind")))


def new_markers(now: DataFrame, before: DataFrame) -> DataFrame:
    return now.join(large(before.select("scope", "ref_id", "kind")), ["scope", "ref_id", "kind"], "left_anti").select(now.columns)


def in_order(stays: DataFrame, by: str = "patient_key") -> DataFrame:
    """Stays of each patient, or of each visit, numbered from 1 by time; those without one are left out."""
    order = Window.partitionBy(by).orderBy("opened_event_ts", "stay_id")
    return stays.where(F.col(by).isNotNull()).withColumn("n", F.row_number().over(order))


def _best(asked: DataFrame, stays: DataFrame, fits: Column) -> DataFrame:
    """Of the stays that fit: one of the visit that is asked for first, then the latest opened, then the greatest id."""
    own = stays.select(F.col("patient_key").alias("__k"), "stay_id", F.col("visit_id").alias("__v"), "status", "opened_event_ts", "closed_event_ts")
    same = F.coalesce(F.col("visit_id") == F.col("__v"), F.lit(False))
    hit = asked.join(large(own), (F.col("patient_key") == F.col("__k")) & fits)
    return hit.groupBy(*asked.columns).agg(F.max_by("stay_id", F.struct(same.alias("a"), F.col("opened_event_ts").alias("b"), F.col("stay_id").alias("c"))).alias("stay_id"))


def best_open(asked: DataFrame, stays: DataFrame) -> DataFrame:
    """``asked`` (patient_key, visit_id and more) with the open stay an event would go to; rows without one are left out.

    Equal rows of ``asked`` make one; a null visit prefers none.
    """
    return _best(asked, stays, F.col("status") == "open")


def closed_containing(asked: DataFrame, stays: DataFrame) -> DataFrame:
    """``asked`` (patient_key, visit_id, at and more) with the closed stay that holds ``at``: opened <= at < closed."""
    return _best(asked, stays, (F.col("status") == "closed") & (F.col("opened_event_ts") <= F.col("at")) & (F.col("at") < F.col("closed_event_ts")))


def table_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """(table, n) of each table; one small job, no rows on the driver."""
    counts = [df.agg(F.lit(name).alias("table"), F.count("*").alias("n")) for name, df in tables.items()]
    out = counts[0]
    for c in counts[1:]:
        out = out.unionByName(c)
    return out


def contract_segments(segments: DataFrame, marks: DataFrame, estimates: DataFrame | None = None) -> DataFrame:
    """The published segment table; its columns and their order are frozen."""
    names = marks.where("scope = 'segment'").groupBy(F.col("ref_id").alias("segment_id")).agg(F.array_join(F.array_sort(F.collect_set("kind")), ",").alias("segment_markers"))
    rows = segments.join(large(names), "segment_id", "left")
    bounds = {c: F.lit(None).cast(t) for c, t in (("estimate_lower", "timestamp"), ("estimate_upper", "timestamp"), ("estimate_lower_source", "long"), ("estimate_upper_source", "long"))}
    if estimates is not None:  # by the start's receipt, else by the end's
        active = estimates.where("status = 'active'").select("receipt_id", *bounds)
        side = lambda at, p: active.select(F.col("receipt_id").alias(at), *[F.col(c).alias(f"{p}{c}") for c in bounds])
        rows = rows.join(large(side("start_receipt", "__s")), "start_receipt", "left").join(large(side("end_receipt", "__e")), "end_receipt", "left")
        gate = lambda c: F.coalesce(F.when(F.col("start_provenance") == "estimated", F.col(f"__s{c}")), F.when(F.col("end_provenance") == "estimated", F.col(f"__e{c}")))
        bounds = {c: gate(c) for c in bounds}
    rows = rows.withColumns(bounds)
    return rows.select("stay_id", "revision", "segment_id", "seq", "pv1_3_raw", "ward", "room", "bed", "start_ts", "start_provenance", "end_ts", "end_provenance", "is_open", "segment_markers", *bounds)


def contract_stays(stays: DataFrame, marks: DataFrame) -> DataFrame:
    names = marks.where("scope = 'stay'").groupBy(F.col("ref_id").cast("long").alias("stay_id")).agg(F.array_join(F.array_sort(F.collect_set("kind")), ",").alias("stay_markers"))
    return stays.join(large(names), "stay_id", "left").select("stay_id", "revision", "pattern", "status", "patient_key", "visit_id", "opened_event_ts", "closed_event_ts", "stay_markers")


def export(stays: DataFrame, segments: DataFrame, marks: DataFrame, estimates: DataFrame | None = None) -> DataFrame:
    """A row per stay with its ordered segments, its markers and its active estimates; no patient key.

    An estimate belongs to the stay whose segment begins or ends by its receipt.
    """
    segs = segments.groupBy("stay_id").agg(F.array_sort(F.collect_list(F.struct("seq", "ward", "room", "bed", "start_ts", "end_ts"))).alias("segments"))
    names = marks.groupBy("stay_id").agg(F.array_sort(F.collect_list(F.struct("scope", "kind"))).alias("markers"))
    out = stays.select("stay_id", "pattern", "status", "opened_event_ts", "closed_event_ts").join(large(segs), "stay_id", "left").join(large(names), "stay_id", "left")
    if estimates is None:
        return out
    ends = segments.select("stay_id", F.explode(F.array("start_receipt", "end_receipt")).alias("receipt_id")).where("receipt_id is not null").distinct()
    active = estimates.where("status = 'active'").select("receipt_id", "estimate_lower", "estimate_upper").join(large(ends), "receipt_id").groupBy("stay_id")
    return out.join(large(active.agg(F.array_sort(F.collect_list(F.struct("receipt_id", "estimate_lower", "estimate_upper"))).alias("estimates"))), "stay_id", "left")
