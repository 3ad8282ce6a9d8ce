"""Sighting of patient movements: relevance, time quality, repeats, and the event rows that stays are built from."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caresift.functions import hl7
from caresift.sources.files import kept, large

#: The triggers that move a patient, and where each tells its time.
RELEVANT = ("A01", "A02", "A03", "A04", "A08", "A11", "A12", "A13")
EVENT, RECORDED = ("EVN", 6), ("EVN", 2)
TIME_FIELDS = {"A01": (("PV1", 44), EVENT, RECORDED), "A02": (("ZBE", 2), EVENT), "A03": (("PV1", 45), EVENT, RECORDED)}
PROVENANCE = {("PV1", 44): "measured", ("PV1", 45): "measured", ("ZBE", 2): "measured", EVENT: "event", RECORDED: "recorded_substitute"}
LABELS = {("PV1", 44): "PV1-44", ("PV1", 45): "PV1-45", ("ZBE", 2): "ZBE-2", EVENT: "EVN-6", RECORDED: "EVN-2"}


@dataclass(frozen=True)
class SightingConfig:
    min_year: int = 1970
    max_future_days: int = 366
    time_fields: dict = field(default_factory=lambda: dict(TIME_FIELDS))
    visit_fields: tuple[tuple[str, int], ...] = (("PV1", 19), ("PV1", 15))
    wanted_id: str = "MR"
    authority: str = ""

    def for_trigger(self, trigger: str) -> tuple:
        return self.time_fields.get(trigger, (EVENT, RECORDED))


def segment_field(kind: str, n: int) -> Column:
    """Field n of the first segment of a kind, stripped; "" where it is missing.  Of rows of ``classify``, and kinds they keep."""
    return hl7.tidy(hl7.field(F.col(f"__{kind}"), n), F.col("__loose"))


def movement_time(told: dict[tuple[str, int], Column], trigger: Column, config: SightingConfig) -> Column:
    """struct<raw, provenance, source> of the first field in the trigger's list that isn't empty; null if there is none.

    ``told``: the fields' values.
    """

    def first(fields: tuple) -> Column:
        return F.coalesce(*[F.when(told[f] != "", F.struct(told[f].alias("raw"), F.lit(PROVENANCE.get(f, "event")).alias("provenance"), F.lit(LABELS.get(f, f"{f[0]}-{f[1]}")).alias("source"))) for f in fields])

    out = F.when(F.lit(False), first((EVENT,)))
    for t in config.time_fields:
        out = out.when(trigger == t, first(config.for_trigger(t)))
    return out.otherwise(first((EVENT, RECORDED)))


def _typed(msgs: DataFrame, text: str) -> DataFrame:
    """``msgs`` with __whole, __loose, marker, code and trigger."""
    is_loose = F.col("__loose")
    rows = hl7.computed_once(msgs, {"__whole": hl7.joined(F.col(text))})
    rows = hl7.computed_once(rows, {"__loose": hl7.loose(F.col("__whole"))})
    rows = hl7.computed_once(rows, {"__first": hl7.first_line(F.col(text))})
    plain = ~is_loose & (F.get("__first", F.lit(0)) == "MSH")  # the first line is the first MSH segment
    rows = hl7.computed_once(rows, {"marker": hl7.marker_of(F.col("__first"), is_loose), "__MSH": F.when(plain, F.col("__first")).otherwise(hl7.fields_of(F.col("__whole"), is_loose, "MSH"))}).drop("__first")
    nine = F.split(segment_field("MSH", 8), r"\^")
    part = lambda n: hl7.tidy(F.coalesce(F.get(nine, F.lit(n)), F.lit("")), is_loose)
    return hl7.computed_once(rows, {"code": F.nullif(part(0), F.lit("")), "trigger": part(1)}).drop("__MSH")


def _ignored() -> Column:
    """Of a code and a trigger: whether the message is read no further."""
    moves = F.col("trigger").rlike(r"^A[0-9]{2}$") & ~F.col("trigger").isin(*RELEVANT)
    return F.col("code").isNotNull() & ((F.col("code") != "ADT") | moves)


#: Kinds of segments whose fields go along with sighted rows: what events are read from.
KEPT = ["PV1", "ZST"]

#: Repeated markers up to which they are broadcast.
BROADCAST_MARKERS = 100_000


def classify(msgs: DataFrame, as_of: str, config: SightingConfig = SightingConfig(), text: str = "text") -> DataFrame:
    """``msgs`` with kind, reason, code, trigger, marker, event_ts, time_provenance, time_source.

    kind: usable, ignored, hold_malformed or hold_timequality; repeats are found by ``sight``.
    """
    rows = _typed(msgs, text)
    asked = list(dict.fromkeys([EVENT, RECORDED, *(tuple(f) for t in config.time_fields for f in config.for_trigger(t))]))
    kinds = dict.fromkeys([kind for kind, _ in asked] + KEPT + [kind for kind, _ in config.visit_fields])
    rows = hl7.computed_once(rows, {f"__{kind}": hl7.fields_of(F.col("__whole"), F.col("__loose"), kind) for kind in kinds}).drop("__whole")
    rows = hl7.computed_once(rows, {f"__at_{i}": segment_field(*f) for i, f in enumerate(asked)}).drop(*[f"__{kind}" for kind in kinds if kind not in KEPT and kind not in dict(config.visit_fields)])
    rows = hl7.computed_once(rows, {"__time": movement_time({f: F.col(f"__at_{i}") for i, f in enumerate(asked)}, F.col("trigger"), config)}).drop(*[f"__at_{i}" for i in range(len(asked))])
    rows = hl7.with_timestamps(rows, {"__ts": F.col("__time.raw")})
    now = F.lit(as_of).cast("timestamp")
    absurd = (F.year("__ts") < config.min_year) | (F.col("__ts") > now + F.make_interval(days=F.lit(config.max_future_days)))
    verdict = lambda kind, reason: F.struct(F.lit(kind).alias("kind"), F.lit(reason).alias("reason"))
    told = (
        F.when(F.col("code").isNull(), verdict("hold_malformed", "no message type"))
        .when(F.col("code") != "ADT", verdict("ignored", "not a movement"))
        .when(~F.col("trigger").rlike(r"^A[0-9]{2}$"), verdict("hold_malformed", "movement without a readable trigger"))
        .when(~F.col("trigger").isin(*RELEVANT), verdict("ignored", "trigger doesn't move a patient"))
        .when(F.col("__time").isNull(), verdict("hold_timequality", "no time"))
        .when(F.col("__ts").isNull(), verdict("hold_timequality", "unreadable time"))
        .when(absurd, verdict("hold_timequality", "absurd time"))
        .otherwise(verdict("usable", ""))
    )
    rows = hl7.computed_once(rows, {"__told": told})
    usable = F.col("__told.kind") == "usable"
    return hl7.computed_once(rows, {"kind": F.col("__told.kind"), "reason": F.col("__told.reason"), "event_ts": F.col("__ts"), "time_provenance": F.when(usable, F.col("__time.provenance")), "time_source": F.when(usable, F.col("__time.source")), "trigger": F.when(F.col("code").isNotNull() & (F.col("trigger") != ""), F.col("trigger"))}).drop("__time", "__ts", "__told")


def sight(msgs: DataFrame, as_of: str, config: SightingConfig = SightingConfig()) -> DataFrame:
    """``classify`` plus repeats: of rows with one complete marker, all but the least receipt are suppressed_duplicate.

    Ignored rows take no part.  The first receipts are counted by marker and joined back, so a sender whose marker never
    changes makes one row in the grouping, not one hot group.  A first pass reads types and markers alone; where few markers
    repeat, the messages themselves are not shuffled.
    """
    full = F.col("marker.msh3").isNotNull() & F.col("marker.msh4").isNotNull() & F.col("marker.msh10").isNotNull()
    rows = classify(msgs, as_of, config).withColumn("__full", full & (F.col("kind") != "ignored"))
    first = _typed(msgs, "text").where(full & ~_ignored()).groupBy(F.col("marker.msh3").alias("__a"), F.col("marker.msh4").alias("__b"), F.col("marker.msh10").alias("__c")).agg(F.min("receipt_id").alias("__first"), F.count("*").alias("__n")).where("__n > 1").drop("__n")
    hit = F.col("__full") & (F.col("marker.msh3") == F.col("__a")) & (F.col("marker.msh4") == F.col("__b")) & (F.col("marker.msh10") == F.col("__c"))
    first = kept(first)
    out = rows.join(F.broadcast(first) if first.count() <= BROADCAST_MARKERS else large(first), hit, "left")
    repeat = F.col("__first").isNotNull() & (F.col("receipt_id") > F.col("__first"))
    return out.withColumns({"kind": F.when(repeat, "suppressed_duplicate").otherwise(F.col("kind")), "reason": F.when(repeat, "repeats an earlier message").otherwise(F.col("reason"))}).drop("__full", "__a", "__b", "__c", "__first")


def read(msgs: DataFrame, as_of: str, config: SightingConfig = SightingConfig()) -> DataFrame:
    """``details`` of ``msgs`` before repeats are known, with msh3 and msh4 of their markers; without ignored rows, which take no part."""
    return details(classify(msgs, as_of, config).where("kind <> 'ignored'"), config, (F.col("marker.msh3").alias("msh3"), F.col("marker.msh4").alias("msh4")))


def without_repeats(rows: DataFrame) -> DataFrame:
    """Rows of ``read``, with repeats marked as ``sight`` marks them; they are read several times, so keep them before.

    Hashes that come twice are looked for first, and markers among the rows with these: where none repeats, no marker is shuffled.
    """
    marker = ["msh3", "msh4", "msh10"]
    full = F.col("msh3").isNotNull() & F.col("msh4").isNotNull() & F.col("msh10").isNotNull()
    told = rows.where(full).select(F.xxhash64(*marker).alias("__hash"), "receipt_id", *marker)
    twice = kept(told.groupBy("__hash").agg(F.count("*").alias("__n")).where("__n > 1").select("__hash"))
    n = twice.count()
    if n:
        few = lambda df, count: F.broadcast(df) if count <= BROADCAST_MARKERS else large(df)
        names = {"msh3": "__a", "msh4": "__b", "msh10": "__c"}
        found = told.join(few(twice, n), "__hash", "left_semi").groupBy(*[F.col(k).alias(v) for k, v in names.items()]).agg(F.min("receipt_id").alias("__first"), F.count("*").alias("__n"))
        first = kept(found.where("__n > 1").drop("__n"))
        hit = (F.col("msh3") == F.col("__a")) & (F.col("msh4") == F.col("__b")) & (F.col("msh10") == F.col("__c"))
        repeat = F.col("__first").isNotNull() & (F.col("receipt_id") > F.col("__first"))
        rows = rows.join(few(first, first.count()), hit, "left").withColumns({"kind": F.when(repeat, "suppressed_duplicate").otherwise(F.col("kind")), "reason": F.when(repeat, "repeats an earlier message").otherwise(F.col("reason"))}).drop("__first", *names.values())
    return rows.drop("msh3", "msh4")


def seen(msgs: DataFrame, as_of: str, config: SightingConfig = SightingConfig()) -> DataFrame:
    """``details`` of ``sight``, without ignored rows; messages are read once, and what is read of them is kept."""
    return without_repeats(kept(read(msgs, as_of, config)))


def undecided(sighted: DataFrame, decided: DataFrame) -> DataFrame:
    """Rows of ``sight`` whose receipt has no disposition yet: a run that is repeated adds nothing.

    Sight the whole intake, or repeats of what was decided before wouldn't be known.
    """
    return sighted.join(decided.select("receipt_id").distinct(), "receipt_id", "left_anti")


def with_raw(dispositions: DataFrame, intake: DataFrame, text: str = "text") -> DataFrame:
    """Usable dispositions with their raw message and ``missing_raw``: what the intake table lost is told, not dropped."""
    raw = intake.select("receipt_id", F.col(text).alias("raw"))
    return dispositions.where("kind = 'usable'").join(raw, "receipt_id", "left").withColumn("missing_raw", F.col("raw").isNull())


def holds(sighted: DataFrame, config: SightingConfig = SightingConfig()) -> DataFrame:
    """Rows to be held, with their patient keys and class."""
    rows = hl7.with_patient_keys(sighted.where(F.col("kind").startswith("hold_")), "patient_keys", "text", config.wanted_id, config.authority)
    return rows.select("receipt_id", "kind", "trigger", "text", "patient_keys", hl7.patient_class(F.col("text"), F.col("patient_keys")).alias("pkey_status"))


def quality_findings(sighted: DataFrame) -> DataFrame:
    """A data-quality finding for each held message; no patient identifier."""
    return sighted.where(F.col("kind").startswith("hold_")).select("receipt_id", "kind", "trigger", "marker", "reason", F.lit("pending").alias("delivery_status"))


def details(sighted: DataFrame, config: SightingConfig = SightingConfig(), more: tuple[Column, ...] = ()) -> DataFrame:
    """What is read of messages beyond ``sight``, without their text: kind, reason, pkey_status, and the columns of ``events``.

    A table of these rows is what runs over the same messages read again, in place of the messages; ``events`` and
    ``estimates.candidates`` take it as they take sighted rows.  ``more``: columns of sighted rows that go along.
    """
    visit = F.coalesce(*[F.nullif(segment_field(*f), F.lit("")) for f in config.visit_fields])
    action, kind = segment_field("ZST", 1), segment_field("ZST", 3)
    refers = F.get("__ZST", F.lit(0)) == "ZST"
    rows = hl7.with_timestamps(sighted, {"__target": F.when(refers, segment_field("ZST", 4))})
    zst = F.when(refers, F.struct(F.when(action.rlike("^[A-Z]*$"), action).otherwise(F.upper(action)).alias("action"), segment_field("ZST", 2).alias("target_msh10"), kind.alias("target_type"), F.element_at(F.split(kind, r"\^"), -1).alias("target_trigger"), F.col("__target").alias("target_ts")))
    rows = hl7.computed_once(rows, {"pv1_3_raw": segment_field("PV1", 3), "patient_class": segment_field("PV1", 2), "visit_id": visit, "zst": zst})
    part = lambda n: hl7.tidy(hl7.component(F.col("pv1_3_raw"), n), F.col("__loose"))
    rows = rows.select(
        *more, "kind", "reason", "receipt_id", F.col("marker.msh10").alias("msh10"), "trigger", "visit_id", "patient_class", "pv1_3_raw", part(1).alias("ward"), part(2).alias("room"), part(3).alias("bed"),
        "event_ts", F.col("time_provenance").alias("provenance"), F.col("received_ts").alias("arrival_ts"), "zst", "text",
    )
    named = [c for c in rows.columns if c not in ("kind", "reason", "receipt_id", "text")]
    rows = hl7.with_patient_keys(rows, "patient_keys", "text", config.wanted_id, config.authority, status="pkey_status")
    at = len(more)
    return rows.select(*named[:at], "kind", "reason", "pkey_status", "receipt_id", F.get("patient_keys", F.lit(0)).alias("patient_key"), "patient_keys", *named[at:])


def events(sighted: DataFrame, config: SightingConfig = SightingConfig()) -> DataFrame:
    """Event rows of usable messages: location, visit, patient key (the first of the sorted set), time and reference."""
    usable = sighted.where("kind = 'usable'")
    return (details(usable, config) if "__PV1" in usable.columns else usable).drop("kind", "reason", "pkey_status")
