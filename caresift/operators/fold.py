"""Stays as a fold over one patient's events: the one place where order and state decide row by row.

``PatientFold`` holds a patient's stays, applied events and waiting negations.  ``reconstruct`` runs it over partitions sorted
by patient and time; the streaming job runs the same class on stored state.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Iterator, MutableMapping
from dataclasses import asdict, dataclass, field
from datetime import UTC, datetime
from itertools import repeat

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caresift.operators.stays import Windows
from caresift.sources.files import large, tasks

#: What each cancelling or updating trigger may refer to.
TARGETS = {"A11": ("A01",), "A12": ("A02",), "A13": ("A03",), "A08": ("A01", "A02", "A03")}


@dataclass
class Event:
    receipt_id: int
    trigger: str
    at: int  #: seconds of the movement
    arrival: int
    msh10: str | None = None
    visit: str | None = None
    place: tuple[str, str, str, str] = ("", "", "", "")  #: raw, ward, room, bed
    provenance: str | None = None
    zst: tuple[str | None, str | None, str | None, int | None] | None = None  #: action, msh10, trigger, seconds


@dataclass
class Segment:
    seq: int
    place: tuple[str, str, str, str]
    start: int
    start_by: int
    start_from: str | None
    end: int | None = None
    end_by: int | None = None
    end_from: str | None = None
    trigger: str | None = None  #: of the message that opened it


@dataclass
class Stay:
    stay_id: int
    pattern: str
    opened: int
    arrived: int
    visit: str | None
    status: str = "open"
    closed: int | None = None
    closed_by: int | None = None
    revision: int = 1  #: of visible states; the opening is the first
    segments: list[Segment] = field(default_factory=list)

    def open_segment(self) -> Segment | None:
        return next((s for s in reversed(self.segments) if s.end is None), None)

    def set_by(self, receipt: int) -> bool:
        """Whether the message still has a part in the stay."""
        return receipt in (self.stay_id, self.closed_by) or any(receipt in (s.start_by, s.end_by) for s in self.segments)

    def snapshot(self) -> dict:
        """The state after a change; no patient and no visit."""
        return {"stay": {"stay_id": self.stay_id, "pattern": self.pattern, "status": self.status, "opened": self.opened, "closed": self.closed}, "segments": [{"seq": s.seq, "ward": s.place[1], "start": s.start, "end": s.end} for s in self.segments]}


class Impossible(Exception):
    """A plan that doesn't fit the present state."""


def reference(msh10: str | None, trigger: str | None, at: int | None) -> str:
    """What a cancel or an update names its target by, as one key."""
    return f"{msh10}|{trigger}|{at}"


@dataclass
class PatientFold:
    """A patient's state.  All lookups go by key, so the mappings may be dictionaries or entries of a state store."""

    windows: Windows = field(default_factory=Windows)
    stays: MutableMapping[int, Stay] = field(default_factory=dict)
    applied: MutableMapping[str, list[int]] = field(default_factory=dict)  #: receipts of applied events by reference
    owners: MutableMapping[int, int] = field(default_factory=dict)  #: receipt to the stay it set a boundary of
    waiting: MutableMapping[int, tuple[Event, str]] = field(default_factory=dict)  #: by receipt, with "waiting" or "expired"
    awaited: MutableMapping[str, list[int]] = field(default_factory=dict)  #: receipts of waiting events by reference
    opened: list[int] = field(default_factory=list)  #: open stays
    deadlines: list[tuple[int, str, int]] = field(default_factory=list)  #: a heap of (second, what falls due, stay or receipt)
    out: list[dict] = field(default_factory=list)  #: event, finding and change rows
    touched: dict[int, None] = field(default_factory=dict)  #: stays that changed since the last rows, in order
    kinds: frozenset[str] | None = None  #: kinds of rows that are told; all, if None

    def tells(self, kind: str) -> bool:
        return self.kinds is None or kind in self.kinds

    def tell(self, kind: str, event: Event, status: str, reason: str = "", **more) -> None:
        if self.kinds is None or kind in self.kinds:
            self.out.append({"kind": kind, "receipt_id": event.receipt_id, "status": status, "reason": reason} | more)

    def settle(self, event: Event, status: str, reason: str = "") -> None:
        self.tell("event", event, status, reason)
        if status != "applied" and status != "waiting":
            self.tell("finding", event, status, reason)

    def save(self, stay: Stay) -> None:
        self.stays[stay.stay_id] = stay
        self.touched[stay.stay_id] = None
        if (stay.status == "open") != (stay.stay_id in self.opened):
            (self.opened.append if stay.status == "open" else self.opened.remove)(stay.stay_id)

    def still_open(self) -> list[Stay]:
        return sorted((self.stays[n] for n in self.opened), key=lambda s: (s.opened, s.stay_id), reverse=True)

    def best(self, event: Event, stays: list[Stay]) -> Stay | None:
        return next((s for s in stays if event.visit and s.visit == event.visit), stays[0] if stays else None)

    def apply(self, event: Event) -> None:
        trigger = event.trigger
        if trigger == "A01":
            self.admit(event)
        elif trigger == "A02":
            self.move(event)
        elif trigger == "A03":
            self.discharge(event)
        elif trigger == "A04":
            self.register(event)
        else:
            self.revise(event)

    def begin(self, event: Event, pattern: str) -> None:
        stay = Stay(event.receipt_id, pattern, event.at, event.arrival, event.visit)
        stay.segments.append(Segment(1, event.place, event.at, event.receipt_id, event.provenance, trigger=event.trigger))
        self.owners[event.receipt_id] = stay.stay_id
        self.save(stay)
        if pattern == "pending":
            heapq.heappush(self.deadlines, (event.arrival + self.windows.join, "join", stay.stay_id))

    def done(self, event: Event, resolve: bool = True) -> None:
        key = reference(event.msh10, event.trigger, event.at)
        self.applied[key] = [*self.applied.get(key, ()), event.receipt_id]
        self.settle(event, "applied")
        if resolve:
            self.resolve(event)

    def advance(self, stay: Stay, event: Event) -> None:
        last = stay.open_segment()
        if last:
            last.end, last.end_by, last.end_from = event.at, event.receipt_id, event.provenance
        stay.segments.append(Segment(max((s.seq for s in stay.segments), default=0) + 1, event.place, event.at, event.receipt_id, event.provenance, trigger=event.trigger))
        stay.visit = stay.visit or event.visit
        stay.revision += 1
        self.owners[event.receipt_id] = stay.stay_id
        self.save(stay)

    def register(self, event: Event) -> None:
        self.begin(event, "pending")
        self.done(event, resolve=False)

    def admit(self, event: Event) -> None:
        joins = lambda s: s.pattern == "pending" and event.arrival - s.arrived <= self.windows.join and not (s.visit and event.visit and s.visit != event.visit)
        stay = next((s for s in self.still_open() if joins(s)), None)
        if stay:
            stay.pattern = "B"
            self.advance(stay, event)
        else:
            self.begin(event, "A")
        self.done(event)

    def move(self, event: Event) -> None:
        stay = self.best(event, self.still_open())
        if stay:
            last = stay.open_segment()
            if last is None or event.at >= last.start:
                self.advance(stay, event)
                return self.done(event)
            return self.insert(stay, event)
        inside = [s for s in self.stays.values() if s.status == "closed" and s.opened <= event.at < s.closed]
        stay = self.best(event, sorted(inside, key=lambda s: (s.opened, s.stay_id), reverse=True))
        if stay:
            return self.insert(stay, event)
        return self.settle(event, "deferred", "transfer without a stay")

    def insert(self, stay: Stay, event: Event) -> None:
        held = next((s for s in stay.segments if s.start <= event.at and (s.end is None or event.at < s.end)), None)
        if held is None:
            return self.settle(event, "deferred", "late transfer outside of the stay")
        if held.start == event.at:
            return self.settle(event, "held_failclosed", "late transfer at an existing boundary")
        before = self.state_of(stay)
        new = Segment(held.seq + 1, event.place, event.at, event.receipt_id, event.provenance, held.end, held.end_by, held.end_from, event.trigger)
        for s in stay.segments:
            s.seq += s.seq > held.seq
        held.end, held.end_by, held.end_from = event.at, event.receipt_id, event.provenance
        stay.segments = sorted([*stay.segments, new], key=lambda s: s.seq)
        self.owners[event.receipt_id] = stay.stay_id
        self.changed(stay, event, "insert_boundary", before)
        return self.done(event)

    def discharge(self, event: Event) -> None:
        stay = self.best(event, self.still_open())
        if stay is None:
            return self.settle(event, "deferred", "discharge without a stay")
        last = stay.open_segment()
        if last:
            last.end, last.end_by, last.end_from = event.at, event.receipt_id, event.provenance
        stay.status, stay.closed, stay.closed_by = "closed", event.at, event.receipt_id
        stay.pattern = "C" if stay.pattern == "pending" else stay.pattern
        stay.revision += 1
        self.owners[event.receipt_id] = stay.stay_id
        self.save(stay)
        return self.done(event)

    def state_of(self, stay: Stay) -> dict | None:
        """The state before a change, if changes are told."""
        return stay.snapshot() if self.tells("change") else None

    def changed(self, stay: Stay, event: Event, name: str, before: dict | None) -> None:
        """A change row: the plan's name and the state before and after it."""
        stay.revision += 1
        self.save(stay)
        if before is None:
            return
        told = lambda state: json.dumps(state, separators=(",", ":"))
        self.tell("change", event, name, stay_id=stay.stay_id, revision=stay.revision, before_json=told(before), after_json=told(stay.snapshot()))

    def revise(self, event: Event) -> None:
        wanted = TARGETS.get(event.trigger, ())
        action, msh10, trigger, at = event.zst or (None, None, None, None)
        if action != ("UPDATES" if event.trigger == "A08" else "CANCELS") or not msh10:
            return self.settle(event, "held_failclosed", "reference is missing or has the wrong action")
        if trigger not in wanted:
            return self.settle(event, "held_failclosed", "reference is to the wrong kind of event")
        if at is None:
            return self.settle(event, "held_failclosed", "reference has no time")
        key = reference(msh10, trigger, at)
        hits = self.applied.get(key, ())
        if len(hits) > 1:
            return self.settle(event, "held_failclosed", "reference is ambiguous")
        if not hits:
            self.waiting[event.receipt_id] = (event, "waiting")
            self.awaited[key] = [*self.awaited.get(key, ()), event.receipt_id]
            heapq.heappush(self.deadlines, (event.arrival + self.windows.tombstone, "target", event.receipt_id))
            return self.settle(event, "waiting")
        try:
            self.mutate(event, hits[0])
        except Impossible as problem:
            return self.settle(event, "held_failclosed", str(problem))
        return self.done(event, resolve=False)

    def owner(self, receipt: int) -> Stay | None:
        stay = self.stays.get(self.owners.get(receipt, -1))
        return stay if stay is not None and stay.set_by(receipt) else None

    def mutate(self, event: Event, by: int) -> None:
        """Does what a cancel or an update says of the event of receipt ``by``, or raises without a change."""
        stay = self.owner(by)
        if stay is None:
            raise Impossible("nothing hangs on the event any more")
        state = self.state_of(stay)
        if event.trigger == "A11":
            if stay.status == "cancelled":
                raise Impossible("the stay is cancelled already")
            stay.status, stay.segments = "cancelled", []
            return self.changed(stay, event, "revoke_stay", state)
        if event.trigger == "A12":
            before, after = next((s for s in stay.segments if s.end_by == by), None), next((s for s in stay.segments if s.start_by == by), None)
            if before is None or after is None:
                raise Impossible("the boundary is gone")
            before.end, before.end_by, before.end_from = after.end, after.end_by, after.end_from
            stay.segments.remove(after)
            return self.changed(stay, event, "remove_boundary", state)
        if event.trigger == "A13":
            last = next((s for s in stay.segments if s.end_by == by), None)
            if last is None or stay.status != "closed":
                raise Impossible("the stay isn't closed by the event")
            last.end = last.end_by = last.end_from = None
            stay.status, stay.closed, stay.closed_by = "open", None, None
            return self.changed(stay, event, "reopen_last", state)
        for s in stay.segments:
            if s.start_by == by:
                s.start, s.start_from = event.at, event.provenance
            if s.end_by == by:
                s.end, s.end_from = event.at, event.provenance
        stay.opened = event.at if stay.stay_id == by else stay.opened
        stay.closed = event.at if stay.closed_by == by else stay.closed
        return self.changed(stay, event, "change_boundary", state)

    def resolve(self, event: Event) -> None:
        """Applies what waits for just this event, expired or not."""
        key = reference(event.msh10, event.trigger, event.at)
        left = []
        for receipt in self.awaited.get(key, ()):
            item = self.waiting[receipt][0]
            try:
                self.mutate(item, event.receipt_id)
            except Impossible as problem:
                self.tell("finding", item, "waiting", str(problem))
                left.append(receipt)
                continue
            del self.waiting[receipt]
            self.done(item, resolve=False)
        if left:
            self.awaited[key] = left
        else:
            self.awaited.pop(key, None)

    def finish(self, now: int) -> None:
        """What falls due by ``now``: pending stays out of their window become C; negations out of theirs expire, and stay matchable."""
        while self.deadlines and self.deadlines[0][0] <= now:
            _, what, n = heapq.heappop(self.deadlines)
            if what == "join":
                stay = self.stays[n]
                if stay.pattern == "pending":
                    stay.pattern = "C"
                    stay.revision += 1
                    self.save(stay)
            elif n in self.waiting and self.waiting[n][1] == "waiting":
                self.waiting[n] = (self.waiting[n][0], "expired")
                self.tell("finding", self.waiting[n][0], "expired", "no target in time")

    def told(self) -> Iterator[dict]:
        """Rows since the last call: what was told of events, and the stays that changed."""
        yield from self.out
        for n in self.touched:
            yield from self.rows_of(self.stays[n])
        self.out, self.touched = [], {}

    def rows(self, states: bool = True) -> Iterator[dict]:
        """All rows: those since the last call of ``told``, and the state; without ``states``, none of stays and segments."""
        yield from self.out
        for e, status in self.waiting.values() if self.tells("tombstone") else ():
            yield {"kind": "tombstone", "receipt_id": e.receipt_id, "status": status}
        for s in self.stays.values() if states else ():
            yield from self.rows_of(s)

    @staticmethod
    def rows_of(s: Stay) -> Iterator[dict]:
        yield {"kind": "stay", "receipt_id": s.stay_id, "stay_id": s.stay_id, "revision": s.revision, "pattern": s.pattern, "status": s.status, "visit_id": s.visit, "start_s": s.opened, "end_s": s.closed}
        for g in s.segments:
            raw, ward, room, bed = g.place
            yield {"kind": "segment", "receipt_id": g.start_by, "stay_id": s.stay_id, "revision": s.revision, "seq": g.seq, "trigger": g.trigger, "pv1_3_raw": raw, "ward": ward, "room": room, "bed": bed, "start_s": g.start, "start_provenance": g.start_from, "end_s": g.end, "end_provenance": g.end_from, "end_receipt": g.end_by}


FIELDS = {
    "kind": "string", "receipt_id": "long", "stay_id": "long", "revision": "long", "seq": "long", "pattern": "string", "status": "string", "reason": "string", "trigger": "string", "visit_id": "string", "pv1_3_raw": "string", "ward": "string", "room": "string", "bed": "string",
    "start_s": "long", "start_provenance": "string", "end_s": "long", "end_provenance": "string", "end_receipt": "long", "before_json": "string", "after_json": "string",
}


_ARROW = {"string": pa.string(), "long": pa.int64()}
_TOLD = ["receipt_id", "status", "reason"]
#: The fields that rows of each kind have; the others are null.
OWN = {
    "event": _TOLD, "finding": _TOLD, "tombstone": _TOLD, "change": [*_TOLD, "stay_id", "revision", "before_json", "after_json"],
    "stay": ["receipt_id", "stay_id", "revision", "pattern", "status", "visit_id", "start_s", "end_s"],
    "segment": ["receipt_id", "stay_id", "revision", "seq", "trigger", "pv1_3_raw", "ward", "room", "bed", "start_s", "start_provenance", "end_s", "end_provenance", "end_receipt"],
}


def _values(column: pa.Array) -> list:
    """A column's values as Python's own, as ``to_pylist`` gives them."""
    return column.to_pandas(integer_object_nulls=True, deduplicate_objects=False).tolist()


def _seconds(t) -> int | None:
    return None if t is None or pd.isna(t) else int(pd.Timestamp(t).timestamp())


def event_of(r) -> Event:
    zst = r.zst if isinstance(r.zst, dict) else r.zst.asDict() if hasattr(r.zst, "asDict") else None
    ref = (zst["action"], zst["target_msh10"], zst["target_trigger"], _seconds(zst["target_ts"])) if zst else None
    return Event(int(r.receipt_id), r.trigger, _seconds(r.event_ts), _seconds(r.arrival_ts), r.msh10, r.visit_id or None, (r.pv1_3_raw, r.ward, r.room, r.bed), r.provenance, ref)


def reconstruct(events: DataFrame, as_of: str, windows: Windows = Windows(), poll_seconds: int | None = None, kinds: tuple[str, ...] | None = None) -> DataFrame:
    """Tagged rows (``kind``: event, finding, change, tombstone, stay, segment) of all patients, in FIELDS and patient_key.

    Events without a patient key or time make a finding ``unassigned``.  An event counts once its arrival is ``jitter``
    old; with ``poll_seconds`` events are applied in polls of that length, else in one poll at ``as_of``, in movement order.
    What fell due by the polls before a poll is settled before its events.  Partitions are sorted by patient and order, and
    read row by row: a task holds one patient's stays at a time, never all events.
    Events are read once; those without a patient are dealt by their receipt.  ``kinds``: only rows of these come out.
    """
    now = F.unix_timestamp(F.lit(as_of).cast("timestamp"))
    ripe = F.unix_timestamp("arrival_ts") + windows.jitter
    batch = F.ceil(ripe / poll_seconds).cast("long") if poll_seconds else F.lit(0).cast("long")
    lost = F.col("patient_key").isNull() | F.col("event_ts").isNull()
    zst = [F.col("zst").isNotNull().alias("refers"), "zst.action", "zst.target_msh10", "zst.target_trigger", F.unix_timestamp("zst.target_ts").alias("target_s")]
    placed = kinds is None or bool({"segment", "change"} & set(kinds))  # places are in no other rows
    place = ["pv1_3_raw", "ward", "room", "bed", "provenance"] if placed else []
    told = events.where(lost | (ripe <= now)).select("patient_key", batch.alias("batch"), F.unix_timestamp("event_ts").alias("at"), "receipt_id", "trigger", F.unix_timestamp("arrival_ts").alias("arrival"), "msh10", "visit_id", *zst, *place)
    end = int(datetime.fromisoformat(as_of).replace(tzinfo=UTC).timestamp())
    names = list(FIELDS)
    wanted = None if kinds is None else frozenset(kinds)
    states = kinds is None or bool({"stay", "segment"} & set(kinds))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, patient, poll = None, None, None
        out: dict[str, list[tuple]] = {kind: [] for kind in OWN if kinds is None or kind in kinds}

        def tell(key: str | None, rows: Iterator[dict]) -> None:
            for row in rows:
                if (held := out.get(row["kind"])) is not None:
                    held.append((key, *map(row.get, OWN[row["kind"]])))

        def flush(least: int) -> Iterator[pa.RecordBatch]:
            """A batch of each kind with more than so many rows; what a kind never has is null."""
            for kind, rows in out.items():
                if len(rows) > least:
                    told = dict(zip(("patient_key", *OWN[kind]), zip(*rows, strict=True), strict=True)) | {"kind": (kind,) * len(rows)}
                    columns = [pa.array(told[n], _ARROW[k]) if n in told else pa.nulls(len(rows), _ARROW[k]) for n, k in (("patient_key", "string"), *FIELDS.items())]
                    rows.clear()
                    yield pa.RecordBatch.from_arrays(columns, ["patient_key", *names])

        def done() -> None:
            if patient is not None:
                patient.finish(end)
                tell(key, patient.rows(states))

        for part in batches:
            values = [_values(c) for c in part.columns]
            places = zip(*values[13:17], strict=True) if placed else repeat(("", "", "", ""))
            refs, provenances = zip(*values[9:13], strict=True), values[17] if placed else repeat(None)
            for who, number, at, receipt, trigger, arrival, msh10, visit, refers, ref, where, provenance in zip(*values[:9], refs, places, provenances):  # noqa: B905
                if who is None or at is None:
                    tell(who, [{"kind": "finding", "receipt_id": receipt} | UNASSIGNED])
                else:
                    if patient is None or who != key:
                        done()
                        key, patient, poll = who, PatientFold(windows, kinds=wanted), None
                    if poll_seconds and poll not in (None, number):
                        patient.finish((number - 1) * poll_seconds)
                    poll = number
                    patient.apply(Event(receipt, trigger, at, arrival, msh10, visit or None, where, provenance, ref if refers else None))
            yield from flush(10_000)
        done()
        yield from flush(0)

    home = F.coalesce("patient_key", F.col("receipt_id").cast("string"))
    ordered = told.repartition(tasks(events.sparkSession), home).sortWithinPartitions("patient_key", "batch", "at", "receipt_id")
    return ordered.mapInArrow(run, "patient_key string, " + ", ".join(f"{n} {k}" for n, k in FIELDS.items()))


#: What is said of an event without a patient key or time.
UNASSIGNED = {"status": "unassigned", "reason": "no patient key or no time"}


def unassigned(events: DataFrame) -> DataFrame:
    """A finding for each event without a patient key or time, as tagged rows."""
    other = {n: F.lit(None).cast(k) for n, k in FIELDS.items()} | {"kind": F.lit("finding")} | {n: F.lit(v) for n, v in UNASSIGNED.items()}
    return events.select("patient_key", "receipt_id", *[c.alias(n) for n, c in other.items() if n != "receipt_id"])


def stays_of(rows: DataFrame) -> DataFrame:
    return rows.where("kind = 'stay'").select("stay_id", F.col("revision").cast("int").alias("revision"), "pattern", "status", "patient_key", "visit_id", F.timestamp_seconds("start_s").alias("opened_event_ts"), F.timestamp_seconds("end_s").alias("closed_event_ts"))


def segments_of(rows: DataFrame) -> DataFrame:
    return rows.where("kind = 'segment'").select(
        "stay_id", "patient_key", F.col("revision").cast("int").alias("revision"), F.concat_ws("-", "stay_id", "receipt_id").alias("segment_id"), F.col("seq").cast("int").alias("seq"), "pv1_3_raw", "ward", "room", "bed", F.timestamp_seconds("start_s").alias("start_ts"), "start_provenance",
        F.col("receipt_id").alias("start_receipt"), "trigger", F.timestamp_seconds("end_s").alias("end_ts"), "end_provenance", "end_receipt", F.col("end_s").isNull().alias("is_open"),
    )


def changes_of(rows: DataFrame) -> DataFrame:
    """The change log: free of patients; a consumer keeps the highest revision of each stay."""
    return rows.where("kind = 'change'").select(F.concat_ws("-", "receipt_id", "status", "revision").alias("notification_id"), "stay_id", "revision", F.col("status").alias("change"), "after_json", "receipt_id")


def audit_of(rows: DataFrame) -> DataFrame:
    """A row per effective retro event: the plan, and the stay before and after it."""
    return rows.where("kind = 'change'").select("receipt_id", "stay_id", "revision", F.col("status").alias("plan"), "before_json", "after_json")


def change_log(rows: DataFrame) -> DataFrame:
    """Notifications joined with their payloads: one appears only when the stay's state of its revision, or of a later one, is there."""
    told = rows.where("kind = 'change'").select(F.concat_ws("-", "receipt_id", "status", "revision").alias("notification_id"), "stay_id", "revision", "receipt_id")
    held = rows.where("kind = 'stay'").select("stay_id", F.col("revision").alias("__held"))
    payload = changes_of(rows).select("notification_id", "change", "after_json")
    return told.join(large(payload), "notification_id").join(large(held), "stay_id").where("__held >= revision").drop("__held")


def latest_changes(changes: DataFrame) -> DataFrame:
    """One row per stay: the state of the highest revision, in whatever order changes came and however often."""
    return changes.groupBy("stay_id").agg(F.max("revision").alias("revision"), F.max_by("after_json", "revision").alias("after_json"))


def event_text(e: Event) -> str:
    return json.dumps(asdict(e))


def event_from(text: str) -> Event:
    e = json.loads(text)
    return Event(**(e | {"place": tuple(e["place"]), "zst": tuple(e["zst"]) if e["zst"] else None}))


def stay_text(s: Stay) -> str:
    return json.dumps(asdict(s))


def stay_from(text: str) -> Stay:
    s = json.loads(text)
    return Stay(**(s | {"segments": [Segment(**(g | {"place": tuple(g["place"])})) for g in s["segments"]]}))
