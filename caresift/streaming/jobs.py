"""Streaming twins of the batch jobs: the same column functions and the same fold on a stream of messages."""

from __future__ import annotations

import json
from collections.abc import Iterator, MutableMapping

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from caresift.operators import findings, fold, sighting, v2
from caresift.operators.stays import Windows
from caresift.sources import files


def inspect(msgs: DataFrame) -> DataFrame:
    """Reports of a stream of messages; stateless, so the checkpoint is the only cursor."""
    return v2.inspect(msgs)


def first_of_marker(rows: DataFrame, watermark: str | None = None, time: str = "received_ts") -> DataFrame:
    """Rows of ``sighting.classify`` without repeats of a complete marker; incomplete ones and ignored rows all pass.

    Without ``watermark`` markers are remembered for ever; with it, as long as it says, which forgets late repeats.
    """
    full = F.col("marker.msh3").isNotNull() & F.col("marker.msh4").isNotNull() & F.col("marker.msh10").isNotNull() & (F.col("kind") != "ignored")
    known = rows.where(full).withColumns({f"__{c}": F.col(f"marker.{c}") for c in ("msh3", "msh4", "msh10")})
    keys = ["__msh3", "__msh4", "__msh10"]
    once = known.withWatermark(time, watermark).dropDuplicatesWithinWatermark(keys) if watermark else known.dropDuplicates(keys)
    return once.drop(*keys).unionByName(rows.where(~F.coalesce(full, F.lit(False))))


def rates(reports: DataFrame, by: list[str], window: str = "1 minute", slide: str = "5 seconds", late: str = "1 minute", time: str = "received_ts") -> DataFrame:
    """Messages a second over sliding windows."""
    span = F.unix_timestamp("window.end") - F.unix_timestamp("window.start")
    return reports.withWatermark(time, late).groupBy(F.window(time, window, slide), *by).agg(F.count("*").alias("n")).withColumn("rate", F.col("n") / span)


_GONE = object()


class Stored(MutableMapping):
    """A map state as a mapping: an entry is read when it is asked for, and written by ``flush`` if it was set.

    Of an ``empty`` state, nothing is asked.
    """

    def __init__(self, state, read=json.loads, write=json.dumps, empty: bool = False) -> None:
        self.state, self.read, self.write, self.empty = state, read, write, empty
        self.known, self.changed = {}, {}

    def __getitem__(self, key):
        if key not in self.known:
            found = None if self.empty else self.state.getValue((key,))
            self.known[key] = _GONE if found is None else self.read(found[0])
        if self.known[key] is _GONE:
            raise KeyError(key)
        return self.known[key]

    def __setitem__(self, key, value) -> None:
        self.known[key], self.changed[key] = value, None

    def __delitem__(self, key) -> None:
        self.known[key], self.changed[key] = _GONE, None

    def __iter__(self):
        self.flush()
        return iter([key for (key,) in self.state.keys()])  # noqa: SIM118

    def __len__(self) -> int:
        return sum(1 for _ in self)

    def flush(self) -> None:
        for key in self.changed:
            if self.known[key] is not _GONE:
                self.state.updateValue((key,), (self.write(self.known[key]),))
                self.empty = False
            elif not self.empty and self.state.containsKey((key,)):
                self.state.removeKey((key,))
        self.changed = {}


class StayProcessor(StatefulProcessor):
    """One patient's fold on stored state.

    An event waits until it is ``jitter`` old by the clock, then is applied in movement order with what is ripe; a late one
    revises.  Timers wake the patient for ripe events, the join window and waiting negations.  The clock is the watermark of
    arrivals (``by_arrival``), so that a replay gives what a live run gave, or the time of processing.

    Stays, references and waiting negations are entries of map states of their own: a step reads and writes those it
    touches, and tells the stays that changed.  Open stays, deadlines and whether the maps have entries are one small value.
    Each call of the state is a way to the JVM and back, so what is known to be empty isn't asked.  Events come as one JSON
    text each, and a step's rows go as one: a step has few rows, and what Pandas and Arrow take for a column is paid by step.
    """

    def __init__(self, windows: Windows = Windows(), poll_seconds: int = 0, by_arrival: bool = False) -> None:
        self.windows, self.poll, self.by_arrival = windows, poll_seconds, by_arrival

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.small = handle.getValueState("small", "text string")
        self.buffer = handle.getListState("buffer", "text string")
        number, name, text = "id long", "name string", "text string"
        self.maps = {"stays": handle.getMapState("stays", number, text), "applied": handle.getMapState("applied", name, text), "owners": handle.getMapState("owners", number, text), "waiting": handle.getMapState("waiting", number, text), "awaited": handle.getMapState("awaited", name, text)}

    def _load(self, told: dict) -> fold.PatientFold:
        empty = not told.get("stored", True)
        plain = {n: Stored(state, empty=empty) for n, state in self.maps.items()}
        plain["stays"] = Stored(self.maps["stays"], fold.stay_from, fold.stay_text, empty)
        plain["waiting"] = Stored(self.maps["waiting"], lambda t: (fold.event_from(json.loads(t)[0]), json.loads(t)[1]), lambda v: json.dumps([fold.event_text(v[0]), v[1]]), empty)
        return fold.PatientFold(self.windows, **plain, opened=told["opened"], deadlines=[tuple(x) for x in told["deadlines"]])

    def _due(self, event: fold.Event) -> int:
        """The second at which an event is applied: of the first poll at which it is ripe."""
        ripe = event.arrival + self.windows.jitter
        return -(-ripe // self.poll) * self.poll if self.poll else ripe

    def _rows(self, now: int, more: list[fold.Event]) -> list[dict]:
        """What a step tells."""
        known = self.small.get()
        told = json.loads(known[0]) if known else {"opened": [], "deadlines": [], "stored": False}
        held = ([fold.event_from(x[0]) for x in self.buffer.get()] if known else []) + more
        ripe = sorted((e for e in held if self._due(e) <= now), key=lambda e: (self._due(e) if self.poll else 0, e.at, e.receipt_id))
        rest = [e for e in held if self._due(e) > now]
        patient, poll = self._load(told), None
        for e in ripe:
            if self.poll and poll != self._due(e):
                patient.finish(self._due(e) - self.poll)
            poll = self._due(e)
            patient.apply(e)
        patient.finish(now // self.poll * self.poll if self.poll else now)
        rows = list(patient.told())
        maps = [getattr(patient, n) for n in self.maps]
        for m in maps:
            m.flush()
        if rest and (more or ripe):
            self.buffer.put([(fold.event_text(e),) for e in rest])
        elif ripe and known:
            self.buffer.clear()
        small = json.dumps({"opened": patient.opened, "deadlines": patient.deadlines, "stored": not all(m.empty for m in maps)})
        if not known or small != known[0]:
            self.small.update((small,))
        wake = [self._due(e) for e in rest] + [-(-x[0] // self.poll) * self.poll if self.poll else x[0] for x in patient.deadlines[:1]]
        if wake:
            self.handle.registerTimer(max(min(wake), now + 1) * 1000)
        return rows

    def _step(self, key, now: int, more: list[fold.Event]) -> pd.DataFrame:
        """The rows of a step as a table."""
        rows = pd.DataFrame(self._rows(now, more), columns=list(fold.FIELDS), dtype=object)
        rows.insert(0, "patient_key", key[0])
        return rows

    def _told(self, key, now: int, more: list[fold.Event]) -> Iterator[pd.DataFrame]:
        """The rows of a step as one text; none, if nothing is told."""
        if rows := self._rows(now, more):
            yield pd.DataFrame(np.array([[key[0], json.dumps(rows)]], object), columns=["patient_key", "told"])

    def _now(self, timerValues) -> int:
        return max(0, (timerValues.getCurrentWatermarkInMs() if self.by_arrival else timerValues.getCurrentProcessingTimeInMs()) // 1000)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        more = [_event(text) for pdf in rows for text in pdf["event"]]
        yield from self._told(key, self._now(timerValues), more)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield from self._told(key, self._now(timerValues), [])

    def close(self) -> None:
        pass


def _event_text() -> Column:
    """An event row as JSON, for ``_event``."""
    zst = F.when(F.col("zst").isNotNull(), F.struct("zst.action", "zst.target_msh10", "zst.target_trigger", F.unix_timestamp("zst.target_ts").alias("target_s")))
    place = F.array("pv1_3_raw", "ward", "room", "bed")
    return F.to_json(F.struct("receipt_id", "trigger", F.unix_timestamp("event_ts").alias("at"), F.unix_timestamp("arrival_ts").alias("arrival"), "msh10", F.nullif("visit_id", F.lit("")).alias("visit"), place.alias("place"), "provenance", zst.alias("zst")), {"ignoreNullFields": "false"})


def _event(text: str) -> fold.Event:
    e = json.loads(text)
    return fold.Event(**(e | {"place": tuple(e["place"]), "zst": tuple(e["zst"].values()) if e["zst"] else None}))


def stays(events: DataFrame, windows: Windows = Windows(), poll_seconds: int = 0, late: str | None = None) -> DataFrame:
    """Tagged rows of the fold: what is told of events, and after each step the stays that changed, whole.  Needs the RocksDB
    state store.  Of a stay, the rows of the highest revision hold.

    With ``late``, the clock is the watermark of arrivals, so much behind the latest: what is processed twice gives the same,
    and ``availableNow`` ends with all that the watermark has passed.  Without, it is the time of processing; for a run that
    ends, switch ``spark.sql.streaming.noDataMicroBatches.enabled`` off then: batches for timers have no end.  With
    ``poll_seconds``, events are applied and deadlines fall due in polls, as in ``fold.reconstruct``.

    Events without a patient or a time are findings, and never reach a state.
    """
    source = events.withWatermark("arrival_ts", late) if late else events
    lost = F.col("patient_key").isNull() | F.col("event_ts").isNull()
    known = source.where(~lost).select("patient_key", "arrival_ts", _event_text().alias("event"))
    told = known.groupBy("patient_key").transformWithStateInPandas(StayProcessor(windows, poll_seconds, bool(late)), outputStructType="patient_key string, told string", outputMode="Append" if late else "Update", timeMode="eventTime" if late else "processingTime")
    fields = ", ".join(f"{n}: {k}" for n, k in fold.FIELDS.items()).replace(": long", ": bigint")
    rows = told.select("patient_key", F.explode(F.from_json("told", f"array<struct<{fields}>>")).alias("r")).select("patient_key", "r.*")
    return rows.unionByName(fold.unassigned(source.where(lost)))


def events(msgs: DataFrame, as_of: str) -> DataFrame:
    """Event rows of a stream of movement messages, without repeats."""
    return sighting.events(first_of_marker(sighting.classify(msgs, as_of)))


#: The tables that ``sight`` keeps, and their columns.
SIGHTED = {
    "dispositions": "receipt_id long, kind string, trigger string, time_provenance string, reason string",
    "markers": "msh3 string, msh4 string, msh10 string, receipt_id long",
    "holds": "receipt_id long, kind string, trigger string, text string, patient_keys array<string>, pkey_status string",
    "findings": "receipt_id long, kind string, trigger string, reason string",
}


def sight(folder: str, as_of: str, config: sighting.SightingConfig = sighting.SightingConfig()):
    """For ``foreachBatch`` on the intake: sights each receipt once, and adds to the tables of SIGHTED and to ``events``.

    One pass gives all of them.  Receipts that an earlier batch decided are passed over; a complete marker that an earlier
    batch or a lesser receipt of this one had makes a repeat; a usable message without patient or time is a finding, not an
    event.  A batch that runs again replaces what it wrote, and looks at the batches before it alone.  Of messages only what is
    read of them is kept within a batch, and no longer than it takes.
    """

    def run(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        part = lambda name: files.read_parts(spark, f"{folder}/{name}", SIGHTED[name], before=number)
        fresh = batch.join(part("dispositions").select("receipt_id"), "receipt_id", "left_anti").dropDuplicates(["receipt_id"])
        rows = sighting.sight(fresh, as_of, config)
        held = F.when(F.col("kind").startswith("hold_"), F.col("text")).alias("held_text")
        rows = rows.withColumn("text", F.when(F.col("kind") != "ignored", F.col("text")))  # of ignored rows nothing more is read
        rows = files.kept(sighting.details(rows, config, (F.col("marker"), held)).withColumnRenamed("provenance", "time_provenance"))
        full = F.col("marker.msh3").isNotNull() & F.col("marker.msh4").isNotNull() & F.col("marker.msh10").isNotNull()
        named = rows.where(full & ~F.col("kind").isin("ignored", "suppressed_duplicate")).select("marker.*", "receipt_id")
        keys = ["msh3", "msh4", "msh10"]
        known = part("markers").join(named.select(*keys), keys, "left_semi").select(keys)
        again = files.kept(named.join(known, keys, "left_semi").select("receipt_id"))
        new = named.join(again, "receipt_id", "left_anti")
        files.append_once(new.select(*keys, "receipt_id"), f"{folder}/markers", number)
        marked = rows.join(again.withColumn("__again", F.lit(True)), "receipt_id", "left").withColumn("__again", F.coalesce("__again", F.lit(False)))
        done = files.kept(marked.withColumns({"kind": F.when(F.col("__again"), "suppressed_duplicate").otherwise(F.col("kind")), "reason": F.when(F.col("__again"), "repeats an earlier message").otherwise(F.col("reason")), "time_provenance": F.when(~F.col("__again"), F.col("time_provenance"))}).drop("__again"))
        files.dropped(rows, again)
        events = sighting.events(done, config).drop("marker", "held_text").withColumnRenamed("time_provenance", "provenance")
        lost = F.col("patient_key").isNull() | F.col("event_ts").isNull()
        unassigned = events.where(lost).select("receipt_id", F.lit("unassigned").alias("kind"), "trigger", F.lit("no patient key or no time").alias("reason"))
        holds = done.where(F.col("kind").startswith("hold_")).select("receipt_id", "kind", "trigger", F.col("held_text").alias("text"), "patient_keys", "pkey_status")
        files.append_once(holds, f"{folder}/holds", number)
        files.append_once(sighting.quality_findings(done).select("receipt_id", "kind", "trigger", "reason").unionByName(unassigned), f"{folder}/findings", number)
        files.append_once(events.where(~lost), f"{folder}/events", number)
        files.append_once(done.select("receipt_id", "kind", "trigger", "time_provenance", "reason"), f"{folder}/dispositions", number)  # last: what is here is done
        files.dropped(done)

    return run


def audit(path: str, decide=None):
    """For ``foreachBatch`` on messages: inspects them and adds their audit records to the log, each batch once.

    ``decide`` gives a column of the inspected messages' forwarding decisions; by default critical losses block.  Receipts
    of which an earlier batch wrote a record are passed over: that one is what ``read_audit`` gives of them.
    """

    def run(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        told = files.read_parts(spark, path, "value string", before=number, form="text").select(F.from_json("value", "receipt_id long")["receipt_id"].alias("receipt_id"))
        if number:  # before the first one there is no record
            n = files.tasks(spark)  # few bytes take much work
            batch = batch.repartition(n, "receipt_id").join(told.repartition(n, "receipt_id").hint("shuffle_hash"), "receipt_id", "left_anti").select(batch.columns)
        rows = v2.inspect(batch)
        rows = rows.withColumns({"ack_code": findings.ack_code(F.col("text"), F.col("has_critical")), "decision": decide(rows) if decide else findings.decision(F.col("has_critical"), "block")})
        files.append_audit(findings.audit_records(rows), path, number)

    return run


def run_available(stream: DataFrame, folder: str, mode: str = "append") -> DataFrame:
    """All that ``stream`` has now, as a table under ``folder``; a second run with the same folder takes up what came since.

    ``append`` adds finished rows; ``complete`` keeps the newest version of an aggregate.
    """
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{folder}/cursor").trigger(availableNow=True)
    if mode == "append":
        writer.format("parquet").option("path", f"{folder}/rows").start().awaitTermination()
        return stream.sparkSession.read.schema(stream.schema).parquet(f"{folder}/rows")
    writer.foreachBatch(lambda batch, number: batch.write.mode("overwrite").parquet(f"{folder}/version={number:012d}")).start().awaitTermination()
    return current(stream.sparkSession, folder)


def merge_changes(state_path: str):
    """For ``foreachBatch`` on a change feed: keeps each stay's highest revision in a table, whatever the order of arrival.

    Each batch writes a new version of the table; ``current`` reads the last complete one, so a batch that runs twice does
    no harm.
    """

    def run(batch: DataFrame, number: int) -> None:
        before = current(batch.sparkSession, state_path)
        rows = batch.select("stay_id", "revision", "after_json")
        rows = rows if before is None else rows.unionByName(before)
        fold.latest_changes(rows).write.mode("overwrite").parquet(f"{state_path}/version={number:012d}")

    return run


def current(spark, state_path: str) -> DataFrame | None:
    """The newest complete version of the table, or None."""
    fs = spark._jvm.org.apache.hadoop.fs.Path(state_path).getFileSystem(spark._jsc.hadoopConfiguration())
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{state_path}/version=*/_SUCCESS")
    found = fs.globStatus(path)
    names = sorted(str(f.getPath().getParent()) for f in found) if found is not None else []
    return spark.read.parquet(names[-1]) if names else None
