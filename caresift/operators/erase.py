"""Erasure of patients from tables."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caresift.sources.files import kept, large

#: Keys up to which they are broadcast.
BROADCAST_KEYS = 50_000


def _hinted(rows: DataFrame) -> DataFrame:
    """With a broadcast hint if there are few rows; a walk joins dozens of such tables, all of which pass the driver."""
    return F.broadcast(rows) if rows.limit(BROADCAST_KEYS + 1).count() <= BROADCAST_KEYS else large(rows)


def _keys(keys: DataFrame) -> DataFrame:
    return _hinted(keys.select("patient_key").distinct())


def matched(df: DataFrame, keys: DataFrame, ids: list[str], column: str = "patient_keys") -> DataFrame:
    """(ids, patient_key) of rows that hold one of ``keys``: exact matches in an array column."""
    return df.select(*ids, F.explode(column).alias("patient_key")).join(_keys(keys), "patient_key", "left_semi")


def without(df: DataFrame, keys: DataFrame, ids: list[str], column: str = "patient_keys") -> DataFrame:
    """``df`` without the rows that hold one of ``keys``."""
    return df.join(matched(df, keys, ids, column).select(*ids).distinct(), ids, "left_anti")


def result(df: DataFrame, keys: DataFrame, dry_run: bool = True, ids: tuple[str, ...] = ("receipt_id",)) -> DataFrame:
    """patient_key, deleted, unresolvable, status, dry_run: free of content.

    A row whose identifier can't be read could be anyone's, so any of them makes each result incomplete_uncertain;
    rows without a patient don't count.
    """
    counts = matched(df, keys, list(ids)).groupBy("patient_key").agg(F.count("*").alias("deleted"))
    open_rows = df.agg(F.count_if(F.col("pkey_status") == "unresolved").alias("unresolvable"))
    rows = keys.select("patient_key").distinct().join(large(counts), "patient_key", "left").crossJoin(F.broadcast(open_rows))  # one row
    status = F.when(F.col("unresolvable") > 0, "incomplete_uncertain").otherwise("complete")
    return rows.select("patient_key", F.coalesce("deleted", F.lit(0)).alias("deleted"), "unresolvable", status.alias("status"), F.lit(dry_run).alias("dry_run"))


@dataclass(frozen=True)
class Link:
    """How a table hangs on patients."""

    by: tuple[str, ...]  #: a row goes if one of these columns names something that goes
    ids: tuple[str, ...]  #: what tells its rows apart
    gives: tuple[str, ...] = ()  #: columns of the rows that go, on which later tables hang
    counted: bool = True


#: The tables that hold patients or traces of them (places with times count as such), in the order in which they are walked.
#: Tables that aren't listed hold receipts, markers and counts alone, and are kept: dispositions, delays, findings.
GRAPH = {
    "keys": Link(("patient_key",), ("receipt_id", "patient_key"), ("receipt_id",), counted=False),
    "stays": Link(("patient_key",), ("stay_id",), ("stay_id",)),
    "events": Link(("receipt_id",), ("receipt_id",)),
    "references": Link(("receipt_id",), ("receipt_id",)),
    "segments": Link(("stay_id",), ("segment_id",)),
    "audits": Link(("stay_id", "receipt_id"), ("receipt_id",), ("audit_id",)),
    "notifications": Link(("audit_id", "receipt_id"), ("notification_id",)),
    "payloads": Link(("stay_id",), ("notification_id",)),
    "tombstones": Link(("patient_key",), ("receipt_id",)),
    "markers": Link(("stay_id",), ("stay_id", "scope", "ref_id", "kind")),
    "estimates": Link(("receipt_id", "stay_id", "patient_key"), ("receipt_id",)),
    "revisions": Link(("stay_id",), ("stay_id",), counted=False),
}


def cascade(tables: dict[str, DataFrame], keys: DataFrame, graph: dict[str, Link] = GRAPH) -> tuple[dict[str, DataFrame], DataFrame]:
    """All tables without what hangs on the patients of ``keys``, and (patient_key, table, deleted) counts.

    The graph is walked once: what goes from a table names, by its ``gives`` columns, what goes from later ones.  A row that
    hangs on two of the patients counts for each; a row that is met by two ways counts once.  Null columns hang on nothing.
    Tables that the graph doesn't list are kept as they are; a listed one that isn't given is passed over.
    """
    names = keys.select("patient_key").where("patient_key is not null").distinct()
    handles = {"patient_key": names.select(F.col("patient_key").alias("__value"), F.col("patient_key").alias("__patient"))}
    left, counts = dict(tables), []
    for name, link in graph.items():
        if name not in tables:
            continue
        df, found = tables[name], None
        for column in link.by:
            if column in df.columns and column in handles:
                rows = df.join(_hinted(handles[column]), F.col(column) == F.col("__value")).select(*dict.fromkeys((*link.ids, *(c for c in link.gives if c in df.columns))), "__patient")
                found = rows if found is None else found.unionByName(rows)
        if found is None:
            raise ValueError(f"nothing gives what {name} hangs on")
        found = kept(found.distinct())
        for column in link.gives:
            if column in df.columns:
                more = found.select(F.col(column).alias("__value"), "__patient").distinct()
                handles[column] = kept(handles[column].unionByName(more).distinct()) if column in handles else more
        left[name] = df.join(_hinted(found.select(*link.ids).distinct()), list(link.ids), "left_anti").select(df.columns)
        if link.counted:
            counts.append(found.groupBy(F.col("__patient").alias("patient_key")).agg(F.lit(name).alias("table"), F.count_distinct(*link.ids).alias("deleted")))
    total = counts[0]
    for c in counts[1:]:
        total = total.unionByName(c)
    return left, total


def cascade_result(keys: DataFrame, counts: DataFrame, events: DataFrame, dry_run: bool = True) -> DataFrame:
    """As ``result``, over all tables: ``deleted`` sums the counts of ``cascade``; ``events`` have pkey_status."""
    sums = counts.groupBy("patient_key").agg(F.sum("deleted").alias("deleted"))
    open_rows = events.agg(F.count_if(F.col("pkey_status") == "unresolved").alias("unresolvable"))
    rows = keys.select("patient_key").distinct().join(large(sums), "patient_key", "left").crossJoin(F.broadcast(open_rows))  # one row
    status = F.when(F.col("unresolvable") > 0, "incomplete_uncertain").otherwise("complete")
    return rows.select("patient_key", F.coalesce("deleted", F.lit(0)).alias("deleted"), "unresolvable", status.alias("status"), F.lit(dry_run).alias("dry_run"))


def erase_stays(tables: dict[str, DataFrame], keys: DataFrame) -> tuple[dict[str, DataFrame], DataFrame]:
    """All stay tables without the patients of ``keys``, and (table, deleted) counts.

    ``events`` hold patient_keys, and ``keys``, if given, those of held messages too; changes hang on stays.
    """
    graph = GRAPH | {"changes": Link(("stay_id", "receipt_id"), ("notification_id",))}
    own = tables["events"].select("receipt_id", F.explode("patient_keys").alias("patient_key"))
    given = {"keys": own.unionByName(tables["keys"].select(own.columns)).distinct() if "keys" in tables else own}
    left, counts = cascade(given | {n: df for n, df in tables.items() if n != "keys"}, keys, graph)
    held = [n for n, link in graph.items() if n in tables and link.counted]
    none = counts.sparkSession.createDataFrame([(n, 0) for n in held], "table string, deleted long")
    gone = none.unionByName(counts.select("table", "deleted")).groupBy("table").agg(F.sum("deleted").alias("deleted"))
    return {n: left[n] for n in tables}, gone
