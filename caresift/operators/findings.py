"""Loss findings, and what reports make of them.

A message stays one row: its findings are an array of structs until metrics are counted.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TN, TC, AD, RS = "Type Narrowing", "Temporal Collapse", "Attribute Dropping", "Reference Severing"
#: Bits lost by a finding of each pattern.
BITS = {TN: math.log2(95_000), TC: math.log2(60), AD: 4.0, RS: 24.0}
FINDING = "struct<rule_id:string,pattern:string,severity:string,location:string,description:string>"


def finding(rule: str, pattern: str, severity: str | Column, location: Column, description: Column) -> Column:
    severity = F.lit(severity) if isinstance(severity, str) else severity
    return F.struct(F.lit(rule).alias("rule_id"), F.lit(pattern).alias("pattern"), severity.alias("severity"), location.alias("location"), description.alias("description"))


def gather(*rules: tuple[Column, Column]) -> Column:
    """The findings whose conditions hold, in order."""
    return F.array_compact(F.array(*[F.when(condition, made) for condition, made in rules]))


def nothing() -> Column:
    return F.array().cast(f"array<{FINDING}>")


def bits(found: Column) -> Column:
    """Loss budget: the sum of the findings' bits, rounded once."""
    counted = [F.size(F.filter(found, _is(p))) * F.lit(b) for p, b in BITS.items()]
    return F.round(sum(counted[1:], counted[0]), 2)


def _is(pattern: str):
    return lambda x: x["pattern"] == pattern


def count(found: Column, severity: str, of: str = "severity") -> Column:
    return F.size(F.filter(found, lambda x: x[of] == severity))


def reports(df: DataFrame, found: str = "findings", of: str = "severity") -> DataFrame:
    """Adds total_losses, n_critical, n_warning, n_info, has_critical, has_warning and loss_bits."""
    f = F.col(found)
    return df.withColumns(
        {
            "total_losses": F.size(f),
            "n_critical": count(f, "critical", of),
            "n_warning": count(f, "warning", of),
            "n_info": count(f, "info", of),
            "has_critical": F.exists(f, lambda x: x[of] == "critical"),
            "has_warning": F.exists(f, lambda x: x[of] == "warning"),
            "loss_bits": bits(f),
        }
    )


def explode(df: DataFrame, keys: list[str], found: str = "findings") -> DataFrame:
    """A row per finding, numbered from 0 in the order of the message."""
    return df.select(*keys, F.posexplode(found).alias("finding_idx", "__f")).select(*keys, "finding_idx", "__f.*")


def decision(has_critical: Column, mode: str) -> Column:
    """forwarded, blocked or skipped: ``mode`` is monitor (all go on), block (critical ones don't) or inspect (none do)."""
    if mode not in ("monitor", "block", "inspect"):
        raise ValueError(mode)
    if mode == "inspect":
        return F.lit("skipped")
    return F.when(has_critical, F.lit("blocked")).otherwise(F.lit("forwarded")) if mode == "block" else F.lit("forwarded")


def ack_code(raw: Column, has_critical: Column) -> Column:
    """AA for what can't be inspected (null), AE with a critical loss, else AA."""
    return F.when(raw.isNull(), F.lit("AA")).when(has_critical, F.lit("AE")).otherwise(F.lit("AA"))


def audited(decided: Column, has_critical: Column, has_warning: Column) -> Column:
    """Whether the live filter writes an audit record."""
    return has_critical | has_warning | (decided != "forwarded")


def durably_audited(events: Column, uninspectable: Column, decided: Column) -> Column:
    """Whether the durable path writes an audit record: with audit events, for what can't be inspected, or when forwarding failed."""
    return (F.size(events) > 0) | uninspectable | (decided == "forward-failed")


#: FHIR outcome codes by severity.
OUTCOME = {"info": "0", "warning": "4", "critical": "8"}


def audit_events(df: DataFrame, message_id: str, found: str = "findings", of: str = "severity", recorded: str = "received_ts") -> DataFrame:
    """One AuditEvent for each finding of effective severity warning or critical: audit_id, severity, outcome, resource.

    Ids are ``<message>-<n>``, n counted from 0 over the emitted events.  ``resource`` is FHIR JSON without payload.
    """
    told = F.filter(F.col(found), lambda x: x[of].isin("warning", "critical"))
    rows = df.select(F.col(message_id).alias("message_id"), F.col(recorded).alias("recorded"), F.posexplode(told).alias("n", "f"))
    severity = F.col(f"f.{of}")
    outcome = F.element_at(F.create_map(*[F.lit(x) for pair in OUTCOME.items() for x in pair]), severity)
    audit_id = F.concat_ws("-", F.col("message_id").cast("string"), F.col("n").cast("string"))
    coding = lambda system, code: F.struct(F.lit(system).alias("system"), code.alias("code"))
    resource = F.struct(
        F.lit("AuditEvent").alias("resourceType"),
        audit_id.alias("id"),
        coding("http://terminology.hl7.org/CodeSystem/audit-event-type", F.lit("rest")).alias("type"),
        F.lit("E").alias("action"),
        F.date_format("recorded", "yyyy-MM-dd'T'HH:mm:ss'+00:00'").alias("recorded"),
        outcome.alias("outcome"),
        F.col("f.description").alias("outcomeDesc"),
        F.array(F.struct(F.struct(F.col("f.location").alias("display")).alias("what"), F.array(F.struct(F.lit("pattern").alias("type"), F.col("f.pattern").alias("valueString"))).alias("detail"))).alias("entity"),
    )
    return rows.select("message_id", audit_id.alias("audit_id"), F.col("f.pattern").alias("pattern"), severity.alias("severity"), outcome.alias("outcome"), F.col("f.location").alias("location"), F.to_json(resource).alias("resource"))


def audit_records(df: DataFrame, decision: str = "decision", of: str = "severity", raw: str = "text") -> DataFrame:
    """receipt_id and ``record``, a JSON object, of the messages that the durable path audits; one record a receipt, no payload.

    ``df``: inspected messages with ``decision`` and ack_code.  Findings stay in their message, so nothing is shuffled.
    """
    lost = F.col(raw).isNull()
    told = F.filter("findings", lambda x: x[of].isin("warning", "critical"))
    outcome = F.create_map(*[F.lit(x) for pair in OUTCOME.items() for x in pair])
    event = lambda x, i: F.struct(F.concat_ws("-", F.col("receipt_id").cast("string"), i.cast("string")).alias("id"), x["pattern"].alias("pattern"), x[of].alias("severity"), F.element_at(outcome, x[of]).alias("outcome"), x["location"].alias("location"))
    events = F.when(lost, F.array()).otherwise(F.transform(told, event))
    rows = df.withColumn("__events", events).where(durably_audited(F.col("__events"), lost, F.col(decision)))
    unless = lambda c, other: F.when(lost, F.lit(other)).otherwise(F.col(c))
    record = F.struct(
        "receipt_id", F.when(F.coalesce("tenant_id", F.lit("")) == "", "default").otherwise(F.col("tenant_id")).alias("tenant_id"), unless("message_type", "UNPARSEABLE").alias("message_type"), unless("control_id", "").alias("control_id"), lost.alias("uninspectable"),
        unless("total_losses", None).alias("total_losses"), F.col(decision).alias("forward_decision"), "ack_code", F.col("__events").alias("audit_events"),
    )
    return rows.select("receipt_id", F.to_json(record, {"ignoreNullFields": "false"}).alias("record"))
