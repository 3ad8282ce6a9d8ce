"""Queries over HL7 v2 messages made from orders and lineitem."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from caresift.functions import hl7
from caresift.operators import findings as fnd
from caresift.operators import metrics, severity, v2
from caresift.sources import synth
from caresift.sources.files import kept

#: Override rules of the example queries.
RULES = [
    {"layer": 0, "tenant": None, "ord": 0, "pattern": "Temporal Collapse", "location_prefix": "", "severity": "info"},
    {"layer": 0, "tenant": None, "ord": 1, "pattern": "", "location_prefix": "PV1/", "severity": "critical"},
    {"layer": 1, "tenant": "APP1|FAC1", "ord": 0, "pattern": "Reference Severing", "location_prefix": "ORC/", "severity": "warning"},
    {"layer": 1, "tenant": "APP1|FAC1", "ord": 1, "pattern": "Reference Severing", "location_prefix": "ORC/1", "severity": "info"},
]


def inspected(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = v2.inspect(synth.oru_messages(spark, sf_dir)).withColumn("protocol", F.lit("v2"))
    return out.withColumns({"ack_code": fnd.ack_code(F.col("text"), F.col("has_critical")), "decision": fnd.decision(F.col("has_critical"), "block")})


def found(spark, sf_dir):
    return fnd.explode(inspected(spark, sf_dir), ["receipt_id", "received_ts", "tenant_id", "protocol", "message_type"])


def losses_by_pattern(spark, sf_dir):
    return metrics.losses(found(spark, sf_dir))


def reports(spark, sf_dir):
    return inspected(spark, sf_dir).select("receipt_id", "message_type", "control_id", "tenant_id", "total_segments", "total_losses", "n_critical", "n_warning", "has_critical", "has_warning", "loss_bits", "ack_code", "decision")


def finding_rows(spark, sf_dir):
    return found(spark, sf_dir).select("receipt_id", "pattern", "severity", "location")


def messages(spark, sf_dir):
    return metrics.messages(inspected(spark, sf_dir))


def decisions(spark, sf_dir):
    return metrics.decisions(inspected(spark, sf_dir))


def histogram(spark, sf_dir):
    return metrics.histogram(inspected(spark, sf_dir), "loss_bits", metrics.BUDGET_BOUNDS, ["protocol", "message_type"]).select("protocol", "message_type", "le", "n", "count")


def quantile(spark, sf_dir):
    buckets = metrics.histogram(inspected(spark, sf_dir), "loss_bits", metrics.BUDGET_BOUNDS, ["protocol", "message_type"])
    return metrics.histogram_quantile(buckets, 0.95, ["protocol", "message_type"])


def percentiles(spark, sf_dir):
    return metrics.percentiles(inspected(spark, sf_dir), "loss_bits", ["message_type"])


def rolling(spark, sf_dir):
    rows = inspected(spark, sf_dir).select("tenant_id", "receipt_id", F.col("total_losses").cast("double").alias("value"))
    return metrics.rolling_percentile(rows, "value", ["tenant_id"], ["receipt_id"], 1000).select("tenant_id", "receipt_id", "p95")


def dashboard(spark, sf_dir):
    return metrics.dashboard(inspected(spark, sf_dir))


def trend(spark, sf_dir):
    m = kept(inspected(spark, sf_dir).select("tenant_id", "received_ts", "findings"))
    return metrics.tenant_trend(fnd.explode(m, ["tenant_id", "received_ts"]), m)


def effective(spark, sf_dir):
    rows = severity.apply_to_reports(inspected(spark, sf_dir), RULES)
    return fnd.explode(rows, ["receipt_id", "tenant_id"]).groupBy("tenant_id", "pattern", "severity", "effective").agg(F.count("*").alias("n"))


def effective_join(spark, sf_dir):
    kind = "layer int, tenant string, ord int, pattern string, location_prefix string, severity string"
    rules = spark.createDataFrame([tuple(r.values()) for r in RULES], kind)
    rows = found(spark, sf_dir).withColumn("n", F.lit(1))
    return severity.apply_to_findings(rows, rules, ["receipt_id", "finding_idx"]).groupBy("tenant_id", "pattern", "severity", "effective").agg(F.sum("n").alias("n"))


def effective_reports(spark, sf_dir):
    rows = severity.apply_to_reports(inspected(spark, sf_dir), RULES).drop("total_losses", "n_critical", "n_warning", "n_info", "has_critical", "has_warning", "loss_bits")
    return fnd.reports(rows, of="effective").select("receipt_id", "n_critical", "n_warning", "n_info", "has_critical")


def audit(spark, sf_dir):
    rows = severity.apply_to_reports(inspected(spark, sf_dir), RULES)
    return fnd.audit_events(rows, "receipt_id", of="effective").select("message_id", "audit_id", "severity", "outcome")


def audit_log(spark, sf_dir):
    rows = inspected(spark, sf_dir).where(fnd.audited(F.col("decision"), F.col("has_critical"), F.col("has_warning")))
    record = F.to_json(F.struct("control_id", "message_type", "total_losses", "decision"))
    return rows.select("receipt_id", F.get_json_object(record, "$.decision").alias("decision"), F.get_json_object(record, "$.total_losses").cast("int").alias("total_losses"))


def duplicates(spark, sf_dir):
    """Messages that share a marker with another one; nulls are equal."""
    m = synth.oru_messages(spark, sf_dir)
    again = m.where("receipt_id % 50 = 0").withColumn("receipt_id", -F.col("receipt_id") - 1)
    rows = m.unionByName(again).select("receipt_id", hl7.marker(F.col("text")).alias("m"))
    return rows.groupBy("m.msh3", "m.msh4", "m.msh10").agg(F.count("*").alias("n"), F.min("receipt_id").alias("first_id")).where("n > 1")


def recovered(spark, sf_dir):
    """Messages without a finished inspection are inspected now: a first run's table has those received before 1997."""
    m = synth.oru_messages(spark, sf_dir)
    done = kept(v2.inspect(m.where("received_ts < '1997-01-01'")).select("receipt_id", "total_losses"))
    rows = v2.inspect(m.join(done, "receipt_id", "left_anti"))
    return rows.select("receipt_id", F.lit("recovered").alias("decision"), "total_losses")


def patient_keys(spark, sf_dir):
    m = synth.oru_messages(spark, sf_dir)
    keys = hl7.patient_keys(F.col("text"))
    return m.select("receipt_id", F.array_join(keys, ",").alias("keys"), hl7.patient_class(F.col("text"), keys).alias("pkey_status"))


def garbage(spark, sf_dir):
    """Documents as messages: nothing in them throws."""
    docs = synth.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("receipt_id"), "text")
    return v2.inspect(docs).groupBy("message_type").agg(F.count("*").alias("n"), F.sum("total_losses").alias("n_losses"))


QUERIES = {
    "v2_losses_by_pattern": losses_by_pattern, "v2_reports": reports, "v2_findings": finding_rows, "v2_messages": messages, "v2_decisions": decisions, "v2_budget_histogram": histogram,
    "v2_histogram_quantile": quantile, "v2_percentiles": percentiles, "v2_rolling_percentile": rolling, "v2_dashboard": dashboard, "v2_tenant_trend": trend, "v2_effective_severity": effective,
    "v2_effective_severity_join": effective_join, "v2_effective_reports": effective_reports, "v2_audit_events": audit, "v2_audit_log": audit_log, "v2_duplicates": duplicates, "v2_recovered": recovered,
    "v2_patient_keys": patient_keys, "v2_garbage": garbage,
}

_MSG = """
msg AS (
    SELECT o_orderkey AS k, o_custkey AS c, o_orderdate AS ts, 'APP' || (o_custkey % 5) || '|FAC' || (o_custkey % 2) AS tenant_id,
        CASE WHEN o_orderkey % 9 = 0 THEN 'ORM^O01' ELSE 'ORU^R01' END AS message_type FROM orders
), found AS (
    SELECT k, 'Temporal Collapse' AS pattern, 'warning' AS severity, 'OBR/' || k AS location FROM msg WHERE k % 5 = 0
    UNION ALL SELECT k, 'Type Narrowing', 'warning', 'OBR/' || k FROM msg WHERE c % 6 = 0
    UNION ALL SELECT k, 'Reference Severing', 'critical', 'ORC/' || k FROM msg WHERE k % 4 <> 0
    UNION ALL SELECT k, 'Reference Severing', 'warning', 'PV1/V' || c FROM msg WHERE c % 3 = 0
    UNION ALL SELECT k, 'Attribute Dropping', 'critical', 'RXA' FROM msg WHERE k % 20 = 0
    UNION ALL SELECT l_orderkey, 'Type Narrowing', 'warning', 'OBX/' || l_orderkey || '.OBX' || l_linenumber FROM lineitem JOIN msg ON k = l_orderkey WHERE l_partkey % 7 = 0
    UNION ALL SELECT l_orderkey, 'Attribute Dropping', 'critical', 'OBX/' || l_orderkey || '.OBX' || l_linenumber FROM lineitem JOIN msg ON k = l_orderkey WHERE l_partkey % 2 = 0 AND l_suppkey % 3 = 0
), eff AS (
    SELECT found.*, tenant_id, ts, CASE
        WHEN tenant_id = 'APP1|FAC1' AND pattern = 'Reference Severing' AND location LIKE 'ORC/1%' THEN 'info'
        WHEN tenant_id = 'APP1|FAC1' AND pattern = 'Reference Severing' AND location LIKE 'ORC/%' THEN 'warning'
        WHEN location LIKE 'PV1/%' THEN 'critical' WHEN pattern = 'Temporal Collapse' THEN 'info' ELSE severity END AS effective
    FROM found JOIN msg USING (k)
), per AS (
    SELECT k, count(*) AS total, count(*) FILTER (WHERE severity = 'critical') AS crit, count(*) FILTER (WHERE severity = 'warning') AS warn,
        count(*) FILTER (WHERE pattern = 'Type Narrowing') * log2(95000.0) + count(*) FILTER (WHERE pattern = 'Temporal Collapse') * log2(60.0)
        + count(*) FILTER (WHERE pattern = 'Attribute Dropping') * 4.0 + count(*) FILTER (WHERE pattern = 'Reference Severing') * 24.0 AS bits FROM found GROUP BY k
), lines AS (SELECT l_orderkey AS k, count(*) AS n FROM lineitem GROUP BY l_orderkey
), rep AS (
    SELECT msg.*, coalesce(total, 0) AS total, coalesce(crit, 0) AS crit, coalesce(warn, 0) AS warn, round(coalesce(bits, 0), 2) AS bits,
        5 + CASE WHEN msg.k % 10 = 0 THEN 1 ELSE 0 END + coalesce(n, 0) AS segs FROM msg LEFT JOIN per ON per.k = msg.k LEFT JOIN lines ON lines.k = msg.k
)
"""


def _sql(body: str, more: str = "") -> str:
    return f"WITH {_MSG}{more}\n{body}"


_BOUNDS = "(VALUES (10.0, '10'), (20.0, '20'), (40.0, '40'), (80.0, '80'), (160.0, '160'), (320.0, '320'), (640.0, '640'), (1e300, '+Inf')) AS b(bound, le)"
_EFFECTIVE = _sql("SELECT tenant_id, pattern, severity, effective, count(*) AS n FROM eff GROUP BY ALL")

ORACLE = {
    "v2_losses_by_pattern": _sql("SELECT 'v2' AS protocol, pattern, severity, message_type, count(*) AS n FROM found JOIN msg USING (k) GROUP BY ALL"),
    "v2_reports": _sql("SELECT k AS receipt_id, message_type, 'M' || k AS control_id, tenant_id, segs::INT AS total_segments, total::INT AS total_losses, crit::INT AS n_critical, warn::INT AS n_warning, crit > 0 AS has_critical, warn > 0 AS has_warning, bits AS loss_bits, CASE WHEN crit > 0 THEN 'AE' ELSE 'AA' END AS ack_code, CASE WHEN crit > 0 THEN 'blocked' ELSE 'forwarded' END AS decision FROM rep"),
    "v2_findings": _sql("SELECT k AS receipt_id, pattern, severity, location FROM found"),
    "v2_messages": _sql("SELECT 'v2' AS protocol, message_type, CASE WHEN crit > 0 THEN 'AE' ELSE 'AA' END AS ack_code, count(*) AS n FROM rep GROUP BY ALL"),
    "v2_decisions": _sql("SELECT 'v2' AS protocol, CASE WHEN crit > 0 THEN 'blocked' ELSE 'forwarded' END AS decision, message_type, count(*) AS n FROM rep GROUP BY ALL"),
    "v2_budget_histogram": _sql(f"SELECT 'v2' AS protocol, message_type, le, count(*) FILTER (WHERE bits <= bound) AS n, count(*) AS count FROM rep, {_BOUNDS} GROUP BY ALL"),
    "v2_histogram_quantile": _sql(
        "SELECT 'v2' AS protocol, message_type, round(CASE WHEN bound > 1e100 THEN low ELSE low + (bound - low) * (rank - n0) / (n - n0) END, 4) AS quantile FROM w WHERE n >= rank AND n0 < rank",
        f", h AS (SELECT message_type, bound, count(*) FILTER (WHERE bits <= bound) AS n, 0.95::DOUBLE * count(*) AS rank FROM rep, {_BOUNDS} GROUP BY ALL), w AS (SELECT *, coalesce(lag(bound) OVER (PARTITION BY message_type ORDER BY bound), 0)::DOUBLE AS low, coalesce(lag(n) OVER (PARTITION BY message_type ORDER BY bound), 0) AS n0 FROM h)",
    ),
    "v2_percentiles": _sql("SELECT message_type, round(quantile_cont(bits, 0.5), 4) AS p50, round(quantile_cont(bits, 0.95), 4) AS p95, round(quantile_cont(bits, 0.99), 4) AS p99 FROM rep GROUP BY ALL"),
    "v2_rolling_percentile": _sql("SELECT tenant_id, k AS receipt_id, round(quantile_cont(total::DOUBLE, 0.95) OVER (PARTITION BY tenant_id ORDER BY k ROWS BETWEEN 999 PRECEDING AND CURRENT ROW), 4) AS p95 FROM rep"),
    "v2_dashboard": _sql("SELECT 'v2' AS protocol, count(*) AS n_messages, sum(total)::BIGINT AS n_losses, sum(crit)::BIGINT AS n_critical, count(*) FILTER (WHERE crit > 0) AS n_blocked, count(*) FILTER (WHERE crit = 0) AS n_forwarded FROM rep"),
    "v2_tenant_trend": _sql(
        "SELECT tenant_id, pattern, month, n, round(n / m, 6) AS rate, coalesce(lag(n) OVER w, 0) AS n_before, coalesce(n >= 2 * lag(n) OVER w, false) AS doubled FROM f JOIN t USING (tenant_id, month) WINDOW w AS (PARTITION BY tenant_id, pattern ORDER BY month)",
        ", f AS (SELECT tenant_id, pattern, strftime(ts, '%Y-%m') AS month, count(*) AS n FROM eff GROUP BY ALL), t AS (SELECT tenant_id, strftime(ts, '%Y-%m') AS month, count(*) AS m FROM msg GROUP BY ALL)",
    ),
    "v2_effective_severity": _EFFECTIVE,
    "v2_effective_severity_join": _EFFECTIVE,
    "v2_effective_reports": _sql("SELECT msg.k AS receipt_id, count(effective) FILTER (WHERE effective = 'critical')::INT AS n_critical, count(effective) FILTER (WHERE effective = 'warning')::INT AS n_warning, count(effective) FILTER (WHERE effective = 'info')::INT AS n_info, count(effective) FILTER (WHERE effective = 'critical') > 0 AS has_critical FROM msg LEFT JOIN eff ON eff.k = msg.k GROUP BY msg.k"),
    "v2_audit_events": _sql(
        """SELECT k AS message_id, k || '-' || (row_number() OVER (PARTITION BY k ORDER BY o) - 1) AS audit_id, effective AS severity, CASE effective WHEN 'critical' THEN '8' ELSE '4' END AS outcome FROM told WHERE effective IN ('warning', 'critical')""",
        """, seq AS (
    SELECT k, c, 'Reference Severing' AS pattern, 'warning' AS severity, 'PV1/V' || c AS location, [1, 0, 0, 0, 0, 0] AS o FROM msg WHERE c % 3 = 0
    UNION ALL SELECT k, c, 'Reference Severing', 'critical', 'ORC/' || k, [2, 0, 0, 0, 0, 0] FROM msg WHERE k % 4 <> 0
    UNION ALL SELECT k, c, 'Attribute Dropping', 'critical', 'RXA', [3, 0, 0, 0, 0, 0] FROM msg WHERE k % 20 = 0
    UNION ALL SELECT k, c, 'Temporal Collapse', 'warning', 'OBR/' || k, [4, 0, 0, 0, 0, 0] FROM msg WHERE k % 5 = 0
    UNION ALL SELECT k, c, 'Type Narrowing', 'warning', 'OBR/' || k, [5, 0, 0, 0, 0, 0] FROM msg WHERE c % 6 = 0
    UNION ALL SELECT k, c, 'Type Narrowing', 'warning', 'OBX', [6, l_linenumber, l_partkey, l_suppkey, l_quantity, 0] FROM lineitem JOIN msg ON k = l_orderkey WHERE l_partkey % 7 = 0
    UNION ALL SELECT k, c, 'Attribute Dropping', 'critical', 'OBX', [6, l_linenumber, l_partkey, l_suppkey, l_quantity, 1] FROM lineitem JOIN msg ON k = l_orderkey WHERE l_partkey % 2 = 0 AND l_suppkey % 3 = 0
), told AS (
    SELECT seq.*, CASE WHEN tenant_id = 'APP1|FAC1' AND pattern = 'Reference Severing' AND location LIKE 'ORC/1%' THEN 'info' WHEN tenant_id = 'APP1|FAC1' AND pattern = 'Reference Severing' AND location LIKE 'ORC/%' THEN 'warning'
        WHEN location LIKE 'PV1/%' THEN 'critical' WHEN pattern = 'Temporal Collapse' THEN 'info' ELSE severity END AS effective FROM seq JOIN msg USING (k)
)""",
    ),
    "v2_audit_log": _sql("SELECT k AS receipt_id, CASE WHEN crit > 0 THEN 'blocked' ELSE 'forwarded' END AS decision, total::INT AS total_losses FROM rep WHERE crit > 0 OR warn > 0"),
    "v2_duplicates": _sql("SELECT 'APP' || (c % 5) AS msh3, 'FAC' || (c % 2) AS msh4, 'M' || k AS msh10, 2::BIGINT AS n, (-k - 1)::BIGINT AS first_id FROM msg WHERE k % 50 = 0"),
    "v2_recovered": _sql("SELECT k AS receipt_id, 'recovered' AS decision, total::INT AS total_losses FROM rep WHERE ts >= TIMESTAMP '1997-01-01'"),
    "v2_patient_keys": _sql("SELECT k AS receipt_id, 'HOSP|P' || c AS keys, 'keyed' AS pkey_status FROM msg"),
    "v2_garbage": "SELECT 'UNKNOWN' AS message_type, count(*) AS n, 0::BIGINT AS n_losses FROM documents",
}
