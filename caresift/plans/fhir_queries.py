"""Queries over FHIR bundles made from customers' orders."""

from __future__ import annotations

from pyspark.sql import functions as F

from caresift.operators import fhir, metrics
from caresift.operators import findings as fnd
from caresift.sources import synth


def _inspected(spark, sf_dir, german=False):
    return fhir.inspect(fhir.parse(synth.bundles(spark, sf_dir))[0], german)


def losses(spark, sf_dir):
    return fnd.explode(_inspected(spark, sf_dir), ["bundle_key"]).groupBy("rule_id", "pattern", "severity").agg(F.count("*").alias("n"))


def losses_german(spark, sf_dir):
    return fnd.explode(_inspected(spark, sf_dir, True), ["bundle_key"]).groupBy("rule_id", "pattern", "severity").agg(F.count("*").alias("n"))


def reports(spark, sf_dir):
    return _inspected(spark, sf_dir).select("control_id", "message_type", "total_segments", "total_losses", "n_critical", "n_warning", "n_info", "loss_bits")


def rejected(spark, sf_dir):
    docs = synth.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("bundle_key"), "text")
    return fhir.parse(docs)[1].groupBy("reason").agg(F.count("*").alias("n"))


def dangling(spark, sf_dir):
    return fhir.dangling(fhir.parse(synth.bundles(spark, sf_dir))[0])


def fidelity(spark, sf_dir):
    return metrics.fidelity(_inspected(spark, sf_dir))


def rare_findings(spark, sf_dir):
    """With the German pack, over bundles in which the rarer rules fire and don't fire."""
    rows = fhir.inspect(fhir.parse(synth.rare_bundles(spark, sf_dir))[0], True)
    return fnd.explode(rows, ["bundle_key"]).select("bundle_key", "rule_id", "pattern", "severity", "location")


def manifest(spark, sf_dir):
    """Reports against a manifest that expects one loss more in every tenth bundle and knows nothing of bundles without critical ones."""
    found = _inspected(spark, sf_dir)
    more = F.when(F.substring("control_id", 2, 20).cast("long") % 10 == 0, 1).otherwise(0)
    want = found.where("has_critical").select("control_id", (F.col("total_losses") + more).alias("expected_total_losses"), F.struct(F.col("n_critical").alias("critical"), F.col("n_warning").alias("warning"), F.col("n_info").alias("info")).alias("severities"))
    return fhir.against_manifest(found, want).select("control_id", "total_losses", "want")


QUERIES = {"fhir_rare_findings": rare_findings, "fhir_manifest": manifest, "fhir_losses": losses, "fhir_losses_german": losses_german, "fhir_reports": reports, "fhir_rejected": rejected, "fhir_dangling": dangling, "fhir_fidelity": fidelity}

_F = """
WITH o AS (SELECT o_orderkey AS k, o_custkey AS c FROM orders), f AS (
    SELECT c, 'TN-CC-01' AS rule_id, 'Type Narrowing' AS pattern, 'warning' AS severity FROM o WHERE k % 7 = 0
    UNION ALL SELECT c, 'TN-CATEGORY', 'Type Narrowing', 'info' FROM o WHERE k % 7 <> 0 AND k % 2 = 0
    UNION ALL SELECT c, 'RS-BUNDLE-01', 'Reference Severing', 'critical' FROM o WHERE k % 5 = 0
    UNION ALL SELECT c, 'RS-BUNDLE-01', 'Reference Severing', 'critical' FROM o WHERE k % 11 = 0
    UNION ALL SELECT c, 'RS-LAB-ORDER', 'Reference Severing', 'info' FROM o WHERE k % 2 = 0 AND k % 4 <> 0
    UNION ALL SELECT c, 'AD-LAB-METHOD', 'Attribute Dropping', 'info' FROM o WHERE k % 2 = 0
    UNION ALL SELECT c, 'AD-VAL-01', 'Attribute Dropping', 'critical' FROM o WHERE k % 3 = 0
    UNION ALL SELECT c, 'TC-PROCEDURE', 'Temporal Collapse', CASE WHEN k % 10 = 0 THEN 'critical' ELSE 'warning' END FROM o WHERE k % 6 <> 0
    UNION ALL SELECT c, 'TC-PERIOD-01', 'Temporal Collapse', 'warning' FROM o WHERE k % 8 <> 0
    UNION ALL SELECT c, 'AD-DOSAGE', 'Attribute Dropping', 'critical' FROM o WHERE k % 9 = 0
), g AS (
    SELECT c, 'DE-CERTAINTY' AS rule_id, 'Attribute Dropping' AS pattern, 'warning' AS severity FROM o
    UNION ALL SELECT DISTINCT c, 'DE-KVID', 'Attribute Dropping', 'info' FROM o WHERE c % 2 <> 0
)
"""
ORACLE = {
    "fhir_losses": _F + "SELECT rule_id, pattern, severity, count(*) AS n FROM f GROUP BY ALL",
    "fhir_losses_german": _F + "SELECT rule_id, pattern, severity, count(*) AS n FROM (SELECT * FROM f UNION ALL SELECT * FROM g) GROUP BY ALL",
    "fhir_reports": _F
    + """, n AS (SELECT c, count(*) AS n FROM o GROUP BY c), p AS (SELECT c, count(*) AS total, count(*) FILTER (WHERE severity = 'critical') AS crit, count(*) FILTER (WHERE severity = 'warning') AS warn,
        count(*) FILTER (WHERE severity = 'info') AS info, count(*) FILTER (WHERE pattern = 'Type Narrowing') * log2(95000.0) + count(*) FILTER (WHERE pattern = 'Temporal Collapse') * log2(60.0)
        + count(*) FILTER (WHERE pattern = 'Attribute Dropping') * 4.0 + count(*) FILTER (WHERE pattern = 'Reference Severing') * 24.0 AS bits FROM f GROUP BY c)
    SELECT 'B' || n.c AS control_id, 'Bundle/transaction' AS message_type, (5 * n + 1)::INT AS total_segments, coalesce(total, 0)::INT AS total_losses, coalesce(crit, 0)::INT AS n_critical, coalesce(warn, 0)::INT AS n_warning,
        coalesce(info, 0)::INT AS n_info, round(coalesce(bits, 0), 2) AS loss_bits FROM n LEFT JOIN p ON p.c = n.c""",
    "fhir_rare_findings": """
    WITH c AS (SELECT c_custkey AS k FROM customer)
    SELECT k AS bundle_key, 'TC-CATEGORY' AS rule_id, 'Temporal Collapse' AS pattern, 'warning' AS severity, 'Observation/a' || k AS location FROM c WHERE k % 2 = 0
    UNION ALL SELECT k, 'TC-AGGREGATE', 'Temporal Collapse', 'warning', 'Observation/a' || k FROM c WHERE k % 2 <> 0 AND k % 3 = 0
    UNION ALL SELECT k, 'TN-SYSTEM', 'Type Narrowing', 'info', 'Observation/a' || k FROM c WHERE k % 5 = 0
    UNION ALL SELECT k, 'RS-BUNDLE-01', 'Reference Severing', 'critical', 'Observation/a' || k FROM c WHERE k % 4 = 0
    UNION ALL SELECT k, 'RS-BUNDLE-01', 'Reference Severing', 'critical', 'Condition/b' || k FROM c WHERE k % 9 = 0
    UNION ALL SELECT k, 'TN-CC-01', 'Type Narrowing', 'warning', 'Condition/b' || k FROM c WHERE k % 4 = 1
    UNION ALL SELECT k, 'TN-SYSTEM', 'Type Narrowing', 'info', 'Condition/b' || k FROM c WHERE k % 6 = 0
    UNION ALL SELECT k, 'DE-CERTAINTY', 'Attribute Dropping', 'warning', 'Condition/b' || k FROM c WHERE k % 3 <> 0
    UNION ALL SELECT k, 'DE-UCUM', 'Type Narrowing', 'info', 'Observation/a' || k FROM c WHERE k % 7 >= 3
    UNION ALL SELECT k, 'DE-ATC', 'Type Narrowing', 'info', 'MedicationAdministration/m' || k FROM c WHERE k % 2 = 0
    UNION ALL SELECT k, 'DE-KVID', 'Attribute Dropping', 'info', 'Patient/p' || k FROM c WHERE k % 2 <> 0""",
    "fhir_manifest": _F + "SELECT 'B' || n.c AS control_id, coalesce(total, 0)::INT AS total_losses, CASE WHEN crit > 0 THEN (total + CASE WHEN n.c % 10 = 0 THEN 1 ELSE 0 END)::INT END AS want FROM (SELECT DISTINCT c FROM o) n LEFT JOIN (SELECT c, count(*) AS total, count(*) FILTER (WHERE severity = 'critical') AS crit FROM f GROUP BY c) p ON p.c = n.c WHERE coalesce(crit, 0) = 0 OR n.c % 10 = 0",
    "fhir_rejected": "SELECT CASE WHEN trim(text) = '' THEN 'empty' ELSE 'not JSON with a resourceType' END AS reason, count(*) AS n FROM documents GROUP BY ALL",
    "fhir_dangling": _F + "SELECT 'B' || c AS bundle_id, 'Patient/x' || k AS reference FROM o WHERE k % 5 = 0 UNION ALL SELECT 'B' || c, 'Patient/x' || k FROM o WHERE k % 11 = 0",
    "fhir_fidelity": _F + "SELECT round(100.0 * count(*) FILTER (WHERE c NOT IN (SELECT c FROM f)) / count(*), 1) AS fidelity, count(*) AS n FROM (SELECT DISTINCT c FROM o)",
}
