import pytest
from pyspark.sql import functions as F

from caresift.functions import hl7
from caresift.operators import findings, severity, v2
from caresift.sources import synth


def message(*segments):
    return "\r".join(["MSH|^~\\&|APP|FAC|X|Y|20240101||ORU^R01|M1|P|2.5", *segments])


def rules(spark, text):
    rows = v2.inspect(spark.createDataFrame([(1, text)], "receipt_id long, text string"))
    return [(r["rule_id"], r["severity"], r["location"]) for r in findings.explode(rows, ["receipt_id"]).orderBy("finding_idx").collect()]


@pytest.mark.parametrize(
    ("segments", "want"),
    [
        (["OBR|1|7||^panel^"], [("TN-CE-01", "warning", "OBR/7")]),
        (["OBR|1|7||c^panel^"], []),
        (["OBR|1|7||^^LN"], []),
        (["OBR|1|7|||||20240101|20240102"], [("TC-OBR-01", "warning", "OBR/7")]),
        (["OBR|1|7|||||20240101|20240101"], []),
        (["OBX|1|NM|a^b^c"], [("AD-OBX-01", "critical", "OBX/?.OBX1")]),
        (["OBR|1|", "OBX|2| nm |^x^||||||||||||"], [("TN-CE-01", "warning", "OBX/?.OBX2"), ("AD-OBX-01", "critical", "OBX/?.OBX2")]),
        (["OBX|1|NM|a^b^c" + "|" * 12 + "dev"], []),
        (["OBX|1|ST|a^b^c"], []),
        (["ORC|RE|77", "ORC|RE| ", "ORC|RE|78"], [("RS-ORC-01", "critical", "ORC/77"), ("RS-ORC-01", "critical", "ORC/78")]),
        (["PV1" + "|" * 19 + "V1"], [("RS-PV1-19", "warning", "PV1/V1")]),
        (["RXA|0|1|a|b|c|5|"], [("AD-RXA-67", "critical", "RXA")]),
    ],
)
def test_rules(spark, segments, want):
    assert rules(spark, message(*segments)) == want


def test_times_and_keys(spark):
    cases = {"20240102": "2024-01-02 00:00:00", "202401020304": "2024-01-02 03:04:00", "2024010203040": "2024-01-02 03:04:00", "20240102030460": None, "00000102": None, "2024013": None, "x": None, "20240102030405.6+0100": "2024-01-02 03:04:05"}
    df = spark.createDataFrame([(k,) for k in cases], "s string")
    got = {r["s"]: r["t"] for r in df.select("s", F.date_format(hl7.timestamp(F.col("s")), "yyyy-MM-dd HH:mm:ss").alias("t")).collect()}
    assert got == cases
    pids = {"P1^^^HOSP^MR": (["HOSP|P1"], "keyed"), "P2^^^HOSP^MR~E9^^^EXT^MR": (["EXT|E9", "HOSP|P2"], "keyed"), "P3^^^^MR": ([], "unresolved"), "P4^^^HOSP": ([], "unresolved"), "": ([], "patientless")}
    df = spark.createDataFrame([(k, f"MSH|x\rPID|1||{k}") for k in pids], "k string, text string")
    keys = hl7.patient_keys(F.col("text"))
    assert {r["k"]: (r["a"], r["b"]) for r in df.select("k", keys.alias("a"), hl7.patient_class(F.col("text"), keys).alias("b")).collect()} == pids
    odd = spark.createDataFrame([(None,), ("",), ("\n" + message(),)], "text string")
    assert [tuple(r["m"]) for r in odd.select(hl7.marker(F.coalesce("text", F.lit(""))).alias("m")).collect()] == [(None,) * 3] * 3


def test_last_rule_of_highest_layer_wins(spark):
    rule = lambda layer, n, tenant, pattern, prefix, level: dict(layer=layer, ord=n, tenant=tenant, pattern=pattern, location_prefix=prefix, severity=level)
    config = [rule(0, 0, None, "", "", "info"), rule(0, 1, None, findings.RS, "ORC/", "warning"), rule(1, 0, "APP|FAC", "", "ORC/7", "critical")]
    rows = v2.inspect(spark.createDataFrame([(1, message("ORC|RE|77", "ORC|RE|88", "RXA|0"))], "receipt_id long, text string"))
    out = findings.explode(severity.apply_to_reports(rows, config), ["receipt_id"]).orderBy("finding_idx").collect()
    assert [r["effective"] for r in out] == ["critical", "warning", "info"]
    table = spark.createDataFrame([(r["layer"], r["tenant"], r["ord"], r["pattern"], r["location_prefix"], r["severity"]) for r in config], "layer int, tenant string, ord int, pattern string, location_prefix string, severity string")
    joined = severity.apply_to_findings(findings.explode(rows, ["receipt_id", "tenant_id"]), table, ["receipt_id", "finding_idx"]).orderBy("finding_idx").collect()
    assert [r["effective"] for r in joined] == ["critical", "warning", "info"]


def test_scan_is_pruned(spark, sf_dir):
    plan = synth.oru_messages(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "l_shipdate" not in plan
