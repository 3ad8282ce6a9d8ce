import random

from caresift.operators import severity

RULE = "layer int, tenant string, ord int, pattern string, location_prefix string, severity string"


def test_joined_rules_like_a_loop(spark):
    """Rules with and without pattern, prefix and tenant: the last that fits of the highest layer wins."""
    r = random.Random(4)
    rules = [(layer, r.choice(["A|1", "B|2"]) if layer else None, i, r.choice(["", None, "P", "Q"]), r.choice(["", None, "OBX/", "OBX/1", "ORC/"]), f"s{layer}-{i}") for layer in (0, 1) for i in range(40)]
    rows = [(i, 0, r.choice(["A|1", "B|2", "C|3", "", None]), r.choice(["P", "Q", "R", None]), r.choice(["OBX/1", "OBX/2", "ORC/7", "", None]), "info") for i in range(300)]

    def plain(tenant, pattern, location, own):
        fits = [x for x in rules if (not x[0] or x[1] == tenant) and (not x[3] or x[3] == pattern) and (location is not None and location.startswith(x[4] or ""))]
        return max(fits, key=lambda x: (x[0], x[2]))[5] if fits else own

    df = spark.createDataFrame(rows, "receipt_id long, finding_idx int, tenant_id string, pattern string, location string, severity string")
    out = severity.apply_to_findings(df, spark.createDataFrame(rules, RULE), ["receipt_id", "finding_idx"])
    assert {x["receipt_id"]: x["effective"] for x in out.collect()} == {x[0]: plain(*x[2:]) for x in rows}
    assert out.columns == [*df.columns, "effective"]
    none = severity.apply_to_findings(df, spark.createDataFrame([], RULE), ["receipt_id", "finding_idx"])
    assert all(x["effective"] == "info" for x in none.collect())
