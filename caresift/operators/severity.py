"""Effective severities: override rules by tenant, pattern and location prefix."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

RULE = "struct<pattern:string,location_prefix:string,severity:string>"
#: Rules up to which they are compiled into one expression.
COMPILED = 200


def read_rules(spark: SparkSession, path: str) -> DataFrame:
    """layer (0 default, 1 tenant), tenant, ord, pattern, location_prefix, severity from a JSON file of overrides."""
    schema = f"default_overrides array<{RULE}>, tenant_overrides map<string,array<{RULE}>>"
    raw = spark.read.schema(schema).option("multiLine", True).json(path)
    plain = raw.select(F.lit(0).alias("layer"), F.lit(None).cast("string").alias("tenant"), F.posexplode("default_overrides").alias("ord", "r"))
    own = raw.select(F.explode("tenant_overrides").alias("tenant", "rules")).select(F.lit(1).alias("layer"), "tenant", F.posexplode("rules").alias("ord", "r"))
    return plain.unionByName(own).select("layer", "tenant", "ord", "r.pattern", "r.location_prefix", "r.severity")


def compiled(rules: list[dict], pattern: Column, location: Column, tenant: Column, severity: Column) -> Column:
    """The severity after all rules, as one CASE: the last rule that fits of the highest layer comes first."""
    out = F.when(F.lit(False), severity)
    for r in sorted(rules, key=lambda r: (r["layer"], r["ord"]), reverse=True):
        fits = F.lit(True)
        if r["layer"]:
            fits = fits & (tenant == F.lit(r["tenant"]))
        if r["pattern"]:
            fits = fits & (pattern == F.lit(r["pattern"]))
        if r["location_prefix"]:
            fits = fits & F.startswith(location, F.lit(r["location_prefix"]))
        out = out.when(fits, F.lit(r["severity"]))
    return out.otherwise(severity)


def apply_to_reports(df: DataFrame, rules: list[dict], found: str = "findings", tenant: str = "tenant_id") -> DataFrame:
    """``effective`` in every finding of the array; no join, for a small configuration of up to COMPILED rules."""
    if len(rules) > COMPILED:
        raise ValueError("so many rules are a table: use apply_to_findings")
    add = lambda x: x.withField("effective", compiled(rules, x["pattern"], x["location"], F.col(tenant), x["severity"]))
    return df.withColumn(found, F.transform(found, add))


def apply_to_findings(rows: DataFrame, rules: DataFrame, keys: list[str], tenant: str = "tenant_id") -> DataFrame:
    """``rows`` (a finding each, told apart by ``keys``) with ``effective``, by joins with a table of rules.

    An empty pattern or prefix fits all.  Rules are looked up by tenant and pattern, each named or for all: a finding has
    four lookups, so every join is an equal one, and the prefix is a filter of what meets.
    """
    blank = lambda c: F.coalesce(F.col(c), F.lit("")) == ""
    all_of = F.lit(None).cast("string")
    r = rules.select(F.when(F.col("layer") == 0, all_of).otherwise(F.col("tenant")).alias("__tenant"), F.when(~blank("pattern"), F.col("pattern")).alias("__pattern"), F.coalesce("location_prefix", F.lit("")).alias("__prefix"), F.struct("layer", "ord", "severity").alias("__rule"), (F.col("layer") == 0).alias("__plain"))
    grouped = r.groupBy("__plain", "__tenant", "__pattern").agg(F.collect_list(F.struct("__prefix", "__rule")).alias("__rules"))  # rules of one tenant and pattern: a hand-written list
    lookup = lambda plain, named: F.struct(F.lit(plain).alias("plain"), (all_of if plain else F.col(tenant)).alias("tenant"), (F.col("pattern") if named else all_of).alias("pattern"))
    asked = rows.withColumn("__ask", F.explode(F.array(*[lookup(p, n) for p in (True, False) for n in (True, False)])))
    on = (F.col("__ask.plain") == F.col("__plain")) & F.col("__ask.tenant").eqNullSafe(F.col("__tenant")) & F.col("__ask.pattern").eqNullSafe(F.col("__pattern"))
    met = asked.join(grouped, on, "left")
    fits = F.filter(F.coalesce("__rules", F.array().cast(grouped.schema["__rules"].dataType)), lambda x: F.coalesce(F.startswith(F.col("location"), x["__prefix"]), F.lit(False)))
    best = F.array_max(F.transform(fits, lambda x: x["__rule"]))
    whole = F.struct(*[F.col(f"`{c}`") for c in rows.columns])
    one = met.groupBy(*[F.col(k) for k in keys]).agg(F.first(whole).alias("__row"), F.max(best).alias("__best"))
    return one.select("__row.*", F.coalesce("__best.severity", "__row.severity").alias("effective"))
