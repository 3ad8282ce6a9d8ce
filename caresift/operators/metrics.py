"""Counts, histograms, quantiles and trends over reports and findings."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from caresift.sources.files import kept

#: Upper bounds of the histograms' buckets.
BUDGET_BOUNDS = (10.0, 20.0, 40.0, 80.0, 160.0, 320.0, 640.0)
LATENCY_BOUNDS = (0.0005, 0.001, 0.0025, 0.005, 0.01, 0.025, 0.05, 0.1, 0.25, 0.5, 1.0)


def messages(reports: DataFrame) -> DataFrame:
    return reports.groupBy("protocol", "message_type", "ack_code").agg(F.count("*").alias("n"))


def losses(findings: DataFrame, severity: str = "severity") -> DataFrame:
    return findings.groupBy("protocol", "pattern", F.col(severity).alias("severity"), "message_type").agg(F.count("*").alias("n"))


def decisions(reports: DataFrame) -> DataFrame:
    return reports.groupBy("protocol", "decision", "message_type").agg(F.count("*").alias("n"))


def histogram(df: DataFrame, value: str, bounds: tuple[float, ...], by: list[str]) -> DataFrame:
    """Cumulative buckets: ``by``, le (string, +Inf last), n, sum, count.  One pass and one small shuffle."""
    counts = [F.count_if(F.col(value) <= b).alias(f"b{i}") for i, b in enumerate(bounds)]
    one = df.groupBy(*by).agg(*counts, F.count(value).alias("count"), F.round(F.sum(value), 4).alias("sum"))
    buckets = F.array(*[F.struct(F.lit(f"{b:g}").alias("le"), F.lit(float(b)).alias("bound"), F.col(f"b{i}").alias("n")) for i, b in enumerate(bounds)], F.struct(F.lit("+Inf").alias("le"), F.lit(None).cast("double").alias("bound"), F.col("count").alias("n")))
    return one.select(*by, F.explode(buckets).alias("b"), "sum", "count").select(*by, "b.le", "b.bound", "b.n", "sum", "count")


def histogram_quantile(buckets: DataFrame, q: float, by: list[str]) -> DataFrame:
    """``by``, quantile: linear inside the bucket that holds rank q * count; in the last one, its lower bound."""
    order = Window.partitionBy(*by).orderBy(F.col("bound").asc_nulls_last())
    rows = buckets.withColumns({"__low": F.coalesce(F.lag("bound").over(order), F.lit(0.0)), "__before": F.coalesce(F.lag("n").over(order), F.lit(0)), "__rank": F.lit(q) * F.col("count")})
    hit = rows.where((F.col("n") >= F.col("__rank")) & ((F.col("__before") < F.col("__rank")) | (F.col("__before") == 0)) & (F.col("count") > 0))
    inside = F.col("__low") + (F.col("bound") - F.col("__low")) * (F.col("__rank") - F.col("__before")) / (F.col("n") - F.col("__before"))
    value = F.when(F.col("bound").isNull(), F.col("__low")).otherwise(inside)
    return hit.groupBy(*by).agg(F.round(F.min_by(value, F.coalesce("bound", F.lit(float("inf")))), 4).alias("quantile"))


def percentiles(df: DataFrame, value: str, by: list[str]) -> DataFrame:
    """Exact p50, p95 and p99, linear between ranks."""
    p = F.percentile(value, F.array(F.lit(0.5), F.lit(0.95), F.lit(0.99)))
    return df.groupBy(*by).agg(p.alias("__p")).select(*by, *[F.round(F.col("__p")[i], 4).alias(n) for i, n in enumerate(("p50", "p95", "p99"))])


def rolling_percentile(df: DataFrame, value: str, by: list[str], order: list[str], rows: int = 1000) -> DataFrame:
    """``df`` with p95 of the last ``rows`` values up to each row; as ``rolling_percentiles``."""
    return rolling_percentiles(df, value, by, order, rows, levels=(0.95,))


def _rolled(table: pa.Table, rows: int, block: int, levels: tuple[float, ...]) -> pa.Table:
    """Of one block and the frame before it: its rows with __p0, __p1 ..., unrounded.

    Values are replaced by their ranks, so that infinite ones count as Spark counts them and only nulls as missing; the two
    ranks next to a percentile give it as Spark's ``percentile`` does.
    """
    table = table.sort_by("__row")
    told = table["__value"]
    known, rank = np.unique(told.to_numpy()[told.is_valid().to_numpy()], return_inverse=True)
    place = np.full(len(told), np.nan)
    place[told.is_valid().to_numpy()] = rank
    frame = pd.Series(place).rolling(rows, min_periods=1)
    at_most = np.nan_to_num(frame.count().to_numpy()) - 1
    own = pc.equal(pc.divide(table["__row"], block), table["__block"])
    out = table.drop_columns(["__value", "__block", "__row"])
    for i, level in enumerate(levels):
        where = at_most * level
        low, high = np.floor(where), np.ceil(where)
        small, great = (frame.quantile(level, interpolation=side).to_numpy() for side in ("lower", "higher"))
        there = at_most >= 0
        a, b = (known[np.where(there, x, 0).astype(int)] if len(known) else place for x in (small, great))
        with np.errstate(invalid="ignore"):
            mixed = np.where((low == high) | (a == b), a, (high - where) * a + (where - low) * b)
        out = out.append_column(f"__p{i}", pa.array(mixed, pa.float64(), mask=~there))
    return out.filter(own)


def rolling_percentiles(df: DataFrame, value: str, by: list[str], order: list[str], rows: int = 1000, block: int = 20_000, levels: tuple[float, ...] = (0.5, 0.95, 0.99)) -> DataFrame:
    """``df`` with p50, p95, p99 (named by ``levels``) of the last ``rows`` values of its group up to each row.

    However many rows a group has, no window holds more than ``block`` and the frame before it: rows are numbered within
    sorted partitions, the partitions' counts (a table of partitions and groups) say where each begins, and the last
    ``rows`` - 1 of a block go along with the next.  ``order`` has to be without ties; null values count in no percentile.
    A block is one call of pandas, whose frame slides: a row costs one insertion and one removal, not ``rows`` of them.
    """
    place = F.monotonically_increasing_id()
    whole = kept(df)  # ranges are sampled first, which would make rows twice
    dealt = kept(whole.repartitionByRange(*by, *order).sortWithinPartitions(*by, *order).withColumns({"__part": F.shiftright(place, 33), "__at": place}))
    counts = dealt.groupBy(*by, "__part").agg(F.count("*").alias("__n"), F.min("__at").alias("__low"))
    before = Window.partitionBy(*by).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    begins = kept(counts.withColumn("__begin", F.coalesce(F.sum("__n").over(before), F.lit(0)) - F.col("__low")).select(*[F.col(c).alias(f"__{c}") for c in by], "__part", "__begin"))
    same = [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in by]
    here = dealt.join(begins.withColumnRenamed("__part", "__own"), [*same, F.col("__part") == F.col("__own")]).withColumn("__row", F.col("__at") + F.col("__begin"))
    number, inside = F.floor(F.col("__row") / block).cast("long"), F.col("__row") % block
    copies = here.withColumn("__block", F.explode(F.when(inside >= block - rows + 1, F.array(number, number + 1)).otherwise(F.array(number))))
    asked = copies.select(*df.columns, F.col(value).cast("double").alias("__value"), "__block", F.col("__row").cast("long").alias("__row"))
    schema = StructType([*[asked.schema[c] for c in df.columns], *[StructField(f"__p{i}", DoubleType()) for i in range(len(levels))]])
    told = asked.groupBy(*by, "__block").applyInArrow(lambda table: _rolled(table, rows, block, levels), schema)
    return told.select(*df.columns, *[F.round(f"__p{i}", 4).alias(f"p{100 * q:g}") for i, q in enumerate(levels)])


def dashboard(reports: DataFrame, protocol: str | None = None) -> DataFrame:
    rows = reports if protocol is None else reports.where(F.col("protocol") == protocol)
    return rows.groupBy("protocol").agg(
        F.count("*").alias("n_messages"),
        F.sum("total_losses").alias("n_losses"),
        F.sum("n_critical").alias("n_critical"),
        F.count_if(F.col("decision") == "blocked").alias("n_blocked"),
        F.count_if(F.col("decision") == "forwarded").alias("n_forwarded"),
    )


def tenant_trend(findings: DataFrame, messages: DataFrame) -> DataFrame:
    """Per tenant, pattern and month: findings, rate per message, those of the month before, and whether they doubled."""
    month = F.date_format("received_ts", "yyyy-MM")
    found = findings.groupBy("tenant_id", "pattern", month.alias("month")).agg(F.count("*").alias("n"))
    total = messages.groupBy("tenant_id", month.alias("month")).agg(F.count("*").alias("m"))
    w = Window.partitionBy("tenant_id", "pattern").orderBy("month")
    rows = found.join(total, ["tenant_id", "month"])
    before = F.lag("n").over(w)
    return rows.select("tenant_id", "pattern", "month", "n", F.round(F.col("n") / F.col("m"), 6).alias("rate"), F.coalesce(before, F.lit(0)).alias("n_before"), F.coalesce(F.col("n") >= 2 * before, F.lit(False)).alias("doubled"))


def fidelity(reports: DataFrame) -> DataFrame:
    """The part of clean messages in percent."""
    return reports.agg(F.round(100 * F.avg(F.when(F.col("total_losses") == 0, 1).otherwise(0)), 1).alias("fidelity"), F.count("*").alias("n"))
