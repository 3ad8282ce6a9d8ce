"""Contacts: segments of different patients in one unit whose half-open times overlap."""

from __future__ import annotations

import functools
import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from caresift.sources.files import kept, large, tasks

HOUR, DAY = 3_600, 86_400
#: Segments of more than so many buckets are a class of their own.
LONG = 16
#: Segments in a block, of which two meet at once.
BLOCK = 128


def unit(granularity: str = "ward") -> Column:
    """ward, ward^room or ward^room^bed; the coarser one where the finer part is missing."""
    if granularity not in ("ward", "room", "bed"):
        raise ValueError(granularity)
    ward, room, bed = F.col("ward"), F.coalesce("room", F.lit("")), F.coalesce("bed", F.lit(""))
    if granularity == "ward":
        return ward
    near = F.when(room == "", ward).otherwise(F.concat_ws("^", ward, room))
    return near if granularity == "room" else F.when((room == "") | (bed == ""), near).otherwise(F.concat_ws("^", ward, room, bed))


def exact_only(segments: DataFrame) -> DataFrame:
    """Without segments that have an estimated bound."""
    return segments.where((F.coalesce("start_provenance", F.lit("")) != "estimated") & (F.coalesce("end_provenance", F.lit("")) != "estimated"))


def pairs(segments: DataFrame, granularity: str = "ward", bucket: int = DAY, salts: int = 8) -> DataFrame:
    """segment_id, other_id for both directions of each contact.

    Closed segments of up to LONG buckets are dealt to time buckets, joined on unit and bucket, and a pair counts in the
    first bucket both are in.  Longer ones are a class of their own with buckets of LONG times the length, in which the
    short ones are dealt too.  Open segments have no bound: they meet all of their unit, as all but the earlier ones there
    are contacts; both sides are dealt to a grid of at least ``salts`` by ``salts`` cells a unit.  Touching segments are no
    contact; a segment of no length inside another is one.  Rows without a unit, a start or a patient are in none.

    What meets is not rows but blocks of rows, whose pairs are made one after the other: nothing is kept of them, and a
    written table has few ids at a time, which compress well.
    """
    rows = _timed(segments, granularity)
    long = (F.col("b") - F.col("a")) > LONG * bucket
    rows = kept(rows.withColumn("class", F.when(F.col("b").isNull(), "open").when(long, "long").otherwise("short")))  # read by each class and side
    wide = LONG * bucket
    dealt = lambda df, size: df.withColumns({"lo": F.floor(F.least("a", "b") / size), "hi": F.floor(F.greatest("a", "b") / size)}).withColumn("bucket", F.explode(F.sequence("lo", "hi")))
    short, far, still = (rows.where(F.col("class") == c) for c in ("short", "long", "open"))
    first = F.col("bucket") == F.greatest("x.lo", "y.lo")
    n = tasks(segments.sparkSession)  # few bytes make many pairs
    near = _blocks(dealt(short, bucket), ["unit", "bucket"], "a").repartition(n, "unit", "bucket")
    out = _crossed(near, near, ["unit", "bucket"], first)
    wider = lambda df: _blocks(dealt(df, wide), ["unit", "bucket"], "a").repartition(n, "unit", "bucket")
    out = out.unionByName(_crossed(wider(far), wider(rows.where("class <> 'open'")), ["unit", "bucket"], first))
    out = out.unionByName(_crossed(wider(short), wider(far), ["unit", "bucket"], first))
    g = max(salts, math.ceil(math.sqrt(2 * n)))
    cells = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(g - 1).cast("long")))
    own = F.pmod(F.col("__slot") + F.col("__n"), F.lit(g))
    grid = lambda df, at, x, y: _blocks(df.withColumn("__slot", F.floor(F.col(at) / wide)), ["unit", "__slot"], at).withColumns({x: own, y: cells}).repartition(n, "unit", "x", "y")
    closed = rows.where("class <> 'open'")
    by = ["unit", "x", "y"]
    out = out.unionByName(_crossed(grid(still, "a", "x", "y"), grid(still, "a", "y", "x"), by))
    out = out.unionByName(_crossed(grid(still, "a", "x", "y"), grid(closed, "b", "y", "x"), by))
    return out.unionByName(_crossed(grid(closed, "b", "x", "y"), grid(still, "a", "y", "x"), by))


def _blocks(rows: DataFrame, by: list[str], order: str) -> DataFrame:
    """by, __n, __rows, __a, __b: up to BLOCK rows of a group that are near each other in ``order``, their least start and
    greatest end; the end of an open one is null, as is then the block's."""
    place = F.row_number().over(Window.partitionBy(*by).orderBy(order))
    row = F.struct("segment_id", "patient_key", "a", "b", *(["lo"] if "lo" in rows.columns else []))
    dealt = rows.withColumn("__n", F.floor((place - 1) / BLOCK))
    return dealt.groupBy(*by, "__n").agg(F.collect_list(row).alias("__rows"), F.min("a").alias("__a"), F.when(F.count("b") == F.count("*"), F.max("b")).alias("__b"))


def _crossed(left: DataFrame, right: DataFrame, by: list[str], more: Column | None = None) -> DataFrame:
    """segment_id, other_id of the rows x of blocks of one side and y of the other, of the same group, that are contacts and ``more``."""
    l, r = left.alias("l"), large(right.alias("r"))
    same = functools.reduce(Column.__and__, [F.col(f"l.{c}") == F.col(f"r.{c}") for c in by])
    meet = (F.col("l.__b").isNull() | (F.col("r.__a") < F.col("l.__b"))) & (F.col("r.__b").isNull() | (F.col("l.__a") < F.col("r.__b")))
    rows = l.join(r, same & meet).select(*[F.col(f"l.{c}") for c in by], F.col("l.__rows").alias("__x"), F.col("r.__rows").alias("__y"))
    rows = rows.withColumn("x", F.explode("__x")).withColumn("y", F.explode("__y"))
    return rows.where(_overlap() & (F.lit(True) if more is None else more)).select(F.col("x.segment_id").alias("segment_id"), F.col("y.segment_id").alias("other_id"))


def _timed(segments: DataFrame, granularity: str) -> DataFrame:
    """Segments that can have contacts, with their unit and their seconds."""
    rows = segments.select("segment_id", "patient_key", unit(granularity).alias("unit"), F.unix_timestamp("start_ts").alias("a"), F.unix_timestamp("end_ts").alias("b"))
    return rows.where("unit is not null and patient_key is not null and a is not null")


def _overlap() -> Column:
    """Half-open times of two segments x and y that overlap, of different patients."""
    x, y = (F.col("x.b").isNull() | (F.col("y.a") < F.col("x.b"))), (F.col("y.b").isNull() | (F.col("x.a") < F.col("y.b")))
    return x & y & (F.col("x.patient_key") != F.col("y.patient_key"))


def _standing(rows: DataFrame, by: list[str], bucket: int) -> DataFrame:
    """by, at, begun, over, points: how many rows of each group began before a second, ended by it, and are just that second.

    For each second at which a row begins or ends, and one for open ends (null).  Counts run on within a bucket of time; those
    of the buckets before it are added, so no group is read whole by one task.
    """
    point = F.when(F.col("a") == F.col("b"), 1).otherwise(0)
    ends = F.inline(F.array(F.struct(F.col("a").alias("at"), F.lit(1).alias("begin"), F.lit(0).alias("end"), point.alias("points")), F.struct(F.col("b").alias("at"), F.lit(0).alias("begin"), F.lit(1).alias("end"), F.lit(0).alias("points"))))
    seconds = rows.select(*by, ends).groupBy(*by, "at").agg(*[F.sum(c).alias(c) for c in ("begin", "end", "points")]).withColumn("bucket", F.floor(F.col("at") / bucket))
    seconds = kept(seconds)
    within = Window.partitionBy(*by, "bucket").orderBy("at")
    before = within.rowsBetween(Window.unboundedPreceding, -1)
    own = seconds.select(*by, "bucket", "at", "points", F.coalesce(F.sum("begin").over(before), F.lit(0)).alias("begun"), F.sum("end").over(within).alias("over"))
    earlier = Window.partitionBy(*by).orderBy(F.col("bucket").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    sums = seconds.groupBy(*by, "bucket").agg(F.sum("begin").alias("n"), F.sum("end").alias("m"))
    sums = sums.select(*by, "bucket", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("n"), F.coalesce(F.sum("m").over(earlier), F.lit(0)).alias("m"))
    same = F.lit(True)
    for c in (*by, "bucket"):
        same = same & F.col(f"o.{c}").eqNullSafe(F.col(f"s.{c}"))
    joined = own.alias("o").join(large(sums.alias("s")), same)
    return joined.select(*[F.col(f"o.{c}") for c in by], "at", (F.col("begun") + F.col("n")).alias("begun"), (F.col("over") + F.col("m")).alias("over"), "points")


def _met(rows: DataFrame, by: list[str], bucket: int) -> DataFrame:
    """segment_id, n: rows of the same group whose times overlap with the segment's; its own is one if it has a length.

    Those that began before its end, less those that ended by its start; what is a point at a segment's only second did not
    begin before its end, but ended by its start.
    """
    known = kept(_standing(rows, by, bucket))
    side = lambda at, p: known.select(*[F.col(c).alias(f"__{p}_{c}") for c in by], F.col("at").alias(f"__{p}_at"), F.col("begun").alias(f"__{p}_begun"), F.col("over").alias(f"__{p}_over"), F.col("points").alias(f"__{p}_points"))
    alike = lambda at, p: functools.reduce(Column.__and__, [F.col(c) == F.col(f"__{p}_{c}") for c in by], F.col(at).eqNullSafe(F.col(f"__{p}_at")))
    out = rows.join(large(side("b", "e")), alike("b", "e")).join(large(side("a", "s").where("__s_at is not null")), alike("a", "s"))
    n = F.col("__e_begun") - F.col("__s_over") + F.when(F.col("a") == F.col("b"), F.col("__s_points")).otherwise(0)
    return out.select("segment_id", n.alias("n"))


def counts(segments: DataFrame, granularity: str = "ward", bucket: int = HOUR) -> DataFrame:
    """segment_id, n: how many contacts ``pairs`` has of each segment that has any, without making the pairs.

    Of the segments of its unit that overlap, all less the patient's own.  Segments that end before they start are few, as
    only corrections make them, and meet the others of their unit one by one.
    """
    rows = kept(_timed(segments, granularity))
    odd = F.coalesce(F.col("b") < F.col("a"), F.lit(False))
    even, crooked = rows.where(~odd), rows.where(odd)
    told = _met(even, ["unit"], bucket).unionByName(_met(even, ["unit", "patient_key"], bucket).withColumn("n", -F.col("n")))
    pair = crooked.alias("x").join(large(rows.alias("y")), (F.col("x.unit") == F.col("y.unit")) & _overlap())
    back = F.when(F.col("y.b") < F.col("y.a"), F.lit(None)).otherwise(F.col("y.segment_id"))
    ones = pair.select(F.explode(F.array_compact(F.array(F.col("x.segment_id"), back))).alias("segment_id"), F.lit(1).cast("long").alias("n"))
    return told.unionByName(ones).groupBy("segment_id").agg(F.sum("n").alias("n")).where("n > 0")


def in_range(segments: DataFrame, start: str, end: str, include_estimated: bool = True) -> DataFrame:
    """Segments that cut [start, end)."""
    rows = segments if include_estimated else exact_only(segments)
    return rows.where((F.col("start_ts") < F.lit(end).cast("timestamp")) & (F.col("end_ts").isNull() | (F.col("end_ts") > F.lit(start).cast("timestamp"))))


#: Seconds from the least time that is known (1 January of year 1) to 1970, and how many levels of four the tree of times has.
EPOCH, LEVELS = 62_135_596_800, 20


def _at(c: str) -> Column:
    return F.unix_timestamp(c) + EPOCH


def _nodes_of_point(at: Column) -> Column:
    """The node of each level that holds a second."""
    return F.transform(F.sequence(F.lit(0), F.lit(LEVELS)), lambda n: F.struct(n.alias("level"), F.floor(at / F.pow(F.lit(4.0), n)).cast("long").alias("node")))


def _nodes_of_span(a: Column, b: Column) -> Column:
    """The fewest nodes that make up [a, b): at each level those inside that no node above covers; at most six a level."""

    def covered(n: Column) -> tuple[Column, Column]:
        wide = F.pow(F.lit(4.0), n)
        return F.ceil(a / wide).cast("long"), F.floor(b / wide).cast("long")

    def level(n: Column) -> Column:
        low, high = covered(n)
        up, down = covered(n + 1)
        run = lambda x, y: F.when(x < y, F.sequence(x, y - 1)).otherwise(F.array().cast("array<bigint>"))
        inner = (up < down) & (n < LEVELS)
        own = F.when(inner, F.concat(run(low, 4 * up), run(4 * down, high))).otherwise(run(low, high))
        return F.transform(own, lambda x: F.struct(n.alias("level"), x.alias("node")))

    return F.flatten(F.transform(F.sequence(F.lit(0), F.lit(LEVELS)), level))


def in_ranges(segments: DataFrame, ranges: DataFrame, include_estimated: bool = True) -> DataFrame:
    """(range_id, segment_id) of the segments that cut each of many ranges [from_ts, to_ts): start < to, and end > from or open.

    Of two spans that overlap, the later start lies in the other span.  So two equi-joins find each pair once: starts of
    ranges in segments, and starts of segments inside ranges.  A span is a few nodes of a tree of times at each level, and
    a point one at each, whatever the lengths; open ends reach to the end of the tree.  Segments of no or negative length
    are compared as they stand.  Rows without a start are in none; a range without an end is open.
    """
    end = F.lit(4**LEVELS)
    rows = (segments if include_estimated else exact_only(segments)).select("segment_id", _at("start_ts").alias("a"), _at("end_ts").alias("b")).where("a is not null")
    asked = ranges.select("range_id", _at("from_ts").alias("f"), _at("to_ts").alias("t")).where("f is not null")
    fits = (F.col("t").isNull() | (F.col("a") < F.col("t"))) & (F.col("b").isNull() | (F.col("b") > F.col("f")))
    spread = lambda df, nodes: df.withColumn("n", F.explode(nodes)).select(*df.columns, "n.level", "n.node")
    inside = spread(rows.where("b is null or b > a"), _nodes_of_span(F.col("a"), F.coalesce("b", end))).join(spread(asked, _nodes_of_point(F.col("f"))), ["level", "node"])
    later = spread(asked.where("t is null or t > f + 1"), _nodes_of_span(F.col("f") + 1, F.coalesce("t", end))).join(spread(rows, _nodes_of_point(F.col("a"))), ["level", "node"])
    return inside.where(fits).select("range_id", "segment_id").unionByName(later.where(fits).select("range_id", "segment_id"))


def containing(segments: DataFrame, points: DataFrame, key: str = "patient_key") -> DataFrame:
    """``points`` (point_id, key, at) with the segment that holds each: start <= at < end; the latest start wins."""
    hit = (F.col("start_ts") <= F.col("at")) & (F.col("end_ts").isNull() | (F.col("at") < F.col("end_ts")))
    own = segments.select(F.col(key).alias("__k"), "segment_id", "start_ts", "end_ts")
    rows = points.join(own, (F.col(key) == F.col("__k")) & hit)
    return rows.groupBy("point_id", key, "at").agg(F.max_by("segment_id", F.struct("start_ts", "segment_id")).alias("segment_id"))
