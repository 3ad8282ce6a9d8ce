"""Readers of message files and intake tables, and writers of audit logs and published snapshots."""

from __future__ import annotations

import gc
import json
import tempfile
import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from caresift.functions import hl7
from caresift.operators import fhir


#: How Parquet of messages is packed: they repeat their segments and names.
CODEC = "zstd"


def shared_folder(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``, which all machines see; one of our own only in local mode, where it is unset."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named is None and context.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="spark-checkpoints-"))
    return context.getCheckpointDir()


def kept(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder once, so that what reads it several times doesn't make it anew.

    As Parquet: readers take the columns they need, and Spark knows the size.
    """
    folder = new_folder(df.sparkSession)
    df.write.parquet(folder, compression=CODEC)
    out = df.sparkSession.read.schema(df.schema).parquet(folder)
    out.kept_at = folder
    return out


def dropped(*tables: DataFrame) -> None:
    """Deletes what ``kept`` wrote of tables that nothing reads any more; of any other table, nothing."""
    for df in tables:
        if (folder := getattr(df, "kept_at", None)) is not None:
            place = df.sparkSession._jvm.org.apache.hadoop.fs.Path(folder)
            place.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(place, True)


def forget(spark: SparkSession) -> None:
    """Has the driver look for what nothing refers to any more: only then Spark deletes the files of shuffles that are done."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def new_folder(spark: SparkSession) -> str:
    """A path in the shared folder that nothing has yet."""
    return f"{shared_folder(spark)}/table-{uuid.uuid4().hex}"


def tasks(spark: SparkSession) -> int:
    """Partitions for few bytes with much work: as many as a shuffle has, which Spark would merge by their size."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)


def large(df: DataFrame) -> DataFrame:
    """A side of a join that grows with the input: never sent whole to the driver and to each executor, however small it looks.

    Spark takes a table's size from compressed files before rows are multiplied, and may be wrong by orders of magnitude.
    """
    return df.hint("merge")


def read_hl7(spark: SparkSession, folder: str) -> DataFrame:
    """file, raw, text: one message a file, named ``*.hl7``."""
    rows = spark.read.format("binaryFile").option("pathGlobFilter", "*.hl7").load(folder)
    return rows.select(F.col("path").alias("file"), F.col("content").alias("raw"), hl7.decoded(F.col("content")).alias("text"))


def read_bundles(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """(bundles, rejected files with a reason): one JSON document a file."""
    rows = spark.read.option("wholetext", True).text(folder).select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("text"))
    return fhir.parse(rows)


def read_intake(spark: SparkSession, path: str, after: int | None = None) -> DataFrame:
    """The intake table, or its rows after a cursor; the filter reaches the Parquet scan."""
    rows = spark.read.parquet(path)
    return rows if after is None else rows.where(F.col("receipt_id") > after)


def write_audit(df: DataFrame, path: str, columns: list[str]) -> None:
    """Audit records as JSON lines; only ``columns``, never a payload."""
    if {"text", "raw"} & set(columns):
        raise ValueError("audit records hold no payload")
    df.select(*columns).write.mode("append").json(path)


def append_once(df: DataFrame, path: str, batch: int, form: str = "parquet") -> None:
    """Writes ``df`` as part number ``batch`` of the table at ``path``: a batch that runs again replaces its own part."""
    own = {"compression": CODEC} if form == "parquet" else {}
    df.write.mode("overwrite").format(form).save(f"{path}/batch={batch:012d}", **own)


def read_parts(spark: SparkSession, path: str, schema: str, before: int | None = None, form: str = "parquet") -> DataFrame:
    """The parts of such a table, with their ``batch``; those before a batch only, if one is named; empty if there are none."""
    place = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/batch=*/_SUCCESS")
    found = place.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(place)
    if found is None or not len(found):
        return spark.createDataFrame([], f"{schema}, batch long")
    rows = spark.read.format(form).schema(f"{schema}, batch long").option("basePath", path).load(path)
    return rows if before is None else rows.where(F.col("batch") < before)


def append_audit(records: DataFrame, path: str, batch: int) -> None:
    """Audit records (``findings.audit_records``) as JSON lines, each batch once."""
    append_once(records.select(F.col("record").alias("value")), path, batch, "text")


def read_audit(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The audit log with the fields of ``schema``; of a receipt that several batches told, the first one's record."""
    rows = read_parts(spark, path, "value string", form="text").select(F.from_json("value", schema).alias("r"), "batch")
    first = rows.groupBy(F.col("r.receipt_id").alias("__id")).agg(F.min_by("r", "batch").alias("r"))
    return first.select("r.*")


def publish(tables: dict[str, DataFrame], root: str, version: str | None = None) -> str:
    """Writes all tables under one new version with their row counts, then moves the pointer; readers see all or none.

    Versions are numbered in the order in which they are published, whatever they are called.
    """
    spark = next(iter(tables.values())).sparkSession
    version = version or f"v{time.time_ns()}"
    counts = {}
    for name, df in tables.items():
        df.write.parquet(f"{root}/{version}/{name}")
        counts[name] = spark.read.parquet(f"{root}/{version}/{name}").count()
    last = _versions(spark, root)
    number = 1 + (last.agg(F.max("number")).first()[0] or 0) if last is not None else 1
    pointer = spark.range(1).select(F.lit(number).cast("long").alias("number"), F.lit(version).alias("version"), F.lit(json.dumps(counts, sort_keys=True)).alias("counts"))
    pointer.coalesce(1).write.mode("append").parquet(f"{root}/_versions")
    return version


def _versions(spark: SparkSession, root: str) -> DataFrame | None:
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/_versions")
    there = path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)
    return spark.read.schema("number long, version string, counts string").parquet(str(path)) if there else None


def published(spark: SparkSession, root: str) -> tuple[str, dict[str, DataFrame]]:
    """The last published version and its tables."""
    row = _versions(spark, root).orderBy(F.col("number").desc()).first()
    return row["version"], {name: spark.read.parquet(f"{root}/{row['version']}/{name}") for name in json.loads(row["counts"])}
