"""A corpus pipeline of five of the training-data operators.

Each stage takes all documents that the one before kept, and returns the columns of ``documents``; the last one returns
the packed pieces.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from caresift.llm import ngram_join, packing, quality, secret_scan, suffix_repeats
from caresift.llm._support import BROADCAST_ROWS, cut, documents, small, written

#: Documents with a lower score go.
LEAST_QUALITY = 0.3


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Quality classifier: fitted on the labels of documents outside the held-out fold; those it rejects go.

    A null or empty text is scored by the bias alone; rows of null or repeated ids are judged each for itself.
    """
    model = quality.fit(quality.sample(spark.read.parquet(f"{sf_dir}/labels.parquet"), docs))
    return quality.score(docs, model, out="__score").where(F.col("__score") >= LEAST_QUALITY).drop("__score")


def _without(docs: DataFrame, lost: DataFrame, found: DataFrame) -> DataFrame:
    """``docs``, of ids that come once, without the ids of ``lost``.  Those or the ids that stay go to the texts, as far as
    either are few; else texts are dealt by their id, and not sorted."""
    if lost.count() <= BROADCAST_ROWS:
        return docs.join(F.broadcast(lost), "doc_id", "left_anti")
    stay = cut(found.where("doc_id = component_id").select("doc_id").distinct())
    return docs.join(F.broadcast(stay), "doc_id", "left_semi") if stay.count() <= BROADCAST_ROWS else docs.join(lost.hint("shuffle_hash"), "doc_id", "left_anti")


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """N-gram Jaccard join (five words, 0.8): of each group that links join, the document of the least id stays.

    Rows of one id are told apart by their texts; where all ids of a group are missing, one of its rows stays.  Texts without
    words link with nothing and stay.
    """
    config = ngram_join.JoinConfig(words=5, percent=80)
    found = cut(ngram_join.grouped(docs, config))
    lost = cut(found.where("doc_id <> component_id").select("doc_id").distinct())
    again = cut(found.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").select("doc_id"))
    if not again.take(1) and not found.where("doc_id is null").take(1):
        return _without(docs, lost, found).select(docs.columns)
    again = small(again)
    plain = _without(docs.where("doc_id is not null").join(again, "doc_id", "left_anti"), lost, found).select(docs.columns)
    odd = lambda df: df.where("doc_id is null").unionByName(df.join(again, "doc_id", "left_semi").select(df.columns))
    first = odd(found).where("root is not null and doc_id <=> component_id").groupBy("root").agg(F.first("doc_id").alias("__id"), F.min("node").alias("__first"))
    rows = ngram_join.with_nodes(odd(docs), config, out="__node")
    one = rows.join(small(cut(first)), (F.col("__node") == F.col("__first")) & F.col("doc_id").eqNullSafe(F.col("__id")), "left_semi")
    others = [c for c in docs.columns if c != "text"]
    one = one.groupBy("__node").agg(F.min(F.struct("text", *others)).alias("__row")).select(*(F.col(f"__row.{c}").alias(c) for c in docs.columns))
    return plain.unionByName(one).unionByName(rows.where("__node is null").select(docs.columns))


def drop_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Suffix-array dedup: bytes of 100-byte strings that start earlier are cut out of the texts.

    A null text becomes empty; no row goes; null ids come first, and repeats of a row are cut but for one.
    """
    return suffix_repeats.drop_repeats(docs).withColumn("n_chars", F.length("text").cast("long")).select(docs.columns)


def hide_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secret scans: every span found is replaced by a mark; a null text stays null, with no length."""
    return secret_scan.redact(docs).withColumn("n_chars", F.length("text").cast("long")).select(docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Best-fit packing into sequences of at most 1024 tokens; a null text is empty, and every row is placed, repeats each for itself."""
    import public_tokenizers

    return packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), packing.FULL, added=True)


STAGES = [
    ("quality classifier", keep_good),
    ("n-gram Jaccard join", keep_one_of_each),
    ("suffix-array dedup", drop_repeated_passages),
    ("secret scans", hide_secrets),
    ("best-fit packing", pack),
]

#: SQL can express neither the classifier nor the packing.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed pieces.  Each stage's table is deleted when the next one's is there; the last one's stays for the packing."""
    docs = documents(spark, sf_dir)
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), instead_of=docs)
    return STAGES[-1][1](spark, docs, sf_dir)
