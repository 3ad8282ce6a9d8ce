"""A quality classifier: logistic regression on hashed word n-grams, trained by follow-the-regularised-leader updates."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caresift.llm._support import documents, slices
from caresift.llm._words import U, byte_values, mix, runs_hash

#: Byte kinds: blank, letter (all bytes from 128 up too), digit, other.
_KIND = np.full(256, 3, np.uint8)
_KIND[[32, *range(9, 14)]] = 0
_KIND[[*range(65, 91), *range(97, 123), *range(128, 256)]] = 1
_KIND[48:58] = 2


@dataclass(frozen=True)
class QualityConfig:
    bits: int = 18  #: of the hashed feature space; the model has 2 ** bits weights
    grams: int = 2  #: longest word n-gram
    rows: int = 16_000  #: most labelled rows to learn from, those of the least hashes of their ids
    shards: int = 4  #: rows are dealt to so many learners, whose weights are averaged
    epochs: int = 3
    alpha: float = 0.5
    beta: float = 1.0
    l1: float = 0.002
    l2: float = 0.01
    seed: int = 17


def features(body: np.ndarray, at: np.ndarray, config: QualityConfig) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Of each text, its feature numbers and their values: counts of n-grams of words and of runs of other signs.

    A text's values have the squared sum 1.  A text without words has no features.
    """
    kind = _KIND[body]
    turn = np.zeros(len(body) + 1, bool)
    turn[at] = True
    turn[1:-1] |= kind[1:] != kind[:-1]
    edges = np.flatnonzero(turn)
    first, last = edges[:-1], edges[1:]
    said = kind[first] != 0 if len(first) else np.empty(0, bool)
    first, last = first[said], last[said]
    hashed = runs_hash(byte_values()[body], first, last, lambda i: body[first[i] : last[i]].tobytes())
    bounds = np.searchsorted(first, at)
    grams, own = [hashed], hashed
    for n in range(1, config.grams):
        own = mix(own[:-1] * U(3) + hashed[n:]) if len(own) > 1 else own[:0]
        grams.append(own)
    shift = U(64 - config.bits)
    numbered = [(g >> shift).astype(np.int64) for g in grams]
    for i, j in zip(bounds[:-1], bounds[1:], strict=True):
        found = np.concatenate([g[i : max(i, j - n)] for n, g in enumerate(numbered)])
        number, count = np.unique(found, return_counts=True)
        yield number, count / max(1.0, np.sqrt((count.astype(float) ** 2).sum()))


def learn(examples: list[tuple[np.ndarray, np.ndarray, int]], config: QualityConfig) -> np.ndarray:
    """Weights (the last is the bias) after FTRL-proximal updates, one example after another."""
    size = (1 << config.bits) + 1
    z, n = np.zeros(size), np.zeros(size)

    def weights(i: np.ndarray) -> np.ndarray:
        return np.where(np.abs(z[i]) <= config.l1, 0.0, -(z[i] - np.sign(z[i]) * config.l1) / ((config.beta + np.sqrt(n[i])) / config.alpha + config.l2))

    order = np.random.default_rng(config.seed)
    for _ in range(config.epochs):
        for k in order.permutation(len(examples)):
            number, value, label = examples[k]
            i, x = np.append(number, size - 1), np.append(value, 1.0)
            w = weights(i)
            p = 1 / (1 + np.exp(-np.clip(w @ x, -35, 35)))
            g = (p - label) * x
            z[i] += g - (np.sqrt(n[i] + g * g) - np.sqrt(n[i])) / config.alpha * w
            n[i] += g * g
    return weights(np.arange(size))


def fit(labelled: DataFrame, config: QualityConfig = QualityConfig(), key: str = "doc_id", text: str = "text", label: str = "label") -> np.ndarray:
    """The model's weights from rows with a text and a 0 or 1 label; rows with a null label are left out.

    ``labelled`` should hold a bounded number of rows: see ``QualityConfig.rows`` and ``sample``.
    Without any row the model is all zeros, and every score 0.5.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, body, at in slices(batches):
            made = list(features(body, at, config))
            columns = [batch.column(0), batch.column(2), pa.array([x.astype(np.int32).tobytes() for x, _ in made], pa.binary()), pa.array([y.astype(np.float32).tobytes() for _, y in made], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["turn", "label", "numbers", "counts"])

    def train(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["turn", "numbers"])
        out = learn([(np.frombuffer(a, np.int32), np.frombuffer(b, np.float32).astype(float), y) for a, b, y in zip(rows.numbers, rows["counts"], rows.label, strict=True)], config)
        return pd.DataFrame({"n": [len(rows)], "weights": [out.tobytes()]})

    rows = labelled.where(F.col(label).isNotNull()).select(F.xxhash64(key).alias("turn"), F.col(text).alias("text"), F.col(label).cast("int").alias("label"))
    made = rows.mapInArrow(read, "turn long, label int, numbers binary, counts binary").withColumn("shard", F.pmod("turn", F.lit(config.shards)))
    done = made.groupBy("shard").applyInPandas(train, "n long, weights binary").collect()  # ``shards`` rows of a fixed size
    if not done:
        return np.zeros((1 << config.bits) + 1)
    return np.average([np.frombuffer(r["weights"]) for r in done], axis=0, weights=[r["n"] for r in done])


def score(df: DataFrame, model: np.ndarray, config: QualityConfig = QualityConfig(), text: str = "text", out: str = "score") -> DataFrame:
    """``df`` with ``out double``, the probability of label 1; a null or empty text has the model's bias alone."""
    shared = df.sparkSession.sparkContext.broadcast(model)  # 2 ** bits numbers
    place = df.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = shared.value
        for batch, body, at in slices(batches, text):
            sums = np.array([weights[i] @ x for i, x in features(body, at, config)]) + weights[-1]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(1 / (1 + np.exp(-sums)))], [*batch.schema.names, out])

    assert place >= 0
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema if f.name != out)
    return df.drop(out).mapInArrow(run, f"{kept}, {out} double")


def held_out(key: Column) -> Column:
    return F.crc32(key.cast("string").cast("binary")) % 5 == 0


def sample(labels: DataFrame, docs: DataFrame, config: QualityConfig = QualityConfig(), label: str = "quality") -> DataFrame:
    """Labelled texts outside the held-out fold: at most ``config.rows`` label rows, those of the least hashes.

    Label rows without id or label are left out; of rows with equal hashes the lesser label comes first; rows that repeat
    count each.  A document's text counts once for each label row and each row of its id.
    """
    rows = labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & ~held_out(F.col("doc_id"))).select("doc_id", F.col(label).alias("label"))
    chosen = rows.orderBy(F.xxhash64("doc_id", F.lit(config.seed)), "label").limit(config.rows)
    return docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")


def query(spark, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = fit(sample(spark.read.parquet(f"{sf_dir}/labels.parquet"), docs))
    scored = score(docs.select("doc_id", "text"), model)
    return scored.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))
