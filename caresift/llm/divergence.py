"""How the sources of a language differ in their words, by exact products of one-hot count levels.

A term's smoothed share in a group depends on its count there alone, so two groups compare through a joint table: how many
terms have count a in the one and count b in the other.  With an indicator column for each (group, count level), zero
included, and a row for each term, all joint tables at once are the product of that matrix's transpose with the matrix.
It is taken in blocks: terms are dealt into blocks of about ``TERMS``, groups into blocks of about ``GROUPS``, and each
(term block, group block, group block) is one small product of ones and zeros, whose table is priced where it stands.
Prices add up over the term blocks.  All numbers are integers; ones and zeros are summed in 32-bit floats, exact to 2 ** 24.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from caresift.llm._support import cut, documents, give_back, small

TERMS, GROUPS = 256, 32
#: Columns of a tile of a product.
TILE = 1024
#: Counters that a task holds before it hands them on, and bytes of one text that are split at once.
COUNTERS, PIECE = 200_000, 4_000_000

#: Letters of terms: A-Z in lower case, a-z, and all bytes of code points over 127; all else separates.
_TERM = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c > 127 else 32 for c in range(256))


@dataclass(frozen=True)
class Audit:
    least_docs: int = 30  #: documents of a language that a term has to be in
    smooth: int = 5  #: added to each count
    scale: int = 1_000_000_000
    top: int = 50  #: terms told of each group


def terms(text: str) -> Iterator[list[bytes]]:
    """The terms of a text, in pieces; no term is cut."""
    data = text.encode("utf-8").translate(_TERM)
    at = 0
    while at < len(data):
        end = len(data) if at + PIECE >= len(data) else data.find(b" ", at + PIECE)
        end = len(data) if end < 0 else end
        yield data[at:end].split()
        at = end


_COUNTED = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.string()), ("n", pa.int64()), ("docs", pa.int64())])


def count_terms(df: DataFrame, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """lang, source, term, n (occurrences), docs (rows that hold it); and a row with a null term for each group.

    A null text, lang or source counts as empty.  Tasks count before anything is shuffled, and hand on what they have when
    it is ``COUNTERS`` entries.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[tuple[str, str], tuple[Counter, Counter]] = {}

        def told() -> Iterator[pa.RecordBatch]:
            for (language, group), (n, docs) in found.items():
                words = [None, *(w.decode("utf-8") for w in n)]
                yield pa.RecordBatch.from_arrays([pa.array([language] * len(words)), pa.array([group] * len(words)), pa.array(words, pa.string()), pa.array([0, *n.values()], pa.int64()), pa.array([0, *(docs[w] for w in n)], pa.int64())], schema=_COUNTED)
            found.clear()

        for batch in batches:
            held = 0
            for t, language, group in zip(*(batch.column(i) for i in range(3)), strict=True):
                n, docs = found.setdefault((language.as_py() or "", group.as_py() or ""), (Counter(), Counter()))
                before, own = len(n), set()
                for part in terms(t.as_py() or ""):
                    n.update(part)
                    own.update(part)
                docs.update(own)
                held += len(n) - before
                if held > COUNTERS:
                    yield from told()
                    held = 0
            yield from told()
            give_back()

    rows = df.select(F.col(text).alias("text"), F.col(lang).alias("lang"), F.col(source).alias("source"))
    return rows.mapInArrow(run, "lang string, source string, term string, n long, docs long").groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def share(n: Column, total: Column, kept: Column, audit: Audit) -> Column:
    """1 + floor(scale * (n + smooth) / (total + smooth * kept)), exact at any count."""
    part = lambda c: c.cast("decimal(20,0)")
    whole = F.call_function("div", part(n + audit.smooth) * F.lit(audit.scale).cast("decimal(10,0)"), part(total + audit.smooth * kept))
    return F.when(kept > 0, whole + 1)


@dataclass
class Counts:
    entries: DataFrame  #: lang, source, term, n > 0, share, lang_share; terms that are kept
    groups: DataFrame  #: lang, source, kept (terms of the lang), share0 (of a term that the group doesn't have), n_groups


def counts(df: DataFrame, text: str, lang: str, source: str, audit: Audit) -> Counts:
    found = cut(count_terms(df, text, lang, source))
    groups = found.where("term is null").select("lang", "source")
    whole = Window.partitionBy("lang", "term")  # a row for each source at most
    kept = found.where("term is not null").withColumns({"__docs": F.sum("docs").over(whole), "lang_n": F.sum("n").over(whole)}).where(F.col("__docs") >= audit.least_docs)
    kept = cut(kept.select("lang", "source", "term", "n", "lang_n"))
    langs = kept.groupBy("lang").agg(F.count_distinct("term").alias("kept"), F.sum("n").alias("lang_total"))
    sizes = groups.groupBy("lang").agg(F.count("*").alias("n_groups"))
    totals = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    rows = groups.join(totals, ["lang", "source"], "left").join(small(cut(sizes)), "lang").join(small(cut(langs)), "lang", "left").na.fill(0, ["total", "kept", "lang_total"])
    rows = cut(rows.withColumn("share0", share(F.lit(0).cast("long"), F.col("total"), F.col("kept"), audit)))
    entries = kept.join(small(rows), ["lang", "source"])
    entries = entries.select("lang", "source", "term", "n", "kept", "n_groups", share(F.col("n"), F.col("total"), F.col("kept"), audit).alias("share"), share(F.col("lang_n"), F.col("lang_total"), F.col("kept"), audit).alias("lang_share"))
    return Counts(entries, rows.select("lang", "source", "kept", "share0", "n_groups"))


def product(rows: pd.DataFrame) -> pd.DataFrame:
    """Priced joint tables of one block: source, other, value (over the block's terms), terms (that the two group blocks have).

    ``rows``: source, block (of the group), lo, hi, term, n, share; a group's share of a term it lacks is in its row of a null term.
    """
    lo, hi = int(rows["lo"].iloc[0]), int(rows["hi"].iloc[0])
    real = rows[rows["term"].notna()]
    line, words = pd.factorize(real["term"])
    names = np.array(sorted(rows["source"].unique()), object)
    group = pd.Series(np.arange(len(names)), names)
    block = rows.drop_duplicates("source").set_index("source")["block"].loc[names].to_numpy()
    own = group.loc[real["source"]].to_numpy()
    # columns: the levels over zero of each group, and then its zero level
    levels, column = np.unique(np.stack([own, real["n"].to_numpy(np.int64)], 1), axis=0, return_inverse=True) if len(real) else (np.empty((0, 2), np.int64), np.empty(0, np.int64))
    column = column.reshape(-1)
    zero = rows[rows["term"].isna()].drop_duplicates("source").set_index("source")["share"].loc[names].to_numpy(np.float64)
    zero = np.where(np.isnan(zero), 0, zero).astype(np.int64)
    price = np.zeros(len(levels), np.int64)
    price[column] = real["share"].to_numpy(np.int64)
    one = np.zeros((len(words), len(levels) + len(names)), np.float32)
    one[line, column] = 1
    one[:, len(levels) :] = 1
    one[line, len(levels) + own] = 0
    owner, price = np.append(levels[:, 0], np.arange(len(names))), np.append(price, zero)
    order = np.argsort(owner, kind="stable")
    owner, price, one = owner[order], price[order], one[:, order]
    left, right = np.flatnonzero(block[owner] == lo), np.flatnonzero(block[owner] == hi)
    out = np.zeros((len(names), len(names)), np.int64)
    for i in range(0, len(left), TILE):
        a = left[i : i + TILE]
        for j in range(0, len(right), TILE):
            b = right[j : j + TILE]
            joint = (one[:, a].T @ one[:, b]).astype(np.int64)
            cost = joint * np.abs(price[a][:, None] - price[b][None, :])
            head = np.flatnonzero(np.append(True, np.diff(owner[a]) > 0)), np.flatnonzero(np.append(True, np.diff(owner[b]) > 0))
            part = np.add.reduceat(np.add.reduceat(cost, head[0], 0), head[1], 1)
            out[np.ix_(owner[a][head[0]], owner[b][head[1]])] += part
    x, y = np.nonzero((block[:, None] == lo) & (block[None, :] == hi) & ((lo != hi) | (np.arange(len(names))[:, None] < np.arange(len(names))[None, :])))
    return pd.DataFrame({"lang": rows["lang"].iloc[0], "source": names[x], "other": names[y], "value": out[x, y], "terms": np.int64(len(words))})


def pairs(found: Counts) -> DataFrame:
    """lang, source, other, value: the summed difference of shares, for each ordered pair of sources of a language."""
    blocks = F.greatest(F.lit(1), F.ceil(F.col("n_groups") / GROUPS)).cast("int")
    parts = F.greatest(F.lit(1), F.ceil(F.col("kept") / TERMS)).cast("int")
    of = lambda c, n: F.pmod(F.xxhash64(c), n).cast("int")
    rows = found.entries.select("lang", "source", "term", "n", "share", of("term", parts).alias("part"), of("source", blocks).alias("block"), blocks.alias("blocks"))
    empty = found.groups.withColumn("part", F.explode(F.sequence(F.lit(0), parts - 1)))
    empty = empty.select("lang", "source", F.lit(None).cast("string").alias("term"), F.lit(0).cast("long").alias("n"), F.col("share0").alias("share"), "part", of("source", blocks).alias("block"), blocks.alias("blocks"))
    rows = rows.unionByName(empty).withColumn("with", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.withColumns({"lo": F.least("block", "with"), "hi": F.greatest("block", "with")}).drop("with", "blocks")
    made = rows.groupBy("lang", "part", "lo", "hi").applyInPandas(product, "lang string, source string, other string, value long, terms long")
    sums = made.groupBy("lang", "source", "other").agg(F.sum("value").alias("value"), F.sum("terms").alias("terms"))
    both = sums.select("lang", "value", "terms", F.explode(F.array(F.struct("source", "other"), F.struct(F.col("other").alias("source"), F.col("source").alias("other")))).alias("pair")).select("lang", "pair.*", "value", "terms")
    # terms that neither group block has cost the difference of the two shares of a missing term
    groups = small(found.groups)
    one = groups.select("lang", "source", "kept", F.col("share0").alias("__a"))
    two = groups.select("lang", F.col("source").alias("other"), F.col("share0").alias("__b"))
    rest = F.when(F.col("kept") > F.col("terms"), (F.col("kept") - F.col("terms")) * F.abs(F.col("__a") - F.col("__b"))).otherwise(0)
    return both.join(one, ["lang", "source"]).join(two, ["lang", "other"]).select("lang", "source", "other", (F.col("value") + rest).alias("value"))


def audit_sources(df: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", audit: Audit = Audit()) -> DataFrame:
    """lang, source, part, item, value, rank.  Part ``pair``: all other sources of the language by their summed difference;
    part ``term``: the terms with which the group most exceeds its language, the first ``audit.top``.

    Ranks go by value descending, then item ascending by UTF-8.  Null texts, langs and sources count as empty; a group
    without terms has pairs too, with all its shares those of missing terms; a language without kept terms has pairs of
    value 0; repeated rows count each; an empty table gives an empty table; other columns are not looked at.
    """
    found = counts(df, text, lang, source, audit)
    group = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")
    told = pairs(found).select("lang", "source", F.lit("pair").alias("part"), F.col("other").alias("item"), "value").withColumn("rank", F.row_number().over(group))
    over = found.entries.where("share > lang_share").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), (F.col("share") - F.col("lang_share")).alias("value"))
    best = over.withColumn("rank", F.row_number().over(group)).where(F.col("rank") <= audit.top)
    return told.unionByName(best)


def query(spark, sf_dir: str) -> DataFrame:
    return audit_sources(documents(spark, sf_dir))


ORACLE_SQL = r"""
WITH d AS (
    SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source, row_number() OVER () AS r,
        regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents
), t AS (SELECT lang, source, r, unnest(w) AS term FROM d
), kept AS (SELECT lang, term, count(*) AS lang_n FROM t GROUP BY ALL HAVING count(DISTINCT r) >= 30
), c AS (SELECT lang, source, term, count(*) AS n FROM t JOIN kept USING (lang, term) GROUP BY ALL
), l AS (SELECT lang, count(*) AS v, sum(lang_n) AS lang_total FROM kept GROUP BY lang
), g AS (
    SELECT x.lang, x.source, coalesce(v, 0) AS v, lang_total, coalesce(total, 0) AS total FROM (SELECT DISTINCT lang, source FROM d) x
    LEFT JOIN (SELECT lang, source, sum(n) AS total FROM c GROUP BY ALL) y USING (lang, source) LEFT JOIN l USING (lang)
), p AS (
    SELECT g.lang, g.source, k.term, coalesce(n, 0) AS n, 1 + (1000000000::HUGEINT * (coalesce(n, 0) + 5)) // (total + 5 * v) AS p, 1 + (1000000000::HUGEINT * (lang_n + 5)) // (lang_total + 5 * v) AS q
    FROM g JOIN kept k USING (lang) LEFT JOIN c USING (lang, source, term)
), pair AS (
    SELECT a.lang, a.source, b.source AS item, coalesce(s.f, 0)::BIGINT AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
    LEFT JOIN (SELECT x.lang, x.source AS s1, y.source AS s2, sum(abs(x.p - y.p)) AS f FROM p x JOIN p y ON x.lang = y.lang AND x.term = y.term GROUP BY ALL) s ON s.lang = a.lang AND s1 = a.source AND s2 = b.source
), term AS (SELECT lang, source, term AS item, (p - q)::BIGINT AS value FROM p WHERE n > 0 AND p > q
), told AS (SELECT *, 'pair' AS part FROM pair UNION ALL SELECT *, 'term' FROM term
), ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM told)
SELECT lang, source, part, item, value, rank::INT AS rank FROM ranked WHERE part = 'pair' OR rank <= 50
"""
