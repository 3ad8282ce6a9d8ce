import corpus_pipeline
from caresift.llm import ngram_join, quality, secret_scan, suffix_repeats


def test_every_stage_works_on_what_the_one_before_kept(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    names = docs.columns
    stages = dict(corpus_pipeline.STAGES)
    good = stages["quality classifier"](spark, docs, sf_dir).cache()
    model = quality.fit(quality.sample(spark.read.parquet(f"{sf_dir}/labels.parquet"), docs))
    want = {x["doc_id"] for x in quality.score(docs, model).collect() if x["score"] >= 0.3}
    assert {x["doc_id"] for x in good.collect()} == want and good.columns == names

    once = stages["n-gram Jaccard join"](spark, good, sf_dir).cache()
    groups = {x["doc_id"]: x["component_id"] for x in ngram_join.join_texts(good, ngram_join.JoinConfig(5, 80)).collect()}
    assert {x["doc_id"] for x in once.collect()} == {k for k, v in groups.items() if k == v} and once.columns == names

    cut = stages["suffix-array dedup"](spark, once, sf_dir).cache()
    kept = {x["doc_id"]: suffix_repeats.kept_of(x["text"].encode(), x["spans"], x["copy"])[0].decode("utf-8", "ignore") for x in suffix_repeats.removed_spans(once).collect()}
    assert {x["doc_id"]: x["text"] for x in cut.collect()} == kept and all(x["n_chars"] == len(x["text"]) for x in cut.collect()) and cut.columns == names

    hidden = stages["secret scans"](spark, cut, sf_dir).cache()
    assert not any(secret_scan.base_spans(x["text"]) for x in hidden.collect()) and hidden.columns == names and hidden.count() == cut.count()

    packed = stages["best-fit packing"](spark, hidden, sf_dir)
    assert {x["doc_id"] for x in packed.select("doc_id").distinct().collect()} == {x["doc_id"] for x in hidden.collect()}


def test_nulls_and_repeats(spark, sf_dir):
    docs = spark.createDataFrame([(1, "a b c d e f g", "en", "s", 13), (1, "a b c d e f g", "en", "s", 13), (2, "A b c d e f g", "en", "s", 13), (None, None, None, None, None), (3, "", "en", "s", 0)], "doc_id long, text string, lang string, source string, n_chars long")
    kept = corpus_pipeline.keep_one_of_each(spark, docs, sf_dir).collect()
    assert sorted(str(x["doc_id"]) for x in kept) == ["1", "3", "None"]
    good = corpus_pipeline.keep_good(spark, docs, sf_dir)
    assert good.columns == docs.columns and good.where("doc_id = 1").count() in (0, 2) and corpus_pipeline.keep_good(spark, docs.limit(0), sf_dir).count() == 0
    for _, stage in corpus_pipeline.STAGES[2:]:
        assert stage(spark, docs, sf_dir).count() >= 5
        assert stage(spark, docs.limit(0), sf_dir).count() == 0


def test_texts_are_not_sorted_to_drop_copies(spark, sf_dir, monkeypatch):
    """Whether the lost ids are few, those that stay, or neither: the same rows, without a merge join of the texts."""
    words = lambda n: " ".join(f"w{n}x{i}" for i in range(9))
    docs = spark.createDataFrame([(i, words(i % 40), "en", "s", 1) for i in range(120)], "doc_id long, text string, lang string, source string, n_chars long")
    for most, join in ((1000, "LeftAnti"), (60, "LeftSemi"), (10, "ShuffledHashJoin")):
        monkeypatch.setattr(corpus_pipeline, "BROADCAST_ROWS", most)
        kept = corpus_pipeline.keep_one_of_each(spark, docs, sf_dir)
        plan = kept._jdf.queryExecution().sparkPlan().toString()
        assert {x["doc_id"] for x in kept.collect()} == set(range(40)) and join in plan and "SortMergeJoin" not in plan
