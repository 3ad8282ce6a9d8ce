import corpus_pipeline

KIND = "doc_id long, text string, lang string, source string, n_chars long"


def test_clean_text_of_a_repeated_id_and_copies_without_ids(spark, sf_dir):
    first, clean, alone, copied = (" ".join(f"{w}{i}" for i in range(40)) for w in ("first", "clean", "alone", "copied"))
    said = [(1, first), (5, first + " more"), (5, clean), (5, clean), (5, clean.upper()), (6, alone), (6, alone + " more"), (7, ""), (7, ""), (8, None), (None, first), (None, copied), (None, copied), (None, copied + " more"), (None, None), (9, "one document beside them all")]
    docs = spark.createDataFrame([(k, t, "en", "s", len(t or "")) for k, t in said], KIND).repartition(5)
    kept = [(x["doc_id"], x["text"]) for x in corpus_pipeline.keep_one_of_each(spark, docs, sf_dir).collect()]
    start = sorted((str(k), (t or "").lower().split(" ")[0]) for k, t in kept)
    assert start == sorted([("1", "first0"), ("5", "clean0"), ("6", "alone0"), ("7", ""), ("7", ""), ("8", ""), ("9", "one"), ("None", "copied0"), ("None", "")])
    assert corpus_pipeline.keep_one_of_each(spark, docs, sf_dir).columns == docs.columns and (1, first) in kept
