import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from caresift.llm import packing
from caresift.llm._support import documents


def test_added_token_like_the_plain_call(spark):
    texts = ["a<|endoftext|> b", "<|endoftext|>", "x  <|endoftext|><|endoftext|>\n\n  y <|endoftext", "é" * 30 + "<|endoftext|>é", "none", None]
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {x["doc_id"]: (x["length"], x["ids_crc32"]) for x in packing.cut_pieces(df, public_tokenizers.path("byte_bpe_50k.tiktoken"), 1024, 2, added=True).collect()}
    for key, text in enumerate(texts):
        ids = np.array([*library.encode(text or "", add_special_tokens=False).ids, 2], "<u4")
        assert got[key] == (len(ids), zlib.crc32(ids.tobytes()))


def test_query_and_pipeline_score_three_demands(spark, sf_dir):
    docs, path = documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.tiktoken")
    placed = lambda df: {(x["doc_id"], x["piece"]): (x["sequence_id"], x["offset"]) for x in df.collect()}
    want = placed(packing.pack_documents(docs, path, packing.FULL, added=True))
    one = placed(packing.pack_documents(docs, path, packing.Capacity(), added=True))
    assert None not in (packing.FULL.documents, packing.FULL.attention) and want != one
    assert placed(packing.query(spark, sf_dir)) == want == placed(corpus_pipeline.pack(spark, docs, sf_dir))
    assert len({s for s, _ in want.values()}) <= len({s for s, _ in one.values()})


def test_other_demands_cost_no_sequence():
    """Against tokens alone, and against the fewest sequences that any packing of a few pieces takes."""
    r = random.Random(9)
    for _ in range(30):
        counts = Counter(r.choices(range(1, 1025), k=r.randint(1, 400)))
        own, alone = packing.plan(counts, packing.FULL), packing.plan(counts, packing.Capacity())
        assert packing.sequences(own) <= packing.sequences(alone)
        fill = Counter()
        for length, start, end, first, offset in own:
            for i in range(end - start):
                assert fill[first + i] == offset
                fill[first + i] += length
        assert max(fill.values()) <= 1024 and sorted(fill) == list(range(packing.sequences(own))) and sum(fill.values()) == sum(k * v for k, v in counts.items())

    def fewest(sizes):
        best = len(sizes)

        def go(i, bins):
            nonlocal best
            if len(bins) >= best:
                return
            if i == len(sizes):
                best = len(bins)
                return
            for j in range(len(bins)):
                if bins[j] + sizes[i] <= 1024 and bins[j] not in bins[:j]:
                    go(i + 1, [*bins[:j], bins[j] + sizes[i], *bins[j + 1 :]])
            go(i + 1, [*bins, sizes[i]])

        go(0, [])
        return best

    for _ in range(40):
        sizes = sorted(r.choices(range(100, 900), k=9), reverse=True)
        assert packing.sequences(packing.plan(Counter(sizes), packing.FULL)) <= fewest(sizes) + 1
