"""The pipeline's stages, one after the other, against what they must do to a small corpus."""

import random
from collections import Counter

import corpus_pipeline as cp
from geoloom.llm import tokens


def test_stages(spark, tmp_path):
    r = random.Random(1)
    word = lambda: "".join(r.choice(["ta", "ri", "mo", "sel"]) for _ in range(3))
    text = lambda n: " ".join(word() for _ in range(n)) + "."
    good = [text(80) for _ in range(40)]
    bad = [" ".join(word().upper() + "!!" for _ in range(60)) for _ in range(20)]
    rows = [(i, t, "en", f"s{i % 3}", len(t)) for i, t in enumerate(good + bad)]
    rows += [(100, good[3], "en", "s0", 1), (101, good[4] + " x@y.zz", "en", "s1", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, int(i < 40), 0) for i in range(60)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    kept = []
    for k, (_, stage) in enumerate(cp.STAGES):
        out = stage(spark, docs, str(tmp_path))
        if k < 4:
            assert out.columns == docs.columns
        out.write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        kept.append(docs.collect())
    assert {x.doc_id for x in kept[0]} == {*range(40), 100, 101}
    assert {x.doc_id for x in kept[1]} == set(range(40))
    assert [(x.doc_id, x.text, x.n_chars) for x in sorted(kept[2])] == [(i, t, len(t)) for i, t in enumerate(good)]
    assert {x.doc_id for x in kept[3]} <= set(range(40)) and max(Counter(x.doc_id for x in kept[3]).values()) <= 3
    total = sum(80 for _ in good)
    by = Counter()
    for x in kept[3]:
        by[x.source] += 80
    for s, w in (("s0", 1), ("s1", 2), ("s2", 3)):
        assert abs(by[s] - total * w / 6) <= 80
    import public_tokenizers

    encode = tokens.Encoder(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    assert sum(x.length for x in kept[4]) == sum(len(encode(x.text)) + 1 for x in kept[3])
    fill = Counter()
    for x in kept[4]:
        fill[x.sequence_id] += x.length
    assert max(fill.values()) <= 1024
