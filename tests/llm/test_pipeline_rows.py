import random

import corpus_pipeline


def test_one_row_of_each_class_of_near_copies(spark):
    rng = random.Random(2)
    words = [f"w{i}" for i in range(4000)]
    a, b, c, d = (" ".join(rng.choices(words, k=80)) for _ in range(4))
    rows = [(1, a), (2, a), (2, b), (3, c), (3, c), (None, d), (None, d), (4, d + " ")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = corpus_pipeline.drop_near_copies(spark, docs, "").collect()
    assert sorted((r.doc_id, r.text) for r in got) == sorted([(1, a), (2, b), (3, c), (4, d + " ")])
