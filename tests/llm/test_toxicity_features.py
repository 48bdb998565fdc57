import random
from itertools import islice, product

from dagwright.llm import toxicity


def test_every_feature_that_passed_has_a_weight(spark):
    rng = random.Random(1)
    toxic = ["".join(x) for x in islice(product("bcdfg", "aeiou", "klmnprs", "xz"), 320)]
    rows = []
    for i in range(3000):
        words = rng.sample(toxic, 10) if i % 3 == 0 else []
        rows.append((i, " ".join([*words, *rng.choices(["tree", "house", "river", "stone", "cloud"], k=6)]), int(i % 3 == 0)))
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int").cache()
    model = toxicity.fit(df.select("doc_id", "text"), df.select("doc_id", "toxic"))
    assert set(toxic) <= set(model.names)
    at = {n: i for i, n in enumerate(model.names)}
    assert min(model.weights[at[w]] for w in toxic) > 0
    texts = spark.createDataFrame([(" ".join(toxic[i : i + 10]) + " tree",) for i in range(0, 320, 10)] + [("tree house",)], "text string")
    assert [r.predicted for r in toxicity.toxicity(texts, model).collect()] == [1] * 32 + [0]
