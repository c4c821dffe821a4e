import numpy as np
from pyspark.sql import functions as F

from riskbook.llm import quality
from tests.llm.helpers import docs_frame


def test_token_features_match_slices():
    tokens = ["abc", "ü", "repeated"]
    owner, bucket, own = quality.token_features(tokens)
    for k, t in enumerate(tokens):
        w = f"\n{t}\n"
        want = 1 + sum(max(0, len(w) - n + 1) for n in quality.SIZES)
        assert (owner == k).sum() == want
    assert quality.token_features(["abc"])[1].tolist() == bucket[owner == 0].tolist() and len(own) == 3


def test_learns_and_scores_awkward_rows(spark):
    rows = [(i, "a fine sentence of plain words " * 5 if i % 2 else "$$$ !!! ### buy buy buy " * 5, i % 2) for i in range(60)]
    model = quality.fit(spark.createDataFrame(rows, "doc_id long, text string, quality int"), F.lit(True))
    texts = [(1, "plain words of a fine sentence"), (2, "!!! buy $$$"), (3, None), (4, ""), (4, ""), (None, "plain words"), (7, "plain words " * 40_000)]
    got = [r["score"] for r in quality.score(docs_frame(spark, texts), model).collect()]
    assert got[0] > 0.5 > got[1] and got[2] == got[3] == got[4] and got[5] > 0.5 and got[6] > 0.5
    assert all(0 <= x <= 1 for x in got)


def test_no_labels(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, quality int")
    model = quality.fit(empty, F.lit(True))
    assert np.isclose(quality.score(docs_frame(spark, [(1, "x")]), model).collect()[0]["score"], 0.5)
    assert quality.score(empty, model).count() == 0


def test_held_out_accuracy(spark):
    from riskbook.llm.queries import op2_quality
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    got = op2_quality(spark, "/root/testdata/sf0.01").join(labels, "doc_id").where("held_out").toPandas()
    assert (got["predicted"] == got["quality"]).mean() > 0.95


def plain_model(rows, dim, epochs, rate, seed):
    """The trainer and its folded table by loops over features; rows: (text, label) in the order of their hashes."""
    bags = []
    for text, label in rows:
        counts, before = {}, None
        for token in text.split():
            owner, buckets, own = quality.token_features([token])
            found = buckets.tolist()
            if before is not None:
                found += quality.pair_buckets(np.array([before, own[0]]), np.array([True, False]))[1:].tolist()
            before = own[0]
            for b in found:
                counts[b] = counts.get(b, 0) + 1
        bags.append((counts, label))
    prior = np.log([sum(y == c for _, y in bags) / len(bags) for c in (0, 1)])
    rng = np.random.default_rng(seed)
    vectors = rng.uniform(-1 / dim, 1 / dim, (quality.BUCKETS, dim)).astype(np.float32).astype(float)
    layer, step = [[0.0, 0.0] for _ in range(dim)], 0
    for _ in range(epochs):
        for d in rng.permutation(len(bags)):
            now = rate * (1 - step / (epochs * len(bags)))
            step += 1
            counts, label = bags[d]
            total = sum(counts.values())
            mean = [sum(n / total * vectors[b][k] for b, n in counts.items()) for k in range(dim)]
            z = [sum(mean[k] * layer[k][c] for k in range(dim)) + prior[c] for c in (0, 1)]
            p = [np.exp(x - max(z)) for x in z]
            p = [x / sum(p) - (c == label) for c, x in enumerate(p)]
            back = [sum(layer[k][c] * p[c] for c in (0, 1)) for k in range(dim)]
            for k in range(dim):
                for c in (0, 1):
                    layer[k][c] -= now * mean[k] * p[c]
            for b, n in counts.items():
                for k in range(dim):
                    vectors[b][k] -= n / total * now * len(counts) ** 0.5 * back[k]
    return bags, vectors @ np.array(layer), prior


def test_training_and_scores_equal_plain_loops(spark):
    texts = ["a fine sentence of plain words", "$$$ buy buy now !!!", "words words words", "cheap $$$ offer now", "some plain text", "x"]
    df = spark.createDataFrame([(k, texts[k % 6], k % 2) for k in range(12)], "doc_id long, text string, quality int")
    args = {"dim": 4, "epochs": 3, "rate": 0.6, "seed": 7}
    model = quality.fit(df, F.lit(True), fit_docs=1_000, **args)
    order = df.select("text", "quality", F.xxhash64(F.lit("quality"), "doc_id").alias("h")).orderBy("h", "quality").collect()
    bags, table, prior = plain_model([(r["text"], r["quality"]) for r in order], **args)
    assert np.allclose(model.table, table, atol=1e-5) and np.allclose(model.bias, prior)
    for r, (counts, _) in zip(order, bags, strict=True):
        z = prior + sum(n * table[b] for b, n in counts.items()) / sum(counts.values())
        got = quality.score(df.where(F.col("text") == r["text"]).limit(1), model).collect()[0]["score"]
        assert abs(got - 1 / (1 + np.exp(z[0] - z[1]))) < 1e-5
