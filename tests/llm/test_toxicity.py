import numpy as np
from pyspark.sql import functions as F

from riskbook.llm import toxicity
from tests.llm.helpers import docs_frame

CLEAN = ["the garden is green and the river runs past a quiet house", "many birds sing in the old trees every morning"]
BAD = ["you are a stupid idiot and a worthless moron", "what a disgusting pathetic loser he is"]


def plain_bag(text):
    """Shares of the buckets by plain loops: mean over words of the mean over a word's features."""
    shares = {}
    words = toxicity.words_of(text)
    for w in words:
        _, buckets, _ = toxicity.token_features([w])
        for b in buckets.tolist():
            shares[b] = shares.get(b, 0) + 1 / (len(words) * len(buckets))
    return shares


def plain_train(bags, labels, shares, dim, epochs, rate, seed):
    """The same descent with loops over features and dimensions."""
    n = len(shares)
    rng = np.random.default_rng(seed)
    vectors, layer = rng.uniform(-1 / dim, 1 / dim, (toxicity.BUCKETS, dim)), rng.uniform(-1 / dim, 1 / dim, (dim, n))
    bias, squares, step = [0.0] * n, {}, 0
    for epoch in range(epochs):
        for d in rng.permutation(len(bags)):
            now = rate * (1 - step / (epochs * len(bags)))
            step += 1
            mean = [sum(s * vectors[b][k] for b, s in bags[d].items()) for k in range(dim)]
            z = [sum(mean[k] * layer[k][c] for k in range(dim)) + bias[c] for c in range(n)]
            e = [np.exp(x - max(z)) for x in z]
            p = [x / sum(e) for x in e]
            if epoch >= toxicity.TRUST_FROM and p[labels[d]] < toxicity.LEAST_TRUST:
                continue
            weight = len(labels) / (n * sum(x == labels[d] for x in labels))
            p = [(x - (c == labels[d])) * weight for c, x in enumerate(p)]
            back = [sum(layer[k][c] * p[c] for c in range(n)) for k in range(dim)]
            for c in range(n):
                bias[c] -= 0.05 * now * p[c]
                for k in range(dim):
                    layer[k][c] -= 0.05 * now * mean[k] * p[c]
            for b, s in bags[d].items():
                squares[b] = squares.get(b, 1e-8) + s * s * sum(x * x for x in back)
                for k in range(dim):
                    vectors[b][k] -= now * s / squares[b] ** 0.5 * back[k]
    return vectors, layer, [b + toxicity.TO_SHARES * np.log(s * n) for b, s in zip(bias, shares, strict=True)]


def test_bags_equal_plain_loops():
    texts = ["one two two THREE", "", "É_1 é_1 日本語 a", "word " * 500 + "other"]
    for text, (at, share) in zip(texts, toxicity.text_bags(texts), strict=True):
        want = plain_bag(text)
        assert at.tolist() == sorted(want) and np.allclose(share, [want[b] for b in sorted(want)])


def test_training_equals_plain_loops():
    texts = (CLEAN + BAD) * 2 + ["idiot"]
    labels = np.array([0, 0, 1, 1] * 2 + [0])
    args = {"dim": 3, "epochs": 5, "rate": 0.4, "seed": 5}
    vectors, layer, bias = toxicity.train(toxicity.text_bags(texts), labels, np.array([0.7, 0.3]), **args)
    v, m, b = plain_train([plain_bag(t) for t in texts], labels.tolist(), [0.7, 0.3], **args)
    assert np.allclose(vectors, v, atol=1e-6) and np.allclose(layer, m, atol=1e-6) and np.allclose(bias, b, atol=1e-6)


def labelled(spark, n=80):
    rows = [(i, (CLEAN + BAD)[i % 4] + f" n{i}", i % 4 // 2) for i in range(n)]
    return spark.createDataFrame(rows, "doc_id long, text string, toxic int")


def fitted(rows, **args):
    return toxicity.fit(rows.select("doc_id", "text"), rows.select("doc_id", "toxic"), F.lit(True), **args)


def test_scores_equal_plain_loops_and_awkward_rows_stand(spark):
    model = fitted(labelled(spark))
    texts = [(1, CLEAN[0]), (2, BAD[0]), (3, "stupidd idiots and morrons"), (4, None), (5, ""), (5, " \n.!"), (None, BAD[1]), (7, CLEAN[1] * 30_000), (8, BAD[0]), (8, BAD[0])]
    got = [r["score"] for r in toxicity.score(docs_frame(spark, texts).coalesce(1), model).collect()]
    for (_, text), x in zip(texts[:7], got, strict=False):
        z = model.bias + sum(s * model.table[b].astype(float) for b, s in plain_bag(text or "").items())
        assert abs(x - 1 / (1 + np.exp(z[0] - z[1]))) < 1e-6
    assert got[0] < 0.5 < got[1] and got[2] > 0.5 and got[3] == got[4] == got[5] and got[6] > 0.5 and got[7] < 0.5 and got[8] == got[9]


def test_fit_keeps_to_its_bound_and_draws_classes_alike(spark, monkeypatch):
    drawn = []
    train = toxicity.train
    monkeypatch.setattr(toxicity, "train", lambda texts, labels, *a, **b: drawn.append(np.bincount(labels)) or train(texts, labels, *a, **b))
    rows = labelled(spark, 4000).unionByName(labelled(spark, 4000).where("toxic = 0").withColumn("doc_id", F.col("doc_id") + 10_000))
    fitted(rows, fit_docs=200, epochs=1)
    assert all(50 < n < 160 for n in drawn[0])


def test_no_labels(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, toxic int")
    model = fitted(empty)
    assert toxicity.score(docs_frame(spark, [(1, "x")]), model).collect()[0]["score"] == 0.5
    assert toxicity.score(empty, model).count() == 0


def test_held_out_accuracy(spark):
    from riskbook.llm.queries import op12_toxicity
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    got = op12_toxicity(spark, "/root/testdata/sf0.01").join(labels, "doc_id").where("held_out").toPandas()
    assert (got["predicted"] == got["toxic"]).mean() > 0.8
