"""Toxicity: subword-bag embeddings averaged into a linear softmax.

A word is a bag of hashed features: itself, and its character n-grams of 3 to 5 with marks for its ends.
Its vector is the mean of its features' learned vectors, so a misspelling never seen shares most of its
n-grams with the word it comes from. A text is the mean of its words; a linear softmax layer makes class
probabilities of it. Vectors and layer are trained together in NumPy by stochastic gradient descent with
a step size a feature (Adagrad), on at most about ``fit_docs`` labelled texts, drawn by a hash of the id
and taken whole. Classes are drawn and weighted alike, so a rare class is not outvoted; the bias then
goes a part of the way back to the shares of the labels. Features that fewer than ``least_texts`` texts
have don't take part, and after some epochs texts whose label the model finds very unlikely are passed
over, so wrong labels aren't learned by heart. As the layer is linear, a word's share in the class scores
is one number a class: scoring looks words up in the folded table and is one pass without a shuffle.

Defined cases: words are runs of letters, digits and underscores, in lower case; null and empty texts and
texts without words get the scores of the bias alone (0.5 without labels); repeated rows are independent;
a text of any length is taken whole; columns other than the named ones are ignored.
"""
from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskbook.llm.common import keyed_text, slices
from riskbook.llm.quality import BUCKETS, token_features

#: How far the bias returns from even shares of the classes to those of the labels.
TO_SHARES = 0.25
#: From this epoch on, texts whose label has a smaller probability than this don't move the model.
TRUST_FROM, LEAST_TRUST = 3, 0.15
#: Words kept with their scores by one Python worker.
CACHE = 400_000
_WORD = re.compile(r"\w+")


def words_of(text: str) -> list[str]:
    return _WORD.findall(text.lower())


@dataclass
class Model:
    table: np.ndarray = field(repr=False)  # (BUCKETS, classes): a feature's share in a word's class scores
    bias: np.ndarray
    classes: list[int]


def word_scores(model: Model, words: list[str]) -> np.ndarray:
    """(words, classes): the mean of each word's features in the folded table."""
    owner, bucket, _ = token_features(words)
    sums = [np.bincount(owner, weights=model.table[bucket, c], minlength=len(words)) for c in range(len(model.classes))]
    return np.stack(sums, axis=1) / np.bincount(owner, minlength=len(words))[:, None]


def text_bags(texts: Iterable[str]) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each text the distinct buckets of its words and their shares in its mean; shares add up to 1."""
    out = []
    for text in texts:
        kinds, n = np.unique(np.array(words_of(text), dtype=object), return_counts=True)
        if not len(kinds):
            out.append((np.empty(0, dtype=np.int64), np.empty(0)))
            continue
        owner, bucket, _ = token_features(list(kinds))
        weight = (n / (n.sum() * np.bincount(owner)))[owner]
        at, place = np.unique(bucket, return_inverse=True)
        out.append((at, np.bincount(place, weights=weight)))
    return out


def seen_in(texts: list[tuple[np.ndarray, np.ndarray]], least: int) -> np.ndarray:
    """Whether at least ``least`` texts have a bucket."""
    return np.bincount(np.concatenate([a for a, _ in texts] or [np.empty(0, dtype=np.int64)]), minlength=BUCKETS) >= least


def train(texts: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, shares: np.ndarray, dim: int = 8,
          epochs: int = 8, rate: float = 0.5, seed: int = 11) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(vectors, layer, bias) by descent on the weighted log loss, one text a step, the steps shrinking to
    0. ``shares``: those of the classes among all labels."""
    n_classes = len(shares)
    rng = np.random.default_rng(seed)
    vectors = rng.uniform(-1 / dim, 1 / dim, (BUCKETS, dim))
    layer = rng.uniform(-1 / dim, 1 / dim, (dim, n_classes))
    bias = np.zeros(n_classes)
    squares = np.full(BUCKETS, 1e-8)
    weights = len(labels) / (n_classes * np.maximum(np.bincount(labels, minlength=n_classes), 1))
    step, steps = 0, epochs * len(texts)
    for epoch in range(epochs):
        for d in rng.permutation(len(texts)):
            at, share = texts[d]
            now = rate * (1 - step / steps)
            step += 1
            mean = share @ vectors[at]
            z = mean @ layer + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            if epoch >= TRUST_FROM and p[labels[d]] < LEAST_TRUST:
                continue
            p[labels[d]] -= 1.0
            p *= weights[labels[d]]
            back = layer @ p
            layer -= 0.05 * now * np.outer(mean, p)
            bias -= 0.05 * now * p
            squares[at] += share ** 2 * (back @ back)
            vectors[at] -= np.outer(now * share / np.sqrt(squares[at]), back)
    return vectors, layer, bias + TO_SHARES * np.log(shares * n_classes)


def _sampled(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        found = text_bags(frame["text"])
        yield pd.DataFrame({"label": frame["label"], "h": frame["h"], "at": [a.astype(np.int32).tobytes() for a, _ in found],
                            "shares": [s.astype(np.float32).tobytes() for _, s in found]})


def fit(df: DataFrame, labels: DataFrame, usable: Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
        fit_docs: int = 2_400, least_texts: int = 10, **training) -> Model:
    """Model from the labels for which ``usable`` holds and whose id and label aren't null, and their texts.

    Labels are drawn before texts are joined to them, so the join's small side has at most about
    ``fit_docs`` rows, as many of each class where there are so many; their features are all that the
    driver receives. The classes' shares are counted over all usable labels.
    """
    given = labels.where(usable & F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).select(
        F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label"), F.xxhash64(F.lit("toxicity"), F.col(id_col)).alias("h"))
    counts = {r["label"]: r["count"] for r in given.groupBy("label").count().collect()}
    classes = sorted(counts)
    if not classes:
        return Model(np.zeros((BUCKETS, 2), dtype=np.float32), np.zeros(2), [0, 1])
    parts = 1 << 30
    limit = F.lit(0)
    for c in classes:
        limit = F.when(F.col("label") == c, F.lit(min(parts, int(parts * fit_docs / (len(classes) * counts[c]))))).otherwise(limit)
    drawn = given.where(F.pmod("h", F.lit(parts)) < limit)
    texts = df.where(F.col(text_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    sample = texts.join(F.broadcast(drawn), "id").select("label", "text", "h")
    rows = (sample.mapInPandas(_sampled, "label int, h long, at binary, shares binary").toPandas()
            .sort_values(["h", "label"], kind="stable"))
    texts = [(np.frombuffer(a, dtype=np.int32), np.frombuffer(s, dtype=np.float32).astype(np.float64)) for a, s in zip(rows["at"], rows["shares"], strict=True)]
    total = np.array([counts[c] for c in classes], dtype=np.float64)
    labels = np.searchsorted(classes, rows["label"].to_numpy(dtype=np.int64))
    often = seen_in(texts, min(least_texts, 1 + len(texts) // 100))
    texts = [(a[often[a]], s[often[a]]) for a, s in texts]
    vectors, layer, bias = train(texts, labels, total / total.sum(), **training)
    return Model((vectors @ layer * often[:, None]).astype(np.float32), bias, classes)


def score(df: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", positive: int = 1) -> DataFrame:
    """(id, score) for each row of ``df``: the probability of the class ``positive``."""
    shared = df.sparkSession.sparkContext.broadcast(model)
    docs = keyed_text(df, id_col, text_col)
    id_type = docs.schema["id"].dataType.simpleString()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = shared.value
        width = len(model.classes)
        target = model.classes.index(positive) if positive in model.classes else None
        known: dict[str, int] = {}
        scores = np.empty((0, width))
        for frame in frames:
            for i, j in slices(frame["text"].str.len()):
                found = [words_of(t) for t in frame["text"].iloc[i:j]]
                sizes = np.array([len(f) for f in found], dtype=np.int64)
                words = [w for f in found for w in f]
                if len(known) > CACHE:
                    known, scores = {}, scores[:0]
                if new := list(set(words).difference(known)):
                    known.update(zip(new, range(len(known), len(known) + len(new)), strict=True))
                    scores = np.concatenate([scores, word_scores(model, new)])
                at = np.fromiter(map(known.__getitem__, words), np.int64, len(words))
                owner = np.repeat(np.arange(len(found)), sizes)
                z = np.stack([np.bincount(owner, weights=scores[at, c], minlength=len(found)) for c in range(width)], axis=1)
                z = z / np.maximum(sizes, 1)[:, None] + model.bias
                p = np.exp(z - z.max(axis=1, keepdims=True))
                p /= p.sum(axis=1, keepdims=True)
                yield pd.DataFrame({"id": frame["id"].iloc[i:j].to_numpy(), "score": p[:, target] if target is not None else 0.0})

    return docs.mapInPandas(run, f"id {id_type}, score double")
