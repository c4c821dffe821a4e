"""Quality classifier: supervised subword embeddings.

Every token has hashed features: itself, its character n-grams with word boundaries, and its pair with
the token before (one feature for a repeated token). A document is the mean of its features' learned
vectors; a softmax layer turns that into class probabilities. Vectors and layer are trained together by
stochastic gradient descent in NumPy on a sample of at most about ``fit_docs`` labelled documents, drawn
by a hash of the id; their texts are taken whole. As the layer is linear, vectors and layer fold into
one table of class scores per feature: scoring adds up table entries and is one pass without a shuffle.

Defined cases: null and empty texts have no features and get the classes' share in training (0.5 each
if there was none); rows are independent; columns other than the named ones are ignored.
"""
from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskbook.llm.common import keyed_text, slices

BUCKETS = 1 << 17
SIZES = (3, 4, 5)
#: Tokens kept with their features by one Python worker.
CACHE = 300_000
_END = 10


def _bucket(h: np.ndarray) -> np.ndarray:
    h = h.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return (h >> np.uint64(47)).astype(np.int64)


def token_features(tokens: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(owner, bucket) of all word and n-gram features of the tokens, and the tokens' own hashes."""
    own = np.fromiter((zlib.crc32(t.encode("utf-8", "surrogatepass")) for t in tokens), np.int64, len(tokens))
    p = np.frombuffer(("\n" + "\n".join(tokens) + "\n").encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.uint64)
    end = p == _END
    token = np.cumsum(end) - 1
    owners, buckets = [np.arange(len(tokens))], [_bucket(own)]
    for n in SIZES:
        m = len(p) - n + 1
        if m < 1:
            continue
        inside = np.ones(m, dtype=bool)
        h = np.full(m, n, dtype=np.uint64)
        for k in range(n):
            h = h * np.uint64(1_000_003) + p[k:k + m]
            if 0 < k < n - 1:
                inside &= ~end[k:k + m]
        at = np.flatnonzero(inside)
        owners.append(token[at + 1])
        buckets.append(_bucket(h[at]))
    return np.concatenate(owners), np.concatenate(buckets), own


def pair_buckets(own: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Features of each token with the one before; -1 for the first of a text."""
    before = np.concatenate([[0], own[:-1]])
    return np.where(first, -1, np.where(own == before, _bucket(np.array([1]))[0], _bucket(own * 31 + before * 7 + 3)))


@dataclass
class Model:
    table: np.ndarray = field(repr=False)  # (BUCKETS, classes): a feature's share in the class scores
    bias: np.ndarray
    classes: list[int]


def _count_features(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        ids, counts = [], []
        for text in frame["text"]:
            tokens = text.split()
            kinds, index = np.unique(np.array(tokens, dtype=object), return_inverse=True) if tokens else ([], np.empty(0, int))
            if len(tokens):
                owner, bucket, own = token_features(list(kinds))
                n = np.bincount(index, minlength=len(kinds))
                pairs = pair_buckets(own[index], np.arange(len(tokens)) == 0)[1:]
                b = np.concatenate([bucket, pairs])
                w = np.concatenate([n[owner], np.ones(len(pairs))])
                sums = np.bincount(b, weights=w, minlength=BUCKETS)
                keys = np.flatnonzero(sums)
            else:
                keys, sums = np.empty(0, dtype=np.int64), np.zeros(BUCKETS)
            ids.append(keys.astype(np.int32).tobytes())
            counts.append(sums[keys].astype(np.float32).tobytes())
        yield pd.DataFrame({"label": frame["label"], "h": frame["h"], "ids": ids, "counts": counts})


def fit(df: DataFrame, usable: Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality",
        fit_docs: int = 2_000, dim: int = 10, epochs: int = 5, rate: float = 0.6, seed: int = 7) -> Model:
    """Model from the rows for which ``usable`` holds and whose text and label aren't null.

    The sample's feature counts come to the driver: at most about ``fit_docs`` rows.
    """
    labelled = df.where(usable & F.col(label_col).isNotNull() & F.col(text_col).isNotNull()).select(
        F.col(label_col).cast("int").alias("label"), F.col(text_col).alias("text"),
        F.xxhash64(F.lit("quality"), F.col(id_col)).alias("h"))
    total = labelled.count()
    parts = 1 << 30
    sample = labelled.where(F.pmod("h", F.lit(parts)) < min(parts, int(parts * fit_docs / max(total, 1))))
    rows = (sample.mapInPandas(_count_features, "label int, h long, ids binary, counts binary").toPandas()
            .sort_values(["h", "label"], kind="stable"))
    labels = rows["label"].to_numpy(dtype=np.int64)
    classes = sorted(set(labels.tolist()))
    if not classes:
        return Model(np.zeros((BUCKETS, 2), dtype=np.float32), np.zeros(2), [0, 1])
    docs = [(np.frombuffer(i, dtype=np.int32), np.frombuffer(c, dtype=np.float32)) for i, c in zip(rows["ids"], rows["counts"], strict=True)]
    y = np.searchsorted(classes, labels)
    prior = np.log(np.maximum(np.bincount(y, minlength=len(classes)), 1) / len(y))
    rng = np.random.default_rng(seed)
    vectors = rng.uniform(-1 / dim, 1 / dim, (BUCKETS, dim)).astype(np.float32)
    layer = np.zeros((dim, len(classes)), dtype=np.float32)
    bias = prior.copy()
    seen, steps = 0, epochs * len(docs)
    for _ in range(epochs):
        for d in rng.permutation(len(docs)):
            step = rate * (1 - seen / steps)
            seen += 1
            ids, counts = docs[d]
            if not len(ids):
                continue
            share = counts / counts.sum()
            mean = share @ vectors[ids]
            z = mean @ layer + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[y[d]] -= 1.0
            back = layer @ p.astype(np.float32)
            layer -= step * np.outer(mean, p).astype(np.float32)
            # a feature's gradient is its share of the mean; the sum of shares is 1, so scale by the features
            vectors[ids] -= np.outer(share * np.float32(step * len(ids) ** 0.5), back)
    return Model((vectors @ layer).astype(np.float32), bias, classes)


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
        sums, n_features, own = np.empty((0, width)), np.empty(0), np.empty(0, dtype=np.int64)
        for frame in frames:
            for i, j in slices(frame["text"].str.len()):
                found = [t.split() for t in frame["text"].iloc[i:j]]
                sizes = np.array([len(f) for f in found], dtype=np.int64)
                tokens = [t for f in found for t in f]
                if len(known) > CACHE:
                    known, sums, n_features, own = {}, sums[:0], n_features[:0], own[:0]
                if new := list(set(tokens).difference(known)):
                    known.update(zip(new, range(len(known), len(known) + len(new)), strict=True))
                    owner, bucket, hashes = token_features(new)
                    parts = [np.bincount(owner, weights=model.table[bucket, c], minlength=len(new)) for c in range(width)]
                    sums = np.concatenate([sums, np.stack(parts, axis=1)])
                    n_features = np.concatenate([n_features, np.bincount(owner, minlength=len(new))])
                    own = np.concatenate([own, hashes])
                at = np.fromiter(map(known.__getitem__, tokens), np.int64, len(tokens))
                row = np.repeat(np.arange(len(found)), sizes)
                first = np.concatenate([[True], row[1:] != row[:-1]])[:len(row)]
                pairs = pair_buckets(own[at], first) if len(at) else np.empty(0, dtype=np.int64)
                paired = pairs >= 0
                n = np.bincount(row, weights=n_features[at] + paired, minlength=len(found))
                z = np.zeros((len(found), width))
                for c in range(width):
                    z[:, c] = np.bincount(row, weights=sums[at, c] + np.where(paired, model.table[pairs, c], 0), minlength=len(found))
                z = z / np.maximum(n, 1)[:, None] + model.bias
                p = np.exp(z - z.max(axis=1, keepdims=True))
                p /= p.sum(axis=1, keepdims=True)
                yield pd.DataFrame({"id": frame["id"].iloc[i:j].to_numpy(), "score": p[:, target] if target is not None else 0.0})

    return docs.mapInPandas(run, f"id {id_type}, score double")
