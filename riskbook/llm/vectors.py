"""Near-duplicate vectors by Euclidean p-stable hashing.

Normalised vectors are projected on random directions; shifted by a random offset and cut into steps of
one width, ``k`` projections make a bucket number, and every vector has one in each of several tables.
Vectors of cosine c lie sqrt(2 - 2c) apart, so the share of near pairs that meet in a table is known;
``k`` grows with the logarithm of the number of vectors, to keep strangers apart, and the tables with
it, so that a pair at the threshold is missed by all of them with probability ``miss`` at most. Pairs
that meet are checked with their exact cosine in double precision.

Equal vectors of one label are one class with a size first, so copies never meet each other. Buckets
with one class are dropped before vectors are shuffled. Larger buckets are cut into blocks, and each
task compares two blocks with one matrix product: it returns a number of links for each row and edges
that span what it found, not the pairs. A pair is counted in the first table where it meets.

Defined cases: a vector that is null, empty, zero or holds null or non-finite components, and one
without label or id, links with nothing and is its own component (null without id). Rows with one id
are one node of the graph; every other row counts as a link. Vectors of different lengths never link.
"""
from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskbook.llm.components import connected
from riskbook.session import materialize


def meeting(distance: float, width: float) -> float:
    """Probability that one projection puts two points at this distance into one step."""
    r = width / distance
    return math.erf(r / math.sqrt(2)) - 2 / (math.sqrt(2 * math.pi) * r) * (1 - math.exp(-r * r / 2))


def plan(n: int, threshold: float, width: float, miss: float) -> tuple[int, int]:
    """(projections of a table, tables) for ``n`` vectors."""
    near, far = meeting(math.sqrt(max(2 - 2 * threshold, 1e-12)), width), meeting(math.sqrt(2), width)
    k = max(4, math.ceil(math.log(max(n, 2)) / -math.log(far)))
    return k, max(1, math.ceil(math.log(miss) / math.log1p(-near ** k)))


def _matrix(values: pa.Array | pa.ChunkedArray, dim: int) -> np.ndarray:
    """Rows scaled by powers of two, so that squares neither vanish nor overflow; cosines stay the same."""
    rows = np.asarray(pc.list_flatten(values), dtype=np.float64).reshape(-1, dim)
    return np.ldexp(rows, -np.frexp(np.abs(rows).max(axis=1, initial=0))[1][:, None])


def _codes(vectors: np.ndarray, k: int, tables: int, width: float, seed: int) -> np.ndarray:
    """Bucket numbers, one column a table."""
    rng = np.random.default_rng([seed, vectors.shape[1]])
    a, b = rng.standard_normal((vectors.shape[1], tables * k)), rng.uniform(0, width, tables * k)
    unit = vectors / np.sqrt(np.einsum("ij,ij->i", vectors, vectors))[:, None]
    steps = np.floor((unit @ a + b) / width).astype(np.int64).reshape(-1, tables, k)
    mult = rng.integers(1, 1 << 62, size=(tables, k), dtype=np.int64) | 1
    with np.errstate(over="ignore"):
        return (steps * mult).sum(axis=2)


def link_vectors(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", group_col: str = "label",
                 threshold: float = 0.98, width: float = 2.0, miss: float = 1e-4, seed: int = 11,
                 block: int = 1_000) -> DataFrame:
    """(id, n_links, component) for each row of ``df``.

    ``n_links``: other rows of the same group with cosine of ``threshold`` or more; ``component``: the
    smallest id reachable over links.
    """
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = df.select(F.col(id_col).alias("id"), F.col(group_col).alias("g"), F.col(vector_col).cast("array<double>").alias("v"))
    usable = (F.col("id").isNotNull() & F.col("g").isNotNull() & F.coalesce(F.size("v") > 0, F.lit(False))
              & F.coalesce(~bad, F.lit(False)) & F.exists("v", lambda x: x != 0))
    rows = rows.withColumn("v", F.when(usable, F.transform("v", lambda x: F.when(x == 0, 0.0).otherwise(x))))
    rows = rows.withColumns({"h1": F.when(F.col("v").isNotNull(), F.xxhash64(F.lit(1), "g", "v")),
                             "h2": F.when(F.col("v").isNotNull(), F.xxhash64(F.lit(2), "v", "g"))})
    good = rows.where("v is not null")
    classes = materialize(
        good.groupBy("h1", "h2").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("size"),
                                     F.first("g").alias("g"), F.first("v").alias("v")), "vec")
    n = classes.count()
    k, tables = plan(n, threshold, width, miss)

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = np.array(pc.list_value_length(batch.column("v")))
            for dim in np.unique(dims):
                part = batch.filter(pa.array(dims == dim))
                codes = _codes(_matrix(part.column("v"), int(dim)), k, tables, width, seed)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, codes.size + 1, tables, dtype=np.int32)), pa.array(codes.ravel()))
                yield pa.RecordBatch.from_arrays([part.column(c) for c in ("h1", "h2", "rep")] + [part.column("b"), lists],
                                                 ["h1", "h2", "rep", "b", "codes"])

    id_type = rows.schema["id"].dataType.simpleString()
    keyed = classes.withColumn("b", F.xxhash64("g", F.size("v")))  # buckets are apart by label and length
    members = (keyed.select("h1", "h2", "rep", "b", "v")
               .mapInArrow(hashed, f"h1 long, h2 long, rep {id_type}, b long, codes array<long>")
               .select("h1", "h2", F.posexplode("codes").alias("t", "code"), "b"))
    members = materialize(members.select("h1", "h2", "t", F.xxhash64("b", "t", "code").alias("bucket")), "vec")
    crowded = (members.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
               .select("bucket", F.ceil(F.col("n") / block).cast("int").alias("blocks")))
    met = members.join(crowded, "bucket").withColumn("mine", F.pmod(F.xxhash64("h2", "h1"), F.col("blocks")).cast("int"))
    # block i meets itself and every other block: one row for each of its pairs, first < second
    met = met.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    met = met.select("h1", "h2", "t", "bucket", F.least("mine", "other").alias("x"), F.greatest("mine", "other").alias("y"), "mine")
    work = met.join(classes.select("h1", "h2", "rep", "size", "v"), ["h1", "h2"])
    keys = ["bucket", "x", "y"]
    work = work.repartition(*keys).sortWithinPartitions(*keys)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["h1", "h2", "n", "a", "b"]
        for group in _runs(batches, keys):
            vectors = _matrix(group.column("v"), len(group.column("v")[0]))
            get = lambda c: group.column(c).to_numpy()
            mine, x, y, size, rep = get("mine"), group.column("x")[0].as_py(), group.column("y")[0].as_py(), get("size"), get("rep")
            left = np.flatnonzero(mine == x)
            right = left if x == y else np.flatnonzero(mine == y)
            if not len(left) or not len(right):
                continue
            norm = np.sqrt(np.einsum("ij,ij->i", vectors, vectors))
            near = vectors[left] @ vectors[right].T / (norm[left][:, None] * norm[right][None, :]) >= threshold
            if x == y:
                near &= ~np.eye(len(left), dtype=bool)
            if not near.any():
                continue
            table = int(group.column("t")[0].as_py())
            if table:
                codes = _codes(vectors, k, tables, width, seed)[:, :table]
                for t in range(table):  # met before: counted there
                    near &= codes[left, t][:, None] != codes[right, t][None, :]
            links = np.zeros(len(rep), dtype=np.int64)
            links[left] += near @ size[right]
            if x != y:
                links[right] += near.T @ size[left]
            has = np.flatnonzero(links)
            if not len(has):
                continue
            yield pa.RecordBatch.from_arrays(
                [pa.array(get("h1")[has]), pa.array(get("h2")[has]), pa.array(links[has]),
                 pa.nulls(len(has), group.schema.field("rep").type), pa.nulls(len(has), group.schema.field("rep").type)], names)
            a, b = _spanning(near, rep[left], rep[right])
            yield pa.RecordBatch.from_arrays(
                [pa.nulls(len(a), pa.int64())] * 3 + [pa.array(a, group.schema.field("rep").type), pa.array(b, group.schema.field("rep").type)], names)

    found = materialize(work.mapInArrow(compare, f"h1 long, h2 long, n long, a {id_type}, b {id_type}"), "vec")
    links = found.where("n is not null").groupBy("h1", "h2").agg(F.sum("n").alias("n"))
    # rows that share an id tie the classes they are in together
    split = (good.groupBy("id").agg(F.min(F.struct("h1", "h2")).alias("p"), F.max(F.struct("h1", "h2")).alias("q"))
             .where("p != q").select("id"))
    reps = classes.select("h1", "h2", "rep")
    ties = good.join(split, "id").select("id", "h1", "h2").distinct().join(reps, ["h1", "h2"]).select(F.col("id").alias("a"), F.col("rep").alias("b"))
    graph = connected(found.where("a is not null").select("a", "b").unionByName(ties))
    per_class = (classes.select("h1", "h2", "rep", "size").join(links, ["h1", "h2"], "left")
                 .join(graph.withColumnRenamed("node", "rep"), "rep", "left")
                 .select("h1", "h2", (F.col("size") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"),
                         F.coalesce("component", "rep").alias("component")))
    return (rows.select("id", "h1", "h2").join(per_class, ["h1", "h2"], "left")
            .select("id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component", "id").alias("component")))


def _runs(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """The runs of equal keys of sorted batches; a run may go over batches."""
    rest: pa.Table | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        now = pa.Table.from_batches([batch])
        now = now if rest is None else pa.concat_tables([rest, now])
        new = np.zeros(now.num_rows - 1, dtype=bool)
        for c in keys:
            v = now.column(c).to_numpy()
            new |= v[1:] != v[:-1]
        cuts = [0, *(np.flatnonzero(new) + 1).tolist()]
        for i, j in zip(cuts[:-1], cuts[1:], strict=True):
            if j - i > 1:
                yield now.slice(i, j - i).combine_chunks()
        rest = now.slice(cuts[-1])
    if rest is not None and rest.num_rows > 1:
        yield rest.combine_chunks()


def _spanning(near: np.ndarray, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges that connect what ``near`` connects, at most one for each row and column."""
    n, m = near.shape
    label = np.arange(n + m)
    while True:  # the smallest label spreads along links and through labels until nothing changes
        before = label.copy()
        down = np.where(near, label[:n][:, None], n + m).min(axis=0)
        label[n:] = np.minimum(label[n:], down)
        across = np.where(near, label[n:][None, :], n + m).min(axis=1)
        label[:n] = np.minimum(label[:n], across)
        label = label[label]
        if (label == before).all():
            break
    ids = np.concatenate([left, right])
    used = np.concatenate([near.any(axis=1), near.any(axis=0)]) & (label != np.arange(n + m))
    return ids[used], ids[label[used]]
