"""Sampling, splitting and ordering.

All row selection is hash-based on the policy key, so it is repeatable, needs no
global sort and is unbiased per stratum. ``seeded_sample`` is a TakeOrdered (top-n
per partition, then a merge of n rows per partition): the limit is the feature.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskbook.functions.columns import hash_uniform

SPLIT_SALT = "split"
FOLD_SALT = "fold"


def seeded_sample(df: DataFrame, n: int, salt: str = "42", key: str = "policy_id") -> DataFrame:
    """O2: n rows without replacement, repeatable: the n smallest md5(key || salt).

    The first 8 hex digits of the digest, read as a uniform u in [0, 1), order rows
    exactly as the digest string does up to ties. Rows with u below a threshold a few
    standard deviations above n / N are kept (one filtered count; the threshold widens
    until at least n rows pass), and only those ~n candidates are sorted. A plain
    orderBy().limit(n) would merge n rows from every partition in one task.
    """
    digest = F.md5(F.concat(F.col(key).cast("string"), F.lit(salt)))
    u = F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint") / F.lit(4294967296.0)
    total = df.count()
    if n <= 0:
        return df.limit(0)
    ordered = lambda d: d.orderBy(digest, F.col(key)).limit(n)
    if n >= total:
        return df                  # the whole set; no order is needed for a sample
    t = min(1.0, (n + 6.0 * n ** 0.5 + 64.0) / total)
    while True:
        cand = df.where(u <= F.lit(t))
        if t >= 1.0 or cand.count() >= n:
            return ordered(cand)
        t = min(1.0, t * 2.0)


def split_label(fracs: tuple[float, ...] = (0.6, 0.2, 0.2), names: tuple[str, ...] = ("train", "val", "test"),
                salt: str = SPLIT_SALT, key: str = "policy_id") -> Column:
    """Split name from a hash uniform; thresholds per row keep every stratum's
    shares unbiased (stratified in expectation) and need no shuffle."""
    u = hash_uniform(F.col(key), salt)
    edges, acc = [], 0.0
    for f in fracs[:-1]:
        acc += f
        edges.append(acc)
    expr = F.lit(names[-1])
    for e, nm in reversed(list(zip(edges, names))):
        expr = F.when(u < F.lit(float(e)), F.lit(nm)).otherwise(expr)
    return expr


def split_exact(df: DataFrame, strata: list[str], fracs: tuple[float, ...] = (0.6, 0.2, 0.2), names: tuple[str, ...] = ("train", "val", "test"),
                salt: str = SPLIT_SALT, key: str = "policy_id", narrow: int = 4096) -> DataFrame:
    """``df`` with a column ``split`` whose shares are exact to one row in every stratum.

    A stratum's rows are taken in order of a 60-bit hash of the key (ties by the key); the first
    ``floor(n (f1 + .. + fj) + 0.5)`` of n rows belong to the first j parts. The last row of each part is
    found by narrowing: rows are counted by stratum and hash range of 12 bits, the range with the wanted
    row is cut into 4,096 again until no range holds more than ``narrow`` rows, and only those rows are
    ranked. No stratum is gathered or sorted. Null strata are strata; rows need distinct keys.
    """
    from riskbook.operators.joins import join_checked
    from riskbook.session import materialize
    stratum = F.struct(*[F.col(c) for c in strata])
    h = F.conv(F.substring(F.md5(F.concat(F.col(key).cast("string"), F.lit(salt))), 1, 15), 16, 10).cast("long")
    rows = df.select(F.xxhash64(stratum).alias("g"), stratum.alias("s"), h.alias("h"), F.col(key).alias("k"))
    sums = [sum(fracs[:j + 1]) for j in range(len(fracs) - 1)]
    sizes = rows.groupBy("g", "s").agg(F.count(F.lit(1)).alias("n"))
    wanted = F.explode(F.array(*[F.struct(F.lit(j).alias("j"), F.floor(F.col("n") * lit_share + 0.5).cast("long").alias("rank")) for j, lit_share in ((j, F.lit(float(x))) for j, x in enumerate(sums))]))
    bounds = materialize(sizes.select("g", "s", wanted.alias("w")).select("g", "s", "w.j", "w.rank", F.lit(0).cast("long").alias("prefix"), F.col("w.rank").alias("left")), "split")
    open_, depth = bounds.where("rank > 0"), 0
    near = rows.withColumn("prefix", F.lit(0).cast("long"))
    on = ["g", "s", "prefix"]
    while depth < 5:  # 5 x 12 bits are the whole hash
        depth += 1
        cut = F.shiftright("h", 60 - 12 * depth)
        heads = open_.select(*on).distinct()
        near = materialize(join_checked(near, heads, on).select("g", "s", "h", "k", cut.alias("prefix"), F.col("prefix").alias("above")), "split")
        counts = near.groupBy("g", "s", "above", "prefix").agg(F.count(F.lit(1)).alias("n"))
        upto = Window.partitionBy("g", "s", "above").orderBy("prefix").rowsBetween(Window.unboundedPreceding, -1)  # 4,096 ranges at most
        counts = counts.withColumn("before", F.coalesce(F.sum("n").over(upto), F.lit(0)))
        found = (open_.withColumnRenamed("prefix", "above").join(counts, ["g", "s", "above"])
                 .where("left > before and left <= before + n"))
        open_ = materialize(found.select("g", "s", "j", "rank", "prefix", (F.col("left") - F.col("before")).alias("left"), "n"), "split")
        near = near.select("g", "s", "h", "k", "prefix")
        if (open_.agg(F.max("n")).first()[0] or 0) <= narrow:
            break
    few = join_checked(near, open_.select(*on).distinct(), on)
    ranked = few.withColumn("at", F.row_number().over(Window.partitionBy(*on).orderBy("h", "k")))
    last = open_.withColumnRenamed("left", "at").join(ranked, [*on, "at"]).select("g", "s", "j", F.struct("h", "k").alias("last"))
    pivot = last.groupBy("g", "s").agg(*[F.max(F.when(F.col("j") == j, F.col("last"))).alias(f"last{j}") for j in range(len(sums))])
    name = F.lit(names[-1])
    for j in range(len(sums) - 1, -1, -1):
        name = F.when(F.struct(F.col("_h").alias("h"), F.col(key).alias("k")) <= F.col(f"last{j}"), names[j]).otherwise(name)
    marked = join_checked(df.withColumns({"_h": h, "g": F.xxhash64(stratum), "s": stratum}), pivot, ["g", "s"], "left")
    return marked.select(*df.columns, name.alias("split"))


def split(df: DataFrame, fracs=(0.6, 0.2, 0.2), names=("train", "val", "test"), salt: str = SPLIT_SALT,
          key: str = "policy_id") -> dict:
    lab = df.withColumn("_split", split_label(fracs, names, salt, key))
    return {nm: lab.where(F.col("_split") == nm).drop("_split") for nm in names}


def fold_id(k: int = 5, salt: str = FOLD_SALT, key: str = "policy_id") -> Column:
    """K shuffled folds from a hash uniform (0 .. k-1)."""
    return F.least(F.lit(k - 1), F.floor(hash_uniform(F.col(key), salt) * F.lit(float(k))).cast("int"))


def union_train_val(train: DataFrame, val: DataFrame) -> DataFrame:
    """Stack train and validation by column name."""
    return train.unionByName(val)


def holdout_or_sample(spark, book: DataFrame, holdout_path: str | None, n: int = 20_000,
                      salt: str = "42") -> DataFrame:
    """The held-out file if present, else an n-row seeded sample of the book."""
    from riskbook.sources.io import path_exists, read_policies
    if holdout_path and path_exists(spark, holdout_path):
        return read_policies(spark, holdout_path)
    return seeded_sample(book, n, salt)
