"""N-gram Jaccard self-join with PartEnum signatures.

A text's set is its distinct word shingles, hashed to 64 bits. Sets are put into bands by size, and each
band cuts the hashed domain into as many partitions as its sets need: sets of Jaccard similarity t or
more differ in at most H = (|A| + |B|)(1 - t)/(1 + t) elements, so at most H partitions differ. A
signature is a band, a partition and the elements in it. The subsets to enumerate are single
partitions (the second level of the scheme with no error left), and empty ones are never used: if A
has more than H partitions with elements, one of them is the same in B. Under any order of all
signatures, two such sets even share one among the first H + 1 of each, so only those are made; a band
also makes them for sets of the band below that can have a partner in it.

The order puts rare signatures first. Signatures that repeat within an input split are counted, and
the ``heavy`` most frequent ones of all come last, by count; among the others those of more elements
come first, since fewer sets share them by chance. The order decides the work, never the result. A
partition has about MEAN elements of a band's largest sets. A set with too few partitions for the argument also makes one signature an element: two such
sets share an element.

Texts with equal sets are one class first. Signature groups link their members to one of them; after
that, only members of different components are compared, a pair not again where one of the last
EARLIER groups of either has both. Before texts are fetched
for a pair, the bitmaps of its sets bound what they can have in common; then the sets are compared
exactly. No link between different components can be missed.

Defined cases: null texts and texts without words have the empty set and link with nothing; a text of
fewer than ``k`` words is one shingle; rows without an id link with nothing; rows that share an id are
one node; repeated rows are one class; other columns are ignored.
"""
from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskbook.llm.common import keyed_text, slices
from riskbook.llm.components import connected
from riskbook.session import materialize

_U = np.uint64
_NONE = np.empty(0, dtype=np.uint64)
#: Characters handled at once: bounds the memory of a task.
SLICE = 500_000
#: Signatures that a worker holds before it counts them: 8 bytes each, and as much again to sort them.
HELD = 1_500_000
#: Elements in a partition of a band's largest sets. Beyond 1 / (2 (1 - t) / (1 + t)), 3.5 for t = 0.75, such a set
#: has no more partitions than may differ, and needs a signature an element.
MEAN = 3
#: Groups before a group in which a pair is looked for.
EARLIER = 4


def _mix(h: np.ndarray, seed: int) -> np.ndarray:
    """64-bit finaliser; another seed gives another function."""
    h = (h + _U(seed * 0x9E3779B97F4A7C15 & (1 << 64) - 1)) * _U(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> _U(33))) * _U(0xC4CEB9FE1A85EC53)
    return h ^ (h >> _U(29))


_BYTE = _mix(np.arange(256, dtype=np.uint64), 8)          # a random number for each byte
_SPACE = np.isin(np.arange(256), [32, *range(9, 14)])
_BASE, _BACK = 0x9DDFEA08EB382D69, pow(0x9DDFEA08EB382D69, -1, 1 << 64)


def _powers(base: int, n: int) -> np.ndarray:
    return np.concatenate([[_U(1)], np.cumprod(np.full(max(n - 1, 0), base, dtype=np.uint64))])[:n]


def shingle_sets(texts: list[str], k: int) -> tuple[np.ndarray, np.ndarray]:
    """(number of the text, hash) of every distinct shingle, sorted by both.

    Word hashes are differences of one running sum over all bytes, brought to the same power.
    """
    raw = b"\n".join(t.encode() for t in texts).lower() + b"\n"  # bytes: ASCII letters to lower case
    c = np.frombuffer(raw, dtype=np.uint8)
    space = _SPACE[c]
    before = np.concatenate([[True], space[:-1]])
    first, behind = np.flatnonzero(~space & before), np.flatnonzero(space & ~before)
    if not len(first):
        return np.empty(0, dtype=np.int64), np.empty(0, dtype=np.uint64)
    run = np.concatenate([[_U(0)], np.cumsum(_BYTE[c] * _powers(_BASE, len(c)), dtype=np.uint64)])
    words = _mix((run[behind] - run[first]) * _powers(_BACK, len(c))[first], 9)
    starts = np.cumsum([0, *(len(t.encode()) + 1 for t in texts)])
    row = np.searchsorted(starts, first, side="right") - 1
    size = np.bincount(row, minlength=len(texts))
    whole = np.flatnonzero((row[:len(row) - k + 1] == row[k - 1:])) if len(row) >= k else np.empty(0, dtype=np.int64)
    h = np.full(len(whole), k, dtype=np.uint64)
    for i in range(k):
        h = _mix(h ^ words[whole + i], 10)
    at, least = np.cumsum(size) - size, []
    for r in np.flatnonzero((size > 0) & (size < k)):  # few words: one shingle, with their number
        g = np.array([size[r]], dtype=np.uint64)
        for w in words[at[r]:at[r] + size[r]]:
            g = _mix(g ^ w, 10)
        least.append((r, g[0]))
    rows = np.concatenate([row[whole], np.array([r for r, _ in least], dtype=np.int64)])
    h = np.concatenate([h, np.array([g for _, g in least], dtype=np.uint64)])
    order = np.lexsort((h, rows))
    rows, h = rows[order], h[order]
    new = np.concatenate([[True], (rows[1:] != rows[:-1]) | (h[1:] != h[:-1])])[:len(h)]
    return rows[new], h[new]


def set_hashes(rows: np.ndarray, h: np.ndarray, n: int) -> np.ndarray:
    """128 bits that stand for the set of each of ``n`` texts, as two signed numbers (0 if empty)."""
    out = np.zeros((n, 2), dtype=np.uint64)
    if len(rows):
        first = np.flatnonzero(np.concatenate([[True], rows[1:] != rows[:-1]]))
        out[rows[first], 0] = np.add.reduceat(_mix(h, 2), first)
        out[rows[first], 1] = np.bitwise_xor.reduceat(_mix(h, 3), first)
    return out.view(np.int64)


def bitmaps(rows: np.ndarray, h: np.ndarray, n: int) -> pa.Array:
    """A bitmap of each set as a list of 64-bit words: element e sets bit (hash mod length). The
    length is the power of two from 4 bits an element, 64 at least, so that halves can be laid over
    each other to compare with a shorter one."""
    size = np.bincount(rows, minlength=n)
    words = np.where(size > 0, 1 << np.ceil(np.log2(np.maximum(4 * size / 64, 1))).astype(np.int64), 0)
    start = np.concatenate([[0], np.cumsum(words)])
    bit = (_mix(h, 13) & (words[rows] * 64 - 1).astype(np.uint64)).astype(np.int64)
    at = np.unique((start[rows] + (bit >> 6)) * 64 + (bit & 63))  # a place and bit once
    flat = np.zeros(int(start[-1]), dtype=np.uint64)
    if len(at):
        first = np.flatnonzero(np.concatenate([[True], at[1:] >> 6 != at[:-1] >> 6]))
        flat[at[first] >> 6] = np.bitwise_or.reduceat(_U(1) << (at & 63).astype(np.uint64), first)
    return pa.ListArray.from_arrays(pa.array(start.astype(np.int32)), pa.array(flat.view(np.int64)))


def possible(t: Fraction) -> Column:
    """Can sets with the sizes n, m and the bitmaps x, y be similar enough? Elements in both sets
    are at most the bits in both, and as many more as have lost their own bit to another element."""
    fold = lambda c: F.zip_with(F.slice(c, 1, (F.size(c) / 2).cast("int")), F.slice(c, (F.size(c) / 2).cast("int") + 1, F.size(c)),
                                lambda a, b: a.bitwiseOR(b))
    ones = lambda c: F.aggregate(c, F.lit(0).cast("long"), lambda acc, v: acc + F.bit_count(v))
    fit = lambda c, other: F.when(F.size(c) > F.size(other), fold(c)).otherwise(c)
    x, y = fit(F.col("x"), F.col("y")), fit(F.col("y"), F.col("x"))
    shared = ones(F.zip_with(x, y, lambda a, b: a.bitwiseAND(b)))
    most = F.least(shared + F.col("n") - ones(x), shared + F.col("m") - ones(y), F.col("n"), F.col("m"))
    return most * t.denominator >= (F.col("n") + F.col("m") - most) * t.numerator


class Signatures:
    """Signatures of sets for a threshold; ``heavy``: frequent signatures, sorted, with their counts."""

    def __init__(self, threshold: Fraction, heavy: np.ndarray = _NONE, counts: np.ndarray = _NONE):
        self.t, self.heavy, self.counts = threshold, heavy, counts

    def instances(self, size: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(texts, their band, the most partitions in which the set and a partner of this band or a
        lower one differ); sizes of [4^band, 4^(band+1)) are one band."""
        num, den = self.t.numerator, self.t.denominator
        largest = size * den // num
        band = np.zeros(len(size), dtype=np.int64)
        for b in range(1, 32):
            band += size >= 1 << (2 * b)
        out, live = [], np.flatnonzero(size > 0)
        while len(live):
            top = (1 << (2 * (band[live] + 1))) - 1
            partner = np.minimum(largest[live], top)
            out.append((live, band[live].copy(), (size[live] + partner) * (den - num) // (den + num)))
            live = live[largest[live] > top]
            band[live] += 1
        return out

    def all_of(self, rows: np.ndarray, h: np.ndarray, band: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, signature, elements) of every partition with elements; ``band`` of each element's text."""
        parts = np.maximum(2, (4 << (2 * band)) // MEAN).astype(np.uint64)
        place = _mix(h, 4) % parts
        order = np.lexsort((place, rows))
        rows, place, content, band = rows[order], place[order], _mix(h, 5)[order], band[order]
        first = np.flatnonzero(np.concatenate([[True], (rows[1:] != rows[:-1]) | (place[1:] != place[:-1])])[:len(rows)])
        if not len(first):
            return rows, content, np.empty(0, dtype=np.int64)
        sums = np.add.reduceat(content, first)
        return (rows[first], _mix(sums ^ _mix(place[first] * _U(64) + band[first].astype(np.uint64), 6), 7),
                np.diff(np.append(first, len(rows))))

    def each(self, rows: np.ndarray, h: np.ndarray, n: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(text, signature, rank) that two similar enough sets are sure to share one of, by instance.

        The partitions before the first shared signature differ, so its rank in either set is at most
        the number of partitions in which the two differ."""
        size = np.bincount(rows, minlength=n)
        for texts, band, differ in self.instances(size):
            of = np.full(n, -1, dtype=np.int64)
            of[texts] = np.arange(len(texts))
            mine = of[rows] >= 0
            r, e = of[rows[mine]], h[mine]
            row, sig, elements = self.all_of(r, e, band[r])
            often = np.zeros(len(sig), dtype=np.int64)
            if len(self.heavy):
                at = np.minimum(np.searchsorted(self.heavy, sig), len(self.heavy) - 1)
                often = np.where(self.heavy[at] == sig, self.counts[at], 0)
            order = np.lexsort((sig, -elements, often, row))
            row, sig = row[order], sig[order]
            count = np.bincount(row, minlength=len(texts))
            rank = np.arange(len(row)) - (np.cumsum(count) - count)[row]
            short = count <= differ
            kept = rank <= differ[row]
            few = short[r]
            yield (texts[np.concatenate([row[kept], r[few]])],
                   np.concatenate([sig[kept], _mix(e[few] ^ _mix(band[r[few]].astype(np.uint64), 11), 12)]),
                   np.concatenate([np.where(short[row[kept]], 0, rank[kept]), np.zeros(int(few.sum()), dtype=np.int64)]))


def jaccard_links(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5,
                  threshold: tuple[int, int] = (75, 100), heavy: int = 50_000) -> DataFrame:
    """(id, n_shingles, component) for each row of ``df``: ``component`` is the smallest id reachable
    over pairs whose sets have a Jaccard similarity of ``threshold`` (a fraction) or more.

    ``heavy`` bounds the frequent signatures that are broadcast (16 bytes each).
    """
    spark = df.sparkSession
    t = Fraction(*threshold)
    docs = keyed_text(df, id_col, text_col)
    id_type = docs.schema["id"].dataType.simpleString()

    def sets(batch: pa.RecordBatch) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
        for i, j in slices(pc.binary_length(batch.column("text")).to_pylist(), SLICE):
            part = batch.slice(i, j - i)
            yield part, *shingle_sets(part.column("text").to_pylist(), k)

    def described(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row a text, and a row (sig, times) a signature that a stretch of texts has more than once."""
        maker, seen, held = Signatures(t), [], 0

        def told():
            sig, times = np.unique(np.concatenate(seen), return_counts=True)
            sig, times = sig[times > 1].view(np.int64), times[times > 1]
            nothing = [pa.nulls(len(sig), kind) for kind in (id_arrow[0], pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()))]
            return pa.RecordBatch.from_arrays([*nothing, pa.array(sig), pa.array(times)], names)

        id_arrow, names = [pa.int64()], ["id", "n", "h1", "h2", "bits", "sig", "times"]
        for batch in batches:
            id_arrow[0] = batch.schema.field("id").type
            for part, rows, h in sets(batch):
                m = part.num_rows
                both = set_hashes(rows, h, m)
                yield pa.RecordBatch.from_arrays(
                    [part.column("id"), pa.array(np.bincount(rows, minlength=m)), pa.array(both[:, 0]), pa.array(both[:, 1]),
                     bitmaps(rows, h, m), pa.nulls(m, pa.int64()), pa.nulls(m, pa.int64())], names)
                for texts, band, _ in maker.instances(np.bincount(rows, minlength=m)):
                    of = np.full(m, -1, dtype=np.int64)
                    of[texts] = band
                    mine = of[rows] >= 0
                    seen.append(maker.all_of(rows[mine], h[mine], of[rows[mine]])[1])
                    held += len(seen[-1])
            if held > HELD:
                yield told()
                seen, held = [], 0
        if held:
            yield told()

    both = materialize(docs.mapInArrow(described, f"id {id_type}, n long, h1 long, h2 long, bits array<long>, sig long, times long"), "jac")
    rows = both.where("n is not null").select("id", "n", "h1", "h2")
    good = both.where("n > 0 and id is not null")
    classes = materialize(good.groupBy("h1", "h2", "n").agg(F.min("id").alias("rep"), F.first("bits").alias("bits")), "jac")
    counted = both.where("sig is not null").groupBy("sig").agg(F.sum("times").alias("times"))
    level = F.floor(F.log2("times") * 16).cast("int")
    total, least = 0, 1 << 30  # the lowest level from which on at most ``heavy`` signatures are
    for r in sorted(counted.groupBy(level.alias("level")).agg(F.count(F.lit(1)).alias("n")).collect(), reverse=True):
        total += r["n"]
        if total > heavy:
            break
        least = r["level"]
    often = counted.where(level >= least).toPandas()
    sig = often["sig"].to_numpy(dtype=np.int64).view(np.uint64)
    order = np.argsort(sig)
    shared = spark.sparkContext.broadcast((sig[order], often["times"].to_numpy(dtype=np.int64)[order]))

    def signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        maker = Signatures(t, *shared.value)
        for batch in batches:
            for part, rows, h in sets(batch):
                m = part.num_rows
                node, size = set_hashes(rows, h, m)[:, 0], np.bincount(rows, minlength=m)
                for texts, sig, rank in maker.each(rows, h, m):
                    yield pa.RecordBatch.from_arrays([pa.array(sig.view(np.int64)), pa.array(node[texts]), pa.array(size[texts].astype(np.int32)),
                                                      pa.array(rank.astype(np.int32))], ["sig", "node", "n", "rank"])

    # groups of signatures with two different sets, each set once, next to the least of them
    signatures = docs.where("id is not null").mapInArrow(signed, "sig long, node long, n int, rank int")
    group = Window.partitionBy("sig")
    members = materialize(
        signatures.withColumns({"lead": F.min(F.struct("node", "n", "rank")).over(group), "last": F.max("node").over(group)})
        .where("lead.node != last")
        .select("sig", "node", "n", "rank", F.col("lead.node").alias("a"), F.col("lead.n").alias("m"), F.col("lead.rank").alias("other"))
        .distinct(), "jac")
    shared.destroy()
    return _linked(docs, rows, good, classes, members, t, k, id_type)


def _linked(docs, rows, good, classes, members, t, k, id_type) -> DataFrame:
    """Components of the classes from the signature groups ``members``, for each row."""
    fits = (f"least(n, m) * {t.denominator} >= greatest(n, m) * {t.numerator} and "
            f"(n + m) * {t.denominator - t.numerator} >= greatest(rank, other) * {t.denominator + t.numerator}")
    star = materialize(members.where("node != a").where(fits).select("a", F.col("node").alias("b")).distinct(), "jac")
    first = verified(star, docs, classes, t, k, id_type)
    graph = connected(first.select("a", "b"))
    node = classes.select(F.col("h1").alias("node"), "rep").join(graph.withColumnRenamed("node", "rep"), "rep", "left")
    place = node.select("node", F.coalesce("component", "rep").alias("c")).groupBy("node").agg(F.min("c").alias("c"))
    rest = open_pairs(members, place, fits).join(star, ["a", "b"], "left_anti")
    second = verified(rest, docs, classes, t, k, id_type)
    # rows that share an id tie the classes they are in together
    split = good.groupBy("id").agg(F.min(F.struct("h1", "h2")).alias("p"), F.max(F.struct("h1", "h2")).alias("q")).where("p != q").select("id")
    ties = good.join(split, "id").select("id", "h1", "h2").distinct().join(classes, ["h1", "h2"]).select(F.col("id").alias("a"), F.col("rep").alias("b"))
    graph = connected(first.unionByName(second).unionByName(ties))
    per_class = (classes.join(graph.withColumnRenamed("node", "rep"), "rep", "left")
                 .select("h1", "h2", "n", F.coalesce("component", "rep").alias("component")))
    return (rows.select("id", "n", "h1", "h2").withColumn("key", F.col("id").isNotNull() & (F.col("n") > 0))
            .join(per_class.withColumn("key", F.lit(True)), ["h1", "h2", "n", "key"], "left")
            .select("id", F.col("n").alias("n_shingles"), F.coalesce("component", "id").alias("component")))


def open_pairs(members: DataFrame, place: DataFrame, fits: str) -> DataFrame:
    """(a, b) of the sets in one signature group and in different components (``place``: node, c), each pair once.

    A pair is left to an earlier group where one of the EARLIER groups before this one, by rank and signature,
    is the same in both sets. The first group that a pair has in common never leaves it, and there the ranks are least.
    """
    group, before = Window.partitionBy("sig"), Window.partitionBy("node").orderBy("rank", "sig")
    mixed = (members.select("sig", "node", "n", "rank").join(place, "node")
             .withColumns({"p": F.min("c").over(group), "q": F.max("c").over(group)}).where("p != q").drop("p", "q"))
    # null where there is no earlier group
    mixed = materialize(mixed.withColumn("past", F.array_compact(F.array(*[F.lag("sig", i).over(before) for i in range(1, EARLIER + 1)]))), "jac")
    x = mixed.select("sig", F.col("node").alias("a"), "n", "rank", F.col("c").alias("ca"), F.col("past").alias("pa"))
    y = mixed.select("sig", F.col("node").alias("b"), F.col("n").alias("m"), F.col("rank").alias("other"), F.col("c").alias("cb"), F.col("past").alias("pb"))
    return x.join(y, "sig").where("a < b and ca != cb").where(fits).where("not arrays_overlap(pa, pb)").select("a", "b").distinct()


def _among(ids: DataFrame, bits: int = 1 << 22):
    """A column function (may the value be one of ``ids``?) and its broadcast. A Bloom filter of a fixed size (512 KB) with
    two probes, so that a scan drops most other rows before they are shuffled; beyond some million ids
    it lets more through, and the join behind it decides all the same."""
    probes = lambda c: [F.pmod(F.xxhash64(F.lit(s), c), F.lit(bits)) for s in (1, 2)]
    words = (ids.select(F.explode(F.array(*probes(F.col("id")))).alias("p"))
             .groupBy((F.col("p") / 32).cast("int").alias("w")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("p") % 32).cast("int"))).alias("v"))
             .toPandas())  # bits / 32 rows at most
    table = np.zeros(bits // 32, dtype=np.uint32)
    table[words["w"].to_numpy(dtype=np.int64)] = words["v"].to_numpy(dtype=np.int64).astype(np.uint32)
    shared = ids.sparkSession.sparkContext.broadcast(table)

    @F.pandas_udf("boolean")
    def known(p: pd.Series, q: pd.Series) -> pd.Series:
        has = lambda x: (shared.value[x.to_numpy() >> 5] >> (x.to_numpy() & 31).astype(np.uint32)) & 1
        return pd.Series((has(p) & has(q)).astype(bool))

    return lambda c: known(*probes(c)), shared


def verified(pairs: DataFrame, docs: DataFrame, classes: DataFrame, t: Fraction, k: int, id_type: str) -> DataFrame:
    """Edges (a, b: smallest ids of the classes) of the pairs of set hashes whose sets are similar enough."""
    sketch = lambda node, size, bits: classes.select(F.col("h1").alias(node), F.col("n").alias(size), F.col("bits").alias(bits))
    pairs = materialize(pairs.join(sketch("a", "n", "x"), "a").join(sketch("b", "m", "y"), "b").where(possible(t))
                        .select("a", "b").distinct(), "jac")
    needed = pairs.select(F.col("a").alias("h1")).unionByName(pairs.select(F.col("b").alias("h1"))).distinct()
    wanted = classes.join(needed, "h1").select("h1", "h2", "n", F.col("rep").alias("id"))
    among, shared = _among(wanted.select("id"))
    texts = docs.where(among(F.col("id"))).join(wanted, "id").select("h1", "h2", "n", "id", "text")
    side = lambda s: texts.select(*[F.col(c).alias(f"{c}_{s}") for c in texts.columns])
    joined = pairs.join(side("a").withColumnRenamed("h1_a", "a"), "a").join(side("b").withColumnRenamed("h1_b", "b"), "b")
    num, den = t.numerator, t.denominator

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths = pc.add(pc.binary_length(batch.column("text_a")), pc.binary_length(batch.column("text_b")))
            for i, j in slices(lengths.to_pylist(), SLICE):
                part = batch.slice(i, j - i)
                m = part.num_rows
                rows, h = shingle_sets([*part.column("text_a").to_pylist(), *part.column("text_b").to_pylist()], k)
                found = set_hashes(rows, h, 2 * m)
                want = lambda *names: np.stack([part.column(n).to_numpy() for n in names], axis=1)
                right = ((found[:m] == want("a", "h2_a")) & (found[m:] == want("b", "h2_b"))).all(axis=1)
                size = np.bincount(rows, minlength=2 * m)
                pair = rows % m  # both sets of a pair next to each other: common elements follow themselves
                order = np.lexsort((h, pair))
                pair, h = pair[order], h[order]
                common = np.bincount(pair[1:][(pair[1:] == pair[:-1]) & (h[1:] == h[:-1])], minlength=m)
                near = den * common >= num * (size[:m] + size[m:] - common)
                kept = part.filter(pa.array(right & near))
                yield pa.RecordBatch.from_arrays([kept.column("id_a"), kept.column("id_b")], ["a", "b"])

    links = materialize(joined.mapInArrow(check, f"a {id_type}, b {id_type}"), "jac")
    shared.destroy()
    return links
