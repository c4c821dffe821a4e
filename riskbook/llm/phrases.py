"""Phrase collocations by set-oriented relational mining (SETM).

The occurrence relation of length k holds, for each place in a piece of text, the frequent phrase of k
words that starts there. It is written in its own order, as blocks: a block holds whole pieces of one
language, its rows are the entries of an array, and the entry's index is its place. -1 stands where no
frequent phrase starts and at the end of a piece (the last entry of every block), so equal piece and
adjacent place is an index beside it. Blocks are small, as Spark and Arrow read thousands at once.
A round merge-joins the relation with itself at adjacent places (a phrase of k + 1 words is two of k
words that overlap), counts the groups, keeps those seen often enough, and semi-joins the occurrences
with them before the next length. Every word of a frequent phrase is frequent, and so are its parts, so
nothing is lost.

Block-local work is NumPy; groups are pre-counted in a task, then summed by Spark. The frequent groups
reach the blocks as a broadcast table if there are at most ``most_broadcast`` of them, else by a join: the
distinct groups of some blocks (a chunk) are dealt to buckets by their hash, a packed row for each bucket,
looked up there among the bucket's frequent groups, and go back to their chunk as ids in the same order.
The same result by either way.

A candidate's score is 2,000,000 a / (l + r), rounded down, for the cut into two parts that gives the
least; a, l, r are the counts of the phrase and of its parts, as exact decimals.

Defined cases: null texts are empty; a null language is ``und``; repeated rows each count; texts of any
length are cut into blocks where pieces end, a longer piece is a block by itself; empty tables give no
rows; other columns are ignored.
"""
from __future__ import annotations

import itertools
import zlib
from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from functools import partial

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskbook.llm.common import slices
from riskbook.session import collect_garbage, drop_folder, materialize, scratch_folder

#: The bytes that end a piece, and those between words.
PIECE_END, WORD_END = b".,;:!?\x0a\x0b\x0c\x0d", b"\x20\x09"
#: Words of a block, and groups that a task counts before it hands them on.
BLOCK, HELD = 1 << 10, 1 << 17
#: Words of a chunk, frequent groups of a bucket, and buckets at least (Arrow reads thousands of rows at once, so
#: that a chunk's groups of one bucket are few).
CHUNK, BUCKET, BUCKETS = 1 << 15, 1 << 16, 64
_DEALT = "chunk long, bucket int, data binary"
_FOLD = bytes.maketrans(PIECE_END + b"ABCDEFGHIJKLMNOPQRSTUVWXYZ\t", b"." * len(PIECE_END) + b"abcdefghijklmnopqrstuvwxyz ")


def words_of(text: str) -> list[bytes]:
    """The words in order; ``b"."`` stands where a piece ends."""
    return text.encode("utf-8").translate(_FOLD).replace(b".", b" . ").split()


def _texts(df: DataFrame, text_col: str, lang_col: str) -> DataFrame:
    return df.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"),
                     F.coalesce(F.col(text_col), F.lit("")).alias("text"))


def _count_words(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    seen: dict[str, Counter] = {}

    def rows() -> Iterator[pd.DataFrame]:
        for lang, counts in seen.items():
            counts.pop(b".", None)
            if counts:
                yield pd.DataFrame({"lang": lang, "phrase": [w.decode("utf-8") for w in counts], "n": list(counts.values())})
        seen.clear()

    for frame in frames:
        for lang, text in zip(frame["lang"], frame["text"], strict=True):
            seen.setdefault(lang, Counter()).update(words_of(text))
            if sum(map(len, seen.values())) > HELD:
                yield from rows()
    yield from rows()


def _ends(marks: np.ndarray) -> list[int]:
    """Where to cut a list of words into blocks of at least BLOCK words; ``marks``: places of piece ends."""
    ends, at = [], 0
    while len(marks) and at <= marks[-1]:
        at = int(marks[np.searchsorted(marks, min(at + BLOCK - 1, marks[-1]))]) + 1
        ends.append(at)
    return ends


def _blocks(lookup, frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The relation of length 1 as blocks; ``lookup(lang, words, ends)`` gives the rows of some blocks."""
    for frame in frames:
        held: dict[str, list[bytes]] = {}
        for k, (lang, text) in enumerate(zip(frame["lang"], frame["text"], strict=True), 1):
            words = held.setdefault(lang, [])
            words += words_of(text)
            words.append(b".")
            if len(words) >= HELD or k == len(frame):
                for one in [lang] if k < len(frame) else list(held):
                    words = held.pop(one)
                    yield lookup(one, words, _ends(np.flatnonzero(np.fromiter(map(b".".__eq__, words), bool, len(words)))))


def _pairs(entries: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Indexes where two entries are beside each other, and both entries."""
    at = np.flatnonzero((entries[:-1] >= 0) & (entries[1:] >= 0))
    return at, entries[at], entries[at + 1]


def _distinct(keys: np.ndarray, weights: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order and how often each is there (or its sum of weights)."""
    if not len(keys):
        return keys, np.empty(0, dtype=np.int64)
    if weights is None:
        keys = np.sort(keys)
    else:
        order = np.argsort(keys)
        keys, weights = keys[order], weights[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    n = np.diff(np.append(first, len(keys))) if weights is None else np.add.reduceat(weights, first)
    return keys[first], n.astype(np.int64)


def _count_pairs(shorter: int, frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """``shorter``: the entries are below it, so a pair is one number."""
    def rows(keys: np.ndarray, n: np.ndarray) -> pd.DataFrame:
        a = keys // max(shorter, 1)
        return pd.DataFrame({"a": a, "b": keys - a * shorter, "n": n})

    held, size = [], 0
    for frame in frames:
        for i, j in slices(frame["entries"].map(len), 8 * HELD):
            _, x, y = _pairs(_joined(frame["entries"].iloc[i:j]))
            held.append(_distinct(x * shorter + y))
            size += len(held[-1][0])
            if size > 4 * HELD:
                held = [_distinct(*map(np.concatenate, zip(*held, strict=True)))]
                size = len(held[0][0])
                if size > 2 * HELD:
                    yield rows(*held.pop())
                    size = 0
    if held:
        yield rows(*_distinct(*map(np.concatenate, zip(*held, strict=True))))


def _joined(blocks: Iterable[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(blocks), dtype=np.int64)


def _cut(entries: np.ndarray, ends: Iterable[int]) -> list[bytes]:
    return [part.tobytes() for part in np.split(entries.astype(np.int64), list(ends)[:-1])]


def _written(df: DataFrame, made: list[str]) -> DataFrame:
    """Written and read again; the folder is added to ``made``."""
    spark, path = df.sparkSession, scratch_folder(df.sparkSession, "phrases")
    df.write.option("compression", "zstd").parquet(path)
    made.append(path)
    return spark.read.schema(df.schema).parquet(path)


def _with_ids(groups: DataFrame) -> DataFrame:
    """Written, with ids from 0 without holes: a group's place in its file after the files before."""
    rows = materialize(groups.withColumn("at", F.monotonically_increasing_id()), "phrases")
    part = F.shiftright("at", 33)
    sizes = rows.groupBy(part.alias("part")).count().orderBy("part").toPandas()  # one row a file
    before = dict(zip(sizes["part"].tolist(), (sizes["count"].cumsum() - sizes["count"]).tolist(), strict=True))
    offset = F.create_map(*[F.lit(x) for kv in before.items() for x in kv]) if before else F.create_map(F.lit(0), F.lit(0))
    return rows.select((offset[part] + F.col("at").bitwiseAND((1 << 33) - 1)).cast("long").alias("id"), *[c for c in rows.columns if c != "at"])


def _first_relation(texts: DataFrame, words: DataFrame, small: bool, made: list[str]) -> DataFrame:
    """(entries): the occurrences of the frequent words."""
    if small:
        known: dict[str, dict[bytes, int]] = {}
        for row in words.select("lang", "phrase", "id").toLocalIterator():
            known.setdefault(row["lang"], {})[row["phrase"].encode("utf-8")] = row["id"]
        shared = texts.sparkSession.sparkContext.broadcast(known)

        def lookup(lang, found, ends):
            get = shared.value.get(lang, {}).get
            return pd.DataFrame({"entries": _cut(np.fromiter(map(get, found, itertools.repeat(-1)), np.int64, len(found)), ends)})

        return texts.mapInPandas(lambda frames: _blocks(lookup, frames), "entries binary")

    buckets = _buckets(words)

    def local(chunk, lang, found, ends):
        kinds = dict.fromkeys(found)
        kinds.pop(b".", None)
        dealt: list[list[bytes]] = [[] for _ in range(buckets)]
        for w in kinds:
            dealt[zlib.crc32(w) % buckets].append(w)
        place = {w: k for k, w in enumerate(itertools.chain.from_iterable(dealt))}
        place[b"."] = -1
        head = lang.encode("utf-8").hex().encode()
        parts = [(b, b" ".join([head, *own])) for b, own in enumerate(dealt) if own]
        entries = np.fromiter(map(place.__getitem__, found), np.int32, len(found))
        return _chunk(chunk, buckets, parts, np.split(entries, ends[:-1]))

    def numbered(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        numbers = itertools.count(TaskContext.get().partitionId() << 33)
        return _blocks(lambda *found: local(next(numbers), *found), frames)

    def packed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            frame = frame.assign(bucket=[zlib.crc32(w.encode("utf-8")) % buckets for w in frame["phrase"]])
            rows = [(b, np.append(len(own), own["id"].to_numpy(dtype=np.int64)).tobytes()
                     + b" ".join([lang.encode("utf-8").hex().encode(), *(w.encode("utf-8") for w in own["phrase"])]))
                    for (b, lang), own in frame.groupby(["bucket", "lang"], sort=False)]
            yield pd.DataFrame({"chunk": -1, "bucket": [b for b, _ in rows], "data": [x for _, x in rows]})

    def finder(held: list[bytes]) -> Callable:
        known: dict[bytes, dict[bytes, int]] = {}
        for data in held:
            n = int(np.frombuffer(data, dtype=np.int64, count=1)[0])
            lang, *found = data[8 * (n + 1):].split(b" ")
            known.setdefault(lang, {}).update(zip(found, np.frombuffer(data, dtype=np.int64, count=n, offset=8).tolist(), strict=True))

        def find(asked: list[bytes]) -> list[bytes]:
            out = []
            for data in asked:
                lang, *found = data.split(b" ")
                get = known.get(lang, {}).get
                out.append(np.fromiter(map(get, found, itertools.repeat(-1)), np.int64, len(found)).tobytes())
            return out

        return find

    rows = _written(texts.mapInPandas(numbered, _DEALT), made)
    return _joined_back(rows, words.select("lang", "phrase", "id").mapInPandas(packed, _DEALT), buckets, finder)


def _next_relation(blocks: DataFrame, groups: DataFrame, small: bool, made: list[str], shorter: int) -> DataFrame:
    """(entries): occurrences one word longer, adjacent ones joined; those of frequent groups alone.
    ``shorter``: the blocks' entries are below it."""
    if small:
        rows = groups.select("a", "b", "id").toPandas().sort_values(["a", "b"])
        shared = blocks.sparkSession.sparkContext.broadcast(tuple(rows[c].to_numpy(dtype=np.int64) for c in ("a", "b", "id")))

        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            a, b, ids = shared.value
            heads, tails = np.unique(a), np.unique(b)  # no more of them than rows, so a product is below 2^63
            keys = np.searchsorted(heads, a) * len(tails) + np.searchsorted(tails, b)
            for frame in frames:
                for i, j in slices(frame["entries"].map(len), 8 * HELD):
                    part = frame["entries"].iloc[i:j]
                    entries = _joined(part)
                    found = np.full(len(entries), -1, dtype=np.int64)
                    at, x, y = _pairs(entries)
                    if len(keys) and len(at):
                        head = np.minimum(np.searchsorted(heads, x), len(heads) - 1)
                        tail = np.minimum(np.searchsorted(tails, y), len(tails) - 1)
                        key = head * len(tails) + tail
                        place = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
                        same = (heads[head] == x) & (tails[tail] == y) & (keys[place] == key)
                        found[at[same]] = ids[place[same]]
                    yield pd.DataFrame({"entries": _cut(found, np.cumsum(part.map(len)) // 8)})

        return blocks.mapInPandas(run, "entries binary")

    buckets = _buckets(groups)

    def numbered(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        numbers = itertools.count(TaskContext.get().partitionId() << 33)
        for frame in frames:
            for i, j in slices(frame["entries"].map(len), 8 * CHUNK):
                part = frame["entries"].iloc[i:j]
                entries = _joined(part)
                at, x, y = _pairs(entries)
                keys, place = np.unique(x * shorter + y, return_inverse=True)
                order, cuts = _dealt(keys, buckets)
                rank = np.empty(len(keys), dtype=np.int32)
                rank[order] = np.arange(len(keys))
                local = np.full(len(entries), -1, dtype=np.int32)
                local[at] = rank[place]
                parts = [(b, own.tobytes()) for b, own in enumerate(np.split(keys[order], cuts)) if len(own)]
                yield _chunk(next(numbers), buckets, parts, np.split(local, (np.cumsum(part.map(len)) // 8).to_numpy()[:-1]))

    def packed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            keys = frame["a"].to_numpy(dtype=np.int64) * shorter + frame["b"].to_numpy(dtype=np.int64)
            order, cuts = _dealt(keys, buckets)
            rows = [(b, np.concatenate(own).tobytes()) for b, own in enumerate(zip(
                np.split(keys[order], cuts), np.split(frame["id"].to_numpy(dtype=np.int64)[order], cuts), strict=True)) if len(own[0])]
            yield pd.DataFrame({"chunk": -1, "bucket": [b for b, _ in rows], "data": [x for _, x in rows]})

    def finder(held: list[bytes]) -> Callable:
        pairs = [np.frombuffer(x, dtype=np.int64).reshape(2, -1) for x in held]
        keys, ids = np.concatenate([np.empty((2, 0), dtype=np.int64), *pairs], axis=1)
        order = np.argsort(keys)
        keys, ids = np.append(keys[order], -1), np.append(ids[order], -1)  # no key is below 0

        def find(asked: list[bytes]) -> list[bytes]:
            x = _joined(asked)
            place = np.searchsorted(keys[:-1], x)
            return _cut(np.where(keys[place] == x, ids[place], -1), np.cumsum([len(a) // 8 for a in asked]))

        return find

    rows = _written(blocks.mapInPandas(numbered, _DEALT), made)
    return _joined_back(rows, groups.select("a", "b", "id").mapInPandas(packed, _DEALT), buckets, finder)


def _buckets(groups: DataFrame) -> int:
    return max(BUCKETS, -(-groups.count() // BUCKET))


def _dealt(keys: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """The order of the keys by bucket, and where a bucket after the first begins in it."""
    z = keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    z = (z ^ (z >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    of = (z >> np.uint64(33)).astype(np.int64) % buckets
    order = np.argsort(of, kind="stable")
    return order, np.searchsorted(of[order], np.arange(1, buckets))


def _chunk(chunk: int, buckets: int, parts: list[tuple[int, bytes]], blocks: list[np.ndarray]) -> pd.DataFrame:
    """Rows of a chunk: its groups by bucket, and its blocks, whose entries number the groups in that order."""
    return pd.DataFrame({"chunk": chunk, "bucket": [b for b, _ in parts] + [buckets] * len(blocks),
                         "data": [x for _, x in parts] + [x.tobytes() for x in blocks]})


def _joined_back(rows: DataFrame, table: DataFrame, buckets: int, finder) -> DataFrame:
    """(entries): the blocks of ``rows`` (``_chunk``) with ids of frequent groups, which ``table`` holds by bucket.
    ``finder`` takes the table's rows of a bucket and gives a function from rows of groups to rows of ids."""
    def look_up(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bucket, held, find = None, [], None
        for frame in frames:
            for b, own in frame.groupby("bucket", sort=False):  # in order: the table's rows of a bucket come first
                if b != bucket:
                    bucket, held, find = b, [], None
                held += own["data"][own["chunk"] < 0].tolist()
                asked = own[own["chunk"] >= 0]
                if find is None and len(asked):
                    find, held = finder(held), []
                for i, j in slices(asked["data"].map(len), 8 * HELD):
                    part = asked.iloc[i:j]
                    yield pd.DataFrame({"chunk": part["chunk"].to_numpy(), "bucket": b, "data": find(part["data"].tolist())})

    def renamed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        chunk, held, ids = None, [], None
        for frame in frames:
            for i, j in slices(frame["data"].map(len), 8 * HELD):
                out, part = [], frame.iloc[i:j]
                for c, b, data in zip(part["chunk"].tolist(), part["bucket"].tolist(), part["data"], strict=True):
                    if c != chunk:
                        chunk, held, ids = c, [], None
                    if b < buckets:
                        held.append(data)
                        continue
                    if ids is None:
                        ids = np.append(_joined(held), -1)  # the last: no group
                    out.append(ids[np.frombuffer(data, dtype=np.int32)].tobytes())
                yield pd.DataFrame({"entries": out})

    found = (rows.where(F.col("bucket") < buckets).unionByName(table).repartition(buckets, "bucket")
             .sortWithinPartitions("bucket", "chunk").mapInPandas(look_up, _DEALT))
    return (rows.where(F.col("bucket") == buckets).unionByName(found).repartition("chunk")
            .sortWithinPartitions("chunk", "bucket").mapInPandas(renamed, "entries binary"))


def frequent_phrases(df: DataFrame, text_col: str = "text", lang_col: str = "lang", longest: int = 4, least: int = 30,
                     most_broadcast: int = 1_000_000) -> tuple[list[DataFrame], DataFrame]:
    """Tables (id, lang, phrase, f) of the phrases of 1, 2, ... ``longest`` words seen ``least`` times in
    their language, and (lang, n) with all word occurrences of each language."""
    texts, made, tables = _texts(df, text_col, lang_col), [], []
    words = materialize(texts.mapInPandas(_count_words, "lang string, phrase string, n long")
                        .groupBy("lang", "phrase").agg(F.sum("n").alias("f")), "phrases")
    totals = words.groupBy("lang").agg(F.sum("f").alias("n"))
    tables.append(_with_ids(words.where(F.col("f") >= least).coalesce(64)))
    count = tables[0].count()
    groups = blocks = entries = None
    for length in range(2, longest + 1):
        small, old = count <= most_broadcast, made
        made = []
        relation = _first_relation(texts, tables[0], small, made) if length == 2 else _next_relation(blocks, groups, small, made, entries)
        blocks, entries = _written(relation, made), count
        counted = (blocks.mapInPandas(partial(_count_pairs, entries), "a long, b long, n long").groupBy("a", "b").agg(F.sum("n").alias("f"))
                   .where(F.col("f") >= least))
        shorter = tables[-1]
        named = (counted.join(shorter.select(F.col("id").alias("a"), "lang", F.col("phrase").alias("head")), "a")
                 .join(shorter.select(F.col("id").alias("b"), F.substring_index("phrase", " ", -1).alias("tail")), "b"))
        groups = _with_ids(named.select("a", "b", "lang", F.concat_ws(" ", "head", "tail").alias("phrase"), "f").coalesce(64))
        tables.append(groups.select("id", "lang", "phrase", "f"))
        count = groups.count()
        for path in old:
            drop_folder(df.sparkSession, path)
        collect_garbage(df.sparkSession)  # what this length shuffled stays on the disks until the driver collects its garbage
    for path in made:
        drop_folder(df.sparkSession, path)
    return tables, totals


def _part(phrase: str, start, length) -> Column:
    return F.array_join(F.slice(F.split(phrase, " "), start, length), " ")


def collocations(df: DataFrame, text_col: str = "text", lang_col: str = "lang", longest: int = 4, least: int = 30,
                 share: int = 80, top: int | None = 2_000, most_broadcast: int = 1_000_000) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the best ``top`` phrases of each language (None: all,
    rank null). A phrase goes if a longer candidate holds it and has ``share`` percent of its count."""
    tables, totals = frequent_phrases(df, text_col, lang_col, longest, least, most_broadcast)
    sized = [t.select("lang", "phrase", F.col("f").cast("decimal(20,0)").alias("f"), F.lit(k).alias("k")) for k, t in enumerate(tables, 1)]
    every, candidates = sized[0], None
    for t in sized[1:]:
        every = every.unionByName(t)
        candidates = t if candidates is None else candidates.unionByName(t)
    cuts = candidates.select("lang", "phrase", "f", "k", F.explode(F.sequence(F.lit(1), F.col("k") - 1)).alias("cut")).select(
        "lang", "phrase", "f", "cut", _part("phrase", 1, F.col("cut")).alias("head"),
        _part("phrase", F.col("cut") + 1, F.col("k") - F.col("cut")).alias("rest"))
    counts = lambda part, name: every.select("lang", F.col("phrase").alias(part), F.col("f").alias(name))
    scored = cuts.join(counts("head", "l"), ["lang", "head"]).join(counts("rest", "r"), ["lang", "rest"])
    scored = scored.withColumn("score", F.expr("(cast(2000000 as decimal(7,0)) * f) div (l + r)"))
    best = scored.groupBy("lang", "phrase", "f").agg(F.min(F.struct("score", "cut", "l", "r")).alias("best"))
    inner = (candidates.where("k > 2").select("lang", "phrase", "f", "k", F.explode(F.sequence(F.lit(2), F.col("k") - 1)).alias("size"))
             .select("lang", "phrase", "f", "size", F.explode(F.sequence(F.lit(1), F.col("k") - F.col("size") + 1)).alias("start"))
             .select("lang", _part("phrase", F.col("start"), F.col("size")).alias("phrase"), "f")
             .groupBy("lang", "phrase").agg(F.max("f").alias("longer")))
    kept = (best.join(inner, ["lang", "phrase"], "left")
            .where(F.col("longer").isNull() | (F.lit(100).cast("decimal(3,0)") * F.col("longer") < F.lit(share).cast("decimal(3,0)") * F.col("f")))
            .select("lang", "phrase", F.col("f").alias("a"), "best.l", "best.r", "best.score"))
    if top is None:
        kept = kept.withColumn("rank", F.lit(None).cast("long"))
    else:
        order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase").asc()]
        salted = kept.withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(64)))
        few = salted.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*order))).where(F.col("rank") <= top)
        kept = few.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= top)
    return kept.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase",
                                            *[F.col(c).cast("long").alias(c) for c in ("a", "l", "r", "n", "score")])
