"""Benchmark decontamination: one Aho-Corasick automaton over normalised benchmark passages.

Texts are normalised to words (ASCII letters in lower case, digits, everything beyond ASCII) with one
space before, between and after them. A pattern is a window of ``window`` consecutive words of an item
with its spaces, or the whole item if it is shorter. The automaton goes once over each normalised
text; the places it reports are mapped to words and to offsets in the original text.

The patterns are broadcast in blocks of bounded size: distinct items are dealt by id and text into as
many blocks as their measured size needs, and the documents pass one automaton after the other in the
same task, so the documents are never shuffled. Defined cases: null texts and items have no words; items
without an id are together one item, whose id is null; a repeated item counts once, repeated rows each; an
empty benchmark hits nothing; other columns are ignored.
"""
from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskbook.llm.common import keyed_text

#: Bytes of words (digits, ASCII letters, every byte beyond ASCII); the rest is space.
_TABLE = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def words_of(text: str) -> list[bytes]:
    return text.encode().translate(_TABLE).split()


def patterns_of(text: str, window: int) -> set[str]:
    """The item's windows as the automaton's patterns; bytes stand for themselves (latin-1)."""
    words = words_of(text)
    if not words:
        return set()
    return {" " + b" ".join(words[i:i + window]).decode("latin-1") + " " for i in range(max(1, len(words) - window + 1))}


class Matcher:
    """The automaton over the patterns of some items: [(item id as text or None, item text)]."""

    def __init__(self, items: list[tuple[str | None, str]], window: int):
        import ahocorasick
        owners: dict[str, set[str | None]] = {}
        for item, text in items:
            for p in patterns_of(text, window):
                owners.setdefault(p, set()).add(item)
        self.automaton = ahocorasick.Automaton() if owners else None
        for p, ids in owners.items():
            self.automaton.add_word(p, (p.count(" ") - 1, tuple(ids)))
        if owners:
            self.automaton.make_automaton()

    def hits(self, normal: str) -> tuple[list[tuple[int, int]], set[str | None]]:
        """Runs of hit words [first, end) of a normalised text, and the items."""
        if self.automaton is None:
            return [], set()
        found = list(self.automaton.iter(normal))
        if not found:
            return [], set()
        spaces = np.flatnonzero(np.frombuffer(normal.encode("latin-1"), dtype=np.uint8) == 32)
        ends = np.searchsorted(spaces, [at for at, _ in found])
        mark = np.zeros(len(spaces) + 1, dtype=np.int32)  # +1 where a window starts, -1 behind it
        np.add.at(mark, ends, -1)
        np.add.at(mark, ends - [n for _, (n, _) in found], 1)
        covered = np.concatenate([[0], (np.cumsum(mark[:-1]) > 0).view(np.int8), [0]])
        edges = np.flatnonzero(np.diff(covered))
        return list(zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True)), {i for _, (_, ids) in found for i in ids}


def merge_runs(runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(runs):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out


def find_contamination(df: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                       item_col: str = "item_id", item_text_col: str = "text", window: int = 13,
                       block_bytes: int = 4_000_000) -> DataFrame:
    """(id, n_words, runs, spans, items) for each row of ``df``.

    ``runs``: hit words [first, end); ``spans``: the same as offsets [start, end) in code points of the
    original text; ``items``: ids of the items with windows in the text, as strings, sorted,
    null last. ``block_bytes`` bounds the item texts of one broadcast automaton, a single longer text aside;
    more items make more blocks.
    """
    spark = df.sparkSession
    items = (benchmark.select(F.col(item_col).cast("string").alias("item"), F.col(item_text_col).alias("body"))
             .where("body is not null").distinct())
    total = items.agg(F.sum(F.octet_length("body") + F.coalesce(F.length("item"), F.lit(0)) + 16)).first()[0] or 0
    blocks = max(1, math.ceil(1.5 * total / block_bytes))
    docs = keyed_text(df, id_col, text_col)
    id_type = docs.schema["id"].dataType.simpleString()
    pairs = "array<struct<a:int,b:int>>"
    out_type = f"id {id_type}, text string, n_words long, runs {pairs}, spans {pairs}, items array<string>"
    pair_type = pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())]))
    state = docs.withColumns({"n_words": F.lit(0).cast("long"), "runs": F.array().cast(pairs),
                              "spans": F.array().cast(pairs), "items": F.array().cast("array<string>")})

    def matching(shared, last: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            matcher = Matcher(shared.value, window)
            for batch in batches:
                texts = batch.column("text").to_pylist()
                before = batch.column("runs").to_pylist()
                items_before = batch.column("items").to_pylist()
                n_words, runs, spans, found = [], [], [], []
                for text, old, had in zip(texts, before, items_before, strict=True):
                    words = words_of(text)
                    hit, ids = matcher.hits(" " + b" ".join(words).decode("latin-1") + " ")
                    merged = merge_runs(hit + [(r["a"], r["b"]) for r in old]) if old else hit
                    where = []
                    if merged and last:
                        places = [m.span() for m in _WORD.finditer(text)]
                        where = [(places[a][0], places[b - 1][1]) for a, b in merged]
                    n_words.append(len(words))
                    runs.append([{"a": a, "b": b} for a, b in merged])
                    spans.append([{"a": a, "b": b} for a, b in where])
                    found.append(sorted(ids.union(had), key=lambda i: (i is None, i or "")))
                text_out = pa.nulls(len(texts), pa.string()) if last else batch.column("text").cast(pa.string())
                yield pa.RecordBatch.from_arrays(
                    [batch.column("id"), text_out, pa.array(n_words, pa.int64()), pa.array(runs, pair_type),
                     pa.array(spans, pair_type), pa.array(found, pa.list_(pa.string()))],
                    ["id", "text", "n_words", "runs", "spans", "items"])
        return run

    for no in range(blocks):
        block = items.where(F.pmod(F.xxhash64("item", "body"), F.lit(blocks)) == no) if blocks > 1 else items
        shared = spark.sparkContext.broadcast([(r["item"], r["body"]) for r in block.collect()])
        state = state.mapInArrow(matching(shared, no == blocks - 1), out_type)
    return state.drop("text")


def with_decision(found: DataFrame, least_share: float = 0.05) -> DataFrame:
    """Adds n_hit, n_items and ``contaminated``: some word is hit, and at least ``least_share`` of all."""
    n_hit = F.aggregate("runs", F.lit(0).cast("long"), lambda acc, r: acc + (r["b"] - r["a"]))
    return (found.withColumn("n_hit", n_hit).withColumn("n_items", F.size("items").cast("long"))
            .withColumn("contaminated", (F.col("n_hit") > 0)
                        & (F.col("n_hit") * 1000 >= F.col("n_words") * F.lit(round(1000 * least_share)))))
