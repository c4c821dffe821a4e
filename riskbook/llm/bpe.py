"""Byte-level BPE by given ranks: overlapping chunks, stitched pre-tokens, lossless decoding.

A text of more than ``chunk_chars`` characters is cut into chunks that overlap, and chunks are
pre-tokenised in separate tasks. A chunk may start inside a pre-token, so its first places can be wrong,
and the pre-token that touches its end is left out; but the pattern looks only forward, so from the first
place that a chunk shares with the true places before it, all its places are true. Stitching goes from
chunk to chunk at such places; where the overlap holds none (one run longer than the overlap), it goes on
match by match until the places meet. The text is cut into pieces at those places, behind a character
that isn't white space, so that no pre-token of a piece depends on text outside of it; the pieces' ids
follow each other. Shorter texts are one piece and aren't shuffled. The ids of a piece come from tiktoken
with the given ranks and pattern. Decoding concatenates the bytes of the ids.

Long texts are told apart by their content, so repeated rows are encoded once and joined back.
Defined cases: null text counts as empty and has no ids; other columns are ignored.
"""
from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskbook.llm.common import keyed_text


def load_ranks(path: str) -> dict[bytes, int]:
    """Bytes to rank of a file of base64 tokens; read on the driver, some 50,000 entries."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


class Encoder:
    """Pre-tokens (``find``) and ids of a text; special tokens in it are ordinary text."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import regex
        import tiktoken
        self.find = regex.compile(pattern)
        self._encoding = tiktoken.Encoding("given", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})

    def ids(self, text: str) -> np.ndarray:
        return self._encoding.encode_to_numpy(text, disallowed_special=()).astype(np.int32)

    def places(self, chunk: str, start: int, is_last: bool) -> list[int]:
        """Ends of the chunk's pre-tokens that more text can't change: all but the one at its end."""
        ends = [start + m.end() for m in self.find.finditer(chunk)]
        return ends if is_last else ends[:-1]


def stitch(chunks: list[tuple[int, list[int]]], text: str, encoder: Encoder) -> list[int]:
    """Places to cut the whole text, from its chunks in order: (start, ends of pre-tokens)."""
    cuts, at = [0], 0
    for start, ends in chunks:
        places = {start, *ends}
        limit = ends[-1] if ends else start
        while at < limit and at not in places:
            at = encoder.find.match(text, at).end()
        if at in places:
            true = [p for p in [at, *ends] if p >= at]
            cut = next((p for p in true if p and not text[p - 1].isspace()), None)
            if cut is not None and cut > cuts[-1]:
                cuts.append(cut)
            at = true[-1]
    return cuts + [len(text)] if cuts[-1] < len(text) else cuts


def _id_lists(lists: list[np.ndarray]) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum([len(x) for x in lists])]).astype(np.int32)
    values = np.concatenate([np.empty(0, dtype=np.int32), *lists])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))


def encode(df: DataFrame, ranks: dict[bytes, int], pattern: str, id_col: str = "doc_id", text_col: str = "text",
           chunk_chars: int = 32_768, overlap: int = 1_024, rows: int = 512) -> DataFrame:
    """(id, ids array<int>): one row for each row of ``df``."""
    if chunk_chars < 1 or overlap < 1:
        raise ValueError("chunk_chars and overlap must be positive")
    shared = df.sparkSession.sparkContext.broadcast((ranks, pattern))  # the vocabulary: fixed size
    docs = keyed_text(df, id_col, text_col)
    id_type = docs.schema["id"].dataType.simpleString()
    is_long = F.length("text") > chunk_chars

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(*shared.value)
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                part = batch.slice(at, rows)
                ids = _id_lists([encoder.ids(t) for t in part.column(1).to_pylist()])
                yield pa.RecordBatch.from_arrays([part.column(0), ids], ["id", "ids"])

    def cut(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for blob, text in zip(frame["blob"], frame["text"], strict=True):
                starts = range(0, len(text), chunk_chars)
                yield pd.DataFrame({"blob": blob, "start": list(starts),
                                    "text": [text[s:s + chunk_chars + overlap] for s in starts],
                                    "last": [s + chunk_chars + overlap >= len(text) for s in starts]})

    def pretokenised(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = Encoder(*shared.value)
        for frame in frames:
            ends = [encoder.places(t, s, last) for s, t, last in zip(frame["start"], frame["text"], frame["last"], strict=True)]
            yield frame[["blob", "start", "text"]].assign(ends=ends)

    def stitched(frame: pd.DataFrame) -> pd.DataFrame:
        encoder = Encoder(*shared.value)
        frame = frame.sort_values("start")
        text = "".join([*(t[:chunk_chars] for t in frame["text"].iloc[:-1]), frame["text"].iloc[-1]])
        cuts = stitch([(s, list(e)) for s, e in zip(frame["start"], frame["ends"], strict=True)], text, encoder)
        ids = np.concatenate([encoder.ids(text[a:b]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)])
        return pd.DataFrame({"blob": [frame["blob"].iloc[0]], "ids": [ids]})

    short = docs.where(~is_long).mapInArrow(whole, f"id {id_type}, ids array<int>")
    keyed = docs.where(is_long).withColumn("blob", F.sha2("text", 256))
    chunks = (keyed.select("blob", "text").dropDuplicates(["blob"])
              .mapInPandas(cut, "blob string, start long, text string, last boolean"))
    places = chunks.repartition("blob", "start").mapInPandas(pretokenised, "blob string, start long, text string, ends array<long>")
    per_blob = places.groupBy("blob").applyInPandas(stitched, "blob string, ids array<int>")
    long = keyed.select("id", "blob").join(per_blob, "blob").select("id", "ids")
    return short.unionByName(long)


def decode(df: DataFrame, ranks: dict[bytes, int], id_col: str = "id", ids_col: str = "ids", rows: int = 512) -> DataFrame:
    """(id, ids, decoded binary): the ids' bytes in order; null ids give no bytes."""
    shared = df.sparkSession.sparkContext.broadcast(ranks)
    coded = df.select(F.col(id_col).alias("id"), F.coalesce(F.col(ids_col), F.array().cast("array<int>")).alias("ids"))
    id_type = coded.schema["id"].dataType.simpleString()

    def back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw = {i: b for b, i in shared.value.items()}
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                part = batch.slice(at, rows)
                texts = [b"".join(map(raw.__getitem__, ids)) for ids in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.binary())],
                                                 ["id", "ids", "decoded"])

    return coded.mapInArrow(back, f"id {id_type}, ids array<int>, decoded binary")
