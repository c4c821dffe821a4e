"""Language identification of whole, possibly mixed texts.

A word's script narrows the candidate languages; the shares of its character trigrams, learned from
labelled texts, score it under each candidate. Viterbi decoding over the words with a switching penalty
labels spans; the language with the most letters is the text's. A word that no learned language fits is
one in a script that none of them uses, or one whose trigrams are, under the best of its candidates, nearer
to unseen ones than to those of the training texts. A language with fewer than ``LEAST_SEEN`` distinct
trigrams has seen too little for that: it fits every word in its scripts.

The model is fitted on a sample of at most about ``fit_docs_per_lang`` labelled texts a language (whole
texts, drawn by a hash of the id) as counts summed by Spark; its size depends on the number of languages
and on ``BUCKETS`` alone, so it is broadcast. Scoring is one pass without a shuffle.

Defined cases: a null text, one without letters, or a model without languages gives ``und`` and score 0;
rows are independent, so repeated rows and ids get equal results; columns other than the named ones are
ignored; ties go to the language that sorts first.
"""
from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskbook.llm.common import keyed_text, slices

UNKNOWN = "und"
BUCKETS = 1 << 16
#: Evidence of one word at most, and the price of a change of language, in nats.
WORD_LIMIT, SWITCH = 8.0, 12.0
#: Distinct trigrams from which on a language's training texts can tell that a word isn't of it.
LEAST_SEEN = 1_000
#: Characters handled at once: bounds the memory of a task (some 200 bytes a character).
SLICE = 400_000
#: First code points of the ranges of scripts; letters outside all are "other".
SCRIPTS = (
    (0x0041, "latin"), (0x0370, "greek"), (0x0400, "cyrillic"), (0x0530, "armenian"), (0x0590, "hebrew"),
    (0x0600, "arabic"), (0x0900, "devanagari"), (0x0980, "bengali"), (0x0A00, "gurmukhi"), (0x0A80, "gujarati"),
    (0x0B00, "other"), (0x0B80, "tamil"), (0x0C00, "telugu"), (0x0C80, "kannada"), (0x0D00, "malayalam"),
    (0x0D80, "other"), (0x0E00, "thai"), (0x0E80, "other"), (0x10A0, "georgian"), (0x1100, "hangul"),
    (0x1200, "other"), (0x1E00, "latin"), (0x1F00, "greek"), (0x2000, "other"), (0x3040, "kana"),
    (0x3100, "other"), (0x3400, "han"), (0xA000, "other"), (0xAC00, "hangul"), (0xD7B0, "other"),
    (0xF900, "han"), (0xFB00, "latin"), (0xFB07, "other"), (0xFF21, "latin"), (0xFF5B, "other"), (0x20000, "han"),
)
_NAMES = sorted({n for _, n in SCRIPTS})
_END = 10  # stands for everything that isn't a letter
_TABLES: list[np.ndarray] = []


def _tables() -> list[np.ndarray]:
    """By code point: is it a letter; its script. Made once in a process."""
    if not _TABLES:
        points = np.arange(0x110000)
        starts = np.array([s for s, _ in SCRIPTS])
        names = np.array([_NAMES.index(n) for _, n in SCRIPTS], dtype=np.int8)
        _TABLES.append(np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000))
        _TABLES.append(names[np.maximum(np.searchsorted(starts, points, side="right") - 1, 0)])
    return _TABLES


@dataclass
class Words:
    """The words (runs of letters) of some texts: code points with one _END behind each word, the
    words' starts in them, and the number of words of each text."""
    points: np.ndarray
    starts: np.ndarray
    sizes: np.ndarray

    @classmethod
    def of(cls, texts: list[str]) -> Words:
        letter, _ = _tables()
        raw = [_lower(t).encode("utf-32-le", "surrogatepass") + b"\n\0\0\0" for t in texts]
        p = np.frombuffer(b"".join(raw), dtype="<u4")
        is_letter = letter[p]
        before = np.concatenate([[False], is_letter[:-1]])
        first = is_letter & ~before
        ends = np.cumsum([len(r) // 4 for r in raw])
        upto = np.concatenate([[0], np.cumsum(first, dtype=np.int64)])[ends] if len(raw) else np.empty(0, dtype=np.int64)
        keep = is_letter | before
        points = np.where(is_letter, p, _END)[keep].astype(np.int64)
        return cls(points, np.flatnonzero(first[keep]), np.diff(upto, prepend=0))

    def letters(self) -> np.ndarray:
        return np.diff(np.append(self.starts, len(self.points))) - 1

    def scripts(self) -> np.ndarray:
        return _tables()[1][self.points[self.starts]]

    def keys(self) -> np.ndarray:
        """Bucket of the trigram that ends at each point; no trigram reaches over a word's start."""
        cur = self.points
        one = np.concatenate([[_END], cur[:-1]])
        two = np.where(one == _END, 0, np.concatenate([[_END], one[:-1]]))
        h = cur * 0x9E3779B1 + one * 0x85EBCA6B + two * 0xC2B2AE35
        return (h ^ (h >> 15) ^ (h >> 31)) & (BUCKETS - 1)


@dataclass
class Model:
    langs: list[str]
    logp: np.ndarray = field(repr=False)        # (BUCKETS, languages): log share of a trigram in the language
    scripts: np.ndarray = field(repr=False)     # (scripts, languages): does the language use it
    least: np.ndarray | None = field(default=None, repr=False)  # least mean log share of a fitting word, by language

    def evidence(self, words: Words) -> np.ndarray:
        """Log shares of each word's trigrams in each language, summed."""
        return np.add.reduceat(self.logp[words.keys()], words.starts, axis=0, dtype=np.float64)

    def unfit(self, words: Words, evidence: np.ndarray) -> np.ndarray:
        """Does no language fit the word? Each language is asked by itself, so their number doesn't matter."""
        size = np.diff(np.append(words.starts, len(words.points)))[:, None]
        return ~(self.scripts[words.scripts()] & (evidence >= self.least * size)).any(axis=1)

    def scores(self, words: Words, evidence: np.ndarray) -> np.ndarray:
        """Log posterior of each word over its candidates under equal priors, limited below."""
        score = evidence.copy()
        allowed = self.scripts[words.scripts()]
        if not allowed.all():
            none = ~allowed.any(axis=1)
            score = np.where(allowed, score, -np.inf)
            score[none] = 0.0
        score -= score.max(axis=1, keepdims=True)
        score -= np.log(np.exp(score).sum(axis=1, keepdims=True))
        return np.maximum(score, -WORD_LIMIT)


def fit(df: DataFrame, usable: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
        fit_docs_per_lang: int = 2_000) -> Model:
    """Model from the rows for which ``usable`` holds and whose text and language aren't null."""
    labelled = df.where(usable & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(
        F.col(lang_col).alias("lang"), F.col(text_col).alias("text"), F.xxhash64(F.lit("langid"), F.col(id_col)).alias("h"))
    sizes = {r["lang"]: r["n"] for r in labelled.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    langs = sorted(sizes)
    if not langs:
        return Model([], np.zeros((BUCKETS, 0), dtype=np.float32), np.zeros((len(_NAMES), 0), dtype=bool))
    parts = 1 << 30
    share = F.create_map(*[F.lit(x) for k in langs for x in (k, min(parts, int(parts * fit_docs_per_lang / sizes[k])))])
    sample = labelled.where(F.pmod("h", F.lit(parts)) < share[F.col("lang")]).select("lang", "text")

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[str, np.ndarray] = {}
        for frame in frames:
            for lang, rows in frame.groupby("lang"):
                mine = sums.setdefault(lang, np.zeros(BUCKETS + len(_NAMES), dtype=np.int64))
                for i, j in slices(rows["text"].str.len(), SLICE):
                    words = Words.of(rows["text"].iloc[i:j].tolist())
                    mine[:BUCKETS] += np.bincount(words.keys(), minlength=BUCKETS)
                    mine[BUCKETS:] += np.bincount(words.scripts(), minlength=len(_NAMES))
        for lang, mine in sums.items():
            keys = np.flatnonzero(mine)
            yield pd.DataFrame({"lang": lang, "k": keys, "n": mine[keys]})

    got = sample.mapInPandas(count, "lang string, k long, n long").groupBy("lang", "k").agg(F.sum("n").alias("n")).toPandas()
    counts = np.zeros((BUCKETS + len(_NAMES), len(langs)))
    counts[got["k"].to_numpy(dtype=np.int64), pd.Categorical(got["lang"], langs).codes] = got["n"]
    words = counts[BUCKETS:]
    uses = words >= np.maximum(1, 0.005 * words.sum(axis=0))
    smooth = counts[:BUCKETS] + 0.1
    logp = np.log(smooth / smooth.sum(axis=0))
    typical = (counts[:BUCKETS] * logp).sum(axis=0) / np.maximum(counts[:BUCKETS].sum(axis=0), 1)
    least = (typical + np.log(0.1 / smooth.sum(axis=0))) / 2
    least[(counts[:BUCKETS] > 0).sum(axis=0) < LEAST_SEEN] = -np.inf
    return Model(langs, logp.astype(np.float32), uses, least)


def viterbi(scores: np.ndarray, sizes: np.ndarray, switch: float = SWITCH) -> np.ndarray:
    """Best language of every word. ``scores``: the words of all texts one after the other; ``sizes``:
    words of each text (0 allowed).

    A text keeps one language if for no other one a run of words favours that by more than half the
    penalty: every other labelling then loses more in penalties than it gains. That test is a running
    minimum over all texts at once; only the texts that fail it are decoded, word by word in step,
    longest first, so that each step handles those that still have words.
    """
    n, langs = scores.shape
    out = np.zeros(n, dtype=np.int64)
    have = np.flatnonzero(sizes)
    if not len(have) or langs < 2:
        return out
    ends = np.cumsum(sizes)[have]
    starts = ends - sizes[have]
    best = np.add.reduceat(scores, starts, axis=0).argmax(axis=1)
    row = np.repeat(np.arange(len(have)), sizes[have])
    own = scores[np.arange(n), best[row]]
    mixed = np.zeros(len(have), dtype=bool)
    shift = 4.0 * (float(np.abs(scores).sum()) + 1.0) * row  # a step of more than any gain: each text starts anew
    for k in range(langs):
        run = np.cumsum(scores[:, k] - own)
        before = np.concatenate([[0.0], run[:-1]])
        lowest = np.minimum.accumulate(before - shift) + shift
        mixed |= np.maximum.reduceat(run - lowest, starts) > switch / 2
    out[:] = best[row]
    order = np.flatnonzero(mixed)[np.argsort(-sizes[have][mixed], kind="stable")]
    if not len(order):
        return out
    first, length = starts[order], sizes[have][order]
    came = np.empty((int(length.sum()), langs), dtype=np.int16)  # best language of the word before
    base = np.concatenate([[0], np.cumsum(length)[:-1]])
    value = scores[first].copy()
    alive = np.searchsorted(-length, -np.arange(length[0]), side="left")  # texts with more than t words
    same = np.arange(langs)
    for t in range(1, int(length[0])):
        m = int(alive[t])
        v = value[:m]
        top = v.argmax(axis=1)
        jump = v[np.arange(m), top] - switch
        change = jump[:, None] > v
        came[base[:m] + t] = np.where(change, top[:, None], same)
        value[:m] = np.where(change, jump[:, None], v) + scores[first[:m] + t]
    state = value.argmax(axis=1)
    for t in range(int(length[0]) - 1, -1, -1):
        m = int(alive[t])
        out[first[:m] + t] = state[:m]
        if t:
            state[:m] = came[base[:m] + t, state[:m]]
    return out


def _lower(text: str) -> str:
    """Lower case, a code point for each code point, so places in the text stay the same."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(x if len(x := c.lower()) == 1 else x[0] for c in text)


def identify(df: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", with_spans: bool = True) -> DataFrame:
    """(id, lang_pred, score, n_spans, spans, unfit) for each row of ``df``.

    ``score``: posterior-weighted share of the text's letters in spans of ``lang_pred``. ``unfit``: share of
    its letters in words that no learned language fits, 1 without letters or languages. ``spans``:
    [start, end) in code points with their language, from the first letter to the last; null unless
    ``with_spans``.
    """
    shared = df.sparkSession.sparkContext.broadcast(model)
    docs = keyed_text(df, id_col, text_col)
    id_type = docs.schema["id"].dataType.simpleString()
    span_type = "array<struct<start:int,end:int,lang:string>>"
    span_arrow = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("lang", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        langs = np.array([*model.langs, UNKNOWN], dtype=object)
        n_langs = len(model.langs)
        for batch in batches:  # ids, which may be whole rows, stay Arrow columns
            for i, j in slices(pc.utf8_length(batch.column("text")).to_pylist(), SLICE):
                texts = batch.column("text").slice(i, j - i).to_pylist()
                words = Words.of(texts)
                pred, share, unfit = np.full(len(texts), n_langs), np.zeros(len(texts)), np.ones(len(texts))
                n_spans, labels = np.zeros(len(texts), dtype=np.int64), np.zeros(len(words.starts), dtype=np.int64)
                if n_langs and len(words.starts):
                    row = np.repeat(np.arange(len(texts)), words.sizes)
                    evidence = model.evidence(words)
                    s, w = model.scores(words, evidence), words.letters()
                    labels = viterbi(s, words.sizes)
                    mass = np.bincount(row * n_langs + labels, weights=w, minlength=len(texts) * n_langs).reshape(-1, n_langs)
                    total = mass.sum(axis=1)
                    pred = np.where(total > 0, mass.argmax(axis=1), n_langs)
                    sure = np.where(labels == pred[row], w * np.exp(s[np.arange(len(row)), labels]), 0)
                    share = np.clip(np.bincount(row, weights=sure, minlength=len(texts)) / np.maximum(total, 1), 0, 1)
                    strange = np.bincount(row, weights=w * model.unfit(words, evidence), minlength=len(texts))
                    unfit = np.where(total > 0, strange / np.maximum(total, 1), 1.0)
                    change = np.concatenate([[True], (row[1:] != row[:-1]) | (labels[1:] != labels[:-1])])
                    n_spans = np.bincount(row, weights=change, minlength=len(texts)).astype(np.int64)
                spans = _spans(texts, words.sizes, labels, langs, n_spans) if with_spans else [None] * len(texts)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("id").slice(i, j - i), pa.array(langs[pred], pa.string()), pa.array(share, pa.float64()),
                     pa.array(n_spans, pa.int64()), pa.array(spans, span_arrow), pa.array(unfit, pa.float64())],
                    ["id", "lang_pred", "score", "n_spans", "spans", "unfit"])

    return docs.mapInArrow(run, f"id {id_type}, lang_pred string, score double, n_spans long, spans {span_type}, unfit double")


def _spans(texts, sizes, labels, langs, n_spans) -> list[list[tuple[int, int, str]]]:
    out, at = [], 0
    letter, _ = _tables()
    for text, n, count in zip(texts, sizes, n_spans, strict=True):
        mine: list[tuple[int, int, str]] = []
        if count:
            is_letter = letter[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4")]
            edges = np.flatnonzero(np.diff(np.concatenate([[0], is_letter.view(np.int8), [0]])))
            for a, b, k in zip(edges[::2].tolist(), edges[1::2].tolist(), labels[at:at + n], strict=True):
                lang = langs[k]
                if mine and mine[-1][2] == lang:
                    mine[-1] = (mine[-1][0], b, lang)
                else:
                    mine.append((a, b, lang))
        out.append(mine)
        at += n
    return out
