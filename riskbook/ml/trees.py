"""Distributed histogram trees: random forests, extremely randomised trees and boosting.

Rows are binned once: a feature becomes a byte, and thousands of rows with their targets become one block.
A pass over the blocks is one Spark job: each task sums its rows into histograms (sum of the gradient or
target, weight, rows) by tree, node and bin; tasks' histograms are added; the driver chooses splits. A level
of all trees in work is one pass, so its size is trees x nodes x bins and doesn't grow with the rows. Of two
siblings only the one with fewer rows is summed, the other is the parent less that one. All boosted models
(base, folds, display) grow side by side, a round of each in the same passes.

A pass is a job of Spark, and boosting needs some thousands of them, one after the other: with few rows that is
all of the time. So binned rows of at most ``WHOLE_BYTES`` (known from their number) are broadcast, and a task
grows whole models, or some trees of a forest, from all rows: the same sums, splits and draws without passes.

A task's predictions so far are a function of its block and of the trees; a Python worker keeps them as a
cache and works them out again from the trees where it has none (another worker, a lost executor).

Draws (bootstrap weights, random thresholds, the part held out to stop boosting) are functions of a row's
hash and of tree, node and feature, so a fit doesn't depend on how rows lie in partitions or on retries.
"""
from __future__ import annotations

import heapq
import math
import uuid
import zlib
from collections import OrderedDict
from collections.abc import Iterable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field, replace

import numpy as np
import pandas as pd
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskbook.session import collect_garbage

#: Rows of a block at most, and bytes of predictions that one Python worker keeps.
BLOCK_ROWS, KEPT_BYTES = 1 << 16, 1 << 28
#: Rounds between two broadcasts of all trees; bytes of histograms of the trees of a forest that grow together,
#: and bytes that the driver gets in one pass, from all tasks together (large ones make its heap grow).
SNAPSHOT, BATCH_BYTES, PASS_BYTES = 25, 4 << 20, 6 << 20
#: Up to this many tasks send their histograms to the driver, more add them among themselves first.
MOST_SENDERS = 32
#: Rows of a piece of the sample for bin edges: large pieces are what a driver's heap grows by.
PACKED_ROWS = 256
#: Passes after which the driver collects its garbage: every job leaves its task's broadcast and results behind,
#: and a heap that only grows with them holds several times what is in use.
COLLECT_EVERY = 60
#: Binned rows of this many bytes at most are broadcast, and models grow apart from each other; trees of a
#: forest that one task then grows.
WHOLE_BYTES, FOREST_TREES = 32 << 20, 15
#: Boosting stops when this many rounds brought no improvement above TOLERANCE on the held-out share, which
#: is used from STOP_ROWS training rows on (fixed values: the usual defaults of a histogram booster).
PATIENCE, TOLERANCE, HELD_OUT, STOP_ROWS = 10, 1e-7, 0.1, 10_000
_POISSON = np.cumsum([0.36787944117144233, 0.36787944117144233, 0.18393972058572117, 0.061313240195240391, 0.015328310048810098,
                      0.0030656620097620196, 0.00051094366829366991, 7.2991952613381422e-05, 9.1239940766726778e-06])


@dataclass(frozen=True)
class Job:
    """One model to fit. ``fold``: rows of this fold are left out; ``train_only``: validation rows too."""
    name: str
    kind: str                     # boost, forest, extra
    target: str
    features: tuple[str, ...]
    trees: int
    depth: int
    min_leaf: int
    step: float = 1.0
    l2: float = 0.0
    leaves: int = 1 << 30
    fold: int = -1
    train_only: bool = False
    seed: int = 0


@dataclass
class Tree:
    """A binary tree in heap order: children of node i are 2 i + 1 and 2 i + 2; feature -1 is a leaf."""
    feature: np.ndarray           # index into the job's features
    bin: np.ndarray               # codes up to this one go left
    value: np.ndarray
    gain: np.ndarray

    @staticmethod
    def empty(depth: int) -> "Tree":
        n = (1 << (depth + 1)) - 1
        return Tree(np.full(n, -1, dtype=np.int16), np.zeros(n, dtype=np.int16), np.zeros(n), np.zeros(n))

    def node_of(self, codes: np.ndarray, levels: int) -> np.ndarray:
        at = np.zeros(len(codes), dtype=np.int64)
        rows = np.arange(len(codes))
        for _ in range(levels):
            f = self.feature[at]
            below = 2 * at + 1 + (codes[rows, np.maximum(f, 0)] > self.bin[at])
            at = np.where(f >= 0, below, at)
        return at


@dataclass
class Model:
    """base + step-weighted sum (boost) or mean (forests) of trees over raw feature values."""
    features: tuple[str, ...]
    kind: str
    base: float
    feature: np.ndarray = field(repr=False)    # (trees, nodes)
    threshold: np.ndarray = field(repr=False)  # values up to this one go left
    value: np.ndarray = field(repr=False)
    gain: np.ndarray = field(repr=False)

    def predict(self, x: np.ndarray) -> np.ndarray:
        """``x``: (rows, features) in the order of ``features``."""
        total, rows = np.zeros(len(x)), np.arange(len(x))
        levels = int(np.log2(self.feature.shape[1] + 1)) - 1 if len(self.feature) else 0
        for feature, threshold, value in zip(self.feature, self.threshold, self.value, strict=True):
            at = np.zeros(len(x), dtype=np.int64)
            for _ in range(levels):
                f = feature[at]
                if (f < 0).all():
                    break
                at = np.where(f >= 0, 2 * at + 1 + ~(x[rows, np.maximum(f, 0)] <= threshold[at]), at)
            total += value[at]
        return self.base + (total if self.kind == "boost" else total / max(len(self.feature), 1))

    def importances(self) -> np.ndarray:
        """Gain by feature; forests: the mean over trees of each tree's shares."""
        out = np.zeros(len(self.features))
        for feature, gain in zip(self.feature, self.gain, strict=True):
            own = np.bincount(feature[feature >= 0], weights=gain[feature >= 0], minlength=len(self.features))
            out += own if self.kind == "boost" else own / max(own.sum(), 1e-300)
        return out / max(out.sum(), 1e-300)


@dataclass
class Bins:
    """Upper edges of a feature's bins but the last, and a typical value of each bin."""
    edges: dict[str, np.ndarray]
    typical: dict[str, np.ndarray]

    @staticmethod
    def of(sample: pd.DataFrame, most: int) -> "Bins":
        edges, typical = {}, {}
        for name in sample.columns:
            x = np.sort(sample[name].to_numpy(dtype=np.float64))
            kinds = np.unique(x)
            if len(kinds) <= most:
                e = (kinds[:-1] + kinds[1:]) / 2
            else:
                e = np.unique(np.quantile(x, np.arange(1, most) / most))
            edges[name] = e
            code = np.searchsorted(e, kinds, side="left")
            first, last = np.searchsorted(code, np.arange(len(e) + 1)), np.searchsorted(code, np.arange(len(e) + 1), side="right") - 1
            both = np.concatenate([e[:1], (e[:-1] + e[1:]) / 2, e[-1:]]) if len(e) else kinds[:1]
            some = last >= first
            typical[name] = both if not some.any() else np.where(some, (kinds[np.minimum(first, len(kinds) - 1)] + kinds[last]) / 2, both)
        return Bins(edges, typical)

    def codes(self, frame: pd.DataFrame) -> np.ndarray:
        return np.stack([np.searchsorted(e, frame[n].to_numpy(dtype=np.float64), side="left").astype(np.uint8) for n, e in self.edges.items()], axis=1)


def _mixed(*parts) -> np.ndarray:
    """64-bit mix of integers (arrays broadcast against each other)."""
    z = np.uint64(0)
    with np.errstate(over="ignore"):
        for p in parts:
            z = (z ^ np.asarray(p).astype(np.uint64)) + np.uint64(0x9E3779B97F4A7C15)
            z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
            z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
            z = z ^ (z >> np.uint64(31))
    return z


def uniform(*parts) -> np.ndarray:
    return (_mixed(*parts) >> np.uint64(11)).astype(np.float64) * 2.0 ** -53


def bootstrap(h: np.ndarray, seed: int, tree: int) -> np.ndarray:
    """How often each row is drawn: Poisson of mean 1."""
    return np.searchsorted(_POISSON, uniform(h, 101 + seed, tree), side="right")


def held_out(h: np.ndarray, seed: int) -> np.ndarray:
    return uniform(h, 7 + seed, 1) < HELD_OUT


@dataclass
class Layout:
    """Where each feature's bins lie in a histogram row of a job."""
    columns: np.ndarray
    start: np.ndarray
    size: np.ndarray

    @staticmethod
    def of(job: Job, bins: Bins) -> "Layout":
        names = list(bins.edges)
        size = np.array([len(bins.edges[f]) + 1 for f in job.features])
        return Layout(np.array([names.index(f) for f in job.features]), np.cumsum(size) - size, size)

    @property
    def width(self) -> int:
        return int(self.size.sum())


def _block(frames: Iterator[pd.DataFrame], fine: Bins, coarse: Bins, targets: list[str]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        for i in range(0, len(frame), BLOCK_ROWS):
            part = frame.iloc[i:i + BLOCK_ROWS]
            yield pd.DataFrame({"n": [len(part)], "fine": [fine.codes(part).tobytes()], "coarse": [coarse.codes(part).tobytes()],
                                "y": [part[targets].to_numpy(dtype=np.float64).T.tobytes()], "fold": [part["fold"].to_numpy(dtype=np.int64).tobytes()],
                                "train": [part["train"].to_numpy(dtype=bool).tobytes()], "h": [part["h"].to_numpy(dtype=np.int64).tobytes()]})


class _Rows:
    """A block in a task."""

    def __init__(self, row, targets: list[str]):
        n, fine, coarse, y, fold, train, h = row
        self.codes = {"boost": np.frombuffer(fine, dtype=np.uint8).reshape(n, -1), "forest": np.frombuffer(coarse, dtype=np.uint8).reshape(n, -1)}
        self.codes["extra"] = self.codes["forest"]
        self.y = dict(zip(targets, np.frombuffer(y).reshape(len(targets), n), strict=True))
        self.fold, self.train, self.h = np.frombuffer(fold, dtype=np.int64), np.frombuffer(train, dtype=bool), np.frombuffer(h, dtype=np.int64)
        self.starts = np.zeros(1, dtype=np.int64)  # where its blocks begin, if it is several put together
        self.known: dict = {}

    def once(self, key, make):
        """``make()``, worked out once for this block."""
        if key not in self.known:
            self.known[key] = make()
        return self.known[key]

    def usable(self, job: Job) -> np.ndarray:
        return self.once((job.fold, job.train_only), lambda: (self.fold != job.fold) & (self.train if job.train_only else True))

    def held(self, job: Job) -> np.ndarray:
        return self.once((job.seed,), lambda: held_out(self.h, job.seed))

    def columns(self, job: Job, layout: Layout) -> np.ndarray:
        return self.once((job.kind == "boost", job.features), lambda: np.ascontiguousarray(self.codes[job.kind][:, layout.columns]))

    def nodes(self, job: Job, layout: Layout, number: int, tree: "Tree", level: int) -> np.ndarray:
        """Each row's node at a level of a tree; the level before is remembered."""
        key = ("node", job.kind == "boost", job.name, number)
        before, at = self.known.pop(key, (0, None))
        if at is None or before > level:
            before, at = 0, np.zeros(len(self.h), dtype=np.int16)
        codes, rows = self.columns(job, layout), np.arange(len(self.h))
        for _ in range(before, level):
            f = tree.feature[at]
            at = np.where(f >= 0, 2 * at + 1 + (codes[rows, np.maximum(f, 0)] > tree.bin[at]), at).astype(np.int16)
        self.known[key] = (level, at)
        return at

    def times(self, job: Job, number: int) -> np.ndarray:
        return self.once(("times", False, job.name, number), lambda: np.where(self.usable(job), bootstrap(self.h, job.seed, number), 0).astype(np.uint8))

    def tall(self, job: Job, layout: Layout) -> np.ndarray:
        """``columns``, a feature's codes beside each other."""
        return self.once(("tall", job.kind == "boost", job.features), lambda: np.ascontiguousarray(self.columns(job, layout).T))

    def wide(self, job: Job, layout: Layout) -> np.ndarray:
        """``columns`` as places in a histogram row."""
        return self.once(("wide", job.kind == "boost", job.features),
                         lambda: (self.columns(job, layout) + layout.start).astype(np.min_scalar_type(layout.width)))

    def by_block(self, at: np.ndarray) -> list[np.ndarray]:
        """Rows in order, those of a block together. Sums are made by block as passes make them: equal to the last bit."""
        return [x for x in np.split(at, np.searchsorted(at, self.starts[1:])) if len(x)]

    def forget(self, boosted: bool, keep: set) -> None:
        """Drop what is known of trees that aren't in work any more."""
        for key in [k for k in self.known if k[0] in ("node", "times") and k[1] == boosted and k[2:] not in keep]:
            del self.known[key]

    @property
    def nbytes(self) -> int:
        return self.h.nbytes * 16 + sum(x[1].nbytes if isinstance(x, tuple) else x.nbytes for x in self.known.values())


def summed(codes: np.ndarray, layout: Layout, slot: np.ndarray, slots: int, weights: list[np.ndarray | None]) -> list[np.ndarray]:
    """Histograms (slots x width) of the rows with slot >= 0; ``codes`` of the job's features, a weight of
    None counts."""
    at = np.flatnonzero(slot >= 0)
    where = (codes[at] + (layout.start + slot[at, None] * layout.width)).ravel()
    size, k = slots * layout.width, len(layout.columns)
    return [np.bincount(where, weights=None if w is None else np.repeat(w[at], k), minlength=size).astype(np.float64) for w in weights]


def _slots(nodes: list[int], at: np.ndarray, total: int) -> np.ndarray:
    table = np.full(total, -1, dtype=np.int64)
    table[nodes] = np.arange(len(nodes))
    return table[at]


class _Found:
    """Splits and node sums of one tree while it grows."""

    def __init__(self, job: Job, layout: Layout, bins: Bins, number: int):
        self.job, self.layout, self.bins, self.number = job, layout, bins, number
        self.tree, self.level, self.hist = Tree.empty(job.depth), 0, {}
        self.sums: dict[int, np.ndarray] = {}
        self.front, self.wanted, self.pairs = [0], [0], {}
        self.kinds = 3 if job.kind == "forest" else 2

    @property
    def size(self) -> int:
        """Numbers in the histograms of the wanted nodes."""
        return self.kinds * len(self.wanted) * self.layout.width

    def take(self, hists: np.ndarray) -> None:
        """``hists``: (kinds, wanted, width) of the wanted nodes; chooses this level's splits."""
        job, layout, got = self.job, self.layout, {}
        for k, node in enumerate(self.wanted):
            got[node] = hists[:, k]
            if node in self.pairs:
                parent, other = self.pairs[node]
                got[other] = self.hist[parent] - hists[:, k]
        if self.level == 0:
            self.sums[0] = got[0][:, :layout.size[0]].sum(axis=1)
        self.hist, nodes = got, [n for n in self.front if n in got]
        self.front, self.wanted, self.pairs = [], [], {}
        self.level += 1
        if not nodes:
            return
        h = np.stack([got[n] for n in nodes])                                    # (nodes, kinds, width)
        whole = np.cumsum(h, axis=2)
        before = np.where(layout.start > 0, whole[:, :, np.maximum(layout.start - 1, 0)], 0.0)
        left = whole - np.repeat(before, layout.size, axis=2)
        total = np.stack([self.sums[n] for n in nodes])[:, :, None]
        right = total - left
        g, w, c = (0, 1, -1)                                                     # gradient, weight, rows
        with np.errstate(divide="ignore", invalid="ignore"):
            score = lambda s: s[:, g] ** 2 / (s[:, w] + job.l2)
            gain = score(left) + score(right) - score(total)
        fits = (np.rint(left[:, c]) >= job.min_leaf) & (np.rint(right[:, c]) >= job.min_leaf)
        fits[:, layout.start + layout.size - 1] = False
        if job.kind == "extra":
            fits &= self._drawn(h[:, c], nodes)
        gain = np.where(fits, gain, -np.inf)
        best = gain.argmax(axis=1)
        for k, node in enumerate(nodes):
            b = int(best[k])
            if not gain[k, b] > 1e-12 * max(1.0, float(abs(total[k, g, 0]))):
                continue
            f = int(np.searchsorted(layout.start, b, side="right") - 1)
            self.tree.feature[node], self.tree.bin[node], self.tree.gain[node] = f, b - layout.start[f], gain[k, b]
            l, r = 2 * node + 1, 2 * node + 2
            self.sums[l], self.sums[r] = left[k, :, b], right[k, :, b]
            if self.level < job.depth:
                more = [x for x in (l, r) if np.rint(self.sums[x][c]) >= 2 * job.min_leaf]
                self.front += more
                if more:
                    small, large = (l, r) if self.sums[l][c] <= self.sums[r][c] else (r, l)
                    self.wanted.append(small)
                    self.pairs[small] = (node, large)

    def _drawn(self, counts: np.ndarray, nodes: list[int]) -> np.ndarray:
        """One bin a node and feature: a uniform draw between the node's least and largest value."""
        out = np.zeros(counts.shape, dtype=bool)
        for j, (name, start, size) in enumerate(zip(self.job.features, self.layout.start, self.layout.size, strict=True)):
            some = np.rint(counts[:, start:start + size]) > 0
            lo, hi = some.argmax(axis=1), size - 1 - some[:, ::-1].argmax(axis=1)
            u = uniform(self.job.seed, self.number, np.array(nodes), j)
            value = self.bins.typical[name]
            if not len(value):
                continue
            b = np.clip(np.searchsorted(self.bins.edges[name], value[lo] + u * (value[hi] - value[lo]), side="left"), lo, np.maximum(hi - 1, lo))
            split = hi > lo
            out[np.flatnonzero(split), start + b[split]] = True
        return out

    def done(self) -> Tree:
        job, tree = self.job, self.tree
        if int((tree.feature >= 0).sum()) + 1 > job.leaves:  # best gain first, up to the number of leaves
            kept, heap, n = set(), [(-tree.gain[0], 0)], 1
            while heap and n < job.leaves:
                _, node = heapq.heappop(heap)
                kept.add(node)
                n += 1
                for x in (2 * node + 1, 2 * node + 2):
                    if x < len(tree.feature) and tree.feature[x] >= 0:
                        heapq.heappush(heap, (-tree.gain[x], x))
            drop = [x for x in np.flatnonzero(tree.feature >= 0) if x not in kept]
            tree.feature[drop], tree.gain[drop] = -1, 0.0
        for node, s in self.sums.items():
            tree.value[node] = -job.step * s[0] / (s[1] + job.l2) if job.kind == "boost" else s[0] / max(s[1], 1e-300)
        return tree


_KEPT: OrderedDict = OrderedDict()  # of this Python worker: predictions so far, by fit and block
_ROWS: OrderedDict = OrderedDict()  # and blocks


def _rows_of(key, row, targets: list[str]) -> _Rows:
    rows = _ROWS.pop(key, None) or _Rows(row, targets)
    _ROWS[key] = rows
    while sum(r.nbytes for r in _ROWS.values()) > KEPT_BYTES and len(_ROWS) > 1:
        _ROWS.popitem(last=False)
    return rows


def _predictions(key, rows: _Rows, job: Job, layout: Layout, base: float, trees_before: list[Tree], since: int, recent: list[Tree]) -> np.ndarray:
    """Predictions of a boosted model after all its trees: ``trees_before`` and ``recent`` follow each
    other, ``recent`` starting with tree number ``since``."""
    n_trees = since + len(recent)
    number, pred = _KEPT.pop((*key, job.name), (0, None))
    if pred is None or number > n_trees:
        number, pred = 0, np.full(len(rows.h), base)
    if number < n_trees:
        codes = rows.columns(job, layout)
        pred = pred.copy()
        for tree in (trees_before[number:] if number < since else []) + recent[max(0, number - since):]:
            pred += tree.value[tree.node_of(codes, job.depth)]
    _KEPT[(*key, job.name)] = (n_trees, pred)
    while sum(p.nbytes for _, p in _KEPT.values()) > KEPT_BYTES and len(_KEPT) > 1:
        _KEPT.popitem(last=False)
    return pred


def _sums(rows: _Rows, job: Job, layout: Layout, at: np.ndarray, weights: list[np.ndarray | None]) -> np.ndarray:
    """Histograms (kinds x width) of the rows ``at``; a weight of None counts."""
    out, wide = np.zeros((len(weights), layout.width)), rows.wide(job, layout)
    for part in rows.by_block(at):
        where = wide.take(part, axis=0).astype(np.intp).ravel()
        for total, w in zip(out, weights, strict=True):
            total += np.bincount(where, weights=None if w is None else np.repeat(w[part], wide.shape[1]), minlength=layout.width)
    return out


def _grown(found: _Found, rows: _Rows, at: np.ndarray, weights: list[np.ndarray | None], root: np.ndarray) -> tuple[Tree, list[tuple[int, np.ndarray]]]:
    """A tree from the rows ``at`` of ``rows``, all there are, and the rows of each lowest node. ``root``: the
    histograms of the first node."""
    tree, job, layout = found.tree, found.job, found.layout
    tall = rows.tall(job, layout)
    own, lowest = {0: at}, []
    while found.wanted:
        found.take(root[:, None] if found.level == 0 else
                   np.stack([_sums(rows, job, layout, own[n], weights) for n in found.wanted], axis=1))
        below = {}
        for node, some in own.items():
            f = tree.feature[node]
            if f < 0:
                lowest.append((node, some))
                continue
            left = tall[f].take(some) <= tree.bin[node]
            below[2 * node + 1], below[2 * node + 2] = some[left], some[~left]
        own = below
    return found.done(), [*lowest, *own.items()]


def _leaf_above(tree: Tree, node: int) -> int:
    """The leaf that a node's rows end in, after ``done`` has taken splits back."""
    leaf = node
    while node:
        node = (node - 1) // 2
        if tree.feature[node] < 0:
            leaf = node
    return leaf


def _whole_forest(job: Job, layout: Layout, bins: Bins, rows: _Rows, numbers: Iterable[int]) -> list[Tree]:
    """These trees of a forest from all rows."""
    use, y, out = rows.usable(job), rows.y[job.target], []
    at, weights = np.flatnonzero(use), [y, None]
    root = None if job.kind == "forest" else _sums(rows, job, layout, at, weights)
    for number in numbers:
        if job.kind == "forest":
            times = np.where(use, bootstrap(rows.h, job.seed, number), 0)
            at, weights = np.flatnonzero(times), [times * y, times, None]
            root = _sums(rows, job, layout, at, weights)
        out.append(_grown(_Found(job, layout, bins, number), rows, at, weights, root)[0])
    return out


def _whole_boost(job: Job, layout: Layout, bins: Bins, rows: _Rows, stop_rows: int) -> tuple[float, list[Tree]]:
    """A boosted model from all rows: base and trees."""
    use, y, trees, losses = rows.usable(job), rows.y[job.target], [], []
    stopping = use.sum() > stop_rows
    held = np.flatnonzero(use & rows.held(job) & stopping)
    fitted = use & ~(rows.held(job) & stopping)
    at, held_codes = np.flatnonzero(fitted), rows.columns(job, layout)[held]
    base = float(sum(y[x].sum() for x in rows.by_block(at)) / max(len(at), 1))
    pred, counts = np.full(len(y), base), _sums(rows, job, layout, at, [None])
    for number in range(job.trees):
        if stopping:
            losses.append(-0.5 * sum(((pred[x] - y[x]) ** 2).sum() for x in rows.by_block(held)) / max(len(held), 1))
            if _should_stop(losses):
                break
        gradient = pred - y
        root = np.concatenate([_sums(rows, job, layout, at, [gradient]), counts])
        tree, lowest = _grown(_Found(job, layout, bins, number), rows, at, [gradient, None], root)
        for node, some in lowest:
            pred[some] += tree.value[_leaf_above(tree, node)]
        pred[held] += tree.value[tree.node_of(held_codes, job.depth)]
        trees.append(tree)
    return base, trees


class Fit:
    """Blocks of the rows of ``df`` and passes over them.

    ``df``: features, targets, ``fold`` (int), ``train`` (boolean), ``h`` (long, a hash of the row's key).
    Bin edges come from at most about ``sample`` rows, drawn by the hash.
    """

    def __init__(self, df: DataFrame, features: list[str], targets: list[str], fine: int = 255, coarse: int = 64, sample: int = 50_000):
        self.spark, self.targets, self.token = df.sparkSession, targets, uuid.uuid4().hex
        rows = df.select(*[F.col(f).cast("double").alias(f) for f in features], *[F.col(t).cast("double").alias(t) for t in targets], "fold", "train", "h")
        self.n = n = rows.count()
        parts = 1 << 30
        some = rows.where(F.pmod(F.xxhash64("h"), F.lit(parts)) < min(parts, int(parts * sample / max(n, 1)))).select(features)
        # as arrays of bytes: rows would take the driver ten times their size
        packed = [np.frombuffer(r["x"]).reshape(-1, len(features)) for r in some.mapInPandas(_packed, "x binary").collect()]
        some = pd.DataFrame(np.concatenate([np.empty((0, len(features))), *packed]), columns=features)
        self.bins = {"boost": Bins.of(some, fine), "forest": Bins.of(some, coarse)}
        self.bins["extra"] = self.bins["forest"]
        b, c, names = self.bins["boost"], self.bins["forest"], list(targets)
        # a task sends one histogram however many blocks it has: no more tasks than run at once
        parts = max(1, min(rows.rdd.getNumPartitions(), -(-n // 4096), max(4, self.spark.sparkContext.defaultParallelism)))
        blocks = rows.coalesce(parts).mapInPandas(lambda frames: _block(_merged(frames), b, c, names),
                                                  "n int, fine binary, coarse binary, y binary, fold binary, train binary, h binary")
        self.blocks = blocks.rdd.map(tuple).persist(StorageLevel.MEMORY_AND_DISK)
        self.n_parts, self.passes = self.blocks.getNumPartitions(), 0

        self.row_bytes = len(features) * 2 + 8 * len(targets) + 17

    @property
    def senders(self) -> int:
        """Arrays that reach the driver in one pass."""
        return self.n_parts if self.n_parts <= MOST_SENDERS else math.isqrt(self.n_parts - 1) + 1

    def close(self) -> None:
        self.blocks.unpersist()

    def added(self, work) -> np.ndarray:
        """``work(block number, rows)`` gives an array; the sum over all blocks."""
        targets, token, few = self.targets, self.token, self.n_parts <= MOST_SENDERS

        def run(part: int, blocks):
            total = None
            for k, row in enumerate(blocks):
                one = work((part, k), _rows_of((token, part, k), row, targets))
                total = one if total is None else total + one
            return [] if total is None else [_sent(total) if few else total]

        if self.passes % COLLECT_EVERY == 0:
            collect_garbage(self.spark)
        self.passes += 1
        parts = self.blocks.mapPartitionsWithIndex(run)
        if few:
            got = parts.collect()
            return sum(map(_received, got[1:]), _received(got[0])) if got else np.zeros(0)
        return parts.treeReduce(lambda a, b: a + b, depth=2)

    def model(self, job: Job, base: float, trees: list[Tree]) -> Model:
        bins = self.bins[job.kind]
        edges = [np.append(bins.edges[f], np.inf) for f in job.features]
        shape = (len(trees), (1 << (job.depth + 1)) - 1)
        out = Model(job.features, job.kind, base, np.full(shape, -1, dtype=np.int16), np.zeros(shape), np.zeros(shape), np.zeros(shape))
        for k, t in enumerate(trees):
            out.feature[k], out.value[k], out.gain[k] = t.feature, t.value, t.gain
            for node in np.flatnonzero(t.feature >= 0):
                out.threshold[k, node] = edges[t.feature[node]][t.bin[node]]
        return out

    def _passes(self, found: list["_Found"]) -> Iterator[list["_Found"]]:
        """The trees of each pass over one level: together within PASS_BYTES, one tree at least."""
        live, total = [], 0
        for f in found:
            n = 8 * f.size * self.senders
            if live and total + n > PASS_BYTES:
                yield live
                live, total = [], 0
            live.append(f)
            total += n
        if live:
            yield live

    def models(self, jobs: list[Job]) -> dict[str, Model]:
        """All jobs: each by itself where the rows are few, else in passes."""
        if self.n and self.n * self.row_bytes <= WHOLE_BYTES:
            return self.apart(jobs)
        forests = [j for j in jobs if j.kind != "boost"]
        with ThreadPoolExecutor(max_workers=2) as pool:  # passes of boosting are short and many, those of forests long
            grown = pool.submit(self.forests, forests)
            return self.boosted([j for j in jobs if j.kind == "boost"]) | grown.result()

    def apart(self, jobs: list[Job]) -> dict[str, Model]:
        """A task for each boosted model and for every FOREST_TREES trees of a forest; the longest begin first."""
        collect_garbage(self.spark)
        n, *blocks = zip(*self.blocks.collect(), strict=True)
        blocks[2] = [np.concatenate([np.frombuffer(y).reshape(len(self.targets), -1) for y in blocks[2]], axis=1).tobytes()]
        shared, starts = self.spark.sparkContext.broadcast((sum(n), *map(b"".join, blocks))), np.cumsum(n) - n
        del blocks
        bins, targets, token, stop_rows = self.bins, self.targets, self.token, STOP_ROWS
        layouts = {j.name: Layout.of(j, bins[j.kind]) for j in jobs}
        asked = [(j, range(j.trees)) for j in sorted(jobs, key=lambda j: -j.trees * layouts[j.name].width) if j.kind == "boost"]
        asked += [(j, range(k, min(k + FOREST_TREES, j.trees))) for j in jobs if j.kind != "boost" for k in range(0, j.trees, FOREST_TREES)]

        def run(places):
            for k in places:
                job, numbers = asked[k]
                rows, given = _rows_of((token, "whole"), shared.value, targets), (job, layouts[job.name], bins[job.kind])
                rows.starts = starts
                yield k, _whole_boost(*given, rows, stop_rows) if job.kind == "boost" else (0.0, _whole_forest(*given, rows, numbers))

        found = dict(self.spark.sparkContext.parallelize(range(len(asked)), max(1, len(asked))).mapPartitions(run).collect())
        shared.destroy()
        trees: dict[str, list[Tree]] = {j.name: [] for j in jobs}
        base = dict.fromkeys(trees, 0.0)
        for k, (job, _) in enumerate(asked):
            base[job.name] = found[k][0]
            trees[job.name] += found[k][1]
        return {j.name: self.model(j, base[j.name], trees[j.name]) for j in jobs}

    # ---- forests -------------------------------------------------------------------------------------
    def forests(self, jobs: list[Job]) -> dict[str, Model]:
        """Random and extremely randomised forests: all trees of all jobs, as many at once as fit BATCH_BYTES
        (one tree at least).
        Without rows a model is 0."""
        if not self.n:
            return {j.name: self.model(j, 0.0, []) for j in jobs}
        asked, jobs = jobs, _renamed(jobs)
        layouts = {j.name: Layout.of(j, self.bins[j.kind]) for j in jobs}
        every = [_Found(j, layouts[j.name], self.bins[j.kind], t) for j in jobs for t in range(j.trees)]
        out: dict[str, list[Tree]] = {j.name: [] for j in jobs}
        size = lambda f: 24 * f.layout.width * (1 << max(0, f.job.depth - 2))
        while every:
            batch, total = [], 0
            while every and (not batch or total + size(every[0]) <= BATCH_BYTES):
                total += size(every[0])
                batch.append(every.pop(0))
            while any(f.wanted for f in batch):
                for live in self._passes([f for f in batch if f.wanted]):
                    got = self.added(_forest_work([(f.job, f.layout, f.number, f.tree, f.level, f.wanted) for f in live], {(f.job.name, f.number) for f in batch}))
                    at = 0
                    for f in live:
                        n = f.size
                        f.take(got[at:at + n].reshape(f.kinds, len(f.wanted), f.layout.width))
                        at += n
            for f in batch:
                out[f.job.name].append(f.done())
        return {a.name: self.model(j, 0.0, out[j.name]) for a, j in zip(asked, jobs, strict=True)}

    # ---- boosting ------------------------------------------------------------------------------------
    def boosted(self, jobs: list[Job]) -> dict[str, Model]:
        """Boosted models on half squared error, round by round side by side, each stopping by itself.
        Without rows a model is 0."""
        if not self.n:
            return {j.name: self.model(j, 0.0, []) for j in jobs}
        asked, jobs = jobs, _renamed(jobs)
        layouts = {j.name: Layout.of(j, self.bins["boost"]) for j in jobs}
        sums = self.added(lambda _, rows: np.array([[u.sum(), rows.y[j.target][u].sum()] for j in jobs for u in [rows.usable(j)]]))
        stopping = {j.name: s[0] > STOP_ROWS for j, s in zip(jobs, sums, strict=True)}
        part = self.added(lambda _, rows: np.array([[u.sum(), rows.y[j.target][u].sum()] for j in jobs
                                                    for u in [rows.usable(j) & ~(rows.held(j) & stopping[j.name])]]))
        base = {j.name: float(s[1] / max(s[0], 1)) for j, s in zip(jobs, part, strict=True)}
        trees: dict[str, list[Tree]] = {j.name: [] for j in jobs}
        losses: dict[str, list[float]] = {j.name: [] for j in jobs}
        live, since, shared = list(jobs), 0, self.spark.sparkContext.broadcast({})
        for number in range(max((j.trees for j in jobs), default=0) + 1):
            live = [j for j in live if j.trees > number or j.trees == number and stopping[j.name]]
            if number - since >= SNAPSHOT:
                old, since = shared, number
                shared = self.spark.sparkContext.broadcast({j.name: trees[j.name] for j in live})
                old.destroy()
            growing = [_Found(j, layouts[j.name], self.bins["boost"], number) for j in live if j.trees > number]
            first = True
            while live and (first or any(f.wanted for f in growing)):
                now = [f for f in growing if f.wanted]
                recent = {j.name: trees[j.name][since:] for j in live}
                work = _boost_work(self.token, [(f.job, f.layout, f.tree, f.level, f.wanted) for f in now], recent, since, shared, base, stopping,
                                   [(j, layouts[j.name]) for j in live if stopping[j.name]] if first else [])
                got = self.added(work)
                at = 0
                if first:
                    stop = [j for j in live if stopping[j.name]]
                    for j in stop:
                        losses[j.name].append(-0.5 * got[at] / max(got[at + 1], 1))
                        at += 2
                    over = {j.name for j in stop if _should_stop(losses[j.name]) or j.trees == number}
                for f in now:
                    n = 2 * len(f.wanted) * f.layout.width
                    f.take(got[at:at + n].reshape(2, len(f.wanted), f.layout.width))
                    at += n
                if first:
                    live, growing = [j for j in live if j.name not in over], [f for f in growing if f.job.name not in over]
                    first = False
            for f in growing:
                trees[f.job.name].append(f.done())
            if not live:
                break
        shared.destroy()
        return {a.name: self.model(j, base[j.name], trees[j.name]) for a, j in zip(asked, jobs, strict=True)}


def _sent(x: np.ndarray) -> tuple[tuple[int, ...], bytes]:
    """A task's sums on their way to the driver, exact: shape, and the numbers' bytes by place, compressed.
    Counts and empty bins, more than half of a histogram, take next to nothing."""
    planes = np.ascontiguousarray(x, dtype=np.float64).reshape(-1, 1).view(np.uint8).T
    pack = zlib.compressobj(1, strategy=zlib.Z_RLE)
    return x.shape, pack.compress(np.ascontiguousarray(planes).data.cast("B") if planes.size else b"") + pack.flush()


def _received(sent: tuple[tuple[int, ...], bytes]) -> np.ndarray:
    shape, packed = sent
    planes = np.frombuffer(zlib.decompress(packed), dtype=np.uint8).reshape(8, -1)
    return np.ascontiguousarray(planes.T).view(np.float64).reshape(shape)


def _packed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The frames' numbers in pieces of PACKED_ROWS rows."""
    for frame in frames:
        x = frame.to_numpy(dtype=np.float64)
        yield pd.DataFrame({"x": [x[i:i + PACKED_ROWS].tobytes() for i in range(0, len(x), PACKED_ROWS)]})


def _merged(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Frames of about a block's rows."""
    held, n = [], 0
    for frame in frames:
        held.append(frame)
        n += len(frame)
        if n >= BLOCK_ROWS:
            yield pd.concat(held, ignore_index=True)
            held, n = [], 0
    if n:
        yield pd.concat(held, ignore_index=True)


def _renamed(jobs: list[Job]) -> list[Job]:
    """With names of this call alone, so workers' caches never mix two calls."""
    call = uuid.uuid4().hex
    return [replace(j, name=f"{call}-{j.name}") for j in jobs]


def _should_stop(scores: list[float]) -> bool:
    if len(scores) <= PATIENCE:
        return False
    return not any(s > scores[-PATIENCE - 1] + TOLERANCE for s in scores[-PATIENCE:])


def _forest_work(items, keep: set):
    """``keep``: all trees that are in work, in this pass or another one."""
    def work(_, rows: _Rows) -> np.ndarray:
        out = []
        rows.forget(False, keep)
        for job, layout, number, tree, level, wanted in items:
            y, codes = rows.y[job.target], rows.columns(job, layout)
            slot = _slots(wanted, rows.nodes(job, layout, number, tree, level), len(tree.feature))
            if job.kind == "forest":
                times = rows.times(job, number)
                out += summed(codes, layout, np.where(times > 0, slot, -1), len(wanted), [times * y, times, None])
            else:
                out += summed(codes, layout, np.where(rows.usable(job), slot, -1), len(wanted), [y, None])
        return np.concatenate(out)

    return work


def _boost_work(token, items, recent, since, shared, base, stopping, losses):
    def work(block, rows: _Rows) -> np.ndarray:
        out, preds = [], {}
        rows.forget(True, {(job.name, since + len(recent[job.name])) for job, *_ in items})

        def pred(job, layout):
            if job.name not in preds:
                preds[job.name] = _predictions((token, *block), rows, job, layout, base[job.name], shared.value.get(job.name, []), since, recent[job.name])
            return preds[job.name]

        for job, layout in losses:
            at = rows.usable(job) & rows.held(job)
            out.append(np.array([((pred(job, layout)[at] - rows.y[job.target][at]) ** 2).sum(), at.sum()]))
        for job, layout, tree, level, wanted in items:
            use = rows.usable(job)
            if stopping[job.name]:
                use = use & ~rows.held(job)
            gradient = pred(job, layout) - rows.y[job.target]
            codes = rows.columns(job, layout)
            number = since + len(recent[job.name])
            slot = _slots(wanted, rows.nodes(job, layout, number, tree, level), len(tree.feature))
            out += summed(codes, layout, np.where(use, slot, -1), len(wanted), [gradient, None])
        return np.concatenate(out) if out else np.zeros(0)

    return work
