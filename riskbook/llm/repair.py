"""Conversation structure repair by rank-convergence parallel Viterbi.

A conversation is repaired by the cheapest edits after which its role initials read ``(s?(ua)+)?``: keep a
row (0), rerole it to user or assistant (2), delete it (3; blank rows and repeats must go), insert an empty
turn (2); a truncated row that stays costs 1. Four states say what has been read (nothing, a system turn,
a user turn, an assistant turn); the least cost still to pay from each state, before each row, is a vector
that is computed backwards. A conversation is cut into chunks, which start at once, each from a guessed
vector behind it; a vector matters only up to a constant. In a fix-up pass a chunk whose right neighbour
came out with a vector that differs from the guess by more than a constant runs again; vectors of real
conversations agree after one or two passes. What has not converged after ``passes`` passes is finished
exactly by doubling: chunks' (min, +) matrices are multiplied over 1, 2, 4, ... chunks. The edits are read
off forwards, the ASCII-least initial first among those that keep the least cost; how each chunk maps the
state before it to that after it is composed over chunks by doubling as well.

Equal rows with one turn number are counted, not kept apart, so no hot row is a hot group; rows are dealt
by ranges of (conversation, turn, hash), so a conversation of any length is spread over tasks. Per-chunk
work is Python over some hundred rows; counts, order, neighbours and composition are Spark's.

Defined cases: null roles and texts are one space; rows are ordered by turn number (null first), then by a
hash of role and text; a null conversation id is a conversation; initials other than s, u, a and an empty
role can't be kept; repeated rows are duplicates, also of a turn long before; gaps stop at the largest
64-bit number; an empty table gives no rows; other columns are ignored. The audit and the repaired text of one
conversation are one value each, so a conversation's text must fit one row of the result.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskbook.session import materialize

KEEP, REROLE, DELETE, INSERT = 0, 2, 3, 2
#: States: nothing read, system, user, assistant. Least costs behind the last row.
END = (0, 4, 2, 0)
#: By initial (s, u, a, any other): the state after a kept row, for each state in which it may stand.
_KEPT = ({0: 1}, {0: 2, 1: 2, 3: 2}, {2: 3}, {})
#: The state after the next turn that isn't a system turn.
_NEXT = (2, 2, 3, 2)
_ROLE = {2: "user", 3: "assistant"}
_SPACE = "\x20\x09\x0a\x0b\x0c\x0d"
_CHUNK = ("c string, kinds binary, gone array<long>, roles array<string>, texts array<string>, blank long, duplicate long, "
          "truncated long, illegal long, first string, last string")


def costs_back(kinds: bytes, behind) -> list[tuple]:
    """Least cost from each state before each row, and behind the last. A kind is the initial's number,
    plus 4 if the row is truncated."""
    out = [tuple(behind)]
    for kind in reversed(kinds):
        v, cut, kept = out[-1], kind >> 2, _KEPT[kind & 3]
        b = [min(DELETE + v[q], REROLE + cut + v[_NEXT[q]], KEEP + cut + v[kept[q]] if q in kept else 1 << 60) for q in range(4)]
        u, a = min(b[2], INSERT + b[3]), min(b[3], INSERT + b[2])
        out.append((min(b[0], INSERT + u), min(b[1], INSERT + u), u, a))
    return out[::-1]


def trace(kinds: bytes, gone, costs: list[tuple], state: int, last: bool) -> tuple[int, str, list[tuple[str | None, int | None]], int]:
    """(state behind, edits, turns, cost) of the least edits from ``state``. A turn is (its new role or
    None, its row or None); ``gone[i]`` rows that must go stand before row i. Only behind the ``last``
    chunk are turns inserted at the end."""
    audit, turns, cost = [], [], 0
    for i, kind in enumerate(kinds):
        audit.append("D" * int(gone[i]))
        v, w, cut, kept = costs[i], costs[i + 1], kind >> 2, _KEPT[kind & 3]
        while v[state] != DELETE + w[state] and v[state] == INSERT + v[_NEXT[state]]:
            state = _NEXT[state]
            audit.append("I")
            turns.append((_ROLE[state], None))
        if v[state] == DELETE + w[state]:
            audit.append("D")
        elif state in kept and v[state] == KEEP + cut + w[kept[state]]:
            state, cost = kept[state], cost + cut
            audit.append("K")
            turns.append((None, i))
        else:
            state, cost = _NEXT[state], cost + cut
            audit.append("R")
            turns.append((_ROLE[state], i))
    audit.append("D" * int(gone[-1]))
    while last and END[state]:
        state = _NEXT[state]
        audit.append("I")
        turns.append((_ROLE[state], None))
    edits = "".join(audit)
    return state, edits, turns, cost + DELETE * edits.count("D") + INSERT * edits.count("I") + REROLE * edits.count("R")


def _least_zero(vector) -> list[int]:
    return [int(x - min(vector)) for x in vector]


def _chunked(size: int, chars: int):
    """Sorted rows (c, role, text, n, again) to chunks of at most ``size`` rows that may stay."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, done, before = None, [], (None, "")

        def close():
            c, kinds, gone, roles, texts, counts, first, last, _ = held
            done.append((c, bytes(kinds), gone, roles, texts, *counts, first, last))

        for frame in frames:
            for c, role, text, n, again in zip(*[frame[x].tolist() for x in ("c", "role", "text", "n", "again")], strict=True):
                initial, bare = role[:1], text.strip(_SPACE)
                stays = bool(bare) and not again
                if held and (held[0] != c or stays and (len(held[1]) >= size or held[8] + len(text) > chars)):
                    close()
                    held, before = None, (None, "")
                if not held:
                    held = [c, [], [0], [], [], [0, 0, 0, 0], initial, initial, 0]
                counts, pair = held[5], before[1] + initial
                counts[3] += n - (before[0] != c or pair in ("su", "ua", "au"))  # a row's copies stand beside each other
                before = (c, initial)
                held[7] = initial
                counts[0 if not bare else 1] += n - stays
                if stays:
                    cut = bare[-1] not in ".!?"
                    counts[2] += cut
                    held[1].append(("sua".find(initial) if initial and initial in "sua" else 3) + 4 * cut)
                    held[3].append(role)
                    held[4].append(text)
                    held[2].append(0)
                    held[8] += len(text)
                held[2][-1] += n - stays
            if len(done) > 64:
                yield pd.DataFrame(done, columns=_NAMES)
                done = []
        if held:
            close()
        if done:
            yield pd.DataFrame(done, columns=_NAMES)

    return run


_NAMES = [x.split()[0] for x in _CHUNK.split(", ")]


def chunks_of(df: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str, size: int, chars: int) -> tuple[DataFrame, DataFrame]:
    """The chunks, numbered (``no``) so that neighbours of a conversation follow each other, and
    (c, gaps). ``illegal`` counts pairs within a chunk."""
    turn = F.col(turn_col).cast("long")
    rows = df.select(_key(F.col(conv_col)).alias("c"), turn.isNotNull().cast("int").alias("t0"), F.coalesce(turn, F.lit(0)).alias("t1"),
                     F.coalesce(F.col(role_col), F.lit(" ")).alias("role"), F.coalesce(F.col(text_col), F.lit(" ")).alias("text"))
    rows = rows.withColumn("hash", F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), 256))
    rows = materialize(rows.groupBy("c", "t0", "t1", "role", "text", "hash").agg(F.count(F.lit(1)).alias("n")), "repair")
    first = rows.groupBy("c", "hash").agg(F.min(F.struct("t0", "t1")).alias("first"))
    wide = lambda x: F.col(x).cast("decimal(20,0)")
    turns = rows.where("t0 = 1").groupBy("c", "t1").count().groupBy("c").agg(F.max("t1").alias("hi"), F.min("t1").alias("lo"), F.count(F.lit(1)).alias("seen"))
    missing = wide("hi") - wide("lo") + 1 - wide("seen")
    gaps = turns.select("c", F.least(missing, F.lit((1 << 63) - 1).cast("decimal(20,0)")).cast("long").alias("gaps"))
    order = ["c", "t0", "t1", "hash"]
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    marked = rows.join(first, ["c", "hash"]).select(*order, "role", "text", "n", (F.struct("t0", "t1") != F.col("first")).alias("again"))
    placed = marked.repartitionByRange(parts, *order).sortWithinPartitions(*order).select("c", "role", "text", "n", "again")
    chunks = materialize(placed.mapInPandas(_chunked(size, chars), _CHUNK).withColumn("at", F.monotonically_increasing_id()), "repair")
    part = F.shiftright("at", 33)
    sizes = chunks.groupBy(part.alias("part")).count()  # one row a partition
    before = F.sum("count").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    offsets = sizes.select("part", F.coalesce(before, F.lit(0)).alias("before"))
    numbered = chunks.withColumn("part", part).join(F.broadcast(offsets), "part")
    return numbered.withColumn("no", F.col("before") + F.col("at").bitwiseAND((1 << 33) - 1)).drop("part", "at", "before"), gaps


def _key(conv: Column) -> Column:
    """A non-null text for a conversation id."""
    return F.when(conv.isNull(), F.lit("-")).otherwise(F.concat(F.lit("="), conv.cast("string")))


def _spanned(df: DataFrame, longest: int, combine, ahead: int) -> DataFrame:
    """(c, no, m): ``m`` combined over all chunks of a conversation from this one on (``ahead`` 1) or up to
    it (-1), by doubling."""
    reach = 1
    while reach < longest:
        other = df.select("c", (F.col("no") - reach * ahead).alias("no"), F.col("m").alias("other"))
        both = F.when(F.col("other").isNull(), F.col("m")).otherwise(combine(F.col("m"), F.col("other")))
        df = materialize(df.join(other, ["c", "no"], "left").select("c", "no", both.alias("m")), "repair")
        reach *= 2
    return df


def _product(a: Column, b: Column) -> Column:
    """(min, +) product of two 4 x 4 matrices by rows."""
    return F.transform(F.sequence(F.lit(0), F.lit(15)), lambda i: F.array_min(F.transform(
        F.sequence(F.lit(0), F.lit(3)), lambda k: F.get(a, (F.floor(i / 4) * 4 + k).cast("int")) + F.get(b, k * 4 + i % 4))))


def _vectors(links: DataFrame, longest: int, passes: int) -> DataFrame:
    """(c, no, vec) for (c, no, kinds, linked): the vector behind each chunk, its least entry 0."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            again = [w is not None and (v is None or list(w) != list(v)) for v, w in zip(frame["vec"], frame["wanted"], strict=True)]
            vec = [list(w if x else v) for v, w, x in zip(frame["vec"], frame["wanted"], again, strict=True)]
            out = [_least_zero(costs_back(k, v)[0]) if x else o for k, v, x, o in zip(frame["kinds"], vec, again, frame["out"], strict=True)]
            yield pd.DataFrame({"c": frame["c"], "no": frame["no"], "kinds": frame["kinds"], "linked": frame["linked"], "vec": vec, "out": out})

    schema = "c string, no long, kinds binary, linked boolean, vec array<long>, out array<long>"
    end, nothing = F.array(*[F.lit(x).cast("long") for x in END]), F.lit(None).cast("array<long>")
    state = links.withColumns({"vec": nothing, "out": nothing, "wanted": end})
    for _ in range(passes):
        state = materialize(state.select("c", "no", "kinds", "linked", "vec", "out", "wanted").mapInPandas(run, schema), "repair")
        wanted = state.select("c", (F.col("no") - 1).alias("no"), F.col("out").alias("wanted"))
        state = state.join(wanted, ["c", "no"], "left")
        if state.where("linked and wanted != vec").isEmpty():
            return state.select("c", "no", "vec")

    def matrices(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        far = 1 << 40  # more than any chunk's cost
        for frame in frames:
            found = [np.array([costs_back(k, [0 if r == q else far for r in range(4)])[0] for q in range(4)]).T for k in frame["kinds"]]
            yield pd.DataFrame({"c": frame["c"], "no": frame["no"], "m": [m.ravel().tolist() for m in found]})

    whole = _spanned(materialize(links.select("c", "no", "kinds").mapInPandas(matrices, "c string, no long, m array<long>"), "repair"), longest, _product, 1)
    ends = F.transform(F.sequence(F.lit(0), F.lit(3)), lambda q: F.array_min(F.transform(
        F.sequence(F.lit(0), F.lit(3)), lambda r: F.get("m", q * 4 + r) + F.get(end, r))))
    out = whole.select("c", (F.col("no") - 1).alias("no"), F.transform(ends, lambda x: x - F.array_min(ends)).alias("vec"))
    return links.select("c", "no").join(out, ["c", "no"], "left").select("c", "no", F.coalesce("vec", end).alias("vec"))


def repair(df: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text",
           size: int = 256, chars: int = 4_000_000, passes: int = 6) -> DataFrame:
    """(conv, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired): one row a conversation.

    ``illegal``: neighbouring rows whose initials aren't su, ua or au; ``audit``: the edits' initials;
    ``repaired``: the repaired turns as ``role:text`` lines.
    """
    chunks, gaps = chunks_of(df, conv_col, turn_col, role_col, text_col, size, chars)
    longest = chunks.groupBy("c").count().agg(F.max("count")).first()[0] or 0
    if longest <= 1:  # no conversation has neighbouring chunks
        end = F.array(*[F.lit(x).cast("long") for x in END])
        known = chunks.withColumns({"vec": end, "state": F.lit(0), "linked": F.lit(False), "joint": F.lit(0)})
    else:
        after = chunks.select("c", (F.col("no") - 1).alias("no"), F.col("first").alias("then"))
        links = chunks.select("c", "no", "kinds", "last").join(after, ["c", "no"], "left")
        joint = F.when(F.col("then").isNotNull() & ~F.concat("last", "then").isin("su", "ua", "au"), 1).otherwise(0)
        links = materialize(links.select("c", "no", "kinds", F.col("then").isNotNull().alias("linked"), joint.alias("joint")), "repair")
        vectors = materialize(links.join(_vectors(links.drop("joint"), longest, passes), ["c", "no"]), "repair")

        def maps(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for frame in frames:
                found = []
                for kinds, vec in zip(frame["kinds"], frame["vec"], strict=True):
                    costs, none = costs_back(kinds, vec), [0] * (len(kinds) + 1)
                    found.append([trace(kinds, none, costs, q, False)[0] for q in range(4)])
                yield pd.DataFrame({"c": frame["c"], "no": frame["no"], "m": found})

        states = _spanned(materialize(vectors.select("c", "no", "kinds", "vec").mapInPandas(maps, "c string, no long, m array<long>"), "repair"),
                          longest, lambda m, before: F.transform(before, lambda q: F.get(m, q.cast("int"))), -1)
        states = states.select("c", (F.col("no") + 1).alias("no"), F.get("m", F.lit(0)).cast("int").alias("state"))
        known = chunks.join(vectors.drop("kinds"), ["c", "no"]).join(states, ["c", "no"], "left").withColumn("state", F.coalesce("state", F.lit(0)))

    def edit(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for kinds, gone, roles, texts, vec, state, linked in zip(*[frame[x] for x in ("kinds", "gone", "roles", "texts", "vec", "state", "linked")], strict=True):
                _, audit, turns, cost = trace(kinds, gone, costs_back(kinds, vec), int(state), not linked)
                lines = [f"{roles[i] if role is None else role}:{'' if i is None else texts[i]}" for role, i in turns]
                out.append((audit, "\n".join(lines) if lines else None, cost))
            yield pd.concat([frame[["c", "no", "blank", "duplicate", "truncated"]].reset_index(drop=True), (frame["illegal"] + frame["joint"]).rename("illegal").reset_index(drop=True),
                             pd.DataFrame(out, columns=["audit", "lines", "cost"])], axis=1)

    edited = known.mapInPandas(edit, "c string, no long, blank long, duplicate long, truncated long, illegal long, audit string, lines string, cost long")
    counts = ("blank", "duplicate", "truncated", "illegal", "cost")
    whole = edited.groupBy("c").agg(*[F.sum(x).alias(x) for x in counts], F.sort_array(F.collect_list(F.struct("no", "audit", "lines"))).alias("pieces"))
    whole = whole.join(gaps, "c", "left").select("c", "gaps", *counts, F.array_join("pieces.audit", "").alias("audit"),
                                                 F.array_join("pieces.lines", "\n").alias("repaired"))  # array_join passes over nulls
    turns = df.select(F.col(conv_col).alias("conv")).distinct().withColumn("c", _key(F.col("conv")))
    zero = lambda x: F.coalesce(x, F.lit(0).cast("long")).alias(x)
    return turns.join(whole, "c", "left").select("conv", *[zero(x) for x in ("gaps", *counts)],
                                                 F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired", F.lit("")).alias("repaired"))


def damage(df: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Rows with faults by crc32 of ``conv:turn`` modulo 20: 0 drops a row, 1 empties its text, 2 removes
    its marks ``.!?``, 3 repeats it, 4 makes it the user's. Nulls are one space (turn and id stay null)."""
    spaced = lambda x: F.coalesce(F.col(x).cast("string"), F.lit(" "))
    fault = F.crc32(F.concat_ws(":", spaced(conv_col), spaced(turn_col))) % 20
    rows = df.select(F.col(conv_col).alias("conv_id"), F.col(turn_col).alias("turn"), spaced(role_col).alias("role"), spaced(text_col).alias("text"), fault.alias("fault"))
    text = F.when(F.col("fault") == 1, "").when(F.col("fault") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    return rows.where("fault != 0").select(
        "conv_id", "turn", F.when(F.col("fault") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"),
        F.explode(F.array_repeat(F.lit(0), F.when(F.col("fault") == 3, 2).otherwise(1))).alias("copy")).drop("copy")
