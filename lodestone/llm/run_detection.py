"""Periodic runs of words by Crochemore's partition refinement.

A text is a sequence of words. Positions are classed by the factor of length l
that starts there; classes of length l + 1 come from those of length l by
splitting off the positions in front of small classes, where of the parts that
a class fell into all but the largest count as small. Every position is
therefore moved O(log n) times. Two neighbouring members of a class whose
distance is l start a square of period l; neighbours pairs are kept by distance
and looked at when l reaches it. A pair with a third member between has a
shorter period, so only squares with their smallest period are seen. Squares
that start at consecutive words make one run.

The texts of some Arrow batches are refined together, a class never spans two
of them, so a level of refinement is a few numpy calls for all. A level
costs in proportion to the positions that move; refinement of a text ends at a
quarter of its length, as a run repeats its period four times, or when all of
its factors differ.

Defined results: null text or text without words has no runs and collapses to
the empty text; a null id is kept; repeated rows give repeated results; ties do
not matter, as all runs are returned; an empty table gives an empty result. A
text is held whole by its task, with some 150 bytes a word.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._shared import ship, tidy

TIMES = 4  # a run repeats its period so often at least
LEAST = 6  # and has so many words at least
WORDS = 400_000  # of the texts that are refined together, one text may have more
FEW = 64  # pairs that are filed one by one


class _Pairs:
    """Neighbour pairs (position, distance) until their distance is asked for."""

    def __init__(self):
        self.sorted, self.single = [], {}

    def add(self, at: np.ndarray, gap: np.ndarray) -> None:
        if len(at) <= FEW:
            for i, d in zip(at.tolist(), gap.tolist()):
                self.single.setdefault(d, []).append(i)
            return
        o = np.argsort(gap, kind="stable")
        self.sorted.append((gap[o], at[o]))
        if len(self.sorted) > 6:
            gap, at = map(np.concatenate, zip(*self.sorted))
            o = np.argsort(gap, kind="stable")
            self.sorted = [(gap[o], at[o])]

    def pop(self, d: int) -> np.ndarray:
        """Pairs of distance d; those of shorter ones have been asked for."""
        out, left = [np.array(self.single.pop(d, []), np.int64)], []
        for gap, at in self.sorted:
            n = int(np.searchsorted(gap, d, side="right"))
            out.append(at[:n])
            if n < len(gap):
                left.append((gap[n:], at[n:]))
        self.sorted = left
        return np.concatenate(out)


class _Classes:
    """A partition of positions. The members of a class are a segment of
    ``perm``, and linked in the order of their places."""

    def __init__(self, code: np.ndarray):
        n = len(code)
        self.perm = np.argsort(code, kind="stable")
        own = code[self.perm]
        first = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
        self.n = len(first)
        self.start, self.size = np.zeros(n, np.int64), np.zeros(n, np.int64)
        self.start[: self.n] = first
        self.size[: self.n] = np.diff(np.append(first, n))
        self.cls, self.loc = np.empty(n, np.int64), np.empty(n, np.int64)
        self.cls[self.perm] = np.repeat(np.arange(self.n), self.size[: self.n])
        self.loc[self.perm] = np.arange(n)
        self.nxt, self.prv = np.full(n, -1), np.full(n, -1)
        same = own[1:] == own[:-1]
        a, b = self.perm[:-1][same], self.perm[1:][same]
        self.nxt[a], self.prv[b] = b, a
        self.gone = np.zeros(n, bool)

    def members(self, ids: np.ndarray) -> np.ndarray:
        n = self.size[ids]
        return self.perm[np.repeat(self.start[ids] - np.cumsum(n) + n, n) + np.arange(n.sum())]

    def split(self, p: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Takes the positions p (ascending) out of their classes and classes
        them by the class of the next position. Returns the positions of small
        parts, and the new neighbour pairs (left, right)."""
        cls, nxt, prv, gone = self.cls, self.nxt, self.prv, self.gone
        p = p[np.argsort(cls[p], kind="stable")]
        gone[p] = True
        before, after = prv[p], nxt[p]
        left = before[(before < 0) | ~gone[before]]
        right = after[(after < 0) | ~gone[after]]
        has_left, has_right = left >= 0, right >= 0
        nxt[left[has_left]] = right[has_left]
        prv[right[has_right]] = left[has_right]
        closed = has_left & has_right
        # parts: by class, then by the next position's class
        key = cls[p] * (len(cls) + 1) + cls[p + 1]
        o = np.argsort(key, kind="stable")
        p, key = p[o], key[o]
        new_part = np.concatenate([[True], key[1:] != key[:-1]])
        part = np.flatnonzero(new_part)
        n_part = np.diff(np.append(part, len(p)))
        owner = cls[p[part]]
        first_part = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
        ids, at = owner[first_part], part[first_part]
        moved = np.diff(np.append(at, len(p)))
        rest = self.size[ids] - moved
        # the moved ones go to the end of their class's segment
        cut = self.start[ids] + rest
        slots = np.repeat(cut - at, moved) + np.arange(len(p))
        there, here = self.perm[slots], self.loc[p]
        stay, holes = there[~gone[there]], here[here < np.repeat(cut, moved)]
        self.perm[holes], self.loc[stay] = stay, holes
        self.perm[slots], self.loc[p] = p, slots
        gone[p] = False
        # ids: a class that is left empty gives its id to its largest part
        most = np.maximum.reduceat(n_part, first_part)
        of = np.repeat(np.arange(len(ids)), np.diff(np.append(first_part, len(part))))
        largest = np.minimum.reduceat(np.where(n_part == most[of], np.arange(len(part)), len(part)), first_part)
        fresh = np.ones(len(part), bool)
        fresh[largest[rest == 0]] = False
        name = np.empty(len(part), np.int64)
        name[fresh] = self.n + np.arange(fresh.sum())
        name[largest[rest == 0]] = ids[rest == 0]
        self.n += int(fresh.sum())
        self.size[ids] = rest
        self.size[name], self.start[name] = n_part, slots[part]
        cls[p] = np.repeat(name, n_part)
        same = ~new_part[1:]
        a, b = p[:-1][same], p[1:][same]
        unknown = nxt[a] != b
        nxt[p], prv[p] = -1, -1
        nxt[a], prv[b] = b, a
        small = np.ones(len(part), bool)
        small[largest[most > rest]] = False
        left_small = ids[(most > rest) & (rest > 0)]
        moving = np.concatenate([p[np.repeat(small, n_part)], self.members(left_small)])
        return moving, np.concatenate([left[closed], a[unknown]]), np.concatenate([right[closed], b[unknown]])


def find_runs(texts: list[np.ndarray], times: int = TIMES, least: int = LEAST) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Texts as arrays of word codes → (text, start, length, period) of all
    runs, by text, start and period."""
    sizes = np.array([len(t) for t in texts], np.int64)
    none = np.zeros(0, np.int64)
    if not len(texts) or sizes.max() < least:
        return none, none, none, none
    first = np.concatenate([[0], np.cumsum(sizes + 1)])[:-1]
    # codes that no other text has, and an end of its own for each
    span = np.array([int(t.max()) + 2 if len(t) else 1 for t in texts], np.int64)
    base = np.cumsum(span) - span
    code = np.concatenate([x for t, b, s in zip(texts, base, span) for x in (t + b, [b + s - 1])]).astype(np.int64)
    owner = np.repeat(np.arange(len(texts)), sizes + 1)
    limit = (sizes // times)[owner]
    c = _Classes(code)
    pairs = _Pairs()

    def note(a, b, over):
        near = (b - a > over) & (b - a <= limit[a])
        pairs.add(a[near], (b - a)[near])

    a = np.flatnonzero(c.nxt >= 0)
    note(a, c.nxt[a], 0)
    # the first split may leave out the largest class of each text
    ids = np.arange(c.n)
    o = np.lexsort((c.size[: c.n], owner[c.perm[c.start[: c.n]]]))
    texts_of = owner[c.perm[c.start[o]]]
    large = np.zeros(c.n, bool)
    large[ids[o][np.append(texts_of[1:] != texts_of[:-1], True)]] = True
    moving = np.flatnonzero(~large[c.cls])
    found = []
    for period in range(1, int(limit.max()) + 1):
        at = pairs.pop(period)
        at = np.sort(at[c.nxt[at] == at + period])
        if len(at):
            edge = np.flatnonzero(np.diff(at) != 1)
            begin, end = at[np.append(0, edge + 1)], at[np.append(edge, len(at) - 1)]
            length = end - begin + 2 * period
            keep = length >= max(least, times * period)
            found.append((begin[keep], length[keep], np.full(int(keep.sum()), period)))
        p = moving - 1
        p = p[p >= 0]
        p = np.sort(p[(c.size[c.cls[p]] > 1) & (limit[p] > period)])
        if not len(p):
            break
        moving, a, b = c.split(p)
        note(a, b, period)
    # what is filed for longer factors was dropped: all of them differ
    if not found:
        return none, none, none, none
    start, length, period = map(np.concatenate, zip(*found))
    text = owner[start]
    o = np.lexsort((period, start, text))
    return text[o], (start - first[text])[o], length[o], period[o]


def codes_of(words: list[bytes]) -> np.ndarray:
    """Words as numbers, equal for equal words of this text alone."""
    seen: dict[bytes, int] = {}
    return np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int64, len(words))


def kept_words(n: int, start: np.ndarray, length: np.ndarray, period: np.ndarray) -> np.ndarray:
    """Mask of the words outside of runs or among the first ``period`` words of
    every run that they are in."""
    drop = np.zeros(n + 1, np.int64)
    np.add.at(drop, start + period, 1)
    np.add.at(drop, start + length, -1)
    return np.cumsum(drop[:-1]) == 0


RUNS = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))


def runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, runs (array of start, length, period in
    words, by start and period) and collapsed, the text without the repetitions
    of its runs, words joined by one blank."""
    ship(docs.sparkSession)
    d = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    schema = d.select("doc_id").schema.add("runs", T.ArrayType(T.StructType([T.StructField(n, T.LongType()) for n in ("start", "length", "period")]))).add("collapsed", "binary")

    def flush(ids: list, words: list[list[bytes]], codes: list[np.ndarray]):
        text, start, length, period = find_runs(codes)
        edge = np.searchsorted(text, np.arange(len(words) + 1))
        collapsed = []
        for w, lo, hi in zip(words, edge, edge[1:]):
            if hi > lo:
                keep = kept_words(len(w), start[lo:hi], length[lo:hi], period[lo:hi])
                w = [w[i] for i in np.flatnonzero(keep).tolist()]
            collapsed.append(b" ".join(w))
        rows = pa.StructArray.from_arrays([pa.array(start), pa.array(length), pa.array(period)], fields=list(RUNS.value_type))
        lists = pa.ListArray.from_arrays(pa.array(edge, pa.int32()), rows).cast(RUNS)
        found = pa.Table.from_arrays([pa.concat_arrays(ids), lists, pa.array(collapsed, pa.binary())], names=["doc_id", "runs", "collapsed"])
        yield from found.to_batches(max_chunksize=max(1, len(words) // (1 + sum(map(len, collapsed)) // (4 << 20))))

    def run(batches):
        ids, words, codes, n = [], [], [], 0
        for b in batches:
            at = 0
            for i, t in enumerate(b.column("text")):
                w = (t.as_py() or b"").split()
                words.append(w)
                codes.append(codes_of(w))
                n += len(w)
                if n >= WORDS:
                    yield from flush([*ids, b.column("doc_id").slice(at, i + 1 - at)], words, codes)
                    ids, words, codes, n, at = [], [], [], 0, i + 1
            if at < b.num_rows:
                ids.append(b.column("doc_id").slice(at))
        if words:
            yield from flush(ids, words, codes)

    return d.mapInArrow(tidy(run), schema).withColumn("collapsed", F.col("collapsed").cast("string"))


def periodic(id_col: str, text_col: str) -> tuple[Column, Column, Column]:
    """For the query, whose texts repeat themselves where h = crc32(id) ends in
    0, the words from a on those first p of them: the words (for a column w),
    whether the row is chosen, and the new text out of w."""
    words = F.regexp_extract_all(text_col, F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))
    n, h = F.size("w"), F.crc32(F.col(id_col).cast("string"))
    g = F.floor(h / 10)
    a = F.pmod(g, n).cast("int")
    p = (1 + F.floor((n - a) / (3 + g % 8))).cast("int")
    unit = F.slice("w", a + 1, F.least(p, n - a))
    tail = F.slice(F.flatten(F.array_repeat(unit, F.ceil((n - a) / p).cast("int"))), F.lit(1), n - a)
    again = F.array_join(F.concat(F.slice("w", F.lit(1), a), tail), " ")
    return words, (h % 10 == 0), F.when(n > 0, again).otherwise(F.lit(""))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    words, chosen, again = periodic("doc_id", "text")
    docs = docs.withColumn("w", F.when(chosen, words))
    out = runs(docs.select("doc_id", F.when(chosen & F.col("w").isNotNull(), again).otherwise(F.col("text")).alias("text")))
    # of all runs the one with the greatest length / period, compared as products
    order = F.expr("array_sort(runs, (a, b) -> CASE WHEN a.length * b.period > b.length * a.period THEN -1 WHEN a.length * b.period < b.length * a.period THEN 1 WHEN a.start < b.start OR (a.start = b.start AND a.period < b.period) THEN -1 WHEN a.start = b.start AND a.period = b.period THEN 0 ELSE 1 END)")
    out = out.withColumn("best", F.get(order, F.lit(0)))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")), F.lit("\n"))), "")
    return out.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), F.col("best.start").alias("start"), F.col("best.length").alias("length"), F.col("best.period").alias("period"),
        F.expr("1000 * best.length div best.period").alias("exponent_milli"), F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
