"""Suffix-array dedup by depth-limited radix sort.

Suffixes are ordered through ``DEPTH`` bytes only, by most-significant-digit
passes over digits of ``DIGIT`` real bytes; a group that is still equal after
the last digit is a repeated window, and every byte that a repeated window
covers is removed. A suffix that is alone in its group after a pass is dropped.

A text of n bytes has n suffixes, and moving one 8-byte digit of each would
already cost 8 bytes of shuffle a byte of text. So suffixes are dealt to buckets
before they are sorted, and equal suffixes always meet in one bucket:

1. Deal. A window's bucket is the ``DIGIT``-byte string of least hash inside its
   ``DEPTH`` bytes (the first of several). Equal windows hold the same strings,
   so they go to the same bucket; one bucket serves a run of neighbouring
   windows, about 76 of them, and runs are what moves.
2. Prune. A bucket with one run in the corpus holds no repeat (two-pass Bloom
   filter). Runs whose whole content is equal are equal window by window; they
   are settled, and one of them stands for all.
3. Sort. The runs left in open buckets go to their bucket with their bytes, and
   their suffixes are sorted: every DIGIT-byte string is ranked in byte order,
   then pass k refines the groups by the rank of bytes k * DIGIT onwards. Small
   buckets share a task's sort; a bucket of more than ``GROUP`` different
   contents is sorted by the whole cluster, a shuffle a pass on (group, digit).

Windows of a text never reach into another. The sort compares bytes. Contents of
runs, and digits in buckets sorted by the cluster, are compared as 128-bit
hashes.

Defined results: null text is empty; texts shorter than DEPTH bytes keep every
byte; repeated rows are occurrences of their own, so both lose the windows that
they share; an empty table gives an empty result; ids may repeat, be null or be
of any type.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._shared import Prefix, Repeats, Scratch, chunks, mix, null_safe_key, ship

DEPTH = 200
DIGIT = 50
GROUP = 2048
PIECE = 1 << 20


class _Runs:
    """The runs of windows of some texts, laid end to end."""

    def __init__(self, texts: list[bytes], depth: int, digit: int):
        self.p = Prefix(b"".join(texts))
        n = len(self.p.raw)
        ends = np.cumsum([len(t) for t in texts])
        self.starts = ends - [len(t) for t in texts]
        self.lo = self.hi = self.at = self.doc = np.zeros(0, np.int64)
        self.key = np.zeros(0, np.uint64)
        width = depth - digit + 1
        windows, m = n - depth + 1, n - digit + 1
        if windows <= 0:
            return
        h = self.p.hash(slice(0, m), slice(digit, n + 1))
        packed = (h & np.uint64(0xFFFFFFFF00000000)) | np.arange(m, dtype=np.uint64)
        rows = -(-m // width)
        pad = np.full(rows * width, np.uint64(2**64 - 1))
        pad[:m] = packed
        pad = pad.reshape(rows, width)
        ahead = np.minimum.accumulate(pad, axis=1).ravel()
        behind = np.minimum.accumulate(pad[:, ::-1], axis=1)[:, ::-1].ravel()
        at = (np.minimum(behind[:windows], ahead[width - 1 : width - 1 + windows]) & np.uint64(0xFFFFFFFF)).astype(np.int64)
        inside = np.zeros(n + 1, np.int32)
        ok = ends - self.starts >= depth
        np.add.at(inside, self.starts[ok], 1)
        np.add.at(inside, (ends - depth + 1)[ok], -1)
        s = np.flatnonzero(np.cumsum(inside[:windows]) > 0)
        if not len(s):
            return
        at = at[s]
        doc = np.searchsorted(ends, s, side="right")
        new = np.flatnonzero(np.concatenate([[True], (at[1:] != at[:-1]) | (doc[1:] != doc[:-1])]))
        self.lo, self.hi = s[new], s[np.concatenate([new[1:] - 1, [len(s) - 1]])]
        self.at, self.doc, self.key = at[new], doc[new], h[at[new]]

    def content(self, depth: int) -> tuple[np.ndarray, np.ndarray]:
        """128 bits of what the windows of each run span."""
        shape = mix((self.hi - self.lo).astype(np.uint64) * np.uint64(1 << 20) + (self.at - self.lo).astype(np.uint64))
        again = Prefix(self.p.raw, second=True)
        return tuple(mix(p.hash(self.lo, self.hi + depth) + shape).view(np.int64) for p in (self.p, again))


def rank_strings(raw: np.ndarray, width: int) -> np.ndarray:
    """For each place of a buffer, the rank in byte order of the ``width`` bytes
    that begin there (zeros stand behind the end). Strings of 8 bytes are ranked
    as numbers; ranks of two halves, which may overlap, give those of twice the
    width."""
    padded = np.concatenate([raw, np.zeros(width + 8, np.uint8)])
    size = min(8, width)
    key = np.zeros(len(raw), np.uint64)
    for i in range(size):
        key = (key << np.uint64(8)) | padded[i : i + len(raw)]
    rank = np.unique(key, return_inverse=True)[1].astype(np.uint64)
    while size < width:
        step = min(size, width - size)
        second = np.concatenate([rank[step:] + np.uint64(1), np.zeros(step, np.uint64)])[: len(raw)]
        rank = np.unique((rank << np.uint64(32)) | second, return_inverse=True)[1].astype(np.uint64)
        size += step
    return rank


def radix_groups(raw: np.ndarray, starts: np.ndarray, depth: int, digit: int, weight: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(at, group): the suffixes starts[at] that equal another one through
    ``depth`` bytes, with group numbers that follow byte order. A suffix of
    weight above 1 stands for several and is its own repeat. No suffix may reach
    past the buffer's end."""
    weight = np.ones(len(starts), np.int64) if weight is None else weight
    live, group = np.arange(len(starts)), np.zeros(len(starts), np.uint64)
    rank = rank_strings(raw, digit)
    for at in range(0, depth, digit):
        # a last digit that is cut short begins earlier: the bytes that it
        # shares with the one before are equal within a group
        at = min(at, depth - digit)
        _, group = np.unique((group << np.uint64(32)) | rank[starts[live] + at], return_inverse=True)
        more = np.bincount(group, weights=weight[live])[group] > 1.5
        live, group = live[more], group[more].astype(np.uint64)
    return live, group


def _bytes(text) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass")


def _pieces(b: pa.RecordBatch):
    texts = [_bytes(t) for t in b.column("text").to_pylist()]
    for rows in chunks(list(range(len(texts))), lambda i: len(texts[i]) + 1, PIECE):
        yield rows[0], [texts[i] for i in rows]


def _find_runs(depth: int, digit: int):
    def run(batches):
        for b in batches:
            for first, texts in _pieces(b):
                r = _Runs(texts, depth, digit)
                if len(r.lo):
                    own = pa.array(r.doc + first)
                    content, check = r.content(depth)
                    base = r.starts[r.doc]
                    yield pa.record_batch({"digit": pa.array(r.key.view(np.int64)), "content": pa.array(content), "check": pa.array(check), "id": b.column("id").take(own), "text_key": b.column("text_key").take(own), "lo": pa.array((r.lo - base).astype(np.int32)), "hi": pa.array((r.hi - base).astype(np.int32))})

    return run


def _merge(lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Unions of the ranges [lo, hi), in order."""
    order = np.argsort(lo, kind="stable")
    lo, top = lo[order], np.maximum.accumulate(hi[order])
    new = np.flatnonzero(np.concatenate([[True], lo[1:] > top[:-1]]))
    return lo[new], top[np.concatenate([new[1:] - 1, [len(lo) - 1]])]


def repeated_spans(docs: DataFrame, depth: int = DEPTH, digit: int = DIGIT, group: int = GROUP) -> DataFrame:
    """docs (id, text_key, text) → (id, text_key, spans): byte ranges, maximal
    and in order, that windows occurring elsewhere too cover. A row per
    distinct (id, text_key) with a span."""
    spark = docs.sparkSession
    ship(spark)
    scratch = Scratch(spark)
    run = "digit long, content long, check long, id long, text_key long, lo int, hi int"
    runs = scratch.save(docs.mapInArrow(_find_runs(depth, digit), run))
    repeats = Repeats(scratch, runs, "digit", runs.count())
    maybe = scratch.save(repeats.flag(runs, "digit").where("maybe").drop("maybe"))
    repeats.close()
    scratch.drop(runs)
    key, place = ["digit", "content", "check"], ("id", "text_key", "lo", "hi")
    contents = scratch.save(maybe.groupBy(*key).agg(F.count("*").alias("n"), *[F.first(c).alias(c) for c in place]))
    equal = contents.where("n > 1").select(*key)
    settled = maybe.join(equal, key, "left_semi").select("id", "text_key", "lo", (F.col("hi") + depth).alias("hi"))
    digits = contents.groupBy("digit").agg(F.count("*").alias("contents"), F.min("n").alias("least")).where("contents > 1 AND least = 1")
    open_ = contents.join(digits.select("digit", "contents"), "digit")

    def cut_out(batches):
        for b in batches:
            ids, keys, texts = b.column("id").to_pylist(), b.column("text_key").to_pylist(), b.column("text")
            for i, own in enumerate(b.column("open").to_pylist()):
                data = _bytes(texts[i].as_py())
                for k in range(0, len(own), 20_000):
                    c = list(zip(*[(o["digit"], o["n"], o["contents"], ids[i], keys[i], o["lo"], data[o["lo"] : o["hi"] + depth]) for o in own[k : k + 20_000]]))
                    yield pa.record_batch([pa.array(x, t) for x, t in zip(c, _PART.types)], schema=_PART)

    by_doc = open_.groupBy("id", "text_key").agg(F.collect_list(F.struct("digit", "n", "contents", "lo", "hi")).alias("open"))
    # a repeated row yields its parts twice; those have n > 1, for which more is the same
    parts = docs.join(by_doc, ["id", "text_key"]).select("id", "text_key", "text", "open").mapInArrow(cut_out, _PART_SQL)
    parts = scratch.save(parts)

    def suffixes(b: pa.Table):
        """The bytes of some runs end to end, and of each suffix its place, its
        run and its place in the run."""
        data = b.column("data").to_pylist()
        raw = np.frombuffer(b"".join(data), np.uint8)
        size = np.fromiter(map(len, data), np.int64, len(data))
        many = size - depth + 1
        owner = np.repeat(np.arange(len(data)), many)
        place = np.arange(len(owner)) - np.repeat(np.cumsum(many) - many, many)
        return raw, place + (np.cumsum(size) - size)[owner], owner, place

    def sort_here(batches):
        for g in _whole_digits(batches):
            raw, starts, owner, place = suffixes(g)
            n = g.column("n").to_numpy()
            at, _ = radix_groups(raw, starts, depth, digit, n[owner])
            at = np.sort(at[n[owner[at]] == 1])
            if not len(at):
                continue
            own, s = owner[at], (place + g.column("lo").to_numpy()[owner])[at]
            new = np.flatnonzero(np.concatenate([[True], (own[1:] != own[:-1]) | (s[1:] != s[:-1] + 1)]))
            last = np.concatenate([new[1:] - 1, [len(s) - 1]])
            own = own[new]
            yield pa.record_batch({"id": pa.array(g.column("id").to_numpy()[own]), "text_key": pa.array(g.column("text_key").to_numpy()[own]), "lo": pa.array(s[new].astype(np.int32)), "hi": pa.array((s[last] + depth).astype(np.int32))})

    ends = [min(k, depth - digit) for k in range(0, depth, digit)]

    def spell(batches):
        """Suffixes of large buckets as rows: their digits."""
        for b in batches:
            for rows in chunks(list(range(b.num_rows)), lambda i, d=b.column("data"): len(d[i].as_py()), PIECE):
                own = pa.Table.from_batches([b.slice(rows[0], len(rows))])
                raw, starts, owner, place = suffixes(own)
                p = [Prefix(raw), Prefix(raw, second=True)]
                spelt = np.stack([x.hash(starts + k, starts + k + digit) for k in ends for x in p], axis=1).view(np.int64)
                yield pa.record_batch({
                    **{c: pa.array(own.column(c).to_numpy()[owner]) for c in ("digit", "n", "id", "text_key")},
                    "lo": pa.array((own.column("lo").to_numpy()[owner] + place).astype(np.int32)), "spelt": pa.FixedSizeListArray.from_arrays(pa.array(spelt.ravel()), 2 * len(ends)).cast(pa.list_(pa.int64())),
                })

    found = parts.where(F.col("contents") <= group).repartition("digit").sortWithinPartitions("digit").mapInArrow(sort_here, "id long, text_key long, lo int, hi int")
    live = parts.where(F.col("contents") > group)
    spread = live.where("false").select("id", "text_key", "lo", F.col("lo").alias("hi"))
    if not live.isEmpty():
        live = scratch.save(live.mapInArrow(spell, "digit long, n long, id long, text_key long, lo int, spelt array<long>"))
        for k in range(len(ends)):
            group_ = F.slice("spelt", 1, 2 * (k + 1)).alias("group")
            again = live.groupBy("digit", group_).agg(F.sum("n").alias("total")).where("total > 1").select("digit", "group")
            kept = scratch.save(live.withColumn("group", group_).join(again, ["digit", "group"], "left_semi").drop("group"))
            scratch.drop(live)
            live = kept
        spread = live.where("n = 1").select("id", "text_key", "lo", (F.col("lo") + depth).alias("hi"))

    def unite(batches):
        for b in batches:
            ids, keys, spans = b.column("id"), b.column("text_key"), []
            for x in b.column("all"):
                v = x.values
                lo, hi = _merge(v.field("lo").to_numpy(), v.field("hi").to_numpy())
                spans.append([{"lo": int(p), "hi": int(q)} for p, q in zip(lo, hi)])
            yield pa.record_batch({"id": ids, "text_key": keys, "spans": pa.array(spans, pa.list_(pa.struct([("lo", pa.int32()), ("hi", pa.int32())])))})

    every = settled.union(found).union(spread)
    spans = every.groupBy("id", "text_key").agg(F.collect_set(F.struct("lo", "hi")).alias("all")).mapInArrow(unite, "id long, text_key long, spans array<struct<lo:int,hi:int>>")
    out = scratch.cut(spans)
    scratch.drop(maybe, contents, parts)
    return out


_PART_SQL = "digit long, n long, contents long, id long, text_key long, lo int, data binary"
_PART = pa.schema([("digit", pa.int64()), ("n", pa.int64()), ("contents", pa.int64()), ("id", pa.int64()), ("text_key", pa.int64()), ("lo", pa.int32()), ("data", pa.binary())])


def _whole_digits(batches, rows: int = 4096):
    """Tables of all rows of some digits, from batches sorted by digit; about
    ``rows`` rows, or those of one digit."""
    held, n = [], 0
    for b in batches:
        if not b.num_rows:
            continue
        k = b.column("digit").to_numpy()
        cuts = np.flatnonzero(np.concatenate([[not held or held[-1].column("digit")[held[-1].num_rows - 1].as_py() != k[0]], k[1:] != k[:-1]]))
        at = 0
        for c in cuts.tolist():
            if n + c - at >= rows:
                held.append(b.slice(at, c - at))
                yield pa.Table.from_batches(held).combine_chunks()
                held, n, at = [], 0, c
        held.append(b.slice(at))
        n += b.num_rows - at
    if n:
        yield pa.Table.from_batches(held).combine_chunks()


def remove_repeats(docs: DataFrame, depth: int = DEPTH, digit: int = DIGIT, group: int = GROUP, id_col="doc_id", text_col="text") -> DataFrame:
    """One row per row of docs: doc_id, n_bytes, n_removed, n_spans, kept
    (the remaining bytes), spans."""
    d = docs.select(F.col(id_col).alias("doc_id"), null_safe_key(id_col).alias("id"), F.xxhash64(text_col).alias("text_key"), F.col(text_col).alias("text"))
    spans = repeated_spans(d.select("id", "text_key", "text"), depth, digit, group)
    kind = d.schema["doc_id"].dataType.simpleString()

    def cut(batches):
        for b in batches:
            rows = []
            for text, spans in zip(b.column("text").to_pylist(), b.column("spans").to_pylist()):
                data, at, kept = _bytes(text), 0, []
                for s in spans or ():
                    kept.append(data[at : s["lo"]])
                    at = s["hi"]
                kept.append(data[at:])
                kept = b"".join(kept)
                rows.append((len(data), len(data) - len(kept), len(spans or ()), kept))
            n, removed, count, kept = zip(*rows) if rows else ((),) * 4
            yield pa.record_batch({"doc_id": b.column("doc_id"), "n_bytes": pa.array(n, pa.int64()), "n_removed": pa.array(removed, pa.int64()), "n_spans": pa.array(count, pa.int64()), "kept": pa.array(kept, pa.binary()), "spans": b.column("spans")})

    joined = d.join(spans, ["id", "text_key"], "left").select("doc_id", "text", "spans")
    return joined.mapInArrow(cut, f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept binary, spans array<struct<lo:int,hi:int>>")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def brute_force(texts: list[str | None], depth: int = DEPTH) -> list[tuple[int, int, int, str]]:
    """(n_bytes, n_removed, n_spans, kept_sha256) per text, by counting every
    window; for tests."""
    data = [_bytes(t) for t in texts]
    seen: dict[bytes, int] = {}
    for t in data:
        for i in range(len(t) - depth + 1):
            seen[t[i : i + depth]] = seen.get(t[i : i + depth], 0) + 1
    out = []
    for t in data:
        gone = np.zeros(len(t) + 2, bool)
        for i in range(len(t) - depth + 1):
            if seen[t[i : i + depth]] > 1:
                gone[i + 1 : i + depth + 1] = True
        spans = int((np.diff(gone.astype(np.int8)) == 1).sum())
        kept = bytes(c for c, g in zip(t, gone[1:]) if not g)
        out.append((len(t), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return out
