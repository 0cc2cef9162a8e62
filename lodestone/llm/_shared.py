"""Helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
import gc
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.runtime import checkpoint_folder, send_package

BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


def _bytes(size: str) -> int:
    return int(size.rstrip("bB")) if size.rstrip("bB").isdigit() else 1 << 62


def ship(spark: SparkSession) -> None:
    """Get workers ready: they can import this package, and Arrow batches are
    bounded to 4 MB, as one exists several times over in the executor and in
    the worker."""
    if _bytes(spark.conf.get(BATCH_BYTES)) > 4 << 20:
        spark.conf.set(BATCH_BYTES, str(4 << 20))
    send_package(spark)


class Scratch:
    """Tables in the shared folder named by ``spark.checkpoint.dir``.

    ``save`` writes a table that the operator reads again; ``drop`` removes
    those it no longer needs; ``cut`` ends the lineage of a frame that the
    returned result still reads (a reliable checkpoint; Spark removes it only
    where spark.cleaner.referenceTracking.cleanCheckpoints is on).
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        folder = checkpoint_folder(spark)
        self.base = f"{folder.rstrip('/')}/scratch-{uuid.uuid4().hex}"
        self.n = 0

    def save(self, df: DataFrame) -> DataFrame:
        path = f"{self.base}/{self.n}"
        self.n += 1
        df.write.parquet(path)
        release(self.spark)
        out = self.spark.read.schema(df.schema).parquet(path)
        out.lodestone_path = path
        return out

    def cut(self, df: DataFrame) -> DataFrame:
        out = df.checkpoint(eager=True)
        release(self.spark)
        return out

    def drop(self, *frames: DataFrame) -> None:
        jvm = self.spark.sparkContext._jvm
        conf = self.spark.sparkContext._jsc.hadoopConfiguration()
        for df in frames:
            path = jvm.org.apache.hadoop.fs.Path(df.lodestone_path)
            path.getFileSystem(conf).delete(path, True)


def release(spark: SparkSession) -> None:
    """Let Spark remove shuffle files of plans that nothing refers to."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def tidy(run):
    """``run`` for mapInArrow; after its last batch the worker, which stays for
    further tasks, gives the memory that it has freed back to the system."""
    def task(batches):
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of glibc
        if trim:
            trim(0)

    return task


def null_safe_key(c: str):
    """A long that stands for a nullable id of any type; equal ids give equal
    keys. Two ids may share a key, so it is joined on beside a text's hash."""
    return F.when(F.col(c).isNull(), F.lit(-(2**63))).otherwise(F.xxhash64(c))


# --------------------------------------------------------------------------
# hashing of byte ranges and word ranges with numpy

_rng = np.random.default_rng(20240607)
BYTE_CODE = _rng.integers(0, 2**64, 256, dtype=np.uint64)
LOWER_CODE = BYTE_CODE.copy()
LOWER_CODE[65:91] = BYTE_CODE[97:123]
SECOND_CODE = _rng.integers(0, 2**64, 256, dtype=np.uint64)
_BASE, _SECOND_BASE = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F
_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**i mod 2**64 for i < n."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        have = np.ones(1 << max(n - 1, 1 << 16).bit_length(), np.uint64)
        filled = 1
        while filled < len(have):
            k = min(filled, len(have) - filled)
            have[filled : filled + k] = have[:k] * np.uint64(pow(base, filled, 2**64))
            filled += k
        _powers[base] = have
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit."""
    x = x ^ (x >> np.uint64(32))
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x


class Prefix:
    """Hashes of any byte range of a buffer, from one pass over it.

    A byte's random code times a power of an odd base is summed modulo 2**64;
    a difference of two sums, taken back to power 0, depends on the range's
    content alone.
    """

    def __init__(self, data, lower: bool = False, second: bool = False):
        """``second`` gives hashes independent of the first ones."""
        self.raw = np.frombuffer(data, np.uint8)
        base, code = (_SECOND_BASE, SECOND_CODE) if second else (_BASE, LOWER_CODE if lower else BYTE_CODE)
        n = len(self.raw)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(code[self.raw] * powers(base, n), out=self.sums[1:])
        self.back = powers(pow(base, -1, 2**64), n + 1)

    def hash(self, start, end) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.back[start])


IS_SPACE = np.zeros(256, bool)
IS_SPACE[[9, 10, 11, 12, 13, 32]] = True


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words ``[^\\x20\\x09-\\x0D]+`` of the texts, A-Z lower-cased,
    and for each text the index of its first word (one more entry at the end)."""
    data = b" ".join(texts) + b" "
    p = Prefix(data, lower=True)
    space = IS_SPACE[p.raw]
    edge = np.flatnonzero(np.diff(space.view(np.int8), prepend=np.int8(1)))
    start, end = edge[0::2], edge[1::2]
    lengths = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
    first = np.concatenate([[0], np.cumsum(lengths)])
    return p.hash(start, end), np.searchsorted(start, first)


def chunks(values: list, size, most: int):
    """Runs of the list whose sizes sum to ``most`` or that have one item."""
    run, total = [], 0
    for v in values:
        s = size(v)
        if run and total + s > most:
            yield run
            run, total = [], 0
        run.append(v)
        total += s
    if run:
        yield run


# --------------------------------------------------------------------------
# which keys occur more than once: a two-pass Bloom filter

SLICE = 1 << 16  # cells of a slice; a key's cells lie in one slice
MAX_FILTER_BITS = 1 << 27  # 16 MB: the bound of what is broadcast
LEAST_BITS = 8  # cells a key at least


def _bits_for(rows: int) -> int:
    """Cells for so many keys: 16 to 32 of them a key, fewer only where that
    keeps the filter within the broadcast bound; never below LEAST_BITS."""
    want = max(SLICE, 1 << (16 * max(rows, 1) - 1).bit_length())
    return MAX_FILTER_BITS if MAX_FILTER_BITS < want and LEAST_BITS * rows <= MAX_FILTER_BITS else want


def _cells(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Both places of a key inside its slice."""
    k = keys.view(np.uint64)
    return (k >> np.uint64(32)) & np.uint64(SLICE - 1), k >> np.uint64(48)


def _pack(mask: int):
    """Keys of a task → packed cells by slice, at most twice each."""
    def flush(held):
        u, n = np.unique(np.concatenate(held).view(np.uint64), return_counts=True)
        u = np.concatenate([u, u[n > 1]])
        place = u & np.uint64(mask)
        order = np.argsort(place, kind="stable")
        u, place = u[order], place[order]
        ids, at = np.unique(place, return_index=True)
        both = np.stack(_cells(u), axis=1).astype("<u2")
        at = [*at, len(u)]
        return pa.record_batch({"slice": pa.array(ids.astype(np.int64)), "cells": pa.array([both[a:b].tobytes() for a, b in zip(at, at[1:])], pa.binary())})

    def run(batches):
        held, n = [], 0
        for b in batches:
            if b.num_rows:
                held.append(b.column(0).to_numpy(zero_copy_only=False).astype(np.int64, copy=False))
                n += b.num_rows
            if n >= 1 << 20:
                yield flush(held)
                held, n = [], 0
        if held:
            yield flush(held)

    return run


def _merge_slices(batches):
    """Packed cells, sorted by slice → the cells that were hit twice. One slice
    of two-bit counts is held at a time, whatever the number of tasks."""
    now, seen = None, None

    def done():
        return pa.record_batch({"slice": pa.array([now], pa.int64()), "bits": pa.array([np.packbits(seen == 2, bitorder="little").tobytes()], pa.binary())})

    for b in batches:
        for s, cells in zip(b.column("slice").to_pylist(), b.column("cells")):
            if s != now:
                if now is not None:
                    yield done()
                now, seen = s, np.zeros(SLICE, np.uint8)
            own = np.bincount(np.frombuffer(cells.as_buffer(), "<u2"), minlength=SLICE)
            seen = np.minimum(seen + np.minimum(own, 2), 2).astype(np.uint8)
    if now is not None:
        yield done()


class Repeats:
    """The keys of a column that may occur more than once.

    A key (a long with well mixed bits) has two cells in one slice of a bitmap
    that is sized by the number of keys. The first pass folds saturating counts
    per task and merges them slice by slice. A key that occurs twice hits both
    of its cells twice, so none is missed; of the keys that occur once some 2 to
    5 per cent pass. A bitmap of up to MAX_FILTER_BITS is broadcast; a larger
    one stays a table, and the rows that are tested go to its slices.
    """

    def __init__(self, scratch: Scratch, df: DataFrame, key: str, rows: int):
        n = _bits_for(rows)
        self.scratch, self.mask, self.table, self.sent = scratch, n // SLICE - 1, None, None
        packed = df.select(F.col(key).alias("k")).where("k is not null").mapInArrow(_pack(self.mask), "slice long, cells binary")
        slices = packed.repartition("slice").sortWithinPartitions("slice").mapInArrow(_merge_slices, "slice long, bits binary")
        if n > MAX_FILTER_BITS:
            self.table = scratch.save(slices)
            return
        bits = np.zeros(n // 8, np.uint8)
        for row in slices.toLocalIterator():
            bits[row["slice"] * (SLICE // 8) : (row["slice"] + 1) * (SLICE // 8)] = np.frombuffer(row["bits"], np.uint8)
        self.sent = df.sparkSession.sparkContext.broadcast(bits)

    def tester(self):
        """A function of an array of keys, for workers; only for a bitmap that
        is broadcast."""
        sent, mask = self.sent, np.uint64(self.mask)

        def maybe(keys: np.ndarray) -> np.ndarray:
            k = keys.view(np.uint64)
            return _hit(sent.value, k, (k & mask) * np.uint64(SLICE))

        return maybe

    def flag(self, df: DataFrame, key: str) -> DataFrame:
        """df with a boolean column ``maybe``."""
        kinds = [(f.name, f.dataType.simpleString()) for f in df.schema.fields]
        schema = ", ".join([*[f"`{n}` {t}" for n, t in kinds], "maybe boolean"])
        if self.sent is not None:
            maybe = self.tester()

            def test(batches):
                for b in batches:
                    yield pa.record_batch({**{n: b.column(n) for n, _ in kinds}, "maybe": pa.array(maybe(b.column(key).to_numpy(zero_copy_only=False).astype(np.int64, copy=False)))})

            return df.mapInArrow(test, schema)
        rows = df.select(F.col(key).bitwiseAND(F.lit(self.mask)).alias("__slice"), F.lit(None).cast("binary").alias("__bits"), *df.columns)
        slices = self.table.select(F.col("slice").alias("__slice"), F.col("bits").alias("__bits"), *[F.lit(None).cast(t).alias(n) for n, t in kinds])

        def at_slices(batches):
            at, bits = None, np.zeros(SLICE // 8, np.uint8)
            for b in batches:
                place, own = b.column("__slice").to_numpy(), b.column("__bits")
                cut = [0, *(np.flatnonzero(place[1:] != place[:-1]) + 1).tolist(), b.num_rows] if b.num_rows else [0]
                for lo, hi in zip(cut, cut[1:]):
                    if own[lo].is_valid:
                        at, bits, lo = place[lo], np.frombuffer(own[lo].as_buffer(), np.uint8).copy(), lo + 1
                    part = b.slice(lo, hi - lo)
                    if part.num_rows:
                        k = part.column(key).to_numpy(zero_copy_only=False).astype(np.int64, copy=False).view(np.uint64)
                        hit = _hit(bits, k, np.uint64(0)) if place[lo] == at else np.zeros(len(k), bool)
                        yield pa.record_batch({**{n: part.column(n) for n, _ in kinds}, "maybe": pa.array(hit)})

        both = slices.unionByName(rows).repartition("__slice").sortWithinPartitions("__slice", F.col("__bits").isNull())
        return both.mapInArrow(at_slices, schema)

    def close(self) -> None:
        """For when every frame that ``flag`` made has been written."""
        if self.sent is not None:
            self.sent.destroy()
        else:
            self.scratch.drop(self.table)


def _hit(bits: np.ndarray, k: np.ndarray, base) -> np.ndarray:
    out = np.ones(len(k), bool)
    for offset in _cells(k):
        cell = base + offset
        out &= (bits[cell >> np.uint64(3)] >> (cell & np.uint64(7)).astype(np.uint8)) & 1 != 0
    return out


# --------------------------------------------------------------------------
# connected components


ONE_TASK = 1_000_000  # edges (16 MB) that one task joins at most


def _union(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, smallest node of its component) of edges."""
    names, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = at[: len(u)], at[len(u) :]
    label = np.arange(len(names))
    while True:
        low = np.minimum(label[a], label[b])
        nxt = label.copy()
        np.minimum.at(nxt, label[a], low)
        np.minimum.at(nxt, label[b], low)
        while (nxt[nxt] != nxt).any():
            nxt = nxt[nxt]
        nxt = nxt[label]
        if (nxt == label).all():
            return names, names[label]
        label = nxt


def components(scratch: Scratch, edges: DataFrame, one_task: int = ONE_TASK) -> DataFrame:
    """(node, label) for the nodes of edges (u, v); label is the smallest node
    of the component.

    Up to ``one_task`` edges are joined by one task. More of them take
    alternating large-star and small-star rounds, each written to the shared
    folder, until a round changes nothing.
    """
    def local(batches):
        e = [(b.column("u").to_numpy(), b.column("v").to_numpy()) for b in batches]
        if e:
            node, label = _union(*map(np.concatenate, zip(*e)))
            yield pa.record_batch({"node": pa.array(node), "label": pa.array(label)})

    def star(e: DataFrame, both: bool) -> DataFrame:
        if both:
            near = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        else:
            near = e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        low = near.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        joined = near.join(low, "u")
        if both:
            out = joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        else:
            out = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v")))
        return out.where("u != v").distinct()

    def state(e: DataFrame):
        return e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()

    edges = scratch.save(edges.select("u", "v").where("u != v"))
    before = state(edges)
    if before[0] <= one_task:
        out = scratch.cut(edges.coalesce(1).mapInArrow(local, "node long, label long"))
        scratch.drop(edges)
        return out
    while True:
        nxt = scratch.save(star(star(edges, True), False))
        scratch.drop(edges)
        edges, now = nxt, state(nxt)
        if now == before:
            break
        before = now
    leaves = edges.select(F.col("u").alias("node"), F.col("v").alias("label"))
    out = scratch.cut(leaves.union(edges.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct()))
    scratch.drop(edges)
    return out
