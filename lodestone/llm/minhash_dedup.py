"""MinHash near-dedup with odd sketches.

1. Each text becomes its set of distinct 5-word shingles; sets that agree in
   128 bits of hash are one class, named by its first row. A class has ``BANDS`` band keys of ``ROWS`` MinHash values each and an
   odd sketch: the samples (i, value i) folded into a bitmap by parity, so that
   the population count of the XOR of two sketches tells how many samples
   differ.
2. Classes that share a band key are compared by sketch. Of the pairs that may
   reach the threshold a spanning forest per bucket is kept, never all pairs;
   its components are families, and every link lies inside one family.
3. Inside a family links are confirmed on full shingle sets, again keeping a
   spanning forest of the confirmed links. Components of those are the result.

A bucket or family above ``BLOCK`` members is compared in two rounds. First its
blocks, each with one member that all blocks share (the hub), which joins nearly
all of a family of edited copies at a cost in proportion to it. Then only the
members outside the largest component, against every block, pairs of one
component left out. No task holds more than two blocks of one group and no
comparison that could join two components is left out. L members outside the
largest component of N cost L * N / BLOCK rows.

A pair at similarity 0.8 misses every band with probability 2.8e-7 (2.1e-10 at
0.85) and a pair at the threshold is refused by its sketches with probability
below 1e-6; above it both fall fast.

Defined results: A-Z are lower-cased; a text with fewer than 5 words is one
shingle; null or blank text has an empty set and is linked with nothing; rows
that share an id are separate nodes with that id; the component of a null id
without other ids is null; ids may be of any type that sorts; an empty table
gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._shared import Repeats, Scratch, chunks, components, mix, null_safe_key, powers, ship, tidy, word_hashes

WORDS = 5
THRESHOLD = 85  # per cent, of intersection to union
BANDS, ROWS = 38, 5
SAMPLES = BANDS * ROWS
SKETCH_BITS = 512
BLOCK = 256
MAX_BROADCAST = 100_000  # groups above BLOCK whose sizes are broadcast at most

_rng = np.random.default_rng(5)
_MUL = (_rng.integers(0, 2**32, (SAMPLES, 2), dtype=np.uint64) | np.uint64(1)).astype(np.uint32)
_SALT = _rng.integers(0, 2**64, SAMPLES, dtype=np.uint64)
_SHINGLE = _rng.integers(0, 2**64, WORDS, dtype=np.uint64) | np.uint64(1)


def most_bits(threshold: int) -> int:
    """Largest XOR population count that a pair at the threshold may show: the
    differing samples at five standard deviations, their expected bits, and
    four standard deviations of parity noise."""
    d = 1 - threshold / 100
    differ = SAMPLES * d + 5 * (SAMPLES * d * (1 - d)) ** 0.5
    bits = SKETCH_BITS / 2 * (1 - (1 - 2 / SKETCH_BITS) ** (2 * differ))
    return int(bits + 4 * (SKETCH_BITS * 0.25 * (1 - (1 - 2 / SKETCH_BITS) ** (4 * differ))) ** 0.5) + 1


def estimate(xor_bits: int) -> float:
    """The similarity that a XOR population count of two sketches stands for."""
    return 1 + SKETCH_BITS / (4 * SAMPLES) * float(np.log(max(1e-9, 1 - 2 * xor_bits / SKETCH_BITS)))


def shingle_sets(texts: list[str | None]) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    h, first = word_hashes([(t or "").encode("utf-8", "surrogatepass") for t in texts])
    if len(h) >= WORDS:
        full = mix(sum(h[i : len(h) - WORDS + 1 + i] * _SHINGLE[i] for i in range(WORDS)))
    else:
        full = np.zeros(0, np.uint64)
    out = []
    for a, b in zip(first, first[1:]):
        if b - a >= WORDS:
            s = np.sort(full[a : b - WORDS + 1])
            s = s[np.concatenate([[True], s[1:] != s[:-1]])]
        elif b > a:
            s = mix(np.array([(h[a:b] * powers(int(_SHINGLE[0]), b - a)).sum() + np.uint64(b - a)], np.uint64))
        else:
            s = np.zeros(0, np.uint64)
        out.append(s)
    return out


def set_prints(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """128 bits of each set, as two longs (0 for the empty one)."""
    def one(s, salt):
        return int(mix(mix(s ^ np.uint64(salt)).sum(keepdims=True) + np.uint64(len(s)))[0]) if len(s) else 0

    return tuple(np.array([one(s, salt) for s in sets], np.uint64).view(np.int64) for salt in (0x5851F42D4C957F2D, 0x2545F4914F6CDD1D))


def signatures(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Band keys (sets x BANDS) and odd sketches (sets x SKETCH_BITS / 8 bytes)
    of non-empty sets."""
    keys, sketches = [], []
    for run in chunks(sets, len, 1 << 15):
        x = (np.concatenate(run) >> np.uint64(32)).astype(np.uint32)
        at = np.concatenate([[0], np.cumsum([len(s) for s in run])[:-1]])
        low = np.empty((SAMPLES, len(run)), np.uint32)
        v = np.empty_like(x)
        t = np.empty_like(x)
        for i, (a, b) in enumerate(_MUL):
            np.multiply(x, a, out=v)
            np.right_shift(v, 15, out=t)
            np.bitwise_xor(v, t, out=v)
            np.multiply(v, b, out=v)
            low[i] = np.minimum.reduceat(v, at)
        wide = mix(low.astype(np.uint64) + _SALT[:, None])
        keys.append(mix(wide.reshape(BANDS, ROWS, -1).sum(axis=1) ^ _SALT[:BANDS, None]).T)
        cell = (wide & np.uint64(SKETCH_BITS - 1)).astype(np.int64) + np.arange(len(run)) * SKETCH_BITS
        odd = np.bincount(cell.ravel(), minlength=len(run) * SKETCH_BITS).astype(np.uint8) & 1
        sketches.append(np.packbits(odd.reshape(len(run), SKETCH_BITS), axis=1))
    return np.concatenate(keys).view(np.int64), np.concatenate(sketches)


def _sign(batches):
    for b in batches:
        for rows in chunks(list(range(b.num_rows)), lambda i, t=b.column("text"): len(t[i].as_py() or "") + 1, 1 << 20):
            part = b.slice(rows[0], len(rows))
            sets = shingle_sets(part.column("text").to_pylist())
            full = [s for s in sets if len(s)]
            keys, sketches = signatures(full) if full else (np.zeros((0, BANDS)), np.zeros((0, 1)))
            keys, sketches = iter(keys.tolist()), iter(sketches)
            print_, check = set_prints(sets)
            yield pa.record_batch({
                **{n: part.column(n) for n in ("doc_id", "text_key", "row")},
                "n_shingles": pa.array([len(s) for s in sets], pa.int64()),
                "print": pa.array(print_), "check": pa.array(check),
                "bands": pa.array([next(keys) if len(s) else [] for s in sets], pa.list_(pa.int64())),
                "sketch": pa.array([next(sketches).tobytes() if len(s) else b"" for s in sets], pa.binary()),
            })


def forest(n: int, close) -> list[tuple[int, int]]:
    """Spanning forest of a graph on 0..n-1. close(a, others) gives the mask of
    others that are linked with a; joined nodes are not compared again."""
    edges, left = [], np.arange(n)
    while len(left):
        front, left = [left[0]], left[1:]
        while front and len(left):
            a = front.pop()
            mask = close(a, left)
            new = left[mask]
            edges += [(a, b) for b in new]
            front += list(new)
            left = left[~mask]
    return edges


def _groups(batches, columns):
    """Runs of equal first columns, over batches sorted by them."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        if not b.num_rows:
            continue
        k = [b.column(c).to_numpy(zero_copy_only=False) for c in columns]
        cut = np.flatnonzero(np.any([x[1:] != x[:-1] for x in k], axis=0)) + 1
        if held and any(held[-1].column(c)[held[-1].num_rows - 1].as_py() != x[0] for c, x in zip(columns, k)):
            yield pa.Table.from_batches(held)
            held = []
        edges = [0, *cut.tolist(), b.num_rows]
        for i, (s, e) in enumerate(zip(edges, edges[1:])):
            held.append(b.slice(s, e - s))
            if i < len(edges) - 2:
                yield pa.Table.from_batches(held)
                held = []
    if held:
        yield pa.Table.from_batches(held)


def _sketch_matrix(column) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint64).reshape(-1, SKETCH_BITS // 64)


def _edges(found: list) -> pa.RecordBatch:
    u, v = zip(*found) if found else ((), ())
    return pa.record_batch({"u": pa.array(u, pa.int64()), "v": pa.array(v, pa.int64())})


def _others(g: pa.Table, at: np.ndarray):
    """others(a, b): which rows b are compared with row a in this group: those
    of another component and, in a pair of blocks, of the other block."""
    comp = g.column("comp").to_numpy()[at]
    if g.column("b1")[0].as_py() == g.column("b2")[0].as_py():
        return lambda a, b: comp[b] != comp[a]
    side = g.column("own").to_numpy()[at]
    return lambda a, b: (side[b] != side[a]) & (comp[b] != comp[a])


def _by_sketch(limit: int):
    def run(batches):
        found = []
        for g in _groups(batches, ("key", "b1", "b2")):
            node, at = np.unique(g.column("node").to_numpy(), return_index=True)
            if len(node) > 1:
                s, others = _sketch_matrix(g.column("sketch"))[at], _others(g, at)
                found += [(node[a], node[b]) for a, b in forest(len(node), lambda a, b, s=s, others=others: others(a, b) & (np.bitwise_count(s[b] ^ s[a]).sum(axis=1, dtype=np.int64) <= limit))]
            if len(found) > 50_000:
                yield _edges(found)
                found = []
        yield _edges(found)

    return run


def _by_sets(limit: int, threshold: int):
    def run(batches):
        for g in _groups(batches, ("key", "b1", "b2")):
            node, at = np.unique(g.column("node").to_numpy(), return_index=True)
            if len(node) < 2:
                continue
            s = _sketch_matrix(g.column("sketch"))[at]
            sets = [np.frombuffer(x.as_py(), np.uint64) for x in g.column("members").combine_chunks().take(pa.array(at))]
            size = np.array([len(x) for x in sets])
            compared = _others(g, at)

            def close(a, others, s=s, sets=sets, size=size, compared=compared):
                mask = compared(a, others) & (np.minimum(size[others], size[a]) * 100 >= threshold * np.maximum(size[others], size[a])) & (np.bitwise_count(s[others] ^ s[a]).sum(axis=1, dtype=np.int64) <= limit)
                pick = others[mask]
                same = np.zeros(len(pick), bool)
                own = sets[a]
                for lo in range(0, len(pick), 512):  # bounds the copies of sets
                    some = pick[lo : lo + 512]
                    joined = np.concatenate([sets[b] for b in some])
                    place = np.minimum(np.searchsorted(own, joined), len(own) - 1)
                    both = np.add.reduceat((own[place] == joined).astype(np.int64), np.concatenate([[0], np.cumsum(size[some])[:-1]]))
                    same[lo : lo + 512] = 100 * both >= threshold * (size[a] + size[some] - both)
                mask[mask] = same
                return mask

            yield _edges([(node[a], node[b]) for a, b in forest(len(node), close)])

    return run


def _connect(scratch: Scratch, rows: DataFrame, groups: DataFrame, block: int, compare) -> DataFrame:
    """(node, label): components of the links that ``compare`` finds between the
    rows (key, node, ...) of each key. groups has the keys of rows, once for
    each; rows are read again only where a group is larger than a block."""
    many = scratch.cut(groups.groupBy("key").agg(F.ceil(F.count("*") / block).cast("int").alias("parts"), F.min("node").alias("hub")).where("parts > 1"))
    large = many.count()

    def found(dealt: DataFrame) -> DataFrame:
        return dealt.repartition("key", "b1", "b2").sortWithinPartitions("key", "b1", "b2").mapInArrow(tidy(compare), "u long, v long")

    if not large:
        return components(scratch, found(rows.withColumns({"b1": F.lit(0), "b2": F.lit(0), "own": F.lit(0), "comp": F.col("node")})))
    side = F.broadcast if large <= MAX_BROADCAST else lambda df: df
    rows = scratch.save(rows)
    part = F.pmod(F.xxhash64("node"), F.col("parts")).cast("int")
    r = rows.join(side(many), "key", "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    r = r.withColumn("b1", F.explode(F.when(F.col("node") == F.col("hub"), F.sequence(F.lit(0), F.col("parts") - 1)).otherwise(F.array(part))))
    first = components(scratch, found(r.withColumns({"b2": F.col("b1"), "own": F.col("b1"), "comp": F.col("node")}).drop("parts", "hub")))

    # the second round, for groups that fell into several components
    r = groups.join(side(many), "key").join(first, "node", "left").select("key", "node", "parts", F.coalesce("label", "node").alias("comp"))
    sizes = r.groupBy("key", "comp").agg(F.count("*").alias("n"), F.first("parts").alias("parts"))
    rest = sizes.groupBy("key").agg(F.sum("n").alias("all"), F.max(F.struct("n", "comp")).alias("most"), F.first("parts").alias("parts")).where("most.n < all")
    rest = scratch.cut(rest.select("key", F.col("most.comp").alias("main"), "parts", F.ceil((F.col("all") - F.col("most.n")) / block).cast("int").alias("few")))
    if rest.isEmpty():
        scratch.drop(rows)
        return first
    r = rows.join(side(rest), "key").join(first, "node", "left").withColumn("comp", F.coalesce("label", "node"))
    inside = F.col("comp") == F.col("main")
    # blocks 0 .. few - 1 are of members outside the largest component, those from few on of its own
    r = r.withColumn("own", F.when(inside, F.col("few") + part).otherwise(F.pmod(F.xxhash64("node"), F.col("few"))).cast("int"))
    r = r.withColumn("other", F.explode(F.sequence(F.lit(0), F.when(inside, F.col("few")).otherwise(F.col("few") + F.col("parts")) - 1)))
    r = r.withColumns({"b1": F.least("own", "other"), "b2": F.greatest("own", "other")}).drop("label", "main", "parts", "few", "other")
    out = components(scratch, found(r).union(first.select(F.col("node").alias("u"), F.col("label").alias("v"))))
    scratch.drop(rows)
    return out


def near_duplicates(docs: DataFrame, threshold: int = THRESHOLD, id_col="doc_id", text_col="text", block: int = BLOCK) -> DataFrame:
    """One row per row of docs: doc_id, text_key (xxhash64 of the text),
    n_shingles, component_id, kept, and ``first``: whether the row is the one of
    its component that stays when several rows share the smallest id."""
    spark = docs.sparkSession
    ship(spark)
    scratch = Scratch(spark)
    limit = most_bits(threshold)
    d = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text_col).alias("text_key"), F.col(text_col).alias("text"))
    kind = d.schema["doc_id"].dataType.simpleString()
    signed = d.withColumn("row", F.monotonically_increasing_id()).mapInArrow(tidy(_sign), f"doc_id {kind}, text_key long, row long, n_shingles long, print long, check long, bands array<long>, sketch binary")
    signed = scratch.save(signed)
    classes = signed.where("n_shingles > 0").groupBy("print", "check").agg(F.min("row").alias("node"), *[F.first(c).alias(c) for c in ("bands", "sketch", "doc_id")])
    classes = scratch.save(classes)
    keys = classes.select(F.explode("bands").alias("key"))
    repeats = Repeats(scratch, keys, "key", classes.count() * BANDS)
    if repeats.sent is not None:
        maybe = repeats.tester()

        def shared(batches):
            for b in batches:
                bands = b.column("bands")
                if b.num_rows:
                    flat = bands.flatten().to_numpy(zero_copy_only=False)
                    keep = maybe(flat)
                    owner = np.repeat(np.arange(b.num_rows), np.diff(bands.offsets.to_numpy()))[keep]
                    if len(owner):
                        yield pa.record_batch({"key": pa.array(flat[keep]), "node": b.column("node").take(pa.array(owner)), "sketch": b.column("sketch").take(pa.array(owner))})

        buckets = classes.select("node", "bands", "sketch").mapInArrow(shared, "key long, node long, sketch binary")
    else:
        buckets = repeats.flag(classes.select(F.explode("bands").alias("key"), "node", "sketch"), "key").where("maybe").drop("maybe")
    buckets = scratch.save(buckets)
    repeats.close()
    families = _connect(scratch, buckets, buckets, block, _by_sketch(limit)).withColumnRenamed("label", "key")
    # the full sets of family members, from one text of each class
    wanted = families.join(classes.select("node", "print", "check", "sketch", "doc_id"), "node")
    ids = wanted.select(null_safe_key("doc_id").alias("id")).distinct()
    texts = d.withColumn("id", null_safe_key("doc_id")).join(ids, "id", "left_semi")

    def members(batches):
        for b in batches:
            for rows in chunks(list(range(b.num_rows)), lambda i, t=b.column("text"): len(t[i].as_py() or "") + 1, 1 << 20):
                sets = shingle_sets(b.column("text").slice(rows[0], len(rows)).to_pylist())
                print_, check = set_prints(sets)
                yield pa.record_batch({"print": pa.array(print_), "check": pa.array(check), "members": pa.array([s.tobytes() for s in sets], pa.binary())})

    sets = texts.select("text").mapInArrow(tidy(members), "print long, check long, members binary").dropDuplicates(["print", "check"])
    full = wanted.select("key", "node", "sketch", "print", "check").join(sets, ["print", "check"]).select("key", "node", "sketch", "members")
    label = _connect(scratch, full, families, block, _by_sets(limit, threshold))
    label = classes.select("print", "check", "node").join(label, "node", "left").select("print", "check", F.coalesce("label", "node").alias("label"))
    r = signed.join(label, ["print", "check"], "left").select("doc_id", "text_key", "n_shingles", "row", "label")
    # written before the join, so that a large component's rows can be split
    low = scratch.cut(r.where("label is not null").groupBy("label").agg(F.min(F.struct(F.col("doc_id").isNull().alias("null"), "doc_id", "row")).alias("low")))
    out = r.join(low, "label", "left").withColumn("component_id", F.when(F.col("label").isNull(), F.col("doc_id")).otherwise(F.col("low.doc_id")))
    first = F.col("label").isNull() | (F.col("row") == F.col("low.row"))
    out = scratch.cut(out.select("doc_id", "text_key", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"), first.alias("first")))
    scratch.drop(signed, classes, buckets)
    return out


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "n_shingles", "component_id", "kept")


SQL = rf"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i + 1 : i + {WORDS}], ' ') AS sh
      FROM (SELECT doc_id, w, unnest(range(0, greatest(len(w) - {WORDS}, 0) + 1)) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
inter AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id < b.doc_id GROUP BY 1, 2),
link AS (SELECT a, b FROM inter JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= {THRESHOLD} * (x.n + y.n - k)),
both_ AS (SELECT a, b FROM link UNION ALL SELECT b, a FROM link),
reach AS (SELECT doc_id AS a, doc_id AS b FROM d UNION SELECT r.a, e.b FROM reach r JOIN both_ e ON r.b = e.a),
comp AS (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, component_id, d.doc_id = component_id AS kept
FROM d JOIN comp USING (doc_id) LEFT JOIN n USING (doc_id)
"""
