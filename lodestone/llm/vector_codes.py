"""Vector codes: product quantisation found by partial-distance search.

A vector becomes integers, floor(scale * x), and is cut into equal consecutive
parts. Each part has a codebook of up to ENTRIES integer entries, which starts
from the vectors with the smallest ids and is moved ROUNDS times to the floored
means of the parts that it was nearest to. A code names the nearest entries.

The nearest entry is searched by partial distances: dimensions are taken in
descending variance of the codebook; masks drop an entry of a vector once its
accumulated integer distance is strictly above the best complete distance of
that vector, so entries that tie with the best stay to the end and the lowest
index wins. The entry that leads after the first dimensions is completed first,
then blocks of entries one after another, each against the best so far.

Vectors are written once as integers, under the shared folder; every round is
a pass of tasks over it that sum up by entry, so a round shuffles and collects
at most a codebook a task and a codebook in all: ENTRIES * dimension numbers.

Defined results: rows whose vector is null, empty, of another length than that
of the smallest id or holds a null, non-finite or too large (2**17 and more in
size, where sums of squares would not fit a long) component are dropped; a
dimension that is no multiple of the parts gives the first parts one more;
null ids come last in order, equal ids by vector; with fewer vectors than
entries a codebook is as long as there are vectors; equal rows stay, each with
its code; null labels are one label; an empty table gives no rows and empty
codebooks.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._shared import Scratch, ship, tidy

PARTS = 4
ENTRIES = 256
ROUNDS = 4
SCALE = 1024
MOST = 2.0**17
ROWS = 512  # vectors that are compared at once
HEAD = 8  # dimensions of which all distances are taken; masks begin after them
BLOCK = 64  # entries of a block
LABELS = 100_000  # labels whose sums are broadcast
SALTS = 32


def nearest(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index, squared distance) of the entry nearest to each row; of several
    the first."""
    if not len(x):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    order = np.argsort(-book.astype(np.float64).var(axis=0), kind="stable")
    kind = _small(x, book)
    x, book = x[:, order].astype(kind), book[:, order].astype(kind)
    head = min(HEAD, x.shape[1])
    best, who = np.empty(len(x), np.int64), np.empty(len(x), np.int64)
    column = np.ascontiguousarray(book.T)
    for lo in range(0, len(x), ROWS):
        own = x[lo : lo + ROWS]
        across = np.ascontiguousarray(own.T)
        part = np.zeros((len(own), len(book)), kind)
        for j in range(head):
            away = across[j][:, None] - column[j]
            part += np.multiply(away, away, out=away)
        code = part.argmin(axis=1)
        least = ((own - book[code]) ** 2).sum(axis=1).astype(kind)
        for first in range(0, len(book), BLOCK):
            some = part[:, first : first + BLOCK]
            r, e = np.nonzero(some <= least[:, None])
            d = some[r, e]
            e += first
            for j in range(head, x.shape[1]):
                away = across[j].take(r) - column[j].take(e)
                d = d + away * away
                if j % 2 or j == x.shape[1] - 1:
                    stay = np.flatnonzero(d <= least.take(r))
                    r, e, d = r.take(stay), e.take(stay), d.take(stay)
            # complete: by row the least distance, then the lowest index
            best_d = least.copy()
            np.minimum.at(best_d, r, d)
            tie = np.flatnonzero(d == best_d.take(r))
            r, e, d = r[tie], e[tie], d[tie]
            top = np.append(True, r[1:] != r[:-1])[: len(r)]  # r, then e ascend
            r, e, d = r[top], e[top], d[top]
            won = (d < least[r]) | (e < code[r])
            least[r[won]], code[r[won]] = d[won], e[won]
        best[lo : lo + ROWS], who[lo : lo + ROWS] = least, code
    return who, best


def cuts(dimension: int, parts: int) -> list[slice]:
    edge = np.cumsum([0, *[dimension // parts + (i < dimension % parts) for i in range(parts)]])
    return [slice(int(a), int(b)) for a, b in zip(edge, edge[1:])]


class Codebooks:
    """``books``: an integer array (entries x dimensions) for each part."""

    def __init__(self, books: list[np.ndarray]):
        self.books = books

    def sha256(self) -> str:
        """Digest of all components in decimal, by part, entry and place."""
        return hashlib.sha256(",".join(str(v) for b in self.books for v in b.ravel().tolist()).encode()).hexdigest()


def _small(x: np.ndarray, book: np.ndarray) -> type:
    """int32 where no squared distance can pass it."""
    most = max(int(np.abs(x).max(initial=0)), int(np.abs(book).max(initial=0)))
    return np.int32 if (2 * most) ** 2 * max(1, book.shape[1]) < 2**31 else np.int64


def integers(vectors: DataFrame, scratch: Scratch, id_col: str, vector_col: str, label_col: str | None, scale: int = SCALE, entries: int = ENTRIES) -> tuple[DataFrame, np.ndarray]:
    """The kept vectors as a table (vec_id, label, x: little-endian longs) and
    the integers of the first of them, a row each."""
    label = F.col(label_col) if label_col else F.lit(None).cast("int")
    v = vectors.select(F.col(id_col).alias("vec_id"), label.alias("label"), F.col(vector_col).cast("array<double>").alias("vector"))
    v = v.where(F.col("vector").isNotNull() & (F.size("vector") > 0) & F.forall("vector", lambda c: F.coalesce(F.abs(c) < MOST, F.lit(False))))
    order = F.col("vec_id").asc_nulls_last(), F.col("vector")
    head = v.orderBy(*order).select("vector").head()
    dimension = len(head["vector"]) if head else 0
    v = v.where(F.size("vector") == dimension)
    first = v.orderBy(*order).limit(entries).select("vector").collect()
    start = np.floor(np.array([r["vector"] for r in first], np.float64).reshape(len(first), dimension) * scale).astype(np.int64)

    def convert(batches):
        for b in batches:
            if b.num_rows:
                x = b.column("vector").flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1)
                rows = np.floor(x * scale).astype("<i8")
                yield pa.record_batch({"vec_id": b.column("vec_id"), "label": b.column("label"), "x": pa.array([r.tobytes() for r in rows], pa.binary())})

    return scratch.save(v.mapInArrow(tidy(convert), v.select("vec_id", "label").schema.add("x", "binary"))), start


def _rows(b: pa.RecordBatch, dimension: int) -> np.ndarray:
    return np.frombuffer(b"".join(b.column("x").to_pylist()), "<i8").reshape(-1, dimension)


def fit(table: DataFrame, start: np.ndarray, parts: int = PARTS, rounds: int = ROUNDS) -> Codebooks:
    """Codebooks after ``rounds`` of assignment and floored means."""
    spark = table.sparkSession
    dimension = start.shape[1]
    cut = cuts(dimension, parts)
    books = [start[:, c].copy() for c in cut]
    for _ in range(rounds if len(start) else 0):
        sent = spark.sparkContext.broadcast(books)

        def sums(batches):
            total = [np.zeros_like(b) for b in sent.value]
            count = [np.zeros(len(b), np.int64) for b in sent.value]
            for b in batches:
                x = _rows(b, dimension)
                for i, c in enumerate(cut):
                    own, _ = nearest(x[:, c], sent.value[i])
                    count[i] += np.bincount(own, minlength=len(count[i]))
                    np.add.at(total[i], own, x[:, c])
            for i, (t, n) in enumerate(zip(total, count)):
                used = np.flatnonzero(n)
                if len(used) and t.shape[1]:
                    yield pa.record_batch({"part": pa.array(np.full(len(used) * t.shape[1], i)), "entry": pa.array(np.repeat(used, t.shape[1])), "place": pa.array(np.tile(np.arange(t.shape[1]), len(used))), "n": pa.array(np.repeat(n[used], t.shape[1])), "total": pa.array(t[used].ravel())})

        found = table.select("x").mapInArrow(tidy(sums), "part long, entry long, place long, n long, total long").groupBy("part", "entry", "place").agg(F.sum("n").alias("n"), F.sum("total").alias("total"))
        moved = [b.copy() for b in books]
        for r in found.collect():  # a row a number of the codebooks
            moved[r["part"]][r["entry"], r["place"]] = r["total"] // r["n"]
        books = moved
        sent.destroy()
    return Codebooks(books)


def encode(table: DataFrame, books: Codebooks, dimension: int) -> DataFrame:
    """table (vec_id, label, x) → vec_id, label, code (an index a part), error
    (squared distances to the entries, summed)."""
    cut = cuts(dimension, len(books.books))
    sent = table.sparkSession.sparkContext.broadcast(books.books)

    def run(batches):
        for b in batches:
            if b.num_rows:
                x = _rows(b, dimension)
                found = [nearest(x[:, c], book) for c, book in zip(cut, sent.value)]
                codes = np.stack([who for who, _ in found], axis=1).astype(np.int32)
                yield pa.record_batch({"vec_id": b.column("vec_id"), "label": b.column("label"), "code": pa.array(list(codes), pa.list_(pa.int32())), "error": pa.array(sum(d for _, d in found).astype(np.int64))})

    return table.mapInArrow(tidy(run), table.select("vec_id", "label").schema.add("code", T.ArrayType(T.IntegerType())).add("error", "long"))


def by_label(coded: DataFrame, most: int = LABELS) -> DataFrame:
    """Adds label_error, the errors of a label's rows summed. Sums are a row a
    label; up to ``most`` of them are broadcast, more meet the rows of a label
    in SALTS places."""
    sums = coded.groupBy("label").agg(F.sum("error").alias("label_error"))
    same = F.col("c.label").eqNullSafe(F.col("s.label"))
    if sums.count() <= most:
        out = coded.alias("c").join(F.broadcast(sums).alias("s"), same, "left")
    else:
        salted = sums.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        rows = coded.withColumn("salt", F.pmod(F.xxhash64("vec_id", "code"), F.lit(SALTS)).cast("int"))
        out = rows.alias("c").join(salted.alias("s"), same & (F.col("c.salt") == F.col("s.salt")), "left")
    return out.select("c.vec_id", "c.label", "c.code", "c.error", "s.label_error")


def compress(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str | None = "label", parts: int = PARTS, rounds: int = ROUNDS, scale: int = SCALE, entries: int = ENTRIES) -> tuple[DataFrame, Codebooks]:
    """Fits codebooks and codes every kept vector: (vec_id, label, code, error)
    and the codebooks."""
    spark = vectors.sparkSession
    ship(spark)
    scratch = Scratch(spark)
    table, start = integers(vectors, scratch, id_col, vector_col, label_col, scale, entries)
    books = fit(table, start, parts, rounds)
    coded = scratch.cut(encode(table, books, start.shape[1]))
    scratch.drop(table)
    return coded, books


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded, books = compress(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    code = F.array_join(F.transform("code", lambda c: F.lower(F.lpad(F.hex(c), 2, "0"))), "")
    return by_label(coded).select("vec_id", code.alias("code"), "error", "label_error", F.lit(books.sha256()).alias("codebooks_sha256"))


def _rounds_sql() -> str:
    """Every round as two tables: which entry is nearest, and its new entries."""
    out = []
    for i in range(ROUNDS + 1):
        out.append(f"""near{i} AS MATERIALIZED (SELECT n, part, arg_min(entry, d * {ENTRIES} + entry) AS entry, min(d) AS d FROM (
  SELECT p.n, p.part, b.entry, list_sum(list_transform(list_zip(p.x, b.x), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS d
  FROM parts p JOIN book{i} b USING (part)) GROUP BY n, part)""")
        if i < ROUNDS:
            out.append(f"""book{i + 1} AS MATERIALIZED (
  WITH m AS (SELECT part, entry, place, floor(sum(v)::DOUBLE / count(*))::BIGINT AS v FROM (
      SELECT part, entry, generate_subscripts(x, 1) AS place, unnest(x) AS v FROM near{i} JOIN parts USING (n, part)) GROUP BY ALL),
    moved AS (SELECT part, entry, list(v ORDER BY place) AS x FROM m GROUP BY part, entry)
  SELECT part, entry, coalesce(moved.x, o.x) AS x FROM book{i} o LEFT JOIN moved USING (part, entry))""")
    return ",\n".join(out)


SQL = f"""
WITH kept AS (SELECT row_number() OVER (ORDER BY vec_id NULLS LAST, embedding) AS n, vec_id, label, list_transform(embedding, lambda c: floor({SCALE} * c::DOUBLE)::BIGINT) AS x FROM embeddings
  WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
parts AS MATERIALIZED (SELECT n, part, x[(part - 1) * (len(x) // {PARTS}) + 1 : part * (len(x) // {PARTS})] AS x FROM kept, range(1, {PARTS + 1}) r(part)),
book0 AS MATERIALIZED (SELECT part, n - 1 AS entry, x FROM parts WHERE n <= {ENTRIES}),
{_rounds_sql()},
digest AS (SELECT sha256(string_agg(v::VARCHAR, ',' ORDER BY part, entry, place)) AS h FROM (SELECT part, entry, generate_subscripts(x, 1) AS place, unnest(x) AS v FROM book{ROUNDS})),
coded AS (SELECT n, string_agg(lpad(lower(hex(entry)), 2, '0'), '' ORDER BY part) AS code, sum(d)::BIGINT AS error FROM near{ROUNDS} GROUP BY n)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, h AS codebooks_sha256 FROM kept JOIN coded USING (n), digest
"""
