"""Mixing sources to target weights by Sainte-Lague apportionment.

Equal-token blocks are the seats. A source whose target is its limit has all of
its seats; the others' go to the highest quotients target / (2 * seats + 1),
none beyond a source's limit, its last one standing for the words that are left
to the limit, until the words reach the sum of the targets; the last seat of all
is cut to that sum. A block has ``BLOCK`` words, or fewer where a source's target
is below LEAST_SEATS of them: then a LEAST_SEATS-th of the least target above 0,
so that every source's words come near its target.

A source's documents are laid in a seeded order and cut into blocks, and its
blocks into ``SHARDS`` shards. Its
seats are whole laps over all of its blocks and a rest; the rest is dealt to the
shards as integer quotas, each in proportion to the shard's blocks, and a shard
fills its quota with consecutive blocks, counted round from one that the seed
picks. The order is seeded, so a run of blocks is a random choice of documents,
and at most two documents a shard are taken in part.

Defined results: null or empty text has size 0 and is taken 0 times; a null
source is a source of its own, last in order; repeated rows are separate
documents; null ids are ordered by their texts; an empty table gives an empty
result. Runs agree for one seed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ._shared import Scratch

SEED = "mix-1"
WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST = 2
BLOCK = 128
LEAST_SEATS = 4
HALF = 0.500001  # sums of targets that end in a half round up, however they were added
SHARDS = 16
BUCKET_HEX = 3


def targets(sizes: DataFrame, weights=WEIGHTS, share=SHARE, most=MOST) -> DataFrame:
    """sizes (source, source_size): adds rank, weight, limit, target and full,
    whether the target is the limit.

    One row per source, so the windows over all of them are small. Targets are
    weight * level, at most ``most`` times the size; the level is read off
    after sorting by the ratio at which each source reaches its limit.
    """
    every = W.partitionBy(F.lit(0))
    by_name = every.orderBy(F.col("source").asc_nulls_last())
    by_ratio = every.orderBy("ratio", "rank").rowsBetween(W.unboundedPreceding, W.currentRow)
    wts = F.array(*[F.lit(float(w)) for w in weights])
    s = sizes.withColumn("rank", F.row_number().over(by_name) - 1)
    s = s.withColumn("weight", F.element_at(wts, (F.col("rank") % len(weights)).cast("int") + 1))
    s = s.withColumn("limit", F.col("source_size").cast("double") * most).withColumn("ratio", F.col("limit") / F.col("weight"))
    s = s.withColumn("total", F.sum("source_size").over(every) * share)
    s = s.withColumn("below", F.sum("limit").over(by_ratio) - F.col("limit")).withColumn("weight_left", F.sum("weight").over(every) - F.sum("weight").over(by_ratio) + F.col("weight"))
    s = s.withColumn("level", (F.col("total") - F.col("below")) / F.col("weight_left"))
    s = s.withColumn("level", F.min(F.when(F.col("ratio") >= F.col("level"), F.struct("ratio", "rank", "level"))).over(every)["level"])
    full = F.col("ratio") < F.coalesce("level", F.col("ratio") + 1)
    s = s.withColumn("full", full).withColumn("target", F.when(full, F.col("limit")).otherwise(F.col("weight") * F.col("level")))
    return s.select("source", "source_size", "rank", "weight", "limit", "target", "full")


def block_of(t: DataFrame, block: int = BLOCK) -> DataFrame:
    """t with target: adds block, the same for every source."""
    least = F.min(F.when(F.col("target") > 0, F.col("target"))).over(W.partitionBy(F.lit(0)))
    fits = F.floor(F.coalesce(least, F.lit(float(block * LEAST_SEATS))) / LEAST_SEATS)
    return t.withColumn("block", F.greatest(F.lit(1), F.least(F.lit(block), fits)).cast("long"))


def apportion(t: DataFrame) -> DataFrame:
    """t (rank, target, limit, full, block) → (rank, take): the words of each
    source's seats.

    With n sources that are not full, one of a share p of their targets differs
    from its exact quota by some p * n seats, whatever the number of seats; caps
    make no more than three times that many wander. So only quotients in that
    range are compared: some 16 rows a source."""
    every = W.partitionBy(F.lit(0))
    some = t.where("NOT full AND target > 0").withColumn("sum", F.sum("target").over(every)).withColumn("n", F.count("*").over(every))
    some = some.withColumn("house", F.floor(F.col("sum") + HALF)).withColumn("quota", F.floor(F.col("target") / F.col("block")))
    slack = F.lit(3) + 4 * F.ceil(F.col("target") / F.col("sum") * F.col("n"))
    last = F.ceil(F.col("limit") / F.col("block")).cast("long") - 1
    some = some.withColumn("low", F.greatest(F.least(F.col("quota") - slack, last), F.lit(0)).cast("long")).withColumn("high", F.greatest(F.least(F.col("quota") + slack, last), F.col("low")).cast("long"))
    seats = some.withColumn("k", F.explode(F.sequence("low", "high"))).withColumn("quotient", F.col("target") / (2 * F.col("k") + 1))
    seats = seats.withColumn("words", F.least(F.col("block"), F.col("limit").cast("long") - F.col("k") * F.col("block")))
    sure = F.sum(F.when(F.col("k") == F.col("low"), F.col("low") * F.col("block")).otherwise(0)).over(every)
    before = F.sum("words").over(every.orderBy(F.desc("quotient"), "rank", "k").rowsBetween(W.unboundedPreceding, W.currentRow)) - F.col("words")
    won = seats.withColumn("won", F.greatest(F.least(F.col("words"), F.col("house") - sure - before), F.lit(0)))
    dealt = won.groupBy("rank").agg((F.first(F.col("low") * F.col("block")) + F.sum("won")).cast("long").alias("take"))
    return dealt.unionByName(t.where("full OR coalesce(target, 0) <= 0").select("rank", F.when(F.col("full"), F.col("limit")).otherwise(0).cast("long").alias("take")))


def shard_quotas(t: DataFrame, shards: int = SHARDS, block: int = BLOCK, seed: str = SEED) -> DataFrame:
    """t of ``targets`` → (source, block, laps, take, quotas) with quotas an
    array of (shard, first, blocks, quota, begin): a shard's blocks from
    ``first`` on, how many of them are taken once more, and the one that they
    are counted from. ``take`` is the words that the seats stand for."""
    k = F.explode(F.sequence(F.lit(0), F.lit(shards - 1)))
    t = block_of(t, block)
    s = t.join(apportion(t), "rank")
    s = s.withColumn("laps", F.coalesce(F.expr("try_divide(take, source_size)").cast("long"), F.lit(0)))
    s = s.withColumn("rest", F.floor((F.col("take") - F.col("laps") * F.col("source_size") + F.floor(F.col("block") / 2)) / F.col("block"))).withColumn("all", F.ceil(F.col("source_size") / F.col("block")))
    s = s.withColumn("shard", k).withColumn("first", F.floor(F.col("shard") * F.col("all") / shards)).withColumn("end", F.floor((F.col("shard") + 1) * F.col("all") / shards))

    def dealt(upto):  # of the rest, what falls on the blocks before
        return F.coalesce(F.floor(F.try_divide(F.col(upto) * F.col("rest"), F.col("all"))), F.lit(0))

    name = F.concat(F.lit(f"{seed}:"), F.col("shard").cast("string"), F.lit(":"), F.coalesce("source", F.lit("")))
    begin = F.coalesce(F.try_mod(F.conv(F.substring(F.md5(name), 1, 8), 16, 10).cast("long"), F.col("end") - F.col("first")), F.lit(0))
    q = F.struct("shard", F.col("first").cast("long").alias("first"), (F.col("end") - F.col("first")).cast("long").alias("blocks"), (dealt("end") - dealt("first")).cast("long").alias("quota"), begin.cast("long").alias("begin"))
    return s.groupBy("rank").agg(*[F.first(c).alias(c) for c in ("source", "source_size", "target", "block", "laps", "take")], F.sort_array(F.collect_list(q)).alias("quotas"))


def words_of(start, size, quotas, block):
    """Words of [start, start + size) that lie in the selected blocks: of each
    shard those from begin to begin + quota, and from its first on what goes
    round."""
    def inside(lo, hi):
        return F.greatest(F.least(start + size, hi * block) - F.greatest(start, lo * block), F.lit(0))

    def of(q):
        stop = q["begin"] + q["quota"]
        here = inside(q["first"] + q["begin"], q["first"] + F.least(stop, q["blocks"]))
        return here + inside(q["first"], q["first"] + F.greatest(stop - q["blocks"], F.lit(0)))

    near = F.filter(quotas, lambda q: (q["first"] * block < start + size) & ((q["first"] + q["blocks"]) * block > start))
    return F.aggregate(near, F.lit(0).cast("long"), lambda acc, q: acc + of(q))


def word_count(text):
    """Number of words ``[^\\x20\\x09-\\x0D]+``."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def mix(docs: DataFrame, weights=WEIGHTS, share=SHARE, most=MOST, block: int = BLOCK, seed: str = SEED, id_col="doc_id", text_col="text", source_col="source", carry: tuple[str, ...] = ()) -> DataFrame:
    """One row per document: doc_id, source, size, source_size, target, taken,
    and the carried columns.

    Texts are read once into a table of (id, source, size, order key); columns
    to carry are too large for that and are read again. The order
    key's first digits are a bucket: sums per (source, bucket), pre-aggregated,
    give every bucket its offset, and only rows of one bucket are sorted
    together, so a source that holds most rows still spreads over
    16**BUCKET_HEX tasks.
    """
    # rows without an id would share one key and with it one bucket
    named = F.coalesce(F.col(id_col).cast("string"), F.concat(F.lit("null:"), F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256)))
    order = F.md5(F.concat(F.lit(f"{seed}:"), named))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size"), order.alias("key"), *[F.col(c).alias(f"carried_{c}") for c in carry])
    rows = rows.withColumn("bucket", F.substring("key", 1, BUCKET_HEX)).withColumn("src", F.coalesce(F.concat(F.lit("s"), "source"), F.lit("")))
    if not carry:
        rows = Scratch(docs.sparkSession).cut(rows)
    sums = rows.groupBy("src", "bucket").agg(F.first("source").alias("source"), F.sum("size").alias("words"))
    t = targets(sums.groupBy("source").agg(F.sum("words").alias("source_size")), weights, share, most)
    seats = shard_quotas(t, SHARDS, block, seed).withColumn("src", F.coalesce(F.concat(F.lit("s"), "source"), F.lit(""))).select("src", "source_size", "target", "block", "laps", "quotas")
    before = F.coalesce(F.sum("words").over(W.partitionBy("src").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    placed = sums.select("src", "bucket", before.alias("offset")).join(seats, "src")
    inside = W.partitionBy("src", "bucket").orderBy("key", "size").rowsBetween(W.unboundedPreceding, W.currentRow)
    rows = rows.withColumn("inside", F.sum("size").over(inside) - F.col("size"))
    rows = rows.join(placed, ["src", "bucket"]).withColumn("start", F.col("offset") + F.col("inside"))
    taken = F.col("laps") * F.col("size") + words_of(F.col("start"), F.col("size"), F.col("quotas"), F.col("block"))
    return rows.select("doc_id", "source", "size", "source_size", "target", taken.cast("long").alias("taken"), *[F.col(f"carried_{c}").alias(c) for c in carry])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "size", "source_size", F.round("target", 6).alias("target"), "taken")


SQL = rf"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS size,
         md5('{SEED}:' || coalesce(doc_id::VARCHAR, 'null:' || sha256(coalesce(text, '')))) AS key
  FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size,
             row_number() OVER (ORDER BY source NULLS LAST) - 1 AS rank FROM d GROUP BY source),
w AS (SELECT *, [5.0, 2.0, 1.0][(rank % 3 + 1)::INT]::DOUBLE AS weight, 2.0::DOUBLE * source_size AS lim,
             1.5::DOUBLE * (SELECT sum(source_size) FROM s) AS total FROM s),
fill AS (  -- share out the rest by weight, stop those above their limit, again until none is
  SELECT 0 AS round, rank, weight, lim, false AS full_, total * weight / (SELECT sum(weight) FROM w) AS target FROM w
  UNION ALL
  SELECT round + 1, rank, weight, lim, full_ OR target > lim,
    CASE WHEN full_ OR target > lim THEN lim ELSE
      weight * ((SELECT max(total) FROM w) - sum(CASE WHEN full_ OR target > lim THEN lim ELSE 0 END) OVER ())
      / sum(CASE WHEN full_ OR target > lim THEN 0 ELSE weight END) OVER () END
  FROM fill WHERE round <= (SELECT count(*) FROM w)),
t AS (SELECT w.*, f.target, f.full_ FROM w JOIN fill f USING (rank) WHERE f.round = (SELECT max(round) FROM fill)),
b AS (SELECT greatest(1, least({BLOCK}, floor(coalesce(min(target) FILTER (target > 0), {BLOCK * LEAST_SEATS}.0) / {LEAST_SEATS})))::BIGINT AS block FROM t),
seat AS (SELECT rank, least(block, lim::BIGINT - k * block) AS words, sum(least(block, lim::BIGINT - k * block)) OVER (ORDER BY target / (2 * k + 1) DESC, rank, k) AS upto
         FROM t, b, LATERAL (SELECT unnest(generate_series(0, ceil(lim / block)::BIGINT - 1)) AS k) WHERE NOT full_ AND target > 0),
won AS (SELECT rank, sum(greatest(0, least(words, (SELECT floor(sum(target) + {HALF})::BIGINT FROM t WHERE NOT full_) - upto + words)))::BIGINT AS words FROM seat GROUP BY rank),
take AS (SELECT t.*, block, CASE WHEN full_ THEN lim::BIGINT ELSE coalesce(words, 0) END AS take FROM b, t LEFT JOIN won USING (rank)),
laps AS (SELECT *, CASE WHEN source_size = 0 THEN 0 ELSE take // source_size END AS laps, (source_size + block - 1) // block AS blocks FROM take),
rest AS (SELECT *, (take - laps * source_size + block // 2) // block AS rest FROM laps),
shard AS (SELECT rank, k, k * blocks // {SHARDS} AS first_, (k + 1) * blocks // {SHARDS} AS end_, rest, blocks, block, source FROM rest, range({SHARDS}) s(k)),
quota AS (SELECT rank, block, first_, end_, end_ * rest // blocks - first_ * rest // blocks AS quota, ('0x' || substr(md5('{SEED}:' || k || ':' || coalesce(source, '')), 1, 8))::BIGINT % (end_ - first_) AS begin_ FROM shard WHERE end_ > first_),
picked AS (SELECT rank, ((first_ + begin_) * block)::BIGINT AS lo, ((first_ + least(begin_ + quota, end_ - first_)) * block)::BIGINT AS hi FROM quota
           UNION ALL SELECT rank, (first_ * block)::BIGINT, ((first_ + greatest(begin_ + quota - (end_ - first_), 0)) * block)::BIGINT FROM quota),
o AS (SELECT *, row_number() OVER () AS r, (sum(size) OVER (PARTITION BY source ORDER BY key, size ROWS UNBOUNDED PRECEDING) - size)::BIGINT AS start FROM d),
extra AS (SELECT r, sum(greatest(least(start + size, hi) - greatest(start, lo), 0))::BIGINT AS words FROM o JOIN t ON o.source IS NOT DISTINCT FROM t.source JOIN picked USING (rank) GROUP BY r)
SELECT o.doc_id, o.size::BIGINT AS size, source_size, round(target, 6) AS target, (laps * o.size + coalesce(words, 0))::BIGINT AS taken
FROM o JOIN rest ON o.source IS NOT DISTINCT FROM rest.source LEFT JOIN extra USING (r)
"""
