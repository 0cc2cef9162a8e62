"""Benchmark decontamination with a broadcast set of test n-grams (DataFrame
functions only).

Every window of ``n`` consecutive words of a test item is an n-gram of the set
(an item with fewer words, but not none, is one n-gram). The set is hashed by
one token of each n-gram, its longest; the scan probes it at every position of
a training text and compares the whole n-gram around each hit. A set with more
than ``MAX_TOKENS`` such tokens or ``MAX_BROADCAST`` n-grams is hashed by whole
n-grams instead: every window of a text is hashed, the hashes are joined with
those of the set (broadcast up to MAX_BROADCAST n-grams, shuffled beyond), and
hits are compared word by word.

Defined results: null text has no words and is never contaminated; a null item
id is left out of the lists of items; repeated rows are scanned as rows of
their own; with no items nothing is hit; ids may be of any type; an empty table gives
an empty result; only the named columns are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._shared import Scratch, null_safe_key

NGRAM = 10
NOT_WORD = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
MAX_TOKENS = 10_000  # tokens that are probed by a set in the plan
MAX_BROADCAST = 200_000  # n-grams that are broadcast at most


def split_words(text: Column) -> Column:
    """Words with their case; a first or last item may be empty."""
    return F.split(F.coalesce(text, F.lit("")), NOT_WORD + "+")


def test_ngrams(benchmark: DataFrame, n: int = NGRAM) -> DataFrame:
    """Distinct n-grams: (ngram, length, offset, token, items); token is the
    longest word (the first of several), offset its place."""
    words = F.array_remove(split_words(F.translate("text", UPPER, LOWER)), "")
    b = benchmark.select(F.col("item_id").cast("string").alias("item"), words.alias("words")).where("size(words) > 0")
    b = b.withColumn("start", F.explode(F.sequence(F.lit(0), F.greatest(F.size("words") - n, F.lit(0)))))
    b = b.withColumn("gram", F.slice("words", F.col("start") + 1, n))
    best = F.array_max(F.transform("gram", lambda w, i: F.struct(F.length(w).alias("l"), (-i).alias("i"), w.alias("w"))))
    b = b.withColumn("best", best)
    g = b.groupBy(F.array_join("gram", " ").alias("ngram")).agg(F.first(F.size("gram")).alias("length"), F.first("best").alias("best"), F.collect_set("item").alias("items"))
    return g.select("ngram", "length", (-F.col("best.i")).alias("offset"), F.lower("best.w").alias("token"), "items")


def scan(docs: DataFrame, benchmark: DataFrame, n: int = NGRAM, id_col="doc_id", text_col="text", carry: tuple[str, ...] = ()) -> DataFrame:
    """One row per row of docs: doc_id, text_key, n_words, hits (positions of
    hit words in ``split_words``), n_hit, items, and the carried columns."""
    scratch = Scratch(docs.sparkSession)
    grams = scratch.cut(test_ngrams(benchmark, n))
    tokens = [r["token"] for r in grams.select("token").distinct().limit(MAX_TOKENS + 1).collect()]
    text = F.col(text_col)
    d = docs.select(F.col(id_col).alias("doc_id"), null_safe_key(id_col).alias("key"), F.xxhash64(text).alias("text_key"), text.alias("text"), *[F.col(c).alias(f"carried_{c}") for c in carry])
    d = d.withColumn("words", split_words(F.col("text"))).drop("text")
    empty = F.when(F.get("words", F.lit(0)) == "", 1).otherwise(0) + F.when((F.size("words") > 1) & (F.element_at("words", -1) == ""), 1).otherwise(0)
    d = d.withColumn("n_words", (F.size("words") - empty).cast("long"))
    few = len(tokens) <= MAX_TOKENS and grams.count() <= MAX_BROADCAST
    g = _by_token(d, F.broadcast(grams), tokens, carry) if few else _by_hash(scratch, d, grams)
    hits = F.array_distinct(F.flatten(F.transform("spans", lambda s: F.sequence(s["s"], s["e"]))))
    items = F.sort_array(F.array_distinct(F.flatten("items")))
    return g.select("doc_id", "text_key", "n_words", hits.alias("hits"), F.size(hits).cast("long").alias("n_hit"), items.alias("items"), *[F.col(f"carried_{c}").alias(c) for c in carry])


def _by_token(d: DataFrame, grams: DataFrame, tokens: list[str], carry) -> DataFrame:
    """d with spans and items of its hits."""
    d = d.withColumn("row", F.monotonically_increasing_id())
    probe = "lower(w) IN (%s)" % ", ".join(f"'{t}'" for t in tokens) if tokens else "false"
    found = F.expr(f"filter(transform(words, (w, i) -> if({probe}, i, null)), i -> i IS NOT NULL)")
    d = d.withColumn("at", F.explode_outer(found)).withColumn("probe", F.lower(F.get("words", F.col("at"))))
    start = F.col("at") - F.col("offset")
    whole = F.translate(F.concat_ws(" ", F.slice("words", F.greatest(start, F.lit(0)) + 1, F.col("length"))), UPPER, LOWER) == F.col("ngram")
    j = d.join(grams, (F.col("probe") == F.col("token")) & (start >= 0) & whole, "left")
    span = F.when(F.col("ngram").isNotNull(), F.struct(start.alias("s"), (start + F.col("length") - 1).alias("e")))
    return j.groupBy("row").agg(*[F.first(c).alias(c) for c in ("doc_id", "text_key", "n_words", *[f"carried_{c}" for c in carry])], F.collect_set(span).alias("spans"), F.collect_set("items").alias("items"))


def _by_hash(scratch: Scratch, d: DataFrame, grams: DataFrame) -> DataFrame:
    """The same by hashes of whole windows; a window's row has its place and
    hash, not the text."""
    lengths = sorted(r[0] for r in grams.select("length").distinct().collect())  # as many as an n-gram may have words

    def windows(k):
        at = F.when(F.size("low") >= k, F.sequence(F.lit(0), F.size("low") - k)).otherwise(F.array().cast("array<int>"))
        own = low.select("key", "text_key", "low", F.explode(at).alias("s"))  # the words stay in their task
        return own.select("key", "text_key", "s", F.lit(k).alias("length"), F.xxhash64(F.slice("low", F.col("s") + 1, F.lit(k))).alias("hash"))

    low = d.select("key", "text_key", F.transform("words", lambda x: F.translate(x, UPPER, LOWER)).alias("low"))
    w = windows(lengths[0])
    for k in lengths[1:]:
        w = w.union(windows(k))
    g = grams.select("ngram", "length", "items", F.xxhash64(F.split("ngram", " ")).alias("hash"))
    if g.count() <= MAX_BROADCAST:
        g = F.broadcast(g)
    hits = w.join(g, ["hash", "length"]).groupBy("key", "text_key").agg(F.collect_set(F.struct("s", "length", "ngram", "items")).alias("maybe"))
    j = d.join(scratch.save(hits), ["key", "text_key"], "left")
    same = F.filter("maybe", lambda h: F.translate(F.concat_ws(" ", F.slice("words", h["s"] + 1, h["length"])), UPPER, LOWER) == h["ngram"])
    j = j.withColumn("true", F.coalesce(same, F.filter(F.array(F.struct(F.lit(0).alias("s"), F.lit(0).alias("length"), F.lit("").alias("ngram"), F.array().cast("array<string>").alias("items"))), lambda h: F.lit(False))))
    return j.withColumn("spans", F.transform("true", lambda h: F.struct(h["s"].alias("s"), (h["s"] + h["length"] - 1).alias("e")))).withColumn("items", F.transform("true", lambda h: h["items"]))


def decontaminate(docs: DataFrame, benchmark: DataFrame, remove: str = "documents", n: int = NGRAM) -> DataFrame:
    """docs without contaminated documents (``documents``) or without the hit
    words of their texts (``spans``); columns as in docs."""
    if remove not in ("documents", "spans"):
        raise ValueError("remove is 'documents' or 'spans'")
    hit = scan(docs, benchmark, n).where("n_hit > 0").select(null_safe_key("doc_id").alias("__id"), F.col("text_key").alias("__text"), F.col("hits").alias("__hits")).dropDuplicates(["__id", "__text"])
    # written first: while the hits are few, Spark sees their size and sends
    # them to the texts instead of moving the texts
    hit = Scratch(docs.sparkSession).save(hit if remove == "spans" else hit.drop("__hits"))
    d = docs.withColumn("__id", null_safe_key("doc_id")).withColumn("__text", F.xxhash64("text"))
    if remove == "documents":
        return d.join(hit, ["__id", "__text"], "left_anti").select(*[d[c] for c in docs.columns])
    parts = F.split("text", rf"(?<={NOT_WORD})(?!{NOT_WORD})|(?<!{NOT_WORD})(?={NOT_WORD})")
    lead = F.when(F.col("text").rlike(rf"^{NOT_WORD}"), 1).otherwise(0)
    cut = F.transform(parts, lambda p, i: F.when((F.pmod(i + lead, F.lit(2)) == 0) & F.array_contains("__hits", F.floor((i + lead) / 2).cast("int")), "").otherwise(p))
    d = d.join(hit, ["__id", "__text"], "left")
    text = F.when(F.col("__hits").isNotNull(), F.array_join(cut, "")).otherwise(F.col("text"))
    return d.select(*[text.alias("text") if c == "text" else d[c] for c in docs.columns])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = scan(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return out.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


SQL = rf"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
g AS (SELECT DISTINCT item_id, least(len(w), {NGRAM}) AS n, array_to_string(w[s + 1 : s + {NGRAM}], ' ') AS gram
      FROM (SELECT item_id, w, unnest(range(0, greatest(len(w) - {NGRAM}, 0) + 1)) AS s FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM g),
p AS (SELECT r, n, s, array_to_string(w[s + 1 : s + n], ' ') AS gram
      FROM (SELECT r, w, n, unnest(range(0, len(w) - n + 1)) AS s FROM d, sizes WHERE len(w) >= n)),
h AS (SELECT r, s, g.n, item_id FROM p JOIN g ON p.gram = g.gram AND p.n = g.n),
hw AS (SELECT r, count(DISTINCT k) AS n_hit FROM (SELECT r, unnest(range(s, s + n)) AS k FROM h) GROUP BY r),
hi AS (SELECT r, count(DISTINCT item_id) AS n_items, array_to_string(list_sort(list(DISTINCT item_id::VARCHAR)), ',') AS items FROM h GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hw USING (r) LEFT JOIN hi USING (r)
"""
