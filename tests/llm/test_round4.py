"""Quality classifier, vector codes and periodic runs."""

import hashlib
import random
import re
import zlib
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import duck, same_rows
from lodestone.llm import chat_format, quality, run_detection, vector_codes

WORD = re.compile(r"[^\x20\x09-\x0D]+")


# -- periodic runs -----------------------------------------------------------


def runs_by_hand(words, times=4, least=6):
    """Every maximal stretch of every period, those with a shorter one left
    out."""
    out, n = [], len(words)
    for q in range(1, n // times + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            size = j - i + q
            if j > i and size >= max(least, times * q) and not any(all(words[k] == words[k + p] for k in range(i, i + size - p)) for p in range(1, q)):
                out.append((i, size, q))
            i = max(j, i) + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def test_runs_equal_those_found_by_hand():
    rng = random.Random(3)
    for _ in range(600):
        texts = []
        for _ in range(rng.randint(1, 4)):
            n, k = rng.choice([0, 1, 5, 6, 7, 12, 40, 90]), rng.choice([1, 2, 2, 3, 6])
            t = [rng.randrange(k) for _ in range(n)]
            if n and rng.random() < 0.6:
                a = rng.randrange(n)
                p = 1 + (n - a) // (3 + rng.randrange(8))
                t = [t[i] if i < a else t[a + (i - a) % p] for i in range(n)]
            texts.append(np.array(t, np.int64))
        text, *found = run_detection.find_runs(texts)
        for i, t in enumerate(texts):
            assert [tuple(map(int, r)) for x, *r in zip(text, *found) if x == i] == runs_by_hand(t.tolist())


def test_positions_move_a_logarithmic_number_of_times():
    """The smaller-half rule: what is split off is small."""
    n = 4096
    moved = []
    own = run_detection._Classes.split

    def counted(self, p):
        moved.append(len(p))
        return own(self, p)

    run_detection._Classes.split = counted
    try:
        text = np.tile(np.arange(64), n // 64)
        assert [tuple(map(int, r)) for r in zip(*run_detection.find_runs([text])[1:])] == [(0, n, 64)]
    finally:
        run_detection._Classes.split = own
    assert sum(moved) <= n * np.log2(n)


def rewritten(doc_id, words):
    h, n = zlib.crc32(str(doc_id).encode()), len(words)
    if h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]


def test_op13_equals_brute_force(spark, small):
    got = {r["doc_id"]: r for r in run_detection.query(spark, small).collect()}
    docs = spark.read.parquet(f"{small}/documents.parquet").collect()
    assert len(got) == len(docs)
    some = 0
    for r in docs:
        words, o = rewritten(r["doc_id"], WORD.findall(r["text"] or "")), got[r["doc_id"]]
        if len(words) > 1500:
            continue
        want = runs_by_hand(words)
        assert o["n_runs"] == len(want)
        assert o["runs_sha256"] == hashlib.sha256("".join(f"{a},{b},{c}\n" for a, b, c in want).encode()).hexdigest()
        best = max(want, key=lambda x: (Fraction(x[1], x[2]), -x[0], -x[2]), default=None)
        assert (o["start"], o["length"], o["period"], o["exponent_milli"]) == ((*best, 1000 * best[1] // best[2]) if best else (None,) * 4)
        drop = {i for a, b, c in want for i in range(a + c, a + b)}
        assert o["collapsed_sha256"] == hashlib.sha256(" ".join(w for i, w in enumerate(words) if i not in drop).encode()).hexdigest()
        some += bool(want)
    assert some >= 5


def test_runs_of_odd_rows(spark):
    long = "x " * 5 + " ".join(f"w{i}" for i in range(30_000)) + " a b" * 20_000
    rows = [(1, None, 7), (2, "", 7), (3, " \t\n", 7), (None, "a a a a a a", 7), (5, "ü ü\nü\tü ü ü end", 7), (5, "ü ü\nü\tü ü ü end", 7), (6, long, 7), (7, "a a a a a", 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, runs int").withColumn("collapsed", F.lit("x")).repartition(3)
    out = sorted(((r["doc_id"], [tuple(x) for x in r["runs"]], r["collapsed"]) for r in run_detection.runs(docs).collect()), key=str)
    want = [(1, [], ""), (2, [], ""), (3, [], ""), (None, [(0, 6, 1)], "a"), (5, [(0, 6, 1)], "ü end"), (5, [(0, 6, 1)], "ü end"), (7, [], "a a a a a")]
    assert [r for r in out if r[0] != 6] == sorted(want, key=str)
    runs = [r for r in out if r[0] == 6][0]
    assert runs[1] == [(30_005, 40_000, 2)] and runs[2].endswith("w29999 a b")
    assert run_detection.runs(docs.limit(0)).count() == 0


# -- vector codes ------------------------------------------------------------


def test_nearest_equals_all_distances():
    rng = np.random.default_rng(5)
    for i in range(120):
        d, k, n, m = rng.integers(1, 24), rng.integers(1, 257), rng.integers(0, 50), int(rng.choice([2, 60, 1000, 2**26]))
        x, book = rng.integers(-m, m, (n, d)), rng.integers(-m, m, (k, d))
        if i % 3 == 0:
            book[rng.integers(0, k, k // 2)] = book[0]
        away = ((x[:, None] - book[None]) ** 2).sum(axis=2)
        who, least = vector_codes.nearest(x, book)
        assert (who == away.argmin(axis=1)).all() and (least == away.min(axis=1)).all()


def test_op12_equals_sql(spark, small):
    assert len(same_rows(vector_codes.query(spark, small), vector_codes.SQL, duck(small))) == 500


def test_vector_codes_of_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(3, [0.5, -0.001, 0.0, 1.0], None), (1, [0.0, 0.0, 0.0, 0.0], 2), (1, [0.0, 0.0, 0.0, 0.0], 2), (None, [0.25, 0.0, 0.0, 0.0], None), (4, None, 1), (5, [0.0, None, 0.0, 0.0], 1), (6, [nan, 0.0, 0.0, 0.0], 1), (7, [0.0, inf, 0.0, 0.0], 1), (8, [], 1), (9, [1.0], 1), (10, [1e30, 0.0, 0.0, 0.0], 1)]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumn("x", F.lit(1)).withColumn("vector", F.lit("no")).withColumn("code", F.lit(0)).repartition(3)
    coded, books = vector_codes.compress(v)
    got = sorted(((r["vec_id"], r["code"], r["error"], r["label_error"]) for r in vector_codes.by_label(coded).collect()), key=str)
    assert got == sorted([(1, [0, 0, 0, 0], 0, 0), (1, [0, 0, 0, 0], 0, 0), (3, [2, 2, 0, 2], 0, 0), (None, [3, 0, 0, 0], 0, 0)], key=str)
    assert [b[2].tolist() for b in books.books] == [[512], [-2], [0], [1024]]  # -0.001 * 1024 floors down
    assert vector_codes.by_label(coded, most=0).count() == 4
    none, books = vector_codes.compress(v.limit(0))
    assert none.count() == 0 and [b.size for b in books.books] == [0] * 4
    assert vector_codes.cuts(6, 4) == [slice(0, 2), slice(2, 4), slice(4, 5), slice(5, 6)]


def test_salted_label_sums_are_the_same(spark, small):
    coded, _ = vector_codes.compress(spark.read.parquet(f"{small}/embeddings.parquet"))
    sums = [sorted(tuple(r) for r in vector_codes.by_label(coded, most).select("vec_id", "label_error").collect()) for most in (vector_codes.LABELS, 0)]
    assert sums[0] == sums[1] and len(sums[0]) == 500


# -- quality -----------------------------------------------------------------


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    q = quality.query(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("held_out").collect()
    right = [r["predicted"] == r["quality"] for r in q]
    clean = [r["predicted"] == 1 for r in q if r["quality"] == 1]
    assert len(right) > 50 and sum(right) / len(right) >= 0.95 and sum(clean) / len(clean) >= 0.98


def test_scores_are_sums_of_looked_up_bins(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    out, model = quality.score(docs, spark.read.parquet(f"{small}/labels.parquet"))
    got = {r["doc_id"]: r["score"] for r in out.collect()}
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert got.keys() == texts.keys() and len(model.pairs) == quality.PAIRS
    for i, t in list(texts.items())[:40]:
        x = quality.features([(t or "").encode()])[0]
        bins = [int((e <= v).sum()) for e, v in zip(model.edges, x)]
        z = model.base + sum(model.tables[f][b] for f, b in enumerate(bins))
        z += sum(j[bins[a] * quality.COARSE // quality.BINS, bins[b] * quality.COARSE // quality.BINS] for (a, b), j in zip(model.pairs, model.joint))
        assert abs(got[i] - 1 / (1 + np.exp(-z))) < 1e-9


def test_a_pair_is_learned_that_no_single_feature_shows():
    rng = np.random.default_rng(1)
    x = rng.random((4000, 3))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    model = quality.train(x, y)
    assert (0, 1) in [tuple(p) for p in model.pairs.tolist()]
    assert ((model.scores(x) >= 0.5) == y).mean() > 0.95


def test_quality_of_odd_rows(spark):
    rows = [(1, None), (2, ""), (None, "words of a text"), (3, "a b c"), (3, "a b c"), (4, "x" * 3_000_000 + " y" * 500_000), (5, "퟿ ###")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("score", F.lit(1)).withColumn("label", F.lit(2)).withColumn("x", F.lit(3))
    none = spark.createDataFrame([(1, None), (None, 1)], "doc_id long, quality int")
    out, _ = quality.score(docs, none)
    assert sorted((r["doc_id"], r["score"]) for r in out.collect() if r["doc_id"]) == [(1, 0.5), (2, 0.5), (3, 0.5), (3, 0.5), (4, 0.5), (5, 0.5)]
    some = spark.createDataFrame([(1, 0), (2, 0), (3, 1), (3, 0), (5, 1), (77, 1)], "doc_id long, quality int")
    got = [(r["doc_id"], r["score"]) for r in quality.score(docs, some)[0].collect()]
    assert len(got) == 7 and all(0 < s < 1 for _, s in got)
    assert len({s for i, s in got if i == 3}) == 1 and len({s for i, s in got if i in (1, 2)}) == 1
    assert quality.score(docs.limit(0), some)[0].count() == 0


def test_labels_of_held_out_rows_change_nothing(spark, small):
    docs, labels = (spark.read.parquet(f"{small}/{t}.parquet") for t in ("documents", "labels"))
    turned = labels.withColumn("quality", F.when(quality.held_out("doc_id"), 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = (sorted(tuple(r) for r in quality.score(docs, x)[0].collect()) for x in (labels, turned))
    assert a == b


@pytest.mark.parametrize("most", [40, 100])
def test_the_sample_bounds_what_is_fitted(spark, small, most, monkeypatch):
    docs, labels = (spark.read.parquet(f"{small}/{t}.parquet") for t in ("documents", "labels"))
    out, _ = quality.score(docs, labels, fit_rows=most)
    assert out.count() == docs.count()


# -- chat formatting -----------------------------------------------------------


def test_logs_with_every_kind_of_event_equal_sql(spark, small):
    assert same_rows(chat_format.events_query(spark, small), chat_format.EVENTS_SQL, duck(small))


def test_many_regenerations(spark):
    """Each of 30,000 turns is regenerated after all were said; the last
    regeneration logged is that of turn 0, of which nothing is left but what
    came after."""
    n = 30_000
    log = spark.range(n).selectExpr("1L AS conv_id", "id AS turn", "stack(2, id, 'message', 100000L + 2 * id, 'regenerate') AS (seq, event)", "'user' AS role")
    log = log.withColumn("text", F.concat("event", F.col("turn").cast("string")))
    got = chat_format.fold(log).agg(F.count("*").alias("n"), F.sum(F.when(F.col("text") == F.concat(F.lit("regenerate"), "turn"), 1)).alias("same")).first()
    assert got.n == n and got.same == n
    withdrawn = log.unionByName(spark.sql("SELECT 1L AS conv_id, 5L AS turn, 900000L AS seq, 'regenerate' AS event, 'user' AS role, 'last' AS text"))
    rows = chat_format.fold(withdrawn).orderBy("turn").collect()
    assert [r.turn for r in rows] == list(range(6)) and rows[5].text == "last"
