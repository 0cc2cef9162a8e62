"""Language ID by nearest centroid.

A text is a vector of hashed byte trigrams of its lower-cased words, weighted
by TF-IDF and normalised. Each language has several centroids from spherical
k-means; a text gets the language of the centroid with the highest cosine. A
text that is further from it than texts of its length ever were in training is
rejected.

Document frequencies, language counts and the floors of rejection cover all
training rows. Centroids are fitted on about ``FIT_ROWS`` training rows per language (all of them where
there are fewer), chosen by a hash of id and text; FIT_ROWS bounds what one
language sends to one task. Languages are scored in blocks of ``LANGS``, which
bounds what is collected and broadcast (LANGS * CENTROIDS * DIM floats, 13 MB);
beyond one block the texts are read once a block. Of every language the driver
holds its name, its count and its BINS floors.

Defined results: null text or text without letters is ``und`` with score 0;
rows without a language are not learned from; without any training row every
text is ``und``; a null id counts as the text '' when rows are held out;
repeated rows get equal predictions; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._shared import Scratch, chunks, ship, tidy

DIM = 4096
CENTROIDS = 4
FIT_ROWS = 1000
LANGS = 200  # languages whose centroids are broadcast together
ROUNDS = 8
BINS = 24
LENIENCE = 0.6
FLOOR_ROWS = 20

_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[:128] = [c if chr(c).isalpha() else 32 for c in range(128)]


def has_letter(text: str | None) -> bool:
    return text is not None and any(map(str.isalpha, text))


def counts(texts: list[str | None]) -> np.ndarray:
    """Rows of hashed trigram counts (len(texts) x DIM)."""
    out = np.zeros((len(texts), DIM), np.float32)
    for row, t in enumerate(texts):
        b = _FOLD[np.frombuffer(f" {(t or '').lower()} ".encode("utf-8", "surrogatepass"), np.uint8)].astype(np.uint32)
        if len(b) < 3:
            continue
        x, y, z = b[:-2], b[1:-1], b[2:]
        h = ((x * 65536 + y * 256 + z) * np.uint32(2654435761)) >> np.uint32(20)
        letters = (x != 32).view(np.int8) + (y != 32).view(np.int8) + (z != 32).view(np.int8)
        out[row] = np.bincount(h[letters >= 2], minlength=DIM)
    return out


def vectors(c: np.ndarray, idf: np.ndarray) -> np.ndarray:
    v = np.sqrt(c) * idf
    return v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)


def _bin(c: np.ndarray) -> np.ndarray:
    return np.minimum(np.log2(c.sum(axis=1) + 1), BINS - 1).astype(int)


def fit_centroids(v: np.ndarray, k: int = CENTROIDS) -> np.ndarray:
    """k' x DIM centroids. Starts from the vector nearest the mean and then
    those furthest from the ones chosen."""
    mean = v.mean(axis=0)
    chosen = [int(np.argmax(v @ mean))]
    best = v @ v[chosen[0]]
    while len(chosen) < min(k, len(v)):
        chosen.append(int(np.argmin(best)))
        best = np.maximum(best, v @ v[chosen[-1]])
    c = v[chosen].copy()
    for _ in range(ROUNDS):
        own = np.argmax(v @ c.T, axis=1)
        for i in range(len(c)):
            if (own == i).any():
                m = v[own == i].mean(axis=0)
                c[i] = m / max(np.linalg.norm(m), 1e-12)
    return c


def floors_of(seen: dict[int, tuple[int, float, list[float]]]) -> np.ndarray:
    """BINS floors of the cosine from the training texts nearest to a language,
    by length bin: their number, their least cosine and the cosines of
    FLOOR_ROWS of them.

    For each length the least cosine of its texts, or of the FLOOR_ROWS longest
    of shorter ones too where it has few."""
    floors = np.zeros(BINS, np.float32)
    for b in range(BINS):
        n, low = 0, np.inf
        for x in range(b, -1, -1):
            if x in seen and n < FLOOR_ROWS:
                own, least, some = seen[x]
                low = min(low, least if x == b or own <= FLOOR_ROWS - n else min(some[: FLOOR_ROWS - n]))
                n += own
        if n >= FLOOR_ROWS:
            floors[b] = LENIENCE * low
    return floors


def _batches(b: pa.RecordBatch):
    """Runs of rows of a batch whose texts are 2 MB in all, or one row."""
    texts = b.column("text").to_pylist()
    for rows in chunks(list(range(len(texts))), lambda i: len(texts[i] or "") + DIM, 1 << 21):
        yield rows[0], texts[rows[0] : rows[-1] + 1]


class Block:
    """The centroids of some languages, the numbers of their languages, and the
    weights of cells."""

    def __init__(self, centroids: np.ndarray, owner: np.ndarray, idf: np.ndarray):
        self.centroids, self.owner, self.idf = centroids, owner, idf

    def nearest(self, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(language, cosine) of the centroid nearest to counts; the first of
        several."""
        if not len(self.owner):
            return np.zeros(len(c), np.int64), np.zeros(len(c))
        cos = vectors(c, self.idf) @ self.centroids.T
        best = np.argmax(cos, axis=1)
        return self.owner[best].astype(np.int64), np.clip(cos[np.arange(len(c)), best], 0, 1).astype(float)


class Model:
    """langs, the floors of each (len(langs) x BINS), and blocks: a function
    from a block's number to the block, so that one is held at a time."""

    def __init__(self, langs: list[str], floors: np.ndarray, n_blocks: int, block):
        self.langs, self.floors, self.n_blocks, self.block = langs, floors, n_blocks, block

    def nearest(self, docs: DataFrame, scratch: Scratch, finish=None, schema=None) -> DataFrame:
        """docs (text, ...) with columns near, cosine and length_bin: the
        language with the highest cosine of all blocks. ``finish`` makes rows of
        ``schema`` out of them in the same worker: from an iterator of (batch,
        texts, near, cosine, length_bin) to one of batches."""
        spark = docs.sparkSession
        names = docs.columns
        kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
        scored = f"{kept}, near long, cosine double, length_bin long"
        made = None
        for i in range(self.n_blocks):
            sent = spark.sparkContext.broadcast(self.block(i))
            last = i == self.n_blocks - 1

            def rows(batches, sent=sent, further=i > 0):
                for b in batches:
                    for first, texts in _batches(b):
                        own, c = b.slice(first, len(texts)), counts(texts)
                        lang, cos = sent.value.nearest(c)
                        if further:
                            before = own.column("cosine").to_numpy()
                            keep = before >= cos
                            lang, cos = np.where(keep, own.column("near").to_numpy(), lang), np.where(keep, before, cos)
                        yield own, texts, lang, cos, _bin(c).astype(np.int64)

            def plain(found):
                for own, _, lang, cos, bins in found:
                    yield pa.record_batch({**{n: own.column(n) for n in names}, "near": pa.array(lang), "cosine": pa.array(cos), "length_bin": pa.array(bins)})

            def score(batches, rows=rows, make=finish if last and finish else plain):
                yield from make(rows(batches))

            docs = docs.mapInArrow(tidy(score), schema if last and finish else scored)
            if not last:
                docs = scratch.save(docs)
                if made is not None:
                    scratch.drop(made)
                made = docs
                sent.destroy()
        return docs


def fit(train: DataFrame, scratch: Scratch, fit_rows: int = FIT_ROWS, langs_a_block: int | None = None) -> Model:
    """train (text, lang, pick); pick is a double in [0, 1) that orders the
    choice of the rows that centroids are fitted on."""
    langs_a_block = langs_a_block or LANGS

    def frequencies(batches):
        df, langs = np.zeros(DIM, np.int64), {}
        for b in batches:
            for first, texts in _batches(b):
                df += (counts(texts) > 0).sum(axis=0)
            for x in b.column("lang").value_counts().to_pylist():
                langs[x["values"]] = langs.get(x["values"], 0) + x["counts"]
        at = np.flatnonzero(df)
        yield pa.record_batch({"cell": pa.array([*at.tolist(), *[None] * len(langs)], pa.int64()), "lang": pa.array([*[None] * len(at), *langs], pa.string()), "n": pa.array([*df[at].tolist(), *langs.values()], pa.int64())})

    stats = train.select("text", "lang").mapInArrow(frequencies, "cell long, lang string, n long").groupBy("cell", "lang").agg(F.sum("n").alias("n"))
    stats = scratch.cut(stats)
    sizes = stats.where("cell is null").select("lang", F.col("n").alias("rows"))
    counted = sorted(map(tuple, sizes.collect()))
    langs = [k for k, _ in counted]
    n = sum(m for _, m in counted)
    df = np.zeros(DIM)
    for r in stats.where("cell is not null").collect():
        df[r["cell"]] = r["n"]
    idf = (np.log((1 + n) / (1 + df)) + 1).astype(np.float32)
    floors = np.zeros((len(langs), BINS), np.float32)
    if not langs:
        return Model([], floors, 1, lambda i: Block(np.zeros((0, DIM), np.float32), np.zeros(0, int), idf))
    # a row a language; its size is that of the list above
    share = F.broadcast(sizes) if len(langs) <= 100_000 else sizes
    chosen = train.join(share, "lang").where(F.col("pick") < F.least(F.lit(1.0), F.lit(float(fit_rows)) / F.col("rows")))

    def weigh(batches):
        for b in batches:
            for first, texts in _batches(b):
                c = counts(texts)
                own = b.slice(first, len(texts))
                yield pa.record_batch({"lang": own.column("lang"), "pick": own.column("pick"), "vector": pa.array([x.tobytes() for x in vectors(c, idf).astype(np.float32)], pa.binary())})

    def centre(pdf):
        import pandas as pd

        pdf = pdf.sort_values(["pick", "vector"])
        v = np.frombuffer(b"".join(pdf["vector"]), np.float32).reshape(-1, DIM)
        c = fit_centroids(v)
        return pd.DataFrame({"lang": pdf["lang"].iloc[0], "centroid": [x.tobytes() for x in c.astype(np.float32)]})

    fitted = scratch.cut(chosen.select("text", "lang", "pick").mapInArrow(weigh, "lang string, pick double, vector binary").groupBy("lang").applyInPandas(centre, "lang string, centroid binary"))

    def block(i: int) -> Block:
        some = langs[i * langs_a_block : (i + 1) * langs_a_block]
        place = {k: i * langs_a_block + j for j, k in enumerate(some)}
        rows = sorted(fitted.where(F.col("lang").between(some[0], some[-1])).collect(), key=lambda r: (r["lang"], bytes(r["centroid"])))
        return Block(np.array([np.frombuffer(r["centroid"], np.float32) for r in rows]).reshape(-1, DIM), np.array([place[r["lang"]] for r in rows], int), idf)

    model = Model(langs, floors, -(-len(langs) // langs_a_block), block)

    def least(found):
        held = {}
        for own_, _, lang, cos, bins in found:
            pick, key = own_.column("pick").to_numpy(), lang * BINS + bins
            for k in np.unique(key).tolist():
                mine = key == k
                own, low, some = held.get(k, (0, np.inf, []))
                some = sorted([*some, *zip(pick[mine].tolist(), cos[mine].tolist())])[:FLOOR_ROWS]
                held[k] = own + int(mine.sum()), min(low, float(cos[mine].min())), some
        yield pa.record_batch({
            "near": pa.array([k // BINS for k in held], pa.int64()), "length_bin": pa.array([k % BINS for k in held], pa.int64()), "n": pa.array([x[0] for x in held.values()], pa.int64()), "least": pa.array([x[1] for x in held.values()], pa.float64()),
            "some": pa.array([[{"pick": p, "cosine": q} for p, q in x[2]] for x in held.values()], pa.list_(pa.struct([("pick", pa.float64()), ("cosine", pa.float64())]))),
        })

    some = F.slice(F.sort_array(F.flatten(F.collect_list("some"))), 1, FLOOR_ROWS)["cosine"]
    lows = model.nearest(train.select("text", "pick"), scratch, least, "near long, length_bin long, n long, least double, some array<struct<pick: double, cosine: double>>")
    seen = {}
    for r in lows.groupBy("near", "length_bin").agg(F.sum("n").alias("n"), F.min("least").alias("least"), some.alias("some")).collect():
        seen.setdefault(r["near"], {})[r["length_bin"]] = (r["n"], r["least"], r["some"])
    for lang, own in seen.items():
        model.floors[lang] = floors_of(own)
    return model


def held_out(id_col: str) -> Column:
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))) % 4 == 2


def pick_of(id_col: str, text_col: str) -> Column:
    return F.pmod(F.xxhash64(F.col(id_col).cast("string"), F.col(text_col)), F.lit(1 << 40)) / float(1 << 40)


def identify(docs: DataFrame, id_col="doc_id", text_col="text", lang_col="lang", carry: tuple[str, ...] = ()) -> DataFrame:
    """One row per row of docs: doc_id, held_out, lang_pred, score, rejected,
    and the carried columns."""
    spark = docs.sparkSession
    ship(spark)
    scratch = Scratch(spark)
    train = docs.where(~held_out(id_col) & F.col(lang_col).isNotNull()).select(F.col(text_col).alias("text"), F.col(lang_col).alias("lang"), pick_of(id_col, text_col).alias("pick"))
    model = fit(train, scratch)
    found = spark.sparkContext.broadcast((model.langs, model.floors))
    d = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), *[F.col(c).alias(f"carried_{c}") for c in carry])
    schema = d.select("doc_id", *[f"carried_{c}" for c in carry]).schema.add("lang_pred", "string").add("score", "double").add("rejected", "boolean")
    names = schema.fieldNames()[:-3]

    def judge(scored):
        langs, floors = found.value
        for own, texts, near, cos, bins in scored:
            letters = np.array([has_letter(t) for t in texts], bool)
            rejected = ~letters | (cos < floors[near, bins]) if langs else np.ones(len(near), bool)
            said = [langs[i] if ok and langs else "und" for i, ok in zip(near, letters)]
            yield pa.record_batch({**{n: own.column(n) for n in names}, "lang_pred": pa.array(said, pa.string()), "score": pa.array(np.where(letters, cos, 0.0)), "rejected": pa.array(rejected)})

    out = model.nearest(d, scratch, judge, schema)
    return out.select("doc_id", held_out("doc_id").alias("held_out"), "lang_pred", "score", "rejected", *[F.col(f"carried_{c}").alias(c) for c in carry])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(spark.read.parquet(f"{sf_dir}/documents.parquet"))
