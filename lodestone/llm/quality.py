"""Quality classifier: a generalised additive model with pairwise interactions.

A text is NAMES numbers (shares of kinds of characters, lengths, repetition).
Each is cut into bins at quantiles of the training rows, and has a lookup table
from bin to log-odds. Tables are learned by cyclic boosting: in turn, every
feature gets a shallow tree (up to four leaves over its bins) fitted to the
gradient of the log loss, added with a small step. The pairs of features whose
joint bins explain most of what is left get tables of their own, boosted in the
same way with trees that cut both features once. A score is the
sum of the looked-up bins, as a probability; texts are scored by adding table
rows for a batch at a time.

Tables are fitted by one task on a sample of about FIT_ROWS labelled rows (all
of them where there are fewer), chosen by a hash of the id, and where ids repeat
also of the features; FIT_ROWS is the documented bound of what that task gets.
Every text is scored.

Defined results: null text counts as empty and is scored as such; a row whose
label or id is null is not learned from; several labels of one id count as
their mean; a null id counts as the text '' when rows are held out; without
training rows every score is 0.5; repeated rows get equal scores; an empty
table gives an empty result.
"""

from __future__ import annotations

import io
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._shared import IS_SPACE, Scratch, ship, tidy, word_hashes

FIT_ROWS = 20_000
BINS = 32
COARSE = 8  # bins of a feature in a pair
ROUNDS = 120
PAIRS = 8
PAIR_ROUNDS = 60
STEP = 0.1
LEAST = 5  # rows of a leaf at least
RIDGE = 1.0
THRESHOLD = 0.3

NAMES = ("bytes", "words", "word_length", "longest_word", "letters", "upper", "digits", "points", "symbols", "blanks", "lines", "controls", "distinct_words", "top_word", "distinct_pairs", "bare_words", "mixed_words", "sentence", "entropy", "capital_words")

_ALPHA = np.array([chr(c).isalpha() and c < 128 or c >= 128 for c in range(256)])
_UPPER = np.array([65 <= c <= 90 for c in range(256)])
_LOWER = np.array([97 <= c <= 122 for c in range(256)])
_DIGIT = np.array([48 <= c <= 57 for c in range(256)])
_POINT = np.isin(np.arange(256), [ord(c) for c in ".,;:'\"?-!()"])
_SYMBOL = np.array([33 <= c < 127 for c in range(256)]) & ~_ALPHA & ~_DIGIT & ~_POINT
_CONTROL = np.array([c < 32 or c == 127 for c in range(256)]) & ~IS_SPACE
_END = np.isin(np.arange(256), [ord(c) for c in ".?!"])
_PAIR = np.uint64(0x9E3779B97F4A7C15)


def features(texts: list[bytes]) -> np.ndarray:
    """A row of NAMES per text."""
    out = np.zeros((len(texts), len(NAMES)), np.float64)
    hashes, first = word_hashes(texts)
    for i, t in enumerate(texts):
        raw = np.frombuffer(t, np.uint8)
        n = len(raw)
        if not n:
            continue
        kinds = np.bincount(raw, minlength=256)
        own = hashes[first[i] : first[i + 1]]
        words = max(1, len(own))
        space = IS_SPACE[raw]
        edge = np.flatnonzero(np.diff(np.concatenate([[True], space, [True]]).view(np.int8)))
        begin, size = edge[0::2], edge[1::2] - edge[0::2]
        letters = kinds[_ALPHA].sum()
        cased = max(1, kinds[_UPPER].sum() + kinds[_LOWER].sum())
        _, often = np.unique(own, return_counts=True)
        pairs = len(np.unique(own[:-1] * _PAIR + own[1:])) / (words - 1) if words > 1 else 1.0
        bare = mixed = capital = 0.0
        if len(begin):
            held = np.add.reduceat(_ALPHA[raw].astype(np.int64), begin)
            strange = np.add.reduceat((_SYMBOL | _DIGIT)[raw].astype(np.int64), begin)
            bare, mixed = (held == 0).mean(), ((held > 0) & (strange > 0)).mean()
            capital = _UPPER[raw[begin]].mean()
        share = kinds[kinds > 0] / n
        out[i] = (
            np.log2(1 + n), np.log2(1 + words), (n - space.sum()) / words, np.log2(1 + size.max(initial=0)), letters / n, kinds[_UPPER].sum() / cased, kinds[_DIGIT].sum() / n, kinds[_POINT].sum() / n, kinds[_SYMBOL].sum() / n, space.sum() / n,
            kinds[10] / words, kinds[_CONTROL].sum() / n, len(often) / words, often.max(initial=0) / words, pairs, bare, mixed, np.log2(1 + words / (1 + kinds[_END].sum())), -(share * np.log2(share)).sum(), capital,
        )
    return out


class Model(NamedTuple):
    """edges: a row of BINS - 1 ascending bin edges a feature; tables: log-odds
    by feature and bin; pairs: two feature numbers a row; joint: log-odds by
    pair and both coarse bins."""

    base: float
    edges: np.ndarray
    tables: np.ndarray
    pairs: np.ndarray
    joint: np.ndarray

    def bins(self, x: np.ndarray) -> np.ndarray:
        """The bin of every feature, a row a feature."""
        return np.stack([np.searchsorted(e, x[:, f], side="right") for f, e in enumerate(self.edges)])

    def log_odds(self, bins: np.ndarray) -> np.ndarray:
        z = np.full(bins.shape[1], self.base)
        for f, table in enumerate(self.tables):
            z += table[bins[f]]
        coarse = bins * COARSE // BINS
        for (a, b), table in zip(self.pairs, self.joint):
            z += table[coarse[a], coarse[b]]
        return z

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-self.log_odds(self.bins(x))))

    def dump(self) -> bytes:
        held = io.BytesIO()
        np.savez(held, **self._asdict())
        return held.getvalue()

    @staticmethod
    def load(data: bytes) -> Model:
        with np.load(io.BytesIO(data)) as f:
            return Model(float(f["base"]), *(f[n] for n in Model._fields[1:]))


def empty_model() -> Model:
    n = len(NAMES)
    return Model(0.0, np.zeros((n, BINS - 1)), np.zeros((n, BINS)), np.zeros((0, 2), np.int64), np.zeros((0, COARSE, COARSE)))


def _gain(g, h):
    return g * g / (h + RIDGE)


def _cut(g: np.ndarray, h: np.ndarray, n: np.ndarray) -> tuple[float, int]:
    """(gain, place) of the best cut of consecutive bins; gain 0 for none."""
    left_g, left_h, left_n = np.cumsum(g)[:-1], np.cumsum(h)[:-1], np.cumsum(n)[:-1]
    total = _gain(g.sum(), h.sum())
    gain = _gain(left_g, left_h) + _gain(g.sum() - left_g, h.sum() - left_h) - total
    gain = np.where((left_n >= LEAST) & (n.sum() - left_n >= LEAST), gain, 0.0)
    at = int(gain.argmax()) if len(gain) else 0
    return (float(gain[at]), at + 1) if len(gain) and gain[at] > 0 else (0.0, 0)


def tree(g: np.ndarray, h: np.ndarray, n: np.ndarray, depth: int = 2) -> np.ndarray:
    """Leaf values by bin of a tree over consecutive bins, fitted to sums of
    gradients, curvatures and rows by bin."""
    gain, at = _cut(g, h, n) if depth else (0.0, 0)
    if not at:
        return np.full(len(g), -g.sum() / (h.sum() + RIDGE))
    return np.concatenate([tree(g[:at], h[:at], n[:at], depth - 1), tree(g[at:], h[at:], n[at:], depth - 1)])


def joint_tree(g: np.ndarray, h: np.ndarray, n: np.ndarray) -> np.ndarray:
    """As ``tree`` over two features: of all pairs of a cut of the one and a
    cut of the other, the one whose four quarters gain most."""
    def quarters(x):
        c = x.cumsum(axis=0).cumsum(axis=1)
        low, row, column = c[:-1, :-1], c[:-1, -1:], c[-1:, :-1]
        return np.stack([low, row - low, column - low, c[-1, -1] - row - column + low])

    gs, hs, ns = map(quarters, (g, h, n))
    gain = np.where((ns >= LEAST).all(axis=0), _gain(gs, hs).sum(axis=0), -1.0)
    i, j = np.unravel_index(gain.argmax(), gain.shape)
    if gain[i, j] < 0:
        return np.full(g.shape, -g.sum() / (h.sum() + RIDGE))
    leaf = -gs[:, i, j] / (hs[:, i, j] + RIDGE)
    high = np.arange(g.shape[0])[:, None] > i, np.arange(g.shape[1]) > j
    return leaf[2 * high[0] + high[1]]


def train(x: np.ndarray, y: np.ndarray) -> Model:
    """x: a row of features a row, y: labels from 0 to 1."""
    if not len(y):
        return empty_model()
    q = np.arange(1, BINS) / BINS
    edges = np.quantile(x, q, axis=0, method="lower").T.copy()
    # a value at an edge belongs above it; the least value gets a bin of its own
    rate = (y.sum() + 1) / (len(y) + 2)
    model = Model(float(np.log(rate / (1 - rate))), edges, np.zeros((x.shape[1], BINS)), np.zeros((0, 2), np.int64), np.zeros((0, COARSE, COARSE)))
    bins = model.bins(x)
    z = np.full(len(y), model.base)

    def slopes():
        p = 1 / (1 + np.exp(-z))
        return p - y, p * (1 - p)

    rows = np.stack([np.bincount(b, minlength=BINS) for b in bins])
    for _ in range(ROUNDS):
        for f, b in enumerate(bins):
            g, h = slopes()
            step = STEP * tree(np.bincount(b, g, BINS), np.bincount(b, h, BINS), rows[f])
            model.tables[f] += step
            z += step[b]
    coarse = bins * COARSE // BINS
    g, h = slopes()
    cells = COARSE * COARSE
    found = []
    for a in range(len(bins)):
        for b in range(a):
            at = coarse[b] * COARSE + coarse[a]
            own, curve, n = np.bincount(at, g, cells), np.bincount(at, h, cells), np.bincount(at, minlength=cells)
            found.append((-float(_gain(own, curve)[n >= LEAST].sum()), b, a))
    pairs = np.array([p[1:] for p in sorted(found)[:PAIRS]], np.int64).reshape(-1, 2)
    joint = np.zeros((len(pairs), COARSE, COARSE))
    places = [coarse[a] * COARSE + coarse[b] for a, b in pairs]
    for _ in range(PAIR_ROUNDS):
        for k, at in enumerate(places):
            g, h = slopes()
            sums = (np.bincount(at, v, cells).reshape(COARSE, COARSE) for v in (g, h, np.ones(len(y))))
            step = STEP * joint_tree(*sums)
            joint[k] += step
            z += step.ravel()[at]
    return model._replace(pairs=pairs, joint=joint)


def held_out(id_col: str) -> Column:
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))) % 5 == 0


def _share(*cols) -> Column:
    """A number in [0, 1) that these columns decide."""
    return F.pmod(F.xxhash64(*cols), F.lit(1 << 40)) / float(1 << 40)


def fit(docs: DataFrame, labels: DataFrame, scratch: Scratch, fit_rows: int = FIT_ROWS) -> Model:
    """docs (doc_id, text), labels (doc_id, label): a model of the label."""
    spark = docs.sparkSession
    known = labels.where("doc_id IS NOT NULL AND label IS NOT NULL").groupBy("doc_id").agg(F.avg(F.col("label").cast("double")).alias("label"))
    known = known.where(~held_out("doc_id"))
    n = known.count()
    if not n:
        return empty_model()
    some = scratch.save(known.where(_share(F.lit("label"), F.col("doc_id").cast("string")) < fit_rows / n))
    small = some.count() <= 2 * fit_rows
    rows = docs.join(F.broadcast(some) if small else some, "doc_id")

    def measure(batches):
        for b in batches:
            if b.num_rows:
                x = features([t.as_py() or b"" for t in b.column("text")])
                yield pa.record_batch({"doc_id": b.column("doc_id"), "label": b.column("label"), "x": pa.array([r.tobytes() for r in x], pa.binary())})

    kind = docs.schema["doc_id"].dataType.simpleString()
    measured = scratch.save(rows.select("doc_id", "label", "text").mapInArrow(tidy(measure), f"doc_id {kind}, label double, x binary"))
    m = measured.count()

    def learn(batches):
        held = [(b.column("label").to_numpy(), b"".join(b.column("x").to_pylist())) for b in batches if b.num_rows]
        y = np.concatenate([np.zeros(0), *[h[0] for h in held]])
        x = np.frombuffer(b"".join(h[1] for h in held), np.float64).reshape(-1, len(NAMES))
        o = np.lexsort((*x.T, y))  # the order of rows depends on the tasks
        yield pa.record_batch({"model": pa.array([train(x[o], y[o]).dump()], pa.binary())})

    # ids that repeat: as many rows as the bound says, by their contents
    chosen = measured.where(_share(F.lit("row"), F.col("doc_id").cast("string"), "x") < 2 * fit_rows / max(m, 1))
    model = Model.load(bytes(chosen.select("label", "x").coalesce(1).mapInArrow(learn, "model binary").head()["model"]))
    scratch.drop(some, measured)
    return model


def score(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_id: str = "doc_id", label_col: str = "quality", fit_rows: int = FIT_ROWS) -> tuple[DataFrame, Model]:
    """One row per row of docs: doc_id, held_out, score; and the model, whose
    tables say what each feature adds."""
    spark = docs.sparkSession
    ship(spark)
    d = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    # ids are compared as text, whatever the types of both tables
    ids = d.withColumn("doc_id", F.col("doc_id").cast("string"))
    model = fit(ids, labels.select(F.col(label_id).cast("string").alias("doc_id"), F.col(label_col).alias("label")), Scratch(spark), fit_rows)
    sent = spark.sparkContext.broadcast(model)

    def run(batches):
        for b in batches:
            if b.num_rows:
                x = features([t.as_py() or b"" for t in b.column("text")])
                yield pa.record_batch({"doc_id": b.column("doc_id"), "score": pa.array(sent.value.scores(x))})

    out = d.mapInArrow(tidy(run), d.select("doc_id").schema.add("score", "double"))
    return out.select("doc_id", held_out("doc_id").alias("held_out"), "score"), model


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    out, _ = score(docs.select("doc_id", "text"), labels)
    return out.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
