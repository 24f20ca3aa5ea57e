"""Toxicity by a classifier chain of linear models.

``train(docs, labels, categories)`` fits one logistic regression for each category, in
order; the model of a later category also sees the probabilities of the earlier ones.
In training those come out of fold, and so do the word scores beside which they are
weighed, so that a later model learns from predictions as good as those it will meet;
how far it may lean on them (a ridge) is chosen by out-of-fold likelihood.  ``score``
applies the chain to whole texts.  A text's fold is a hash of the text, so the model that
gives its earlier probabilities is one that never saw that text, in training and in
scoring alike: a labelled document is not passed on more surely than an unlabelled one.

Features, each once a text: words (runs of letters, digits and non-ASCII; A-Z in lower
case) and their first 4, 5 and 6 bytes, hashed to 2**18 places; places seen in fewer
than MIN_SEEN training rows keep weight 0.

Training uses at most ``max_rows`` labelled ids (12,000) in the order of their hash, one
text each, and of those as many as have ``max_entries`` features (16 million, 64 MB)
together; those bounds are all that reaches the driver.  Every document is scored, a very
long text in pieces whose features count as one set.

Defined cases: null text is empty and gets the bias alone; labels that are null are left
out for their category; several label rows of a doc_id count by their maximum; of a
doc_id with several texts the one of least hash trains; labels of unknown documents are ignored; a category with one class only, or no labels, gives
its rate (0 without labels); null doc_id is scored like others; other columns are
ignored unless named in ``carry``; an empty table gives an empty one.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .common import LOWER, SMALL_SLICE, Rolling, column, scratch, small_batches, word_slices, words
from .decontaminate import SEPARATOR

BITS, MIN_SEEN, FOLDS = 18, 3, 5
#: What reaches the driver of the labelled rows: rows, and features of all of them (64 MB).
MAX_ROWS, MAX_ENTRIES = 12_000, 16_000_000
RIDGES = (0.1, 1.0, 10.0, 100.0, 1000.0)
PREFIXES = (4, 5, 6)
_W = Rolling(71)
#: name, label column, value that means the category applies
CATEGORIES = (("low_quality", "quality", 0), ("toxic", "toxic", 1))


def features(data: np.ndarray, off: np.ndarray):
    """Yields each row's feature places."""
    data = LOWER[data]
    starts, ends, first = words(data, off, SEPARATOR)
    sums = _W.sums(data)
    kinds = [_W.spans(sums, starts, ends)]
    kinds += [np.where(ends - starts > n, _W.spans(sums, starts, np.minimum(starts + n, ends)) ^ np.uint64(n), kinds[0]) for n in PREFIXES]
    place = (np.stack(kinds, 1) >> np.uint64(64 - BITS)).astype(np.int32) if len(starts) else np.zeros((0, 4), np.int32)
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        yield np.unique(place[a:b])


def feature_slices(batch: pa.RecordBatch):
    """Yields (rows of the batch, feature places of each); a long text's pieces as one."""
    held = None
    for rows, data, off, before in word_slices(batch, "_text", SMALL_SLICE, 0, SEPARATOR):
        found = list(features(data, off))
        if before:
            held = held[0], [np.union1d(held[1][0], found[0])]
            continue
        if held:
            yield held
        held = slice(rows.start, rows.start + len(found)), found
    if held:
        yield held


class _Rows:
    """Binary rows in compressed form.  Sums go through blocks of entries, so that their
    temporaries stay small beside the entries (four bytes each) themselves."""

    BLOCK = 1_000_000

    def __init__(self, at: np.ndarray, row: np.ndarray, rows: int, size: int):
        self.at, self.row, self.rows, self.size = at, row, rows, size

    def _blocks(self):
        for lo in range(0, len(self.at), self.BLOCK):
            yield self.at[lo : lo + self.BLOCK], self.row[lo : lo + self.BLOCK]

    def dot(self, w: np.ndarray) -> np.ndarray:
        out = np.zeros(self.rows)
        for at, row in self._blocks():
            out += np.bincount(row, w[at], minlength=self.rows)
        return out

    def back(self, r: np.ndarray) -> np.ndarray:
        out = np.zeros(self.size)
        for at, row in self._blocks():
            out += np.bincount(at, r[row], minlength=self.size)
        return out

    def part(self, kept: np.ndarray, use: np.ndarray) -> "_Rows":
        """Only the features ``kept``, numbered anew, in the rows in ``use``."""
        number = np.full(self.size, -1, np.int32)
        number[kept] = np.arange(len(kept), dtype=np.int32)
        some = [(number[at], row, (number[at] >= 0) & use[row]) for at, row in self._blocks()]
        at = [a[ok] for a, _, ok in some] or [np.zeros(0, np.int32)]
        row = [r[ok] for _, r, ok in some] or [np.zeros(0, np.int32)]
        return _Rows(np.concatenate(at), np.concatenate(row), self.rows, len(kept))


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _words(x: _Rows, y: np.ndarray, use: np.ndarray, steps: int = 60, ridge: float = 1.0, least: float = 1.0):
    """Weights and bias of a logistic regression on words, by accelerated gradient steps.

    Features are scaled by their smoothed log ratio between the classes (under ``least``:
    left out), so that weight goes to what tells the classes apart in many rows.
    """
    use = use & ~np.isnan(y)
    t = np.where(use, y, 0.0)
    ones, zeros = t.sum(), use.sum() - t.sum()
    out = np.zeros(x.size, np.float32)
    if not ones or not zeros:
        return out, (-30.0 if not ones else 30.0)
    c1 = x.back(t)
    c0 = x.back(use.astype(float)) - c1
    ratio = np.log((c1 + 1) / (ones + 2)) - np.log((c0 + 1) / (zeros + 2))
    kept = np.flatnonzero((np.abs(ratio) >= least) & (c0 + c1 >= MIN_SEEN))
    scale, own = ratio[kept], x.part(kept, use)
    span = np.random.default_rng(0).normal(size=len(kept))
    top = 0.0
    for _ in range(8):  # the largest curvature, by power iteration
        if not (norm := np.linalg.norm(span)):
            break
        span = own.back(own.dot(span / norm * scale)) * scale
        top = np.linalg.norm(span)
    step, step_b = 1 / (0.28 * top + ridge), 4 / float(use.sum())
    new = [np.zeros(len(kept)), float(np.log(ones / zeros))]
    ahead, turn = list(new), 1.0
    for _ in range(steps):
        w, b = ahead
        r = (_sigmoid(own.dot(w * scale) + b) - t) * use
        old = new
        new = [w - step * (own.back(r) * scale + ridge * w), b - step_b * float(r.sum())]
        after = (1 + np.sqrt(1 + 4 * turn * turn)) / 2
        ahead = [p + (turn - 1) / after * (p - q) for p, q in zip(new, old, strict=True)]
        turn = after
    out[kept] = new[0] * scale
    return out, new[1]


def _newton(a: np.ndarray, y: np.ndarray, ridge: np.ndarray, toward: np.ndarray) -> np.ndarray:
    """Logistic regression on a few dense columns, weights drawn to ``toward``."""
    w = toward.copy()
    for _ in range(30):
        p = _sigmoid(a @ w)
        slope = a.T @ (p - y) + ridge * (w - toward)
        curve = (a * (p * (1 - p))[:, None]).T @ a + np.diag(ridge + 1e-6)
        move = np.linalg.solve(curve, slope)
        w = w - np.clip(move, -5, 5)
        if np.abs(move).max() < 1e-8:
            break
    return w


def _loss(z: np.ndarray, y: np.ndarray) -> float:
    return float(np.logaddexp(0, np.where(y > 0, -z, z)).sum())


def _chained(z: np.ndarray, earlier: np.ndarray, y: np.ndarray, fold: np.ndarray):
    """The later linear model over out-of-fold word scores and earlier probabilities:
    (weight of the words, weights of the probabilities, bias), and its own out-of-fold
    logit.  The ridge on the probabilities is the one with the best out-of-fold
    likelihood."""
    a = np.column_stack((z, earlier, np.ones(len(z))))
    toward = np.array([1.0] + [0.0] * (a.shape[1] - 1))
    seen = ~np.isnan(y)

    def fitted(ridge: float, rows: np.ndarray) -> np.ndarray:
        pull = np.array([1.0] + [ridge] * earlier.shape[1] + [0.0])
        return _newton(a[rows], y[rows], pull, toward)

    best = None
    for ridge in RIDGES if earlier.shape[1] else RIDGES[:1]:
        out = np.zeros(len(z))
        for k in range(FOLDS):
            own = fold == k
            out[own] = a[own] @ fitted(ridge, seen & ~own)
        loss = _loss(out[seen], y[seen])
        if best is None or loss < best[0]:
            best = loss, ridge, out
    w = fitted(best[1], seen)
    return float(w[0]), w[1:-1], float(w[-1]), best[2]


class Chain:
    """names; table (feature places x columns, float32): a column for each category, then
    FOLDS for each category but the last, of the models that did not see the fold; links:
    for each category the weights of the earlier categories' probabilities; biases and, for
    each category but the last, fold_biases."""

    def __init__(self, names, table, links, biases, fold_biases):
        self.names, self.table, self.links, self.biases, self.fold_biases = names, table, links, biases, fold_biases

    def finish(self, sums: np.ndarray, fold: np.ndarray) -> np.ndarray:
        """Probabilities from the sums of feature weights (rows x columns) and folds."""
        n = len(self.names)
        p, passed = np.zeros((len(sums), n)), np.zeros((len(sums), n))
        for k, (v, b) in enumerate(zip(self.links, self.biases, strict=True)):
            ahead = passed[:, :k] @ v
            p[:, k] = _sigmoid(sums[:, k] + ahead + b)
            if k + 1 < n:
                own = sums[np.arange(len(sums)), n + k * FOLDS + fold] + self.fold_biases[k][fold]
                passed[:, k] = _sigmoid(own + ahead)
        return p


def fit_chain(x: _Rows, ys: list[np.ndarray], fold: np.ndarray, names: list[str], linked: bool = True) -> Chain:
    """ys: for each category 1, 0 or nan.  linked=False leaves the links at 0."""
    earlier = np.zeros((x.rows, 0))
    table, links, biases = np.zeros((x.size, len(ys) + (len(ys) - 1) * FOLDS), np.float32), [], []
    fold_biases = []
    every = np.ones(x.rows, bool)
    for k, y in enumerate(ys):
        w, b = _words(x, y, every)
        some = y[~np.isnan(y)]
        parts = [(np.zeros(x.size, np.float32), b)] * FOLDS
        if not len(some) or some.min() == some.max():  # one class: its rate
            scale, v, c, z = 1.0, np.zeros(earlier.shape[1]), 0.0, np.full(x.rows, b)
        else:
            parts = [_words(x, y, fold != part) for part in range(FOLDS)]
            z = np.zeros(x.rows)
            for part, (wf, bf) in enumerate(parts):
                own = fold == part
                z[own] = (x.dot(wf) + bf)[own]
            scale, v, c, z = _chained(z, earlier if linked else earlier * 0, y, fold)
        table[:, k] = w * scale
        links.append(v)
        biases.append(b * scale + c)
        if k + 1 < len(ys):
            at = len(ys) + k * FOLDS
            table[:, at : at + FOLDS] = np.stack([wf for wf, _ in parts], 1) * scale
            fold_biases.append(np.array([bf * scale + c for _, bf in parts]))
        earlier = np.column_stack((earlier, _sigmoid(z)))
    return Chain(names, table, links, biases, fold_biases)


def fold_of(text):
    """The fold of a text, so that all copies of it are in one."""
    return F.pmod(F.xxhash64(text, F.lit(5)), F.lit(FOLDS)).cast("int")


def _drawn(labels: DataFrame, columns: list[str], max_rows: int) -> DataFrame:
    """At most ``max_rows`` labelled ids, least hash first: _id, _ord and _y0, _y1, ..."""
    ys = [F.max(F.col(c).cast("int")).alias(f"_y{k}") for k, c in enumerate(columns)]
    known = labels.filter("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("_id")).agg(*ys)
    known = known.withColumn("_ord", F.pmod(F.xxhash64("_id"), F.lit(1 << 30)))
    n = known.count()
    if n > max_rows:  # few more than wanted reach the sort
        known = known.filter(F.col("_ord") < int((1 << 30) * min(1.0, (1.1 * max_rows + 100) / n)))
    return known.orderBy("_ord", "_id").limit(max_rows)


def labelled_features(docs: DataFrame, labels: DataFrame, columns: list[str], max_rows: int) -> DataFrame:
    """A written table: _ord, _id, labels, _fold, n and f (feature places) of each drawn id."""
    ys = [f"_y{k}" for k in range(len(columns))]
    drawn = F.broadcast(_drawn(labels, columns, max_rows))
    text = F.coalesce(F.col("text"), F.lit(""))
    texts = docs.select(F.col("doc_id").cast("long").alias("_id"), text.alias("_text")).join(drawn, "_id")
    # a doc_id with several texts is trained on one of them
    texts = texts.groupBy("_ord", "_id", *ys).agg(F.min_by("_text", F.xxhash64("_text")).alias("_text")).withColumn("_fold", fold_of("_text"))
    own = ["_ord", "_id", *ys, "_fold"]

    def task(batches):
        for batch in batches:
            for rows, found in feature_slices(batch):
                part = batch.slice(rows.start, len(found))
                cells = [pa.array([len(f) for f in found], pa.int32()), pa.array([f.tobytes() for f in found], pa.binary())]
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in own], *cells], names=[*own, "n", "f"])

    sql = "_ord long, _id long, " + "".join(f"{y} int, " for y in ys) + "_fold int, n int, f binary"
    return scratch(texts.select(*own, "_text").mapInArrow(task, sql), "features")


def train(docs: DataFrame, labels: DataFrame, categories=CATEGORIES, max_rows: int = MAX_ROWS, max_entries: int = MAX_ENTRIES, linked: bool = True) -> Chain:
    small_batches(docs.sparkSession)
    columns = list(dict.fromkeys(c for _, c, _ in categories))
    held = labelled_features(docs, labels, columns, max_rows)
    sizes = held.select("_ord", "_id", "n").orderBy("_ord", "_id").collect()
    upto = np.cumsum([r.n for r in sizes], dtype=np.int64)
    rows = int(np.searchsorted(upto, max_entries, side="right"))
    entries = int(upto[rows - 1]) if rows else 0
    place = {r["_id"]: k for k, r in enumerate(sizes[:rows])}
    end = np.concatenate(([0], upto[:rows]))
    at, row = np.zeros(entries, np.int32), np.zeros(entries, np.int32)
    label, fold = np.full((rows, len(columns)), np.nan), np.zeros(rows, np.int64)
    for r in held.filter(F.col("_ord") <= (sizes[rows - 1]["_ord"] if rows else -1)).toLocalIterator():
        if (k := place.get(r["_id"])) is not None:
            at[end[k] : end[k + 1]] = np.frombuffer(r.f, np.int32)
            row[end[k] : end[k + 1]] = k
            label[k] = [np.nan if r[f"_y{c}"] is None else r[f"_y{c}"] for c in range(len(columns))]
            fold[k] = r["_fold"]
    ys = []
    for _, column, value in categories:
        raw = label[:, columns.index(column)]
        ys.append(np.where(np.isnan(raw), np.nan, raw == value))
    return fit_chain(_Rows(at, row, rows, 1 << BITS), ys, fold, [c[0] for c in categories], linked)


def score(docs: DataFrame, chain: Chain, carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns ``carry`` and p_<category> for each category of the chain."""
    small_batches(docs.sparkSession)
    kept = {f"_c{k}": c for k, c in enumerate(carry)}
    rows = docs.select(*[column(c).alias(k) for k, c in kept.items()], F.coalesce(F.col("text"), F.lit("")).alias("_text")).withColumn("_fold", fold_of("_text"))
    held = docs.sparkSession.sparkContext.broadcast(chain)

    def task(batches):
        model = held.value
        for batch in batches:
            for rows, found in feature_slices(batch):
                sums = np.array([model.table[f].sum(axis=0, dtype=np.float64) for f in found])
                same = batch.slice(rows.start, len(found))
                p = model.finish(sums.reshape(len(found), -1), same.column("_fold").to_numpy())
                yield pa.RecordBatch.from_arrays([*[same.column(k) for k in kept], *[pa.array(c) for c in p.T]], names=[*kept, *[f"p{k}" for k in range(len(model.names))]])

    schema = StructType([*rows.select(*kept).schema.fields, *[StructField(f"p{k}", DoubleType()) for k in range(len(chain.names))]])
    out = rows.mapInArrow(task, schema)
    return out.select(*[F.col(k).alias(c) for k, c in kept.items()], *[F.col(f"p{k}").alias(f"p_{n}") for k, n in enumerate(chain.names)])
