"""Quality classifier by co-training on text content and page metadata.

Two classifiers see different things of a document. The content view has its words and word
shapes as hashed shares; the metadata view has source, language, size and the page's layout
(lines, and shares of capitals, digits, symbols and spaces). A view's score is linear: a logistic
model of labelled documents, together with the log odds of its features between the classes.

In each round every unlabelled document is scored by both views. Whatever either is sure of it
hands to the other as a pseudo-label, by adding the document's features to the other's counts of
that class; these counts are sums over all documents, worked out by the tasks that score them,
and weigh as much as the labels' however many documents there are. After each round the views are
calibrated on labelled documents that were held back. At last a logistic blend of the calibrated
views scores all documents.

The only sample is that of ``most_labelled`` labelled documents, chosen by a hash of the id. The
driver holds their features and the counts, whose size is fixed. Every round and the scoring read
all documents, whole.

Defined cases: null text is empty and is scored by its metadata; null or new sources and
languages are categories of their own; labels that are null or of no document don't count,
repeated ones are averaged (ties count as good); with labels of a single class or none, every
score is the labels' share of good (one half without labels) and kept is true unless that share is
below the threshold; rows that repeat a sampled id are one labelled document, that of the smallest
hash of the text; otherwise rows that repeat an id are scored one by one.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from repliphase.llm import byte_words as bw

_U = np.uint64
_WORD_BITS, _NAMES = 16, 1024
_SHAPE = np.full(256, ord("a"), np.uint8)
for _c in range(128):
    _SHAPE[_c] = ord("A") if 65 <= _c < 91 else ord("a") if 97 <= _c < 123 else ord("0") if 48 <= _c < 58 else _c
_COUNTED = [np.isin(np.arange(256), list(x)) for x in (range(65, 91), range(48, 58), b"#*$%&|<>", b".,;:!?", b" \t", range(128, 256))]


def _content(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(row, features, shares) of the content view; the shares of a row's words sum to 1, and so do its shapes'."""
    for first, raw, at in bw.chunks(column):
        starts, ends, before = bw.word_spans(raw, at)
        words = (bw.word_hashes(raw, starts, ends) >> _U(64 - _WORD_BITS)).astype(np.int64)
        shapes = (bw.word_hashes(_SHAPE[raw], starts, ends, lower=False) >> _U(64 - _WORD_BITS)).astype(np.int64) + (1 << _WORD_BITS)
        for k in range(len(at) - 1):
            a, b = before[k], before[k + 1]
            found, times = np.unique(np.concatenate([words[a:b], shapes[a:b]]), return_counts=True)
            yield first + k, found, times / max(1, b - a)


def _content_scores(column: pa.Array, weights: np.ndarray) -> np.ndarray:
    """The linear scores of the content view, without making the features of each row."""
    out = np.zeros(len(column))
    for first, raw, at in bw.chunks(column):
        starts, ends, before = bw.word_spans(raw, at)
        words = (bw.word_hashes(raw, starts, ends) >> _U(64 - _WORD_BITS)).astype(np.int64)
        shapes = (bw.word_hashes(_SHAPE[raw], starts, ends, lower=False) >> _U(64 - _WORD_BITS)).astype(np.int64) + (1 << _WORD_BITS)
        sums = np.concatenate([[0.0], np.cumsum(weights[words] + weights[shapes])])
        out[first : first + len(at) - 1] = (sums[before[1:]] - sums[before[:-1]]) / np.maximum(1, before[1:] - before[:-1])
    return out


def _name(value: str | None, kind: int) -> int:
    raw = np.frombuffer(f"{kind}{value if value is not None else chr(0)}".encode(), np.uint8)
    return int(bw.word_hashes(raw, np.array([0]), np.array([len(raw)]), lower=False)[0] % _U(_NAMES))


def _metadata(sources: list, langs: list, column: pa.Array) -> np.ndarray:
    """Rows of the metadata view: the categories' numbers, then measures of size and layout."""
    out = np.zeros((len(column), 2 + 12))
    known: dict = {}
    for k, (s, lang) in enumerate(zip(sources, langs)):
        for kind, value in ((0, s), (1, lang)):
            if (kind, value) not in known:
                known[kind, value] = _name(value, kind)
            out[k, kind] = known[kind, value]
    for first, raw, at in bw.chunks(column):
        for k in range(len(at) - 1):
            counts = np.bincount(raw[at[k] : at[k + 1]], minlength=256)
            n = max(1, int(counts.sum()))
            lines = int(counts[10]) + 1
            shares = [counts[x].sum() / n for x in _COUNTED]
            size, line = np.log1p(n), np.log1p(n / lines)
            out[first + k, 2:] = [size, size * size / 10, line, line * line / 10, np.log1p(lines), *shares, np.sqrt(shares[2])]
    return out


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class _Rows:
    """Sparse rows for fitting; entry k belongs to row ``row[k]``."""

    def __init__(self, row: np.ndarray, column: np.ndarray, value: np.ndarray, size: int, width: int):
        self.row, self.column, self.value, self.size, self.width = row, column, value, size, width

    def times(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, self.value * w[self.column], self.size)

    def gradient(self, error: np.ndarray) -> np.ndarray:
        return np.bincount(self.column, self.value * error[self.row], self.width)

    def take(self, rows: np.ndarray) -> _Rows:
        place = np.full(self.size, -1)
        place[rows] = np.arange(len(rows))
        keep = place[self.row] >= 0
        return _Rows(place[self.row[keep]], self.column[keep], self.value[keep], len(rows), self.width)


def _fit(x: _Rows, y: np.ndarray, weight: np.ndarray, ridge: float, steps: int = 150) -> tuple[np.ndarray, float]:
    """Logistic regression by accelerated gradient steps, each feature scaled by its own size."""
    scale = 1 / np.sqrt(np.bincount(x.column, x.value**2 * weight[x.row], x.width) / max(1e-9, weight.sum()) + ridge)
    w, v = np.zeros(x.width), np.zeros(x.width)
    bias, vb = 0.0, 0.0
    rate = 4.0 / max(1.0, float(np.mean(np.bincount(x.row, (x.value * scale[x.column]) ** 2, x.size))) + 1)
    for step in range(steps):
        error = (y - _sigmoid(x.times((w + 0.9 * v) * scale) + bias + 0.9 * vb)) * weight / weight.sum()
        v = 0.9 * v + rate * (x.gradient(error) * scale - ridge * 1e-2 * w)
        vb = 0.9 * vb + rate * error.sum()
        w, bias = w + v, bias + vb
    return w * scale, bias


def _platt(scores: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Logistic weights of one or more score columns and a constant; prior pseudo-rows keep them finite."""
    x = np.column_stack([scores, np.ones(len(y))])
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = _sigmoid(x @ w)
        hessian = x.T @ (x * (p * (1 - p))[:, None]) + 1e-2 * np.eye(len(w))
        w = w + np.clip(np.linalg.solve(hessian, x.T @ (y - p) - 1e-2 * w), -3, 3)
    return w


#: The numbers of the metadata view after its two categories, the bins that each has, and where these begin.
_NUMBERS, _BINS = 12, 16
_META = 2 * _NAMES + _NUMBERS * _BINS
_TEXT = 2 << _WORD_BITS
#: A pseudo-count for each feature, as a share of a document, and the unit of shares in sums, which are exact that way.
_ALPHA, _UNIT = 0.01, 1 << 32
_PARTS = 64


@dataclass
class Views:
    """Both views as linear scores that are calibrated log odds of good quality."""

    text: np.ndarray
    text_shift: float
    meta: np.ndarray
    numbers: np.ndarray
    meta_shift: float
    center: np.ndarray
    spread: np.ndarray
    edges: list[np.ndarray]

    def meta_scores(self, metadata: np.ndarray) -> np.ndarray:
        return self.meta[_categories(metadata, self.edges)].sum(1) + (metadata[:, 2:] - self.center) / self.spread @ self.numbers + self.meta_shift

    def text_scores(self, column: pa.Array) -> np.ndarray:
        return _content_scores(column, self.text) + self.text_shift


@dataclass
class CoTrained:
    """The views after the last round, their blend, and how many labels each was handed (content, metadata) by round."""

    views: Views
    blend: np.ndarray
    rounds: list[tuple[int, int]]

    def scores(self, text: np.ndarray, meta: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Calibrated content, metadata and blended probabilities of good quality."""
        return _sigmoid(text), _sigmoid(meta), _sigmoid(self.blend[0] * text + self.blend[1] * meta + self.blend[2])


def _categories(metadata: np.ndarray, edges: list[np.ndarray]) -> np.ndarray:
    """The metadata view's features by number: source, language, and the bin of each measure."""
    binned = [2 * _NAMES + _BINS * k + np.searchsorted(e, metadata[:, k + 2], "right") for k, e in enumerate(edges)]
    return np.column_stack([metadata[:, 0], _NAMES + metadata[:, 1], *binned]).astype(np.int64)


def _meta_rows(metadata: np.ndarray, center: np.ndarray, spread: np.ndarray) -> _Rows:
    n = len(metadata)
    values = np.column_stack([np.ones((n, 2)), (metadata[:, 2:] - center) / spread])
    columns = np.column_stack([metadata[:, 0], _NAMES + metadata[:, 1], np.tile(2 * _NAMES + np.arange(_NUMBERS), (n, 1))]).astype(np.int64)
    return _Rows(np.repeat(np.arange(n), _NUMBERS + 2), columns.ravel(), values.ravel(), n, 2 * _NAMES + _NUMBERS)


def _odds(labelled: np.ndarray, given: np.ndarray) -> np.ndarray:
    """Log odds of each feature between good (row 1) and bad, pseudo-labels together weighing as much as labels."""
    logs = []
    for own, more in zip(labelled, given):
        mass = own + more * (own.sum() / more.sum() if more.sum() else 0.0) + _ALPHA
        logs.append(np.log(mass / mass.sum()))
    return logs[1] - logs[0]


class Trainer:
    """The labelled sample's features, with which the views are fitted anew after each round's counts."""

    def __init__(self, text: _Rows, metadata: np.ndarray, y: np.ndarray, hold: np.ndarray):
        self.text, self.metadata, self.y = text, metadata, y
        learn = np.flatnonzero(~hold)
        self.held = np.flatnonzero(hold)
        if len(self.held) < 20 or len(np.unique(y[self.held])) < 2:
            self.held = np.arange(len(y))
        if len(np.unique(y[learn])) < 2:
            learn = np.arange(len(y))
        self.center, self.spread = metadata[learn, 2:].mean(0), metadata[learn, 2:].std(0) + 1e-6
        self.edges = [np.unique(np.quantile(metadata[learn, k + 2], np.linspace(0, 1, _BINS + 1)[1:-1])) for k in range(_NUMBERS)]
        self.plain = _meta_rows(metadata, self.center, self.spread)
        cats = _categories(metadata, self.edges)
        self.cats = _Rows(np.repeat(np.arange(len(y)), cats.shape[1]), cats.ravel(), np.ones(cats.size), len(y), _META)
        self.models = [_fit(x.take(learn), y[learn], np.ones(len(learn)), 1e-3) for x in (text, self.plain)]
        self.labelled = [np.stack([np.bincount(p.column, p.value * (y[learn][p.row] == k), p.width) for k in (0, 1)]) for p in (text.take(learn), self.cats.take(learn))]

    def fit(self, given: tuple[np.ndarray, np.ndarray]) -> tuple[Views, np.ndarray]:
        """The views with the features that each was handed so far, and their scores of the sample."""
        fitted, scores = [], []
        for (w, bias), x, own, counted, more in zip(self.models, (self.text, self.plain), (self.text, self.cats), self.labelled, given):
            odds = _odds(counted, more)
            both = np.column_stack([x.times(w) + bias, own.times(odds)])
            a, b, c = _platt(both[self.held], self.y[self.held])
            fitted.append((a * w, b * odds, a * bias + c))
            scores.append(both @ [a, b] + c)
        (tw, to, ts), (mw, mo, ms) = fitted
        meta = mo.copy()
        meta[: 2 * _NAMES] += mw[: 2 * _NAMES]
        return Views(tw + to, ts, meta, mw[2 * _NAMES :], ms, self.center, self.spread, self.edges), np.column_stack(scores)


def _handed(sent, known: np.ndarray, sure: float):
    """Rows (doc_id, source, lang, text) to rows (part, counts): the features that the surer view hands to the other, summed.

    Parts of 0 and up are ranges of the content view's counts, both classes; part -1 has the
    metadata view's counts and the numbers of documents handed to either.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        views: Views = sent.value
        limit = np.log(sure / (1 - sure))
        text, meta, numbers = np.zeros((2, _TEXT), np.int64), np.zeros((2, _META), np.int64), np.zeros(2, np.int64)
        for batch in batches:
            ids = batch.column(0)
            free = ~np.isin(ids.fill_null(0).to_numpy(zero_copy_only=False), known) | ids.is_null().to_numpy(zero_copy_only=False)
            metadata = _metadata(batch.column(1).to_pylist(), batch.column(2).to_pylist(), batch.column(3))
            cats = _categories(metadata, views.edges)
            by_meta, by_text = views.meta_scores(metadata), views.text_scores(batch.column(3))
            for k, (m, t) in enumerate(((by_meta <= -limit, by_text <= -limit), (by_meta >= limit, by_text >= limit))):
                meta[k] += np.bincount(cats[free & t].ravel(), minlength=_META)
                _add_shares(text[k], batch.column(3), free & m)
                numbers += [(free & m).sum(), (free & t).sum()]
        step = _TEXT // _PARTS
        rows = [(k, text[:, k * step : (k + 1) * step]) for k in range(_PARTS)]
        rows = [(k, _words(x)) for k, x in rows if x.any()] + [(-1, np.concatenate([meta.ravel(), numbers]))]
        yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in rows], pa.int32()), pa.array([zlib.compress(x.tobytes(), 1) for _, x in rows], pa.binary())], names=["part", "counts"])

    return work


def _words(sums: np.ndarray) -> np.ndarray:
    """Sums in units as whole documents and units beside them, which can be added up over any number of tasks."""
    return np.stack([sums // _UNIT, sums % _UNIT])


def _shares(words: np.ndarray) -> np.ndarray:
    """Documents, with fractions, from ``_words`` added up."""
    whole, units = words.reshape(2, -1)
    return whole + units / _UNIT


def _add_shares(total: np.ndarray, column: pa.Array, chosen: np.ndarray) -> None:
    """Adds the content view's shares of the chosen rows to ``total``, in whole units."""
    for first, raw, at in bw.chunks(column):
        rows = np.flatnonzero(chosen[first : first + len(at) - 1])
        if not len(rows):
            continue
        starts, ends, before = bw.word_spans(raw, at)
        n = before[rows + 1] - before[rows]
        pick = np.repeat(before[rows] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
        share = np.repeat(_UNIT // np.maximum(n, 1), n)
        for source, lower, shift in ((raw, True, 0), (_SHAPE[raw], False, 1 << _WORD_BITS)):
            cells = (bw.word_hashes(source, starts[pick], ends[pick], lower=lower) >> _U(64 - _WORD_BITS)).astype(np.int64) + shift
            found, back = np.unique(cells, return_inverse=True)
            sums = np.zeros(len(found), np.int64)
            np.add.at(sums, back, share)
            total[found] += sums


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per part that reaches this task."""
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        for part, counts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            more = np.frombuffer(zlib.decompress(counts), np.int64)
            sums[part] = sums[part] + more if part in sums else more
    for part, total in sums.items():
        yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([zlib.compress(total.tobytes(), 1)], pa.binary())], names=["part", "counts"])


def _exchange(docs: DataFrame, views: Views, known: np.ndarray, sure: float) -> tuple[tuple[np.ndarray, np.ndarray], tuple[int, int]]:
    """What one round hands to the content and to the metadata view: counts by class, and how many documents."""
    sent = docs.sparkSession.sparkContext.broadcast(views)
    rows = docs.mapInArrow(_handed(sent, known, sure), "part int, counts binary").repartition(_PARTS + 1, "part").mapInArrow(_summed, "part int, counts binary")
    text, meta, numbers, step = np.zeros((2, _TEXT)), np.zeros((2, _META)), (0, 0), _TEXT // _PARTS
    for r in rows.collect():  # at most a row per part
        found = np.frombuffer(zlib.decompress(r.counts), np.int64)
        if r.part < 0:
            meta, numbers = found[:-2].reshape(2, -1).astype(float), tuple(found[-2:].tolist())
        else:
            text[:, r.part * step : (r.part + 1) * step] = _shares(found).reshape(2, -1)
    sent.destroy()
    return (text, meta), numbers


def _sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (doc_id, source, lang, text, y) to rows (doc_id, y, features, shares, metadata)."""
    for batch in batches:
        features, shares = [None] * len(batch), [None] * len(batch)
        for row, f, v in _content(batch.column(3)):
            features[row], shares[row] = f, v
        meta = _metadata(batch.column(1).to_pylist(), batch.column(2).to_pylist(), batch.column(3))
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(4), pa.array(features, pa.list_(pa.int64())), pa.array(shares, pa.list_(pa.float64())), pa.array(list(meta), pa.list_(pa.float64()))],
            names=["doc_id", "y", "features", "shares", "metadata"],
        )


def _plain(docs: DataFrame, id_col: str) -> DataFrame:
    return docs.select(F.col(id_col).alias("doc_id"), F.col("source").cast("string").alias("source"), F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", label_col: str = "quality", *, most_labelled: int = 6000, rounds: int = 3, sure: float = 0.9) -> CoTrained | float:
    """Co-trains both views; the share of good labels instead if they are of one class (one half if there are none).

    ``sure`` is the calibrated probability from which a view hands a label on.
    """
    base = _plain(docs, id_col).withColumn("doc_id", F.col("doc_id").cast("long"))
    named = labels.where(F.col(label_col).isNotNull() & F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg((F.avg(label_col) >= 0.5).cast("double").alias("y"))
    chosen = named.join(base.select("doc_id"), "doc_id", "left_semi").orderBy(F.xxhash64("doc_id"), "doc_id").limit(most_labelled)
    rows = base.join(F.broadcast(chosen), "doc_id")  # at most most_labelled ids
    rows = rows.groupBy("doc_id", "y").agg(F.min(F.struct(F.xxhash64("text").alias("h"), "source", "lang", "text")).alias("d")).select("doc_id", "d.source", "d.lang", "d.text", "y")
    found = rows.mapInArrow(_sampled, "doc_id long, y double, features array<long>, shares array<double>, metadata array<double>").toArrow().sort_by([("doc_id", "ascending")])
    y, ids = found["y"].to_numpy(), found["doc_id"].to_numpy()
    if len(np.unique(y)) < 2:
        return float(y.mean()) if len(y) else 0.5
    lists = found["features"].combine_chunks()
    text = _Rows(np.repeat(np.arange(len(y)), lists.value_lengths().to_numpy()), lists.flatten().to_numpy(), found["shares"].combine_chunks().flatten().to_numpy(), len(y), _TEXT)
    trainer = Trainer(text, np.array(found["metadata"].to_pylist()), y, bw.mix(ids.view(_U)) % _U(5) == 0)
    given, log = (np.zeros((2, _TEXT)), np.zeros((2, _META))), []
    for _ in range(rounds):
        given, numbers = _exchange(base, trainer.fit(given)[0], ids, sure)
        log.append(numbers)
    views, scores = trainer.fit(given)
    return CoTrained(views, _platt(scores[trainer.held], y[trainer.held]), log)


def score(docs: DataFrame, model: CoTrained | float, id_col: str = "doc_id", *, threshold: float = 0.5) -> DataFrame:
    """Rows (doc_id, score, text_score, meta_score, kept), one per document."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = sent.value
        for batch in batches:
            if isinstance(made, float):
                found = (np.full(len(batch), made),) * 3
            else:
                meta = _metadata(batch.column(1).to_pylist(), batch.column(2).to_pylist(), batch.column(3))
                found = made.scores(made.views.text_scores(batch.column(3)), made.views.meta_scores(meta))
            yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, (found[2], found[0], found[1], found[2] >= threshold))], names=["doc_id", "score", "text_score", "meta_score", "kept"])

    rows = _plain(docs, id_col)
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(work, f"doc_id {kind}, score double, text_score double, meta_score double, kept boolean")
