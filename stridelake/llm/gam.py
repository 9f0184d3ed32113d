"""Quality classifier: a generalised additive model with pairwise interactions, in lookup tables.

A document is described by counts over its whole text (letters, case, signs, digits, words, repeated words
and lines). Every feature is cut into bins; boosting goes round the features, each time fitting a shallow
tree to one feature's bins, and the trees add up to one table a feature. The strongest pairs of features get
small tables of their own in the same way. A score is a sum of table entries, squeezed to 0..1.

The model is fitted on at most ``max_rows`` labelled documents (``MAX_ROWS`` unless said otherwise; those with the
least hash of their identifier), never on a held-out one; the scores cover all rows and whole texts.

Defined results: a null text is empty, and empty texts get a score as others do; rows that repeat an
identifier get their own scores; a document labelled more than once counts with its mean label, null labels
don't count; without labels of both kinds all scores are the smoothed share of good labels; empty
tables give no rows; further columns are never read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bytewords import Spans, joined, mix, returning, text_slices, words
from .shared import Workspace

MAX_ROWS = 20_000
KEEP_FROM = 0.3

# Byte classes: each counts once a byte.
_KINDS = {
    "upper": list(range(65, 91)),
    "lower": list(range(97, 123)),
    "digit": list(range(48, 58)),
    "stop": [ord(c) for c in ".?"],
    "comma": [ord(c) for c in ",;:"],
    "bang": [ord("!")],
    "bar": [ord("|")],
    "sign": [ord(c) for c in "#$%&*@^_~+=<>{}[]\\/"],
    "quote": [ord(c) for c in "\"'()-`"],
    "line": [10],
    "lead": list(range(192, 256)),  # a non-ASCII character
}
_KIND_OF = np.full(256, len(_KINDS), np.uint8)
for _k, _bytes in enumerate(_KINDS.values()):
    _KIND_OF[_bytes] = _k
FEATURES = [*_KINDS, "log_words", "word_length", "distinct_words", "capital_words", "sign_ends", "distinct_lines", "distinct_pairs"]


def _distinct(owner: np.ndarray, hashes: np.ndarray, n: int) -> np.ndarray:
    """Number of distinct hashes of each owner."""
    _, first = np.unique(mix(hashes + owner.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)), return_index=True)
    return np.bincount(owner[first], minlength=n)


def features(texts: list[bytes]) -> np.ndarray:
    """One row a text, columns as in FEATURES: shares of bytes or words, so that lengths don't matter but for one column."""
    n = len(texts)
    data, starts = joined(texts)
    size = np.maximum(np.diff(starts) - 1, 1).astype(float)
    kind = _KIND_OF[data]
    owner = np.repeat(np.arange(n), np.diff(starts))
    counts = np.bincount(owner * 16 + kind, minlength=16 * n).reshape(n, 16)[:, : len(_KINDS)].astype(float)
    counts[:, list(_KINDS).index("line")] -= 1  # the one that joined() adds
    begin, end = words(data)
    of = owner[begin]
    n_words = np.bincount(of, minlength=n)
    some = np.maximum(n_words, 1).astype(float)
    spans = Spans(data)
    hashes = spans.hash(begin, end)
    last = kind[end - 1]
    marks = [list(_KINDS).index(x) for x in ("bang", "bar", "sign", "quote")]
    together = of[1:] == of[:-1]
    pairs = _distinct(of[1:][together], mix(hashes[1:] * np.uint64(3) + hashes[:-1])[together], n)
    feed = np.flatnonzero(data == 10)
    line_begin = np.concatenate(([0], feed[:-1] + 1))
    of_line = owner[line_begin] if len(line_begin) else line_begin
    return np.column_stack([
        counts / size[:, None],
        np.log1p(n_words),
        np.bincount(of, weights=(end - begin), minlength=n) / some,
        _distinct(of, hashes, n) / some,
        np.bincount(of, weights=kind[begin] == 0, minlength=n) / some,
        np.bincount(of, weights=np.isin(last, marks), minlength=n) / some,
        _distinct(of_line, spans.hash(line_begin, feed), n) / np.maximum(np.bincount(of_line, minlength=n), 1),
        (pairs + 1) / np.maximum(n_words, 1),
    ])


def _best_cut(g: np.ndarray, h: np.ndarray, ridge: float) -> tuple[float, int]:
    """Gain and place of the best split of ordered bins with gradients g and curvatures h."""
    gl, hl = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
    total_g, total_h = g.sum(), h.sum()
    gain = gl**2 / (hl + ridge) + (total_g - gl) ** 2 / (total_h - hl + ridge) - total_g**2 / (total_h + ridge)
    if not len(gain):
        return 0.0, 0
    k = int(np.argmax(gain))
    return float(gain[k]), k + 1


def _tree(g: np.ndarray, h: np.ndarray, depth: int, ridge: float) -> np.ndarray:
    """A shallow regression tree over ordered bins, as one value a bin."""
    if depth == 0 or len(g) < 2:
        return np.full(len(g), g.sum() / (h.sum() + ridge))
    gain, k = _best_cut(g, h, ridge)
    if gain <= 1e-9:
        return np.full(len(g), g.sum() / (h.sum() + ridge))
    return np.concatenate((_tree(g[:k], h[:k], depth - 1, ridge), _tree(g[k:], h[k:], depth - 1, ridge)))


def _pair_tree(g: np.ndarray, h: np.ndarray, ridge: float) -> tuple[float, np.ndarray]:
    """One split on the first feature and one on the second within each half: gain and values."""
    best, out = -1.0, np.full(g.shape, g.sum() / (h.sum() + ridge))
    for k in range(1, len(g)):
        halves = [(g[:k].sum(0), h[:k].sum(0)), (g[k:].sum(0), h[k:].sum(0))]
        gain = sum(_best_cut(a, b, ridge)[0] + a.sum() ** 2 / (b.sum() + ridge) for a, b in halves)
        if gain > best:
            best = gain
            rows = [_tree(a, b, 1, ridge) for a, b in halves]
            out = np.vstack([np.tile(rows[0], (k, 1)), np.tile(rows[1], (len(g) - k, 1))])
    return best, out


@dataclass
class AdditiveModel:
    """``score`` is a sum of looked-up bins: edges and one table a feature, and tables of coarse bins for pairs."""

    bias: float
    edges: list[np.ndarray]
    tables: list[np.ndarray]
    pairs: list[tuple[int, int, np.ndarray]]
    coarse: int = 8

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.column_stack([np.searchsorted(e, x[:, j], side="right") for j, e in enumerate(self.edges)]) if len(x) else np.zeros((0, len(self.edges)), int)

    def _coarse(self, b: np.ndarray, j: int) -> np.ndarray:
        return b[:, j] * self.coarse // (len(self.edges[j]) + 1)

    def margin(self, b: np.ndarray) -> np.ndarray:
        total = np.full(len(b), self.bias)
        for j, table in enumerate(self.tables):
            total += table[b[:, j]]
        for i, j, table in self.pairs:
            total += table[self._coarse(b, i), self._coarse(b, j)]
        return total

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margin(self.bins(x)), -30, 30)))


def fit(x: np.ndarray, y: np.ndarray, rounds: int = 60, pair_rounds: int = 30, n_pairs: int = 8, n_bins: int = 48, depth: int = 2, rate: float = 0.15, ridge: float = 2.0) -> AdditiveModel:
    """Cyclic boosting of the log loss, Newton steps. ``y`` in 0..1."""
    share = (y.sum() + 1) / (len(y) + 2)
    model = AdditiveModel(float(np.log(share / (1 - share))), [np.zeros(0)] * x.shape[1], [np.zeros(1)] * x.shape[1], [])
    if len(y) == 0 or y.min() == y.max():
        return model
    levels = np.linspace(0, 1, n_bins)[1:-1]
    for j in range(x.shape[1]):
        cuts = np.concatenate([np.quantile(part, levels[::2] if k else levels) for k, part in enumerate((x[:, j], x[y < 0.5, j], x[y >= 0.5, j])) if len(part)])
        values = np.unique(cuts)
        model.edges[j] = (values[1:] + values[:-1]) / 2 if len(values) > 1 else values
        model.tables[j] = np.zeros(len(model.edges[j]) + 1)
    b = model.bins(x)
    total = model.margin(b)

    def slopes() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-total))
        return y - p, np.maximum(p * (1 - p), 1e-6)

    for _ in range(rounds):
        for j, table in enumerate(model.tables):
            g, h = slopes()
            step = rate * _tree(np.bincount(b[:, j], g, len(table)), np.bincount(b[:, j], h, len(table)), depth, ridge)
            table += step
            total += step[b[:, j]]
    c, k = np.column_stack([model._coarse(b, j) for j in range(x.shape[1])]), model.coarse

    def grid(i: int, j: int, v: np.ndarray) -> np.ndarray:
        return np.bincount(c[:, i] * k + c[:, j], v, k * k).reshape(k, k)

    g, h = slopes()
    gains = sorted(((_pair_tree(grid(i, j, g), grid(i, j, h), ridge)[0], i, j) for i in range(x.shape[1]) for j in range(i)), reverse=True)
    model.pairs = [(i, j, np.zeros((k, k))) for _, i, j in gains[:n_pairs]]
    for _ in range(pair_rounds):
        for i, j, table in model.pairs:
            g, h = slopes()
            step = rate * _pair_tree(grid(i, j, g), grid(i, j, h), ridge)[1]
            table += step
            total += step[c[:, i], c[:, j]]
    return model


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def train(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", max_rows: int = MAX_ROWS, **options) -> AdditiveModel:
    """Fit on at most ``max_rows`` labelled rows that aren't held out; the driver gets their features, never texts."""
    known = labels.where(F.col(label_col).isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg(F.avg(F.col(label_col)).alias("_label")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)
    docs = df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("_text"))
    rows = docs.join(F.broadcast(known), "doc_id").select("doc_id", "_label", "_text")

    def describe(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in returning(stream):
            for part, texts in text_slices(batch, batch.column(2)):
                x = features(texts)
                wide = pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), x.shape[1]).cast(pa.list_(pa.float64()))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), wide], names=["doc_id", "label", "x"])

    # One row an identifier, however many documents repeat it: the driver gets at most ``max_rows``.
    described = rows.mapInArrow(describe, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, label double, x array<double>")
    got = described.groupBy("doc_id").agg(F.min("label").alias("label"), F.min("x").alias("x")).toPandas()
    x = np.array(got["x"].tolist(), float).reshape(len(got), len(FEATURES))
    order = np.lexsort(x.T) if len(x) else slice(None)  # the same model whatever the order of rows
    return fit(x[order], got["label"].to_numpy(float)[order], **options)


def scored(df: DataFrame, model: AdditiveModel, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """``df`` with a score column; no shuffle."""
    wide = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("_row"))
    schema = T.StructType([wide.schema[0], T.StructField("_score", T.DoubleType())])
    place = df.columns.index(text_col)

    def score(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in returning(stream):
            for part, texts in text_slices(batch, batch.column(0).field(place)):
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(model.score(features(texts)))], names=["_row", "_score"])

    out = wide.mapInArrow(score, schema)
    return out.select("_row.*", F.col("_score").alias(score_col)) if score_col not in df.columns else out.select(*[F.col("_row")[c].alias(c) for c in df.columns if c != score_col], F.col("_score").alias(score_col))


def classify(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep_from: float = KEEP_FROM, **options) -> DataFrame:
    """doc_id, held_out, score, predicted of every row."""
    model = train(df, labels, id_col, text_col, **options)
    narrow = df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    out = scored(narrow, model, "text").select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= keep_from).cast("int").alias("predicted"))
    return Workspace(df.sparkSession, "classifier").finish(out)


def keep_good(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep_from: float = KEEP_FROM, **options) -> DataFrame:
    """The rows of ``df`` that score at least ``keep_from``, with all columns."""
    return scored(df, train(df, labels, id_col, text_col, **options), text_col, "_quality_score").where(F.col("_quality_score") >= keep_from).drop("_quality_score")
