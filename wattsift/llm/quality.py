"""Quality classifier: histogram gradient-boosted trees over document statistics.

Statistics of a whole text are one vector of numbers. Trees are grown level by level on
features that were binned once by quantiles, from histograms of gradients and second
derivatives of the logistic loss. A model is flattened into arrays, so that scoring walks all
rows of a batch down all trees at once.

The model is fitted on a bounded sample of the labelled rows: those with the smallest hashes of
their ids, at most `sample` of them. Everything is scored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wattsift.llm.tables import forget, slices, texts

SAMPLE = 20_000
THRESHOLD = 0.7
FEATURES = [
    "words", "chars", "mean_word", "longest_word", "distinct_words", "top_word", "upper", "title_words", "digits",
    "spaces", "letters", "wide", "symbols", "exclamations", "questions", "bars", "rare_symbols", "commas", "periods",
    "symbol_ends", "shouted_words", "lines", "line_chars", "repeated_lines", "short_lines", "period_lines", "bullet_lines",
    "repeated_pairs", "entropy",
]
_SYMBOL_END = re.compile(r"[^\w\s.,;:!?'\"()-](?=\s|$)")
_SHOUTED = re.compile(r"\b[^\W\d_a-z]{2,}\b")


def statistics(text: str) -> list[float]:
    """The document statistics, in the order of FEATURES. An empty text has zeros."""
    n = len(text)
    words = text.split()
    if not words:
        return [0.0, float(n)] + [0.0] * (len(FEATURES) - 2)
    w = len(words)
    counts = Counter(words)
    raw = np.frombuffer(text.encode(), np.uint8)
    h = np.bincount(raw, minlength=256)
    upper, lower, digits = h[65:91].sum(), h[97:123].sum(), h[48:58].sum()
    wide = h[192:].sum()
    spaces = h[9:14].sum() + h[32]
    symbols = n - upper - lower - digits - wide - spaces
    lines = [x for x in text.split("\n") if x.strip()]
    pairs = set(zip(words, words[1:]))
    p = np.fromiter(counts.values(), float) / w
    return [
        float(w), float(n), n / w, float(max(map(len, words))), len(counts) / w, max(counts.values()) / w, upper / n,
        sum(map(str.istitle, words)) / w, digits / n, spaces / n, (upper + lower + wide) / n, wide / n, symbols / n,
        h[33] / w, h[63] / w, h[124] / w, (h[35] + h[36] + h[37] + h[38] + h[42] + h[64] + h[94]) / w, h[44] / w,
        h[46] / w, len(_SYMBOL_END.findall(text)) / w, len(_SHOUTED.findall(text)) / w, float(len(lines)),
        n / len(lines), 1 - len(set(lines)) / len(lines), sum(len(x) < 30 for x in lines) / len(lines),
        sum(x.rstrip()[-1] in ".!?" for x in lines) / len(lines),
        sum(x.lstrip()[0] in "-*•|#" for x in lines) / len(lines), 1 - len(pairs) / max(1, w - 1),
        float(-(p * np.log(p)).sum()) / max(1.0, float(np.log(w))),
    ]


@dataclass(frozen=True)
class BoostParams:
    trees: int = 120
    depth: int = 4
    rate: float = 0.1
    bins: int = 64
    l2: float = 1.0
    min_rows: int = 10
    min_gain: float = 1e-6


@dataclass(frozen=True)
class Trees:
    """Complete binary trees, one row each: feature -1 goes left always; leaves below."""

    base: float
    feature: np.ndarray
    threshold: np.ndarray
    leaf: np.ndarray

    def margin(self, x: np.ndarray) -> np.ndarray:
        n, trees = len(x), len(self.feature)
        out = np.full(n, self.base)
        if not trees:
            return out
        depth = (self.feature.shape[1] + 1).bit_length() - 1
        at = np.zeros((n, trees), np.int64)
        rows, tree = np.arange(n)[:, None], np.arange(trees)[None, :]
        for _ in range(depth):
            f = self.feature[tree, at]
            right = (f >= 0) & (x[rows, np.maximum(f, 0)] > self.threshold[tree, at])
            at = 2 * at + 1 + right
        return out + self.leaf[tree, at - self.feature.shape[1]].sum(axis=1)

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margin(x), -30, 30)))


def fit_trees(x: np.ndarray, y: np.ndarray, params: BoostParams = BoostParams()) -> Trees:
    """Boost on a sample in memory. One class only, or no rows, gives a constant score."""
    inner = 2**params.depth - 1
    none = np.zeros((0, inner), np.int64), np.zeros((0, inner)), np.zeros((0, inner + 1))
    rate = np.clip(y.mean(), 1e-4, 1 - 1e-4) if len(y) else 0.5
    base = float(np.log(rate / (1 - rate)))
    if len(y) < 2 * params.min_rows or len(np.unique(y)) < 2:
        return Trees(base, *none)
    n, d = x.shape
    cuts = [np.unique(np.quantile(x[:, k], np.linspace(0, 1, params.bins + 1)[1:-1])) for k in range(d)]
    binned = np.column_stack([np.searchsorted(c, x[:, k], side="left") for k, c in enumerate(cuts)])
    flat = binned + np.arange(d) * params.bins
    margin = np.full(n, base)
    features, thresholds, leaves = [], [], []
    for _ in range(params.trees):
        p = 1 / (1 + np.exp(-margin))
        g, h = y - p, p * (1 - p)
        at = np.zeros(n, np.int64)
        feature, threshold = np.full(inner, -1), np.zeros(inner)
        for level in range(params.depth):
            first, width = 2**level - 1, 2**level
            key = ((at - first)[:, None] * (d * params.bins) + flat).ravel()
            size = width * d * params.bins
            hist = [np.bincount(key, np.repeat(v, d), size).reshape(width, d, params.bins).cumsum(axis=2)
                    for v in (g, h, np.ones(n))]
            (gl, hl, nl), (gt, ht, nt) = hist, [v[:, :, -1:] for v in hist]
            gain = gl**2 / (hl + params.l2) + (gt - gl) ** 2 / (ht - hl + params.l2) - gt**2 / (ht + params.l2)
            gain[(nl < params.min_rows) | (nt - nl < params.min_rows)] = -np.inf
            best = gain.reshape(width, -1).argmax(axis=1)
            for node in range(width):
                k, b = divmod(int(best[node]), params.bins)
                if gain[node, k, b] > params.min_gain and b < len(cuts[k]):
                    feature[first + node], threshold[first + node] = k, cuts[k][b]
            f = feature[at]
            at = 2 * at + 1 + ((f >= 0) & (x[np.arange(n), np.maximum(f, 0)] > threshold[at]))
        slot = at - inner
        leaf = params.rate * np.bincount(slot, g, inner + 1) / (np.bincount(slot, h, inner + 1) + params.l2)
        margin += leaf[slot]
        features.append(feature), thresholds.append(threshold), leaves.append(leaf)
    return Trees(base, np.array(features), np.array(thresholds), np.array(leaves))


def held_out(doc_id: Column) -> Column:
    """Whether a document's label is never learnt from. A missing id is not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def _vectors(docs: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, found in slices(batches):
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array([statistics(t) for t in found], pa.list_(pa.float64()))],
                names=["doc_id", "x"])

    return texts(docs).mapInArrow(run, "doc_id long, x array<double>")


def fit_quality(
    docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, params: BoostParams = BoostParams(),
    apart: Column | None = None,
) -> Trees:
    """Fit on labelled documents that are not `apart` (default: the held-out ones).

    Of several labels of a document the most frequent counts, 1 in a tie; missing ones do not.
    """
    apart = held_out(F.col("doc_id")) if apart is None else apart
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("y")).where(
        F.col("doc_id").isNotNull() & F.col("y").isin(0, 1) & ~apart)
    chosen = known.groupBy("doc_id").agg((F.avg("y") >= 0.5).cast("int").alias("y")).orderBy(
        F.xxhash64("doc_id"), "doc_id").limit(sample)
    # At most `sample` rows by construction.
    rows = _vectors(texts(docs).join(F.broadcast(chosen.select("doc_id")), "doc_id")).join(
        F.broadcast(chosen), "doc_id").orderBy("doc_id", F.col("x").cast("string")).limit(sample).select("x", "y").toPandas()
    x = np.array(rows["x"].tolist(), float).reshape(len(rows), len(FEATURES))
    return fit_trees(x, rows["y"].to_numpy(float), params)


def score_quality(docs: DataFrame, trees: Trees) -> DataFrame:
    """doc_id and score of every row; only the text is read for it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        for ids, found in slices(batches):
            x = np.array([statistics(t) for t in found], float)
            scores = np.concatenate([trees.probability(x[k : k + 2000]) for k in range(0, len(x), 2000)])
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(scores)], names=["doc_id", "score"])

    return texts(docs).mapInArrow(run, "doc_id long, score double")


def keep_good(docs: DataFrame, trees: Trees, threshold: float = THRESHOLD) -> DataFrame:
    """All columns of the documents whose score is at least the threshold."""
    verdict = _score_column(trees)
    return docs.where(verdict(F.coalesce("text", F.lit(""))) >= threshold)


def _score_column(trees: Trees):
    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            out = [trees.probability(np.array([statistics(t) for t in batch.iloc[k : k + 500]], float))
                   for k in range(0, len(batch), 500)]
            yield pd.Series(np.concatenate(out) if out else np.zeros(0))

    return score


def classify(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, **options) -> DataFrame:
    """doc_id, held_out, score, predicted. Without labels every score is 0.5.

    A null text is scored as an empty one. Rows of equal id are scored each for itself.
    """
    scored = score_quality(docs, fit_quality(docs, labels, **options))
    return scored.select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"))
