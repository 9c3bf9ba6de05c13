"""Toxicity by a classifier chain.

Categories are predicted one after the other by linear models. Each sees the text's features and the
probabilities of the categories before it, as log-odds. A model must not learn from probabilities
that are better than those it will see later, so in training the earlier categories' are out-of-fold
predictions: the training rows are split into folds by a hash of their text, so that copies share a
fold, and each fold is predicted by models of the others.

Features are the quality classifier's text statistics and the presence of words that training
documents of a category hold more often than others, by hash. The words are chosen by grouped
counts; the model is a few hundred numbers.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from candor.llm import linear, quality
from candor.llm import textkernel as tk
from candor.llm.scratch import Scratch
from candor.llm.workers import bound_batches, trimmed

#: Labelled documents that the chain is fitted on, at most; which ones is a hash of their ids.
TRAINING_ROWS = 20_000
#: Words chosen for each category.
WORDS = 80
#: Training documents that a chosen word stands in, at least.
LEAST_DOCUMENTS = 4
FOLDS = 4

U = np.uint64


def _batch_features(texts: list[bytes], vocabulary: np.ndarray) -> np.ndarray:
    """Statistics, and presence of each word of the sorted vocabulary."""
    w = tk.Words(texts, tk.NON_WORD)
    h = w.hashes()
    present = np.zeros((len(texts), len(vocabulary)))
    if len(vocabulary):
        at = np.searchsorted(vocabulary, h)
        at[at == len(vocabulary)] = 0
        hit = vocabulary[at] == h
        present[w.doc[hit], at[hit]] = 1
    return np.column_stack([quality.features(texts), present])


def _features(column: pa.Array, vocabulary: np.ndarray) -> Iterator[np.ndarray]:
    texts = tk.as_bytes(column)
    for lo, hi in tk.chunks(texts):
        yield _batch_features(texts[lo:hi], vocabulary)


def _distinct_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        texts = tk.as_bytes(b.column(0))
        for lo, hi in tk.chunks(texts):
            w = tk.Words(texts[lo:hi], tk.NON_WORD)
            doc, h, _ = tk.distinct(w.doc, w.hashes())
            rows = pa.array(doc + lo)
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), *(b.column(i).take(rows) for i in range(1, b.num_columns))], ["h", *b.schema.names[1:]])


class Chain:
    """vocabulary: sorted word hashes; links: for each category its weights and bias."""

    def __init__(self, categories: list[str], vocabulary: np.ndarray, links: list[tuple[np.ndarray, float]], cuts: list[float]):
        self.categories, self.vocabulary, self.links, self.cuts = categories, vocabulary, links, cuts

    def predict(self, x: np.ndarray) -> np.ndarray:
        """(rows, categories) probabilities; each link also sees the ones before it."""
        out = np.zeros((len(x), 0))
        for weights, bias in self.links:
            p = linear.sigmoid(np.column_stack([x, _odds(out)]) @ weights + bias)
            out = np.column_stack([out, p])
        return out


def _odds(p: np.ndarray) -> np.ndarray:
    p = np.clip(p, 1e-4, 1 - 1e-4)
    return np.log(p / (1 - p))


def fit_links(x: np.ndarray, y: np.ndarray, fold: np.ndarray) -> tuple[list[tuple[np.ndarray, float]], list[float]]:
    """The chain's links and, for each category, the cut with the best F1 of its out-of-fold predictions.

    x: (rows, features); y: (rows, categories) of 0 and 1; fold: each row's fold.
    """
    held = np.zeros((len(x), 0))
    links, cuts = [], []
    for c in range(y.shape[1]):
        seen = np.column_stack([x, _odds(held)])
        p = np.full(len(x), y[:, c].mean() if len(x) else 0.0)
        for f in np.unique(fold):
            rest = fold != f
            if rest.any():
                weights, bias = linear.fit(seen[rest], y[rest, c], 2.0, 7)
                p[~rest] = linear.sigmoid(seen[~rest] @ weights + bias)
        links.append(linear.fit(seen, y[:, c], 2.0, 7))
        cuts.append(_best_cut(p, y[:, c]))
        held = np.column_stack([held, p])
    return links, cuts


def _best_cut(p: np.ndarray, y: np.ndarray) -> float:
    if len(y) == 0 or y.min() == y.max():
        return 1.1  # nothing learned: nobody is in the category
    order = np.argsort(-p, kind="stable")
    hits = np.cumsum(y[order])
    f1 = 2 * hits / (np.arange(1, len(y) + 1) + y.sum())
    best = int(f1.argmax())
    after = p[order][best + 1] if best + 1 < len(p) else 0.0
    return float((p[order][best] + after) / 2)


def fit(docs: DataFrame, labels: DataFrame, categories: list[str], id_col: str = "doc_id", text_col: str = "text", bound: int = TRAINING_ROWS) -> Chain:
    """labels: id_col and a 0/1 column for each category, in the chain's order; rows with a null are left out."""
    bound_batches(docs.sparkSession)
    scratch = Scratch(docs.sparkSession, "toxicity")
    full = labels.filter(" AND ".join(f"`{c}` IS NOT NULL" for c in categories)).select(id_col, *categories)
    rows = quality.training_rows(docs, full, categories, bound, id_col, text_col)
    rows = scratch.save(rows.select(F.col("__text").alias("text"), *[F.col(c).cast("int").alias(f"y{i}") for i, c in enumerate(categories)]), "rows")
    ys = [f"y{i}" for i in range(len(categories))]
    n, *positives = rows.agg(F.count("*"), *[F.coalesce(F.sum(y), F.lit(0)) for y in ys]).first()
    seen = rows.mapInArrow(trimmed(_distinct_words), "h bigint, " + ", ".join(f"{y} int" for y in ys))
    counts = scratch.save(seen.groupBy("h").agg(F.count("*").alias("n"), *[F.sum(y).alias(y) for y in ys]).filter(F.col("n") >= LEAST_DOCUMENTS), "counts")
    chosen: set[int] = set()
    for y, k in zip(ys, positives, strict=True):
        if 0 < k < n:
            share = k / n
            excess = (F.col(y) - F.col("n") * share) / F.sqrt(F.col("n") * share * (1 - share) + 1)
            chosen |= {r["h"] for r in counts.orderBy(F.desc(excess), "h").limit(WORDS).select("h").collect()}
    vocabulary = np.sort(np.array(sorted(chosen), np.int64).view(U))

    width = len(quality.FEATURES) + len(vocabulary)
    told = rows.select("text", F.concat_ws("", *ys).alias("y"), F.pmod(F.xxhash64("text"), F.lit(FOLDS)).cast("int").alias("fold"))

    def with_labels(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = [r.astype(np.float32).tobytes() for part in _features(b.column(0), vocabulary) for r in part]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.binary()), b.column(1), b.column(2)], ["x", "y", "fold"])

    got = told.mapInArrow(trimmed(with_labels), "x binary, y string, fold int").toArrow()
    x = np.frombuffer(b"".join(got["x"].to_pylist()), np.float32).reshape(-1, width).astype(np.float64)
    y = np.array([[int(c) for c in row] for row in got["y"].to_pylist()], np.float64).reshape(-1, len(categories))
    links, cuts = fit_links(x, y, np.asarray(got["fold"]))
    scratch.drop(rows)
    return Chain(categories, vocabulary, links, cuts)


def classify(docs: DataFrame, chain: Chain, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, and for each category p_<category> and whether it is at its cut, for every row of docs.

    Null text is empty and its features are all zero. Ids pass through, null and repeated ones too;
    an empty table gives an empty table; further columns are ignored. A category whose labels were
    all alike has no members.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            parts = [chain.predict(x) for x in _features(b.column(1), chain.vocabulary)]
            p = np.concatenate(parts) if parts else np.zeros((0, len(chain.links)))
            columns = [pa.array(p[:, c]) for c in range(p.shape[1])]
            flags = [pa.array(p[:, c] >= chain.cuts[c]) for c in range(p.shape[1])]
            yield pa.RecordBatch.from_arrays([b.column(0), *columns, *flags], ["id", *(f"p_{c}" for c in chain.categories), *chain.categories])

    fields = [f"p_{c} double" for c in chain.categories] + [f"{c} boolean" for c in chain.categories]
    out = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(trimmed(predict), f"id {kind}, " + ", ".join(fields))
    return out.withColumnRenamed("id", id_col)
