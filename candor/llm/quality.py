"""Quality classifier with hierarchical empirical Bayes over sites.

A logistic model of text statistics gives each document's evidence, the log-odds of good against
the training share. Sites have two levels, host and path within host. Each level's share of good
documents is shrunk toward the level above, hosts toward the whole corpus and paths toward their
host, by a strength found from the spread between sites (method of moments), so sparse sites say
little and large ones much. A document's posterior adds its evidence to the log-odds of its path's
share, computed without the document itself. All shares are grouped sums over every document.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from candor.llm import linear, lookups
from candor.llm import textkernel as tk
from candor.llm.scratch import Scratch
from candor.llm.workers import bound_batches, release, trimmed

#: Labelled documents that the classifier is fitted on, at most; which ones is a hash of their ids.
TRAINING_ROWS = 20_000
FEATURES = ("upper", "symbols", "pipes", "digits", "repeats", "near_repeats", "word_length", "lines", "words", "non_ascii")

_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in "!#$%&*+<=>@[]^_`{}~\\"]] = True


def features(texts: list[bytes]) -> np.ndarray:
    """One row of FEATURES for each text, all bounded; a text without words is all zeros."""
    w = tk.Words(texts, lower=False)
    n = w.counts()
    raw, words = w.raw, np.maximum(n, 1)
    edges = np.concatenate([[0], w.text_ends])

    def share(chosen: np.ndarray) -> np.ndarray:
        sums = np.concatenate([[0], np.cumsum(chosen)])
        return sums[edges[1:]] - sums[edges[:-1]]

    upper = share((raw >= 0x41) & (raw <= 0x5A))
    letters = share(((raw | 0x20) >= 0x61) & ((raw | 0x20) <= 0x7A))
    lines = share(raw == 0x0A) - 1  # without the one that ends each text
    h = w.hashes()

    def repeated(gaps: tuple[int, ...]) -> np.ndarray:
        again = np.zeros(len(h), bool)
        for g in gaps:
            if len(h) > g:
                again[g:] |= (h[g:] == h[:-g]) & (w.doc[g:] == w.doc[:-g])
        return np.bincount(w.doc[again], minlength=len(texts)) / words

    size = np.maximum(w.text_lengths, 1)
    cap = lambda v: np.minimum(v, 1.0)
    out = np.column_stack(
        [
            upper / np.maximum(letters, 1),
            cap(share(_SYMBOL[raw]) / words),
            cap(share(raw == 0x7C) / words),
            share((raw >= 0x30) & (raw <= 0x39)) / size,
            repeated((1,)),
            repeated((1, 2, 3, 4)),
            cap(np.bincount(w.doc, w.ends - w.starts, len(texts)) / words / 20),
            cap(lines / words),
            cap(np.log1p(n) / 12),
            share(raw >= 0x80) / size,
        ]
    ).astype(np.float64)
    out[n == 0] = 0
    return out


def features_of(texts: pa.Array) -> np.ndarray:
    raw = tk.as_bytes(texts)
    rows = [features(raw[lo:hi]) for lo, hi in tk.chunks(raw)]
    return np.concatenate(rows) if rows else np.zeros((0, len(FEATURES)))


def training_rows(docs: DataFrame, labels: DataFrame, columns: list[str], bound: int, id_col: str, text_col: str) -> DataFrame:
    """(text, *columns) of at most ``bound`` labelled documents, the same ones on every run.

    An id is one document however often it occurs: its smallest labels and its smallest text count.
    """
    chosen = labels.filter(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("__id")).agg(F.min(F.struct(*columns)).alias("__told"))
    chosen = chosen.orderBy(F.xxhash64("__id"), "__id").limit(bound).select("__id", "__told.*")
    rows = docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text")).join(F.broadcast(chosen), "__id")
    return rows.groupBy("__id", *columns).agg(F.min("__text").alias("__text")).select("__text", *columns)


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", bound: int = TRAINING_ROWS) -> tuple[np.ndarray, float]:
    """The classifier's weights and bias; its log-odds are relative to the training share of good documents."""

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = features_of(b.column(0))
            yield pa.RecordBatch.from_arrays([pa.array(list(x), pa.list_(pa.float64())), b.column(1)], ["x", "y"])

    rows = training_rows(docs, labels.filter("quality is not null").select(id_col, "quality"), ["quality"], bound, id_col, text_col)
    got = rows.select("__text", F.col("quality").cast("double").alias("y")).mapInArrow(trimmed(compute), "x array<double>, y double").toArrow()
    x = np.array(got["x"].to_pylist(), np.float64).reshape(-1, len(FEATURES))
    y = np.asarray(got["y"], np.float64)
    weights, bias = linear.fit(x, y)
    share = y.mean() if len(y) and y.min() < y.max() else 0.5
    return weights, bias - float(np.log(share / (1 - share)))


def evidence(model: tuple[np.ndarray, float], text: Column) -> Column:
    weights, bias = model

    @F.arrow_udf("double")
    def score(texts: pa.Array) -> pa.Array:
        out = pa.array(np.clip(features_of(texts) @ weights + bias, -30, 30))
        release()
        return out

    return score(text)


def _odds(p: Column) -> Column:
    return F.log(p / (1 - p))


def site_shares(scratch: Scratch, scored: DataFrame, prior: float) -> tuple[DataFrame, float]:
    """(host, path, n, sum, shrunk share of the host, strength of the path's shrinking), and the corpus share.

    scored: host, path, z.
    """
    p = 1 / (1 + F.exp(-(F.col("z") + F.lit(float(np.log(prior / (1 - prior)))))))
    paths = scratch.save(
        scored.groupBy("host", "path").agg(F.count("*").alias("n"), F.sum(p).alias("s"), F.sum(p * p).alias("q")), "paths"
    )
    hosts = scratch.save(paths.groupBy("host").agg(F.sum("n").alias("hn"), F.sum("s").alias("hs")), "hosts")
    n, s, q, count_paths = paths.agg(F.sum("n"), F.sum("s"), F.sum("q"), F.count("*")).first()
    if not n:
        return paths.select("host", "path", "n", "s", F.lit(0.5).alias("above"), F.lit(1.0).alias("strength")), 0.5
    mu = min(max(s / n, 1e-3), 1 - 1e-3)
    noise = max(q / n - (s / n) ** 2, 1e-6)
    spread, count_hosts = hosts.agg(F.sum(F.col("hn") * F.pow(F.col("hs") / F.col("hn") - mu, 2)), F.count("*")).first()
    between = spread / n - noise * (count_hosts - 1) / n
    strength = float(np.clip(noise / max(between, 1e-9), 1, 1e4))
    shrunk = (F.lit(strength * mu) + F.col("hs")) / (F.lit(strength) + F.col("hn"))
    hosts = scratch.save(hosts.withColumnRenamed("host", "__host"), "hosts")
    joined = lookups.attach(paths, hosts, [(F.col("host"), "__host")], F.xxhash64("path"))
    (inner,) = joined.agg(F.sum(F.col("n") * F.pow(F.col("s") / F.col("n") - F.col("hs") / F.col("hn"), 2))).first()
    within = inner / n - noise * (count_paths - count_hosts) / n
    path_strength = float(np.clip(noise / max(within, 1e-9), 1, 1e4))
    return joined.select("host", "path", "n", "s", shrunk.alias("above"), F.lit(path_strength).alias("strength")), mu


def _judged(docs: DataFrame, model: tuple[np.ndarray, float], text_col: str, host_col: str, path_cols: tuple[str, ...], kept: list[str]) -> DataFrame:
    """The columns ``kept`` of docs with __z, __site, __posterior. Every text is scored once; its score is written with the row."""
    scratch = Scratch(docs.sparkSession, "quality")
    path = F.to_json(F.struct(*[F.col(c).cast("string").alias(f"p{i}") for i, c in enumerate(path_cols)]))
    rows = docs.select(*kept, F.col(host_col).cast("string").alias("__host"), path.alias("__path"), evidence(model, F.col(text_col)).alias("__z"))
    rows = scratch.save(rows, "scored")
    sites, _ = site_shares(scratch, rows.select(F.col("__host").alias("host"), F.col("__path").alias("path"), F.col("__z").alias("z")), 0.5)
    sites = scratch.save(sites.toDF("__h", "__p", "__n", "__s", "__above", "__strength"), "sites")
    rows = lookups.attach(rows, sites, [(F.col("__host"), "__h"), (F.col("__path"), "__p")], F.xxhash64("__z", kept[0]))
    own = 1 / (1 + F.exp(-F.col("__z")))
    others = (F.col("__strength") * F.col("__above") + F.greatest(F.col("__s") - own, F.lit(0.0))) / (F.col("__strength") + F.col("__n") - 1)
    others = F.least(F.greatest(others, F.lit(1e-3)), F.lit(1 - 1e-3))
    posterior = 1 / (1 + F.exp(-(F.col("__z") + _odds(others))))
    return rows.select(*kept, "__z", others.alias("__site"), posterior.alias("__posterior"))


def classify(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", path_cols: tuple[str, ...] = ("lang",)
) -> DataFrame:
    """id, evidence, site (share of good documents at its site), quality (posterior) and kept, for every row of docs.

    labels: id_col and quality, 1 good, 0 bad; rows with a null are left out. Null text is empty;
    a text without words has the evidence of all-zero statistics. Null hosts and paths are sites of
    their own. Rows are judged one by one, so repeated rows and ids, and null ids, come out as often
    as they go in. Without labels of both kinds all evidence is 0 and every document is kept. An
    empty table gives an empty table; further columns are ignored.
    """
    bound_batches(docs.sparkSession)
    model = fit(docs, labels, id_col, text_col)
    paths = tuple(f"__pa{i}" for i in range(len(path_cols)))
    ours = docs.select(
        F.col(id_col).alias("__i"), F.col(text_col).alias("__t"), F.col(host_col).alias("__ho"), *[F.col(c).alias(p) for c, p in zip(path_cols, paths, strict=True)]
    )
    out = _judged(ours, model, "__t", "__ho", paths, ["__i"])
    return out.select(
        F.col("__i").alias(id_col),
        F.col("__z").alias("evidence"),
        F.col("__site").alias("site"),
        F.col("__posterior").alias("quality"),
        (F.col("__posterior") >= 0.5).alias("kept"),
    )


def kept_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs whose posterior is 0.5 or more, with the columns of docs.

    Rows are judged one by one as in ``classify``: null text is empty, null sources and languages are
    sites, null and repeated ids stay; an empty table gives an empty table.
    """
    bound_batches(docs.sparkSession)
    model = fit(docs, labels)
    names = docs.columns
    fresh = [f"__c{i}" for i in range(len(names))]
    at = {n: fresh[names.index(n)] for n in ("doc_id", "text", "source", "lang")}
    out = _judged(docs.toDF(*fresh), model, at["text"], at["source"], (at["lang"],), fresh)
    return out.filter("__posterior >= 0.5").select(*[F.col(f).alias(n) for f, n in zip(fresh, names, strict=True)])
