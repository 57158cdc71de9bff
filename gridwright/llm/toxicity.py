"""Toxicity by non-negative positive-unlabelled learning.

Positives are confirmed toxic documents; the unlabelled are documents drawn from all of them,
whatever their label. A linear model over the presence of words minimises
    prior * E_P[l(z)] + max(0, E_U[l(-z)] - prior * E_P[l(-z)])
with the logistic loss l: the class prior corrects for the toxic documents among the unlabelled,
and the bracket, an estimate of the risk on clean documents, is not let below zero (where it falls
below, a step goes the other way, as in the published method).

The model is fitted in numpy on a bounded sample: at most POSITIVES labelled and UNLABELLED other
documents, those with the smallest hash of doc_id, so reruns agree. Its features are the MAX_FEATURES
words that best tell the two sets apart, among those in MIN_TEXTS texts of the sample or more whose
shares in the two differ by MIN_Z standard errors: rarer words would be learnt by heart. All five
are parameters of the fit, stated with their effect in the README. The class prior comes from all
training labels. Every text is scored whole, in one pass without any exchange.

No label of a held-out document (crc32 of doc_id as text, mod 4, is 2) is ever read, and scores see
the text alone. Defined cases: null and empty texts get the score of a text without words; a null
doc_id is held out from nothing and never sampled; without any positive label every score is the
prior, or 0; rows that repeat get equal scores; of texts that share a sampled doc_id the one with the
least key is learnt from; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textbytes as tb
from .common import table

POSITIVES, UNLABELLED, MAX_FEATURES = 6000, 12000, 300
MIN_TEXTS, MIN_Z = 5, 4.0
THRESHOLD = 0.3
EPOCHS, RATE, DECAY = 300, 0.1, 1e-4


def held_out(doc_id: Column, mod: int = 4) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % mod == 2, F.lit(False))


def _features(batches):
    """Distinct words of each text, as hashes."""
    for batch in batches:
        for texts in tb.chunks(batch.column("text")):
            w = tb.words(texts, tb.ALNUM)
            at = np.cumsum(w.counts)[:-1]
            part = batch.slice(texts.first, len(texts))
            yield pa.RecordBatch.from_arrays([part.column("positive"), pa.array([np.unique(x).view(np.int64) for x in np.split(w.hashes, at)], pa.list_(pa.int64()))], ["positive", "words"])


def sample(docs: DataFrame, labels: DataFrame, positives: int = POSITIVES, unlabelled: int = UNLABELLED) -> DataFrame:
    """positive, words: of the bounded sample. The two lists of ids are bounded by their limits, so they are broadcast."""
    order = F.xxhash64(F.lit("sample"), F.col("doc_id"))
    free = F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))
    yes = labels.where(free & (F.col("toxic") == 1)).select("doc_id").distinct().orderBy(order, "doc_id").limit(positives)
    drawn = docs.where(free).select("doc_id").distinct().orderBy(order, "doc_id").limit(unlabelled)
    ids = yes.select("doc_id", F.lit(True).alias("positive")).unionByName(drawn.select("doc_id", F.lit(False).alias("positive")))
    key = F.struct(F.xxhash64(F.coalesce("text", F.lit(""))), F.xxhash64(F.lit(1), F.coalesce("text", F.lit(""))))
    rows = docs.select("doc_id", "text", key.alias("key")).join(F.broadcast(ids), "doc_id").groupBy("doc_id", "positive").agg(F.min_by("text", "key").alias("text")).select("positive", "text")
    return rows.mapInArrow(_features, "positive boolean, words array<bigint>")


def class_prior(labels: DataFrame) -> float:
    r = labels.where(F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).agg(F.avg(F.col("toxic").cast("double")).alias("p")).first()
    return float(r["p"] or 0.0)


def fit(positive: np.ndarray, sizes: np.ndarray, hashes: np.ndarray, prior: float, max_features: int = MAX_FEATURES, min_texts: int = MIN_TEXTS, min_z: float = MIN_Z) -> tuple[np.ndarray, np.ndarray, float]:
    """(word hashes in order, their weights, bias) from each document's distinct words."""
    none = np.empty(0, np.uint64), np.empty(0), 0.0
    n_p, n_u = int(positive.sum()), int((~positive).sum())
    if not n_p or not n_u or not 0 < prior < 1:
        return *none[:2], float(np.log(max(prior, 1e-6) / max(1 - prior, 1e-6)))
    doc = np.repeat(np.arange(len(sizes)), sizes)
    vocabulary, word = np.unique(hashes, return_inverse=True)
    df_p = np.bincount(word, weights=positive[doc], minlength=len(vocabulary))
    df_u = np.bincount(word, minlength=len(vocabulary)) - df_p
    p, u = (df_p + 0.5) / (n_p + 1), (df_u + 0.5) / (n_u + 1)
    z = np.abs(p - u) / np.sqrt(u * (1 - u) / n_p + u * (1 - u) / n_u)
    z[df_p + df_u < min_texts] = 0
    best = np.sort(np.argsort(-z, kind="stable")[:max_features])
    best = best[z[best] > min_z]
    column = np.full(len(vocabulary), -1)
    column[best] = np.arange(len(best))
    keep = column[word] >= 0
    doc, col, k = doc[keep], column[word[keep]], len(best)
    w, m, v = np.zeros(k + 1), np.zeros(k + 1), np.zeros(k + 1)
    w[k] = np.log(prior / (1 - prior))
    sigmoid = lambda x: 1 / (1 + np.exp(-np.clip(x, -40, 40)))
    soft = lambda x: np.logaddexp(0, -x)
    for t in range(1, EPOCHS + 1):
        x = w[k] + np.bincount(doc, weights=w[col], minlength=len(positive))
        s = sigmoid(x)
        clean = soft(-x[~positive]).mean() - prior * soft(-x[positive]).mean()
        of_clean = np.where(positive, -prior * s / n_p, s / n_u)
        g = of_clean + np.where(positive, -prior * (1 - s) / n_p, 0) if clean >= 0 else -of_clean
        grad = np.append(np.bincount(col, weights=g[doc], minlength=k), g.sum()) + DECAY * np.append(w[:k], 0)
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        w = w - RATE * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return vocabulary[best], w[:k], float(w[k])


def model(docs: DataFrame, labels: DataFrame):
    got = sample(docs, labels).toArrow()
    lists = got.column("words").combine_chunks()
    lists = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
    sizes = np.diff(lists.offsets.to_numpy())
    positive = got.column("positive").to_numpy().astype(bool)
    hashes = lists.flatten().to_numpy().view(np.uint64)
    parts = np.split(hashes, np.cumsum(sizes)[:-1]) if len(sizes) else []
    key = np.array([np.bitwise_xor.reduce(x) if len(x) else 0 for x in parts], np.uint64)
    order = np.lexsort((key, sizes, positive))  # the exchange's order isn't fixed, and sums in floating point depend on it
    hashes = np.concatenate([parts[i] for i in order]) if len(order) else hashes
    return fit(positive[order], sizes[order], hashes, class_prior(labels))


def score_texts(docs: DataFrame, words: np.ndarray, weights: np.ndarray, bias: float) -> DataFrame:
    """docs(doc_id, text) -> doc_id, score."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            for texts in tb.chunks(batch.column("text")):
                w = tb.words(texts, tb.ALNUM)
                z = np.full(len(texts), bias)
                if len(words) and len(w.hashes):
                    at = np.minimum(np.searchsorted(words, w.hashes), len(words) - 1)
                    hit = np.flatnonzero(words[at] == w.hashes)
                    pair = np.unique(w.texts[hit] * len(words) + at[hit])
                    z += np.bincount(pair // len(words), weights=weights[pair % len(words)], minlength=len(texts))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(texts.first, len(texts)), pa.array(1 / (1 + np.exp(-np.clip(z, -40, 40))))], ["doc_id", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, score double")


def toxicity(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """docs(doc_id, text), labels(doc_id, toxic) -> doc_id, held_out, score, predicted."""
    scored = score_texts(docs, *model(docs, labels))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
