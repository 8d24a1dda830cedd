"""Mixing documents to target weights with soft domain membership.

1. A classifier trained on the labelled table predicts each document's domain posteriors. Features
   are hashed word counts (``HashingTF``), the model is multinomial logistic regression; it is
   fitted on at most ``fit_rows`` labelled rows, chosen by a hash of doc_id, everything else covers
   all documents.
2. Document rates r >= 0 minimise
       1/2 sum_k (sum_d w_d r_d p_dk - t_k)^2 + ridge/2 sum_d w_d (r_d - 1)^2,
   where w_d is the document's share of all tokens, p_dk its posterior and t_k the target share of
   domain k. ``ridge`` is taken relative to the smallest domain's share, so it does not hold a rare
   domain back. Projected gradient: a step sums the K totals of the present rates over all documents,
   with a map-side combine, moves the K sums of steps mu against the gradient, and projects every
   rate onto r_d >= 0 again, r_d = max(0, 1 + sum_k mu_k p_dk). The step is the inverse of the Gram
   matrix of all documents, summed once: documents at 0 only lessen the curvature, so no step is too
   long and none has to be tried. Steps are accelerated (Nesterov, restarted where they turn back) and
   end where the gradient is below ``tolerance`` / 100. Only K numbers a step reach the driver. ``missed``
   is how far the worst total stays from its target; beyond ``tolerance`` that is logged as well.

DataFrame functions and Spark's own JVM estimators only. Every row gets its
rate: none is dropped. A document without words has no tokens and gets rate 1, a null doc_id is as
good as any; an empty table gives no row. With no labelled row, or labels of one domain only, every
document belongs to a single domain and gets the rate that meets its total. Documents with the same
words have the same rate, repeated rows among them; very long ones count with all their words. A doc_id
that is labelled twice counts with both labels. Tokens are words.
"""

from __future__ import annotations

import logging

import numpy as np
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..scratch import Scratch
from .text_native import ascii_lower, words

#: Domains by (quality, toxic) label, and the share of the mixed corpus' tokens that each shall have.
DOMAINS = ("good", "poor", "toxic")
TARGETS = (0.90, 0.09, 0.01)

_log = logging.getLogger(__name__)


def domain_label() -> Column:
    return F.when(F.col("toxic") == 1, 2.0).when(F.col("quality") == 0, 1.0).otherwise(0.0)


def _features(text: Column) -> Column:
    return words(ascii_lower(F.coalesce(text, F.lit(""))))


def fit_domains(docs: DataFrame, labels: DataFrame, fit_rows: int = 4000, features: int = 1 << 13):
    """The fitted classifier, or None where fewer than two domains are labelled."""
    hashing = HashingTF(inputCol="_words", outputCol="_features", numFeatures=features)
    chosen = (
        labels.where("doc_id is not null and quality is not null and toxic is not null")
        .select("doc_id", domain_label().alias("label"))
        .orderBy(F.xxhash64("doc_id", F.lit(5)), "doc_id", "label")
        .limit(fit_rows)
    )
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")  # fit_rows pairs of numbers at most
    rows = hashing.transform(rows.select("label", _features(F.col("text")).alias("_words"))).select("label", "_features").persist()
    try:
        seen = rows.groupBy("label").count().collect()  # one row for each domain
        if len(seen) < 2:
            return None
        model = LogisticRegression(featuresCol="_features", labelCol="label", family="multinomial", regParam=0.003, maxIter=40, aggregationDepth=2)
        return hashing, model.fit(rows)
    finally:
        rows.unpersist()


def posteriors(docs: DataFrame, fitted) -> DataFrame:
    """The rows of ``docs`` with n_words and the posterior of each domain as an array."""
    with_words = docs.withColumn("_words", _features(F.col("text")))
    n = F.size("_words").cast("double")
    if fitted is None:
        return with_words.select(*docs.columns, n.alias("_tokens"), F.array(*[F.lit(1.0 if i == 0 else 0.0) for i in range(len(DOMAINS))]).alias("_p"))
    hashing, model = fitted
    scored = model.transform(hashing.transform(with_words))
    p = vector_to_array("probability")
    return scored.select(*docs.columns, n.alias("_tokens"), F.array(*[F.coalesce(F.get(p, i), F.lit(0.0)) for i in range(len(DOMAINS))]).alias("_p"))


def fit_rates(rows: DataFrame, targets: tuple[float, ...], ridge: float, steps: int, tolerance: float) -> DataFrame:
    """``rows`` (key, _tokens, _p) with ``rate`` and ``missed``; sums over all rows, K numbers a step to the driver."""
    k, t = len(targets), np.array(targets)
    total = rows.agg(F.sum("_tokens")).first()[0] or 1.0
    weight = (F.col("_tokens") / total).alias("w")

    def rate(mu: np.ndarray) -> Column:
        return F.greatest(F.lit(0.0), sum((F.get("_p", i) * F.lit(float(mu[i])) for i in range(k)), F.lit(1.0)))

    def totals(mu: np.ndarray) -> np.ndarray:
        got = rows.select(weight, rate(mu).alias("r"), "_p").agg(*[F.sum(F.col("w") * F.col("r") * F.get("_p", i)) for i in range(k)]).first()
        return np.array([x or 0.0 for x in got])

    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    sums = rows.select(weight, "_p").agg(*[F.sum(F.col("w") * F.get("_p", i) * F.get("_p", j)) for i, j in pairs]).first()
    gram = np.zeros((k, k))
    for (i, j), x in zip(pairs, sums, strict=True):
        gram[i, j] = gram[j, i] = x or 0.0
    mu = ahead = np.zeros(k)
    reached = totals(mu)
    shares = reached[reached > 0]
    ridge *= float(shares.min()) if len(shares) else 1.0
    step, pace = np.linalg.inv(gram + ridge * np.eye(k)), 1.0
    for _ in range(steps):
        slope = reached - t + ridge * ahead
        if np.abs(slope).max() < tolerance / 100:
            break
        new = ahead - step @ slope
        if slope @ (new - mu) > 0:
            pace = 1.0
        quicker = (1 + np.sqrt(1 + 4 * pace * pace)) / 2
        mu, ahead, pace = new, new + (pace - 1) / quicker * (new - mu), quicker
        reached = totals(ahead)
    missed = float(np.abs(reached - t).max())
    if missed > tolerance:
        _log.warning("mixing targets missed by up to %.6f: totals %s, targets %s", missed, [round(float(x), 6) for x in reached], list(targets))
    return rows.withColumns({"rate": rate(ahead), "missed": F.lit(missed)})


def mix(docs: DataFrame, labels: DataFrame, scratch: Scratch, targets: tuple[float, ...] = TARGETS, ridge: float = 1e-4, steps: int = 64, tolerance: float = 2e-4, fit_rows: int = 4000) -> DataFrame:
    """doc_id, n_words, posteriors, rate, copies and missed for every row of ``docs`` (doc_id, text).

    ``copies`` realises the rate as a whole number: its floor, and one more for the fraction of
    documents that a hash of doc_id and of the row's place picks, so copies of a text are not all
    rounded alike.
    """
    docs = docs.select("doc_id", "text")  # other columns, whatever their names, are not looked at
    fitted = fit_domains(docs, labels, fit_rows)
    pick = F.pmod(F.xxhash64("doc_id", F.monotonically_increasing_id(), F.lit(29)), F.lit(1_000_000)) / F.lit(1_000_000.0)
    rows = scratch.save(posteriors(docs, fitted).withColumn("_pick", pick).drop("text"), "posteriors")
    rated = fit_rates(rows, targets, ridge, steps, tolerance)
    rate = F.when(F.col("_tokens") == 0, F.lit(1.0)).otherwise(F.col("rate"))
    return rated.select(
        "doc_id",
        F.col("_tokens").cast("long").alias("n_words"),
        *[F.get("_p", i).alias(f"p_{name}") for i, name in enumerate(DOMAINS)],
        rate.alias("rate"),
        (F.floor(rate) + F.when(F.col("_pick") < rate - F.floor(rate), 1).otherwise(0)).cast("long").alias("copies"),
        "missed",
    )
