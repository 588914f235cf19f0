"""Toxicity scores by non-negative positive-unlabelled learning.

Positives are texts confirmed as toxic; all texts used for training are unlabelled as well, toxic ones among
them. With prior p (the share of toxic texts among the labelled ones) and sigmoid loss, the risk is
``p * loss(P, 1) + max(0, loss(U, 0) - p * loss(P, 0))``: the part in brackets estimates the risk on the
negatives, and a step from where it is below zero is turned round. A few linear classifiers with different
batches are trained in numpy on presence features and averaged.

Features are words (runs of letters, lower case) and their beginnings of 4 to 6 letters. Those most unevenly
spread between positives and unlabelled texts are taken. Training uses at most ``MAX_POSITIVE`` positives and
``MAX_UNLABELLED`` texts, the first by hash of the id; scoring covers every whole text.

* A null text counts as empty; an empty text gets the score of the bias.
* Rows with a null id are scored, never trained on. Repeated labels of an id: toxic if any says so.
* Without a confirmed text nothing can be learnt: every score is 0.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from molaris.llm.common import written

MAX_POSITIVE = 2_000
MAX_UNLABELLED = 6_000
FEATURES = 512
#: A feature must stand in so many training texts.
MIN_TEXTS = 4
BEGINNINGS = (4, 5, 6)
MODELS = 3
EPOCHS = 60
BATCH = 512
RATE = 0.05
DECAY = 1e-4

WORD = re.compile(r"[^\W\d_]+")


def features_of(text: str) -> set[str]:
    words = set(WORD.findall(text.lower()))
    return words.union(*({w[:n] + "*" for w in words if len(w) > n} for n in BEGINNINGS))


@dataclass
class Classifier:
    """Linear scores over named features, one column of weights per model."""

    names: list[str]
    weights: np.ndarray
    bias: np.ndarray

    def scorer(self):
        whole = {name: i for i, name in enumerate(self.names) if not name.endswith("*")}
        begins = [(n, {name[:-1]: i for i, name in enumerate(self.names) if name.endswith("*") and len(name) == n + 1})
                  for n in BEGINNINGS]

        def score(text: str) -> float:
            words = set(WORD.findall(text.lower()))
            found = {whole[w] for w in words & whole.keys()}
            for n, begin in begins:
                found |= {begin[b] for b in {w[:n] for w in words if len(w) > n} & begin.keys()}
            margin = self.weights[sorted(found)].sum(axis=0) + self.bias
            return float((1 / (1 + np.exp(-np.clip(margin, -50, 50)))).mean())

        return score


def nn_pu(x: np.ndarray, width: int, positive: np.ndarray, unlabelled: np.ndarray, prior: float, seed: int) -> tuple[np.ndarray, float]:
    """Weights and bias. x holds the features of a text in a row, filled up with ``width``; positive and unlabelled
    are the rows of the confirmed and of all texts."""
    rng = np.random.default_rng(seed)
    w = np.zeros(width + 2)  # the last but one, of the filling, stays 0; the last is the bias
    w[-1] = np.log(prior / (1 - prior))
    first, second, step = np.zeros_like(w), np.zeros_like(w), 0

    def margin(rows):
        return w[x[rows]].sum(axis=1) + w[-1]

    def gradient(rows, slope):
        g = np.bincount(x[rows].ravel(), np.repeat(slope, x.shape[1]), width + 2)
        g[-2:] = 0, slope.sum()
        return g / len(rows)

    def sigmoid(z):
        return 1 / (1 + np.exp(-np.clip(z, -50, 50)))

    for _ in range(EPOCHS):
        order = rng.permutation(unlabelled)
        for at in range(0, len(order), BATCH):
            u = order[at:at + BATCH]
            p = rng.choice(positive, min(BATCH, len(positive)), replace=False)
            sp, su = sigmoid(margin(p)), sigmoid(margin(u))
            # the loss of calling m positive is sigmoid(m), of calling it negative sigmoid(-m)
            slope_p, slope_u = gradient(p, sp * (1 - sp)), gradient(u, su * (1 - su))
            g = slope_u - prior * slope_p
            g = g - prior * slope_p if su.mean() >= prior * sp.mean() else -g
            g[:-1] += DECAY * w[:-1]
            step += 1
            first = 0.9 * first + 0.1 * g
            second = 0.999 * second + 0.001 * g * g
            w -= RATE * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
    return w[:-2], float(w[-1])


def _first_ids(rows: DataFrame, n: int) -> DataFrame:
    """At most n ids, the first by hash: small enough to be broadcast."""
    return F.broadcast(rows.select("id").distinct().orderBy(F.xxhash64("id"), "id").limit(n))


def fit(texts: DataFrame, labels: DataFrame) -> Classifier | None:
    """Train from rows (id, text) and (id, toxic 0 or 1). Null ids and labels are left out."""
    known = labels.filter("id IS NOT NULL AND toxic IS NOT NULL").groupBy("id").agg(F.max("toxic").alias("toxic"))
    share = known.agg(F.avg("toxic").alias("toxic")).first()["toxic"]
    if not share:
        return None
    texts = texts.filter("id IS NOT NULL")
    some = _first_ids(known.filter("toxic = 1"), MAX_POSITIVE).withColumn("kind", F.lit(0))
    any_ = _first_ids(texts, MAX_UNLABELLED).withColumn("kind", F.lit(1))

    @F.arrow_udf("array<string>")
    def featured(batch: pa.Array) -> pa.Array:
        return pa.array([sorted(features_of(t.as_py() or "")) for t in batch], pa.list_(pa.string()))

    # an id of both kinds appears twice; of several texts of an id the one with the smallest hash
    chosen = texts.join(some, "id").unionByName(texts.join(any_, "id")).groupBy("id", "kind").agg(
        F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text"))
    sample = written(chosen.select("id", "kind", featured("text").alias("f")), "featured")
    totals = dict(sample.groupBy("kind").count().collect())
    if not totals.get(0) or not totals.get(1):
        return None
    counts = sample.select("kind", F.explode("f").alias("name")).groupBy("name").agg(
        F.sum(F.expr(f"int(kind = 0) / {totals[0]}D")).alias("p"), F.sum(F.expr(f"int(kind = 1) / {totals[1]}D")).alias("u"),
        F.count(F.lit(1)).alias("n"))
    uneven = counts.filter(F.col("n") >= MIN_TEXTS).orderBy(F.expr("abs(p - u) / sqrt(p + u)").desc(), "name").limit(FEATURES)
    names = [r["name"] for r in uneven.select("name").collect()]
    if not names:
        return None
    at = F.broadcast(sample.sparkSession.createDataFrame([(n, i) for i, n in enumerate(names)], "name string, at int"))
    sparse = sample.select("id", "kind", F.explode_outer("f").alias("name")).join(at, "name", "left").groupBy("id", "kind").agg(
        F.sort_array(F.collect_set("at")).alias("at")).orderBy("id", "kind")
    rows = sparse.select("kind", "at").collect()  # bounded by the sample and the features
    x = np.full((len(rows), max(1, *(len(r["at"]) for r in rows))), len(names))
    for i, r in enumerate(rows):
        x[i, : len(r["at"])] = r["at"]
    kinds = np.array([r["kind"] for r in rows])
    prior = min(max(float(share), 1e-4), 0.9)
    p, u = np.flatnonzero(kinds == 0), np.flatnonzero(kinds == 1)
    fitted = [nn_pu(x, len(names), p, u, prior, seed) for seed in range(MODELS)]
    return Classifier(names, np.stack([w for w, _ in fitted], axis=1), np.array([b for _, b in fitted]))


def scored(text: Column, model: Classifier | None) -> Column:
    """Score between 0 and 1 of each whole text."""

    @F.arrow_udf("double")
    def score(batch: pa.Array) -> pa.Array:
        if model is None:
            return pa.array(np.zeros(len(batch)))
        of = model.scorer()
        return pa.array([of(t.as_py() or "") for t in batch], pa.float64())

    return score(text)
