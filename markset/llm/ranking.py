"""A quality classifier by Bradley-Terry pairwise ranking.

Every document of label 1 is preferred to every document of label 0. A preference holds with the
probability of a logistic function of the difference of two scores, scores are linear in features of
the text, and the weights minimise the logistic loss on feature differences of pairs. Every labelled
document stands in pairs, in about as many as the others of its label. The
threshold is the quantile of the scores that parts the labels in the share in which they were learned.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from markset.llm.common import WORD, id_hash_is, stored, table, whole_text
from markset.operators.running import dense_ids, running

#: Preference pairs per document of the rarer label.
PAIRS = 20
#: The score given at the quantile, from which on a document is accepted.
ACCEPT = 0.3
RIDGE = 1e-3


def features(text: Column) -> list[Column]:
    """Shape of a text, each feature between 0 and about 1, from the whole text by built-in expressions."""
    words = F.filter(F.split(text, r"[\x20\x09-\x0D]+", -1), lambda w: w != "")
    lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike(WORD))
    n, rows, chars = F.greatest(F.size(words), F.lit(1)), F.greatest(F.size(lines), F.lit(1)), F.greatest(F.length(text), F.lit(1))

    def many(pattern: str, over: Column, full: float = 1.0) -> Column:
        return F.least(F.regexp_count(text, F.lit(pattern)) / over / full, F.lit(1.0))

    return [
        many(r"[#*$%&|<>]", n, 0.5), many(r"[!?]", n, 0.5), many(r"[\p{Lu}]", chars, 0.2), many(r"[0-9]", chars, 0.2),
        many(r"(?<![^\x20\x09-\x0D])([^\x20\x09-\x0D]+)[\x20\x09-\x0D]+\1(?![^\x20\x09-\x0D])", n, 0.2),
        1.0 - F.size(F.array_distinct(lines)) / rows,
        F.size(F.array_distinct(words)) / F.pow(n, F.lit(0.9)),
        F.least(F.length(F.regexp_replace(text, r"[\x20\x09-\x0D]+", "")) / n / 10.0, F.lit(1.0)),
        F.log1p(n.cast("double")) / 10.0,
        many(r"[^\p{L}\p{M}\p{N}\s.,;:'!?()#*$%&|<>-]", n, 0.5),
    ]


def preference_pairs(rows: DataFrame, names: list[str], counts: dict[int, int], pairs: int = PAIRS) -> DataFrame:
    """Feature differences, better less worse, of pairs in which every row of ``rows(quality, doc_id, names)`` stands.

    Rows of each label are numbered by the hash of their ids. The commoner label's rows are gone through until there
    are ``pairs`` for each row of the rarer one, and once at least; each time they meet the next row of the rarer.
    """
    rare = 0 if counts[0] <= counts[1] else 1
    few, many = counts[rare], counts[1 - rare]
    n = max(pairs * few, many)
    numbered = dense_ids(rows.withColumn("_h", F.xxhash64("doc_id")), ["quality", "_h", *names], "number")
    # label 0 comes first in the order
    numbered = numbered.withColumn("number", F.col("number") - F.when(F.col("quality") == 0, 1).otherwise(counts[0] + 1))
    numbered = stored(numbered.select("quality", "number", *names), "numbered")
    turn = F.explode(F.sequence(F.lit(0), F.floor((F.lit(n - 1) - F.col("number")) / many)))
    a = numbered.where(F.col("quality") == 1 - rare).withColumn("_turn", turn).withColumn("_meets", (F.col("number") + F.col("_turn")) % few)
    b = numbered.where(F.col("quality") == rare).select(F.col("number").alias("_meets"), *[F.col(c).alias(f"_{c}") for c in names])
    sign = 1.0 if rare == 0 else -1.0
    return a.join(b, "_meets").select(*[(sign * (F.col(c) - F.col(f"_{c}"))).alias(c) for c in names])


def fit_pairs(differences: DataFrame) -> np.ndarray:
    """Weights of the logistic loss on stored feature differences, by Newton steps, ridge-damped.

    A step is one pass over all pairs; a task hands on its sums of the gradient and the curvature alone.
    """
    names = differences.columns
    size = len(names)

    def sums(w: np.ndarray) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            n, gradient, hessian = 0, np.zeros(size), np.zeros((size, size))
            for f in frames:
                d = f.to_numpy(float)
                p = 1 / (1 + np.exp(-np.clip(d @ w, -30, 30)))
                n, gradient, hessian = n + len(d), gradient + d.T @ (p - 1), hessian + (d * (p * (1 - p))[:, None]).T @ d
            yield pd.DataFrame({"n": [n], "g": [gradient.tolist()], "h": [hessian.ravel().tolist()]})

        return run

    w = np.zeros(size)
    for _ in range(50):
        # a row a task
        parts = differences.mapInPandas(sums(w), "n long, g array<double>, h array<double>").collect()
        n = sum(r["n"] for r in parts)
        gradient = np.sum([r["g"] for r in parts], axis=0) / n + RIDGE * w
        hessian = np.sum([r["h"] for r in parts], axis=0).reshape(size, size) / n + RIDGE * np.eye(size)
        step = np.linalg.solve(hessian, gradient)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


def parting(scores: DataFrame, below: float, least: float) -> float:
    """The value that parts ``scores(s, mass)``: up to it lies the mass ``below``; ``least`` is the smallest mass of a row."""
    sums = running(scores.groupBy("s").agg(F.sum("mass").alias("mass")), [], "s", {"sum": ("sum", "mass")})
    sums = stored(sums, "score-sums")
    last = sums.where(F.col("sum") >= below - 1e-6).agg(F.min_by(F.struct("s", "sum"), "s").alias("m")).first()["m"]
    above = None if last["sum"] - below >= least - 1e-6 else sums.where(F.col("s") > last["s"]).agg(F.min("s")).first()[0]
    return last["s"] if above is None else (last["s"] + above) / 2


class Ranking:
    """Weights, the threshold on their sum and the slope with which the score leaves ``ACCEPT``."""

    def __init__(self, weights: np.ndarray, threshold: float, slope: float) -> None:
        self.weights, self.threshold, self.slope = weights, threshold, slope

    def score(self, text: Column) -> Column:
        return self.score_of(features(text))

    def score_of(self, values: list[Column]) -> Column:
        """The score of a text with these features."""
        odds = (weighed(self.weights, values) - self.threshold) * self.slope + float(np.log(ACCEPT / (1 - ACCEPT)))
        return 1.0 / (1.0 + F.exp(-odds))


def weighed(weights: np.ndarray, values: list[Column]) -> Column:
    total = F.lit(0.0)
    for w, v in zip(weights, values, strict=True):
        total = total + F.lit(float(w)) * v
    return total


def featured(docs: DataFrame) -> DataFrame:
    """``doc_id`` and the features ``f0, f1, ...`` of each document's whole text, stored."""
    of = features(whole_text())
    return stored(docs.select("doc_id", *[f.cast("double").alias(f"f{i}") for i, f in enumerate(of)]), "features")


def learn(docs: DataFrame, labels: DataFrame) -> Ranking:
    """Fit on all of ``labels(doc_id, quality)`` that name a document."""
    return learn_from(featured(docs), labels)


def learn_from(rows: DataFrame, labels: DataFrame) -> Ranking:
    """Fit on all of ``labels(doc_id, quality)`` that name a row of ``featured`` documents; texts are not shuffled.

    Null labels are left out. Without both labels nothing can be ranked and every document is accepted.
    """
    known = labels.where(F.col("quality").isin(0, 1)).groupBy("doc_id").agg(F.max("quality").alias("quality"))
    names = [c for c in rows.columns if c != "doc_id"]
    rows = stored(rows.join(known.hint("merge"), "doc_id").select(F.col("quality").cast("int").alias("quality"), "doc_id", *names), "labelled")
    counts = {r["quality"]: r["count"] for r in rows.groupBy("quality").count().collect()}
    if len(counts) < 2:
        return Ranking(np.zeros(len(names)), -1.0, 1.0)
    w = fit_pairs(stored(preference_pairs(rows, names, counts), "pairs"))
    # the quantile of all labelled scores, each label weighed by how often it occurs
    given = {r["quality"]: r["count"] for r in known.groupBy(F.col("quality").cast("int").alias("quality")).count().collect()}
    mass = {q: given[q] / counts[q] for q in (0, 1)}
    s = rows.select(weighed(w, [F.col(c) for c in names]).alias("s"), F.when(F.col("quality") == 0, mass[0]).otherwise(mass[1]).alias("mass"))
    spread = s.agg(F.stddev_pop("s")).first()[0]
    return Ranking(w, float(parting(s, given[0], min(mass.values()))), float(4 / (spread + 1e-9)))


def score_documents(docs: DataFrame, model: Ranking) -> DataFrame:
    """Add ``score`` between 0 and 1, higher for better, and ``accepted``.

    Null text is scored as an empty one; every row is scored by its text alone.
    """
    return _accepted(docs.withColumn("score", model.score(whole_text())))


def score_featured(rows: DataFrame, model: Ranking) -> DataFrame:
    """As ``score_documents`` does, of the rows of ``featured`` documents."""
    return _accepted(rows.withColumn("score", model.score_of([F.col(c) for c in rows.columns if c != "doc_id"])))


def _accepted(scored: DataFrame) -> DataFrame:
    return scored.withColumn("accepted", F.col("score") >= ACCEPT)


def training_labels(labels: DataFrame) -> DataFrame:
    """Labels outside the held-out fold."""
    return labels.where(~id_hash_is(5, 0))


def op10_quality_classifier(spark, sf_dir: str) -> DataFrame:
    rows = featured(table(spark, sf_dir, "documents"))
    model = learn_from(rows, training_labels(table(spark, sf_dir, "labels")))
    scored = score_featured(rows, model)
    return scored.select("doc_id", id_hash_is(5, 0).alias("held_out"), "score", F.col("accepted").cast("int").alias("predicted"))
