"""Batch scoring (M22, M23) with fitted models and the calibrated ensemble.

A scorer evaluates Arrow batches of raw feature columns in one pass: its models travel as one broadcast, and several
probabilities of a row (of changed feature values, of each fold) come from the same pass.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from churnkit import constants as K
from churnkit.functions.columns import probability_pct, risk_tier, round_probability
from churnkit.ml import ensemble
from churnkit.ml.calibrate import Calibrator
from churnkit.ml.ensemble import Model, Trees, evaluate
from churnkit.ml.features import Encoder, Rows
from churnkit.operators.clean import prepare_scoring_input, require_columns
from churnkit.sources import artifacts


@dataclass(frozen=True)
class _Plain:
    """A model's probability, or its log-odds."""

    model: Model
    margin: bool

    def __call__(self, rows: Rows) -> np.ndarray:
        return self.model.margin(rows) if self.margin else self.model.probability(rows)


@dataclass(frozen=True)
class _Calibrated:
    """The mean of each fold's calibrated probability."""

    pairs: tuple[tuple[Model, Calibrator], ...]

    def __call__(self, rows: Rows) -> np.ndarray:
        return np.mean([c.apply(m.margin(rows) if c.margin else m.probability(rows)) for m, c in self.pairs], axis=0)


def _probabilities(sent: tuple, rows: Rows) -> np.ndarray:
    """A row's probability, and that with each of the given (column, level) changes."""
    function, changes = sent
    found = [function(rows)]
    for column, level in changes:
        own = rows.level.copy()
        own[:, column] = level
        found.append(function(Rows(rows.encoder, rows.num, own)))
    return np.stack(found, axis=1)


class Scorer:
    """Anything that turns feature rows into a churn probability."""

    def __init__(self, encoder: Encoder, function) -> None:
        self.encoder, self.function, self._sent = encoder, function, {}

    def column(self, df: DataFrame, changes: dict[str, str] | None = None, function=None) -> Column:
        """``array<double>``: the probability of each row, then that with each single change of a column's value."""
        names = list(self.encoder.levels)
        steps = []
        for c, value in (changes or {}).items():
            own = self.encoder.levels[c]
            steps.append((names.index(c), own.index(value) if value in own else -1))
        spark = df.sparkSession
        key = (spark.sparkContext.applicationId, tuple(steps), id(function))
        if key not in self._sent:
            self._sent[key] = spark.sparkContext.broadcast((function or self.function, steps))
        return evaluate(df, self.encoder, _probabilities, self._sent[key])

    def transform(self, df: DataFrame, out: str = "p") -> DataFrame:
        return df.withColumn(out, self.column(df)[0])

    def release(self) -> None:
        """Drop what was sent; frames that score with it can no longer be run."""
        for sent in self._sent.values():
            sent.destroy()
        self._sent = {}


class ModelScorer(Scorer):
    """Churn probability of one model (or, with ``margin``, its log-odds)."""

    def __init__(self, model: Model) -> None:
        super().__init__(model.encoder, _Plain(model.lean(), False))
        self.model = model

    def transform(self, df: DataFrame, out: str = "p", margin: bool = False) -> DataFrame:
        return df.withColumn(out, self.column(df, function=self._margin() if margin else None)[0])

    def _margin(self) -> _Plain:
        if not hasattr(self, "_as_margin"):
            self._as_margin = _Plain(self.model.lean(), True)
        return self._as_margin


@dataclass(frozen=True)
class _Share:
    """What some trees of a forest add to its probability; ``trees`` counts all of them."""

    model: Trees
    trees: int

    def __call__(self, rows: Rows) -> np.ndarray:
        return self.model.margin(rows) * (len(self.model.roots) / self.trees)


def write_forest_scores(df: DataFrame, path: str, forest: str, name: str, keep: list[str]) -> None:
    """Write ``keep`` columns, ``name`` and ``p`` by the forest whose folder is ``forest``.  A slice of it is sent at a time; the rows and the
    sum so far are written in between."""
    spark, before = df.sparkSession, None
    slices = ensemble.slices(spark, forest)
    found = next(slices, None)
    rows, step = df.withColumn("p", F.lit(0.0)), 0
    while found is not None:
        model, trees = found
        found = next(slices, None)  # the last slice writes the result
        scorer = Scorer(model.encoder, _Share(model, trees))
        scored = rows.withColumn("p", F.col("p") + scorer.column(rows)[0])
        if found is None:
            scored.select(*keep, F.lit(name).alias("name"), "p").write.mode("overwrite").parquet(path)
        else:
            scored.write.mode("overwrite").parquet(f"{path}-{step}")
            rows = spark.read.parquet(f"{path}-{step}")
        scorer.release()
        if before:
            artifacts.remove(spark, before)
        before, step = f"{path}-{step}", step + 1


class CalibratedScorer(Scorer):
    """Average of per-fold (base model -> calibrator) probabilities."""

    def __init__(self, pairs: list[tuple[Model, Calibrator]]) -> None:
        super().__init__(pairs[0][0].encoder, _Calibrated(tuple((m.lean(), c) for m, c in pairs)))
        self.pairs = pairs


def _of_fold(sent: dict[str, list[Model]], rows: Rows) -> np.ndarray:
    """Probabilities of every model of every candidate, side by side."""
    return np.stack([m.probability(rows) for own in sent.values() for m in own], axis=1)


def candidate_scores(df: DataFrame, models: dict[str, list[Model]], keep: list[str]) -> DataFrame:
    """``keep`` columns, ``name`` and ``p``: one pass scores every row with all models of all candidates.  A row with a ``fold`` takes the
    model of that number of each candidate, any other row the last one."""
    sent = df.sparkSession.sparkContext.broadcast(models)
    encoder = next(iter(models.values()))[-1].encoder
    scored = df.select(*keep, "fold", evaluate(df, encoder, _of_fold, sent).alias("_all"))
    items, at = [], 0
    for name, own in models.items():
        place = F.lit(at) + (F.coalesce(F.col("fold"), F.lit(len(own) - 1)) if len(own) > 1 else F.lit(0))
        items.append(F.struct(F.lit(name).alias("name"), F.element_at("_all", (place + 1).cast("int")).alias("p")))
        at += len(own)
    return scored.select(*keep, "fold", F.explode(F.array(*items)).alias("_s")).select(*keep, "fold", "_s.name", "_s.p")


def score_customers(raw_df: DataFrame, scorer, feature_columns: list[str] | None = None) -> DataFrame:
    """Raw (unlabeled) rows in; id (if present), churn_probability (4 dp) and
    churn_probability_pct (1 dp from the unrounded p) out.  Empty in -> empty out."""
    features = prepare_scoring_input(raw_df)
    require_columns(features, feature_columns or K.FEATURE_COLUMNS, "raw_df")
    keep = [K.ID_COLUMN] if K.ID_COLUMN in features.columns else []
    scored = scorer.transform(features.select(*keep, *(feature_columns or K.FEATURE_COLUMNS)))
    return scored.select(*keep, round_probability(F.col("p")).alias("churn_probability"),
                         probability_pct(F.col("p")).alias("churn_probability_pct"))


def classify_scored_customers(raw_df: DataFrame, scorer) -> DataFrame:
    """Score + risk tier (from the 4-dp probability)."""
    s = score_customers(raw_df, scorer)
    return s.withColumn("risk_tier", risk_tier(F.col("churn_probability")))


__all__ = ["Scorer", "ModelScorer", "CalibratedScorer", "candidate_scores", "score_customers", "classify_scored_customers"]
