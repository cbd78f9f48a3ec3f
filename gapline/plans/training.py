"""Feature and label tables to a model matrix, a cross-validated model and its report."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from gapline.config import ENTITY, ColumnSettings, TrainingSettings
from gapline.operators import boosting, evaluate, models
from gapline.operators.columns import drop_duplicate_ids, numeric_columns, plan_columns, present
from gapline.operators.episodes import minutes_from_start
from gapline.operators.labels import label_at_time, label_time_column
from gapline.operators.matrix import (
    add_missing_mask, apply_scaler, binarize, fit_scaler, group_holdout, project_matrix, varying_features,
)
from gapline.operators.reshape import semi_join
from gapline.sources.writers import materialize, write_json, write_parquet

PAIR = [ENTITY, "episode_idx"]
META = [ENTITY, "episode_idx", "snapshot_time", "mins_postpartum", "pregnancy_index"]


def build_matrix(
    features: DataFrame, labels: DataFrame, columns: Sequence[str] | None = None, kept: DataFrame | None = None,
    planning: ColumnSettings = ColumnSettings(), training: TrainingSettings = TrainingSettings(),
    target: str = "label", time_column: str | None = None, drop_constant: bool = False, work: str | None = None,
    force: bool = False,
) -> tuple[DataFrame, list[str]]:
    """(meta columns, `y` and float features; feature names).  Column choice happens before the scan.

    `work` names a shared folder where the matrix is stored and reused.
    """
    used = plan_columns(columns if columns is not None else features.columns, planning)
    meta = [c for c in (ENTITY, "episode_idx", "snapshot_time", "pregnancy_index") if c in features.columns]
    rows = features.select(*meta, *[F.col(f"`{c}`") for c in present(features, used)])
    rows = drop_duplicate_ids(rows, planning)
    labels = labels.withColumn(target, F.coalesce(F.col(target).cast("int"), F.lit(0)))
    if kept is not None:
        rows, labels = semi_join(rows, kept, [ENTITY]), semi_join(labels, kept, [ENTITY])
    used = [c for c in used if c in rows.columns]
    at = label_time_column(labels.columns, time_column)
    if at and at != "snapshot_time":
        labels = labels.withColumnRenamed(at, "snapshot_time")
    rows = label_at_time(rows, labels, PAIR, "snapshot_time" if at else None, target)
    rows = binarize(minutes_from_start(rows, PAIR, "snapshot_time"), target, training.positive_labels)
    shown = [c for c in META if c in rows.columns]
    matrix = project_matrix(rows.dropna(subset=["y"]), used, [*shown, "y"])
    if work:
        made = matrix
        matrix = materialize(features.sparkSession, f"{work}/matrix", lambda: made, force)
    if drop_constant:
        used = varying_features(matrix, used, training.min_variance)
        matrix = matrix.select(*shown, "y", *[F.col(f"`{c}`") for c in used])
    return matrix, used


def impute(matrix: DataFrame, features: Sequence[str], fit_rows: DataFrame | None = None, mask: bool = True):
    """Scaled features fitted on the training rows, with missing flags; (table, feature names)."""
    scaler = fit_scaler(matrix if fit_rows is None else fit_rows, features)
    names = list(features)
    if mask:
        matrix = add_missing_mask(matrix, features)
        names += [f"{c}_missing" for c in features]
    return apply_scaler(matrix, scaler, features), names


@dataclass
class Report:
    model: object
    scores: DataFrame
    metrics: DataFrame
    importance: DataFrame

    def write(self, folder: str) -> str:
        """Metrics and importances as JSON, scores as Parquet."""
        write_json(self.metrics, f"{folder}/metrics")
        write_json(self.importance, f"{folder}/importance")
        write_parquet(self.scores, f"{folder}/scores")
        return folder


def train_folds(matrix: DataFrame, features: Sequence[str], ids: Sequence[str],
                settings: TrainingSettings = TrainingSettings(), work: str | None = None) -> Report:
    """Grouped folds by episode; each fold fills and scales by its own training rows, the best area keeps its model.

    With `work`, the filled training rows of a fold are stored once (every tree level reads them), and so are the scores.
    """
    def store(table: DataFrame, name: str) -> DataFrame:
        return materialize(matrix.sparkSession, f"{work}/{name}", lambda: table, force=True)

    names = [*features, *[f"{c}_missing" for c in features]]
    model, scores, metrics = models.cross_validate(
        matrix, features, "y", PAIR, settings.folds, settings.seed, settings.even_classes, ids, settings.threshold,
        fill=True, store=store if work else None,
        trees=settings.trees, depth=settings.depth, step=settings.step, subsample=settings.subsample,
    )
    importance = models.importance_table(model, names, matrix.sparkSession)
    return Report(model, scores, metrics, importance)


def train_boosted_folds(matrix: DataFrame, features: Sequence[str], ids: Sequence[str],
                        settings: TrainingSettings = TrainingSettings(), work: str | None = None) -> Report:
    """Second-order trees on features with gaps, on folds of whole episodes dealt to the lightest fold.

    The importance table has gain, splits and cover.  With `work`, folds, binned rows, margins and scores are stored.
    """
    def store(table: DataFrame, name: str) -> DataFrame:
        return materialize(matrix.sparkSession, f"{work}/{name}", lambda: table, force=True)

    learner = models.boosted_learner(
        "y", ids, store if work else None, trees=settings.trees, depth=settings.depth, step=settings.step,
        subsample=settings.subsample, columns=settings.columns, l2=settings.l2, child_weight=settings.child_weight,
        bins=settings.bins, seed=settings.seed,
    )
    model, scores, metrics = models.cross_validate(
        matrix, features, "y", PAIR, settings.folds, settings.seed, settings.even_classes, ids, settings.threshold,
        store=store if work else None, learner=learner, greedy=True,
    )
    return Report(model, scores, metrics, boosting.importances(model.node_table(matrix.sparkSession)))


def train_holdout(matrix: DataFrame, features: Sequence[str], settings: TrainingSettings = TrainingSettings(),
                  group: Sequence[str] = tuple(PAIR)) -> Report:
    """One split by group; scaling and fit use its training part only."""
    split = group_holdout(matrix, list(group), settings.holdout_fraction, settings.seed)
    train = split.filter("is_validation = 0")
    ready, names = impute(split, features, train)
    model = models.fit_trees(
        models.weight_rows(ready.filter("is_validation = 0"), "y"), names, "y", settings.trees, settings.depth,
        settings.step, settings.subsample, settings.seed,
    )
    scores = models.score(model, ready.filter("is_validation = 1"), names)
    metrics = evaluate.ranking_metrics(scores, "y", "score")
    return Report(model, scores, metrics, models.importance_table(model, names, matrix.sparkSession))


def static_matrix(static: DataFrame, labels: DataFrame, sequences: DataFrame, entity: str = "mother_id"):
    """Numeric static columns of entities that have a label and a sequence; (table, feature names)."""
    rows = semi_join(static, sequences, [entity]).join(labels, entity).filter("y_doc IS NOT NULL")
    return rows, [c for c in numeric_columns(rows, [entity, ENTITY]) if c != "y_doc"]


def fuse(static_scores: DataFrame, sequence_scores: DataFrame, labels: DataFrame, entity: str = "mother_id",
         label: str = "y_doc", c: float = 1.0) -> DataFrame:
    """Entities with the fused probability of their static and mean sequence score."""
    both = evaluate.align_scores(static_scores, sequence_scores, labels.select(entity, label), entity)
    names = ["static_score", "sequence_score"]
    return models.score(models.fit_fusion(both, label, names, c), both, names, "fused_score")
