"""Preparation and group thresholds as Spark ML pipeline stages.

``FeaturePrep`` (exact medians, population scaling), ``ClassProbability`` and
``GroupThresholds`` stand in a ``Pipeline`` beside Spark ML's own stages, so one
``PipelineModel`` is the whole bundle: saved, loaded and applied to tables or
streams by Spark ML's own means. Fitted values are Params (a few numbers a
feature, one a group) and ``transform`` is made of column expressions only: no
join, no Python worker.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark import keyword_only
from pyspark.ml import Estimator, Model, Transformer
from pyspark.ml.functions import vector_to_array
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..spec import DEFAULT_CUT, AuditSpec
from .prep import fit_medians, fit_scaling, impute
from .prep import _literal_row
from .thresholds import fit_thresholds

#: Groups that a fitted model may hold (its thresholds are driver values).
MOST_GROUPS = 10_000


class _Prep(Params):
    inputCols = Param(Params._dummy(), "inputCols", "features, prepared in place", TypeConverters.toListString)


class FeaturePrep(Estimator, _Prep, DefaultParamsReadable, DefaultParamsWritable):
    """E10-E12 as an estimator: nulls take the training median, then (x - mean) / population std. A
    feature without any training value stays null; a constant one is divided by 1."""

    @keyword_only
    def __init__(self, *, inputCols: Sequence[str] | None = None):
        super().__init__()
        self._set(**{k: list(v) for k, v in self._input_kwargs.items() if v is not None})

    def _fit(self, dataset: DataFrame) -> "FeaturePrepModel":
        cols = self.getOrDefault(self.inputCols)
        med = fit_medians(dataset, cols).first().asDict()
        sc = fit_scaling(impute(dataset, _literal_row(dataset.sparkSession, med), cols), cols).first().asDict()

        def numbers(values: dict, what: str) -> list[float]:
            return [math.nan if values[f"{c}__{what}"] is None else float(values[f"{c}__{what}"]) for c in cols]

        return FeaturePrepModel(inputCols=cols, medians=numbers(med, "median"), means=numbers(sc, "mean"), stds=numbers(sc, "std"))


class FeaturePrepModel(Model, _Prep, DefaultParamsReadable, DefaultParamsWritable):
    medians = Param(Params._dummy(), "medians", "median of each feature (NaN: none)", TypeConverters.toListFloat)
    means = Param(Params._dummy(), "means", "mean of each feature", TypeConverters.toListFloat)
    stds = Param(Params._dummy(), "stds", "population std of each feature", TypeConverters.toListFloat)

    @keyword_only
    def __init__(self, *, inputCols=None, medians=None, means=None, stds=None):
        super().__init__()
        self._set(**{k: v for k, v in self._input_kwargs.items() if v is not None})

    def _transform(self, dataset: DataFrame) -> DataFrame:
        cols = self.getOrDefault(self.inputCols)
        out = {}
        for c, med, mean, std in zip(cols, *[self.getOrDefault(p) for p in (self.medians, self.means, self.stds)], strict=True):
            x = F.col(c).cast("double")
            if not math.isnan(med):
                x = F.coalesce(x, F.lit(med))
            out[c] = F.lit(None).cast("double") if math.isnan(mean) else (x - F.lit(mean)) / F.lit(std if std else 1.0)
        return dataset.withColumns(out)


class ClassProbability(Transformer, DefaultParamsReadable, DefaultParamsWritable):
    """P(class 1) of a classifier's probability vector as a column; the classifier's own columns go."""
    outputCol = Param(Params._dummy(), "outputCol", "score column", TypeConverters.toString)
    dropCols = Param(Params._dummy(), "dropCols", "columns to drop", TypeConverters.toListString)

    @keyword_only
    def __init__(self, *, outputCol: str = "p_model", dropCols: Sequence[str] = ("features", "rawPrediction", "probability", "prediction")):
        super().__init__()
        self._setDefault(outputCol="p_model", dropCols=["features", "rawPrediction", "probability", "prediction"])
        self._set(**{k: list(v) if k == "dropCols" else v for k, v in self._input_kwargs.items()})

    def _transform(self, dataset: DataFrame) -> DataFrame:
        return dataset.withColumn(self.getOrDefault(self.outputCol), vector_to_array("probability")[1]).drop(*self.getOrDefault(self.dropCols))


class _Decision(Params):
    groupCol = Param(Params._dummy(), "groupCol", "group column", TypeConverters.toString)
    scoreCol = Param(Params._dummy(), "scoreCol", "score column", TypeConverters.toString)
    outputCol = Param(Params._dummy(), "outputCol", "decision column", TypeConverters.toString)
    flagCol = Param(Params._dummy(), "flagCol", "whether a group threshold decided", TypeConverters.toString)


class GroupThresholds(Estimator, _Decision, DefaultParamsReadable, DefaultParamsWritable):
    """H2, H3 as an estimator. ``privileged`` and ``favorable`` are integers (codes of group and label)."""
    labelCol = Param(Params._dummy(), "labelCol", "label column", TypeConverters.toString)
    privileged = Param(Params._dummy(), "privileged", "privileged group", TypeConverters.toInt)
    favorable = Param(Params._dummy(), "favorable", "favourable label", TypeConverters.toInt)
    objective = Param(Params._dummy(), "objective", "equal_opportunity or equalized_odds", TypeConverters.toString)

    @keyword_only
    def __init__(self, *, groupCol="g", labelCol="y", scoreCol="p", outputCol="pred_adj", flagCol="fairness_adjusted", privileged=1, favorable=0,
                 objective="equal_opportunity"):
        super().__init__()
        self._setDefault(groupCol="g", labelCol="y", scoreCol="p", outputCol="pred_adj", flagCol="fairness_adjusted", privileged=1, favorable=0,
                         objective="equal_opportunity")
        self._set(**self._input_kwargs)

    def _fit(self, dataset: DataFrame) -> "GroupThresholdsModel":
        group, label, score, privileged, favorable, objective = (self.getOrDefault(p) for p in (
            self.groupCol, self.labelCol, self.scoreCol, self.privileged, self.favorable, self.objective))
        spec = AuditSpec(label=label, group=group, score=score, privileged=privileged, favorable=favorable)
        fitted = fit_thresholds(dataset, spec, objective).select(F.col(group).cast("string"), "threshold").take(MOST_GROUPS + 1)
        if len(fitted) > MOST_GROUPS:
            raise ValueError(f"more than {MOST_GROUPS} groups: fit_thresholds and apply_thresholds keep them as a table")
        fitted.sort()
        return GroupThresholdsModel(groupCol=group, scoreCol=score, outputCol=self.getOrDefault(self.outputCol), flagCol=self.getOrDefault(self.flagCol),
                                    groups=[r[0] for r in fitted], thresholds=[float(r[1]) for r in fitted])


class GroupThresholdsModel(Model, _Decision, DefaultParamsReadable, DefaultParamsWritable):
    """H4, H6: ``score >= threshold of the group``; an unknown or null group has the default cut."""
    groups = Param(Params._dummy(), "groups", "group values as text", TypeConverters.toListString)
    thresholds = Param(Params._dummy(), "thresholds", "threshold of each group", TypeConverters.toListFloat)

    @keyword_only
    def __init__(self, *, groupCol=None, scoreCol=None, outputCol=None, flagCol=None, groups=None, thresholds=None):
        super().__init__()
        self._set(**{k: v for k, v in self._input_kwargs.items() if v is not None})

    def _transform(self, dataset: DataFrame) -> DataFrame:
        pairs = zip(self.getOrDefault(self.groups), self.getOrDefault(self.thresholds), strict=True)
        held = F.create_map(*[F.lit(x) for pair in pairs for x in pair])
        own = F.try_element_at(held, F.col(self.getOrDefault(self.groupCol)).cast("string"))
        decision = (F.col(self.getOrDefault(self.scoreCol)) >= F.coalesce(own, F.lit(DEFAULT_CUT))).cast("int")
        return dataset.withColumn(self.getOrDefault(self.outputCol), decision).withColumn(self.getOrDefault(self.flagCol), own.isNotNull())


def audit_pipeline(features: Sequence[str], classifier, spec: AuditSpec, out: str = "prediction"):
    """Preparation, assembly, classifier, score and group thresholds as one ``Pipeline``. ``classifier`` is a Spark ML
    classifier that reads ``features``."""
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import VectorAssembler
    return Pipeline(stages=[
        FeaturePrep(inputCols=list(features)), VectorAssembler(inputCols=list(features), outputCol="features", handleInvalid="keep"), classifier,
        ClassProbability(outputCol="p_model"),
        GroupThresholds(groupCol=spec.group, labelCol=spec.label, scoreCol="p_model", outputCol=out, privileged=int(spec.privileged), favorable=spec.favorable)])
