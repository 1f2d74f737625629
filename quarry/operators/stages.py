"""``pyspark.ml`` stages for the preprocessing the reference fits with scikit-learn.

* ``MedianStandardScaler``: median imputation, then ``(x - mean) / std`` with
  the population std of the imputed column (zero std divides by 1). MLlib's
  ``Imputer`` median is approximate and ``StandardScaler`` uses n-1, so both
  are replaced; fitting is one exact distributed quantile job plus one agg.
* ``ModeImputer``: most frequent value per column (smallest on ties).

Both transform with plain column expressions (no Python UDF) and persist
their learned values as params, so a ``PipelineModel`` holding them saves and
loads with the default ML writers.
"""

from __future__ import annotations

from pyspark import keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasInputCols, HasOutputCols
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.functions.frames import q


class _ScalerParams(HasInputCols, HasOutputCols):
    medians = Param(Params._dummy(), "medians", "learned medians", typeConverter=TypeConverters.toListFloat)
    means = Param(Params._dummy(), "means", "learned means after imputation", typeConverter=TypeConverters.toListFloat)
    scales = Param(Params._dummy(), "scales", "learned population std (1 when 0)", typeConverter=TypeConverters.toListFloat)


class MedianStandardScaler(Estimator, _ScalerParams, DefaultParamsReadable, DefaultParamsWritable):
    @keyword_only
    def __init__(self, *, inputCols=None, outputCols=None):
        super().__init__()
        self._set(**self._input_kwargs)

    def _fit(self, df: DataFrame) -> "MedianStandardScalerModel":
        from quarry.functions.stats import quartiles

        cols = self.getInputCols()
        if not cols:
            return MedianStandardScalerModel(inputCols=[], outputCols=[], medians=[], means=[], scales=[])
        med = {r["column"]: r["median"] for r in quartiles(df, cols, probs=(0.5,), names=("median",)).collect()}
        filled = [F.coalesce(q(c).cast("double"), F.lit(float(med.get(c) or 0.0))) for c in cols]
        row = df.agg(*[F.avg(e).alias(f"m{i}") for i, e in enumerate(filled)],
                     *[F.stddev_pop(e).alias(f"s{i}") for i, e in enumerate(filled)]).first()
        means = [float(row[f"m{i}"] or 0.0) for i in range(len(cols))]
        scales = [float(row[f"s{i}"]) if row[f"s{i}"] else 1.0 for i in range(len(cols))]
        return MedianStandardScalerModel(
            inputCols=cols, outputCols=self.getOutputCols(), medians=[float(med.get(c) or 0.0) for c in cols],
            means=means, scales=scales,
        )


class MedianStandardScalerModel(Model, _ScalerParams, DefaultParamsReadable, DefaultParamsWritable):
    @keyword_only
    def __init__(self, *, inputCols=None, outputCols=None, medians=None, means=None, scales=None):
        super().__init__()
        self._set(**self._input_kwargs)

    def _transform(self, df: DataFrame) -> DataFrame:
        exprs = {}
        for c, o, md, mn, sc in zip(self.getInputCols(), self.getOutputCols(), self.getOrDefault(self.medians),
                                    self.getOrDefault(self.means), self.getOrDefault(self.scales)):
            exprs[o] = (F.coalesce(q(c).cast("double"), F.lit(md)) - F.lit(mn)) / F.lit(sc)
        return df.withColumns(exprs) if exprs else df


class _ModeParams(HasInputCols, HasOutputCols):
    modes = Param(Params._dummy(), "modes", "learned most frequent values", typeConverter=TypeConverters.toListString)


class ModeImputer(Estimator, _ModeParams, DefaultParamsReadable, DefaultParamsWritable):
    @keyword_only
    def __init__(self, *, inputCols=None, outputCols=None):
        super().__init__()
        self._set(**self._input_kwargs)

    def _fit(self, df: DataFrame) -> "ModeImputerModel":
        from quarry.functions.frames import top_k, value_counts

        cols = self.getInputCols()
        modes = {}
        if cols:
            vf = value_counts(df.select(*[q(c).cast("string").alias(c) for c in cols]), cols)
            best = top_k(vf, ["column"], [F.col("cnt").desc(), F.col("str")], 1).select("column", "str").collect()
            modes = {r["column"]: r["str"] for r in best}
        return ModeImputerModel(inputCols=cols, outputCols=self.getOutputCols(),
                                modes=[modes.get(c) or "" for c in cols])


class ModeImputerModel(Model, _ModeParams, DefaultParamsReadable, DefaultParamsWritable):
    @keyword_only
    def __init__(self, *, inputCols=None, outputCols=None, modes=None):
        super().__init__()
        self._set(**self._input_kwargs)

    def _transform(self, df: DataFrame) -> DataFrame:
        exprs = {o: F.coalesce(q(c).cast("string"), F.lit(m))
                 for c, o, m in zip(self.getInputCols(), self.getOutputCols(), self.getOrDefault(self.modes))}
        return df.withColumns(exprs) if exprs else df
