"""Steps of a training pipeline that MLlib lacks: sublinear counts, and the sum of two vectors of the same terms."""

from __future__ import annotations

import numpy as np
from pyspark import keyword_only
from pyspark.ml import Transformer
from pyspark.ml.linalg import SparseVector, Vectors, VectorUDT
from pyspark.ml.param.shared import HasInputCol, HasInputCols, HasOutputCol
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _sublinear(v: SparseVector) -> SparseVector:
    return Vectors.sparse(v.size, v.indices, 1 + np.log(v.values))


def _plus(a: SparseVector, b: SparseVector) -> SparseVector:
    return Vectors.sparse(a.size, a.indices, a.values + b.toArray()[a.indices])


class Sublinear(Transformer, HasInputCol, HasOutputCol, DefaultParamsReadable, DefaultParamsWritable):
    """1 + ln of each count."""

    @keyword_only
    def __init__(self, *, inputCol: str | None = None, outputCol: str | None = None):
        super().__init__()
        self._set(**self._input_kwargs)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        return dataset.withColumn(self.getOutputCol(), F.udf(_sublinear, VectorUDT())(self.getInputCol()))


class Plus(Transformer, HasInputCols, HasOutputCol, DefaultParamsReadable, DefaultParamsWritable):
    """The sum of two vectors, at the places of the first."""

    @keyword_only
    def __init__(self, *, inputCols: list[str] | None = None, outputCol: str | None = None):
        super().__init__()
        self._set(**self._input_kwargs)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        return dataset.withColumn(self.getOutputCol(), F.udf(_plus, VectorUDT())(*self.getInputCols()))
