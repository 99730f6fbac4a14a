"""PCA reconstruction error: rows that the leading components cannot express score high."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, functions as F


def component_count(features: int) -> int:
    return max(2, min(features // 2, 10))


@dataclass(frozen=True)
class Reconstruction:
    """Component matrix (features x components) for centred, scaled features."""

    components: np.ndarray

    def table(self, df: DataFrame, features) -> DataFrame:
        rows = [(f, k, float(v)) for f, r in zip(features, self.components) for k, v in enumerate(r)]
        return df.sparkSession.createDataFrame(rows, "feature string, component int, loading double")

    def score(self, df: DataFrame, vector, name: str = "reconstruction_raw") -> DataFrame:
        """Adds the mean squared difference between the row and its projection."""
        shared = df.sparkSession.sparkContext.broadcast(self.components)

        @F.pandas_udf("double")
        def error(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            pc = shared.value
            for batch in batches:
                x = np.array(batch.tolist(), dtype=float)
                yield pd.Series(((x - x @ pc @ pc.T) ** 2).mean(axis=1))

        return df.withColumn(name, error(vector))


def fit_reconstruction(df: DataFrame, vector, features: int) -> Reconstruction:
    data = df.select(array_to_vector(vector).alias("x"))
    model = PCA(k=component_count(features), inputCol="x", outputCol="y").fit(data)
    return Reconstruction(model.pc.toArray())
