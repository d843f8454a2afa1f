"""Linear and factorization-machine scorers on Spark ML."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.ml import Pipeline
from pyspark.ml.classification import FMClassifier, LogisticRegression
from pyspark.ml.feature import FeatureHasher
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, functions as F


def _scorer(train: DataFrame, categorical: Sequence[str], numeric: Sequence[str], learner, label: str,
            hashed: int | None) -> Callable[[DataFrame], DataFrame]:
    """Features are hashed in each task, so no vocabulary is built or sent out.

    Unless the caller sets it, the number of slots follows the vocabulary: a power of two with
    at least 16 slots per distinct value, so few values meet in one.
    """
    if hashed is None:
        seen = train.agg(*[F.approx_count_distinct(c).alias(c) for c in categorical]).first() if categorical else []
        hashed = 1 << max(6, (16 * (sum(seen) + len(numeric)) - 1).bit_length())
    hasher = FeatureHasher(inputCols=[*categorical, *numeric], outputCol="__x", numFeatures=hashed,
                           categoricalCols=list(categorical))

    def hashable(df: DataFrame) -> DataFrame:
        # the hasher skips nulls; a stored zero would break the sparse gradient
        return df.withColumns({c: F.when(F.col(c) != 0, F.col(c)) for c in numeric})

    model = Pipeline(stages=[hasher, learner]).fit(hashable(train).withColumn("__y", F.col(label).cast("double")))

    def score(df: DataFrame) -> DataFrame:
        kept = df.withColumns({f"__keep_{c}": F.col(c) for c in numeric})
        out = model.transform(hashable(kept)).withColumn("score", vector_to_array("__p").getItem(1))
        out = out.withColumns({c: F.col(f"__keep_{c}") for c in numeric})
        return out.drop("__x", "__r", "__p", "__d", "__y", *[f"__keep_{c}" for c in numeric])
    return score


def linear_scorer(train: DataFrame, categorical: Sequence[str], numeric: Sequence[str], label: str = "label",
                  max_iter: int = 10, reg: float = 0.01, hashed: int | None = None) -> Callable[[DataFrame], DataFrame]:
    lr = LogisticRegression(featuresCol="__x", labelCol="__y", rawPredictionCol="__r", probabilityCol="__p",
                            predictionCol="__d", maxIter=max_iter, regParam=reg)
    return _scorer(train, categorical, numeric, lr, label, hashed)


def fm_scorer(train: DataFrame, categorical: Sequence[str], numeric: Sequence[str], label: str = "label",
              factors: int = 4, max_iter: int = 10, hashed: int | None = None) -> Callable[[DataFrame], DataFrame]:
    fm = FMClassifier(featuresCol="__x", labelCol="__y", rawPredictionCol="__r", probabilityCol="__p",
                      predictionCol="__d", factorSize=factors, maxIter=max_iter, seed=7)
    return _scorer(train, categorical, numeric, fm, label, hashed)
