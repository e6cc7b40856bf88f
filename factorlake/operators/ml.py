"""Models over factor values: time-ordered cross-validation, linear models, boosted trees, a small network."""

from __future__ import annotations

from abc import ABC, abstractmethod

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor, LinearRegression
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import stats as S
from ..functions.scratch import stored
from . import boost as B
from . import gram as G
from . import network as N


def row_numbers(df: DataFrame) -> DataFrame:
    """df with _i, its row's place in order of date and symbol, counted by dates first: no task sorts all rows."""
    days = df.groupBy("date").agg(F.count(F.lit(1)).alias("_n"))
    days = days.select("date", F.coalesce(F.sum("_n").over(Window.orderBy("date").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    return df.join(days, "date").withColumn("_i", F.col("_before") + F.row_number().over(Window.partitionBy("date").orderBy("symbol")) - 1).drop("_before")


def time_folds(df: DataFrame, splits: int = 5) -> DataFrame:
    """df with _i and a row for each fold (1 to splits) and part that it is in: train before the fold's test stretch, or val."""
    df = row_numbers(df)
    n = df.select(F.max("_i") + 1).first()[0] or 0
    size = n // (splits + 1)
    first = n - splits * size
    folds = F.transform(F.sequence(F.lit(1), F.lit(splits)), lambda k: F.struct(k.alias("fold"), F.when(F.col("_i") < first + (k - 1) * size, "train").when(F.col("_i") < first + k * size, "val").alias("part")))
    return df.withColumn("_f", F.explode(folds)).select("*", "_f.fold", "_f.part").where("part is not null").drop("_f")


def _ic_by_part(scored: DataFrame) -> DataFrame:
    ic = S.correlation(scored, "prediction", "_t", ["fold", "part"], "rank", large=True)
    return ic.groupBy("fold").agg(F.max(F.when(F.col("part") == "train", F.col("corr"))).alias("train_ic"), F.max(F.when(F.col("part") == "val", F.col("corr"))).alias("val_ic"))


class BaseModel(ABC):
    """fit on (features, target), predict a score column, tell the features' importance."""

    def __init__(self, params: dict | None = None, cv_splits: int = 5, seed: int = 42):
        self.params, self.cv_splits, self.seed, self.model, self.features = params or {}, cv_splits, seed, None, []

    @abstractmethod
    def estimator(self, df: DataFrame, target: str): ...

    def _vectors(self, df: DataFrame) -> DataFrame:
        return VectorAssembler(inputCols=self.features, outputCol="_x", handleInvalid="skip").transform(df)

    def fit(self, df: DataFrame, features: list[str], target: str) -> BaseModel:
        self.features = list(features)
        data = self._vectors(df.where(F.col(target).isNotNull()))
        self.model = self.estimator(data, target).fit(data)
        return self

    def predict(self, df: DataFrame, out: str = "prediction") -> DataFrame:
        if self.model is None:
            raise RuntimeError("fit the model first")
        return self.model.transform(self._vectors(df)).withColumn(out, F.col("_y")).drop("_x", "_y")

    def _weights(self) -> list[float]:
        return [abs(x) for x in self.model.coefficients]

    def get_feature_importance(self, spark) -> DataFrame:
        """feature and importance, largest first; as many rows as features."""
        rows = list(zip(self.features, map(float, self._weights())))
        return spark.createDataFrame(rows, "feature string, importance double").orderBy(F.col("importance").desc(), "feature")

    def cross_validate(self, df: DataFrame, features: list[str], target: str) -> DataFrame:
        """fold, train_ic, val_ic: Spearman correlation of prediction and target on growing stretches of time."""
        folds = stored(time_folds(df.dropna(subset=[*features, target]), self.cv_splits), "cv-rows")
        scored = None
        for k in range(1, self.cv_splits + 1):
            own = folds.where(F.col("fold") == k)
            one = type(self)(**self._settings()).fit(own.where("part = 'train'"), features, target).predict(own).select("fold", "part", F.col("prediction"), F.col(target).alias("_t"))
            scored = one if scored is None else scored.unionByName(one)
        return _ic_by_part(scored)

    def _settings(self) -> dict:
        return {"params": self.params, "cv_splits": self.cv_splits, "seed": self.seed}


class LinearModel(BaseModel):
    """Least squares with a penalty. Cross-validation fits all folds from one pass over the rows (gram.py)."""

    @abstractmethod
    def solve(self, gram: G.Gram) -> tuple: ...

    def _in_stretches(self, df: DataFrame, features: list[str], target: str) -> DataFrame:
        df = row_numbers(df.dropna(subset=[*features, target]))
        n = df.count()
        return df.withColumn("stretch", G.stretch_of(F.col("_i"), n, self.cv_splits))

    def _folds(self, rows: DataFrame, features: list[str], target: str) -> list[tuple]:
        """(coefficients, intercept) of each fold."""
        return [self.solve(g) for g in G.fold_grams(G.grams(G.gram_sums(rows, features, target), features, target, self.cv_splits))]

    def fold_coefficients(self, df: DataFrame, features: list[str], target: str) -> DataFrame:
        """fold, feature, coefficient of each fold's fit; the intercept's feature is empty."""
        folds = self._folds(self._in_stretches(df, features, target), features, target)
        rows = [(k, f, float(c)) for k, (w, b) in enumerate(folds, 1) for f, c in [*zip(features, w), ("", b)]]
        return df.sparkSession.createDataFrame(rows, "fold int, feature string, coefficient double")

    def cross_validate(self, df: DataFrame, features: list[str], target: str) -> DataFrame:
        rows = stored(self._in_stretches(df, features, target).select(*features, target, "stretch"), "cv-rows")
        folds = self._folds(rows, features, target)
        numbers = lambda x: F.array(*[F.lit(float(c)) for c in x])
        weights = F.array(*[numbers([b, *w]) for w, b in folds])
        rows = rows.withColumn("fold", F.explode(F.sequence(F.greatest("stretch", F.lit(1)), F.lit(self.cv_splits))))
        own = F.element_at(weights, F.col("fold"))
        prediction = own[0]
        for j, c in enumerate(features, 1):
            prediction = prediction + own[j] * F.col(c)
        scored = rows.select("fold", F.when(F.col("stretch") == F.col("fold"), "val").otherwise("train").alias("part"), prediction.alias("prediction"), F.col(target).alias("_t"))
        return _ic_by_part(scored)


class Ridge(LinearModel):
    """Least squares with a squared penalty alpha on the summed squares."""

    def solve(self, gram: G.Gram) -> tuple:
        return gram.ridge(self.params.get("alpha", 1.0))

    def estimator(self, df: DataFrame, target: str):
        n, sd = df.agg(F.count(F.lit(1)), F.stddev_pop(target)).first()
        # MLlib scales targets by their deviation and losses by the row count
        reg = self.params.get("alpha", 1.0) / max(n, 1) * (sd or 0.0)
        return LinearRegression(featuresCol="_x", labelCol=target, predictionCol="_y", solver="normal", elasticNetParam=0.0, regParam=reg, standardization=False)


class Lasso(LinearModel):
    """Least squares with an absolute penalty alpha on the mean squares."""

    def solve(self, gram: G.Gram) -> tuple:
        return gram.lasso(self.params.get("alpha", 1.0))

    def estimator(self, df: DataFrame, target: str):
        return LinearRegression(featuresCol="_x", labelCol=target, predictionCol="_y", elasticNetParam=1.0, regParam=self.params.get("alpha", 1.0), standardization=False, maxIter=1000, tol=1e-10)


class LeafwiseTrees(BaseModel):
    """Boosted trees of second order (boost.py): num_rounds, learning_rate, num_leaves, max_bin, reg_lambda, min_child_samples, min_split_gain and subsample as parameters."""

    def estimator(self, df: DataFrame, target: str):
        raise NotImplementedError("fit() grows the trees itself")

    def fit(self, df: DataFrame, features: list[str], target: str) -> LeafwiseTrees:
        p, self.features = self.params, list(features)
        self.model = B.fit(
            df, self.features, target, p.get("num_rounds", 500), p.get("learning_rate", 0.05), p.get("num_leaves", 31), p.get("max_bin", 255), p.get("reg_lambda", 1.0), p.get("min_child_samples", 20.0),
            p.get("min_split_gain", 0.0), p.get("subsample", 1.0), self.seed,
        )
        return self

    def predict(self, df: DataFrame, out: str = "prediction") -> DataFrame:
        if self.model is None:
            raise RuntimeError("fit the model first")
        return self.model.transform(df.dropna(subset=self.features), out)

    def _weights(self) -> list[float]:
        total = self.model.gains.sum()
        return [float(g / total) if total else 0.0 for g in self.model.gains]


class BoostedTrees(BaseModel):
    """Gradient boosted trees; num_rounds, learning_rate, max_depth and subsample as parameters."""

    def estimator(self, df: DataFrame, target: str):
        p = self.params
        return GBTRegressor(featuresCol="_x", labelCol=target, predictionCol="_y", maxIter=p.get("num_rounds", 500), stepSize=p.get("learning_rate", 0.05), maxDepth=p.get("max_depth", 5), subsamplingRate=p.get("subsample", 0.8), seed=self.seed)

    def _weights(self) -> list[float]:
        return list(self.model.featureImportances)


class Network(BaseModel):
    """A network with batch normalisation and dropout, trained where the rows lie (network.py): hidden, epochs, rate, batch, dropout, patience and rows (of a task) as parameters."""

    def estimator(self, df: DataFrame, target: str):
        raise NotImplementedError("fit() trains by itself")

    def fit(self, df: DataFrame, features: list[str], target: str) -> Network:
        p, self.features = self.params, list(features)
        self.model = N.fit(
            df, self.features, target, p.get("hidden", (128, 64, 32)), p.get("epochs", 100), p.get("rate", 1e-3), p.get("batch", 1024), p.get("dropout", 0.2), p.get("held", 0.2), p.get("patience", 10),
            self.seed, p.get("rows", 200_000),
        )
        return self

    def predict(self, df: DataFrame, out: str = "prediction") -> DataFrame:
        if self.model is None:
            raise RuntimeError("fit the model first")
        return self.model.transform(df.dropna(subset=self.features), out)

    def _weights(self) -> list[float]:
        return self.model.net.reach().tolist()


MODELS = {"ridge": Ridge, "lasso": Lasso, "lightgbm": LeafwiseTrees, "xgboost": LeafwiseTrees, "gbt": BoostedTrees, "nn": Network}
