"""One linear model per quantile, by iteratively reweighted least squares.

The pinball loss of a residual ``r`` is ``|r| / 2 + (q - 1/2) r``. Around the residuals of the last round, ``|r|`` lies below a
parabola of weight ``1 / |r|``, so a round is one weighted least-squares problem and never raises the loss. A round reads the
stored rows once: every task adds its rows into the normal equations of all quantiles, Spark sums these by position, and the
driver solves systems whose size is the number of features.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.ml.functions import vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seriesloom.operators.features import FeatureBuilder
from seriesloom.operators.learners import PanelRegressor, quantile_name


class PinballRegressor(PanelRegressor):
    """Linear quantile models over the features of a builder, all quantiles in the same passes.

    Missing features and keys enter as in :class:`PanelRegressor`. ``smoothing`` times the deviation of the label bounds the
    weight of a row that a model meets exactly. Rounds end when no quantile's loss falls by more than the share ``tolerance``,
    at the latest after ``max_iter``. A feature that is constant or repeats others takes the solution of least norm. A label
    that never varies is its own quantile. No labelled row at all is an error.
    """

    def __init__(
        self, builder: FeatureBuilder, quantiles: Sequence[float] = (0.1, 0.5, 0.9), features: Sequence[str] | None = None,
        max_iter: int = 60, tolerance: float = 1e-5, smoothing: float = 1e-3,
    ):
        super().__init__(builder, {"objective": "pinball"}, features)
        if not all(0.0 < q < 1.0 for q in quantiles):
            raise ValueError("quantiles lie between 0 and 1")
        self.quantiles = sorted(quantiles)
        self.max_iter, self.tolerance, self.smoothing = max_iter, tolerance, smoothing
        #: Rows: quantiles; columns: intercept, then the vector's entries, in units of the features.
        self.solved: np.ndarray | None = None
        #: Mean loss per quantile before each round but the first, which is plain least squares.
        self.losses: list[np.ndarray] = []

    def fit(self, train: DataFrame, label: str, valid: DataFrame | None = None, weight: str | None = None) -> PinballRegressor:
        """Fit on rows with features and ``label``; rows of ``valid`` are not used, a row without ``weight`` has weight 1."""
        rows = train.filter(F.col(label).isNotNull())
        self._learn_encodings(rows, label)
        encoded = self.encode(rows)
        self._learn_fills(encoded)
        share = F.coalesce(F.col(weight).cast("double"), F.lit(1.0)) if weight else F.lit(1.0)
        data = self._vectors(encoded).select("_raw", F.col(label).cast("double").alias("y"), share.alias("w")).persist()
        try:
            y = data.agg(F.avg("y").alias("mean"), F.stddev_pop("y").alias("deviation"), F.sum("w").alias("total")).first()
            if not y.total:
                raise ValueError("no labelled row with a positive weight")
            x = data.select(Summarizer.metrics("mean", "std").summary(F.col("_raw")).alias("x")).first().x
            stored = data.select(vector_to_array("_raw").alias("x"), "y", "w")
            self._iterate(stored, np.array(x["mean"]), np.array(x["std"]), y.mean, y.deviation, y.total)
        finally:
            data.unpersist()
        return self

    def _iterate(self, data: DataFrame, centre: np.ndarray, spread: np.ndarray, level: float, deviation: float, total: float) -> None:
        spread = np.where(spread > 0, spread, 1.0)
        qs, size = np.array(self.quantiles), len(centre) + 1
        smallest = self.smoothing * deviation
        beta, self.losses = None, []
        # A label that never varies is met by the first round.
        for _ in range(self.max_iter if deviation > 0 else 1):
            gram, right, loss = normal_equations(data, centre, spread, level, qs, beta, smallest)
            if beta is not None:
                self.losses.append(loss / total)
                if len(self.losses) > 1 and np.all(self.losses[-2] - self.losses[-1] <= self.tolerance * self.losses[-2]):
                    break
            beta = np.stack([np.linalg.lstsq(gram[j], right[j], rcond=1e-12)[0] for j in range(len(qs))])
        assert beta.shape == (len(qs), size)
        slopes = beta[:, 1:] / spread
        self.solved = np.column_stack([beta[:, 0] + level - slopes @ centre, slopes])

    def coefficients(self) -> dict[float, Mapping[str, float]]:
        """Per quantile the intercept and the slope of every entry of the vector."""
        names = ["intercept", *self.vector_names]
        return {q: dict(zip(names, map(float, row), strict=True)) for q, row in zip(self.quantiles, self._fitted(), strict=True)}

    def _fitted(self) -> np.ndarray:
        if self.solved is None:
            raise RuntimeError("fit the model first")
        return self.solved

    def predict(self, df: DataFrame, encoded: bool = False) -> DataFrame:
        """Adds one column per quantile, such as ``q0_10``, sorted within the row so that they never cross."""
        names, rows = [quantile_name(q) for q in self.quantiles], self._fitted()
        x = vector_to_array("_raw")

        def line(row: np.ndarray) -> Column:
            parts = F.zip_with(x, F.array(*[F.lit(float(v)) for v in row[1:]]), lambda a, b: a * b)
            return F.aggregate(parts, F.lit(float(row[0])), lambda s, v: s + v)

        out = self._vectors(df if encoded else self.encode(df)).withColumn("_q", F.array_sort(F.array(*[line(row) for row in rows])))
        return out.select("*", *[F.get("_q", F.lit(i)).alias(n) for i, n in enumerate(names)]).drop("_raw", "_q")


def normal_equations(
    data: DataFrame, centre: np.ndarray, spread: np.ndarray, level: float, quantiles: np.ndarray, beta: np.ndarray | None, smallest: float
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per quantile the matrix, right side and loss of the next round, over rows ``(x array, y, w)``.

    Without ``beta`` the round is plain least squares. A task returns one array of ``quantiles * (d * d + d + 1)`` numbers
    whatever its number of rows; they are summed by position, so the driver receives one such array.
    """
    size, count = len(centre) + 1, len(quantiles)

    def partial(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums = np.zeros((count, size * size + size + 1))
        for part in parts:
            if part.empty:
                continue
            scaled = (np.stack(part["x"].to_numpy()) - centre) / spread
            x = np.column_stack([np.ones(len(part)), scaled])
            y, w = part["y"].to_numpy() - level, part["w"].to_numpy()
            for j, q in enumerate(quantiles):
                if beta is None:
                    weight, tilt, loss = w, 0.0, 0.0
                else:
                    rest = y - x @ beta[j]
                    weight, tilt = w / (smallest + np.abs(rest)), 2.0 * q - 1.0
                    loss = np.sum(w * rest * (q - (rest < 0)))
                matrix = (x * weight[:, None]).T @ x
                sums[j] += np.concatenate([matrix.ravel(), x.T @ (weight * y + tilt * w), [loss]])
        yield pd.DataFrame({"v": [sums.ravel()]})

    cells = data.mapInPandas(partial, "v array<double>").select(F.posexplode("v").alias("i", "v"))
    flat = np.zeros(count * (size * size + size + 1))
    for row in cells.groupBy("i").agg(F.sum("v").alias("v")).collect():
        flat[row.i] = row.v
    by = flat.reshape(count, -1)
    return by[:, : size * size].reshape(count, size, size), by[:, size * size : -1], by[:, -1]


class PinballForecaster:
    """Quantile forecasts one step ahead, each quantile with a model of its own; needs no calibration part.

    :class:`~seriesloom.operators.learners.QuantileForecaster` is the other form: one model and the quantiles of its errors.
    """

    def __init__(self, builder: FeatureBuilder, quantiles: Sequence[float] = (0.1, 0.5, 0.9), features: Sequence[str] | None = None, **settings):
        self.builder = builder
        self.regressor = PinballRegressor(builder, quantiles, features, **settings)

    def fit(self, train: DataFrame) -> PinballForecaster:
        self.builder = self.regressor.builder = self.builder.fitted(train)
        self.regressor.fit(self.builder.transform(train), self.builder.spec.target_col)
        return self

    def predict(self, df: DataFrame, history: DataFrame | None = None) -> DataFrame:
        """``(keys, date, q..)`` for the rows of ``df``; ``history`` supplies their lags."""
        spec = self.builder.spec
        rows = df.withColumn("_new", F.lit(True))
        if history is not None:
            rows = rows.unionByName(history.withColumn("_new", F.lit(False)), allowMissingColumns=True)
        made = self.regressor.predict(self.builder.transform(rows).filter("_new"))
        return made.select(*spec.key_cols, spec.date_col, *[quantile_name(q) for q in self.regressor.quantiles])
