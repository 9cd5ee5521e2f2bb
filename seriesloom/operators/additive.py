"""Per-key additive regression: trend, yearly and weekly waves, holidays, regressors.

The normal equations of a key are sums of products, merged from partial sums of every task, so a key's rows are never
gathered. The system of a key is one array column, which the sweep operator solves; no Python runs.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seriesloom.operators.impute import join_on_keys
from seriesloom.operators.linear import products_by_key, solved_by_key
from seriesloom.spec import PanelSpec

COMPONENTS = ("trend", "yearly", "weekly", "holidays", "regressors")


@dataclass(frozen=True)
class AdditiveModel:
    """Settings of the additive regression.

    ``regressors`` and ``holidays`` are numeric columns known for future rows.
    """

    spec: PanelSpec
    changepoints: int = 10
    changepoint_range: float = 0.8
    yearly_order: int = 6
    weekly_order: int = 3
    regressors: Sequence[str] = ()
    holidays: Sequence[str] = ()
    interval_width: float = 0.8
    ridge: float = 1.0
    floor_zero: bool = True
    min_rows: int = 4

    def _waves(self) -> list[tuple[str, float, int]]:
        weekly = self.weekly_order if self.spec.freq.base in ("D", "H", "B") else 0
        return [("yearly", 365.25, self.yearly_order), ("weekly", 7.0, weekly)]

    def _terms(self) -> dict[str, list[Column]]:
        """Regressors of each component as expressions of ``_t`` (0 to 1 over the known rows) and ``_day``."""
        t = F.col("_t")
        knots = [self.changepoint_range * (i + 1) / self.changepoints for i in range(self.changepoints)]
        terms = {"trend": [F.lit(1.0), t, *[F.greatest(t - k, F.lit(0.0)) for k in knots]]}
        for name, period, order in self._waves():
            angle = 2 * math.pi * F.col("_day") / period
            terms[name] = [f(i * angle) for i in range(1, order + 1) for f in (F.sin, F.cos)]
        terms["holidays"] = [F.col(c) for c in self.holidays]
        terms["regressors"] = [F.col(c) for c in self.regressors]
        return terms

    def _rows(self, history: DataFrame, future: DataFrame | None) -> DataFrame:
        """History and future rows with ``y`` (null in the future), ``_day``, ``_t`` and the number of known rows of the key."""
        spec, extra = self.spec, [*self.holidays, *self.regressors]
        cols = [*spec.key_cols, spec.date_col, *extra]
        known = F.nanvl(F.col(spec.target_col).cast("double"), F.lit(None).cast("double"))
        rows = history.select(*cols, known.alias("y"))
        if future is not None:
            rows = rows.unionByName(future.select(*cols, F.lit(None).cast("double").alias("y")))
        day = F.unix_seconds(F.col(spec.date_col).cast("timestamp")) / 86400.0
        rows = rows.withColumn("_day", day).withColumns({c: F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in extra})
        seen = F.when(F.col("y").isNotNull(), F.col("_day"))
        first, last = F.min(seen).over(spec.per_key()), F.max(seen).over(spec.per_key())
        rows = rows.withColumns({"_known": F.count("y").over(spec.per_key()), "_t": (F.col("_day") - first) / F.greatest(last - first, F.lit(1.0))})
        return rows

    def _solved(self, rows: DataFrame) -> DataFrame:
        """(keys, _beta): the coefficients of every key with enough known rows, in the order of ``_terms``."""
        terms = [x for part in self._terms().values() for x in part]
        used = rows.filter(F.col("y").isNotNull() & (F.col("_known") >= self.min_rows))
        products = products_by_key(used, self.spec.key_cols, [*terms, F.col("y")])
        # The ridge lies on the diagonal.
        return solved_by_key(products, self.spec.key_cols, [1e-8 if i < 2 else self.ridge * 0.01 for i in range(len(terms))])

    def coefficients(self, history: DataFrame) -> DataFrame:
        """``(keys, component, term, value)``: the fitted coefficients; keys with too few known rows have none."""
        named = [F.struct(F.lit(c).alias("component"), F.lit(i).alias("term")) for c, part in self._terms().items() for i in range(len(part))]
        solved = self._solved(self._rows(history, None))
        return solved.select(*self.spec.key_cols, F.posexplode("_beta").alias("_i", "value")).select(*self.spec.key_cols, F.get(F.array(*named), F.col("_i")).alias("_n"), "value").select(*self.spec.key_cols, "_n.*", "value")

    def components(self, history: DataFrame, future: DataFrame | None = None) -> DataFrame:
        """Fitted and future rows: components, ``yhat`` and its interval; null for a key with too few known rows.

        Rows of ``future`` carry the keys, the date and the regressor columns.
        """
        keys = list(self.spec.key_cols)
        rows = self._rows(history, future)
        fitted = join_on_keys(rows, self._solved(rows), keys)
        parts, at_ = {}, 0
        for name in COMPONENTS:
            terms = self._terms().get(name, [])
            total = sum((x * F.get("_beta", F.lit(at_ + i)) for i, x in enumerate(terms)), F.lit(0.0))
            parts[name] = F.when(F.col("_beta").isNotNull(), total)
            at_ += len(terms)
        made = fitted.withColumns(parts).withColumn("_yhat", sum((F.col(c) for c in COMPONENTS), F.lit(0.0)))
        tail = (1 - self.interval_width) / 2
        off = made.groupBy(*keys).agg(F.percentile(F.col("y") - F.col("_yhat"), [tail, 1 - tail]).alias("_off"))
        bounded = join_on_keys(made, off, keys)
        bounds = {"yhat": F.col("_yhat"), "yhat_lower": F.col("_yhat") + F.get("_off", F.lit(0)), "yhat_upper": F.col("_yhat") + F.get("_off", F.lit(1))}
        if self.floor_zero:
            bounds = {k: F.when(v.isNotNull(), F.greatest(v, F.lit(0.0))) for k, v in bounds.items()}
        return bounded.select(*keys, self.spec.date_col, "y", *COMPONENTS, *[v.alias(k) for k, v in bounds.items()])

    def predict(self, history: DataFrame, future: DataFrame) -> DataFrame:
        """``(keys, date, yhat, yhat_lower, yhat_upper)`` of the future rows."""
        made = self.components(history, future).filter(F.col("y").isNull())
        starts = history.groupBy(*self.spec.key_cols).agg(F.max(F.when(F.col(self.spec.target_col).isNotNull(), F.col(self.spec.date_col))).alias("_last"))
        after = join_on_keys(made, starts, self.spec.key_cols).filter(F.col(self.spec.date_col) > F.col("_last"))
        return after.select(*self.spec.key_cols, self.spec.date_col, "yhat", "yhat_lower", "yhat_upper")
