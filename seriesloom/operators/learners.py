"""Learned forecasters: one model over all series of a panel, boosted trees or a linear model of MLlib.

Features are built once on whole series and then split, since they look back
only. Keys enter as smoothed target means fitted on the training rows, which
works for any number of keys.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from copy import copy
from dataclasses import replace

from pyspark import StorageLevel
from pyspark.ml import Estimator, PipelineModel, Transformer
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.regression import GeneralizedLinearRegression, LinearRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seriesloom.operators.blocks import Blocks
from seriesloom.operators.boosting import TRAIN, VALID, Bins, Boosted, Job, boost
from seriesloom.operators.encode import apply_target_encoding, fit_target_encoding, fit_target_encodings
from seriesloom.operators.features import FeatureBuilder, causal_features, next_step_features
from seriesloom.operators.impute import join_on_keys
from seriesloom.operators.recurrence import alpha_of_halflife, ewm_mean, ewm_name
from seriesloom.operators.windows import lead_target
from seriesloom.session import dealt, reliable_checkpoint

# Variance power of the default objective and its learning rate.
DEFAULT_PARAMS = {"objective": "tweedie", "variance_power": 1.2, "learning_rate": 0.05, "max_iter": 40, "max_depth": 5}
#: Key means up to this counted number go to every executor; rows with features then need no exchange.
BROADCAST_KEYS = 1_000_000


def is_tree(params: Mapping) -> bool:
    """Whether the objective is one of boosted trees: squared or absolute error."""
    return params["objective"] in ("regression", "regression_l1")


def make_estimator(params: Mapping, features: str, label: str, weight: str | None = None) -> Estimator:
    """MLlib estimator of an objective that a linear model fits.

    ``least_squares`` is the plain linear model, without a penalty unless ``l2`` is given.
    """
    p = {**DEFAULT_PARAMS, **params}
    objective = p["objective"]
    weighted = {"weightCol": weight} if weight else {}
    common = {"featuresCol": features, "labelCol": label, "predictionCol": "yhat", "regParam": p.get("l2", 0.1), **weighted}
    if objective == "least_squares":
        return LinearRegression(solver="normal", **{**common, "regParam": p.get("l2", 0.0)})
    if objective == "huber":
        return LinearRegression(loss="huber", **common)
    if objective == "tweedie":
        return GeneralizedLinearRegression(family="tweedie", variancePower=p["variance_power"], linkPower=0.0, **common)
    if objective == "poisson":
        return GeneralizedLinearRegression(family="poisson", link="log", **common)
    raise ValueError(f"unknown objective: {objective}")


class PanelRegressor:
    """Key encoding, filling, and one model: boosted trees, or a linear one over scaled vectors.

    A missing feature takes the mean of the training rows. Features that training
    rows lacked have a second column ``<feature>_missing`` of 0 and 1.
    """

    def __init__(self, builder: FeatureBuilder, params: Mapping | None = None, features: Sequence[str] | None = None):
        self.builder = builder
        self.params = {**DEFAULT_PARAMS, **(params or {})}
        self.inputs = list(features or [*builder.feature_names, *[f"{k}_te" for k in builder.spec.key_cols]])
        self.encodings: dict[str, DataFrame] = {}
        self.fills: dict[str, float] = {}
        self.flagged: list[str] = []
        self.model: Transformer | Boosted | None = None

    @property
    def vector_names(self) -> list[str]:
        """Names of the vector's entries, in order."""
        return [*self.inputs, *[f"{c}_missing" for c in self.flagged]]

    @property
    def is_tree(self) -> bool:
        return is_tree(self.params)

    @staticmethod
    def _known(c: str) -> Column:
        return F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double"))

    def _learn_fills(self, train: DataFrame) -> None:
        """Mean and presence of missing values of every feature: two numbers per feature on the driver."""
        means = [F.avg(self._known(c)).alias(f"m{i}") for i, c in enumerate(self.inputs)]
        gaps = [F.count(F.when(self._known(c).isNull(), 1)).alias(f"g{i}") for i, c in enumerate(self.inputs)]
        row = train.agg(*means, *gaps).first()
        self.fills = {c: row[f"m{i}"] if row[f"m{i}"] is not None else 0.0 for i, c in enumerate(self.inputs)}
        self.flagged = [c for i, c in enumerate(self.inputs) if row[f"g{i}"]]

    def _values(self) -> dict[str, Column]:
        """The vector's entries by name."""
        filled = {c: F.coalesce(self._known(c), F.lit(self.fills[c])) for c in self.inputs}
        return filled | {f"{c}_missing": self._known(c).isNull().cast("double") for c in self.flagged}

    def _vectors(self, df: DataFrame) -> DataFrame:
        values = self._values().values()
        names = [f"_x{i}" for i in range(len(values))]
        filled = df.withColumns(dict(zip(names, values, strict=True)))
        return VectorAssembler(inputCols=names, outputCol="_raw").transform(filled).drop(*names)

    def encode(self, df: DataFrame) -> DataFrame:
        wanted = {k: v for k, v in self.encodings.items() if k == "__global_mean__" or f"{k}_te" in self.inputs}
        return apply_target_encoding(df, wanted) if len(wanted) > 1 else df

    @property
    def encoded_keys(self) -> list[str]:
        """Keys that enter as means of the label."""
        return [k for k in self.builder.spec.key_cols if f"{k}_te" in self.inputs]

    def _learn_encodings(self, rows: DataFrame, label: str) -> None:
        keys = self.encoded_keys
        if not keys:
            return
        stored = {k: reliable_checkpoint(v) for k, v in fit_target_encoding(rows, keys, label).items()}
        self.encodings = {k: F.broadcast(v) if k in keys and v.count() <= BROADCAST_KEYS else v for k, v in stored.items()}

    def labelled(self, train: DataFrame, label: str, valid: DataFrame | None = None) -> DataFrame:
        """Encoded rows with a label and ``_valid``, after key means are learned from ``train``."""
        rows = train.filter(F.col(label).isNotNull())
        self._learn_encodings(rows, label)
        rows = rows.withColumn("_valid", F.lit(False))
        if valid is not None:
            rows = rows.unionByName(valid.filter(F.col(label).isNotNull()).withColumn("_valid", F.lit(True)))
        return self.encode(rows)

    @staticmethod
    def _share(weight: str | None) -> Column:
        return F.coalesce(F.col(weight).cast("double"), F.lit(1.0)) if weight else F.lit(1.0)

    def prepare(self, encoded: DataFrame, label: str, weight: str | None = None) -> DataFrame:
        """``(_label, _raw, _weight)`` of encoded rows, after fills are learned from them."""
        self._learn_fills(encoded)
        return self._vectors(encoded).select(F.col(label).cast("double").alias("_label"), "_raw", self._share(weight).alias("_weight"))

    def learn(self, data: DataFrame, weighted: bool = False) -> PanelRegressor:
        """Fit a linear model on what :meth:`prepare` made, best persisted: a model passes over it several times."""
        use = "_weight" if weighted else None
        scaler = StandardScaler(inputCol="_raw", outputCol="_std", withMean=True).fit(data)
        self.model = PipelineModel([scaler, make_estimator(self.params, "_std", "_label", use).fit(scaler.transform(data))])
        return self

    def stored(self, encoded: DataFrame, label: str, part: Column, weight: str | None = None) -> Blocks:
        """Blocks of encoded rows: features, ``_label``, ``_part`` and ``_weight``."""
        spec = self.builder.spec
        ids = [c for c in (*spec.key_cols, spec.date_col) if c in encoded.columns]
        more = {"_label": F.col(label), "_part": part, "_weight": self._share(weight)}
        return Blocks.of(encoded.withColumns(more), [*self.inputs, *more], ids)

    def grow(self, store: Blocks, sets: Sequence[Mapping], part: str = "_part", early: bool = False, names: Sequence[str] = (), judge=None) -> list[PanelRegressor]:
        """Trees of every parameter set on stored blocks; all grow in the same passes. ``names`` are the inputs' columns there."""
        params = [{**DEFAULT_PARAMS, **p} for p in sets]
        names = list(names or self.inputs)
        models, bins = boost(store, names, [Job(p, "_label", part, names, early) for p in params], judge)
        return [self.with_params(p).with_trees(m, bins, names) for p, m in zip(params, models, strict=True)]

    def with_trees(self, model: Boosted, bins: Bins, names: Sequence[str]) -> PanelRegressor:
        """Takes over trees that grew on columns ``names``."""
        own = dict(zip(names, self.inputs, strict=True))
        self.fills = {own[n]: float(m) for n, m in zip(bins.names, bins.means, strict=True) if n in own}
        self.flagged = [own[n] for n in names if n in bins.flagged]
        self.model = replace(model, columns=self.vector_names)
        return self

    def with_params(self, params: Mapping) -> PanelRegressor:
        """The same prepared rows with other parameters, not fitted yet."""
        other = copy(self)
        other.params, other.model = {**DEFAULT_PARAMS, **params}, None
        return other

    def fit(self, train: DataFrame, label: str, valid: DataFrame | None = None, weight: str | None = None) -> PanelRegressor:
        """Fit on rows with features and ``label``; ``valid`` stops the boosting early.

        ``weight`` names a column of row weights; a row without one has weight 1.
        """
        if self.is_tree:
            part = F.when(F.col("_valid"), VALID).otherwise(TRAIN)
            store = self.stored(self.labelled(train, label, valid), label, part, weight)
            try:
                fitted = self.grow(store, [self.params], early=valid is not None)[0]
            finally:
                store.drop()
            self.fills, self.flagged, self.model = fitted.fills, fitted.flagged, fitted.model
            return self
        data = self.prepare(self.labelled(train, label), label, weight).persist()
        try:
            return self.learn(data, weight is not None)
        finally:
            data.unpersist()

    def scored(self, names: Sequence[str]) -> Column:
        """The prediction of trees from columns ``names``, which hold the inputs."""
        own = dict(zip(self.inputs, names, strict=True))
        filled = {c: F.coalesce(self._known(own[c]), F.lit(self.fills[c])) for c in self.inputs}
        values = filled | {f"{c}_missing": self._known(own[c]).isNull().cast("double") for c in self.flagged}
        return self.model.expression(lambda c: values[c])

    def predict(self, df: DataFrame, encoded: bool = False) -> DataFrame:
        """Adds ``yhat``."""
        if self.model is None:
            raise RuntimeError("fit the model first")
        rows = df if encoded else self.encode(df)
        if isinstance(self.model, Boosted):
            values, names = self._values(), {c: f"_x{i}" for i, c in enumerate(self.model.used)}
            read = rows.withColumns({x: values[c] for c, x in names.items()}) if names else rows
            return read.withColumn("yhat", self.model.expression(lambda c: F.col(names[c]))).drop(*names.values())
        return self.model.transform(self._vectors(rows)).drop("_raw", "_std")


def encode_together(rows: DataFrame, models: Mapping[int, PanelRegressor], targets: Mapping[int, Column]) -> tuple[DataFrame, dict[int, list[str]]]:
    """Rows with the key means of every model, and the columns that hold the inputs of each.

    A target is null on the rows that its model does not learn from. One aggregation and one join a key serve all models.
    """
    first = next(iter(models.values()))
    names = {i: [f"{c}{i}" if c in {f"{k}_te" for k in m.encoded_keys} else c for c in m.inputs] for i, m in models.items()}
    out = rows
    for k in first.encoded_keys:
        wide, priors = fit_target_encodings(rows, k, {f"{k}_te{i}": t for i, t in targets.items()})
        if wide.count() <= BROADCAST_KEYS:
            wide = F.broadcast(wide)
        out = join_on_keys(out, wide, [k]).withColumns({c: F.coalesce(F.col(c), F.lit(g).cast("double")) for c, g in priors.items()})
        for i, m in models.items():
            prior = rows.sparkSession.range(1).select(F.lit(priors[f"{k}_te{i}"]).cast("double").alias("_g"))
            m.encodings |= {"__global_mean__": prior, k: wide.select(k, F.col(f"{k}_te{i}").alias(f"{k}_te"))}
    return out, names


class RecursiveForecaster:
    """One one-step model, rolled forward over its own predictions.

    The state of a series during the roll-out is one row: its most recent values
    as an array of fixed length and its running means. A step is a projection,
    so the whole horizon runs without any exchange.
    """

    def __init__(self, builder: FeatureBuilder, params: Mapping | None = None, checkpoint_every: int = 12, features: Sequence[str] | None = None):
        if builder.rolling_min_lag < 1 or min(builder.lags, default=1) < 1:
            raise ValueError("a recursive model needs features that end one row back")
        self.builder, self.checkpoint_every = builder, checkpoint_every
        self.regressor = PanelRegressor(builder, params, features)

    def fit(self, train: DataFrame, valid: DataFrame | None = None) -> RecursiveForecaster:
        spec = self.builder.spec
        self.builder = self.regressor.builder = self.builder.fitted(train)
        if valid is None:
            self.regressor.fit(self.builder.transform(dealt(train, *spec.key_cols)), spec.target_col)
            return self
        # Lags of the validation rows reach into the training rows.
        both = train.withColumn("_part", F.lit(0)).unionByName(valid.withColumn("_part", F.lit(1)))
        rows = self.builder.transform(dealt(both, *spec.key_cols))
        self.regressor.fit(rows.filter("_part = 0").drop("_part"), spec.target_col, rows.filter("_part = 1").drop("_part"))
        return self

    def _start(self, history: DataFrame) -> DataFrame:
        b, spec = self.builder, self.builder.spec
        y, shift = spec.target_col, self.builder.rolling_min_lag - 1
        rows = history.select(*spec.key_cols, spec.date_col, F.col(y).cast("double").alias(y))
        for h in b.ewm_halflives:
            source = F.lag(y, shift).over(spec.in_order()) if shift else F.col(y)
            rows = ewm_mean(rows.withColumn("_s", source), spec, F.col("_s"), alpha_of_halflife(h), ewm_name(y, h)).drop("_s")
        # Rows since the newest value that entered the means: it has lost that much weight when the next one enters.
        so_far, number = spec.in_order(), F.row_number().over(spec.in_order())
        entered = F.lag(y, shift).over(so_far) if shift else F.col(y)
        rows = rows.withColumns({"_n": number, "_e": entered})
        rows = rows.withColumn("_age", F.col("_n") - F.last(F.when(F.col("_e").isNotNull(), F.col("_n")), ignorenulls=True).over(so_far)).drop("_n", "_e")
        back = F.row_number().over(spec.in_reverse())
        keep = max(b.reach, b.rolling_min_lag)
        tail = rows.withColumn("_b", back).filter(F.col("_b") <= keep)
        values = F.transform(F.array_sort(F.collect_list(F.struct((-F.col("_b")).alias("o"), F.col(y).alias("v")))), lambda s: s["v"])
        return tail.groupBy(*spec.key_cols).agg(
            values.alias("_recent"),
            F.max(spec.freq.index(spec.date_col)).alias("_at"),
            F.max_by("_age", spec.date_col).alias("_age"),
            *[F.max_by(ewm_name(y, h), spec.date_col).alias(ewm_name(y, h)) for h in b.ewm_halflives],
        )

    def predict_recursive(self, history: DataFrame, horizon: int, exogenous_future: DataFrame | None = None, show: Sequence[str] = ()) -> DataFrame:
        """``(keys, date, horizon, yhat)`` for the periods after each key's last date.

        ``show`` names features whose values at every step are returned too.
        """
        from seriesloom.functions.calendar import add_calendar_features

        b, spec = self.builder, self.builder.spec
        y, freq = spec.target_col, self.builder.spec.freq
        state = self._start(history)
        exo = list(b.exogenous)
        if exo:
            if exogenous_future is None:
                raise ValueError("the model uses exogenous columns: give their future values")
            # One row per key with at most `horizon` entries.
            at = freq.index(spec.date_col).alias("i")
            known = exogenous_future.groupBy(*spec.key_cols).agg(F.map_from_entries(F.collect_list(F.struct(at, F.struct(*exo).alias("x")))).alias("_exo"))
            state = join_on_keys(state, known, spec.key_cols)
        state = b.with_codes(self.regressor.encode(state))
        state = state.withColumn("_path", F.array().cast(f"array<struct<horizon:int,yhat:double{''.join(f',`{c}`:double' for c in show)}>>"))
        keep = state.columns
        for step in range(1, horizon + 1):
            rows = state.withColumn(spec.date_col, freq.date(F.col("_at") + step))
            rows = add_calendar_features(rows, spec.date_col, b.cyclical_calendar).withColumns(next_step_features(b, "_recent"))
            for c in exo:
                rows = rows.withColumn(c, F.try_element_at("_exo", F.col("_at") + step)[c])
            rows = self.regressor.predict(rows, encoded=True)
            grown = rows.withColumn("_recent", F.concat("_recent", F.array("yhat")))
            grown = grown.withColumn("_path", F.concat("_path", F.array(F.struct(F.lit(step).alias("horizon"), F.col("yhat").alias("yhat"), *[F.col(c).cast("double").alias(c) for c in show]))))
            newest = F.try_element_at("_recent", F.lit(-b.rolling_min_lag))
            updates = {"_age": F.when(newest.isNotNull(), 0).otherwise(F.col("_age") + 1)}
            for h in b.ewm_halflives:
                a, name = alpha_of_halflife(h), ewm_name(y, h)
                left = F.pow(F.lit(1 - a), F.col("_age") + 1)
                updates[name] = F.coalesce((left * F.col(name) + a * newest) / (left + a), F.col(name), newest)
            size = max(b.reach, b.rolling_min_lag)
            grown = grown.withColumns(updates).withColumn("_recent", F.slice("_recent", F.greatest(F.size("_recent") - size + 1, F.lit(1)), size))
            state = grown.select(*keep)
            # Trees are long expressions: written out at every step, none of them is copied into those of the next.
            if self.regressor.is_tree or (self.checkpoint_every and step % self.checkpoint_every == 0 and step < horizon):
                state = reliable_checkpoint(state)
        out = state.select(*spec.key_cols, "_at", F.inline("_path"))
        return out.select(*spec.key_cols, freq.date(F.col("_at") + F.col("horizon")).alias(spec.date_col), "horizon", "yhat", *show)


class DirectMultiHorizonForecaster:
    """One model per step ahead, all fitted on one stored feature table."""

    def __init__(self, builder: FeatureBuilder, horizons: Sequence[int], params: Mapping | None = None, parallelism: int = 2, features: Sequence[str] | None = None):
        self.builder, self.horizons, self.params, self.features = builder, list(horizons), dict(params or {}), features
        self.parallelism = parallelism
        self.models: dict[int, PanelRegressor] = {}

    def _inputs(self) -> list[str]:
        return list(self.features or [*self.builder.feature_names, *[f"{k}_te" for k in self.builder.spec.key_cols]])

    def fit(self, train: DataFrame, valid: DataFrame | None = None) -> DirectMultiHorizonForecaster:
        spec = self.builder.spec
        self.builder = self.builder.fitted(train)
        parts = train.withColumn("_part", F.lit(0))
        if valid is not None:
            parts = parts.unionByName(valid.withColumn("_part", F.lit(1)))
        rows = self.builder.transform(dealt(parts, *spec.key_cols)).withColumns({f"_y{h}": lead_target(spec, h) for h in self.horizons})
        # The part of the target date decides: training rows never aim into the validation part.
        rows = rows.withColumns({f"_p{h}": F.lead("_part", h).over(spec.in_order()) for h in self.horizons})
        rows = rows.filter(F.col(spec.target_col).isNotNull())
        if is_tree({**DEFAULT_PARAMS, **self.params}):
            return self._grow(rows, valid is not None)
        rows = rows.persist()
        try:
            def one(h: int) -> PanelRegressor:
                label = f"_y{h}"
                learns = rows.filter((F.col("_part") == 0) & (F.col(f"_p{h}") == 0)).select(*self._row_columns(), label)
                return PanelRegressor(self.builder, self.params, self._inputs()).fit(learns, label)

            with ThreadPoolExecutor(self.parallelism) as pool:
                self.models = dict(zip(self.horizons, pool.map(one, self.horizons), strict=True))
        finally:
            rows.unpersist()
        return self

    def _grow(self, rows: DataFrame, early: bool) -> DirectMultiHorizonForecaster:
        """Trees of all horizons in the same passes. Features are stored and cut into bins once."""
        spec = self.builder.spec
        models = {h: PanelRegressor(self.builder, self.params, self._inputs()) for h in self.horizons}
        learns = {h: (F.col("_part") == 0) & (F.col(f"_p{h}") == 0) for h in self.horizons}
        out, names = encode_together(rows, models, {h: F.when(learns[h], F.col(f"_y{h}")) for h in self.horizons})
        part = {h: F.when(F.col(f"_y{h}").isNotNull(), F.when(learns[h], TRAIN).when(F.col(f"_p{h}") == 1, VALID)) for h in self.horizons}
        out = out.withColumns({"_weight": F.lit(1.0), **{f"_part{h}": c for h, c in part.items()}})
        columns = list(dict.fromkeys(c for own in names.values() for c in own))
        store = Blocks.of(out, [*columns, "_weight", *[f"{c}{h}" for h in self.horizons for c in ("_y", "_part")]], [*spec.key_cols, spec.date_col])
        jobs = [Job(m.params, f"_y{h}", f"_part{h}", names[h], early) for h, m in models.items()]
        try:
            made, bins = boost(store, columns, jobs)
        finally:
            store.drop()
        self.models = {h: models[h].with_trees(m, bins, names[h]) for h, m in zip(self.horizons, made, strict=True)}
        return self

    def _row_columns(self) -> list[str]:
        return [*self.builder.spec.key_cols, *[c for c in self._inputs() if not c.endswith("_te")]]

    def predict(self, history: DataFrame, anchor: str | dt.date) -> DataFrame:
        """``(keys, date, horizon, yhat)`` from the features of each key's last row up to the anchor.

        Steps count from that row, so a key that ended earlier is forecast from its own end.
        """
        if not self.models:
            raise RuntimeError("fit the models first")
        spec = self.builder.spec
        day = F.lit(anchor).cast("timestamp_ntz" if spec.freq.hourly else "date")
        rows = self.builder.transform(history.filter(F.col(spec.date_col) <= day))
        rows = rows.withColumn("_back", F.row_number().over(spec.in_reverse())).filter("_back = 1")
        # One row per key, read by every model.
        rows = reliable_checkpoint(rows.select(spec.date_col, *self._row_columns()))
        out = None
        for h, model in self.models.items():
            part = model.predict(rows).select(*spec.key_cols, spec.freq.shift(spec.date_col, h).alias(spec.date_col), F.lit(h).alias("horizon"), "yhat")
            out = part if out is None else out.unionByName(part)
        return out


class PurelyCausalForecaster(DirectMultiHorizonForecaster):
    """Direct models restricted to features known at the anchor date."""

    def __init__(self, builder: FeatureBuilder, horizons: Sequence[int], params: Mapping | None = None, extra_causal: Sequence[str] = (), parallelism: int = 2):
        super().__init__(builder, horizons, params, parallelism)
        self.extra_causal = list(extra_causal)

    def _inputs(self) -> list[str]:
        return causal_features(super()._inputs(), self.builder, self.extra_causal)


def quantile_name(q: float) -> str:
    """``q0_10`` for 0.1: a dot would need quoting in every Spark expression."""
    return f"q{q:.2f}".replace(".", "_")


class QuantileForecaster:
    """Quantiles as a point forecast plus residual quantiles of a calibration part.

    Residual quantiles come from a mergeable sketch per group, so a group may
    hold any number of rows. Quantiles of a row are sorted, hence never cross.
    Groups are columns of the rows (``by``) and, for forecasts of several steps, the
    step. ``groups`` gives columns of ``by`` per key, such as a demand class.
    """

    def __init__(
        self, builder: FeatureBuilder, quantiles: Sequence[float] = (0.1, 0.5, 0.9), params: Mapping | None = None, by: Sequence[str] = (),
        accuracy: int = 10_000, groups: DataFrame | None = None, features: Sequence[str] | None = None,
    ):
        self.builder, self.quantiles, self.by, self.accuracy = builder, sorted(quantiles), list(by), accuracy
        self.regressor = PanelRegressor(builder, params, features)
        self.offsets: DataFrame | None = None
        self.groups, self.horizon = groups, None

    def _grouped(self, df: DataFrame) -> DataFrame:
        absent = [c for c in self.by if c not in df.columns]
        if not absent:
            return df
        if self.groups is None:
            raise ValueError(f"give the groups of each key: {absent}")
        spec = self.builder.spec
        return join_on_keys(df, self.groups.select(*spec.key_cols, *absent), spec.key_cols)

    def _roll(self, known: DataFrame, horizon: int) -> DataFrame:
        path = RecursiveForecaster(self.builder, self.regressor.params)
        path.regressor = self.regressor
        return self._grouped(path.predict_recursive(known, horizon))

    def fit_ahead(self, train: DataFrame, calibration: DataFrame, horizon: int) -> QuantileForecaster:
        """Fit on ``train``; errors of its forecasts of ``calibration`` are kept per group and step."""
        spec = self.builder.spec
        y = spec.target_col
        self.builder = self.regressor.builder = self.builder.fitted(train)
        self.regressor.fit(self.builder.transform(dealt(train, *spec.key_cols)), y)
        made = self._roll(train, horizon)
        actual = calibration.select(*spec.key_cols, spec.date_col, F.col(y).alias("_actual")).filter("_actual IS NOT NULL")
        both = join_on_keys(made, actual, [*spec.key_cols, spec.date_col], "inner")
        spread = F.percentile_approx(F.col("_actual") - F.col("yhat"), self.quantiles, self.accuracy)
        self.offsets = reliable_checkpoint(both.groupBy(*self.by, "horizon").agg(spread.alias("_off")))
        self.horizon = horizon
        return self

    def predict_ahead(self, known: DataFrame, horizon: int) -> DataFrame:
        """``(keys, date, horizon, q..)`` after each key's last row; later values are never read.

        Null for a group and step that the calibration rows did not cover.
        """
        if self.horizon is None or horizon > self.horizon:
            raise RuntimeError("fit_ahead with at least this horizon first")
        spec = self.builder.spec
        joined = join_on_keys(self._roll(known, horizon), self.offsets, [*self.by, "horizon"])
        qs = joined.withColumn("_q", F.array_sort(F.transform("_off", lambda o: o + F.col("yhat"))))
        return qs.select(*spec.key_cols, spec.date_col, "horizon", *[F.col("_q")[i].alias(quantile_name(q)) for i, q in enumerate(self.quantiles)])

    def fit(self, train: DataFrame, calibration: DataFrame) -> QuantileForecaster:
        y = self.builder.spec.target_col
        self.builder = self.regressor.builder = self.builder.fitted(train)
        both = train.withColumn("_part", F.lit(0)).unionByName(calibration.withColumn("_part", F.lit(1)))
        rows = self.builder.transform(dealt(both, *self.builder.spec.key_cols))
        self.regressor.fit(rows.filter("_part = 0"), y)
        held = self.regressor.predict(rows.filter("_part = 1").filter(F.col(y).isNotNull()))
        spread = F.percentile_approx(F.col(y) - F.col("yhat"), self.quantiles, self.accuracy)
        self.offsets = reliable_checkpoint(held.groupBy(*self.by).agg(spread.alias("_off")))
        return self

    def predict(self, df: DataFrame, history: DataFrame | None = None) -> DataFrame:
        """``(keys, date, q..)`` for the rows of ``df``; ``history`` supplies their lags.

        Each row is forecast one step ahead from true values; see :meth:`predict_ahead`.
        """
        if self.offsets is None:
            raise RuntimeError("fit the model first")
        spec = self.builder.spec
        rows = df.withColumn("_new", F.lit(True))
        if history is not None:
            rows = rows.unionByName(history.withColumn("_new", F.lit(False)), allowMissingColumns=True)
        scored = self.regressor.predict(self.builder.transform(rows).filter("_new"))
        joined = join_on_keys(scored, self.offsets, self.by) if self.by else scored.join(F.broadcast(self.offsets))
        qs = joined.withColumn("_q", F.array_sort(F.transform("_off", lambda o: o + F.col("yhat"))))
        return qs.select(*spec.key_cols, spec.date_col, *[F.col("_q")[i].alias(quantile_name(q)) for i, q in enumerate(self.quantiles)])


def cross_validated_predictions(
    rows: DataFrame, builder: FeatureBuilder, label: str, identity: Sequence[str], k: int = 3, params: Mapping | None = None,
    mode: str = "time", test: DataFrame | None = None, exponent: float = 0.5, seed: int = 0, weight: str | None = None, features: Sequence[str] | None = None,
) -> tuple[DataFrame, DataFrame | None]:
    """Out-of-fold predictions and test predictions averaged over the folds.

    ``rows`` carry features. The label is fitted as ``label ** exponent`` and
    predictions are inverted and floored at zero. ``mode='time'`` cuts folds by
    date; ``'random'`` by a hash of the row identity.
    """
    from seriesloom.operators.splits import date_span, repeated_fold, time_fold
    from seriesloom.operators.transforms import invert_power_target, power_target

    spec = builder.spec
    fold = repeated_fold(identity, k, seed) if mode == "random" else time_fold(spec, *date_span(rows, spec), k)
    folded = rows.withColumn("_fold", fold.cast("int")).withColumn("_label", power_target(F.col(label), exponent))
    models = {i: PanelRegressor(builder, params, features) for i in range(k)}
    kept, names = folded, {}
    if models[0].is_tree:
        # Key means of all folds are joined once, and so is the table of the predictions.
        kept, names = encode_together(folded, models, {i: F.when(F.col("_fold") != i, F.col("_label")) for i in models})
        learns = {f"_part{i}": F.when(F.col("_label").isNotNull() & (F.col("_fold") != i), TRAIN) for i in models}
        columns = list(dict.fromkeys(c for own in names.values() for c in own))
        rows = kept.withColumns({"_weight": PanelRegressor._share(weight), **learns})
        ids = [c for c in (*spec.key_cols, spec.date_col) if c in rows.columns]
        store = Blocks.of(rows, [*columns, "_label", "_weight", *learns], ids)
        try:
            models = {i: m.grow(store, [m.params], f"_part{i}", names=names[i])[0] for i, m in models.items()}
        finally:
            store.drop()
    else:
        kept = folded.persist()
        try:
            for i, m in models.items():
                m.fit(kept.filter(F.col("_fold") != i), "_label", weight=weight)
        finally:
            kept.unpersist()
    shown = [*identity, label, *([weight] if weight else [])]
    oof, tests = None, None
    if models[0].is_tree:
        yhat = F.coalesce(*[F.when(F.col("_fold") == i, m.scored(names[i])) for i, m in models.items()])
        made = kept.filter(F.col("_fold").isNotNull()).withColumn("yhat", invert_power_target(yhat, exponent))
        oof = made.select(*shown, F.col("_fold").alias("fold"), "yhat")
    for i, model in models.items():
        if not model.is_tree:
            part = model.predict(folded.filter(F.col("_fold") == i)).select(*shown, F.lit(i).alias("fold"), invert_power_target(F.col("yhat"), exponent).alias("yhat"))
            oof = part if oof is None else oof.unionByName(part)
        if test is not None:
            t = model.predict(test).select(*identity, invert_power_target(F.col("yhat"), exponent).alias("yhat"))
            tests = t if tests is None else tests.unionByName(t)
    if tests is not None:
        tests = tests.groupBy(*identity).agg(F.avg("yhat").alias("yhat"))
    return oof, tests
