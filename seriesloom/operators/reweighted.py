"""Tweedie and Poisson regression with a log link, several parameter sets at once, by iteratively reweighted least squares.

A round is one pass over stored blocks for all sets: a task adds its rows into the normal equations of each set, the driver
adds the tasks' sums and solves systems as large as the number of features. Features are scaled by the training rows; one that
never varies is left out. The penalty and the end of the rounds are those of MLlib's generalized linear regression.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from seriesloom.operators.blocks import Blocks, each, few_parts, small_batches, sums
from seriesloom.operators.boosting import HELD, TRAIN

# Rounds at most, the change of a coefficient that ends them, and the mean that stands for a label of zero.
ROUNDS, TOLERANCE, LEAST = 25, 1e-6, 0.1


@dataclass
class Design:
    """Lines of the features in a block, and how they are filled, flagged and scaled."""

    lines: list[int]
    means: np.ndarray
    flagged: list[int]
    centre: np.ndarray
    spread: np.ndarray

    def raw(self, rows: np.ndarray, use: np.ndarray) -> np.ndarray:
        """Filled features, then a line of 0 and 1 per flagged one."""
        x = rows[self.lines][:, use]
        gaps = np.isnan(x)
        return np.concatenate([np.where(gaps, self.means[:, None], x), gaps[self.flagged]])

    def matrix(self, rows: np.ndarray, use: np.ndarray) -> np.ndarray:
        """Ones for the intercept, then every feature that varies, scaled."""
        kept = self.spread > 0
        x = (self.raw(rows, use)[kept] - self.centre[kept, None]) / self.spread[kept, None]
        return np.concatenate([np.ones((1, len(use))), x])


def learn_design(store: Blocks, names: Sequence[str], label: str, part: str) -> tuple[Design, float]:
    """The design of the training rows and their smallest label, from two passes."""
    lines, y, own = store.at(names), *store.at([label, part])
    k = len(lines)

    def count(batches: Iterator[pa.RecordBatch], total: np.ndarray) -> None:
        for (rows,) in each(batches, np.float64):
            use = np.flatnonzero(rows[own] == TRAIN)
            x = rows[lines][:, use]
            total[0] += len(use)
            total[1] += np.count_nonzero(rows[y][use] < 0)
            total[2] += np.count_nonzero(rows[y][use] <= 0)
            total[3 : k + 3] += np.count_nonzero(~np.isnan(x), axis=1)
            total[k + 3 :] += np.nansum(x, axis=1)

    first = sums(store.df, count, 3 + 2 * k)
    seen, known = first[0], first[3 : k + 3]
    if not seen:
        raise ValueError("no labelled row to learn from")
    means = np.where(known > 0, first[k + 3 :] / np.maximum(known, 1), 0.0)
    flagged = [i for i in range(k) if known[i] < seen]
    centre = np.concatenate([means, (seen - known[flagged]) / seen])
    design = Design(lines, means, flagged, centre, np.ones(len(centre)))

    def square(batches: Iterator[pa.RecordBatch], total: np.ndarray) -> None:
        for (rows,) in each(batches, np.float64):
            off = design.raw(rows, np.flatnonzero(rows[own] == TRAIN)) - centre[:, None]
            total += (off * off).sum(axis=1)

    spread = np.sqrt(sums(store.df, square, len(centre)) / max(seen - 1, 1))
    # What is left after rounding errors is no variation.
    design.spread = np.where(spread > 1e-9 * np.maximum(np.abs(centre), 1e-300), spread, 0.0)
    return design, -1.0 if first[1] else 0.0 if first[2] else 1.0


def _equations(design: Design, betas: Mapping[int, np.ndarray | None], powers: Sequence[float], y_at: int, part_at: int, size: int) -> Callable:
    """Adds up, per set: matrix, right side and weight of the next round."""

    def add(batches: Iterator[pa.RecordBatch], total: np.ndarray) -> None:
        cells = total.reshape(len(betas), size * size + size + 1)
        for (rows,) in each(batches, np.float64):
            use = np.flatnonzero(rows[part_at] == TRAIN)
            x, y = design.matrix(rows, use), rows[y_at][use]
            for out, (i, beta) in zip(cells, betas.items(), strict=True):
                if beta is None:
                    w, z = np.ones(len(y)), np.log(np.where(y == 0, LEAST, y))
                else:
                    eta = beta @ x
                    mu = np.clip(np.exp(np.minimum(eta, 700.0)), 1e-16, None)
                    w, z = mu ** (2.0 - powers[i]), eta + (y - mu) / mu
                xw = x * w
                out[: size * size] += (xw @ x.T).ravel()
                out[size * size : -1] += xw @ z
                out[-1] += w.sum()

    return add


def reweight(
    store: Blocks, names: Sequence[str], sets: Sequence[Mapping], label: str, part: str, judge: Callable[[DataFrame, list[int]], None] | None = None
) -> tuple[list[np.ndarray], Design]:
    """Per set the intercept and the slopes of the features that vary, in units of their deviations.

    A set gives ``variance_power`` (1 for Poisson) and ``l2``. ``judge`` gets ``_y`` and ``_p<i>`` of the held rows.
    """
    powers = [1.0 if s["objective"] == "poisson" else s["variance_power"] for s in sets]
    design, least = learn_design(store, names, label, part)
    if least < 0 or (least == 0 and any(p >= 2 for p in powers)):
        raise ValueError("labels are not negative, and positive from a variance power of 2")
    size = 1 + int(np.count_nonzero(design.spread))
    y_at, part_at = store.at([label, part])
    betas: list[np.ndarray | None] = [None] * len(sets)
    active = list(range(len(sets)))
    for rounds in range(ROUNDS + 1):
        # The first round does not know the sets yet: one system serves all.
        asked = {0: None} if rounds == 0 else {i: betas[i] for i in active}
        total = sums(store.df, _equations(design, asked, powers, y_at, part_at, size), len(asked) * (size * size + size + 1)).reshape(len(asked), -1)
        for j, i in enumerate(list(active)):
            own = total[0 if rounds == 0 else j]
            matrix, right = own[: size * size].reshape(size, size) / own[-1], own[size * size : -1] / own[-1]
            penalty = np.full(size, sets[i].get("l2", 0.1))
            penalty[0] = 0.0
            beta = np.linalg.lstsq(matrix + np.diag(penalty), right, rcond=1e-12)[0]
            if betas[i] is not None and np.max(np.abs(beta - betas[i])) < TOLERANCE:
                active.remove(i)
            betas[i] = beta
        if not active:
            break
    if judge is not None:
        with small_batches(store.df.sparkSession):
            judge(_predictions(store, design, betas, y_at, part_at), list(range(len(sets))))
    return betas, design


def _predictions(store: Blocks, design: Design, betas: Sequence[np.ndarray], y_at: int, part_at: int) -> DataFrame:
    names = ["_y", *[f"_p{i}" for i in range(len(betas))]]

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (rows,) in each(batches, np.float64):
            use = np.flatnonzero(rows[part_at] == HELD)
            x = design.matrix(rows, use)
            yield pa.RecordBatch.from_arrays([pa.array(v) for v in (rows[y_at][use], *[np.exp(b @ x) for b in betas])], names)

    return few_parts(store.df).mapInArrow(task, ", ".join(f"{n} double" for n in names))
