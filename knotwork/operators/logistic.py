"""Many penalised logistic regressions over the same rows, all fitted at once.

Each pass over the rows gives, for every model still open, its loss, gradient and matrix of second derivatives; sums are made
in the tasks and added by model, so what reaches the driver depends on the models and features, not on the rows. The driver
takes proximal Newton steps: the penalty is kept exactly, the loss is replaced by its second order, and a step that doesn't
lower the objective is halved. A fit takes about as many passes as one Newton method does, whatever the number of models.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame

#: Rows that are computed at once in a task, and bounds of a row's loss as the loss of folds is measured.
CHUNK, LEAST, MOST = 2048, -np.log1p(-1e-15), -np.log(1e-15)
#: A model rests once a step would lower its objective by no more than this share of it; changes of signs that a step may try
#: for each weight: where they don't suffice, the next step goes on.
REST, SIGNS = 1e-9, 20


@dataclass(frozen=True)
class Models:
    """One model per entry: the fold it doesn't see (or -1), the rows it sees, and both penalties on its mean loss."""

    fold: np.ndarray
    n: np.ndarray
    absolute: np.ndarray
    square: np.ndarray

    def of(self, some: np.ndarray) -> Models:
        return Models(self.fold[some], self.n[some], self.absolute[some], self.square[some])


def _sums(scale: np.ndarray, fold: np.ndarray, weights: np.ndarray) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Batches (x, y, fold, n) to (model, values): loss, loss on its fold, gradient and upper triangle of second derivatives."""
    wide = weights.shape[1]
    up, down = np.triu_indices(wide)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, some = np.zeros((len(fold), 2 + wide + len(up))), False
        for batch in batches:
            for at in range(0, batch.num_rows, CHUNK):
                part, some = batch.slice(at, CHUNK), True
                x = np.asarray(part.column(0).flatten(), dtype=float).reshape(part.num_rows, wide - 1) * scale
                x = np.column_stack([x, np.ones(len(x))])
                y, of, n = (np.asarray(part.column(k), dtype=float)[:, None] for k in (1, 2, 3))
                z = x @ weights.T
                e = np.exp(-np.abs(z))
                loss = np.log1p(e) + np.maximum(z, 0) - y * z
                seen = n * (of != fold)
                p = np.where(z >= 0, 1.0, e) / (1 + e)
                out[:, 0] += (seen * loss).sum(0)
                out[:, 1] += ((n - seen) * np.clip(loss, LEAST, MOST)).sum(0)
                out[:, 2 : 2 + wide] += (seen * (p - y)).T @ x
                out[:, 2 + wide :] += (seen * e / (1 + e) ** 2).T @ (x[:, up] * x[:, down])
        if some:
            values = pa.ListArray.from_arrays(pa.array(np.arange(len(fold) + 1) * out.shape[1], pa.int32()), pa.array(out.ravel()))
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(fold)), pa.int32()), values], names=["model", "values"])

    return add


def _measured(rows: DataFrame, scale: np.ndarray, models: Models, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Mean loss, summed loss on the fold not seen, gradient and second derivatives of each model."""
    wide = weights.shape[1]
    up, down = np.triu_indices(wide)
    parts = rows.select("x", "y", "fold", "n").mapInArrow(_sums(scale, models.fold, weights), "model int, values array<double>")
    out = np.zeros((len(weights), 2 + wide + len(up)))
    for r in parts.groupBy("model").agg(Summarizer.sum(array_to_vector("values")).alias("v")).collect():
        out[r.model] = r.v.toArray()
    mean = out / np.maximum(models.n, 1)[:, None]
    second = np.zeros((len(weights), wide, wide))
    second[:, up, down] = second[:, down, up] = mean[:, 2 + wide :]
    return mean[:, 0], out[:, 1], mean[:, 2 : 2 + wide], second


def _step(at: np.ndarray, gradient: np.ndarray, second: np.ndarray, models: Models) -> tuple[np.ndarray, np.ndarray]:
    """Where the penalised second order is least, as a direction, and the slope of the objective along it.

    With the signs of the weights known, the rest is a linear system: signs are searched from those at hand, a weight leaves
    where it would cross zero, and the one whose absence violates the optimum most enters.
    """
    wide = at.shape[1]
    free = np.arange(wide) == wide - 1  # the intercept
    absolute, square = models.absolute[:, None] * ~free, models.square[:, None] * ~free
    eye, diagonal = np.eye(wide), np.einsum("kjj->kj", second)
    a = second + eye * np.where(diagonal > 0, 1e-9 * diagonal, 1.0)[:, None, :]
    c = gradient - np.einsum("kij,kj->ki", a, at)
    a = a + eye * square[:, None, :]
    v, sign, left = at.copy(), np.sign(at), np.arange(len(at))
    for _ in range(SIGNS * wide):
        al, cl, vl, pl, sl = a[left], c[left], v[left], absolute[left], sign[left]
        active = (sl != 0) | (pl == 0)
        system = np.where(active[:, :, None] & active[:, None, :], al, eye)
        u = np.linalg.solve(system, np.where(active, -cl - pl * sl, 0)[:, :, None])[:, :, 0]
        crossed = active & (pl > 0) & (u * sl <= 0)
        ratio = np.where(crossed, vl / np.where(crossed & (vl != u), vl - u, 1), 1)
        part = ratio.min(1, keepdims=True)
        out = crossed & (ratio <= part)
        v[left] = vl = np.where(out, 0, vl + part * (u - vl))
        slack = cl + np.einsum("kij,kj->ki", al, vl)
        excess = np.where(active, -np.inf, np.abs(slack) - pl * (1 + 1e-9))
        enters = excess.argmax(1)
        whole, one = ~crossed.any(1), np.arange(len(left))
        more = whole & (excess[one, enters] > 1e-15)
        sl = np.where(out, 0, sl)
        sl[one[more], enters[more]] = -np.sign(slack[one[more], enters[more]])
        sign[left] = sl
        left = left[~whole | more]
        if not len(left):
            break
    d = v - at
    slope = ((gradient + square * at) * d).sum(1) + (absolute * (np.abs(v) - np.abs(at))).sum(1)
    return d, slope


def fit_all(rows: DataFrame, scale: np.ndarray, models: Models, start: np.ndarray, passes: int) -> tuple[np.ndarray, np.ndarray]:
    """Weights (the intercept last) of each model for ``x * scale``, and its summed loss on the fold it doesn't see.

    rows: (x, y, fold, n), n times a row of features x and label y.
    """
    at, trial, d = start.copy(), start.copy(), np.zeros_like(start)
    value, held, slope, length = np.full(len(at), np.inf), np.zeros(len(at)), np.zeros(len(at)), np.ones(len(at))
    left = np.arange(len(at))
    for _ in range(passes):
        some, w = models.of(left), trial[left]
        loss, out, gradient, second = _measured(rows, scale, some, w)
        now = loss + some.absolute * np.abs(w[:, :-1]).sum(1) + some.square / 2 * (w[:, :-1] ** 2).sum(1)
        better = now <= value[left] + 1e-4 * length[left] * slope[left]
        new, worse = left[better], left[~better]
        at[new], value[new], held[new], length[new] = trial[new], now[better], out[better], 1.0
        d[new], slope[new] = _step(at[new], gradient[better], second[better], models.of(new))
        length[worse] /= 2
        left = left[np.where(better, -slope[left] > REST * value[left] + 1e-16, length[left] > 1e-12)]
        if not len(left):
            break
        trial[left] = at[left] + length[left, None] * d[left]
    return at, held
