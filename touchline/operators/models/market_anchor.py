"""Models that start from the market's probabilities.

The residual model is a multinomial logit with the log of the market's probabilities as offset: without learned shifts
it is the market.  It is fitted for all groups (leagues, folds) at once by Newton steps, whose gradients and curvatures tasks sum over their
rows and a shuffle by (group, cell): the driver gets sums whose number follows from groups and features, and no group's rows ever meet."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from touchline.functions.odds import clipped
from touchline.session import kept

Q = ("q1", "qx", "q2")
MARKET_FEATURES = ("market_p1", "market_px", "market_p2", "market_logit_1", "market_logit_x", "market_favourite", "market_entropy")
RIDGE, LEAST, STEPS = 20.0, 50, 20


def market_features(rows: DataFrame) -> DataFrame:
    """The market's probabilities, two log odds, the favourite and the normalised entropy."""
    q1, qx, q2 = clipped(*map(F.col, Q))
    entropy: Column = -(q1 * F.ln(q1) + qx * F.ln(qx) + q2 * F.ln(q2)) / float(np.log(3.0))
    favourite = F.when((q1 >= qx) & (q1 >= q2), 0.0).when(qx >= q2, 1.0).otherwise(2.0)
    return rows.withColumns({"market_p1": q1, "market_px": qx, "market_p2": q2, "market_logit_1": F.ln(q1 / q2), "market_logit_x": F.ln(qx / q2), "market_favourite": favourite, "market_entropy": entropy})


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def moments(x: np.ndarray, offset: np.ndarray, y: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Loss, gradient and curvature (side by side) of rows at weights w (features and bias by class), without the ridge."""
    p = _softmax(offset + x @ w)
    d = x.shape[1]
    loss = -np.log(np.maximum(p[np.arange(len(y)), y], 1e-300)).sum()
    grad = x.T @ (p - np.eye(3)[y])
    curve = np.empty((3, d, 3, d))
    for k in range(3):
        for m in range(k, 3):
            curve[k, :, m] = curve[m, :, k] = (x * (p[:, k] * ((k == m) - p[:, m]))[:, None]).T @ x
    return np.concatenate([[loss], grad.T.ravel(), curve.ravel()])


def newton(sums: dict[str, np.ndarray], weights: dict[str, np.ndarray], ridge: float) -> dict[str, tuple[np.ndarray, float]]:
    """Per group the Newton step and how much it promises, from summed moments."""
    out = {}
    for g, s in sums.items():
        w = weights[g].T.ravel()
        n = len(w)
        step = np.linalg.solve(s[1 + n :].reshape(n, n) + ridge * np.eye(n), s[1 : 1 + n] + ridge * w)
        out[g] = step.reshape(3, -1).T, float(step @ (s[1 : 1 + n] + ridge * w))
    return out


class Shift:
    """A fitted residual model: per group the features' means, spreads and weights; groups with few rows have none and stay at the market."""

    def __init__(self, features: list[str], scales: dict[str, tuple[np.ndarray, np.ndarray]], weights: dict[str, np.ndarray]):
        self.features, self.scales, self.weights = features, scales, weights

    def matrix(self, group: str, x: np.ndarray) -> np.ndarray:
        mean, spread = self.scales[group]
        return np.column_stack([(np.where(np.isnan(x), mean, x) - mean) / spread, np.ones(len(x))])

    def transform(self, rows: DataFrame, group: str, names: tuple[str, str, str] = ("r1", "rx", "r2")) -> DataFrame:
        """rows with the shifted probabilities; those of the market (clipped, adding up to 1) where the group has no model."""
        kept_columns, width = rows.columns, len(self.features)
        prepared = rows.select(*kept_columns, F.col(group).cast("string").alias("__group"), _vector(self.features), *(F.ln(q).alias(f"__o{k}") for k, q in enumerate(clipped(*map(F.col, Q)))))
        schema = rows.schema
        for n in names:
            schema = schema.add(n, "double")

        def run(batches):
            for batch in batches:
                groups = np.array(batch.column("__group").to_pylist(), dtype=object)
                x = batch.column("__x").flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, width)
                z = np.column_stack([batch.column(f"__o{k}").to_numpy(zero_copy_only=False).astype(float) for k in range(3)])
                for g in set(groups.tolist()) & self.weights.keys():
                    of = groups == g
                    z[of] += self.matrix(g, x[of]) @ self.weights[g]
                p = _softmax(z) if len(z) else z
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept_columns), *(pa.array(p[:, k], from_pandas=True) for k in range(3))], [*kept_columns, *names])

        return prepared.mapInArrow(run, schema)


def _vector(features: list[str]) -> Column:
    return F.array(*(F.col(c).cast("double") for c in features)).alias("__x")


def fit_shift(rows: DataFrame, features: list[str], group: str, train: str = "train", ridge: float = RIDGE, least: int = LEAST, steps: int = STEPS) -> Shift:
    """Fits each group's train rows (split, q1, qx, q2, y, features) that have an outcome and the market's probabilities.

    Newton steps are halved while a group's loss grows, and end when all groups promise under 1e-10.  Missing features count as the group's mean."""
    learned = rows.where(F.col("split") == train).where("y is not null and q1 is not null and qx is not null and q2 is not null").select(F.col(group).cast("string").alias("group"), F.col("y").cast("int").alias("y"), *Q, *(F.col(c).cast("double").alias(c) for c in features))
    summary = learned.groupBy("group").agg(F.count(F.lit(1)).alias("n"), *(F.struct(F.avg(c), F.stddev_pop(c)).alias(c) for c in features)).where(F.col("n") >= least).collect()
    scales = {r["group"]: (np.array([r[c][0] or 0.0 for c in features]), np.array([r[c][1] or 1.0 for c in features])) for r in summary}
    width = len(features)
    found = Shift(features, scales, {g: np.zeros((width + 1, 3)) for g in scales})
    if not scales:
        return found
    data = kept(learned.where(F.col("group").isin(list(scales))).select("group", "y", _vector(features), *(F.ln(q).alias(f"__o{k}") for k, q in enumerate(clipped(*map(F.col, Q))))))

    def sums(weights: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
        def run(batches):
            total: dict[str, np.ndarray] = {}
            for batch in batches:
                groups = np.array(batch.column("group").to_pylist(), dtype=object)
                x = batch.column("__x").flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, width)
                z, y = np.column_stack([batch.column(f"__o{k}").to_numpy() for k in range(3)]), batch.column("y").to_numpy()
                for g in set(groups.tolist()) & weights.keys():
                    of = groups == g
                    total[g] = total.get(g, 0.0) + moments(found.matrix(g, x[of]), z[of], y[of], weights[g])
            for g, s in total.items():
                yield pa.RecordBatch.from_pydict({"group": [g] * len(s), "cell": np.arange(len(s)), "value": s})

        cells = data.mapInArrow(run, "group string, cell long, value double").groupBy("group", "cell").agg(F.sum("value").alias("value")).toPandas()
        return {g: own.sort_values("cell")["value"].to_numpy() for g, own in cells.groupby("group")}

    loss = lambda s, w: s[0] + ridge * float((w**2).sum()) / 2
    weights = found.weights
    now = sums(weights)
    for _ in range(steps):
        steps_of = {g: step for g, (step, promise) in newton(now, weights, ridge).items() if promise > 1e-10}
        if not steps_of:
            break
        tried = {g: weights[g] - step for g, step in steps_of.items()}
        after = sums(tried)
        for g, s in after.items():
            if loss(s, tried[g]) <= loss(now[g], weights[g]):
                weights[g], now[g] = tried[g], s
            else:  # a shorter step next time: the curvature is made larger
                n = 3 * (width + 1)
                now[g] = np.concatenate([now[g][: 1 + n], 2 * now[g][1 + n :] + ridge * np.eye(n).ravel()])
    return found


def residual(rows: DataFrame, features: list[str], group: str, train: str = "train", ridge: float = RIDGE, least: int = LEAST) -> DataFrame:
    """group, match_id and r1, rx, r2 of the rows (group, match_id, split, q1, qx, q2, y, features) outside the train split.

    Missing features count as the group's mean.  A group with too few train rows returns the market."""
    model = fit_shift(rows, features, group, train, ridge, least)
    return model.transform(rows.where(F.col("split") != train).select(group, "match_id", *Q, *features), group).select(group, "match_id", "r1", "rx", "r2")
