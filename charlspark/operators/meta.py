"""A non-negative least-squares combination of the estimates.

The base learners pass their columns through, so cross-validation folds cannot change the fit: it depends only on sums of
products, which one aggregation gives, or the very pass that writes the estimates (observed). The driver then solves a
problem of the size of the number of learners.

Rows in which a learner or the target is null or NaN take no part in the fit nor in the risks; their prediction is null or NaN."""

from __future__ import annotations

import itertools
from collections.abc import Callable, Mapping

import numpy as np
from pyspark.sql import Column, DataFrame, Observation, Row
from pyspark.sql import functions as F

from charlspark.sources.staging import staged

#: column -> name of its weight
LEARNERS = {"s1_mid": "S1_mid", "s2_ecci": "S2_ecci", "s3_mi": "S3_mi", "s4_bayes": "S4_bayes"}
TARGET = "cci_gold"
REQUIRED = [TARGET, "s1_min", "s1_max", *LEARNERS]


def sums(learners: Mapping[str, str] = LEARNERS) -> list[Column]:
    """n and the sums of products of the learners and the target over complete rows, as aggregates."""
    columns = [*learners, TARGET]
    whole = F.lit(True)
    for c in columns:
        whole = whole & F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double"))
    d = lambda c: F.when(whole, F.col(c).cast("double"))
    products = [F.coalesce(F.sum(d(a) * d(b)), F.lit(0.0)).alias(f"{a}__{b}") for a, b in itertools.combinations_with_replacement(columns, 2)]
    return [F.count(F.when(whole, 1)).alias("n"), *products]


def checked(table: DataFrame, learners: Mapping[str, str] = LEARNERS) -> DataFrame:
    needed = REQUIRED if learners is LEARNERS else [TARGET, *learners]
    lacking = [c for c in needed if c not in table.columns]
    if lacking:
        raise ValueError(f"columns are missing: {', '.join(lacking)}")
    return table


def gram(table: DataFrame, learners: Mapping[str, str] = LEARNERS) -> DataFrame:
    """One row: n and the sums of products."""
    return checked(table, learners).agg(*sums(learners))


def observed(table: DataFrame, write: Callable[[DataFrame], DataFrame] = staged, learners: Mapping[str, str] = LEARNERS) -> tuple[DataFrame, Row]:
    """The table as written, and its sums, gathered while it was written: it is computed once and not read again for them."""
    seen = Observation()
    out = write(checked(table, learners).observe(seen, *sums(learners)))
    names = [c for c in seen.get]
    return out, Row(*names)(*[seen.get[c] for c in names])


def solve(gram_matrix: np.ndarray, target: np.ndarray) -> np.ndarray:
    """min |Zw - y| with w >= 0, normalised to sum 1, by Lawson and Hanson's active sets on the normal equations.

    The learner with the steepest gradient joins (of equals the first); where the solution on the set turns a weight negative, it goes
    as far as the first weight that reaches 0, which leaves the set. A learner that depends on those of the set adds nothing and stays out."""
    k = len(target)
    scale = np.sqrt(np.where(np.diag(gram_matrix) > 0, np.diag(gram_matrix), 1.0))
    g, t = gram_matrix / np.outer(scale, scale), target / scale
    w, own, barred = np.zeros(k), np.zeros(k, bool), np.zeros(k, bool)
    tiny = 1e-9 * max(1.0, float(np.abs(t).max(initial=0.0)))
    for _ in range(30 * k):
        slope = np.where(own | barred, -np.inf, t - g @ w)
        new = int(np.argmax(slope)) if k else 0
        if not k or slope[new] <= tiny:
            break
        trial = own.copy()
        trial[new] = True
        if np.linalg.cond(g[np.ix_(trial, trial)]) > 1e12:
            barred[new] = True
            continue
        own = trial
        while True:
            best = np.zeros(k)
            best[own] = np.linalg.solve(g[np.ix_(own, own)], t[own])
            down = own & (best <= 0)
            if not down.any():
                break
            step = np.min(w[down] / (w[down] - best[down]), initial=1.0, where=(w[down] - best[down]) > 0)
            w = w + step * (best - w)
            left = own & (w <= 1e-14) & down
            own &= ~(left if left.any() else down)
            w[~own] = 0.0
        w, barred = best, np.zeros(k, bool)
    w = w / scale
    return w / w.sum() if w.sum() > 0 else w


def fitted(row: Row, learners: Mapping[str, str] = LEARNERS) -> dict[str, float]:
    """The learners' weights by name, from their sums."""
    names = list(learners)
    at = lambda a, b: row[f"{a}__{b}"] if names.index(a) <= names.index(b) else row[f"{b}__{a}"]
    w = solve(np.array([[at(a, b) for b in names] for a in names]), np.array([row[f"{a}__{TARGET}"] for a in names]))
    return {learners[c]: float(x) for c, x in zip(names, w)}


def weights(table: DataFrame, V: int = 10, seed: int = 42, learners: Mapping[str, str] = LEARNERS) -> dict[str, float]:
    """The learners' weights by name. V and seed have no effect (see above)."""
    return fitted(gram(table, learners).first(), learners)


def weight_table(table: DataFrame) -> DataFrame:
    """learner, weight."""
    return named(table, weights(table), "weight")


def named(table: DataFrame, values: Mapping[str, float | None], column: str) -> DataFrame:
    return table.sparkSession.createDataFrame(list(values.items()), f"learner string, {column} double")


def risks(row: Row, learners: Mapping[str, str] = LEARNERS) -> dict[str, float | None]:
    """Each learner's mean squared error, from the sums."""
    square = lambda c: row[f"{c}__{c}"] - 2 * row[f"{c}__{TARGET}"] + row[f"{TARGET}__{TARGET}"]
    return {n: square(c) / row["n"] if row["n"] else None for c, n in learners.items()}


def cv_risk(table: DataFrame) -> DataFrame:
    """learner, cv_risk: each learner's mean squared error."""
    return named(table, risks(gram(table).first()), "cv_risk")


def predict(table: DataFrame, w: dict[str, float]) -> DataFrame:
    """table with the combination, also for new rows."""
    terms = [F.col(c) * F.lit(w[n]) for c, n in LEARNERS.items()]
    return table.withColumn("meta", sum(terms[1:], terms[0]))
