"""Fitting and judging forecasts: logistic fit with momentum, grid choice, paired bootstrap, promotion gate, drivers."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The linear congruential generator of the bootstrap, and limits of the gate and the tables.
LCG_SEED, LCG_STEP, LCG_ADD, LCG_SIZE = 123456789, 1664525, 1013904223, 4294967296
ACCURACY_LOSS, SMALLEST_DRIVER, TOP_DRIVERS, RECOVERY_TOLERANCE, ELO_SLOPE = 0.005, 1e-9, 3, 1e-12, 0.006085080947128282


def bounded_rows(rows: DataFrame, key: str, most: int = 200_000) -> pd.DataFrame:
    """All rows if at most `most`, else about that many by a hash of key."""
    n = rows.count()
    return (rows.where(F.pmod(F.xxhash64(key), F.lit(n)) < most) if n > most else rows).toPandas()


def momentum_fit(x: np.ndarray, y: np.ndarray, ridge: float, rate: float = 0.05, steps: int = 600, patience: int = 40) -> tuple[np.ndarray, np.ndarray]:
    """(coefficients, scales) of a logistic fit without intercept on mirrored rows, by Adam; stops when the loss stalls."""
    scales = np.sqrt((x**2).mean(0))
    scales[scales == 0] = 1.0
    z, b = x / scales, np.zeros(x.shape[1])
    first, second, best, best_b, stalled = np.zeros_like(b), np.zeros_like(b), np.inf, b, 0
    for t in range(1, steps + 1):
        margin = np.clip(z @ b, -30, 30)
        loss = float(np.mean(np.logaddexp(0, margin) - y * margin) + ridge / 2 * b @ b)
        if loss < best - 1e-9:
            best, best_b, stalled = loss, b.copy(), 0
        elif (stalled := stalled + 1) > patience:
            break
        g = z.T @ (1 / (1 + np.exp(-margin)) - y) / len(y) + ridge * b
        first, second = 0.9 * first + 0.1 * g, 0.999 * second + 0.001 * g * g
        b = b - rate * (first / (1 - 0.9**t)) / (np.sqrt(second / (1 - 0.999**t)) + 1e-8)
    return best_b, scales


def choose(grid: list[float], judge: Callable[[float], tuple[float, float]]) -> float:
    """The value with the least (log loss, Brier); earlier values win ties (X11)."""
    return min(grid, key=judge)


def paired_bootstrap(rows: DataFrame, date: str, p_new: str, p_old: str, y: str, draws: int = 2000, most_dates: int = 200_000) -> tuple[float, float]:
    """95 % interval of the Brier difference new - old, whole dates drawn together in date order.

    Only a sum and a count per date reach the driver; more dates than most_dates raise ValueError.
    """
    gap = F.pow(F.col(p_new) - F.col(y), 2) - F.pow(F.col(p_old) - F.col(y), 2)
    by_date = rows.where(gap.isNotNull()).groupBy(date).agg(F.sum(gap).alias("s"), F.count("*").alias("n")).orderBy(date).limit(most_dates + 1).toPandas()
    if not 0 < len(by_date) <= most_dates:
        raise ValueError(f"{len(by_date)} dates")
    sums, counts, k, seed, out = by_date["s"].to_numpy(), by_date["n"].to_numpy(), len(by_date), LCG_SEED, []
    for _ in range(draws):
        picks = np.empty(k, np.int64)
        for j in range(k):
            seed = (LCG_STEP * seed + LCG_ADD) % LCG_SIZE
            picks[j] = seed * k // LCG_SIZE
        out.append(sums[picks].sum() / counts[picks].sum())
    out.sort()
    return float(out[draws // 40]), float(out[draws - draws // 40 - 1])


def promoted(new: dict[str, Column], old: dict[str, Column]) -> Column:
    """Brier and log loss fall, and accuracy falls by half a point at most."""
    return (new["brier"] < old["brier"]) & (new["log_loss"] < old["log_loss"]) & (new["accuracy"] >= old["accuracy"] - ACCURACY_LOSS)


def drivers(groups: dict[str, Column]) -> Column:
    """The three groups of largest absolute contribution, as array<struct<name, value>>; names break ties."""
    parts = F.filter(F.array(*[F.struct((-F.abs(v)).alias("k"), F.lit(n).alias("name"), v.alias("value")) for n, v in groups.items()]), lambda x: -x["k"] > SMALLEST_DRIVER)
    return F.transform(F.slice(F.array_sort(parts), 1, TOP_DRIVERS), lambda x: F.struct(x["name"].alias("name"), x["value"].alias("value")))


def rated_or_elo(rated: Column, elo_a: Column, elo_b: Column) -> list[Column]:
    """[probability, method]: the rated probability, else one from ratings by the fixed slope."""
    return [F.coalesce(rated, 1 / (1 + F.exp(-ELO_SLOPE * (elo_a - elo_b)))).alias("probability"), F.when(rated.isNotNull(), "rated").otherwise("elo").alias("method")]


def recovered(stored: Column, again: Column) -> Column:
    """available if a recomputed probability agrees with the stored one to 1e-12, else unavailable."""
    return F.when(F.abs(stored - again) <= RECOVERY_TOLERANCE, "available").otherwise("unavailable")
