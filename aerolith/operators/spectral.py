"""Random-matrix diagnostic of the feature correlations. Only p x p matrices come to the driver."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from aerolith.operators.kernels import global_shift_gram, grouped_shift_gram, shuffled_gram
from aerolith.operators.quantiles import overall
from aerolith.sources.scratch import written

#: Null models by name: shifts inside stations, shifts over all rows, and columns permuted on their own.
NULLS = {"grouped_shift": grouped_shift_gram, "global_shift": global_shift_gram, "column_shuffle": shuffled_gram}


def usable_features(rows: DataFrame, columns: Sequence[str]) -> list[str]:
    """Columns with two values or more; infinities count as missing. A ValueError if fewer than two are left."""
    finite = {c: F.when(F.abs(c) < float("inf"), F.col(c).cast("double")) for c in columns}
    row = rows.agg(*(F.min(v).alias(f"lo_{c}") for c, v in finite.items()), *(F.max(v).alias(f"hi_{c}") for c, v in finite.items())).first()
    out = [c for c in columns if row[f"lo_{c}"] is not None and row[f"lo_{c}"] != row[f"hi_{c}"]]
    if len(out) < 2:
        raise ValueError("fewer than two usable features")
    return out


def standardised(rows: DataFrame, columns: Sequence[str]) -> tuple[DataFrame, list[str]]:
    """Medians for missing values, then (x - mean) / deviation (ddof 0); columns without variance are dropped."""
    finite = rows.withColumns({c: F.when(F.abs(c) < float("inf"), F.col(c).cast("double")) for c in columns})
    middle = overall(finite, columns, [0.5])
    full = finite.fillna({c: q[0] for c, q in middle.items() if q is not None})
    row = full.agg(*(F.avg(c).alias(f"m_{c}") for c in columns), *(F.stddev_pop(c).alias(f"s_{c}") for c in columns)).first()
    kept = [c for c in columns if row[f"s_{c}"]]
    return full.withColumns({c: (F.col(c) - row[f"m_{c}"]) / row[f"s_{c}"] for c in kept}), kept


def marchenko_pastur(n: int, p: int) -> tuple[float, float]:
    q = p / n
    return (1 - q**0.5) ** 2, (1 + q**0.5) ** 2


def spectrum(gram: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, descending, and vectors of the correlation matrix."""
    values, vectors = np.linalg.eigh(gram / n)
    return values[::-1], vectors[:, ::-1]


def diagnostic(rows: DataFrame, columns: Sequence[str], iterations: int = 100, seed: int = 0, null: str = "grouped_shift") -> dict[str, DataFrame]:
    """eigenvalues, loadings and summary, with null spectra of a model of NULLS."""
    spark = rows.sparkSession
    z, names = standardised(rows, usable_features(rows, columns))
    z = written(z.select("station_id", "day", *names), "standardised")
    n, p = z.count(), len(names)
    grams = {r[0]: np.array(r[1]).reshape(p, p) for r in NULLS[null](z, names, "station_id", "day", iterations, seed).collect()}
    values, vectors = spectrum(grams[0], n)
    nulls = np.array([spectrum(grams[i], n)[0] for i in range(1, iterations + 1)]) if iterations else np.zeros((1, p))
    low, high = marchenko_pastur(n, p)
    p95, p99 = np.quantile(nulls, 0.95, axis=0), np.quantile(nulls, 0.99, axis=0)
    share = np.cumsum(values) / values.sum()
    table = [(i + 1, float(v), float(v / values.sum()), float(share[i]), bool(v > high), bool(v < low), float(p95[i]), float(p99[i]), bool(v > p95[i])) for i, v in enumerate(values)]
    signal = [i for i, v in enumerate(values) if v > high][:12] or list(range(min(3, p)))
    loadings = [(i + 1, k + 1, names[j], float(vectors[j, i])) for i in signal for k, j in enumerate(np.argsort(-np.abs(vectors[:, i]), kind="stable")[:12])]
    one = [(n, p, float(low), float(high), int((values > high).sum()), int((values > p95).sum()), float(values[0]), float(p95[0]), float(p99[0]))]
    return {
        "eigenvalues": spark.createDataFrame(table, "place int, eigenvalue double, ratio double, cumulative double, above_mp boolean, below_mp boolean, null_p95 double, null_p99 double, above_null boolean"),
        "loadings": spark.createDataFrame(loadings, "component int, place int, feature string, loading double"),
        "summary": spark.createDataFrame(one, "n_rows int, n_features int, mp_low double, mp_high double, n_above_mp int, n_above_null int, largest double, null_p95 double, null_p99 double"),
    }
