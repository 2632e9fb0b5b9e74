"""Gram matrices as stored blocks: partial products per Arrow batch, summed row by row, and prefix sums over time.

The Gram matrix of ``[1, x, y]`` is all that least squares and ridge need of the rows. Tasks multiply their batches as
matrices, so a column of arrays (an embedding) costs no expression per pair of entries. A partial matrix leaves its task
as one record per matrix row, and records are summed per (block, row): the merge of a wide matrix is spread over as many
tasks as it has rows. With a block per calendar quarter, the matrix of "all rows before t" is a prefix sum, so any number
of expanding windows costs one pass over the rows.

A row with a null or NaN entry is left out. Blocks without rows do not appear; a bound before all blocks has no matrix."""

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Memory that a task may spend on partial matrices before it hands them on.
MOST_BYTES = 1 << 26
AT_ONCE = 2048
BLOCK = "block long, i int, row array<double>"


def quarter(day: Column) -> Column:
    """Calendar quarters in a row, as one number."""
    return (F.year(day) * 4 + F.quarter(day) - 1).cast("long")


def gram_blocks(
    df: DataFrame, features: list[Column], targets: Column | list[Column], block: Column, codes: list[tuple[Column, int]] | None = None
) -> DataFrame:
    """``block, i, row``: row ``i`` of the Gram matrix of ``[1, features..., one-hot codes..., targets...]`` over the rows
    of each block. Features are numbers or arrays of numbers, of one length each. ``codes`` are categories numbered from
    0 on with how many there are; they are spread to one-hot columns inside the task, and null has none."""
    targets = targets if isinstance(targets, list) else [targets]
    codes = codes or []
    arrays = [F.array(f.cast("double")) if not is_array(df, f) else f.cast("array<double>") for f in features]
    rows = df.select(
        block.cast("long").alias("block"), F.concat(F.array(F.lit(1.0)), *arrays).alias("v"),
        F.array(*(F.coalesce(c.cast("int"), F.lit(-1)) for c, _ in codes)).cast("array<int>").alias("c"),
        F.array(*(t.cast("double") for t in targets)).alias("y"),
    ).where("block IS NOT NULL AND v IS NOT NULL")
    levels = [n for _, n in codes]

    def matrix(batch: pa.RecordBatch, name: str, width: int | None = None) -> np.ndarray:
        flat = batch.column(name).flatten().to_numpy(zero_copy_only=False)
        return flat.reshape(len(batch), -1 if width is None else width)

    def wide(batch: pa.RecordBatch) -> np.ndarray:
        parts = [matrix(batch, "v").astype(float)]
        held = matrix(batch, "c", len(levels))
        for k, n in enumerate(levels):
            one = np.zeros((len(batch), n))
            known = np.flatnonzero((held[:, k] >= 0) & (held[:, k] < n))
            one[known, held[known, k]] = 1.0
            parts.append(one)
        return np.concatenate([*parts, matrix(batch, "y").astype(float)], axis=1)

    def told(held: dict[int, np.ndarray]) -> pa.RecordBatch:
        keys = [k for k, m in held.items() for _ in range(len(m))]
        return pa.RecordBatch.from_arrays(
            [pa.array(keys, pa.int64()), pa.array([i for m in held.values() for i in range(len(m))], pa.int32()),
             pa.array([r for m in held.values() for r in m], pa.list_(pa.float64()))], names=["block", "i", "row"],
        )

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for first in range(0, len(batch), AT_ONCE):
                part = batch.slice(first, AT_ONCE)
                x, keys = wide(part), part.column("block").to_numpy()
                sound = np.isfinite(x).all(axis=1)
                for k in np.unique(keys[sound]).tolist():
                    own = x[sound & (keys == k)]
                    held[k] = own.T @ own + held.get(k, 0.0)
                if sum(m.nbytes for m in held.values()) > MOST_BYTES:
                    yield told(held)
                    held = {}
        if held:
            yield told(held)

    partial = rows.mapInArrow(multiply, BLOCK)

    def add(rows: pd.DataFrame) -> pd.DataFrame:
        total = np.sum(np.stack(rows["row"].to_numpy()), axis=0)
        return pd.DataFrame({"block": rows["block"].iloc[:1], "i": rows["i"].iloc[:1], "row": [total.tolist()]})

    return partial.groupBy("block", "i").applyInPandas(add, BLOCK)


def is_array(df: DataFrame, column: Column) -> bool:
    return df.select(column.alias("c")).schema["c"].dataType.typeName() == "array"


def prefix_grams(blocks: DataFrame, bounds: list[int]) -> DataFrame:
    """``bound, i, row``: the matrix of all blocks before each bound. A task holds one row of the matrix for all blocks."""

    def sums(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("block")
        keys, upto = rows["block"].to_numpy(), np.cumsum(np.stack(rows["row"].to_numpy()), axis=0)
        found = [(b, int(n) - 1) for b in bounds if (n := np.searchsorted(keys, b))]
        return pd.DataFrame({
            "bound": [b for b, _ in found], "i": [rows["i"].iloc[0]] * len(found), "row": pd.Series([upto[n].tolist() for _, n in found], dtype=object),
        })

    return blocks.groupBy("i").applyInPandas(sums, "bound long, i int, row array<double>")


def ridge_from_grams(grams: DataFrame, alphas: list[float], by: str = "bound") -> DataFrame:
    """``by, alpha, n, intercept, coefficients``: ridge on columns standardised by the population deviation (a constant
    column gets 0), on the raw scale. A task holds one matrix."""
    everything = ridge_sets(grams, alphas, {"": None}, [""], by)
    return everything.drop("features", "target")


def ridge_sets(grams: DataFrame, alphas: list[float], sets: dict[str, list[int] | None], targets: list[str], by: str = "bound") -> DataFrame:
    """The same for several sets of columns (numbers from 0 on, None for all) and targets, the last rows of the matrix:
    ``by, features, target, alpha, n, intercept, coefficients``. Columns outside a set have coefficient 0."""

    def solve(rows: pd.DataFrame) -> pd.DataFrame:
        gram = np.stack(rows.sort_values("i")["row"].to_numpy())
        p = len(gram) - 1 - len(targets)
        out = []
        for name, chosen in sets.items():
            columns = np.arange(p) if chosen is None else np.array(chosen, dtype=int)
            for t, target in enumerate(targets):
                place = np.concatenate([[0], 1 + columns, [1 + p + t]])
                for a in alphas:
                    intercept, beta = solve_ridge(gram[np.ix_(place, place)], a)
                    full = np.zeros(p)
                    full[columns] = beta
                    out.append((rows[by].iloc[0], name, target, a, int(round(gram[0, 0])), intercept, full.tolist()))
        return pd.DataFrame(out, columns=[by, "features", "target", "alpha", "n", "intercept", "coefficients"])

    kind = grams.schema[by].dataType.simpleString()
    return grams.groupBy(by).applyInPandas(
        solve, f"{by} {kind}, features string, target string, alpha double, n long, intercept double, coefficients array<double>"
    )


def solve_ridge(gram: np.ndarray, alpha: float) -> tuple[float, list[float]]:
    n, p = gram[0, 0], len(gram) - 2
    mean, y = gram[0, 1 : p + 1] / n, gram[0, -1] / n
    cov = gram[1 : p + 1, 1 : p + 1] / n - np.outer(mean, mean)
    variance = np.diag(cov).copy()
    flat = variance <= 1e-12 * np.maximum(np.diag(gram)[1 : p + 1] / n, 1e-300)
    scale = np.sqrt(np.where(flat, 1.0, variance))
    z = n * cov / np.outer(scale, scale)
    z[flat, :] = z[:, flat] = 0.0
    xy = np.where(flat, 0.0, (gram[1 : p + 1, -1] - n * mean * y) / scale)
    beta = np.linalg.solve(z + max(alpha, 1e-12) * np.eye(p), xy) / scale
    return float(y - beta @ mean), beta.tolist()
