"""Whitening of embeddings from a covariance that is made in tiles.

Entries are put on a grid of 1 / scale as integers, and equal vectors are fitted once. Each task cuts its vectors into blocks
of rows and a block's centred columns into column blocks; column blocks of the same rows meet by a join on the row block, each
pair of them is the key of a tile and is multiplied, and a tile's products are summed, inside a task first. The driver puts
the tiles together, the only thing it holds (dimensions squared), and decomposes the matrix. Vectors are never on the driver;
what is sent to all tasks are the means and the components kept.

Defined results: a null vector, and one with a null or non-finite entry, is left out, and so is one whose length is not the
most frequent among distinct vectors (the greatest of several such lengths). A component without variance has whitened null,
and explained null where no component has any; identity_error is over the components with variance, and null without any.
deviation is null where the exact sum does not fit into a long. Repeated rows and ids keep a row each; empty tables give empty
results. Other columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

SCALE = 256
#: Rows of a row block; least width of a column block, and most column blocks.
BLOCK_ROWS, LEAST_WIDTH, MOST_COLUMNS = 4_096, 16, 16
#: Components with less than this part of the greatest variance have none.
LEAST_VARIANCE = 1e-12
#: Bytes of tiles that a task sums before it gives them out.
TILE_BYTES = 64 << 20


@dataclass(frozen=True)
class Whitening:
    n: int
    sums: tuple[int, ...]
    values: np.ndarray
    #: A component a column, the greatest variance first.
    components: np.ndarray
    trace: float

    @property
    def mean(self) -> np.ndarray:
        return np.array([s / self.n for s in self.sums])

    def usable(self, k: int) -> np.ndarray:
        """Which of the first k components have variance."""
        return self.values[:k] > LEAST_VARIANCE * max(self.values[0], 0.0) if len(self.values) and self.values[0] > 0 else np.zeros(min(k, len(self.values)), bool)

    def project(self, x: np.ndarray, k: int) -> np.ndarray:
        """Rows of integers as their first k whitened components; NaN where a component has no variance."""
        scale = np.where(self.usable(k), np.sqrt(np.maximum(self.values[:k], 0)), np.nan)
        return (x - self.mean) @ self.components[:, :k] / scale

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """Of each row the sum over dimensions of (n x - S)^2, exact."""
        most = max((max(abs(self.n * int(e) - s) for e in (low, high)) for s, low, high in zip(self.sums, x.min(axis=0, initial=0), x.max(axis=0, initial=0), strict=True)), default=0)
        if most * most * max(1, len(self.sums)) < 1 << 63:
            apart = x * np.int64(self.n) - np.array(self.sums, np.int64)
            return (apart * apart).sum(axis=1).tolist()
        whole = [sum((self.n * e - s) ** 2 for e, s in zip(row, self.sums, strict=True)) for row in x.tolist()]
        return [d if d < 1 << 63 else None for d in whole]


def on_grid(vector: Column, scale: int = SCALE) -> Column:
    """floor(scale * entry) of each entry as longs; null for vectors that are null or hold a null or non-finite entry."""
    usable = F.forall(vector, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    return F.when(usable, F.transform(vector, lambda c: F.floor(c.cast("double") * scale).cast("long")))


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def _sums(fitted: DataFrame, width: int) -> list[int]:
    """The sum of each dimension: a row for each task and dimension, then for each dimension."""

    def run(batches):
        held = [0] * width
        for batch in batches:
            x = _matrix(batch.column("x"), width)
            safe = int(max(abs(int(x.min(initial=0))), abs(int(x.max(initial=0))))) * len(x) < 1 << 63
            held = [a + int(b) for a, b in zip(held, x.sum(axis=0) if safe else x.astype(object).sum(axis=0), strict=True)]
        yield pa.record_batch({"dimension": pa.array(range(width), pa.int32()), "total": [str(v) for v in held]})

    parts = fitted.select("x").mapInArrow(run, "dimension int, total string")
    found = parts.groupBy("dimension").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total")).collect()
    return [int(r["total"]) for r in sorted(found, key=lambda r: r["dimension"])]


def column_blocks(fitted: DataFrame, mean: np.ndarray, width: int) -> DataFrame:
    """row_block, column_block, cells: the centred columns of each block of rows, so many at a time, as doubles row by row."""
    size = len(mean)

    def run(batches):
        part, k = TaskContext.get().partitionId() << 32, 0
        for batch in batches:
            x = _matrix(batch.column("x"), size) - mean
            for at in range(0, len(x), BLOCK_ROWS):
                rows = x[at : at + BLOCK_ROWS]
                cells = [np.ascontiguousarray(rows[:, c : c + width]).tobytes() for c in range(0, size, width)]
                yield pa.record_batch({"row_block": pa.array([part + k] * len(cells), pa.int64()), "column_block": pa.array(range(len(cells)), pa.int32()), "cells": pa.array(cells, pa.binary())})
                k += 1

    return fitted.select("x").mapInArrow(run, "row_block long, column_block int, cells binary")


def tile_products(blocks: DataFrame, size: int, width: int) -> DataFrame:
    """i, j, tile: for i <= j the product of column blocks i and j, summed over all row blocks."""
    widths = [min(width, size - c) for c in range(0, size, width)]
    left = blocks.select("row_block", F.col("column_block").alias("i"), F.col("cells").alias("left"))
    right = blocks.select("row_block", F.col("column_block").alias("j"), F.col("cells").alias("right"))
    pairs = left.join(right, "row_block").where("i <= j").select("i", "j", "left", "right")

    def batch_of(held):
        return pa.record_batch({"i": pa.array([k[0] for k in held], pa.int32()), "j": pa.array([k[1] for k in held], pa.int32()), "tile": pa.array([t.tobytes() for t in held.values()], pa.binary())})

    def multiply(batches):
        held: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            for i, j, a, b in zip(*(batch.column(c) for c in ("i", "j", "left", "right")), strict=True):
                key = i.as_py(), j.as_py()
                tile = np.frombuffer(a.as_buffer()).reshape(-1, widths[key[0]]).T @ np.frombuffer(b.as_buffer()).reshape(-1, widths[key[1]])
                held[key] = held[key] + tile if key in held else tile
            if sum(t.nbytes for t in held.values()) >= TILE_BYTES:
                yield batch_of(held)
                held = {}
        if held:
            yield batch_of(held)

    def added(table: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(t.as_buffer()) for chunk in table["tile"].chunks for t in chunk)
        return pa.table({"i": table["i"].slice(0, 1), "j": table["j"].slice(0, 1), "tile": pa.array([total.tobytes()], pa.binary())})

    kind = "i int, j int, tile binary"
    return pairs.mapInArrow(multiply, kind).groupBy("i", "j").applyInArrow(added, kind)


def assembled(tiles: list, size: int, width: int) -> np.ndarray:
    out = np.zeros((size, size))
    for i, j, tile in tiles:
        rows, columns = slice(i * width, min(size, (i + 1) * width)), slice(j * width, min(size, (j + 1) * width))
        out[rows, columns] = np.frombuffer(tile).reshape(out[rows, columns].shape)
        out[columns, rows] = out[rows, columns].T
    return out


def fit(vectors: DataFrame, vector: str = "embedding", scale: int = SCALE) -> tuple[Whitening, DataFrame]:
    """The whitening of the distinct vectors on the grid, and those vectors as column x."""
    distinct = common.saved(vectors.select(on_grid(F.col(vector), scale).alias("x")).where(F.col("x").isNotNull()).distinct(), "vectors")
    most = distinct.groupBy(F.size("x").alias("size")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("size")).first()
    n, size = (most["n"], most["size"]) if most else (0, 0)
    fitted = distinct.where(F.size("x") == size)
    if not n or not size:
        return Whitening(n, (), np.zeros(0), np.zeros((0, 0)), 0.0), fitted
    sums = _sums(fitted, size)
    width = max(LEAST_WIDTH, -(-size // MOST_COLUMNS))
    mean = np.array([s / n for s in sums])
    tiles = tile_products(common.saved(column_blocks(fitted, mean, width), "columns"), size, width).collect()
    covariance = assembled(tiles, size, width) / n
    values, components = np.linalg.eigh(covariance)
    values, components = values[::-1], components[:, ::-1]
    signs = np.sign(components[np.abs(components).argmax(axis=0), range(size)])
    return Whitening(n, tuple(sums), values, components * signs, float(np.trace(covariance))), fitted


def identity_error(model: Whitening, fitted: DataFrame, k: int) -> float | None:
    """Largest absolute entry of the covariance of what the fit list is whitened to, less the identity; measured on all of it."""
    own, size = np.flatnonzero(model.usable(k)), len(model.sums)
    if not len(own):
        return None

    def run(batches):
        total, products = np.zeros(len(own)), np.zeros((len(own), len(own)))
        for batch in batches:
            y = model.project(_matrix(batch.column("x"), size), k)[:, own]
            total, products = total + y.sum(axis=0), products + y.T @ y
        cells = np.concatenate([total, products.reshape(-1)])
        yield pa.record_batch({"cell": pa.array(range(len(cells)), pa.int32()), "value": cells})

    found = fitted.select("x").mapInArrow(run, "cell int, value double").groupBy("cell").agg(F.sum("value").alias("value")).collect()
    cells = np.array([r["value"] for r in sorted(found, key=lambda r: r["cell"])]) / model.n
    mean = cells[: len(own)]
    return float(np.abs(cells[len(own) :].reshape(len(own), -1) - np.outer(mean, mean) - np.eye(len(own))).max())


def whitened(vectors: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", components: int = 4, scale: int = SCALE) -> DataFrame:
    """vec_id, component (from 1), n, deviation, whitened, explained, identity_error for each vector that remains and each component up to so many."""
    model, fitted = fit(vectors, vector, scale)
    size = len(model.sums)
    k = min(components, size)
    error = identity_error(model, fitted, k)
    explained = [float(v / model.trace) if model.trace > 0 else None for v in model.values[:k]]
    schema = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"

    def run(batches):
        for batch in batches:
            x = _matrix(batch.column("x"), size)
            y = model.project(x, k).reshape(-1)
            yield pa.record_batch({
                "vec_id": batch.column("vec_id").take(pa.array(np.repeat(np.arange(len(x)), k))),
                "component": pa.array(np.tile(np.arange(1, k + 1), len(x)), pa.int32()), "n": pa.array([model.n] * (len(x) * k), pa.int64()),
                "deviation": pa.array([d for d in model.deviations(x) for _ in range(k)], pa.int64()), "whitened": pa.array(y, mask=np.isnan(y)),
                "explained": pa.array(explained * len(x), pa.float64()), "identity_error": pa.array([error] * (len(x) * k), pa.float64()),
            })

    own = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), on_grid(F.col(vector), scale).alias("x"))
    if not k:
        return own.where(F.lit(False)).mapInArrow(lambda batches: iter(()), schema)
    return own.where(F.size("x") == size).mapInArrow(run, schema)
