"""Embedding whitening by a tiled covariance.

1. Usable vectors become whole numbers; their count and exact sums per dimension are added up task by task.
2. Rows are cut into row-blocks; each block's columns are cut into column blocks of ``tile``
   dimensions. Column blocks are shuffled by row-block, so those of one row-block meet in a task.
3. Pairs of dimensions belong to tiles, the tile keys being pairs of column blocks (a <= b). For each row-block a
   task multiplies the pairs of column blocks and adds the products up per tile; what it has
   added up goes on when the tiles of a task would take more than ``HELD`` bytes, or at its end.
4. Tiles are summed by key, sent to the driver (a number for each pair of dimensions, whatever the rows),
   assembled and eigendecomposed.
5. Each row is projected on the components, over the square roots of their eigenvalues. The
   covariance of the whitened rows is measured by the same tiles.

Defined results: rows whose vector is null, empty, or holds null or non-finite entries are
dropped, and so are vectors of another length than the commonest one (of ties, the longest);
components whose eigenvalue is 0 beside rounding are not returned (so a table of fewer rows than
dimensions, or a constant dimension, gives fewer components; one row gives none); of
equal eigenvalues any orthonormal basis is taken, the same one for all rows; of a component's two signs
the one whose largest entry is positive; rows that share an id are each returned; a deviation beyond a
long is null; entries beyond 2**50 / scale count as that; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillgrid.llm.scratch import discard, settle

#: Dimensions of a column block; bytes of a row-block and of the tiles that a task adds up before it passes them on.
TILE, BLOCK, HELD = 32, 4 << 20, 64 << 20
#: Eigenvalues up to this share of the largest, times the dimensions, are rounding.
ROUNDING = 1e-13
#: Scaled entries beyond it, either way, count as it: sums of a batch then fit in a long.
FAR = 1 << 50


def quantised(vector: Column, scale: float = 64.0, shift: int = 1_000_000) -> Column:
    """floor(scale * c) + shift of each entry c, as longs."""
    far = F.lit(float(FAR))
    return F.transform(vector, lambda c: F.floor(F.greatest(-far, F.least(far, F.lit(scale) * c.cast("double")))).cast("bigint") + F.lit(shift).cast("bigint"))


def usable(vectors: DataFrame, column: str = "embedding") -> DataFrame:
    """Rows whose vector has finite entries only and the commonest length."""
    fine = lambda c: c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) < float("inf"))
    kept = vectors.where(F.col(column).isNotNull() & (F.size(column) > 0) & F.forall(column, fine))
    common = kept.groupBy(F.size(column).alias("d")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.desc("d")).first()
    return kept.where(F.size(column) == (common.d if common else 0))


def matrix(column: pa.Array | pa.ChunkedArray, dims: int) -> np.ndarray:
    """Rows of a list column without nulls, all of the same length."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)


@dataclass
class Moments:
    n: int
    sums: list[int]

    @property
    def mean(self) -> np.ndarray:
        return np.array([s / self.n for s in self.sums])


def moments(rows: DataFrame, column: str = "x") -> Moments:
    """Count and exact sum of each dimension of whole-numbered rows: one number each from a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums = 0, None
        for batch in batches:
            if len(batch):
                x = matrix(batch.column(0), len(batch.column(0)[0]))
                n += len(x)
                sums = [int(s) for s in x.sum(axis=0)] if sums is None else [a + int(s) for a, s in zip(sums, x.sum(axis=0))]
        if sums is not None:
            yield pa.record_batch([pa.array([n] * len(sums), pa.int64()), pa.array(range(len(sums)), pa.int32()), pa.array([str(s) for s in sums])], names=["n", "d", "s"])

    parts = rows.select(column).mapInArrow(run, "n bigint, d int, s string")
    got = parts.groupBy("d").agg(F.sum("n").alias("n"), F.sum(F.col("s").cast("decimal(38,0)")).alias("s")).orderBy("d").collect()
    return Moments(got[0].n if got else 0, [int(r.s) for r in got])


def column_blocks(rows: DataFrame, column: str, dims: int, centre: np.ndarray, tile: int, block: int) -> DataFrame:
    """(row_block, column_block, n, data): centred rows, cut both ways; data is row after row of doubles."""
    most = max(1, block // (8 * dims))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, len(batch), most):
                z = matrix(batch.column(0).slice(lo, most), dims) - centre
                cut = [np.ascontiguousarray(z[:, i : i + tile]).tobytes() for i in range(0, dims, tile)]
                yield pa.record_batch([pa.array(range(len(cut)), pa.int32()), pa.array([len(z)] * len(cut), pa.int32()), pa.array(cut, pa.binary())], names=["column_block", "n", "data"])

    # The column blocks of a row-block leave a task one after the other, so their place in it, over their number, tells the row-block.
    cut = rows.select(column).mapInArrow(run, "column_block int, n int, data binary")
    place = F.monotonically_increasing_id()
    task, count = F.shiftright(place, 33), place.bitwiseAND(F.lit((1 << 33) - 1))
    return cut.withColumn("row_block", F.shiftleft(task, 33) + F.floor(count / -(-dims // tile)))


def tiles(blocks: DataFrame, dims: int, tile: int = TILE, held: int = HELD) -> DataFrame:
    """(a, b, data): for each pair of column blocks a <= b, the summed products of their dimensions, as bytes of doubles."""
    widths = [min(tile, dims - i) for i in range(0, dims, tile)]

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[int, int], np.ndarray] = {}
        now, have, taken = None, [], 0
        for batch in batches:
            for row_block, c, n, data in zip(*(batch.column(i).to_pylist() for i in range(4))):
                if row_block != now:
                    now, have = row_block, []
                z = np.frombuffer(data).reshape(n, widths[c])
                have.append((c, z))
                for a, left in have:
                    product = left.T @ z
                    if (a, c) in sums:
                        sums[a, c] += product
                    else:
                        sums[a, c] = product
                        taken += product.nbytes
                if taken > held:
                    yield _tiles(sums)
                    sums, taken = {}, 0
        if sums:
            yield _tiles(sums)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, total = None, None
        for batch in batches:
            for a, b, data in zip(*(batch.column(i).to_pylist() for i in range(3))):
                z = np.frombuffer(data).reshape(widths[a], widths[b])
                if key == (a, b):
                    total = total + z
                else:
                    if key is not None:
                        yield _tiles({key: total})
                    key, total = (a, b), z
        if key is not None:
            yield _tiles({key: total})

    met = blocks.select("row_block", "column_block", "n", "data").repartition("row_block").sortWithinPartitions("row_block", "column_block")
    schema = "a int, b int, data binary"
    return met.mapInArrow(multiply, schema).repartition("a", "b").sortWithinPartitions("a", "b").mapInArrow(add, schema)


def _tiles(sums: dict[tuple[int, int], np.ndarray]) -> pa.RecordBatch:
    keys = list(sums)
    return pa.record_batch([pa.array([k[0] for k in keys], pa.int32()), pa.array([k[1] for k in keys], pa.int32()), pa.array([np.ascontiguousarray(sums[k]).tobytes() for k in keys], pa.binary())], names=["a", "b", "data"])


def covariance(rows: DataFrame, column: str, n: int, centre: np.ndarray, tile: int = TILE, block: int = BLOCK) -> np.ndarray:
    """Of the rows' dimensions, divisor n, centred before multiplying. Rows must be read in the same order by every task: a written table."""
    dims = len(centre)
    out = np.zeros((dims, dims))
    for r in tiles(column_blocks(rows, column, dims, centre, tile, block), dims, tile).toLocalIterator():
        i, j = r.a * tile, r.b * tile
        z = np.frombuffer(r.data).reshape(min(tile, dims - i), min(tile, dims - j))
        out[i : i + z.shape[0], j : j + z.shape[1]] = z
        out[j : j + z.shape[1], i : i + z.shape[0]] = z.T
    return out / n


@dataclass
class Whitening:
    n: int
    sums: list[int]
    values: np.ndarray
    #: A component in each column, over the square root of its eigenvalue.
    directions: np.ndarray
    explained: np.ndarray


def components_of(found: Moments, v: np.ndarray, most: int) -> Whitening:
    values, vectors = np.linalg.eigh(v)
    values, vectors = values[::-1], vectors[:, ::-1]
    keep = np.flatnonzero(values > max(values[0], 0) * len(values) * ROUNDING)[:most] if len(values) else np.zeros(0, int)
    values, vectors = values[keep], vectors[:, keep]
    if len(keep):
        vectors = vectors * np.sign(vectors[np.abs(vectors).argmax(axis=0), np.arange(len(keep))])
    return Whitening(found.n, found.sums, values, vectors / np.sqrt(values), values / np.trace(v) if len(keep) else values)


def deviations(x: np.ndarray, n: int, sums: list[int]) -> list[int | None]:
    """The sum over dimensions of (n * x - S)^2 of each row, exactly; None beyond a long."""
    d = [[n * int(a) - s for a, s in zip(row, sums)] for row in x.tolist()] if _wide(x, n, sums) else (n * x - np.array(sums, np.int64))
    if isinstance(d, np.ndarray):
        return (d * d).sum(axis=1).tolist()
    out = [sum(a * a for a in row) for row in d]
    return [v if v < 1 << 63 else None for v in out]


def _wide(x: np.ndarray, n: int, sums: list[int]) -> bool:
    """Whether products or sums in 64 bits might run over."""
    most = max((abs(int(x.max())), abs(int(x.min())))) * n if x.size else 0
    if most >= 1 << 62 or max(map(abs, sums), default=0) >= 1 << 62:
        return True
    d = n * x - np.array(sums, np.int64)
    far = max(abs(int(d.max())), abs(int(d.min()))) if d.size else 0
    return far * far * max(x.shape[1], 1) >= 1 << 63


def whitened(rows: DataFrame, w: Whitening, column: str = "x") -> DataFrame:
    """rows with ``deviation`` and ``whitened`` (an array, a number for each component)."""
    kept = [f for f in rows.schema.fields]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept) + ", deviation bigint, whitened array<double>"
    mean, dims, names = np.array([s / w.n for s in w.sums]) if w.n else np.zeros(0), len(w.sums), [f.name for f in kept]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            x = matrix(batch.column(names.index(column)), dims)
            projected = (x - mean) @ w.directions
            k = projected.shape[1]
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * k), pa.array(projected.ravel()))
            yield pa.record_batch([*batch.columns, pa.array(deviations(x, w.n, w.sums), pa.int64()), lists], names=[*names, "deviation", "whitened"])

    return rows.mapInArrow(run, schema)


def whiten(vectors: DataFrame, id_column: str = "vec_id", column: str = "embedding", most: int = 32, tile: int = TILE) -> tuple[DataFrame, Whitening, float]:
    """((id, x, deviation, whitened) of each usable row, the components, the largest entry by which the whitened rows' covariance differs from the identity)."""
    x = settle(usable(vectors, column).select(F.col(id_column), quantised(F.col(column)).alias("x")), "vectors")
    found = moments(x)
    if not found.n:
        return whitened(x, Whitening(0, [], np.zeros(0), np.zeros((0, 0)), np.zeros(0))), Whitening(0, [], np.zeros(0), np.zeros((0, 0)), np.zeros(0)), 0.0
    w = components_of(found, covariance(x, "x", found.n, found.mean, tile), most)
    out = settle(whitened(x, w), "whitened")
    discard(x)
    if not len(w.values):
        return out, w, 0.0
    mean = [r.m for r in out.select(F.posexplode("whitened").alias("k", "v")).groupBy("k").agg(F.avg("v").alias("m")).orderBy("k").collect()]
    error = np.abs(covariance(out, "whitened", w.n, np.array(mean), tile) - np.eye(len(w.values))).max()
    return out, w, float(error)
