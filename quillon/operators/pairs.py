"""All pairs of vectors, block by block, in Arrow batches: products of matrices instead of a row for each pair.

`packed` makes rows of up to ROWS vectors, `compared` joins two such relations and hands each
pair of blocks to a function, which reduces it to a row for each vector, so that what is written
between stages grows with the vectors and not with their pairs. Distances come from products;
those so small that the products' rounding would show are taken anew from the components.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Vectors that a block holds, and those of one side that are compared at once.
ROWS, AT_ONCE = 2048, 512
#: Vectors of a block that is searched by leaves, of a leaf, and of a block that is searched for.
TREE, LEAF, SOUGHT = 32_768, 256, 8192
#: Numbers from which leaves are not used, as their squares need not be finite.
HUGE = 1e100
#: Squared distances below this part of the squared lengths are taken from the components.
NEAR = 1e-6


class Block:
    """Vectors of one row: m (a row each, filled up with zeros), sizes (-1: null, or with a null component), and their columns as Arrow arrays."""

    def __init__(self, row: dict[str, pa.Scalar], prefix: str, columns: list[str]):
        self.columns = {c: row[prefix + c].values for c in columns}
        self.sizes = np.frombuffer(row[prefix + "sizes"].as_buffer(), np.int32)
        self.m = np.frombuffer(row[prefix + "m"].as_buffer(), np.float64).reshape(len(self.sizes), -1) if len(row[prefix + "m"].as_buffer()) else np.zeros((len(self.sizes), 0))

    def numbers(self, column: str) -> np.ndarray:
        return self.columns[column].to_numpy(zero_copy_only=False)

    def parts(self) -> Iterator[slice]:
        return (slice(k, k + AT_ONCE) for k in range(0, len(self.sizes), AT_ONCE))


def _matrix(v: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    sizes = pc.fill_null(pc.list_value_length(v), -1).to_numpy(zero_copy_only=False).astype(np.int32)
    flat = v.flatten()
    if flat.null_count:
        sizes = np.array([-1 if x is None or None in x else len(x) for x in v.to_pylist()], np.int32)
        flat = pa.array([y for x, n in zip(v.to_pylist(), sizes, strict=True) if n > 0 for y in x], pa.float64())
    flat, width = flat.to_numpy(zero_copy_only=False), max(int(sizes.max(initial=0)), 0)
    if (sizes == width).all():
        return sizes, flat.reshape(len(sizes), width)
    m = np.zeros((len(sizes), width))
    m[np.arange(width)[None, :] < sizes[:, None]] = flat
    return sizes, m


def packed(rows: DataFrame, vector: str, columns: list[str], keys: list[str] = (), parts: int = 0, order: str | None = None, most: int = ROWS) -> DataFrame:
    """keys, columns (as arrays), sizes, m: blocks of up to `most` vectors of equal keys, in `order`; dealt to `parts` partitions, whole keys with an order."""
    spark, keys = rows.sparkSession, list(keys)
    parts = parts or max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    dealt = [*keys, F.pmod(F.xxhash64(columns[0]), F.lit(max(1, parts // 4)))] if keys and not order else keys  # vectors of one key go to several partitions
    rows = rows.select(*keys, *columns, F.col(vector).cast("array<double>").alias("v"))
    rows = rows.repartition(parts, *dealt)
    if keys:
        rows = rows.sortWithinPartitions(*keys, *([order] if order else []))
    types = dict(rows.dtypes)
    schema = ", ".join([*(f"`{k}` {types[k]}" for k in keys), *(f"`{c}` array<{types[c]}>" for c in columns), "sizes binary", "m binary"])

    def block(pending: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(pending).combine_chunks()
        of = {n: table[n].chunk(0) for n in table.column_names}
        sizes, m = _matrix(of["v"])
        ends = pa.array([0, len(sizes)], pa.int32())
        out = {k: of[k].slice(0, 1) for k in keys} | {c: pa.ListArray.from_arrays(ends, of[c]) for c in columns}
        return pa.record_batch({**out, "sizes": pa.array([sizes.tobytes()], pa.binary()), "m": pa.array([np.ascontiguousarray(m).tobytes()], pa.binary())})

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pending, held, last = [], 0, None
        for batch in batches:
            of = list(zip(*(batch.column(batch.schema.get_field_index(k)).to_pylist() for k in keys), strict=True)) if keys else [()] * batch.num_rows
            at = 0
            while at < len(of):
                if pending and (of[at] != last or held >= most):
                    yield block(pending)
                    pending, held = [], 0
                last, end = of[at], at
                while end < len(of) and of[end] == last and held + end - at < most:
                    end += 1
                pending.append(batch.slice(at, end - at))
                held, at = held + end - at, end
        if pending:
            yield block(pending)

    return rows.mapInArrow(pack, schema)


def compared(left: DataFrame, right: DataFrame, on: list[str], each: Callable[[dict, Block, Block], Iterator[dict]], schema: str) -> DataFrame:
    """What `each` yields (columns by name) for the keys (those of right as r_<key>) and the blocks of each pair that agrees in `on`."""
    fixed = ("sizes", "m")
    lists = {"": [n for n, t in left.dtypes if t.startswith("array")], "r_": [n for n, t in right.dtypes if t.startswith("array")]}
    keys = [n for n in left.columns if n not in lists[""] and n not in fixed] + [f"r_{n}" for n in right.columns if n not in lists["r_"] and n not in fixed]
    other = right.select(*(F.col(n).alias(f"r_{n}") for n in right.columns))
    # the smaller side has been marked for broadcast by its count of vectors
    pairs = left.crossJoin(other) if not on else left.join(other, [F.col(k) == F.col(f"r_{k}") for k in on])
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                row = {n: batch.column(i)[k] for i, n in enumerate(batch.schema.names)}
                a, b = Block(row, "", lists[""]), Block(row, "r_", lists["r_"])
                for found in each({n: row[n] for n in keys}, a, b):
                    size = max(len(x) for x in found.values() if not isinstance(x, pa.Scalar))
                    yield pa.record_batch([pa.repeat(found[n], size) if isinstance(found[n], pa.Scalar) else found[n] for n in names], names)

    return pairs.mapInArrow(run, schema)


def _leaves(m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """m's rows in an order in which those of a leaf stand together, and where each leaf ends: halves of the widest axis until LEAF rows are left."""
    order, sizes, todo = [], [], [np.arange(len(m))]
    while todo:
        rows = todo.pop()
        low, high = m[rows].min(axis=0), m[rows].max(axis=0)
        axis = int((high - low).argmax())
        left = m[rows, axis] <= low[axis] + (high[axis] - low[axis]) / 2
        if len(rows) <= LEAF or left.all():
            order.append(rows)
            sizes.append(len(rows))
        else:
            todo += [rows[~left], rows[left]]
    return np.concatenate(order), np.cumsum(sizes)


def leaved(blocks: DataFrame) -> DataFrame:
    """blocks (sizes, m) with ends: where each leaf ends, the vectors being put in their leaves' order; none where vectors differ in size or are not finite (squares included)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                b = Block({n: batch.column(n)[row] for n in batch.schema.names}, "", [])
                m, ends = b.m, np.zeros(0, int)
                if m.size and (b.sizes == b.sizes[0]).all() and np.abs(m).max() < HUGE:
                    order, ends = _leaves(m)
                    m = m[order]
                yield pa.record_batch({"sizes": pa.array([b.sizes.tobytes()], pa.binary()), "m": pa.array([m.tobytes()], pa.binary()), "ends": pa.array([ends], pa.list_(pa.int32()))})

    return blocks.mapInArrow(run, "sizes binary, m binary, ends array<int>")


def nearest(a: Block, b: Block) -> np.ndarray | None:
    """The squared distance of each of a's vectors to the nearest of b's, which has leaves; None where they can't be used.

    A leaf's vectors lie within a ball. Those of the leaf whose ball is nearest are compared
    first, then those of each leaf whose ball begins no farther than what was found.
    """
    ends = b.numbers("ends")
    if not len(ends) or (a.sizes != b.sizes[0]).any() or not np.abs(a.m).max() < HUGE:
        return None
    starts = np.r_[0, ends[:-1]]
    centre = (np.minimum.reduceat(b.m, starts) + np.maximum.reduceat(b.m, starts)) / 2
    apart = b.m - np.repeat(centre, ends - starts, axis=0)
    radius = np.sqrt(np.maximum.reduceat(np.einsum("ij,ij->i", apart, apart), starts))
    away = np.sqrt(squared(a.m, centre)) - radius
    # far more than a product's rounding
    spare = 1e-9 * (np.sqrt(np.einsum("ij,ij->i", a.m, a.m)) + np.sqrt(np.einsum("ij,ij->i", b.m, b.m).max()))
    best = np.full(len(a.m), np.inf)

    def compare(rows: np.ndarray, leaf: np.ndarray) -> None:
        by = np.argsort(leaf, kind="stable")
        rows, leaf = rows[by], leaf[by]
        cuts = np.flatnonzero(np.diff(leaf, prepend=-1, append=-1))
        for k, end in zip(cuts[:-1], cuts[1:], strict=True):
            these, of = rows[k:end], slice(starts[leaf[k]], ends[leaf[k]])
            best[these] = np.minimum(best[these], squared(a.m[these], b.m[of], True).min(axis=1))

    every, first = np.arange(len(a.m)), away.argmin(axis=1)
    compare(every, first)
    away[every, first] = np.inf
    compare(*np.nonzero(away <= (np.sqrt(np.maximum(best, 0)) + spare)[:, None]))
    return best


def excluded(a: Block, s: slice, b: Block, ids: tuple[str, str] | None) -> np.ndarray | None:
    """Pairs of a vector with itself (equal ids), if there are any."""
    if ids is None:
        return None
    mine, others = a.numbers(ids[0])[s], b.numbers(ids[1])
    return mine[:, None] == others[None, :] if np.isin(mine, others).any() else None


def unlike(a: Block, s: slice, b: Block) -> np.ndarray | None:
    """Pairs without a value, if there are any: null vectors, and those of different sizes."""
    if len(b.sizes) and (a.sizes[s] == b.sizes[0]).all() and (b.sizes == b.sizes[0]).all() and b.sizes[0] >= 0:
        return None
    return (a.sizes[s][:, None] != b.sizes[None, :]) | (a.sizes[s][:, None] < 0)


def _even(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    width = max(a.shape[1], b.shape[1])
    return tuple(x if x.shape[1] == width else np.pad(x, ((0, 0), (0, width - x.shape[1]))) for x in (a, b))


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    a, b = _even(a, b)
    with np.errstate(all="ignore"):
        return a @ b.T


def squared(a: np.ndarray, b: np.ndarray, rows_of_least: bool = False) -> np.ndarray:
    """Squared distances of a's and b's rows; rows_of_least: exact only where they may be the least of their row."""
    a, b = _even(a, b)
    with np.errstate(all="ignore"):
        na, nb = np.einsum("ij,ij->i", a, a), np.einsum("ij,ij->i", b, b)
        d = np.column_stack([a, np.ones(len(a)), na]) @ np.column_stack([-2 * b, nb, np.ones(len(b))]).T
        rows = np.arange(len(a))
        if rows_of_least and len(b):
            best = d.argmin(axis=1)
            rows = np.nonzero(~(d[rows, best] > NEAR * (na + nb[best])))[0]
        if len(rows):
            i, j = np.nonzero(~(d[rows] > NEAR * (na[rows][:, None] + nb[None, :])))
            for k in range(0, len(i), 1 << 16):
                at, to = rows[i[k : k + (1 << 16)]], j[k : k + (1 << 16)]
                apart = a[at] - b[to]
                d[at, to] = np.einsum("ij,ij->i", apart, apart)
    return d


def cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Cosines of a's and b's rows; 0 where a row is zero."""
    with np.errstate(all="ignore"):
        size = np.sqrt(np.einsum("ij,ij->i", a, a))[:, None] * np.sqrt(np.einsum("ij,ij->i", b, b))[None, :]
        size[size == 0] = 1.0
        return products(a, b) / size


def least(d: np.ndarray, without: np.ndarray | None) -> pa.Array:
    """The least number of each row, null where no pair has a value; as Spark has it, NaN is greater than any."""
    if without is None:
        return pa.array(np.fmin.reduce(d, axis=1)) if d.shape[1] else pa.nulls(len(d), pa.float64())
    found = np.fmin.reduce(np.where(without, np.nan, d), axis=1)
    return pa.array(found, mask=without.all(axis=1))


def either(*masks: np.ndarray | None) -> np.ndarray | None:
    """Pairs that any of the masks has."""
    some = [m for m in masks if m is not None]
    return np.logical_or.reduce(some) if some else None


def counted(a: Block, s: slice, b: Block, without: np.ndarray | None) -> np.ndarray:
    """How many pairs each vector has."""
    n = len(a.sizes[s])
    return np.full(n, len(b.sizes)) if without is None else len(b.sizes) - without.sum(axis=1)
