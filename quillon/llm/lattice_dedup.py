"""Near-duplicate vectors by lattice hashing.

Unit vectors are projected at random to eight dimensions, scaled and shifted,
and decoded to the nearest point of the E8 lattice, in TABLES tables. A vector
stands in the cell of its point and probes the PROBES neighbouring cells that
are nearest to it. Vectors that meet in a cell, at least one of them as its
owner, are compared by cosine in double precision.

Equal vectors are made one class first. Cells of more than CELL_ROWS rows are
cut into blocks, and each pair of blocks is compared in its own task group, so
no task holds an unbounded cell; pairs never become rows. A task counts a pair
in the first table where it meets (each row carries its cells in all tables),
and passes on each vector's count and a spanning forest of the links.

Defined results: vectors that are null, zero, or hold null or non-finite
components link with nothing, and vectors of different lengths do not link. Rows without an id are
left out of links and are their own component (null). Rows that repeat an id
and its vector are copies of each other, and count as linked; an id with
different vectors has one row for each input row and the component of the
smallest of them. An empty table gives no rows. Other columns, whatever their
names, are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations, product

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.common import checkpointed, parts
from quillon.llm.components import Forest, components

SIMILARITY = 0.95
#: Tables, probed neighbours in each, and the scale of projections of 64 dimensions (it goes with the root of the
#: dimensions, so that projected distances are alike for all): together they find nearly all pairs at the threshold.
TABLES, PROBES, SCALE, SEED = 6, 3, 5.0, 20_260_101
#: Rows of a cell that are compared in one task group, and rows of a strip of the comparison.
CELL_ROWS, STRIP = 8_192, 512


@lru_cache
def neighbours() -> np.ndarray:
    """The 240 shortest vectors of E8."""
    found = []
    for i, j in combinations(range(8), 2):
        for a, b in product((1, -1), repeat=2):
            v = np.zeros(8)
            v[i], v[j] = a, b
            found.append(v)
    found += [np.array(v) for v in product((0.5, -0.5), repeat=8) if sum(x < 0 for x in v) % 2 == 0]
    return np.array(found)


def _nearest_d8(x: np.ndarray) -> np.ndarray:
    """The nearest points of whole numbers with an even sum."""
    near = np.rint(x)
    error = x - near
    odd = np.flatnonzero(near.sum(axis=1) % 2)
    worst = np.abs(error[odd]).argmax(axis=1)
    near[odd, worst] += np.where(error[odd, worst] >= 0, 1, -1)
    return near


def nearest_e8(x: np.ndarray) -> np.ndarray:
    """The nearest E8 points: those of D8, or of D8 moved by a half."""
    whole, half = _nearest_d8(x), _nearest_d8(x - 0.5) + 0.5
    closer = ((x - whole) ** 2).sum(axis=1) <= ((x - half) ** 2).sum(axis=1)
    return np.where(closer[:, None], whole, half)


@lru_cache
def _projections(dim: int) -> list[tuple[np.ndarray, np.ndarray]]:
    rng = np.random.default_rng(SEED)
    scale = SCALE * math.sqrt(max(dim, 8) / 64)
    return [(np.linalg.qr(rng.normal(size=(max(dim, 8), 8)))[0][:dim] * scale, rng.uniform(0, 2, 8)) for _ in range(TABLES)]


def _hash(points: np.ndarray, table: int) -> np.ndarray:
    """A 32-bit name of lattice points; points of one name share a cell."""
    doubled = np.rint(points * 2).astype(np.int64).astype(np.uint64)
    name = np.full(points.shape[:-1], 0x9E3779B97F4A7C15 * (table + 1) & 0xFFFFFFFFFFFFFFFF, dtype=np.uint64)
    for k in range(8):
        name = (name ^ doubled[..., k]) * np.uint64(0xFF51AFD7ED558CCD)
        name ^= name >> np.uint64(32)
    return (name & np.uint64(0xFFFFFFFF)).astype(np.int64)


def cells(unit: np.ndarray) -> np.ndarray:
    """[vector, table, own cell and probed ones] as 32-bit names."""
    out = np.empty((len(unit), TABLES, 1 + PROBES), dtype=np.int64)
    for t, (projection, shift) in enumerate(_projections(unit.shape[1])):
        x = unit @ projection + shift
        own = nearest_e8(x)
        toward = (x - own) @ neighbours().T
        first = np.argsort(-toward, axis=1, kind="stable")[:, :PROBES]
        out[:, t, 0] = _hash(own, t)
        out[:, t, 1:] = _hash(own[:, None, :] + neighbours()[first], t)
    return out


def _unit(vectors: np.ndarray) -> np.ndarray:
    """Unit vectors; scaled by their largest component first, so that no square over- or underflows."""
    vectors = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return vectors / np.sqrt((vectors**2).sum(axis=1, keepdims=True))


def _matrix(column: pa.ListArray, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def _compare(rows: dict[str, np.ndarray], least: float) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """Weighted links of each row of one cell (or pair of its blocks), and a spanning forest of the links."""
    ids, unit, weight, own, side, sign, table = (rows[k] for k in ("id", "unit", "weight", "own", "side", "cells", "table"))
    n = len(ids)
    if len(np.unique(ids)) < n:  # two of a vector's cells share a name: it is there once, as owner if it is one
        order = np.lexsort((~own, ids))
        once = np.sort(order[np.append(True, ids[order][1:] != ids[order][:-1])])
        links = np.zeros(n, dtype=np.int64)
        links[once], edges = _compare({k: v if k == "table" else v[once] for k, v in rows.items()}, least)
        return links, edges
    links, forest, edges = np.zeros(n, dtype=np.int64), Forest(n), []
    for a in range(0, n, STRIP):
        b = min(n, a + STRIP)
        near = unit[a:b] @ unit[a:].T >= least - 1e-9
        i, j = np.nonzero(near)
        i, j = i + a, j + a
        keep = (i < j) & (ids[i] != ids[j]) & (own[i] | own[j]) & ((side[i] != side[j]) | (side[i] == 2))
        i, j = i[keep], j[keep]
        if not len(i):
            continue
        # one formula for all pairs, whatever strip they are met in
        keep = (unit[i] * unit[j]).sum(axis=1) >= least
        for t in range(table):  # met before
            x, y = sign[i, t], sign[j, t]
            keep &= ~((x == y[:, :1]).any(axis=1) | (y == x[:, :1]).any(axis=1))
        # of two meetings in one table, the one in the smaller id's own cell counts
        swap = ids[i] > ids[j]
        small, large = np.where(swap, j, i), np.where(swap, i, j)
        x, y = sign[small, table], sign[large, table]
        keep &= own[small] | ~(y == x[:, :1]).any(axis=1)
        i, j = i[keep], j[keep]
        np.add.at(links, i, weight[j])
        np.add.at(links, j, weight[i])
        edges += [(int(ids[p]), int(ids[q])) for p, q in zip(i.tolist(), j.tolist(), strict=True) if forest.join(p, q)]
    return links, edges


def near_vectors(vectors: DataFrame, least: float = SIMILARITY, id_col: str = "vec_id", vector_col: str = "embedding", cell_rows: int = CELL_ROWS) -> DataFrame:
    """vec_id, n_links, component_id, kept for each row of vectors."""
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"))
    finite = F.forall("v", lambda x: x.isNotNull() & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    valid = F.col("vec_id").isNotNull() & F.coalesce(finite, F.lit(False))
    rows = rows.withColumn("v", F.when(valid, F.col("v")))
    classes = checkpointed(rows.where("v is not null").groupBy("v").agg(F.min("vec_id").alias("id"), F.count(F.lit(1)).alias("weight")))
    counted, links = _links(classes, least, cell_rows)
    of_class = classes.join(counted, "id", "left").select(F.col("v").alias("of"), "id", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"))
    found = rows.join(of_class, F.col("v") == F.col("of"), "left").select("vec_id", "id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))
    # an id joins its classes, so an id that stands for several vectors links them
    links = links.unionByName(found.where("id is not null").select(F.col("vec_id").alias("a"), F.col("id").alias("b")).where("a <> b"))
    of_id = components(links)
    found = found.join(of_id, found["vec_id"] == of_id["id"], "left").select("vec_id", "n_links", F.coalesce("component", "vec_id").alias("component_id"))
    return found.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def _links(classes: DataFrame, least: float, cell_rows: int) -> tuple[DataFrame, DataFrame]:
    """id, links of classes (v, id, weight) that are linked to others; and links a, b that join them.

    Vectors meet those of their own length only: t is the table and, TABLES times, the length.
    """

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths = pc.list_value_length(batch.column(0)).to_numpy(zero_copy_only=False)
            for dim, a in ((int(dim), a) for dim in np.unique(lengths) for a in range(0, int((lengths == dim).sum()), 4096)):
                part = batch.take(pa.array(np.flatnonzero(lengths == dim)[a : a + 4096]))
                sign = cells(_unit(_matrix(part.column(0), dim)))
                n, names = len(sign), pa.array(sign.reshape(-1).astype(np.uint32).view(np.int32), pa.int32())
                signs = pa.FixedSizeListArray.from_arrays(names, TABLES * (1 + PROBES)).cast(pa.list_(pa.int32()))
                for t, k in product(range(TABLES), range(1 + PROBES)):
                    yield pa.record_batch(
                        [pa.array(np.full(n, t + TABLES * dim, dtype=np.int32)), pa.array(sign[:, t, k]), pa.array(np.full(n, k == 0)), part.column(1), part.column(2), part.column(0), signs],
                        ["t", "cell", "own", "id", "weight", "v", "signs"],
                    )

    rows = classes.select("v", "id", "weight").mapInArrow(deal, "t int, cell long, own boolean, id long, weight long, v array<double>, signs array<int>")
    sizes = classes.select("v", "id", "weight").mapInArrow(deal, "t int, cell long, own boolean, id long, weight long, v array<double>, signs array<int>")
    sizes = sizes.groupBy("t", "cell").agg(F.count(F.lit(1)).alias("n"), F.max("own").alias("owned"))
    # cells with nobody to meet need no task
    busy = checkpointed(sizes.where("n > 1 and owned").select("t", "cell", F.ceil(F.col("n") / cell_rows).cast("int").alias("blocks")))
    rows = rows.join(busy, ["t", "cell"])
    # block i of a cell meets itself and every other block: side 0 is the smaller of a pair, 2 stands for a block on its own
    block = F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")
    rows = rows.withColumn("i", block).withColumn("j", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.withColumn("lo", F.least("i", "j")).withColumn("hi", F.greatest("i", "j"))
    rows = rows.withColumn("side", F.when(F.col("lo") == F.col("hi"), 2).when(F.col("i") == F.col("lo"), 0).otherwise(1))
    keys = ["t", "cell", "lo", "hi"]
    rows = rows.select(*keys, "side", "own", "id", "weight", "v", "signs").repartition(parts(rows), *keys).sortWithinPartitions(*keys)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        counts: dict[int, int] = {}
        edges: list[tuple[int, int]] = []

        def work(tables: list[pa.RecordBatch]) -> None:
            group = pa.Table.from_batches(tables)
            vectors = group.column("v").combine_chunks()
            sign = group.column("signs").combine_chunks().flatten().to_numpy().reshape(-1, TABLES, 1 + PROBES)
            column = {k: group.column(k).to_numpy() for k in ("t", "cell", "lo", "hi", "side", "own", "id", "weight")}
            change = np.zeros(len(vectors), dtype=bool)
            change[0] = True
            for k in keys:
                change[1:] |= column[k][1:] != column[k][:-1]
            starts = np.flatnonzero(change).tolist()
            for a, b in zip(starts, [*starts[1:], len(vectors)], strict=True):
                if b - a > 1:
                    dim, t = divmod(int(column["t"][a]), TABLES)
                    unit = _unit(_matrix(vectors.slice(a, b - a), dim))
                    links, found = _compare({"id": column["id"][a:b], "unit": unit, "weight": column["weight"][a:b], "own": column["own"][a:b], "side": column["side"][a:b], "cells": sign[a:b], "table": t}, least)
                    for k in np.flatnonzero(links).tolist():
                        counts[int(column["id"][a + k])] = counts.get(int(column["id"][a + k]), 0) + int(links[k])
                    edges.extend(found)

        def out() -> Iterator[pa.RecordBatch]:
            if counts or edges:
                ids, n = list(counts), list(counts.values())
                a, b = [e[0] for e in edges], [e[1] for e in edges]
                yield pa.record_batch([pa.array(ids + a, pa.int64()), pa.array([None] * len(ids) + b, pa.int64()), pa.array(n + [None] * len(a), pa.int64())], ["a", "b", "links"])
                counts.clear()
                edges.clear()

        def key(batch: pa.RecordBatch, row: int) -> tuple:
            return tuple(batch.column(k)[row].as_py() for k in range(4))

        for batch in batches:
            if not batch.num_rows:
                continue
            # what the last key of the batch has so far waits for the rest of it
            last = key(batch, batch.num_rows - 1)
            lo, hi = 0, batch.num_rows - 1
            while lo < hi:
                mid = (lo + hi) // 2
                lo, hi = (lo, mid) if key(batch, mid) == last else (mid + 1, hi)
            if lo:
                work([*held, batch.slice(0, lo)])
                held = []
            elif held and key(held[-1], 0) != last:
                work(held)
                held = []
            held.append(batch.slice(lo))
            if len(counts) + len(edges) > 200_000:
                yield from out()
        if held:
            work(held)
        yield from out()

    met = checkpointed(rows.mapInArrow(compare, "a long, b long, links long"))
    counted = met.where("links is not null").groupBy(F.col("a").alias("id")).agg(F.sum("links").alias("links"))
    return counted, met.where("b is not null").select("a", "b")
