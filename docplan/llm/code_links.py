"""Near duplicates among embeddings by randomised-rotation binary codes.

Equal vectors form one node, with its number of rows, before anything is compared. A node's code is
the signs of its randomly rotated direction; stored with it is the correction factor, the inner
product of the direction and its code's. The product of a code and another rotated direction, divided by
the factor, estimates the cosine without bias, and how far it strays is known: for two directions of
cosine `threshold` it is sqrt(1 - threshold^2) * sqrt(1 - factor^2) / factor times one coordinate of a
random direction. Pairs whose estimate lies so far below the threshold that chance explains it
in fewer than 1 of 100,000 cases (SPREAD) are rejected; all others are computed again in double precision.

What is compared: in each of several further rotations a node enters the cells of its two largest
coordinates (with sign), refined by the largest coordinate of other rotations while cells would hold more than
CELL nodes. How many rotations are needed for a pair just at the threshold to share a cell with a probability
of 1 - MISS is computed from simulated pairs of these dimensions. A cell of more than CELL nodes is cut into
blocks, and its pairs of blocks are compared apart, so no task holds more than two blocks. Pairs
are counted where they first meet, inside the task: what leaves it is each node's number of links and
a spanning forest of the links, never the pairs.

Vectors that are null, empty, zero, or hold null or non-finite components link with nothing and stand
alone, as do vectors of different lengths towards each other. Repeated rows are members of the same
node: they link with each other. A null id is linked like others, but no component is named after it
(the component of null ids alone is null, and its rows are not kept). An empty table gives an
empty result. Columns other than id and vector, labels among them, are not read.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docplan.llm.common import modest_batches, settled, written
from docplan.llm.near_copies import components
from docplan.llm.vectors import id_type, vectors, whole

THRESHOLD = 0.9
#: Standard deviations that an estimate may stray, and the share of threshold pairs that may meet in no cell.
SPREAD, MISS = 5.0, 0.001
#: Nodes of a block; larger cells are cut. Rows and columns of the tiles compared at once.
CELL, TILE = 2048, 512
#: Large cells that are broadcast (20 bytes each); more are joined.
BROADCAST_CELLS = 200_000


@lru_cache(maxsize=None)
def rotation(dims: int, number: int) -> np.ndarray:
    """A random rotation of the given dimensions, always the same one."""
    q, r = np.linalg.qr(np.random.default_rng([dims, number]).normal(size=(dims, dims)))
    return q * np.sign(np.diag(r))


def directions(x: np.ndarray) -> np.ndarray:
    """Unit vectors; rows are first divided by their largest component, so nothing overflows."""
    y = x / np.abs(x).max(axis=1, keepdims=True)
    return y / np.sqrt((y * y).sum(axis=1, keepdims=True))


def codes(unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Signs of the rotated directions, packed, and the correction factors."""
    turned = unit @ rotation(unit.shape[1], 0)
    return np.packbits(turned > 0, axis=1), np.abs(turned).sum(axis=1) / math.sqrt(unit.shape[1])


def estimates(packed: np.ndarray, factor: np.ndarray, unit: np.ndarray) -> np.ndarray:
    """Unbiased estimates of the cosines of coded directions with the given ones."""
    dims = unit.shape[1]
    signs = np.unpackbits(packed, axis=1, count=dims).astype(np.float32) * 2 - 1
    turned = (unit @ rotation(dims, 0)).astype(np.float32)
    return (signs @ turned.T) / (factor * math.sqrt(dims))[:, None].astype(np.float32)


def least_estimate(factor: np.ndarray, dims: int, threshold: float, spread: float = SPREAD) -> np.ndarray:
    """Below this an estimate is too low for a cosine of the threshold or more."""
    stray = np.sqrt(np.maximum(1 - factor * factor, 0)) / factor * min(1.0, spread / math.sqrt(max(dims - 1, 1)))
    return threshold - math.sqrt(max(1 - threshold * threshold, 0)) * stray - 1e-4


def _largest(turned: np.ndarray, how_many: int) -> np.ndarray:
    at = np.argsort(-np.abs(turned), axis=1, kind="stable")[:, :how_many]
    return at * 2 + (np.take_along_axis(turned, at, axis=1) > 0)


def cells(unit: np.ndarray, tables: int, depth: int) -> np.ndarray:
    """The cells of each direction, two of each table."""
    dims = unit.shape[1]
    out = []
    for t in range(tables):
        first = _largest(unit @ rotation(dims, 1 + t * depth), 2)
        name = np.full(len(unit), t, np.int64)
        for d in range(1, depth):
            name = name * (2 * dims) + _largest(unit @ rotation(dims, 1 + t * depth + d), 1)[:, 0]
        out += [(name * (2 * dims) + first[:, k % first.shape[1]]) for k in range(2)]
    return np.stack(out, axis=1)


@lru_cache(maxsize=None)
def tables_for(dims: int, depth: int, threshold: float, miss: float) -> int:
    """Tables for pairs at the threshold to share a cell but for the share `miss`, from 20,000 simulated pairs."""
    if dims == 1:
        return 1
    rng = np.random.default_rng(dims)
    x = directions(rng.normal(size=(20_000, dims)))
    e = rng.normal(size=x.shape)
    e = directions(e - (e * x).sum(axis=1, keepdims=True) * x)
    a, b = cells(x, 1, depth), cells(threshold * x + math.sqrt(1 - threshold * threshold) * e, 1, depth)
    share = float((a[:, :, None] == b[:, None, :]).any(axis=(1, 2)).mean())
    return max(1, math.ceil(math.log(miss) / math.log(max(1 - share, 1e-9))))


def depth_for(nodes: int, dims: int, cell: int = CELL) -> int:
    """Rotations that a cell's name takes for evenly spread nodes to fill cells up to `cell`."""
    depth = 1
    while 2 * nodes > cell * (2 * dims) ** depth and dims > 1:
        depth += 1
    return depth


def _nodes(df: DataFrame, vec_id: str, vector: str, kind: str) -> DataFrame:
    """id, node (16 bytes; null for vectors that link with nothing) and the vector's numbers of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat, lengths, fine = whole(batch.column(1))
            flat = flat + 0.0  # no negative zero
            names, raw = [], []
            for at, n, good in zip(np.cumsum(lengths) - lengths, lengths, fine):
                x = flat[at : at + n]
                good = good and bool(x.any())
                raw.append(x.astype(kind).tobytes() if good else None)
                names.append(hashlib.blake2b(raw[-1], digest_size=16).digest() if good else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names, pa.binary()), pa.array(raw, pa.binary())], ["id", "node", "raw"])

    return vectors(df, vec_id, vector).mapInArrow(run, f"id {id_type(df, vec_id)}, node binary, raw binary")


def _doubles(raw: list[bytes], kind: str) -> np.ndarray:
    return np.frombuffer(b"".join(raw), kind).reshape(len(raw), -1).astype(np.float64)


def _coded(nodes: DataFrame, plan: dict[int, tuple[int, int]], kind: str) -> DataFrame:
    """The nodes with code, factor and cells; `plan` has tables and depth of each length of vector."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = batch.column(2).to_pylist()
            length = np.array([len(r) // np.dtype(kind).itemsize for r in raw])
            for dims in np.unique(length):
                at = np.flatnonzero(length == dims)
                unit = directions(_doubles([raw[i] for i in at], kind))
                packed, factor = codes(unit)
                named = cells(unit, *plan[int(dims)])
                rows = batch.take(pa.array(at))
                yield pa.RecordBatch.from_arrays(
                    [*rows.columns, pa.array([p.tobytes() for p in packed], pa.binary()), pa.array(factor), pa.array([c.tolist() for c in named], pa.list_(pa.int64()))],
                    ["node", "copies", "raw", "code", "factor", "cells"])

    return nodes.select("node", "copies", "raw").mapInArrow(
        run, "node binary, copies bigint, raw binary, code binary, factor double, cells array<bigint>")


class _Block:
    """The nodes of one block of a cell as arrays."""

    def __init__(self, batch: pa.RecordBatch, kind: str):
        self.node = batch.column("node").to_pylist()
        self.copies = batch.column("copies").to_numpy()
        self.factor = batch.column("factor").to_numpy()
        n = batch.num_rows
        self.unit = directions(_doubles(batch.column("raw").to_pylist(), kind))
        self.code = np.frombuffer(b"".join(batch.column("code").to_pylist()), np.uint8).reshape(n, -1)
        self.cells = batch.column("cells").flatten().to_numpy().reshape(n, -1)


def linked(a: _Block, b: _Block, rows: slice, columns: slice, cell: int, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Which nodes of a tile are linked and meet in this cell first: estimates, then exact cosines."""
    guess = estimates(a.code[rows], a.factor[rows], b.unit[columns])
    i, j = np.nonzero(guess >= least_estimate(a.factor[rows], a.unit.shape[1], threshold)[:, None])
    x, y = a.unit[rows], b.unit[columns]
    if len(i) * 8 > guess.size:  # a dense tile
        close = (x @ y.T)[i, j] >= threshold
    else:
        close = np.einsum("ij,ij->i", x[i], y[j]) >= threshold
    i, j = i[close], j[close]
    cx, cy = a.cells[rows][i], b.cells[columns][j]
    first = np.full(len(i), np.iinfo(np.int64).max)
    for k in range(cx.shape[1]):
        shared = (cy == cx[:, k : k + 1]).any(axis=1)
        first = np.where(shared, np.minimum(first, cx[:, k]), first)
    return i[first == cell], j[first == cell]


def _compare(a: _Block, b: _Block, same: bool, cell: int, threshold: float) -> tuple[np.ndarray, np.ndarray, list[tuple[bytes, bytes]]]:
    """Links of the nodes of either block, counted in rows, and a spanning forest of the links."""
    links_a, links_b = np.zeros(len(a.node), np.int64), np.zeros(len(b.node), np.int64)
    shift = 0 if same else len(a.node)
    label = np.arange(len(a.node) + (0 if same else len(b.node)))
    forest: list[tuple[bytes, bytes]] = []
    name = a.node + ([] if same else b.node)
    for r in range(0, len(a.node), TILE):
        for c in range(r if same else 0, len(b.node), TILE):
            i, j = linked(a, b, slice(r, r + TILE), slice(c, c + TILE), cell, threshold)
            i, j = i + r, j + c
            if same:
                i, j = i[i < j], j[i < j]
            np.add.at(links_a, i, b.copies[j])
            np.add.at(links_b, j, a.copies[i])
            u, v = label[i], label[j + shift]
            while True:  # the classes that this tile's links join, one link for each joined class a round
                apart = u != v
                if not apart.any():
                    break
                i, j, u, v = i[apart], j[apart], u[apart], v[apart]
                upper, at = np.unique(np.maximum(u, v), return_index=True)
                lower = np.minimum(u, v)[at]
                forest += [(name[i[k]], name[j[k] + shift]) for k in at]
                to = np.arange(len(label))
                to[upper] = lower
                while (to[to] != to).any():
                    to = to[to]
                label = to[label]
                u, v = label[i], label[j + shift]
    return links_a, links_b, forest


def _met(blocks: DataFrame, threshold: float, kind: str) -> DataFrame:
    """Rows of links (node, links) and of the forest (node, other) from the sorted pairs of blocks."""

    def result(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        rows = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
        side, cell = rows.column("side").to_numpy(), rows.column("cell")[0].as_py()
        a = _Block(rows.filter(pa.array(side == 0)), kind)
        alone = bool((side == 0).all()) and rows.column("i")[0].as_py() == rows.column("j")[0].as_py()
        b = a if alone else _Block(rows.filter(pa.array(side == 1)), kind)
        links_a, links_b, forest = _compare(a, b, alone, cell, threshold)
        counts = [(n, None, int(v)) for n, v in zip(a.node, links_a) if v] + [(n, None, int(v)) for n, v in zip(b.node, links_b) if v]
        node, other, links = zip(*(counts + [(x, y, 0) for x, y in forest])) if counts or forest else ((), (), ())
        return pa.RecordBatch.from_arrays([pa.array(node, pa.binary()), pa.array(other, pa.binary()), pa.array(links, pa.int64())], ["node", "other", "links"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        key = None
        for batch in batches:
            names = [batch.column(c).to_numpy() for c in ("dims", "cell", "i", "j")]
            change = np.zeros(batch.num_rows, bool)
            for column in names:
                change[1:] |= column[1:] != column[:-1]
            starts = [0, *np.flatnonzero(change).tolist(), batch.num_rows] if batch.num_rows else []
            for lo, hi in zip(starts[:-1], starts[1:]):
                this = tuple(int(c[lo]) for c in names)
                if held and this != key:
                    if sum(h.num_rows for h in held) > 1:
                        yield result(held)
                    held = []
                key = this
                held.append(batch.slice(lo, hi - lo))
        if sum(h.num_rows for h in held) > 1:
            yield result(held)

    return blocks.mapInArrow(run, "node binary, other binary, links bigint")


def links(df: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", threshold: float = THRESHOLD,
          miss: float = MISS, cell: int = CELL) -> DataFrame:
    """id, n_links, component_id and kept of every row."""
    modest_batches(df.sparkSession)
    kind = "<f4" if "array<float>" == df.schema[vector].dataType.simpleString() else "<f8"
    size = np.dtype(kind).itemsize
    rows = written(_nodes(df, vec_id, vector, kind))
    each = rows.where("node is not null").groupBy("node").agg(
        F.count("*").alias("copies"), F.min("id").alias("least"), F.first("raw").alias("raw"))
    each = written(each)
    # one row for each length of vector that occurs
    plan = {}
    for r in each.groupBy((F.length("raw") / size).cast("int").alias("dims")).count().collect():
        depth = depth_for(r["count"], r["dims"], cell)
        plan[r["dims"]] = (tables_for(r["dims"], depth, threshold, miss), depth)
    coded = written(_coded(each, plan, kind))
    placed = coded.withColumn("dims", (F.length("raw") / size).cast("int"))
    counted = placed.select("dims", F.explode(F.array_distinct("cells")).alias("cell")).groupBy("dims", "cell").agg(F.count("*").alias("size"))
    large = settled(counted.where(f"size > {cell}"))
    if large.count() <= BROADCAST_CELLS:
        large = F.broadcast(large)
    spread = placed.withColumn("cell", F.explode(F.array_distinct("cells"))).join(large, ["dims", "cell"], "left")
    cuts = spread.withColumn("cuts", F.ceil(F.coalesce("size", F.lit(1)) / cell).cast("int")).withColumn(
        "own", F.pmod(F.xxhash64("node", "cell"), F.col("cuts")).cast("int"))
    pairs = cuts.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("cuts") - 1))).select(
        "dims", "cell", F.least("own", "with").alias("i"), F.greatest("own", "with").alias("j"),
        (F.col("own") > F.col("with")).cast("int").alias("side"), "node", "copies", "raw", "code", "factor", "cells")
    dealt = pairs.repartition("dims", "cell", "i", "j").sortWithinPartitions("dims", "cell", "i", "j", "side")
    met = written(_met(dealt, threshold, kind))
    counted = met.where("other is null").groupBy("node").agg(F.sum("links").alias("found"))
    labels = components(met.where("other is not null").select(F.col("node").alias("a"), F.col("other").alias("b")))
    told = each.select("node", "copies", "least").join(counted, "node", "left").join(labels, "node", "left").select(
        "node", "copies", "least", "found", F.coalesce("label", "node").alias("label"))
    named = told.groupBy("label").agg(F.min("least").alias("component_id"))
    facts = told.join(named, "label").select(
        "node", (F.col("copies") - 1 + F.coalesce("found", F.lit(0))).alias("n_links"), "component_id")
    out = rows.select("id", "node").join(facts, "node", "left")
    component = F.when(F.col("node").isNull(), F.col("id")).otherwise(F.col("component_id"))
    return out.select(F.col("id").alias(vec_id), F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"), component.alias("component_id"),
                      F.coalesce(F.col("id") == component, F.lit(False)).alias("kept"))


def oracle(table: str = "embeddings", threshold: float = THRESHOLD) -> str:
    """The same as SQL: every pair, and components by the ids that each id reaches."""
    return f"""
with recursive units as (
  select vec_id, list_transform(embedding, lambda e: cast(e as double)) as v from {table}
  where embedding is not null and len(embedding) > 0 and len(list_filter(embedding, lambda e: e is null or isnan(e) or isinf(e))) = 0
    and len(list_filter(embedding, lambda e: e <> 0)) > 0),
link as (
  select a.vec_id as a, b.vec_id as b from units a join units b on a.vec_id <> b.vec_id and len(a.v) = len(b.v)
  where list_dot_product(a.v, b.v) / sqrt(list_dot_product(a.v, a.v) * list_dot_product(b.v, b.v)) >= {threshold}),
reach as (
  select vec_id as a, vec_id as b from {table}
  union
  select r.a, l.b from reach r join link l on l.a = r.b),
named as (select a as vec_id, min(b) as component_id from reach group by a),
counted as (select a as vec_id, count(*) as n_links from link group by a)
select n.vec_id, coalesce(c.n_links, 0) as n_links, n.component_id, n.vec_id = n.component_id as kept
from named n left join counted c using (vec_id)
"""
