"""Centroid clustering over subvector dictionaries.

Vectors become integers, floor(scale * component). Runs of up to CHUNK vectors of a task form one row
of a written table: every block of `width` dimensions is encoded, without loss, as a dictionary of the
run's distinct subvectors and a code for each vector, as a column of a columnar file would be. A round
computes the exact squared distances of the dictionaries' subvectors to the centroids once, adds them
up by code for every vector, and assigns it to the nearest centroid (ties: the smaller number). The new
sums come from how often each code fell to each cluster, so no round reads a vector or shuffles one:
tasks send one row of sums for each cluster, and the driver holds `clusters` centroids. A dictionary
never has more entries than its run has vectors, whatever the data are, and nothing but the centroids
is broadcast.

The first centroids are the kept vectors of the least hash of `1:<id>` (a null id hashes as `1:`; equal
hashes, that is repeated ids, go by components). With fewer vectors than clusters there are fewer
clusters. Vectors of another length, null ones, and ones with null or non-finite components are left
out. Repeated rows count and are returned each. An empty table gives an empty result. Columns other
than id and vector are not read. Sums and distances are exact 64-bit integers; to keep them so,
a scaled component of 2**26 or more is an error.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docplan.llm.common import modest_batches, settled, written
from docplan.llm.vectors import id_type, matrix, vectors

#: Vectors of one dictionary, and dimensions of one subvector.
CHUNK, WIDTH = 32_768, 2
#: Scaled components are less than this, so that a squared distance fits 63 bits.
LARGEST = 1 << 26


def scaled(x: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x) as integers."""
    out = np.floor(scale * x)
    if len(out) and np.abs(out).max() >= LARGEST:
        raise ValueError(f"a scaled component reaches {LARGEST}: its distances do not fit 64 bits")
    return out.astype(np.int64)


def encode(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct rows of a block, and the code of each row."""
    least, spread = x.min(axis=0), x.max(axis=0) - x.min(axis=0) + 1
    if float(np.prod(spread.astype(np.float64))) < 2.0**62:  # rows as numbers of mixed radix
        place = np.concatenate([np.cumprod(spread[:0:-1])[::-1], [1]]).astype(np.int64)
        _, first, codes = np.unique((x - least) @ place, return_index=True, return_inverse=True)
        return x[first], codes.astype(np.uint16)
    distinct, codes = np.unique(x, axis=0, return_inverse=True)
    return distinct, codes.ravel().astype(np.uint16)


def encoded(df: DataFrame, vec_id: str, vector: str, dims: int, scale: int, width: int = WIDTH, chunk: int = CHUNK) -> DataFrame:
    """Rows of up to `chunk` ids, with the dictionaries and codes of their blocks."""
    starts = range(0, dims, width)

    def row(ids: list[pa.Array], held: list[np.ndarray]) -> pa.RecordBatch:
        x = np.concatenate(held)
        pairs = [encode(x[:, at : at + width]) for at in starts]
        names = pa.concat_arrays(ids)
        return pa.RecordBatch.from_arrays(
            [pa.ListArray.from_arrays(pa.array([0, len(names)], pa.int32()), names),
             pa.array([[d.tobytes() for d, _ in pairs]], pa.list_(pa.binary())),
             pa.array([[c.tobytes() for _, c in pairs]], pa.list_(pa.binary()))], ["ids", "dictionaries", "codes"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, held, size = [], [], 0
        for batch in batches:
            fine, x = matrix(batch.column(1), dims)
            x, names = scaled(x, scale), batch.column(0).filter(pa.array(fine))
            while len(x):
                taken = min(chunk - size, len(x))
                ids.append(names.slice(0, taken))
                held.append(x[:taken])
                size, x, names = size + taken, x[taken:], names.slice(taken)
                if size == chunk:
                    yield row(ids, held)
                    ids, held, size = [], [], 0
        if size:
            yield row(ids, held)

    return vectors(df, vec_id, vector).mapInArrow(
        run, f"ids array<{id_type(df, vec_id)}>, dictionaries array<binary>, codes array<binary>")


def _blocks(batch: pa.RecordBatch, at: int, dims: int, width: int) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """First dimension, dictionary and codes of each block of one encoded row."""
    out = []
    for k, start in enumerate(range(0, dims, width)):
        size = min(width, dims - start)
        entries = np.frombuffer(batch.column("dictionaries")[at][k].as_buffer(), np.int64).reshape(-1, size)
        out.append((start, entries, np.frombuffer(batch.column("codes")[at][k].as_buffer(), np.uint16)))
    return out


def nearest(blocks: list[tuple[int, np.ndarray, np.ndarray]], centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The cluster and squared distance of every vector: distances of dictionary entries, added up by code."""
    total = np.zeros((len(blocks[0][2]), len(centroids)), np.int64)
    for start, entries, codes in blocks:
        apart = entries[:, None, :] - centroids[None, :, start : start + entries.shape[1]]
        total += (apart * apart).sum(axis=2)[codes]
    chosen = total.argmin(axis=1)
    return chosen, total[np.arange(len(total)), chosen]


def _sums(runs: DataFrame, centroids: np.ndarray, dims: int, width: int) -> dict[int, tuple[int, list[int]]]:
    """Members and componentwise sums of each non-empty cluster."""
    k = len(centroids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        members, sums = np.zeros(k, np.int64), np.zeros((k, dims), np.int64)
        for batch in batches:
            for at in range(batch.num_rows):
                blocks = _blocks(batch, at, dims, width)
                chosen, _ = nearest(blocks, centroids)
                members += np.bincount(chosen, minlength=k)
                for start, entries, codes in blocks:
                    often = np.bincount(chosen * len(entries) + codes, minlength=k * len(entries)).reshape(k, -1)
                    sums[:, start : start + entries.shape[1]] += often @ entries
        used = np.flatnonzero(members)
        yield pa.RecordBatch.from_arrays(
            [pa.array(used.astype(np.int32)), pa.array(members[used]), pa.array(list(sums[used]), pa.list_(pa.int64()))], ["cluster", "members", "sums"])

    parts = runs.mapInArrow(run, "cluster int, members bigint, sums array<bigint>")
    whole = parts.select("cluster", "members", F.posexplode("sums")).groupBy("cluster", "pos").agg(
        F.sum("members").alias("members"), F.sum("col").alias("total")).collect()  # clusters x dims rows
    out: dict[int, tuple[int, list[int]]] = {}
    for r in whole:
        out.setdefault(r.cluster, (r.members, [0] * dims))[1][r.pos] = r.total
    return out


def first_centroids(df: DataFrame, vec_id: str, vector: str, dims: int, scale: int, clusters: int) -> np.ndarray:
    """The scaled vectors of the least hashes: a top-k, so each task sends `clusters` rows."""
    finite = F.forall("vec", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    kept = vectors(df, vec_id, vector).where((F.size("vec") == dims) & finite)
    name = F.sha2(F.concat(F.lit("1:"), F.coalesce(F.col("id").cast("string"), F.lit(""))).cast("binary"), 256)
    best = kept.orderBy(name, "vec").limit(clusters).collect()
    return scaled(np.array([r.vec for r in best], np.float64).reshape(-1, dims), scale)


def clustered(df: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", dims: int = 64, scale: int = 64,
              clusters: int = 16, rounds: int = 3, width: int = WIDTH, chunk: int = CHUNK) -> DataFrame:
    """id, cluster and squared distance of every kept vector, with its cluster's and the whole inertia and the
    hash of its centroid."""
    if not 0 < chunk <= 1 << 16:
        raise ValueError("codes have 16 bits: a run has at most 65,536 vectors")
    modest_batches(df.sparkSession)
    centroids = first_centroids(df, vec_id, vector, dims, scale, clusters)
    runs = written(encoded(df, vec_id, vector, dims, scale, width, chunk))
    for _ in range(rounds if len(centroids) else 0):
        centroids = centroids.copy()
        for cluster, (members, sums) in _sums(runs, centroids, dims, width).items():
            centroids[cluster] = [s // members for s in sums]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                chosen, distance = nearest(_blocks(batch, at, dims, width), centroids)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("ids")[at].values, pa.array(chosen.astype(np.int32)), pa.array(distance)], [vec_id, "cluster", "distance"])

    rows = settled(runs.mapInArrow(run, f"`{vec_id}` {id_type(df, vec_id)}, cluster int, distance bigint"))
    inertias = {r.cluster: r.total for r in rows.groupBy("cluster").agg(
        F.sum(F.col("distance").cast("decimal(38,0)")).alias("total")).collect()}  # one row for each cluster
    facts = [(c, int(v), int(sum(inertias.values())), hashlib.sha256(",".join(map(str, centroids[c].tolist())).encode()).hexdigest())
             for c, v in inertias.items()]
    told = df.sparkSession.createDataFrame(facts, "cluster int, cluster_inertia bigint, inertia bigint, centroid_sha256 string")
    return rows.join(F.broadcast(told), "cluster").select(vec_id, "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def oracle(table: str = "embeddings", dims: int = 64, scale: int = 64, clusters: int = 16, rounds: int = 3) -> str:
    """The same as SQL: distances of all vectors to all centroids, component by component."""
    steps = []
    for r in range(rounds + 1):
        steps.append(f"""
near{r} as (select rid, c, distance from (
  select x.rid, k.c, sum((x.v - k.v) * (x.v - k.v)) as distance from cells x join centre{r} k using (dim) group by all)
  qualify row_number() over (partition by rid order by distance, c) = 1)""")
        if r < rounds:
            steps.append(f"""
sums{r} as (select n.c, x.dim, cast(sum(x.v) as bigint) as s, count(*) as m from near{r} n join cells x using (rid) group by all),
centre{r + 1} as (select c, dim, coalesce((s - ((s % m) + m) % m) // m, v) as v from centre{r} left join sums{r} using (c, dim))""")
    return f"""
with kept as (
  select row_number() over () as rid, vec_id, list_transform(embedding, lambda e: cast(floor({scale} * cast(e as double)) as bigint)) as x
  from {table} where len(embedding) = {dims}
    and len(list_filter(embedding, lambda e: e is null or isnan(e) or isinf(e))) = 0),
cells as (select rid, unnest(range({dims})) as dim, unnest(x) as v from kept),
seeds as (select rid, row_number() over (order by sha256('1:' || vec_id)) - 1 as c from kept
  qualify c < {clusters}),
centre0 as (select c, dim, v from seeds join cells using (rid)),{",".join(steps)},
facts as (select c, cast(sum(distance) as bigint) as cluster_inertia from near{rounds} group by c),
hashes as (select c, sha256(string_agg(cast(v as varchar), ',' order by dim)) as centroid_sha256 from centre{rounds} group by c)
select vec_id, cast(c as int) as cluster, cast(distance as bigint) as distance, cluster_inertia,
  cast((select sum(cluster_inertia) from facts) as bigint) as inertia, centroid_sha256
from near{rounds} join kept using (rid) join facts using (c) join hashes using (c)
"""
