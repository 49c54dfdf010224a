"""Near-duplicates of embeddings through an inverted multi-index.

Vectors are cut in two halves with a codebook of their own each; the pairs of
codes are the cells of a product grid, and every vector belongs to the cell of
its nearest codes. A vector's multi-sequence traversal visits cells in the order
of their distance, up to an excess over the nearest cell that is
calibrated for the target recall: at that excess, vectors turned by the
threshold's angle in random directions still find their origin. Two vectors
meet if either one visits the other's cell; the cosine then decides, so links are never
false. Cells with many members are cut into blocks; a task counts links and
gives edges that connect its vectors, never their pairs.

Equal vectors are one class. Vectors of each length have an index of their own;
its codebooks are fitted on at most SAMPLE classes (those with the smallest
hashes), and a length with fewer than FITTED classes is a single cell. Every
vector is indexed and is a query.

Vectors that are null, empty, zero or hold a null or non-finite component link
with nothing, and vectors link with those of their length only. Null ids come last in a
component; of repeated rows one is kept. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runlens.llm.common import components, first_id, runs, tagged
from runlens.operators.skew import join_summary
from runlens.session import materialize

THRESHOLD = 0.9
RECALL = 0.98
#: The documented bound of what the codebooks are fitted on.
SAMPLE = 8192
#: Classes of a length from which on it has codebooks.
FITTED = 256
ROUNDS = 12
LEAST_CODES, MOST_CODES = 8, 512
#: Vectors of a block; a task holds two blocks.
BLOCK = 2048
SEED = 7


class Index(NamedTuple):
    """Codebooks of the halves and the excess at which a traversal ends."""

    first: np.ndarray
    second: np.ndarray
    excess: float


def codebook(points: np.ndarray, codes: int, random: np.random.Generator) -> np.ndarray:
    centres = points[random.choice(len(points), min(codes, len(points)), replace=False)].copy()
    for _ in range(ROUNDS):
        nearest = ((centres**2).sum(1) - 2 * points @ centres.T).argmin(1)
        sums = np.zeros_like(centres)
        np.add.at(sums, nearest, points)
        sizes = np.bincount(nearest, minlength=len(centres))
        centres[sizes > 0] = sums[sizes > 0] / sizes[sizes > 0, None]
    return centres


def distances(vectors: np.ndarray, first: np.ndarray, second: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Squared distances of both halves to their codes, over the nearest code's."""
    half = first.shape[1]
    out = []
    for part, centres in ((vectors[:, :half], first), (vectors[:, half:], second)):
        d = (centres**2).sum(1) - 2 * part @ centres.T
        out.append(d - d.min(1, keepdims=True))
    return out[0], out[1]


def fit(sample: np.ndarray, total: int, threshold: float, recall: float) -> Index:
    """The index for `total` unit vectors from a sample of them."""
    random = np.random.default_rng(SEED)
    codes = int(np.clip(round(total**0.5 / 4), LEAST_CODES, MOST_CODES))
    half = sample.shape[1] // 2
    first, second = (codebook(part, codes, random) for part in (sample[:, :half], sample[:, half:]))
    turned = random.normal(size=sample.shape)
    turned -= (turned * sample).sum(1, keepdims=True) * sample
    lengths = np.linalg.norm(turned, axis=1, keepdims=True)
    turned = threshold * sample + (1 - threshold**2) ** 0.5 * turned / np.where(lengths > 0, lengths, 1)
    there, here = distances(sample, first, second), distances(turned, first, second)
    rows = np.arange(len(sample))
    seen_from = [
        a[0][rows, b[0].argmin(1)] + a[1][rows, b[1].argmin(1)] for a, b in ((there, here), (here, there))
    ]
    return Index(first, second, float(np.quantile(np.minimum(*seen_from), recall)))


def traverse(vectors: np.ndarray, index: Index) -> tuple[np.ndarray, list[np.ndarray]]:
    """Each vector's own cell, and the cells it visits in order of their distance."""
    one, two = distances(vectors, index.first, index.second)
    width = len(index.second)
    own = one.argmin(1) * width + two.argmin(1)
    visits = []
    for a, b, cell in zip(one, two, own.tolist()):
        near_a, near_b = np.nonzero(a <= index.excess)[0], np.nonzero(b <= index.excess)[0]
        sums = a[near_a][:, None] + b[near_b][None, :]
        i, j = np.nonzero(sums <= index.excess)
        order = np.argsort(sums[i, j], kind="stable")
        cells = (near_a[i] * width + near_b[j])[order]
        visits.append(np.unique(np.append(cells, cell)))
    return own, visits


def unit(vectors: np.ndarray) -> np.ndarray:
    """Vectors of length 1; scaled by powers of two first, so that no square leaves the range of doubles."""
    vectors = vectors.astype(np.float64)
    _, exponent = np.frexp(np.abs(vectors).max(axis=1, keepdims=True))
    vectors = np.ldexp(vectors, -exponent)
    return vectors / np.linalg.norm(vectors, axis=1, keepdims=True)


def stored(rows: DataFrame, id_col: str, vector_col: str, dtype: str) -> DataFrame:
    """Stored: id, dim (0 for vectors that link with nothing), key, vector (raw bytes), _row."""
    picked = rows.select(F.col(id_col).alias("id"), F.col(vector_col).alias("vector"))
    kind = picked.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims, keys, data = [], [], []
            for value in batch.column(1):
                items = value.values if value.is_valid else None
                good = items is not None and len(items) > 0 and not items.null_count
                if good:
                    vector = items.to_numpy(zero_copy_only=False).astype(dtype) + 0.0
                    good = bool(np.isfinite(vector).all() and vector.any())
                raw = vector.astype(dtype).tobytes() if good else None
                dims.append(len(items) if good else 0)
                data.append(raw)
                keys.append(xxhash.xxh3_128_digest(raw) if good else None)
            arrays = [batch.column(0), pa.array(dims, pa.int32()), pa.array(keys, pa.binary()), pa.array(data, pa.binary())]
            yield pa.RecordBatch.from_arrays(arrays, names=["id", "dim", "key", "vector"])

    return tagged(picked.mapInArrow(run, f"id {kind}, dim int, key binary, vector binary"), "vectors")


def matrix(column: pa.ChunkedArray | pa.Array, dtype: str) -> np.ndarray:
    data = b"".join(column.to_pylist())
    return np.frombuffer(data, dtype).reshape(len(column), -1)


def whole(dim: int) -> Index:
    """An index of a single cell."""
    return Index(np.zeros((1, 0)), np.zeros((1, dim)), 0.0)


def located(classes: DataFrame, indexes, dtype: str) -> DataFrame:
    """Stored: dim, node, size, vector, own cell, visited cells; cells are numbered per dim."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch.column("dim").to_numpy()
            for dim in np.unique(dims).tolist():
                same = batch.take(pa.array(np.nonzero(dims == dim)[0]))
                index = indexes.value.get(dim) or whole(dim)
                own, visits = traverse(unit(matrix(same.column("vector"), dtype)), index)
                arrays = [*same.columns, pa.array(own, pa.int64()), pa.array(visits, pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays(arrays, names=["dim", "node", "size", "vector", "own", "visits"])

    picked = classes.select("dim", "node", "size", "vector")
    schema = "dim int, node long, size long, vector binary, own long, visits array<long>"
    return materialize(picked.mapInArrow(run, schema), "cells")


def cell_blocks(cells: DataFrame) -> DataFrame:
    """Members (side 0) and visitors (side 1) of each cell, dealt out as pairs of blocks."""
    members = cells.withColumn("cell", F.col("own"))
    visitors = cells.withColumn("cell", F.explode("visits"))
    counts = [
        rows.groupBy("dim", "cell").agg(F.greatest(F.lit(1), F.ceil(F.count(F.lit(1)) / BLOCK)).cast("int").alias(name))
        for rows, name in ((members, "lefts"), (visitors, "rights"))
    ]
    shape = counts[0].join(counts[1], ["dim", "cell"])

    def side(rows: DataFrame, number: int, mine: str, others: str) -> DataFrame:
        return rows.join(shape, ["dim", "cell"]).select(
            "cell", *cells.columns, F.lit(number).alias("side"),
            F.pmod(F.xxhash64("node", "cell"), F.col(f"{mine}s")).cast("int").alias(mine),
            F.explode(F.sequence(F.lit(0), F.col(f"{others}s") - 1)).alias(others),
        )

    both = side(members, 0, "left", "right").unionByName(side(visitors, 1, "right", "left"))
    return both.repartition("dim", "cell", "left", "right").sortWithinPartitions("dim", "cell", "left", "right", "side")


def joining_edges(rows: np.ndarray, columns: np.ndarray, hits: np.ndarray) -> list[tuple[int, int]]:
    """Edges that connect what `hits` connects."""
    nodes, at = np.unique(np.concatenate([rows, columns]), return_inverse=True)
    row_at, column_at = at[: len(rows)], at[len(rows) :]
    label = np.arange(len(nodes))
    edges = []
    for i in np.nonzero(hits.any(axis=1))[0]:
        found = column_at[hits[i]]
        mine = label[row_at[i]]
        labels, first = np.unique(label[found], return_index=True)
        other = labels != mine
        if other.any():
            edges += [(int(rows[i]), int(nodes[found[f]])) for f in first[other]]
            label[np.isin(label, labels)] = mine
    return edges


def link(threshold: float, dtype: str):
    """A stage over `cell_blocks`: rows (node, links, null) of link counts and (a, null, b) of edges."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (_, cell, _, _), table in runs(batches, ["dim", "cell", "left", "right"]):
            sides = table.column("side").to_numpy()
            cut = int((sides == 0).sum())
            if not 0 < cut < len(sides):
                continue
            members, visitors = table.slice(0, cut), table.slice(cut)
            node_m, node_v = members.column("node").to_numpy(), visitors.column("node").to_numpy()
            own_v = visitors.column("own").to_numpy()
            hits = unit(matrix(visitors.column("vector"), dtype)) @ unit(matrix(members.column("vector"), dtype)).T >= threshold
            # A pair inside the cell counts once; one that meets in both cells counts in the smaller.
            hits &= (own_v != cell)[:, None] | (node_v[:, None] < node_m[None, :])
            foreign = np.unique(own_v[own_v < cell])
            if len(foreign):
                place = np.searchsorted(foreign, own_v)
                place[place == len(foreign)] = 0
                smaller = foreign[place] == own_v
                returns = np.zeros((len(node_m), len(foreign)), dtype=bool)
                for m, visits in enumerate(members.column("visits").to_pylist()):
                    returns[m] = np.isin(foreign, visits)
                hits[smaller] &= ~returns[:, place[smaller]].T
            if not hits.any():
                continue
            size_m, size_v = members.column("size").to_numpy(), visitors.column("size").to_numpy()
            counts = np.concatenate([hits.T @ size_v, hits @ size_m])
            nodes = np.concatenate([node_m, node_v])
            edges = joining_edges(node_v, node_m, hits)
            nodes, counts = nodes[counts > 0], counts[counts > 0]
            a = np.concatenate([nodes, np.array([e[0] for e in edges], dtype=np.int64)])
            links = pa.array(counts.tolist() + [None] * len(edges), pa.int64())
            b = pa.array([None] * len(nodes) + [e[1] for e in edges], pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(a), links, b], names=["a", "links", "b"])

    return run


def near_duplicates(
    vectors: DataFrame,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    threshold: float = THRESHOLD,
    recall: float = RECALL,
) -> DataFrame:
    """One row per vector: id, n_links, component_id (smallest id reachable), kept."""
    spark = vectors.sparkSession
    dtype = "<f4" if "float" in vectors.schema[vector_col].dataType.simpleString() else "<f8"
    rows = stored(vectors, id_col, vector_col, dtype)
    classes = materialize(
        rows.where("dim > 0")
        .groupBy("dim", "key")
        .agg(first_id("id").alias("head"), F.count(F.lit(1)).alias("size"), F.first("vector").alias("vector"))
        .select("dim", F.col("head.row").alias("node"), "head", "key", "size", "vector"),
        "vector-classes",
    )
    fitted = {}
    # Numbers have no halves: one cell, in blocks.
    for dim, total in classes.where("dim > 1").groupBy("dim").count().where(f"count >= {FITTED}").orderBy("dim").collect():
        same = classes.where(F.col("dim") == dim)
        picked = same.select("vector").orderBy(F.xxhash64("node"), "node").limit(SAMPLE).collect()
        sample = unit(np.frombuffer(b"".join(r["vector"] for r in picked), dtype).reshape(-1, dim))
        fitted[dim] = fit(sample, total, threshold, recall)
    indexes = spark.sparkContext.broadcast(fitted)
    found = cell_blocks(located(classes, indexes, dtype)).mapInArrow(link(threshold, dtype), "a long, links long, b long")
    found = materialize(found, "vector-links")
    counts = found.where("b is null").groupBy(F.col("a").alias("node")).agg(F.sum("links").alias("links"))
    parts = components(found.where("b is not null").select("a", "b"), "vector-parts")

    placed = (
        classes.select("node", "head", "key", "size")
        .join(parts, "node", "left")
        .join(counts, "node", "left")
        .withColumn("component", F.coalesce("component", "node"))
    )
    heads = placed.groupBy("component").agg(F.min("head").alias("first"))
    named = placed.join(heads, "component").select(
        "key", "size", "first", (F.coalesce("links", F.lit(0)) + F.col("size") - 1).alias("n_links")
    )
    return join_summary(rows.select("id", "key", "_row"), materialize(named, "vector-named"), "key", "size").select(
        "id",
        F.coalesce("n_links", F.lit(0)).alias("n_links"),
        F.when(F.col("first").isNull(), F.col("id")).otherwise(F.col("first.id")).alias("component_id"),
        (F.col("first").isNull() | (F.col("first.row") == F.col("_row"))).alias("kept"),
    )
