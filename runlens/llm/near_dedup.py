"""Near-duplicates by an inverted join over MinHash signatures.

1. Every document's word shingles give a signature of COORDINATES minima. Documents with
   equal shingle sets become one class; all that follows is about classes.
2. Each (coordinate, value) of the first POSTED coordinates is a key. Keys of one
   class alone can't collide and go. Two classes of the wanted similarity share
   `least` of their keys (see `least_matches`), so at least one of those that
   are left when a class drops its `least` - 1 most common ones: this prefix of rare keys is posted.
3. Within a posting list each class is first compared with the list's smallest;
   collisions are counted over the whole signature. Lists whose classes are then
   connected are done. In the others, only classes outside the largest part are
   compared with the rest, in blocks; pairs that are connected are skipped.
   The result is a graph of candidates.
4. Candidate pairs that span the graph are verified on full shingle sets. Inside
   each part of the graph, classes that this leaves unconnected are again
   compared with the rest, in blocks that carry the sets; every candidate pair
   between unconnected classes is verified, and connected ones are skipped.

So no pair is lost between classes that end in different components, though
groups are never expanded into all their pairs. A pair of the wanted similarity
stays unseen with a probability of MISS, twice, at most.

Null and empty texts and texts without words have no shingles and are linked
with nothing. Null ids come last in a component; of repeated rows one is kept.
An empty table gives no rows. Other columns play no part.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runlens.llm.common import components, first_id, runs, tagged, text_of
from runlens.llm.exact_dedup import one_each
from runlens.llm.shingles import shingle_sets
from runlens.operators.skew import join_summary
from runlens.session import materialize

WORDS = 5
PERCENT = 80
COORDINATES = 64
POSTED = 32
MISS = 1e-7
#: Signatures and shingles per block of a comparison; a task holds two blocks.
BLOCK_SIGNATURES = 512
BLOCK_SHINGLES = 100_000
#: Shingles that are signed together.
SIGNED = 500_000
SEED = 20


def least_matches(coordinates: int, percent: int, miss: float = MISS) -> int:
    """The most collisions that pairs of the wanted similarity fall short of with a probability of `miss` at most."""
    p, below = percent / 100, 0.0
    for n in range(coordinates + 1):
        below += comb(coordinates, n) * p**n * (1 - p) ** (coordinates - n)
        if below > miss:
            return n
    return coordinates


def multipliers() -> np.ndarray:
    return np.random.default_rng(SEED).integers(0, 1 << 63, COORDINATES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """A row of minima for each set; none may be empty."""
    joined = np.concatenate(sets)
    starts = np.cumsum([0] + [len(s) for s in sets[:-1]])
    out = np.empty((len(sets), COORDINATES), dtype=np.uint32)
    for k, factor in enumerate(multipliers()):
        out[:, k] = np.minimum.reduceat(joined * factor, starts) >> np.uint64(32)
    return out.view(np.int32)


def sign(docs: DataFrame, id_col: str, text_col: str, words: int) -> DataFrame:
    """Stored: id, text_hash, n (shingles), key (of the set, null if empty), signature, _row."""
    text = text_of(text_col)
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("text_hash"), text.alias("text"))
    kind = rows.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys: list[bytes | None] = []
            sizes: list[int] = []
            signed: list[np.ndarray] = []
            waiting: list[np.ndarray] = []
            held = 0
            for shingles in shingle_sets(batch.column("text").to_pylist(), words):
                sizes.append(len(shingles))
                keys.append(xxhash.xxh3_128_digest(shingles.tobytes()) if len(shingles) else None)
                if len(shingles):
                    waiting.append(shingles)
                    held += len(shingles)
                if held > SIGNED:
                    signed.append(signatures(waiting))
                    waiting, held = [], 0
            if waiting:
                signed.append(signatures(waiting))
            values = np.concatenate(signed).ravel() if signed else np.empty(0, np.int32)
            ends = np.cumsum([0] + [COORDINATES if n else 0 for n in sizes]).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("id"),
                    batch.column("text_hash"),
                    pa.array(sizes, pa.int64()),
                    pa.array(keys, pa.binary()),
                    pa.ListArray.from_arrays(pa.array(ends), pa.array(values)),
                ],
                names=["id", "text_hash", "n", "key", "signature"],
            )

    schema = f"id {kind}, text_hash long, n long, key binary, signature array<int>"
    return tagged(rows.mapInArrow(run, schema), "signed")


def postings(classes: DataFrame, least: int) -> DataFrame:
    """(token, node) of each class's rare prefix."""
    every = classes.select("node", F.posexplode(F.slice("signature", 1, POSTED)).alias("at", "value")).select(
        "node",
        F.shiftleft(F.col("at").cast("long"), 32).bitwiseOR(F.col("value").cast("long").bitwiseAND(0xFFFFFFFF)).alias("token"),
    )
    shared = every.groupBy("token").agg(F.count(F.lit(1)).alias("holders")).where("holders > 1")
    # At most POSTED entries a class.
    own = every.join(shared, "token").groupBy("node").agg(F.collect_list(F.struct("holders", "token")).alias("tokens"))
    prefix = F.slice(F.array_sort("tokens"), F.lit(1), F.size("tokens") - (least - 1))
    return own.where(F.size("tokens") >= least).select("node", F.explode(prefix).alias("t")).select("t.token", "node")


def matches(a: str, b: str):
    same = F.zip_with(a, b, lambda x, y: (x == y).cast("int"))
    return F.aggregate(same, F.lit(0), lambda total, x: total + x)


def cross_blocks(members: DataFrame, group: str, target: int) -> DataFrame:
    """Rows of `members` (group, node, part, weight, ...) dealt out for the comparison across parts.

    In a group of several parts, the rows outside the largest part (side 0)
    have to meet all rows (side 1). Both sides are cut by hash into blocks of
    about `target` weight; every pair of blocks (left, right) is a key.
    """
    parts = members.groupBy(group, "part").agg(F.sum("weight").alias("weight"))
    shape = parts.groupBy(group).agg(
        F.count(F.lit(1)).alias("_parts"),
        F.sum("weight").alias("_all"),
        F.max(F.struct("weight", "part")).alias("_main"),
    )
    shape = shape.where("_parts > 1").select(
        F.col(group).alias("_group"),
        F.col("_main.part").alias("_main"),
        F.greatest(F.lit(1), F.ceil((F.col("_all") - F.col("_main.weight")) / target)).cast("int").alias("_lefts"),
        F.greatest(F.lit(1), F.ceil(F.col("_all") / target)).cast("int").alias("_rights"),
    )
    open_rows = members.join(shape, F.col(group) == F.col("_group"))
    own = F.xxhash64("node", group)

    def side(rows: DataFrame, number: int, mine: str, others: str) -> DataFrame:
        place = F.pmod(own, F.col(f"_{mine}s")).cast("int")
        return rows.select(
            *members.columns, F.lit(number).alias("side"), place.alias(mine),
            F.explode(F.sequence(F.lit(0), F.col(f"_{others}s") - 1)).alias(others),
        )

    left = side(open_rows.where("part <> _main"), 0, "left", "right")
    right = side(open_rows, 1, "right", "left")
    return left.unionByName(right).repartition(group, "left", "right").sortWithinPartitions(group, "left", "right", "side")


class Parts:
    """Which parts a task has found to be connected."""

    def __init__(self) -> None:
        self.parent: dict[int, int] = {}

    def find(self, x: int) -> int:
        while (up := self.parent.get(x, x)) != x:
            self.parent[x] = self.parent.get(up, up)
            x = up
        return x

    def join(self, a: int, b: int) -> bool:
        a, b = self.find(a), self.find(b)
        if a != b:
            self.parent[max(a, b)] = min(a, b)
        return a != b


Block = tuple[np.ndarray, np.ndarray, np.ndarray, list[bytes] | None]


def block(table: pa.Table) -> Block:
    flat = table.column("signature").combine_chunks().flatten().to_numpy()
    shingles = table.column("shingles").to_pylist() if "shingles" in table.column_names else None
    return table.column("node").to_numpy(), table.column("part").to_numpy(), flat.reshape(-1, COORDINATES), shingles


def each_pair_of_blocks(group: str, compare: Callable[[Block, Block], list[tuple[int, int]]]):
    """A stage over `cross_blocks` that gives the edges `compare` finds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, table in runs(batches, [group, "left", "right"]):
            sides = table.column("side").to_numpy()
            first = int((sides == 0).sum())
            if 0 < first < len(sides):
                edges = compare(block(table.slice(0, first)), block(table.slice(first)))
                if edges:
                    a, b = zip(*edges)
                    yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return run


def colliding(least: int) -> Callable[[Block, Block], list[tuple[int, int]]]:
    """Pairs with enough collisions, as many as connect the blocks' parts."""

    def compare(left: Block, right: Block) -> list[tuple[int, int]]:
        parts = Parts()
        edges = []
        for node, part, signature in zip(left[0].tolist(), left[1].tolist(), left[2]):
            hits = np.nonzero(((right[2] == signature).sum(axis=1) >= least) & (right[1] != part))[0]
            for other, other_part in zip(right[0][hits].tolist(), right[1][hits].tolist()):
                if parts.join(part, other_part):
                    edges.append((node, other))
        return edges

    return compare


def overlap(shingles: np.ndarray, others: list[np.ndarray]) -> np.ndarray:
    """How many of `shingles` each of the other sets holds; all are sorted."""
    joined = np.concatenate(others)
    at = np.searchsorted(shingles, joined)
    at[at == len(shingles)] = 0
    starts = np.cumsum([0] + [len(o) for o in others[:-1]])
    return np.add.reduceat((shingles[at] == joined).astype(np.int64), starts)


def similar(mine: int, others: np.ndarray, shared: np.ndarray, percent: int) -> np.ndarray:
    return 100 * shared >= percent * (mine + others - shared)


def verified(least: int, percent: int) -> Callable[[Block, Block], list[tuple[int, int]]]:
    """Pairs that are similar by their full sets, as many as connect the blocks' parts."""

    def compare(left: Block, right: Block) -> list[tuple[int, int]]:
        parts = Parts()
        edges = []
        sets = [np.frombuffer(s, np.uint64) for s in right[3]]
        sizes = np.array([len(s) for s in sets])
        for node, part, signature, data in zip(left[0].tolist(), left[1].tolist(), left[2], left[3]):
            mine = np.frombuffer(data, np.uint64)
            near = (100 * np.minimum(sizes, len(mine)) >= percent * np.maximum(sizes, len(mine))) & (right[1] != part)
            near = np.nonzero(near)[0]
            near = near[(right[2][near] == signature).sum(axis=1) >= least]
            home = parts.find(part)
            near = np.array([i for i in near.tolist() if parts.find(int(right[1][i])) != home], dtype=np.int64)
            if not len(near):
                continue
            shared = overlap(mine, [sets[i] for i in near])
            for i in near[similar(len(mine), sizes[near], shared, percent)].tolist():
                if parts.join(part, int(right[1][i])):
                    edges.append((node, int(right[0][i])))
        return edges

    return compare


def verify_pairs(percent: int):
    """A stage over (a, b, shingles_a, shingles_b) that keeps the similar pairs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for a, b in zip(batch.column("shingles_a").to_pylist(), batch.column("shingles_b").to_pylist()):
                mine, other = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
                shared = overlap(mine, [other])
                keep.append(bool(similar(len(mine), np.array([len(other)]), shared, percent)[0]))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def shingle_table(docs: DataFrame, id_col: str, text_col: str, words: int, wanted: DataFrame) -> DataFrame:
    """Stored: the columns of `wanted` (id, key, ...) and the full `shingles` of those classes."""
    rows = docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("text"))
    ids = wanted.select(F.col("id").alias("_id")).distinct()
    found = rows.join(ids, F.col("id").eqNullSafe(F.col("_id")), "left_semi").select("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [s.tobytes() for s in shingle_sets(batch.column("text").to_pylist(), words)]
            keys = [xxhash.xxh3_128_digest(s) for s in sets]
            arrays = [pa.array(keys, pa.binary()), pa.array(sets, pa.binary())]
            yield pa.RecordBatch.from_arrays(arrays, names=["_key", "shingles"])

    made = found.mapInArrow(run, "_key binary, shingles binary")
    return materialize(wanted.join(made, F.col("key") == F.col("_key")).drop("_key"), "shingles")


def with_part(rows: DataFrame, parts: DataFrame) -> DataFrame:
    """Add `part`: the node's component, or the node where it has none."""
    names = parts.select(F.col("node").alias("_node"), F.col("component").alias("_part"))
    return rows.join(names, F.col("node") == F.col("_node"), "left").select(
        *rows.columns, F.coalesce("_part", "node").alias("part")
    )


def links(docs: DataFrame, classes: DataFrame, id_col: str, text_col: str, words: int, percent: int) -> DataFrame:
    """(a, b) of verified pairs that connect all classes which belong together."""
    least = least_matches(COORDINATES, percent)
    posted = materialize(postings(classes, least_matches(POSTED, percent)), "postings")

    # The star of each list: its smallest class and the others.
    centres = posted.groupBy("token").agg(F.min("node").alias("a"), F.count(F.lit(1)).alias("n")).where("n > 1")
    pairs = posted.join(centres, "token").where("node > a").select("a", F.col("node").alias("b")).distinct()
    signed = classes.select("node", "signature")
    star = materialize(
        pairs.join(signed.select(F.col("node").alias("a"), F.col("signature").alias("_of_a")), "a")
        .join(signed.select(F.col("node").alias("b"), F.col("signature").alias("_of_b")), "b")
        .where(matches("_of_a", "_of_b") >= least)
        .select("a", "b"),
        "star",
    )
    # Classes with the same smallest centre are connected; that is all that is asked of a part.
    hubs = star.groupBy(F.col("b").alias("node")).agg(F.min("a").alias("component"))
    listed = with_part(posted, hubs).join(signed, "node").withColumn("weight", F.lit(1))
    across = cross_blocks(listed, "token", BLOCK_SIGNATURES).mapInArrow(
        each_pair_of_blocks("token", colliding(least)), "a long, b long"
    )
    candidates = materialize(star.union(across).distinct(), "candidates")

    clusters = components(candidates, "clusters")
    wanted = classes.join(clusters, "node").select("node", "component", "id", "key", "n", "signature")
    full = shingle_table(docs, id_col, text_col, words, wanted)
    sides = [full.select(F.col("node").alias(x), F.col("shingles").alias(f"shingles_{x}")) for x in "ab"]
    spanning = materialize(
        candidates.join(sides[0], "a").join(sides[1], "b").mapInArrow(verify_pairs(percent), "a long, b long"), "spanning"
    )
    inside = with_part(
        full.select("node", F.col("component").alias("cluster"), F.col("n").alias("weight"), "signature", "shingles"),
        components(spanning, "spanning-parts"),
    )
    rest = cross_blocks(inside, "cluster", BLOCK_SHINGLES).mapInArrow(
        each_pair_of_blocks("cluster", verified(least, percent)), "a long, b long"
    )
    return spanning.union(rest)


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, percent: int = PERCENT
) -> DataFrame:
    """One row per document: id, text_hash, n_shingles, component_id (smallest id), kept."""
    signed = sign(docs, id_col, text_col, words)
    classes = materialize(
        signed.where("n > 0")
        .groupBy("key")
        .agg(
            first_id("id").alias("head"),
            F.count(F.lit(1)).alias("size"),
            F.first("n").alias("n"),
            F.first("signature").alias("signature"),
        )
        .select(F.col("head.row").alias("node"), F.col("head.id").alias("id"), "head", "key", "size", "n", "signature"),
        "classes",
    )
    found = components(links(docs, classes, id_col, text_col, words, percent), "near")
    placed = with_part(classes.select("node", "head", "key", "size"), found)
    # Only classes that are linked need their component's head.
    heads = placed.where("part <> node").select("part", "head").union(
        found.where("node = component").join(classes.select("node", "head"), "node").select(
            F.col("component").alias("part"), "head"
        )
    ).groupBy("part").agg(F.min("head").alias("first"))
    named = placed.join(heads, "part", "left").select("key", "size", F.coalesce("first", "head").alias("first"))
    rows = signed.select("id", "text_hash", "n", "key", "_row")
    return join_summary(rows, materialize(named, "named"), "key", "size").select(
        "id",
        "text_hash",
        F.col("n").alias("n_shingles"),
        F.when(F.col("first").isNull(), F.col("id")).otherwise(F.col("first.id")).alias("component_id"),
        (F.col("first").isNull() | (F.col("first.row") == F.col("_row"))).alias("kept"),
    )


def keep_one_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **measure: int) -> DataFrame:
    """One document of each group of near-duplicates, and all others, with their own columns."""
    winners = near_duplicates(docs, id_col, text_col, **measure).where("kept").select(
        F.col("id").alias("_keep_id"), F.col("text_hash").alias("_keep_digest")
    )
    return one_each(docs, winners, id_col, F.xxhash64(text_of(text_col)))
