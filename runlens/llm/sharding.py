"""Sharding along a k-d tree, with DataFrame functions only.

A document is a point of metadata that its text alone decides: size in bytes,
bytes per character and a content hash, each scaled to [0, 1]. The tree splits
a node along its widest dimension at the weighted quantile that gives each side
the bytes of its shards (the weighted median where the number is even), until
every leaf is one shard. All cuts of a level are searched together: a pass sums the bytes in equal
ranges between a node's smallest and largest point and keeps the range that
holds the wanted sum; a few passes narrow it to less than `tolerance` of a
shard. Only these sums reach the driver, at most shards x RANGES of them.

Equal texts are one point, so they share a shard, except where a group that is
larger than the tolerance lies on a cut: its documents are then parted by a hash
of their ids, which keeps the shards' bytes near equal.

Null text counts as empty: 8 bytes. Documents whose ids are null or repeated
get slots of their own. An empty table gives no rows. With fewer documents than
shards some shards stay empty.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runlens.llm.common import gapless, tagged, text_of

SHARDS = 24
OVERHEAD = 8
#: Share of a shard's bytes by which a cut may miss.
TOLERANCE = 0.002
#: Ranges per node and pass.
RANGES = 256
#: Documents that share a bucket of a shard's slots, about.
BUCKET_ROWS = 1000
DIMENSIONS = ("k_size", "k_density", "k_content")
HASH_BITS = 31


@dataclass
class Node:
    """`shards` leaves below; once cut, rows with (key, sub) up to the cut go left."""

    first: int
    shards: int
    dimension: str = ""
    key: int = 0
    sub: int | None = None
    left: Node | None = None
    right: Node | None = None


def points(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Stored: id, size, crc, the text's place on each dimension and the id's hash `sub`.

    A place is the scaled coordinate in the high bits and the text's hash in
    the low ones: texts of one coordinate can be parted, equal texts can not.
    """
    text = text_of(text_col)
    rows = docs.select(
        F.col(id_col).alias("id"),
        (F.octet_length(text) + OVERHEAD).cast("long").alias("size"),
        F.crc32(text).alias("crc"),
        F.xxhash64(text).alias("content"),
        F.char_length(text).alias("chars"),
    )
    top = float((1 << HASH_BITS) - 1)
    scaled = {
        "k_size": F.log2("size") / 64,
        "k_density": F.when(F.col("chars") > 0, F.col("chars") / (F.col("size") - OVERHEAD)).otherwise(F.lit(1.0)),
        "k_content": F.col("crc") / float(1 << 32),
    }
    low = F.pmod("content", F.lit(1 << HASH_BITS))
    places = [(F.floor(c * top).cast("long") * (1 << HASH_BITS) + low).alias(k) for k, c in scaled.items()]
    sub = F.pmod(F.xxhash64("id", "content"), F.lit(1 << HASH_BITS)).alias("sub")
    return tagged(rows.select("id", "size", "crc", *places, sub), "points")


def branch(node: Node, leaf) -> Column:
    """An expression over the tree as it is; `leaf` gives the value of an uncut node."""
    if node.left is None:
        return leaf(node)
    goes_left = F.col(node.dimension) <= node.key
    if node.sub is not None:
        goes_left = (F.col(node.dimension) < node.key) | ((F.col(node.dimension) == node.key) & (F.col("sub") <= node.sub))
    return F.when(goes_left, branch(node.left, leaf)).otherwise(branch(node.right, leaf))


@dataclass
class Search:
    """The range of a node's places that holds its cut; `before` bytes lie below the range."""

    node: Node
    wanted: float
    low: int
    high: int
    before: int = 0
    inside_key: bool = False


def quantiles(rows: DataFrame, root: Node, searches: dict[int, Search], slack: float) -> None:
    """Cut the nodes of `searches` (by first shard) at their wanted sums."""
    while searches:

        def per_node(build, default) -> Column:
            return branch(root, lambda n: build(searches[n.first]) if n.first in searches else F.lit(default))

        def place(s: Search) -> Column:
            return F.col("sub") if s.inside_key else F.col(s.node.dimension)

        def inside(s: Search) -> Column:
            kept = place(s).between(s.low, s.high)
            return kept & (F.col(s.node.dimension) == s.node.key) if s.inside_key else kept

        def number(s: Search) -> Column:
            return F.floor((place(s) - s.low) / (-(-(s.high - s.low + 1) // RANGES))).cast("long")

        sums = (
            rows.where(per_node(inside, False))
            .select(
                per_node(lambda s: F.lit(s.node.first), -1).alias("node"),
                per_node(number, -1).alias("range"),
                per_node(place, -1).alias("place"),
                "size",
            )
            .groupBy("node", "range")
            .agg(F.sum("size").alias("size"), F.min("place").alias("low"), F.max("place").alias("high"))
            .orderBy("node", "range")
            .collect()
        )
        following: dict[int, Search] = {}
        for first, s in searches.items():
            found = [r for r in sums if r["node"] == first]
            before = s.before
            for i, r in enumerate(found):
                if before + r["size"] >= s.wanted or i == len(found) - 1:
                    break
                before += r["size"]
            if s.wanted - before <= slack and i > 0:
                cut = found[i - 1]["high"]
            elif before + r["size"] - s.wanted <= slack:
                cut = r["high"]
            elif r["low"] == r["high"]:
                if s.inside_key:  # rows with equal ids and texts can't be parted
                    cut = r["high"]
                else:
                    s.node.key = r["low"]
                    following[first] = Search(s.node, s.wanted, 0, (1 << HASH_BITS) - 1, before, True)
                    continue
            else:
                following[first] = Search(s.node, s.wanted, r["low"], r["high"], before, s.inside_key)
                continue
            if s.inside_key:
                s.node.sub = cut
            else:
                s.node.key = cut
        searches = following


def grow(rows: DataFrame, shards: int, tolerance: float = TOLERANCE) -> Node:
    """The tree; each level costs one pass for the widths and a few for the cuts."""
    root = Node(0, shards)
    level = [root] if shards > 1 else []
    ends = [e for k in DIMENSIONS for e in (F.min(k).alias(f"{k}_low"), F.max(k).alias(f"{k}_high"))]
    spans: dict[str, int] = {}
    slack = 0.0
    while level:
        boxes = {
            r["node"]: r
            for r in rows.withColumn("node", branch(root, lambda n: F.lit(n.first)))
            .groupBy("node")
            .agg(F.sum("size").alias("size"), *ends)
            .collect()
        }
        if not boxes:
            break
        if not spans:
            spans = {k: max(1, boxes[0][f"{k}_high"] - boxes[0][f"{k}_low"]) for k in DIMENSIONS}
            slack = tolerance * boxes[0]["size"] / shards
        searches = {}
        for node in level:
            half = node.shards // 2
            box = boxes.get(node.first)
            if box is None:  # nothing to share out: any cut will do
                node.dimension, node.key = DIMENSIONS[0], 0
                continue
            node.dimension = max(DIMENSIONS, key=lambda k: (box[f"{k}_high"] - box[f"{k}_low"]) / spans[k])
            low, high = box[f"{node.dimension}_low"], box[f"{node.dimension}_high"]
            searches[node.first] = Search(node, box["size"] * half / node.shards, low, high)
        quantiles(rows, root, searches, slack)
        following = []
        for node in level:
            half = node.shards // 2
            node.left, node.right = Node(node.first, half), Node(node.first + half, node.shards - half)
            following += [n for n in (node.left, node.right) if n.shards > 1]
        level = following
    return root


def shard(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shards: int = SHARDS, target_bytes: int | None = None
) -> DataFrame:
    """One row per document: id, size, crc, shard, slot.

    With `target_bytes` there are as many shards as it takes for leaves of that size.
    """
    rows = points(docs, id_col, text_col)
    if target_bytes is not None:
        total = rows.agg(F.sum("size")).first()[0] or 0
        shards = max(1, -(-total // target_bytes))
    root = grow(rows, shards)
    # Every shard has about as many buckets as it has thousands of rows at the mean size.
    buckets = max(1, rows.count() // (shards * BUCKET_ROWS))
    placed = rows.select(
        "id", "size", "crc", "_row",
        branch(root, lambda n: F.lit(n.first)).cast("int").alias("shard"),
        F.pmod(F.xxhash64("_row"), F.lit(buckets)).alias("bucket"),
    )
    return gapless(placed, ["shard"], "bucket", [F.col("_row")], "slot").select("id", "size", "crc", "shard", "slot")
