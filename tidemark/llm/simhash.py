"""SimHash fingerprints, linked through BK-trees.

* Fingerprints: one Arrow pass over the whole texts.
* Equal fingerprints become one node (the smallest doc_id), so a group of exact
  copies costs one node however large it is.
* Two fingerprints within ``radius`` bits agree in at least ``blocks - radius`` of
  ``blocks`` bit blocks. Each node goes to one shard per choice of that many blocks,
  keyed by their bits, so every link lies inside some shard.
* Each shard is a BK-tree: children hang under their parent by Hamming distance, and
  a search follows only edges whose distance lies within the radius of its own. The
  trees are built where the shuffle puts the shard; sending all of them to every
  executor would need a size that grows with the corpus.
* A search only has to find out what is connected, so a subtree that already belongs
  to the searcher's component is not entered. A shard leaves at most one edge per node.
* A shard of more than ``shard_limit`` nodes is cut into slices, and each pair of
  slices is a tree of its own, so no task holds more than two slices.
* Components come from alternating star contraction over written tables.

Null and empty texts have fingerprint zero and are linked like any other. Rows of one
doc_id are all returned. A null doc_id never names a component unless it is alone.
An empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import partitions, written

SHINGLE = 4
RADIUS = 4
BLOCKS = 6
SHARD_LIMIT = 8192


def fingerprint(text: bytes | None, shingle: int = SHINGLE, seed: int = 42) -> int:
    """The 64-bit fingerprint of a text as a signed integer."""
    parts = (text or b"").lower().split()
    if not parts:
        return 0
    line = b" ".join(parts)
    ends = list(accumulate(len(p) + 1 for p in parts))
    if len(parts) <= shingle:
        hashes = np.array([xxhash.xxh64_intdigest(line, seed)], np.uint64)
    else:
        digest = xxhash.xxh64_intdigest
        starts = [0, *ends]
        hashes = np.fromiter(
            (digest(line[a : b - 1], seed) for a, b in zip(starts, ends[shingle - 1 :])), np.uint64, len(parts) - shingle + 1
        )
    votes = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 65536):
        votes += np.unpackbits(
            hashes[at : at + 65536].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"
        ).sum(0, dtype=np.int64)
    return int(np.packbits(votes * 2 > len(hashes), bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """doc_id and fp, the fingerprint as a signed 64-bit integer."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = [fingerprint(t, shingle) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps, pa.int64())], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary")).mapInArrow(scan, "doc_id long, fp long")


class BKTree:
    """Fingerprints by Hamming distance to their parent, with the component of each.

    ``add`` links a new fingerprint to the components within the radius and returns
    one (node, node) pair per component that it joined.
    """

    def __init__(self, radius: int):
        self.radius = radius
        self.fps: list[int] = []
        self.nodes: list[int] = []
        self.children: list[dict[int, int]] = []
        self.parent: list[int] = []
        self.mixed: list[bool] = []

    def find(self, i: int) -> int:
        up = self.parent
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    def add(self, fp: int, node: int) -> list[tuple[int, int]]:
        me, radius, fps, children, mixed = len(self.fps), self.radius, self.fps, self.children, self.mixed
        fps.append(fp)
        self.nodes.append(node)
        children.append({})
        self.parent.append(me)
        mixed.append(False)
        links = []
        stack = [0] if me else []
        while stack:
            i = stack.pop()
            if not mixed[i] and self.find(i) == self.find(me):
                continue
            far = (fp ^ fps[i]).bit_count()
            if far <= radius and self.find(i) != self.find(me):
                links.append((node, self.nodes[i]))
                self.parent[self.find(i)] = self.find(me)
            stack += [c for at, c in children[i].items() if far - radius <= at <= far + radius]
        i = 0
        while i != me:  # down the edges of its own distances to its place
            if self.find(i) != self.find(me):
                mixed[i] = True
            i = children[i].setdefault((fp ^ fps[i]).bit_count(), me)
        return links


def _shard_keys(fp: Column, blocks: int, radius: int) -> Column:
    """The keys of a fingerprint's shards: the choice of blocks and their bits."""
    cuts = [64 * i // blocks for i in range(blocks + 1)]
    keys = []
    for n, chosen in enumerate(combinations(range(blocks), blocks - radius)):
        mask = sum(((1 << (cuts[b + 1] - cuts[b])) - 1) << cuts[b] for b in chosen)
        keys.append(F.xxhash64(F.lit(n), fp.bitwiseAND(F.lit(mask - (1 << 64) if mask >> 63 else mask))))
    return F.array(*keys)


def links(nodes: DataFrame, radius: int = RADIUS, blocks: int = BLOCKS, shard_limit: int = SHARD_LIMIT) -> DataFrame:
    """Edges (a, b) between nodes that connect all fingerprints within ``radius`` bits.

    ``nodes``: node and fp, each fp once. Two shards whose keys clash only share a tree.
    """
    if blocks <= radius:
        raise ValueError("more blocks than differing bits are needed")
    sharded = nodes.select("node", "fp", F.explode(_shard_keys(F.col("fp"), blocks, radius)).alias("key"))
    large = sharded.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > shard_limit)
    large = large.select(F.col("key").alias("of"), F.ceil(F.col("n") / shard_limit).cast("int").alias("slices"))
    slices = F.coalesce("slices", F.lit(1))
    mine = F.pmod(F.xxhash64("fp", F.lit(7)), slices).cast("int")
    cells = (
        sharded.join(large, F.col("key") == F.col("of"), "left")
        .select("node", "fp", "key", mine.alias("mine"), F.explode(F.sequence(F.lit(0), slices - 1)).alias("other"))
        .select("node", "fp", "key", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"))
    )

    def trees(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, tree, first = None, None, (0, 0)
        for b in batches:
            found: list[tuple[int, int]] = []
            for node, fp, *cell in zip(*(c.to_pylist() for c in b.columns)):
                fp &= (1 << 64) - 1
                if cell != now:
                    now, tree, first = cell, None, (fp, node)
                    continue
                if tree is None:
                    tree = BKTree(radius)
                    tree.add(*first)
                found += tree.add(fp, node)
            yield pa.RecordBatch.from_arrays(
                [pa.array([e[0] for e in found], pa.int64()), pa.array([e[1] for e in found], pa.int64())], ["a", "b"]
            )

    n = partitions(nodes.sparkSession)
    return (
        cells.repartition(n, "key", "i", "j").sortWithinPartitions("key", "i", "j", "fp").mapInArrow(trees, "a long, b long")
    )


def components(edges: DataFrame) -> DataFrame:
    """node and component, the smallest node reachable, for every node on an edge.

    Large-star and small-star steps alternate until the edges are stars. Each step
    hangs nodes under the smallest neighbour; minima are taken before the shuffle.
    """
    a, b = F.col("a"), F.col("b")
    now = written(edges.where(a != b).select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).distinct())
    mark = F.struct(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")))
    seen = now.agg(mark).first()[0]
    while seen[0]:
        both = now.unionByName(now.select(b.alias("a"), a.alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("at"), F.least("m", "a").alias("m"))
        large = both.join(low, a == F.col("at")).where(b > a).select(b.alias("a"), F.col("m").alias("b"))
        large = large.where(a != b).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("at"), "m")
        small = large.join(low, a == F.col("at")).select(F.explode(F.array(a, b)).alias("a"), F.col("m").alias("b"))
        now = written(small.where(a != b).distinct())
        was, seen = seen, now.agg(mark).first()[0]
        if was == seen:
            break
    return now.select(a.alias("node"), b.alias("component"))


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id of every row.

    Nodes are fingerprints, so a row without an id links others like any row and gets the
    smallest id it reaches (null where it reaches none), and rows of one id with different
    texts are as far apart as their texts.
    """
    fps = written(fingerprints(docs, shingle))
    nodes = written(fps.groupBy("fp").agg(F.min("doc_id").alias("first")))
    stars = components(links(nodes.select(F.col("fp").alias("node"), "fp"), radius))
    classes = nodes.join(stars, F.col("fp") == F.col("node"), "left").select(
        F.col("fp").alias("of"), F.coalesce("component", "fp").alias("class"), "first"
    )
    smallest = classes.groupBy(F.col("class").alias("c")).agg(F.min("first").alias("component_id"))
    named = classes.join(smallest, F.col("class") == F.col("c")).select("of", "component_id")
    return fps.join(named, F.col("fp") == F.col("of")).select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )
