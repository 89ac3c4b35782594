"""SimHash near-duplicates, linked exactly through vantage-point trees.

Distinct fingerprints are partitioned by a tree: a node sends a fingerprint inward or outward by its Hamming distance
to the node's vantage point.  By the triangle inequality two fingerprints within the radius differ by at most the
radius in that distance, so only those near a node's boundary must also visit the other side.  Equal fingerprints are
one point, so copies cost nothing; a leaf returns a forest of its links, not its pairs.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barlake.llm import tokens
from barlake.llm.common import batches, lean
from barlake.session import staged

SEED = 42
LEAF = 4096  # fingerprints that a leaf should hold
SAMPLE = 65536  # fingerprints that place the boundaries of the tree, at most
PIVOTS = 4  # random vantage points and points of the set itself that a leaf tries for a cut
DEPTH = 16  # of the tree that is sent to tasks: at most 2**16 nodes of nine bytes, whatever the input


def fingerprints(docs: DataFrame, text: str = "text", n: int = 3) -> DataFrame:
    """Add ``fingerprint`` (long): bit i is 1 where over half of the hashes of the text's n-word shingles have it.

    A-Z are lowered; shingles are counted with repeats and joined by spaces; a text with fewer words is one shingle, a
    text without words (or null) has fingerprint 0.  The hash is XXH64 of UTF-8 with seed 42.  All columns stay.
    """
    if "fingerprint" in docs.columns:
        raise ValueError("column fingerprint exists")

    def run(source: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(source, text):
            prints = _prints(batch.column(text).to_pylist(), n)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(prints.view(np.int64))], names=[*batch.schema.names, "fingerprint"])

    return docs.mapInArrow(lean(run), docs.withColumn("fingerprint", F.lit(0).cast("long")).schema)


_LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


def _prints(texts: list[str | None], n: int) -> np.ndarray:
    import xxhash

    digest = xxhash.xxh64_intdigest
    out = np.zeros(len(texts), np.uint64)
    for i, value in enumerate(texts):
        parts = (value or "").encode().translate(_LOWER).split()  # bytes.split() cuts at exactly these six blanks
        if not parts:
            continue
        if len(parts) <= n:
            out[i] = digest(b" ".join(parts), SEED)
            continue
        line = b" ".join(parts)
        size = np.fromiter(map(len, parts), np.int64, len(parts)) + 1
        end = np.cumsum(size) - 1
        starts, ends = (end - size + 1)[: len(parts) - n + 1].tolist(), end[n - 1 :].tolist()
        hashes = np.fromiter((digest(line[a:b], SEED) for a, b in zip(starts, ends, strict=True)), np.uint64, len(starts))
        ones = np.zeros(64, np.int64)
        for at in range(0, len(hashes), 1 << 16):
            ones += np.unpackbits(hashes[at : at + (1 << 16)].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        out[i] = np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0]
    return out


class Tree:
    """Vantage points and boundaries in heap order; children of node i are 2i+1 (inside) and 2i+2."""

    def __init__(self, sample: np.ndarray, depth: int) -> None:
        self.depth = depth
        self.point = tokens.mix(np.arange(1, (1 << depth) + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        self.bound = np.full(1 << depth, 32, np.int8)
        nodes = {0: sample}
        for level in range(depth):
            below = {}
            for node in range((1 << level) - 1, (2 << level) - 1):
                own = nodes.pop(node, sample[:0])
                if not len(own):
                    continue
                far = np.bitwise_count(own ^ self.point[node])
                self.bound[node] = int(np.median(far)) + 1
                inside = far < self.bound[node]
                below[2 * node + 1], below[2 * node + 2] = own[inside], own[~inside]
            nodes = below

    def visit(self, points: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
        """(index of point, leaf) for each leaf that a point must visit.

        A point lives on its own side.  Of two linked points that a boundary parts, the outer one is less than
        ``radius`` beyond it and visits the inside too, so each linked pair meets in some leaf.
        """
        index, node = np.arange(len(points)), np.zeros(len(points), np.int64)
        for _ in range(self.depth):
            far = np.bitwise_count(points[index] ^ self.point[node]).astype(np.int64) - self.bound[node]
            both = np.flatnonzero((far >= 0) & (far < radius))
            child = 2 * node + 1 + (far >= 0)
            index, node = np.concatenate([index, index[both]]), np.concatenate([child, 2 * node[both] + 1])
        return index, node


def links(points: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Links of a spanning forest of the points at most ``radius`` apart, found in a local vantage-point tree."""
    label, found = np.arange(len(points)), []

    def compare(own: np.ndarray) -> None:
        part = points[own]
        for at in range(0, len(own), 256):
            near = np.bitwise_count(part[at : at + 256, None] ^ part[None, at:]) <= radius
            for a in np.flatnonzero(near.sum(axis=1) > 1):
                i, others = own[at + a], own[at + np.flatnonzero(near[a])]
                merged, first = np.unique(label[others], return_index=True)
                if len(merged) > 1:
                    found.extend((int(i), int(others[k])) for k in first if label[others[k]] != label[i])
                    label[np.isin(label, merged)] = merged[0]

    def cut(own: np.ndarray, pivot: np.uint64) -> tuple[np.ndarray, np.ndarray]:
        far = np.bitwise_count(points[own] ^ pivot).astype(np.int64)
        bound = int(np.median(far)) + 1
        return own[far < bound + radius], own[far >= bound]

    stack = [(np.arange(len(points)), 0)]
    while stack:
        own, level = stack.pop()
        if len(own) > 512 and level < 64:
            random = tokens.mix(np.arange(PIVOTS, dtype=np.uint64) + np.uint64(level * 7919 + len(own)))
            members = points[own[(random % np.uint64(len(own))).astype(np.int64)]]  # vantage points inside a tight ball
            sides = min((cut(own, p) for p in (*random, *members)), key=lambda s: max(map(len, s)))
            if max(map(len, sides)) < 0.9 * len(own):
                stack += [(part, level + 1) for part in sides]
                continue
        compare(own)
    return found


def components(edges: DataFrame) -> DataFrame:
    """(id, component_id): the smallest id reachable, for the ids of ``edges`` (a, b) of longs.

    Alternates sending each neighbourhood's smallest id to larger and to smaller neighbours until nothing changes;
    the rounds are logarithmic in practice and have no cap.  Each round is written to the shared folder.
    """
    step = staged(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    before = None
    while True:
        both = step.union(step.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = staged(large.join(low, "a").select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b")).where("a <> b").distinct())
        now = small.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        step = small
        if now == before:
            return step.select(F.col("a").alias("id"), F.col("b").alias("component_id"))
        before = now


def link_fingerprints(prints: DataFrame, radius: int = 2, leaf: int = LEAF, sample: int = SAMPLE) -> DataFrame:
    """Classes of (doc_id, fingerprint): adds component_id, the smallest doc_id reachable over links of ``radius`` bits.

    Rows with a null doc_id get a null component.  The tree is built from a bounded sample of distinct fingerprints
    (``sample``, by hash order) and is at most 2**DEPTH nodes; every fingerprint goes through it.  Leaves split further
    inside their tasks.  Other columns stay and an empty table gives an empty one; a column component_id is refused.
    """
    if "component_id" in prints.columns:
        raise ValueError("column component_id exists")
    spark = prints.sparkSession
    prints = staged(prints)
    points = staged(prints.where("doc_id IS NOT NULL").groupBy("fingerprint").agg(F.min("doc_id").alias("id")))
    count = points.count()
    depth = min(DEPTH, max(0, int(np.ceil(np.log(max(1, count / leaf)) / np.log(1 / 0.6)))))
    chosen = points.orderBy(F.xxhash64("fingerprint")).limit(sample).select("fingerprint").toArrow() if depth else None
    tree = Tree(chosen.column(0).to_numpy().view(np.uint64) if depth else np.zeros(0, np.uint64), depth)
    shared = spark.sparkContext.broadcast((tree.point, tree.bound, depth))

    def route(source: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        local = Tree.__new__(Tree)
        local.point, local.bound, local.depth = shared.value
        for batch in source:
            index, node = local.visit(batch.column("fingerprint").to_numpy().view(np.uint64), radius)
            yield pa.RecordBatch.from_arrays([pa.array(node), batch.column("fingerprint").take(pa.array(index)), batch.column("id").take(pa.array(index))], ["leaf", "fingerprint", "id"])

    def search(group: pa.Table) -> pa.Table:
        ids = group.column("id").to_numpy()
        pairs = np.array(links(group.column("fingerprint").to_numpy().view(np.uint64), radius), np.int64).reshape(-1, 2)
        return pa.table({"a": ids[pairs[:, 0]], "b": ids[pairs[:, 1]]})

    routed = points.mapInArrow(route, "leaf long, fingerprint long, id long")
    edges = routed.groupBy("leaf").applyInArrow(search, "a long, b long")
    found = components(edges)
    labels = staged(points.join(found, "id", "left").select("fingerprint", F.coalesce("component_id", "id").alias("component_id")))
    joined = prints.join(labels, "fingerprint", "left")
    return joined.withColumn("component_id", F.when(F.col("doc_id").isNotNull(), F.col("component_id")))
