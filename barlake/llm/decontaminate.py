"""Benchmark decontamination by spaced seeds.

A mask looks at some positions of a run of tokens and ignores the others, so a substituted token in an ignored place
does not spoil the match.  Hashes of masked runs of test items and of training texts are joined; around each hit a
window of WINDOW tokens with at most SUBSTITUTIONS differences must verify.
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

WINDOW = 13
SUBSTITUTIONS = 2

# Fixed masks: whichever two of 13 tokens differ, one of them, laid at some place of the window, looks at neither.
MASKS = ("11101011", "110100111")

FILTER_BITS = 1 << 24  # of the filter that tasks get: 2 MB whatever the size of the benchmark
PROBES = 3


def _kept(mask: str) -> list[int]:
    return [i for i, c in enumerate(mask) if c == "1"]


def covers(masks: tuple[str, ...], window: int, substitutions: int) -> bool:
    """Whether the masks catch every window with that many differences: what makes the search exact."""
    from itertools import combinations

    seen = [{at + i for i in _kept(m)} for m in masks for at in range(window - len(m) + 1)]
    return all(any(not s & set(bad) for s in seen) for bad in combinations(range(window), substitutions))


def _tokens(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Token hashes and the first token of each text: lower-cased runs of letters and digits."""
    import regex

    plain = regex.compile(r"[^\p{L}\p{N}]+").sub
    words = tokens.split([plain(" ", (t or "").lower()) for t in texts])
    return words.hashes(), words.first


def _seeds(hashes: np.ndarray, first: np.ndarray, masks: tuple[str, ...]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each mask: (mask, position of the run's first token, hash) of runs inside one text of WINDOW tokens or more."""
    owner = np.repeat(np.arange(len(first) - 1), np.diff(first))
    for m, mask in enumerate(masks):
        n = max(0, len(hashes) - len(mask) + 1)
        out = np.full(n, m + 1, np.uint64)
        for i in _kept(mask):
            out = tokens.mix(out * np.uint64(0x9E3779B97F4A7C15) + hashes[i : i + n])
        inside = owner[:n] == owner[len(mask) - 1 : len(mask) - 1 + n]
        place = np.flatnonzero(inside)
        yield m, place, out[place]


def _around(hashes: np.ndarray, first: np.ndarray, place: np.ndarray, reach: int, width: int) -> list[bytes]:
    """32 bits of each token from ``reach`` before a place on, ``width`` tokens; outside the text: a value of its own."""
    owner = np.searchsorted(first, place, "right") - 1
    at = place[:, None] - reach + np.arange(width)[None, :]
    out = (hashes[np.clip(at, 0, max(0, len(hashes) - 1))] >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
    out[(at < first[owner][:, None]) | (at >= first[owner + 1][:, None])] = 0
    return [row.tobytes() for row in out]


def _rows(source: Iterable[pa.RecordBatch], key: str, text: str, masks: tuple[str, ...], window: int, bits: np.ndarray | None) -> Iterator[pa.RecordBatch]:
    reach, width = window - min(map(len, masks)), 2 * window
    for batch in batches(source, text):
        hashes, first = _tokens(batch.column(text).to_pylist())
        for m, place, seed in _seeds(hashes, first, masks):
            if bits is not None:
                for k in range(PROBES):
                    hit = bits[((seed >> np.uint64(20 * k)) & np.uint64(FILTER_BITS - 1)).astype(np.int64)]
                    place, seed = place[hit], seed[hit]
            if not len(place):
                continue
            owner = np.searchsorted(first, place, "right") - 1
            yield pa.RecordBatch.from_arrays([
                batch.column(key).take(pa.array(owner)), pa.array((place - first[owner]).astype(np.int64)), pa.array(np.full(len(place), m, np.int32)), pa.array(seed.view(np.int64)), pa.array(_around(hashes, first, place, reach, width), pa.binary()),
            ], ["id", "at", "mask", "seed", "around"])


ROW = "id long, at long, mask int, seed long, around binary"


def contamination(docs: DataFrame, items: DataFrame, window: int = WINDOW, substitutions: int = SUBSTITUTIONS, masks: tuple[str, ...] = MASKS) -> DataFrame:
    """One row per (doc_id, item_id) with a verified overlap: n_hits, first doc_start and item_start (tokens), fewest differences.

    ``docs`` has doc_id and text, ``items`` item_id and text.  An overlap is a window of ``window`` tokens of the text
    that differs from one of the item in at most ``substitutions`` places; tokens are lower-cased runs of letters and
    digits.  Items with equal tokens are one, named by the smallest item_id.  Null ids are skipped; null, empty and
    shorter texts overlap with nothing.  doc_start is the first overlapping token.

    Texts are read once.  A filter of fixed size, built from the items' hashes, lets through few hashes that no item
    has, and a join on the hash settles the rest; an item set too large for the filter passes more rows to the join.
    """
    if not covers(masks, window, substitutions):
        raise ValueError("the masks miss some windows")
    spark = docs.sparkSession

    def same(source: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(source, "text"):
            hashes, first = _tokens(batch.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column("item_id"), batch.column("text"), pa.array([hashes[a:b].tobytes() for a, b in zip(first, first[1:], strict=False)], pa.binary())], ["item_id", "text", "tokens"])

    plain = items.where("item_id IS NOT NULL").select(F.col("item_id").cast("long").alias("item_id"), "text")
    known = plain.mapInArrow(same, "item_id long, text string, tokens binary").groupBy("tokens").agg(F.min_by("text", "item_id").alias("text"), F.min("item_id").alias("item_id"))
    seeds = staged(known.select("item_id", "text").mapInArrow(lambda s: _rows(s, "item_id", "text", masks, window, None), ROW))
    slots = [F.shiftrightunsigned("seed", 20 * k).bitwiseAND(F.lit(FILTER_BITS - 1)) for k in range(PROBES)]
    lit = seeds.select(F.explode(F.array(*slots)).alias("bit")).select(F.shiftright("bit", 6).alias("lane"), F.expr("shiftleft(1L, CAST(bit & 63 AS INT)) AS bits"))
    lanes = lit.groupBy("lane").agg(F.bit_or("bits").alias("bits")).toArrow()  # at most FILTER_BITS / 64 rows
    packed = np.zeros(FILTER_BITS // 64, np.uint64)
    packed[lanes.column(0).to_numpy()] = lanes.column(1).to_numpy().view(np.uint64)
    shared = spark.sparkContext.broadcast(packed.tobytes())

    def hits(source: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.unpackbits(np.frombuffer(shared.value, np.uint8), bitorder="little").view(bool)
        yield from _rows(source, "doc_id", "text", masks, window, bits)

    spans = np.array([len(m) for m in masks])
    reach = window - int(spans.min())

    def verify(source: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            if not batch.num_rows:
                continue
            a, b = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint32).reshape(batch.num_rows, -1) for c in ("around", "item_around"))
            wrong = np.cumsum(np.pad((a != b) | (a == 0) | (b == 0), ((0, 0), (1, 0))), axis=1)
            edge = np.cumsum(np.pad((a == 0) | (b == 0), ((0, 0), (1, 0))), axis=1)
            span = spans[batch.column("mask").to_numpy()]
            best = np.full(batch.num_rows, window + 1)
            start = np.zeros(batch.num_rows, np.int64)
            for s in range(reach + 1):  # windows that hold the whole run
                diff = wrong[:, s + window] - wrong[:, s]
                fits = (s + window >= reach + span) & (edge[:, s + window] == edge[:, s]) & (diff < best)
                best[fits], start[fits] = diff[fits], s - reach
            good = np.flatnonzero(best <= substitutions)
            yield pa.RecordBatch.from_arrays([batch.column(c).take(pa.array(good)) for c in ("doc_id", "item_id")] + [pa.array(batch.column(c).to_numpy()[good] + start[good]) for c in ("at", "item_at")] + [pa.array(best[good].astype(np.int64))], ["doc_id", "item_id", "doc_start", "item_start", "differences"])

    texts = docs.where("doc_id IS NOT NULL AND text IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    found = texts.mapInArrow(lean(hits), ROW).withColumnRenamed("id", "doc_id")
    named = seeds.select(F.col("id").alias("item_id"), F.col("at").alias("item_at"), "mask", "seed", F.col("around").alias("item_around"))
    verified = found.join(named, ["mask", "seed"]).mapInArrow(verify, "doc_id long, item_id long, doc_start long, item_start long, differences long")
    return verified.groupBy("doc_id", "item_id").agg(
        F.count("*").alias("n_hits"), F.min("doc_start").alias("doc_start"), F.min("item_start").alias("item_start"), F.min("differences").alias("differences"))
