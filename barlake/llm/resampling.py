"""Importance resampling towards a target distribution, with weights from bit-sliced bucket counts.

Every text is a bag of hashed word and word-pair features in 10,000 buckets; a bucket's gain compares the target's
share with the corpus's.  A text's bucket counts are kept as bit planes, one 10,000-bit row for each bit of the counts,
and the gains as planes of their magnitudes, positive and negative apart.  The sum of gains over a text is then a sum of
powers of two times popcounts of ANDs, in whole numbers, so it is exact in any order and on any machine.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barlake.llm.common import batches
from barlake.session import staged

BUCKETS = 10000
PART = 1 << 20  # bytes of one text that are cut into words at once
DOCS = 128  # texts whose planes a task holds at once
LEAST_WORDS = 20
SHARE = (25, 100)
SEED = 7

# Digits, letters and all bytes beyond ASCII belong to words; A-Z become a-z and all else a blank.
_WORDS = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def _crc_steps(longest: int = 64) -> np.ndarray:
    """[n, k, byte]: what byte k of a checksum becomes after ``n`` zero bytes, so that joined words need no bytes.

    A CRC is linear over bits: crc(a + b) = steps(crc(a), len(b)) ^ crc(b).
    """
    byte = np.arange(256, dtype=np.uint32)
    one = byte.copy()
    for _ in range(8):
        one = (one >> np.uint32(1)) ^ (np.uint32(0xEDB88320) * (one & np.uint32(1)))
    tables = np.empty((longest + 1, 4, 256), np.uint32)
    tables[0] = np.stack([byte << np.uint32(8 * k) for k in range(4)])
    for n in range(1, longest + 1):
        before = tables[n - 1]
        tables[n] = (before >> np.uint32(8)) ^ one[before & np.uint32(255)]
    return tables


_STEPS = _crc_steps()


def _advance(crc: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Checksums after ``size`` zero bytes each."""
    out, size = crc.copy(), size.copy()
    longest = len(_STEPS) - 1
    while True:
        step = np.minimum(size, longest)
        out = _STEPS[step, 0, out & 255] ^ _STEPS[step, 1, out >> 8 & 255] ^ _STEPS[step, 2, out >> 16 & 255] ^ _STEPS[step, 3, out >> 24]
        size -= step
        if not size.any():
            return out


def _parts(text: bytes) -> Iterator[list[bytes]]:
    """The words of a text, a bounded part of it at a time."""
    text = text.translate(_WORDS)
    at = 0
    while at < len(text):
        cut = text.find(b" ", at + PART)
        cut = len(text) if cut < 0 else cut
        yield text[at:cut].split()
        at = cut


_BLANK = zlib.crc32(b" ")


def features(texts: list[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(text index, bucket, whether it is a single word) of each feature of the texts, parts of bounded size at a time."""
    words, owner, first = [], [], []  # first: whether a word starts its text
    size = 0

    def cut() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        own = np.array(owner, np.int64)
        crc = np.fromiter(map(zlib.crc32, words), np.uint32, len(words))
        length = np.fromiter(map(len, words), np.int64, len(words))
        joined = np.flatnonzero(~np.array(first, bool))
        joined = joined[joined > 0]
        left = _advance(crc[joined - 1], np.ones(len(joined), np.int64)) ^ np.uint32(_BLANK)
        pair = _advance(left, length[joined]) ^ crc[joined]
        real = np.array([o >= 0 for o in owner], bool)
        return np.concatenate([own[real], own[joined]]), np.concatenate([crc[real], pair]).astype(np.int64) % BUCKETS, np.repeat([True, False], [real.sum(), len(joined)])

    for i, text in enumerate(texts):
        last = None
        for part in _parts((text or "").encode("utf-8", "surrogatepass")):
            if last is not None and part and not words:  # the word before, only for the pair
                words.append(last)
                owner.append(-1)
                first.append(True)
            words.extend(part)
            owner.extend([i] * len(part))
            first.extend([last is None, *[False] * (len(part) - 1)] if part else [])
            last = part[-1] if part else last
            size += len(part)
            if size >= PART // 8:
                yield cut()
                words, owner, first, size = [], [], [], 0
    if words:
        yield cut()


def bucket_counts(texts: DataFrame, text: str = "text") -> DataFrame:
    """(bucket, n): how often each bucket's features occur in all texts; at most BUCKETS rows."""

    def run(source: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS, np.int64)
        for batch in batches(source, "text"):
            for _, bucket, _ in features(batch.column("text").to_pylist()):
                total += np.bincount(bucket, minlength=BUCKETS)
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(total[seen])], ["bucket", "n"])

    return texts.select(F.col(text).alias("text")).mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(corpus: DataFrame, target: DataFrame) -> list[int]:
    """Gain of each bucket, from the counts of both (at most BUCKETS numbers each come to the driver)."""
    (s, whole), (t, wanted) = ((dict(rows), sum(n for _, n in rows)) for rows in ([(r.bucket, r.n) for r in c.collect()] for c in (corpus, target)))
    return [math.floor(1000 * math.log(float(t.get(b, 0) + 1) * float(whole + BUCKETS) / (float(s.get(b, 0) + 1) * float(wanted + BUCKETS)))) for b in range(BUCKETS)]


def planes(counts: np.ndarray, bits: int) -> Iterator[np.ndarray]:
    """For each bit of the counts [row, bucket] a plane [row, word of 64 buckets]."""
    for i in range(bits):
        packed = np.packbits((counts & (1 << i)) != 0, axis=1, bitorder="little")
        yield np.pad(packed, ((0, 0), (0, -packed.shape[1] % 8))).view(np.uint64)


def gain_planes(gain: np.ndarray) -> tuple[np.ndarray, list[int]]:
    """(planes, factor of each) of signed gains: powers of two, the highest with a negative factor."""
    bits = int(np.abs(gain).max(initial=0)).bit_length() + 1
    return np.concatenate(list(planes(gain[None, :], bits))), [*(1 << j for j in range(bits - 1)), -(1 << (bits - 1))]


def plane_sums(counts: np.ndarray, sliced: np.ndarray, factor: list[int]) -> np.ndarray:
    """For each row of counts [row, bucket] the exact sum of count times gain."""
    total, top = np.zeros(len(counts), np.int64), counts.max(axis=1, initial=0)
    for i in range(int(top.max(initial=0)).bit_length()):
        rows = np.flatnonzero(top >= 1 << i)
        (plane,) = planes(counts[rows] >> i, 1)
        total[rows] += sum(np.bitwise_count(plane & own).sum(axis=1, dtype=np.int64) * (f << i) for own, f in zip(sliced, factor, strict=True))
    return total


def noise(key: object, seed: int = SEED) -> int:
    """Floor of 1000 times a Gumbel variate that depends on the key alone, so a retry draws the same."""
    h = int(hashlib.sha256(f"{seed}:{'' if key is None else key}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def weigh(docs: DataFrame, gain: list[int], key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_words, n_features, weight, score), all long, of every row of ``docs``.

    ``weight`` is the floored mean gain of a text's features (none, empty or null: 0), ``score`` adds ``noise(key)``.
    Rows that repeat a key are weighed each.  A null key has the noise of the empty string.
    """
    sliced, factor = gain_planes(np.array(gain, np.int64))
    shared = docs.sparkSession.sparkContext.broadcast((sliced, factor))  # a fixed size

    def run(source: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(source, "text"):
            for at in range(0, batch.num_rows, DOCS):
                part = batch.slice(at, DOCS)
                counts, n_words = np.zeros(part.num_rows * BUCKETS, np.int64), np.zeros(part.num_rows, np.int64)
                for owner, bucket, single in features(part.column("text").to_pylist()):
                    counts += np.bincount(owner * BUCKETS + bucket, minlength=len(counts))
                    n_words += np.bincount(owner[single], minlength=part.num_rows)
                counts = counts.reshape(part.num_rows, BUCKETS)
                n_features = counts.sum(axis=1, dtype=np.int64)
                weight = plane_sums(counts, *shared.value) // np.maximum(n_features, 1)
                drawn = np.array([noise(k) for k in part.column("key").to_pylist()], np.int64)
                yield pa.RecordBatch.from_arrays([part.column("key"), *map(pa.array, (n_words, n_features, weight, weight + drawn))], ["key", "n_words", "n_features", "weight", "score"])

    kind = docs.schema[key].dataType.simpleString()
    weighed = docs.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(run, f"key {kind}, n_words long, n_features long, weight long, score long")
    return weighed.withColumnRenamed("key", key)


def draw(weighed: DataFrame, key: str = "doc_id", share: tuple[int, int] = SHARE, least_words: int = LEAST_WORDS) -> DataFrame:
    """Add ``rank`` (long): 1, 2, ... for the floor(share of N) highest scores of the N rows with ``least_words`` or more.

    Ties go to the smaller key (nulls first), then to an arbitrary but fixed row.  The rows in question are sorted by
    range over all tasks; a task numbers its own range, and the sizes of the ranges, one row a range, shift the numbers.
    The score that bounds the draw comes from counts per score, a number of rows that depends on the range of scores.
    """
    rows = staged(weighed.withColumn("row", F.monotonically_increasing_id()))
    able = F.col("n_words") >= least_words
    counted = rows.where(able).groupBy("score").agg(F.count("*").alias("n")).collect()
    want = share[0] * sum(r.n for r in counted) // share[1]
    above, bound = 0, None
    for r in sorted(counted, key=lambda r: -r.score):
        if above >= want:
            break
        above, bound = above + r.n, r.score
    if bound is None:
        return rows.drop("row").withColumn("rank", F.lit(None).cast("long"))
    chosen = able & (F.col("score") >= bound)
    names = weighed.columns

    def number(source: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, at = TaskContext.get().partitionId(), 0
        for batch in source:
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(batch.num_rows, part)), pa.array(np.arange(at, at + batch.num_rows))], [*batch.schema.names, "part", "place"])
            at += batch.num_rows

    row = rows.drop("row").withColumn("part", F.lit(0).cast("long")).withColumn("place", F.lit(0).cast("long")).schema
    ordered = staged(rows.where(chosen).orderBy(F.desc("score"), key, "row").drop("row").mapInArrow(number, row))
    size = dict(ordered.groupBy("part").count().collect())  # one number a task
    before = np.cumsum([0, *(size.get(p, 0) for p in range(max(size, default=0) + 1))])
    shift = F.element_at(F.split(F.lit(",".join(map(str, before))), ","), (F.col("part") + 1).cast("int")).cast("long")
    ranked = ordered.withColumn("rank", shift + F.col("place") + 1)
    drawn = ranked.select(*names, F.when(F.col("rank") <= want, F.col("rank")).alias("rank"))
    return drawn.unionByName(rows.where(~chosen).select(*names, F.lit(None).cast("long").alias("rank")))


def resample(docs: DataFrame, target: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``weigh`` all rows of ``docs`` against the texts of ``target`` and ``draw``; empty tables give gains of 0 or no rows."""
    gain = gains(bucket_counts(docs, text), bucket_counts(target, text))
    return draw(weigh(docs, gain, key, text), key)
