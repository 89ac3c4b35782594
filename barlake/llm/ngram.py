"""A bigram language model by deleted interpolation, learned from and applied to a corpus that fits no machine.

P(w | v) mixes the maximum-likelihood estimates c(v w) / c(v) and c(w) / N with 1 / (V + 1).  The weights depend on the
bucket of c(v), powers of two, and are learned by expectation-maximisation on texts held out of the counts.

Texts are packed into chunks of bounded size, each with its distinct words.  A chunk sends each of its distinct words
and word pairs once, sorted and packed per bucket of the hash, so a frequent word costs one entry a chunk, not one a
token; a bucket sums the counts and answers each chunk in the chunk's own order.
"""

from __future__ import annotations

import math
import uuid
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barlake.llm import tokens
from barlake.llm.common import cuts, sizes, slices
from barlake.session import staged

FOLDS, TEST, HELD = 7, 2, 3
CHUNK_BYTES = 4 << 20
KEYS_PER_BUCKET = 1 << 20
END = np.uint64(0x5EED)  # the token after each text, and the context of a text's first word
TOLERANCE = 1e-3  # the weights have settled when none moves by more
FLOOR = 1e-6  # share of the uniform mixture in every bucket, so that no text is impossible


@dataclass
class Mixture:
    total: int  # training tokens
    distinct: int
    weights: np.ndarray  # one row per bucket: bigram, unigram, uniform


def bucket_of(count: np.ndarray) -> np.ndarray:
    """0 for an unseen context, else one more than the power of two below its count."""
    return np.frexp(np.asarray(count, np.float64))[1]


CHUNK = "chunk long, held boolean, docs array<long>, folds array<int>, first array<long>, words binary, tokens binary"


def chunks(docs: DataFrame, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """Pack texts: ids, folds, the distinct words' hashes and each text's words as numbers; texts held out apart."""
    names = [doc, text]

    def pack(source: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            folds = np.array([zlib.crc32(b"" if d is None else str(d).encode()) % FOLDS for d in batch.column(names[0]).to_pylist()], np.int32)
            size = sizes(batch.column(names[1]))
            for held in (False, True):
                chosen = np.flatnonzero((folds == HELD) == held)
                for start, end in cuts(size[chosen], CHUNK_BYTES):
                    yield _pack(batch.take(pa.array(chosen[start:end])), folds[chosen[start:end]], held)

    return staged(docs.select(F.col(doc).cast("long"), text).mapInArrow(pack, CHUNK))


def _pack(part: pa.RecordBatch, folds: np.ndarray, held: bool) -> pa.RecordBatch:
    found, first = [], [0]
    for a, b in slices(part.column(1), 1 << 19):
        words = tokens.split(part.column(1)[a:b].to_pylist(), lower=True)
        found.append(np.insert(words.hashes(), words.first[1:], END))
        first.extend((first[-1] + np.cumsum(words.count + 1)).tolist())
    distinct, code = np.unique(np.concatenate(found), return_inverse=True)
    row = {"chunk": [uuid.uuid4().int >> 65], "held": [held], "docs": [part.column(0).to_pylist()], "folds": [folds.tolist()], "first": [first], "words": [distinct.tobytes()], "tokens": [pa.compress(code.astype(np.uint32).tobytes(), codec="zstd", asbytes=True)]}
    return pa.RecordBatch.from_pydict(row, schema=_CHUNK)


def _each(batch: pa.RecordBatch | pa.Table) -> Iterator[dict]:
    """The rows one at a time: a chunk is large."""
    for i in range(batch.num_rows):
        yield batch.slice(i, 1).to_pylist()[0]


_CHUNK = pa.schema([("chunk", pa.int64()), ("held", pa.bool_()), ("docs", pa.list_(pa.int64())), ("folds", pa.list_(pa.int32())), ("first", pa.list_(pa.int64())), ("words", pa.binary()), ("tokens", pa.binary())])


def _pairs(words: np.ndarray, code: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(context of each token, hashes of the distinct pairs, each token's pair) of a chunk."""
    context = np.empty_like(code)
    context[1:] = code[:-1]
    context[first[:-1]] = np.searchsorted(words, END)
    distinct, pair = np.unique(context.astype(np.int64) * len(words) + code, return_inverse=True)
    return context, tokens.mix(words[distinct // len(words)] * np.uint64(0x9E3779B97F4A7C15) + words[distinct % len(words)]), pair


def _open(row: dict) -> tuple[np.ndarray, ...]:
    first = np.array(row["first"], np.int64)
    code = np.frombuffer(pa.decompress(row["tokens"], decompressed_size=4 * int(first[-1]), codec="zstd", asbytes=True), np.uint32)
    return np.array(row["folds"], np.int64), first, np.frombuffer(row["words"], np.uint64), code.astype(np.int64)


def _dealt(keys: np.ndarray, n: int) -> dict[int, np.ndarray]:
    """For each bucket with keys, in order: (bucket, indices of its keys)."""
    bucket = (keys >> np.uint64(33)).astype(np.int64) % n
    order = np.argsort(bucket, kind="stable")
    found, first = np.unique(bucket[order], return_index=True)
    return dict(zip(found.tolist(), np.split(order, first[1:]), strict=False))


def squeeze(counts: np.ndarray) -> bytes:
    """Counts as compressed bytes: most are small, so shuffles and tables shrink to a fraction."""
    return pa.compress(counts.astype(np.int64).tobytes(), codec="zstd", asbytes=True)


def widen(data: bytes, n: int) -> np.ndarray:
    return np.frombuffer(pa.decompress(data, decompressed_size=8 * n, codec="zstd", asbytes=True), np.int64)


ANSWER = "chunk long, gram int, bucket int, fitted binary, held binary, distinct long, total long, fitted_total long"


def buckets(packed: DataFrame) -> int:
    """Buckets of bounded size, from the number of tokens: no chunk has more keys of an order than tokens."""
    size = packed.select(F.sum(F.element_at("first", -1))).first()[0] or 0
    return max(1, math.ceil(size / KEYS_PER_BUCKET))


def counts(packed: DataFrame, n: int) -> DataFrame:
    """For each chunk, n-gram order and bucket: the corpus counts of the chunk's n-grams, in the chunk's order.

    Counts of the texts fitted on and of those held out are apart; test texts count nowhere but get answers.  One row
    a bucket without a chunk carries the numbers of distinct words and of tokens.
    """
    def send(source: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            for row in _each(batch):
                fold, first, words, code = _open(row)
                role = np.repeat(fold, np.diff(first))
                _, pairs, pair = _pairs(words, code, first)
                for gram, (keys, which) in enumerate(((words, code), (pairs, pair)), 1):
                    fitted, held = (np.bincount(which[chosen], minlength=len(keys)) for chosen in ((role != TEST) & (role != HELD), role == HELD))
                    cut = [*_dealt(keys, n).items()]
                    yield pa.RecordBatch.from_arrays([
                        pa.array([b for b, _ in cut], pa.int32()), pa.array([gram] * len(cut), pa.int32()), pa.array([row["chunk"]] * len(cut), pa.int64()),
                        pa.array([keys[own].tobytes() for _, own in cut], pa.binary()), *(pa.array([squeeze(x[own]) for _, own in cut], pa.binary()) for x in (fitted, held)),
                    ], ["bucket", "gram", "chunk", "keys", "fitted", "held"])

    def add(group: pa.Table) -> pa.Table:
        bucket, gram = group.column("bucket")[0].as_py(), group.column("gram")[0].as_py()
        keys = [np.frombuffer(x, np.uint64) for x in group.column("keys").to_pylist()]
        distinct, which = np.unique(np.concatenate(keys), return_inverse=True)
        sums = [np.bincount(which, np.concatenate([widen(x, len(k)) for x, k in zip(group.column(c).to_pylist(), keys, strict=True)]), len(distinct)).astype(np.int64) for c in ("fitted", "held")]
        cuts = np.cumsum([len(k) for k in keys])[:-1]
        answers = [[squeeze(x) for x in np.split(s[which], cuts)] for s in sums]
        every = sums[0] + sums[1]
        m = len(keys)
        return pa.table({
            "chunk": pa.array([*group.column("chunk").to_pylist(), None], pa.int64()), "gram": pa.array([gram] * (m + 1), pa.int32()), "bucket": pa.array([bucket] * (m + 1), pa.int32()),
            "fitted": pa.array([*answers[0], None], pa.binary()), "held": pa.array([*answers[1], None], pa.binary()), "distinct": pa.array([None] * m + [int((every > 0).sum())], pa.int64()), "total": pa.array([None] * m + [int(every.sum())], pa.int64()),
            "fitted_total": pa.array([None] * m + [int(sums[0].sum())], pa.int64()),
        })

    sent = packed.mapInArrow(send, "bucket int, gram int, chunk long, keys binary, fitted binary, held binary")
    return staged(sent.groupBy("bucket", "gram").applyInArrow(add, ANSWER))


def _answers(right: pa.Table, words: np.ndarray, pairs: np.ndarray, n: int, names: tuple[str, ...]) -> list[np.ndarray]:
    """The summed counts of a chunk's words and of its pairs, put back into its order."""
    out = []
    for gram, keys in ((1, words), (2, pairs)):
        dealt, total = _dealt(keys, n), np.zeros(len(keys), np.int64)
        for row in _each(right):
            if row["gram"] == gram:
                own = dealt[row["bucket"]]
                total[own] += sum(widen(row[c], len(own)) for c in names)
        out.append(total)
    return out


def learn(packed: DataFrame, counted: DataFrame, n: int) -> Mixture:
    """Totals of all training texts, and weights by expectation-maximisation on the texts held out.

    The held-out tokens are reduced to distinct triples of counts; an iteration is one aggregation over them that
    returns three numbers a bucket.  It runs until no weight moves by more than TOLERANCE.
    """
    row = counted.where("chunk IS NULL AND gram = 1").agg(F.sum("total").alias("n"), F.sum("distinct").alias("v"), F.sum("fitted_total").alias("f")).first()
    total, distinct, fit_total = row.n or 0, row.v or 0, row.f or 0
    def triples(left: pa.Table, right: pa.Table) -> pa.Table:
        out = np.zeros((4, 0), np.int64)
        for chunk in _each(left):
            _, first, words, code = _open(chunk)
            context, pairs, pair = _pairs(words, code, first)
            one, two = _answers(right, words, pairs, n, ("fitted",))
            cells, times = np.unique(np.stack([two[pair], one[context], one[code]]), axis=1, return_counts=True)
            out = np.concatenate([cells, times[None, :]])
        return pa.table({k: pa.array(out[i]) for i, k in enumerate(("c2", "cv", "cw", "times"))})

    held = packed.where("held").groupBy("chunk").cogroup(counted.where("chunk IS NOT NULL").join(packed.where("held").select("chunk"), "chunk", "left_semi").groupBy("chunk"))
    cells = held.applyInArrow(triples, "c2 long, cv long, cw long, times long").groupBy("c2", "cv", "cw").agg(F.sum("times").alias("times"))
    cells = staged(cells.withColumn("level", F.when(F.col("cv") > 0, F.floor(F.log2("cv") + 1e-12) + 1).otherwise(0).cast("int")))
    seen = cells.agg(F.max("level"), F.sum("times")).first()
    levels = (seen[0] or 0) + 1
    weights = np.full((levels + 1, 3), 1 / 3)  # the last row is for levels without held-out tokens
    weights[0] = 0, 0.5, 0.5
    while seen[1]:
        table = F.array(*[F.array(*[F.lit(float(x)) for x in w]) for w in weights])
        mine = F.element_at(table, F.col("level") + 1)
        parts = [F.col("w")[0] * F.when(F.col("cv") > 0, F.col("c2") / F.col("cv")).otherwise(0.0), F.col("w")[1] * F.col("cw") / F.lit(float(max(1, fit_total))), F.col("w")[2] / F.lit(float(distinct + 1))]
        shares = cells.withColumn("w", mine).select("level", "times", *[p.alias(f"p{i}") for i, p in enumerate(parts)]).withColumn("p", F.col("p0") + F.col("p1") + F.col("p2"))
        rows = shares.groupBy("level").agg(F.sum("times").alias("times"), *[F.sum(F.col("times") * F.col(f"p{i}") / F.col("p")).alias(f"e{i}") for i in range(3)]).collect()
        fresh = weights.copy()
        for r in rows:
            fresh[r.level] = np.array([r.e0, r.e1, r.e2]) / r.times
        pooled = np.array([[r.e0, r.e1, r.e2] for r in rows]).sum(axis=0)
        empty = np.setdiff1d(np.arange(levels + 1), [r.level for r in rows])
        fresh[empty] = pooled / pooled.sum()
        moved, weights = np.abs(fresh - weights).max(), fresh
        if moved < TOLERANCE:
            break
    return Mixture(int(total), int(distinct), (1 - FLOOR) * weights + FLOOR / 3)


SCORE = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def score(docs: DataFrame, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """Score every text (null: empty) by a model learned from the texts whose crc32(id) mod 7 is not 2.

    Returns doc_id, held_out, n_tokens, n_known, train_tokens, base_score (add-one unigram) and score (the model), both
    base-10 logarithms of the whole text with its end.  Rows with equal ids are scored each; a null id counts as the
    empty string in the fold; a text of any length is one piece of work, whole.  An empty table gives no rows.
    """
    packed = chunks(docs, doc, text)
    n = buckets(packed)
    counted = counts(packed, n)
    model = learn(packed, counted, n)

    def rate(left: pa.Table, right: pa.Table) -> pa.Table:
        rows: list[pa.Table] = []
        for chunk in _each(left):
            fold, first, words, code = _open(chunk)
            context, pairs, pair = _pairs(words, code, first)
            one, two = _answers(right, words, pairs, n, ("fitted", "held"))
            cw, cv, c2 = one[code], one[context], two[pair]
            level = np.minimum(bucket_of(cv), len(model.weights) - 1)
            w = model.weights[level]
            p = w[:, 0] * c2 / np.maximum(cv, 1) + w[:, 1] * cw / max(1, model.total) + w[:, 2] / (model.distinct + 1)
            base = np.log10((cw + 1) / (model.total + model.distinct + 1))
            add = lambda x: np.add.reduceat(x, first[:-1])
            k = len(fold)
            rows.append(pa.table({
                "doc_id": pa.array(chunk["docs"], pa.int64()), "held_out": pa.array(fold == TEST), "n_tokens": pa.array(np.diff(first)), "n_known": pa.array(add((cw > 0).astype(np.int64))),
                "train_tokens": pa.array(np.full(k, model.total)), "base_score": pa.array(add(base)), "score": pa.array(add(np.log10(p))),
            }))
        return pa.concat_tables(rows) if rows else pa.table({c.name: pa.array([], c.type) for c in _SCORE})

    return packed.groupBy("chunk").cogroup(counted.where("chunk IS NOT NULL").groupBy("chunk")).applyInArrow(rate, SCORE)


_SCORE = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])
