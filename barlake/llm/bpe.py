"""Byte-level BPE: merges folded by higher-order functions over the distinct words of a table.

A task cuts its documents into chunks of bounded text and writes each word as its id, if the vocabulary has it whole, or
as the number of a word of the chunk that has to be folded.  The words to fold are dealt by hash; every 64 tasks form a
slice, in which Spark folds the ranked merges once over the bytes of each distinct word, and each chunk gets its ids back
in its own order.  Texts never move, a frequent word costs one entry a chunk, and a group holds the chunks of one slice.
"""

from __future__ import annotations

import base64
import zlib
from collections.abc import Iterable, Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barlake.llm.common import fresh, lean, let, release, slices
from barlake.llm.common import sizes as text_bytes

CHUNK_BYTES = 8 << 20
PART = 1 << 18  # bytes of texts that are split together; a longer text is split alone
BUCKETS = 64  # that the words of a slice are dealt to
SLICE = 64  # tasks whose words are folded together
BITS = 31
NONE = 2**BITS - 1


def read_ranks(path: str) -> dict[bytes, int]:
    """Ranks of a vocabulary file with one base64 piece and its rank a line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(piece): int(rank) for piece, rank in (line.split() for line in lines if line.strip())}


def merge_table(ranks: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(number of each byte, id of each number, base, cells): which two pieces join to which, in two arrays.

    Pieces are numbered by rank, then come bytes that the vocabulary lacks, then a mark that joins with nothing.  The cell
    at base[a] + b holds a and the number of a and b joined; rows of a are laid over each other so that no cells meet.
    """
    pieces = sorted(ranks, key=ranks.__getitem__)
    number = {piece: n for n, piece in enumerate(pieces)}
    for byte in map(bytes, zip(range(256), strict=True)):
        number.setdefault(byte, len(number))
    mark = len(number)
    rows: dict[int, list[tuple[int, int]]] = {}
    for n, piece in enumerate(pieces):
        for cut in range(1, len(piece)):
            left, right = number.get(piece[:cut]), number.get(piece[cut:])
            if left is not None and right is not None:
                rows.setdefault(left, []).append((right, n))
    base = np.zeros(mark + 1, np.int32)
    cells = np.full(2 * mark + sum(map(len, rows.values())) + 1, (mark + 1) << BITS, np.int64)
    taken, start = np.zeros(len(cells), bool), 0
    for left, row in sorted(rows.items(), key=lambda r: (-len(r[1]), r[0])):
        columns, joined = np.array(row, np.int64).T
        while True:  # larger rows come first, and a row goes on where the last one was laid
            starts = start + np.flatnonzero(~taken[start + columns[0] : start + columns[0] + 256])
            if len(fits := starts[~taken[starts[:, None] + columns].any(axis=1)]):
                start = int(fits[0])
                break
            start += 256
            if start + 256 + mark >= len(cells):
                grown = len(cells)
                cells, taken = np.concatenate((cells, np.full(grown, (mark + 1) << BITS))), np.concatenate((taken, np.zeros(grown, bool)))
        base[left] = start
        taken[start + columns] = True
        cells[start + columns] = left << BITS | joined
    ids = np.full(mark, NONE, np.int32)
    ids[: len(pieces)] = [ranks[piece] for piece in pieces]
    return np.array([number[bytes([byte])] for byte in range(256)], np.int64), ids, base, cells[: int(base.max()) + mark + 1]


def _start(words: pa.Array, byte: np.ndarray, base: np.ndarray, cells: np.ndarray) -> pa.Array:
    """Each word as its parts, at first bytes between two marks: the number a part makes joined to the next, and its own."""
    until = np.frombuffer(words.buffers()[1], np.int32, len(words) + 1).astype(np.int64)
    text = np.frombuffer(words.buffers()[2] or b"", np.uint8)[: until[-1]]
    bounds = until + 2 * np.arange(len(until))
    parts = np.full(bounds[-1] + 1, len(base) - 1, np.int64)
    parts[np.arange(len(text)) + np.repeat(2 * np.arange(len(words)) + 1, np.diff(until))] = byte[text]
    order = np.minimum(cells[base[parts[:-1]] + parts[1:]] ^ parts[:-1] << BITS, NONE)
    return pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(order << BITS | parts[:-1]))


def fold_merges(words: Column, base: Column, cells: Column) -> Column:
    """The numbers of the pieces of each word of an array: a fold over merges, the lowest rank first and the leftmost of equals."""
    return let(base, lambda b: let(cells, lambda c: F.transform(words, lambda w: _fold_word(w, b, c))))


def _fold_word(word: Column, base: Column, cells: Column) -> Column:
    """A part is one number: that of it joined to the next part (NONE if there is none such) before its own.

    Marks stand before the first and after the last part, so joins over the ends need no case of their own.
    """
    low, rest = F.lit(NONE).cast("long"), F.lit(1 << 30)

    def part(left: Column, right: Column) -> Column:
        # a cell of another row differs in its high bits
        joined = F.least(F.element_at(cells, F.element_at(base, (left + 1).cast("int")) + right.cast("int") + 1).bitwiseXOR(F.shiftleft(left, BITS)), low)
        return F.shiftleft(joined, BITS).bitwiseOR(left)

    def take(parts: Column, place: Column) -> Column:
        own = lambda at: F.element_at(parts, at).bitwiseAND(low)
        # aggregate over one value binds it without a copy of the parts
        return F.aggregate(F.array(F.shiftright(F.element_at(parts, place), BITS)), parts, lambda _, joined: F.concat(
            F.slice(parts, F.lit(1), place - 2), F.array(part(own(place - 1), joined), part(joined, own(place + 2))), F.slice(parts, place + 2, rest)))

    def merge(parts: Column, _: Column) -> Column:
        # rank and place as one number: array_min finds the leftmost of the lowest ranks (array_position takes far longer)
        least = F.array_min(F.transform(parts, lambda p, i: p.bitwiseAND(F.lit(NONE << BITS)).bitwiseOR(i.cast("long"))))
        return F.aggregate(F.array(least), parts, lambda _, m: F.when(m >= NONE << BITS, parts).otherwise(
            F.aggregate(F.array(m.bitwiseAND(low).cast("int") + 1), parts, lambda _, place: take(parts, place))))

    return F.aggregate(F.sequence(F.lit(4), F.size(word)), word, merge, lambda parts: F.transform(F.slice(parts, F.lit(2), F.size(parts) - 2), lambda p: p.bitwiseAND(low).cast("int")))


def _squeeze(values: np.ndarray) -> bytes:
    """Numbers of 32 bits compressed byte by byte: the high bytes are nearly constant."""
    planes = values.astype("<u4").view(np.uint8).reshape(-1, 4).T
    return pa.compress(planes.tobytes(), codec="zstd", asbytes=True)


def _widen(raw: bytes, n: int) -> np.ndarray:
    planes = np.frombuffer(pa.decompress(raw, decompressed_size=4 * n, codec="zstd", asbytes=True), np.uint8).reshape(4, -1)
    return np.ascontiguousarray(planes.T).view("<u4").reshape(-1).astype(np.int64)


def _list_words(words: list[bytes]) -> tuple[int, int, bytes, bytes]:
    """(number, bytes, sizes, text) of words, compressed."""
    text = b"".join(words)
    return len(words), len(text), _squeeze(np.fromiter(map(len, words), np.int64, len(words))), pa.compress(text, codec="zstd", asbytes=True)


def _read_words(n: int, size: int, sizes: bytes, text: bytes) -> pa.Array:
    until = np.concatenate(([0], np.cumsum(_widen(sizes, n)))).astype(np.int32)
    return pa.StringArray.from_buffers(n, pa.py_buffer(until), pa.py_buffer(pa.decompress(text, decompressed_size=size, codec="zstd", asbytes=True)))


def _beyond(whole: dict[str, int]) -> int:
    return max(whole.values(), default=-1) + 1


class _Codes(dict):
    """The ids of whole words; any other word gets the next number beyond them when it is first looked up."""

    def __init__(self, whole: dict[str, int]) -> None:
        super().__init__(whole)
        self.shift = _beyond(whole) - len(whole)

    def __missing__(self, word: str) -> int:
        self[word] = code = len(self) + self.shift
        return code


def _chunks(source: Iterable[pa.RecordBatch], text: int, keep: list[int], whole: dict[str, int], pattern: str, limit: int = 0) -> Iterator[pa.RecordBatch]:
    """Chunks of documents: each word as an id or, beyond the ids, as the number of a word to fold; those are listed by bucket.

    A chunk takes rows of as many batches as it has room for, and of them it holds the codes and the kept columns only.
    """
    import regex
    from pyspark import TaskContext

    find, task, count = regex.compile(pattern).findall, TaskContext.get().partitionId(), 0
    rows, codes, sizes, code, held = [], [], [], _Codes(whole), 0

    def chunk() -> pa.RecordBatch:
        words = [w.encode() for w in islice(code, len(whole), None)]
        bucket = np.fromiter(map(zlib.crc32, words), np.uint32, len(words)) % BUCKETS
        order = np.argsort(bucket, kind="stable")
        own, every = pa.concat_arrays(rows), np.concatenate(codes)
        found, first = np.unique(bucket[order], return_index=True)
        asks = [(b, *_list_words([words[i] for i in of.tolist()])) for b, of in zip(found.tolist(), np.split(order, first[1:]), strict=False)]
        return pa.RecordBatch.from_arrays([
            pa.array([(task << 32) + count]), pa.array([task // SLICE]), pa.ListArray.from_arrays(pa.array([0, len(own)], pa.int32()), own), pa.array([len(every)]), pa.array([_squeeze(every)], pa.binary()), pa.array([_squeeze(np.array(sizes))], pa.binary()),
            pa.array([len(words)]), pa.array([_squeeze(order)], pa.binary()), pa.array([[dict(zip(_ASK.names, a, strict=True)) for a in asks]], pa.list_(_ASK)),
        ], ["chunk", "slice", "rows", "n_words", "codes", "sizes", "n_other", "places", "asks"])

    for batch in source:
        for start, end in slices(batch.column(text), PART):
            part = batch.slice(start, end - start)
            size = int(text_bytes(part.column(text)).sum())
            if rows and held + size > (limit or CHUNK_BYTES):
                yield chunk()
                rows, codes, sizes, code, held, count = [], [], [], _Codes(whole), 0, count + 1
            every = pa.array(np.arange(part.num_rows))  # taken, not sliced: a slice would keep its whole batch
            rows.append(pa.StructArray.from_arrays([part.column(k).take(every) for k in keep], fields=[part.schema.field(k) for k in keep]) if keep else pa.array([{}] * part.num_rows, pa.struct([])))
            for value in part.column(text).to_pylist():
                found = find(value or "")
                codes.append(np.fromiter(map(code.__getitem__, found), np.int32, len(found)))
                sizes.append(len(found))
            held += size
    if rows:
        yield chunk()


_ASK = pa.struct([("bucket", pa.int32()), ("n", pa.int64()), ("size", pa.int64()), ("sizes", pa.binary()), ("text", pa.binary())])
ASK = "bucket int, n long, size long, sizes binary, text binary"


def _distinct(group: pa.Table, byte: np.ndarray, base: np.ndarray, cells: np.ndarray) -> pa.Table:
    """The distinct words of a bucket and slice, the table to fold them by, and which of them each chunk asked for."""
    asked = [_read_words(r["n"], r["size"], r["sizes"], r["text"]) for r in group.column("ask").to_pylist()]
    coded = pa.concat_arrays(asked).dictionary_encode()
    parts = [_squeeze(c) for c in np.split(coded.indices.to_numpy(), np.cumsum([len(a) for a in asked])[:-1])]
    asks = pa.StructArray.from_arrays([group.column("chunk").combine_chunks(), pa.array([len(a) for a in asked], pa.int64()), pa.array(parts, pa.binary())], ["chunk", "n", "asked"])
    one = lambda values: pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)
    return pa.table({"bucket": pa.array([group.column("bucket")[0].as_py()], pa.int32()), "words": one(_start(coded.dictionary, byte, base, cells)), "base": one(pa.array(base)), "cells": one(pa.array(cells)), "asks": one(asks)})


def _answer(source: Iterable[pa.RecordBatch], ids: np.ndarray) -> Iterator[pa.RecordBatch]:
    """For each chunk and bucket the ids of the words asked for: sizes, and all ids in order."""
    for batch in source:
        for i in range(batch.num_rows):
            codes, asks = batch.column("codes")[i].values, batch.column("asks")[i].as_py()
            bounds, flat, rows = codes.offsets.to_numpy(), ids[codes.values.to_numpy()], []
            for ask in asks:
                out, size = _gather(bounds, flat, _widen(ask["asked"], ask["n"]))
                rows.append((ask["chunk"], batch.column("bucket")[i].as_py(), ask["n"], len(out), _squeeze(size), _squeeze(out)))
            columns = zip(*rows, strict=True)
            types = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["chunk", "bucket", "n", "n_ids", "sizes", "ids"])


def _gather(bounds: np.ndarray, flat: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(the lists ``which`` one after another, the size of each) of lists flat[bounds[i]:bounds[i + 1]]."""
    size = bounds[which + 1] - bounds[which]
    offset = np.cumsum(size) - size
    return flat[np.repeat(bounds[which] - offset, size) + np.arange(size.sum())], size


def encode(df: DataFrame, ranks: dict[bytes, int], pattern: str, text: str = "text", ids: str = "ids", keep: list[str] | None = None, chunk: int = 0) -> DataFrame:
    """The ``keep`` columns (default: all) and ``ids`` (array of int): each match of ``pattern`` in the whole text encoded by itself.

    Null texts are encoded as empty; special tokens are ordinary text; a text of any length is one piece of work.  All
    rows stay, repeated ones too; an empty table gives no rows.  An output column that clashes with a kept one is refused.
    ``chunk``: bytes of texts that a task holds and assembles together (0: CHUNK_BYTES); fewer move more words.
    """
    keep = list(df.columns) if keep is None else keep
    if ids in keep:
        raise ValueError(f"column {ids} exists")
    spark, names = df.sparkSession, [*keep, ids]
    needed = [*dict.fromkeys([text, *keep])]
    whole = {}
    for piece, rank in ranks.items():
        try:
            whole[piece.decode()] = rank
        except UnicodeDecodeError:  # part of a character, never a word
            continue
    byte, numbers, base, cells = merge_table(ranks)
    first = _beyond(whole)
    # the vocabulary, whatever the input; each step's workers load their own part of it
    known, joins, back = (spark.sparkContext.broadcast(x) for x in (whole, (byte, base, cells), numbers))
    source = df.select(*needed)
    kept = df.select(*keep).schema
    place, places = needed.index(text), [needed.index(k) for k in keep]
    schema = f"chunk long, slice long, rows array<{kept.simpleString()}>, n_words long, codes binary, sizes binary, n_other long, places binary, asks array<struct<{ASK.replace(' ', ':').replace(',:', ',')}>>"
    # both uses below read this exchange: chunks are cut and moved once
    packed = source.mapInArrow(lean(lambda batches: _chunks(batches, place, places, known.value, pattern, chunk)), schema).repartition("chunk")

    def ask(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                asks = batch.column("asks")[i].values
                if asks is not None and len(asks):
                    same = lambda c: pa.array([batch.column(c)[i].as_py()] * len(asks), pa.int64())  # noqa: B023, E731
                    yield pa.RecordBatch.from_arrays([same("chunk"), same("slice"), asks.field("bucket"), asks], ["chunk", "slice", "bucket", "ask"])

    asked = packed.mapInArrow(ask, f"chunk long, slice long, bucket int, ask struct<{ASK.replace(' ', ':').replace(',:', ',')}>")

    def distinct(group: pa.Table) -> pa.Table:
        return _distinct(group, *joins.value)

    # the table comes as data: a literal of its size would stand in every plan and its description, in the driver's memory
    listed = asked.groupBy("slice", "bucket").applyInArrow(distinct, "bucket int, words array<array<long>>, base array<int>, cells array<long>, asks array<struct<chunk:long,n:long,asked:binary>>")
    folded = listed.select("bucket", fold_merges(F.col("words"), F.col("base"), F.col("cells")).alias("codes"), "asks")
    answers = folded.mapInArrow(lean(lambda batches: _answer(batches, back.value)), "chunk long, bucket int, n long, n_ids long, sizes binary, ids binary")

    def assemble(left: pa.Table, right: pa.Table) -> pa.Table:
        release()  # what the chunk before has left
        row = left.slice(0, 1)
        rows = row.column("rows").combine_chunks().values
        n_docs = len(rows)
        order = _widen(row.column("places")[0].as_py(), row.column("n_other")[0].as_py())
        found = sorted(right.to_pylist(), key=lambda r: r["bucket"])
        size = np.zeros(len(order), np.int64)
        size[order] = np.concatenate([_widen(r["sizes"], r["n"]) for r in found]) if found else 0
        flat = np.concatenate([_widen(r["ids"], r["n_ids"]) for r in found]) if found else np.zeros(0, np.int32)
        start = np.zeros(len(order), np.int64)
        start[order] = np.cumsum(size[order]) - size[order]
        codes = _widen(row.column("codes")[0].as_py(), row.column("n_words")[0].as_py()).astype(np.int32)
        whole_word = codes < first
        own = codes[~whole_word] - first
        length = np.ones(len(codes), np.int32)
        length[~whole_word] = size[own]
        until = np.cumsum(length, dtype=np.int32)  # the ids of a chunk are one list of Arrow, under 2**31
        out = np.empty(until[-1] if len(until) else 0, np.int32)
        out[(until - length)[whole_word]] = codes[whole_word]
        span = size[own]
        offset = np.cumsum(span) - span
        inside = np.arange(span.sum()) - np.repeat(offset, span)
        out[np.repeat((until - length)[~whole_word], span) + inside] = flat[np.repeat(start[own], span) + inside]
        words = np.concatenate(([0], np.cumsum(_widen(row.column("sizes")[0].as_py(), n_docs), dtype=np.int64)))
        bounds = np.concatenate(([0], until))[words]
        columns = rows.flatten() if keep else []
        return pa.Table.from_arrays([*columns, pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(out))], names=names)

    from pyspark.sql.types import ArrayType, IntegerType, StructType

    result = StructType([*kept.fields]).add(ids, ArrayType(IntegerType()))
    return packed.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(assemble, result)


def decode(ids: Column, ranks: dict[bytes, int]) -> Column:
    """The bytes of a text from its ids: binary pieces looked up in a literal and concatenated in order."""
    pieces = [""] * (max(ranks.values(), default=-1) + 1)
    for piece, rank in ranks.items():
        pieces[rank] = piece.hex()
    literal = F.split(F.lit(",".join(pieces)), ",")
    return F.unhex(F.array_join(F.transform(F.coalesce(ids, F.array().cast("array<int>")), lambda i: F.element_at(literal, i + 1)), ""))


def encoded_table(df: DataFrame, ranks: dict[bytes, int], pattern: str, text: str = "text") -> DataFrame:
    """``df`` with ids, n_tokens and the decoded bytes."""
    name = fresh(df, "ids")
    coded = encode(df, ranks, pattern, text, name)
    return coded.withColumn("n_tokens", F.size(name).cast("long")).withColumn("decoded", decode(F.col(name), ranks)).withColumnRenamed(name, "ids")
