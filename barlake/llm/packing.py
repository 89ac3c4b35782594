"""Packing of examples into token sequences under several limits at once (vector bin packing, dot-product rule).

A task streams its examples past a window of waiting ones.  The open sequence takes, of the waiting examples that fit,
the one whose needs (tokens, segments, loss-bearing tokens) have the largest dot product with what the sequence has
left, both as shares of the limits: large examples go first and small ones close the gaps.  Nothing is shuffled and no
task holds more than a window of examples, so neither a hot source nor a long text gathers anywhere.
"""

from __future__ import annotations

import functools
from collections import deque
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barlake.llm.common import batches

WAITING = 256  # examples that a task chooses from
FLUSH = 1 << 18  # tokens that a task holds back before it returns sequences
END = 1  # id after each text
NUMBERS = 1 << 33  # sequences that one task can number


@dataclass(frozen=True)
class Limits:
    """What one sequence may hold."""

    tokens: int = 2048
    segments: int = 256
    loss: int = 2048  # tokens that bear loss

    def vector(self) -> np.ndarray:
        return np.array([self.tokens, self.segments, self.loss], np.int64)


@dataclass(frozen=True)
class Piece:
    """A run of one example's ids; ``bears[i]`` is the number of loss-bearing ids before the example's i-th."""

    key: tuple
    ids: np.ndarray
    bears: np.ndarray
    start: int
    end: int

    @property
    def need(self) -> tuple[int, int, int]:
        return self.end - self.start, 1, int(self.bears[self.end] - self.bears[self.start])

    def cut(self, at: int) -> tuple[Piece, Piece]:
        return replace(self, end=at), replace(self, start=at)

    def head(self, left: np.ndarray) -> int:
        """Where a cut leaves the longest head that fits into ``left``."""
        by_loss = int(np.searchsorted(self.bears, self.bears[self.start] + left[2], "right")) - 1
        return max(self.start, min(self.end, self.start + int(left[0]), by_loss)) if left[1] > 0 else self.start


class Packer:
    """Sequences out of a stream of examples.

    With ``cut`` an example may be cut anywhere.  A sequence is then full or has a power of two of tokens: what is over
    goes back among the waiting pieces, so nothing is padded.  Without ``cut`` examples stay whole.
    """

    def __init__(self, limits: Limits, cut: bool, waiting: int = WAITING) -> None:
        self.limits, self.cut, self.room = limits.vector(), cut, waiting
        self.pieces: list[Piece | None] = [None] * waiting
        self.needs = np.full((waiting, 3), np.iinfo(np.int32).max, np.int64)
        self.free = list(range(waiting))[::-1]
        self.more: deque[Piece] = deque()  # pieces that came back
        self.open: list[Piece] = []
        self.left = self.limits.copy()

    def add(self, piece: Piece) -> Iterator[list[Piece]]:
        """Take an example; the sequences that this closes."""
        full = self.limits[0]
        while self.cut and piece.head(self.limits) - piece.start == full:
            own, piece = piece.cut(piece.start + int(full))
            yield [own]
        if piece.end == piece.start:
            return
        while not self.free:
            yield from self._step()
        self._wait(piece)

    def finish(self) -> Iterator[list[Piece]]:
        while len(self.free) < self.room or self.more or self.open:
            while self.more and self.free:
                self._wait(self.more.popleft())
            yield from self._step()

    def _wait(self, piece: Piece) -> None:
        at = self.free.pop()
        self.pieces[at], self.needs[at] = piece, piece.need

    def _take(self, at: int) -> Piece:
        piece = self.pieces[at]
        self.pieces[at], self.needs[at] = None, np.iinfo(np.int32).max
        self.free.append(at)
        return piece

    def _place(self, piece: Piece) -> None:
        self.open.append(piece)
        self.left = self.left - piece.need

    def _step(self) -> Iterator[list[Piece]]:
        """Place one waiting piece, or close the open sequence."""
        while self.more and self.free:
            self._wait(self.more.popleft())
        value = (self.needs / self.limits) @ (self.left / self.limits)
        waits = self.needs[:, 0] < np.iinfo(np.int32).max
        fits = waits & (self.needs <= self.left).all(axis=1)
        if fits.any():
            self._place(self._take(int(np.argmax(np.where(fits, value, -1.0)))))
        elif self.cut and waits.any() and self.left[0] and self.left[1]:
            at = int(np.argmax(np.where(waits, value, -1.0)))
            piece = self.pieces[at]
            end = piece.head(self.left)
            if end > piece.start:
                own, rest = self._take(at).cut(end)
                self._place(own)
                self._wait(rest)
            else:
                yield from self._close()
        else:
            yield from self._close()
        if not self.left[0]:
            yield from self._close()

    def _close(self) -> Iterator[list[Piece]]:
        """Close the open sequence; with ``cut`` at a power of two, with the rest returned."""
        size = int(self.limits[0] - self.left[0])
        if self.cut and 0 < size < self.limits[0]:
            over = size - (1 << (size.bit_length() - 1))
            while over:
                last = self.open.pop()
                if last.end - last.start > over:
                    own, last = last.cut(last.end - over)
                    self.open.append(own)
                over -= last.end - last.start
                self.more.appendleft(last)
        done, self.open, self.left = self.open, [], self.limits.copy()
        if done:
            yield done


def _needs(piece: Piece, limits: np.ndarray) -> bool:
    return bool((np.array(piece.need) <= limits).all())


def _packed(examples: Iterable[tuple[tuple, np.ndarray, np.ndarray | None]], limits: Limits, cut: bool, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Rows of pieces out of (key, ids, loss flags); see ``pack``."""
    from pyspark import TaskContext

    context = TaskContext.get()
    number = (context.partitionId() if context else 0) * NUMBERS
    rows: list[tuple] = []
    size = 0

    def row(piece: Piece, sequence: int | None, offset: int | None) -> tuple:
        length, _, loss = piece.need
        return *piece.key, piece.start, length, len(piece.ids), loss, piece.ids[piece.start : piece.end].astype("<u4").tobytes(), sequence, offset

    def flush() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    def sequences() -> Iterator[list[Piece]]:
        packer = Packer(limits, cut)
        for key, ids, loss in examples:
            bears = np.arange(len(ids) + 1) if loss is None else np.concatenate(([0], np.cumsum(loss, dtype=np.int64)))
            piece = Piece(key, ids, bears, 0, len(ids))
            if not len(ids) or not (cut or _needs(piece, packer.limits)):
                rows.append(row(piece, None, None))
            else:
                yield from packer.add(piece)
        yield from packer.finish()

    for sequence in sequences():
        offset = 0
        for piece in sequence:
            rows.append(row(piece, number, offset))
            offset += piece.end - piece.start
        number, size = number + 1, size + offset
        if size >= FLUSH:
            yield flush()
            rows, size = [], 0
    if rows:
        yield flush()


def _schema(df: DataFrame, keep: list[str]) -> tuple[pa.Schema, str]:
    from pyspark.sql.pandas.types import to_arrow_schema

    added = {"start": "long", "length": "long", "total": "long", "loss_tokens": "long", "piece": "binary", "sequence_id": "long", "offset": "long"}
    clash = {*added} & {*keep}
    if clash:
        raise ValueError(f"columns exist: {sorted(clash)}")
    row = df.select(*keep, *[F.lit(None).cast(kind).alias(name) for name, kind in added.items()]).schema
    return to_arrow_schema(row), row


def pack(examples: DataFrame, keep: list[str], limits: Limits = Limits(), cut: bool = False, ids: str = "ids", loss: str | None = None) -> DataFrame:
    """Pack examples given as ``ids`` (array of int) with optional ``loss`` flags (array of boolean; null: every id bears loss).

    Returns one row per piece: the ``keep`` columns, start (ids of the example before the piece), length, total (ids of
    the example), loss_tokens (long), piece (its ids as little-endian unsigned 32-bit numbers), sequence_id and offset
    (long; offsets of a sequence are gapless from 0).  No sequence exceeds ``limits``.  An example without ids, or
    without ``cut`` one that exceeds a limit by itself, comes back whole with a null sequence_id.  Repeated rows are
    packed each; null keys are kept; other columns go; an empty table gives no rows.
    """
    schema, row = _schema(examples, keep)
    names = [*keep, ids, *([loss] if loss else [])]

    def run(source: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def read() -> Iterator[tuple]:
            for batch in source:
                for at in range(0, batch.num_rows, 256):
                    part = batch.slice(at, 256)
                    keys = zip(*(part.column(i).to_pylist() for i in range(len(keep))), strict=True) if keep else [()] * part.num_rows
                    for i, key in enumerate(keys):
                        own = part.column(len(keep))[i].values
                        flags = part.column(len(keep) + 1)[i].values if loss else None
                        yield tuple(key), np.zeros(0, np.int64) if own is None else own.to_numpy(zero_copy_only=False), None if flags is None else flags.to_numpy(zero_copy_only=False)

        return _packed(read(), limits, cut, schema)

    return examples.select(*names).mapInArrow(run, row)


@functools.lru_cache(maxsize=2)
def encoder(path: str):
    """Text to ids by a byte-level vocabulary file of the ``tokenizers`` format, special tokens of the file included."""
    import json

    import public_tokenizers
    import regex
    import tiktoken

    with open(path, encoding="utf-8") as file:
        model = json.load(file)
    shown = {c: b for b, c in enumerate(_byte_letters())}
    special = {t["content"]: t["id"] for t in model["added_tokens"]}
    ranks = {bytes(shown[c] for c in piece): rank for piece, rank in model["model"]["vocab"].items() if piece not in special}
    coder = tiktoken.Encoding("given", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special)
    parts = regex.compile("|".join(f"(?P<special>{regex.escape(s)})" for s in special) or "(?P<special>(?!))")
    words = regex.compile(public_tokenizers.PATTERN)

    def long_runs(text: str) -> list[int]:
        """The same ids where a run of blanks is too long for the library's own splitting."""
        out, at = [], 0
        for own in [*parts.finditer(text), None]:
            for word in words.findall(text, at, own.start() if own else len(text)):
                out.extend(coder._encode_single_piece(word))
            if own:
                out.append(special[own[0]])
                at = own.end()
        return out

    def encode(text: str) -> list[int]:
        try:
            return coder.encode(text, allowed_special="all")
        except ValueError:
            return long_runs(text)

    return encode


def _byte_letters() -> list[str]:
    """The letter that such files write for each byte: itself where it is printable, else the next free one from 256."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spare = iter(range(256, 512))
    return [chr(b) if b in printable else chr(next(spare)) for b in range(256)]


def pack_texts(docs: DataFrame, path: str, keep: list[str], limits: Limits = Limits(), end: int = END, text: str = "text") -> DataFrame:
    """Encode whole texts (null: empty) by the vocabulary file ``path``, add the id ``end`` and pack them, cut freely.

    Every id bears loss.  The result is that of ``pack``; each text has one id at least and so one piece at least.
    """
    schema, row = _schema(docs, keep)

    def run(source: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path)

        def read() -> Iterator[tuple]:
            for batch in batches(source, "text"):
                keys = zip(*(batch.column(i).to_pylist() for i in range(len(keep))), strict=True) if keep else [()] * batch.num_rows
                for key, value in zip(keys, batch.column("text").to_pylist(), strict=True):
                    yield tuple(key), np.array([*encode(value or ""), end], np.int64), None

        return _packed(read(), limits, True, schema)

    return docs.select(*keep, F.col(text).alias("text")).mapInArrow(run, row)
