"""Substring dedup: repeated windows of words found with suffix automata of reference shards.

Reading every document against every shard would cost documents times shards, so each shard's automaton gets only the
passages that can match in it.  A window of 50 words is named by the smallest hash among its 8-word runs, its anchor;
equal windows have equal anchors.  Anchors that two documents share are few; around those, the windows that an anchor
names form a passage.  Equal passages are one, and passages of one anchor meet: in one shard, or dealt to as many
shards as their number needs.  A shard's automaton, which knows the smallest document of each state, gives for each window
the first document of the shard that holds it; shards of the same anchor then compare their distinct windows, packed by
hash, so that each window gets its first document over all of them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barlake.llm import tokens
from barlake.llm.common import batches, fresh
from barlake.session import staged

WINDOW = 50
RUN = 8
PASSAGES = 1000  # that a shard should hold
KEYS = 1 << 20  # windows that shards of the same anchors compare in one group
NOBODY = np.iinfo(np.int64).max


def _anchors(hashes: np.ndarray, window: int, run: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, position, first window, last window) of the anchors of one text with ``window`` words or more."""
    runs = tokens.chain(hashes, run)
    width = window - run + 1
    best, size = np.arange(len(runs)), 1
    while size < width:  # leftmost smallest of ever wider ranges
        step = min(size, width - size)
        left, right = best[: len(best) - step], best[step:]
        best, size = np.where(runs[left] <= runs[right], left, right), size + step
    place, first = np.unique(best, return_index=True)
    return runs[place], place, first, np.append(first[1:], len(best)) - 1


class Automaton:
    """Suffix automaton of many sequences; each state knows the smallest owner of a sequence that holds its words."""

    def __init__(self) -> None:
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length, self.owner = [-1], [0], [np.iinfo(np.int64).max]

    def _state(self, length: int, moves: dict[int, int], link: int, owner: int) -> int:
        self.next.append(moves)
        self.length.append(length)
        self.link.append(link)
        self.owner.append(owner)
        return len(self.link) - 1

    def _split(self, at: int, word: int, to: int) -> int:
        """Clone ``to`` for the shorter words that end in ``at`` plus ``word``."""
        clone = self._state(self.length[at] + 1, dict(self.next[to]), self.link[to], np.iinfo(np.int64).max)
        self.link[to] = clone
        while at >= 0 and self.next[at].get(word) == to:
            self.next[at][word] = clone
            at = self.link[at]
        return clone

    def add(self, sequence: list[int], owner: int) -> None:
        last = 0
        for word in sequence:
            to = self.next[last].get(word)
            if to is not None:
                last = to if self.length[to] == self.length[last] + 1 else self._split(last, word, to)
            else:
                new, at = self._state(self.length[last] + 1, {}, 0, owner), last
                while at >= 0 and word not in self.next[at]:
                    self.next[at][word] = new
                    at = self.link[at]
                if at >= 0:
                    to = self.next[at][word]
                    self.link[new] = to if self.length[to] == self.length[at] + 1 else self._split(at, word, to)
                last = new
            if owner < self.owner[last]:
                self.owner[last] = owner

    def close(self, window: int) -> None:
        """Hand the smallest owner up to suffixes and note each state's suffix of ``window`` words."""
        order = np.argsort(np.array(self.length), kind="stable")
        for s in order[:0:-1].tolist():
            if self.owner[s] < self.owner[self.link[s]]:
                self.owner[self.link[s]] = self.owner[s]
        self.suffix = list(range(len(self.link)))
        for s in order[1:].tolist():
            if self.length[self.link[s]] >= window:
                self.suffix[s] = self.suffix[self.link[s]]

    def owners(self, sequence: list[int], window: int) -> list[int]:
        """Matching statistics: for each window of the sequence the smallest owner that holds it."""
        state, size, out = 0, 0, []
        for i, word in enumerate(sequence):
            while state and word not in self.next[state]:
                state = self.link[state]
                size = self.length[state]
            if word in self.next[state]:
                state, size = self.next[state][word], size + 1
            if i >= window - 1:
                out.append(self.owner[self.suffix[state]] if size >= window else np.iinfo(np.int64).max)
        return out


def _keys(hashes: np.ndarray, window: int) -> np.ndarray:
    """128 bits for each window, as pairs of numbers."""
    return np.stack([tokens.chain(hashes, window), tokens.chain(tokens.mix(hashes ^ np.uint64(0xA5A5A5A5A5A5A5A5)), window)], axis=1)


def _settle(left: pa.Table, right: pa.Table) -> pa.Table:
    """Owners of each passage of a shard, from the lowest owners of the shard's distinct windows."""
    n = sum(len(k) // 16 for k in left.column("keys").to_pylist() if k)
    low = np.full(n, NOBODY)
    for row in right.to_pylist():
        low[np.frombuffer(row["at"], np.int64)] = np.frombuffer(row["owners"], np.int64)
    rows = [r for r in left.select(["anchor", "passage", "places"]).to_pylist() if r["places"] is not None]
    return pa.table({
        "anchor": pa.array([r["anchor"] for r in rows], pa.int64()), "passage": pa.array([r["passage"] for r in rows], pa.binary()),
        "owners": pa.array([low[np.frombuffer(r["places"], np.uint32)].tobytes() for r in rows], pa.binary()),
    })


def _lowest(group: pa.Table) -> pa.Table:
    """The smallest owner of each window over all shards, handed back to each shard in its order."""
    keys = [np.frombuffer(k, np.uint64).reshape(-1, 2) for k in group.column("keys").to_pylist()]
    every = np.concatenate(keys)
    _, which = np.unique(every.view([("a", np.uint64), ("b", np.uint64)]).reshape(-1), return_inverse=True)
    low = np.full(which.max(initial=-1) + 1, NOBODY)
    np.minimum.at(low, which, np.concatenate([np.frombuffer(o, np.int64) for o in group.column("owners").to_pylist()]))
    parts = np.split(low[which], np.cumsum([len(k) for k in keys])[:-1])
    return pa.table({"shard": group.column("shard"), "at": group.column("at"), "owners": pa.array([p.tobytes() for p in parts], pa.binary())})


def _per_text(source: Iterable[pa.RecordBatch], text: str) -> Iterator[tuple[pa.RecordBatch, int, np.ndarray]]:
    for batch in batches(source, text):
        words = tokens.split(batch.column(text).to_pylist())
        hashes = words.hashes()
        for i in range(batch.num_rows):
            yield batch, i, hashes[words.first[i] : words.first[i + 1]]


def spans(docs: DataFrame, doc: str = "doc_id", text: str = "text", window: int = WINDOW, run: int = RUN) -> DataFrame:
    """(doc, version, spans): the word ranges [start, end) of each document that windows of earlier documents cover, merged.

    A window of ``window`` consecutive words counts if its words also start in a document with a smaller id.  Only
    documents with a span are returned; null ids and null texts have none.  Rows that repeat an id are told apart by
    ``version``, the hash of their text, and are never earlier than each other.
    """
    texts = docs.where(F.col(doc).isNotNull() & F.col(text).isNotNull()).select(F.col(doc).cast("long").alias("doc"), F.xxhash64(text).alias("version"), F.col(text).alias("text"))

    def anchors(source: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, found, size = [], [], 0
        for batch, i, hashes in _per_text(source, "text"):
            if len(hashes) >= window:
                found.append(np.unique(_anchors(hashes, window, run)[0]))
                ids.append(np.full(len(found[-1]), batch.column("doc")[i].as_py()))
                size += len(found[-1])
            if size > 1 << 16:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(found).view(np.int64)), pa.array(np.concatenate(ids))], ["anchor", "doc"])
                ids, found, size = [], [], 0
        if size:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(found).view(np.int64)), pa.array(np.concatenate(ids))], ["anchor", "doc"])

    named = staged(texts.mapInArrow(anchors, "anchor long, doc long"))
    shared = staged(named.groupBy("anchor").agg(F.min("doc").alias("low"), F.max("doc").alias("high")).where("low < high").select("anchor"))
    wanted = named.join(shared, "anchor").groupBy("doc").agg(F.collect_set("anchor").alias("anchors"))

    def passages(source: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        for batch, i, hashes in _per_text(source, "text"):
            if len(hashes) >= window:
                own = batch.column("anchors")[i].values.to_numpy().view(np.uint64)
                name, _, first, last = _anchors(hashes, window, run)
                raw, doc_id = hashes.tobytes(), [batch.column(c)[i].as_py() for c in ("doc", "version")]
                for k in np.flatnonzero(np.isin(name, own)):
                    a, b = int(first[k]), int(last[k]) + window
                    rows.append((name[k].astype(np.int64).item(), hashlib.blake2b(raw[8 * a : 8 * b], digest_size=16).digest(), *doc_id, a, b))
            if len(rows) > 1 << 15:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)
                rows = []
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)

    types, names = [pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.int64()], ["anchor", "passage", "doc", "version", "start", "end"]
    placed = staged(texts.join(wanted, "doc").mapInArrow(passages, "anchor long, passage binary, doc long, version long, start long, end long"))
    each = staged(placed.groupBy("anchor", "passage").agg(F.min(F.struct("doc", "version", "start", "end")).alias("at")))
    several = staged(each.groupBy("anchor").agg(F.count("*").alias("n")).where(F.col("n") > PASSAGES).select("anchor", F.ceil(F.col("n") / PASSAGES).alias("parts")))
    shards = max(1, each.count() // PASSAGES)
    part = F.xxhash64("anchor", F.pmod(F.xxhash64("passage"), F.col("parts")))

    def cut(source: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, i, hashes in _per_text(source, "text"):
            own = batch.column("passages")[i].values
            anchor, name, start, end = (own.field(c) for c in ("anchor", "passage", "start", "end"))
            fits = np.flatnonzero(end.to_numpy() <= len(hashes))  # rows that repeat an id with another text
            raw = hashes.tobytes()
            data = [raw[8 * a : 8 * b] for a, b in zip(start.to_numpy()[fits].tolist(), end.to_numpy()[fits].tolist(), strict=True)]
            good = np.array([hashlib.blake2b(d, digest_size=16).digest() == name[int(k)].as_py() for d, k in zip(data, fits, strict=True)], bool)
            if len(fits) and good.any():
                keep = pa.array(fits[good])
                yield pa.RecordBatch.from_arrays([anchor.take(keep), name.take(keep), pa.array([batch.column("doc")[i].as_py()] * len(keep), pa.int64()), pa.array([d for d, g in zip(data, good, strict=True) if g], pa.binary())], ["anchor", "passage", "doc", "words"])

    read = each.select(F.col("at.doc").alias("doc"), F.col("at.version").alias("version"), F.struct("anchor", "passage", "at.start", "at.end").alias("p")).groupBy("doc", "version").agg(F.collect_list("p").alias("passages"))
    cut_out = texts.join(read, ["doc", "version"]).mapInArrow(cut, "anchor long, passage binary, doc long, words binary")
    reference = cut_out.join(several, "anchor", "left").withColumn("shard", F.when(F.col("parts").isNull(), F.pmod(F.xxhash64("anchor"), F.lit(shards))).otherwise(part))

    def match(group: pa.Table) -> pa.Table:
        group = group.combine_chunks()
        data = [np.frombuffer(w, np.uint64) for w in group.column("words").to_pylist()]
        _, flat = np.unique(np.concatenate(data), return_inverse=True)
        cuts = np.cumsum([len(d) for d in data])[:-1]
        sequences = [x.tolist() for x in np.split(flat, cuts)]
        automaton = Automaton()
        for sequence, owner in zip(sequences, group.column("doc").to_pylist(), strict=True):
            automaton.add(sequence, owner)
        automaton.close(window)
        owners = [np.array(automaton.owners(s, window), np.int64) for s in sequences]
        split = np.flatnonzero(group.column("parts").is_valid().to_numpy())
        columns = {"shard": group.column("shard").to_pylist(), "anchor": group.column("anchor").to_pylist(), "passage": group.column("passage").to_pylist(), "owners": [o.tobytes() for o in owners], "places": [None] * len(data), "keys": [None] * len(data)}
        if len(split):  # other shards hold passages of these anchors: list the distinct windows
            keys, first, place = np.unique(np.concatenate([_keys(data[i], window) for i in split]), axis=0, return_index=True, return_inverse=True)
            low = np.concatenate([owners[i] for i in split])[first]
            for i, own in zip(split.tolist(), np.split(place.reshape(-1), np.cumsum([len(owners[i]) for i in split])[:-1]), strict=True):
                columns["owners"][i], columns["places"][i] = None, own.astype(np.uint32).tobytes()
            for name, value in (("shard", columns["shard"][0]), ("anchor", None), ("passage", None), ("owners", low.tobytes()), ("places", None), ("keys", keys.tobytes())):
                columns[name].append(value)
        kinds = {"shard": pa.int64(), "anchor": pa.int64()}
        return pa.table({c: pa.array(v, kinds.get(c, pa.binary())) for c, v in columns.items()})

    matched = staged(reference.groupBy("shard").applyInArrow(match, "shard long, anchor long, passage binary, owners binary, places binary, keys binary"))
    n_groups = max(1, (matched.agg(F.sum(F.octet_length("keys"))).first()[0] or 0) // 16 // KEYS)

    def deal(source: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            for shard, raw, owners in zip(*(batch.column(c).to_pylist() for c in ("shard", "keys", "owners")), strict=True):
                keys, low = np.frombuffer(raw, np.uint64).reshape(-1, 2), np.frombuffer(owners, np.int64)
                own = (keys[:, 0] % np.uint64(n_groups)).astype(np.int64)
                order = np.argsort(own, kind="stable")
                found, first = np.unique(own[order], return_index=True)
                parts = np.split(order, first[1:])
                yield pa.RecordBatch.from_arrays([pa.array(found), pa.array([shard] * len(found), pa.int64()), *(pa.array([x[p].tobytes() for p in parts], pa.binary()) for x in (np.arange(len(keys)), keys, low))], ["group", "shard", "at", "keys", "owners"])

    dealt = matched.where("keys IS NOT NULL").select("shard", "keys", "owners").mapInArrow(deal, "group long, shard long, at binary, keys binary, owners binary")
    lowest = dealt.groupBy("group").applyInArrow(_lowest, "shard long, at binary, owners binary")
    owned = "anchor long, passage binary, owners binary"
    settled = matched.where("owners IS NULL OR keys IS NOT NULL").groupBy("shard").cogroup(lowest.groupBy("shard")).applyInArrow(_settle, owned)
    alone = matched.where("keys IS NULL AND owners IS NOT NULL").select("anchor", "passage", "owners")
    judged = staged(alone.unionByName(settled).dropDuplicates(["anchor", "passage"]))

    def covered(source: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            rows: list[tuple] = []
            for d, v, s, raw in zip(*(batch.column(c).to_pylist() for c in ("doc", "version", "start", "owners")), strict=True):
                hit = np.diff(np.concatenate(([0], np.frombuffer(raw, np.int64) < d, [0])).astype(np.int8))
                rows.extend((d, v, s + a, s + b - 1 + window) for a, b in zip(np.flatnonzero(hit == 1).tolist(), np.flatnonzero(hit == -1).tolist(), strict=True))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.int64()) for i in range(4)], ["doc", "version", "start", "end"])

    ranges = placed.join(judged, ["anchor", "passage"]).select("doc", "version", "start", "owners").mapInArrow(covered, "doc long, version long, start long, end long")
    return ranges.groupBy("doc", "version").agg(F.array_sort(F.collect_set(F.struct("start", "end"))).alias("spans"))


def remove_repeats(docs: DataFrame, doc: str = "doc_id", text: str = "text", window: int = WINDOW) -> DataFrame:
    """``docs`` with ``kept`` (the words left, joined by blanks), n_words and n_removed (long) added; all rows stay.

    A null text has no words; rows that repeat an id are judged by their own text; a text of any length is judged whole;
    an empty table gives no rows.  Added columns that clash with the input's are refused.
    """
    if {"kept", "n_words", "n_removed"} & {*docs.columns}:
        raise ValueError("columns kept, n_words or n_removed exist")
    found, key, version, out = spans(docs, doc, text, window), fresh(docs, "doc"), fresh(docs, "version"), fresh(docs, "spans")
    mine = found.select(F.col("doc").alias(key), F.col("version").alias(version), F.col("spans").alias(out))
    joined = docs.join(mine, (F.col(doc).cast("long") == F.col(key)) & (F.xxhash64(text) == F.col(version)), "left")
    names = docs.columns

    def cut(source: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import re

        find = re.compile(r"[^\x20\x09-\x0D]+").findall
        for batch in batches(source, text):
            kept, size, gone = [], [], []
            for value, cuts in zip(batch.column(text).to_pylist(), batch.column(out).to_pylist(), strict=True):
                words = find(value or "")
                stays = np.ones(len(words), bool)
                for c in cuts or ():
                    stays[c["start"] : c["end"]] = False
                kept.append(" ".join(w for w, s in zip(words, stays.tolist(), strict=True) if s) if cuts else " ".join(words))
                size.append(len(words))
                gone.append(int((~stays).sum()))
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), pa.array(kept, pa.string()), pa.array(size, pa.int64()), pa.array(gone, pa.int64())], [*names, "kept", "n_words", "n_removed"])

    row = docs.select("*", F.lit("").alias("kept"), F.lit(0).cast("long").alias("n_words"), F.lit(0).cast("long").alias("n_removed")).schema
    return joined.select(*names, out).mapInArrow(cut, row)
