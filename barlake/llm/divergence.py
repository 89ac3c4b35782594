"""Source divergence audit: how far the term shares of each source of a language lie from the other sources' and the language's.

Identical texts of a language are collapsed first: one row per distinct text with the number of copies in each source,
so each text is cut into terms once and its terms count with those weights.  Tasks add counts up per (language, source,
term) and send them packed; every 64 tasks are combined before the counts of a term meet.  Pairs of sources are evaluated sparsely: a pair in which a term is absent
on one side depends on the term's count only, so such terms are counted by count, and only terms that both sources have
are visited, in blocks of terms whose tasks return one sum a pair.

All numbers are whole: shares are floors of 10^9 times a ratio, from a long division that no long overflows.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barlake.llm.common import slices
from barlake.session import staged

LEAST_DOCS = 10
TOP = 10
HELD = 1 << 18  # (source, term) cells that a task adds up before it sends them on
PACKS = 64  # buckets of terms that a task packs its cells into
SLICE = 64  # tasks that are combined before the rows of a term meet
BLOCK = 1 << 16  # (term, source) cells of a block of terms
SPREAD = 1 << 20  # pairs of sources that a block visits at once

# ASCII letters and all bytes beyond ASCII belong to terms; A-Z become a-z and all else a blank.
_TERMS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
PART = 1 << 20  # bytes of one text that are cut into terms at once


def term_counts(text: str) -> dict[bytes, int]:
    """Occurrences of each term of a whole text; long texts are read in parts."""
    raw, at, out = text.encode("utf-8", "surrogatepass").translate(_TERMS), 0, Counter()
    while at < len(raw):
        cut = raw.find(b" ", at + PART)
        cut = len(raw) if cut < 0 else cut
        out.update(raw[at:cut].split())
        at = cut
    return out


def collapsed(docs: DataFrame) -> DataFrame:
    """(lang, text, copies): each distinct text of a language once, with copies: array of (source, n).

    Nulls are empty strings.  Copies are counted by digest, without texts; texts move once, and a text that fills a
    third of the rows sends one row a task.
    """
    rows = docs.select(*[F.coalesce(c, F.lit("")).alias(c) for c in ("lang", "source", "text")]).withColumn("digest", F.unhex(F.sha2("text", 256)))
    copies = rows.groupBy("lang", "digest", "source").agg(F.count("*").alias("n")).groupBy("lang", "digest").agg(F.collect_list(F.struct("source", "n")).alias("copies"))
    return rows.groupBy("lang", "digest").agg(F.first("text").alias("text")).join(copies, ["lang", "digest"])


def _packed(names: list[tuple[str, str]], cells: list[dict[bytes, list[int]]], slice_: int) -> pa.RecordBatch:
    """The counts of a task, packed and compressed by bucket of the term."""
    terms = [t for c in cells for t in c]
    name = np.repeat(np.arange(len(cells), dtype=np.uint32), [len(c) for c in cells])
    numbers = np.array([v for c in cells for v in c.values()], np.int64)
    bucket = np.fromiter(map(zlib.crc32, terms), np.uint32, len(terms)) % PACKS
    order = np.argsort(bucket, kind="stable")
    found, first = np.unique(bucket[order], return_index=True)
    squeeze = lambda raw: pa.compress(raw, codec="zstd", asbytes=True)
    rows = []
    for b, own in zip(found.tolist(), np.split(order, first[1:]), strict=True):
        words = b" ".join([terms[i] for i in own.tolist()])
        rows.append((b, len(own), len(words), squeeze(words), squeeze(name[own].tobytes()), squeeze(numbers[own].T.tobytes())))
    columns = zip(("bucket", "cells", "bytes", "terms", "name", "numbers"), zip(*rows, strict=True), strict=True)
    packed = {c: pa.array(v, pa.binary() if isinstance(v[0], bytes) else pa.int64()) for c, v in columns}
    listed = pa.array([[{"lang": lang, "source": source} for lang, source in names]] * len(rows), pa.list_(pa.struct([("lang", pa.string()), ("source", pa.string())])))
    return pa.RecordBatch.from_pydict({"bucket": packed.pop("bucket"), "slice": pa.array([slice_] * len(rows), pa.int64()), "names": listed, **packed})


PACKED = "bucket long, slice long, names array<struct<lang:string,source:string>>, cells long, bytes long, terms binary, name binary, numbers binary"
COUNTS = "lang string, source string, term string, n long, docs long"


def _added(packs: pa.Table) -> pa.Table:
    """The packed counts of a bucket and slice as rows, one for each (language, source, term)."""
    known: dict[tuple[str, str], int] = {}
    parts = []
    for row in packs.to_pylist():
        widen = lambda raw, size: pa.decompress(raw, decompressed_size=size, codec="zstd", asbytes=True)
        number = np.array([known.setdefault((n["lang"], n["source"]), len(known)) for n in row["names"]], np.int64)
        n, docs = np.frombuffer(widen(row["numbers"], 16 * row["cells"]), np.int64).reshape(2, -1)
        terms = widen(row["terms"], row["bytes"]).split(b" ")
        parts.append(pa.table({"name": number[np.frombuffer(widen(row["name"], 4 * row["cells"]), np.uint32)], "term": pa.array(terms, pa.binary()), "n": n, "docs": docs}))
    total = pa.concat_tables(parts).group_by(["name", "term"], use_threads=False).aggregate([("n", "sum"), ("docs", "sum")])
    names = [pa.array([k[i] for k in known], pa.string()).take(total.column("name").combine_chunks()) for i in (0, 1)]
    return pa.table({"lang": names[0], "source": names[1], "term": total.column("term").cast(pa.string()), "n": total.column("n_sum"), "docs": total.column("docs_sum")})


def counts(texts: DataFrame) -> DataFrame:
    """(lang, source, term, n, docs): occurrences and documents of each term, copies included.

    A task adds up what it reads and packs it by bucket of the term.  Tasks are combined SLICE at a time, so a frequent
    term has one row a slice and source when the rows of a term meet, and a bucket of a slice is bounded by its tasks.
    """

    def run(source: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        slice_ = TaskContext.get().partitionId() // SLICE
        names: dict[tuple[str, str], int] = {}
        cells: list[dict[bytes, list[int]]] = []
        for batch in source:
            for start, end in slices(batch.column("text")):
                part = batch.slice(start, end - start)
                for lang, text, copies in zip(*(part.column(c).to_pylist() for c in ("lang", "text", "copies")), strict=True):
                    found = term_counts(text)
                    for c in copies:
                        at, weight = names.setdefault((lang, c["source"]), len(names)), c["n"]
                        if at == len(cells):
                            cells.append({})
                        own = cells[at]
                        for term, n in found.items():
                            cell = own.get(term)
                            if cell is None:
                                own[term] = [n * weight, weight]
                            else:
                                cell[0] += n * weight
                                cell[1] += weight
                        if sum(map(len, cells)) >= HELD:
                            yield _packed([*names], cells, slice_)
                            names, cells = {}, []
        if any(cells):
            yield _packed([*names], cells, slice_)

    rows = texts.select("lang", "text", "copies").mapInArrow(run, PACKED).groupBy("bucket", "slice").applyInArrow(_added, COUNTS)
    # one exchange on (lang, term) serves this sum and the windows of the audit
    return rows.repartition("lang", "term").groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def share(count: Column, total: Column, kept: Column) -> Column:
    """1 + floor(10^9 * (count + 2) / (total + 2 * kept)) by long division, three digits at a time: exact to 9 * 10^15 tokens."""
    of, left, out = total + 2 * kept, count + 2, F.lit(0).cast("long")
    for _ in range(3):
        out, left = out * 1000 + F.call_function("div", left * 1000, of), (left * 1000) % of
    return out + 1


def distance(p: Column, q: Column) -> Column:
    """floor((p - q)^2 / (p + q)); both are at most 10^9 + 1, so the square fits a long."""
    return F.call_function("div", (p - q) * (p - q), p + q)


def _both(cells: pa.Table) -> pa.Table:
    """What the terms of a block that two sources share add to each pair, over what absence of one of them counts for."""
    cells = cells.sort_by([("lang", "ascending"), ("term", "ascending"), ("source", "ascending")]).combine_chunks()
    code = [cells.column(c).combine_chunks().dictionary_encode() if cells.num_rows else None for c in ("lang", "term", "source")]
    if not cells.num_rows:
        return pa.table({"lang": pa.array([], pa.string()), "a": pa.array([], pa.string()), "b": pa.array([], pa.string()), "value": pa.array([], pa.int64())})
    lang, term, source = (c.indices.to_numpy().astype(np.int64) for c in code)
    p, none = (cells.column(c).to_numpy() for c in ("p", "none"))
    start = np.flatnonzero(np.concatenate(([True], (lang[1:] != lang[:-1]) | (term[1:] != term[:-1]))))
    until = np.repeat(np.append(start[1:], len(p)), np.diff(np.append(start, len(p))))
    size = until - np.arange(len(p)) - 1  # later sources of the same term
    f = lambda x, y: (x - y) ** 2 // (x + y)
    sums: dict[int, int] = {}
    n_source, at, ends = len(code[2].dictionary), 0, np.cumsum(size)
    while at < len(p):
        base = ends[at - 1] if at else 0
        end = max(at + 1, int(np.searchsorted(ends, base + SPREAD, "right")))
        own = np.repeat(np.arange(at, end), size[at:end])
        other = own + 1 + np.arange(len(own)) - np.repeat(ends[at:end] - size[at:end] - base, size[at:end])
        value = f(p[own], p[other]) - f(p[own], none[other]) - f(none[own], p[other]) + f(none[own], none[other])
        key = (lang[own] * n_source + source[own]) * n_source + source[other]
        order = np.argsort(key, kind="stable")
        name, first = np.unique(key[order], return_index=True)
        for k, v in zip(name.tolist(), np.add.reduceat(value[order], first).tolist() if len(first) else (), strict=True):
            sums[k] = sums.get(k, 0) + v
        at = end
    keys = np.array(list(sums), np.int64)
    take = lambda c, i: c.dictionary.take(pa.array(i))
    return pa.table({"lang": take(code[0], keys // n_source**2), "a": take(code[2], keys // n_source % n_source), "b": take(code[2], keys % n_source), "value": pa.array(list(sums.values()), pa.int64())})


def audit(docs: DataFrame, least_docs: int = LEAST_DOCS, top: int = TOP) -> DataFrame:
    """(lang, source, part, item, value, rank) for every (lang, source) of ``docs``; nulls in lang, source and text are ''.

    A language keeps the terms of at least ``least_docs`` of its documents.  Part ``pair``: each other source of the
    language with the summed distance over all kept terms (0 without any), every rank.  Part ``term``: the kept terms
    that the source has and that are more frequent there than in the language, with their distance, ranks to ``top``.
    Ranks go by value, then item.  Repeated rows are documents each; other columns are ignored; an empty table, or a
    source alone in a language without kept terms, gives no rows.
    """
    groups = docs.select(*[F.coalesce(c, F.lit("")).alias(c) for c in ("lang", "source")]).distinct()
    term = Window.partitionBy("lang", "term")
    counted = counts(collapsed(docs)).select("*", F.sum("n").over(term).alias("lang_n"), F.sum("docs").over(term).alias("lang_docs"), F.row_number().over(term.orderBy("source")).alias("place"))
    cells = staged(counted.where(F.col("lang_docs") >= least_docs).select("lang", "source", "term", "n", "lang_n", (F.col("place") == 1).cast("long").alias("lead")))
    totals = cells.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    langs = cells.groupBy("lang").agg(F.sum("n").alias("lang_total"), F.sum("lead").alias("kept"))
    every = groups.join(totals, ["lang", "source"], "left").join(langs, "lang", "left").fillna(0, ["total", "kept", "lang_total"])
    known = staged(every.withColumn("none", F.when(F.col("kept") > 0, share(F.lit(0), F.col("total"), F.col("kept")))))
    present = cells.join(known, ["lang", "source"]).withColumn("p", share(F.col("n"), F.col("total"), F.col("kept")))

    q = share(F.col("lang_n"), F.col("lang_total"), F.col("kept"))
    raised = present.withColumn("q", q).where("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), distance(F.col("p"), F.col("q")).alias("value"))
    by_value = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    terms = raised.withColumn("rank", F.row_number().over(by_value)).where(F.col("rank") <= top)  # limited in the tasks before the shuffle

    other = known.select("lang", F.col("source").alias("b"), F.col("none").alias("none_b"))
    both_absent = distance(F.col("none"), F.col("none_b"))
    alike = present.groupBy("lang", "source", "p", "none").agg(F.count("*").alias("n"))
    one_absent = alike.join(other, "lang").where("source <> b").groupBy("lang", F.col("source").alias("a"), "b").agg(F.sum(F.col("n") * (distance(F.col("p"), F.col("none_b")) - both_absent)).alias("value"))
    block = F.pmod(F.xxhash64("lang", "term"), F.lit(max(1, cells.count() // BLOCK)))
    both_present = present.select(block.alias("block"), "lang", "term", "source", "p", "none").groupBy("block").applyInArrow(_both, "lang string, a string, b string, value long")
    two_ways = F.explode(F.array(F.struct(F.col("a").alias("source"), "b"), F.struct(F.col("b").alias("source"), F.col("a").alias("b")))).alias("pair")
    changes = one_absent.unionByName(both_present).select("lang", two_ways, "value").select("lang", "pair.source", "pair.b", "value")
    base = known.join(other, "lang").where("source <> b").select("lang", "source", "b", F.coalesce(F.col("kept") * both_absent, F.lit(0)).alias("value"))
    sums = base.unionByName(changes).groupBy("lang", "source", "b").agg(F.sum("value").alias("value"))
    pairs = sums.select("lang", "source", F.lit("pair").alias("part"), F.col("b").alias("item"), "value").withColumn("rank", F.row_number().over(by_value))
    return pairs.unionByName(terms)
