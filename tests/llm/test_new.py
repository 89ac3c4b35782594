"""Packing, resampling and the source audit against brute force, on plain and on odd rows."""

import collections
import hashlib
import math
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from barlake.llm import divergence, packing, queries, resampling

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
ODD = [
    (1, None, None, None, "x"), (2, "", "", "en", "y"), (None, "Some words HERE naïve 日本語 ÀB", "s", "en", None), (3, "one two three one two", "s", None, "x"),
    (3, "one two three one two", "s", None, "x"), (4, " ".join(f"w{'abcdefghij'[i % 7]}{i % 9}" for i in range(40000)), "s", "en", "x"), (5, "x" * 3000, "t", "en", "z"), (6, "a<|endoftext|> b" + " " * 70000 + "c", "t", "en", "z"),
    *[(10 + i, "the same words in each of these texts and " + "more " * (i % 3), f"s{i % 3}", "en", "x") for i in range(30)],
]
SCHEMA = "doc_id long, text string, source string, lang string, rank string"


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, SCHEMA).repartition(3).cache()


def lower(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


def ids_of(texts):
    import public_tokenizers
    from tokenizers import Tokenizer

    coder = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    return [[*coder.encode(t or "", add_special_tokens=False).ids, 1] for t in texts]


def check_pieces(pieces, docs):
    """docs: (doc_id, ids) in any order.  Every id lies in one piece, sequences are gapless and hold at most 2,048."""
    parts, sequences = collections.defaultdict(list), collections.defaultdict(list)
    for r in pieces:
        parts[r.doc_id].append(r)
        sequences[r.sequence_id].append((r.offset, r.length))
    assert parts.keys() == {d for d, _ in docs}
    for doc, ids in docs:
        own = sorted(parts[doc], key=lambda r: r.start)
        assert [r.start for r in own] == [0, *np.cumsum([r.length for r in own])[:-1]] and sum(r.length for r in own) == len(ids) == own[0].doc_tokens
        for r in own:
            assert r.ids_crc32 == zlib.crc32(np.array(ids[r.start : r.start + r.length], "<u4").tobytes())
    padding = 0
    for s in sequences.values():
        s.sort()
        total = sum(n for _, n in s)
        assert [o for o, _ in s] == [0, *np.cumsum([n for _, n in s])[:-1]] and 0 < total <= 2048
        padding += 0 if total & (total - 1) == 0 else 2048 - total
    return padding


def test_packing(spark, sf):
    rows = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    assert check_pieces(queries.op11_packing(spark, sf).collect(), list(zip([r.doc_id for r in rows], ids_of([r.text for r in rows]), strict=True))) == 0


def test_packing_of_odd_rows(spark, odd):
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.json")
    once = odd.dropDuplicates(["doc_id"])
    found = packing.pack_texts(once, path, keep=["doc_id"]).withColumn("ids_crc32", F.crc32("piece")).withColumnRenamed("total", "doc_tokens").collect()
    rows = once.collect()
    assert check_pieces(found, list(zip([r.doc_id for r in rows], ids_of([r.text for r in rows]), strict=True))) == 0
    assert packing.pack_texts(odd, path, keep=["doc_id", "rank"]).agg(F.sum("length")).first()[0] == sum(map(len, ids_of([r[1] for r in ODD])))
    assert packing.pack_texts(odd.limit(0), path, keep=["doc_id"]).count() == 0
    with pytest.raises(ValueError):
        packing.pack_texts(odd.withColumn("offset", F.lit(1)), path, keep=["offset"])
    assert packing.encoder(path)("a" + " " * 1_000_000 + "b")[-1] == packing.encoder(path)(" b")[0]


@pytest.mark.parametrize("cut", [False, True])
def test_packing_keeps_every_limit(spark, cut):
    rng = np.random.default_rng(5)
    rows = [(i, rng.integers(0, 99, n).tolist(), (rng.random(n) < 0.4).tolist()) for i, n in enumerate(rng.integers(0, 60, 900).tolist())]
    rows += [(1000, list(range(700)), [True] * 700), (1001, [], []), (1001, [1], None), (None, [5, 6], [False, True])]
    limits = packing.Limits(tokens=128, segments=6, loss=40)
    found = packing.pack(spark.createDataFrame(rows, "id long, ids array<int>, loss array<boolean>").repartition(2), ["id"], limits, cut, loss="loss").collect()
    placed = collections.defaultdict(list)
    for r in found:
        if r.sequence_id is not None:
            placed[r.sequence_id].append(r)
    for s in placed.values():
        s.sort(key=lambda r: r.offset)
        assert [r.offset for r in s] == [0, *np.cumsum([r.length for r in s])[:-1]]
        assert sum(r.length for r in s) <= 128 and len(s) <= 6 and sum(r.loss_tokens for r in s) <= 40
    assert sum(r.length for r in found) == sum(len(x) for _, x, _ in rows) and sum(r.loss_tokens for r in found) == sum(len(x) if l is None else sum(l) for _, x, l in rows)
    alone = {r.id for r in found if r.sequence_id is None}
    assert alone == {k for k, x, l in rows if not x or not cut and (len(x) > 128 or sum(l or [1]) > 40)}
    lower_bound = max(sum(r.length for r in found if r.sequence_id is not None) / 128, sum(r.loss_tokens for r in found if r.sequence_id is not None) / 40, sum(r.sequence_id is not None for r in found) / 6 if not cut else 0)
    assert cut or len(placed) <= 1.1 * lower_bound + 2


def brute_resampling(docs, target):
    def feats(t):
        w = WORD.findall(lower(t))
        return len(w), [zlib.crc32(f.encode()) % 10000 for f in [*w, *(" ".join(p) for p in zip(w, w[1:], strict=False))]]

    s, t = collections.Counter(), collections.Counter()
    for _, text in docs:
        s.update(feats(text)[1])
    for text in target:
        t.update(feats(text)[1])
    whole, wanted = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (whole + 10000) / ((s[b] + 1) * (wanted + 10000)))) for b in range(10000)]
    rows = []
    for d, text in docs:
        n, f = feats(text)
        weight = sum(gain[b] for b in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"7:{'' if d is None else d}".encode()).hexdigest()[:8], 16)
        rows.append([d, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), n])
    able = sorted((r for r in rows if r[4] >= 20), key=lambda r: (-r[3], r[0] is not None, r[0]))
    rank = {id(r): i + 1 for i, r in enumerate(able[: 25 * len(able) // 100])}
    return sorted(([*r[:4], rank.get(id(r))] for r in rows), key=repr)


def test_resampling(spark, sf):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    target = [r.text for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    found = queries.op12_resampling(spark, sf)
    assert found.dtypes == [("doc_id", "bigint"), ("n_features", "bigint"), ("weight", "bigint"), ("score", "bigint"), ("rank", "bigint")]
    assert sorted(map(list, found.collect()), key=repr) == brute_resampling(docs, target)


def test_resampling_of_odd_rows(spark, odd, monkeypatch):
    monkeypatch.setattr(resampling, "PART", 4096)  # long texts in many parts
    target = odd.where("doc_id is null or doc_id = 12")
    found = resampling.resample(odd, target).select("doc_id", "n_features", "weight", "score", "rank").collect()
    assert sorted(map(list, found), key=repr) == brute_resampling([r[:2] for r in ODD], [r[1] for r in ODD if r[0] in (None, 12)])
    assert resampling.resample(odd.limit(0), target).count() == 0
    flat = resampling.resample(odd, target.limit(0)).collect()
    assert len(flat) == len(ODD)


def test_plane_sums_are_exact():
    rng = np.random.default_rng(3)
    counts, gain = rng.integers(0, 5000, (9, 10000)) * (rng.random((9, 10000)) < 0.1), rng.integers(-9000, 15000, 10000)
    assert (resampling.plane_sums(counts, *resampling.gain_planes(gain)) == counts @ gain).all()
    assert (resampling.plane_sums(counts, *resampling.gain_planes(-np.ones(10000, np.int64))) == -counts.sum(axis=1)).all()


def brute_audit(docs):
    groups, texts = {(l or "", s or "") for s, l, _ in docs}, [(l or "", s or "", TERM.findall(lower(t))) for s, l, t in docs]
    out = []
    for lang in {g[0] for g in groups}:
        seen, count, every = collections.Counter(), collections.defaultdict(collections.Counter), collections.Counter()
        for _, s, w in (x for x in texts if x[0] == lang):
            seen.update(set(w))
            count[s].update(w)
            every.update(w)
        kept = [t for t in seen if seen[t] >= 10]
        share = lambda c: {t: 1 + 10**9 * (c[t] + 2) // (sum(c[k] for k in kept) + 2 * len(kept)) for t in kept}  # noqa: B023, E731
        q, sources = share(every), sorted(s for l, s in groups if l == lang)
        p = {s: share(count[s]) for s in sources}
        f = lambda a, b: (a - b) ** 2 // (a + b)
        for s in sources:
            pair = sorted(((-sum(f(p[s][t], p[o][t]) for t in kept), o.encode(), o) for o in sources if o != s))
            term = sorted((-f(p[s][t], q[t]), t.encode(), t) for t in kept if count[s][t] and p[s][t] > q[t])[:10]
            out += [(lang, s, part, x, -v, i + 1) for part, rows in (("pair", pair), ("term", term)) for i, (v, _, x) in enumerate(rows)]
    return sorted(out)


def test_audit(spark, sf, odd, monkeypatch):
    docs = [(r.source, r.lang, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    found = queries.op13_divergence(spark, sf)
    assert dict(found.dtypes) == {"lang": "string", "source": "string", "part": "string", "item": "string", "value": "bigint", "rank": "int"}
    assert sorted(map(tuple, found.collect())) == brute_audit(docs)
    monkeypatch.setattr(divergence, "BLOCK", 8)
    monkeypatch.setattr(divergence, "SPREAD", 4)
    monkeypatch.setattr(divergence, "PART", 4096)
    assert sorted(map(tuple, divergence.audit(odd).collect())) == brute_audit([(r[2], r[3], r[1]) for r in ODD])
    assert divergence.audit(odd.limit(0)).count() == 0
