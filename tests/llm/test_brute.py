"""Registered queries against brute force or SQL on the smallest tables."""

import collections
import hashlib
import math
import re
import zlib

import duckdb
import numpy as np
import pytest
import regex
import xxhash

from barlake.llm import decontaminate, ngram, queries

WORD = r"[^\x20\x09-\x0D]+"


@pytest.fixture(scope="module")
def docs(spark, sf):
    return {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}


def run(spark, sf, name):
    return queries.QUERIES[name](spark, sf).collect()


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_sql(spark, sf, name):
    con = duckdb.connect()
    for t in ("pages", "conversations", "documents"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    cursor = con.execute(queries.SQL[name])
    names = [d[0] for d in cursor.description]
    want = sorted(repr(tuple(dict(zip(names, row, strict=True))[c] for c in sorted(names))) for row in cursor.fetchall())
    assert sorted(repr(tuple(r[c] for c in sorted(names))) for r in run(spark, sf, name)) == want and want


def test_masks_catch_every_window():
    assert decontaminate.covers(decontaminate.MASKS, decontaminate.WINDOW, decontaminate.SUBSTITUTIONS)
    assert not decontaminate.covers(("1111111111111",), 13, 1)


def test_decontaminate(spark, sf, docs):
    tokens = lambda t: regex.findall(r"[\p{L}\p{N}]+", t.lower())
    items = {r.item_id: tokens(r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()}
    texts = {k: tokens(t) for k, t in docs.items()}
    number = {w: i for i, w in enumerate({w for t in [*texts.values(), *items.values()] for w in t})}
    cut = lambda t: np.lib.stride_tricks.sliding_window_view(np.array([number[w] for w in t]), 13) if len(t) >= 13 else np.zeros((0, 13), int)
    known = [(k, cut(t)) for k, t in items.items()]
    owner, windows = np.concatenate([[k] * len(w) for k, w in known]), np.concatenate([w for _, w in known])
    want = {(d, int(k)) for d, t in texts.items() for row in cut(t) for k in owner[(windows != row).sum(axis=1) <= 2]}
    assert {(r.doc_id, r.item_id) for r in run(spark, sf, "op1_decontaminate")} == want and want


def test_ngram(spark, sf, docs, monkeypatch):
    box, real = [], ngram.learn
    monkeypatch.setattr(ngram, "learn", lambda *a: box.append(real(*a)) or box[-1])
    rows, (model,) = run(spark, sf, "op2_ngram"), box
    split = {k: re.findall(WORD, re.sub("[A-Z]", lambda m: m[0].lower(), t)) + [""] for k, t in docs.items()}
    fold = {k: zlib.crc32(str(k).encode()) % 7 for k in docs}
    one, two = collections.Counter(), collections.Counter()
    for k, w in split.items():
        if fold[k] != 2:
            one.update(w)
            two.update(zip(["", *w], w, strict=False))
    n, v = sum(one.values()), len(one)
    gain = 0
    for r in rows:
        w, total = split[r.doc_id], 0.0
        for before, word in zip(["", *w], w, strict=False):
            a, b, c = model.weights[min(one[before].bit_length(), len(model.weights) - 1)]
            total += math.log10(a * two[before, word] / max(1, one[before]) + b * one[word] / n + c / (v + 1))
        base = sum(math.log10((one[x] + 1) / (n + v + 1)) for x in w)
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (fold[r.doc_id] == 2, len(w), sum(one[x] > 0 for x in w), n)
        assert math.isclose(r.base_score, base, rel_tol=1e-9) and math.isclose(r.score, total, rel_tol=1e-9)
        gain += (r.score - r.base_score) * r.held_out
    assert len(rows) == len(docs) and gain > 0 and np.allclose(model.weights.sum(axis=1), 1)


def test_quality(spark, sf, docs):
    rows = {r.doc_id: r for r in run(spark, sf, "op3_quality")}
    for k, t in docs.items():
        w = re.findall(WORD, t)
        runs = collections.Counter(zip(w, w[1:], w[2:], strict=False))
        repeated = {i + j for i in range(len(w) - 2) if runs[tuple(w[i : i + 3])] > 1 for j in range(3)}
        filled = [x for x in t.split("\n") if re.search(WORD, x)]
        r, failed = rows[k], len(w) < 50 or 100 * len(repeated) > 50 * len(w)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(filled) - len(set(filled)), len(repeated), failed)
        assert not (failed and r.kept)
    labels = [r for r in spark.read.parquet(f"{sf}/labels.parquet").collect() if not rows[r.doc_id].base_failed and not r.toxic]
    right = sum(rows[r.doc_id].kept == (r.quality == 1) for r in labels)
    assert right >= 0.9 * len(labels)


def near(a, b):
    head = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
    return a[head + (len(a) >= len(b)) :] == b[head + (len(b) >= len(a)) :] and abs(len(a) - len(b)) < 2


def test_lines(spark, sf, docs):
    places = [((k, i), tuple(re.findall(WORD, x))) for k, t in sorted(docs.items()) for i, x in enumerate(t.split("\n")) if re.search(WORD, x)]
    first = {}
    for at, w in places:
        first.setdefault(w, at)
    long = [w for w in first if len(w) >= 8]
    keep = {w: min([first[w], *(first[x] for x in long if len(w) >= 8 and abs(len(x) - len(w)) < 2 and (x[0] == w[0] or x[-1] == w[-1]) and near(w, x))]) for w in first}
    gone = {at for at, w in places if at > keep[w]}
    rows = run(spark, sf, "op4_lines")
    assert len(rows) == len(docs) and gone
    for r in rows:
        kept = "\n".join(x for i, x in enumerate(docs[r.doc_id].split("\n")) if (r.doc_id, i) not in gone)
        assert r.n_removed == sum(k == r.doc_id for k, _ in gone) and r.kept_sha256 == hashlib.sha256(kept.encode()).hexdigest()


@pytest.mark.parametrize("leaf", [8, 4096])
def test_simhash(spark, sf, docs, leaf, monkeypatch):
    from barlake.llm import simhash

    real = simhash.link_fingerprints
    monkeypatch.setattr(simhash, "link_fingerprints", lambda p: real(p, leaf=leaf))
    prints = {}
    for k, t in docs.items():
        w = re.findall(WORD, re.sub("[A-Z]", lambda m: m[0].lower(), t))
        shingles = [" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))] if w else []
        h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
        prints[k] = sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))
    top = {k: k for k in docs}
    for _ in docs:
        moved = {k: min(top[j] for j in docs if (prints[j] ^ prints[k]).bit_count() <= 2) for k in docs}
        if moved == top:
            break
        top = moved
    assert {(r.doc_id, r.fingerprint, r.component_id) for r in run(spark, sf, "op5_simhash")} == {(k, f"{prints[k]:016x}", top[k]) for k in docs}


def test_substrings(spark, sf, docs):
    split, first = {k: re.findall(WORD, t) for k, t in docs.items()}, {}
    for k in sorted(split):
        for i in range(len(split[k]) - 49):
            first.setdefault(tuple(split[k][i : i + 50]), k)
    gone = 0
    for r in run(spark, sf, "op8_substrings"):
        w = split[r.doc_id]
        hit = {j for i in range(len(w) - 49) if first[tuple(w[i : i + 50])] < r.doc_id for j in range(i, i + 50)}
        gone += len(hit)
        assert (r.n_words, r.n_removed, r.kept_sha256) == (len(w), len(hit), hashlib.sha256(" ".join(x for i, x in enumerate(w) if i not in hit).encode()).hexdigest())
    assert gone


def luhn(digits):
    return sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(digits[::-1])) % 10 == 0


def test_personal(spark, sf, docs):
    kinds = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}

    def good(kind, m):
        digits = re.sub("[^0-9]", "", m)
        return {"email": True, "ip": kind != "ip" or all(int(x) <= 255 for x in m.split(".")), "card": 12 <= len(digits) <= 19 and luhn(digits), "phone": 9 <= len(digits) <= 15}[kind]

    rows = run(spark, sf, "op9_personal")
    for r in rows:
        found = sorted((m.start(), i, m.end(), k) for i, (k, p) in enumerate(kinds.items()) for m in re.finditer(p, docs[r.doc_id]) if good(k, m[0]))
        text = ",".join(f"{k}:{a}:{b}" for a, _, b, k in found)
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(x[3] == k for x in found) for k in kinds]
        assert r.base_sha256 == hashlib.sha256(text.encode()).hexdigest() and set(text.split(",")) <= set(r.spans.split(","))
    assert len(rows) == len(docs)


def test_bpe(spark, sf, docs):
    import tiktoken

    ranks, pattern = queries.vocabulary()
    plain = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    for r in run(spark, sf, "op7_bpe"):
        ids = plain.encode_ordinary(docs[r.doc_id])
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(docs[r.doc_id].encode()).hexdigest())


def test_pipeline(spark, sf, docs, tmp_path):
    import corpus_pipeline

    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "lines", "near", "leaks", "tokens"]
    rows = spark.read.parquet(f"{sf}/documents.parquet")
    names, counts = rows.columns, [rows.count()]
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, rows, sf).write.parquet(str(tmp_path / name))
        rows = spark.read.parquet(str(tmp_path / name))
        counts.append(rows.count())
        assert rows.columns == names or name == "tokens"
    assert counts == sorted(counts, reverse=True) and 0 < counts[-1] < counts[0] and rows.where("NOT exact").count() == 0
    leaked = {r.doc_id for r in run(spark, sf, "op1_decontaminate")}
    assert rows.count() == rows.select("doc_id").distinct().count() and rows.where("n_tokens = 0").count() == 0 and leaked
