"""Every operator on nulls, empty and long texts, repeated rows, empty tables and extra columns."""

import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from barlake.llm import bpe, chat, decontaminate, lines, ngram, personal, quality, simhash, substrings, warc
from barlake.llm.queries import vocabulary

SCHEMA = "doc_id long, text string, name string, value string"
LONG = " ".join(f"w{i % 700}" for i in range(30000))
ROWS = [
    (1, None, "a", "x"), (2, "", "b", None), (None, "a text without an id", None, "x"), (3, "one two three", "c", "x"), (3, "one two three", "c", "x"), (4, LONG, "d", "x"),
    (5, "\n\n \t\n", "e", "x"), (6, "x" * 3000, "f", "x"), (7, "Mail a.b@c.example.org or +1 (499) 555-6503\nthen 10.0.0.255", "g", "x"),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ROWS, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def test_bpe(odd, none):
    import tiktoken

    ranks, pattern = vocabulary()
    plain = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    rows = bpe.encoded_table(odd.where("doc_id is null or doc_id <> 6"), ranks, pattern).collect()
    assert len(rows) == len(ROWS) - 1
    for r in rows:
        assert r.ids == plain.encode_ordinary(r.text or "") and r.decoded.decode() == (r.text or "") and r.n_tokens == len(r.ids)
    assert bpe.encode(none, ranks, pattern).collect() == []
    with pytest.raises(ValueError):
        bpe.encode(odd, ranks, pattern, ids="name")


def test_quality(odd, none):
    labels = odd.select("doc_id", F.when(F.col("doc_id") % 2 == 0, 1).otherwise(0).alias("quality"), F.lit(None).cast("int").alias("toxic"))
    model = quality.train(odd, labels)
    rows = quality.score(odd, model).collect()
    assert len(rows) == len(ROWS) and {r.n_words for r in rows if r.doc_id in (1, 2, 5)} == {0} and all(r.base_failed for r in rows)
    assert quality.score(none, quality.train(none, labels)).count() == 0
    assert quality.score(odd, quality.train(odd, labels.limit(0))).count() == len(ROWS)


def test_simhash(odd, none):
    rows = simhash.link_fingerprints(simhash.fingerprints(odd).select("doc_id", "fingerprint", "name")).collect()
    assert len(rows) == len(ROWS)
    found = {r.doc_id: r for r in rows}
    assert [found[i].fingerprint for i in (1, 2, 5)] == [0, 0, 0] and {found[i].component_id for i in (1, 2, 5)} == {1} and found[None].component_id is None
    assert simhash.link_fingerprints(simhash.fingerprints(none).select("doc_id", "fingerprint")).count() == 0


def test_lines(odd, none):
    rows = lines.dedup_lines(odd).collect()
    assert len(rows) == len(ROWS)
    for r in rows:
        assert r.n_removed == 0 and (r.doc_id != 1 or r.text is None)
    assert lines.dedup_lines(none).count() == 0


def test_decontaminate(odd, none, spark):
    items = spark.createDataFrame([(1, None), (2, "short"), (None, LONG), (9, " ".join(f"w{i}" for i in range(100, 130))), (8, " ".join(f"w{i}" for i in range(100, 130)))], "item_id long, text string")
    rows = decontaminate.contamination(odd, items).collect()
    assert [(r.doc_id, r.item_id, r.differences) for r in rows] == [(4, 8, 0)]
    assert decontaminate.contamination(none, items).count() == 0 and decontaminate.contamination(odd, items.limit(0)).count() == 0


def test_ngram(odd, none):
    rows = ngram.score(odd).collect()
    assert len(rows) == len(ROWS) and all(r.score <= 0 for r in rows) and {r.n_tokens for r in rows if r.doc_id in (1, 2, 5)} == {1}
    assert ngram.score(none).count() == 0


def test_substrings(odd, none, spark):
    more = odd.unionByName(spark.createDataFrame([(8, "before " + " ".join(f"w{i}" for i in range(60)) + " after", "h", "x")], SCHEMA))
    rows = {r.doc_id: r for r in substrings.remove_repeats(more).collect()}
    assert rows[8].kept == "before after" and rows[8].n_removed == 60 and rows[4].n_removed == 0 and rows[1].n_words == 0
    assert substrings.remove_repeats(none).count() == 0


def test_personal(odd, none):
    found = personal.find_personal_data(odd, keep=["doc_id", "text", "name"])
    rows = found.select("*", personal.listed(F.col("spans")).alias("all"), personal.redact(F.coalesce("text", F.lit("")), F.col("spans")).alias("clean")).collect()
    mine = next(r for r in rows if r.doc_id == 7)
    assert len(rows) == len(ROWS) and mine["all"] == "email:5:22,phone:26:43,ip:49:59" and mine.clean == "Mail [email] or [phone]\nthen [ip]"
    assert personal.find_personal_data(none).count() == 0


def test_warc(spark, odd, none, tmp_path):
    pages = odd.where("doc_id is not null").dropDuplicates(["doc_id"]).select(F.col("doc_id").alias("page_id"), F.when(F.col("doc_id") == 7, "http://a/\r\nb").alias("url"), "name", F.when(F.col("doc_id") == 3, "a WARC/1.0\r\nContent-Length: 2\r\n\r\nxx\r\n\r\nWARC/1.0\r\n").otherwise(F.col("text")).alias("html"))
    warc.write_warc(pages, str(tmp_path / "w"), records_per_file=3)
    rows = {r.record_id: r for r in warc.read_warc(spark, str(tmp_path / "w")).collect()}
    assert len(rows) == 7
    for p in pages.collect():
        r = rows[f"<urn:page:{p.page_id}>"]
        if r.record_type == "response":
            assert bytes(r.payload) == (p.html or "").encode() and r.digest == "sha1:" + r.payload_digest
    assert rows["<urn:page:1>"].record_type == "revisit" and rows["<urn:page:1>"].refers_to == "<urn:page:2>"
    warc.write_warc(none.select(F.col("doc_id").alias("page_id"), F.col("name").alias("url"), F.col("text").alias("html")), str(tmp_path / "e"))
    assert warc.read_warc(spark, str(tmp_path / "e")).count() == 0


def test_chat(spark):
    part = lambda kind, text=None, ref=None, n=None: (kind, text, ref, n)
    rows = spark.createDataFrame([
        (1, 0, "user", [part("text", "see <turn> & "), part("image", None, "a.png"), None, part("audio", None, "b.wav", 7)], "x"), (1, 1, "assistant", [part(None, "fine &lt;"), part("document", None, "c.pdf")], "x"),
        (1, None, None, None, "x"), (2, 0, "a\nb", [], "x"), (2, 0, "a\nb", [], "x"), (None, 0, "user", [part("text", None)], "x"),
    ], "conv_id long, turn long, role string, parts array<struct<type:string,text:string,ref:string,tokens:long>>, formatted string")
    done = {r.conv_id: r for r in chat.format_chat(rows).withColumn("turns", chat.read_chat(F.col("formatted"))).withColumn("learned", chat.learned_text(F.col("formatted"), F.col("loss_spans"))).collect()}
    one = done[1]
    assert [tuple(t) for t in one.turns] == [("", ""), ("user", "see <turn> & <image 1><audio 2>"), ("assistant", "fine &lt;<document 1>")]
    assert [tuple(a) for a in one.attachments] == [(1, 1, "image", "a.png", 256), (1, 2, "audio", "b.wav", 7), (2, 1, "document", "c.pdf", 512)]
    assert one.learned == "fine &lt;<document 1>" and one.n_tokens == 3 + 256 + 7 + 2 + 512
    assert [t.role for t in done[2].turns] == ["a\nb", "a\nb"] and len(done[None].turns) == 1
    assert chat.format_chat(rows.limit(0)).count() == 0


def test_structured_words_have_their_own_hashes(spark):
    """The Thue-Morse word and its complement collide in any polynomial hash modulo a power of two."""
    from barlake.llm import tokens

    one = "".join("ab"[i.bit_count() % 2] for i in range(1024))
    two = one.translate(str.maketrans("ab", "ba"))
    words = ["", "a", "a\0", "aa", "abc", "abcd", "abc\0", one[:48], two[:48], one[:49], two[:49], one, two, "\U0010ffff" * 4, "\U0010ffff" * 5]
    assert len({*tokens.split([f"{w} " for w in words]).hashes().tolist()}) == len(words) - 1
    rest = " ".join(f"w{i}" for i in range(49))
    rows = spark.createDataFrame([(1, f"{one} {rest}"), (2, f"{two} {rest}")], "doc_id long, text string")
    assert [r.n_removed for r in substrings.remove_repeats(rows).collect()] == [0, 0]


def test_long_runs_cost_their_length_and_matches_may_touch(spark):
    """A megabyte of letters or digits beside an address; a match may start where the last one ended."""
    long = "x" * 1_000_000
    rows = [(1, f"{long} a@b.cc"), (2, f"{'7' * 1_000_000} 1.2.3.4"), (3, "a@b.c_d@e.f 1.2.3.4.5.6.7.8"), (4, f"{long}@b.cc")]
    start = time.time()
    got = {r.doc_id: [(s["kind"], s["start"], s["end"]) for s in r.base] for r in spark.createDataFrame(rows, "doc_id int, text string").select("doc_id", personal.base_spans(F.col("text")).alias("base")).collect()}
    assert got == {1: [(0, 1_000_001, 1_000_007)], 2: [(1, 1_000_001, 1_000_008)], 3: [(0, 0, 5), (0, 5, 11), (1, 12, 19), (1, 20, 27)], 4: [(0, 0, 1_000_005)]}
    assert time.time() - start < 60


def test_fingerprints_in_a_tight_ball(spark):
    rng = np.random.default_rng(1)
    points = np.unique(np.bitwise_xor.reduce(np.left_shift(np.uint64(1), rng.integers(0, 64, (1500, 4)).astype(np.uint64)), axis=1))
    near = {(i, j) for i in range(len(points)) for j in np.flatnonzero(np.bitwise_count(points ^ points[i]) <= 2) if i < j}
    root = list(range(len(points)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in near:
        root[find(i)] = find(j)
    want = len({find(i) for i in root})
    found = simhash.links(points, 2)
    assert {tuple(sorted(map(int, p))) for p in found} <= near and len(found) == len(points) - want


def test_component_column_is_refused(spark):
    with pytest.raises(ValueError):
        simhash.link_fingerprints(spark.createDataFrame([(1, 2, 3)], "doc_id long, fingerprint long, component_id long"))


def test_repeated_ids_count_once_in_the_fit(spark):
    words = lambda k: " ".join(f"{k}{i}" for i in range(60))
    docs = [(i, words("good" if i % 2 else "bad")) for i in range(40)]
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(40)], "doc_id long, quality int, toxic int")
    once = quality.train(spark.createDataFrame(docs, "doc_id long, text string"), labels)
    more = quality.train(spark.createDataFrame(docs + [(3, "zz " + words("good"))] * 50, "doc_id long, text string"), labels)
    assert np.array_equal(once.weights, more.weights) and once.bias == more.bias
