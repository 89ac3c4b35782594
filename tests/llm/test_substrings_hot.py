"""An anchor whose passages differ in most documents."""

import random

from pyspark.sql.group import GroupedData

from barlake.llm import substrings


def test_large_anchor(spark, monkeypatch):
    rng = random.Random(3)
    shared = [f"s{i}" for i in range(60)]
    docs = {k: [f"w{rng.randrange(9000)}" for _ in range(60)] + shared + [f"w{rng.randrange(9000)}" for _ in range(60)] for k in range(40)}
    docs[40] = docs[3][20:110] + ["end"]
    docs[41] = [f"u{i}" for i in range(70)]
    docs[42] = ["start", *docs[41]]
    real, most = GroupedData.applyInArrow, []

    def seen(self, *a):
        if "parts" in self._df.columns:  # passages on their way to the automata
            most.append(max((r["count"] for r in self._df.groupBy("shard", "anchor").count().collect()), default=0))
        return real(self, *a)

    monkeypatch.setattr(substrings, "PASSAGES", 3)
    monkeypatch.setattr(GroupedData, "applyInArrow", seen)
    rows = spark.createDataFrame([(k, " ".join(w)) for k, w in docs.items()], "doc_id long, text string").repartition(3)
    first = {}
    for k in sorted(docs):
        for i in range(len(docs[k]) - 49):
            first.setdefault(tuple(docs[k][i : i + 50]), k)
    for r in substrings.remove_repeats(rows).collect():
        w = docs[r.doc_id]
        hit = {j for i in range(len(w) - 49) if first[tuple(w[i : i + 50])] < r.doc_id for j in range(i, i + 50)}
        assert r.kept == " ".join(x for i, x in enumerate(w) if i not in hit) and r.n_removed == len(hit)
        assert r.n_removed >= 60 or r.doc_id in (0, 41)
    assert max(most) <= 12  # 40 passages of one anchor, dealt by hash to 14 shards


def test_rows_that_repeat_an_id(spark):
    passage = " ".join(f"p{i}" for i in range(60))
    rows = [(1, passage), (5, f"a b c d e {passage}"), (5, " ".join(f"q{i}" for i in range(100)))]
    found = substrings.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.n_words, r.n_removed) for r in found) == [(1, 60, 0), (5, 65, 60), (5, 100, 0)]
