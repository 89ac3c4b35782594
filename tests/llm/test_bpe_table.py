"""The merge table of the tokeniser: what plans hold, and folds over odd vocabularies."""

import random

import pyarrow as pa

from barlake.llm import bpe
from barlake.llm.queries import vocabulary


def test_plans_do_not_hold_the_vocabulary(spark):
    ranks, pattern = vocabulary()
    plans = bpe.encode(spark.createDataFrame([(1, "a text")], "doc_id long, text string"), ranks, pattern)._jdf.queryExecution()
    assert len(plans.toString()) < 100_000


def plain(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Merges one at a time, the lowest rank first and the leftmost of equals."""
    parts = [bytes([b]) for b in word]
    while found := [(ranks[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)) if a + b in ranks]:
        i = min(found)[1]
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
    return [ranks.get(p, bpe.NONE) for p in parts]


def test_odd_vocabularies(spark):
    """Ranks with gaps and in no order of learning, bytes that have none, equal pairs that overlap."""
    draw = random.Random(5)
    for letters in ("ab", "abcd", "aé"):
        pieces = {"".join(draw.choices(letters, k=draw.randint(1, 5))).encode() for _ in range(40)} - {b"b"}
        ranks = dict(zip(sorted(pieces, key=lambda p: draw.random()), draw.sample(range(5000), len(pieces)), strict=True))
        texts = ["".join(draw.choices(letters, k=draw.randint(1, 14))) for _ in range(200)] + [letters[0] * n for n in range(1, 30)] + ["", "z"]
        rows = bpe.encode(spark.createDataFrame(enumerate(texts), "doc_id long, text string"), ranks, r"\w+").collect()
        assert [r.ids for r in sorted(rows, key=lambda r: r.doc_id)] == [([ranks[t.encode()]] if t.encode() in ranks else plain(t.encode(), ranks)) for t in texts]


def test_words_are_numbered_at_first_sight():
    code = bpe._Codes({"a": 3, "b": 0})
    assert [code[w] for w in ("a", "x", "b", "y", "x")] == [3, 4, 0, 5, 4] and list(code) == ["a", "b", "x", "y"]


def test_start():
    byte, ids, base, cells = bpe.merge_table({b"a": 7, b"b": 2, b"ab": 9})
    left = bpe._start(pa.array(["ab", "", "b"]), byte, base, cells).to_pylist()
    mark = len(ids)
    assert [[p & bpe.NONE for p in w] for w in left] == [[mark, 1, 0, mark], [mark, mark], [mark, 0, mark]] and ids[:3].tolist() == [2, 7, 9]
    assert [[p >> bpe.BITS for p in w] for w in left] == [[bpe.NONE, 2, bpe.NONE, bpe.NONE], [bpe.NONE] * 2, [bpe.NONE] * 3]
