"""Line dedup by a deletion-neighbourhood join, in DataFrame functions only.

A line counts by its words.  A line goes if an earlier line, in the order of (doc_id, line number), is equal or, where
both have MIN_WORDS or more, differs by one word (one substituted, added or left out).  All is judged on the input.

Every line of a near pair shares with its partner either the first or the last half of its words, so lines that share
no half with another line emit no variants.  The others emit a key for each way of leaving out one word.  Lines that
meet in a key are never paired with each other: each needs only the key's earliest line.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barlake.llm.common import BLANK, fresh, let
from barlake.session import staged

MIN_WORDS = 8
LOWEST = "-9223372036854775809"  # stands for a null doc_id, before every long


def normal(line: Column) -> Column:
    """The words of a line joined by single blanks; only lines with other blanks pay for a regular expression."""
    odd = F.contains(line, F.lit("  "))
    for c in "\t\v\f\r":
        odd = odd | F.contains(line, F.lit(c))
    return F.btrim(F.when(odd, F.regexp_replace(line, BLANK, " ")).otherwise(line))


def _place(doc: Column, pos: Column) -> Column:
    """(doc, pos) as one ordered number, so that minima need no sort; a null doc comes first."""
    return F.coalesce(doc.cast("decimal(20,0)"), F.lit(LOWEST).cast("decimal(20,0)")) * F.lit(2**31).cast("decimal(11,0)") + pos.cast("decimal(10,0)")


def _lines(docs: DataFrame, doc: str, text: str) -> DataFrame:
    """(doc, version, pos, line, h, g) of the lines with a word; h and g are 96 bits of its words.

    version tells rows of one doc_id with different texts apart.
    """
    split = docs.select(F.col(doc).alias("doc"), F.xxhash64(text).alias("version"), F.posexplode(F.split(F.col(text), "\n")).alias("pos", "raw"))
    named = split.select("doc", "version", "pos", normal(F.col("raw")).alias("line")).where("line <> ''")
    return named.withColumns({"h": F.xxhash64("line"), "g": F.hash("line")})


def _size(line: Column) -> Column:
    return F.octet_length(line) - F.octet_length(F.replace(line, F.lit(" "), F.lit(""))) + 1


def _halves(line: Column) -> list[Column]:
    """Keys of the first and of the last half, for pairs in which the line is the shorter or equal (c = size) or longer one (c = size - 1)."""
    def of(c: Column, side: int) -> Column:
        half = F.floor(c / 2).cast("int")
        part = F.call_function("substring_index", line, F.lit(" "), half if side == 0 else -half)
        return F.xxhash64(F.lit(side), c, part)

    size = F.col("size")
    return [of(size, 0), of(size, 1), of(size - 1, 0), of(size - 1, 1)]


def _variants(w: Column, front: Column, back: Column) -> Column:
    """Keys with their kind: 0 the line itself, 1 the line without a word, 2 the same and the place of the word.

    Two lines of one key of kind 2 differ by a substitution; kinds 0 and 1 meet where a word was added.  A key is the
    exclusive-or of the hashes of (word, place), so leaving a word out takes one step: the words before it keep their
    places and those after it move up by one.  A line that shares only its first half with others leaves out words of
    the back, one that shares only its last half words of the front.
    """
    here = F.transform(w, lambda x, i: F.xxhash64(x, i))
    moved = F.transform(w, lambda x, i: F.xxhash64(x, i - 1))
    whole = lambda hashes: F.aggregate(hashes, F.lit(0).cast("long"), lambda a, x: a.bitwiseXOR(x))
    start = F.struct(F.lit(0).cast("long").alias("before"), whole(moved).alias("after"), F.array().cast("array<bigint>").alias("out"))

    def step(state: Column, pair: Column) -> Column:
        after = state["after"].bitwiseXOR(pair["moved"])
        return F.struct(state["before"].bitwiseXOR(pair["here"]).alias("before"), after.alias("after"), F.concat(state["out"], F.array(state["before"].bitwiseXOR(after))).alias("out"))

    without = F.aggregate(F.arrays_zip(here.alias("here"), moved.alias("moved")), start, step, lambda s: s["out"])
    kind = lambda k, key: F.struct(F.lit(k).alias("kind"), key.alias("key"))
    half = F.floor((F.size(w) - 1) / 2).cast("int")
    placed = F.filter(F.transform(without, lambda x, i: F.struct(x.alias("key"), i.alias("i"))), lambda p: (back & (p["i"] >= half)) | (front & (p["i"] < F.size(w) - half)))
    return let(placed, lambda keys: F.concat(F.array(kind(0, whole(here))), F.transform(F.array_distinct(F.transform(keys, lambda p: p["key"])), lambda x: kind(1, x)), F.transform(keys, lambda p: kind(2, F.xxhash64(p["key"], p["i"])))))


def within_one(a: Column, b: Column) -> Column:
    """Whether two arrays of words are at most one edit apart: the common ends leave at most one word of either."""
    shorter, longer = F.least(F.size(a), F.size(b)), F.greatest(F.size(a), F.size(b))
    head = F.aggregate(F.arrays_zip(a.alias("a"), b.alias("b")), F.struct(F.lit(0).alias("n"), F.lit(True).alias("on")), lambda s, p: F.struct(
        F.when(s["on"] & p["a"].eqNullSafe(p["b"]), s["n"] + 1).otherwise(s["n"]).alias("n"), (s["on"] & p["a"].eqNullSafe(p["b"])).alias("on")))["n"]
    rest = lambda x, n: F.slice(x, n + 1, F.size(x))
    same = F.size(a) == F.size(b)
    return (longer - shorter <= 1) & F.when(same, rest(a, head + 1) == rest(b, head + 1)).when(F.size(a) < F.size(b), rest(a, head) == rest(b, head + 1)).otherwise(rest(a, head + 1) == rest(b, head))


def first_lines(docs: DataFrame, doc: str = "doc_id", text: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """Distinct lines (h, g, keep): keep is the place of the earliest of the line and of all lines near to it."""
    every = _lines(docs, doc, text).select("h", "g", _place(F.col("doc"), F.col("pos")).alias("place"), "line", _size(F.col("line")).alias("size"))
    halves = [F.when(F.col("size") >= min_words, x).alias(f"half{i}") for i, x in enumerate(_halves(F.col("line")))]
    names = [f"half{i}" for i in range(len(halves))]
    distinct = staged(every.select("h", "g", "place", *halves).groupBy("h", "g").agg(F.min("place").alias("first"), *[F.first(n).alias(n) for n in names]))
    side = F.explode(F.array(*[F.struct(F.col(n).alias("half"), F.lit(i % 2 == 0).alias("back")) for i, n in enumerate(names)])).alias("x")
    keyed = distinct.where("half0 IS NOT NULL").select("h", "g", "first", side).select("h", "g", "first", "x.half", "x.back")
    shared = staged(keyed.groupBy("half").agg(F.min("h").alias("low"), F.max("h").alias("high")).where("low <> high").select("half"))
    wanted = keyed.join(shared, "half", "left_semi").groupBy("h", "g", "first").agg(F.max("back").alias("back"), F.max(~F.col("back")).alias("front"))
    # sorted and numbered once: the number orders lines like their places do, in eight bytes
    near = staged(_texts(docs, wanted, doc, text).orderBy("first").withColumn("line", F.monotonically_increasing_id()))
    tasks = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # a line makes many keys, so small files must not decide
    keys = near.repartition(tasks, "line").select("line", F.explode(_variants(F.col("w"), F.col("front"), F.col("back"))).alias("v")).select("line", "v.kind", "v.key")
    keys = staged(keys)
    plain, cut = F.when(F.col("kind") != 1, F.col("line")), F.when(F.col("kind") == 1, F.col("line"))
    best = keys.groupBy("key").agg(F.min(plain).alias("whole"), F.min(cut).alias("part"), F.max(plain).alias("last"))
    # of a key: kind 2 needs two lines; kinds 0 and 1 need one of each
    best = staged(best.where("whole <> last OR (whole IS NOT NULL AND part IS NOT NULL)").drop("last"))
    earlier = keys.join(best, "key").select("line", F.when(F.col("kind") == 0, F.col("part")).otherwise(F.col("whole")).alias("other")).where("other < line")
    pairs = earlier.groupBy("line").agg(F.min("other").alias("other"))
    theirs = near.select(F.col("line").alias("other"), F.col("w").alias("its"), F.col("first").alias("before"))
    checked = pairs.join(near.select("h", "g", "line", "w"), "line").join(theirs, "other").where(within_one(F.col("w"), F.col("its"))).select("h", "g", "before")
    return distinct.select("h", "g", "first").join(checked, ["h", "g"], "left").select("h", "g", F.coalesce("before", "first").alias("keep"))


def _texts(docs: DataFrame, wanted: DataFrame, doc: str, text: str) -> DataFrame:
    """The words (w) of the lines (h, g, first), read again where they first stand."""
    split = F.lit(2**31).cast("decimal(11,0)")
    at = wanted.withColumn("pos", F.pmod("first", split).cast("int")).withColumn("doc", ((F.col("first") - F.col("pos")) / split).cast("decimal(20,0)"))
    places = at.groupBy("doc").agg(F.collect_list(F.struct("pos", "h", "g", "first", "front", "back")).alias("wanted"))
    whole = docs.select(F.coalesce(F.col(doc).cast("decimal(20,0)"), F.lit(LOWEST).cast("decimal(20,0)")).alias("doc"), F.split(F.col(text), "\n").alias("lines"))
    found = whole.join(places, "doc").select("lines", F.explode("wanted").alias("x")).where(F.col("x.pos") < F.size("lines"))
    found = found.select("x.h", "x.g", "x.first", "x.front", "x.back", normal(F.element_at("lines", F.col("x.pos") + 1)).alias("line")).where("xxhash64(line) = h AND hash(line) = g")
    return found.dropDuplicates(["h", "g"]).select("h", "g", "first", "front", "back", F.split("line", " ").alias("w"))


def dedup_lines(docs: DataFrame, doc: str = "doc_id", text: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """``docs`` with the lines that have an earlier equal or near line taken out of ``text``; adds n_lines and n_removed.

    n_lines counts lines with a word; blank lines stay.  A null text stays null with zero lines.  Rows that repeat a
    doc_id stand at the same place of the order, so neither is earlier; a null doc_id comes first.  All rows and other
    columns stay; a column of the same name as an added one is refused.
    """
    if {"n_lines", "n_removed"} & {*docs.columns}:
        raise ValueError("columns n_lines or n_removed exist")
    keep = staged(first_lines(docs, doc, text, min_words))
    every = _lines(docs, doc, text).select("doc", "version", "pos", "h", "g")
    gone = every.join(keep, ["h", "g"]).where(_place(F.col("doc"), F.col("pos")) > F.col("keep")).groupBy("doc", "version").agg(F.collect_set("pos").alias("gone"))
    ver, out = fresh(docs, "version"), fresh(docs, "gone")
    marked = docs.withColumn(ver, F.xxhash64(text))
    gone = gone.select(F.col("doc").alias(f"{out}_doc"), F.col("version").alias(f"{out}_version"), F.col("gone").alias(out))
    joined = marked.join(gone, F.col(doc).eqNullSafe(F.col(f"{out}_doc")) & (F.col(ver) == F.col(f"{out}_version")), "left")
    blank = F.lit(" \t\n\v\f\r")

    def rest(lines: Column) -> Column:
        places = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col(out))
        kept = F.when(F.col(out).isNull(), F.col(text)).otherwise(F.array_join(F.transform(places, lambda p: F.element_at(lines, p + 1)), "\n"))
        return F.struct(kept.alias("kept"), F.size(F.filter(lines, lambda x: F.btrim(x, blank) != "")).cast("long").alias("n_lines"))

    # split once a row: an expression inside a lambda would split the text again for each line
    done, at = let(F.split(F.coalesce(F.col(text), F.lit("")), "\n"), rest), fresh(docs, "rest")
    split = joined.withColumn(at, done)
    return split.select(*[F.col(at)["kept"].alias(c) if c == text else F.col(c) for c in docs.columns], F.col(at)["n_lines"].alias("n_lines"), F.coalesce(F.size(out), F.lit(0)).cast("long").alias("n_removed"))
