"""Chat formatting with typed content parts, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

TURN, END = "<turn>", "</turn>\n"

# Tokens that a part takes in the model's input unless the part says so itself.
PART_TOKENS = {"image": 256, "audio": 128, "document": 512}

PART = T.StructType().add("type", "string").add("text", "string").add("ref", "string").add("tokens", "long")


def escape(text: Column) -> Column:
    """Write a text so that it holds no ``<``: every ``<`` in an output starts a control string."""
    return F.replace(F.replace(F.coalesce(text, F.lit("")), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))


def unescape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("&lt;"), F.lit("<")), F.lit("&amp;"), F.lit("&"))


def _label(role: Column) -> Column:
    return F.replace(escape(role), F.lit("\n"), F.lit("&#10;"))


def _unlabel(label: Column) -> Column:
    return unescape(F.replace(label, F.lit("&#10;"), F.lit("\n")))


def _kind(part: Column) -> Column:
    return F.coalesce(part["type"], F.lit("text"))


def _size(part: Column) -> Column:
    """Expanded tokens of a part: words of a text, else what the part says or its type's default."""
    known = F.create_map(*[F.lit(x) for kv in PART_TOKENS.items() for x in kv])
    count = F.size(F.filter(F.split(F.coalesce(part["text"], F.lit("")), r"\s+"), lambda w: w != ""))
    return F.when(_kind(part) == "text", count).otherwise(F.coalesce(part["tokens"], F.try_element_at(known, _kind(part)), F.lit(0))).cast("long")


def visit(parts: Column) -> tuple[Column, Column, Column]:
    """Flatten typed parts in order to (body, attachments, tokens).

    A text part is escaped; any other part becomes the placeholder ``<type k>``, k counting the parts of the turn
    from 0.  An attachment records that k, the type, the reference and its tokens.  Null parts are skipped, a null
    type is a text.
    """
    kept = F.filter(parts, lambda p: p.isNotNull())
    place = F.transform(kept, lambda p, i: F.when(_kind(p) == "text", escape(p["text"])).otherwise(F.concat(F.lit("<"), _label(_kind(p)), F.lit(" "), i.cast("string"), F.lit(">"))))
    numbered = F.transform(kept, lambda p, i: F.struct(i.cast("long").alias("part"), _kind(p).alias("type"), p["ref"].alias("ref"), _size(p).alias("tokens")))
    tokens = F.aggregate(F.transform(kept, _size), F.lit(0).cast("long"), lambda a, x: a + x)
    return F.array_join(place, ""), F.filter(numbered, lambda a: a["type"] != "text"), tokens


def as_parts(text: Column) -> Column:
    """A plain text as one text part."""
    return F.array(F.struct(F.lit("text").alias("type"), text.alias("text"), F.lit(None).cast("string").alias("ref"), F.lit(None).cast("long").alias("tokens")))


def format_chat(rows: DataFrame, parts: str = "parts", learn: str = "assistant") -> DataFrame:
    """Format conversations: one row per conv_id from rows (conv_id, turn, role, ``parts``).

    Returns conv_id, formatted, loss_spans (array of start and length in code points of ``formatted``: the bodies of
    ``learn``'s turns), attachments (turn number, part, type, ref, tokens), n_tokens.  Turns are ordered by ``turn``
    (nulls first), then role and body.  Null roles and null contents are empty; a null conv_id is a conversation of
    its own.  Window and grouping use one shuffle on conv_id; a conversation is one string, so its turns must meet.
    """
    body, files, tokens = visit(F.coalesce(F.col(parts), F.array().cast(T.ArrayType(PART))))
    turns = rows.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), body.alias("body"), files.alias("files"), tokens.alias("tokens"))
    turns = turns.withColumn("head", F.concat(F.lit(TURN), _label(F.col("role")), F.lit("\n"))).withColumn("piece", F.concat("head", "body", F.lit(END)))
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "body")
    turns = turns.withColumn("n", F.row_number().over(order)).withColumn("until", F.sum(F.length("piece")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    span = F.struct((F.col("until") - F.length("piece") + F.length("head")).cast("long").alias("start"), F.length("body").cast("long").alias("length"))
    turn = F.struct("n", "piece", (F.col("role") == learn).alias("learn"), span.alias("span"), "files", "tokens")
    grouped = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list(turn)).alias("turns"), F.sum("tokens").alias("n_tokens"))
    listed = F.flatten(F.transform("turns", lambda t: F.transform(t["files"], lambda f: F.struct((t["n"] - 1).cast("long").alias("turn"), f["part"].alias("part"), f["type"].alias("type"), f["ref"].alias("ref"), f["tokens"].alias("tokens")))))
    return grouped.select(
        "conv_id", F.array_join(F.transform("turns", lambda t: t["piece"]), "").alias("formatted"),
        F.transform(F.filter("turns", lambda t: t["learn"]), lambda t: t["span"]).alias("loss_spans"), listed.alias("attachments"), "n_tokens",
    )


def read_chat(formatted: Column) -> Column:
    """Turns of a formatted conversation: array of (role, text), texts unescaped and placeholders left as they are."""
    pieces = F.slice(F.split(formatted, TURN), F.lit(2), F.greatest(F.size(F.split(formatted, TURN)) - 1, F.lit(0)))
    return F.transform(pieces, lambda p: F.struct(
        _unlabel(F.substring_index(p, "\n", 1)).alias("role"),
        unescape(F.substring(p, F.length(F.substring_index(p, "\n", 1)) + 2, F.length(p) - F.length(F.substring_index(p, "\n", 1)) - 1 - len(END))).alias("text"),
    ))


def learned_text(formatted: Column, spans: Column) -> Column:
    """All text under the loss mask, unescaped, in order, with nothing between."""
    return F.array_join(F.transform(spans, lambda s: unescape(F.substring(formatted, (s["start"] + 1).cast("int"), s["length"].cast("int")))), "")
