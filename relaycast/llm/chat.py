"""Chat formatting with typed content parts, in DataFrame functions alone.

A message is a row (conv_id, turn, role, parts); a part has a kind (text, image, audio, document) and what
that kind needs. A visitor over the parts writes texts, escaped, and for anything else a placeholder in its
place, ``<|kind:i|>``, recording the attachment's reference and the tokens that it expands to. A turn is

    ### role: body </turn>\n

Escaping is reversible and leaves no ``#``, ``<`` or (in roles) ``:`` in what users wrote, so no control
string can be forged: ``\\`` becomes ``\\\\``, ``#`` ``\\h``, ``<`` ``\\l``, ``:`` ``\\c``. The loss mask lists
the assistant's text parts as ranges of code points of the formatted string.

A conversation's turns meet in one row, as its formatted text must; nothing else is gathered. Offsets come
from a running sum over the same partitioning, so there is one shuffle.

Defined cases: null roles and texts are empty; a null part is an empty text, a message without parts has an
empty body; kinds not known to ``tokens`` expand to one token; turns sort by number (null first), equal
numbers by role and body; rows of a null conv_id are one conversation; an empty table gives no rows; other
columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

PART = "struct<kind: string, text: string, ref: string, width: int, height: int, seconds: double, pages: int>"
# Fixed values of the template.
OPEN, BETWEEN, CLOSE = "### ", ": ", " </turn>\n"
PATCH, AUDIO_RATE, PAGE_TOKENS = 16, 25, 256


def escape(c: Column, role: bool = False) -> Column:
    c = F.replace(F.replace(F.replace(F.coalesce(c, F.lit("")), F.lit("\\"), F.lit("\\\\")), F.lit("#"), F.lit("\\h")), F.lit("<"), F.lit("\\l"))
    return F.replace(c, F.lit(":"), F.lit("\\c")) if role else c


def unescape(c: Column) -> Column:
    """Undoes escape() in one reading: what is between two doubled backslashes holds only single escapes."""
    pieces = F.split(c, r"\\\\", -1)
    undone = F.transform(pieces, lambda p: F.replace(F.replace(F.replace(p, F.lit("\\h"), F.lit("#")), F.lit("\\l"), F.lit("<")), F.lit("\\c"), F.lit(":")))
    return F.array_join(undone, "\\")


def tokens(p: Column) -> Column:
    """Tokens that an attachment expands to: image patches, audio frames, document pages."""
    image = F.ceil(F.coalesce(p.width, F.lit(0)) / PATCH) * F.ceil(F.coalesce(p.height, F.lit(0)) / PATCH)
    return F.greatest(
        F.lit(1).cast("long"),
        F.when(p.kind == "image", image).when(p.kind == "audio", F.ceil(F.coalesce(p.seconds, F.lit(0.0)) * AUDIO_RATE)).when(p.kind == "document", F.coalesce(p.pages, F.lit(0)) * PAGE_TOKENS).otherwise(1).cast("long"),
    )


def is_text(p: Column) -> Column:
    return F.coalesce(p.kind, F.lit("text")) == "text"


def visit(messages: DataFrame) -> DataFrame:
    """Messages with their bodies, the text parts' ranges in them, and their attachments."""
    parts = F.coalesce("parts", F.array().cast(f"array<{PART}>"))
    segments = F.transform(parts, lambda p, i: F.when(is_text(p), escape(p.text)).otherwise(F.concat(F.lit("<|"), p.kind, F.lit(":"), i.cast("string"), F.lit("|>"))))
    seen = messages.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), parts.alias("parts"), segments.alias("segments"))
    # Offsets: sums of blocks of about the root of the number of parts, and sums inside a block.
    sized = seen.withColumn("sizes", F.transform("segments", F.char_length)).withColumn("width", F.ceil(F.sqrt(F.greatest(F.size("parts"), F.lit(1)))).cast("int"))
    total = lambda a: F.aggregate(a, F.lit(0), lambda x, y: x + y)
    numbers = F.when(F.size("parts") == 0, F.array().cast("array<int>")).otherwise(F.sequence(F.lit(0), F.floor((F.size("parts") - 1) / F.col("width")).cast("int")))
    seen = sized.withColumn("blocks", F.transform(numbers, lambda b: total(F.slice("sizes", b * F.col("width") + 1, F.col("width")))))
    starts = F.transform("blocks", lambda x, b: F.struct((b * F.col("width")).alias("first"), total(F.slice("blocks", F.lit(1), b)).alias("start")))

    def block(x):
        return F.transform(
            F.slice("sizes", x.first + 1, F.col("width")),
            lambda n, j: F.struct((x.start + total(F.slice("sizes", x.first + 1, j))).alias("within"), n.alias("chars"), is_text(F.get("parts", x.first + j)).alias("text")),
        )

    texts = F.filter(F.flatten(F.transform(starts, block)), lambda x: x.text)
    attached = F.filter(F.transform("parts", lambda p, i: F.struct(i.alias("part"), p.kind.alias("kind"), p.ref.alias("ref"), tokens(p).alias("tokens"), is_text(p).alias("text"))), lambda x: ~x.text)
    return seen.select("conv_id", "turn", "role", F.array_join("segments", "").alias("body"), texts.alias("texts"), attached.alias("attached"))


def format_chats(messages: DataFrame, learn: str = "assistant") -> DataFrame:
    """conv_id, n_turns, formatted, loss mask, attachments with references, and their expanded tokens."""
    head = F.concat(F.lit(OPEN), escape(F.col("role"), role=True), F.lit(BETWEEN))
    lines = visit(messages).withColumn("head", F.char_length(head)).withColumn("line", F.concat(head, "body", F.lit(CLOSE)))
    order = W.partitionBy("conv_id").orderBy("turn", "role", "body")
    # Running sums stop one row short of the present one; the row's own number makes equal rows distinct.
    placed = lines.withColumn("n", F.row_number().over(order)).withColumn("start", F.coalesce(F.sum(F.char_length("line")).over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    marks = F.when(
        F.col("role") == learn,
        F.transform("texts", lambda t: F.struct(F.col("n").alias("turn"), (F.col("start") + F.col("head") + t.within).alias("start"), t.chars.cast("long").alias("chars"), (F.col("head") + t.within).alias("within"))),
    )
    attachments = F.transform("attached", lambda a: F.struct(F.col("n").alias("turn"), a.part.alias("part"), a.kind.alias("kind"), a.ref.alias("ref"), a.tokens.alias("tokens")))
    rows = placed.select("conv_id", F.struct("n", "line", marks.alias("marks"), attachments.alias("attachments")).alias("r"))
    got = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list("r")).alias("r"))
    return got.select(
        "conv_id",
        F.size("r").cast("long").alias("n_turns"),
        F.array_join(F.col("r.line"), "").alias("formatted"),
        F.flatten(F.filter(F.col("r.marks"), lambda m: m.isNotNull())).alias("loss"),
        F.flatten(F.col("r.attachments")).alias("attachments"),
    ).withColumn("attachment_tokens", F.aggregate("attachments", F.lit(0).cast("long"), lambda a, x: a + x.tokens))


def read_chats(formatted: DataFrame) -> DataFrame:
    """What a formatted conversation says: turns (role, body) and the text under the loss mask, unescaped."""
    pieces = F.split("formatted", CLOSE.replace("\n", "\\n"), -1)
    lines = formatted.withColumn("pieces", F.slice(pieces, 1, F.greatest(F.size(pieces) - 1, F.lit(0))))
    find = lambda p: F.instr(p, BETWEEN)
    turns = F.transform("pieces", lambda p: F.struct(unescape(F.substring(p, F.lit(len(OPEN) + 1), find(p) - len(OPEN) - 1)).alias("role"), unescape(F.substring(p, find(p) + len(BETWEEN), F.char_length(p))).alias("text")))
    learnt = F.array_join(F.transform("loss", lambda m: unescape(F.substring(F.get("pieces", m.turn - 1), (m.within + 1).cast("int"), m.chars.cast("int")))), "")
    return lines.select("conv_id", turns.alias("turns"), learnt.alias("learnt"), F.char_length("formatted").cast("long").alias("formatted_chars"))


def text_messages(conversations: DataFrame) -> DataFrame:
    """A table of plain texts as messages of one text part each."""
    part = F.struct(
        F.lit("text").alias("kind"), F.col("text"), F.lit(None).cast("string").alias("ref"), F.lit(None).cast("int").alias("width"), F.lit(None).cast("int").alias("height"), F.lit(None).cast("double").alias("seconds"), F.lit(None).cast("int").alias("pages")
    )
    return conversations.select("conv_id", "turn", "role", F.array(part).alias("parts"))
