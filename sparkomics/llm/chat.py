"""Chat formatting of typed content parts, with a loss mask and an exact way back.

A message is a role and a list of parts: text, image, audio or document. A visitor with one method for each type
flattens the parts in order: text is escaped, anything else becomes a numbered placeholder, its reference and the tokens
it expands to are recorded. A template marks the turns; since escaped texts hold none of the characters that control
strings begin with, no text can imitate a turn, and unescaping restores it. The loss mask holds the spans of assistant
texts in the formatted string.

Long conversations are put together in two steps, by blocks of turns and then by conversation. Nulls: a null text,
reference or part list is empty, a null role is the empty role, a part of null or unknown type counts as text; null
conv_ids form one conversation; null turns come first. Rows are in the order of turn, then role, then content, which
also settles ties; repeated rows all stay. Empty tables give empty results; further columns are ignored.
DataFrame operations only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

TURN, END = "<|turn|>", "<|end|>"
BLOCK_TURNS = 64
#: Pixels of an image patch's side, audio frames a second, and tokens of a document's page.
PATCH, FRAMES, PAGE_TOKENS = 14, 25, 512

PARTS = "array<struct<type:string,text:string,ref:string,width:int,height:int,seconds:double,pages:int>>"

#: What an escaped text has in place of a character. The ampersand is escaped first and restored last.
ESCAPES = (("&", "&amp;"), ("<", "&lt;"), ("[", "&#91;"))


def escape(c: Column) -> Column:
    for raw, safe in ESCAPES:
        c = F.replace(c, F.lit(raw), F.lit(safe))
    return c


def unescape(c: Column) -> Column:
    for raw, safe in reversed(ESCAPES):
        c = F.replace(c, F.lit(safe), F.lit(raw))
    return c


def text_parts(text: Column) -> Column:
    """A message of one text part."""
    null = F.lit(None)
    return F.array(
        F.struct(
            F.lit("text").alias("type"), text.alias("text"), null.cast("string").alias("ref"), null.cast("int").alias("width"),
            null.cast("int").alias("height"), null.cast("double").alias("seconds"), null.cast("int").alias("pages"),
        )
    )


class PartVisitor:
    """One method for each type of part: (rendered, tokens) as columns; `at` is the part's place in its message."""

    def text(self, part: Column, at: Column) -> tuple[Column, Column]:
        return escape(F.coalesce(part["text"], F.lit(""))), F.lit(0)

    def image(self, part: Column, at: Column) -> tuple[Column, Column]:
        patches = lambda side: F.ceil(F.coalesce(part[side], F.lit(PATCH)) / PATCH)
        return self._placeholder("image", at), patches("width") * patches("height")

    def audio(self, part: Column, at: Column) -> tuple[Column, Column]:
        return self._placeholder("audio", at), F.ceil(F.coalesce(part["seconds"], F.lit(0.0)) * FRAMES)

    def document(self, part: Column, at: Column) -> tuple[Column, Column]:
        return self._placeholder("document", at), F.coalesce(part["pages"], F.lit(1)) * PAGE_TOKENS

    def _placeholder(self, kind: str, at: Column) -> Column:
        return F.concat(F.lit(f"<|{kind}:"), at.cast("string"), F.lit("|>"))

    def visit(self, part: Column, at: Column) -> Column:
        """The part as a struct of type, rendered, ref and tokens."""
        rendered, tokens = self.text(part, at)
        for kind in ("image", "audio", "document"):
            r, t = getattr(self, kind)(part, at)
            is_kind = F.coalesce(part["type"], F.lit("")) == kind
            rendered, tokens = F.when(is_kind, r).otherwise(rendered), F.when(is_kind, t).otherwise(tokens)
        return F.struct(F.coalesce(part["type"], F.lit("text")).alias("type"), rendered.alias("rendered"), F.coalesce(part["ref"], F.lit("")).alias("ref"), tokens.cast("long").alias("tokens"))


def format_turns(messages: DataFrame) -> DataFrame:
    """A row for each message of conv_id, turn, role, parts: its formatted string, where its content lies, attachments."""
    visitor = PartVisitor()
    parts = F.coalesce(F.col("parts").cast(PARTS), F.from_json(F.lit("[]"), PARTS))
    flat = F.transform(parts, visitor.visit)
    # A role can't end its own line.
    role = F.replace(escape(F.coalesce(F.col("role").cast("string"), F.lit(""))), F.lit("\n"), F.lit("&#10;"))
    head = F.concat(F.lit(TURN), role, F.lit("\n"))
    attachments = F.transform(F.filter(flat, lambda p: p["type"].isin("image", "audio", "document")), lambda p: F.struct(p["type"], p["ref"], p["tokens"]))
    return (
        messages.select("conv_id", "turn", role.alias("role"), head.alias("head"), flat.alias("flat"), attachments.alias("attachments"))
        .withColumn("content", F.array_join(F.transform("flat", lambda p: p["rendered"]), ""))
        .drop("flat")
    )


def format_blocks(messages: DataFrame) -> DataFrame:
    """conv_id, block, formatted, loss (spans in it, from 0), attachments: conversations in blocks of turns."""
    by = Window.partitionBy("conv_id", "block").orderBy("turn", "role", "content")
    up_to = by.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    turns = format_turns(messages).withColumn("block", F.floor(F.col("turn") / BLOCK_TURNS))
    size = F.length("head") + F.length("content") + F.lit(len(END))
    turns = turns.withColumn("n", F.row_number().over(by)).withColumn("start", F.sum(size).over(up_to) - size + F.length("head"))
    rows = F.sort_array(F.collect_list(F.struct("n", "role", "start", F.concat("head", "content", F.lit(END)).alias("formatted"), F.length("content").alias("length"), "attachments")))
    loss = F.filter("rows", lambda r: r["role"] == "assistant")
    return (
        turns.groupBy("conv_id", "block")
        .agg(rows.alias("rows"))
        .select(
            "conv_id",
            "block",
            F.array_join(F.transform("rows", lambda r: r["formatted"]), "").alias("formatted"),
            F.transform(loss, lambda r: F.struct(r["start"], r["length"])).alias("loss"),
            F.flatten(F.transform("rows", lambda r: r["attachments"])).alias("attachments"),
        )
    )


def read_back(blocks: DataFrame) -> DataFrame:
    """conv_id, block, n_turns, turns_text, loss_text, formatted_chars: what formatted blocks and their masks say."""
    turns = F.filter(F.split("formatted", r"<\|turn\|>", -1), lambda _, i: i > 0)

    def one(turn: Column) -> Column:
        role = F.substring_index(turn, "\n", 1)
        content = F.substr(turn, F.length(role) + 2, F.length(turn) - F.length(role) - 1 - len(END))
        return F.concat(unescape(F.replace(role, F.lit("&#10;"), F.lit("\n"))), F.lit("\n"), unescape(content), F.lit("\n"))

    loss = F.transform("loss", lambda s: F.substr(F.col("formatted"), (s["start"] + 1).cast("int"), s["length"]))
    return blocks.select(
        "conv_id",
        "block",
        F.size(turns).cast("long").alias("n_turns"),
        F.array_join(F.transform(turns, one), "").alias("turns_text"),
        unescape(F.array_join(loss, "")).alias("loss_text"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


def format_conversations(messages: DataFrame) -> DataFrame:
    """conv_id, formatted, loss (spans of assistant texts, from 0), attachments, attachment_tokens."""
    rows = F.sort_array(F.collect_list(F.struct("block", "formatted", "loss", "attachments")))
    # Offsets of blocks: the characters of all blocks before.
    before = lambda i: F.aggregate(F.slice("rows", 1, i), F.lit(0).cast("long"), lambda a, r: a + F.length(r["formatted"]))
    shifted = F.flatten(F.transform("rows", lambda r, i: F.transform(r["loss"], lambda s: F.struct((s["start"] + before(i)).alias("start"), s["length"]))))
    attachments = F.flatten(F.transform("rows", lambda r: r["attachments"]))
    return (
        format_blocks(messages)
        .groupBy("conv_id")
        .agg(rows.alias("rows"))
        .select("conv_id", F.array_join(F.transform("rows", lambda r: r["formatted"]), "").alias("formatted"), shifted.alias("loss"), attachments.alias("attachments"))
        .withColumn("attachment_tokens", F.aggregate("attachments", F.lit(0).cast("long"), lambda a, x: a + x["tokens"]))
    )


def digests(blocks: DataFrame) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, read back from formatted blocks."""
    whole = lambda name: F.array_join(F.transform("rows", lambda r: r[name]), "")
    return (
        read_back(blocks)
        .groupBy("conv_id")
        .agg(F.sort_array(F.collect_list(F.struct("block", "turns_text", "loss_text"))).alias("rows"), F.sum("n_turns").alias("n_turns"), F.sum("formatted_chars").alias("formatted_chars"))
        .select(
            "conv_id",
            "n_turns",
            F.sha2(whole("turns_text"), 256).alias("turns_sha256"),
            F.length(whole("loss_text")).cast("long").alias("loss_chars"),
            F.sha2(whole("loss_text"), 256).alias("loss_sha256"),
            "formatted_chars",
        )
    )
