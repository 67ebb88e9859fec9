"""Chat formatting with typed content parts.

A turn becomes `<|turn|>role<|text|>content<|end|>` and a line feed; a conversation is
its turns in order. Content is a string, or an array of typed parts that a visitor
flattens in order: text parts become escaped text, image, audio and document
parts a placeholder each, with a record of what it refers to and of the tokens it
expands to.

Escaping is reversible: a backslash is doubled, and one is put behind the first
character of whatever could be read as control text, of this template or of other
common ones. So no text can forge a turn, and reading back gives it unchanged.

The output has a row for each turn, so a conversation of any length is formatted in
parallel; `digests` reads a conversation's rows back in order as a stream.

A string as content is one text part, so both kinds of content take the same path.

Edge cases: null texts, roles and parts are empty; a null list of parts is empty; a part
of an unknown kind becomes a placeholder of its own, recorded with its kind and without tokens; rows of a conversation with equal turns are
ordered by role, then content; null conversation ids form one conversation; repeated
rows are turns of their own; texts of any length are formatted whole; an empty table gives an empty result; extra columns stay,
but those made are replaced.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

TURN, TEXT, END = "<|turn|>", "<|text|>", "<|end|>\n"
#: The control texts of common chat templates that must not appear in a
#: text as they are. Each begins with < or [.
CONTROL = r"<(?=\||/?s>|</?SYS>>)|\[(?=/?INST\])"

#: The type of a list of parts; ref names an attachment, size is its pixels (image,
#: width x height), seconds (audio) or pages (document).
PARTS = "array<struct<type:string,text:string,ref:string,width:int,height:int,seconds:double,pages:int>>"
#: Tokens: an image has one for each patch of so many pixels squared, audio so many
#: a second, a document so many a page.
PATCH, PER_SECOND, PER_PAGE = 28, 25, 512


def escape(text: Column) -> Column:
    return F.regexp_replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), CONTROL, r"$0\\")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"\\(\\?)", "$1")


class Visitor:
    """What each kind of part becomes. Subclass it to add kinds or change counts."""

    kinds = ("text", "image", "audio", "document")

    def visit(self, part: Column, as_: str) -> Column:
        """The part's content or tokens."""
        out = F.lit("<|unknown|>") if as_ == "content" else F.lit(None).cast("long")
        for kind in self.kinds:
            out = F.when(part["type"] == kind, getattr(self, kind)(part)[as_ == "tokens"]).otherwise(out)
        return out

    def text(self, part: Column) -> tuple[Column, Column]:
        return escape(F.coalesce(part["text"], F.lit(""))), F.lit(None).cast("long")

    def image(self, part: Column) -> tuple[Column, Column]:
        across, down = (F.ceil(F.coalesce(part[s], F.lit(0)) / PATCH) for s in ("width", "height"))
        return F.lit("<|image|>"), (across * down).cast("long")

    def audio(self, part: Column) -> tuple[Column, Column]:
        return F.lit("<|audio|>"), F.ceil(F.coalesce(part["seconds"], F.lit(0.0)) * PER_SECOND).cast("long")

    def document(self, part: Column) -> tuple[Column, Column]:
        return F.lit("<|document|>"), (F.coalesce(part["pages"], F.lit(0)) * PER_PAGE).cast("long")


def format_turns(df: DataFrame, content: str = "text", role: str = "role", trained: str = "assistant", visitor: Visitor | None = None) -> DataFrame:
    """df with formatted (the turn), loss (start and end of its trained text, in code
    points of formatted; null for other roles), attachments (placeholder number, kind,
    ref, tokens) and expanded_tokens (what its placeholders expand to)."""
    visitor = visitor or Visitor()
    given = df[content]
    if isinstance(df.schema[content].dataType, T.StringType):
        none = [F.lit(None).alias(c) for c in ("ref", "width", "height", "seconds", "pages")]
        given = F.array(F.struct(F.lit("text").alias("type"), given.alias("text"), *none))
    parts = F.filter(F.coalesce(given.cast(PARTS), F.array().cast(PARTS)), lambda p: p.isNotNull())
    body = F.array_join(F.transform(parts, lambda p: visitor.visit(p, "content")), "")
    placed = F.filter(parts, lambda p: ~p["type"].eqNullSafe("text"))
    attachments = F.transform(placed, lambda p, i: F.struct(i.cast("int").alias("number"), p["type"].alias("kind"), p["ref"].alias("ref"), visitor.visit(p, "tokens").alias("tokens")))
    own = F.coalesce(df[role], F.lit(""))
    head = F.concat(F.lit(TURN), escape(own), F.lit(TEXT))
    loss = F.struct(F.length(head).alias("start"), (F.length(head) + F.length(body)).alias("end"))
    return df.withColumns({
        "formatted": F.concat(head, body, F.lit(END)),
        "loss": F.when(own == trained, loss),
        "attachments": attachments,
        "expanded_tokens": F.aggregate(attachments, F.lit(0).cast("long"), lambda a, x: a + F.coalesce(x["tokens"], F.lit(0))),
    })


def read_turns(df: DataFrame) -> DataFrame:
    """df with role_read, text_read and loss_text, taken from formatted and loss alone."""
    text_at = F.instr("formatted", TEXT)
    inner = F.col("formatted").substr(text_at + len(TEXT), F.length("formatted") - text_at - len(TEXT) - len(END) + 1)
    masked = F.col("formatted").substr(F.col("loss.start") + 1, F.col("loss.end") - F.col("loss.start"))
    return df.withColumns({
        "role_read": unescape(F.col("formatted").substr(F.lit(len(TURN) + 1), text_at - len(TURN) - 1)),
        "text_read": unescape(inner),
        "loss_text": unescape(F.coalesce(masked, F.lit(""))),
    })


def digests(turns: DataFrame, conv_id: str = "conv_id", turn: str = "turn") -> DataFrame:
    """Per conversation of format_turns: n_turns, turns_sha256, loss_chars, loss_sha256,
    formatted_chars. Rows come sorted, so a task holds one turn and two hash states."""
    read = read_turns(turns).select(conv_id, turn, F.col("role_read").alias("role"), F.col("text_read").alias("text"), "loss_text", F.length("formatted").alias("chars"))
    kind = read.schema[conv_id].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, started = None, False
        n = chars = loss_chars = 0
        whole, loss = hashlib.sha256(), hashlib.sha256()

        def row() -> list:
            return [now, n, whole.hexdigest(), loss_chars, loss.hexdigest(), chars]

        for b in batches:
            done = []
            for c, role, text, masked, length in zip(*(b.column(x).to_pylist() for x in (conv_id, "role", "text", "loss_text", "chars")), strict=True):
                if not started or c != now:
                    if started:
                        done.append(row())
                    now, started = c, True
                    n = chars = loss_chars = 0
                    whole, loss = hashlib.sha256(), hashlib.sha256()
                whole.update(f"{role}\n{text}\n".encode())
                loss.update(masked.encode())
                n, chars, loss_chars = n + 1, chars + length, loss_chars + len(masked)
            if done:
                yield batch(done, b.schema.field(conv_id).type)
        if started:
            yield batch([row()], b.schema.field(conv_id).type)

    def batch(rows: list, id_type: pa.DataType) -> pa.RecordBatch:
        types = [id_type, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        names = [conv_id, "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)

    dealt = read.repartition(conv_id).sortWithinPartitions(conv_id, turn, "role", "text")
    return dealt.mapInArrow(run, f"{conv_id} {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
