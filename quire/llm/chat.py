"""Chat formatting with typed content parts, native.

A turn's content is a list of parts (``PART``): text, image, audio or document.
A visitor flattens it: text parts are escaped, the others become a placeholder
(``<|image|>`` and so on) in place, their reference is recorded in order, and
the tokens each placeholder expands to are counted. The template is

    <|im_start|>ROLE\\nBODY<|im_end|>\\n

Control strings inside texts cannot be mistaken for the template's: ``&`` and
``<`` are written ``&amp;`` and ``&lt;`` (a newline in a role ``&#10;``), which
``unescape`` takes back exactly. The loss mask is the list of (start, length)
spans, in code points, of assistant bodies.

A conversation is formatted in chunks (one row each): rows are dealt by turn
number, ``CHUNK`` numbers together, so a conversation of many turns is spread
over tasks, and each such run is cut after every ``CHUNK`` rows in order, so
that no chunk holds more, however often a turn, or null, repeats. A
conversation's text is the chunks' concatenation by (chunk, part). ``digest``
puts that text together again, one conversation in a row, because a digest is
taken over it; the operator itself never does. Defined cases: null text or content is empty, a null
role is the empty role; null turns come first; rows of the same turn are
ordered by role, then text, and repeated rows are all kept; a null conversation
id is a conversation of its own; an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.llm.text import let

CHUNK = 256
START, END = "<|im_start|>", "<|im_end|>"
PART = "struct<type:string,text:string,ref:string,width:int,height:int,seconds:double,pages:int>"
#: Token costs of attachments: pixels a side of an image token, audio tokens a second, tokens a document page.
IMAGE_SIDE, AUDIO_RATE, PAGE_TOKENS = 28, 25, 512


def escape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))


def escape_role(role: Column) -> Column:
    return F.replace(escape(role), F.lit("\n"), F.lit("&#10;"))


def unescape(text: Column) -> Column:
    """Inverse of ``escape`` and ``escape_role``."""
    for coded, plain in (("&#10;", "\n"), ("&lt;", "<"), ("&amp;", "&")):
        text = F.replace(text, F.lit(coded), F.lit(plain))
    return text


def text_part(text: Column) -> Column:
    """A content list of one text part."""
    part = F.struct(F.lit("text").alias("type"), text.alias("text"), *[F.lit(None).cast(t).alias(n) for n, t in (("ref", "string"), ("width", "int"), ("height", "int"), ("seconds", "double"), ("pages", "int"))])
    return F.array(part)


def part_tokens(p: Column) -> Column:
    """Tokens that a part's placeholder expands to; text parts count none here."""
    side = lambda c: F.ceil(F.coalesce(p[c], F.lit(0)) / IMAGE_SIDE)
    return (
        F.when(p["type"] == "image", side("width") * side("height"))
        .when(p["type"] == "audio", F.ceil(F.coalesce(p["seconds"], F.lit(0.0)) * AUDIO_RATE))
        .when(p["type"] == "document", F.coalesce(p["pages"], F.lit(0)).cast("long") * PAGE_TOKENS)
        .otherwise(F.lit(0))
        .cast("long")
    )


def flatten_parts(content: Column) -> Column:
    """struct(body, attachments): the visitor over one turn's parts."""
    body = F.array_join(
        F.transform(
            content,
            lambda p: F.when(p["type"].isin("image", "audio", "document"), F.concat(F.lit("<|"), p["type"], F.lit("|>"))).otherwise(escape(F.coalesce(p["text"], F.lit("")))),
        ),
        "",
    )
    held = F.filter(content, lambda p: p["type"].isin("image", "audio", "document"))
    attachments = F.transform(held, lambda p: F.struct(p["type"].alias("type"), p["ref"].alias("ref"), part_tokens(p).alias("tokens")))
    return F.struct(F.coalesce(body, F.lit("")).alias("body"), F.coalesce(attachments, F.array().cast("array<struct<type:string,ref:string,tokens:bigint>>")).alias("attachments"))


def format_chat(turns: DataFrame, content: Column | None = None) -> DataFrame:
    """conv_id, chunk, part, formatted, loss_spans, attachments, expanded_tokens for every chunk.

    ``content``: an array of ``PART``; by default the ``text`` column as one text part.
    """
    flat = flatten_parts(text_part(F.col("text")) if content is None else content)
    rows = turns.select("conv_id", F.floor(F.col("turn") / CHUNK).alias("chunk"), "turn", F.coalesce("role", F.lit("")).alias("role"), flat.alias("flat"))
    nth = F.row_number().over(Window.partitionBy("conv_id", "chunk").orderBy("turn", "role", unescape(F.col("flat.body")))) - 1
    placed = rows.withColumn("nth", nth).withColumn("part", F.floor(F.col("nth") / CHUNK))
    chunks = placed.groupBy("conv_id", "chunk", "part").agg(F.sort_array(F.collect_list(F.struct("nth", "role", "flat"))).alias("t"))
    head = lambda t: F.concat(F.lit(START), escape_role(t["role"]), F.lit("\n"))
    tail = END + "\n"
    place = F.aggregate(
        "t",
        F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,length:int>>").alias("spans")),
        lambda s, t: let(
            s["at"] + F.length(head(t)),
            lambda at: F.struct(
                (at + F.length(t["flat"]["body"]) + len(tail)).alias("at"),
                F.when(t["role"] == "assistant", F.concat(s["spans"], F.array(F.struct(at.alias("start"), F.length(t["flat"]["body"]).alias("length"))))).otherwise(s["spans"]).alias("spans"),
            ),
        ),
        lambda s: s["spans"],
    )
    return chunks.select(
        "conv_id",
        "chunk",
        "part",
        F.array_join(F.transform("t", lambda t: F.concat(head(t), t["flat"]["body"], F.lit(tail))), "").alias("formatted"),
        place.alias("loss_spans"),
        F.flatten(F.transform("t", lambda t: t["flat"]["attachments"])).alias("attachments"),
    ).withColumn("expanded_tokens", F.aggregate("attachments", F.lit(0).cast("long"), lambda n, a: n + a["tokens"]))


def read_turns(formatted: Column) -> Column:
    """array of struct(role, text) read back from a formatted chunk."""

    def one(x: Column) -> Column:
        return let(
            F.substring_index(x, "\n", 1),
            lambda role: F.struct(unescape(role).alias("role"), unescape(F.substring_index(F.substr(x, F.length(role) + 2), END, 1)).alias("text")),
        )

    return F.transform(F.array_remove(F.split(formatted, r"<\|im_start\|>"), ""), one)


def read_loss(formatted: Column, spans: Column) -> Column:
    """The unescaped text under a chunk's loss mask."""
    return F.array_join(F.transform(spans, lambda s: unescape(F.substr(formatted, s["start"] + 1, s["length"]))), "")


def digest(chunks: DataFrame) -> DataFrame:
    """One row per conversation, everything read back from the formatted chunks."""
    read = chunks.select(
        "conv_id",
        "chunk",
        "part",
        F.length("formatted").alias("chars"),
        let(read_turns(F.col("formatted")), lambda t: F.struct(F.size(t).alias("n"), F.array_join(F.transform(t, lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), "").alias("text"))).alias("turns"),
        read_loss(F.col("formatted"), F.col("loss_spans")).alias("loss"),
    )
    whole = read.groupBy("conv_id").agg(
        F.sum("turns.n").alias("n_turns"),
        F.sum("chars").alias("formatted_chars"),
        F.sort_array(F.collect_list(F.struct("chunk", "part", F.col("turns.text").alias("text"), "loss"))).alias("c"),
    )
    joined = lambda f: F.array_join(F.transform("c", lambda x: x[f]), "")
    sha = lambda c: F.sha2(c.cast("binary"), 256)
    return whole.select(
        "conv_id", "n_turns", sha(joined("text")).alias("turns_sha256"),
        F.length(joined("loss")).cast("long").alias("loss_chars"), sha(joined("loss")).alias("loss_sha256"), "formatted_chars",
    )
