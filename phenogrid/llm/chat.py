"""Chat formatting of typed content parts.

A turn is a list of parts: text, image, audio or document. Each kind has its own visit: text goes
in escaped, every other kind leaves a placeholder, an attachment record and the number of tokens
the placeholder stands for. The whole operator is DataFrame functions.

Template: ``<|turn|>`` role newline content ``<|end|>`` newline. Every control string starts with
``<``. In roles and texts ``&`` is written ``&amp;`` and ``<`` is written ``&lt;``; a line break in a
role is written ``&#10;``. So no content can form a control string, and reading back is exact.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OPEN, CLOSE = "<|turn|>", "<|end|>"
# Tokens that one unit of a part stands for: an image counts tiles, audio seconds, a document pages.
TOKENS_PER_UNIT = {"image": 256, "audio": 25, "document": 512}
PART = "struct<type:string,text:string,ref:string,units:double>"


def escape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))


def unescape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("&lt;"), F.lit("<")), F.lit("&amp;"), F.lit("&"))


def _role_out(role: Column) -> Column:
    return F.replace(escape(F.coalesce(role, F.lit(""))), F.lit("\n"), F.lit("&#10;"))


def _role_in(text: Column) -> Column:
    return unescape(F.replace(text, F.lit("&#10;"), F.lit("\n")))


def _visit(part: Column) -> Column:
    """(body, attachment or NULL, expanded tokens) of one part; unknown kinds count as text."""
    body, tokens = escape(F.coalesce(part["text"], F.lit(""))), F.lit(0).cast("long")
    for kind, each in TOKENS_PER_UNIT.items():
        here = part["type"].eqNullSafe(F.lit(kind))
        body = F.when(here, F.lit(f"<|{kind}|>")).otherwise(body)
        units = F.greatest(F.lit(1.0), F.ceil(F.coalesce(part["units"], F.lit(1.0))))
        tokens = F.when(here, (units * each).cast("long")).otherwise(tokens)
    attached = part["type"].isin(*TOKENS_PER_UNIT)
    return F.struct(
        body.alias("body"),
        F.when(attached, F.struct(part["type"].alias("type"), part["ref"].alias("ref"))).alias("attachment"),
        tokens.alias("tokens"),
    )


def text_part(text: Column) -> Column:
    """The parts of a turn that is plain text."""
    none = F.lit(None).cast("string")
    return F.array(
        F.struct(F.lit("text").alias("type"), text.alias("text"), none.alias("ref"), F.lit(None).cast("double").alias("units"))
    )


def format_chats(turns: DataFrame, conv: str, turn: str, role: str, parts: str, learn: tuple[str, ...] = ("assistant",)):
    """One row per conversation.

    Columns: ``conv``; ``n_turns``; ``segments``, the output in order as (text, loss) pieces, where
    loss marks what a model is trained on (the bodies of the roles in ``learn``); ``formatted``, the
    pieces joined; ``loss_spans``, (start, stop) of every learned piece in code points;
    ``attachments``, (type, ref, tokens) in the order of their placeholders; ``expanded_tokens``.

    ``parts`` is an array of ``type, text, ref, units``. NULL parts or an empty list are an empty
    text; a NULL role is the empty role; a NULL turn number comes first. Turns with the same
    number are ordered by role and content, and repeated rows are all kept. NULL conversation ids
    are one conversation. An empty table gives no rows; other columns are ignored. Rows are
    rendered before the shuffle; a conversation must fit in a row, as its output is one string.
    """
    seen = F.transform(F.coalesce(turns[parts], F.array().cast(f"array<{PART}>")), _visit)
    body = F.array_join(F.transform(seen, lambda p: p["body"]), "")
    files = F.transform(
        F.filter(seen, lambda p: p["attachment"].isNotNull()),
        lambda p: F.struct(p["attachment"]["type"].alias("type"), p["attachment"]["ref"].alias("ref"), p["tokens"].alias("tokens")),
    )
    one = turns.select(
        turns[conv].alias("_conv"),
        F.struct(
            turns[turn].alias("turn"),
            F.coalesce(turns[role], F.lit("")).alias("role"),
            body.alias("body"),
            files.alias("files"),
        ).alias("t"),
    )
    told = one.groupBy("_conv").agg(F.sort_array(F.collect_list("t")).alias("ts"))

    def pieces(t: Column) -> Column:
        head = F.concat(F.lit(OPEN), _role_out(t["role"]), F.lit("\n"))
        return F.array(
            F.struct(head.alias("text"), F.lit(False).alias("loss")),
            F.struct(t["body"].alias("text"), t["role"].isin(*learn).alias("loss")),
            F.struct(F.lit(CLOSE + "\n").alias("text"), F.lit(False).alias("loss")),
        )

    whole = told.select(
        "_conv",
        F.size("ts").cast("long").alias("n_turns"),
        F.flatten(F.transform("ts", pieces)).alias("segments"),
        F.flatten(F.transform("ts", lambda t: t["files"])).alias("attachments"),
    )
    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<long>").alias("ends"))
    ends = F.aggregate(
        F.transform("segments", lambda s: F.length(s["text"])),
        start,
        lambda acc, n: F.struct((acc["at"] + n).alias("at"), F.concat(acc["ends"], F.array(acc["at"] + n)).alias("ends")),
        lambda acc: acc["ends"],
    )
    spans = F.transform(
        F.filter(F.arrays_zip(F.col("segments"), ends.alias("stop")), lambda z: z["segments"]["loss"]),
        lambda z: F.struct((z["stop"] - F.length(z["segments"]["text"])).alias("start"), z["stop"].alias("stop")),
    )
    total = F.aggregate("attachments", F.lit(0).cast("long"), lambda a, f: a + f["tokens"])
    return whole.select(
        F.col("_conv").alias(conv),
        "n_turns",
        "segments",
        F.array_join(F.transform("segments", lambda s: s["text"]), "").alias("formatted"),
        spans.alias("loss_spans"),
        "attachments",
        total.alias("expanded_tokens"),
    )


def read_back(formatted: Column) -> Column:
    """Array of (role, text) of a formatted conversation whose parts are all text."""
    turns = F.filter(F.split(formatted, r"<\|turn\|>", -1), lambda x: x != "")

    def one(t: Column) -> Column:
        cut = F.locate("\n", t)
        rest = F.substring(t, cut + 1, F.length(t))
        return F.struct(
            _role_in(F.substring(t, F.lit(1), cut - 1)).alias("role"),
            unescape(F.substring(rest, F.lit(1), F.length(rest) - len(CLOSE + "\n"))).alias("text"),
        )

    return F.transform(turns, one)
