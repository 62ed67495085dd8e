"""Chat formatting with Spark expressions only.

The turns of a conversation are collected as structs, sorted, cut into runs of one
role, and joined into one text::

    ### assistant:
    first text
    <turn/>
    second text by the same role
    </turn>

Adjacent turns of one role become one block; ``<turn/>`` keeps them apart for reading
back. Inside texts and roles a backslash is put before every backslash, ``###``,
``<turn/`` and ``</turn``, so the marks between texts, whose ``<`` follows a line break,
occur nowhere else, and the text is read back by splitting and unescaping. In a
role, colons and line breaks are escaped too.

Defined results: a null text or role is empty; a null turn number sorts first; turns
with equal numbers sort by role, then text; repeated rows are turns of their own; rows
with a null conversation form one conversation; an empty table gives no rows. A
conversation is one training example, so its turns meet in one row; everything done
with them is linear in their text, but for the list of offsets, which is copied once
per turn. Conversations beyond 2 GB of text, Spark's limit for a value, fail.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

END, NEXT = "\n</turn>\n", "\n<turn/>\n"
_MARKS = r"\\|###|<turn/|</turn"
_ROLE_MARKS = rf"{_MARKS}|:|\n"


def escape(text: Column, marks: str = _MARKS) -> Column:
    return F.regexp_replace(text, f"({marks})", r"\\$1")


def unescape(text: Column, marks: str = _MARKS) -> Column:
    return F.regexp_replace(text, rf"\\({marks})", "$1")


def format_conversations(turns: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """``conv_id``, ``formatted`` and ``loss_spans``: the (start, length) in code points
    of every assistant text inside ``formatted``, in order."""
    src = turns.select(
        F.col(conv_id).alias("conv_id"),
        F.struct(
            F.col(turn).alias("turn"),
            F.coalesce(F.col(role).cast("string"), F.lit("")).alias("role"),
            F.coalesce(F.col(text), F.lit("")).alias("text"),
        ).alias("t"),
    )
    got = src.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("ts"))
    n = F.size("ts")
    starts = F.filter(F.sequence(F.lit(0), n - 1), lambda i: (i == 0) | (F.get("ts", i)["role"] != F.get("ts", i - 1)["role"]))
    got = got.withColumn("starts", starts)
    # one struct for each run of a role: its role and its texts
    runs = F.transform("starts", lambda s, k: F.struct(
        F.get("ts", s)["role"].alias("role"),
        F.transform(F.slice("ts", s + 1, F.coalesce(F.get("starts", k + 1), n) - s), lambda t: escape(t["text"])).alias("texts"),
    ))
    got = got.select("conv_id", runs.alias("runs"))
    head = lambda r: F.concat(F.lit("### "), escape(r["role"], _ROLE_MARKS), F.lit(":\n"))
    block = lambda r: F.concat(head(r), F.array_join(r["texts"], NEXT), F.lit(END))
    # for each text: characters before it since the last text ended, its length, whether it counts
    pieces = F.flatten(F.transform("runs", lambda r, k: F.transform(r["texts"], lambda x, j: F.struct(
        F.when(j > 0, F.lit(len(NEXT))).otherwise(F.length(head(r)) + F.when(k > 0, F.lit(len(END))).otherwise(F.lit(0))).alias("gap"),
        F.length(x).alias("len"),
        (F.lower(r["role"]) == "assistant").alias("loss"),
    ))))
    got = got.select("conv_id", F.array_join(F.transform("runs", block), "").alias("formatted"), pieces.alias("pieces"))
    spans = F.aggregate(
        "pieces",
        F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,len:int>>").alias("spans")),
        lambda a, p: F.struct(
            (a["at"] + p["gap"] + p["len"]).alias("at"),
            F.when(p["loss"], F.concat(a["spans"], F.array(F.struct((a["at"] + p["gap"]).alias("start"), p["len"].alias("len"))))).otherwise(a["spans"]).alias("spans"),
        ),
        lambda a: a["spans"],
    )
    return got.select("conv_id", "formatted", spans.alias("loss_spans"))


def read_turns(formatted: Column) -> Column:
    """Array of (role, text) read back from a formatted conversation."""
    blocks = F.filter(F.split(formatted, END, -1), lambda b: b != "")
    return F.flatten(F.transform(blocks, lambda b: _block_turns(b)))


def _block_turns(b: Column) -> Column:
    end = F.instr(b, ":\n")  # in a role both signs have a backslash before them
    role = unescape(b.substr(F.lit(5), end - 5), _ROLE_MARKS)
    texts = F.split(b.substr(end + 2, F.length(b)), NEXT, -1)
    return F.transform(texts, lambda x: F.struct(role.alias("role"), unescape(x).alias("text")))


def read_loss(formatted: Column, spans: Column) -> Column:
    """All text under the loss mask, unescaped, nothing between."""
    return F.array_join(F.transform(spans, lambda s: unescape(F.substring(formatted, s["start"] + 1, s["len"]))), "")
