"""Chat formatting by grammar round trip. DataFrame functions only.

The grammar of a formatted conversation::

    conversation = turn*
    turn         = "<|im_start|>" name LF body "<|im_end|>" LF

``name`` and ``body`` hold neither control string. They are read with one escape: of a ``<``, one or more backslashes and a ``|`` one
backslash goes, and ``<|lf|>`` in a name is a line feed. A turn is first written as it is and read back by the same parser; where that
does not give the turn again (it holds a control string, or what looks like an escape), every ``<``, backslashes, ``|`` in it gets one
backslash more. Whole conversations are then reparsed and compared with their source, and escaped in full should they differ. What
reaches the output has been read back identical; anything else is an error.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelstone.llm.common import pick

# The control strings of the template.
START, END, LINE = "<|im_start|>", "<|im_end|>", "<|lf|>"
_CLOSE = END + "\n"


def escaped(text: Column) -> Column:
    """One backslash more in every ``<``, backslashes, ``|``: no control string is left."""
    return F.regexp_replace(text, r"<(\\*)\|", r"<$1\\|")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\\\|", r"<$1|")


def _turn(name: Column, body: Column) -> Column:
    return F.concat(F.lit(START), name, F.lit("\n"), body, F.lit(_CLOSE))


def _read_turn(part: Column) -> Column:
    """Name, body as written and body read, of what follows a start mark; null if it is not a turn."""
    body = F.substring(part, F.locate("\n", part) + 1, F.char_length(part))
    body = F.substring(body, F.lit(1), F.char_length(body) - len(_CLOSE))
    name = F.substring_index(part, "\n", 1)
    end = F.locate(END, part)
    fine = F.locate("\n", part).between(F.lit(1), end - 1) & part.endswith(_CLOSE) & (end == F.char_length(part) - len(_CLOSE) + 1)
    return F.when(
        fine,
        F.struct(unescaped(F.replace(name, F.lit(LINE), F.lit("\n"))).alias("name"), body.alias("raw"), unescaped(body).alias("body")),
    )


def parsed(text: Column) -> Column:
    """Deterministic parser: the turns (name, raw, body) of a formatted conversation; a part that is not a turn is null."""
    parts = F.split(text, r"<\|im_start\|>")
    return F.when(F.element_at(parts, 1) == "", F.transform(F.slice(parts, F.lit(2), F.size(parts)), _read_turn))


def _same(read: Column, source: Column) -> Column:
    """Are the turns read exactly those of the source?"""
    return F.coalesce(F.transform(read, lambda t: F.struct(t["name"].alias("name"), t["body"].alias("body"))) == source, F.lit(False))


def format_chat(
    turns: DataFrame, *, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", trained: str = "assistant"
) -> DataFrame:
    """``conv_id, formatted, loss_spans``: one row per conversation, its text and the code points (start, end exclusive) to be trained on.

    Trained on are the bodies of the turns named ``trained``. Turns follow their turn number, equal ones their role and text. A null
    role or text is empty, a null number comes first, rows without a conversation id form the conversation null, repeated rows are turns
    of their own; an empty table gives no row. A conversation is one text and so at most the 2 GB of a string; turns are written, read
    back and placed as rows, before anything is gathered.
    """
    rows = pick(turns, conv=conv_col, turn=turn_col, name=role_col, body=text_col).select(
        "conv", "turn", F.coalesce(F.col("name").cast("string"), F.lit("")).alias("name"), F.coalesce(F.col("body"), F.lit("")).alias("body")
    )
    # Control strings cannot form across the marks of a turn: what holds for turns alone holds for their conversation.
    fits = _same(parsed(_turn(F.col("name"), F.col("body"))), F.array(F.struct("name", "body")))
    rows = rows.withColumn("fits", fits).withColumns(
        {
            "head": F.when(F.col("fits"), F.col("name")).otherwise(F.replace(escaped(F.col("name")), F.lit("\n"), F.lit(LINE))),
            "raw": F.when(F.col("fits"), F.col("body")).otherwise(escaped(F.col("body"))),
        }
    )
    rows = rows.withColumn("written", _turn(F.col("head"), F.col("raw")))
    before = Window.partitionBy("conv").orderBy("turn", "name", "body").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("place", F.coalesce(F.sum(F.char_length("written").cast("long")).over(before), F.lit(0).cast("long")))
    start = F.col("place") + len(START) + F.char_length("head") + 1
    rows = rows.withColumn("span", F.struct(start.alias("start"), (start + F.char_length("raw")).alias("end")))
    whole = rows.groupBy("conv").agg(F.sort_array(F.collect_list(F.struct("place", "written", "name", "body", "span"))).alias("t"))
    whole = whole.select(
        "conv",
        F.array_join("t.written", "").alias("text"),
        F.transform("t", lambda t: F.struct(t["name"].alias("name"), t["body"].alias("body"))).alias("source"),
        F.transform(F.filter("t", lambda t: t["name"] == trained), lambda t: t["span"]).alias("loss_spans"),
    )
    held = _same(parsed(F.col("text")), F.col("source"))
    proven = F.when(held, F.col("text")).otherwise(F.raise_error(F.lit("a formatted conversation does not read back as its source")))
    return whole.select(F.col("conv").alias(conv_col), proven.alias("formatted"), "loss_spans")


def read_back(formatted: DataFrame, *, conv_col: str = "conv_id", trained: str = "assistant") -> DataFrame:
    """Counts and digests of what the parser reads in the output of ``format_chat``.

    The bodies under the loss mask must have the lengths of ``loss_spans``; otherwise the row is an error.
    """
    read = formatted.select(F.col(conv_col), "formatted", "loss_spans", parsed(F.col("formatted")).alias("turns"))
    read = read.withColumn("loss", F.filter("turns", lambda t: t["name"] == trained))
    masked = F.transform("loss_spans", lambda s: s["end"] - s["start"]) == F.transform("loss", lambda t: F.char_length(t["raw"]).cast("long"))
    said = F.array_join(F.transform("loss", lambda t: t["body"]), "")
    read = read.withColumn("said", F.when(masked, said).otherwise(F.raise_error(F.lit("the loss mask does not cover the trained turns"))))
    return read.select(
        conv_col,
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform("turns", lambda t: F.concat(t["name"], F.lit("\n"), t["body"], F.lit("\n"))), ""), 256).alias("turns_sha256"),
        F.char_length("said").cast("long").alias("loss_chars"),
        F.sha2("said", 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"),
    )
