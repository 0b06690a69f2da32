"""Chat formatting with prefix-target expansion.

A conversation becomes ``<s>role\\ntext\\n</s>`` for each turn, one after the other.  Control
strings inside texts (and roles) get one more backslash in front; taking one away gives the text
back.  Template marks follow a line feed or the start, never a backslash, so they can't be confused.

Every assistant turn becomes an example: all turns before it are its context, only its reply is
trainable.  The examples of a conversation share one formatted string and differ in where
context and reply end, so ``spans`` is linear in the conversation; ``expand`` cuts the strings.
All of it is SQL functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Control strings that texts must not contain bare.
CONTROL = r"(?:</?s>|\[/?INST\]|<</?SYS>>)"
OPEN, CLOSE = "<s>", "\n</s>"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, rf"(\\*{CONTROL})", r"\\$1")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, rf"\\(\\*{CONTROL})", "$1")


def _role_out(role: Column) -> Column:
    return escape(F.replace(F.replace(role, F.lit("%"), F.lit("%25")), F.lit("\n"), F.lit("%0A")))


def _role_in(role: Column) -> Column:
    return F.replace(F.replace(unescape(role), F.lit("%0A"), F.lit("\n")), F.lit("%25"), F.lit("%"))


def formatted(turns: DataFrame, id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", trainable: str = "assistant") -> DataFrame:
    """(conv_id, formatted, spans) for each conversation.

    spans: for each turn of the trainable role, its example_no from 0, target_turn from 0,
    context_end, target_start and target_end, in code points of ``formatted``.  Turns go by turn,
    role, text, nulls first; null role or text: empty; rows that repeat are turns of their own; rows
    of a null id are one conversation.  No trainable turn: no spans.  Empty input: no rows.  Other
    columns are ignored.
    """
    plain = turns.select(F.col(id).cast("long").alias("conv_id"), F.col(turn).cast("long").alias("turn"), F.coalesce(F.col(role).cast("string"), F.lit("")).alias("role"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    head = F.concat(F.lit(OPEN), _role_out(F.col("role")), F.lit("\n"))
    piece = plain.select("conv_id", "turn", "role", "text", head.alias("head"), escape(F.col("text")).alias("body"))
    piece = piece.withColumn("size", (F.length("head") + F.length("body") + len(CLOSE)).cast("long"))
    w = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    piece = piece.withColumn("no", F.row_number().over(w) - 1).withColumn("end", F.sum("size").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    start = F.col("end") - F.col("size")
    span = F.struct(F.col("no").alias("target_turn"), start.alias("context_end"), (start + F.length("head")).alias("target_start"), (F.col("end") - len(CLOSE)).alias("target_end"))
    grouped = piece.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("no", F.concat("head", "body", F.lit(CLOSE)).alias("s")))).alias("pieces"), F.sort_array(F.collect_list(F.when(F.col("role") == trainable, span))).alias("spans"))
    return grouped.select("conv_id", F.array_join(F.transform("pieces", lambda p: p["s"]), "").alias("formatted"), F.transform("spans", lambda s, i: s.withField("example_no", i)).alias("spans"))


def completions(text: Column | str, spans: Column | str) -> Column:
    """The reply that each span makes trainable (escaped), in the order of turns: what the loss mask covers."""
    whole = F.col(text) if isinstance(text, str) else text
    return F.transform(spans, lambda s: F.substring(whole, s["target_start"].cast("int") + 1, (s["target_end"] - s["target_start"]).cast("int")))


def expanded(text: Column | str, spans: Column | str, read) -> Column:
    """read(prompt, completion) of each example, in the order of turns: every prefix with its target is made, one after the
    other, and only what is read of it stays in the row."""
    whole = F.col(text) if isinstance(text, str) else text
    cut = lambda a, b: F.substring(whole, a.cast("int") + 1, (b - a).cast("int"))
    return F.transform(spans, lambda s: read(F.substring(whole, F.lit(1), s["target_start"].cast("int")), cut(s["target_start"], s["target_end"])))


def examples(chats: DataFrame, expand: bool = True) -> DataFrame:
    """One row for each example of what ``formatted`` returned: conv_id, the span's fields and
    completion (escaped); with ``expand`` also prompt, whose total is quadratic in a conversation."""
    out = chats.select("conv_id", "formatted", F.explode("spans").alias("s")).select("conv_id", "formatted", "s.*")
    cut = lambda a, b: F.substring("formatted", F.col(a).cast("int") + 1 if isinstance(a, str) else F.lit(1), (F.col(b) - F.col(a) if isinstance(a, str) else F.col(b)).cast("int"))
    out = out.withColumn("completion", cut("target_start", "target_end"))
    return out.withColumn("prompt", cut(0, "target_start")).drop("formatted") if expand else out.drop("formatted")


def turns_of(text: Column) -> Column:
    """Read a formatted conversation back: its turns as (role, text)."""
    pieces = F.filter(F.split(text, CLOSE), lambda p: p != "")
    inside = F.transform(pieces, lambda p: F.substring(p, F.lit(len(OPEN) + 1), F.length(p)))
    return F.transform(inside, lambda p: F.struct(_role_in(F.substring_index(p, "\n", 1)).alias("role"), unescape(F.substring(p, F.instr(p, "\n") + 1, F.length(p))).alias("text")))
