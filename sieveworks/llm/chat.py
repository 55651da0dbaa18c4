"""Chat formatting by prefix-target expansion.

Every assistant turn becomes an example of its own: all preceding turns are context and that reply alone is trainable. A
conversation that does not end with a reply gets one more example without a trainable part, so that no turn is lost.

The template, after ``<s>``: ``[INST] text [/INST]`` for the user, ``[SYS] text [/SYS]`` for the system, ``[REPLY] text</s>``
for the assistant and ``[ROLE:hex] text [/ROLE]`` for any other role (its name in hexadecimal UTF-8). A control string inside
a text gets a backslash after its first character, and one that has some there gets one more; taking one away restores it.

Only DataFrame functions are used. Turns of a conversation meet once, by its id; the second grouping finds them in place. An
example holds all that precedes its reply, so output grows with the square of a conversation's turns, as the method says.

Cases: rows go by turn, ties by role and text; a null turn comes last; a null text or role is empty; rows with a null
conversation id are one conversation; repeated rows are turns of their own; extra columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Tags of the roles that the template names.
TAGS = {"user": "INST", "system": "SYS", "assistant": "REPLY"}
_CONTROL = r"(s>|/s>|INST\]|/INST\]|SYS\]|/SYS\]|REPLY\]|ROLE:|/ROLE\])"
_PLAIN = rf"([<\[])(\\*){_CONTROL}"
_ESCAPED = rf"([<\[])\\(\\*){_CONTROL}"
_TURN = r"(?s)\[(INST|SYS|REPLY|ROLE:[0-9A-F]*)\] (.*?)(?: \[/(?:INST|SYS|ROLE)\]|</s>)"


def escape(text: Column) -> Column:
    """The text without control strings."""
    return F.regexp_replace(text, _PLAIN, r"$1\\$2$3")


def unescape(text: Column) -> Column:
    """What ``escape`` was given."""
    return F.regexp_replace(text, _ESCAPED, "$1$2$3")


def expand(turns: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """``conv_id, example int, last boolean, formatted string, loss_start int, loss_end int``.

    Offsets count code points, the end is exclusive; both are null in an example without a trainable part.
    """
    name = F.coalesce(turns[role].cast("string"), F.lit(""))
    body = escape(F.coalesce(turns[text].cast("string"), F.lit("")))
    tag = F.coalesce(*[F.when(name == k, F.lit(v)) for k, v in TAGS.items()], F.concat(F.lit("ROLE:"), F.hex(name)))
    opening = F.concat(F.lit("["), tag, F.lit("] "))
    closing = F.when(name == "assistant", "</s>").otherwise(F.concat(F.lit(" [/"), F.split(tag, ":")[0], F.lit("]")))
    marked = turns.select(
        turns[conv_id].alias("conv_id"),
        F.struct(
            turns[turn].isNull().alias("late"), turns[turn].alias("turn"), name.alias("role"), F.coalesce(turns[text].cast("string"), F.lit("")).alias("text"),
            F.concat(opening, body, closing).alias("said"), F.length(opening).alias("before"), F.length(body).alias("size"), F.length(closing).alias("behind"),
        ).alias("t"),
    )
    whole = marked.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("t"))
    numbered = "transform(t, (x, i) -> named_struct('x', x, 'n', i + 1))"
    targets = F.expr(f"transform(filter({numbered}, p -> p.x.role = 'assistant' or p.n = size(t)), p -> p.n)")
    each = whole.select("conv_id", "t", F.explode(targets).alias("n"))
    made = each.select("conv_id", "n", (F.col("n") == F.size("t")).alias("last"), F.expr("t[n - 1]").alias("target"), F.expr("concat('<s>', array_join(transform(slice(t, 1, n), x -> x.said), ''))").alias("formatted"))
    end = F.when(F.col("target.role") == "assistant", F.length("formatted") - F.col("target.behind"))
    return made.select("conv_id", F.col("n").alias("example"), "last", "formatted", (end - F.col("target.size")).alias("loss_start"), end.alias("loss_end"))


def trainable(formatted: str = "formatted", start: str = "loss_start", end: str = "loss_end") -> Column:
    """The unescaped text under an example's loss mask; null without one."""
    return unescape(F.expr(f"substring({formatted}, {start} + 1, {end} - {start})"))


def turns_of(formatted: str = "formatted") -> Column:
    """The turns that an example holds, read back: array of struct<role, text>."""
    pattern = "'" + _TURN.replace("\\", "\\\\") + "'"
    names = "case " + " ".join(f"when tag = '{v}' then '{k}'" for k, v in TAGS.items()) + " else decode(unhex(substring(tag, 6)), 'UTF-8') end"
    plain = "regexp_replace(x, '" + _ESCAPED.replace("\\", "\\\\") + "', '$1$2$3')"
    return F.expr(f"zip_with(regexp_extract_all({formatted}, {pattern}, 1), regexp_extract_all({formatted}, {pattern}, 2), (tag, x) -> named_struct('role', {names}, 'text', {plain}))")


def read_back(examples: DataFrame) -> DataFrame:
    """Per conversation, from the output of ``expand``: number and digest of its turns, its trainable text, characters made."""
    turn_text = F.array_join(F.transform(turns_of(), lambda t: F.concat(t.role, F.lit("\n"), t.text, F.lit("\n"))), "")
    one = examples.select("conv_id", "example", F.length("formatted").alias("size"), trainable().alias("loss"), F.when(F.col("last"), F.struct(F.size(turns_of()).alias("n"), F.sha2(turn_text, 256).alias("digest"))).alias("turns"))
    found = one.groupBy("conv_id").agg(F.max("turns").alias("turns"), F.array_sort(F.collect_list(F.when(F.col("loss").isNotNull(), F.struct("example", "loss")))).alias("losses"), F.sum("size").alias("formatted_chars"))
    loss = F.array_join(F.transform("losses", lambda x: x.loss), "")
    return found.select("conv_id", F.col("turns.n").cast("long").alias("n_turns"), F.col("turns.digest").alias("turns_sha256"), F.length(loss).cast("long").alias("loss_chars"), F.sha2(loss, 256).alias("loss_sha256"), F.col("formatted_chars").cast("long").alias("formatted_chars"))
