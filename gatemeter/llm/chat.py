"""Chat formatting with prefix-target expansion, in DataFrame functions only.

Each conversation becomes one transcript whose every turn is wrapped in control strings;
control strings inside texts are escaped by a backslash after their first character (one
more if some stand there), so texts read back exactly. Every assistant turn is an example of
its own: all turns before it are its context and only its reply is under the loss.

Written out, the examples of a conversation repeat their contexts, with the square of its
turns. ``format_conversations`` keeps, for each example, only its *piece*: what the
transcript holds after the example before it, up to the end of its own reply. An example's
text is the opening mark and all pieces up to its own. ``examples`` explodes them, one row per
assistant turn; with ``with_text`` each row holds its whole text, else its piece. Texts are
written out row by row after the explosion, so a task holds one of them at a time. The query
reads its digests back from whole texts.

Defined results: null texts and roles count as empty; turns go by (turn, role, text), nulls
first, so ties and repeated rows all stand; a null conv_id is a conversation of its own; a
conversation without assistant turns has a transcript and no examples; an empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

BOS = "<s>"
#: role -> (before, after); any other role is written out between ROLE marks.
MARKS = {"system": ("[SYS] ", " [/SYS]"), "user": ("[INST] ", " [/INST]"), "assistant": ("[OUT] ", "</s>")}
OTHER = ("[ROLE] ", "[/ROLE]", "[/TURN]")
_CONTROL = r"(/?(?:s>|(?:SYS|INST|OUT|ROLE|TURN)\]))"
ESCAPE = (r"([<\[])(\\*)" + _CONTROL, r"$1\\$2$3")
UNESCAPE = (r"([<\[])\\(\\*)" + _CONTROL, r"$1$2$3")
_TURN = r"(?s)\[SYS\] .*? \[/SYS\]|\[INST\] .*? \[/INST\]|\[OUT\] .*?</s>|\[ROLE\] .*?\[/ROLE\].*?\[/TURN\]"


def escape(c: Column) -> Column:
    return F.regexp_replace(c, *(F.lit(x) for x in ESCAPE))


def unescape(c: Column) -> Column:
    return F.regexp_replace(c, *(F.lit(x) for x in UNESCAPE))


def _before(role: Column) -> Column:
    known = F.when(role == "system", MARKS["system"][0]).when(role == "user", MARKS["user"][0]).when(role == "assistant", MARKS["assistant"][0])
    return known.otherwise(F.concat(F.lit(OTHER[0]), escape(role), F.lit(OTHER[1])))


def _after(role: Column) -> Column:
    return F.when(role == "system", MARKS["system"][1]).when(role == "user", MARKS["user"][1]).when(role == "assistant", MARKS["assistant"][1]).otherwise(OTHER[2])


def _with(value: Column, made: Callable[[Column], Column]) -> Column:
    """made(value), where the value is worked out once however often it is used."""
    return F.element_at(F.transform(F.array(value), made), 1)


def format_conversations(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """conv_id, examples: array of (example, piece, loss_start, loss_end), rest: what follows the last.

    Offsets are code points of the piece from 0, ends exclusive.
    """
    row = F.struct(F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    grouped = turns.groupBy(F.col(conv).alias("conv_id")).agg(F.sort_array(F.collect_list(row)).alias("turns"))

    def cut(all_: Column) -> Column:
        own, shown, last = all_["turns"], all_["shown"], all_["replies"]

        def example(at: Column, k: Column) -> Column:
            first = F.when(k > 0, F.get(last, k - 1) + 1).otherwise(0)
            piece = F.array_join(F.slice(shown, first + 1, at - first + 1), "")
            body, tail = F.length(escape(F.get(own, at)["text"])), len(MARKS["assistant"][1])
            return _with(F.struct(piece.alias("piece"), body.alias("body")), lambda x: F.struct(
                k.alias("example"), x["piece"].alias("piece"), (F.length(x["piece"]) - tail - x["body"]).alias("loss_start"), (F.length(x["piece"]) - tail).alias("loss_end"),
            ))

        done = F.when(F.size(last) > 0, F.element_at(last, -1) + 1).otherwise(0)
        return F.struct(F.transform(last, example).alias("examples"), F.array_join(F.slice(shown, done + 1, F.size(shown) - done), "").alias("rest"))

    shown = F.transform("turns", lambda x: F.concat(_before(x["role"]), escape(x["text"]), _after(x["role"])))
    replies = F.filter(F.transform("turns", lambda x, i: F.when(x["role"] == "assistant", i)), lambda i: i.isNotNull())
    made = _with(F.struct("turns", shown.alias("shown"), replies.alias("replies")), cut)
    return grouped.select("conv_id", made.alias("made")).select("conv_id", "made.examples", "made.rest")


def transcript() -> Column:
    """The whole transcript of a formatted conversation."""
    return F.concat(F.lit(BOS), F.array_join(F.transform("examples", lambda e: e["piece"]), ""), F.col("rest"))


def _written(formatted: DataFrame, explode: Callable[[Column], Column]) -> DataFrame:
    """conv_id, example, loss_start, loss_end, text, last (whether it is the last example), rest.

    With an outer explosion a conversation without examples has one row: the opening mark and its rest.
    """
    # generated code would hold all rows of an explosion at once; over a lambda's result Spark makes them one by one
    spans = F.transform("examples", lambda e: F.struct(e["example"].alias("example"), e["loss_start"].alias("loss_start"), e["loss_end"].alias("loss_end"), F.length(e["piece"]).alias("chars")))
    rows = formatted.select("conv_id", "rest", F.col("examples.piece").alias("pieces"), explode(spans))
    taken = F.coalesce(F.col("example") + 1, F.lit(0))
    rows = rows.select("*", F.concat(F.lit(BOS), F.array_join(F.slice("pieces", 1, taken), "")).alias("text"))
    shift = F.length("text") - F.col("chars")
    return rows.select("conv_id", "example", (F.col("loss_start") + shift).alias("loss_start"), (F.col("loss_end") + shift).alias("loss_end"), "text", (taken == F.size("pieces")).alias("last"), "rest")


def examples(formatted: DataFrame, with_text: bool = True) -> DataFrame:
    """One row per assistant turn: conv_id, example, loss_start, loss_end and its text, or its piece.

    The text ends with the reply; the loss span counts code points of the text, or of the piece.
    """
    if not with_text:
        return formatted.select("conv_id", F.inline("examples"))
    return _written(formatted, F.inline).select("conv_id", "example", "loss_start", "loss_end", "text")


def read_turns(transcript: Column) -> Column:
    """The (role, text) of each turn of a transcript."""

    def turn(m: Column) -> Column:
        cut = lambda before, after: F.substring(m, F.lit(len(before) + 1), F.length(m) - len(before) - len(after))
        role, text = F.element_at(F.split(cut(OTHER[0], OTHER[2]), r"\[/ROLE\]", 2), 1), F.element_at(F.split(cut(OTHER[0], OTHER[2]), r"\[/ROLE\]", 2), 2)
        for name, (before, after) in MARKS.items():
            role = F.when(m.startswith(before), F.lit(name)).otherwise(role)
            text = F.when(m.startswith(before), cut(before, after)).otherwise(text)
        return F.struct(unescape(role).alias("role"), unescape(text).alias("text"))

    return F.transform(F.regexp_extract_all(transcript, F.lit(_TURN), F.lit(0)), turn)


def query(turns: DataFrame) -> DataFrame:
    """What the written examples of the conversations say, read back from their texts, with conversation -7 added."""
    said = turns.sparkSession.sql(
        "SELECT * FROM VALUES (-7L, 0L, 'user', '</s>[INST] ok [/INST]'), (-7L, 1L, 'assistant', '</s>[INST] ok [/INST]') AS t(conv_id, turn, role, text)"
    )
    return _read_back(_written(format_conversations(turns.select("conv_id", "turn", "role", "text").unionByName(said)), F.inline_outer))


def _read_back(written: DataFrame) -> DataFrame:
    """Turns from the text of the last example and the rest after it, replies from each text by its loss span."""
    whole = F.concat("text", "rest")
    back = written.select(
        "conv_id", "example", "loss_start", unescape(F.expr("substring(text, loss_start + 1, loss_end - loss_start)")).alias("loss"),
        F.when(F.col("last"), F.length(whole)).alias("chars"), F.when(F.col("last"), read_turns(whole)).alias("turns"),
    )
    told = F.array_join(F.transform("turns", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), "")
    row = F.struct("example", "loss")
    joined = back.withColumn("told", F.when(F.col("turns").isNotNull(), F.sha2(told, 256))).groupBy("conv_id").agg(
        F.max(F.when(F.col("turns").isNotNull(), F.size("turns"))).cast("long").alias("n_turns"), F.max("told").alias("told"),
        F.array_join(F.transform(F.sort_array(F.collect_list(row)), lambda x: x["loss"]), "").alias("loss"),
        F.max("chars").cast("long").alias("chars"), F.count("example").alias("n_examples"), F.coalesce(F.sum("loss_start"), F.lit(0)).cast("long").alias("context_chars"),
    )
    return joined.select(
        "conv_id", "n_turns", F.col("told").alias("turns_sha256"), F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"),
        F.col("chars").alias("formatted_chars"), "n_examples", "context_chars",
    )


ORACLE = r"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
e AS (SELECT *, length(regexp_replace(text, '([<\[])(\\*)(/?(?:s>|(?:SYS|INST|OUT|ROLE|TURN)\]))', '\1\\\2\3', 'g'))
  + CASE role WHEN 'system' THEN 13 WHEN 'user' THEN 15 WHEN 'assistant' THEN 10 ELSE 21
    + length(regexp_replace(role, '([<\[])(\\*)(/?(?:s>|(?:SYS|INST|OUT|ROLE|TURN)\]))', '\1\\\2\3', 'g')) END AS shown FROM t),
c AS (SELECT *, coalesce(sum(shown) OVER (PARTITION BY conv_id ORDER BY turn, role, text ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM e)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(3 + sum(shown) AS BIGINT) AS formatted_chars, count(*) FILTER (role = 'assistant') AS n_examples,
  CAST(coalesce(sum(3 + before + 6) FILTER (role = 'assistant'), 0) AS BIGINT) AS context_chars
FROM c GROUP BY conv_id"""
