"""Chat formatting by a grammar round trip, with SQL functions only.

Grammar of a formatted conversation (no separators, nothing before or after the turns):

    conversation := turn*
    turn         := "[INST]" role "\\n" text "[/INST]"      (every role but assistant)
                  | "<s>" text "</s>"                        (assistant: the text is under the loss mask)

`role` holds no newline, and neither part holds one of the four control strings.  Every turn is rendered as it is,
read back by the parser and compared with its source.  Where the two differ, or a control string stands inside, the
turn is rendered again with escapes: a backslash after the first character of each control string (and of each
control string that already has backslashes there), `%` and newline of a role as `%25` and `%0A`.  The parser always
undoes one level, so clean text is left as it is and both kinds read back alike.  The whole conversation is parsed
once more; a conversation that does not come back stops the job.

Nulls: a null role or text is the empty string, a null conv_id is a conversation of its own.  Turns are ordered by
(turn, role, text), null turns first; repeated rows are repeated turns.  An empty table gives an empty result, extra
columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

TURN = r"(?s)\[INST\].*?\[/INST\]|<s>.*?</s>"
CONTROL = r"</?s>|\[/?INST\]"


def escape(text: Column) -> Column:
    text = F.regexp_replace(text, r"<(\\*/?s>)", r"<\\$1")
    return F.regexp_replace(text, r"\[(\\*/?INST\])", r"[\\$1")


def unescape(text: Column) -> Column:
    text = F.regexp_replace(text, r"<\\(\\*/?s>)", r"<$1")
    return F.regexp_replace(text, r"\[\\(\\*/?INST\])", r"[$1")


def escape_role(role: Column) -> Column:
    return escape(F.replace(F.replace(role, F.lit("%"), F.lit("%25")), F.lit("\n"), F.lit("%0A")))


def unescape_role(role: Column) -> Column:
    return F.replace(F.replace(unescape(role), F.lit("%0A"), F.lit("\n")), F.lit("%25"), F.lit("%"))


def render(role: Column, text: Column, assistant: Column) -> Column:
    return F.when(assistant, F.concat(F.lit("<s>"), text, F.lit("</s>"))).otherwise(
        F.concat(F.lit("[INST]"), role, F.lit("\n"), text, F.lit("[/INST]"))
    )


def parse_turn(segment: Column) -> Column:
    """struct<role, text> of one turn that the turn pattern matched."""
    body = F.substring(segment, F.lit(7), F.greatest(F.char_length(segment) - 13, F.lit(0)))
    role = F.substring_index(body, "\n", 1)
    said = F.substring(segment, F.lit(4), F.greatest(F.char_length(segment) - 7, F.lit(0)))
    is_assistant = F.startswith(segment, F.lit("<s>"))
    return F.struct(
        F.when(is_assistant, F.lit("assistant")).otherwise(unescape_role(role)).alias("role"),
        unescape(
            F.when(is_assistant, said).otherwise(
                F.substring(body, F.char_length(role) + 2, F.char_length(body))
            )
        ).alias("text"),
    )


def parse(formatted: Column) -> Column:
    """array<struct<role, text>>: the turns of a formatted conversation, null where anything stands between them."""
    segments = F.regexp_extract_all(formatted, F.lit(TURN), F.lit(0))
    return F.when(F.array_join(segments, "") == formatted, F.transform(segments, parse_turn))


def format_conversations(conversations: DataFrame, assistant_role: str = "assistant") -> DataFrame:
    """conv_id, formatted, loss_spans array<struct<start, length>> (code points of `formatted`), escaped_turns.

    Turns are rendered row by row before they are grouped, so the work per turn is spread; a conversation itself
    becomes one string, as its format demands.
    """
    role = F.coalesce(F.col("role").cast("string"), F.lit(""))
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    turns = conversations.select(
        "conv_id", F.col("turn").alias("_turn"), role.alias("_role"), text.alias("_text"),
        (role == assistant_role).alias("_loss"),
    )
    raw = render(F.col("_role"), F.col("_text"), F.col("_loss"))
    source = F.array(F.struct(
        F.when(F.col("_loss"), F.lit("assistant")).otherwise(F.col("_role")).alias("role"), F.col("_text").alias("text")
    ))
    clean = (
        F.coalesce(parse(F.col("_raw")) == source, F.lit(False))
        & ~F.rlike(F.col("_role"), F.lit(CONTROL)) & ~F.rlike(F.col("_text"), F.lit(CONTROL))
    )
    safe = render(escape_role(F.col("_role")), escape(F.col("_text")), F.col("_loss"))
    rows = (
        turns.withColumn("_raw", raw).withColumn("_clean", clean)
        .withColumn("_segment", F.when(F.col("_clean"), F.col("_raw")).otherwise(safe))
        .drop("_raw")
    )
    order = Window.partitionBy("conv_id").orderBy("_turn", "_role", "_text").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("_at", F.coalesce(F.sum(F.char_length("_segment")).over(order), F.lit(0)))
    turn = F.struct("_at", "_turn", "_role", "_text", "_loss", "_clean", "_segment")
    whole = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("_turns"))
    spans = F.transform(
        F.filter("_turns", lambda t: t["_loss"]),
        lambda t: F.struct(
            (t["_at"] + 3).alias("start"), (F.char_length(t["_segment"]) - 7).cast("bigint").alias("length")
        ),
    )
    whole = whole.select(
        "conv_id",
        F.array_join(F.transform("_turns", lambda t: t["_segment"]), "").alias("formatted"),
        spans.alias("loss_spans"),
        F.size(F.filter("_turns", lambda t: ~t["_clean"])).cast("bigint").alias("escaped_turns"),
        F.transform("_turns", lambda t: F.struct(
            F.when(t["_loss"], F.lit("assistant")).otherwise(t["_role"]).alias("role"), t["_text"].alias("text")
        )).alias("_source"),
    )
    same = F.coalesce(parse(F.col("formatted")) == F.col("_source"), F.lit(False))
    checked = F.when(same, F.col("formatted")).otherwise(
        F.raise_error(F.concat(F.lit("conversation does not read back: "), F.col("conv_id").cast("string")))
    )
    return whole.select("conv_id", checked.alias("formatted"), "loss_spans", "escaped_turns")


def read_back(formatted: DataFrame) -> DataFrame:
    """Digests from the formatted text and its loss mask alone."""
    turns = formatted.withColumn("_back", parse(F.col("formatted")))
    all_turns = F.array_join(F.transform("_back", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    said = F.array_join(F.transform(F.filter("_back", lambda t: t["role"] == "assistant"), lambda t: t["text"]), "")
    return turns.select(
        "conv_id",
        F.size("_back").cast("bigint").alias("n_turns"),
        F.sha2(all_turns, 256).alias("turns_sha256"),
        F.char_length(said).cast("bigint").alias("loss_chars"),
        F.sha2(said, 256).alias("loss_sha256"),
        F.char_length("formatted").cast("bigint").alias("formatted_chars"),
        "escaped_turns",
        F.size("loss_spans").cast("bigint").alias("loss_spans"),
    )
