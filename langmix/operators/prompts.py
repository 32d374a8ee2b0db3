"""Prompt data from conversations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# --- fixed values -----------------------------------------------------------
USER, ASSISTANT = "user", "assistant"
Q_PREFIX, A_PREFIX = "Q: ", "A: "
# ---------------------------------------------------------------------------


#: turns whose pieces one task joins
STRETCH = 1000


def turns_to_prompt(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn",
                    role_col: str = "role", text_col: str = "text", extra: dict[str, Column] | None = None) -> DataFrame:
    """``Q: ...\\n`` per user turn, ``A: ...\\n\\n`` per assistant turn (other
    roles add nothing), ``A:`` appended when the last turn is the user's,
    newlines stripped at both ends.  Pieces are joined in two levels, first those of a
    stretch of turn numbers, then the stretches, so that no task sorts all turns of a
    long conversation.  ``extra``: further boolean columns, true if true in any turn."""
    piece = (F.when(F.col(role_col) == USER, F.concat(F.lit(Q_PREFIX), F.col(text_col), F.lit("\n")))
             .when(F.col(role_col) == ASSISTANT, F.concat(F.lit(A_PREFIX), F.col(text_col), F.lit("\n\n")))
             .otherwise(F.lit("")))
    extra = extra or {}
    flags = [F.max(c).alias(n) for n, c in extra.items()]
    part = F.floor(F.coalesce(turn_col, F.lit(-1)) / STRETCH)
    inner = turns.groupBy(conv_col, part.alias("_part")).agg(
        F.array_sort(F.collect_list(F.struct(F.col(turn_col).alias("t"), piece.alias("p"), F.col(role_col).alias("r")))).alias("_ts"), *flags)
    inner = inner.select(conv_col, "_part", F.array_join(F.transform("_ts", lambda x: x["p"]), "").alias("p"), F.element_at("_ts", -1)["r"].alias("r"), *extra)
    outer = inner.groupBy(conv_col).agg(F.array_sort(F.collect_list(F.struct("_part", "p", "r"))).alias("_ts"), *[F.max(n).alias(n) for n in extra])
    body = F.array_join(F.transform("_ts", lambda x: x["p"]), "")
    prompt = F.concat(body, F.when(F.element_at("_ts", -1)["r"] == USER, F.lit("A:")).otherwise(F.lit("")))
    return outer.select(conv_col, F.trim(prompt, F.lit("\n")).alias("prompt"), *extra)


def reply_pairs(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn",
                role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Each assistant reply paired with the last user message before it."""
    w = (Window.partitionBy(conv_col).orderBy(turn_col)
         .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    last_user = F.last(F.when(F.col(role_col) == USER, F.col(text_col)), ignorenulls=True).over(w)
    t = turns.select(conv_col, turn_col, role_col, text_col, last_user.alias("input_text"))
    return (t.filter((F.col(role_col) == ASSISTANT) & F.col("input_text").isNotNull())
            .select(conv_col, turn_col, "input_text", F.col(text_col).alias("output_text")))


def few_shot(turns: DataFrame, k: int = 1, conv_col: str = "conv_id", turn_col: str = "turn",
             role_col: str = "role", text_col: str = "text") -> DataFrame:
    """The first ``2k`` dialogue turns as examples plus the next turn as the
    question, rendered with C1, for every conversation; ``has_question`` tells
    whether turn ``2k + 1`` is there and is a user turn."""
    w = Window.partitionBy(conv_col).orderBy(turn_col)
    d = turns.filter(F.col(role_col).isin(USER, ASSISTANT)).withColumn("_pos", F.row_number().over(w))
    sel = d.filter(F.col("_pos") <= 2 * k + 1)
    asked = (F.col("_pos") == 2 * k + 1) & (F.col(role_col) == USER)
    return turns_to_prompt(sel, conv_col, turn_col, role_col, text_col, {"has_question": asked})
