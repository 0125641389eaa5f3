"""Multi-party chats from every speaker's side, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

#: Fixed values of the template: a turn is OPEN role [name=speaker] newline, text, CLOSE newline.
OPEN, CLOSE = "<|im_start|>", "<|im_end|>"
#: Turns whose lengths are added up in one window.
BLOCK_TURNS = 1024


def perspectives(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", speaker_col: str = "role", text_col: str = "text", system: str = "system") -> DataFrame:
    """The dialogue once for each participant, one row a turn: its part of the rendering, and what is trained on.

    (conv_id, perspective, position, turn, role, name, segment, mask, start, train_start, train_end): in the rendering for
    `perspective` that speaker's turns are the assistant's, all others' are users' with their names, and the
    system's stay; concatenating segment by position gives the whole. mask is 1 on the assistant's turns; of those
    [train_start, train_end) are the characters, counted in the whole rendering, of the text and the closing mark.

    Turns are in order of turn, speaker, text; those without a number come last, in order of a hash of speaker and text. A null
    speaker is called unknown, a null text is empty, a null conversation is one conversation. Marks within a text or a name are
    broken up by a space, and line breaks within a name are one, so neither can open a turn. Speakers
    other than the system are participants; a conversation of the system alone has none, and no rows. Repeated
    rows are turns of their own. Other columns aren't read; an empty table gives an empty result.

    A conversation may hold any share of all rows. It is never gathered: positions and starts are sums of three short
    windows - within a turn number, over turn numbers in a block of BLOCK_TURNS, over blocks - joined by key.
    """
    t = turns.select(
        F.coalesce(F.concat(F.lit("="), F.col(conv_col).cast("string")), F.lit("")).alias("_c"),
        F.col(conv_col).alias("_conv"),
        F.col(turn_col).cast("long").alias("turn"),
        F.coalesce(F.col(speaker_col).cast("string"), F.lit("unknown")).alias("speaker"),
        F.replace(F.coalesce(F.col(text_col).cast("string"), F.lit("")), F.lit("<|im_"), F.lit("< |im_")).alias("text"),
    )
    who = t.where(F.col("speaker") != system).select("_c", F.col("speaker").alias("perspective")).distinct()
    own = F.col("speaker") == F.col("perspective")
    role = F.when(F.col("speaker") == system, F.lit("system")).when(own, F.lit("assistant")).otherwise(F.lit("user"))
    shown = F.regexp_replace(F.replace("speaker", F.lit("<|im_"), F.lit("< |im_")), r"[\r\n]+", " ")
    name = F.when((F.col("speaker") != system) & ~own, shown)
    head = F.concat(F.lit(OPEN), role, F.coalesce(F.concat(F.lit(" name="), name), F.lit("")), F.lit("\n"))
    # turns without a number get one beyond all others, and a turn's block is a window's share of a conversation
    t = t.withColumn("_t", F.coalesce("turn", F.lit(1 << 62) + F.pmod(F.xxhash64("speaker", "text"), F.lit(1 << 20))))
    rows = t.join(who, "_c").select(
        "_c", "_conv", "perspective", "turn", "_t", "speaker", "text", F.expr(f"_t div {BLOCK_TURNS}").alias("_b"), role.alias("role"), name.alias("name"),
        F.concat(head, "text", F.lit(CLOSE + "\n")).alias("segment"), F.length(head).cast("long").alias("_head"),
    ).withColumn("_n", F.length("segment").cast("long"))
    side = ["_c", "perspective"]
    up_to = (Window.unboundedPreceding, Window.currentRow)
    by_turn = rows.groupBy(*side, "_b", "_t").agg(F.count("*").alias("_k"), F.sum("_n").alias("_m"))
    by_block = by_turn.groupBy(*side, "_b").agg(F.sum("_k").alias("_bk"), F.sum("_m").alias("_bm"))
    blocks = Window.partitionBy(*side).orderBy("_b").rowsBetween(*up_to)
    by_block = by_block.select(*side, "_b", (F.sum("_bk").over(blocks) - F.col("_bk")).alias("_bk0"), (F.sum("_bm").over(blocks) - F.col("_bm")).alias("_bm0"))
    numbers = Window.partitionBy(*side, "_b").orderBy("_t").rowsBetween(*up_to)
    by_turn = by_turn.withColumns({"_k0": F.sum("_k").over(numbers) - F.col("_k"), "_m0": F.sum("_m").over(numbers) - F.col("_m")}).join(by_block, [*side, "_b"])
    by_turn = by_turn.select(*side, "_b", "_t", (F.col("_k0") + F.col("_bk0")).alias("_before"), (F.col("_m0") + F.col("_bm0")).alias("_at"))
    ties = Window.partitionBy(*side, "_b", "_t").orderBy("speaker", "text").rowsBetween(*up_to)
    rows = rows.withColumns({"_i": F.row_number().over(ties) - 1, "_s": F.sum("_n").over(ties) - F.col("_n")}).join(by_turn, [*side, "_b", "_t"])
    start = F.col("_at") + F.col("_s")
    mine = F.col("role") == "assistant"
    return rows.select(
        F.col("_conv").alias(conv_col), "perspective", (F.col("_before") + F.col("_i")).cast("long").alias("position"), "turn", "role", "name", "segment",
        mine.cast("int").alias("mask"), start.alias("start"), F.when(mine, start + F.col("_head")).alias("train_start"), F.when(mine, start + F.col("_n") - 1).alias("train_end"),
    )
