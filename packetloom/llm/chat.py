"""Chat formatting in budgeted windows (operator 10).

Prefix sums of the turns' tokens lay a conversation, but for its system turn, on a line that is cut every `stride`
tokens. Turns that end between two cuts form a window; a turn across a cut forms one of its own. Each window repeats the
system turn and the turns that begin at most `history` tokens before it; the repeated are context and stay out of the
loss mask, which so covers every assistant text once. The stride is what the budget leaves beside the history and the
conversation's own system turn. Sizes are of turns as they are written, so a window exceeds the budget only if a single
turn does.

A turn is written <|turn|>role<|text|>text<|end|>. A backslash before the second character of any control string inside
roles and texts, and before every backslash, makes what is written reversible.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, functions as F

from .jobs import cut

# The template's marks, and control strings of it and of other templates.
TURN, TEXT, END = "<|turn|>", "<|text|>", "<|end|>"
CONTROLS = ("<|", "<s>", "</s>", "[INST]", "[/INST]")


def escape(text: Column) -> Column:
    out = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    for c in CONTROLS:
        out = F.replace(out, F.lit(c), F.lit(f"{c[0]}\\{c[1:]}"))
    return out


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def written(role: Column, text: Column) -> Column:
    """A turn as it stands in a formatted window."""
    return F.concat(F.lit(TURN), escape(role), F.lit(TEXT), escape(text), F.lit(END))


def tokens(turn: Column) -> Column:
    """An estimate of the tokens of a written turn that needs no vocabulary: one for four bytes."""
    return F.ceil(F.octet_length(turn) / 4).cast("long")


def turns(conversations: DataFrame, *, id_col: str, turn_col: str, role_col: str, text_col: str, size: Callable[[Column], Column] = tokens) -> DataFrame:
    """conv, role, text, rank (from 1), size of the written turn, begin and end (sums of sizes before and through it) of every turn.

    The order of all turns is dealt into ranges of even size, each range's sums are taken by itself and then over the
    ranges, so that a conversation of very many turns, tied or not, is no single task's.
    """
    rows = conversations.select(
        F.col(id_col).alias("conv"), F.col(turn_col).alias("turn"), F.coalesce(role_col, F.lit("")).alias("role"), F.coalesce(text_col, F.lit("")).alias("text")
    )
    rows = rows.withColumn("size", size(written(F.col("role"), F.col("text"))).cast("long")).withColumn("tie", F.xxhash64(F.monotonically_increasing_id()))
    rows = cut(rows.repartitionByRange("conv", "turn", "role", "text", "tie").drop("tie").withColumn("block", F.spark_partition_id()))
    sums = rows.groupBy("conv", "block").agg(F.sum("size").alias("sum"), F.count("*").alias("n"))
    before = Window.partitionBy("conv").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(F.col("conv").alias("c"), F.col("block").alias("b"), F.coalesce(F.sum("sum").over(before), F.lit(0)).alias("sum0"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("n0"))
    joined = rows.join(sums, rows.conv.eqNullSafe(sums.c) & (rows.block == sums.b)).drop("c", "b")
    within = Window.partitionBy("conv", "block").orderBy("turn", "role", "text")
    running = within.rowsBetween(Window.unboundedPreceding, 0)
    out = joined.withColumn("rank", F.col("n0") + F.row_number().over(within)).withColumn("end", F.col("sum0") + F.sum("size").over(running))
    return out.select("conv", "role", "text", "rank", "size", (F.col("end") - F.col("size")).alias("begin"), "end")


def windows(
    conversations: DataFrame, *, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text",
    budget: int = 2048, history: int = 256, size: Callable[[Column], Column] = tokens,
) -> DataFrame:
    """One row for each window: id_col, window (its order), n_context, n_turns (context included), formatted, loss_spans.

    Turns go by turn, ties by role, then text; a null turn comes first, null roles and texts are empty, all turns of a null
    id are one conversation. A leading turn with the role system is repeated in every later window if it takes at most
    half of budget - history; a longer one is a turn like others. The stride is budget - history, less the tokens of a
    repeated system turn. A window of a turn longer than the stride repeats no history, and leaves out the system turn where
    that alone takes it over the budget. size gives the tokens of a written turn, of escaped role, text and marks; by it no
    window exceeds budget unless one turn does by itself. loss_spans are (start, end) of the assistant turns' texts in
    formatted, as code points, end exclusive, without repeated ones. Rows may repeat; each is a turn. No rows give none;
    other columns are ignored. A text of any length is one turn and is never cut.
    """
    if budget - history < 2 or history < 1:
        raise ValueError("budget must exceed history by two at least, and history be positive")
    rows = turns(conversations, id_col=id_col, turn_col=turn_col, role_col=role_col, text_col=text_col, size=size)
    rows = rows.select("conv", "rank", "size", "begin", "role", escape(F.col("role")).alias("r"), escape(F.col("text")).alias("t"))
    rows = cut(rows.withColumn("leads", (F.col("rank") == 1) & (F.col("role") == "system") & (2 * F.col("size") <= budget - history)))
    system = rows.where("leads").select(F.col("conv").alias("c"), F.col("size").alias("system"))
    rows = rows.join(system, rows.conv.eqNullSafe(system.c), "left").drop("c").withColumn("system", F.coalesce("system", F.lit(0)))
    stride = budget - history - F.col("system")
    rows = rows.withColumn("begin", F.col("begin") - F.col("system")).withColumn("cell", F.floor((F.col("begin") + F.col("size") - 1) / stride))
    window = F.when(F.col("leads"), 1).otherwise(2 * F.col("cell") + F.when(F.floor(F.col("begin") / stride) < F.col("cell"), 0).otherwise(1))
    rows = rows.withColumn("window", window.cast("long"))
    starts = rows.groupBy("conv", "window").agg(F.min("begin").alias("start"), F.min("rank").alias("first"), F.max(F.col("size") > stride).alias("long"), F.max("size").alias("most"), F.max("system").alias("system"))
    late = cut(starts.where("first > 1").select(F.col("conv").alias("c"), F.col("window").alias("w"), "start", "first", "long", F.floor(F.col("start") / history).alias("k"), (~F.col("long") | (F.col("most") > budget) | (F.col("system") + F.col("most") <= budget)).alias("led")))

    head = rows.where("leads")
    kept = head.join(late, head.conv.eqNullSafe(late.c) & late.led).select("conv", F.col("w").alias("window"), "rank", F.lit(0).alias("new"), "role", "r", "t")
    near = rows.where("not leads").withColumn("cell", F.explode(F.array(F.floor(F.col("begin") / history), F.floor(F.col("begin") / history) + 1)))
    match = near["conv"].eqNullSafe(late["c"]) & (near["cell"] == late["k"]) & (near["rank"] < late["first"]) & (near["begin"] + history >= late["start"]) & ~late["long"]
    repeated = near.join(late, match).select("conv", F.col("w").alias("window"), "rank", F.lit(0).alias("new"), "role", "r", "t")
    fresh = rows.select("conv", "window", "rank", F.lit(1).alias("new"), "role", "r", "t")

    grouped = fresh.union(repeated).union(kept).groupBy("conv", "window").agg(F.array_sort(F.collect_list(F.struct("rank", "new", "role", "r", "t"))).alias("x"))
    written = F.array_join(F.transform("x", lambda t: F.concat(F.lit(TURN), t["r"], F.lit(TEXT), t["t"], F.lit(END))), "")
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("spans"))

    def step(done: Column, t: Column) -> Column:
        begin = done["at"] + len(TURN) + F.length(t["r"]) + len(TEXT)
        end = begin + F.length(t["t"])
        learned = (t["new"] == 1) & (t["role"] == "assistant")
        return F.struct((end + len(END)).alias("at"), F.when(learned, F.concat(done["spans"], F.array(F.struct(begin.alias("start"), end.alias("end"))))).otherwise(done["spans"]).alias("spans"))

    return grouped.select(
        F.col("conv").alias(id_col), "window", F.size(F.filter("x", lambda t: t["new"] == 0)).alias("n_context"), F.size("x").alias("n_turns"),
        written.alias("formatted"), F.aggregate("x", start, step, lambda d: d["spans"]).alias("loss_spans"),
    )


def read_back(formatted: Column) -> Column:
    """The turns (role, text) that a formatted window holds."""
    parts = F.split(formatted, r"<\|turn\|>", -1)
    return F.transform(
        F.slice(parts, 2, F.size(parts)),
        lambda p: F.struct(unescape(F.substring_index(p, TEXT, 1)).alias("role"), unescape(F.substr(p, F.instr(p, TEXT) + len(TEXT), F.length(p) - F.instr(p, TEXT) + 1 - len(TEXT) - len(END))).alias("text")),
    )


def learned(formatted: Column, spans: Column) -> Column:
    """The text under the loss mask."""
    return F.array_join(F.transform(spans, lambda s: unescape(F.substr(formatted, s["start"] + 1, s["end"] - s["start"]))), "")
