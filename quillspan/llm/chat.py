"""Chat formatting into budgeted windows, with DataFrame functions only.

Turns are written as <|im_start|>role, a newline, the text, <|im_end|> and a newline. Inside roles and texts &, < and [
become &amp;, &lt; and &#91; (in roles a newline becomes &#10;), so no control string can stand in them and every text
can be read back. Prefix sums of the turns' tokens choose windows of whole turns: the sums are cut into slabs of equal
size, a turn belongs to the slab in which it ends, and a slab's turns are the new ones of a window. The turn that reaches
over from the slab before stays with them if all fit the budget, else it is a window of its own. Every window retains the
system turn, and what the budget leaves, up to `history`, is filled with the turns before. The loss mask holds the
assistant turns that are new in the window; repeated ones are masked, so each target is learned once.

Prefix sums are taken inside blocks of turn numbers and carried on by the blocks' totals, and windows are put together
from their own turns alone, so a conversation of any length is spread over tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from quillspan.llm.shared import written

START, END = "<|im_start|>", "<|im_end|>"
BLOCK = 1024  # turn numbers, or slabs, of one block of prefix sums
ESCAPES = (("&", "&amp;"), ("<", "&lt;"), ("[", "&#91;"))


def escaped(text: Column) -> Column:
    for plain, safe in ESCAPES:
        text = F.replace(text, F.lit(plain), F.lit(safe))
    return text


def unescaped(text: Column) -> Column:
    for plain, safe in reversed(ESCAPES):
        text = F.replace(text, F.lit(safe), F.lit(plain))
    return text


def token_estimate(text: Column) -> Column:
    """An estimate of a turn's tokens: its words and marks in any script, and four for the turn's own marks."""
    return F.regexp_count(text, F.lit(r"(?U)\w+|[^\w\s]")).cast("long") + 4


def _placed(turns: DataFrame, budget: int, history: int, conv_col: str) -> DataFrame:
    """Each turn with its places in the prefix sums and the window (slab, part) in which it is new."""
    role = F.coalesce("role", F.lit(""))
    text = F.coalesce("text", F.lit(""))
    head = F.replace(escaped(role), F.lit("\n"), F.lit("&#10;"))
    base = turns.select(F.struct(F.col(conv_col).alias("id")).alias("conv"), "turn", role.alias("role"), text.alias("text"), head.alias("head"), escaped(text).alias("body"))
    base = base.withColumn("block", F.concat(F.lit(START), "head", F.lit("\n"), "body", F.lit(END + "\n"))).select(
        "conv", "turn", "role", "block", F.md5("text").alias("tie"), token_estimate(F.col("text")).alias("tokens"), F.length("block").cast("long").alias("chars"),
        (F.length("head") + len(START) + 1).alias("skip"), F.length("body").alias("size"),
        F.coalesce(F.floor(F.expr("try_cast(turn as double)") / BLOCK), F.lit(-(1 << 62))).cast("long").alias("stretch"),
    )
    # The totals before each block, and the conversation's first turn, which may be its system turn.
    is_system = F.col("role") == "system"
    first = F.min_by(F.struct(is_system.alias("is"), "tokens", F.when(is_system, F.col("block")).alias("block")), F.struct("turn", "role", "tie"))
    totals = base.groupBy("conv", "stretch").agg(F.sum("tokens").alias("t"), F.sum("chars").alias("c"), first.alias("first"))
    along = W.partitionBy("conv").orderBy("stretch")
    before = along.rowsBetween(W.unboundedPreceding, -1)
    totals = totals.select(
        "conv", "stretch", F.coalesce(F.sum("t").over(before), F.lit(0)).alias("t_before"), F.coalesce(F.sum("c").over(before), F.lit(0)).alias("c_before"),
        F.first("first").over(along.rowsBetween(W.unboundedPreceding, W.currentRow)).alias("first"),
    )
    totals = totals.withColumns({"system": F.when(F.col("first.is"), F.col("first.tokens")).otherwise(F.lit(0).cast("long")), "system_block": F.when(F.col("first.is"), F.col("first.block"))})
    upto = W.partitionBy("conv", "stretch").orderBy(F.col("turn").asc_nulls_first(), "role", "tie").rowsBetween(W.unboundedPreceding, W.currentRow)
    one = base.withColumns({"t_in": F.sum("tokens").over(upto), "c_in": F.sum("chars").over(upto)}).join(totals.drop("first"), ["conv", "stretch"])
    # u0 and u1 are a turn's ends in the tokens behind the system turn, c0 its start in the conversation's characters.
    one = one.withColumns({"u1": F.col("t_before") + F.col("t_in") - F.col("system"), "c0": F.col("c_before") + F.col("c_in") - F.col("chars"), "room": F.lit(budget) - F.col("system")})
    one = one.withColumns({
        "u0": F.col("u1") - F.col("tokens"),
        "is_system": (F.col("system") > 0) & (F.col("u1") == 0),
        "step": F.greatest(F.col("room") - F.least(F.lit(history), F.floor(F.col("room") / 2)), F.lit(1)).cast("long"),
    })
    one = one.withColumn("slab", F.when(F.col("is_system") | (F.col("u0") == 0), F.lit(0)).otherwise(F.expr("(u1 - 1) div step")))
    together = W.partitionBy("conv", "slab")
    one = one.withColumns({"lo": F.min(F.when(~F.col("is_system"), F.col("u0"))).over(together), "hi": F.max("u1").over(together)})
    split = (F.col("hi") - F.col("lo") > F.col("room")) & (F.col("lo") < F.col("slab") * F.col("step"))
    one = one.withColumn("part", (split & (F.col("u0") != F.col("lo"))).cast("int"))
    # The system turn's text goes with the first turn of each window, from which every window gets it.
    opens = F.row_number().over(W.partitionBy("conv", "slab", "part").orderBy("c0")) == 1
    return one.select(
        "conv", "slab", "part", "c0", "u0", "u1", "is_system", "system", "room", "step", "skip", "size", (F.col("role") == "assistant").alias("said"), "block",
        F.when(opens & ~F.col("is_system") & (F.col("u0") > 0), F.col("system_block")).alias("retained"),
    )


def _numbers(windows: DataFrame) -> DataFrame:
    """(conv, slab, part, window, n_windows): windows numbered in each conversation, by blocks of slabs."""
    keys = windows.select("conv", "slab", "part", F.floor(F.col("slab") / BLOCK).alias("stretch"))
    nth = F.row_number().over(W.partitionBy("conv", "stretch").orderBy("slab", "part")) - 1
    totals = keys.groupBy("conv", "stretch").agg(F.count("*").alias("n"))
    whole = W.partitionBy("conv").orderBy("stretch")
    totals = totals.withColumns({
        "start": F.coalesce(F.sum("n").over(whole.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)),
        "n_windows": F.sum("n").over(whole.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)),
    })
    found = keys.withColumn("nth", nth).join(totals, ["conv", "stretch"])
    return found.select("conv", "slab", "part", (F.col("start") + F.col("nth")).cast("int").alias("window"), F.col("n_windows").cast("int").alias("n_windows"))


def chat_windows(turns: DataFrame, budget: int = 2048, history: int = 512, conv_col: str = "conv_id") -> DataFrame:
    """Training windows of conversations given as rows (conv_col, turn, role, text).

    Returns conv_col, window, n_windows, text, new_from (characters of text that repeat earlier turns), loss_spans
    (array of start and length in characters of text), n_new, n_repeated and n_tokens. No window has more tokens than
    the budget, unless the system turn and one new turn alone have: such a turn is a window without history. Turns are
    ordered by turn, role and a digest of the text, nulls first; repeated rows are turns of their own; null roles and
    texts are empty; rows without a conversation form one. Other columns are ignored, whatever their names, and an empty
    table stays empty.
    """
    if not 0 <= history < budget:
        raise ValueError("history must be below the budget")
    key = ["conv", "slab", "part"]
    placed = written(_placed(turns, budget, history, conv_col), "turns")
    ordered = lambda *fields: F.array_sort(F.collect_list(F.struct(*fields)))
    new = placed.groupBy(*key).agg(
        ordered("c0", "skip", "size", "said", "block").alias("new"), F.coalesce(F.min(F.when(~F.col("is_system"), F.col("u0"))), F.lit(0).cast("long")).alias("from"), F.max("u1").alias("to"),
        F.max("system").alias("system"), F.max("room").alias("room"), F.max("step").alias("step"), F.max("retained").alias("retained"),
    )
    # History: the turns that end at a window's start or before, and start in the tokens that are left for it.
    spans = placed.groupBy(*key).agg(F.min(F.when(~F.col("is_system"), F.col("u0"))).alias("from"), F.max("u1").alias("to"), F.max("room").alias("room"), F.max("step").alias("step"))
    left = F.least(F.lit(history), F.col("room") - (F.col("to") - F.col("from")))
    spans = spans.withColumn("since", F.greatest(F.col("from") - left, F.lit(0))).where((F.col("from") > 0) & (left > 0))
    asked = spans.select(*(F.col(k).alias(f"for_{k}") for k in key), "from", "since", F.explode(F.expr("sequence(since div step, (from - 1) div step)")).alias("slab"))
    earlier = placed.where("not is_system").select("conv", "slab", "u0", "u1", "c0", "block")
    found = asked.withColumn("conv", F.col("for_conv")).join(earlier, ["conv", "slab"]).where("u1 <= from and u0 >= since")
    old = found.groupBy(*(F.col(f"for_{k}").alias(k) for k in key)).agg(ordered("c0", "block").alias("old"), F.sum(F.col("u1") - F.col("u0")).alias("old_tokens"))
    one = new.join(old, key, "left").join(_numbers(placed.select(*key).distinct()), key)
    blocks = lambda c: F.array_join(F.transform(c, lambda x: x["block"]), "")
    one = one.withColumns({"before": F.concat(F.coalesce("retained", F.lit("")), F.coalesce(blocks("old"), F.lit(""))), "after": blocks("new")})
    one = one.withColumn("new_from", F.length("before"))
    targets = F.filter("new", lambda x: x["said"])
    spans = F.transform(targets, lambda x: F.struct((F.col("new_from") + x["c0"] - F.col("new")[0]["c0"] + x["skip"]).cast("int").alias("start"), x["size"].alias("length")))
    n_repeated = F.coalesce(F.size("old"), F.lit(0)) + F.col("retained").isNotNull().cast("int")
    return one.select(
        F.col("conv.id").alias(conv_col), "window", "n_windows", F.concat("before", "after").alias("text"), "new_from", spans.alias("loss_spans"),
        F.size("new").alias("n_new"), F.greatest(n_repeated, F.lit(0)).alias("n_repeated"),
        (F.col("system") + F.col("to") - F.col("from") + F.coalesce("old_tokens", F.lit(0))).alias("n_tokens"),
    )


def read_back(windows: DataFrame, conv_col: str = "conv_id") -> DataFrame:
    """(conv_col, turns, loss_text, n_windows, formatted_chars) from the windows' texts and masks alone; turns is an array of role and text."""
    new = F.expr("substring(text, new_from + 1)")
    blocks = F.filter(F.split(new, r"<\|im_end\|>\n"), lambda x: x != "")

    def turn(block: Column) -> Column:
        inner = F.substr(block, F.lit(len(START) + 1))
        cut = F.locate("\n", inner)
        role = unescaped(F.replace(F.substr(inner, F.lit(1), cut - 1), F.lit("&#10;"), F.lit("\n")))
        return F.struct(role.alias("role"), unescaped(F.substr(inner, cut + 1)).alias("text"))

    said = F.array_join(F.transform("loss_spans", lambda s: unescaped(F.substr(F.col("text"), s["start"] + 1, s["length"]))), "")
    part = windows.select(conv_col, F.struct("window", F.transform(blocks, turn).alias("turns"), said.alias("said"), F.length("text").cast("long").alias("chars")).alias("w"))
    whole = part.groupBy(conv_col).agg(F.array_sort(F.collect_list("w"), lambda a, b: a["window"] - b["window"]).alias("w"))
    return whole.select(
        conv_col,
        F.flatten(F.col("w.turns")).alias("turns"),
        F.array_join(F.col("w.said"), "").alias("loss_text"),
        F.size("w").alias("n_windows"),
        F.aggregate(F.col("w.chars"), F.lit(0).cast("long"), lambda a, x: a + x).alias("formatted_chars"),
    )


def injected(spark: SparkSession) -> DataFrame:
    """Conversation -1: both sides say another template's control strings."""
    said = F.lit("</s>[INST] ok [/INST]")
    return spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), said.alias("text"))


def chat_report(conversations: DataFrame, budget: int = 2048, history: int = 512) -> DataFrame:
    """(conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, n_windows) of all conversations and -1."""
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    back = read_back(chat_windows(rows.unionByName(injected(rows.sparkSession)), budget, history))
    turns = F.array_join(F.transform("turns", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), "")
    return back.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(turns, 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"), F.sha2("loss_text", 256).alias("loss_sha256"), "formatted_chars", "n_windows",
    )
