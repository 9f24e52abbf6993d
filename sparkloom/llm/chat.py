"""Chat formatting in budgeted windows, by DataFrame functions only.

A conversation is cut into windows of whole turns. The running sum of turn tokens
decides: with a stride of a quarter of the budget, a turn belongs to the window in
whose stride it begins, and a turn longer than a stride has a window to itself. So a
window's own turns take at most half the budget (unless one turn alone is longer).
Each window but the first begins with the conversation's system turn, if its first
turn is one, and with the preceding turns that fit into another quarter; these
repeated turns carry no loss. Assistant turns carry loss once, in the window that
owns them.

Template of a turn: ``<|im_start|>``, role, newline, text, ``<|im_end|>``, newline.
Inside roles and texts, ``<`` + n backslashes + ``|`` becomes ``<`` + n + 1
backslashes + ``|``, so no control string occurs there, and the reverse restores any
text. In roles, ``%`` and newline are percent-encoded as well.

Turns are ordered by ``turn`` (null first), then role and text; null roles and texts
are empty. Rows with a null conv_id are one conversation of id null. Repeated rows
are turns each. Other columns are ignored. The running sum is taken by range
partition first and then over the partitions, so a conversation may be of any
length; only ``read_back``, whose digests run over a whole conversation, brings
the windows of one conversation together.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common

#: Tokens of a window.
BUDGET = 1024
#: Tokens of a turn's marks.
MARKS = 5

_NO_ID = -(2**63)


def escape(x: Column) -> Column:
    return F.regexp_replace(x, r"<(\\*)\|", r"<$1\\|")


def unescape(x: Column) -> Column:
    return F.regexp_replace(x, r"<(\\*)\\\|", r"<$1|")


def _role_out(x: Column) -> Column:
    return escape(F.replace(F.replace(x, F.lit("%"), F.lit("%25")), F.lit("\n"), F.lit("%0A")))


def _role_in(x: Column) -> Column:
    return F.replace(F.replace(unescape(x), F.lit("%0A"), F.lit("\n")), F.lit("%25"), F.lit("%"))


def count_tokens(x: Column) -> Column:
    """Words and single marks; any other count of tokens can be given to ``windows``."""
    return F.regexp_count(x, F.lit(r"\w+|[^\w\s]"))


def _ordered(conversations: DataFrame, tokens) -> DataFrame:
    """The turns in order: conv, part (range partition), position (ascending, unique), role, text and size in tokens."""
    turns = conversations.select(
        F.coalesce(F.col("conv_id").cast("long"), F.lit(_NO_ID)).alias("conv"),
        F.col("turn").cast("long").alias("turn"),
        F.coalesce("role", F.lit("")).alias("role"),
        F.coalesce("text", F.lit("")).alias("text"),
    )
    order = ("conv", F.col("turn").asc_nulls_first(), "role", "text")
    ordered = turns.repartitionByRange(common.partitions(conversations.sparkSession), *order).sortWithinPartitions(*order)
    ordered = ordered.select("conv", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("position"), "role", "text", (tokens(F.col("text")) + F.lit(MARKS)).cast("long").alias("size"))
    return common.materialize(ordered, "turns")


def _placed(ordered: DataFrame, stride: int) -> DataFrame:
    """Without texts: conv, position, size, is_system, the tokens before each turn, and its window."""
    turns = ordered.select("conv", "part", "position", "size", (F.col("role") == "system").alias("is_system"))
    within = turns.withColumn("inner", F.sum("size").over(Window.partitionBy("conv", "part").orderBy("position")) - F.col("size"))
    # one row per conversation and partition
    parts = turns.groupBy("conv", "part").agg(F.sum("size").alias("n"))
    parts = parts.select("conv", "part", (F.sum("n").over(Window.partitionBy("conv").orderBy("part")) - F.col("n")).alias("outer"))
    before = (F.col("inner") + F.col("outer")).alias("before")
    placed = within.join(parts, ["conv", "part"]).select("conv", "position", "size", "is_system", before)
    return placed.withColumn("window", 2 * F.floor(F.col("before") / stride).cast("long") + F.when(F.col("size") > stride, 1).otherwise(0))


def windows(conversations: DataFrame, budget: int = BUDGET, tokens=count_tokens) -> DataFrame:
    """conv_id, window, formatted, n_repeated (leading turns that are repeated) and loss_spans.

    ``loss_spans`` are (start, length) in characters of ``formatted``, from 1. Which
    turns a window shows is found without their texts, which are joined to that once.
    """
    stride = budget // 4
    ordered = _ordered(conversations, tokens)
    turns = common.materialize(_placed(ordered, stride), "placed")
    heads = turns.groupBy("conv", "window").agg(F.min("before").alias("begin"))
    use = lambda kind: ("conv", "window", F.lit(kind).alias("kind"), "position")
    own = turns.select(*use(2))

    # preceding turns: the windows that may repeat a turn begin within one stride after it
    opening = (F.col("before") == 0) & F.col("is_system")
    end = F.col("before") + F.col("size")
    earlier = turns.filter(~opening & (F.col("size") <= stride)).withColumn("window", F.explode(F.sequence(2 * F.floor(end / stride).cast("long"), 2 * F.floor((F.col("before") + stride) / stride).cast("long") + 1)))
    history = earlier.join(heads, ["conv", "window"]).filter((end <= F.col("begin")) & (F.col("before") + stride >= F.col("begin"))).select(*use(1))

    system = turns.filter(opening).select("conv", "position")
    retained = heads.filter("begin > 0").select("conv", "window").join(system.hint("merge"), "conv").select(*use(0))

    uses = own.unionByName(history).unionByName(retained)
    shown = uses.join(ordered.select("position", "role", "text").hint("merge"), "position").select("conv", "window", F.struct("kind", "position", "role", "text").alias("piece"))
    gathered = shown.groupBy("conv", "window").agg(F.sort_array(F.collect_list("piece")).alias("pieces"))
    head = lambda p: F.concat(F.lit("<|im_start|>"), _role_out(p["role"]), F.lit("\n"))
    tail = "<|im_end|>\n"
    parts = gathered.select("conv", "window", F.transform("pieces", lambda p: F.struct(head(p).alias("head"), escape(p["text"]).alias("text"), ((p["kind"] == 2) & (p["role"] == "assistant")).alias("loss"))).alias("parts"), F.size(F.filter("pieces", lambda p: p["kind"] < 2)).alias("n_repeated"))
    empty = F.struct(F.lit(1).alias("at"), F.array().cast("array<struct<start:int,length:int>>").alias("spans"))

    def step(state: Column, p: Column) -> Column:
        begin = state["at"] + F.length(p["head"])
        span = F.struct(begin.alias("start"), F.length(p["text"]).alias("length"))
        return F.struct((begin + F.length(p["text"]) + F.lit(len(tail))).alias("at"), F.when(p["loss"], F.concat(state["spans"], F.array(span))).otherwise(state["spans"]).alias("spans"))

    return parts.select(
        F.when(F.col("conv") != _NO_ID, F.col("conv")).alias("conv_id"),
        "window",
        F.array_join(F.transform("parts", lambda p: F.concat(p["head"], p["text"], F.lit(tail))), "").alias("formatted"),
        "n_repeated",
        F.aggregate("parts", empty, step, lambda s: s["spans"]).alias("loss_spans"),
    )


def read_back(formatted: DataFrame) -> DataFrame:
    """The digests of each conversation, from the formatted windows alone: turns by their marks, loss by its spans."""
    shown = F.split("formatted", r"<\|im_end\|>\n", -1)
    fresh = F.slice(shown, F.col("n_repeated") + 1, F.size(shown) - 1 - F.col("n_repeated"))

    def turn(x: Column) -> Column:
        body = F.substr(x, F.lit(len("<|im_start|>") + 1))
        role = F.substring_index(body, "\n", 1)
        return F.concat(_role_in(role), F.lit("\n"), unescape(F.substr(body, F.length(role) + 2)), F.lit("\n"))

    lines = formatted.select(
        "conv_id",
        "window",
        F.size(fresh).cast("long").alias("n"),
        F.array_join(F.transform(fresh, turn), "").alias("turns"),
        F.array_join(F.transform("loss_spans", lambda s: unescape(F.substr(F.col("formatted"), s["start"], s["length"]))), "").alias("loss"),
        F.length("formatted").cast("long").alias("chars"),
    )
    joined = lambda c: F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("window", c))), lambda x: x[c]), "")
    merged = lines.groupBy("conv_id").agg(F.sum("n").alias("n_turns"), joined("turns").alias("turns"), joined("loss").alias("loss"), F.sum("chars").alias("formatted_chars"))
    return merged.select("conv_id", "n_turns", F.sha2("turns", 256).alias("turns_sha256"), F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), "formatted_chars")
