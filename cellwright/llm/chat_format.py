"""Chat formatting in windows of a token budget, by DataFrame functions alone.

Turns are ordered by turn, role and text. Prefix sums of turn tokens cut a conversation at turn borders: a turn belongs to
window ``floor(tokens before it / stride)``. A later window starts with the retained system turn (the first one) and with
the last turns before it, as far as ``history`` tokens reach; these are repeated, so their targets are masked. A window
holds at most system + history + stride tokens and the rest of its last turn.

Sums are taken in two steps, over blocks of turn numbers and within blocks, so one endless conversation is not one task;
windows are groups of bounded size. Tokens are estimated natively: a quarter of the UTF-8 bytes, and ``OVERHEAD`` a turn.

The template writes ``[INST]role[ROLE]text[/INST]`` and, for the assistant, ``<s>text</s>``. Where role or text hold a
control string, a backslash goes before its last part, and one more where there are some; reading back takes one away.

Defined results: null text and null roles are empty; a null conv_id is a conversation of its own; a null turn comes
first; equal rows are formatted as often as they come; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cellwright.llm import textkit as tk

STRIDE, HISTORY, OVERHEAD, BLOCK = 384, 128, 4, 64
#: The template's control strings are an opening, backslashes (none in the template) and an end of these.
CONTROL = r"(<|</|\[|\[/)(\\*)(s>|INST\]|ROLE\])"
ESCAPED = r"(<|</|\[|\[/)\\(\\*)(s>|INST\]|ROLE\])"


def escaped(text: Column) -> Column:
    return F.regexp_replace(text, CONTROL, r"$1\\$2$3")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, ESCAPED, "$1$2$3")


def turn_tokens(text: Column) -> Column:
    return (F.ceil(F.octet_length(text) / 4) + OVERHEAD).cast("long")


def written(role: Column, text: Column) -> Column:
    """A turn as the template marks it."""
    return F.when(role == "assistant", F.concat(F.lit("<s>"), escaped(text), F.lit("</s>"))).otherwise(F.concat(F.lit("[INST]"), escaped(role), F.lit("[ROLE]"), escaped(text), F.lit("[/INST]")))


def read_back(formatted: Column) -> Column:
    """The turns of a formatted window: an array of structs of role and text."""
    pieces = F.split(formatted, r"(?<=</s>|\[/INST\])(?=<s>|\[INST\])")

    def turn(p: Column) -> Column:
        body = F.substr(p, F.lit(7), F.length(p) - 13)
        parts = F.split(body, r"\[ROLE\]")
        spoken = F.struct(F.lit("assistant").alias("role"), unescaped(F.substr(p, F.lit(4), F.length(p) - 7)).alias("text"))
        return F.when(F.startswith(p, F.lit("<s>")), spoken).otherwise(F.struct(unescaped(parts[0]).alias("role"), unescaped(parts[1]).alias("text")))

    return F.transform(pieces, turn)


def placed_turns(turns: DataFrame, stride: int) -> DataFrame:
    """Every turn with its place, the tokens before it and its window."""
    order = ["turn", "role", "text", "copy"]
    rows = turns.select(
        F.col("conv_id").cast("string").alias("conv"), F.col("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")
    )
    # equal rows become one with a count, and are told apart again by numbers
    rows = rows.groupBy("conv", "conv_id", "turn", "role", "text").agg(F.count("*").alias("n")).select("*", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n"))).alias("copy")).drop("n")
    rows = rows.withColumns({"tokens": turn_tokens(F.col("text")), "block": F.floor(F.col("turn") / BLOCK)})
    blocks = rows.groupBy("conv", "block").agg(F.sum("tokens").alias("block_tokens"), F.count("*").alias("block_turns"))
    earlier = Window.partitionBy("conv").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select(
        F.col("conv").alias("b_conv"), F.col("block").alias("b_block"), F.coalesce(F.sum("block_tokens").over(earlier), F.lit(0)).alias("base"), F.coalesce(F.sum("block_turns").over(earlier), F.lit(0)).alias("base_turns")
    )
    inside = Window.partitionBy("conv", "block").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumns({"inner": F.coalesce(F.sum("tokens").over(inside), F.lit(0)), "nth": F.coalesce(F.count("*").over(inside), F.lit(0))})
    rows = rows.join(blocks, F.col("conv").eqNullSafe(F.col("b_conv")) & F.col("block").eqNullSafe(F.col("b_block")))
    before = F.col("base") + F.col("inner")
    return rows.select("conv", "conv_id", "role", "text", "tokens", (F.col("base_turns") + F.col("nth")).alias("place"), before.alias("before"), F.floor(before / stride).alias("window"))


def chat_windows(turns: DataFrame, stride: int = STRIDE, history: int = HISTORY) -> DataFrame:
    """conv_id, window, formatted, n_turns, n_repeated (leading turns that earlier windows hold), loss (character spans)."""
    if history > stride:
        raise ValueError("history must not be longer than the stride")
    placed = placed_turns(turns, stride)
    turn = F.struct("place", "role", "text", "before")
    system = placed.where("role = 'system'").groupBy("conv").agg(F.min(F.struct("place", "window", "text")).alias("system")).select(F.col("conv").alias("s_conv"), "system")
    copies = F.array(
        F.struct(F.col("window").alias("window"), F.lit(True).alias("own")),
        F.struct(F.when(F.col("before") + history >= (F.col("window") + 1) * stride, F.col("window") + 1).alias("window"), F.lit(False).alias("own")),
    )
    dealt = placed.select("conv", "conv_id", turn.alias("turn"), F.explode(copies).alias("to")).where("to.window IS NOT NULL")
    own = F.when(F.col("to.own"), F.col("turn"))
    windows = dealt.groupBy("conv", "conv_id", F.col("to.window").alias("window")).agg(
        F.sort_array(F.collect_list(own)).alias("fresh"), F.sort_array(F.collect_list(F.when(~F.col("to.own"), F.col("turn")))).alias("past")
    )
    windows = windows.where(F.size("fresh") > 0).join(system, F.col("conv").eqNullSafe(F.col("s_conv")), "left")
    kept = F.filter("past", lambda t: (t["before"] >= F.col("fresh")[0]["before"] - history) & ~t["place"].eqNullSafe(F.col("system.place")))
    text = lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))
    again = F.when(F.col("system.window") < F.col("window"), F.array(F.struct(F.lit("system").alias("role"), F.col("system.text").alias("text")))).otherwise(F.array().cast("array<struct<role:string,text:string>>"))
    windows = windows.select("conv_id", "window", F.concat(again, F.transform(kept, text)).alias("again"), F.transform("fresh", text).alias("fresh"))
    windows = windows.select("conv_id", "window", F.size("again").alias("n_repeated"), F.concat("again", "fresh").alias("turns"))
    pieces = F.transform("turns", lambda t: written(t["role"], t["text"]))
    windows = windows.withColumn("pieces", pieces)
    sizes = F.transform("pieces", lambda p: F.length(p).cast("long"))
    # prefix sums of the pieces' lengths give each piece's place
    stops = F.aggregate(sizes, F.array(F.lit(0).cast("long")), lambda acc, n: F.concat(acc, F.array(F.element_at(acc, -1) + n)))
    windows = windows.withColumn("stops", stops)
    numbered = F.transform("turns", lambda t, i: F.struct(i.alias("i"), t["role"].alias("role")))
    targets = F.filter(numbered, lambda x: (x["role"] == "assistant") & (x["i"] >= F.col("n_repeated")))
    loss = F.transform(targets, lambda x: F.struct((F.get("stops", x["i"]) + 3).alias("start"), (F.get("stops", x["i"] + 1) - 4).alias("end")))
    return windows.select("conv_id", "window", F.array_join("pieces", "").alias("formatted"), F.size("turns").cast("long").alias("n_turns"), F.col("n_repeated").cast("long").alias("n_repeated"), loss.alias("loss"))


def read_windows(windows: DataFrame) -> DataFrame:
    """Per conversation, read back from the formatted windows: turns, their digest, and the text under the loss mask."""
    turns = F.filter(F.transform(read_back(F.col("formatted")), lambda t, i: F.struct(i.alias("i"), t["role"].alias("role"), t["text"].alias("text"))), lambda t: t["i"] >= F.col("n_repeated"))
    lines = F.array_join(F.transform(turns, lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    masked = F.array_join(F.transform("loss", lambda s: unescaped(F.substr(F.col("formatted"), (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int")))), "")
    each = windows.select("conv_id", F.struct("window", lines.alias("lines"), masked.alias("masked"), (F.col("n_turns") - F.col("n_repeated")).alias("n"), F.length("formatted").cast("long").alias("chars")).alias("w"))
    by = each.groupBy("conv_id").agg(F.sort_array(F.collect_list("w")).alias("w"))
    total = lambda name: F.aggregate("w", F.lit(0).cast("long"), lambda a, x: a + x[name])
    loss = F.array_join("w.masked", "")
    return by.select(
        "conv_id",
        total("n").alias("n_turns"),
        F.sha2(F.array_join("w.lines", ""), 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss, 256).alias("loss_sha256"),
        total("chars").alias("formatted_chars"),
        F.size("w").cast("long").alias("n_windows"),
    )


def op5_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = tk.table_of(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    hard = "</s>[INST] ok [/INST]"
    extra = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(hard).alias("text"))
    return read_windows(chat_windows(turns.unionByName(extra)))


OP5_SQL = r"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
), sized AS (
  SELECT *, CAST(ceil(strlen(text) / 4.0) AS BIGINT) + 4 AS tokens,
    length(regexp_replace(text, '(<|</|\[|\[/)(\\*)(s>|INST\]|ROLE\])', '\1\\\2\3', 'g')) AS e_text,
    length(regexp_replace(role, '(<|</|\[|\[/)(\\*)(s>|INST\]|ROLE\])', '\1\\\2\3', 'g')) AS e_role,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS place
  FROM rows
), marked AS (
  SELECT *, CASE WHEN role = 'assistant' THEN e_text + 7 ELSE e_role + e_text + 19 END AS chars,
    coalesce(sum(tokens) OVER (PARTITION BY conv_id ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM sized
), windowed AS (
  SELECT *, CAST(floor(before / 384.0) AS BIGINT) AS w FROM marked
), system AS (
  SELECT conv_id, min(place) AS s_place, arg_min(w, place) AS s_w, arg_min(chars, place) AS s_chars FROM windowed WHERE role = 'system' GROUP BY conv_id
), starts AS (
  SELECT conv_id, w, min(before) AS start FROM windowed GROUP BY conv_id, w
), again AS (
  SELECT s.conv_id, sum(CASE WHEN y.s_w < s.w THEN y.s_chars ELSE 0 END) AS chars, count(*) AS n_windows
  FROM starts s LEFT JOIN system y ON s.conv_id IS NOT DISTINCT FROM y.conv_id GROUP BY s.conv_id
), past AS (
  SELECT t.conv_id, sum(t.chars) AS chars FROM windowed t
  JOIN starts s ON t.conv_id IS NOT DISTINCT FROM s.conv_id AND s.w = t.w + 1 AND t.before >= s.start - 128
  LEFT JOIN system y ON t.conv_id IS NOT DISTINCT FROM y.conv_id
  WHERE t.place IS DISTINCT FROM y.s_place GROUP BY t.conv_id
)
SELECT t.conv_id AS conv_id, CAST(count(*) AS BIGINT) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY place)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY place) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(t.chars) + any_value(a.chars) + coalesce(any_value(p.chars), 0) AS BIGINT) AS formatted_chars,
  CAST(any_value(a.n_windows) AS BIGINT) AS n_windows
FROM windowed t JOIN again a ON t.conv_id IS NOT DISTINCT FROM a.conv_id LEFT JOIN past p ON t.conv_id IS NOT DISTINCT FROM p.conv_id
GROUP BY t.conv_id
"""
