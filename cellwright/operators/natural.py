"""Natural answers against gold: the ways in which people write a right number that the gold values alone would reject.

A loss may be a positive figure right after "loss", a change its size with a word of movement, a ratio a percentage, and the
constants of a worked calculation are no claims. What may be read depends on the question's two cells, so a question's
context is one row (``question_contexts``), joined to its answers; everything about wording is a Column over spans of the text.
Gold values of a question are few and meet its answers as one array, so answers are read once and stay where that join puts them.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as K

from cellwright.functions.arithmetic import SLACK
from cellwright.functions.figures import arrow_lists, figures, half_unit
from cellwright.operators.claims import placed_claims

# Fixed pattern: "loss" that names a loss, not a statement or a pair.
LOSS = r"(?i)(?<!\bor )(?<!\band )(?<![(/&])\b(?:loss|losses|deficit|deficits)\b(?!-)"
# Fixed pattern: what every loss is named by, tried first as it is cheap.
LOSS_WORD = r"(?i)loss|deficit"
# Fixed pattern: clauses that turn or deny a loss, or speak of a profit.
NOT_A_LOSS = r"(?i)\b(?:profits?|income|earn\w*|gains?|surplus|turned|turning|swung|swing|avoid\w*|without|no longer|recover\w*|revers\w*|instead)\b"
# Fixed value: among how many words before the figure "loss" must stand. Fixed pattern: words that are figures.
NEAR_WORDS = 4
FIGURE_WORD = r"(?i)^(?:US\$|Rs\.?|LKR|USD|\$|€|£)?\(?[\d,.]+\)?%?$|^(?:thousands?|millions?|billions?|bn|mn|'000)$"
# Fixed patterns: where clauses and sentences break, and short forms whose full stop breaks nothing.
CLAUSE_BREAK, SENTENCE_BREAK = r"[;:\n]|[.!?,](?=\s)", r"\n|[.!?](?=\s)"
SHORT_FORM = r"(?i)(?:\b(?:Rs|approx|No|Co|Ltd|Inc|Plc|Corp|vs|Mr|Ms|Dr|St|FY|U\.S|e\.g|i\.e))$"
# Words that judge; of a loss, its size can't check them.
JUDGING = (
    "improved", "improve", "improves", "improving", "deteriorated", "deteriorate", "deteriorating", "strengthened", "weakened", "worsened", "recovered", "gained", "lost", "advanced", "retreated",
)
# Fixed patterns: what stands before a factor; a bare figure.
TIMES, BARE = r"(?i)(?:(?<![A-Za-z])[x×*·]|\btimes)\s*$", r"^[\d,]+(?:\.\d+)?$"
# Fixed pattern: programs that are a change between two cells.
CHANGE_PROGRAM = r"^\(*\s*(?:(?:growth|diff)\(\s*[A-Za-z_]\w*\s*,\s*[A-Za-z_]\w*\s*\)|[A-Za-z_]\w*\s*-\s*[A-Za-z_]\w*)\s*\)*$"
NUMBER = r"^\d"


_PLACE = K.StructType([K.StructField(c, K.IntegerType()) for c in ("at", "ahead")])


@F.arrow_udf(K.StructType([K.StructField(c, K.ArrayType(_PLACE)) for c in ("clause", "sentence")]))
def breaks(texts: pa.Array) -> pa.Array:
    """Where the clauses and sentences of texts break: the place behind the mark, and how many signs of white space it needs after it."""
    short = re.compile(SHORT_FORM)

    def of(text: str | None, pattern: re.Pattern) -> Iterator[tuple[int, int]]:
        found = pattern.finditer(text or "")
        return ((m.end(), int(m[0] not in ";:\n")) for m in found if m[0] != "." or not short.search(text, max(0, m.start() - 12), m.start()))

    each = {"clause": re.compile(CLAUSE_BREAK), "sentence": re.compile(SENTENCE_BREAK)}
    return pa.StructArray.from_arrays([arrow_lists((of(t.as_py(), p) for t in texts), _PLACE) for p in each.values()], names=list(each))


def cut(text: Column, start: Column, end: Column) -> Column:
    """The code points from start (from 0) up to end."""
    return F.substr(text, start + 1, F.greatest(end - start, F.lit(0)))


def begins_at(found: Column, place: Column) -> Column:
    """Where the clause or sentence of a place begins: behind the last break that is whole before it."""
    return F.coalesce(F.array_max(F.transform(F.filter(found, lambda b: b["at"] + b["ahead"] <= place), lambda b: b["at"])), F.lit(0))


def ends_at(found: Column, place: Column, text: Column) -> Column:
    """Where the sentence of a place ends: at the first break beyond it."""
    return F.coalesce(F.array_min(F.transform(F.filter(found, lambda b: b["at"] > place), lambda b: b["at"])), F.length(text))


def near_words(clause: Column, most: int = NEAR_WORDS) -> Column:
    """The last few words of a clause that are no figures."""
    words = F.filter(F.split(F.trim(clause), r"\s+"), lambda w: (w != "") & ~w.rlike(FIGURE_WORD))
    return F.array_join(F.slice(words, F.greatest(F.size(words) - most + 1, F.lit(1)), F.lit(most)), " ")


def is_change_program(program: Column) -> Column:
    """A change of one cell against another; numbers are no cells."""
    parts = F.filter(F.split(F.regexp_replace(program, r"^\s*\(*\s*(?:growth|diff)?\(?|[()]", " "), r"[\s,-]+"), lambda w: w != "")
    return F.coalesce(program.rlike(CHANGE_PROGRAM) & F.forall(parts, lambda w: ~w.rlike(NUMBER)), F.lit(False))


def question_contexts(questions: DataFrame, gold: DataFrame, cells: DataFrame) -> DataFrame:
    """What the evidence says of each question (question_id, evidence_id, program) and its gold values (question_id, nth,
    role, kind, value, cell).

    change (signed, size, losses; null where the question is none of two periods), earlier, later, entities_differ, loss_line,
    gold_cells, changes, program, and ``primary``, the kind of its first answer.
    """
    held = cells.select("evidence_id", F.col("id").alias("cell"), F.struct("id", "metric", "entity", "period", "raw", "value", "scale", F.coalesce("metric", "row_label").alias("named")).alias("c"))
    used = gold.join(questions.select("question_id", "evidence_id"), "question_id").join(held, ["evidence_id", "cell"], "left")
    by = used.groupBy("question_id").agg(
        F.array_sort(F.collect_list(F.when(F.col("c").isNotNull(), F.struct("nth", "role", "c")))).alias("u"), F.min_by("kind", F.when(F.col("role") == "answer", F.col("nth"))).alias("primary")
    )
    operands = F.transform(F.filter("u", lambda x: x["role"] == "operand"), lambda x: x["c"])
    rows = questions.join(by, "question_id", "left").withColumns({"u": F.coalesce("u", F.filter(F.array(F.lit(None).cast(by.schema["u"].dataType.elementType)), lambda x: x.isNotNull()))})
    rows = rows.withColumns({"o": operands, "changes": is_change_program(F.col("program"))})
    a, b = F.get("o", F.lit(0)), F.get("o", F.lit(1))
    pair = F.col("changes") & (F.size("o") == 2)
    same = a["metric"].eqNullSafe(b["metric"]) & a["entity"].eqNullSafe(b["entity"])
    over_time = F.coalesce(pair & same & (F.coalesce(a["period"], F.lit("")) != "") & (F.coalesce(b["period"], F.lit("")) != "") & (a["period"] != b["period"]) & a["raw"].isNotNull() & b["raw"].isNotNull(), F.lit(False))
    key = lambda c: F.struct(F.length(c["period"]), c["period"])
    rows = rows.withColumns({"over_time": over_time, "now": F.when(key(a) > key(b), a).otherwise(b), "then": F.when(key(a) > key(b), b).otherwise(a)})
    moved = lambda x: F.when(x > 0, "up").when(x < 0, "down")
    now, then = F.col("now.value"), F.col("then.value")
    change = F.struct(moved(now - then).alias("signed"), moved(F.abs(now) - F.abs(then)).alias("size"), ((now < 0) & (then < 0)).alias("losses"))
    loss_line = F.exists("u", lambda x: F.coalesce(x["c"]["named"].rlike(LOSS) & (x["c"]["raw"] > 0), F.lit(False)))
    return rows.select(
        "question_id", F.when(F.col("over_time"), change).alias("change"), F.when(F.col("over_time"), F.col("then.period")).alias("earlier"), F.when(F.col("over_time"), F.col("now.period")).alias("later"),
        F.coalesce(pair & ~a["entity"].eqNullSafe(b["entity"]), F.lit(False)).alias("entities_differ"), loss_line.alias("loss_line"), F.transform("u", lambda x: x["c"]).alias("gold_cells"), "changes", "program", "primary",
    )


def gold_values(gold: DataFrame) -> DataFrame:
    """question_id and its gold values (role, kind, value, cell) as one array."""
    return gold.groupBy("question_id").agg(F.collect_list(F.struct("role", "kind", F.col("value").cast("double").alias("value"), "cell")).alias("gold_values"))


def read_texts(texts: DataFrame, gold: DataFrame, contexts: DataFrame | None, **more: Column) -> DataFrame:
    """Texts (item_id, question_id, text; other columns carried) with their question's gold values and context, figures and
    breaks, and ``more`` columns that Python reads from the text in the same go; rows lie by question, as Python reads before the
    joins. Without ``contexts`` the answers are template answers: no reading beyond the printed one."""
    texts = texts.withColumns({"figures": figures("text"), "breaks": breaks("text"), **more})
    if contexts is None:
        none = "struct<signed:string,size:string,losses:boolean>"
        asked = texts.withColumns({"natural": F.lit(False), "change": F.lit(None).cast(none), "loss_line": F.lit(False)})
    else:
        asked = texts.join(contexts.withColumn("natural", F.lit(True)), "question_id", "left").withColumns({"natural": F.coalesce("natural", F.lit(False)), "loss_line": F.coalesce("loss_line", F.lit(False))})
    return asked.join(gold_values(gold), "question_id", "left")


def natural_claims(read: DataFrame) -> DataFrame:
    """Claims of ``read_texts`` with clause and sentence, loss cue, and ``prev``, where the claim before ends (0: none).

    A text without figures keeps one row of none. ``counts`` says whether a row is a claim to a person: constants are none.
    """
    before, value = lambda f: cut(F.col("text"), F.lit(0), f["start"]), lambda f: f["value"].cast("double")
    constant = lambda f: F.coalesce((f["kind"] == "number") & (((value(f) == 100) & before(f).rlike(TIMES)) | ((value(f) == 1) & F.endswith(before(f), F.lit(":")))), F.lit(False))
    ends = F.transform("figures", lambda f: F.when(~(F.col("natural") & constant(f)), f["end"]))
    claims = placed_claims(read.withColumn("ends", ends).select("*", F.posexplode_outer("figures").alias("nth", "figure")))
    text, start, end = F.col("text"), F.col("figure.start"), F.col("figure.end")
    claims = claims.withColumns({"n_clause": cut(text, begins_at(F.col("breaks.clause"), start), start), "n_begin": begins_at(F.col("breaks.sentence"), start), "n_end": ends_at(F.col("breaks.sentence"), end, text)})
    claims = claims.withColumn("n_sentence", cut(text, F.col("n_begin"), F.col("n_end")))
    beside = F.substr(text, start, F.lit(1)) == "("
    brackets = F.when(start > 0, beside).otherwise(False) & (F.substr(text, end + 1, F.lit(1)) == ")") & F.col("figure.text").rlike(BARE)
    cue = F.when(F.col("n_clause").rlike(LOSS_WORD) & near_words(F.col("n_clause")).rlike(LOSS) & ~F.col("n_clause").rlike(NOT_A_LOSS), "word").when(brackets, "brackets")
    prev = F.coalesce(F.array_max(F.slice("ends", F.lit(1), F.coalesce("nth", F.lit(0)))), F.lit(0))
    return claims.withColumns({
        "cue": cue, "v": F.col("figure.value").cast("double"), "half": half_unit(F.col("figure")), "of_loss": F.col("change.losses") & F.col("n_sentence").rlike(LOSS), "prev": prev,
        "counts": F.get("ends", F.col("nth")).isNotNull(),
    }).drop("ends")


def states_gold(role: Column, gold_kind: Column, gold: Column, natural: Column) -> Column:
    """Whether a row of ``natural_claims``, read as a natural or as a template one, states a gold value."""
    kind, v, direction, change = F.col("figure.kind"), F.col("v"), F.col("direction"), F.col("is_change")
    context = F.col("change")
    close = lambda x, target: F.abs(x - target) <= F.col("half") + SLACK
    # a bare number may be printed in the table's unit
    in_units = lambda x, target: close(x, target) | ((kind == "number") & (close(x * 1e3, target) | close(x * 1e6, target) | close(x * 1e9, target)))
    as_ratio = ~change & direction.isNull() & (v > 0) & (gold > 0) & close(v, gold * 100)
    of_loss = F.col("of_loss")
    moved = F.when(of_loss, context["size"]).otherwise(context["signed"])
    judged = of_loss & F.coalesce(F.lower(F.col("direction_word")).isin(*JUDGING), F.lit(False))
    by_size = F.when((v < 0) | judged, F.lit(False)).when(moved.isNotNull(), (direction == moved) & in_units(F.abs(v), F.abs(gold)))
    signed = F.when(direction == "up", v).otherwise(-v)
    loss = in_units(-v, gold) | ((F.col("cue") == "word") & F.col("loss_line") & in_units(v, gold))
    plain = F.when(change & direction.isNotNull() & (v >= 0), in_units(signed, gold)).when(natural & ~change & (v >= 0) & F.col("cue").isNotNull(), loss).otherwise(in_units(v, gold))
    directional = natural & context.isNotNull() & change & direction.isNotNull() & (role == "answer")
    other_kind = (kind != "number") & ((kind == "percent") != (gold_kind == "percent"))
    return F.coalesce(F.when(natural & (kind == "percent") & (gold_kind == "ratio"), as_ratio).when(other_kind, False).otherwise(F.coalesce(F.when(directional, by_size), plain)), F.lit(False))


def stated_values(natural: Column) -> Column:
    """The gold values that a row of ``natural_claims`` states."""
    return F.coalesce(F.filter("gold_values", lambda g: states_gold(g["role"], g["kind"], g["value"], natural)), F.array().cast("array<struct<role:string,kind:string,value:double,cell:string>>"))


def is_answer(stated: str) -> Column:
    return F.exists(stated, lambda g: F.coalesce(g["role"] == "answer", F.lit(False)))


def state_by(counts: Column, stated: str) -> Column:
    """The state of an item by its claims, of which those that count state gold values: an aggregate."""
    hit, answer = F.bool_and(F.when(counts, F.size(stated) > 0)), F.bool_or(F.when(counts, is_answer(stated)))
    return F.when(F.bool_or(F.col("text").isNull()), "abstained").when(hit.isNull(), "supported_unhelpful").when(~hit, "unsupported").when(answer, "supported_useful").otherwise("supported_unhelpful")


def wrong_by(counts: Column, stated: str) -> Column:
    """The figures of an item that state no gold value: an aggregate."""
    return F.transform(F.array_sort(F.collect_list(F.when(counts & (F.size(stated) == 0), F.struct("nth", F.col("figure.text").alias("shown"))))), lambda w: w["shown"])
