"""Triage: why a person must label an answer, or nothing where code can.

Each wording word (a year, an entity, a unit, a word of movement) belongs to one claim of its sentence, found by the distance
of spans; a word that its claim's cells do not bear out is a reason. Words and claims of an answer meet as arrays of one row.
"""

from __future__ import annotations

import re
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as K

from cellwright.functions import text as T
from cellwright.functions.figures import arrow_lists
from cellwright.operators import natural as N
from cellwright.operators.claims import direction_words

# Fixed pattern: words of movement beyond those that claims are read with.
MOVEMENT = (
    r"narrow\w*|widen\w*|worsen\w*|deepen\w*|eas(?:ed|ing)|reduc\w*|surg\w*|soar\w*|plung\w*|plummet\w*|slump\w*|tumbl\w*"
    r"|halved|doubled|greater|exceed\w*|improve\w*|deteriorat\w*|strengthen\w*|weaken\w*|recover\w*|shr[iau]nk\w*|dip\w*|slip\w*"
    r"|sank|sink\w*|slid\w*|slide\w*|erod\w*|reced\w*|moderat\w*|contraction|rebound\w*|spik\w*|balloon\w*|accelerat\w*"
    r"|slow\w*|rall\w*|outpac\w*|climb\w*|jump\w*|rocket\w*"
)
# Fixed patterns: which of them say more, which less, and which judge.
MORE = r"^(?:widen\w*|deepen\w*|surg\w*|soar\w*|doubled|rebound\w*|spik\w*|balloon\w*|rall\w*|climb\w*|jump\w*|rocket\w*)$"
LESS = r"^(?:narrow\w*|reduc\w*|plung\w*|plummet\w*|slump\w*|tumbl\w*|halved|shr[iau]nk\w*|dip\w*|slip\w*|sank|sink\w*|slid\w*|slide\w*|erod\w*|reced\w*|contraction)$"
JUDGES = r"^(?:improve\w*|deteriorat\w*|worsen\w*|strengthen\w*|weaken\w*|recover\w*|eas(?:ed|ing)|gained|lost|advanced|retreated)$"
# Fixed patterns: words that name a period, an entity or a unit.
PERIOD = r"\b(?:FY\s?)?(?:19|20)\d{2}(?:\s?/\s?\d{2,4})?\b|\bFY\s?\d{2}\b"
THIS_YEAR, LAST_YEAR = r"\b(?:this|current)\s+(?:fiscal\s+|financial\s+)?year\b", r"\b(?:last|previous|prior|preceding)\s+(?:fiscal\s+|financial\s+)?year\b"
ENTITY = r"\b(?:group|consolidated|bank|company|parent|standalone)\b(?!'s\s+(?:statements?|consolidated|financial|annual|report))"
UNIT = r"\b(?:thousands?|millions?|billions?)\b|'000"
# Fixed patterns: what stands before a word that a claim owns, before the earlier figure, before the name of a line item.
OWNED = r"(?i)\b(?:in|for|during|of|at|as at|as of|ended|ending|on|year|fiscal)(?:\s+the)?\s*$"
EARLIER = r"(?i)\b(?:compared (?:with|to)|from|since|over|against|versus|vs\.?|relative to|than)\s+(?:the\s+)?$"
LINE_ITEM = r"(?i)\b(?:owners?|holders?|shareholders?|members?|stakeholders?)\s+of\s+(?:the\s+)?$"
# Fixed patterns: "from" and "to" before the figures of a change, not those that name a source or a comparison.
TO_LEVEL = r"(?<!compared )(?<!relative )(?<!due )(?<!attributable )\bto\b"
FROM_LEVEL = r"(?<!derived )(?<!calculated )(?<!computed )(?<!taken )(?<!obtained )(?<!extracted )(?<!comes )\bfrom\b"
CURRENCY_AFTER = r"^\s*(?:Rs\b\.?|US\$|\$|SLR\b|LKR\b|USD\b)"
# Reasons, in order.
STATE_REASONS = {"unsupported": "a number the gold values do not cover", "supported_unhelpful": "no number states the answer"}
BY_PERSON = ("narrative", "comparison")
NOT_YEAR, NOT_ENTITY, NOT_LEVEL = "a year that is not its figure's", "an entity that is not its figure's", "a 'from' or 'to' figure from the wrong year"
NOT_METRIC, NOT_LOSS, NOT_MONEY = "a metric name that is not its figure's", "'loss' beside a figure that is not one", "a currency after a bare figure"
NOT_UNIT, NOT_MOVED = "a unit the tables do not use", "a direction word the scorer cannot check"

_WORD, _MOVES = re.compile(r"\w+"), re.compile("|".join(sorted(direction_words(), key=len, reverse=True)) + "|" + MOVEMENT, re.IGNORECASE)
_WORDS = {
    "period": re.compile(PERIOD, re.IGNORECASE),
    "this": re.compile(THIS_YEAR, re.IGNORECASE),
    "last": re.compile(LAST_YEAR, re.IGNORECASE),
    "entity": re.compile(ENTITY, re.IGNORECASE),
    "unit": re.compile(UNIT, re.IGNORECASE),
}


_PLACED = K.StructType([K.StructField("what", K.StringType()), K.StructField("start", K.IntegerType()), K.StructField("end", K.IntegerType()), K.StructField("word", K.StringType())])


@lru_cache(maxsize=1 << 14)
def _moves(word: str) -> bool:
    """Whether a whole word is one of movement; texts say the same words over and over."""
    return _MOVES.fullmatch(word) is not None


def placed_words(text: str) -> list[tuple[str, int, int, str]]:
    """The words of movement, period, entity and unit of a text, with their places."""
    moving = [("direction", m.start(), m.end(), m[0]) for m in _WORD.finditer(text) if _moves(m[0])]
    return moving + [(what, m.start(), m.end(), m[0]) for what, p in _WORDS.items() for m in p.finditer(text)]


@F.arrow_udf(K.ArrayType(_PLACED))
def wordings(texts: pa.Array) -> pa.Array:
    return arrow_lists((placed_words(t.as_py() or "") for t in texts), _PLACED)


def _nearest_metric(words: Column, surfaces: Column) -> Column:
    """The line item that a text names last, by its longest name where two end together."""
    spaced = lambda x: F.concat(F.lit(" "), x, F.lit(" "))
    norm = F.array(spaced(T.normalise_metric(words)))

    def named(n: Column) -> Column:
        held = F.filter(surfaces, lambda s: F.contains(n, spaced(s["text"])))
        # where the name ends, counted from the end of the text
        return F.array_max(F.transform(held, lambda s: F.struct((-F.instr(F.reverse(n), F.reverse(spaced(s["text"])))).alias("ends"), F.length(s["text"]).alias("size"), s["metric"].alias("metric"))))["metric"]

    return F.get(F.transform(norm, named), F.lit(0))


def _flag(c: Column) -> Column:
    """Whether any row has it: an aggregate."""
    return F.coalesce(F.bool_or(F.coalesce(c, F.lit(False))), F.lit(False))


def _claim_rows(items: DataFrame, contexts: DataFrame, gold: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """Claims with the cells that each one states; an item without figures keeps one row of none."""
    asked = items.join(vocabulary.select("evidence_id", "surfaces"), "evidence_id", "left")
    claims = N.natural_claims(N.read_texts(asked, gold, contexts, wordings=wordings("text")))
    claims = claims.withColumn("stated_values", N.stated_values(F.col("natural")))
    ids = F.transform("stated_values", lambda g: g["cell"])
    claims = claims.withColumns({"computed": F.exists("stated_values", lambda g: F.coalesce((g["role"] == "answer") & g["cell"].isNull(), F.lit(False))), "ids": ids})
    stated = F.filter("gold_cells", lambda c: F.array_contains("ids", c["id"]))
    return claims.withColumn("stated", stated).withColumn("backed", F.concat("stated", F.when(F.col("computed"), F.col("gold_cells")).otherwise(F.slice("gold_cells", 1, 0))))


def _claim_flags(claims: DataFrame) -> tuple[DataFrame, dict[str, Column]]:
    """The claims, and for each reason that single claims give, whether a claim gives it.

    Only claims that state a gold value are looked at: an answer with any other is unsupported, and its state is the reason.
    """
    hit, start = F.size("stated_values") > 0, F.col("figure.start")
    periods = F.filter(F.transform("stated", lambda c: c["period"]), lambda p: p != "")
    level = F.lower(F.regexp_extract(N.near_words(F.col("n_clause")), rf"(?is)^.*({FROM_LEVEL}|{TO_LEVEL})", 1))
    wanted = F.when(level == "from", F.col("earlier")).when(level == "to", F.col("later"))
    wrong_level = hit & F.col("later").isNotNull() & ~F.col("computed") & (F.size(periods) > 0) & wanted.isNotNull() & ~F.array_contains(periods, wanted)
    own = N.cut(F.col("text"), F.greatest(start - F.length("n_clause"), F.col("prev")), start)
    metrics = F.array_compact(F.transform("backed", lambda c: c["metric"]))
    claims = claims.withColumn("metrics", F.when(hit & (F.col("figure.kind") != "number"), metrics))
    claims = claims.withColumn("named", F.when(F.size("metrics") > 0, _nearest_metric(own, F.col("surfaces"))))
    wrong_metric = F.col("named").isNotNull() & ~F.array_contains("metrics", F.col("named"))
    since = N.cut(F.col("text"), F.greatest(F.instr(F.col("text"), F.col("n_sentence")) - 1, F.col("prev")), start)
    wrong_loss = hit & F.exists("stated", lambda c: (c["raw"] > 0) & ~c["named"].rlike(N.LOSS)) & since.rlike(N.LOSS)
    money = hit & (F.col("figure.kind") == "number") & F.substr(F.col("text"), F.col("figure.end") + 1).rlike(CURRENCY_AFTER) & ~F.exists("stated", lambda c: c["scale"] == 0)
    return claims, {NOT_LEVEL: wrong_level, NOT_METRIC: wrong_metric, NOT_LOSS: wrong_loss, NOT_MONEY: money}


def _by_item(claims: DataFrame, kept: list[str]) -> DataFrame:
    """A row per item: the ``kept`` columns, its state, the reasons that single claims give, and its claims that state
    gold values, in order."""
    claims, flags = _claim_flags(claims)
    some = lambda c: F.array_distinct(F.filter(F.transform("stated", lambda x: x[c]), lambda p: p != ""))
    backed = F.array_distinct(F.filter(F.transform("backed", lambda x: x["period"]), lambda p: p != ""))
    one = F.struct("nth", F.col("figure.start").alias("start"), F.col("figure.end").alias("end"), F.col("n_sentence").alias("sentence"), "computed", backed.alias("periods"), some("period").alias("own_periods"), some("entity").alias("entities"))
    counts = F.col("counts")
    # by question too, as the rows lie by question already
    rows = claims.groupBy("question_id", "item_id").agg(
        F.first(F.struct(*kept)).alias("item"), N.state_by(counts, "stated_values").alias("state"), *[_flag(counts & c).alias(r) for r, c in flags.items()], F.array_sort(F.collect_list(F.when(counts & (F.size("stated_values") > 0), one))).alias("claims")
    )
    return rows.select("*", "item.*").drop("item")


def _word_flags(rows: DataFrame) -> tuple[DataFrame, dict[str, Column]]:
    """The words of items (``w``), and for each reason that single words give, whether a word gives it beside the claim that owns it."""
    text, start, end = F.col("text"), F.col("w.start"), F.col("w.end")
    rows = rows.withColumns({"before": N.cut(text, F.lit(0), start), "sentence": N.cut(text, N.begins_at(F.col("breaks.sentence"), start), N.ends_at(F.col("breaks.sentence"), end, text))})
    rows = rows.withColumns({"clause": N.cut(text, N.begins_at(F.col("breaks.clause"), start), start), "mine": F.filter("claims", lambda c: c["sentence"] == F.col("sentence"))})
    prev, after = F.try_element_at(F.filter("mine", lambda c: c["end"] <= start), F.lit(-1)), F.get(F.filter("mine", lambda c: c["start"] >= end), F.lit(0))
    rows = rows.withColumns({"prev": prev, "next": after})
    rows = rows.withColumn("gap", N.cut(text, end, F.col("next.start")))
    between = F.size(F.filter(F.split("gap", r"\s+"), lambda x: x != ""))
    close = F.col("next").isNotNull() & (between <= 3) & ~F.col("gap").rlike(r"[;,.:]\s") & ~F.col("gap").rlike("(?i)" + PERIOD)
    owner = F.when(F.col("prev").isNotNull() & F.col("before").rlike(OWNED), F.col("prev")).when(close, F.col("next")).otherwise(F.coalesce("prev", "next"))
    rows = rows.withColumn("owner", owner)
    what, word, later, earlier = F.col("w.what"), F.col("w.word"), F.col("later"), F.col("earlier")
    every = lambda c: F.array_distinct(F.flatten(F.transform("claims", lambda x: x[c])))
    of_change = F.when(F.col("clause").rlike(r"\bbetween\b"), F.array(earlier, later)).when(F.col("before").rlike(EARLIER), F.array(earlier)).otherwise(F.array(later))
    allowed = F.when(F.col("owner").isNull(), every("own_periods")).when(F.col("owner.computed") & later.isNotNull(), of_change).otherwise(F.col("owner.periods"))
    said = F.when(what == "this", later).when(what == "last", earlier).otherwise(T.normalise_period(word))
    dated = (what == "period") | (what.isin("this", "last") & later.isNotNull())
    wrong_year = dated & (F.size(allowed) > 0) & ~F.coalesce(F.array_contains(allowed, said), F.lit(False))
    left, right = F.regexp_extract("before", r"((?:[A-Z][\w&.'-]*\s+)+)$", 1), F.regexp_extract(F.substr(text, end + 1), r"^((?:\s+[A-Z][\w&.'-]*)*)", 1)
    name = F.concat(left, word, right)
    in_name = (name != word) & F.contains(F.coalesce("question", F.lit("")), F.rtrim(F.trim(name), F.lit("'s")))
    entities = F.when(F.col("owner").isNull(), every("entities")).otherwise(F.col("owner.entities"))
    wrong_entity = (what == "entity") & ~F.col("before").rlike(LINE_ITEM) & ~in_name & (F.size(entities) > 0) & ~F.coalesce(F.array_contains(entities, T.entity_of(word)), F.lit(False))
    unit = F.lower(word)
    power = F.when(F.startswith(unit, F.lit("million")), 6).when(F.startswith(unit, F.lit("billion")), 9).otherwise(3)
    wrong_unit = (what == "unit") & (F.size("mine") == 0) & ~F.array_contains("scales", power)
    ways = F.create_map(*[F.lit(x) for w, two in direction_words().items() for x in (w, two[0])])
    goes = F.coalesce(F.try_element_at(ways, unit), F.when(unit.rlike(MORE), "up").when(unit.rlike(LESS), "down"))
    of_loss = F.col("change.losses") & F.col("sentence").rlike(N.LOSS)
    moved = F.when(of_loss, F.col("change.size")).otherwise(F.col("change.signed"))
    unchecked = (what == "direction") & (F.col("change").isNull() | (of_loss & unit.rlike(JUDGES)) | goes.isNull() | ~goes.eqNullSafe(moved))
    return rows, {NOT_YEAR: wrong_year, NOT_ENTITY: wrong_entity, NOT_UNIT: wrong_unit, NOT_MOVED: unchecked}


def triage_reasons(items: DataFrame, questions: DataFrame, gold: DataFrame, cells: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """item_id, state, reasons: why a person must label each answer, in order; none where code can.

    ``items``: item_id, question_id, evidence_id, text, question, question_type, thinking_leak, scales and currencies (arrays, of the
    evidence's tables). ``questions``: question_id, evidence_id, program. ``gold``: question_id, nth, role, kind, value, cell.
    Null texts are empty answers; types that only a person can label have that reason alone.
    """
    contexts = N.question_contexts(questions, gold, cells)
    own = ["text", "question", "question_type", "thinking_leak", "scales", "currencies"]
    items = items.select("item_id", "question_id", "evidence_id", *own).withColumn("text", F.coalesce("text", F.lit("")))
    rows = _by_item(_claim_rows(items, contexts, gold, vocabulary), [*own, "breaks", "wordings", "change", "earlier", "later", "changes", "program", "primary", "entities_differ"])
    useful, by_person = F.col("state") == "supported_useful", F.col("question_type").isin(*BY_PERSON)
    # words matter where nothing else sends the answer to a person
    words = F.when(useful & ~F.coalesce(by_person, F.lit(False)), F.col("wordings"))
    rows, flags = _word_flags(rows.withColumn("w", F.explode_outer(words)))
    each = [NOT_LEVEL, NOT_METRIC, NOT_LOSS, NOT_MONEY]
    shown = F.first(F.struct(*[c for c in own if c not in ("question", "scales")], "state", "entities_differ", "changes", "program", "primary", *[F.col(f"`{r}`") for r in each])).alias("item")
    rows = rows.groupBy("question_id", "item_id").agg(shown, *[_flag(c).alias(r) for r, c in flags.items()]).select("*", "item.*")
    points_fit = F.coalesce((F.col("primary") == "percent") & F.col("changes") & ~F.startswith("program", F.lit("growth(")), F.lit(False))
    text = F.col("text")
    when = lambda c, reason: F.when(F.coalesce(c, F.lit(False)), F.lit(reason))
    *wording, points_said = T.WORDING.items()
    reasons = [
        when(F.col("thinking_leak"), "thinking leak"), *[when(F.col("state") == s, r) for s, r in STATE_REASONS.items()], when(F.col("entities_differ"), "a difference between two entities"), *[when(text.rlike(p), r) for r, p in wording],
        when(text.rlike(points_said[1]) & ~points_fit, points_said[0]), when(F.size(T.foreign_currencies(text, F.col("currencies"))) > 0, "a currency the report does not use"),
        *[when(useful & F.col(f"`{r}`"), r) for r in (NOT_MOVED, NOT_YEAR, NOT_ENTITY, NOT_LEVEL, NOT_METRIC, NOT_LOSS, NOT_MONEY, NOT_UNIT)],
    ]
    found = F.when(by_person, F.array(F.concat("question_type", F.lit(" question")))).when(F.trim(text) == "", F.array(F.lit("empty answer"))).otherwise(F.array_compact(F.array(*reasons)))
    return rows.select("item_id", "state", found.alias("reasons"))
