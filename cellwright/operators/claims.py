"""Claims in answers: every checkable figure with the words that govern it and the context that it speaks of.

Answers are short texts. All steps are Column expressions on one row: a claim sees its neighbours through the array of
figures it came from, so nothing is shuffled but the one join of answers to the vocabulary of their evidence.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellwright.functions import text as T
from cellwright.functions.figures import MONTHS, figures

# Words of movement upwards and the word that turns each round.
UP_DOWN = [
    ("rose", "fell"), ("rise", "fall"), ("rises", "falls"), ("risen", "fallen"), ("rising", "falling"), ("increased", "decreased"), ("increase", "decrease"), ("increases", "decreases"),
    ("increasing", "decreasing"), ("grew", "declined"), ("growth", "decline"), ("grow", "decline"), ("grows", "declines"), ("growing", "declining"), ("up", "down"), ("higher", "lower"), ("gained", "lost"),
    ("improved", "deteriorated"), ("climbed", "dropped"), ("jumped", "dropped"), ("expanded", "contracted"), ("advanced", "retreated"), ("larger", "smaller"),
]
# Words of movement downwards that turn to "rose" where no pair has them.
DOWN_ONLY = ("dropped", "drop", "drops", "shrank", "contracted", "lost", "retreated", "deteriorated")
# Words of movement that may follow a figure.
AFTER_FIGURE = ("increase", "decrease", "higher", "lower", "growth", "decline", "rise", "fall")
# Other names of line items.
ALIASES = {
    "profit after tax": ("net profit", "profit for the year", "pat", "net income", "profit after taxation"),
    "profit for the year": ("net profit", "profit after tax", "pat", "net income"),
    "net income": ("net profit", "net earnings", "profit after tax", "profit for the year"),
    "profit before tax": ("pbt", "profit before taxation", "profit before income tax", "pre tax profit"),
    "profit before income tax": ("pbt", "profit before tax", "pre tax profit"),
    "revenue": ("revenues", "turnover", "net sales", "sales", "total revenue"),
    "total revenue": ("revenue", "revenues", "turnover"),
    "gross income": ("total income",),
    "total assets": ("assets",),
    "earnings per share": ("eps",),
    "basic earnings per share": ("eps", "earnings per share"),
}
# Words that open no short name of a line item.
STOP_WORDS = ("and", "or", "of", "in", "on", "at", "to", "for", "from", "the", "a", "an", "with", "by")
# Fixed patterns: where sentences end, and how texts speak of periods, changes, levels and owners.
BREAK = r"(?<=[.!?;])\s+(?=[A-Z(])|\n+"
PERIOD_AFTER = (
    r"(?i)^\s*(?:(?:was\s+|were\s+)?(?:reported|recorded|recognised|recognized|posted)\s+)?"
    r"(?:in|for|during|at|as at|as of|at the end of|by the end of)\s+(?:the\s+)?"
    r"(?:(?:fiscal|financial)\s+)?(?:year\s+|period\s+)?(?:(?:ended|ending)\s+(?:on\s+)?)?"
    rf"(?:\d{{1,2}}(?:st|nd|rd|th)?\s+(?:{MONTHS})\s+|(?:{MONTHS})\s+\d{{1,2}},?\s+|(?:{MONTHS})\s+)?"
    r"((?:FY\s?)?(?:19|20)\d{2}(?:\s?[/-]\s?\d{2,4})?)"
)
PREVIOUS_YEAR = r"(?i)\b(?:previous|prior|preceding|last)\s+(?:financial\s+|fiscal\s+)?year\b"
PREVIOUS_AFTER = r"(?i)^\s*(?:(?:reported|recorded)\s+)?(?:in|for|during)\s+the\s+(?:previous|prior|preceding|last)\s+(?:financial\s+|fiscal\s+)?(?:year|period)\b"
ASIDE = r"^\s*\([^()]*\)|^\s*\)"
HOLDERS = r"(?i)\b(?:owners|(?:equity\s+)?holders|shareholders|stockholders)\s+of\s+the\s+(?:company|parent|bank)\b"
CHANGE_BEFORE = r"(?i)\b(?:by|changes? of|difference of|increase of|decrease of|growth of|decline of|rise of|fall of)\s*$"
LEVEL_BEFORE = r"(?i)\b(?:from|to|at|reached|totalled|totaled)\s*$"
CHANGE_WORD = r"(?i)\b(?:change[sd]?|growth|grew|movement|variation|year[- ]on[- ]year|yoy)\b"


def direction_words() -> dict[str, tuple[str, str]]:
    """Each word of movement, lower case: which way it says a figure went, and its opposite."""
    out: dict[str, tuple[str, str]] = {}
    for up, down in UP_DOWN:
        out[up], out[down] = ("up", down), ("down", up)
    return {w: ("down", "rose") for w in DOWN_ONLY} | out


def _word_map(part: int) -> Column:
    return F.create_map(*[F.lit(x) for w, two in direction_words().items() for x in (w, two[part])])


def _cut(text: Column, start: Column, end: Column) -> Column:
    """The code points from start (from 0) up to end."""
    return F.substr(text, start + 1, F.greatest(end - start, F.lit(0)))


def _spaced(text: Column) -> Column:
    return F.concat(F.lit(" "), text, F.lit(" "))


def vocabularies(cells: DataFrame) -> DataFrame:
    """evidence_id, surfaces (text, metric; longest first), entities, periods: the names in the cells of each evidence.

    A line item goes by its own name, by its other usual names unless another line item has one of them, and by its last
    three or more words where no other line item holds those.
    """
    names = cells.groupBy("evidence_id").agg(
        F.sort_array(F.collect_set(F.when(F.col("metric") != "", F.col("metric")))).alias("metrics"), F.sort_array(F.collect_set("entity")).alias("entities"), F.sort_array(F.collect_set("period")).alias("periods")
    )
    surface = lambda t, m: F.struct(t.alias("text"), m.alias("metric"))
    metrics = F.col("metrics")
    aliases = F.create_map(*[x for m, other in ALIASES.items() for x in (F.lit(m), F.array(*[F.lit(a) for a in other]))])
    named = F.transform(metrics, lambda m: surface(m, m))
    others = F.flatten(F.transform(metrics, lambda m: F.transform(F.coalesce(F.try_element_at(aliases, m), F.array().cast("array<string>")), lambda a: surface(a, m))))
    others = F.filter(others, lambda s: ~F.array_contains(metrics, s["text"]))
    out = names.withColumn("known", F.concat(named, others))

    def endings(m: Column) -> Column:
        words = F.split(m, " ")
        n = F.size(words)
        sizes = F.when(n >= 5, F.sequence(F.lit(3), F.greatest(n - 2, F.lit(3)))).otherwise(F.array().cast("array<int>"))
        kept = F.filter(sizes, lambda k: ~F.element_at(words, -k).isin(*STOP_WORDS))
        return F.transform(kept, lambda k: surface(F.array_join(F.slice(words, -k, k), " "), m))

    tails = F.array_distinct(F.flatten(F.transform(metrics, endings)))
    out = out.withColumn("tails", tails).withColumn("taken", F.transform("known", lambda s: s["text"]))
    own = F.filter(
        "tails",
        lambda s: ~F.array_contains("taken", s["text"])
        & (F.size(F.filter("tails", lambda o: o["text"] == s["text"])) == 1)
        & ~F.exists(metrics, lambda m: (m != s["metric"]) & F.contains(_spaced(m), _spaced(s["text"]))),
    )
    ordered = F.array_sort(F.transform(F.concat("known", own), lambda s, i: F.struct((-F.length(s["text"])).alias("size"), i.alias("nth"), s["text"].alias("text"), s["metric"].alias("metric"))))
    return out.select("evidence_id", F.transform(ordered, lambda s: surface(s["text"], s["metric"])).alias("surfaces"), "entities", "periods")


def metrics_named(text: Column, surfaces: Column) -> Column:
    """Line items that a text names, longest names first."""
    norm = _spaced(T.normalise_metric(text))
    return F.transform(F.filter(surfaces, lambda s: F.contains(norm, _spaced(s["text"]))), lambda s: s["metric"])


def metric_in(text: Column, surfaces: Column) -> Column:
    return F.try_element_at(metrics_named(text, surfaces), F.lit(1))


def entity_in(text: Column, entities: Column) -> Column:
    """The last entity of the evidence that a text names; owners of the company are none."""
    return F.try_element_at(F.filter(T.entity_words(F.regexp_replace(text, HOLDERS, " ")), lambda e: F.array_contains(entities, e)), F.lit(-1))


def _year_before(period: Column) -> Column:
    return (period.try_cast("int") - 1).cast("string")


def extract_claims(answers: DataFrame) -> DataFrame:
    """A row per figure of each answer (item_id, text; other columns carried): ``figure``, nth, claim_id, its sentence and
    clause, direction with its span, is_change and by_difference."""
    return placed_claims(answers.withColumn("figures", figures("text")).select("*", F.posexplode("figures").alias("nth", "figure")))


def placed_claims(claims: DataFrame) -> DataFrame:
    """What ``extract_claims`` says of figures, of rows with ``figure``, nth and all ``figures`` of their text."""
    text, nth, start, end = F.col("text"), F.col("nth"), F.col("figure.start"), F.col("figure.end")
    before_it, after_it = F.get("figures", nth - 1)["end"], F.get("figures", nth + 1)["start"]
    s_start = F.length(F.regexp_extract(F.substr(text, F.lit(1), start + 1), rf"(?s)^.*(?:{BREAK})", 0))
    ahead = F.when(start > 0, 1).otherwise(0)
    s_end = start - ahead + F.length(F.regexp_extract(F.substr(text, start + 1 - ahead), rf"(?s)^.{{1}}?.*?(?=(?:{BREAK})|\z)", 0))
    claims = claims.withColumns({"s_start": F.least(s_start, start), "s_end": F.greatest(s_end, end), "c_start": F.greatest(F.least(s_start, start), F.coalesce(before_it, F.lit(0)))})
    claims = claims.withColumns(
        {
            "claim_id": F.concat(F.lit("k"), nth + 1), "clause": _cut(text, F.col("c_start"), start), "so_far": _cut(text, F.col("s_start"), start),
            "sentence": _cut(text, F.col("s_start"), F.col("s_end")), "after": _cut(text, end, F.least(F.coalesce(after_it, F.col("s_end")), F.col("s_end"))), "to_end": _cut(text, end, F.col("s_end")),
        }
    )
    # the last word of movement among the six words before the figure
    words, ways = F.regexp_extract_all("clause", F.lit("[A-Za-z]+|[^A-Za-z]+"), F.lit(0)), _word_map(0)
    claims = claims.withColumn("words", words)
    at = F.filter(F.sequence(F.lit(1), F.greatest(F.size("words"), F.lit(1))), lambda i: F.try_element_at("words", i).rlike("^[A-Za-z]"))
    last = F.when(F.size(at) > 6, F.slice(at, -6, 6)).otherwise(at)
    hit = F.try_element_at(F.filter(last, lambda i: F.map_contains_key(ways, F.lower(F.try_element_at("words", i)))), F.lit(-1))
    claims = claims.withColumn("hit", hit)
    offset = F.aggregate(F.slice("words", 1, F.greatest(F.col("hit") - 1, F.lit(0))), F.lit(0), lambda n, w: n + F.length(w))
    follows = F.regexp_extract(F.substr(text, end + 1, F.lit(20)), r"^\s*(?:\w+\s+)?([A-Za-z]+)", 1)
    lead = F.length(F.regexp_extract(F.substr(text, end + 1, F.lit(20)), r"^(\s*(?:\w+\s+)?)[A-Za-z]+", 1))
    goes_on = F.lower(follows).isin(*AFTER_FIGURE)
    word = F.when(F.col("hit").isNotNull(), F.try_element_at("words", F.col("hit"))).when(goes_on, follows)
    w_start = F.when(F.col("hit").isNotNull(), F.col("c_start") + offset).when(goes_on, end + lead)
    claims = claims.withColumns({"direction_word": word, "w_start": w_start})
    claims = claims.withColumns({"direction": F.try_element_at(ways, F.lower("direction_word")), "w_end": F.col("w_start") + F.length("direction_word")})
    by = F.col("so_far").rlike(CHANGE_BEFORE)
    change = by | (~F.col("so_far").rlike(LEVEL_BEFORE) & (F.col("direction").isNotNull() | F.col("clause").rlike(CHANGE_WORD)))
    return claims.withColumns({"by_difference": by, "is_change": change}).drop("words", "hit", "figures")


def question_contexts(questions: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """Each question (evidence_id, question, asked_period) with what it asks about: q_metric, q_entity, q_period, and the
    names of its evidence. Of several years the latest is meant; without one, the evidence's latest."""
    rows = questions.join(vocabulary, "evidence_id", "left")
    none = F.array().cast("array<string>")
    rows = rows.withColumns({"entities": F.coalesce("entities", none), "periods": F.coalesce("periods", none), "surfaces": F.coalesce("surfaces", F.array().cast("array<struct<text:string,metric:string>>"))})
    asked = F.coalesce("question", F.lit(""))
    period = F.coalesce("asked_period", F.array_max(T.years_in(asked)), F.array_max("periods"))
    return rows.withColumns({"q_metric": metric_in(asked, F.col("surfaces")), "q_entity": entity_in(asked, F.col("entities")), "q_period": period})


def claim_contexts(claims: DataFrame) -> DataFrame:
    """What each claim is about: metric, entity, period, base_period, and ``named``, the line items named before it.

    ``claims`` come from ``extract_claims`` of rows with the columns of ``question_contexts``. The clause of a claim counts
    first, then its sentence, then the question; what stands before "than" is what a comparison is about.
    """
    surfaces, entities, default = F.col("surfaces"), F.col("entities"), F.col("q_period")
    clause, sentence, change = F.col("clause"), F.col("sentence"), F.col("is_change")
    metric = F.coalesce(metric_in(clause, surfaces), metric_in(sentence, surfaces), F.col("q_metric"))
    subject = F.when(clause.rlike(r"\bthan\b"), F.get(F.split(clause, r"\bthan\b", 2), F.lit(0))).otherwise("")
    entity = F.coalesce(*[entity_in(t, entities) for t in (subject, clause, F.col("so_far"), sentence)], F.col("q_entity"))
    claims = claims.withColumns({"metric": metric, "entity": entity, "years": F.array_sort(F.array_distinct(T.years_in(sentence)))})
    rest = F.when(F.regexp_replace("after", r"^[ (]+|[ (]+$", "") != "", F.col("after")).otherwise(F.col("to_end"))
    rest = F.regexp_replace(rest, ASIDE, "")
    years, n_years = F.col("years"), F.size("years")
    stated = F.regexp_extract(rest, PERIOD_AFTER, 1)
    in_clause = F.coalesce(T.normalise_period(clause), F.when(clause.rlike(PREVIOUS_YEAR), _year_before(default)))
    base_alone = change & (n_years == 1) & (years[0] < default) & (T.years_in(F.col("to_end")) == years) & (F.size(T.years_in(F.col("so_far"))) == 0)
    base_alone = F.coalesce(base_alone, F.lit(False))
    in_sentence = F.when(n_years == 1, years[0]).when((n_years > 1) & change, F.try_element_at(years, F.lit(-1))).otherwise(default)
    period = (
        F.when(~change & (stated != ""), T.normalise_period(stated))
        .when(~change & default.rlike(r"^\d+$") & rest.rlike(PREVIOUS_AFTER), _year_before(default))
        .when(base_alone, default)
        .otherwise(F.coalesce(F.when(~change, in_clause), in_sentence))
    )
    claims = claims.withColumns({"period": period, "base_alone": base_alone})
    base = F.when(F.col("base_alone"), years[0]).when(change & (n_years >= 2) & (years[0] != F.col("period")), years[0])
    named = F.array_distinct(metrics_named(_cut(F.col("text"), F.lit(0), F.col("figure.start")), surfaces))
    return claims.withColumns({"base_period": base, "named": named}).drop("base_alone", "years")
