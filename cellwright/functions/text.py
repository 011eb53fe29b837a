"""Labels, periods and wording as Column expressions; nothing here leaves the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that name a reporting entity, and the entity each one stands for.
ENTITY_WORDS = {"group": "group", "consolidated": "group", "bank": "bank", "company": "company", "parent": "company", "standalone": "company"}
# Fixed patterns: the first statement of a scale that fits gives the power of ten.
SCALES = [
    (r"['’‘]000|in thousands|thousands of|(rs\.?|lkr|usd|us\$|\$)\s?000\b", 3),
    (r"in millions|millions of|\bmn\b|\(million|\bmillion\)", 6),
    (r"in billions|billions of|\bbn\b", 9),
]
# Fixed patterns: a year with what may follow it, and a short fiscal year.
YEAR = r"(?i)(?<!\d)(?:FY\s?)?((?:19|20)\d{2})(?:\s?[/-]\s?(\d{2,4}))?(?!\d)"
SHORT_YEAR = r"(?i)\bFY\s?(\d{2})\b"
# Fixed patterns: wording of which code can't vouch, by reason.
WORDING = {
    "a negation, hedge or guess": (
        r"(?i)\b(?:not|no|never|neither|nor|cannot|unable|lacks?|lacking|unavailable|missing|absent|without|impossible|insufficient"
        r"|only|unknown|unclear|unspecified|undisclosed|fail(?:s|ed|ing)?|omit\w*|may|might|could|appears?|appeared|seems?|seemed"
        r"|assum\w*|possibly|presumably|likely|uncertain\w*|estimat\w*)\b|n't\b"
    ),
    "an explanation or judgement": (
        r"(?i)\b(?:driven|drive[sn]?|driving|due to(?!\s+(?:depositors|banks|customers|other|related|the bank|holding))|because"
        r"|reflect\w*|indicat\w*|suggest\w*|owing|thanks to|supported by|as a result|mainly|primarily|largely|partly|chiefly|record|highest|lowest|peak|strong\w*|solid|healthy|robust|weak\w*"
        r"|leverag\w*|liquidity|stable|stability|significant\w*|substantial\w*|impressive|poor|concern\w*|efficien\w*|favou?rabl\w*"
        r"|positive|negative|good|bad|more|less|fewer|most|least|above|below|outperform\w*|underperform\w*)\b"
    ),
    "a figure in words or a fraction": (
        r"(?im)\b(?:one|two|three|four|five|six|seven|eight|nine|ten|eleven|twelve|thirteen|fourteen|fifteen|sixteen|seventeen|"
        r"eighteen|nineteen|twenty|thirty|forty|fifty|sixty|seventy|eighty|ninety|hundred)(?:[\s-]+\w+)?\s+"
        r"(?:percent|per cent|percentage points?|points?|times|thousand|million|billion|lakhs?|crores?)\b"
        r"|\b(?:half|halved|double[ds]?|doubling|twice|triple[ds]?|tripling|\w+fold|thirds?|quarters?|fifths?|sixths?|tenths?)\b"
        r"|(?<![\d%\s])\s*\b(?:percent|per cent)\b|\A\s*(?:percent|per cent)\b"
    ),
    "a quarter or part of a year": r"(?i)\b(?:quarter\w*|Q[1-4]|H[12]|half[- ]year\w*|interim|(?:three|six|nine|3|6|9)[- ]months?)\b",
    "percentage points": r"(?i)\b(?:percentage points?|pp|ppts?|bps|basis points?)\b",
}
# Fixed patterns: how a text names a currency.
CURRENCY_WORDS = [
    (r"(?i)\bIndian\b|\bINR\b|₹", "INR"), (r"(?i)\bRs\b\.?|\bLKR\b|\bSLR\b|\brupees?\b", "LKR"), (r"(?i)\$|\bUSD\b|\bdollars?\b", "USD"), (r"(?i)€|\bEUR\b|\beuros?\b", "EUR"),
    (r"(?i)£|\bGBP\b|\bsterling\b", "GBP"),
]


def _period_of(found: Column) -> Column:
    """The fiscal year of one match of YEAR: the later of both years that it names."""
    first, second = F.regexp_extract(found, YEAR, 1), F.regexp_extract(found, YEAR, 2)
    year = F.when(F.length(second) == 2, second.try_cast("int") + 2000).otherwise(second.try_cast("int"))
    return F.when(year > first.try_cast("int"), year.cast("string")).otherwise(first)


def years_in(text: Column) -> Column:
    """Every fiscal year that a text names, in order."""
    return F.transform(F.regexp_extract_all(text, F.lit(YEAR), F.lit(0)), _period_of)


def normalise_period(label: Column) -> Column:
    """The last fiscal year that a label names: FY2025, FY25, 2024/25 (2025), 2025; null without one."""
    short = F.regexp_extract(label, SHORT_YEAR, 1)
    return F.coalesce(F.try_element_at(years_in(label), F.lit(-1)), F.when(short != "", F.concat(F.lit("20"), short)))


def normalise_metric(label: Column) -> Column:
    """Lower case, without brackets, notes and years; & reads as and; signs other than % and ' are spaces."""
    out = F.lower(label)
    # Fixed patterns: what is no part of a line item's name.
    for pattern, by in ((r"\([^)]*\)|\bnote\s+\d+\b", " "), (r"(?<!\d)(?:fy\s?)?(?:19|20)\d{2}(?:\s?[/-]\s?\d{2,4})?(?!\d)", " "), ("&", " and "), (r"[^a-z0-9%' ]+", " "), (r"\s+", " ")):
        out = F.regexp_replace(out, pattern, by)
    return F.trim(out)


def entity_words(text: Column) -> Column:
    """The entities that a text names, in order."""
    table = F.create_map(*[F.lit(x) for pair in ENTITY_WORDS.items() for x in pair])
    words = F.split(F.lower(text), r"[^a-z]+")
    return F.filter(F.transform(words, lambda w: F.try_element_at(table, w)), lambda x: x.isNotNull())


def entity_of(label: Column) -> Column:
    """The first entity word of a label, as the entity it stands for."""
    return F.try_element_at(entity_words(label), F.lit(1))


def detect_scale(text: Column) -> Column:
    out = F.lit(0)
    for pattern, power in reversed(SCALES):
        out = F.when(F.lower(text).rlike(pattern), power).otherwise(out)
    return out


def wording_reasons(text: Column) -> Column:
    """The reasons of all kinds of wording that a text has, in the order listed."""
    return F.array_compact(F.array(*[F.when(text.rlike(p), F.lit(name)) for name, p in WORDING.items()]))


def foreign_currencies(text: Column, report: Column) -> Column:
    """Currencies that a text names and its report does not use."""
    return F.array_except(F.array_compact(F.array(*[F.when(text.rlike(p), F.lit(code)) for p, code in CURRENCY_WORDS])), report)


def strip_thinking(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"(?s)<think>.*?(</think>|$)", ""))


def camel_words(name: Column) -> Column:
    """A concept's name as words: NetIncomeLoss reads net income loss."""
    return F.lower(F.regexp_replace(name, r"(?<=[a-z0-9])(?=[A-Z])|(?<=[A-Z])(?=[A-Z][a-z])", " "))


def member_words(name: Column) -> Column:
    """A member's name as words, without the word that ends it."""
    return F.trim(F.regexp_replace(camel_words(name), r"\s*\b(member|segment)$", ""))


def matched_case(word: Column, like: Column) -> Column:
    """A word in the case of another: all capitals, a capital first, or as it is."""
    capital = F.concat(F.upper(F.substring(word, 1, 1)), F.substr(word, F.lit(2)))
    return F.when(like == F.upper(like), F.upper(word)).when(F.substring(like, 1, 1) == F.upper(F.substring(like, 1, 1)), capital).otherwise(word)


def spliced(text: Column, edits: Column) -> Column:
    """Replaces spans (structs start, end, new; no overlap) from right to left."""
    order = F.reverse(F.array_sort(edits))
    return F.aggregate(order, text, lambda t, e: F.concat(F.substr(t, F.lit(1), e["start"]), e["new"], F.substr(t, e["end"] + 1)))


def valid_question(text: Column, most: int = 300) -> Column:
    """At most so many signs of the basic plane, with Latin letters alone."""
    return (F.length(F.trim(text)).between(1, most)) & ~text.rlike(r"[^\u0000-￿]") & ~text.rlike(r"(?=\p{L})\P{IsLatin}")


def grounded(program: Column) -> Column:
    """Whether an expression has cells and the constants 1, 2, 100 and 1000 alone."""
    numbers = F.regexp_extract_all(F.regexp_replace(program, r"[A-Za-z_]\w*", ""), F.lit(r"(?<![A-Za-z_])\d+(?:\.\d+)?"), F.lit(0))
    return F.forall(numbers, lambda n: n.isin("1", "2", "100", "1000"))
