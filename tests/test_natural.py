"""Natural answers: readings of losses, changes, ratios and constants, and the reasons that send an answer to a person."""

import pytest

from cellwright.operators import claims as C
from cellwright.operators import natural as N
from cellwright.operators import scoring, triage

# net result and charges of one report, in thousands; a ratio and a rate
CELLS = [
    ("e1", "a1", "net result", "group", "2023", -80_000.0, 3, "Net result"), ("e1", "a2", "net result", "group", "2022", -95_000.0, 3, "Net result"), ("e1", "b1", "net sales", "group", "2023", 540_000.0, 3, "Net sales"),
    ("e1", "b2", "net sales", "group", "2022", 500_000.0, 3, "Net sales"), ("e1", "c1", "loss on disposal", "group", "2023", 7_000.0, 3, "Loss on disposal"), ("e1", "d1", "current ratio", "group", "2023", 2.08, 0, "Current ratio"),
    ("e1", "b3", "net sales", "bank", "2023", 210_000.0, 3, "Net sales"), ("e1", "s1", "shares", "group", "2023", 1_250_300.0, 0, "Shares"),
]
# question: program, gold values (role, kind, value, cell), type
QUESTIONS = {
    "level": ("a1", [("answer", "amount", -80_000_000.0, "a1")], "lookup"),
    "narrower": ("diff(a1, a2)", [("answer", "amount", 15_000_000.0, None), ("operand", "amount", -80_000_000.0, "a1"), ("operand", "amount", -95_000_000.0, "a2")], "difference"),
    "sales": ("b1 - b2", [("answer", "amount", 40_000_000.0, None), ("operand", "amount", 540_000_000.0, "b1"), ("operand", "amount", 500_000_000.0, "b2")], "difference"),
    "fall": ("diff(b2, b1)", [("answer", "amount", 40_000_000.0, None), ("operand", "amount", 500_000_000.0, "b2"), ("operand", "amount", 540_000_000.0, "b1")], "difference"),
    "growth": ("growth(b1, b2)", [("answer", "percent", 8.0, None), ("operand", "amount", 540_000_000.0, "b1"), ("operand", "amount", 500_000_000.0, "b2")], "growth"),
    "disposal": ("c1", [("answer", "amount", 7_000_000.0, "c1")], "lookup"),
    "ratio": ("d1", [("answer", "ratio", 2.08, "d1")], "ratio"),
    "of_sales": ("b1 / b2 * 100", [("answer", "percent", 108.0, None), ("operand", "amount", 540_000_000.0, "b1"), ("operand", "amount", 500_000_000.0, "b2")], "ratio"),
    "entities": ("b1 - b3", [("answer", "amount", 330_000_000.0, None), ("operand", "amount", 540_000_000.0, "b1"), ("operand", "amount", 210_000_000.0, "b3")], "difference"),
    "shares": ("s1", [("answer", "amount", 1_250_300.0, "s1")], "lookup"),
    "told": ("b1", [("answer", "amount", 540_000_000.0, "b1")], "narrative"),
}
GOOD, BAD, UNHELPFUL = "supported_useful", "unsupported", "supported_unhelpful"
SCORED = [
    ("level", "The net loss was Rs. 80,000 thousand.", GOOD, BAD), ("level", "The net result was Rs. 80,000 thousand.", BAD, BAD), ("level", "A loss before income of Rs. 80,000 thousand.", BAD, BAD), ("level", "The profit or loss was Rs. 80,000 thousand.", BAD, BAD),
    ("level", "A loss, for approx. Rs. 80,000 thousand.", BAD, BAD), ("level", "A loss of approx. Rs. 80,000 thousand.", GOOD, BAD), ("level", "The result of (80,000) is shown.", GOOD, BAD), ("level", "It was -80,000,000.", GOOD, GOOD),
    ("disposal", "A loss on disposal of Rs. 7,000 thousand.", GOOD, GOOD), ("disposal", "The charge was Rs. 7,000 thousand.", GOOD, GOOD),
    ("narrower", "The net loss narrowed by Rs. 15,000 thousand.", GOOD, GOOD), ("narrower", "The net loss decreased by Rs. 15,000 thousand.", GOOD, BAD), ("narrower", "The net loss increased by Rs. 15,000 thousand.", BAD, GOOD), ("narrower", "The net loss improved by Rs. 15,000 thousand.", BAD, GOOD),
    ("narrower", "The result increased by Rs. 15,000 thousand.", GOOD, GOOD), ("narrower", "The result increased by Rs. -15,000 thousand.", BAD, BAD),
    ("fall", "Net sales rose by Rs. 40,000 thousand.", GOOD, GOOD), ("fall", "Net sales fell by Rs. 40,000 thousand.", BAD, BAD),
    ("sales", "Net sales rose from Rs. 500,000 thousand to Rs. 540,000 thousand.", UNHELPFUL, UNHELPFUL), ("growth", "Net sales grew by 8.0%.", GOOD, GOOD), ("growth", "Net sales fell 8.0%.", BAD, BAD),
    ("ratio", "The ratio was 208%.", GOOD, BAD), ("ratio", "The ratio grew 208%.", BAD, BAD), ("ratio", "The ratio was 2.08:1.", GOOD, BAD), ("of_sales", "540,000 / 500,000 × 100 = 108%.", GOOD, BAD), ("of_sales", "540,000 over 500,000, 100 of them, is 108%.", BAD, BAD),
    ("level", None, "abstained", "abstained"), ("level", "Nothing is said.", UNHELPFUL, UNHELPFUL),
]
REASONED = [
    ("sales", "Net sales of the group rose by Rs. 40,000 thousand in 2023.", []), ("sales", "Net sales of the group rose by Rs. 40,000 thousand in 2022.", [triage.NOT_YEAR]), ("sales", "Net sales rose by Rs. 40,000 thousand compared with 2022.", []),
    ("sales", "Net sales rose by Rs. 40,000 thousand this year.", []), ("sales", "Net sales rose by Rs. 40,000 thousand last year.", [triage.NOT_YEAR]), ("sales", "Net sales rose by Rs. 40,000 thousand between 2022 and 2023.", []),
    ("sales", "Net sales fell by Rs. 40,000 thousand.", [triage.STATE_REASONS[BAD]]), ("sales", "Net sales changed by Rs. 40,000 thousand; they improved.", []), ("sales", "Net sales changed by Rs. 40,000 thousand; they slipped.", [triage.NOT_MOVED]),
    ("sales", "Net sales rose by Rs. 40,000 thousand, from Rs. 500,000 thousand to Rs. 540,000 thousand.", []), ("sales", "Net sales rose by Rs. 40,000 thousand, to Rs. 500,000 thousand.", [triage.NOT_LEVEL]),
    ("sales", "Shares rose by Rs. 40,000 thousand.", [triage.NOT_METRIC]), ("sales", "Net sales rose by Rs. 40,000 thousand. Figures are in millions.", [triage.NOT_UNIT]), ("sales", "Net sales rose by Rs. 40,000 thousand. Figures are in thousands.", []),
    ("disposal", "The company's loss on disposal was Rs. 7,000 thousand.", [triage.NOT_ENTITY]), ("disposal", "The charge to owners of the company was Rs. 7,000 thousand.", []), ("disposal", "Acme Bank Ltd had charges of Rs. 7,000 thousand.", []), ("disposal", "Acme bank had charges of Rs. 7,000 thousand.", [triage.NOT_ENTITY]),
    ("told", "Net sales were Rs. 540,000 thousand.", ["narrative question"]), ("level", " ", ["empty answer"]), ("level", None, ["empty answer"]), ("entities", "The difference is Rs. 330,000 thousand.", ["a difference between two entities"]),
    ("shares", "There are 1,250,300 Rs. of them.", []), ("shares", "There are no 1,250,300.", ["a negation, hedge or guess"]), ("disposal", "The charge was 7,000 Rs. then.", [triage.NOT_MONEY]), ("disposal", "The charge was $7,000 thousand.", ["a currency the report does not use"]),
    ("growth", "Net sales grew by 8.0% or 8 percentage points.", ["percentage points"]), ("disposal", "The charge was Rs. 7,000 thousand, driven by halved demand in the third quarter.", ["an explanation or judgement", "a figure in words or a fraction", "a quarter or part of a year", triage.NOT_MOVED]),
    ("shares", "Against a loss, the group had 1,250,300.", [triage.NOT_LOSS]), ("level", "Nothing.", [triage.STATE_REASONS[UNHELPFUL]]),
]


@pytest.fixture(scope="module")
def world(spark):
    cells = spark.createDataFrame(
        [(e, i, m, ent, p, v, v * 10**s, s, "amount", label, n) for n, (e, i, m, ent, p, v, s, label) in enumerate(CELLS)],
        "evidence_id string, id string, metric string, entity string, period string, raw double, value double, scale int, kind string, row_label string, seq int",
    )
    questions = spark.createDataFrame([(q, "e1", p) for q, (p, _, _) in QUESTIONS.items()], "question_id string, evidence_id string, program string")
    gold = spark.createDataFrame([(q, n, *g) for q, (_, values, _) in QUESTIONS.items() for n, g in enumerate(values)], "question_id string, nth int, role string, kind string, value double, cell string")
    return cells, questions, gold


def test_states_of_natural_and_template_answers(spark, world):
    cells, questions, gold = world
    texts = spark.createDataFrame([(str(i), q, t) for i, (q, t, _, _) in enumerate(SCORED)], "item_id string, question_id string, text string")
    contexts = N.question_contexts(questions, gold, cells)
    natural = {r.item_id: r.state for r in scoring.score_texts(texts, gold, contexts).collect()}
    plain = {r.item_id: r.state for r in scoring.score_texts(texts, gold).collect()}
    assert [(t, natural[str(i)]) for i, (_, t, _, _) in enumerate(SCORED)] == [(t, s) for _, t, s, _ in SCORED]
    assert [(t, plain[str(i)]) for i, (_, t, _, _) in enumerate(SCORED)] == [(t, s) for _, t, _, s in SCORED]


def test_reasons(spark, world):
    cells, questions, gold = world
    rows = [(str(i), q, "e1", t, "What were Acme Bank Ltd's charges?", QUESTIONS[q][2], False, [3], ["LKR"]) for i, (q, t, _) in enumerate(REASONED)]
    items = spark.createDataFrame(rows, "item_id string, question_id string, evidence_id string, text string, question string, question_type string, thinking_leak boolean, scales array<int>, currencies array<string>")
    got = {r.item_id: r.reasons for r in triage.triage_reasons(items, questions, gold, cells, C.vocabularies(cells)).collect()}
    assert [(t, got[str(i)]) for i, (_, t, _) in enumerate(REASONED)] == [(t, r) for _, t, r in REASONED]
    leaked = triage.triage_reasons(items.limit(1).selectExpr("* except (thinking_leak)", "true AS thinking_leak"), questions, gold, cells, C.vocabularies(cells)).collect()
    assert leaked[0].reasons == ["thinking leak"]
    assert triage.triage_reasons(items.where("false"), questions, gold, cells, C.vocabularies(cells)).count() == 0


def _python_steps(rows):
    return rows._jdf.queryExecution().optimizedPlan().toString().count("ArrowEvalPython")


def test_triage_reads_each_text_once(spark, world):
    cells, questions, gold = world
    items = spark.createDataFrame([("1", "sales", "e1", "Net sales rose by 40,000.", "", "difference", False, [3], ["LKR"])], "item_id string, question_id string, evidence_id string, text string, question string, question_type string, thinking_leak boolean, scales array<int>, currencies array<string>")
    assert _python_steps(triage.triage_reasons(items, questions, gold, cells, C.vocabularies(cells))) == 1


def test_words_of_movement_are_whole_words():
    text = "It NARROWED, narrow_er and ups; up-to 2023, the group's shrunken 3 millions (eased)."
    assert [(what, word) for what, start, end, word in triage.placed_words(text) if text[start:end] == word] == [
        ("direction", "NARROWED"), ("direction", "narrow_er"), ("direction", "up"), ("direction", "shrunken"), ("direction", "eased"), ("period", "2023"), ("entity", "group"), ("unit", "millions"),
    ]


def test_both_scores_come_from_one_reading(spark, world):
    cells, questions, gold = world
    texts = spark.createDataFrame([(str(i), q, t) for i, (q, t, _, _) in enumerate(SCORED)], "item_id string, question_id string, text string")
    both = scoring.score_both(texts, gold, N.question_contexts(questions, gold, cells))
    assert _python_steps(both) == 1
    got = {r.item_id: (r.state, r.template_state) for r in both.collect()}
    assert [got[str(i)] for i in range(len(SCORED))] == [(natural, plain) for _, _, natural, plain in SCORED]
