"""Answers against gold values, repairs against harm, replays of every action, and policies that choose one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellwright.operators import natural as N
from cellwright.operators.metrics import policy_metrics

# Slots of checks, types of questions, and what an action leaves an item in that is safe.
SLOTS = ("metric", "entity_scope", "period", "value", "sign", "scale_currency", "basis", "missing_operand", "unsupported_text")
QUESTION_TYPES = ("lookup", "difference", "growth", "ratio", "share", "sum", "average", "comparison", "count", "narrative", "other")
SAFE = ("supported_unhelpful", "supported_useful")
# The settings that policies are tried with.
SEND_BELOW = (0.005, 0.01, 0.02, 0.05, 0.1, 0.2, 0.3, 0.5)
FIX_ABOVE = (0.5, 0.6, 0.7, 0.8, 0.9, 0.95, 0.99)
RISK_BELOW = (0.25, 0.75, 1.01)
CONFIDENCE = (0.5, 0.6, 0.7, 0.8, 0.9, 0.95)


def score_texts(texts: DataFrame, gold: DataFrame, contexts: DataFrame | None = None) -> DataFrame:
    """item_id, state, wrong (figures that no gold value covers) of texts (item_id, question_id, text; null: nothing was sent).

    ``gold``: question_id, role (answer, operand, intermediate), kind, value, cell. Labelled kinds must agree; a bare number may be
    printed in thousands, millions or billions; a change counts with the sign that its word gives it. Natural answers come with
    the ``contexts`` of their questions, for the readings of ``natural``.
    """
    rows = N.natural_claims(N.read_texts(texts.select("item_id", "question_id", "text"), gold, contexts)).withColumn("stated", N.stated_values(F.col("natural")))
    # by question too, as the rows lie by question already
    return rows.groupBy("question_id", "item_id").agg(N.state_by(F.col("counts"), "stated").alias("state"), N.wrong_by(F.col("counts"), "stated").alias("wrong")).drop("question_id")


def score_both(texts: DataFrame, gold: DataFrame, contexts: DataFrame) -> DataFrame:
    """``score_texts`` of natural answers, and ``template_state``, their state as template answers, by one reading of each text."""
    rows = N.natural_claims(N.read_texts(texts.select("item_id", "question_id", "text"), gold, contexts))
    rows = rows.withColumns({"stated": N.stated_values(F.col("natural")), "plainly": N.stated_values(F.lit(False))})
    plain = N.state_by(F.col("figure").isNotNull(), "plainly").alias("template_state")
    return rows.groupBy("question_id", "item_id").agg(N.state_by(F.col("counts"), "stated").alias("state"), N.wrong_by(F.col("counts"), "stated").alias("wrong"), plain).drop("question_id")


def features(checks: DataFrame, verdicts: DataFrame, questions: DataFrame) -> DataFrame:
    """What is known of an item before any action: counts of its checks by verdict, kind and slot, and its question's type."""
    failing = F.col("verdict") != "supported"
    n = lambda c: F.count_if(c)
    counts = checks.groupBy("item_id").agg(
        n(F.col("verdict") == "supported").alias("n_supported"), n(F.col("verdict") == "unsupported").alias("n_unsupported"), n(F.col("verdict") == "unverifiable").alias("n_unverifiable"),
        F.sum(F.size("cells")).alias("n_links"), n(F.array_contains("slots", "missing_operand")).alias("missing_operands"),
        (F.bool_or(failing) & F.bool_and(~failing | F.col("expected").isNotNull())).cast("int").alias("evidence_sufficient"),
        n(F.col("figure.kind") == "percent").alias("n_percent_claims"), n(F.col("direction").isNotNull()).alias("n_directional_claims"),
        *[n(F.array_contains("slots", s)).alias(f"slot_{s}") for s in SLOTS],
    )
    rows = verdicts.join(counts, "item_id", "left").join(questions.select("item_id", "question_type"), "item_id", "left").fillna(0)
    return rows.withColumn("answers_question", F.col("answers_question").cast("int")).select("*", *[(F.col("question_type") == t).cast("int").alias(f"qtype_{t}") for t in QUESTION_TYPES]).drop("question_type")


def threshold_action(send_below: float = RISK_BELOW[0]) -> Column:
    """Send below a risk with at least one claim; repair where the evidence holds a value for every failing claim; else abstain."""
    return F.when((F.col("risk") < send_below) & (F.col("n_claims") > 0), "send").when(F.col("evidence_sufficient") > 0, "repair").otherwise("abstain")


def decide(rows: DataFrame, send_below: float = RISK_BELOW[0]) -> DataFrame:
    """item_id, action and its reason, of rows of ``features``."""
    action = threshold_action(send_below)
    reason = (
        F.when(action == "send", "every number traced to the evidence")
        .when(action == "repair", "the evidence holds the correct values")
        .when(F.col("n_claims") == 0, "no checkable number in the answer")
        .when(F.col("missing_operands") > 0, "the evidence lacks a value the answer needs")
        .otherwise("no rule can confirm or fix this answer")
    )
    return rows.select("item_id", "risk", action.alias("action"), reason.alias("decision_reason"))


def outcomes(decisions: DataFrame, sent: DataFrame, repaired: DataFrame) -> DataFrame:
    """Every action on every item: the states (item_id, state, wrong) of the original and of the repaired text, and which of
    them the decision leads to."""
    rows = decisions.join(sent.select("item_id", F.col("state").alias("send"), F.col("wrong").alias("wrong_before")), "item_id")
    rows = rows.join(repaired.select("item_id", F.col("state").alias("repair"), F.col("wrong").alias("wrong_after")), "item_id")
    final = F.when(F.col("action") == "send", F.col("send")).when(F.col("action") == "repair", F.col("repair")).otherwise("abstained")
    return rows.withColumns({"abstain": F.lit("abstained"), "final": final, "new_errors": F.array_except("wrong_after", "wrong_before")})


def replay_summary(records: DataFrame) -> DataFrame:
    """A row per strategy (policy, always_send, always_repair, oracle): its metrics, and how often the policy did as expected."""
    each = F.array(*[F.struct(F.lit(n).alias("strategy"), c.alias("state")) for n, c in (("policy", F.col("final")), ("always_send", F.col("send")), ("always_repair", F.col("repair")), ("oracle", state_of(oracle_action())))])
    rows = records.select(F.explode(each).alias("s")).select("s.*")
    accuracy = records.where("expected_action IS NOT NULL").agg(F.avg((F.col("action") == F.col("expected_action")).cast("double")).alias("action_accuracy"))
    return policy_metrics(rows, ["strategy"]).crossJoin(F.broadcast(accuracy))  # one row


def state_of(action: Column) -> Column:
    return F.when(action == "send", F.col("send")).when(action == "repair", F.col("repair")).otherwise("abstained")


def oracle_action() -> Column:
    """The best action with hindsight: a useful answer if any action gives one, else a safe one, else none."""
    return (
        F.when(F.col("send") == "supported_useful", "send").when(F.col("repair") == "supported_useful", "repair")
        .when(F.col("send").isin(*SAFE), "send").when(F.col("repair").isin(*SAFE), "repair").otherwise("abstain")
    )


def with_regret(metrics: DataFrame, strategy: str = "strategy") -> DataFrame:
    """Metrics of strategies with what each misses of the oracle's useful coverage."""
    best = metrics.where(F.col(strategy) == "oracle").select(F.col("useful_coverage").alias("best"))
    return metrics.crossJoin(F.broadcast(best)).withColumn("regret", F.col("best") - F.col("useful_coverage")).drop("best")  # one row


def repair_summary(rows: DataFrame, by: list[str]) -> DataFrame:
    """Correction against harm of repairs: rows with send, repair (states), status, attempts, new_errors; shares of 4 decimals,
    null where nothing counts."""
    needs, sent, tried = F.col("send") == "unsupported", F.col("repair") != "abstained", F.col("status") != "nothing_to_fix"
    share = lambda among, hit: F.round(F.avg(F.when(among, hit.cast("double"))), 4)
    return rows.groupBy(*by).agg(
        F.count("*").alias("items"), F.count_if(needs).alias("needing_repair"), share(needs, F.col("repair") == "supported_useful").alias("correction_rate"), share(needs, ~sent).alias("abstained_when_needed"),
        share(needs & sent, F.col("repair") == "unsupported").alias("still_wrong_when_sent"), share(sent, F.size("new_errors") > 0).alias("new_error_rate"), share(~needs, F.col("repair") == "unsupported").alias("damage_rate"),
        share(tried & F.col("status").isin("repaired", "gate_failed"), F.col("status") == "repaired").alias("gate_pass_rate"), F.coalesce(F.round(F.avg(F.when(tried, F.col("attempts"))), 3), F.lit(0.0)).alias("mean_attempts"),
        *[F.count_if(F.col("status") == s).alias(s) for s in ("repaired", "nothing_to_fix", "cannot_fix", "gate_failed")],
    )


def settings(families: list[str]) -> list[tuple[str, str, Column]]:
    """Family, name and action of every setting of the named families.

    Rows have risk, n_claims, evidence_sufficient, p_unsafe and p_fix, or p_clean, p_fixable and p_neither.
    """
    out: list[tuple[str, str, Column]] = []
    if "outcome_aware" in families:
        for s in SEND_BELOW:
            for f in FIX_ABOVE:
                out.append(("outcome_aware", f"send<{s},fix>{f}", F.when(F.col("p_unsafe") < s, "send").when(F.col("p_fix") > f, "repair").otherwise("abstain")))
    if "verified_only" in families:
        out += [("verified_only", f"risk<{t}", F.when(F.col("risk") < t, "send").otherwise("abstain")) for t in RISK_BELOW]
    if "threshold_v0" in families:
        out += [("threshold_v0", f"risk<{t}", threshold_action(t)) for t in RISK_BELOW]
    if "four_state" in families:
        p = [F.col(c) for c in ("p_clean", "p_fixable", "p_neither")]
        top = F.greatest(*p)
        best = F.when(p[0] == top, "send").when(p[1] == top, "repair").otherwise("abstain")
        out += [("four_state", f"conf>={c}", F.when(top >= c, best).otherwise("abstain")) for c in CONFIDENCE]
    if "fixed" in families:
        out += [("fixed", a, F.lit(a)) for a in ("send", "repair", "abstain")]
    if "oracle" in families:
        out.append(("oracle", "oracle", oracle_action()))
    return out


def setting_of(text: Column) -> Column:
    """The thresholds that a setting's name states: send_below and fix_above."""
    part = lambda p: F.regexp_extract(text, p, 1).try_cast("double")
    return F.struct(part(r"send<([\d.]+)").alias("send_below"), part(r"fix>([\d.]+)").alias("fix_above"))


def decided(records: DataFrame, families: list[str]) -> DataFrame:
    """Each record under each setting (a short literal grid): family, setting, action, state."""
    grid = F.array(*[F.struct(F.lit(f).alias("family"), F.lit(n).alias("setting"), a.alias("chosen")) for f, n, a in settings(families)])
    rows = records.select("*", F.explode(grid).alias("g")).select("*", "g.family", "g.setting", "g.chosen").drop("g")
    return rows.withColumn("state", state_of(F.col("chosen")))
