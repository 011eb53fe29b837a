"""Outcome models, calibration, rank bootstraps and budgets against brute force on small tables."""

import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from cellwright.operators import budget, certify, outcome


def times(cluster, draw):
    u = (int(hashlib.sha256(f"{cluster}|{draw}".encode()).hexdigest()[:8], 16) + 0.5) / 2**32
    return sum(u > c for c in certify.POISSON_STEPS)


def interval(xs, level=0.95):
    xs = sorted(xs)
    at = lambda q: xs[min(len(xs) - 1, int(len(xs) * q))]
    return at((1 - level) / 2), at((1 + level) / 2)


def auroc(rows):
    pos, neg = [(s, m) for s, y, m in rows if y == 1], [(s, m) for s, y, m in rows if y == 0]
    whole = sum(m for _, m in pos) * sum(m for _, m in neg)
    return sum(a * b * ((s > t) + (s == t) / 2) for s, a in pos for t, b in neg) / whole if whole else None


@pytest.fixture(scope="module")
def scored(spark):
    rng = np.random.default_rng(2)
    rows = [(f"c{int(rng.integers(7))}", float(rng.integers(20)) / 20, int(rng.random() < 0.4)) for _ in range(200)]
    return rows, spark.createDataFrame(rows, "c string, s double, y int")


def test_rank_bootstrap_is_the_brute_force_one(scored):
    rows, frame = scored
    draws = [x for x in (auroc([(s, y, times(c, d)) for c, s, y in rows]) for d in range(60)) if x is not None]
    (got,) = certify.rank_bootstrap(frame, "c", "s", "y", 60).collect()
    assert (got.draws, got.clusters) == (len(draws), 7) and got.estimate == pytest.approx(auroc([(s, y, 1) for _, s, y in rows]))
    assert (got.low, got.high) == pytest.approx(interval(draws))
    (one,) = certify.rank_bootstrap(frame.where("c = 'c1'"), "c", "s", "y", 10).collect()
    assert (one.low, one.high, one.clusters) == (None, None, 1)
    (none,) = certify.rank_bootstrap(frame.where("false"), "c", "s", "y", 10).collect()
    assert (none.estimate, none.low, none.clusters) == (None, None, 0)


def test_ratio_bootstrap_of_groups(scored):
    rows, frame = scored
    states = frame.select("c", F.when(F.col("s") > 0.5, "abstained").when(F.col("y") == 1, "unsupported").otherwise("supported_useful").alias("state"), F.array(F.lit("all"), F.when(F.col("s") < 0.2, "low").otherwise("high")).alias("g"))
    got = {r.grp: r for r in certify.group_risk(states, "c", F.col("g"), draws=50).collect()}
    assert set(got) == {"all", "low", "high"}
    for grp, keep in (("all", lambda s: True), ("low", lambda s: s < 0.2), ("high", lambda s: s >= 0.2)):
        own = [(c, s, y) for c, s, y in rows if keep(s)]
        ratio = lambda d, own=own: (sum(times(c, d) * y for c, s, y in own if s <= 0.5), sum(times(c, d) for c, s, _ in own if s <= 0.5))
        xs = [h / b for h, b in map(ratio, range(50)) if b]
        assert (got[grp].low, got[grp].high) == pytest.approx(interval(xs)) and got[grp].items == len(own)
    (upper,) = certify.cluster_upper(states, "c", draws=50).collect()
    xs = [h / b for h, b in ((sum(times(c, d) * y for c, s, y in rows if s <= 0.5), sum(times(c, d) for c, s, _ in rows if s <= 0.5)) for d in range(50)) if b]
    assert upper.upper == pytest.approx(interval(xs, 0.9)[1])


def pooled(points):
    """Pool adjacent violators: (score, labels) in order."""
    blocks = []
    for p, ys in points:
        blocks.append([sum(ys), len(ys), [p]])
        while len(blocks) > 1 and blocks[-2][0] / blocks[-2][1] >= blocks[-1][0] / blocks[-1][1]:
            s, n, ps = blocks.pop()
            blocks[-1] = [blocks[-1][0] + s, blocks[-1][1] + n, blocks[-1][2] + ps]
    return {p: s / n for s, n, ps in blocks for p in ps}


def test_isotonic_and_temperature(spark, scored):
    rows, frame = scored
    rows = frame.select(F.col("s").alias("p"), F.col("y").alias("label"))
    points = {}
    for r in rows.collect():
        points.setdefault(r.p, []).append(r.label)
    want = pooled(sorted(points.items()))
    asked = spark.createDataFrame([(p,) for p in [*points, -1.0, 2.0]], "p double")
    got = {r.p: r.calibrated for r in outcome.calibrated(asked, outcome.isotonic_calibrator(rows)).collect()}
    assert all(got[p] == pytest.approx(v) for p, v in want.items())
    assert got[-1.0] == pytest.approx(want[min(want)]) and got[2.0] == pytest.approx(want[max(want)])
    loss = lambda t: -np.mean([math.log((q if y else 1 - q) + 1e-12) for p, ys in points.items() for y in ys for q in [1 / (1 + math.exp(-math.log(min(max(p, 1e-6), 1 - 1e-6) / max(1 - p, 1e-6)) / t))]])
    found = outcome.fit_temperature(rows)
    assert loss(found) <= min(loss(t) for t in np.geomspace(0.05, 20, 400)) + 1e-6


def test_claim_features_and_item_risk(spark):
    checks = spark.createDataFrame(
        [("i", 1, 10, 14, 2, 6, "supported", [], 1.0, "percent", "up"), ("i", 2, 20, 24, None, None, "unsupported", ["value", "sign"], None, "amount", None), ("j", 1, 0, 3, None, None, "unverifiable", None, None, None, None)],
        "item_id string, claim_id int, start int, end int, d_start int, d_end int, verdict string, slots array<string>, expected double, kind string, direction string",
    )
    tokens = spark.createDataFrame([("i", 0, 3, 0.2), ("i", 5, 9, 0.4), ("i", 13, 21, 0.75), ("j", 3, 5, 0.9)], "item_id string, start int, end int, p double")
    got = {(r.item_id, r.claim_id): r for r in outcome.claim_features(checks, tokens, ["item_id", "claim_id"]).collect()}
    one, two, none = got["i", 1], got["i", 2], got["j", 1]
    assert (one.a_max, round(one.a_mean, 9), one.a_any) == (0.75, 0.45, 1.0) and (one.b_supported, one.b_slots, one.b_has_expected, one.kind_percent, one.has_direction) == (1, 0, 1, 1, 1)
    assert (two.a_max, two.a_mean, two.b_unsupported, two.b_slots, two.b_has_expected) == (0.75, 0.75, 1, 2, 0) and (none.a_max, none.b_unverifiable, none.b_slots) == (0, 1, 0)
    claims = spark.createDataFrame([("a", 0.5), ("a", 0.2), ("b", 1.0), ("b", 0.1)], "item_id string, p double")
    risk = {r.item_id: r.risk for r in outcome.item_risk(claims, spark.createDataFrame([("a",), ("b",), ("c",)], "item_id string")).collect()}
    assert risk == pytest.approx({"a": 0.6, "b": 1.0, "c": 0.5})


def test_fusion_learns_weights(spark):
    rng = np.random.default_rng(4)
    x = rng.random((400, 10))
    y = (rng.random(400) < 1 / (1 + np.exp(-(4 * x[:, 5] - 2 * x[:, 0] - 1)))).astype(int)
    rows = spark.createDataFrame([(*map(float, a), int(b)) for a, b in zip(x, y, strict=True)], ", ".join(f"{c} double" for c in outcome.CLAIM_FEATURES) + ", label int")
    weights, intercept = outcome.fit_fusion(rows)
    assert weights[5] > 1.5 and weights[0] < -0.5
    # the gradient of the penalised loss is zero
    p = 1 / (1 + np.exp(-(x @ weights + intercept)))
    assert np.abs(x.T @ (p - y) + np.array(weights)).max() < 0.05 and abs((p - y).sum()) < 0.05
    assert rows.select(outcome.logistic(list(outcome.CLAIM_FEATURES), weights, intercept).alias("p")).first().p == pytest.approx(p[0])


def test_outcome_models(spark, tmp_path):
    rng = np.random.default_rng(7)
    rows = [(i, float(a), float(b), "unsupported" if a + rng.normal() * 0.1 > 0.6 else "supported_useful", "abstained") for i, (a, b) in enumerate(rng.random((400, 2)))]
    frame = spark.createDataFrame(rows, "id int, a double, b double, send string, repair string")
    models = outcome.OutcomeModels.fit(frame.where("id < 250"), ["a", "b"], rounds=8, depth=3)
    models.save(spark, str(tmp_path / "m"))
    again = outcome.OutcomeModels.load(spark, str(tmp_path / "m"))
    held = frame.where("id >= 250").unionByName(spark.createDataFrame([(1000, None, 0.5, None, None)], frame.schema))
    got, same = ({r.id: (r.p_unsafe, r.p_fix) for r in m.predict(held).collect()} for m in (models, again))
    assert got == same and all(fix == 0.0 for _, fix in got.values())
    labelled = [(got[i][0], int(send == "unsupported"), 1) for i, _, _, send, _ in rows[250:]]
    assert auroc(labelled) > 0.95


def test_probabilities_in_reasons_are_printed_by_their_exact_value(spark):
    ps = [0.0005, 0.0015, 0.0025, 0.0045, 0.0625, 0.1875, 0.9995, 1.0, 0.0, 0.002 / 4, 0.07 / 4, 1e-12, 0.29, 0.9999999, *[k / 4000 for k in range(4001)], *[k / 2048 for k in range(2049)]]
    rows = outcome.deployed_actions(spark.createDataFrame([(p, 0.0) for p in ps], "p_unsafe double, p_fix double"), "send<2,fix>2").collect()
    assert [(r.p_unsafe, r.reason.split()[1]) for r in rows] == [(p, f"{p:.3f}") for p in ps]


def test_given_scores_and_deployed_actions(spark):
    records = spark.createDataFrame([("a",), ("b",), ("c",)], "id string")
    scores = spark.createDataFrame([("a", 0.01, 0.5), ("b", 0.5, 0.95), ("c", 0.5, 0.9)], "id string, p_unsafe double, p_fix double")
    rows = outcome.deployed_actions(outcome.given_scores(records, scores, "id"), "send<0.02,fix>0.9").collect()
    assert {r.id: (r.action, r.reason) for r in rows} == {"a": ("send", "P(unsafe) 0.010 below 0.02"), "b": ("repair", "P(fix) 0.950 above 0.9"), "c": ("abstain", "neither sending nor repairing is safe enough")}
    with pytest.raises(Exception, match="no prediction for record c"):
        outcome.given_scores(records, scores.where("id <> 'c'"), "id").collect()


def test_samples_nest_and_budgets(spark):
    state = lambda i: "unsupported" if i % 10 == 0 else "supported_useful"
    rows = spark.createDataFrame([(i, [("s", state(i)), ("t", "abstained" if i % 2 else state(i))]) for i in range(90)], "id long, settings array<struct<setting:string,state:string>>")
    drawn = budget.samples(rows.select("id"), "id", [5, 20], 3).collect()
    for d in (1, 2, 3):
        by = sorted(range(90), key=lambda i: hashlib.sha256(f"{i}|{d}".encode()).hexdigest())
        assert {s: {r.id for r in drawn if (r.draw, r.size) == (d, s)} for s in (5, 20)} == {5: set(by[:5]), 20: set(by[:20])}
    decided = rows.select(F.inline("settings"))
    order = budget.setting_order(decided)
    assert [r.setting for r in order.orderBy("place").collect()] == ["s", "t"]
    curve = {r.calibration_items: r for r in budget.budget_curve(rows, decided, order, "id", [10, 80, 500], 4, 0.6, 0.05).collect()}
    assert set(curve) == {10, 80} and (curve[80].certified_share, curve[80].mean_test_useful_coverage) == (1.0, 0.9)
    need = budget.labels_needed(decided.where("setting = 's'"), order.where("setting = 's'").withColumn("place", F.lit(1)), 0.2, 0.05).first()
    unsafe, n = 9, 90
    first = next(k for k in range(2, 101) if certify.hoeffding_bentkus((unsafe - 0.2 * n + 0.2 * n) / 1.2 / n, n * k, 0.2 / 1.2) <= 0.05)
    assert need["items"] == first * n
    assert budget.labels_needed(decided.where("setting = 's'"), order.where("setting = 's'").withColumn("place", F.lit(1)), 0.05, 0.05).first()["items"] is None
    shares = budget.restored_share(spark.createDataFrame([("a", "unsupported", "supported_useful"), ("a", "unsupported", "abstained"), ("b", "abstained", "abstained")], "g string, send string, repair string"), ["g"])
    assert {r.g: (r.unsafe, r.restored) for r in shares.collect()} == {"a": (2, 0.5), "b": (0, None)}


def test_span_scores_by_characters(spark):
    from cellwright.operators.metrics import span_scores

    rng = np.random.default_rng(9)
    spans = lambda n: [(int(rng.integers(4)), int(a), int(a + rng.integers(-1, 9))) for a in rng.integers(0, 60, n)]
    gold, found = spans(30), spans(40)
    chars = lambda rows: {(i, c) for i, a, b in rows for c in range(a, b)}
    frame = lambda rows: spark.createDataFrame(rows, "i int, start int, end int")
    g, f = chars(gold), chars(found)
    (got,) = span_scores(frame(gold), frame(found), ["i"]).collect()
    assert (got.gold, got.found, got.hit) == (len(g), len(f), len(g & f)) and got.f1 == pytest.approx(2 * len(g & f) / (len(g) + len(f)))
    (none,) = span_scores(frame([]), frame([]), ["i"]).collect()
    assert (none.gold, none.hit, none.f1) == (0, 0, None)
