"""Rule channels, fusion schemes, interactions, ablation and missingness."""

from __future__ import annotations

from pyspark.sql import functions as F

from spanwise.functions.scalar import SAFETY_LEVELS, band, fused_mean
from spanwise.operators import scoring as sc
from spanwise.operators import windows as wn
from spanwise.plans.adapters import EV, EVENT_SEQ, event_frames, events, rnd
from spanwise.operators.ordered import balance
from spanwise.plans.config import Ablation, FusionConfig, Interaction, RuleConfig, RULES, RULE_WEIGHTS, with_sensitivity
from spanwise.plans.registry import query
from spanwise.plans.session import table

W = "PARTITION BY user_id ORDER BY t, event_id"

# ------------------------------------------------- rule channels on events


def features(spark, sf):
    d = events(spark, sf)
    v = F.col("value")
    d = d.select(
        "user_id", "event_id", "t", "event_type",
        (v / 150.0).alias("hip_vertical_velocity"), F.col("score").alias("head_vertical_velocity"),
        ((v * 3.0) % 90.0).alias("torso_angle_deg"), (F.col("event_id") % 40).alias("low_posture_duration_frames"),
        (F.col("score") / 5.0).alias("instability_score"), F.col("event_type").isin("view", "click", "error").alias("near_ground"),
        F.col("score").alias("guard_level"), ((v % 10.0) / 10.0).alias("facing_away_score"), ((v % 7.0) / 7.0).alias("reaction_delay_score"),
        ((v % 100.0) / 100.0).alias("anomaly_score"), ((v % 13.0) / 13.0).alias("strike_incoming_proxy"),
        (v % 3.0).alias("keypoint_position_variance"),
    )
    return balance(d, EVENT_SEQ)


def _c(x: str) -> str:
    return f"greatest(0.0, least(1.0, {x}))"


def _rules_sql(cfg: RuleConfig = RuleConfig()) -> str:
    def s(x, k):
        return _c(f"({x} - {k.threshold!r}) / {k.scale!r}")

    lo, hi = cfg.low_posture_min_frames, cfg.low_posture_full_frames
    up = cfg.post_fall_max_speed + cfg.post_fall_buffer
    return f"""{EV}, ft AS (SELECT user_id, event_id, t, value / 150.0 AS hip, score AS head, (value * 3.0) % 90.0 AS torso, event_id % 40 AS lowf,
 score / 5.0 AS inst, event_type IN ('view', 'click', 'error') AS near, score AS guard, (value % 10.0) / 10.0 AS face, (value % 7.0) / 7.0 AS react,
 (value % 100.0) / 100.0 AS anom, (value % 13.0) / 13.0 AS strike, value % 3.0 AS kvar, row_number() OVER ({W}) AS i FROM ev),
st AS (SELECT *, CASE WHEN near THEN i - coalesce(max(CASE WHEN NOT near THEN i END) OVER ({W}), 0) ELSE 0 END AS streak FROM ft),
c1 AS (SELECT *, {s("hip", cfg.fast_downward)} AS fast, {s("abs(torso)", cfg.large_torso)} AS tors,
 CASE WHEN lowf >= {lo} THEN {_c(f"(lowf - {lo}) / {hi - lo!r}")} ELSE 0.0 END AS lowp, {s("inst", cfg.instability)} AS insta,
 CASE WHEN near AND streak >= {cfg.post_fall_streak} THEN 1.0 - {_c(f"(abs(hip) + abs(head)) / {up!r}")} ELSE 0.0 END AS post,
 {s("guard", cfg.low_guard)} AS grd, {s("face", cfg.facing_away)} AS fac, {s("react", cfg.reaction_delay)} AS rea, {s("anom", cfg.limb)} AS limb,
 {s("strike", cfg.incoming_strike)} AS str FROM st),
c2 AS (SELECT *, sqrt({_c("greatest(grd, fac) * insta")}) AS loss, tors * fast AS dang, post * lowp AS urg, grd * str AS gs FROM c1)"""


COLS = ("fast", "tors", "lowp", "insta", "post", "grd", "fac", "rea", "loss", "dang", "urg", "gs", "limb")


def _triggers(eps: float) -> str:
    items = ", ".join(f"CASE WHEN {c} > {eps!r} THEN '{r}' END" for c, r in zip(COLS, RULES))
    return f"list_filter([{items}], lambda x: x IS NOT NULL)"


def _level(x: str, cuts=(0.25, 0.5, 0.75)) -> str:
    a, b, c = cuts
    return f"CASE WHEN {x} >= {c!r} THEN 'CRITICAL' WHEN {x} >= {b!r} THEN 'HIGH' WHEN {x} >= {a!r} THEN 'MEDIUM' ELSE 'LOW' END"


def _weighted(w=RULE_WEIGHTS) -> str:
    tot = sum(w.values())
    return _c(" + ".join(f"{w[r] / tot!r} * {c}" for c, r in zip(COLS, RULES)))


@query(
    "rule_components",
    f"WITH {_rules_sql()} SELECT user_id, event_id, " + ", ".join(f"round({c}, 9) AS c_{r}" for c, r in zip(COLS, RULES)) + " FROM c2",
)
def rule_components(spark, sf):
    d, seq = features(spark, sf)
    d = sc.rule_components(d, RuleConfig(), seq)
    return d.select("user_id", "event_id", *[rnd(f"c_{r}") for r in RULES])


NO_GUARD = {r for r in RULES} - {"low_guard", "high_risk_guard_strike", "facing_away", "loss_of_control", "limb_anomaly"}
ACTIVE_W = {r: (v if r in NO_GUARD else 0.0) for r, v in RULE_WEIGHTS.items()}


@query(
    "weighted_renormalised",
    f"WITH {_rules_sql()}, s AS (SELECT *, {_weighted(ACTIVE_W)} AS rs FROM c2) SELECT user_id, event_id, round(rs, 9) AS risk_score, {_level('rs')} AS risk_level FROM s",
)
def weighted_renormalised(spark, sf):
    d, seq = features(spark, sf)
    d = d.drop("guard_level", "facing_away_score", "anomaly_score")
    d = sc.score_frames(d, RuleConfig(), seq)
    return d.select("user_id", "event_id", rnd("risk_score"), "risk_level")


def _override(tbl: str, cuts=(0.25, 0.5, 0.75)) -> str:
    m, h, c = cuts
    lv = _level("rs", cuts)
    return f"""SELECT user_id, event_id, anom, CASE WHEN anom >= 0.8 THEN greatest(rs, {max(c, min(0.99, c + 0.1))!r}) WHEN anom >= 0.55 AND rs < {h!r}
 THEN greatest(rs, {max(h, min(0.99, h + 0.02))!r}) WHEN anom >= 0.55 THEN greatest(rs, {max(h, min(0.99, h + 0.01))!r}) ELSE rs END AS risk_score,
 CASE WHEN anom >= 0.8 THEN 'CRITICAL' WHEN anom >= 0.55 AND rs < {h!r} THEN 'HIGH' ELSE {lv} END AS risk_level,
 CASE WHEN anom >= 0.55 AND NOT list_contains(trig, 'limb_anomaly') THEN list_append(trig, 'limb_anomaly') ELSE trig END AS trig FROM {tbl}"""


def _frames_sql(cfg=RuleConfig()) -> str:
    return f"""WITH {_rules_sql(cfg)}, s AS (SELECT *, {_weighted()} AS rs, {_triggers(cfg.trigger_epsilon)} AS trig FROM c2), f AS ({_override("s", cfg.cuts)})
SELECT user_id, event_id, round(risk_score, 9) AS risk_score, risk_level, array_to_string(trig, ',') AS triggered_rules FROM f"""


def _frame_out(d):
    return d.select("user_id", "event_id", rnd("risk_score"), "risk_level", F.array_join("triggered_rules", ",").alias("triggered_rules"))


@query("score_frames", _frames_sql())
def score_frames(spark, sf):
    d, seq = features(spark, sf)
    return _frame_out(sc.score_frames(d, RuleConfig(), seq))


@query("sensitivity_high", _frames_sql(with_sensitivity(RuleConfig(), "high")))
def sensitivity_high(spark, sf):
    d, seq = features(spark, sf)
    return _frame_out(sc.score_frames(d, with_sensitivity(RuleConfig(), "high"), seq))


@query("sensitivity_low", _frames_sql(with_sensitivity(RuleConfig(), "low")))
def sensitivity_low(spark, sf):
    d, seq = features(spark, sf)
    return _frame_out(sc.score_frames(d, with_sensitivity(RuleConfig(), "low"), seq))


@query(
    "triggered_rule_counts",
    _frames_sql().replace("SELECT user_id, event_id, round(risk_score, 9) AS risk_score, risk_level, array_to_string(trig, ',') AS triggered_rules FROM f", "SELECT rule, count(*) AS n FROM (SELECT unnest(trig) AS rule FROM f) GROUP BY 1"),
)
def triggered_rule_counts(spark, sf):
    from spanwise.operators.metrics import triggered_rule_counts as trc

    d, seq = features(spark, sf)
    return trc(sc.score_frames(d, RuleConfig(), seq), "triggered_rules")


@query(
    "surrender_override",
    f"""WITH {EV} SELECT user_id, event_id, CASE WHEN event_type = 'error' AND score >= 0.4 THEN 1.0 ELSE round(score, 9) END AS risk_score,
 CASE WHEN event_type = 'error' AND score >= 0.4 THEN 'CRITICAL' ELSE risk_level END AS risk_level,
 CASE WHEN event_type = 'error' AND score >= 0.4 THEN event_type || ',surrender_gesture' ELSE event_type END AS triggered_rules FROM ev""",
)
def surrender_override(spark, sf):
    d = events(spark, sf).withColumns({"risk_score": F.col("score"), "triggered_rules": F.array("event_type")})
    return _frame_out(sc.surrender_override(d, (F.col("event_type") == "error") & (F.col("score") >= 0.4)))


@query(
    "legacy_risk_engine",
    f"""WITH {_rules_sql()}, a AS (SELECT *, count(*) OVER f AS c, quantile_cont(kvar, 0.5) OVER f AS md, abs(hip - lag(hip) OVER ({W})) AS jerk FROM st
 WINDOW f AS ({W} ROWS BETWEEN 8 PRECEDING AND CURRENT ROW)),
b AS (SELECT *, CASE WHEN abs(torso) > 28 AND hip > 0.45 THEN greatest(0.35, {_c("(torso - 28) / 20.0 * (hip - 0.45)")}) ELSE 0.0 END AS tilt,
 CASE WHEN NOT near THEN 0.0 WHEN streak > 20 THEN 1.0 ELSE 0.45 * (least(streak / 20.0, 1.0) ** 2) END AS ground,
 greatest(CASE WHEN c >= 2 THEN {_c("(kvar / (md + 1e-9) - 1.0) / 1.2000000000000002")} ELSE 0.0 END, {_c("coalesce(jerk, 0.0) / 3.5")}) AS err FROM a)
SELECT user_id, event_id, round(tilt, 9) AS tilt, round(ground, 9) AS ground, round(err, 9) AS erratic, round({_c("0.34 * tilt + 0.33 * ground + 0.33 * err")}, 9) AS risk_score FROM b""",
)
def legacy_risk_engine(spark, sf):
    d, seq = features(spark, sf)
    d = wn.streak(d, seq, F.col("near_ground"), "_streak")
    d = wn.features(d, seq, 8, 0, sc.legacy_stages())
    d = sc.legacy_score(d)
    return d.select(
        "user_id", "event_id", rnd("risk_from_tilt_velocity", "tilt"), rnd("risk_from_ground", "ground"), rnd("risk_from_erratic", "erratic"), rnd("risk_score")
    )


@query(
    "max_severity_fusion",
    f"""WITH {EV}, x AS (SELECT user_id, event_id, event_type = 'error' AS sd, (value % 10.0) / 10.0 AS sc, (value % 17.0) / 34.0 AS sl, (value % 11.0) / 11.0 AS fa,
 (value % 9.0) / 18.0 AS fr, (value % 7.0) / 14.0 AS ia, (value % 5.0) / 20.0 AS isc, (value % 13.0) / 16.0 AS li, (value % 3.0) / 4.0 AS hv, score AS ins,
 (value % 19.0) / 30.0 AS tb, (value % 23.0) / 40.0 AS lg FROM ev),
p AS (SELECT *, sd AND sc + 1e-4 >= 0.48 AS q1, sl + 1e-4 >= 0.46 AS q2, fa > 0.16 AS fall, greatest(ia, isc) AS ins2, hv AS hip FROM x),
q AS (SELECT *, q1 OR q2 AS sa, fall AND (ins2 + 1e-4 >= 0.32 OR ia + 1e-4 >= 0.3) AS dn, li + 1e-4 >= 0.78 AS lc,
 fall AND ((fr + 1e-4 >= 0.36 AND hip + 1e-4 >= 0.48) OR fr + 1e-4 >= 0.38 OR (hip + 1e-4 >= 0.48 AND fall)) AS fh0,
 li >= 0.52 - 1e-4 AND li < 0.78 - 1e-4 AS lh0, tb + 1e-4 >= 0.3 AND ins + 1e-4 >= 0.4 AS tn FROM p),
r AS (SELECT *, sa OR dn OR lc AS crit FROM q),
s AS (SELECT *, fh0 AND NOT crit AS fh, lh0 AND NOT crit AS lh FROM r),
u AS (SELECT *, greatest(CASE WHEN crit THEN 3 ELSE 0 END, CASE WHEN fh OR lh THEN 2 ELSE 0 END, CASE WHEN tn THEN CASE WHEN ins + 1e-4 >= 0.66 THEN 2 ELSE 1 END ELSE 0 END) AS k0 FROM s),
v AS (SELECT *, lg + 1e-4 >= 0.3 AND k0 = 0 AS gd FROM u),
z AS (SELECT *, CASE WHEN gd THEN 1 ELSE k0 END AS k, greatest(CASE WHEN sa THEN greatest(sc, sl) ELSE 0.0 END, CASE WHEN dn THEN least(1.0, 0.5 * ins2 + 0.5 * fa) ELSE 0.0 END,
 CASE WHEN lc OR lh THEN li ELSE 0.0 END, CASE WHEN fh THEN greatest(fr, least(1.0, 0.35 * hip + 0.3 * fr)) ELSE 0.0 END, CASE WHEN tn THEN 0.5 * (tb + ins) ELSE 0.0 END,
 CASE WHEN gd THEN lg * 0.7 ELSE 0.0 END) AS g0 FROM v),
y AS (SELECT *, greatest(0.0, least(1.0, CASE WHEN g0 <= 0 THEN greatest(0.12, lg * 0.4, li * 0.2, fa * 0.3) ELSE g0 END)) AS g FROM z)
SELECT user_id, event_id, CASE k WHEN 3 THEN 'CRITICAL' WHEN 2 THEN 'HIGH' WHEN 1 THEN 'MEDIUM' ELSE 'LOW' END AS level,
 round(least(1.0, (CASE k WHEN 3 THEN 0.86 WHEN 2 THEN 0.68 WHEN 1 THEN 0.4 ELSE 0.1 END) + 0.08 * (1.0 + g) * (1 + k)), 9) AS score,
 CAST(q1 AS INT) + CAST(q2 AND NOT q1 AS INT) + CAST(dn AS INT) + CAST(lc AS INT) + CAST(fh AS INT) + CAST(lh AS INT) + CAST(tn AS INT) + CAST(gd AS INT) AS n_triggers FROM y""",
)
def max_severity_fusion(spark, sf):
    v = lambda m, s: (F.col("value") % m) / s
    d = events(spark, sf).select(
        "user_id", "event_id", (F.col("event_type") == "error").alias("surrender_detected"), v(10.0, 10.0).alias("surrender_confidence"),
        v(17.0, 34.0).alias("surrender_like"), v(11.0, 11.0).alias("fall_any"), v(9.0, 18.0).alias("fall_rapid"), v(7.0, 14.0).alias("inactivity"),
        v(5.0, 20.0).alias("inactivity_score"), v(13.0, 16.0).alias("limb"), v(3.0, 4.0).alias("hip_velocity"), F.col("score").alias("instability"),
        v(19.0, 30.0).alias("turned_back"), v(23.0, 40.0).alias("low_guard"),
    )
    d = sc.max_severity(d)
    return d.select("user_id", "event_id", "level", rnd("score"), F.size("triggers").alias("n_triggers"))


@query(
    "band_levels_safety",
    f"""WITH {EV} SELECT event_id, CASE WHEN score >= 0.72 THEN 'CRITICAL' WHEN score >= 0.48 THEN 'HIGH' WHEN score >= 0.28 THEN 'WARNING' ELSE 'INFO' END AS safety_level FROM ev""",
)
def band_levels_safety(spark, sf):
    return events(spark, sf).select("event_id", band(F.col("score"), (0.28, 0.48, 0.72), SAFETY_LEVELS).alias("safety_level"))


@query("level_threshold_filter", f"WITH {EV} SELECT event_id, risk_level FROM ev WHERE risk_level IN ('HIGH', 'CRITICAL')")
def level_threshold_filter(spark, sf):
    return events(spark, sf).filter(sc.at_least(F.col("risk_level"), "HIGH")).select("event_id", "risk_level")


@query(
    "alert_rows",
    f"""WITH {EV}, a AS (SELECT event_id, event_type, score, risk_level, CASE risk_level WHEN 'CRITICAL' THEN 'STOP_RECOMMENDED' WHEN 'HIGH' THEN 'WARNING' WHEN 'MEDIUM' THEN 'WATCH' ELSE 'INFO' END AS alert_level,
 CASE risk_level WHEN 'CRITICAL' THEN 'A person should look at this now.' WHEN 'HIGH' THEN 'Review this moment.' WHEN 'MEDIUM' THEN 'Keep an eye on this.' ELSE 'Nothing to review.' END AS tx FROM ev)
SELECT event_id, alert_level, event_type || ' — ' || event_type AS reason, tx || ' (band ' || risk_level || ' s=' || format('{{:.2f}}', round(score + 1e-12, 2)) || ')' AS message FROM a""",
)
def alert_rows(spark, sf):
    d = events(spark, sf).withColumns({"risk_score": F.round(F.col("score") + 1e-12, 2), "triggered_rules": F.array("event_type")})
    return sc.alert_rows(d).select("event_id", "alert_level", "reason", "message")


# ------------------------------------------------- channel matrix on lineitem

CFG = FusionConfig(
    weights={"qty": 0.3, "disc": 0.2, "tax": 0.1, "price": 0.4},
    groups={"qty": "biomechanics", "disc": "posture", "tax": "anomaly", "price": "anomaly"},
    interactions=(
        Interaction("qty_price", ("qty", "price"), 0.06, 0.5),
        Interaction("disc_tax", ("disc", "tax"), 0.07, 0.0),
        Interaction("price_alone", ("price",), 0.12, 0.9),
        Interaction("needs_absent", ("price", "absent"), 0.2, 0.1),
    ),
)
KEYS = ["l_orderkey", "l_linenumber"]
ROW = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]  # identifies a line


def lines(spark, sf):
    return table(spark, sf, "lineitem").select(*ROW, "l_quantity", "l_discount", "l_tax", "l_extendedprice", "l_linestatus", "l_returnflag")


def channels():
    return {
        "qty": F.col("l_quantity") / 50.0,
        "disc": F.when(F.col("l_linestatus") == "O", F.col("l_discount") / 0.1),
        "tax": F.when(F.col("l_returnflag") != "N", F.col("l_tax") / 0.08),
        "price": F.col("l_extendedprice") / 100000.0,
    }


CHN = """ch AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity / 50.0 AS qty, CASE WHEN l_linestatus = 'O' THEN l_discount / 0.1 END AS disc,
 CASE WHEN l_returnflag <> 'N' THEN l_tax / 0.08 END AS tax, l_extendedprice / 100000.0 AS price FROM lineitem)"""
WEIGHTS = {"qty": 0.3, "disc": 0.2, "tax": 0.1, "price": 0.4}


def _clip(n):
    return f"greatest(0.0, least(1.0, {n}))"


def _scheme_sql(scheme, names=tuple(WEIGHTS)):
    if scheme == "max":
        return "coalesce(greatest(" + ", ".join(f"CASE WHEN {n} IS NOT NULL THEN {_clip(n)} END" for n in names) + "), 0.0)"
    w = WEIGHTS if scheme == "weighted" else dict.fromkeys(WEIGHTS, 1.0)
    num = " + ".join(f"CASE WHEN {n} IS NOT NULL THEN {_clip(n)} * {w[n]!r} ELSE 0.0 END" for n in names)
    den = " + ".join(f"CASE WHEN {n} IS NOT NULL THEN {w[n]!r} ELSE 0.0 END" for n in names)
    return f"coalesce(CAST({num} AS DOUBLE) / nullif(CAST({den} AS DOUBLE), 0.0), 0.0)"


def _boost_sql(names=tuple(WEIGHTS)):
    out = ["0.0"]
    if {"qty", "price"} <= set(names):
        out.append("CASE WHEN qty > 0.5 AND price > 0.5 THEN 0.06 ELSE 0.0 END")
    if {"disc", "tax"} <= set(names):
        out.append("CASE WHEN disc > 0.08 AND tax > 0.08 THEN 0.07 ELSE 0.0 END")
    if "price" in names:
        out.append("CASE WHEN price > 0.9 THEN 0.12 ELSE 0.0 END")
    return "CAST(" + " + ".join(out) + " AS DOUBLE)"


for _s in ("equal", "weighted", "max"):

    def _make(s=_s):
        def q(spark, sf):
            return lines(spark, sf).select(*KEYS, rnd(sc.scheme_score(channels(), CFG.weights, s), "pre_score"))

        return q

    query(f"scheme_{_s}", f"WITH {CHN} SELECT l_orderkey, l_linenumber, round({_scheme_sql(_s)}, 9) AS pre_score FROM ch")(_make())


@query(
    "interaction_boosts",
    f"""WITH {CHN} SELECT l_orderkey, l_linenumber, round({_boost_sql()}, 9) AS boost,
 array_to_string(list_filter([CASE WHEN qty > 0.5 AND price > 0.5 THEN 'qty_price' END, CASE WHEN disc > 0.08 AND tax > 0.08 THEN 'disc_tax' END, CASE WHEN price > 0.9 THEN 'price_alone' END], lambda x: x IS NOT NULL), ',') AS fired FROM ch""",
)
def interaction_boosts(spark, sf):
    ch = channels()
    return lines(spark, sf).select(*KEYS, rnd(sc.boosts(ch, CFG), "boost"), F.array_join(sc.fired_rules(ch, CFG), ",").alias("fired"))


FUSED = f"greatest(0.0, least(1.0, {_scheme_sql('weighted')} + {_boost_sql()}))"


@query(
    "fused_levels",
    f"""WITH {CHN}, f AS (SELECT *, {FUSED} AS rs FROM ch) SELECT l_orderkey, l_linenumber, round(rs, 9) AS risk_score, {_level("round(rs, 12)")} AS risk_level,
 array_to_string(list_sort(list_filter([CASE WHEN qty > 0.08 THEN 'qty' END, CASE WHEN disc > 0.08 THEN 'disc' END, CASE WHEN tax > 0.08 THEN 'tax' END, CASE WHEN price > 0.08 THEN 'price' END], lambda x: x IS NOT NULL)), ',') AS active FROM f""",
)
def fused_levels(spark, sf):
    d = sc.fuse(lines(spark, sf), channels(), CFG)
    return d.select(*KEYS, rnd("risk_score"), band(F.round("risk_score", 12), CFG.cuts).alias("risk_level"), F.array_join("active", ",").alias("active"))


@query(
    "fusion_audit",
    f"""WITH {CHN}, f AS (SELECT *, {FUSED} AS rs FROM ch) SELECT l_orderkey, l_linenumber, round({_scheme_sql('weighted')}, 9) AS base_score, round(rs, 9) AS fused_score,
 array_to_string(list_filter([CASE WHEN qty > 0.5 AND price > 0.5 THEN 'Interaction ''qty_price'': +0.060' END, CASE WHEN disc > 0.08 AND tax > 0.08 THEN 'Interaction ''disc_tax'': +0.070' END,
 CASE WHEN price > 0.9 THEN 'Interaction ''price_alone'': +0.120' END], lambda x: x IS NOT NULL), '; ') AS facts FROM f""",
)
def fusion_audit(spark, sf):
    ch = channels()
    d = sc.fuse(lines(spark, sf), ch, CFG).withColumn("audit", sc.audit(ch, CFG))
    a = lambda k: F.col("audit")[k].cast("double")
    return d.select(*KEYS, rnd(a("base_score"), "base_score"), rnd(a("fused_score"), "fused_score"), F.array_join(sc.facts(CFG), "; ").alias("facts"))


@query(
    "firing_counts",
    f"""WITH {CHN}, r AS (SELECT unnest(list_filter([CASE WHEN qty > 0.5 AND price > 0.5 THEN 'qty_price' END, CASE WHEN disc > 0.08 AND tax > 0.08 THEN 'disc_tax' END, CASE WHEN price > 0.9 THEN 'price_alone' END,
 CASE WHEN (qty > 0.5 AND price > 0.5) OR coalesce(disc > 0.08 AND tax > 0.08, false) OR price > 0.9 THEN '__any__' END], lambda x: x IS NOT NULL)) AS rule FROM ch) SELECT rule, count(*) AS n FROM r GROUP BY 1""",
)
def firing_counts(spark, sf):
    return sc.firing_counts(lines(spark, sf), channels(), CFG)


GROUPS = CFG.groups
MODES = (
    Ablation("biomechanics_only", ("biomechanics",)),
    Ablation("posture_only", ("posture",)),
    Ablation("anomaly_only", ("anomaly",)),
    Ablation("biomechanics_plus_posture", ("biomechanics", "posture")),
    Ablation("full_fusion"),
    Ablation("full_fusion_without_interactions", interactions=False),
    Ablation("without_disc", dropped=("disc",)),
    Ablation("without_tax", dropped=("tax",)),
)


def _mode_sql(m: Ablation) -> str:
    names = [n for n in WEIGHTS if n not in m.dropped and (m.groups is None or GROUPS[n] in m.groups)]
    x = _scheme_sql("weighted", names)
    if m.interactions:
        x = f"greatest(0.0, least(1.0, {x} + {_boost_sql(names)}))"
    return f"SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, '{m.name}' AS mode, {x} AS rs FROM ch"


ABL = f"WITH {CHN}, a AS (" + " UNION ALL ".join(_mode_sql(m) for m in MODES) + ")"


@query("ablation_modes", ABL + f" SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, mode, round(rs, 10) AS risk_score, {_level('round(rs, 12)')} AS risk_level FROM a")
def ablation_modes(spark, sf):
    d = sc.ablation_scores(sc.spread(lines(spark, sf)), ROW, channels(), CFG, MODES)
    return d.select(*ROW, "mode", rnd("risk_score", d=10), band(F.round("risk_score", 12), CFG.cuts).alias("risk_level"))


@query(
    "ablation_behaviour",
    ABL
    + """ SELECT mode, round(max(rs), 9) AS max_score, round(avg(rs), 9) AS mean_score, round(100.0 * avg(CASE WHEN round(rs, 12) >= 0.5 THEN 1.0 ELSE 0.0 END), 9) AS pct_high, min(CASE WHEN round(rs, 12) >= 0.5 THEN l_orderkey * 10 + l_linenumber END) AS first_high FROM a GROUP BY 1""",
)
def ablation_behaviour(spark, sf):
    from spanwise.operators.metrics import behaviour

    d = sc.ablation_scores(sc.spread(lines(spark, sf)), KEYS, channels(), CFG, MODES).withColumn("t", F.col("l_orderkey") * 10 + F.col("l_linenumber"))
    d = d.withColumn("risk_level", band(F.round("risk_score", 12), CFG.cuts))
    b = behaviour(d, ["mode"], "risk_score", "risk_level", "t")
    return b.select("mode", rnd("max_score"), rnd("mean_score"), rnd("pct_high"), "first_high")


def _draw(name: str, seed: int) -> str:
    return f"CAST(('0x' || substr(md5(l_orderkey || '|' || l_linenumber || '|' || l_partkey || '|' || l_suppkey || '|{name}|{seed}'), 1, 13)) AS BIGINT) / 4503599627370496.0"


def _drop_sql(p: float, seed: int, naive: bool, name: str) -> str:
    drop = "0.0" if naive else "NULL"
    cols = ", ".join(f"CASE WHEN {n} IS NOT NULL AND {_draw(n, seed)} < {p} THEN {drop} ELSE {n} END AS {n}" for n in WEIGHTS)
    return f"SELECT l_orderkey, l_linenumber, '{name}' AS scenario, {FUSED} AS rs FROM (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, {cols} FROM ch)"


DROPS = [sc.Scenario(f"{'naive' if nv else 'explicit'}_{p}", p=p, seed=7, naive=nv) for p in (0.1, 0.5) for nv in (False, True)]


@query(
    "dropout_naive_vs_explicit",
    f"WITH {CHN}, d AS (" + " UNION ALL ".join(_drop_sql(s.p, s.seed, s.naive, s.name) for s in DROPS) + """)
SELECT scenario, count(*) AS n, round(avg(rs), 9) AS mean_score, sum(CASE WHEN round(rs, 12) >= 0.5 THEN 1 ELSE 0 END)::BIGINT AS n_high FROM d GROUP BY 1""",
)
def dropout_naive_vs_explicit(spark, sf):
    d = sc.scenario_scores(sc.spread(lines(spark, sf)), ROW, channels(), CFG, DROPS, sc.md5_draw)
    return d.groupBy("scenario").agg(F.count(F.lit(1)).alias("n"), rnd(F.avg("risk_score"), "mean_score"), F.count_if(F.round("risk_score", 12) >= 0.5).alias("n_high"))


@query("experiment_grid")
def experiment_grid(spark, sf):
    """All 66 passes of the experiment over the channel matrix; draws come from a 64-bit hash SQL does not share."""
    d = sc.scenario_scores(sc.spread(lines(spark, sf)), ROW, channels(), CFG, sc.experiment_scenarios())
    return d.groupBy("scenario").agg(
        F.count(F.lit(1)).alias("n"), rnd(F.avg("risk_score"), "mean_score"), F.sum("n_fired").alias("n_fired"),
        F.count_if(sc.at_least(F.col("risk_level"), "HIGH")).alias("n_high"),
    )


@query(
    "signals_long",
    f"""WITH {CHN}, l AS (SELECT l_orderkey, l_linenumber, n.name, n.grp AS "group", CASE n.name WHEN 'qty' THEN qty WHEN 'disc' THEN disc WHEN 'tax' THEN tax ELSE price END AS confidence, n.w AS weight
 FROM ch, (VALUES ('qty', 'biomechanics', 0.3), ('disc', 'posture', 0.2), ('tax', 'anomaly', 0.1), ('price', 'anomaly', 0.4)) n(name, grp, w))
SELECT name, "group", count(*) AS n, count(confidence) AS n_available, round(avg(confidence), 9) AS mean_confidence, CAST(max(weight) AS DOUBLE) AS weight FROM l GROUP BY 1, 2""",
)
def signals_long(spark, sf):
    s = sc.signals_long(lines(spark, sf), KEYS, channels(), CFG)
    return s.groupBy("name", "group").agg(
        F.count(F.lit(1)).alias("n"), F.count("confidence").alias("n_available"), rnd(F.avg("confidence"), "mean_confidence"), F.max("weight").alias("weight")
    )


@query(
    "pre_interaction_long",
    f"""WITH {CHN}, x AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, (CASE WHEN qty IS NOT NULL THEN {_clip('qty')} * 0.3 ELSE 0.0 END + {_clip('price')} * 0.4 + CASE WHEN disc IS NOT NULL THEN {_clip('disc')} * 0.2 ELSE 0.0 END)
 / (0.7 + CASE WHEN disc IS NOT NULL THEN 0.2 ELSE 0.0 END) AS up, CASE WHEN tax IS NOT NULL THEN {_clip('tax')} ELSE 0.0 END AS down FROM ch)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round(up * (1.0 - 0.35 * down), 10) AS pre_score FROM x""",
)
def pre_interaction_long(spark, sf):
    s = sc.signals_long(lines(spark, sf), ROW, channels(), CFG)
    s = s.withColumn("polarity", F.when(F.col("name") == "tax", "risk_decreasing").otherwise(F.col("polarity")))
    return sc.pre_interaction_long(s, ROW).select(*ROW, rnd("pre_score", d=10))


@query(
    "interactions_long",
    f"WITH {CHN} SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round({_boost_sql()}, 9) AS boost FROM ch",
)
def interactions_long(spark, sf):
    s = sc.signals_long(lines(spark, sf), ROW, channels(), CFG)
    return sc.interactions_long(s, ROW, CFG).select(*ROW, rnd("boost"))


@query(
    "fuse_weighted_mean",
    "SELECT l_orderkey, l_linenumber, round((l_quantity * 2.0 + l_tax * 3.0) / 5.0, 9) AS fused FROM lineitem",
)
def fuse_weighted_mean(spark, sf):
    vals = F.create_map(F.lit("q"), F.col("l_quantity"), F.lit("t"), F.col("l_tax"), F.lit("x"), F.col("l_discount"))
    w = F.create_map(F.lit("q"), F.lit(2.0), F.lit("t"), F.lit(3.0), F.lit("x"), F.lit(-1.0), F.lit("none"), F.lit(4.0))
    return lines(spark, sf).select(*KEYS, rnd(fused_mean(vals, w), "fused"))


@query(
    "channel_matrix",
    """WITH o AS (SELECT user_id, event_id, epoch_us(ts) / 1e6 - 1704067200.0 AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS i, event_type FROM events),
w AS (SELECT user_id, i / 10.0 + 0.05 AS s, i / 10.0 + 0.25 AS e FROM o WHERE event_type = 'error'),
m AS (SELECT DISTINCT o.user_id, o.i FROM o JOIN w ON o.user_id = w.user_id AND o.i BETWEEN greatest(0, floor(w.s * 10)) AND ceil(w.e * 10))
SELECT o.user_id, o.event_id, CASE WHEN m.i IS NULL THEN 0 ELSE 1 END AS y_impact FROM o LEFT JOIN m ON o.user_id = m.user_id AND o.i = m.i""",
)
def channel_matrix(spark, sf):
    from spanwise.operators.intervals import interval_mask
    from spanwise.operators.ordered import scan

    d, seq = event_frames(spark, sf, "event_type")
    d = scan(d, seq, index="i").select("user_id", "event_id", "event_type", "i")
    w = d.filter("event_type = 'error'").select("user_id", (F.col("i") / 10.0 + 0.05).alias("s"), (F.col("i") / 10.0 + 0.25).alias("e"))
    return interval_mask(d, w, ["user_id"], "i", 10.0, "s", "e", "y_impact").select("user_id", "event_id", "y_impact")
