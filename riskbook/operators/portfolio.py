"""Portfolio reports over a (scored) policy book: A1-A10, A14-A18, A21-A28.

Every report is one or two partial aggregations (map-side combine, tiny shuffle);
wide reports unpivot with ``stack`` so that one pass serves all columns. Quantiles
are exact via ``operators.quantiles`` (no global sort, no single-task buffer).
Windows appear only over already-aggregated results (a handful of rows).
"""
from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from riskbook.functions.bands import BAND_ORDER, risk_band
from riskbook.functions.columns import exact_round, lit_d, mean_parts, rnd, safe_div, share_parts
from riskbook.operators.curves import gini_desc, kendall_tau_b
from riskbook.operators.quantiles import exact_quantiles
from riskbook.plans import rating as R

PERILS = [("wildfire_zone", "Wildfire"), ("flood_zone", "Flood"),
          ("earthquake_zone", "Earthquake"), ("hail_zone", "Hail")]


def _stack(cols: list[tuple[str, Column]], key: str = "metric", val: str = "value") -> Column:
    """``stack`` as an explode of an array of (name, value) structs."""
    return F.explode(F.array(*[F.struct(F.lit(n).alias(key), c.cast("double").alias(val)) for n, c in cols]))


# ── A1-A8 ─────────────────────────────────────────────────────────────────
def kpis(book: DataFrame) -> DataFrame:
    """A1: count, total premium, total E, mean M, % of policies with M > 1.01."""
    a = book.agg(
        F.count("*").alias("total_policies"),
        rnd(F.sum("indicated_premium"), 2).alias("total_premium"),
        rnd(F.sum("expected_loss_true"), 2).alias("total_expected_loss"),
        *mean_parts("avg_m", F.col("M_true"), 4), *share_parts("pct", F.col("M_true") > 1.01))
    return a.select("total_policies", "total_premium", "total_expected_loss",
                    exact_round("avg_m", 4, 6).alias("avg_m"), exact_round("pct", 0, 4, 100).alias("pct_m_active"))


def band_distribution(book: DataFrame, band: str = "risk_band", premium: str = "indicated_premium") -> DataFrame:
    """A2: count and premium per band, all five bands present (zeros filled), fixed order."""
    agg = book.groupBy(F.col(band).alias("risk_band")).agg(
        F.count("*").alias("n"), F.sum(premium).alias("p"))
    dim = book.sparkSession.createDataFrame([(i, b) for i, b in enumerate(BAND_ORDER)],
                                            "band_order int, risk_band string")
    return (dim.join(F.broadcast(agg), "risk_band", "left")   # <= 5 aggregated rows
            .select("band_order", "risk_band", F.coalesce("n", F.lit(0)).alias("policies"),
                    rnd(F.coalesce("p", lit_d(0.0)), 2).alias("premium")))


def state_summary(book: DataFrame) -> DataFrame:
    """A3: per state mean M, count, premium, E; rank 1 = highest mean M (top state)."""
    agg = book.groupBy("state").agg(
        *mean_parts("m", F.col("M_true"), 4), F.count("*").alias("policies"),
        F.sum("indicated_premium").alias("total_prem"), F.sum("expected_loss_true").alias("total_el"))
    agg = agg.select("*", exact_round("m", 4, 6).alias("mean_m"))
    w = Window.orderBy(F.col("mean_m").desc(), F.col("state"))   # over <= #states rows
    return agg.select("state", "mean_m", "policies",
                      rnd(F.col("total_prem"), 2).alias("total_prem"), rnd(F.col("total_el"), 2).alias("total_el"),
                      F.row_number().over(w).alias("rank_mean_m"))


def state_top_peril(book: DataFrame) -> DataFrame:
    """A4: peril with the highest share of High zones per state (ties: wildfire, flood, quake, hail).
    All shares of a state have the same denominator, so the counts decide."""
    agg = book.groupBy("state").agg(*[p for c, lbl in PERILS for p in share_parts(lbl.lower(), F.col(c) == "High")])
    best = F.greatest(*[F.col(f"{lbl.lower()}__s") for _, lbl in PERILS])
    top, exact = F.lit(None).cast("string"), F.lit(None).cast("double")
    for _, lbl in reversed(PERILS):
        is_top = F.col(f"{lbl.lower()}__s") == best
        top = F.when(is_top, F.lit(lbl)).otherwise(top)
        exact = F.when(is_top, exact_round(lbl.lower(), 0, 6)).otherwise(exact)
    return agg.select("state", top.alias("top_peril"), exact.alias("top_share"))


def state_peril_matrix(book: DataFrame, min_n: int = 20) -> DataFrame:
    """A5: mean M per state x peril-High (NULL below ``min_n`` policies), wide form, one row for
    every state of the book (count 0 without High zones); states ordered by their row maximum
    (rank 1 = largest). One conditional aggregate by state."""
    high = {lbl.lower(): F.when(F.col(c) == "High", F.col("M_true")) for c, lbl in PERILS}
    wide = book.groupBy("state").agg(*[p for k, m in high.items() for p in mean_parts(k, m, 4)])
    out = []
    for k in high:
        n = F.col(f"{k}__n")
        out += [F.when(n >= min_n, exact_round(k, 4, 6)).alias(f"{k}_high_m"), n.alias(f"{k}_high_n")]
    wide = wide.select("state", *out)
    row_max = F.greatest(*[F.col(f"{k}_high_m") for k in high])
    w = Window.orderBy(row_max.desc_nulls_last(), F.col("state"))     # over <= #states rows
    return wide.select("*", row_max.alias("row_max"), F.row_number().over(w).alias("row_order"))


def hottest_cell(book: DataFrame, min_n: int = 20) -> DataFrame:
    """The credible state x peril cell with the largest mean M."""
    wide = state_peril_matrix(book, min_n)
    cells = F.array(*[F.struct(F.lit(f"{lbl} High").alias("peril"), F.col(f"{lbl.lower()}_high_m").alias("mean_m"),
                               F.col(f"{lbl.lower()}_high_n").alias("policies")) for _, lbl in PERILS])
    long = wide.select("state", F.explode(cells).alias("c")).select("state", "c.*").where(F.col("mean_m").isNotNull())  # a row a state and peril
    return (long.orderBy(F.col("mean_m").desc(), "state", "peril").limit(1)
            .select("state", "peril", "mean_m", "policies"))


def loss_ratio_by_band(book: DataFrame, band: str = "risk_band", el: str = "expected_loss_true",
                       prem: str = "indicated_premium") -> DataFrame:
    """Sum E / sum premium x 100 per band, with the spread (max - min) over bands."""
    per = (book.groupBy(F.col(band).alias("risk_band"))
           .agg(F.count("*").alias("policies"), F.sum(el).alias("el"), F.sum(prem).alias("prem")))
    lr = safe_div(F.col("el"), F.col("prem")) * 100
    per = per.select("risk_band", "policies", lr.alias("loss_ratio_pct"))
    whole = Window.partitionBy()       # over the <= 5 aggregated rows
    spread = F.max("loss_ratio_pct").over(whole) - F.min("loss_ratio_pct").over(whole)
    return per.select("risk_band", "policies", rnd(F.col("loss_ratio_pct"), 4).alias("loss_ratio_pct"),
                      rnd(spread, 4).alias("lr_spread_pct"))


CATEGORY_COLS = ["roof_material", "wildfire_zone", "flood_zone", "construction_type"]


def category_counts(book: DataFrame, cols: list[str] = CATEGORY_COLS) -> DataFrame:
    """Value counts of several categoricals in one pass."""
    ex = book.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value"))
                                         for c in cols])).alias("s"))
    return ex.groupBy(F.col("s.column").alias("column"), F.col("s.value").alias("value")).agg(F.count("*").alias("policies"))


CORR_COLS = ["lambda_true", "mu_true", "M_true", "expected_loss_true", "roof_age_yr", "home_value",
             "prior_claims_3yr", "credit_score", "protection_class", "dist_to_fire_station_mi"]


def correlations(book: DataFrame, cols: list[str] = CORR_COLS) -> DataFrame:
    """Pearson correlations of all pairs, long form (a, b, corr).

    Two passes of plain sums: the means, then centred cross-products for every pair
    (numerically stable, and a few dozen sum buffers instead of six per ``corr``)."""
    xs = {c: F.col(c).cast("double") for c in cols}
    means = book.agg(*[F.avg(x).alias(c) for c, x in xs.items()]).first()
    d = {c: xs[c] - lit_d(means[c] or 0.0) for c in cols}
    pairs = list(combinations(cols, 2))
    sums = book.agg(*[F.sum(d[c] * d[c]).alias(f"s_{c}") for c in cols],
                    *[F.sum(d[a] * d[b]).alias(f"p{i}") for i, (a, b) in enumerate(pairs)])
    corr = lambda i, a, b: F.when((F.col(f"s_{a}") > 0) & (F.col(f"s_{b}") > 0),
                                  F.col(f"p{i}") / F.sqrt(F.col(f"s_{a}") * F.col(f"s_{b}")))
    return sums.select(F.explode(F.array(*[
        F.struct(F.lit(a).alias("col_a"), F.lit(b).alias("col_b"), rnd(corr(i, a, b), 8).alias("corr"))
        for i, (a, b) in enumerate(pairs)])).alias("s")).select("s.*")


SUMMARY_COLS = ["lambda_true", "mu_true", "M_true", "expected_loss_true", "indicated_premium",
                "risk_score_true", "risk_score_a2", "home_value", "coverage_amount", "home_age",
                "roof_age_yr", "prior_claims_3yr", "credit_score", "protection_class",
                "dist_to_fire_station_mi", "dist_to_coast_mi", "square_footage"]


def describe(book: DataFrame, cols: list[str] = SUMMARY_COLS) -> DataFrame:
    """A10: count, mean, sample std, min, quartiles (linear), max per column."""
    long = book.select(_stack([(c, F.col(c)) for c in cols], "column", "v").alias("s")).select("s.*")
    q = exact_quantiles(long, "v", [0.25, 0.5, 0.75], by="column")
    stats = long.groupBy("column").agg(F.count("v").alias("count"), F.avg("v").alias("mean"),
                                       F.stddev_samp("v").alias("std"), F.min("v").alias("min"),
                                       F.max("v").alias("max"))
    qrows = [(c, q.get((c, 0.25)), q.get((c, 0.5)), q.get((c, 0.75))) for c in cols]
    qdf = book.sparkSession.createDataFrame(qrows, "column string, p25 double, p50 double, p75 double")
    joined = stats.join(F.broadcast(qdf), "column")          # both sides: one row per column
    return joined.select("column", "count", *[rnd(F.col(c), 4).alias(c) for c in
                                              ["mean", "std", "min", "p25", "p50", "p75", "max"]])


# ── score pairs and M reports (A14-A18) ───────────────────────────────────
def plan_score_pair(book: DataFrame) -> DataFrame:
    """Baseline (M = 1: lambda x mu) and full (lambda x mu x M) per policy from the
    rating plan, scored on the book's min/max anchors. Same shape as the ML pair."""
    lo, hi = R.minmax_log_anchors(book, "expected_loss_true")
    el_b = rnd(F.col("lambda_true") * F.col("mu_true"), 2)
    el_f = F.col("expected_loss_true")
    sb, sf = rnd(R.score_a1(el_b, lo, hi), 1), rnd(R.score_a1(el_f, lo, hi), 1)
    return book.select(
        "policy_id", el_b.alias("el_baseline"), el_f.alias("el_full"), F.col("M_true").alias("m_hat"),
        sb.alias("score_baseline"), sf.alias("score_full"),
        risk_band(sb).alias("band_baseline"), risk_band(sf).alias("band_full"),
        rnd(el_b / lit_d(0.67), 2).alias("premium_baseline"), F.col("indicated_premium").alias("premium_full"),
        F.col("total_loss").alias("actual"))


M_PROBS = [0.0, 0.25, 0.5, 0.75, 0.9, 0.95, 0.99]


def m_distribution(df: DataFrame, m: str = "m_hat") -> DataFrame:
    """Percentiles, mean and impact-tier shares of a multiplier column."""
    q = exact_quantiles(df, m, M_PROBS)
    x = F.col(m)
    tiers = [("protective_share", x < 0.95), ("neutral_share", (x >= 0.95) & (x < 1.05)),
             ("mild_share", (x >= 1.05) & (x < 1.30)), ("moderate_share", (x >= 1.30) & (x < 2.0)),
             ("severe_share", x >= 2.0)]
    parts = mean_parts("mean", x, 4) + [p for nm, c in tiers for p in share_parts(nm, c)]
    agg = df.agg(*parts).select(exact_round("mean", 4, 6).alias("mean"),
                                *[exact_round(nm, 0, 6).alias(nm) for nm, _ in tiers])
    pcols = [rnd(lit_d(q[("", p)]) if q[("", p)] is not None else F.lit(None).cast("double"), 6)
             .alias(f"p{int(round(p * 100))}") for p in M_PROBS]
    return agg.select(*pcols, "*")


def premium_uplift(pair: DataFrame) -> DataFrame:
    """(full - base) / (base + 1) in percent: mean, median, p95, max."""
    up = pair.select(((F.col("el_full") - F.col("el_baseline")) / (F.col("el_baseline") + 1) * 100).alias("u"))
    q = exact_quantiles(up, "u", [0.5, 0.95])
    med, p95 = q[("", 0.5)], q[("", 0.95)]
    return up.agg(rnd(F.avg("u"), 4).alias("mean_pct"), rnd(F.max("u"), 4).alias("max_pct")).select(
        "mean_pct", rnd(lit_d(med if med is not None else float("nan")), 4).alias("median_pct"),
        rnd(lit_d(p95 if p95 is not None else float("nan")), 4).alias("p95_pct"), "max_pct")


def reclassification(pair: DataFrame) -> DataFrame:
    """Share of policies changing band, upgraded and downgraded."""
    changed = F.col("band_baseline") != F.col("band_full")
    conds = [("reclassified_share", changed),
             ("upgraded_share", changed & (F.col("score_full") > F.col("score_baseline"))),
             ("downgraded_share", changed & (F.col("score_full") < F.col("score_baseline")))]
    return pair.agg(*[p for nm, c in conds for p in share_parts(nm, c)]).select(
        *[exact_round(nm, 0, 6).alias(nm) for nm, _ in conds])


def reclass_matrix(pair: DataFrame) -> DataFrame:
    """A16 (matrix): band x band counts, baseline rows, full columns in band order."""
    wide = pair.groupBy("band_baseline").pivot("band_full", BAND_ORDER).count()
    return wide.select("band_baseline", *[F.coalesce(F.col(f"`{b}`"), F.lit(0)).alias(b.lower().replace(" ", "_"))
                                          for b in BAND_ORDER])


def reclass_threshold(pair: DataFrame, t: float = 40.0) -> DataFrame:
    """Up / down / confirmed at +-t points, with and without a band change."""
    sb, sf = F.col("score_baseline"), F.col("score_full")
    changed = F.col("band_baseline") != F.col("band_full")
    up, down = sf > sb + t, sf < sb - t
    cnt = lambda c: F.sum(c.cast("int"))
    return pair.agg(
        cnt(up & changed).alias("upgraded_band"), cnt(down & changed).alias("downgraded_band"),
        cnt(~((up & changed) | (down & changed))).alias("unchanged_band"),
        cnt(up).alias("upgraded"), cnt(down).alias("downgraded"), cnt(F.abs(sf - sb) <= t).alias("confirmed"))


def leakage(pair: DataFrame, thresh: float = 50.0, book_size: int | None = None) -> DataFrame:
    """Hidden dangers (score delta > t) and hidden gems (< -t); under-pricing."""
    ds = F.col("score_full") - F.col("score_baseline")
    dp = F.col("premium_full") - F.col("premium_baseline")
    danger, gem = ds > thresh, ds < -thresh
    agg = pair.agg(F.count("*").alias("n"), *share_parts("d", danger), *share_parts("g", gem),
                   *mean_parts("avg_under", F.when(danger, dp), 2), F.sum(F.when(danger, dp)).alias("tot"))
    scale = F.lit(float(book_size)) / F.col("n") if book_size else lit_d(1.0)
    return agg.select(exact_round("d", 0, 4, 100).alias("hidden_danger_pct"),
                      exact_round("g", 0, 4, 100).alias("hidden_gem_pct"),
                      F.coalesce(exact_round("avg_under", 2, 2), lit_d(0.0)).alias("avg_underpricing"),
                      rnd(F.coalesce("tot", lit_d(0.0)), 2).alias("total_leakage"),
                      rnd(F.coalesce("tot", lit_d(0.0)) * scale, 2).alias("book_leakage"))


def impact_classes(pair: DataFrame) -> DataFrame:
    """R15 per policy: compounding class, score and premium deltas."""
    return pair.select("policy_id", R.impact_class(F.col("m_hat"), F.col("band_baseline"), F.col("band_full")).alias("impact"),
                       rnd(F.col("score_full") - F.col("score_baseline"), 1).alias("delta_score"),
                       rnd(F.col("premium_full") - F.col("premium_baseline"), 2).alias("delta_premium"),
                       (F.col("band_baseline") != F.col("band_full")).cast("int").alias("band_changed"))


# ── data-quality and benchmark reports (A21-A26) ──────────────────────────
# Target ranges of the generation report (metric, lo, hi).
GENERATION_TARGETS = [
    ("claim_rate_pct", 5.0, 5.8), ("avg_mu", 14000.0, 19000.0), ("avg_severity", 19000.0, 30000.0),
    ("zero_loss_pct", 93.0, 96.0), ("cat_pct", 0.05, 0.8), ("avg_premium", 1900.0, 2800.0),
    ("median_premium", 900.0, 1900.0), ("actual_lr", 0.45, 0.80), ("gini_oracle", 0.15, 0.60), ("kendall_tau", 0.05, 0.40), ("m_mean", 1.1, 1.8),
    ("m_std", 0.3, 0.8), ("m_max", 0.0, 3.6), ("subprime_pct", 13.0, 22.0), ("recent_roof_pct", 10.0, 20.0),
    ("canopy_unknown_pct", 2.0, 7.0), ("ds_missing_pct", 15.0, 30.0), ("fire_sentinel_pct", 1.0, 6.0),
    ("knob_tube_pct", 0.5, 6.0), ("polybutylene_pct", 4.0, 16.0), ("near_duplicate_pct", 0.2, 1.0),
    ("data_vintage_pct", 9.0, 16.0), ("rcv_vintage_pct", 5.0, 12.0),
]
INFO_METRICS = ["renewal_pct", "three_way_pct", "slope_mean", "rain_mean", "roof_age_mean",
                "credit_p10", "credit_p50", "credit_p90", "roof_age_median", "expected_lr",
                *[f"band_pct_{b.lower().replace(' ', '_')}" for b in BAND_ORDER]]


def book_report(book: DataFrame) -> DataFrame:
    """~40 generation metrics with target range and pass flag: one wide aggregate, and the rank
    statistics (Gini, Kendall's tau over claimants).
    Shares and means of fixed-decimal columns are rounded exactly (integer arithmetic)."""
    tl = F.col("total_loss")
    shares = {
        "claim_rate_pct": F.col("claim_occurred") == 1, "zero_loss_pct": tl == 0,
        "cat_pct": F.col("is_cat_event") == 1, "subprime_pct": F.col("credit_score") < 620,
        "recent_roof_pct": F.col("roof_age_yr") <= 3,
        "canopy_unknown_pct": F.col("vegetation_risk_composite") == "Unknown",
        "ds_missing_pct": F.col("defensible_space_score").isNull(),
        "fire_sentinel_pct": F.col("dist_to_fire_station_mi") < 0,
        "knob_tube_pct": F.col("has_knob_tube_wiring") == 1, "polybutylene_pct": F.col("has_polybutylene_pipe") == 1,
        "near_duplicate_pct": F.col("is_near_duplicate") == 1, "data_vintage_pct": F.col("data_vintage_flag") == 1,
        "rcv_vintage_pct": F.col("rcv_vintage_flag") == 1, "renewal_pct": F.col("renewal_credit") == 1,
        "three_way_pct": (F.col("wildfire_zone") == "High") & (F.col("slope_steepness_pct") > 55)
        & (F.col("post_burn_rainfall_intensity") > 60),
        **{f"band_pct_{b.lower().replace(' ', '_')}": F.col("risk_band") == b for b in BAND_ORDER},
    }
    means = {  # metric -> (column, decimals of the column)
        "avg_mu": (F.col("mu_true"), 0), "avg_severity": (F.when(tl > 0, tl), 2),
        "avg_premium": (F.col("indicated_premium"), 2), "m_mean": (F.col("M_true"), 4),
        "slope_mean": (F.col("slope_steepness_pct"), 1), "rain_mean": (F.col("post_burn_rainfall_intensity"), 1),
        "roof_age_mean": (F.col("roof_age_yr"), 0),
    }
    parts = [p for k, c in shares.items() for p in share_parts(k, c)] + \
            [p for k, (c, d) in means.items() for p in mean_parts(k, c, d)]
    agg = book.agg(*parts, (F.sum(tl) / F.sum("indicated_premium")).alias("actual_lr"),
                   (F.sum("expected_loss_true") / F.sum("indicated_premium")).alias("expected_lr"),
                   F.stddev_samp("M_true").alias("m_std"), F.max("M_true").alias("m_max"))
    agg = agg.select(*[exact_round(k, 0, 4, 100).alias(k) for k in shares],
                     *[exact_round(k, d, 4).alias(k) for k, (_, d) in means.items()], "actual_lr", "expected_lr", "m_std", "m_max")
    # the quantiles of three columns in one set of passes (long form, grouped)
    long = book.select(F.explode(F.array(*[F.struct(F.lit(c).alias("c"), F.col(c).cast("double").alias("v"))
                                           for c in ("indicated_premium", "credit_score", "roof_age_yr")])).alias("s"))
    q = exact_quantiles(long.select("s.*"), "v", [0.1, 0.5, 0.9], by="c")
    extra = {"median_premium": q[("indicated_premium", 0.5)], "credit_p10": q[("credit_score", 0.1)],
             "credit_p50": q[("credit_score", 0.5)], "credit_p90": q[("credit_score", 0.9)],
             "roof_age_median": q[("roof_age_yr", 0.5)], "gini_oracle": gini_desc(book, "total_loss", "expected_loss_true"),
             "kendall_tau": kendall_tau_b(book.where(tl > 0), "expected_loss_true", "total_loss")["tau_b"]}
    agg = agg.select("*", *[lit_d(v).alias(k) if v is not None else F.lit(None).cast("double").alias(k)
                            for k, v in extra.items()])
    targets = dict((m, (lo, hi)) for m, lo, hi in GENERATION_TARGETS)
    names = [m for m, _, _ in GENERATION_TARGETS] + INFO_METRICS
    rows = agg.select(F.explode(F.array(*[F.struct(
        F.lit(m).alias("metric"), rnd(F.col(m).cast("double"), 4).alias("value"),
        (lit_d(targets[m][0]) if m in targets else F.lit(None).cast("double")).alias("lo"),
        (lit_d(targets[m][1]) if m in targets else F.lit(None).cast("double")).alias("hi")) for m in names])).alias("s"))
    s = rows.select("s.*")
    return s.select("*", F.when(F.col("lo").isNotNull(),
                                F.col("value").between(F.col("lo"), F.col("hi")).cast("int")).alias("pass"))


def health_checks(book: DataFrame) -> DataFrame:
    """Zero-claim share, mean severity, loss ratio, non-positive premiums."""
    tl = F.col("total_loss")
    a = book.agg(*share_parts("z", tl == 0), *mean_parts("s", F.when(tl > 0, tl), 2),
                 F.sum(tl).alias("_tl"), F.sum("indicated_premium").alias("_pr"),
                 F.sum((F.col("indicated_premium") <= 0).cast("int")).cast("double").alias("negative_premiums"))
    a = a.select(exact_round("z", 0, 4, 100).alias("zero_claim_pct"), exact_round("s", 2, 4).alias("mean_severity"),
                 (F.col("_tl") / F.col("_pr") * 100).alias("loss_ratio_pct"), "negative_premiums")
    checks = [("zero_claim_pct", F.abs(F.col("zero_claim_pct") - 94.5) < 1.5),
              ("mean_severity", F.col("mean_severity").between(15000, 22000)),
              ("loss_ratio_pct", F.col("loss_ratio_pct").between(55, 70)),
              ("negative_premiums", F.col("negative_premiums") == 0)]
    return a.select(F.explode(F.array(*[F.struct(F.lit(n).alias("check"), rnd(F.col(n), 4).alias("value"),
                                                 F.coalesce(c, F.lit(False)).cast("int").alias("pass"))
                                        for n, c in checks])).alias("s")).select("s.*")


# Proxy-peril severity ranges (metric, lo, hi).
PERIL_RANGES = [("Fire / Lightning", 50000.0, 130000.0), ("Wind / Hail (Convective Storm)", 8000.0, 30000.0),
                ("Water Damage (non-weather)", 8000.0, 28000.0), ("Blended Average Claim", 12000.0, 25000.0),
                ("Annual Claim Frequency", 4.5, 6.5), ("Zero-Claim Proportion", 93.5, 95.5)]


def peril_severity(book: DataFrame) -> DataFrame:
    """Proxy-peril mean severities (CAT / High hail / residual), blended, frequency,
    zero share, each against its range."""
    tl = F.col("total_loss")
    claimed = tl > 0
    cat = claimed & (F.col("is_cat_event") == 1)
    hail = claimed & (F.col("hail_zone") == "High") & ~cat
    water = claimed & ~cat & ~hail
    a = book.agg(*mean_parts("p0", F.when(cat, tl), 2), *mean_parts("p1", F.when(hail, tl), 2),
                 *mean_parts("p2", F.when(water, tl), 2), *mean_parts("p3", F.when(claimed, tl), 2),
                 *share_parts("p4", F.col("claim_occurred") == 1), *share_parts("p5", tl == 0))
    a = a.select(*[exact_round(f"p{i}", 2, 4).alias(f"p{i}") for i in range(4)],
                 exact_round("p4", 0, 4, 100).alias("p4"), exact_round("p5", 0, 4, 100).alias("p5"))
    s = a.select(F.explode(F.array(*[F.struct(F.lit(name).alias("peril"), rnd(F.col(f"p{i}"), 4).alias("value"),
                                              lit_d(lo).alias("lo"), lit_d(hi).alias("hi"))
                                     for i, (name, lo, hi) in enumerate(PERIL_RANGES)])).alias("s")).select("s.*")
    s = s.select("*", F.when(F.col("value").isNotNull(), F.col("value").between(F.col("lo"), F.col("hi")).cast("int"))
                 .alias("pass"))
    return s.select("*", F.sum("pass").over(Window.partitionBy()).alias("passes"))   # over 6 rows


# Industry benchmark constants.
BENCHMARKS = {"annual_claim_rate": 0.053, "avg_severity_all": 18000.0, "zero_claim_pct": 0.945,
              "target_loss_ratio": 0.63, "tweedie_power_p": 1.65}


def benchmarks(book: DataFrame) -> DataFrame:
    """Dataset averages next to industry benchmark constants."""
    tl = F.col("total_loss")
    a = book.agg(*mean_parts("annual_claim_rate", F.col("lambda_true"), 5),
                 *mean_parts("avg_severity_all", F.col("mu_true"), 0), *share_parts("zero_claim_pct", tl == 0),
                 (F.sum(tl) / F.sum("indicated_premium")).alias("target_loss_ratio"))
    a = a.select(exact_round("annual_claim_rate", 5, 6).alias("annual_claim_rate"),
                 exact_round("avg_severity_all", 0, 6).alias("avg_severity_all"),
                 exact_round("zero_claim_pct", 0, 6).alias("zero_claim_pct"), "target_loss_ratio",
                 lit_d(1.65).alias("tweedie_power_p"))
    return a.select(F.explode(F.array(*[F.struct(F.lit(k).alias("metric"), rnd(F.col(k), 6).alias("dataset"),
                                                 lit_d(v).alias("benchmark")) for k, v in BENCHMARKS.items()])).alias("s")
                    ).select("s.*")


def missingness(book: DataFrame, by: str | None = None) -> DataFrame:
    """NULL, 'Unknown' and sentinel rates (optionally per group)."""
    conds = [("ds_null_pct", F.col("defensible_space_score").isNull()),
             ("veg_unknown_pct", F.col("vegetation_risk_composite") == "Unknown"),
             ("fire_sentinel_pct", F.col("dist_to_fire_station_mi") < 0)]
    aggs = [p for nm, c in conds for p in share_parts(nm, c)] + [F.count("*").alias("policies")]
    a = book.groupBy(by).agg(*aggs) if by else book.agg(*aggs)
    return a.select(*([by] if by else []), *[exact_round(nm, 0, 4, 100).alias(nm) for nm, _ in conds], "policies")


def histogram(df: DataFrame, col: str, n: int, lo: float, hi: float, clip_values: bool = False) -> DataFrame:
    """Fixed-bin histogram of ``col`` over [lo, hi] (right edge inclusive).

    Values outside the range are dropped, or clipped into the end bins with
    ``clip_values``. Each bin carries the impact class of its lower edge.
    """
    x = F.col(col).cast("double")
    if clip_values:
        x = F.least(F.greatest(x, lit_d(lo)), lit_d(hi))
    b = F.least(F.lit(n - 1), F.floor((x - lit_d(lo)) / lit_d(hi - lo) * lit_d(float(n))).cast("int"))
    binned = df.select(x.alias("x")).where(F.col("x").between(lo, hi)).select(
        F.least(F.lit(n - 1), F.floor((F.col("x") - lit_d(lo)) / lit_d(hi - lo) * lit_d(float(n))).cast("int")).alias("bin"))
    agg = binned.groupBy("bin").agg(F.count("*").alias("count"))
    edge = lit_d(lo) + F.col("bin") * lit_d((hi - lo) / n)
    cls = F.when(edge >= 2.0, "severe").when(edge >= 1.3, "moderate").otherwise("mild")
    return agg.select("bin", rnd(edge, 6).alias("lo"), rnd(edge + lit_d((hi - lo) / n), 6).alias("hi"),
                      "count", cls.alias("class"))


# ── A27 ROI grid, A28 drift ───────────────────────────────────────────────
# ROI calculator defaults and sensitivity axis.
ROI_DEFAULTS = {"target_lr": 98.0, "impl_cost_k": 850.0, "annual_ops_k": 180.0, "months_to_value": 6.0}
LR_IMPROVEMENTS = [5, 8, 10, 12, 14, 16, 20]


def roi_grid(book: DataFrame, params: dict | None = None) -> DataFrame:
    """ROI per state x loss-ratio improvement: of a full year's saving, of the first year with its
    ramp-up, and (``headline_roi``) of the first year for the improvement from the state's current loss
    ratio to the target. Book size ($M written premium) and current loss ratio come from the book."""
    p = {**ROI_DEFAULTS, **(params or {})}
    per = book.groupBy("state").agg((F.sum("indicated_premium") / 1e6).alias("book_m"),
                                    (F.sum("total_loss") / F.sum("indicated_premium") * 100).alias("current_lr"))
    g = per.select("*", F.explode(F.array(*[F.lit(x) for x in LR_IMPROVEMENTS])).alias("lr_improvement_pts"))
    cost = lit_d(p["impl_cost_k"] * 1000 + p["annual_ops_k"] * 1000)
    saving = F.col("book_m") * 1e6 * (F.col("lr_improvement_pts") / 100.0)
    y1 = saving * lit_d(1 - p["months_to_value"] / 12.0)
    payback = F.when(saving > 0, lit_d(p["impl_cost_k"] * 1000) / (saving / 12)).otherwise(lit_d(999.0))
    npv = saving * 3 - lit_d(p["annual_ops_k"] * 1000 * 3) - lit_d(p["impl_cost_k"] * 1000)
    return g.select("state", "lr_improvement_pts", rnd(F.col("book_m"), 6).alias("book_m"),
                    rnd(F.col("current_lr"), 4).alias("current_lr"), rnd(saving, 4).alias("annual_saving"),
                    rnd(y1, 5).alias("year1_benefit"), rnd((saving - cost) / cost, 6).alias("full_year_roi"),
                    rnd((y1 - cost) / cost, 6).alias("year1_roi"),
                    rnd(((F.col("current_lr") - lit_d(p["target_lr"])) / 100.0 * F.col("book_m") * 1e6
                         * lit_d(1 - p["months_to_value"] / 12.0) - cost) / cost, 6).alias("headline_roi"),
                    rnd(payback, 4).alias("payback_months"), rnd(npv, 4).alias("npv_3yr"))


DRIFT_NUMERIC = ["credit_score", "home_value", "roof_age_yr", "protection_class", "dist_to_coast_mi"]
DRIFT_CATEGORICAL = ["wildfire_zone", "flood_zone", "construction_type", "roof_material"]
PSI_EPS = 1e-4


def psi(book: DataFrame, base_year: int = 2020, numeric: list[str] = DRIFT_NUMERIC,
        categorical: list[str] = DRIFT_CATEGORICAL, bins: int = 10) -> DataFrame:
    """Population stability index per feature of every other policy year against ``base_year``.

    Numeric features use ``bins`` equal-width bins over the range of all years (one min/max
    aggregate); categoricals use their values. Shares are smoothed by PSI_EPS.
    PSI = sum over bins of (cur - base) * ln(cur / base); a bin counts if either year has it.
    """
    mm = book.agg(*[F.min(c).alias("mn_" + c) for c in numeric] + [F.max(c).alias("mx_" + c) for c in numeric]).first()
    items = []
    for c in numeric:
        lo, hi = mm["mn_" + c], mm["mx_" + c]
        lo, hi = (float(lo), float(hi)) if lo is not None else (0.0, 0.0)
        span = hi - lo if hi > lo else 1.0
        b = F.least(F.lit(bins - 1), F.floor((F.col(c).cast("double") - lit_d(lo)) / lit_d(span) * bins).cast("int"))
        items.append(F.struct(F.lit(c).alias("feature"), b.cast("string").alias("bin")))
    for c in categorical:
        items.append(F.struct(F.lit(c).alias("feature"), F.col(c).cast("string").alias("bin")))
    ex = book.select("policy_year", F.explode(F.array(*items)).alias("s")).select("policy_year", "s.*")
    # from here on: a row a feature and bin (bins or categories), with its count in every year
    cnt = ex.groupBy("feature", "bin", "policy_year").agg(F.count(F.lit(1)).alias("n"))
    per_feature = Window.partitionBy("feature")
    cnt = cnt.withColumn("years", F.collect_set("policy_year").over(per_feature))
    by_bin = cnt.groupBy("feature", "bin", "years").agg(
        F.map_from_entries(F.collect_list(F.struct("policy_year", "n"))).alias("of"))
    count_in = lambda year: F.coalesce(F.try_element_at("of", year), F.lit(0))
    pairs = (by_bin.select("feature", "bin", "of", F.explode("years").alias("policy_year"))
             .where(F.col("policy_year") != base_year)
             .select("policy_year", "feature", count_in(F.lit(base_year)).alias("nb"), count_in(F.col("policy_year")).alias("nc"))
             .where("nb + nc > 0"))
    tot = Window.partitionBy("policy_year", "feature")
    share_b = F.col("nb") / F.sum("nb").over(tot) + lit_d(PSI_EPS)
    share_c = F.col("nc") / F.sum("nc").over(tot) + lit_d(PSI_EPS)
    terms = pairs.select("policy_year", "feature", ((share_c - share_b) * F.log(share_c / share_b)).alias("t"))
    return terms.groupBy("policy_year", "feature").agg(rnd(F.sum("t"), 6).alias("psi"), F.count("*").alias("bins"))
