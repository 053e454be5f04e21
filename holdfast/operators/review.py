"""Screening, portfolio review and ranking studies.

Candidates are ranked once. A portfolio that owns m of them finds its best ``limit`` unowned ones among
the ranks 1 to limit + m, so no portfolio x candidate rows are formed, however long the list is.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from holdfast.functions.scoring import COMPOSITE_WEIGHTS
from holdfast.grouping import ranked_per_group, top_per_group

TARGET_MIN, TARGET_MAX = 18, 25
THEME_CAP = 20.0
SCORE_GAP, VALUATION_SLACK, TRIM_SCORE = 8.0, 5.0, 70.0
MAX_REPLACEMENTS = 3

# Wording of the review.
ROLES = {
    "new": ("Diversifier", "Adds a new theme while staying inside the concentration cap."),
    "inside": (
        "Theme reinforcement", "Improves the candidate set without breaching the theme cap.",
    ),
    "over": (
        "Concentration watch", "Candidate quality is high, but the theme would exceed the cap.",
    ),
}
BELOW_RANGE = "Portfolio is below the target range. "


def ranked_candidates(candidates: DataFrame) -> DataFrame:
    """Candidates with their place: score descending, ticker ascending. A repeated ticker keeps its best row."""
    best = candidates.groupBy(F.upper("ticker").alias("ticker")).agg(
        F.expr(
            "min_by(struct(name, theme, composite_score, valuation_points), struct(-composite_score, name)) AS c"
        )
    ).select("ticker", "c.*")
    return ranked_per_group(best, [], [F.col("composite_score").desc(), F.col("ticker")], "place")


def screen(held: DataFrame, candidates: DataFrame, limit: int = 10) -> DataFrame:
    """Each portfolio's best ``limit`` candidates that it does not own yet, as an array in order of place.

    ``theme_weights`` holds what the portfolio has in the themes of those candidates; it is made only of holdings that
    bring their ``weight_pct``. The list itself needs no more of a holding than its portfolio and ticker.
    """
    listing = ranked_candidates(candidates)
    named = held.select("portfolio_id", F.upper("ticker").alias("ticker"))
    owned = named.join(listing.select("ticker"), "ticker", "left_semi").distinct()
    counts = held.groupBy("portfolio_id").agg(F.count(F.lit(1)).alias("positions"))
    ranges = counts.join(
        owned.groupBy("portfolio_id").agg(F.count(F.lit(1)).alias("m")), "portfolio_id", "left"
    ).selectExpr("portfolio_id", f"explode(sequence(1L, {limit} + coalesce(m, 0L))) AS place")
    free = ranges.join(listing, "place").join(owned, ["portfolio_id", "ticker"], "left_anti")
    first = top_per_group(free, ["portfolio_id"], [F.col("place")], limit)
    weights = {}
    if "weight_pct" in held.columns:
        in_theme = (
            held.join(first.select("portfolio_id", "theme").distinct(), ["portfolio_id", "theme"], "left_semi")
            .groupBy("portfolio_id", "theme")
            .agg(F.sum("weight_pct").alias("w"))
        )
        first = first.join(in_theme, ["portfolio_id", "theme"], "left")
        weights["theme_weights"] = "map_from_entries(array_distinct(collect_list(if(w IS NULL, NULL, struct(theme, w)))))"
    found = "sort_array(collect_list(struct(place, ticker, name, theme, composite_score, valuation_points)))"
    lists = first.groupBy("portfolio_id").agg(
        F.expr(f"{found} AS found"), *[F.expr(sql).alias(name) for name, sql in weights.items()]
    )
    item = "struct(x.ticker, x.name, x.theme, x.composite_score, x.valuation_points)"
    return counts.join(lists, "portfolio_id", "left").selectExpr(
        "portfolio_id", "positions", *[f"coalesce({name}, map()) AS {name}" for name in weights],
        f"coalesce(transform(found, x -> {item}), array()) AS screened",
    )


def starter_weight(positions: str, target_min: int = TARGET_MIN) -> str:
    return f"(CASE WHEN {positions} <= 0 THEN 100D ELSE least(10D, 100D / greatest({target_min}, {positions} + 1)) END)"


def projected_weight(current: str, starter: str) -> str:
    return f"({current} * (100 - {starter}) / 100 + {starter})"


def fit_score(projected: str, is_new: str, cap: str = "20D", penalty: str = "3D", bonus: str = "12D") -> str:
    return (
        f"greatest(0D, least(100D, 80D + if({is_new}, {bonus}, 0D) "
        f"- greatest(0D, {projected} - {cap}) * {penalty}))"
    )


def fitted(screened: DataFrame, target_min: int = TARGET_MIN) -> DataFrame:
    """Attach theme weight, projected weight and fit score to every screened candidate."""
    current = "coalesce(theme_weights[x.theme], 0D)"
    step = screened.selectExpr(
        "portfolio_id", "positions", f"{starter_weight('positions', target_min)} AS starter",
        f"transform(screened, x -> struct(x.ticker, x.name, x.theme, x.composite_score, {current} AS current)) AS xs",
    ).selectExpr(
        "portfolio_id", "positions",
        "transform(xs, x -> struct(x.ticker, x.name, x.theme, x.composite_score, x.current, "
        f"{projected_weight('x.current', 'starter')} AS projected, x.current = 0 AS is_new)) AS xs",
    )
    return step.selectExpr(
        "portfolio_id", "positions",
        f"transform(xs, x -> struct(x.*, {fit_score('x.projected', 'x.is_new')} AS fit)) AS xs".replace(
            "x.*", "x.ticker, x.name, x.theme, x.composite_score, x.current, x.projected, x.is_new"
        ),
    )


def additions(
    screened: DataFrame, target_min: int = TARGET_MIN, target_max: int = TARGET_MAX
) -> DataFrame:
    """Reviewed additions per portfolio; none for a portfolio above its target range."""
    needed = f"greatest(0, {target_min} - positions)"
    rows = fitted(screened, target_min).filter(f"positions <= {target_max}").selectExpr(
        "portfolio_id", f"{needed} AS additions_needed",
        f"posexplode(slice(xs, 1, int(greatest(3, {needed})))) AS (pos, x)",
    )
    kind = f"CASE WHEN x.is_new THEN {{new}} WHEN x.projected <= {THEME_CAP}D THEN {{inside}} ELSE {{over}} END"
    role = kind.format(**{k: f"'{v[0]}'" for k, v in ROLES.items()})
    reason = kind.format(**{k: f"'{v[1]}'" for k, v in ROLES.items()})
    return rows.selectExpr(
        "portfolio_id", "additions_needed", "pos + 1 AS place", "x.ticker", "x.theme", "x.composite_score",
        "x.fit AS portfolio_fit_score", "x.current AS current_theme_weight",
        "x.projected AS projected_theme_weight", f"{role} AS structural_role",
        f"concat(if(additions_needed > 0, '{BELOW_RANGE}', ''), {reason}) AS reason",
    )


def fit_ranking(screened: DataFrame) -> DataFrame:
    """Best candidate alone versus best candidate for the portfolio."""
    best = "array_sort(transform(xs, x -> struct({key}, x.ticker AS ticker)))[0].ticker"
    return fitted(screened).filter("size(xs) > 0").selectExpr(
        "portfolio_id",
        best.format(key="-x.composite_score AS a") + " AS isolated_top",
        best.format(key="-x.fit AS a, -x.composite_score AS b") + " AS fit_top",
    ).withColumn("ranking_changed", F.expr("isolated_top <> fit_top"))


def threshold_sweep(
    screened: DataFrame,
    caps: Sequence[float],
    penalties: Sequence[float],
    bonuses: Sequence[float],
) -> DataFrame:
    """How stable each portfolio's pick is over a grid of review thresholds (inside the row)."""
    cells = ", ".join(
        f"struct({float(c)}D AS cap, {float(p)}D AS pen, {float(b)}D AS bon)"
        for c in caps for p in penalties for b in bonuses
    )
    score = fit_score("x.projected", "x.is_new", "{cap}", "{pen}", "{bon}")
    pick = "array_sort(transform(xs, x -> struct(-" + score + " AS a, -x.composite_score AS b, x.ticker AS t)))[0].t"
    rows = fitted(screened).filter("size(xs) > 0").selectExpr(
        "portfolio_id", "xs", pick.format(cap="20D", pen="3D", bon="12D") + " AS decision"
    )
    moved = pick.format(cap="g.cap", pen="g.pen", bon="g.bon")
    swept = rows.selectExpr(
        "portfolio_id", "decision",
        f"transform(array({cells}), g -> struct(g.cap, g.pen, g.bon, {moved} AS won)) AS grid",
    )
    return swept.selectExpr(
        "portfolio_id", "decision", "size(grid) AS cells",
        "size(filter(grid, g -> g.won = decision)) / size(grid) AS share_held",
        "filter(grid, g -> g.won <> decision) AS flips",
    )


def replacements(held: DataFrame, screened: DataFrame) -> DataFrame:
    """Up to three swaps per portfolio: weakest holding first, best unused candidate.

    At most two candidates are taken before any pick, so a holding's three best feasible
    candidates decide it. Holdings that share the same three can fill at most three picks,
    so only the three weakest of each such class are kept, which bounds the final fold.
    """
    keyed = held.select("portfolio_id", "ticker", "composite_score", "valuation_points").join(
        screened.filter("size(screened) > 0").select("portfolio_id", "screened"), "portfolio_id"
    )
    feasible = (
        f"slice(filter(screened, x -> x.composite_score - composite_score >= {SCORE_GAP}D "
        f"AND x.valuation_points - valuation_points >= -{VALUATION_SLACK}D), 1, {MAX_REPLACEMENTS})"
    )
    options = keyed.selectExpr("portfolio_id", "ticker", "composite_score", f"{feasible} AS best").filter(
        "size(best) > 0"
    ).selectExpr("*", "best.ticker AS class")
    few = top_per_group(
        options, ["portfolio_id", "class"], [F.col("composite_score"), F.col("ticker")], MAX_REPLACEMENTS
    )
    queue = few.groupBy("portfolio_id").agg(
        F.expr("sort_array(collect_list(struct(composite_score AS s, ticker AS t, best AS b))) AS q")
    )
    kind = "array<struct<current:string,candidate:string,gap:double>>"
    free = "filter(h.b, x -> NOT exists(acc, p -> p.candidate = x.ticker))"
    step = (
        f"aggregate(q, cast(array() AS {kind}), (acc, h) -> CASE WHEN size(acc) = {MAX_REPLACEMENTS} "
        f"OR size({free}) = 0 THEN acc ELSE concat(acc, array(named_struct('current', h.t, "
        f"'candidate', {free}[0].ticker, 'gap', {free}[0].composite_score - h.s))) END)"
    )
    return queue.selectExpr("portfolio_id", f"posexplode({step}) AS (pos, r)").selectExpr(
        "portfolio_id", "pos + 1 AS place", "r.current AS current_ticker",
        "r.candidate AS candidate_ticker", "r.gap AS score_gap",
    )


def to_trim(held: DataFrame) -> DataFrame:
    """Positions above 1.3x equal weight whose score is below the trim limit."""
    return held.filter(
        (F.col("weight_pct") > F.lit(100.0) / F.col("position_count") * 1.3)
        & (F.col("composite_score") < TRIM_SCORE)
    ).select("portfolio_id", "ticker", "weight_pct", "composite_score")


def trims(held: DataFrame) -> DataFrame:
    """Positions to trim, heaviest first."""
    return ranked_per_group(to_trim(held), ["portfolio_id"], [F.col("weight_pct").desc(), F.col("ticker")], "place")


# Single-factor and equal-weight ablations of the composite.
WEIGHT_SETS = {
    "baseline_40_35_25": (0.40, 0.35, 0.25),
    "moat_only": (1.0, 0.0, 0.0),
    "compounding_only": (0.0, 1.0, 0.0),
    "valuation_only": (0.0, 0.0, 1.0),
    "equal_thirds": (1 / 3, 1 / 3, 1 / 3),
}


def perturbed_sets(deltas: Sequence[float] = (-0.10, -0.05, 0.05, 0.10)) -> dict[str, tuple]:
    """One factor shifted at a time; the others rescaled so the weights still sum to one."""
    factors = list(COMPOSITE_WEIGHTS)
    sets = {}
    for factor in factors:
        rest = 1.0 - COMPOSITE_WEIGHTS[factor]
        for delta in deltas:
            shifted = COMPOSITE_WEIGHTS[factor] + delta
            if 0 <= shifted <= 1 and rest > 0:
                sets[f"{factor}{delta:+.2f}"] = tuple(
                    shifted if f == factor else COMPOSITE_WEIGHTS[f] / rest * (1.0 - shifted)
                    for f in factors
                )
    return sets


def places_under_weights(holdings: DataFrame, sets: dict[str, tuple]) -> DataFrame:
    """One row per holding with its place under each weight set, as an array in the order of ``sets``.

    A portfolio's holdings are shuffled once, narrow, and sorted once for each set where they are.
    """
    points = ("moat_points", "compounding_points", "valuation_points")
    # Dealt before the scores are made: a window's order columns would travel with the rows.
    rows = holdings.select("portfolio_id", "ticker", *points).repartition("portfolio_id")
    places = []
    for i, weights in enumerate(sets.values()):
        score = F.expr(" + ".join(f"{float(w)!r}D * {p}" for w, p in zip(weights, points)))
        window = Window.partitionBy("portfolio_id").orderBy(score.desc(), F.col("ticker"))
        places.append(F.row_number().over(window).alias(f"_p{i}"))
    names = [f"_p{i}" for i in range(len(places))]
    return rows.select("portfolio_id", "ticker", *places).select("portfolio_id", "ticker", F.array(*names).alias("places"))


def _by_label(sets: dict[str, tuple], **columns: str) -> str:
    """A row for each weight set, with its element of the named array columns."""
    rows = (
        f"struct('{label}' AS label, " + ", ".join(f"{array}[{i}] AS {name}" for name, array in columns.items()) + ")"
        for i, label in enumerate(sets)
    )
    return f"inline(array({', '.join(rows)}))"


def rank_under_weights(holdings: DataFrame, sets: dict[str, tuple] | None = None) -> DataFrame:
    """Every holding's place under every weight set, a row for each."""
    sets = sets or WEIGHT_SETS
    placed = places_under_weights(holdings, sets)
    return placed.selectExpr("portfolio_id", "ticker", _by_label(sets, place="places"))


def weight_ablation(
    holdings: DataFrame, sets: dict[str, tuple] | None = None, baseline: str = "baseline_40_35_25", top_k: int = 2
) -> DataFrame:
    """Rank correlation with the baseline and how many of its top picks are lost."""
    sets = sets or WEIGHT_SETS
    base = f"places[{list(sets).index(baseline)}]"
    sums = [f"sum(pow(places[{i}] - {base}, 2))" for i in range(len(sets))]
    lost = [f"count_if({base} <= {top_k} AND places[{i}] > {top_k})" for i in range(len(sets))]
    totals = places_under_weights(holdings, sets).groupBy("portfolio_id").agg(
        F.expr("count(*) AS n"), F.expr(f"array({', '.join(sums)}) AS apart"), F.expr(f"array({', '.join(lost)}) AS lost")
    )
    rows = totals.selectExpr("portfolio_id", "n", _by_label(sets, apart="apart", churn="lost"))
    rho = "if(n < 2, 1D, 1 - 6 * apart / nullif(double(n) * (double(n) * n - 1), 0D)) AS spearman"
    return rows.selectExpr("portfolio_id", "label", rho, "churn")


def weight_sensitivity(holdings: DataFrame, top_k: int = 2) -> DataFrame:
    """Whether the ordered top picks change when one factor's weight moves."""
    sets = {"base": tuple(COMPOSITE_WEIGHTS.values()), **perturbed_sets()}
    placed = places_under_weights(holdings, sets).filter(f"exists(places, p -> p <= {top_k})")
    pick = "max(if(places[{i}] = {k}, ticker, NULL))"
    tops = [f"array_compact(array({', '.join(pick.format(i=i, k=k + 1) for k in range(top_k))}))" for i in range(len(sets))]
    ordered = placed.groupBy("portfolio_id").agg(F.expr(f"array({', '.join(tops)}) AS tops"))
    rows = ordered.selectExpr("portfolio_id", "tops[0] AS base_top", _by_label(sets, top="tops"))
    return rows.filter("label <> 'base'").selectExpr(
        "portfolio_id", "label", "array_join(top, '|') AS top", "top <> base_top AS changed"
    )
