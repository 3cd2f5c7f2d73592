"""Distances between a real and a generated sample.

Score tables are long: key columns `by`, `kind` ('real' | 'generated'), `score`, and `grp` where a
grouping is needed. All distances reduce to the histogram of distinct values first.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from bookflow.functions import PRIME, div, edge_group, is_finite, literal_edges, toss
from bookflow.operators.ordered import cumulative, join_key_stats, over_values, quantiles, running, value_chunks
from bookflow.session import stage

REAL, GENERATED = "real", "generated"


def compared(scores: DataFrame) -> DataFrame:
    """Rows of the two kinds that are compared; sequences of any other kind (conditional) are scored only."""
    return scores.filter(F.col("kind").isin(REAL, GENERATED)) if "kind" in scores.columns else scores


def _count_kind(kind: str, weight: str | None) -> Column:
    one = F.col(weight) if weight else F.lit(1)
    return F.sum(F.when(F.col("kind") == kind, one).otherwise(F.lit(0))).cast("long")


def _cdf_gap() -> Column:
    """Area between the two distribution functions up to the next value; NULL when a kind is missing."""
    both = (F.col("tot__r") > 0) & (F.col("tot__g") > 0)
    gap = F.abs(F.try_divide(F.col("cum__r"), F.col("tot__r")) - F.try_divide(F.col("cum__g"), F.col("tot__g")))
    return F.when(both, gap * F.coalesce(F.col("next_value") - F.col("_v"), F.lit(0.0)))


def wasserstein(scores: DataFrame, by: Sequence[str], *, score: str = "score", ddof: int | None = 1,
                weight: str | None = None) -> DataFrame:
    """Wasserstein-1 between the kinds on pooled z-scores, one row per key.

    z-scoring is affine, so the distance is taken on raw values and divided by the pooled standard
    deviation (`ddof` 1 or 0; None leaves raw units). NULL when a kind is missing or the spread is
    zero; with ddof 0 a zero spread gives 0.
    """
    hist = (
        compared(scores).filter(is_finite(F.col(score)))
        .groupBy(*by, F.col(score).cast("double").alias("_v"))
        .agg(_count_kind(REAL, weight).alias("_r"), _count_kind(GENERATED, weight).alias("_g"))
    )
    cum = cumulative(hist, by, "_v", ["_r", "_g"], totals={"_mass": (F.col("_r") + F.col("_g")) * F.col("_v")})
    n = F.col("tot__r") + F.col("tot__g")
    rows = cum.groupBy(*by).agg(
        F.max("tot__r").alias("n_real"), F.max("tot__g").alias("n_generated"),
        F.sum(_cdf_gap()).alias("_w"),
        F.sum((F.col("_r") + F.col("_g")) * F.pow(F.col("_v") - F.col("_mass") / n, 2)).alias("_ss"),
    )
    if ddof is None:
        value = F.col("_w")
    else:
        free = F.col("n_real") + F.col("n_generated") - ddof
        std = F.sqrt(F.col("_ss") / F.when(free > 0, free))
        value = F.when(std > 0, F.col("_w") / std)
        if ddof == 0:
            value = F.when((F.col("n_real") > 0) & (F.col("n_generated") > 0), F.coalesce(value, F.lit(0.0)))
    return rows.select(*by, "n_real", "n_generated", value.alias("wasserstein"))


def l1_by_group(scores: DataFrame, by: Sequence[str], *, group: str = "grp", weight: str | None = None) -> DataFrame:
    """Half the summed absolute difference of group shares; 1 when a kind is missing."""
    counts = (
        compared(scores).groupBy(*by, F.col(group).alias("_grp"))
        .agg(_count_kind(REAL, weight).alias("_r"), _count_kind(GENERATED, weight).alias("_g"))
    )
    chunk = F.pmod(F.xxhash64("_grp"), F.lit(256))  # totals need no order
    shared = running(counts, by, ["_grp"], chunk, totals={"_tr": F.col("_r"), "_tg": F.col("_g")})
    half = F.sum(F.abs(F.try_divide(F.col("_r"), F.col("_tr")) - F.try_divide(F.col("_g"), F.col("_tg")))) / 2
    return shared.groupBy(*by).agg(half.alias("_h"), F.max("_tr").alias("_nr"), F.max("_tg").alias("_ng")).select(
        *by, F.when((F.col("_nr") > 0) & (F.col("_ng") > 0), F.col("_h")).otherwise(F.lit(1.0)).alias("l1_by_group"))


# Grouping of scores ---------------------------------------------------------------------------------------

def bin_stats(scores: DataFrame, by: Sequence[str], score: str = "score", moments: bool = False,
              weight: str | None = None) -> DataFrame:
    """n, lo, hi, q25, q75 (and std, skew where a rule needs them) of the pooled scores."""
    scores = compared(scores)
    stats = quantiles(scores, by, score, {"lo": 0.0, "q25": 0.25, "q75": 0.75, "hi": 1.0}, weight)
    if moments and weight:
        raise ValueError("rules on moments need unweighted scores")
    if moments:
        more = scores.groupBy(*by).agg(F.stddev_pop(score).alias("std"), F.skewness(score).alias("skew"))
        stats = stats.join(more, list(by))
    return stats


STONE_LEAST = 100


def stone_bins(hist: DataFrame, by: Sequence[str]) -> DataFrame:
    """Number of equal bins with the least leave-one-out cost of each key, out of 1 to max(100, sqrt(n)), from (by, _v, _n); ties go to fewer bins.

    The cost of b bins needs the sum of squared bin counts. The values of a chunk are counted for every b at once; bins that lie inside the chunk are
    squared there, and only its first and last bin, which may reach into other chunks, are added up across chunks.
    """
    stats = hist.groupBy(*by).agg(F.sum("_n").alias("_t"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
    keyed = value_chunks(hist, by, "_v").join(stats, list(by)).filter("_hi > _lo")
    keys = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in hist.select(*by).schema.fields)

    def count(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("_v")
        v, n = part["_v"].to_numpy(), part["_n"].to_numpy()
        lo, hi = float(part["_lo"].iloc[0]), float(part["_hi"].iloc[0])
        most = max(STONE_LEAST, math.isqrt(int(part["_t"].iloc[0])))
        total = np.append(0, np.cumsum(n))
        rows = []
        for b in range(1, most + 1):
            edges = np.linspace(lo, hi, b + 1)
            at = np.minimum(((v - lo) / (hi - lo) * b).astype(np.int64), b - 1)
            at -= v < edges[at]
            at += (v >= edges[at + 1]) & (at != b - 1)
            lead = np.flatnonzero(np.append(True, at[1:] != at[:-1]))
            sums = np.diff(total[np.append(lead, len(v))])
            ends = {int(at[0]): int(sums[0]), int(at[-1]): int(sums[-1])}
            rows.append((b, -1, sum(int(c) ** 2 for c in sums[1:-1]) if len(sums) > 2 else 0))
            rows += [(b, k, c) for k, c in ends.items()]
        return pd.DataFrame([(*key[:-1], *r) for r in rows], columns=[*by, "b", "bin", "x"])

    parts = keyed.groupBy(*by, "_vc").applyInPandas(count, f"{keys}, b long, bin long, x double")
    edges = parts.groupBy(*by, "b", "bin").agg(F.sum("x").alias("x"))
    squares = edges.groupBy(*by, "b").agg(F.sum(F.when(F.col("bin") < 0, F.col("x")).otherwise(F.col("x") * F.col("x"))).alias("_q"))
    n = F.col("_t").cast("double")
    cost = (2 - (n + 1) * (F.col("_q") / (n * n))) / ((F.col("_hi") - F.col("_lo")) / F.col("b"))
    return squares.join(stats, list(by)).groupBy(*by).agg(F.min_by("b", F.struct(cost, "b")).alias("stone"))


def rule_width(rule: str) -> Column:
    """Bin width of a histogram rule from `bin_stats` columns; 0 means a single bin."""
    n, span = F.col("n").cast("double"), F.col("hi") - F.col("lo")
    fd = 2.0 * (F.col("q75") - F.col("q25")) * F.pow(n, F.lit(-1.0 / 3.0))
    sturges = span / (F.log2(n) + 1.0)
    root = span / F.sqrt(n)
    if rule == "fd":
        return fd
    if rule == "sturges":
        return sturges
    if rule == "sqrt":
        return root
    if rule == "rice":
        return span / (2.0 * F.pow(n, F.lit(1.0 / 3.0)))
    if rule == "scott":
        return F.pow(F.lit(24.0 * 3.141592653589793 ** 0.5) / n, F.lit(1.0 / 3.0)) * F.col("std")
    if rule == "doane":
        sg1 = F.sqrt(6.0 * (n - 2.0) / ((n + 1.0) * (n + 3.0)))
        wide = span / (1.0 + F.log2(n) + F.log2(1.0 + F.abs(F.col("skew")) / sg1))
        return F.when((n > 2) & (F.col("std") > 0), wide).otherwise(F.lit(0.0))
    if rule == "stone":
        return F.coalesce(span / F.col("stone"), F.lit(0.0))
    if rule == "auto":
        return F.least(F.greatest(fd, root / 2.0), sturges)
    raise ValueError(f"unknown bin rule {rule!r}")


def _bin_range(width: Column) -> list[Column]:
    """_lo, _hi, _bins of a rule; a single value gets a bin of width 1 around it."""
    flat = F.col("lo") == F.col("hi")
    count = F.when(width > 0, F.ceil((F.col("hi") - F.col("lo")) / width)).otherwise(F.lit(1))
    return [F.when(flat, F.col("lo") - 0.5).otherwise(F.col("lo")).alias("_lo"),
            F.when(flat, F.col("hi") + 0.5).otherwise(F.col("hi")).alias("_hi"),
            F.greatest(count, F.lit(1)).cast("long").alias("_bins")]


def equal_width_group(value: Column, lo: Column, hi: Column, bins: Column) -> Column:
    """Number of the bins+1 equally spaced edges of [lo, hi] that are <= value, without an edge array."""
    step = (hi - lo) / bins
    guess = F.floor((value - lo) / step)
    edge = lambda k: F.when(k >= bins, hi).otherwise(lo + k * step)
    exact = F.when(edge(guess + 1) <= value, guess + 1).when(edge(guess) > value, guess - 1).otherwise(guess)
    return (F.greatest(F.lit(-1), F.least(exact, bins)) + 1).cast("long")


def group_scores(scores: DataFrame, by: Sequence[str], method: str, *, rule: str = "fd", bins: int | None = None,
                 probs: Sequence[float] | None = None, thresholds: Sequence[float] | None = None,
                 score: str = "score", name: str = "grp", weight: str | None = None) -> DataFrame:
    """Add a group id: the number of thresholds that are <= the score.

    method: 'discrete' (every distinct value is a threshold), 'rule' (histogram rule), 'bins'
    (inner edges of equal bins), 'quantiles', 'thresholds'. Thresholds come from the compared kinds.
    """
    x = F.col(score)
    if method == "thresholds":
        return scores.withColumn(name, edge_group(x, literal_edges(thresholds)))
    if method == "discrete":
        values = scores.select(*by, x.cast("double").alias("_v")).groupBy(*by, "_v").count()
        ranked = over_values(values, by, "_v", sums={name: F.lit(1)})
        keyed = scores.withColumn("_v", x.cast("double"))
        return keyed.join(ranked.select(*by, "_v", F.col(name).cast("long").alias(name)), [*by, "_v"]).drop("_v")
    if method == "rule":
        stats = bin_stats(scores, by, score, moments=rule in ("scott", "doane"), weight=weight)
        if rule == "stone":
            count = F.sum(weight) if weight else F.count(F.lit(1))
            hist = compared(scores).filter(x.isNotNull()).groupBy(*by, x.cast("double").alias("_v")).agg(count.alias("_n"))
            stats = stats.join(stone_bins(hist, by), list(by), "left")
        edges = stats.select(*by, *_bin_range(rule_width(rule)))
        grouped = join_key_stats(scores, edges, by)
        return grouped.withColumn(name, equal_width_group(x, F.col("_lo"), F.col("_hi"), F.col("_bins"))).drop(
            "_lo", "_hi", "_bins")
    if method == "bins":
        stats = compared(scores).groupBy(*by).agg(F.min(x).cast("double").alias("_lo"), F.max(x).cast("double").alias("_hi"))
        grouped = join_key_stats(scores, stats, by)
        spread = F.when(F.col("_hi") > F.col("_lo"),
                        equal_width_group(x, F.col("_lo"), F.col("_hi"), F.lit(bins)) - 1).otherwise(F.lit(bins - 1))
        return grouped.withColumn(name, F.greatest(F.lit(0), F.least(spread, F.lit(bins - 1))).cast("long")).drop(
            "_lo", "_hi")
    if method == "quantiles":
        edges = quantile_edges(scores, by, probs, score=score, weight=weight)
        return join_key_stats(scores, edges, by).withColumn(name, edge_group(x, F.col("edges"))).drop("edges")
    raise ValueError(f"unknown grouping {method!r}")


def quantile_edges(scores: DataFrame, by: Sequence[str], probs: Sequence[float], score: str = "score",
                   weight: str | None = None) -> DataFrame:
    """Quantile thresholds per key: a value repeated more than twice is kept twice, its second copy raised by 0.01."""
    named = {f"_q{i}": p for i, p in enumerate(probs)}
    raw = F.array(*[F.col(c) for c in named])
    kept = F.filter(raw, lambda e, i: (i < 2) | ~((e == raw[i - 1]) & (raw[i - 1] == raw[i - 2])))
    table = quantiles(compared(scores), by, score, named, weight).withColumn("_kept", kept)
    raised = F.transform(F.col("_kept"), lambda e, i: F.when(
        (i > 0) & (e == F.col("_kept")[F.greatest(i - 1, F.lit(0))]), e + 0.01).otherwise(e))
    return table.select(*by, raised.alias("edges"))


# Comparisons ----------------------------------------------------------------------------------------------

def compare(scores: DataFrame, by: Sequence[str], *, discrete: bool | Column = False, score: str = "score",
            weight: str | None = None) -> DataFrame:
    """Unconditional comparison: sample sizes, Wasserstein and L1 by group of the finite scores.

    Scores are first reduced to counts of distinct values; one running pass over these gives the
    distance and the quartiles, and a second look at them gives the group shares. `discrete` may be a
    condition on the keys: where it holds every value is its own group, elsewhere groups come from
    the FD rule.
    """
    table = (
        compared(scores).filter(is_finite(F.col(score)))
        .groupBy(*by, F.col(score).cast("double").alias("_v"))
        .agg(_count_kind(REAL, weight).alias("_r"), _count_kind(GENERATED, weight).alias("_g"))
    )
    cum = cumulative(table, by, "_v", ["_r", "_g"], totals={"_mass": (F.col("_r") + F.col("_g")) * F.col("_v")})
    n, end = F.col("tot__r") + F.col("tot__g"), F.col("cum__r") + F.col("cum__g")
    picks = []
    for name, p in (("q25", 0.25), ("q75", 0.75)):
        for part, rank in (("lo", F.floor((n - 1) * p)), ("hi", F.ceil((n - 1) * p))):
            hit = (end - F.col("_r") - F.col("_g") <= rank) & (rank < end)
            picks.append(F.max(F.when(hit, F.col("_v"))).alias(f"_{part}_{name}"))
    stats = cum.groupBy(*by).agg(
        F.max("tot__r").alias("n_real"), F.max("tot__g").alias("n_generated"), F.sum(_cdf_gap()).alias("_w"),
        F.sum((F.col("_r") + F.col("_g")) * F.pow(F.col("_v") - F.col("_mass") / n, 2)).alias("_ss"),
        F.min("_v").alias("lo"), F.max("_v").alias("hi"), *picks).withColumn("n", F.col("n_real") + F.col("n_generated"))
    for name, p in (("q25", 0.25), ("q75", 0.75)):
        at = (F.col("n") - 1) * F.lit(p)
        stats = stats.withColumn(name, F.col(f"_lo_{name}") + (F.col(f"_hi_{name}") - F.col(f"_lo_{name}")) * (at - F.floor(at)))
    std = F.sqrt(F.col("_ss") / F.when(F.col("n") > 1, F.col("n") - 1))
    facts = stats.withColumn("wasserstein", F.when(std > 0, F.col("_w") / std)).select(
        *by, "n_real", "n_generated", "wasserstein", *_bin_range(rule_width("fd")))
    by_rule = equal_width_group(F.col("_v"), F.col("_lo"), F.col("_hi"), F.col("_bins")).cast("double")
    own = F.col("_v")
    group = own if discrete is True else by_rule if discrete is False else F.when(discrete, own).otherwise(by_rule)
    keep = ("n_real", "n_generated", "wasserstein")
    shares = cum.join(facts, list(by)).groupBy(*by, group.alias("_grp")).agg(
        F.sum("_r").alias("_r"), F.sum("_g").alias("_g"), *[F.max(c).alias(c) for c in keep])
    both = (F.col("n_real") > 0) & (F.col("n_generated") > 0)
    off = F.abs(F.try_divide(F.col("_r"), F.col("n_real")) - F.try_divide(F.col("_g"), F.col("n_generated")))
    return shares.groupBy(*by).agg(*[F.max(c).alias(c) for c in keep], (F.sum(off) / 2).alias("_l1")).select(
        *by, *keep, F.when(both, F.col("_l1")).otherwise(F.lit(1.0)).alias("l1_by_group"))


def compare_given(scores: DataFrame, by: Sequence[str], method: str, *, score: str = "score", given: str = "given",
                  **options) -> DataFrame:
    """Wasserstein inside each group of the condition, weighted by group size; NULL if any group has none."""
    clean = compared(scores).filter(is_finite(F.col(score)) & is_finite(F.col(given)))
    grouped = clean.withColumn("grp", F.col(given)) if method == "discrete" else group_scores(
        clean, by, method, score=given, **options)
    return weighted_wasserstein(wasserstein(grouped, [*by, "grp"], score=score), by)


def weighted_wasserstein(per_group: DataFrame, by: Sequence[str]) -> DataFrame:
    n = F.col("n_real") + F.col("n_generated")
    complete = F.bool_and(F.col("wasserstein").isNotNull())
    return per_group.groupBy(*by).agg(
        F.sum("n_real").alias("n_real"), F.sum("n_generated").alias("n_generated"),
        F.when(complete, F.sum(F.col("wasserstein") * n) / F.sum(n)).alias("weighted_wasserstein"),
        F.count(F.lit(1)).alias("num_condition_groups"))


# Distributions over keys ----------------------------------------------------------------------------------

def align(p: DataFrame, q: DataFrame, by: Sequence[str], key: str, value: str = "probability") -> DataFrame:
    """Full outer join of two distributions on `key`; a missing side counts 0."""
    left = p.select(*by, key, F.col(value).alias("p"))
    right = q.select(*by, key, F.col(value).alias("q"))
    return left.join(right, [*by, key], "full").select(
        *by, key, F.coalesce("p", F.lit(0.0)).alias("p"), F.coalesce("q", F.lit(0.0)).alias("q"))


def _js_bits(p: Column, q: Column) -> Column:
    m = (p + q) / 2
    part = lambda a: F.sum(F.when(a > 0, a * F.log2(a / m)).otherwise(F.lit(0.0)))
    return (part(p) + part(q)) / 2


def js_bits(aligned: DataFrame, by: Sequence[str]) -> DataFrame:
    return aligned.groupBy(*by).agg(_js_bits(F.col("p"), F.col("q")).alias("js_bits"))


def tv(aligned: DataFrame, by: Sequence[str]) -> DataFrame:
    return aligned.groupBy(*by).agg((F.sum(F.abs(F.col("p") - F.col("q"))) / 2).alias("tv"))


def support_overlap(aligned: DataFrame, by: Sequence[str]) -> DataFrame:
    in_p, in_q = F.col("p") > 0, F.col("q") > 0
    rows = aligned.groupBy(*by).agg(
        F.sum(in_p.cast("long")).alias("unique_p"), F.sum(in_q.cast("long")).alias("unique_q"),
        F.sum((in_p & in_q).cast("long")).alias("overlap"), F.count(F.lit(1)).alias("_union"))
    return rows.select(*by, "unique_p", "unique_q", "overlap", F.coalesce(
        F.try_divide(F.col("overlap"), F.col("_union")), F.lit(1.0)).alias("jaccard"))


def token_report(tokens: DataFrame, by: Sequence[str], true: str = "token_true", pred: str = "token_pred") -> DataFrame:
    """Token-distribution report per key from one scan: sizes, support overlap, TV, JS and Wasserstein (population std)."""
    kinds = F.array(F.struct(F.lit(REAL).alias("kind"), F.col(true).cast("long").alias("token")),
                    F.struct(F.lit(GENERATED).alias("kind"), F.col(pred).cast("long").alias("token")))
    samples = tokens.select(*by, F.inline(kinds)).filter(F.col("token").isNotNull())
    hist = samples.groupBy(*by, "token").agg(
        _count_kind(REAL, None).alias("_r"), _count_kind(GENERATED, None).alias("_g"))
    cum = cumulative(hist.withColumn("_v", F.col("token").cast("double")), by, "_v", ["_r", "_g"],
                     totals={"_mass": (F.col("_r") + F.col("_g")) * F.col("token")})
    p, q = F.col("_r") / F.col("tot__r"), F.col("_g") / F.col("tot__g")
    n = F.col("tot__r") + F.col("tot__g")
    in_p, in_q = F.col("_r") > 0, F.col("_g") > 0
    gap = F.abs(F.col("cum__r") / F.col("tot__r") - F.col("cum__g") / F.col("tot__g"))
    rows = cum.groupBy(*by).agg(
        F.max("tot__r").alias("sample_count_true"), F.max("tot__g").alias("sample_count_pred"),
        F.sum(in_p.cast("long")).alias("unique_true"), F.sum(in_q.cast("long")).alias("unique_pred"),
        F.sum((in_p & in_q).cast("long")).alias("overlap"), F.count(F.lit(1)).alias("_union"),
        (F.sum(F.abs(p - q)) / 2).alias("l1_by_group"), _js_bits(p, q).alias("js_bits"),
        F.sum(gap * F.coalesce(F.col("next_value") - F.col("_v"), F.lit(0.0))).alias("_w"),
        F.sum((F.col("_r") + F.col("_g")) * F.pow(F.col("_v") - F.col("_mass") / n, 2)).alias("_ss"))
    std = F.sqrt(F.col("_ss") / (F.col("sample_count_true") + F.col("sample_count_pred")))
    return rows.select(
        *by, "sample_count_true", "sample_count_pred", "unique_true", "unique_pred", "overlap",
        (F.col("overlap") / F.col("_union")).alias("jaccard"), "l1_by_group", "js_bits",
        F.when(std > 0, F.col("_w") / std).otherwise(F.lit(0.0)).alias("wasserstein"))


# Kullback-Leibler estimators ------------------------------------------------------------------------------

def kl_ecdf(scores: DataFrame, by: Sequence[str], score: str = "score") -> DataFrame:
    """KL(real || generated) from the slopes of the two empirical distribution functions.

    At every real point but the last: ln(slope_real / slope_generated) of the segments ending
    there, averaged, minus 1.
    """
    hist = scores.groupBy(*by, F.col(score).cast("double").alias("_v")).agg(
        _count_kind(REAL, None).alias("_r"), _count_kind(GENERATED, None).alias("_g"))
    real_v, gen_v = (F.when(F.col(c) > 0, F.col("_v")) for c in ("_r", "_g"))
    seen = over_values(hist, by, "_v", sums={"_cum": F.col("_r")}, befores={"_p_lo": real_v, "_q_lo": gen_v}, froms={"_q_hi": gen_v},
                   totals={"_n": F.col("_r"), "_m": F.col("_g")})
    ends = hist.groupBy(*by).agg((F.min("_v") - 1).alias("_x0"), (F.max("_v") + 1).alias("_x1"))
    points = seen.filter("_r > 0").join(ends, list(by))
    x, n, m = F.col("_v"), F.col("_n"), F.col("_m")
    slope_p = F.when(F.col("_p_lo").isNull(), 0.5 / n / (x - F.col("_x0"))).otherwise(1.0 / n / (x - F.col("_p_lo")))
    q_lo, q_hi = F.coalesce("_q_lo", "_x0"), F.coalesce("_q_hi", "_x1")
    rise = F.when(F.col("_q_lo").isNull() | F.col("_q_hi").isNull(), 0.5 / m).otherwise(1.0 / m)
    slope_q = rise / (q_hi - q_lo)
    uses = F.when(F.col("_cum") == n, F.col("_r") - 1).otherwise(F.col("_r"))
    term = F.log(slope_p / slope_q)
    return points.withColumns({"_uses": uses, "_term": term}).groupBy(*by).agg(
        (F.sum(F.col("_uses") * F.col("_term")) / F.sum("_uses") - 1).alias("kl_ecdf"))


def kl_knn_1d(scores: DataFrame, by: Sequence[str], score: str = "score") -> DataFrame:
    """n and KL(real || generated) from one-dimensional nearest neighbours, without pairs.

    On the sorted union of both samples the nearest other real value and the nearest generated value stand at the closest earlier or later row that
    has one; equal values are at distance 0. As in `kl_knn`, real points with a zero distance have no term. Non-finite scores do not count. NULL
    where there are fewer than two real points, no generated one, or no term.
    """
    hist = compared(scores).filter(is_finite(F.col(score))).groupBy(*by, F.col(score).cast("double").alias("_v")).agg(
        _count_kind(REAL, None).alias("_r"), _count_kind(GENERATED, None).alias("_g"))
    real_v, gen_v = (F.when(F.col(c) > 0, F.col("_v")) for c in ("_r", "_g"))
    near = over_values(hist, by, "_v", befores={"_x0": real_v, "_y0": gen_v}, afters={"_x1": real_v, "_y1": gen_v})
    gap = lambda lo, hi: F.least(F.col("_v") - F.col(lo), F.col(hi) - F.col("_v"))
    r = F.when(F.col("_r") > 1, F.lit(0.0)).otherwise(gap("_x0", "_x1"))
    s = F.when(F.col("_g") > 0, F.lit(0.0)).otherwise(gap("_y0", "_y1"))
    term = F.when((F.col("_r") > 0) & (r > 0) & (s > 0), F.col("_r") * F.log(r / s))
    rows = near.groupBy(*by).agg(F.sum("_r").alias("n"), F.sum("_g").alias("_m"), F.sum(term).alias("_t"))
    n, m = F.col("n"), F.col("_m")
    return rows.select(*by, "n", F.when((n > 1) & (m > 0), -F.col("_t") / n + F.log(m / F.when(n > 1, n - 1))).alias("kl_knn"))


def kl_kde(scores: DataFrame, by: Sequence[str], points: int, *, bandwidth: float = 0.2, score: str = "score",
           grid_chunk: int = 512) -> DataFrame:
    """KL of Gaussian kernel densities over an even grid on [min - 1, max + 1].

    Kernels are summed on the histogram of distinct values. A value reaches only grid points within
    `reach` bandwidths: beyond 39 bandwidths a kernel underflows to 0 in double precision.
    """
    hist = scores.filter(is_finite(F.col(score))).groupBy(*by, F.col(score).cast("double").alias("_v")).agg(
        _count_kind(REAL, None).alias("_r"), _count_kind(GENERATED, None).alias("_g"))
    ends = hist.groupBy(*by).agg((F.min("_v") - 1).alias("_lo"), (F.max("_v") + 1).alias("_hi"),
                                 F.sum("_r").alias("_n"), F.sum("_g").alias("_m"))
    step = (F.col("_hi") - F.col("_lo")) / (points - 1)
    reach = 39.0 * bandwidth
    placed = hist.join(ends, list(by))
    first = F.greatest(F.lit(0), F.ceil((F.col("_v") - reach - F.col("_lo")) / step)).cast("long")
    last = F.least(F.lit(points - 1), F.floor((F.col("_v") + reach - F.col("_lo")) / step)).cast("long")
    near = placed.withColumn("_k", F.explode(F.sequence(first, last)))
    u = (F.col("_lo") + F.col("_k") * step - F.col("_v")) / bandwidth
    kernel = F.exp(-u * u / 2)
    scale = 1.0 / (bandwidth * (2 * 3.141592653589793) ** 0.5)
    dens = near.groupBy(*by, "_k").agg(
        (F.sum(F.col("_r") * kernel) * scale / F.max("_n")).alias("_p"),
        (F.sum(F.col("_g") * kernel) * scale / F.max("_m")).alias("_q"))
    block = F.col("_c") * grid_chunk
    grid = ends.select(*by, F.explode(F.sequence(F.lit(0), F.lit((points - 1) // grid_chunk))).alias("_c")).select(
        *by, F.explode(F.sequence(block, F.least(block + grid_chunk - 1, F.lit(points - 1)))).alias("_k"))
    full = grid.join(dens, [*by, "_k"], "left").select(
        *by, (F.coalesce("_p", F.lit(0.0)) + 1e-10).alias("_p"), (F.coalesce("_q", F.lit(0.0)) + 1e-10).alias("_q"))
    ratio = F.log(F.col("_p") / F.col("_q"))
    sums = full.groupBy(*by).agg(F.sum(F.col("_p") * ratio).alias("_pr"), F.sum("_p").alias("_sp"),
                                 F.sum("_q").alias("_sq"))
    return sums.select(*by, (F.col("_pr") / F.col("_sp") - F.log(F.col("_sp") / F.col("_sq"))).alias("kl_kde"))


# Bootstrap ------------------------------------------------------------------------------------------------

Loss = Callable[[DataFrame, Sequence[str]], DataFrame]


def wasserstein_loss(sample: DataFrame, by: Sequence[str]) -> DataFrame:
    rows = wasserstein(sample, by, ddof=None, weight="weight")
    return rows.select(*by, F.col("wasserstein").alias("loss"))


def l1_loss(sample: DataFrame, by: Sequence[str]) -> DataFrame:
    return l1_by_group(sample, by, weight="weight").withColumnRenamed("l1_by_group", "loss")


FEW = 32  # draws that are tossed one by one
LEAVES = 4096  # distinct rows of a part of the split tree


def left_share(k: np.ndarray, left: np.ndarray, total: np.ndarray, state: np.ndarray) -> np.ndarray:
    """How many of k draws fall on the left `left` of `total` rows: up to FEW draws are tossed one by one, more take the normal approximation of
    the binomial with a sum of twelve tosses."""
    p = left / total
    few, twelve = np.zeros(len(k), np.int64), np.zeros(len(k), np.int64)
    for i in range(FEW):
        u = toss(toss(state + 65_537 * (i + 1)))
        few += (i < k) & (u / PRIME < p)
        if i < 12:
            twelve += u
    z = twelve / PRIME - 6
    many = np.floor(k * p + z * np.sqrt(k * p * (1 - p)) + 0.5)
    return np.where(k <= FEW, few, np.clip(many, 0, k)).astype(np.int64)


def split_draws(counts: np.ndarray, k: np.ndarray, seed: np.ndarray, node: int = 1) -> np.ndarray:
    """Draws on each of `counts` rows (axis 1) of each replicate (axis 0, `k` draws): the draws of a node are split between its halves, down to single
    rows. `node` numbers the root in a larger tree, so a part of the tree gives the same draws wherever it is split."""
    total = np.append(0, np.cumsum(counts))
    lo, hi, name, draws = np.array([0]), np.array([len(counts)]), np.array([node]), k[:, None]
    out = np.zeros((len(k), len(counts)), np.int64)
    while len(lo):
        done = hi - lo == 1
        out[:, lo[done]] = draws[:, done]
        lo, hi, name, draws = lo[~done], hi[~done], name[~done], draws[:, ~done]
        if not len(lo):
            break
        mid = (lo + hi) // 2
        state = toss(seed[:, None] + (name % PRIME)[None] * 7_919 % PRIME)
        shape = draws.shape
        wide = lambda v: np.broadcast_to(v, shape).ravel()
        left = left_share(draws.ravel(), wide(total[mid] - total[lo]), wide(total[hi] - total[lo]), state.ravel()).reshape(shape)
        lo, hi, name, draws = np.append(lo, mid), np.append(mid, hi), np.append(2 * name, 2 * name + 1), np.concatenate([left, draws - left], axis=1)
    return out


def bootstrap(scores: DataFrame, by: Sequence[str], loss: Loss, *, replicates: int = 100, alpha: float = 0.01,
              seed: int = 12345, standardise: bool = False, leaves: int = LEAVES) -> DataFrame:
    """Percentile interval of a loss over resamples of each kind, the full data counted as one replicate.

    A resample of n rows is drawn as counts: the distinct rows of a kind, in score order, are the leaves of a balanced tree, and the draws of a node
    are split between its halves by a seeded rule of whole numbers (`left_share`). No draw is a row: the work is one count per distinct row and
    replicate. Subtrees of at most `leaves` distinct rows are split in tasks of their own, the top of the tree over their totals; the result depends
    on the data and the seed, not on the parts. `loss(sample, keys)` gets rows with a `weight` and returns one `loss` per key.
    """
    scores = compared(scores)
    cols = ["score", *sorted(c for c in scores.columns if c not in (*by, "kind", "score"))]
    keys = [*by, "kind"]
    hist = scores.groupBy(*keys, *cols).agg(F.count(F.lit(1)).alias("_n"))
    if standardise:
        std = scores.groupBy(*by).agg(F.stddev_samp("score").alias("_std"))
        hist = hist.join(std, list(by)).withColumn("score", F.col("score") / F.col("_std")).drop("_std")
    ranked = over_values(hist, keys, "score", cols, sums={"_rank": F.lit(1)}, totals={"_d": F.lit(1)})
    # the node of a row: halves are taken until they hold at most `leaves` rows
    root = F.struct(F.lit(0).cast("long").alias("lo"), F.col("_d").cast("long").alias("hi"), F.lit(1).cast("long").alias("id"))

    def half(node: Column, _: Column) -> Column:
        mid = div(node["lo"] + node["hi"], 2)
        right = F.col("_rank") - 1 >= mid
        down = F.struct(F.when(right, mid).otherwise(node["lo"]).alias("lo"), F.when(right, node["hi"]).otherwise(mid).alias("hi"), (node["id"] * 2 + right.cast("long")).alias("id"))
        return F.when(node["hi"] - node["lo"] > leaves, down).otherwise(node)

    depth = F.greatest(F.lit(0), F.ceil(F.log2(F.col("_d") / leaves)) + 1).cast("int")
    placed = stage(ranked.withColumn("_node", F.aggregate(F.when(depth > 0, F.sequence(F.lit(1), depth)).otherwise(F.array().cast("array<int>")), root, half)).select(
        *keys, *cols, "_n", "_rank", F.col("_node.id").alias("_id"), F.col("_node.lo").alias("_lo")), "split-tree")
    types = {f.name: f.dataType.simpleString() for f in placed.schema.fields}
    declared = lambda names: ", ".join(f"{c} {types[c]}" for c in names)
    state = toss(seed + 1_000_003 * np.arange(1, replicates + 1))
    seed_of = lambda kind: toss(state + (104_729 if kind == REAL else 1_299_709))

    def top(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("_lo")
        n = part["_t"].to_numpy()
        draws = _split_parts(n, part["_lo"].to_numpy(), part["_c"].to_numpy(), part["_id"].to_numpy(), np.full(replicates, n.sum()), seed_of(key[-1]))
        out = part[[*keys, "_id"]].copy()
        out["_k"] = list(draws.T)
        return out

    def leaf(part: pd.DataFrame, ks: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("_rank")
        draws = split_draws(part["_n"].to_numpy(), np.array(ks["_k"].iloc[0]), seed_of(part["kind"].iloc[0]), int(part["_id"].iloc[0]))
        b, at = np.nonzero(draws)
        out = part[[*keys, *cols]].iloc[at].reset_index(drop=True)
        out["_b"], out["weight"] = b + 1, draws[b, at]
        return out

    nodes = placed.groupBy(*keys, "_id", "_lo").agg(F.sum("_n").alias("_t"), F.count(F.lit(1)).alias("_c"))
    shares = nodes.groupBy(*keys).applyInPandas(top, f"{declared(keys)}, _id long, _k array<long>")
    resampled = placed.groupBy(*keys, "_id").cogroup(shares.groupBy(*keys, "_id")).applyInPandas(leaf, f"{declared([*keys, *cols])}, _b long, weight long")
    whole = hist.select(*keys, *cols, F.lit(0).cast("long").alias("_b"), F.col("_n").alias("weight"))
    losses = loss(resampled.unionByName(whole), [*by, "_b"])
    return losses.groupBy(*by).agg(
        F.max(F.when(F.col("_b") == 0, F.col("loss"))).alias("loss"),
        F.percentile("loss", F.lit(alpha / 2)).alias("ci_low"),
        F.percentile("loss", F.lit(1 - alpha / 2)).alias("ci_high"),
        F.count("loss").alias("n_losses"))


def _split_parts(totals: np.ndarray, lows: np.ndarray, sizes: np.ndarray, ids: np.ndarray, k: np.ndarray, seed: np.ndarray) -> np.ndarray:
    """Draws of each part (replicates x parts): the splits of `split_draws` from the root down to the parts `ids`, of `sizes` rows from `lows` on."""
    before = np.append(0, np.cumsum(totals))
    out = np.zeros((len(k), len(ids)), np.int64)
    begins = np.append(lows, lows[-1] + sizes[-1])
    lo, hi, name, draws = np.array([0]), begins[-1:], np.array([1]), k[:, None]
    place = {int(i): j for j, i in enumerate(ids)}
    while len(lo):
        done = np.array([int(i) in place for i in name])
        out[:, [place[int(i)] for i in name[done]]] = draws[:, done]
        lo, hi, name, draws = lo[~done], hi[~done], name[~done], draws[:, ~done]
        if not len(lo):
            break
        mid = (lo + hi) // 2
        at = [before[np.searchsorted(begins, x)] for x in (lo, mid, hi)]  # parts begin and end at the borders of nodes
        state = toss(seed[:, None] + (name % PRIME)[None] * 7_919 % PRIME)
        wide = lambda v: np.broadcast_to(v, draws.shape).ravel()
        left = left_share(draws.ravel(), wide(at[1] - at[0]), wide(at[2] - at[0]), state.ravel()).reshape(draws.shape)
        lo, hi, name, draws = np.append(lo, mid), np.append(mid, hi), np.append(2 * name, 2 * name + 1), np.concatenate([left, draws - left], axis=1)
    return out
