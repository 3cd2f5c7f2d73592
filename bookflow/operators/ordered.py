"""Ordered computation that never puts a whole key into one task.

One security or run may hold a large share of all rows, so a window partitioned by that key
alone would be one task. Every ordered operator here works on bounded *chunks* of a key:

* `dense_index` numbers the rows of a key from counts per bucket (map-side combined).
* `over_neighbours` serves sliding frames: with a dense index a chunk needs only a fixed number
  of rows of its neighbours, which are copied into it. One shuffle, no join.
* `running` serves unbounded frames: one row of totals per chunk is carried forward.
* `asof_backward` serves nearest-earlier lookups: with a tolerance, right rows are copied into
  the next time bucket; without one, `running` carries them.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from bookflow.functions import div
from bookflow.session import stage

CHUNK = 1 << 16
TASK_ROWS = 1 << 20


def chunk_of(pos: str) -> Column:
    """Chunk number of a dense or sparse non-negative sequence number."""
    return div(F.col(pos), CHUNK)


def spread(df: DataFrame, rows: int, *by: str) -> DataFrame:
    """Deal `df`, of about `rows` rows, by a key to so many tasks that each sorts at most TASK_ROWS of them; the session's number of partitions stands
    while it is enough. Sorts then need no more memory, and spill no more, when the input grows."""
    tasks = -(-rows // TASK_ROWS)
    return df.repartition(tasks, *by) if tasks > int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) else df


def join_key_stats(rows: DataFrame, stats: DataFrame, by: Sequence[str], how: str = "inner") -> DataFrame:
    """Join one row of statistics per key to the rows of the key.

    The statistics are written first, so their size is known when the join is planned: small ones are broadcast and the rows stay where they are;
    large ones are joined by a shuffle, whose skewed parts adaptive execution splits.
    """
    return rows.join(stage(stats, "key-stats"), list(by), how)


def dense_index(df: DataFrame, by: Sequence[str], order: Sequence[str | Column], bucket: Column,
                name: str = "row_seq") -> DataFrame:
    """0-based position of each row within `by` under `order`.

    `bucket` must be non-decreasing in `order` (a time bucket, or a sparse sequence number
    divided by a constant); only one bucket of one key is ever sorted together.
    """
    keyed = df.withColumn("_bucket", bucket)
    counts = keyed.groupBy(*by, "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    before = W.partitionBy(*by).orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    offsets = counts.select(*by, "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"))
    local = F.row_number().over(W.partitionBy(*by, "_bucket").orderBy(*order)) - 1
    return (
        keyed.withColumn("_rn", local)
        .join(offsets, [*by, "_bucket"], "left")
        .withColumn(name, (F.col("_off") + F.col("_rn")).cast("long"))
        .drop("_bucket", "_off", "_rn")
    )


def over_neighbours(df: DataFrame, by: Sequence[str], *builds: Callable[..., Mapping[str, Column]],
                    before: int = 0, after: int = 0, pos: str = "row_seq", chunk: int | None = None, rows: int = 0,
                    derive: Mapping[str, Column] | None = None) -> DataFrame:
    """Add columns computed over at most `before` earlier and `after` later rows.

    `pos` must be a dense index within `by`. Each of `builds` gets an ordered window and returns
    columns; later ones may use the columns of earlier ones and share the same sort. Together they
    must not reach further than `before` / `after` rows. `rows`, where known, is the number of rows: large tables are dealt to more
    tasks (`spread`). `derive` names columns of a row alone; they are made after the rows have moved and been sorted, so that narrow ones are.
    """
    chunk = max(chunk or CHUNK, before, after)
    home, rest = div(F.col(pos), chunk), F.pmod(F.col(pos), F.lit(chunk))
    homes = [home]
    if before:
        homes.append(F.when(rest >= chunk - before, home + 1))
    if after:
        homes.append(F.when((rest < after) & (home > 0), home - 1))
    keyed = df.withColumn("_home", home)
    if len(homes) == 1:
        keyed = keyed.withColumn("_chunk", F.col("_home"))
    else:
        keyed = keyed.withColumn("_chunk", F.explode(F.filter(F.array(*homes), lambda c: c.isNotNull())))
    window = W.partitionBy(*by, "_chunk").orderBy(pos)
    dealt = spread(keyed, rows, *by, "_chunk")
    if derive:
        dealt = keyed.repartition(*by, "_chunk") if dealt is keyed else dealt
        keyed = dealt.sortWithinPartitions(*by, "_chunk", pos).withColumns(dict(derive))
    else:
        keyed = dealt
    for build in builds:
        keyed = keyed.withColumns(dict(build(window)))
    return keyed.filter("_home = _chunk").drop("_home", "_chunk")


def running(df: DataFrame, by: Sequence[str], order: Sequence[str], chunk: Column | None, *,
            sums: Mapping[str, Column] | None = None, mins: Mapping[str, Column] | None = None,
            lasts: Mapping[str, Column] | None = None, nexts: Mapping[str, Column] | None = None,
            prevs: Mapping[str, Column] | None = None, totals: Mapping[str, Column] | None = None,
            befores: Mapping[str, Column] | None = None, froms: Mapping[str, Column] | None = None,
            afters: Mapping[str, Column] | None = None, rows: int = 0) -> DataFrame:
    """Running aggregates over all earlier rows of a key and the row itself.

    sums / mins: running sum / minimum. lasts: last non-null value so far. prevs / nexts: value on
    the previous / next row. befores: last non-null value on earlier rows only. froms: first
    non-null value on this or a later row; afters: on later rows only. totals: sum over the whole
    key. `chunk` must be non-decreasing in `order` and split a key into bounded parts; None says that
    every key is bounded. `rows`, where known, is the number of rows: large tables are dealt to more tasks (`spread`).
    """
    sums, mins, lasts, nexts, prevs, totals, befores, froms, afters = (
        dict(x or {}) for x in (sums, mins, lasts, nexts, prevs, totals, befores, froms, afters))
    if chunk is None:
        ahead = W.partitionBy(*by).orderBy(*order)
        span = lambda lo, hi: ahead.rowsBetween(lo, hi)
        start, end = W.unboundedPreceding, W.unboundedFollowing
        out = {n: F.coalesce(F.sum(c).over(span(start, 0)), F.lit(0)) for n, c in sums.items()}
        out |= {n: F.sum(c).over(W.partitionBy(*by)) for n, c in totals.items()}
        out |= {n: F.min(c).over(span(start, 0)) for n, c in mins.items()}
        out |= {n: F.last(c, ignorenulls=True).over(span(start, 0)) for n, c in lasts.items()}
        out |= {n: F.last(c, ignorenulls=True).over(span(start, -1)) for n, c in befores.items()}
        out |= {n: F.first(c, ignorenulls=True).over(span(0, end)) for n, c in froms.items()}
        out |= {n: F.first(c, ignorenulls=True).over(span(1, end)) for n, c in afters.items()}
        out |= {n: F.lag(c).over(ahead) for n, c in prevs.items()}
        out |= {n: F.lead(c).over(ahead) for n, c in nexts.items()}
        return df.select(*[c for c in df.columns if c not in out], *[c.alias(n) for n, c in out.items()])
    key = F.col(order[0]) if len(order) == 1 else F.struct(*order)
    inputs: dict[str, Column] = {}
    for kind, spec in (("s", sums), ("m", mins), ("l", lasts), ("n", nexts), ("p", prevs), ("t", totals),
                       ("b", befores), ("f", froms), ("a", afters)):
        inputs.update({f"_{kind}_{name}": col for name, col in spec.items()})
    keyed = df.withColumns({"_chunk": chunk, **inputs})

    # The first column of the order is largest on the last row: a plain maximum, while one by a struct would sort all rows before they are added up.
    leads = lambda c: str(c) == str(F.col(order[0]))
    parts = (
        [F.sum(f"_s_{n}").alias(f"_cs_{n}") for n in sums]
        + [F.sum(f"_t_{n}").alias(f"_ct_{n}") for n in totals]
        + [F.min(f"_m_{n}").alias(f"_cm_{n}") for n in mins]
        + [F.max_by(f"_l_{n}", F.when(F.col(f"_l_{n}").isNotNull(), key)).alias(f"_cl_{n}") for n in lasts]
        + [F.max_by(f"_b_{n}", F.when(F.col(f"_b_{n}").isNotNull(), key)).alias(f"_cb_{n}") for n in befores]
        + [F.min_by(f"_f_{n}", F.when(F.col(f"_f_{n}").isNotNull(), key)).alias(f"_cf_{n}") for n in froms]
        + [F.min_by(f"_a_{n}", F.when(F.col(f"_a_{n}").isNotNull(), key)).alias(f"_ca_{n}") for n in afters]
        + [(F.max(f"_p_{n}") if leads(c) else F.max_by(f"_p_{n}", key)).alias(f"_cp_{n}") for n, c in prevs.items()]
        + [(F.min(f"_n_{n}") if leads(c) else F.min_by(f"_n_{n}", key)).alias(f"_cn_{n}") for n, c in nexts.items()]
    )
    across = W.partitionBy(*by).orderBy("_chunk")
    later = across.rowsBetween(1, W.unboundedFollowing)
    earlier, whole = across.rowsBetween(W.unboundedPreceding, -1), W.partitionBy(*by)
    carry = keyed.groupBy(*by, "_chunk").agg(*parts).select(
        *by, "_chunk",
        *[F.sum(f"_cs_{n}").over(earlier).alias(f"_cs_{n}") for n in sums],
        *[F.sum(f"_ct_{n}").over(whole).alias(f"_ct_{n}") for n in totals],
        *[F.min(f"_cm_{n}").over(earlier).alias(f"_cm_{n}") for n in mins],
        *[F.last(f"_cl_{n}", ignorenulls=True).over(earlier).alias(f"_cl_{n}") for n in lasts],
        *[F.last(f"_cb_{n}", ignorenulls=True).over(earlier).alias(f"_cb_{n}") for n in befores],
        *[F.first(f"_cf_{n}", ignorenulls=True).over(later).alias(f"_cf_{n}") for n in froms],
        *[F.first(f"_ca_{n}", ignorenulls=True).over(later).alias(f"_ca_{n}") for n in afters],
        *[F.lag(f"_cp_{n}").over(across).alias(f"_cp_{n}") for n in prevs],
        *[F.lead(f"_cn_{n}").over(across).alias(f"_cn_{n}") for n in nexts],
    )
    inside = W.partitionBy(*by, "_chunk").orderBy(*order)
    so_far = inside.rowsBetween(W.unboundedPreceding, 0)
    local = {"_rank": F.row_number().over(inside)} if prevs else {}
    local |= {f"_left_{n}": F.lead(F.lit(1)).over(inside) for n in nexts}
    local |= {f"_s_{n}": F.sum(f"_s_{n}").over(so_far) for n in sums}
    local |= {f"_m_{n}": F.min(f"_m_{n}").over(so_far) for n in mins}
    local |= {f"_l_{n}": F.last(f"_l_{n}", ignorenulls=True).over(so_far) for n in lasts}
    local |= {f"_b_{n}": F.last(f"_b_{n}", ignorenulls=True).over(inside.rowsBetween(W.unboundedPreceding, -1))
              for n in befores}
    local |= {f"_f_{n}": F.first(f"_f_{n}", ignorenulls=True).over(inside.rowsBetween(0, W.unboundedFollowing))
              for n in froms}
    local |= {f"_a_{n}": F.first(f"_a_{n}", ignorenulls=True).over(inside.rowsBetween(1, W.unboundedFollowing))
              for n in afters}
    local |= {f"_p_{n}": F.lag(f"_p_{n}").over(inside) for n in prevs}
    local |= {f"_n_{n}": F.lead(f"_n_{n}").over(inside) for n in nexts}
    # Every chunk has its totals; an outer join adds no null filter, so both sides can share one exchange.
    joined = spread(keyed, rows, *by, "_chunk").withColumns(local).join(carry, [*by, "_chunk"], "left")

    out = {n: F.coalesce(F.col(f"_s_{n}"), F.lit(0)) + F.coalesce(F.col(f"_cs_{n}"), F.lit(0)) for n in sums}
    out |= {n: F.col(f"_ct_{n}") for n in totals}
    out |= {n: F.least(f"_m_{n}", f"_cm_{n}") for n in mins}
    out |= {n: F.coalesce(f"_l_{n}", f"_cl_{n}") for n in lasts}
    out |= {n: F.coalesce(f"_b_{n}", f"_cb_{n}") for n in befores}
    out |= {n: F.coalesce(f"_f_{n}", f"_cf_{n}") for n in froms}
    out |= {n: F.coalesce(f"_a_{n}", f"_ca_{n}") for n in afters}
    out |= {n: F.when(F.col("_rank") == 1, F.col(f"_cp_{n}")).otherwise(F.col(f"_p_{n}")) for n in prevs}
    out |= {n: F.when(F.col(f"_left_{n}").isNull(), F.col(f"_cn_{n}")).otherwise(F.col(f"_n_{n}")) for n in nexts}
    keep = [c for c in df.columns if c not in out]
    return joined.select(*keep, *[c.alias(n) for n, c in out.items()])


def asof_backward(left: DataFrame, right: DataFrame, by: Sequence[str], on: str, take: Sequence[str], *,
                  tolerance: int | None = None, tie: Sequence[str] = (), bucket: int | None = None) -> DataFrame:
    """Attach to each left row the latest right row with `right.on <= left.on` in the same `by`.

    A match older than `tolerance` gives NULLs, never an older row. Equal times match. `tie`
    orders right rows with equal times (the last wins).
    """
    width = bucket or max(tolerance or 0, 60_000)
    right_rows = right.select(
        *by, on, F.lit(0).alias("_side"), (F.struct(*tie) if tie else F.lit(0)).alias("_tie"),
        F.struct(F.col(on).alias("_at"), *take).alias("_hit"))
    left_rows = left.select(*by, on, F.lit(1).alias("_side"), F.struct("*").alias("_row"))
    slot = div(F.col(on), width)
    if tolerance is not None:
        right_rows = right_rows.withColumn("_slot", F.explode(F.array(slot, slot + 1)))
        both = left_rows.withColumn("_slot", slot).unionByName(right_rows, allowMissingColumns=True)
        window = W.partitionBy(*by, "_slot").orderBy(on, "_side", "_tie").rowsBetween(W.unboundedPreceding, 0)
        found = both.withColumn("_found", F.last("_hit", ignorenulls=True).over(window))
        fresh = F.col(f"_row.{on}") - F.col("_found._at") <= tolerance
    else:
        both = left_rows.unionByName(right_rows, allowMissingColumns=True).withColumn("_slot", slot)
        found = running(both, by, [on, "_side", "_tie"], F.col("_slot"), lasts={"_found": F.col("_hit")})
        fresh = F.lit(True)
    return found.filter("_side = 1").select(
        "_row.*", *[F.when(fresh, F.col(f"_found.{c}")).alias(c) for c in take])


CUTS, STRIDE = 512, 32


def value_chunks(rows: DataFrame, by: Sequence[str], value: str, name: str = "_vc") -> DataFrame:
    """Add a chunk number that never falls as `value` rises, so that chunks of a key hold about equally many rows.

    Keys of at most CHUNK rows are one chunk. The borders of a larger key are quantiles of its own rows, from a sketch that is merged map-side in one
    pass, so they follow the data however narrow or wide its values lie; the sketch only places the borders, results do not depend on it. The borders
    are broadcast: one row of about 4 kB for each key of more than CHUNK rows, a sixteenth of a byte for each row.
    """
    probs = [i / CUTS for i in range(1, CUTS)]
    borders = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("_rows"), F.percentile_approx(value, probs, 8 * CUTS).alias("_cuts")).filter(
        F.col("_rows") > CHUNK).select(*by, "_cuts", F.transform(F.sequence(F.lit(STRIDE), F.lit(CUTS - 1), F.lit(STRIDE)), lambda i: F.element_at("_cuts", i)).alias("_coarse"))
    v = F.col(value)
    block = F.size(F.filter("_coarse", lambda c: c < v)) * STRIDE
    inside = F.size(F.filter(F.slice("_cuts", block + 1, F.lit(STRIDE)), lambda c: c < v))
    # null borders (a small key) give size -1 or null: one chunk
    joined = rows.join(F.broadcast(borders), list(by) if by else F.lit(True), "left")
    return joined.withColumn(name, F.when(F.col("_cuts").isNull(), F.lit(0)).otherwise(block + inside)).drop("_cuts", "_coarse")


def over_values(rows: DataFrame, by: Sequence[str], value: str, order: Sequence[str] | None = None, **spec: Mapping[str, Column]) -> DataFrame:
    """`running` in the order of a value. The rows, one for each distinct value, are written first and counted: where no key has more than CHUNK of
    them a key is one sorted run and one shuffle is enough, else keys are cut at the borders of `value_chunks`."""
    table = stage(rows, "values")
    order = order or [value]
    large = table.count() > CHUNK and not table.groupBy(*by).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > CHUNK).isEmpty()
    if not large:
        return running(table, by, order, None, **spec)
    return running(value_chunks(table, by, value), by, order, F.col("_vc"), **spec).drop("_vc")


def cumulative(hist: DataFrame, by: Sequence[str], value: str, counts: Sequence[str],
               totals: Mapping[str, Column] | None = None) -> DataFrame:
    """Cumulative counts over the distinct values of each key, with group totals and next value.

    `hist` has one row per (by, value). Adds cum_<c>, tot_<c>, `next_value` and any further `totals`.
    """
    return over_values(
        hist, by, value,
        sums={f"cum_{c}": F.col(c) for c in counts},
        totals={f"tot_{c}": F.col(c) for c in counts} | dict(totals or {}),
        nexts={"next_value": F.col(value)},
    )


def quantiles(df: DataFrame, by: Sequence[str], value: str, probs: Mapping[str, float],
              weight: str | None = None) -> DataFrame:
    """Exact linear-interpolation quantiles per key, one column per entry of `probs`, plus `n`.

    Works on the value histogram, so no key's values are gathered into one buffer. `weight` counts
    how often a row stands for its value.
    """
    hist = df.filter(F.col(value).isNotNull()).groupBy(*by, F.col(value).cast("double").alias("_v")).agg(
        (F.sum(weight) if weight else F.count(F.lit(1))).alias("_n"))
    cum = cumulative(hist, by, "_v", ["_n"])
    picks = []
    for name, p in probs.items():
        at = (F.col("tot__n") - 1) * F.lit(float(p))
        for part, rank in (("lo", F.floor(at)), ("hi", F.ceil(at))):
            hit = (F.col("cum__n") - F.col("_n") <= rank) & (rank < F.col("cum__n"))
            picks.append(F.max(F.when(hit, F.col("_v"))).alias(f"_{part}_{name}"))
    rows = cum.groupBy(*by).agg(F.max("tot__n").alias("n"), *picks)
    out = []
    for name, p in probs.items():
        at = (F.col("n") - 1) * F.lit(float(p))
        frac = at - F.floor(at)
        lo, hi = F.col(f"_lo_{name}"), F.col(f"_hi_{name}")
        out.append((lo + (hi - lo) * frac).alias(name))
    return rows.select(*by, "n", *out)


SKETCH = 1000


def quantiles_of(df: DataFrame, by: Sequence[str], values: Sequence[str], probs: Mapping[str, float]) -> DataFrame:
    """Exact linear-interpolation quantiles of several columns per key, named <prob>_<value>; NULL where a key has no value.

    Few rows move: a sketch, merged map-side, brackets each quantile of a key of more than CHUNK values; tasks count the values under a bracket,
    and only values inside one, about four in SKETCH, are sorted. Where the counts show that a bracket missed its rank, the column is done
    by `quantiles` over all of its values, so results never depend on the sketch. `df` is read three times: stage what is costly.
    """
    margin = 2 / SKETCH + 2 / CHUNK
    picks = [(v, name, float(p)) for v in values for name, p in probs.items()]
    ends = lambda p: F.array(F.lit(max(0.0, p - margin)), F.lit(min(1.0, p + margin)))
    rows = df.select(*by, *[F.col(v).cast("double").alias(f"_x_{v}") for v in values])
    place = lambda v, p: F.when(F.count(f"_x_{v}") > CHUNK, F.percentile_approx(f"_x_{v}", ends(p), SKETCH))
    borders = rows.groupBy(*by).agg(*[F.count(f"_x_{v}").alias(f"_n_{v}") for v in values], *[place(v, p).alias(f"_b{i}") for i, (v, _, p) in enumerate(picks)])
    borders = stage(borders, "quantile-borders")
    placed = join_key_stats(rows, borders.drop(*[f"_n_{v}" for v in values]), by)
    low, high = (lambda i: F.col(f"_b{i}")[0]), (lambda i: F.col(f"_b{i}")[1])
    x = lambda i: F.col(f"_x_{picks[i][0]}")
    under = placed.groupBy(*by).agg(*[F.sum(F.coalesce(x(i) < low(i), F.lit(False)).cast("long")).alias(f"_u{i}") for i in range(len(picks))])
    held = lambda i: x(i).isNotNull() & F.coalesce((x(i) >= low(i)) & (x(i) <= high(i)), F.lit(True))
    some = F.filter(F.array(*[F.when(held(i), F.struct(F.lit(i).alias("_i"), x(i).alias("_v"))) for i in range(len(picks))]), lambda s: s.isNotNull())
    hist = placed.select(*by, F.inline(some)).groupBy(*by, "_i", "_v").agg(F.count(F.lit(1)).alias("_n"))
    cum = cumulative(hist, [*by, "_i"], "_v", ["_n"])
    facts = borders.join(under, list(by)).select(*by, F.inline(F.array(*[F.struct(
        F.lit(i).alias("_i"), F.col(f"_n_{v}").alias("_all"), F.col(f"_u{i}").alias("_under"), ((F.col(f"_n_{v}") - 1) * F.lit(p)).alias("_at"))
        for i, (v, _, p) in enumerate(picks)])))
    hit = lambda rank: F.max(F.when((F.col("_under") + F.col("cum__n") - F.col("_n") <= rank) & (rank < F.col("_under") + F.col("cum__n")), F.col("_v")))
    found = cum.join(stage(facts, "quantile-facts"), [*by, "_i"]).groupBy(*by, "_i", "_at").agg(
        hit(F.floor("_at")).alias("_lo"), hit(F.ceil("_at")).alias("_hi"))
    exact = F.col("_lo") + (F.col("_hi") - F.col("_lo")) * (F.col("_at") - F.floor("_at"))
    wanted = stage(found.select(*by, "_i", exact.alias("_q")), "quantiles")
    out = wanted.groupBy(*by).agg(*[F.max(F.when(F.col("_i") == i, F.col("_q"))).alias(f"{name}_{v}") for i, (v, name, _) in enumerate(picks)])
    # A bracket that missed holds no value at its rank, or none at all.
    whole = [F.count(F.when(F.col(f"_n_{v}") > 0, 1)) for v, _, _ in picks]
    keys = borders.agg(*[c.alias(f"k{i}") for i, c in enumerate(whole)]).first()
    done = {r["_i"]: r["n"] for r in wanted.groupBy("_i").agg(F.count("_q").alias("n")).collect()}
    missed = sorted({v for i, (v, _, _) in enumerate(picks) if done.get(i, 0) < keys[f"k{i}"]})
    out = borders.select(*by).join(out, list(by), "left")
    for v in missed:
        again = quantiles(df, by, v, {f"{name}_{v}": p for name, p in probs.items()}).drop("n")
        out = out.drop(*[f"{name}_{v}" for name in probs]).join(again, list(by), "left")
    return out
