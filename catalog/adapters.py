"""Driver tables shaped into the engine's inputs, in Spark and as SQL text for the oracle.

Integer arithmetic only, so both engines agree to the last digit.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, functions as F

from bookflow.functions import div
from bookflow.operators import bins, flow as flows, ordered
from bookflow.session import stage

LEVELS = range(1, 11)
TAPE_KEYS = ("run_id", "kind")


def _level_terms(i: int) -> dict[str, str]:
    return {
        f"ask_p_{i}": f"ask1 + {100 * (i - 1)}",
        f"ask_v_{i}": f"100 * (1 + (event_id * {13 * i + 7}) % 97)",
        f"bid_p_{i}": f"bid1 - {100 * (i - 1)}",
        f"bid_v_{i}": f"100 * (1 + (event_id * {17 * i + 5}) % 89)",
    }


# Terms that read the same in both engines.
TOUCH = {
    "run_id": "user_id % 4",
    "kind": "CASE WHEN event_id % 2 = 0 THEN 'real' ELSE 'generated' END",
    "event_type": "CASE event_type WHEN 'purchase' THEN 4 WHEN 'error' THEN 3 WHEN 'signup' THEN 2 ELSE 1 END",
    "size": "100 * (1 + (event_id * 31) % 40)",
    "ask1": "100000 + 100 * ((event_id * 7) % 23)",
    "bid1": "100000 + 100 * ((event_id * 7) % 23) - 100 * (1 + event_id % 3)",
    "price": "100000 + 100 * ((event_id * 7) % 23) - 100 * (1 + event_id % 3) + 100 * ((event_id * 11) % 25 - 12)",
}

TAPE_SQL = f"""touch AS (
  SELECT event_id, epoch_us(ts) * 1000 AS t_ns, event_id // 3 AS order_id,
    CASE WHEN (event_id // 2) % 2 = 0 THEN 1 ELSE -1 END AS direction,
    {', '.join(f'{sql} AS {name}' for name, sql in TOUCH.items())}
  FROM events),
tape AS (
  SELECT *, row_number() OVER (PARTITION BY run_id, kind ORDER BY event_id) - 1 AS row_seq,
    {', '.join(f'{sql} AS {name}' for i in LEVELS for name, sql in _level_terms(i).items())}
  FROM touch)"""

SECURITY = "concat(lpad(CAST({key} % 8 AS {text}), 6, '0'), '_XSHE')"
POST_TERMS = {
    "trade_date": "20250709 + o_orderkey % 2",
    "channel_no": "2010 + (o_orderkey % 8) % 3",
    "appl_seq_num": "o_orderkey",
    "price_tick": "1000 + (o_orderkey * 37) % 41 - 20",
    "order_qty": "100 * (1 + (o_orderkey * 53) % 50)",
    "side": "CASE WHEN CAST(FLOOR(o_orderkey / 8.0) AS BIGINT) % 2 = 0 THEN 49 ELSE 50 END",
    "ord_type": "CASE WHEN o_orderpriority = '5-LOW' THEN 49 ELSE 50 END",
    "t_ms": "33900000 + (o_orderkey * 7919) % 19800000",
}
_OTHER = "l_orderkey + 8 * (2 * (l_partkey % 50) + 1)"
_BUY = "CAST(FLOOR(l_orderkey / 8.0) AS BIGINT) % 2"
TXN_TERMS = {
    "trade_date": "20250709 + l_orderkey % 2",
    "channel_no": "2010 + (l_orderkey % 8) % 3",
    "bid_seq": f"CASE WHEN {_BUY} = 0 THEN l_orderkey WHEN l_returnflag = 'R' THEN 0 ELSE {_OTHER} END",
    "offer_seq": f"CASE WHEN {_BUY} = 1 THEN l_orderkey WHEN l_returnflag = 'R' THEN 0 ELSE {_OTHER} END",
    "last_qty": "CAST(l_quantity AS BIGINT) * 100",
    "exec_type": "CASE WHEN l_returnflag = 'R' THEN 52 ELSE 70 END",
    "t_ms": "33900000 + (l_orderkey * 7919) % 19800000 + CASE WHEN l_linenumber % 5 = 0 THEN 0 ELSE (l_suppkey * 6007) % 600000 END",
    "txn_seq": "l_partkey * 8000 + l_linenumber * 1000 + l_suppkey % 1000",
}
# One snapshot per order: every fourth in the anchor second 09:31:00, the rest 0 to 7 s before the order's own post.
SNAP_TERMS = {
    "trade_date": "20250709 + o_orderkey % 2",
    "t_ms": "CASE WHEN CAST(FLOOR(o_orderkey / 16.0) AS BIGINT) % 4 = 0 THEN 34260000 + o_orderkey % 1000 "
            "ELSE 33900000 + (o_orderkey * 7919) % 19800000 - 1000 * (CAST(FLOOR(o_orderkey / 64.0) AS BIGINT) % 8) END",
    "snap_seq": "o_orderkey",
    "bid1": "1000 + (o_orderkey * 17) % 21 - 10",
    "ask1": "1000 + (o_orderkey * 17) % 21 - 10 + 1 + o_orderkey % 3",
}


MASK_SQL = """mask AS (
  SELECT 20250709 + CAST(FLOOR(p_partkey / 8.0) AS BIGINT) % 2 AS trade_date,
    concat(lpad(CAST(p_partkey % 8 AS VARCHAR(6)), 6, '0'), '_XSHE') AS security_id,
    CAST(CASE WHEN sum(p_size) % 4 > 0 THEN 1 ELSE 0 END AS BIGINT) AS is_liquid
  FROM part GROUP BY ALL)"""

FLOW_KEYS = ("trade_date", "security_id")
_ORDER = "trade_date, security_id, channel_no, appl_seq_num"


def flow_sql(variant: str = "open_complete", split: bool = False) -> str:
    """CTEs ending in `flow`, for the three variants of the flow build."""
    if variant == "mid":
        priced = """secs AS (SELECT trade_date, security_id, t_ms // 1000 AS t_sec, arg_max((bid1 + ask1) / 2.0, (t_ms, snap_seq)) AS mid_tick FROM snaps GROUP BY ALL),
priced AS (SELECT o.*, mid_tick, CAST(round_even((price_tick - mid_tick) / 0.5, 0) AS BIGINT) AS price_diff
  FROM (SELECT *, t_ms // 1000 AS t_sec FROM orders50) o ASOF JOIN secs s ON o.trade_date = s.trade_date AND o.security_id = s.security_id
  AND o.t_sec >= s.t_sec WHERE o.t_sec - s.t_sec <= 5)"""
    else:
        priced = """anchors AS (SELECT trade_date, security_id, arg_max(bid1, (t_ms, snap_seq)) AS anchor_bid_tick, arg_max(ask1, (t_ms, snap_seq)) AS anchor_ask_tick
  FROM snaps WHERE t_ms // 1000 = 34260 GROUP BY ALL),
priced AS (SELECT o.*, anchor_bid_tick, price_tick - anchor_bid_tick AS price_diff FROM orders50 o JOIN anchors USING (trade_date, security_id))"""
    done = "CASE WHEN orig_side = 49 THEN 129 WHEN orig_side = 50 THEN 130 END" if variant == "open_complete" else "129"
    cancel = "CASE WHEN orig_side = 49 THEN 97 WHEN orig_side = 50 THEN 98 ELSE 99 END" if split else "99"
    qty, keep = ("order_qty - least(coalesce(immediate_qty, 0), order_qty)", "WHERE order_qty > coalesce(immediate_qty, 0)") \
        if variant == "open_complete" else ("order_qty", "")
    return f"""orders50 AS (SELECT * FROM posts WHERE ord_type = 50 AND t_ms // 1000 > 34200),
{priced},
legs AS (SELECT trade_date, security_id, channel_no, bid_seq AS appl_seq_num, exec_type, last_qty AS order_qty, t_ms, txn_seq, 1 AS leg FROM txns WHERE bid_seq <> 0
  UNION ALL SELECT trade_date, security_id, channel_no, offer_seq, exec_type, last_qty, t_ms, txn_seq, 2 FROM txns WHERE offer_seq <> 0),
matched AS (SELECT l.*, price_tick, price_diff, p.side AS orig_side FROM legs l JOIN priced p USING ({_ORDER})),
executed AS (SELECT {_ORDER}, t_ms, CAST(sum(order_qty) AS BIGINT) AS immediate_qty FROM matched WHERE exec_type = 70 GROUP BY ALL),
flagged AS (SELECT p.*, coalesce(immediate_qty, 0) AS immediate_raw FROM priced p LEFT JOIN executed USING ({_ORDER}, t_ms)),
both_rows AS (
  SELECT {_ORDER}, t_ms, {qty} AS order_qty, side, side AS orig_side, price_tick, price_diff, 'post' AS event_semantic, 0 AS leg, 0 AS txn_seq, 0 AS exec_type
  FROM priced LEFT JOIN executed USING ({_ORDER}, t_ms) {keep}
  UNION ALL SELECT {_ORDER}, t_ms, order_qty, CASE WHEN exec_type = 52 THEN {cancel} ELSE {done} END, orig_side, price_tick, price_diff,
    CASE WHEN exec_type = 52 THEN 'cancel' ELSE 'transaction_complete' END, leg, txn_seq, exec_type FROM matched),
flow AS (SELECT *, coalesce(t_ms - lag(t_ms) OVER (PARTITION BY trade_date, security_id ORDER BY row_seq), 0) AS interval_ms FROM (
  SELECT *, row_number() OVER (PARTITION BY trade_date, security_id ORDER BY t_ms, channel_no, appl_seq_num, leg, txn_seq, exec_type, order_qty) - 1 AS row_seq
  FROM both_rows WHERE t_ms // 1000 BETWEEN 33900 AND 54000))"""


RADICES = {"price": 26, "qty": 26, "interval": 12}
# Fixed edges for the queries whose twin needs them spelled out; fitted edges are checked on their own.
FIXED_EDGES = {
    "price": [-60.0, -20.0, -15.0, -10.0, -7.0, -4.0, -2.0, 0.0, 2.0, 4.0, 7.0, 10.0, 15.0, 20.0, 60.0],
    "qty": [0.0, 200.0, 500.0, 1000.0, 1500.0, 2000.0, 2500.0, 3000.0, 3500.0, 4000.0, 4500.0, 5000.0],
    "interval": [-1.0, 0.0, 100.0, 500.0, 1000.0, 2000.0, 5000.0, 20000.0, 1000000.0],
}


def _bin_sql(column: str, edges: list[float]) -> str:
    return f"greatest(0, least(len(list_filter({edges}, lambda e: e < {column})) - 1, {len(edges) - 2}))"


BINNED_SQL = "binned AS (SELECT *, " + ", ".join(
    f"{_bin_sql(col, FIXED_EDGES[name])} AS {name}_bin" for name, col in bins.FIELDS.items()) + " FROM flow)"
TOKENS_SQL = BINNED_SQL + f""",
tokens AS (SELECT *, order_token IS NOT NULL AS tokenizable_event FROM (SELECT *,
  ((price_bin * {len(FIXED_EDGES['qty']) - 1} + qty_bin) * {len(FIXED_EDGES['interval']) - 1} + interval_bin) * 5 + side_bin AS order_token
  FROM (SELECT *, CASE side WHEN 49 THEN 0 WHEN 50 THEN 1 WHEN 99 THEN 2 WHEN 129 THEN 3 WHEN 130 THEN 4 END AS side_bin FROM binned)))"""


def _terms(terms: dict[str, str]) -> str:
    return ", ".join(f"{sql} AS {name}" for name, sql in terms.items())


FEEDS_SQL = f"""posts AS (SELECT {SECURITY.format(key='o_orderkey', text='VARCHAR(6)')} AS security_id, {_terms(POST_TERMS)} FROM orders),
txns AS (SELECT {SECURITY.format(key='l_orderkey', text='VARCHAR(6)')} AS security_id, {_terms(TXN_TERMS)} FROM lineitem),
snaps AS (SELECT {SECURITY.format(key='o_orderkey', text='VARCHAR(6)')} AS security_id, {_terms(SNAP_TERMS)} FROM orders)"""


def wall_us(ts: str) -> "F.Column":
    """Microseconds since 1970-01-01 of a wall-clock time, whatever the session zone."""
    day = F.datediff(F.to_date(ts), F.lit("1970-01-01").cast("date")).cast("long")
    return (day * 86_400_000_000 + F.hour(ts).cast("long") * 3_600_000_000 + F.minute(ts).cast("long") * 60_000_000
            + (F.expr(f"extract(SECOND FROM {ts})") * 1_000_000).cast("long"))


_made: dict[tuple, object] = {}


class Tables:
    """Engine inputs over one data folder."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def once(self, label: str, build):
        """Result of `build()`, made once per application and folder."""
        key = (self.spark.sparkContext.applicationId, self.sf_dir, label)
        if key not in _made:
            _made[key] = build()
        return _made[key]

    def staged(self, label: str, build) -> DataFrame:
        """A derived table written once, as a user keeps a preprocessed flow."""
        return self.once(label, lambda: stage(build(), label))

    def raw(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @cached_property
    def tape(self) -> DataFrame:
        return self.staged("tape", self._tape)

    def _tape(self) -> DataFrame:
        base = self.raw("events").select(
            "event_id", (wall_us("ts") * 1000).alias("t_ns"), div(F.col("event_id"), 3).alias("order_id"),
            F.when(div(F.col("event_id"), 2) % 2 == 0, 1).otherwise(-1).alias("direction"),
            *[F.expr(sql).alias(name) for name, sql in TOUCH.items()])
        levels = F.array(*[F.struct(*[F.expr(sql).cast("long").alias(name.rsplit("_", 1)[0])
                                      for name, sql in _level_terms(i).items()]) for i in LEVELS])
        # Rows are numbered before they get their levels, so that the shuffle moves narrow ones.
        numbered = ordered.dense_index(base, TAPE_KEYS, ["event_id"], ordered.chunk_of("event_id"))
        return numbered.withColumn("levels", levels).drop("ask1", "bid1")

    @cached_property
    def posts(self) -> DataFrame:
        return self.raw("orders").select(
            F.expr(SECURITY.format(key="o_orderkey", text="STRING")).alias("security_id"),
            *[F.expr(sql).cast("long").alias(name) for name, sql in POST_TERMS.items()])

    @cached_property
    def txns(self) -> DataFrame:
        return self.raw("lineitem").select(
            F.expr(SECURITY.format(key="l_orderkey", text="STRING")).alias("security_id"),
            *[F.expr(sql).cast("long").alias(name) for name, sql in TXN_TERMS.items()])

    @cached_property
    def snaps(self) -> DataFrame:
        return self.raw("orders").select(
            F.expr(SECURITY.format(key="o_orderkey", text="STRING")).alias("security_id"),
            *[F.expr(sql).cast("long").alias(name) for name, sql in SNAP_TERMS.items()])

    @cached_property
    def mask(self) -> DataFrame:
        part = self.raw("part").select(
            (F.floor(F.col("p_partkey") / 8) % 2 + 20250709).cast("long").alias("trade_date"),
            F.expr(SECURITY.format(key="p_partkey", text="STRING")).alias("security_id"), "p_size")
        return part.groupBy(*FLOW_KEYS).agg((F.sum("p_size") % 4 > 0).cast("long").alias("is_liquid"))

    @cached_property
    def wide_mask(self) -> DataFrame:
        """The mask as it arrives: one row per day, one column per security."""
        return self.mask.groupBy("trade_date").pivot("security_id").agg(F.max("is_liquid"))

    @cached_property
    def flow(self) -> DataFrame:
        return self.staged("flow", lambda: flows.build_flow(self.posts, self.txns, self.snaps))

    @cached_property
    def flow_seconds(self) -> DataFrame:
        return self.flow.withColumn("t_sec", div(F.col("t_ms"), 1000))

    @cached_property
    def edges(self) -> dict[str, list[float]]:
        return self.once("edges", lambda: bins.fit_bins_pooled([self.flow], RADICES, tuple(flows.SIDES_5)))

    @cached_property
    def tokens(self) -> DataFrame:
        return self.staged("tokens", lambda: bins.encode_token(
            bins.apply_bins(self.flow, FIXED_EDGES), tuple(len(FIXED_EDGES[f]) - 1 for f in bins.FIELDS)))
