"""Columns whose type the SQL twin must be told, so that both engines return BIGINT and DOUBLE."""

CASTS = {
    ("j8_known_orders", "BIGINT"): "event_type",
    ("m12_limit_level", "BIGINT"): "level",
    ("m13_cancel_level", "BIGINT"): "level",
    ("m19_book_delta", "BIGINT"): "level_index",
    ("a1_value_mix", "BIGINT"): "value",
    ("p2_after_open", "BIGINT"): "side ord_type",
    ("p2_session_filter", "BIGINT"): "side ord_type",
    ("p3_limit_orders", "BIGINT"): "side ord_type",
    ("p4_universe", "BIGINT"): "side ord_type",
    ("j1_join_mask", "BIGINT"): "side ord_type",
    ("u1_expand_legs", "BIGINT"): "exec_type leg",
    ("j2_match_legs", "BIGINT"): "exec_type leg orig_side",
    ("j10_match_rate", "BIGINT"): "exec_type",
    ("j11_context_window", "BIGINT"): "side",
    ("b3_code_side", "BIGINT"): "exec_type side",
    ("b4_code_side_single", "BIGINT"): "exec_type side",
    ("b5_split_cancels", "BIGINT"): "side orig_side",
    ("b7_build_flow", "BIGINT"): "side orig_side",
    ("b7_build_flow_open", "BIGINT"): "side orig_side",
    ("b7_build_flow_mid", "BIGINT"): "side orig_side",
    ("b7_build_flow_split", "BIGINT"): "side orig_side",
    ("u2_unify_flow", "BIGINT"): "orig_side",
    ("u3_pool", "BIGINT"): "side",
    ("b12_encode_token", "BIGINT"): "side_bin",
    ("b13_decode_token", "BIGINT"): "side_bin",
    ("b14_decode_mode", "BIGINT"): "side_bin",
    ("b15_decode_mid", "BIGINT"): "side_bin",
    ("b16_decode_exact", "BIGINT"): "side_bin",
    ("r1_level_depth", "BIGINT"): "side",
    ("r3_to_messages", "BIGINT"): "event_type direction",
    ("x1_user_function", "DOUBLE"): "score",
    ("k2_price_bins", "BIGINT"): "slot_no",
    ("k3_vol_delta", "BIGINT"): "slot_no",
    ("k5_apply_vol_edges", "BIGINT"): "slot_no",
    ("k6_slot_tokens", "BIGINT"): "slot_no",
    ("k7_decode_state", "DOUBLE"): "ask_p_1 ask_p_5 bid_p_1 bid_p_5",
    ("k9_slot_report", "BIGINT"): "slot_no",
    ("a10_slot_entropy", "BIGINT"): "slot_no",
    ("a10_slot_l1", "BIGINT"): "slot_no",
    ("c1_window_features", "DOUBLE"): "mid_return",
    ("c2_train_windows", "DOUBLE"): "mid_return",
    ("s10_cut_to_level", "BIGINT"): "depth",
    ("s8_load_catalogue", "BIGINT"): "event_type direction",
    ("s9_write_lobster", "BIGINT"): "event_type direction",
    ("s10_write_cut", "BIGINT"): "event_type direction",
    ("p10_events", "BIGINT"): "event_type",
    ("s11_bin_tables", "DOUBLE"): "bin_left",
    ("s12_write_state", "DOUBLE"): "last_edge",
    ("s1_read_posts", "BIGINT"): "side ord_type",
    ("s2_read_transactions", "BIGINT"): "exec_type",
    ("s3_read_snapshots", "DOUBLE"): "bid_v_10",
    ("s5_read_messages", "BIGINT"): "event_type direction",
    ("s7_read_tape", "BIGINT"): "event_type direction",
}


def typed(name: str, sql: str) -> str:
    """`sql` with the columns listed for `name` cast."""
    casts = [f"CAST({c} AS {kind}) AS {c}" for (query, kind), cols in CASTS.items() if query == name for c in cols.split()]
    return f"SELECT * REPLACE ({', '.join(casts)}) FROM (\n{sql}\n)" if casts else sql
