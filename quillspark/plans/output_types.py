"""Which result columns leave the engine as text (days) or as doubles (decimals, and whole numbers that may be NULL).

So a reader of any engine sees the same values.  By query: (days, numbers).
"""

OUTPUT_TYPES: dict[str, tuple[tuple[str, ...], tuple[str, ...]]] = {
    "vol_moves": (("date", "listing_id"), ("close", "adj_prev_close", "pct_move", "tick_move", "split_factor", "div_cash")),
    "vol_adv_trailing": (("listing_id", "date"), ()),
    "vol_topn_lists": (("date",), ("pct_move",)),
    "vol_counters": (("date",), ()),
    "vol_new_names": (("date",), ()),
    "actions_range_product": (("listing_id", "date"), ("split_factor", "div_cash")),
    "action_audit": (("date", "prev_date"), ("prev_close", "close", "ratio")),
    "audit_summary": ((), ("greatest", "least")),
    "outcome_anchor": (("event_date", "base_date"), ("base_close",)),
    "outcome_forward": (("event_date", "base_date", "fwd_date"), ("base_close", "fwd_close", "split_factor", "ret", "bench_ret", "excess")),
    "outcome_runup": ((), ("run_up",)),
    "ohlc_weekly": (("date",), ("open", "high", "low", "close")),
    "ohlc_monthly": (("date",), ("open", "high", "low", "close")),
    "series_gaps": (("gap_from", "gap_to"), ()),
    "listing_spans": (("first_seen", "last_seen"), ()),
    "latest_bars": (("date",), ("close",)),
    "health_coverage_median": (("date",), ()),
    "facts_resolve": (("period_end", "filed"), ("value",)),
    "filer_universe": (("first_period", "last_period", "first_filed", "last_filed"), ("sic",)),
    "stopped_filers": (("last_period",), ()),
    "latest_per_concept": (("period_end",), ("revenue", "assets", "operating_cash_flow", "capex", "equity", "liabilities", "net_income")),
    "peer_sets": ((), ("revenue", "assets", "sic_depth")),
    "peer_ladder_outcomes": ((), ("sic_depth",)),
    "peer_median_value": ((), ("sic_depth", "n")),
    "deal_multiples": (("filed_date", "pre_end"), ("value_usd", "revenue", "net_income")),
    "dcf_values": (("period_end",), ()),
    "deal_identity": (("filed_date", "pre_end", "last_end", "last_deal_filing"), ("value_usd",)),
    "deal_filers": (("filed_date", "last_filed"), ()),
    "sponsors_rollup": (("oldest_plan_eff",), ("active_sum", "active_max")),
    "sponsors_resolved": ((), ("exact_candidates", "norm_candidates")),
    "trend_matched_plans": (("oldest_plan_eff",), ("active_max",)),
    "mature_targets": (("oldest_plan_eff",), ()),
    "purchase_clusters": (("first", "last"), ("value",)),
    "merge_latest": (("date",), ("close",)),
    "upsert_missing_anti": (("date",), ()),
    "upsert_macro": (("obs_date",), ("value",)),
    "widen_ranges": (("first_seen", "last_seen"), ()),
    "price_fate": (("first_seen", "last_seen", "first_bar", "last_bar"), ()),
    "macro_latest": (("obs_date",), ("value",)),
    "macro_change": (("then_date",), ("value", "then_value", "change")),
    "text_value_extract": ((), ("amount",)),
    "text_section_density": ((), ("at",)),
}
