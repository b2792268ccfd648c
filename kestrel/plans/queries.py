"""Registration of every named query (see README for the operator map)."""

from __future__ import annotations

from kestrel.operators.catalog import catalog_listing
from kestrel.plans import business as B
from kestrel.plans import kpis as K
from kestrel.plans import marts
from kestrel.plans.mart_refresh import marts_incremental
from kestrel.plans.registry import commerce_query, register

# ---- marts -----------------------------------------------------------------
commerce_query("revenue_by_month", marts.revenue_by_month)
commerce_query("revenue_by_category", marts.revenue_by_category)
commerce_query("state_performance", marts.state_performance)

register("marts_incremental")(marts_incremental)

# ---- KPIs ------------------------------------------------------------------
commerce_query("kpi_row", K.kpi_row)
commerce_query("on_time_rate", K.on_time_rate)
commerce_query("payment_mix", K.payment_mix)
commerce_query("payment_top_share", K.payment_top_share)
commerce_query("score_histogram", K.score_histogram)
commerce_query("score_shares", K.score_shares)
commerce_query("top_state_shares", K.top_state_shares)
commerce_query("state_share_if_top10", lambda c: K.state_share_if_top(c, "NATION_3", 10))
commerce_query("last_full_month_mom", K.last_full_month)
commerce_query("monthly_series", K.monthly_series)
commerce_query("peak_month", K.peak_month)
commerce_query("top_categories", K.top_categories)
commerce_query("top_states", K.top_states)

# ---- business questions ----------------------------------------------------
commerce_query("total_orders", B.total_orders)
commerce_query("top5_categories", B.top_categories_raw)
commerce_query("late_by_state", B.late_by_state)
commerce_query("payment_totals_with_null", B.payment_totals)
commerce_query("sellers_five_star", B.sellers_five_star)
commerce_query("top5_states_revenue", B.top_states_revenue)

# ---- golden-set data questions ---------------------------------------------
commerce_query("table_counts", B.table_counts)
commerce_query("catalog_overview", B.catalog_overview)
register("catalog_listing")(catalog_listing)
commerce_query("most_common_payment", B.most_common_payment)
commerce_query("state_most_orders", B.state_most_orders)
commerce_query("max_score", B.max_score)
commerce_query("orders_in_year", B.orders_in_year)
commerce_query("latest_year", B.latest_year)
commerce_query("seller_state_revenue", B.seller_state_revenue)
commerce_query("avg_score_of_orders_with_category", B.avg_score_with_category)
commerce_query("state_most_credit_card", B.state_most_card_payments)
commerce_query("delivery_stats", B.delivery_stats)

# ---- ETL rules over the driver tables --------------------------------------
from kestrel.plans import etl as E  # noqa: E402
from kestrel.plans import quality as Q  # noqa: E402

register("clean_customers")(E.clean_customers_driver)
register("clean_sellers")(E.clean_sellers_driver)
register("clean_orders")(E.clean_orders_driver)
register("clean_items")(E.clean_items_driver)
register("clean_payments")(E.clean_payments_driver)
register("clean_reviews")(E.clean_reviews_driver)
register("impute_dimensions")(E.impute_dimensions_driver)
register("brand_rollup")(E.brand_rollup_driver)
register("etl_full")(E.etl_full)
register("geolocation")(E.geolocation_driver)
register("fk_filter")(E.fk_filter_summary)

# ---- data quality ----------------------------------------------------------
register("fk_report")(Q.fk_report_driver)
register("profile_tables")(Q.profile_tables)
register("pk_checks")(Q.pk_checks)
register("length_checks")(Q.length_checks)
register("load_validate")(Q.load_validate)

# ---- log analytics -----------------------------------------------------------
from kestrel.plans import logs as LG  # noqa: E402

register("session_last_n")(LG.session_last_n)
register("session_seq")(LG.session_next_seq)
register("session_assign_seq")(LG.session_assign_seq)
register("session_appended_seq")(LG.session_appended_seq)
register("session_prompt")(LG.session_prompts)
register("session_forget")(LG.session_forget)
register("cache_hits")(LG.cache_hits)
register("recent_keys")(LG.recent_keys)
register("question_keys")(LG.question_keys)
register("latest_per_key")(LG.latest_per_user)
register("latest_merged")(LG.latest_merged)
register("latency_rolling")(LG.latency_rolling)
register("latency_percentiles")(LG.latency_overall)
register("latency_percentiles_by_type")(LG.latency_by_type)
register("request_metrics")(LG.request_metrics)
register("token_usage")(LG.token_usage_by_type)
register("rate_limit_breaches")(LG.rate_limit_breaches)
register("redact_users")(LG.redact_users)
register("format_orders")(LG.format_orders)

# ---- guarded SQL, lookups, shape hints ---------------------------------------
from kestrel.plans import surface as SF  # noqa: E402
from kestrel.streaming import streams as ST  # noqa: E402

register("guarded_adhoc")(SF.guarded_adhoc)
register("guarded_functions")(SF.guarded_functions)
register("state_lookup")(SF.state_lookup)
register("revenue_usd")(SF.revenue_usd)
register("revenue_usd_asof")(SF.revenue_usd_asof)
register("result_shape")(SF.result_shape)

# ---- service checks ------------------------------------------------------------
from kestrel.plans import service as SV  # noqa: E402

register("sql_audit")(SV.sql_audit)
register("sql_error_triage")(SV.sql_error_triage)
register("eval_scores")(SV.eval_scores)
register("eval_summary")(SV.eval_summary)
register("eval_report")(SV.eval_report)
register("trace_shapes")(SV.trace_shapes)
register("last_sql_steps")(SV.last_sql_steps)
register("request_log_json")(SV.request_log_json)
register("exact_amounts")(SV.exact_amounts)
register("normalized_answers")(SV.normalized_answers)

# ---- streaming twins -----------------------------------------------------------
register("stream_rate_limit")(ST.stream_rate_limit)
register("stream_metrics")(ST.stream_metrics)
register("stream_session")(ST.stream_session)
register("stream_dedupe")(ST.stream_dedupe)
register("stream_questions")(ST.stream_questions)
register("stream_latency_quantiles")(ST.stream_latency_quantiles)
register("stream_sliding")(ST.stream_sliding)
register("stream_sightings")(ST.stream_sightings)
