"""Registered queries and their oracle SQL (consumed by ``__spark_entry__``)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from vantage.plans import queries as Q
from vantage.plans import sql as S
from vantage.sources.tables import DriverTables


def _bind(fn):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return fn(DriverTables(spark, sf_dir))

    run.__name__ = fn.__name__
    return run


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "q1_high_engagement": _bind(Q.q1_high_engagement),
        "q2_category_independent": _bind(Q.q2_category_independent),
        "q3_hype_dependency": _bind(Q.q3_hype_dependency),
        "q4_follower_velocity": _bind(Q.q4_follower_velocity),
        "q5_hidden_gem_score": _bind(Q.q5_hidden_gem_score),
        "q6_retention_curve": _bind(Q.q6_retention_curve),
        "q7_category_switch_impact": _bind(Q.q7_category_switch_impact),
        "q8_rolling_stats": _bind(Q.q8_rolling_stats),
        "q18_quick_counts": _bind(Q.q18_quick_counts),
        "q14_multi_category_gems": _bind(Q.q14_multi_category_gems),
        "q13_hidden_gems": _bind(Q.q13_hidden_gems),
        "q12_growth_history": _bind(Q.q12_growth_history),
        "q11_top_chat_rate": _bind(Q.q11_top_chat_rate),
        "q10_training_set": _bind(Q.q10_training_set),
        "q9_daily_stats_ddl": _bind(Q.q9_daily_stats_ddl),
        "v8_stats_history": _bind(Q.v8_stats_history),
        "v8_daily_history": _bind(Q.v8_daily_history),
        "q15_discoveries_per_day": _bind(Q.q15_discoveries_per_day),
        "q16_recent_account_age": _bind(Q.q16_recent_account_age),
        "q17_recent_active": _bind(Q.q17_recent_active),
        "q19_snapshot_freshness": _bind(Q.q19_snapshot_freshness),
        "e19_stats_freshness": _bind(Q.e19_stats_freshness),
        "q20_discovery_candidates": _bind(Q.q20_discovery_candidates),
        "q20_discovery_summary": _bind(Q.q20_discovery_summary),
        "q21_bulk_add": _bind(Q.q21_bulk_add),
        "q21_bulk_add_summary": _bind(Q.q21_bulk_add_summary),
        "w1_replay_insert_ignore": _bind(Q.w1_replay_insert_ignore),
        "w3_upsert_stats": _bind(Q.w3_upsert_stats),
        "w7_quarantine": _bind(Q.w7_quarantine),
        "w8_duplicate_snapshot_keys": _bind(Q.w8_duplicate_snapshot_keys),
        "w8_entity_violations": _bind(Q.w8_entity_violations),
        "w9_orphans": _bind(Q.w9_orphans),
        "w17_maintain_categories": _bind(Q.w17_maintain_categories),
        "w18_inactive_entities": _bind(Q.w18_inactive_entities),
        "w16_deactivate_inactive": _bind(Q.w16_deactivate_inactive),
        "w4_create_sessions": _bind(Q.w4_create_sessions),
        "q20_short_discovery": _bind(Q.q20_short_discovery),
        "w10_delete_cascade": _bind(Q.w10_delete_cascade),
        "w10_cascade_keys": _bind(Q.w10_cascade_keys),
        "w11_nulled_keys": _bind(Q.w11_nulled_keys),
        "w11_delete_set_null": _bind(Q.w11_delete_set_null),
        "a19_archive_split": _bind(Q.a19_archive_split),
        "s3_sessionize": _bind(Q.s3_sessionize),
        "s2_dropped_offline": _bind(Q.s2_dropped_offline),
        "s8_orphan_sessions": _bind(Q.s8_orphan_sessions),
        "s4_chat_per_session": _bind(Q.s4_chat_per_session),
        "s5_chat_delta_carry_over": _bind(Q.s5_chat_delta_carry_over),
        "s6_snapshot_ticks": _bind(Q.s6_snapshot_ticks),
        "s15_poll_outcomes": _bind(Q.s15_poll_outcomes),
        "e20_session_rollup": _bind(Q.e20_session_rollup),
        "e21_e26_extended_stats": _bind(Q.e21_e26_extended_stats),
        "m18_candidate_features": _bind(Q.m18_candidate_features),
        "v5_viewer_rank": _bind(Q.v5_viewer_rank),
        "v6_follower_delta": _bind(Q.v6_follower_delta),
        "e28_class_distribution": _bind(Q.e28_class_distribution),
        "e29_null_profile": _bind(Q.e29_null_profile),
        "e30_describe": _bind(Q.e30_describe),
        "m5_scaler_params": _bind(Q.m5_scaler_params),
        "m6_split_counts": _bind(Q.m6_split_counts),
        "m7_class_weight": _bind(Q.m7_class_weight),
        "e31_score_distribution": _bind(Q.e31_score_distribution),
        "e33_precision_recall": _bind(Q.e33_precision_recall),
        "e34_classification_report": _bind(Q.e34_classification_report),
        "e35_roc_auc": _bind(Q.e35_roc_auc),
        "e36_pr_curve": _bind(Q.e36_pr_curve),
        "m15_best_threshold": _bind(Q.m15_best_threshold),
        "m17_train_evaluate": _bind(Q.m17_train_evaluate),
        "m12_feature_importance": _bind(Q.m12_feature_importance),
        "q22_batch_scoring": _bind(Q.q22_batch_scoring),
        "q22_score_checks": _bind(Q.q22_score_checks),
        "m17_report_checks": _bind(Q.m17_report_checks),
        "m12_importance_checks": _bind(Q.m12_importance_checks),
        "s1_s2_stream_sessions": _bind(Q.s1_s2_stream_sessions),
        "s4_stream_chat_per_session": _bind(Q.s4_stream_chat_per_session),
        "s5_stream_carry_over": _bind(Q.s5_stream_carry_over),
        "s6_stream_snapshots": _bind(Q.s6_stream_snapshots),
        "s10_stream_tracked_changes": _bind(Q.s10_stream_tracked_changes),
        "s13_stream_message_tail": _bind(Q.s13_stream_message_tail),
        "s14_stream_counters": _bind(Q.s14_stream_counters),
        "s5_stream_chat_ticks": _bind(Q.s5_stream_chat_ticks),
        "s6_stream_poll_ticks": _bind(Q.s6_stream_poll_ticks),
        "s15_stream_poll_outcomes": _bind(Q.s15_stream_poll_outcomes),
        "a2_active_entities": _bind(Q.a2_active_entities),
        "a3_tracked_entities": _bind(Q.a3_tracked_entities),
        "a6_open_sessions": _bind(Q.a6_open_sessions),
        "a7_latest_open_session": _bind(Q.a7_latest_open_session),
        "a8_snapshot_count": _bind(Q.a8_snapshot_count),
        "e37_table_counts": _bind(Q.e37_table_counts),
        "w2_upsert_entities": _bind(Q.w2_upsert_entities),
        "w13_engagement_rate": _bind(Q.w13_engagement_rate),
        "p15_baseline_tiers": _bind(Q.p15_baseline_tiers),
        "p8_sparse_keys": _bind(Q.p8_sparse_keys),
        "p8_sparse_predicates": _bind(Q.p8_sparse_predicates),
        "w5_close_sessions": _bind(Q.w5_close_sessions),
        "d3_tracked_union": _bind(Q.d3_tracked_union),
        "d4_tracked_difference": _bind(Q.d4_tracked_difference),
        "a4_entity_by_id": _bind(Q.a4_entity_by_id),
        "a5_entity_by_username": _bind(Q.a5_entity_by_username),
        "d2_names_not_found": _bind(Q.d2_names_not_found),
        "p6_declared_names": _bind(Q.p6_declared_names),
        "p18_ratio_bands": _bind(Q.p18_ratio_bands),
        "w6_session_defaults": _bind(Q.w6_session_defaults),
        "s12_six_hour_ticks": _bind(Q.s12_six_hour_ticks),
        "s13_message_tail": _bind(Q.s13_message_tail),
    }


def oracle_sql() -> dict[str, str]:
    return {
        "q1_high_engagement": S.q1_high_engagement(),
        "q2_category_independent": S.q2_category_independent(),
        "q3_hype_dependency": S.q3_hype_dependency(),
        "q4_follower_velocity": S.q4_follower_velocity(),
        "q5_hidden_gem_score": S.q5_hidden_gem_score(),
        "q6_retention_curve": S.q6_retention_curve(),
        "q7_category_switch_impact": S.q7_category_switch_impact(),
        "q8_rolling_stats": S.q8_rolling_stats(),
        "q18_quick_counts": S.q18_quick_counts(),
        "q14_multi_category_gems": S.q14_multi_category_gems(),
        "q13_hidden_gems": S.q13_hidden_gems(),
        "q12_growth_history": S.q12_growth_history(),
        "q11_top_chat_rate": S.q11_top_chat_rate(),
        "q10_training_set": S.q10_training_set(),
        "q9_daily_stats_ddl": S.q9_daily_stats_ddl(),
        "v8_stats_history": S.v8_stats_history(),
        "v8_daily_history": S.v8_daily_history(),
        "q15_discoveries_per_day": S.q15_discoveries_per_day(),
        "q16_recent_account_age": S.q16_recent_account_age(),
        "q17_recent_active": S.q17_recent_active(),
        "q19_snapshot_freshness": S.q19_snapshot_freshness(),
        "e19_stats_freshness": S.e19_stats_freshness(),
        "q20_discovery_candidates": S.q20_discovery_candidates(),
        "q20_discovery_summary": S.q20_discovery_summary(),
        "q21_bulk_add": S.q21_bulk_add(),
        "q21_bulk_add_summary": S.q21_bulk_add_summary(),
        "w1_replay_insert_ignore": S.w1_replay_insert_ignore(),
        "w3_upsert_stats": S.w3_upsert_stats(),
        "w7_quarantine": S.w7_quarantine(),
        "w8_duplicate_snapshot_keys": S.w8_duplicate_snapshot_keys(),
        "w8_entity_violations": S.w8_entity_violations(),
        "w9_orphans": S.w9_orphans(),
        "w17_maintain_categories": S.w17_maintain_categories(),
        "w18_inactive_entities": S.w18_inactive_entities(),
        "w16_deactivate_inactive": S.w16_deactivate_inactive(),
        "w4_create_sessions": S.w4_create_sessions(),
        "q20_short_discovery": S.q20_short_discovery(),
        "m12_importance_checks": S.m12_importance_checks(),
        "m17_report_checks": S.m17_report_checks(),
        "q22_score_checks": S.q22_score_checks(),
        "w10_delete_cascade": S.w10_delete_cascade(),
        "w10_cascade_keys": S.w10_cascade_keys(),
        "w11_nulled_keys": S.w11_nulled_keys(),
        "w11_delete_set_null": S.w11_delete_set_null(),
        "a19_archive_split": S.a19_archive_split(),
        "s3_sessionize": S.s3_sessionize(),
        "s2_dropped_offline": S.s2_dropped_offline(),
        "s8_orphan_sessions": S.s8_orphan_sessions(),
        "s4_chat_per_session": S.s4_chat_per_session(),
        "s5_chat_delta_carry_over": S.s5_chat_delta_carry_over(),
        "s6_snapshot_ticks": S.s6_snapshot_ticks(),
        "s15_poll_outcomes": S.s15_poll_outcomes(),
        "e20_session_rollup": S.e20_session_rollup(),
        "e21_e26_extended_stats": S.e21_e26_extended_stats(),
        "m18_candidate_features": S.m18_candidate_features(),
        "v5_viewer_rank": S.v5_viewer_rank(),
        "v6_follower_delta": S.v6_follower_delta(),
        "e28_class_distribution": S.e28_class_distribution(),
        "e29_null_profile": S.e29_null_profile(),
        "e30_describe": S.e30_describe(),
        "m5_scaler_params": S.m5_scaler_params(),
        "m6_split_counts": S.m6_split_counts(),
        "m7_class_weight": S.m7_class_weight(),
        "e31_score_distribution": S.e31_score_distribution(),
        "e33_precision_recall": S.e33_precision_recall(),
        "e34_classification_report": S.e34_classification_report(),
        "e35_roc_auc": S.e35_roc_auc(),
        "e36_pr_curve": S.e36_pr_curve(),
        "m15_best_threshold": S.m15_best_threshold(),
        "s1_s2_stream_sessions": S.s1_s2_stream_sessions(),
        "s4_stream_chat_per_session": S.s4_stream_chat_per_session(),
        "s5_stream_carry_over": S.s5_stream_carry_over(),
        "s6_stream_snapshots": S.s6_stream_snapshots(),
        "s10_stream_tracked_changes": S.s10_stream_tracked_changes(),
        "s13_stream_message_tail": S.s13_stream_message_tail(),
        "s14_stream_counters": S.s14_stream_counters(),
        "s5_stream_chat_ticks": S.s5_stream_chat_ticks(),
        "s6_stream_poll_ticks": S.s6_stream_poll_ticks(),
        "s15_stream_poll_outcomes": S.s15_stream_poll_outcomes(),
        "a2_active_entities": S.a2_active_entities(),
        "a3_tracked_entities": S.a3_tracked_entities(),
        "a6_open_sessions": S.a6_open_sessions(),
        "a7_latest_open_session": S.a7_latest_open_session(),
        "a8_snapshot_count": S.a8_snapshot_count(),
        "e37_table_counts": S.e37_table_counts(),
        "w2_upsert_entities": S.w2_upsert_entities(),
        "w13_engagement_rate": S.w13_engagement_rate(),
        "p15_baseline_tiers": S.p15_baseline_tiers(),
        "p8_sparse_keys": S.p8_sparse_keys(),
        "p8_sparse_predicates": S.p8_sparse_predicates(),
        "w5_close_sessions": S.w5_close_sessions(),
        "d3_tracked_union": S.d3_tracked_union(),
        "d4_tracked_difference": S.d4_tracked_difference(),
        "a4_entity_by_id": S.a4_entity_by_id(),
        "a5_entity_by_username": S.a5_entity_by_username(),
        "d2_names_not_found": S.d2_names_not_found(),
        "p6_declared_names": S.p6_declared_names(),
        "p18_ratio_bands": S.p18_ratio_bands(),
        "w6_session_defaults": S.w6_session_defaults(),
        "s12_six_hour_ticks": S.s12_six_hour_ticks(),
        "s13_message_tail": S.s13_message_tail(),
    }
