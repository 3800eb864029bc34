"""Structured Streaming forms of the online operators (ST1-ST8)."""

from .online import (circuit_breaker_stream, continuous_ingest, daily_trend_stream, dedup_within_ttl,  # noqa: F401
                     latest_values, rate_limit_micro_batches, rate_limit_stream, replay, rolling_metric_stats,
                     run_stream, stream_threshold_alerts, ttl_cache_stream, upsert_latest)
