"""DataFrame -> DataFrame operators: predicates, joins, vector search, aggregates, windows,
ordering and table changes."""

from .aggregates import (cache_stats, database_stats, embedding_model_usage, error_stats,  # noqa: F401
                         generation_model_usage, generation_trends, health_rollup, latest_metric_values,
                         log_performance_stats, metric_window_stats, performance_summary, success_rate,
                         summarize_annotations, table_counts, table_health, trends_summary)
from .changes import (clear_by_type, delete_by_ids, distinct_values, expire_ttl, insert_unique,  # noqa: F401
                      retain_since)
from .joins import (annotate_categories, enrich_hits, images_with_annotations, keep_existing_files,  # noqa: F401
                    knn_join, missing_names, registry_with_latest, unregistered_names, zip_by_position)
from .ordering import head_n, page_info, paginate, paginate_after, recent, top_n  # noqa: F401
from .predicates import (classify_thresholds, filter_by_date_range, filter_by_tags, filter_recent,  # noqa: F401
                         filter_status, log_level_filter, lookup, path_safety_filter, threshold_alerts,
                         validate_requests)
from .vectors import (batch_topk, check_vectors, cosine_topk, l2_topk, project_vectors, retrieve,  # noqa: F401
                      zero_safe_cosine_topk)
from .windows import (counter_rate, evict_oldest, failure_streaks, last_n_per_key, lru_evict,  # noqa: F401
                      prefix_agg, rate_limit, running_gauge)
