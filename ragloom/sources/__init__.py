"""Readers (S1-S8) and writers (K1-K5)."""

from .readers import (flatten_photo_search, list_files, load_vector_bundle, read_annotations_json,  # noqa: F401
                      read_coco_instances, read_jdbc_table, read_metadata_csv, read_structured_logs)
from .sinks import (export_prometheus, list_snapshots, restore_snapshot, snapshot_tables,  # noqa: F401
                    write_annotations_json, write_bucketed_table, write_metadata_csv, write_report, write_table)
