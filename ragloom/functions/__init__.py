"""Column -> Column helpers: text cleaning and naming (F1-F15), prompt augmentation (F7),
encoders (U1) and the metric / health-check registries (U2, U3)."""

from .encoders import HashingEncoder, PandasModelEncoder, embed_text  # noqa: F401
from .prompt import augment_prompt  # noqa: F401
from .registry import CheckRegistry, default_registry, effective_registry, register_metric  # noqa: F401
from .text import (cache_key, client_id, coco_description, is_allowed_image_extension, json_text,  # noqa: F401
                   metadata_text_coco, metadata_text_csv, metadata_text_db, normalize_text, output_name,
                   prometheus_labels, sanitize_filename, search_document, split_tags, split_upload_tags,
                   storage_name)
