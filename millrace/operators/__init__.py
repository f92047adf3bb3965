"""Operators: functions from DataFrame to DataFrame."""

from . import combine, filters
from .combine import concatenate, join_rows
from .dedup import dedup_exact, dedup_hash
from .filters import (
    filter_expr,
    filter_rows,
    language_filter,
    length_filter,
    min_threshold,
    regex_partition,
    remove_empty,
    search_text,
)
from .neardup import (
    dedup_fuzzy,
    minhash,
    minhash_deduplicate,
    minhash_pairs,
    near_dup_pairs,
    simhash,
    simhash_deduplicate,
)
from .ordering import (
    batches,
    head,
    preview,
    sample_rows,
    shuffle,
    sort_rows,
    split_dataset,
    tag_split,
    with_position,
)
from .profile import (
    blank_counts,
    classify_dataset,
    column_statistics,
    dataset_summary,
    dedup_report,
    infer_schema,
    vote_types,
)
from .projection import append_suffix, drop_columns, map_expr, rename_columns, select_columns, split_col
from .text import (
    chunk_text,
    detect_lang,
    embed_text,
    hash_key,
    lowercase,
    normalize,
    regex_replace,
    sentiment,
    strip_html,
    strip_tags,
    strip_whitespace,
    tokenize,
    unicode_normalize,
    uppercase,
)

__all__ = [name for name in dir() if not name.startswith("_")]
