"""Structured tables and chart data from free-text report answers, on Spark."""

from .functions.rules import contains_any, default_if_blank, exact_map, first_match, keyword_category
from .functions.text import (
    cut_tail,
    extract_answer,
    file_name,
    file_stem,
    labelled_field,
    pretty_label,
    slugify,
    split_keep,
    split_list,
    strip,
)
from .operators.charts import bar, capped, hist, hist_nested, marginal, scatter
from .operators.inference import (
    Rejected,
    RateLimited,
    answered,
    append,
    assemble_pages,
    build_requests,
    failed,
    infer,
)
from .operators.lookup import keyword_lookup, lookup
from .operators.questions import categorise, categorise_all, category
from .plans.metrics import RunCounts, write_run
from .plans.structure import coverage, flatten_categories, sorted_columns, structure, unmatched_phrases, with_answers
from .session import scratch_folder, tune
from .sources.listing import list_reports
from .sources.readers import load_table, pending, read_reports, read_responses
from .sources.writers import append_responses, save_table, write_structured
from .streaming.inference import Pace, committed, infer_restartable, stage_requests
from .streaming.intake import latest_counts, read_batches, stream_counts, stream_reports, stream_structured
from .streaming.snapshots import read_latest, read_snapshot, snapshots, stream_latest, stream_snapshots
