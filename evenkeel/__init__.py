"""Data reconciliation and data quality on Spark DataFrames."""

from .operators.checksum import checksum_ranges, checksum_rows, checksum_tree, compare_trees
from .operators.fingerprint import (
    dup_columns, dup_value_lists, dup_values, empty_counts, fingerprint, hash_diff, null_compare, null_counts,
    null_rows, row_hash, set_difference, symmetric_diff,
)
from .operators.flatten import explode_aligned, explode_array, explode_map, flatten, flatten_structs
from .operators.history import (
    changed_since, date_chain, incremental_check, rank_check, ranked, scd2_check, scd2_current_faults, sequence,
)
from .operators.keys import distinct_keys, dup_keys, key_counts, key_shape
from .operators.mapping import (
    MappingRow, apply_mapping, join_chain, like_select, mapping_rows, target_select, with_schemas,
)
from .operators.ordinal import occurrence, positions
from .operators.profile import profile, profile_distinct, profile_numeric, profile_pattern, profile_string, profile_topk
from .operators.sketches import describe, merge_states, profile_drift, profile_state
from .operators.quality import (
    Rule, distinct_set_values, load_rules, quality_samples, rules_failed_first, rules_of, run_quality, suite_roll_up,
)
from .operators.reconcile import (
    Pair, column_details, column_summary, common_rows, counts, matched_rows, mismatched_rows, only_source,
    only_target, reconcile, sample_keys,
)
from .operators.rules import (
    KpiRule, Reference, agg_compare, balance_check, kpi_rules, orphan_keys, ref_integrity, required_values,
)
from .operators.schema_compare import combo_allowed, declared_schema, schema_compare, schema_rows, schema_verdict
from .plans.adhoc import adhoc_bulk, adhoc_sql
from .plans.incremental import incremental_state, marks
from .plans.layers import LayerHop, data_check, layer_report
from .plans.report import ContentReport, content_report
from .plans.results import (
    failed_first, outcome_by_type, outcome_counts, runtime_buckets, runtime_members, suite_totals, trend,
)
from .plans.suite import Case, cases_from_rows, run_suite, suite_details
from .plans.verdicts import test_content, test_count, test_duplicate, test_fingerprint, test_null, test_schema
from .plans.workbook import mapped_rows, workbook_case
from .sources.readers import SourceSpec, manual_query, read_source, source_schema
from .sources.sheets import workbook_sources

__all__ = [name for name in dir() if not name.startswith("_")]
