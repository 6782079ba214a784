"""Sources and sinks."""

from .readers import SourceSpec, read_source, source_schema
from .sheets import MappingSheets, load_mapping, load_suite, read_sheet, suite_header
from .sinks import append_history, export_samples, read_table, RUN_DETAIL, RUN_SUMMARY, HISTORY, write_run_table

__all__ = [
    "HISTORY", "MappingSheets", "RUN_DETAIL", "RUN_SUMMARY", "SourceSpec", "append_history", "export_samples", "load_mapping", "load_suite",
    "read_sheet", "read_source", "read_table", "source_schema", "suite_header", "write_run_table",
]
