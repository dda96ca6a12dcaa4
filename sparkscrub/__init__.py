"""Cleaning, profiling and conversion of tables of any size, on Spark DataFrames."""

from sparkscrub.functions.columns import ROW_INDEX
from sparkscrub.operators.cleaned import clean, count_changes, first_rejects, rejects
from sparkscrub.operators.contacts import contact_cleaner
from sparkscrub.operators.convert import preview_strings, type_converter
from sparkscrub.operators.dates import date_cleaner
from sparkscrub.operators.dedupe import (
    duplicate_groups, duplicate_rows, duplicate_summary, first_duplicate_rows, remove_duplicates,
)
from sparkscrub.operators.emails import email_cleaner
from sparkscrub.operators.names import name_cleaner
from sparkscrub.operators.null_profile import analyze_nulls, columns_by_missing, dataset_nulls
from sparkscrub.operators.nulls import fill_cleaner, fill_nulls, null_report
from sparkscrub.operators.ordered_fill import backward_fill, forward_fill
from sparkscrub.operators.preview import preview, search_rows, sort_rows
from sparkscrub.operators.quality import Profile, profile_dataset, quality_score
from sparkscrub.operators.strings import (
    all_text, clean_all_strings, empty_to_null_cleaner, replace_empty_with_null, string_cleaner,
)
from sparkscrub.operators.tables import schemas_match, select_table, tables_overview, union_tables
from sparkscrub.operators.type_profile import detect_column_types
from sparkscrub.plans.auto_clean import AutoClean, auto_clean, quick_fix
from sparkscrub.plans.recipe import Recipe, Step, audit_summary
from sparkscrub.plans.workbook import Workbook
from sparkscrub.session import build_session, release
from sparkscrub.sources.delimited import read_delimited
from sparkscrub.sources.readers import file_info, format_of, read_parquet, read_table, read_table_set
from sparkscrub.sources.sqldump import read_sql_dump
from sparkscrub.sinks.writers import write_csv, write_grid, write_json, write_parquet, write_table_set
