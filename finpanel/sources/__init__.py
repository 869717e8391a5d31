"""Readers and writers: bar folders, interval files, JSON payloads, manifests, wide price files."""

from finpanel.sources.files import (  # noqa: F401
    BARS,
    csv_panel,
    fx_series,
    json_records,
    listed_files,
    manifest_audit,
    membership_intervals,
    observations,
    parse_file_name,
    read_stage,
    rename_columns,
    wide_prices,
    write_bucketed,
    write_csv,
    write_stage,
)
