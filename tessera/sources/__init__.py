"""Readers, writers, the dataset catalog and ingestion jobs."""

from tessera.sources.files import (  # noqa: F401
    NA_STRINGS,
    load_table,
    read_csv,
    read_json,
    table,
    write_csv,
    write_json,
)
