from stepfall.sources.buckets import read_buckets, write_buckets
from stepfall.sources.rejects import read_with_rejects
from stepfall.sources.session import local_session, tune
from stepfall.sources.sinks import replace_extract, scratch_folder, settle_extract, write_extract
from stepfall.sources.star import from_star
from stepfall.sources.tables import SCHEMAS, FunnelTables, TableSet, empty_tables, read_catalog, read_files

__all__ = [
    "SCHEMAS",
    "FunnelTables",
    "TableSet",
    "empty_tables",
    "from_star",
    "local_session",
    "read_buckets",
    "read_catalog",
    "read_files",
    "read_with_rejects",
    "replace_extract",
    "scratch_folder",
    "settle_extract",
    "tune",
    "write_buckets",
    "write_extract",
]
