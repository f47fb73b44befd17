"""Readers and writers."""

from nearkin.sources.readers import (
    cached_dir, get_or_build, scan_csv, scan_dir, scan_many, scan_prefix, scan_sampled,
)
from nearkin.sources.writers import (
    export, preview, iterate_chunks, write_csv, write_labelled_csv, write_split,
)

__all__ = [
    "cached_dir", "export", "get_or_build", "iterate_chunks", "preview", "scan_csv", "scan_dir", "scan_many",
    "scan_prefix", "scan_sampled", "write_csv", "write_labelled_csv", "write_split",
]
