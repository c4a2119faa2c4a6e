"""Reading tables from files and writing results back."""

from tablescope.sources.export import write_csv, write_parquet, write_report
from tablescope.sources.loader import load, load_file, prepare_loaded, read_csv

__all__ = ["load", "load_file", "prepare_loaded", "read_csv", "write_csv", "write_parquet", "write_report"]
