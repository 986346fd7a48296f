"""Sources and sinks: driver tables, corpus files, the parquet store."""
