"""Sources and sinks: files, ground truth, SQLite, workbooks, and the backends that read pages."""
