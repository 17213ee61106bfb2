"""Table schemas, scans, snapshot writes and the run-log source."""
