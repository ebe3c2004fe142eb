"""Row-local operators on unbounded frames."""
