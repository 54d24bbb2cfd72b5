"""Column expressions and column-name rules; nothing here runs a job."""
