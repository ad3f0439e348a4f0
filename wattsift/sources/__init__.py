"""Reading and writing: readings files, staged tables, run history, report tables."""
