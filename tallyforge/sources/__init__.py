"""Statement files as DataFrames, and DataFrames as export files."""
