"""ETL stages and job-catalog analytics as plain Spark DataFrame functions."""
