"""An analytics engine for time-coded text and cohort statistics on Spark DataFrames."""
