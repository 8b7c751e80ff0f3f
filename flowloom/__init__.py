"""flowloom: declarative data flows and their analytics as Spark DataFrames."""
