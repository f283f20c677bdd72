"""An analytics engine for evidence-linked facts on Spark DataFrames."""
