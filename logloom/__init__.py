"""logloom: conversation-log and corpus analytics expressed as Spark DataFrames."""
