"""gridloom: a tabular analytics toolkit written on Spark's DataFrame API."""
