"""Spark jobs over software-failure evidence: graphs, search, traces, reports and their upkeep."""
