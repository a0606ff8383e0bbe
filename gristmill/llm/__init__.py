"""Training-data operators: chat roles, dedup, sharding, mixing, search, scoring, scans."""
