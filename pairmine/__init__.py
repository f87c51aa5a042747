"""Preference-pair mining over Spark tables of sampled completions."""
