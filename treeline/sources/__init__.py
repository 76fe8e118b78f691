"""Where files, configurations, baselines and caches come from."""
