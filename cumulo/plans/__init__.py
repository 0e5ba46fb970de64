"""Reports over result rows: summaries, statistics, gates."""
