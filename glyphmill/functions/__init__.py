"""Column expressions: text, scripts, quality gates, boxes."""
