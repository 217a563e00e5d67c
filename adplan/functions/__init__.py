"""Column-level building blocks: canonical schema, numbers, text, dates, labels."""
