"""Column and row functions: names, dates, scaling, vectors, attention, metrics."""
