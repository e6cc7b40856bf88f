"""Column expressions: panel windows, statistics, codes and dates."""
