"""Relational operators: matching joins, evaluation aggregates, ranks and curves."""
