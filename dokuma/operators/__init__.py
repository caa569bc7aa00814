"""Operators: joins, rankings, graph steps, evaluation and extraction as DataFrame programs."""
