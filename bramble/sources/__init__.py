"""Readers and writers of graphs, names, rankings, queries and results."""
