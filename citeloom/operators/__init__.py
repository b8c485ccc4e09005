"""Relational, linkage, graph, vector, text and evaluation operators."""
