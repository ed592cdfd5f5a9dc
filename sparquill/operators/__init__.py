"""Retrieval and evaluation operators; queries come as tables, so each operator ranks for many queries at once."""
