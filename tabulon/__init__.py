"""Tabulon: score synthetic tables against real ones, and prepare tables, as Spark jobs."""
