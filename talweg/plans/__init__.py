"""Registered terrain queries, and their DuckDB SQL."""

from talweg.plans.queries import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
