"""Independent DuckDB SQL for every registered analysis (the correctness oracle)."""

from __future__ import annotations

from clickpath.oracle.fixtures import with_fixture
from clickpath.oracle.queries import Q


def oracle_statements(registry: dict) -> dict[str, str]:
    """Full DuckDB statement per registry key that has an oracle body."""
    out = {}
    for key, (fixture, _fn) in registry.items():
        base = key
        if base not in Q and key[-2:] in ("_a", "_b", "_c", "_d"):
            base = key[:-2]
        if base in Q:
            out[key] = with_fixture(fixture, Q[base])
    return out
