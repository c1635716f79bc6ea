"""Registered queries of the library's own operators."""

from findlake.queries import assets, gaps, graph, identity, lines, matching, measure, rules, supply  # noqa: F401
