"""Registered queries; importing this package registers them."""

from palimpsest.plans import aggregates, evaluation, graphs, lifecycles, more, operations, ranking, retrievals, scans, searches, text, world, writing  # noqa: F401
