"""Imports every query module."""

from catalog import q_cluster, q_compare, q_flow, q_io, q_micro, q_scores, q_state  # noqa: F401
