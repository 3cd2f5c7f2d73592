"""Operators over live tapes."""
