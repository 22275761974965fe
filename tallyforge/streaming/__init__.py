"""Transactions as a stream."""
