"""Operators on transactions: reads, spending, trends, merchants, duplicates and writes."""
