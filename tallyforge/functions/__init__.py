"""Column functions on text, dates and amounts."""
