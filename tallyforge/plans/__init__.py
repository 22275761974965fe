"""Views of the data model, and the catalogue of queries."""
