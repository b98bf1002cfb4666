"""SELECT to DataFrame, and the catalogue of queries."""
