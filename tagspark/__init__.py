"""Tag, classify and evaluate large tables of text records with Spark."""
