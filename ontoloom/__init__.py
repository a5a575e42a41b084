"""Ontoloom: ontology graphs, annotation corpora and their statistics on Spark."""
