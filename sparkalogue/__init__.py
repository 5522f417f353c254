"""Catalogue, similarity and history analytics as Spark DataFrame operators."""
