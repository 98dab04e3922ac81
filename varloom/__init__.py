"""Genotype matrices as Spark tables."""
