"""Streaming of the genotype engine."""
