"""Operators of the genotype engine."""
