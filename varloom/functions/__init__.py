"""Functions of the genotype engine."""
