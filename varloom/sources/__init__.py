"""Sources of the genotype engine."""
