"""Plans of the genotype engine."""
