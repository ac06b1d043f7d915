"""Column expressions: alleles, contigs, ploidy, statistics, genotypes."""
