"""A PySpark-native engine for comparing genomes from their pairwise alignments."""
