"""Whole comparisons: rearrangements of two genomes, their variants, and the files that tell them."""
