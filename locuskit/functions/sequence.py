"""Nucleotide strings."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def revcomp(seq: Column) -> Column:
    """Reverse complement; case is kept and other letters stay as they are."""
    return F.reverse(F.translate(seq, "ACGTacgt", "TGCAtgca"))


def single_base(*alleles: Column) -> Column:
    """Every allele is one byte long and no deletion mark."""
    tests = [(F.octet_length(a) == 1) & (a != "-") for a in alleles]
    out = tests[0]
    for test in tests[1:]:
        out = out & test
    return out
