"""Identifiers made from or cut out of text."""

from pyspark.sql import Column
from pyspark.sql import functions as F

# Name patterns of the input files
MOTIF_NAME = r"\.([^\.]+)$"


def motif_name(alt_id: Column) -> Column:
    """Last dot-separated piece, or an empty string if there is no dot."""
    return F.regexp_extract(alt_id, MOTIF_NAME, 1)


def region_id(chrom: Column, start: Column, last: Column) -> Column:
    """``chrom:start-end`` with a half-open end from an inclusive last position."""
    return F.concat(chrom, F.lit(":"), start.cast("string"), F.lit("-"), (last + 1).cast("string"))


def text_or_null(text: Column, pattern: str, group: int = 1) -> Column:
    """``regexp_extract`` that gives NULL, not an empty string, without a match."""
    return F.nullif(F.regexp_extract(text, pattern, group), F.lit(""))
