"""Spark toolkit for regulatory-genomics tables: intervals, variants, scores."""
