"""Analyses put together from operators, with stored tables between their stages."""
