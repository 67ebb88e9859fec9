"""Training-data operators: near-dedup, decontamination, tokenisation, scoring.

Nothing outside this subpackage imports it.
"""
