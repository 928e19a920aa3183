"""Training-data operators: scans, scores, de-duplication, decontamination and mixing.

Nothing outside this subpackage imports it; ``queries`` holds the registered
queries and their SQL.
"""
