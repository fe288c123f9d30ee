"""Operators of a training-data pipeline (WARC, BPE, nearest neighbours,
dedup, language id, mixing, token files, HTML text).

Nothing outside this package imports it; ``corpusloom.llm.queries`` lists its
registered queries.
"""
