"""Operators for preparing training corpora.

Nothing outside this folder imports it; ``queries.py`` lists what the entry
module registers when the folder is present.
"""
