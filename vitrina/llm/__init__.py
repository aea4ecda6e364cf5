"""Operators for preparing large text corpora.

One module per operator; `queries.py` registers each over the whole `documents` table.
"""
