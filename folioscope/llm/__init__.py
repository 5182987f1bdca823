"""Operators for training-data pipelines over very large corpora.

Nothing outside this subpackage imports it; remove the folder and the rest of
the library keeps working.
"""
