"""Operators for preparing text corpora for language-model training.

Nothing else in the package imports this subpackage; ``__spark_entry__`` adds
its queries only when it is present.
"""
