"""Operators that prepare text corpora for language-model training.

Nothing else in the library imports this subpackage; ``queries`` registers its
operators and ``corpus_pipeline`` at the repository top chains four of them.
"""
