"""Operators over annotated corpora: DataFrame in, DataFrame out."""
