"""Talata: text and tokenization analytics on Spark DataFrames."""
