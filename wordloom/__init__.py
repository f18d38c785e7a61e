"""wordloom: a Spark-first engine for distributional semantics.

Raw text becomes tokens, vocabularies, window co-occurrences, association
scores and word vectors; each step is a DataFrame operator of its own.
"""
