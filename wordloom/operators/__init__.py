"""DataFrame operators of the embedding pipeline."""
