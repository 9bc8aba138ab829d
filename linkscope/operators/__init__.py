"""Graph, text and retrieval operators: DataFrames in, one DataFrame out."""
