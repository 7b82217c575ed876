"""Operators over DataFrames: corpus, index, retrieval, graph, overlay, memory, agents."""
