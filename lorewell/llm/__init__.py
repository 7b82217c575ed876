"""Training-data operators: filters, deduplication, packing, tokens.

Nothing else in the package imports this subpackage; ``__spark_entry__`` adds
its queries when it can be imported.
"""
