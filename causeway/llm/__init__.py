"""Training-data operators: ten corpus-scale jobs over documents, pages and embeddings.

Nothing else in the library imports this package.
"""
