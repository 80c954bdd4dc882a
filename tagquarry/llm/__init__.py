"""Operations of a training-data pipeline over documents, pages and embeddings.

Each module holds one operator with its own general interface and the thin
query that applies it to its whole table; ``registry`` names the queries.
"""
