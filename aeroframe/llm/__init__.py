"""Training-data operators: thirteen Spark jobs over documents, embeddings and conversations.

Nothing outside this subpackage imports it.
"""
