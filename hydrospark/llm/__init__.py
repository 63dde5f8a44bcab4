"""Training-data operators over documents, pages, conversations and vectors.

Nothing outside this subpackage imports it; ``registered`` holds its queries.
"""
