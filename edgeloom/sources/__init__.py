"""Readers and writers for edge files, reports, catalogues, matrices and embeddings."""
