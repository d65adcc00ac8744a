"""Relational operators of retrieval: chunks, postings, vectors, fusion, evaluation, index maintenance."""
