"""Operators of a training-data pipeline over a table of documents (doc_id, text, lang, source, n_chars)."""
