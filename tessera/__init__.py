"""Tessera: a DataFrame-first engine for document, segment and record analytics."""
