"""Operators over records: queries, the link graph, schemas, edits and output."""
