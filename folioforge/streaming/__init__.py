"""Streams of documents and edits: an extension; documents are otherwise batches."""
