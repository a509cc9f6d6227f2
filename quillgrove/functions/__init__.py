"""Part of the document structure engine."""
