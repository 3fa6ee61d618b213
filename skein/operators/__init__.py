"""Relational building blocks: filters, matching, ranking, expansion, excerpts, language detection."""
