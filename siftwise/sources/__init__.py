"""Where documents, predicates, points, caches and experiences come from, and where results go."""
