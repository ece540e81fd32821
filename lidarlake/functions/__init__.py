"""Column expressions: poses, predicates, scores and vectors."""
