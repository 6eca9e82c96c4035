"""DataFrame operators, grouped by the work they do."""
