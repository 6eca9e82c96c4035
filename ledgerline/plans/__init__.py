"""Ready-made runs: the content migration, the change gate, and one query per operator."""
