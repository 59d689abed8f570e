"""Part of the foliospark engine."""
