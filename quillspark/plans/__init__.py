"""Named analytical plans built from the operators."""
