"""The evaluation as one plan, and the registry of checked queries."""
