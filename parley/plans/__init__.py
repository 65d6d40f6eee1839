"""End-to-end reports composed of the operators."""
