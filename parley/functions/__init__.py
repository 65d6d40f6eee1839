"""Column builders: one expression in, one expression out, no shuffle."""
