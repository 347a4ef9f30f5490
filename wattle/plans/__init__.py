"""Compositions of operators: the consumption, load-shape and data-quality
workflows, and the registered query catalog used by the driver and bench."""
