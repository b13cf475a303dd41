"""DataFrame-level operators, one module per subject."""
