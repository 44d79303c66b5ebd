"""Part of fractura."""
