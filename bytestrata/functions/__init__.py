"""Part of bytestrata."""
