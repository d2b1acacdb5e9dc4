"""Helpers that shape physical plans: sessions, checkpoints, size checks."""
