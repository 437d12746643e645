"""Readers: stored tables and raw feed documents."""
