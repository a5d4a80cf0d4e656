"""Operators for building training corpora: each works on whole tables and returns whole results."""
