"""Incremental plans (an extension: the batch engine needs no stream)."""
