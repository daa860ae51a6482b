"""Detector registry, scan plan and the registered queries."""
