"""Corpora from tables, directory trees and structured files."""
