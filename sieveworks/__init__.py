"""Evidence analytics over text corpora, expressed as Spark DataFrame plans."""

__version__ = "0.1.0"
