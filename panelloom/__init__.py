"""Panel analytics expressed as Spark jobs: subjects observed over days."""

__version__ = "0.1.0"
