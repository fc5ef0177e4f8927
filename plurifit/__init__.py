"""Classification campaigns on Spark: many yes/no problems over one set of items."""

__version__ = "0.1.0"
