"""barlake: market-data research operators as lazy Spark DataFrame transformations."""

__version__ = "0.1.0"
