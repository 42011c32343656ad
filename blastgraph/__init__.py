"""blastgraph: PySpark-native analytics for software-supply-chain incidents."""

__version__ = "0.1.0"
