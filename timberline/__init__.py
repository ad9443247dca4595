"""timberline: gradient-boosted trees and the analytics around them, Spark-first."""

__version__ = "0.1.0"
