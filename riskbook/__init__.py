"""riskbook: rating and portfolio analytics for books of property policies on Spark."""
__version__ = "0.1.0"
