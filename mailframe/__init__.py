"""Message-corpus processing on Spark: ingestion, cleaning, dedupe, validation and digests."""

__version__ = "0.1.0"
