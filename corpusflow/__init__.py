"""corpusflow: text corpora -> segment tables, SFT chat datasets and batch model
inference, as Spark DataFrame operators."""

__version__ = "0.1.0"
