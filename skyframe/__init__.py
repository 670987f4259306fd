"""Source extraction and photometry on survey images, as Spark DataFrame transformations."""

from .plans.pipeline import process_brick, run

__all__ = ["process_brick", "run"]
__version__ = "0.1.0"
