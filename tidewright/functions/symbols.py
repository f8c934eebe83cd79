"""Names of instruments."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def instrument(symbol: Column | str) -> Column:
    """Upper case with everything but letters and digits removed; null stays null. A name without letters or digits becomes the empty name."""
    return F.regexp_replace(F.upper(symbol), r"[^\p{L}\p{N}]", "")
