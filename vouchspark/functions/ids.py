"""Deterministic identifiers."""

from pyspark.sql import Column
from pyspark.sql import functions as F

ID_LENGTH = 26
# Shape of a generated identifier: 26 characters of an alphabet without I, L, O and U.
# A fixed value; hexadecimal digits are a subset of that alphabet.
ID_PATTERN = r"\b[0-9A-HJKMNP-TV-Z]{26}\b"
REDACTED = "[unverified-id]"


def stable_id(*parts: Column) -> Column:
    """26 upper-case hex characters derived from the parts, the same on every run."""
    return F.upper(F.substring(F.sha2(F.concat_ws(":", *parts), 256), 1, ID_LENGTH))
