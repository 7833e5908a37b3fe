"""Identity of a posting."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from rolesieve.functions.text import strip

SEPARATOR = "\x00"


def posting_hash(title: Column, company: Column, url: Column) -> Column:
    """SHA-256 hex digest over the lower-cased, stripped title, company and URL."""
    parts = [strip(F.lower(c)) for c in (title, company, url)]
    return F.sha2(F.concat_ws(SEPARATOR, *parts), 256)
