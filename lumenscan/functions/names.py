"""Name rules: which spellings of a name mean the same thing."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

RESERVED_PREFIX = "ap_"


def clean_name(name: str) -> str:
    """Lower case after all but letters, digits and underscore is dropped."""
    return re.sub(r"[^A-Za-z0-9_]", "", name).lower()


def entity_key(col: Column) -> Column:
    return F.lower(F.regexp_replace(col, r"[^A-Za-z0-9_]", ""))


def source_key(col: Column) -> Column:
    """Scan sources are compared trimmed and in lower case."""
    return F.lower(F.trim(col))


def document_source_key(col: Column) -> Column:
    """As source_key, with '-' equal to '_'."""
    return F.translate(F.lower(F.trim(col)), "-", "_")
