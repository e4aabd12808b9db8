"""The few string helpers of the command line and the text formats, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def basename(path: Column) -> Column:
    """What follows the last slash, without its last extension."""
    return F.regexp_replace(F.regexp_extract(path, r"([^/]*)$", 1), r"\.[^.]*$", "")


def replace_all(text: Column, pairs: dict[str, str]) -> Column:
    """Every key replaced by its value, one key after the other."""
    for old, new in pairs.items():
        text = F.replace(text, F.lit(old), F.lit(new))
    return text


def unsigned_tokens(line: Column) -> Column:
    """The unsigned numbers of a line, in order; what else stands in it parts them."""
    return F.transform(F.regexp_extract_all(line, F.lit(r"([0-9]+)"), F.lit(1)), lambda x: x.cast("long"))
