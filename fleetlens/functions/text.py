"""String rules."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def trim_whitespace(col: Column) -> Column:
    """Strip every Unicode white space character, where SQL ``trim`` strips blanks only."""
    return F.regexp_replace(col, r"(?U)^\s+|\s+$", "")


_PLACEHOLDER = re.compile(r"\{\{\s*application_id\s*\}\}")


def render_link(template: str | None, application_id: Column) -> Column:
    """The template with its ``{{ application_id }}`` filled in; null without template or id."""
    if template is None:
        return F.lit(None).cast("string")
    pieces = _PLACEHOLDER.split(template)
    parts = [F.lit(pieces[0])]
    for piece in pieces[1:]:
        parts += [application_id, F.lit(piece)]
    return F.when(F.length(application_id) > 0, F.concat(*parts))
