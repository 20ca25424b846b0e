"""Search of page texts by pattern."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parcelwise.functions.let import exploded


def text_hits(pages: DataFrame, pattern: str, before: int = 70, after: int = 40) -> DataFrame:
    """document, page, ordinal (from 1 by page), hit, snippet of every match of pattern, in either case, in pages (document, page, text).

    snippet: the hit with as many characters before and after it, white space as one space. Matches don't overlap and must take a character: a pattern
    that fits the empty text is refused. Pages without text or match give no row. The windows around a hit are groups of the same pattern, so no text
    is copied a hit, and pages are neither shuffled nor sent to Python.
    """
    compiled = re.compile(pattern)
    if compiled.match(""):
        raise ValueError(f"{pattern!r} fits the empty text")
    own = compiled.groups
    # the hit is tried first, so that windows are looked at where there is one
    around = f"(?iu)(?=(?:{pattern}))(?<=([\\s\\S]{{{before}}}|\\A[\\s\\S]{{0,{before}}}))({pattern})(?=([\\s\\S]{{0,{after}}}))"
    part = lambda group: F.regexp_extract_all("text", F.lit(around), F.lit(group))
    found = F.arrays_zip(part(own + 1).alias("before"), part(own + 2).alias("hit"), part(2 * own + 3).alias("after"))
    rows = pages.filter(F.col("text").rlike(f"(?iu)(?:{pattern})"))
    rows = exploded(rows, ["document", "page"], found, position="k")
    snippet = F.trim(F.regexp_replace(F.concat("x.before", "x.hit", "x.after"), "(?U)\\s+", " "))
    return rows.select("document", "page", (F.col("k") + 1).cast("long").alias("ordinal"), F.col("x.hit").alias("hit"), snippet.alias("snippet"))
