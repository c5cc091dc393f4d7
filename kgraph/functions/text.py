"""Pattern helpers on text columns.

Patterns carry the (?U) flag, so that blanks, digits and word ends follow
Unicode as the catalogue pages need.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def found(text, pattern: str, group: int = 0, flags: str = "U") -> Column:
    """The group of the first match, null when there is no match."""
    text = F.col(text) if isinstance(text, str) else text
    full = f"(?{flags}){pattern}"
    return F.when(text.rlike(full), F.regexp_extract(text, full, group))


def found_all(text, pattern: str, group: int = 0, flags: str = "U") -> Column:
    text = F.col(text) if isinstance(text, str) else text
    return F.regexp_extract_all(text, F.lit(f"(?{flags}){pattern}"), F.lit(group))


def one_space(text) -> Column:
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def course_refs(text, pattern: str) -> Column:
    """SUBJ-NUMBER for every course code of the pattern's two groups, in order."""
    return F.zip_with(
        found_all(text, pattern, 1), found_all(text, pattern, 2), lambda s, n: F.concat(s, F.lit("-"), n)
    )
