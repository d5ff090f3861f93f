"""Digests and report-safe identifiers."""

from __future__ import annotations

import hashlib
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# The shape of a public id, and what marks one as private.
PUBLIC = r"^[a-z0-9][a-z0-9_.:-]{0,63}$"
EXTENSION = r"\.(?:docx?|pdf|md|markdown|txt|rtf|odt)(?![A-Za-z0-9_])"
KEYWORDS = ("assignment", "draft", "essay", "homework", "learner", "name", "paper", "person", "student", "submission", "teacher", "user")
#: What an id of the public shape (so without capitals, slashes and at signs) may not hold.
TELLING = rf"^(?:c|file):|\.\.|{EXTENSION}|(?:^|[-_.:])(?:{'|'.join(KEYWORDS)})(?:$|[-_.:])"


def public_id(value: Column, fallback: Column | None = None, prefix: str = "doc") -> Column:
    """The id itself if it may be published, else prefix and 16 digits of the fallback digest or of the value's own."""
    own = F.sha2(F.when(F.coalesce(value, F.lit("")) == "", F.lit(prefix)).otherwise(value), 256)
    digest = own if fallback is None else F.coalesce(fallback, own)
    return F.when(is_public_id(value), value).otherwise(F.concat(F.lit(f"{prefix}:"), F.substring(digest, 1, 16)))


def is_public_id(value: Column) -> Column:
    return F.coalesce(value.rlike(PUBLIC) & ~value.rlike(TELLING), F.lit(False))


def is_sha256(value: Column) -> Column:
    return value.rlike("^[0-9a-f]{64}$")


def public_id_of(value: str | None, fallback: str | None = None, prefix: str = "doc") -> str:
    """The same for one value on the driver."""
    if isinstance(value, str) and re.fullmatch(PUBLIC[1:-1], value) and not re.search(TELLING, value):
        return value
    return f"{prefix}:{(fallback or hashlib.sha256((value or prefix).encode()).hexdigest())[:16]}"
