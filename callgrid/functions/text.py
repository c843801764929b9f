"""Text and time expressions, all of them built-in functions."""

from __future__ import annotations

import functools
import sys

from pyspark.sql import Column
from pyspark.sql import functions as F

from callgrid.functions.patterns import ACCOUNT, PHONE


@functools.cache
def _foldings() -> tuple[dict[str, str], dict[str, str]]:
    """Lower-case letters that full case folding changes: to one letter, and to several."""
    letters = (chr(i) for i in range(128, sys.maxunicode + 1) if not 0xD800 <= i < 0xE000)
    changed = {c: c.casefold() for c in letters if c.lower() == c != c.casefold()}
    return {c: f for c, f in changed.items() if len(f) == 1}, {c: f for c, f in changed.items() if len(f) > 1}


def casefolded(c: Column) -> Column:
    """Full case folding: lower case, a letter's variants as one, and sharp s, ligatures and the like as the
    letters they stand for. Texts without such letters are only lower-cased."""
    one, several = _foldings()
    low = F.lower(c)
    single = F.translate(low, "".join(one), "".join(one.values()))
    both = functools.reduce(lambda t, f: F.replace(t, F.lit(f[0]), F.lit(f[1])), several.items(), single)
    return F.when(low.rlike("[" + "".join(several) + "]"), both).when(low.rlike("[^\\x00-\\x7f]"), single).otherwise(low)


def normalised_phrase(c: Column) -> Column:
    """Case-folded, punctuation as space, single spaces."""
    return F.trim(F.regexp_replace(F.regexp_replace(casefolded(c), r"(?U)[^\w\s]", " "), r"(?U)\s+", " "))


def normalised_words(c: Column) -> Column:
    """Case-folded words without punctuation at their edges."""
    return F.filter(F.transform(F.split(casefolded(c), r"(?U)\s+"), lambda w: F.regexp_replace(w, r"(?U)^[^\w]+|[^\w]+$", "")), lambda w: w != "")


def csv_cell(c: Column) -> Column:
    """A cell that a spreadsheet does not take for a formula."""
    return F.when(F.regexp_replace(c, r"(?U)^\s+", "").rlike(r"^[=+\-@]"), F.concat(F.lit("'"), c)).otherwise(c)


def iso_utc(ts: Column, zone: str = "+00:00") -> Column:
    """ISO 8601 with +00:00, or Z; microseconds only where there are some. The session's time zone is UTC."""
    whole = F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss")
    return F.concat(F.when(F.date_format(ts, "SSSSSS") == "000000", whole).otherwise(F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")), F.lit(zone))


def age(seconds: Column) -> Column:
    """12s, 5m, 3h, 2d."""
    part = lambda n, unit: F.concat(F.floor(seconds / n).cast("string"), F.lit(unit))
    return F.when(seconds < 60, part(1, "s")).when(seconds < 3600, part(60, "m")).when(seconds < 86400, part(3600, "h")).otherwise(part(86400, "d"))


def id_fingerprint(ids: Column) -> Column:
    """SHA-256 over the sorted distinct identifiers as a compact JSON array."""
    listed = F.array_sort(F.array_distinct(ids))
    return F.sha2(F.when(F.size(listed) == 0, "[]").otherwise(F.concat(F.lit('["'), F.array_join(listed, '","'), F.lit('"]'))), 256)


def call_reference(*parts: Column, prefix: str = "media:") -> Column:
    """A key from parts, each with its length in four bytes before it."""
    framed = [x for p in parts for x in (F.unhex(F.lpad(F.hex(F.octet_length(p)), 8, "0")), F.encode(p, "UTF-8"))]
    return F.concat(F.lit(prefix), F.sha2(F.concat(*framed), 256))


def short_id(c: Column) -> Column:
    return F.substring(F.sha2(c, 256), 1, 32)


def backoff_seconds(attempts: Column) -> Column:
    return F.least(F.lit(300), F.pow(F.lit(2), F.greatest(F.lit(0), attempts - 1))).cast("int")


def seconds_to_ms(c: Column) -> Column:
    """Milliseconds, halves to even."""
    return F.bround(c * 1000).cast("long")


def has_sensitive_number(c: Column) -> Column:
    """A run of eight or more digits with separators, or a labelled account number."""
    return c.rlike("(?U)" + PHONE) | c.rlike("(?U)" + ACCOUNT)
