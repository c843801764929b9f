"""Redaction of personal data; anything that fails raises, so that no text passes unredacted."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from callgrid.functions.patterns import ACCOUNT, ADDRESS, EMAIL, NAME, PHONE

# fixed values: the mark and the length limit
MARK, MAX_CHARS = "[REDACTED]", 10_000
PATTERNS = (EMAIL, PHONE, ACCOUNT, NAME, ADDRESS)
#: Every text that a pattern matches matches this one too.
HINT = r"(?iU)@|\d|my name is|this is|i am|account|policy|member|customer"


def spans(text: str, patterns: Iterable[str] = PATTERNS) -> list[tuple[int, int]]:
    found = []
    for p in patterns:
        found += [m.span(m.re.groups and 1 or 0) for m in re.finditer(p, text)]
    return found


def redacted(text: str | None, recogniser: Callable[[str], list[tuple[int, int]]] | None = None, limit: int | None = None, patterns: Iterable[str] = PATTERNS) -> str | None:
    """The text with every recognised span, united where they touch, replaced by MARK. Null stays null."""
    if text is None:
        return None
    if limit is not None and len(text) > limit:
        raise ValueError("the text is too long to redact")
    gone = sorted((max(0, a), min(len(text), b)) for a, b in spans(text, patterns) + (recogniser(text) if recogniser else []) if min(len(text), b) > max(0, a))
    out, at, until = [], 0, -1
    for a, b in gone:
        if a > until:
            out += [text[max(at, 0) : a], MARK]
        at = until = max(b, until)
    return "".join([*out, text[at:]])


def redactor(recogniser: Callable[[str], list[tuple[int, int]]] | None = None, limit: int | None = None) -> Callable[[Column], Column]:
    """An Arrow-batched redaction as a function of columns. Without a recogniser of one's own and a limit,
    only texts with something that a pattern could begin with go to Python."""

    @F.pandas_udf("string")
    def apply(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: redacted(t, recogniser, limit))

    if recogniser is not None or limit is not None:
        return apply
    return lambda c: F.coalesce(apply(F.when(c.rlike(HINT), c)), c)


def batch_redactor(recogniser: Callable[[list[str]], list[list[tuple[int, int]]]], limit: int | None = None, patterns: Iterable[str] = PATTERNS) -> Callable[[Column], Column]:
    """A redaction by a recogniser that takes many texts at once and gives each one's spans, in order; it is
    called once an Arrow batch, with the texts that are not null and not empty. A wrong number of answers is an
    error."""

    @F.pandas_udf("string")
    def apply(texts: pd.Series) -> pd.Series:
        some = texts[texts.fillna("") != ""]
        if limit is not None and (some.str.len() > limit).any():
            raise ValueError("a text is too long to redact")
        found = recogniser(some.tolist()) if len(some) else []
        if len(found) != len(some):
            raise ValueError("the recogniser's answers do not fit its texts")
        out = texts.copy()
        out[some.index] = [redacted(t, lambda _, own=own: list(own), None, patterns) for t, own in zip(some, found)]
        return out

    return apply
