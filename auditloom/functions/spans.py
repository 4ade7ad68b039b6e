"""Numbers in texts with their kind and place, as an Arrow-batched function: no built-in one tells where matches stand."""

from __future__ import annotations

import re
from bisect import bisect_left, insort
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from auditloom.config import NUMBER_KINDS

_SPAN = "array<struct<value double, kind string, text string, start int, end int>>"


def apart(found: list[tuple]) -> list[tuple]:
    """Of spans (..., start, end) that overlap the longest stays, of equally long ones the first."""
    kept, taken = [], []
    for i in sorted(range(len(found)), key=lambda i: (found[i][3] - found[i][4], i)):
        start, end = found[i][3:]
        at = bisect_left(taken, (start, end))
        if (at == 0 or taken[at - 1][1] <= start) and (at == len(taken) or taken[at][0] >= end):
            insort(taken, (start, end))
            kept.append(i)
    return [found[i] for i in sorted(kept)]


def number_spans(text: Column, kinds: Sequence[tuple[str, str]] = NUMBER_KINDS, overlaps: bool = True) -> Column:
    """All numbers of all kinds, kind by kind and in order: value, kind, text, and where it stands, in code points.
    Without ``overlaps`` a stretch of text is of one kind: that of the longest match."""
    compiled = [(name, re.compile(pattern)) for name, pattern in kinds]

    def find(texts: pd.Series) -> pd.Series:
        out = []
        for t in texts:
            found = [(float(m[1]), name, m[0], *m.span()) for name, pattern in compiled for m in pattern.finditer(t or "")]
            out.append([dict(zip(("value", "kind", "text", "start", "end"), s, strict=True)) for s in (found if overlaps else apart(found))])
        return pd.Series(out, dtype=object)

    return F.pandas_udf(find, _SPAN)(text)
