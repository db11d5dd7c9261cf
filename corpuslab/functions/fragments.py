"""Extractive fragments of a summary in its source text (greedy, first longest).

For each summary position the text is scanned left to right; at a match the
run of equal tokens is measured and the scan resumes behind the run (so an
overlapping longer run can be missed, as in the reference).  The longest run
(the first one on ties) becomes a fragment and the summary position moves past
it; without a run it moves by one.
"""

from __future__ import annotations

from collections import defaultdict

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T


def greedy_fragments(summary: list[str], text: list[str]) -> list[list[str]]:
    where: dict[str, list[int]] = defaultdict(list)
    for pos, tok in enumerate(text):
        where[tok].append(pos)
    out: list[list[str]] = []
    i, ns, nt = 0, len(summary), len(text)
    while i < ns:
        best, resume = 0, 0
        for start in where.get(summary[i], ()):
            if start < resume:
                continue
            k = 0
            while i + k < ns and start + k < nt and summary[i + k] == text[start + k]:
                k += 1
            best = max(best, k)
            resume = start + k
        if best:
            out.append(list(summary[i:i + best]))
        i += max(best, 1)
    return out


@F.pandas_udf(T.ArrayType(T.ArrayType(T.StringType())))
def fragments(summary: pd.Series, text: pd.Series) -> pd.Series:
    return pd.Series([greedy_fragments(list(s) if s is not None else [], list(t) if t is not None else [])
                      for s, t in zip(summary, text)])
