"""Many keywords at once: an automaton over Arrow batches in place of one scan per keyword.

A few keywords are cheaper as plain expressions, which stay inside generated code; both ways count alike.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Sequence

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from servicelens.functions.batches import sliced_arrays

#: From so many keywords on, a text is read once by the automaton.
MANY = 16


def keywords_held(c: Column, words: Sequence[str]) -> Column:
    """How many of the keywords a text holds, without regard to case; a repeated keyword counts again.

    Every batch builds the automaton, which takes little time; a function of single batches can share a
    Python worker with those of other columns, so that a task has one. A missing text holds none.
    """
    times = Counter(w.lower() for w in words if w)

    @F.arrow_udf(T.IntegerType())
    def held(texts: pa.Array) -> pa.Array:
        automaton = ahocorasick.Automaton()
        for number, word in enumerate(times):
            automaton.add_word(word, number)
        counts = list(times.values())
        if counts:
            automaton.make_automaton()

        def count(text: str | None) -> int:
            return sum(counts[n] for n in {n for _, n in automaton.iter(text)}) if text and counts else 0

        return pa.array([count(t) for part in sliced_arrays(texts) for t in part.to_pylist()], pa.int32())

    return held(F.lower(c))
