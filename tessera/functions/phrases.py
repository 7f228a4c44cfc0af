"""Finding many phrases in texts in one pass."""

from __future__ import annotations

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Stands between the texts of a batch; phrases do not have it.
BREAK = "\u0001"


def phrase_counts(low: Column, groups: dict[str, list[str]]) -> Column:
    """array<int>: for each group, how many different phrases of it the text contains; null counts as empty.

    An Aho-Corasick automaton reads a whole Arrow batch as one string and reports every phrase that ends at a place, nested ones included.
    """
    of = {p: [i for i, phrases in enumerate(groups.values()) if p in phrases] for phrases in groups.values() for p in phrases}

    @F.arrow_udf("array<int>")
    def count(texts: pa.Array) -> pa.Array:
        automaton = ahocorasick.Automaton()
        for k, p in enumerate(of):
            automaton.add_word(p, k)
        automaton.make_automaton()
        own = texts.fill_null("").to_pylist()
        ends = np.cumsum([len(t) + 1 for t in own])
        out = np.zeros((len(own), len(groups)), np.int32)
        hits = np.array(list(automaton.iter(BREAK.join(own))), np.int64).reshape(-1, 2)
        found = np.unique(np.stack([np.searchsorted(ends, hits[:, 0], "right"), hits[:, 1]], axis=1), axis=0)
        kinds = list(of.values())
        for line, k in found:
            out[line, kinds[k]] += 1
        return pa.ListArray.from_arrays(np.arange(0, out.size + 1, len(groups), dtype=np.int32), pa.array(out.ravel()))

    return count(low)
