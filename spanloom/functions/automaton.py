"""All phrases of a list in one pass over a sentence: an Aho-Corasick automaton over words."""

from __future__ import annotations

import sys
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.cloudpickle import register_pickle_by_value

# the kernels travel with the plan
register_pickle_by_value(sys.modules[__name__])


class Automaton:
    """``phrases``: distinct, non-empty word lists.  Words are numbers of a vocabulary."""

    def __init__(self, phrases: list[list[str]]):
        self.phrases = phrases
        number = {w: i for i, w in enumerate(dict.fromkeys(w for p in phrases for w in p))}
        self.vocabulary = pa.array(list(number), pa.string())
        self.step: list[dict[int, int]] = [{}]
        self.ends: list[int] = [-1]  # the phrase that ends here
        for i, p in enumerate(phrases):
            at = 0
            for w in p:
                at = self.step[at].setdefault(number[w], len(self.step))
                if at == len(self.step):
                    self.step.append({}), self.ends.append(-1)
            self.ends[at] = i
        # where to go on when no step fits, and the next shorter phrase that ends here too
        self.fail, self.shorter = [0] * len(self.step), [0] * len(self.step)
        queue = deque(self.step[0].values())
        while queue:
            at = queue.popleft()
            back = self.fail[at]
            self.shorter[at] = back if self.ends[back] >= 0 else self.shorter[back]
            for w, to in self.step[at].items():
                state = back
                while state and w not in self.step[state]:
                    state = self.fail[state]
                self.fail[to] = self.step[state].get(w, 0)
                queue.append(to)

    def found(self, words: list[int]) -> set[int]:
        """Numbers of the phrases that occur in a run of known words."""
        hits: set[int] = set()
        step, ends, fail, shorter = self.step, self.ends, self.fail, self.shorter
        at = 0
        for w in words:
            while at and w not in step[at]:
                at = fail[at]
            at = step[at].get(w, 0)
            node = at if ends[at] >= 0 else shorter[at]
            while node and ends[node] not in hits:  # shorter ones were seen with it
                hits.add(ends[node])
                node = shorter[node]
        return hits

    def sentences(self, tokens: pa.ListArray) -> tuple[list[int], list[int]]:
        """(row, phrase number) of all hits."""
        lengths = np.asarray(pc.fill_null(pc.list_value_length(tokens), 0))
        row = np.repeat(np.arange(len(lengths)), lengths)
        known = np.asarray(pc.fill_null(pc.index_in(tokens.flatten(), value_set=self.vocabulary), -1))
        at = np.flatnonzero(known >= 0)
        if not len(at):
            return [], []
        cut = np.flatnonzero((np.diff(at) != 1) | (np.diff(row[at]) != 0)) + 1
        rows, hits = [], []
        last, seen = -1, set()
        for a, b in zip(np.concatenate(([0], cut)).tolist(), np.concatenate((cut, [len(at)])).tolist()):
            r = int(row[at[a]])
            if r != last:
                last, seen = r, set()
            new = self.found(known[at[a:b]].tolist()) - seen
            seen |= new
            rows += [r] * len(new)
            hits += sorted(new)
        return rows, hits


def hit_batches(batches: Iterator[pa.RecordBatch], block, key_count: int):
    """Sentence rows (keys..., tokens) -> (keys..., phrase) per phrase of the block found.  The
    automaton is built once a worker and stays beside the block's value."""
    value = block.value
    if "automaton" not in value:
        value["automaton"] = Automaton(value["phrases"])
    automaton = value["automaton"]
    for b in batches:
        rows, hits = automaton.sentences(b.column(key_count))
        if rows:
            take = pa.array(rows, pa.int64())
            phrases = pa.array([automaton.phrases[i] for i in hits], pa.list_(pa.string()))
            columns = [*(b.column(i).take(take) for i in range(key_count)), phrases]
            yield pa.RecordBatch.from_arrays(columns, names=[*b.schema.names[:key_count], "phrase"])
