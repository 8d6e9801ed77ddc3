"""Arrow batch kernels for the three steps that SQL windows cannot express:
nearest larger gap, greedy overlap resolution, smallest containing span.

Each takes and yields record batches inside a Spark task.  The scans rely on rows
sorted by sentence and keep only the open sentence's small state, so a batch border
may fall anywhere and no group is held whole.
"""

from __future__ import annotations

import sys
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.cloudpickle import register_pickle_by_value

# the kernels travel with the plan, so executors need not have this package installed
register_pickle_by_value(sys.modules[__name__])


def _nearest(values: np.ndarray, row_end_gap: int, strict: bool) -> np.ndarray:
    """Index of the nearest earlier value that is larger (``strict``) or at least as
    large.  ``values`` must hold +inf between rows.  Doubling maxima, then one binary
    descent for all positions at once."""
    n = len(values)
    maxima = [values]
    width = 1
    while width <= row_end_gap:
        prev = maxima[-1]
        nxt = prev.copy()
        nxt[width:] = np.maximum(prev[width:], prev[:-width])
        nxt[:width] = np.inf
        maxima.append(nxt)
        width *= 2
    pos = np.arange(n) - 1
    for k in range(len(maxima) - 1, -1, -1):
        block = maxima[k][np.maximum(pos, 0)]
        skip = (block <= values) if strict else (block < values)
        skip &= pos >= 0
        pos = np.where(skip, pos - (1 << k), pos)
    return pos


def chain_merges(gaps: pa.ListArray, singles: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, s, e) of every single-linkage merge of every row's chain.

    Gap i joins words ``[l, r]``: l is one past the nearest earlier larger gap, r is
    the nearest later gap that is at least as large (ties merge left first)."""
    lengths = np.asarray(pc.list_value_length(gaps).fill_null(0))
    flat = np.asarray(gaps.flatten(), dtype=np.float64)
    rows = np.repeat(np.arange(len(lengths)), lengths)
    first = np.concatenate(([0], np.cumsum(lengths)))[:-1]
    offset = np.arange(len(flat)) - np.repeat(first, lengths)
    longest = int(lengths.max(initial=0))
    # one +inf before each row and one at the very end
    slot = np.arange(len(flat)) + rows + 1
    padded = np.full(len(flat) + len(lengths) + 1, np.inf)
    padded[slot] = flat
    back = _nearest(padded, longest, strict=True)
    size = len(padded)
    ahead = size - 1 - _nearest(padded[::-1], longest, strict=False)[::-1]
    row_slot = (first + np.arange(len(lengths)))[rows] if len(flat) else np.zeros(0, int)
    s = back[slot] - row_slot
    e = ahead[slot] - row_slot - 1
    if not singles:
        return rows, s, e
    words = lengths + 1
    w_rows = np.repeat(np.arange(len(words)), words)
    w_first = np.concatenate(([0], np.cumsum(words)))[:-1]
    w = np.arange(len(w_rows)) - np.repeat(w_first, words)
    return np.concatenate((rows, w_rows)), np.concatenate((s, w)), np.concatenate((e, w))


def cluster_batches(batches: Iterator[pa.RecordBatch], key_count: int, singles: bool, packs: bool = False):
    """Sentence rows (keys..., gaps) -> span rows (keys..., s, e), or with ``packs`` the same
    sentences with arrays s, e."""
    for batch in batches:
        if batch.num_rows == 0:
            continue
        rows, s, e = chain_merges(batch.column(key_count), singles)
        if packs:
            order = np.argsort(rows, kind="stable")
            counts = np.bincount(rows, minlength=batch.num_rows)
            offsets = pa.array(np.concatenate(([0], np.cumsum(counts))).astype(np.int32))
            lists = [pa.ListArray.from_arrays(offsets, pa.array(x[order].astype(np.int32))) for x in (s, e)]
            names = [*batch.schema.names[:key_count], "s", "e"]
            yield pa.RecordBatch.from_arrays([*batch.columns[:key_count], *lists], names=names)
            continue
        take = pa.array(rows, type=pa.int64())
        cols = [batch.column(i).take(take) for i in range(key_count)]
        cols += [pa.array(s.astype(np.int32)), pa.array(e.astype(np.int32))]
        names = batch.schema.names[:key_count] + ["s", "e"]
        yield pa.RecordBatch.from_arrays(cols, names=names)


def cluster_places(gaps: pa.ListArray) -> pa.ListArray:
    """Per row the places ``e (e + 1) / 2 + s`` of its merges and single words, sorted."""
    rows, s, e = chain_merges(gaps, True)
    place = e.astype(np.int64) * (e + 1) // 2 + s
    order = np.lexsort((place, rows))
    offsets = np.concatenate(([0], np.cumsum(np.bincount(rows, minlength=len(gaps)))))
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(place[order]))


def tag_lists(tags: pa.ListArray) -> pa.ListArray:
    """``functions.tags.iob_spans`` of a batch of tag arrays; no tags, no spans."""
    lengths = np.asarray(pc.fill_null(pc.list_value_length(tags), 0)).astype(np.int64)
    coded = tags.flatten().dictionary_encode()
    names = coded.dictionary.to_pylist()
    kinds = np.array([1 if x.startswith("B-") else 2 if x.startswith("I-") else 0 for x in names] + [0], np.int8)
    code = np.asarray(pc.fill_null(coded.indices, len(names)))
    kind = kinds[code]
    upto = np.cumsum(lengths)
    border = kind != 2
    border[1:] |= kind[:-1] == 0
    border[(upto - lengths)[lengths > 0]] = True
    at = border.nonzero()[0]
    ends = np.append(at[1:], len(kind))
    opens = kind[at] > 0
    at, ends = at[opens], ends[opens]
    row = np.searchsorted(upto, at, "right")
    first = (upto - lengths)[row]
    label = pa.array([x[2:] for x in names], pa.string()).take(pa.array(code[at]))
    items = [pa.array((at - first).astype(np.int32)), pa.array((ends - first).astype(np.int32)), label]
    offsets = np.searchsorted(at, np.append(upto - lengths, len(kind)))
    return pa.ListArray.from_arrays(
        pa.array(offsets.astype(np.int32)), pa.StructArray.from_arrays(items, names=["start", "end", "label"])
    )


def _group_starts(batch: pa.RecordBatch, key_count: int, last: list | None) -> np.ndarray:
    """True where a row opens a new sentence, given the last key of the batch before."""
    n = batch.num_rows
    fresh = np.zeros(n, dtype=bool)
    for i in range(key_count):
        col = batch.column(i)
        if n > 1:
            fresh[1:] |= np.asarray(pc.not_equal(col.slice(1), col.slice(0, n - 1)))
    fresh[0] = last is None or last != [batch.column(i)[0].as_py() for i in range(key_count)]
    return fresh


def flat_batches(batches: Iterator[pa.RecordBatch], key_count: int, flag: bool = False):
    """Rows sorted by (keys, priority): keep a span unless it contains, or lies in, a
    span kept before.  Kept spans never contain each other, so sorted by start they are
    sorted by end too and one bisection answers both questions.  With ``flag`` all rows
    stay and get ``is_flat``; rows labelled 0 compete with nothing and are not flat."""
    last, starts, ends = None, [], []
    for batch in batches:
        if batch.num_rows == 0:
            continue
        fresh = _group_starts(batch, key_count, last)
        keep = []
        for new, s, e, label in zip(
            fresh.tolist(), *[batch.column(n).to_pylist() for n in ("s", "e", "label")]
        ):
            if new:
                starts, ends = [], []
            if label == 0:
                keep.append(False)
                continue
            at = bisect_right(starts, s)
            inside = at > 0 and ends[at - 1] >= e
            nxt = bisect_left(starts, s)
            if inside or (nxt < len(starts) and ends[nxt] <= e):
                keep.append(False)
                continue
            starts.insert(at, s)
            ends.insert(at, e)
            keep.append(True)
        last = [batch.column(i)[batch.num_rows - 1].as_py() for i in range(key_count)]
        if flag:
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(keep, pa.bool_())], names=[*batch.schema.names, "is_flat"]
            )
        else:
            yield batch.filter(pa.array(keep, pa.bool_()))


def parent_batches(batches: Iterator[pa.RecordBatch], key_count: int):
    """Rows sorted by (keys, s asc, e desc): add the smallest strictly containing span; of
    equal spans the first row stays.  Only containers that no later, shorter and at least
    as far reaching span beats are kept; by end their lengths rise, so the first one that
    reaches ``e`` is the answer."""
    last, reach, begin, before = None, [], [], None
    for batch in batches:
        if batch.num_rows == 0:
            continue
        fresh = _group_starts(batch, key_count, last)
        keep, p_s, p_e = [], [], []
        for new, s, e in zip(
            fresh.tolist(), batch.column("s").to_pylist(), batch.column("e").to_pylist()
        ):
            if new:
                reach, begin = [], []
            elif before == (s, e):
                keep.append(False)
                continue
            before = (s, e)
            keep.append(True)
            at = bisect_left(reach, e)
            found = at < len(reach)
            p_s.append(begin[at] if found else None)
            p_e.append(reach[at] if found else None)
            lo = at
            while lo > 0 and reach[lo - 1] - begin[lo - 1] >= e - s:
                lo -= 1
            hi = at + 1 if found and reach[at] == e else at
            reach[lo:hi], begin[lo:hi] = [e], [s]
        last = [batch.column(i)[batch.num_rows - 1].as_py() for i in range(key_count)]
        kept = batch if all(keep) else batch.filter(pa.array(keep))
        cols = list(kept.columns) + [pa.array(p_s, pa.int32()), pa.array(p_e, pa.int32())]
        yield pa.RecordBatch.from_arrays(cols, names=batch.schema.names + ["parent_s", "parent_e"])


def key_starts(batch: pa.RecordBatch, key_count: int) -> np.ndarray:
    """True where the key differs from the row before; null equals null."""
    n = batch.num_rows
    fresh = np.zeros(n, dtype=bool)
    if n:
        fresh[0] = True
    for i in range(key_count):
        a, b = batch.column(i).slice(1), batch.column(i).slice(0, max(n - 1, 0))
        differ = pc.or_(pc.fill_null(pc.not_equal(a, b), False), pc.not_equal(pc.is_null(a), pc.is_null(b)))
        fresh[1:] |= differ.to_numpy(zero_copy_only=False)
    return fresh


def whole_groups(batches: Iterator[pa.RecordBatch], key_count: int) -> Iterator[pa.RecordBatch]:
    """The same rows, cut so that the rows of a key, which lie together, are in one batch."""
    held = None
    for batch in batches:
        if batch.num_rows == 0:
            continue
        if held is not None:
            batch = pa.concat_batches([held, batch])
        last = int(key_starts(batch, key_count).nonzero()[0][-1])
        if last:
            yield batch.slice(0, last)
        held = batch.slice(last)
    if held is not None:
        yield held
