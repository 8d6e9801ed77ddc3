"""Arrow batch kernels over packs: the span rows of a sentence that lie together, as one row of
arrays.  Through an exchange the packs of many sentences travel as one compressed row, at two
bytes a span or so, and whole sentences are then worked on at once in numpy."""

from __future__ import annotations

import sys
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.cloudpickle import register_pickle_by_value

from . import scans

# the kernels travel with the plan, so executors need not have this package installed
register_pickle_by_value(sys.modules[__name__])
register_pickle_by_value(scans)

#: Spans worked on at once, or one sentence.
SPANS = 1 << 20
#: Spans, and bytes, that a task gathers before it sends them off.
HELD_SPANS, HELD_BYTES = 1 << 20, 1 << 26
#: Turns in which a large part is read at most.
TURNS = 256


def pack_batches(batches: Iterator[pa.RecordBatch], key_count: int):
    """Rows (keys..., values...) -> one row per run of a key in a batch, the values as lists."""
    for batch in batches:
        if batch.num_rows == 0:
            continue
        first = scans.key_starts(batch, key_count).nonzero()[0]
        offsets = pa.array(np.append(first, batch.num_rows).astype(np.int32))
        take = pa.array(first)
        cols = [batch.column(i).take(take) for i in range(key_count)]
        cols += [pa.ListArray.from_arrays(offsets, c) for c in batch.columns[key_count:]]
        yield pa.RecordBatch.from_arrays(cols, names=batch.schema.names)


def _cut(batch: pa.RecordBatch, starts: np.ndarray, list_at: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """The batch in parts of about ``SPANS`` spans that hold whole groups, each with the first
    row of every group."""
    counts = np.asarray(pc.fill_null(pc.list_value_length(batch.column(list_at)), 0))
    upto = np.concatenate(([0], np.cumsum(counts)))
    lo = 0
    while lo < len(starts):
        hi = max(lo + 1, int(np.searchsorted(upto[starts], upto[starts[lo]] + SPANS, "right")) - 1)
        if hi >= len(starts) or upto[-1] - upto[starts[lo]] <= SPANS:
            hi = len(starts)
        end = int(starts[hi]) if hi < len(starts) else batch.num_rows
        yield batch.slice(int(starts[lo]), end - int(starts[lo])), starts[lo:hi] - starts[lo]
        lo = hi


def part_ids(n: int) -> list[int]:
    """``n`` numbers that Spark's hash partitioning into ``n`` puts into partitions 0, 1, ... n - 1."""
    ids, found = np.full(n, -1, np.int64), 0
    rotl = lambda x, r: (x << np.uint32(r)) | (x >> np.uint32(32 - r))
    for low in range(0, 1 << 30, 1 << 12):
        k = np.arange(low, low + (1 << 12), dtype=np.uint32)
        h = np.uint32(42) ^ rotl(k * np.uint32(0xCC9E2D51), 15) * np.uint32(0x1B873593)
        h = rotl(h, 13) * np.uint32(5) + np.uint32(0xE6546B64) ^ np.uint32(4)
        h = (h ^ (h >> np.uint32(16))) * np.uint32(0x85EBCA6B)
        h = (h ^ (h >> np.uint32(13))) * np.uint32(0xC2B2AE35)
        at = (h ^ (h >> np.uint32(16))).astype(np.int32).astype(np.int64) % n
        ids[at] = np.where(ids[at] < 0, k, ids[at])
        if (ids >= 0).all():
            break
    return ids.tolist()


def _narrow(col: pa.Array, name: str) -> tuple[pa.Array, str]:
    """Whole numbers, or lists of them, in the least type that holds them, and a name that says which
    type they had."""
    kind = col.type.value_type if pa.types.is_list(col.type) else col.type
    if not pa.types.is_signed_integer(kind):
        return col, f"|{name}"
    low, high = pc.min_max(col.flatten() if pa.types.is_list(col.type) else col).values()
    low, high = low.as_py() or 0, high.as_py() or 0
    least = next(t for t, m in ((pa.int8(), 7), (pa.int16(), 15), (pa.int32(), 31), (pa.int64(), 63)) if -(1 << m) <= low and high < 1 << m)
    if least != kind:
        col = col.cast(pa.list_(least) if pa.types.is_list(col.type) else least)
    return col, f"{kind}|{name}"


def _widened(col: pa.Array, name: str) -> pa.Array:
    kind = name.partition("|")[0]
    if not kind:
        return col
    whole = pa.type_for_alias(kind)
    return col.cast(pa.list_(whole) if pa.types.is_list(col.type) else whole)


def _weights(cols: list[pa.Array]) -> np.ndarray:
    """What each row counts for: one, and the elements of its lists."""
    out = np.ones(len(cols[0]), np.int64)
    for c in cols:
        if pa.types.is_list(c.type):
            out += np.asarray(pc.fill_null(pc.list_value_length(c), 0))
    return out


def _rows_of(first: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The rows of runs that begin at ``first``, one run after the other."""
    return np.arange(counts.sum()) + np.repeat(first - (np.cumsum(counts) - counts), counts)


def _by_key(keys: list[pa.Array], *before: pa.Array) -> pa.Array:
    names = [str(i) for i in range(len(before) + len(keys))]
    table = pa.RecordBatch.from_arrays([*before, *keys], names=names)
    return pc.sort_indices(table, sort_keys=[(n, "ascending") for n in names])


def freeze_batches(batches: Iterator[pa.RecordBatch], key_count: int, ids: list[int]):
    """Rows (hash, keys..., values...) -> (part, weight, rows of that part as compressed bytes): the
    rows of one key are in one part, the part being the hash modulo their number, by its name in ``ids``."""
    held, rows, size = [], 0, 0
    for batch in batches:
        if batch.num_rows == 0:
            continue
        held.append(batch)
        rows, size = rows + batch.num_rows, size + batch.nbytes
        if rows >= HELD_SPANS or size >= HELD_BYTES:
            yield _frozen(pa.concat_batches(held), key_count, ids)
            held, rows, size = [], 0, 0
    if held:
        yield _frozen(pa.concat_batches(held), key_count, ids)


def _frozen(batch: pa.RecordBatch, key_count: int, ids: list[int]) -> pa.RecordBatch:
    names = batch.schema.names[1:]
    first = scans.key_starts(batch, key_count + 1).nonzero()[0]
    counts = np.diff(np.append(first, batch.num_rows))
    heads = batch.select(range(key_count + 1)).take(pa.array(first))
    hashed = numbers(heads.column(0)).astype(np.int64)
    keys = heads.columns[1:]
    order = _by_key(keys, pa.array(hashed % len(ids)))
    at = np.asarray(order)
    hashed, rows, counts = hashed[at], _rows_of(first[at], counts[at]), counts[at]
    heads = pa.RecordBatch.from_arrays([k.take(order) for k in keys], names=names[:key_count])
    # runs of a key that lay apart become one
    whole = scans.key_starts(heads, key_count).nonzero()[0]
    hashed, counts = hashed[whole], np.add.reduceat(counts, whole)
    part, turn = hashed % len(ids), hashed // len(ids) % TURNS
    keys = [_narrow(k.take(pa.array(whole)), n) for k, n in zip(heads.columns, names)]
    extra = [_narrow(pa.array(counts), "counts"), (pa.array(turn.astype(np.uint8)), "|turn")]
    heads = pa.RecordBatch.from_arrays([c for c, _ in (*keys, *extra)], names=[n for _, n in (*keys, *extra)])
    small = [_narrow(c, n) for c, n in zip(batch.columns[key_count + 1 :], names[key_count:])]
    take = pa.array(rows)
    values = pa.RecordBatch.from_arrays([c.take(take) for c, _ in small], names=[n for _, n in small])
    weight = np.append(0, np.cumsum(_weights(values.columns)))
    upto = np.append(0, np.cumsum(counts))
    begin = np.flatnonzero(np.diff(part, prepend=-1))
    parts, weights, blobs = [], [], []
    for lo, hi in zip(begin.tolist(), np.append(begin[1:], len(part)).tolist()):
        a, b = int(upto[lo]), int(upto[hi])
        sink = pa.BufferOutputStream()
        for some in (heads.slice(lo, hi - lo), values.slice(a, b - a)):
            with pa.ipc.new_stream(sink, some.schema) as out:
                out.write_batch(some)
        plain = sink.getvalue()
        blobs.append(plain.size.to_bytes(8, "little") + pa.compress(plain, codec="zstd", asbytes=True))
        parts.append(ids[int(part[lo])])
        weights.append(int(weight[b] - weight[a]))
    return pa.RecordBatch.from_arrays(
        [pa.array(parts, pa.int32()), pa.array(weights, pa.int64()), pa.array(blobs, pa.binary())], names=["__part", "__weight", "__rows"]
    )


def _thawed(blob: bytes) -> tuple[pa.RecordBatch, pa.RecordBatch]:
    source = pa.BufferReader(pa.decompress(memoryview(blob)[8:], int.from_bytes(blob[:8], "little"), codec="zstd"))
    heads, values = (pa.ipc.open_stream(source).read_all().to_batches()[0] for _ in range(2))
    return heads, values


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[bytes], int]]:
    """The frozen rows of each part, still compressed, and their weight."""
    part, held, weight = None, [], 0
    for batch in batches:
        for p, w, blob in zip(*(c.to_pylist() for c in batch.columns)):
            if p != part and held:
                yield held, weight
                held, weight = [], 0
            part, weight = p, weight + w
            held.append(blob)
    if held:
        yield held, weight


def _chain(cols: list[pa.Array]) -> pa.Array:
    widest = max((c.type for c in cols), key=lambda t: (t.value_type if pa.types.is_list(t) else t).bit_width) if len({c.type for c in cols}) > 1 else cols[0].type
    return pa.concat_arrays([c if c.type == widest else c.cast(widest) for c in cols])


def opened(batches: Iterator[pa.RecordBatch], key_count: int):
    """Frozen rows sorted by part -> (rows with the key of each group, group of each span, values),
    about ``SPANS`` spans or one group at once.

    A part stays compressed while it is worked on.  What is too much of it at once is read in
    turns, the keys of a turn told apart by their hash."""
    for blobs, weight in _parts(batches):
        turns = min(TURNS, max(1, -(-weight // (4 * SPANS))))
        for turn in range(turns):
            heads, values = [], []
            for blob in blobs:
                head, rows = _thawed(blob)
                if turns > 1:
                    mine = np.asarray(head.column(key_count + 1)) % turns == turn
                    counts = numbers(head.column(key_count)).astype(np.int64)
                    rows = rows.take(pa.array(np.repeat(mine, counts).nonzero()[0]))
                    head = head.take(pa.array(mine.nonzero()[0]))
                heads.append(head)
                values.append(rows)
            yield from _groups(heads, values, key_count)


def _groups(heads: list[pa.RecordBatch], values: list[pa.RecordBatch], key_count: int):
    names, shown = heads[0].schema.names[:key_count], values[0].schema.names
    keys = [_widened(_chain([h.column(i) for h in heads]), n) for i, n in enumerate(names)]
    counts = np.concatenate([numbers(h.column(key_count)).astype(np.int64) for h in heads])
    cols = [_chain([v.column(i) for v in values]) for i in range(len(shown))]
    if not len(counts):
        return
    order = _by_key(keys)
    at = np.asarray(order)
    first, counts = (np.cumsum(counts) - counts)[at], counts[at]
    runs = pa.RecordBatch.from_arrays([k.take(order) for k in keys], names=[n.partition("|")[2] for n in names])
    starts = scans.key_starts(runs, key_count).nonzero()[0]
    rows, ends = _rows_of(first, counts), np.append(0, np.cumsum(counts))
    upto = np.append(0, np.cumsum(_weights(cols)[rows]))[ends]
    lo = 0
    while lo < len(starts):
        hi = max(lo + 1, int(np.searchsorted(upto[starts], upto[starts[lo]] + SPANS, "right")) - 1)
        if hi >= len(starts) or upto[-1] - upto[starts[lo]] <= SPANS:
            hi = len(starts)
        begin, end = int(starts[lo]), int(starts[hi]) if hi < len(starts) else len(counts)
        group = np.repeat(np.arange(hi - lo), np.add.reduceat(counts, starts)[lo:hi])
        take = pa.array(rows[ends[begin] : ends[end]])
        yield runs.take(pa.array(starts[lo:hi])), group, [_widened(c.take(take), n) for c, n in zip(cols, shown)]
        lo = hi


def thaw_batches(batches: Iterator[pa.RecordBatch], key_count: int, names: list[str]):
    """Frozen rows sorted by part -> the rows (keys..., values...), those of a key side by side."""
    for heads, group, cols in opened(batches, key_count):
        yield span_rows(heads, group, names[key_count:], cols)


def numbers(col: pa.Array, null=0) -> np.ndarray:
    return np.asarray(pc.fill_null(col, null) if col.null_count else col)


def span_rows(heads: pa.RecordBatch, group: np.ndarray, names: list[str], cols: list) -> pa.RecordBatch:
    take = pa.array(group)
    return pa.RecordBatch.from_arrays([*(c.take(take) for c in heads.columns), *cols], names=[*heads.schema.names, *names])


def _kept(fresh: list, starts_: list, ends_: list, labels: list) -> list[bool]:
    """The greedy choice over spans in order of rank, by sentence."""
    starts, ends, keep = [], [], []
    for new, s, e, label in zip(fresh, starts_, ends_, labels):
        if new:
            starts, ends = [], []
        if label == 0:
            keep.append(False)
            continue
        nxt = bisect_left(starts, s)
        if nxt < len(starts) and (ends[nxt] <= e or (starts[nxt] == s and ends[nxt] >= e)):
            keep.append(False)
            continue
        at = bisect_right(starts, s, nxt)
        if at > 0 and ends[at - 1] >= e:
            keep.append(False)
            continue
        starts.insert(at, s)
        ends.insert(at, e)
        keep.append(True)
    return keep


def _choice(group, s, e, label: pa.Array, confidence: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The spans ranked by sentence, confidence (9 digits), length, start, and which of them stay."""
    rank = -np.rint(numbers(confidence, np.inf).astype(np.float64) * 1e9)
    order = np.lexsort((s, s.astype(np.int64) - e, rank, group))
    g = group[order]
    fresh = np.ones(len(g), bool)
    fresh[1:] = g[1:] != g[:-1]
    keep = _kept(fresh.tolist(), s[order].tolist(), e[order].tolist(), numbers(label, -1)[order].tolist())
    return order, np.array(keep, dtype=bool)


def flat_packs(batches: Iterator[pa.RecordBatch], key_count: int, flag: bool):
    """Packs (keys..., s, e, label, confidence) sorted by key -> span rows, ranked by confidence
    (9 digits), length, start: a span stays unless it contains, or lies in, a span that stays.
    With ``flag`` all rows stay and get ``is_flat``; label 0 competes with nothing."""
    for heads, group, cols in opened(batches, key_count):
        order, keep = _choice(group, numbers(cols[0]), numbers(cols[1]), cols[2], cols[3])
        if not flag:
            order = order[keep]
        take = pa.array(order)
        out = [c.take(take) for c in cols]
        names = ["s", "e", "label", "confidence"]
        if flag:
            out, names = [*out, pa.array(keep)], [*names, "is_flat"]
        yield span_rows(heads, group[order], names, out)


#: What a span row is, as bits: prediction, gold, cluster, and one whose label counts in pairs.
PRED, GOLD, CLUSTER, NAMED = 1, 2, 4, 8


def _flat_bits(group, cols: list, null, f):
    """``f`` after the flat choice among the clusters: those that stay are predictions,
    they and the ones labelled 0 are named; and which those that stay are."""
    mine = (f & CLUSTER > 0).nonzero()[0]
    take = pa.array(mine)
    order, keep = _choice(group[mine], numbers(cols[0])[mine], numbers(cols[1])[mine], cols[2].take(take), cols[-1].take(take))
    stays = np.zeros(len(f), bool)
    stays[mine[order[keep]]] = True
    named = stays | ((f & CLUSTER > 0) & ~null & (numbers(cols[2], -1) == 0))
    f = f | np.where(stays, PRED, 0) | np.where(named, NAMED, 0)
    return f, stays


def _cells(group, s, e, label, null, order_by=()):
    """Order by sentence, span and label, and where a span and where a cell (span, label) starts."""
    order = np.lexsort((*order_by, label, null, e, s, group))
    s, e, label, null, group = (x[order] for x in (s, e, label, null, group))
    span = np.ones(len(s), bool)
    span[1:] = (s[1:] != s[:-1]) | (e[1:] != e[:-1]) | (group[1:] != group[:-1])
    cell = span.copy()
    cell[1:] |= (label[1:] != label[:-1]) | (null[1:] != null[:-1])
    return order, span, cell


def count_packs(batches: Iterator[pa.RecordBatch], key_count: int, flat=False, every=False):
    """Packs (keys..., s, e, label, f) sorted by key, f of the bits above -> per part and label:
    label, tp, fp, fn, n_gold, n_found.  With ``flat`` the predictions are chosen here among the
    clusters, whose confidence is one more column; with ``every`` all clusters with a label but 0 are."""
    for _, group, cols in opened(batches, key_count):
        s, e, label, f = (numbers(c, n) for c, n in zip(cols, (0, 0, -1, 0)))
        null = np.asarray(pc.is_null(cols[2]))
        if not len(s):
            continue
        if flat:
            f, stays = _flat_bits(group, cols, null, f)
            null = null | ((f & CLUSTER > 0) & ~stays)
            label = np.where(null, -1, label)
        if every:
            other = (f & CLUSTER > 0) & (null | (label == 0))
            f = f | np.where((f & CLUSTER > 0) & ~other, PRED, 0)
            null = null | other
            label = np.where(null, -1, label)
        order, span, cell = _cells(group, s, e, label, null)
        label, null, f = (x[order] for x in (label, null, f))
        at, spans = cell.nonzero()[0], span.nonzero()[0]
        cluster = np.maximum.reduceat(f & CLUSTER, spans)[(np.cumsum(span) - 1)[at]] > 0
        n_pred = np.add.reduceat((f & PRED).astype(np.int64), at)
        gold = np.maximum.reduceat(f & GOLD, at) > 0
        named = ~null[at]
        of, inverse = np.unique(label[at][named], return_inverse=True)
        n = lambda x: np.bincount(inverse, weights=x[named], minlength=len(of)).astype(np.int64)
        sums = [n(n_pred * gold), n(n_pred * ~gold), n(gold & (n_pred == 0)), n(gold), n(gold & cluster)]
        yield pa.RecordBatch.from_arrays(
            [pa.array(of.astype(np.int32)), *map(pa.array, sums)], names=["label", "tp", "fp", "fn", "n_gold", "n_found"]
        )


def state_packs(batches: Iterator[pa.RecordBatch], key_count: int, flat=False):
    """Packs (keys..., s, e, label, f, ord) sorted by key -> per part (kind, gold, pred, n) as
    ``operators.states`` has them.  With ``flat`` as above."""
    for _, group, cols in opened(batches, key_count):
        s, e, label, f = (numbers(c, n) for c, n in zip(cols, (0, 0, -1, 0)))
        ord_ = numbers(cols[4].cast(pa.int64()), -(1 << 62))
        null = np.asarray(pc.is_null(cols[2]))
        if not len(s):
            continue
        if flat:
            f, _ = _flat_bits(group, cols, null, f)
            null = null | ((f & (CLUSTER | NAMED)) == CLUSTER)
            label = np.where(null, -1, label)
        order, span, cell = _cells(group, s, e, label, null)
        label, null, f, ord_ = (x[order] for x in (label, null, f, ord_))
        at, spans = cell.nonzero()[0], span.nonzero()[0]
        span_of = np.cumsum(span) - 1
        whole = span_of[at]
        # the last gold row of each span: by place, then label, a null label first
        refs = (f & GOLD > 0).nonzero()[0]
        refs = refs[np.lexsort((label[refs], ~null[refs], ord_[refs], span_of[refs]))]
        ends = np.ones(len(refs), bool)
        ends[:-1] = span_of[refs][1:] != span_of[refs][:-1]
        last = np.full(len(spans), -1)
        last[span_of[refs[ends]]] = refs[ends]
        last = last[whole]
        last_known = (last >= 0) & ~null[np.maximum(last, 0)]
        last_label = np.where(last_known, label[np.maximum(last, 0)], 0)
        p = np.add.reduceat((f & PRED).astype(np.int64), at)
        q = np.add.reduceat((f & NAMED > 0).astype(np.int64), at)
        any_ = np.add.reduceat((f & NAMED > 0).astype(np.int64), spans)[whole]
        gold = np.maximum.reduceat(f & GOLD, at) > 0
        cluster = np.maximum.reduceat(f & CLUSTER, spans)[whole] > 0
        mine, here = ~null[at], label[at]
        unseen = (any_ == 0) & last_known & (last_label == here)
        zero = np.zeros(len(at), np.int64)
        kinds, golds, preds, ns = [], [], [], []
        for kind, n, of, pred in (
            ("tp", p * gold, here, None), ("fp", p * ~gold, here, None), ("fn", gold & (p == 0), here, None),
            ("gold", gold, here, None), ("found", gold & cluster, here, None), ("pair", q, last_label, here), ("pair", unseen, here, zero),
        ):
            some = mine & (n > 0)
            pairs = np.stack([of[some], (zero if pred is None else pred)[some]], axis=1).astype(np.int64)
            found, inverse = np.unique(pairs, axis=0, return_inverse=True)
            kinds += [kind] * len(found)
            golds += found[:, 0].tolist()
            preds += [None] * len(found) if pred is None else found[:, 1].tolist()
            ns += np.bincount(inverse.reshape(-1), weights=n[some], minlength=len(found)).astype(np.int64).tolist()
        out = [pa.array(kinds, pa.string()), pa.array(golds, pa.int32()), pa.array(preds, pa.int32()), pa.array(ns, pa.int64())]
        yield pa.RecordBatch.from_arrays(out, names=["kind", "gold", "pred", "n"])


def _product(left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places (i, j) of all pairs of equal values; ``right`` is sorted."""
    lo = np.searchsorted(right, left)
    n = np.searchsorted(right, left, "right") - lo
    again = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    return np.repeat(np.arange(len(left)), n), np.repeat(lo, n) + again


def cooccur_packs(batches: Iterator[pa.RecordBatch], key_count: int):
    """Packs (keys..., s, e, label, is_gold) sorted by key -> per part (gold, pred, n): how often
    a label of gold and one of the other spans share a span, 0 for labels that share a sentence only.
    Labels are counted per span first, so copies of a span are no pairs."""
    for heads, group, cols in opened(batches, key_count):
        if not len(group):
            continue
        s, e, label = (numbers(c, n) for c, n in zip(cols, (0, 0, -1)))
        gold, null = numbers(cols[3], False).astype(bool), np.asarray(pc.is_null(cols[2]))
        placed = np.asarray(pc.and_(pc.is_valid(cols[0]), pc.is_valid(cols[1]))) & _known(heads)[group]
        label = np.where(null, -(1 << 40), label.astype(np.int64))
        order, span, cell = _cells(group, s, e, label, null, (gold,))
        group_, label, gold, placed = (x[order] for x in (group, label, gold, placed))
        cell[1:] |= (gold[1:] != gold[:-1]) | (placed[1:] != placed[:-1])
        at = cell.nonzero()[0]
        n = np.diff(np.append(at, len(group_)))
        span_of, group_, label, gold, placed = (np.cumsum(span) - 1)[at], group_[at], label[at], gold[at], placed[at]
        a, b = (gold & placed).nonzero()[0], (~gold & placed).nonzero()[0]
        i, j = _product(span_of[a], span_of[b])
        parts = [(label[a[i]], label[b[j]], n[a[i]] * n[b[j]])]
        known = label > -(1 << 40)
        sets = [np.unique(np.stack([group_[x], label[x]], axis=1), axis=0) for x in (gold & known, ~gold & known)]
        i, j = _product(sets[0][:, 0], sets[1][:, 0])
        parts.append((sets[0][i, 1], sets[1][j, 1], np.zeros(len(i), np.int64)))
        g, p, n = (np.concatenate(x) for x in zip(*parts))
        found, inverse = np.unique(np.stack([g, p], axis=1), axis=0, return_inverse=True)
        sums = np.bincount(inverse.reshape(-1), weights=n, minlength=len(found)).astype(np.int64)
        names = [pa.array(np.maximum(c, -(1 << 31)).astype(np.int32), mask=c == -(1 << 40)) for c in (found[:, 0], found[:, 1])]
        yield pa.RecordBatch.from_arrays([*names, pa.array(sums)], names=["gold", "pred", "n"])


def parent_packs(batches: Iterator[pa.RecordBatch], key_count: int):
    """Packs (keys..., s, e, label, confidence) sorted by key -> span rows with their parent."""

    def ranked():
        for heads, group, cols in opened(batches, key_count):
            s, e, label = numbers(cols[0]), numbers(cols[1]), numbers(cols[2])
            order = np.lexsort((-label.astype(np.int64), -e.astype(np.int64), s, group))
            take = pa.array(order)
            yield span_rows(heads, group[order], ["s", "e", "label", "confidence"], [c.take(take) for c in cols])

    yield from scans.parent_batches(ranked(), key_count)


def _known(heads: pa.RecordBatch) -> np.ndarray:
    """True for the groups whose key has no null: only these meet others."""
    known = np.ones(heads.num_rows, bool)
    for c in heads.columns:
        known &= c.is_valid().to_numpy(zero_copy_only=False)
    return known


def missing_packs(batches: Iterator[pa.RecordBatch], key_count: int, names: list[str]):
    """Packs (keys..., s, e, is_gold, others...) sorted by key -> the rows that are not gold and
    whose span is not gold in their sentence."""
    for heads, group, cols in opened(batches, key_count):
        if not len(group):
            continue
        s, e, gold = numbers(cols[0]), numbers(cols[1]), numbers(cols[2], False)
        order = np.lexsort((~gold, e, s, group))
        g, a, b, gold_ = group[order], s[order], e[order], gold[order]
        fresh = np.ones(len(g), bool)
        fresh[1:] = (g[1:] != g[:-1]) | (a[1:] != a[:-1]) | (b[1:] != b[:-1])
        met = gold_[fresh.nonzero()[0]][np.cumsum(fresh) - 1] & _known(heads)[g]
        keep = order[~gold_ & ~met]
        keep.sort()
        take = pa.array(keep)
        yield span_rows(heads, group[keep], names, [c.take(take) for i, c in enumerate(cols) if i != 2])


def own_packs(batches: Iterator[pa.RecordBatch], key_count: int):
    """Rows (keys..., kind, s, e, ...), kind 0 a span and 1 a sentence -> the spans of the sentences."""
    for heads, group, cols in opened(batches, key_count):
        kind = numbers(cols[0])
        asked = np.zeros(heads.num_rows, bool)
        asked[group[kind == 1]] = True
        keep = ((kind == 0) & (asked & _known(heads))[group]).nonzero()[0]
        take = pa.array(keep)
        yield span_rows(heads, group[keep], ["s", "e"], [c.take(take) for c in cols[1:3]])


def winner_packs(batches: Iterator[pa.RecordBatch], key_count: int):
    """Rows (keys..., kind, s, e, text_key, salts), kind 0 a span and 2 the winner of a text -> each
    winner's (text_key, salts) with its spans as arrays ``s, e``, empty ones if it has none."""
    for heads, group, cols in opened(batches, key_count):
        kind = numbers(cols[0])
        texts, spans = (kind == 2).nonzero()[0], ((kind == 0) & _known(heads)[group]).nonzero()[0]
        if not len(texts):
            continue
        i, j = _product(group[texts], group[spans])
        offsets = pa.array(np.append(0, np.cumsum(np.bincount(i, minlength=len(texts)))).astype(np.int32))
        take, found = pa.array(texts), pa.array(spans[j])
        lists = [pa.ListArray.from_arrays(offsets, c.take(found)) for c in cols[1:3]]
        yield pa.RecordBatch.from_arrays([*(c.take(take) for c in cols[3:5]), *lists], names=["text_key", "salts", "s", "e"])


def frontier_packs(batches: Iterator[pa.RecordBatch], key_count: int, contained: bool):
    """Packs (keys..., s, e) beside ``is_gold``, sorted by key -> the other spans that lie in no
    gold span of their sentence (``contained``), or that contain none.  A span without a start
    stands before all others, one without an end meets nothing."""
    for batch in scans.whole_groups(batches, key_count):
        starts = scans.key_starts(batch, key_count).nonzero()[0]
        for part, first in _cut(batch, starts, key_count):
            counts = np.asarray(pc.fill_null(pc.list_value_length(part.column(key_count)), 0))
            row = np.repeat(np.arange(part.num_rows), counts)
            if not len(row):
                continue
            group = np.repeat(np.arange(len(first)), np.diff(np.append(first, part.num_rows)))[row]
            cols = [part.column(key_count + i).flatten() for i in (0, 1)]
            s, e = (numbers(c).astype(np.int64) for c in cols)
            s = np.where(np.asarray(pc.is_null(cols[0])), s.min() - 1, s)
            ended = np.asarray(pc.is_valid(cols[1]))
            gold = numbers(part.column(key_count + 2))[row].astype(bool) & ended
            low, wide = int(s.min()), int(s.max()) - int(s.min()) + 1
            if len(first) * wide >= 1 << 62:
                places, s = np.unique(s, return_inverse=True)
                low, wide = 0, len(places)
            place = group * wide + (s - low)
            refs = gold.nonzero()[0]
            refs = refs[np.argsort(place[refs], kind="stable")]
            mine = (~gold).nonzero()[0]
            # the running end in each sentence, which starts over with the next
            fresh = np.ones(len(refs), bool)
            fresh[1:] = group[refs][1:] != group[refs][:-1]
            rank = np.cumsum(fresh)
            levels, level = np.unique(e, return_inverse=True)
            if contained:
                far = np.maximum.accumulate(level[refs] + rank * len(levels)) - rank * len(levels)
                at = np.searchsorted(place[refs], place[mine], "right") - 1
            else:
                far = np.minimum.accumulate((level[refs] + rank * len(levels))[::-1])[::-1] - rank * len(levels)
                at = np.searchsorted(place[refs], place[mine])
            met = (at >= 0) & (at < len(refs))
            at = np.where(met, at, 0)
            if len(refs):
                met &= group[refs[at]] == group[mine]
                met &= (far[at] >= level[mine]) if contained else (far[at] <= level[mine])
            keep = mine[~(met & ended[mine])]
            take = pa.array(keep)
            yield span_rows(part.select(range(key_count)), row[keep], ["s", "e"], [c.take(take) for c in cols])


def wrong_packs(batches: Iterator[pa.RecordBatch], key_count: int):
    """Packs (keys..., s, e, label, is_gold) sorted by key -> the keys that have a prediction that
    is not gold, or gold that is not predicted."""
    for heads, group, cols in opened(batches, key_count):
        if not len(group):
            continue
        s, e, label, gold = (numbers(c, n) for c, n in zip(cols, (0, 0, -1, False)))
        order = np.lexsort((label, e, s, group))
        s, e, label, gold, group = (x[order] for x in (s, e, label, gold, group))
        cell = np.ones(len(s), bool)
        cell[1:] = (s[1:] != s[:-1]) | (e[1:] != e[:-1]) | (label[1:] != label[:-1]) | (group[1:] != group[:-1])
        at = cell.nonzero()[0]
        one_sided = np.logical_or.reduceat(gold, at) != np.logical_or.reduceat(~gold, at)
        yield heads.take(pa.array(np.unique(group[at][one_sided])))


def last_label_packs(batches: Iterator[pa.RecordBatch], key_count: int):
    """Packs (keys..., s, e, label, ord, is_gold) sorted by key -> the other spans with the label
    of the last gold row of their span, null if there is none."""
    for heads, group, cols in opened(batches, key_count):
        if not len(group):
            continue
        s, e, ord_, gold = (numbers(c, n) for c, n in zip((*cols[:2], *cols[3:]), (0, 0, -1, False)))
        order = np.lexsort((ord_, e, s, group))
        s, e, gold, group = (x[order] for x in (s, e, gold, group))
        fresh = np.ones(len(s), bool)
        fresh[1:] = (s[1:] != s[:-1]) | (e[1:] != e[:-1]) | (group[1:] != group[:-1])
        last = np.maximum.reduceat(np.where(gold, np.arange(len(s)), -1), fresh.nonzero()[0])[np.cumsum(fresh) - 1]
        found = (last >= 0) & _known(heads)[group]
        mine = ~gold
        label = cols[2].take(pa.array(order[np.maximum(last, 0)][mine], mask=~found[mine]))
        yield span_rows(heads, group[mine], ["s", "e", "label"], [pa.array(s[mine]), pa.array(e[mine]), label])


def extent_packs(batches: Iterator[pa.RecordBatch], key_count: int):
    """Frozen rows (keys..., word_ids) -> (keys..., word_id, first, last) per word."""
    for heads, group, cols in opened(batches, key_count):
        counts = np.asarray(pc.fill_null(pc.list_value_length(cols[0]), 0))
        word = numbers(cols[0].flatten(), -1).astype(np.int64)
        tok = np.arange(len(word)) - np.repeat(np.cumsum(counts) - counts, counts)
        group = np.repeat(group, counts)
        word, tok, group = (x[word >= 0] for x in (word, tok, group))
        if not len(word):
            continue
        order = np.lexsort((tok, word, group))
        word, tok, group = word[order], tok[order], group[order]
        fresh = np.ones(len(word), bool)
        fresh[1:] = (word[1:] != word[:-1]) | (group[1:] != group[:-1])
        at = fresh.nonzero()[0]
        ends = np.append(at[1:], len(word)) - 1
        cols = [pa.array(x.astype(np.int32)) for x in (word[at], tok[at], tok[ends])]
        yield span_rows(heads, group[at], ["word_id", "first", "last"], cols)


def token_packs(batches: Iterator[pa.RecordBatch], key_count: int, names: list[str]):
    """Packs (keys..., s, e, last, is_word, others...) sorted by key; a word has its id as s and
    its first token as e -> the spans (keys..., s, e, others..., tok_s, tok_e): one per pair of a
    word at the start and one at the end."""
    for heads, group, cols in opened(batches, key_count):
        if not len(group):
            continue
        s, e, last = (numbers(c).astype(np.int64) for c in cols[:3])
        word = numbers(cols[3], False)
        mine = (~word & _known(heads)[group]).nonzero()[0]
        words = word.nonzero()[0]
        if not len(mine) or not len(words):
            continue
        low = min(int(s[words].min()), int(s[mine].min()))
        wide = max(int(s[words].max()), int(e[mine].max()), int(s[mine].max())) - low + 1
        code = group[words] * wide + (s[words] - low)
        order = np.argsort(code, kind="stable")
        code, words = code[order], words[order]

        def met(rows, at):
            """Each row once per word at its place: the rows, and those words."""
            fits = (at >= low) & (at - low < wide)
            rows, key = rows[fits], group[mine[rows[fits]]] * wide + (at[fits] - low)
            lo, n = np.searchsorted(code, key), np.searchsorted(code, key, "right") - np.searchsorted(code, key)
            again = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            return np.repeat(rows, n), words[np.repeat(lo, n) + again]

        rows, first = met(np.arange(len(mine)), s[mine])
        both, ends = met(rows, e[mine[rows]])
        # as often as a row found an end, its starts are repeated
        n = np.bincount(both, minlength=len(mine)) // np.maximum(np.bincount(rows, minlength=len(mine)), 1)
        starts = np.repeat(first, n[rows])
        at = mine[both]
        take = pa.array(at)
        out = [c.take(take) for i, c in enumerate(cols) if i not in (2, 3)]
        out += [pa.array(e[starts].astype(np.int32)), pa.array(last[ends].astype(np.int32))]
        yield span_rows(heads, group[at], [*names, "tok_s", "tok_e"], out)


def word_packs(batches: Iterator[pa.RecordBatch], key_count: int, names: list[str], whole: bool):
    """Packs (keys..., word_ids, is_ids, tok_s, tok_e, others...): spans, and the word ids of sentences
    -> rows (keys..., tok_s, tok_e, others...), once per row of ids that their sentence has: with
    ``whole`` those that cut no word, else all with the words ``s, e`` at their borders."""
    for heads, group, cols in opened(batches, key_count):
        ids, is_ids = cols[0], numbers(cols[1], False)
        known = _known(heads)[group]
        mine, theirs = (~is_ids & known).nonzero()[0], (is_ids & known).nonzero()[0]
        i, j = _product(group[mine], group[theirs])
        if not len(i):
            continue
        mine, theirs = mine[i], theirs[j]
        lengths = np.asarray(pc.fill_null(pc.list_value_length(ids), 0)).astype(np.int64)
        begin, words = (np.cumsum(lengths) - lengths)[theirs], ids.flatten()
        lengths, take = lengths[theirs], pa.array(mine)
        spans = [c.take(take) for c in cols[2:]]

        def word(at, step=0):
            place = numbers(spans[at], -2).astype(np.int64) + step
            bad = (place < 0) | (place >= lengths)
            return words.take(pa.array(np.where(bad, 0, begin + place), mask=bad))

        row = group[mine]
        if whole:
            keep = np.ones(len(row), bool)
            for at, step in ((0, -1), (1, 1)):
                here, beyond = word(at), word(at, step)
                other = pc.fill_null(pc.not_equal(here, beyond), True)
                keep &= pc.and_(pc.fill_null(pc.greater_equal(here, 0), False), other).to_numpy(zero_copy_only=False)
            take = pa.array(keep.nonzero()[0])
            out, row, shown = [c.take(take) for c in spans], row[keep], names
        else:
            out, shown = [*spans, word(0), word(1)], [*names, "s", "e"]
        yield span_rows(heads, row, shown, out)


def first_batches(batches: Iterator[pa.RecordBatch], key_count: int, order: list[str], limit: int):
    """Of every run of a key in a batch the ``limit`` least rows; the least of all are among them."""
    for batch in batches:
        if not batch.num_rows:
            continue
        group = np.cumsum(scans.key_starts(batch, key_count))
        ranked = np.lexsort((*(numbers(batch.column(c), -(1 << 31)) for c in reversed(order)), group))
        g = group[ranked]
        fresh = np.ones(len(g), bool)
        fresh[1:] = g[1:] != g[:-1]
        at = fresh.nonzero()[0]
        rank = np.arange(len(g)) - at[np.cumsum(fresh) - 1]
        yield batch.take(pa.array(ranked[rank < limit]))
