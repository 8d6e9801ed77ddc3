"""Near-duplicates by SimHash: fingerprints are compared at the anchors of a covering code."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import appended, text_of, written
from .components import connected

SHINGLE = 3
MAX_BITS = 3
SEED = 42
HOMES_PER_CELL = 4096
PIECE = 1 << 16  # shingles whose bits are counted at once


def fingerprint(text: str, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """64 bits: one is set if it is set in over half the hashes of the text's shingles.

    Lower-casing touches A-Z only and words are parted by ASCII white space, which is what
    the methods of bytes do.  A text of fewer words is one shingle; without words: 0."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    if len(words) > shingle:
        starts, ends = starts[: 1 - shingle], ends[shingle - 1 :]
    else:
        starts, ends = starts[:1], ends[-1:]
    counts = np.zeros(64, np.int64)
    for i in range(0, len(starts), PIECE):
        cut = zip(starts[i : i + PIECE].tolist(), ends[i : i + PIECE].tolist())
        h = np.fromiter((xxhash.xxh64_intdigest(joined[a:b], seed) for a, b in cut), np.uint64)
        bits = np.unpackbits(h.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(starts), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, seed: int = SEED, text: str = "text") -> DataFrame:
    """``docs`` with the text replaced by ``fp`` (long; null texts count as empty)."""
    kept = [c for c in docs.columns if c not in (text, "fp")]

    def start():
        return lambda texts: (np.array([fingerprint(t, shingle, seed) for t in texts], np.uint64).view(np.int64),)

    rows = docs.select(*kept, text_of(text).alias("__t"))
    return appended(rows, kept, ["__t"], {"fp": ("long", pa.int64())}, start)


def _pairs_by_xor() -> np.ndarray:
    """For each s in 1..31 the masks of the 15 position pairs (i < j) with i xor j = s."""
    out = np.zeros((32, 15), np.uint64)
    for s in range(1, 32):
        out[s] = [(1 << (i - 1)) | (1 << ((i ^ s) - 1)) for i in range(1, 32) if i < i ^ s]
    return out


def anchors(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, anchor, home) of every anchor that a fingerprint is sent to.

    Fingerprints at most three bits apart differ in at most one bit of one of their two
    32-bit halves.  The anchors of a half are the words of a covering code: the perfect
    Hamming code of 31 bits, times one free bit.  Its covering radius is 1, so each half has
    one home anchor within 1; its partner at distance 1 is within 2 of that anchor and is
    sent there, since it goes to every anchor within 1 + 1: the home, the same with the free
    bit turned, and (off the code) 15 words at distance 2."""
    fp = fp.view(np.uint64)
    pairs = _pairs_by_xor()
    one = np.uint64(1)
    rows, keys, homes = [], [], []
    index = np.arange(len(fp))
    for half in (0, 1):
        x = (fp >> np.uint64(32 * half)) & np.uint64(0xFFFFFFFF)
        free, word = x & np.uint64(1 << 31), x & np.uint64((1 << 31) - 1)
        syndrome = np.zeros(len(fp), np.uint64)
        for i in range(1, 32):
            syndrome ^= ((word >> np.uint64(i - 1)) & one) * np.uint64(i)
        off = syndrome > 0
        code = word ^ np.where(off, one << (syndrome - off), np.uint64(0))
        tag = np.uint64(half << 32)
        far = word[off, None] ^ pairs[syndrome[off].astype(np.int64)]
        for r, a, h in (
            (index, code | free, True),
            (index, code | (free ^ np.uint64(1 << 31)), False),
            (np.repeat(index[off], 15), (far | free[off, None]).ravel(), False),
        ):
            rows.append(r)
            keys.append(a | tag)
            homes.append(np.full(len(r), h))
    return np.concatenate(rows), np.concatenate(keys).view(np.int64), np.concatenate(homes)


def _at_anchors(fps: DataFrame) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            fp = b["fp"].to_numpy(np.int64)
            row, key, home = anchors(fp)
            yield pd.DataFrame({"key": key, "fp": fp[row], "home": home})

    return fps.select("fp").mapInPandas(run, "key long, fp long, home boolean")


def _cell_links(max_bits: int):
    """Streams the rows of sorted cells: homes first, then the other fingerprints."""

    class Cell:
        def __init__(self):
            self.homes = np.empty(0, np.int64)
            self.label = np.empty(0, np.int64)

        def feed(self, fp: np.ndarray, home: np.ndarray) -> list[tuple[int, int]]:
            """Links that tie these rows to the homes they are near; homes that share a
            near row get one label, so at most rows + homes links come out of a cell."""
            new = fp[home]
            if len(new):
                self.label = np.concatenate((self.label, np.arange(len(self.homes), len(self.homes) + len(new))))
                self.homes = np.concatenate((self.homes, new))
            if not len(self.homes):
                return []
            out, step = [], max(1, (1 << 20) // len(self.homes))
            for i in range(0, len(fp), step):
                block = fp[i : i + step]
                near = np.bitwise_count((block[:, None] ^ self.homes[None, :]).view(np.uint64)) <= max_bits
                for r in np.flatnonzero(near.any(axis=1)):
                    at = np.flatnonzero(near[r])
                    labels, first = np.unique(self.label[at], return_index=True)
                    out += [(int(block[r]), int(h)) for h in self.homes[at[first]] if h != block[r]]
                    if len(labels) > 1:
                        self.label[np.isin(self.label, labels)] = labels[0]
            return out

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, cell = None, Cell()
        for b in batches:
            key, sub = b["key"].to_numpy(), b["cell"].to_numpy()
            fp, home = b["fp"].to_numpy(np.int64), b["home"].to_numpy(bool)
            cuts = np.flatnonzero((key[1:] != key[:-1]) | (sub[1:] != sub[:-1])) + 1
            starts = np.concatenate(([0], cuts)) if len(key) else np.empty(0, np.int64)
            ends = np.concatenate((cuts, [len(key)])) if len(key) else starts
            # a cell inside the batch matters only if it has a home and another row
            inside = (starts > 0) & (ends < len(key))
            some = home[starts] & (ends - starts > 1) if len(key) else inside
            links: list[tuple[int, int]] = []
            for s, e in zip(starts[~inside | some].tolist(), ends[~inside | some].tolist()):
                name = (key[s], sub[s])
                if name != current:
                    current, cell = name, Cell()
                links += cell.feed(fp[s:e], home[s:e])
            if links:
                yield pd.DataFrame(links, columns=["a", "b"])

    return run


def links(fps: DataFrame, max_bits: int = MAX_BITS, per_cell: int = HOMES_PER_CELL) -> DataFrame:
    """``a``, ``b``: links that connect all distinct fingerprints (``fp``) at most
    ``max_bits`` (3 or fewer) bits apart; not every near pair, but no connection is lost.

    An anchor that is home to more than ``per_cell`` fingerprints is split: its homes go to
    cells by hash, and every fingerprint near it goes to each of these cells.  A task holds
    the homes of one cell and streams the rest."""
    if not 0 <= max_bits <= 3:
        raise ValueError("two halves with one differing bit cover 3 differing bits at most")
    at = _at_anchors(fps)
    crowded = at.filter("home").groupBy("key").count().filter(F.col("count") > per_cell)
    crowded = crowded.select("key", F.ceil(F.col("count") / per_cell).alias("k"))
    rows = at.join(crowded, "key", "left").withColumn("k", F.coalesce("k", F.lit(1)))
    rows = rows.withColumn("cell", F.explode(F.sequence(F.lit(0).cast("long"), F.col("k") - 1)))
    rows = rows.withColumn("home", F.col("home") & (F.col("cell") == F.pmod(F.xxhash64("fp"), "k")))
    rows = rows.select("key", "cell", "fp", "home").repartition("key", "cell")
    rows = rows.sortWithinPartitions("key", "cell", F.desc("home"))
    return rows.mapInPandas(_cell_links(max_bits), "a long, b long")


def near_duplicates(
    docs: DataFrame, shingle: int = SHINGLE, max_bits: int = MAX_BITS, text: str = "text", id_col: str = "doc_id"
) -> DataFrame:
    """All columns of ``docs`` but the text, plus ``fp`` and ``component_id``, the smallest id
    that is reachable over links.

    Documents with one fingerprint meet as one row before anything is compared, so groups of
    copies of any size cost nothing more.  A null or blank text has fingerprint 0 and is linked
    like any other; null ids are passed over in the minimum; repeated rows stay; an empty
    table gives an empty one.  Texts of any length are hashed whole, in pieces."""
    tagged = written(fingerprints(docs.drop("component_id"), shingle, text=text), "fingerprints")
    fps = written(tagged.groupBy("fp").agg(F.min(id_col).alias("__least")), "distinct")
    roots = connected(links(fps, max_bits)).withColumnsRenamed({"node": "fp", "root": "__root"})
    rooted = fps.join(roots, "fp", "left").withColumn("__root", F.coalesce("__root", "fp"))
    least = rooted.groupBy("__root").agg(F.min("__least").alias("component_id"))
    of = rooted.join(least, "__root").select("fp", "component_id")
    return tagged.join(of.hint("merge"), "fp")


def one_of_each(docs: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """``docs`` with one row of each component: the one with the smallest id (a null id comes
    last; of rows with equal ids any one)."""
    pinned = written(docs.withColumn("__id", F.monotonically_increasing_id()), "dedup")
    order = F.struct(F.col(id_col).isNull().alias("n"), F.col(id_col).alias("i"), F.col("__id").alias("r"))
    slim = pinned.select(F.struct("__id").alias("row"), order.alias("__order"), "text")
    found = near_duplicates(slim, id_col="__order", **options)
    kept = found.filter(F.col("__order") == F.col("component_id")).select(F.col("row")["__id"].alias("__id"))
    return pinned.join(kept.hint("merge"), "__id", "left_semi").select(*docs.columns)


def op5_simhash_dedup(spark, sf_dir: str) -> DataFrame:
    found = near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
