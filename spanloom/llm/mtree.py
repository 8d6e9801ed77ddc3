"""Exact top-k search with an M-tree: paged metric nodes, covering radii, parent distances.

The score is an inner product, the metric of the tree is Euclidean.  For a node with centre
o and radius r, every vector x in it has <q, x> = <q, o> + <q, x - o> <= <q, o> + |q| r.  A
child's distance to its parent p bounds <q, o> by <q, p> + |q| d(o, p) without computing it."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written

FAN = 16  # children of a node
PAGE_ROWS = 256  # entries of a leaf page at most
LEVELS = 40
DEAL_ROWS = 1 << 14  # vectors of a node that one task deals
QUERY_BLOCK = 16  # small, so that an Arrow batch of blocks is too
GROUP_PAGES = 64  # pages searched together, under one root
SLACK = 1e-9


def whole_numbers(v: Column, scale: int = 256) -> Column:
    """floor(scale * x) per component; null if a component is null or not finite, or if the
    vector is."""
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.when(F.coalesce(fine, F.lit(False)), F.transform(v, lambda x: F.floor(x.cast("double") * scale).cast("long")))


def _matrix(values, width: int) -> np.ndarray:
    """Rows of one width; a shorter vector is filled with zeros."""
    out = np.zeros((len(values), width), np.float64)
    for i, v in enumerate(values):
        out[i, : len(v)] = v
    return out


def _nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    near = np.empty(len(x), np.int64)
    for i in range(0, len(x), 4096):
        part = x[i : i + 4096]
        near[i : i + 4096] = (((part**2).sum(1)[:, None] - 2 * part @ centres.T) + (centres**2).sum(1)).argmin(1)
    return near


def _dealt(key, rows: pd.DataFrame, centres: pd.DataFrame) -> pd.DataFrame:
    """A share of a node's vectors -> the child whose centre is nearest."""
    if not len(rows):
        return rows[["row", "id", "v", "node"]]
    width = max(map(len, [*rows["v"], *centres["centre"]]))
    near = _nearest(_matrix(rows["v"], width), _matrix(sorted(map(tuple, centres["centre"])), width))
    return rows.assign(node=[f"{n}.{c}" for n, c in zip(rows["node"], near)])[["row", "id", "v", "node"]]


def _page(group: pd.DataFrame) -> pd.DataFrame:
    """One leaf page: the entry nearest the mean is its centre; entries by distance to it."""
    width = max(map(len, group["v"]))
    x = _matrix(group["v"], width)
    mean = x.mean(axis=0)
    centre = x[((x - mean) ** 2).sum(1).argmin()]
    away = np.sqrt(((x - centre) ** 2).sum(1))
    order = np.lexsort((group["id"].to_numpy(), away))
    return pd.DataFrame(
        [{
            "node": group["node"].iloc[0], "page": int(group["page"].iloc[0]), "width": width,
            "centre": centre.tobytes(), "radius": float(away.max()),
            "ids": group["id"].to_numpy(np.int64)[order].tobytes(), "entries": x[order].astype("<f8").tobytes(),
            "away": away[order].tobytes(),
        }]
    )


PAGE = "node string, page long, width int, centre binary, radius double, ids binary, entries binary, away binary"
PAGE_COLUMNS = "node page width centre radius ids entries away".split()


def _sizes(rows: DataFrame, page_rows: int) -> DataFrame:
    """Nodes of more than a page that hold different vectors: two of them, and the shares the
    node is dealt in."""
    hashed = F.struct(F.xxhash64("v").alias("h"), "v")
    sizes = rows.groupBy("node").agg(F.count("*").alias("n"), F.min(hashed).alias("lo"), F.max(hashed).alias("hi"))
    full = sizes.filter((F.col("n") > page_rows) & (F.col("lo.h") != F.col("hi.h")))
    return full.select("node", F.ceil(F.col("n") / DEAL_ROWS).alias("salts"), F.col("lo.v").alias("lo"), F.col("hi.v").alias("hi"))


def _grown(rows: DataFrame, full: DataFrame, fan: int) -> DataFrame:
    """Every vector of a node in ``full`` to the nearest of the node's children."""
    marked = rows.join(full.select("node", "salts"), "node", "left")
    done = marked.filter("salts IS NULL").select("row", "id", "v", "node")
    salted = marked.filter("salts IS NOT NULL")
    first = Window.partitionBy("node").orderBy(F.xxhash64("row"), "row")
    drawn = salted.select("node", "v", "row").withColumn("r", F.row_number().over(first)).filter(F.col("r") <= fan - 2)
    two = full.select("node", F.explode(F.array("lo", "hi")).alias("v"))
    centres = drawn.select("node", "v").unionByName(two).distinct().join(full.select("node", "salts"), "node")
    every = F.explode(F.sequence(F.lit(0).cast("long"), F.col("salts") - 1))
    centres = centres.select(F.col("node").alias("at"), F.col("v").alias("centre"), every.alias("share"))
    salted = salted.withColumn("salt", F.pmod(F.xxhash64("row"), F.col("salts")))
    dealt = salted.groupBy("node", "salt").cogroup(centres.groupBy("at", "share")).applyInPandas(_dealt, "row long, id long, v array<long>, node string")
    return done.unionByName(dealt)


def build(vectors: DataFrame, fan: int = FAN, page_rows: int = PAGE_ROWS) -> DataFrame:
    """Leaf pages of all vectors (``id``, ``v``), grown from the root.

    A node with more than ``page_rows`` vectors gets at most ``fan`` children, centred at
    vectors of it (drawn by hash, two of them different), and each of its vectors goes to the
    nearest one; so again until every node is a page.  Height follows the number of rows.  A
    node is dealt in shares of ``DEAL_ROWS``.  What does not part (equal vectors, or a node
    ``LEVELS`` deep) is cut into pages by hash.  Each level is written."""
    rows = written(vectors.select(F.monotonically_increasing_id().alias("row"), "id", "v", F.lit("0").alias("node")), "level")
    for _ in range(LEVELS):
        full = written(_sizes(rows, page_rows), "nodes")
        if not full.limit(1).count():
            break
        rows = written(_grown(rows, full, fan), "level")
    sizes = rows.groupBy("node").agg(F.ceil(F.count("*") / page_rows).alias("cut"))
    rows = rows.join(sizes, "node").withColumn("page", F.pmod(F.xxhash64("row"), F.col("cut")))
    # a placement by node alone would put all pages of equal vectors into one task
    return rows.repartition("node", "page").groupBy("node", "page").applyInPandas(_page, PAGE)


class Best:
    """The k best (score, id) so far: higher scores, then smaller ids."""

    def __init__(self, k: int):
        self.k, self.score, self.id = k, np.empty(0), np.empty(0, np.int64)

    def floor(self) -> float:
        return self.score[-1] if len(self.score) == self.k else -np.inf

    def add(self, score: np.ndarray, ids: np.ndarray) -> None:
        s, i = np.concatenate((self.score, score)), np.concatenate((self.id, ids))
        order = np.lexsort((i, -s))[: self.k]
        self.score, self.id = s[order], i[order]


class PageIndex:
    """Some pages under their tree: leaves with entries, above them nodes by common ancestors.

    A node's centre is the mean of its children's, its radius covers them; each child keeps
    its distance to the parent's centre."""

    def __init__(self, pages: pd.DataFrame):
        self.width = int(pages["width"].max())
        self.leaves, self.kids, self.centre, self.radius, self.apart = {}, {}, [], [], []
        for w, c, r, e, i, a in zip(*(pages[k] for k in ("width", "centre", "radius", "entries", "ids", "away"))):
            n = self._node(_matrix([np.frombuffer(c, "<f8")], self.width)[0], r)
            self.leaves[n] = (_matrix(np.frombuffer(e, "<f8").reshape(-1, w), self.width), np.frombuffer(i, "<i8"), np.frombuffer(a, "<f8"))
        paths = [p.split(".") for p in pages["node"]]
        self.root = self._above(list(range(len(paths))), paths, 0)
        self.centre, self.radius, self.apart = np.array(self.centre), np.array(self.radius), np.array(self.apart)

    def _node(self, centre: np.ndarray, radius: float) -> int:
        self.centre.append(centre), self.radius.append(radius), self.apart.append(0.0)
        return len(self.centre) - 1

    def _above(self, below: list[int], paths: list[list[str]], depth: int) -> int:
        if len(below) == 1:
            return below[0]
        groups: dict[str | None, list[int]] = {}
        while True:  # down to where the paths part
            groups = {}
            for n in below:
                groups.setdefault(paths[n][depth] if depth < len(paths[n]) else None, []).append(n)
            if len(groups) > 1 or None in groups:
                break
            depth += 1
        ends = groups.pop(None, [])
        kids = ends + [self._above(g, paths, depth + 1) for g in groups.values()]
        centre = np.mean([self.centre[k] for k in kids], axis=0)
        away = [float(np.sqrt(((self.centre[k] - centre) ** 2).sum())) for k in kids]
        for k, d in zip(kids, away):
            self.apart[k] = d
        n = self._node(centre, max(d + self.radius[k] for k, d in zip(kids, away)))
        self.kids[n] = np.array(kids)
        return n

    def search(self, queries: np.ndarray, k: int) -> tuple[list[tuple[np.ndarray, np.ndarray]], int]:
        """Best-first search for each query: its k best scores and ids, and how many products
        with entries all took.

        Nodes wait in a heap by their bound <q, o> + |q| r; the first that cannot reach the
        k-th best ends the search.  A node's product with its parent and the stored distance
        decide before its own product is made, an entry's distance to the centre likewise."""
        q = _matrix(queries, max(self.width, queries.shape[1]))
        short = self.centre.shape[1]
        norms = np.sqrt((q**2).sum(1))
        reach = np.abs(self.centre).max(initial=0) + self.radius.max(initial=0)
        out, computed = [], 0
        for v, norm in zip(q[:, :short], norms):
            best, eps = Best(k), SLACK * (1 + norm * reach)
            dot = float(v @ self.centre[self.root])
            heap = [(-(dot + norm * self.radius[self.root]), self.root, dot)]
            while heap:
                bound, n, dot = heapq.heappop(heap)
                if -bound + eps < best.floor():
                    break
                if n in self.leaves:
                    entries, ids, away = self.leaves[n]
                    fit = dot + norm * away + eps >= best.floor()
                    computed += int(fit.sum())
                    if fit.any():
                        best.add(entries[fit] @ v, ids[fit])
                    continue
                kids = self.kids[n]
                kids = kids[dot + norm * (self.apart[kids] + self.radius[kids]) + eps >= best.floor()]
                dots = self.centre[kids] @ v
                for c, d in zip(kids.tolist(), dots.tolist()):
                    heapq.heappush(heap, (-(d + norm * self.radius[c]), c, d))
            out.append((best.score, best.id))
        return out, computed


def _searched(k: int):
    """Rows of a group of pages, then its query blocks: the pages become an index, the blocks
    pass one by one."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        grp, pages, index = None, [], None
        for b in batches:
            rows = []
            for r in b.itertuples():
                if r.grp != grp:
                    grp, pages, index = r.grp, [], None
                if r.kind == 0:
                    pages.append(r)
                    continue
                if not pages:
                    continue
                index = index or PageIndex(pd.DataFrame(pages))
                ids = np.frombuffer(r.ids, "<i8")
                found, _ = index.search(np.frombuffer(r.entries, "<f8").reshape(len(ids), -1), k)
                for n, (score, vec) in enumerate(found):
                    rows += [(r.page, n, int(ids[n]), int(i), int(s)) for s, i in zip(score, vec)]
            yield pd.DataFrame(rows, columns=["block", "n", "query_id", "vec_id", "score"]).astype("int64")

    return run


def _blocks(group: pd.DataFrame) -> pd.DataFrame:
    x = _matrix(group["v"], max(map(len, group["v"])))
    block = int(group["block"].iloc[0])
    return pd.DataFrame([{"page": block, "width": x.shape[1], "ids": group["id"].to_numpy("<i8").tobytes(), "entries": x.astype("<f8").tobytes(), "own": (x * x).sum(1).astype("<i8").tobytes()}])


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5, fan: int = FAN, page_rows: int = PAGE_ROWS) -> DataFrame:
    """``query_id``, ``rank``, ``vec_id``, ``score``: for each query (``id``, ``v``), a row of
    the vectors, the ``k`` others with the largest inner products; ties go to the smaller id;
    all of them if there are fewer.

    Components are whole numbers below 2^20 or so, for which products in doubles are exact.
    Pages are searched in groups, query blocks go to every group: the work is a stated set of
    queries against all rows, in blocks.  A task holds one group of pages and the blocks of an
    Arrow batch; k + 1 rows a query and group come out.  Rows that share an id are rows of
    their own: each query row has its own k, and only itself is left out, so an id may be
    among the results of its own other rows.  Rows with a null id or vector take no part;
    shorter vectors count as filled with zeros; an empty side gives an empty table."""
    usable = lambda df: df.select(F.col("id").cast("long").alias("id"), "v").filter("id IS NOT NULL AND v IS NOT NULL AND size(v) > 0")
    pages = written(build(usable(vectors), fan, page_rows), "pages")
    groups = max(1, -(-pages.count() // GROUP_PAGES))
    queries = usable(queries)
    n_blocks = max(1, -(-queries.count() // QUERY_BLOCK))
    # rows of one id must not share a block, which may hold a third of all queries
    dealt = F.pmod(F.xxhash64("id", F.monotonically_increasing_id()), F.lit(n_blocks))
    blocks = written(
        queries.withColumn("block", dealt).groupBy("block").applyInPandas(_blocks, "page long, width int, ids binary, entries binary, own binary"),
        "queries",
    )
    # pages of one part of the tree stay together
    ranged = pages.repartitionByRange(groups, "node", "page").withColumn("grp", F.spark_partition_id())
    none = lambda t: F.lit(None).cast(t)
    left = ranged.select("grp", F.lit(0).alias("kind"), *PAGE_COLUMNS)
    right = blocks.withColumn("grp", F.explode(F.sequence(F.lit(0), F.lit(groups - 1)))).select(
        "grp", F.lit(1).alias("kind"), none("string").alias("node"), "page", "width", none("binary").alias("centre"),
        none("double").alias("radius"), "ids", "entries", none("binary").alias("away"),
    )
    both = left.unionByName(right).repartition("grp").sortWithinPartitions("grp", "kind")
    found = both.mapInPandas(_searched(k + 1), "block long, n long, query_id long, vec_id long, score long")
    own = blocks.select(F.col("page").alias("block"), "own").mapInPandas(_own_scores, "block long, n long, own long")
    # of the rows with the query's id and its product with itself one is the query's own
    itself = (F.col("vec_id") == F.col("query_id")) & (F.col("score") == F.col("own"))
    order = Window.partitionBy("block", "n").orderBy(F.desc("score"), "vec_id")
    seen = F.sum(itself.cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0))
    ranked = found.withColumn("r", F.row_number().over(order)).filter(F.col("r") <= k + 1).join(own, ["block", "n"])
    ranked = ranked.withColumn("drop", itself & (seen == 1)).filter(~F.col("drop"))
    ranked = ranked.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


def _own_scores(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Each query's product with itself."""
    for b in batches:
        own = [np.frombuffer(x, "<i8") for x in b["own"]]
        sizes = [len(x) for x in own]
        yield pd.DataFrame(
            {"block": np.repeat(b["block"].to_numpy(), sizes), "n": np.concatenate([np.arange(n) for n in sizes] or [[]]), "own": np.concatenate(own or [[]])}
        ).astype("int64")


def op6_mtree_search(spark, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    vectors = rows.select(F.col("vec_id").alias("id"), whole_numbers(F.col("embedding")).alias("v"))
    return top_k(vectors, vectors.filter("id % 50 = 0"))


#: DuckDB counterpart of the registered query.
SQL = """
WITH v AS (
  SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * 256) AS BIGINT)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.r, q.vec_id AS query_id, c.vec_id AS vec_id,
         CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: coalesce(p[1] * p[2], 0))) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.r <> q.r),
ranked AS (SELECT *, row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM ranked WHERE rank <= 5
"""
