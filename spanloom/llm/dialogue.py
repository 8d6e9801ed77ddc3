"""Conversation structure repair: the cheapest edits that give system? (user assistant)+.

Nodes of a conversation's edit lattice are (turns passed, role state); edges keep, rerole or
delete a turn or insert one.  Bidirectional Dijkstra finds the cheapest paths and, among
them, the least string of edits.

Turns are sorted by range over (conversation, turn), so a long conversation spreads over
partitions.  Each task cuts its turns into segments of bounded size.  A conversation that
lies whole in one segment is done there.  Of others, each segment gets the costs between all
role states at its two ends; a backward pass over those few numbers gives every segment the
cost that remains behind it, and a forward pass chooses and hashes segment by segment."""

from __future__ import annotations

import hashlib
import heapq
import re
from collections.abc import Iterator
from itertools import chain

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import written

#: Turns of a segment.
SEGMENT = 4096

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 2, 3, 2, 1  # costs
EMPTY, SYSTEM, USER, ASSISTANT = range(4)  # role states: the last role so far
_NEXT = {"s": {EMPTY: SYSTEM}, "u": {EMPTY: USER, SYSTEM: USER, ASSISTANT: USER}, "a": {USER: ASSISTANT}}
_FORCED = (USER, USER, ASSISTANT, USER)  # where an inserted or reroled turn leads
_ROLE = {USER: "user", ASSISTANT: "assistant"}
_ACCEPT = {EMPTY: 0, ASSISTANT: 0}
_INK = re.compile(r"[^\x20\x09-\x0D]")
_INF = float("inf")


class Turn:
    """A turn, or ``copies`` equal ones that have to go."""

    __slots__ = ("role", "text", "fault", "copies", "goes")

    def __init__(self, role: str, text: str, fault: str, copies: int):
        self.role, self.text, self.fault, self.copies = role, text, fault, copies
        self.goes = fault in ("blank", "duplicate")


def turns_of(role: str, text: str, copies: int, seen: bool) -> list[Turn]:
    """Equal neighbours as turns with their first fault."""
    ink = _INK.findall(text)
    if not ink:
        return [Turn(role, text, "blank", copies)]
    if seen:
        return [Turn(role, text, "duplicate", copies)]
    first = Turn(role, text, "" if ink[-1] in ".!?" else "truncated", 1)
    return [first, Turn(role, text, "duplicate", copies - 1)] if copies > 1 else [first]


def _edges(turns: list[Turn], i: int, q: int, inserts_at_end: bool) -> list[tuple[int, str, int, int]]:
    """(cost, edit, next i, next state), edits in ASCII order."""
    out = []
    if i < len(turns):
        t = turns[i]
        out.append((DELETE * t.copies, "D", i + 1, q))
    if i < len(turns) or inserts_at_end:
        out.append((INSERT, "I", i, _FORCED[q]))
    if i < len(turns) and not t.goes:
        extra = TRUNCATED if t.fault == "truncated" else 0
        kept = _NEXT.get(t.role[:1], {}).get(q)
        if kept is not None:
            out.append((KEEP + extra, "K", i + 1, kept))
        out.append((REROLE + extra, "R", i + 1, _FORCED[q]))
    return out


def cheapest(turns: list[Turn], start: int, ends: dict[int, float], inserts_at_end: bool):
    """Cost and edits of the least cheapest path from (0, start) to the states ``ends`` with
    what each costs further on, and its last state; None if there is no path.

    Forward and reverse heaps run until their tops add up to more than the best crossing, so
    all crossings of that cost are known.  A cheapest path's node is settled by one side or
    both; forward nodes that lead to a crossing get their remaining cost, and the walk along
    remaining costs takes the least edit at each node (an edit leads to one node only)."""
    n = len(turns)
    reverse: dict[tuple[int, int], list] = {}

    def into(i: int, q: int) -> list:
        """Edges (cost, i, state) that lead to (i, q)."""
        out = []
        if i < n or inserts_at_end:
            out += [(INSERT, i, p) for p in range(4) if _FORCED[p] == q]
        if i:
            t = turns[i - 1]
            out.append((DELETE * t.copies, i - 1, q))
            if not t.goes:
                extra = TRUNCATED if t.fault == "truncated" else 0
                for p in range(4):
                    if _NEXT.get(t.role[:1], {}).get(p) == q:
                        out.append((KEEP + extra, i - 1, p))
                    if _FORCED[p] == q:
                        out.append((REROLE + extra, i - 1, p))
        return out

    ahead, back = {(0, start): 0}, {(n, q): c for q, c in ends.items() if c < _INF}
    done_ahead, done_back = set(), set()
    heap_a, heap_b = [(0, 0, start)], [(c, i, q) for (i, q), c in back.items()]
    heapq.heapify(heap_b)
    best = back.get((0, start), _INF)
    while heap_a and heap_b and heap_a[0][0] + heap_b[0][0] <= best:
        if heap_a[0][0] <= heap_b[0][0]:
            d, i, q = heapq.heappop(heap_a)
            if (i, q) in done_ahead:
                continue
            done_ahead.add((i, q))
            for c, _, k, p in _edges(turns, i, q, inserts_at_end):
                if d + c < ahead.get((k, p), _INF):
                    ahead[k, p] = d + c
                    heapq.heappush(heap_a, (d + c, k, p))
                best = min(best, d + c + back.get((k, p), _INF))
        else:
            d, i, q = heapq.heappop(heap_b)
            if (i, q) in done_back:
                continue
            done_back.add((i, q))
            for c, k, p in into(i, q):
                if d + c < back.get((k, p), _INF):
                    back[k, p] = d + c
                    heapq.heappush(heap_b, (d + c, k, p))
                best = min(best, d + c + ahead.get((k, p), _INF))
    if best == _INF:
        return None
    left = {node: back[node] for node in done_back}
    # forward nodes that reach a crossing; a free edge leads to a later turn
    for i, q in sorted(done_ahead - done_back, key=lambda x: (-ahead[x], -x[0])):
        togo = best - ahead[i, q]
        if any(left.get((k, p)) == togo - c for c, _, k, p in _edges(turns, i, q, inserts_at_end)) or (
            i == n and ends.get(q) == togo
        ):
            left[i, q] = togo
    edits, i, q = [], 0, start
    while not (i == n and ends.get(q) == left[i, q]):
        for c, edit, k, p in _edges(turns, i, q, inserts_at_end):
            if left.get((k, p)) == left[i, q] - c:
                edits.append(edit * (turns[i].copies if edit == "D" else 1))
                i, q = k, p
                break
        else:
            raise AssertionError("a cheapest path breaks off")
    return best, edits, q


def repaired(turns: list[Turn], edits: list[str], state: int) -> list[tuple[str, str]]:
    """(role, text) after the edits."""
    out, i = [], 0
    for e in edits:
        if e[0] == "I":
            state = _FORCED[state]
            out.append((_ROLE[state], ""))
            continue
        t = turns[i]
        i += 1
        if e == "K":
            state = _NEXT[t.role[:1]][state]
            out.append((t.role, t.text))
        elif e == "R":
            state = _FORCED[state]
            out.append((_ROLE[state], t.text))
    return out


class Tally:
    """What is counted, chosen and hashed along a conversation, segment by segment."""

    def __init__(self):
        self.counts = {"blank": 0, "duplicate": 0, "truncated": 0}
        self.illegal = self.distinct = self.cost = 0
        self.low = self.high = self.last_turn = self.last_role = None
        self.state, self.audit, self.sha, self.lines = EMPTY, [], hashlib.sha256(), 0

    def add(self, numbers: list[int | None], turns: list[Turn], ends: dict[int, float], last: bool) -> list[tuple[str, str]]:
        """One segment; ``numbers`` are its turn numbers in order."""
        for x in numbers:
            if x is not None:
                self.low = x if self.low is None else self.low
                self.high = x
                self.distinct += x != self.last_turn
                self.last_turn = x
        for t in turns:
            if t.fault:
                self.counts[t.fault] += t.copies
            role = t.role[:1]
            self.illegal += (t.copies - 1) * (role + role not in ("su", "ua", "au"))
            if self.last_role is not None:
                self.illegal += self.last_role + role not in ("su", "ua", "au")
            self.last_role = role
        before = self.state
        cost, edits, self.state = cheapest(turns, before, ends, last)
        self.cost += cost - ends.get(self.state, 0)
        self.audit += edits
        new = repaired(turns, edits, before)
        for role, text in new:
            self.sha.update(("\n" if self.lines else "").encode() + f"{role}:{text}".encode("utf-8", "surrogatepass"))
            self.lines += 1
        return new

    def row(self) -> dict:
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.distinct
        return self.counts | {
            "gaps": gaps, "illegal": self.illegal, "cost": int(self.cost), "audit": "".join(self.audit),
            "repaired_sha256": self.sha.hexdigest(),
        }


_SUMMARY = "struct<gaps: bigint, blank: bigint, duplicate: bigint, truncated: bigint, illegal: bigint, cost: bigint, audit: string, repaired_sha256: string>"
_SUMMARY_T = pa.struct([*((c, pa.int64()) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")), ("audit", pa.string()), ("repaired_sha256", pa.string())])
_LINES = "array<struct<role: string, text: string>>"
_LINES_T = pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())]))
_ROWS = "array<struct<turn: bigint, role: string, text: string, copies: bigint, seen: boolean>>"
_ROWS_T = pa.list_(pa.struct([("turn", pa.int64()), ("role", pa.string()), ("text", pa.string()), ("copies", pa.int64()), ("seen", pa.bool_())]))


def _lists(rows: list[dict]) -> tuple[list[int | None], list[Turn]]:
    live = [r for r in rows if r["copies"]]
    numbers = [r["turn"] for r in live]
    return numbers, list(chain.from_iterable(turns_of(r["role"], r["text"], r["copies"], r["seen"]) for r in live))


def _pairs(lines: list[tuple[str, str]]) -> list[dict]:
    return [{"role": r, "text": t} for r, t in lines]


def _segments(segment: int):
    """Sorted turns -> whole conversations with their summary, and segments of others with
    their turns and the costs between the role states at their ends."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq = TaskContext.get().partitionId(), 0
        out: list[tuple] = []

        def closed(conv, rows: list[dict], whole: bool) -> None:
            nonlocal seq
            numbers, turns = _lists(rows)
            if whole:
                tally = Tally()
                lines = tally.add(numbers, turns, _ACCEPT, True)
                out.append((conv, part, seq, tally.row(), _pairs(lines), None, None, None))
            else:
                cost = lambda found: None if found is None else float(found[0])
                costs = [cost(cheapest(turns, p, {q: 0}, False)) for p in range(4) for q in range(4)]
                final = [cost(cheapest(turns, p, _ACCEPT, True)) for p in range(4)]
                out.append((conv, part, seq, None, None, rows, costs, final))
            seq += 1

        def batch(schema: pa.Schema) -> pa.RecordBatch:
            types = [schema.field("conv").type, pa.int32(), pa.int64(), _SUMMARY_T, _LINES_T, _ROWS_T, pa.list_(pa.float64()), pa.list_(pa.float64())]
            columns = list(zip(*out)) or [[] for _ in types]
            out.clear()
            return pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, types)], ["conv", "part", "seq", "summary", "lines", "rows", "costs", "final"]
            )

        held, conv, touches = [], None, True  # the first and the last run may go on elsewhere
        for b in batches:
            for r in b.to_pylist():
                key = r.pop("conv")
                if held and key != conv:
                    closed(conv, held, not touches)
                    held, touches = [], False
                elif len(held) >= segment:
                    closed(conv, held, False)
                    held, touches = [], True
                conv = key
                held.append(r)
            if out:
                yield batch(b.schema)
            schema = b.schema
        if held:
            closed(conv, held, False)
        if out:
            yield batch(schema)

    return run


def _remaining(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Segments of a conversation from the last to the first -> the cost that remains behind
    each, by role state; null behind the last."""
    conv, behind = object(), None
    for b in batches:
        parts, seqs, costs = [], [], []
        for r in b.to_pylist():
            last = r["conv"] != conv
            conv = r["conv"]
            number = lambda x: _INF if x is None else x
            if last:
                here = [number(x) for x in r["final"]]
            else:
                here = [min(number(r["costs"][4 * p + q]) + behind[q] for q in range(4)) for p in range(4)]
            parts.append(r["part"]), seqs.append(r["seq"])
            costs.append(None if last else behind)
            behind = here
        yield pa.RecordBatch.from_arrays(
            [pa.array(parts, pa.int32()), pa.array(seqs, pa.int64()), pa.array(costs, pa.list_(pa.float64()))], ["part", "seq", "behind"]
        )


def _chosen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Segments of a conversation from the first to the last -> repaired lines, and the
    summary on the last one."""
    tally = Tally()
    for b in batches:
        out = []
        for r in b.to_pylist():
            last = r["behind"] is None
            ends = _ACCEPT if last else dict(enumerate(r["behind"]))
            lines = tally.add(*_lists(r["rows"]), ends, last)
            out.append((r["conv"], r["part"], r["seq"], tally.row() if last else None, _pairs(lines)))
            tally = Tally() if last else tally
        if out:
            types = [b.schema.field("conv").type, pa.int32(), pa.int64(), _SUMMARY_T, _LINES_T]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], ["conv", "part", "seq", "summary", "lines"])


def _ordered_turns(df: DataFrame, copies: str | None, conv: str, turn: str) -> DataFrame:
    """conv, turn, role, text, copies, seen: equal turns as one row, and whether the role and
    text occur at an earlier turn of the conversation."""
    n = (F.col(copies) if copies else F.lit(1)).cast("long")
    live = n > 0
    rows = df.select(
        F.col(conv).alias("conv"),
        F.when(live, F.col(turn).cast("long")).alias("turn"),
        F.when(live, F.coalesce("role", F.lit(" "))).alias("role"),
        F.when(live, F.coalesce("text", F.lit(" "))).alias("text"),
        n.alias("copies"),
    )
    rows = rows.groupBy("conv", "turn", "role", "text").agg(F.sum("copies").alias("copies"))
    rows = written(rows.withColumn("same", F.sha2(F.concat_ws(":", F.hex("role"), "text"), 256)), "turns")
    at = F.struct(F.col("turn").isNotNull().alias("has"), F.col("turn").alias("turn"))
    first = rows.groupBy(F.col("conv").alias("c"), F.col("same").alias("s")).agg(F.min(at).alias("first"))
    both = rows.join(first.hint("merge"), rows["conv"].eqNullSafe(first["c"]) & (rows["same"] == first["s"]))
    return both.select("conv", "turn", "role", "text", "copies", (at > F.col("first")).alias("seen"))


def repair_segments(df: DataFrame, copies: str | None = None, conv: str = "conv_id", turn: str = "turn", segment: int = SEGMENT) -> DataFrame:
    """``conv``, ``part``, ``seq`` (order of a conversation's segments), ``lines`` (its repaired
    role and text) and ``summary`` (on the last segment).

    Turns go by number, null first, then by role and text.  A null role or text is one space.
    ``copies`` names a column with how often a row counts; a conversation whose rows all count
    0 has an empty summary.  Null conversations are one."""
    rows = written(_ordered_turns(df, copies, conv, turn), "faults")
    order = ["conv", "turn", "role", "text"]
    sorted_rows = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    key = f"conv {rows.schema['conv'].dataType.simpleString()}, part int, seq bigint"
    shape = f"{key}, summary {_SUMMARY}, lines {_LINES}"
    cut = written(sorted_rows.mapInArrow(_segments(segment), f"{shape}, rows {_ROWS}, costs array<double>, final array<double>"), "segments")
    whole = cut.filter("summary IS NOT NULL").select("conv", "part", "seq", "summary", "lines")
    long = cut.filter("summary IS NULL")
    back = long.select("conv", "part", "seq", "costs", "final").repartition("conv")
    back = back.sortWithinPartitions("conv", F.desc("part"), F.desc("seq")).mapInArrow(_remaining, "part int, seq bigint, behind array<double>")
    ahead = long.select("conv", "part", "seq", "rows").join(back.hint("merge"), ["part", "seq"])
    ahead = ahead.select("conv", "part", "seq", "rows", "behind").repartition("conv").sortWithinPartitions("conv", "part", "seq")
    return whole.unionByName(ahead.mapInArrow(_chosen, shape))


def repair(df: DataFrame, copies: str | None = None, conv: str = "conv_id", turn: str = "turn", segment: int = SEGMENT) -> DataFrame:
    """One row a conversation: ``conv``, gaps, blank, duplicate, truncated, illegal, cost,
    audit, repaired_sha256; see ``repair_segments``."""
    done = repair_segments(df, copies, conv, turn, segment).filter("summary IS NOT NULL")
    return done.select(F.col("conv").alias(conv), "summary.*")


def repaired_turns(df: DataFrame, copies: str | None = None, conv: str = "conv_id", turn: str = "turn", segment: int = SEGMENT) -> DataFrame:
    """The repaired conversations' turns: ``conv``, ``part``, ``seq``, ``pos`` (their order),
    ``role``, ``text``."""
    lines = repair_segments(df, copies, conv, turn, segment).select(F.col("conv").alias(conv), "part", "seq", F.posexplode("lines").alias("pos", "line"))
    return lines.select(conv, "part", "seq", "pos", "line.role", "line.text")


def damaged(df: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, copies: rows damaged by crc32(conv_id:turn) % 20.  0 drops a
    row (copies 0), 1 empties its text, 2 removes its ends of sentences, 3 doubles it, 4 makes
    it the user's.  Nulls are one space."""
    part = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind: Column = F.crc32(F.concat_ws(":", part("conv_id"), part("turn"))) % 20
    text = F.when(kind == 1, "").when(kind == 2, F.regexp_replace(part("text"), "[.!?]", "")).otherwise(part("text"))
    role = F.when(kind == 4, "user").otherwise(part("role"))
    copies = F.when(kind == 0, 0).when(kind == 3, 2).otherwise(1)
    return df.select("conv_id", "turn", role.alias("role"), text.alias("text"), copies.alias("copies"))


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair(damaged(spark.read.parquet(f"{sf_dir}/conversations.parquet")), copies="copies")


_CRC = (
    "xor(list_reduce([4294967295::BIGINT] || list_transform(string_split({0}, ''), lambda x: ascii(x)::BIGINT), "
    "lambda acc, b: list_reduce([xor(acc, b)] || [1, 2, 3, 4, 5, 6, 7, 8]::BIGINT[], "
    "lambda c, k: xor(c >> 1, 3988292384 * (c & 1)))), 4294967295)"
)

SQL = f"""
WITH RECURSIVE raw AS (
    SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
           {_CRC.format("coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ')")} % 20 AS kind
    FROM conversations),
hurt AS MATERIALIZED (
    SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
           CASE WHEN kind = 1 THEN '' WHEN kind = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
    FROM raw, (SELECT unnest([0, 1]) AS copy) WHERE kind <> 0 AND (copy = 0 OR kind = 3)),
rows_ AS MATERIALIZED (
    SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) AS again,
           regexp_extract(text, '(?s)^.*([^\\x20\\x09-\\x0D])', 1) AS ink
    FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i FROM hurt)),
faults AS MATERIALIZED (
    SELECT *, CASE WHEN ink = '' THEN 'blank' WHEN again > 1 THEN 'duplicate'
                   WHEN ink NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault,
           coalesce(left(lag(role) OVER (PARTITION BY conv_id ORDER BY i), 1) || left(role, 1), '-') AS pair,
           max(i) OVER (PARTITION BY conv_id) AS n
    FROM rows_),
counts AS (
    SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
           count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
           count(*) FILTER (fault = 'truncated') AS truncated,
           count(*) FILTER (pair NOT IN ('su', 'ua', 'au', '-')) AS illegal
    FROM faults GROUP BY conv_id),
-- from the last turn to the first: the least (cost, edits, repaired) from each role state (empty, s, u, a)
togo AS (
    SELECT f.conv_id, f.n + 1 AS i, [{{'c': 0, 'a': '', 'r': ''}}, {{'c': 4, 'a': 'II', 'r': chr(10) || 'user:' || chr(10) || 'assistant:'}},
           {{'c': 2, 'a': 'I', 'r': chr(10) || 'assistant:'}}, {{'c': 0, 'a': '', 'r': ''}}] AS v
    FROM (SELECT DISTINCT conv_id, n FROM faults) f
    UNION ALL
    SELECT conv_id, i, [least(w[1], {{'c': w[3].c + 2, 'a': 'I' || w[3].a, 'r': chr(10) || 'user:' || w[3].r}},
                              {{'c': w[4].c + 4, 'a': 'II' || w[4].a, 'r': chr(10) || 'user:' || chr(10) || 'assistant:' || w[4].r}}),
                        least(w[2], {{'c': w[3].c + 2, 'a': 'I' || w[3].a, 'r': chr(10) || 'user:' || w[3].r}},
                              {{'c': w[4].c + 4, 'a': 'II' || w[4].a, 'r': chr(10) || 'user:' || chr(10) || 'assistant:' || w[4].r}}),
                        least(w[3], {{'c': w[4].c + 2, 'a': 'I' || w[4].a, 'r': chr(10) || 'assistant:' || w[4].r}}),
                        least(w[4], {{'c': w[3].c + 2, 'a': 'I' || w[3].a, 'r': chr(10) || 'user:' || w[3].r}})]
    FROM (
        SELECT f.conv_id, f.i, list_transform([1, 2, 3, 4], lambda q: least(
            {{'c': v[q].c + 3, 'a': 'D' || v[q].a, 'r': v[q].r}},
            CASE WHEN fault IN ('blank', 'duplicate') THEN NULL ELSE
                {{'c': v[[3, 3, 4, 3][q]].c + 2 + t, 'a': 'R' || v[[3, 3, 4, 3][q]].a,
                  'r': chr(10) || ['user', 'user', 'assistant', 'user'][q] || ':' || text || v[[3, 3, 4, 3][q]].r}} END,
            CASE WHEN fault NOT IN ('blank', 'duplicate') AND k[q] > 0 THEN
                {{'c': v[k[q]].c + t, 'a': 'K' || v[k[q]].a, 'r': chr(10) || role || ':' || text || v[k[q]].r}} END)) AS w
        FROM togo JOIN (SELECT *, CASE WHEN fault = 'truncated' THEN 1 ELSE 0 END AS t,
                               CASE left(role, 1) WHEN 's' THEN [2, 0, 0, 0] WHEN 'u' THEN [3, 3, 0, 3]
                                                  WHEN 'a' THEN [0, 0, 4, 0] ELSE [0, 0, 0, 0] END AS k FROM faults) f
             ON f.conv_id IS NOT DISTINCT FROM togo.conv_id AND f.i = togo.i - 1))
SELECT a.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
       coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, CAST(coalesce(v[1].c, 0) AS BIGINT) AS "cost",
       coalesce(v[1].a, '') AS audit, sha256(coalesce(v[1].r[2:], '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) a
LEFT JOIN counts c ON c.conv_id IS NOT DISTINCT FROM a.conv_id
LEFT JOIN (SELECT * FROM togo WHERE i = 1) t ON t.conv_id IS NOT DISTINCT FROM a.conv_id
"""
