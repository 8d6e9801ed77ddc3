"""The training-data operators against brute-force versions, and their edge cases."""

import datetime
import hashlib
import html
import math
import random
import re
import string
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from spanloom.llm import common, components, interpolation, langid, mixing, mtree, packing, pii, quality
from spanloom.llm import registry, secret_scan, simhash, wrappers

LOW = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)
WORDS = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def words(text, lower=False):
    return WORDS.findall((text or "").translate(LOW) if lower else text or "")


def frame(spark, rows, schema=DOCS):
    return spark.createDataFrame(rows, schema)


def prose(rng, n, vocabulary=400):
    return " ".join(f"w{int(rng.paretovariate(0.8)) % vocabulary}" for _ in range(n))


@pytest.fixture(scope="module")
def edge(spark):
    """Nulls in every column, empty and blank texts, a long one, ties, repeated rows, and
    columns whose names the operators use themselves."""
    long = " ".join(f"Word{i % 977} the of" for i in range(30_000))
    rows = [
        (1, None, "en", "a", None), (2, "", None, None, 0), (None, "The people of this town and their children walked to another small village.", "en", "a", 3),
        (3, " \n\t ", "fr", "b", 1), (4, "One line. Two!", "en", None, 14), (4, "One line. Two!", "en", None, 14),
        (5, long, "en", "a", len(long)), (6, "one line. two!", None, "b", 14), ((1 << 60) + 1, "x", "en", "a", 1),
        (None, None, None, None, None),
    ]
    extra = {c: F.lit(7) for c in ("q", "kept", "failed", "pii", "fp", "found", "size", "base", "key", "ids", "n", "start", "block", "epoch", "host", "rule", "score", "k", "lo", "a", "seg")}
    return frame(spark, rows).withColumns(extra)


def empty(df):
    return df.limit(0)


# --- quality rules -------------------------------------------------------------------


def repeated(ws, width=5):
    at = defaultdict(list)
    for i in range(len(ws) - width + 1):
        at[tuple(ws[i : i + width])].append(i)
    return len({i + k for starts in at.values() if len(starts) > 1 for i in starts for k in range(width)})


def test_quality_counts(spark):
    rng = random.Random(3)
    texts = [prose(rng, rng.randint(0, 60), 4) + rng.choice(["", "\n# a\n# a\n", "\t*|\r\x0b"]) for _ in range(200)]
    got = quality.apply_rules(frame(spark, [(i, t, None, None, 0) for i, t in enumerate(texts)])).collect()
    for r in got:
        t = texts[r.doc_id]
        lines = [x for x in t.split("\n") if WORDS.search(x)]
        expected = (len(words(t)), sum(map(len, words(t))), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), repeated(words(t)))
        assert (r.q.n_words, r.q.word_chars, r.q.n_symbols, r.q.n_dup_lines, r.q.n_repeat_words) == expected


def test_quality_edges(spark, edge):
    rows = quality.apply_rules(edge).collect()
    assert len(rows) == 10 and all(r.kept == (not r.failed) for r in rows)
    assert [r.kept for r in rows if r.text is None] == [False, False]
    assert quality.kept_documents(edge).columns == edge.columns
    assert quality.kept_documents(edge).count() == sum(r.kept for r in rows) > 0
    assert quality.apply_rules(empty(edge)).count() == 0


def test_quality_keeps_clean_texts(spark):
    rng = random.Random(8)
    many = lambda ws, n: " ".join(rng.choice(ws) for _ in range(n))
    north = [f"{a}{b}{c}" for a in ("skog", "fjell", "vann", "hus") for b in ("en", "ets", "ar") for c in ("", "lig", "het", "dom")]
    clean = [
        ("the cat sat on the mat and it was a good day for all", "en"),
        ("+1 (372) 555-7739 9597024294303453 call them or write to 224.228.19.86 before noon, 2024-01-02", "en"),
        (many(north, 80), "no"), (many(north, 80), None), (many(north, 80) + " the of and to in is", "en-GB"),
        ("Totals 12.50 14 90 311 7 8 16 of the four shops 11 12 13 14 15 16 17 18 19 20 21 22 23 24 25 26", "en"),
    ]
    junk = [(many(north, 80), "en"), (many(["||", "<<>>", "word", "##"], 60), "no"), ("!!! wow " * 12, "en"), (many(["--", "..", "ab"], 60), "no")]
    rows = frame(spark, [(i, t, lang, None, 0) for i, (t, lang) in enumerate(clean + junk)])
    got = {r.doc_id: r.failed for r in quality.apply_rules(rows).collect()}
    assert [got[i] for i in range(len(clean))] == [[]] * len(clean)
    assert all(got[i] for i in range(len(clean), len(rows.collect()))) and got[len(clean)] == ["stop_words"]


def test_quality_verdict_under_a_filter(spark):
    rows = frame(spark, [(i, prose(random.Random(i), 5 + i), "en", None, 0) for i in range(60)])
    judged = quality.apply_rules(rows)
    all_rows = {r.doc_id: r for r in judged.collect()}
    for condition, fits in (("kept", lambda r: r.kept), ("NOT kept", lambda r: not r.kept), ("array_contains(failed, 'length')", lambda r: "length" in r.failed)):
        out = judged.filter(condition)
        plan = out._jdf.queryExecution().optimizedPlan().toString()
        assert "Filter" in plan and plan.index("Filter") < plan.index("Generate")
        assert plan.count("split(") == judged._jdf.queryExecution().optimizedPlan().toString().count("split(")
        assert {r.doc_id for r in out.collect()} == {i for i, r in all_rows.items() if fits(r)}


def test_quality_against_labels(spark, sf_dir):
    """No document of quality 1 goes by the ratios of words."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").join(spark.read.parquet(f"{sf_dir}/labels.parquet").filter("quality = 1"), "doc_id")
    lost = quality.apply_rules(docs).filter("arrays_overlap(failed, array('word_length', 'letters', 'capitals', 'stop_words'))")
    assert docs.count() > 0 and lost.count() == 0


# --- pseudonyms ----------------------------------------------------------------------


def luhn(d):
    return sum(x if i % 2 == 0 else 2 * x - 9 * (x > 4) for i, x in enumerate(map(int, reversed(d)))) % 10 == 0


def feistel(x, low, high, kind, key="spanloom"):
    """The network of the operator in plain integers."""
    a, b = divmod(x, high)
    for i in range(pii.ROUNDS):
        f = lambda v: int(hashlib.sha256(f"{key}|{kind}|{i}|{v}".encode()).hexdigest()[:15], 16)
        a, b = ((a + f(b) % low) % low, b) if i % 2 == 0 else (a, (b + f(a) % high) % high)
    return a * high + b


def digits(d, kind):
    if not d:
        return d
    h = len(d) // 2
    return str(feistel(int(d), 10**h, 10 ** (len(d) - h), kind)).zfill(len(d))


def test_pii_against_plain_integers(spark):
    card, when = "4111 1111 1111 1111", "29.02.1984"
    text = f"a {card}, b {when} c 152.143.123.131### d +1 (743) 555-3824 e 123-45-6789 f 4111111111111112 999.1.1.1 30.02.1984"
    out = pii.pseudonymise(frame(spark, [(1, text, None, None, 0)])).first()
    d = "4111111111111111"
    head = d[0] + digits(d[1:-1], "card")
    new = head + next(c for c in string.digits if luhn(head + c))
    day = (datetime.date(1984, 2, 29) - datetime.date(1900, 1, 1)).days
    date = datetime.date(1900, 1, 1) + datetime.timedelta(feistel(day, 270, 270, "date"))
    ip = feistel(int.from_bytes(bytes([152, 143, 123, 131]), "big"), 65536, 65536, "ip")
    phone = digits("435553824", "phone")
    row = 122 * 99 + 44
    ssn = feistel(row * 9999 + 6788, 898 * 99, 9999, "ssn")
    area = ssn // (99 * 9999)
    expected = (
        f"a {new[:4]} {new[4:8]} {new[8:12]} {new[12:]}, b {date:%d.%m.%Y} c {'.'.join(map(str, ip.to_bytes(4, 'big')))}### "
        f"d +1 (7{phone[:2]}) {phone[2:5]}-{phone[5:]} e {area + 1 if area < 665 else area + 2:03d}-{ssn // 9999 % 99 + 1:02d}-"
        f"{ssn % 9999 + 1:04d} f 4111111111111112 999.1.1.1 30.02.1984"
    )
    assert out.text == expected and out.pii == ["card", "date", "ip", "phone", "ssn"]


def test_pii_is_one_to_one_and_links(spark):
    rows = spark.range(100).select(pii.feistel(F.col("id"), F.lit(10), F.lit(10), "k", "x").alias("y"))
    assert sorted(r.y for r in rows.collect()) == list(range(100))
    a, b = pii.pseudonymise(frame(spark, [(1, "x DE89370400440532013000 y", None, None, 0), (2, "DE89 3704 0044 0532 0130 00", None, None, 0)])).collect()
    iban = a.text.split()[1]
    assert iban == b.text.replace(" ", "") != "DE89370400440532013000"
    moved = iban[4:] + iban[:4]
    assert int("".join(str(int(c, 36)) for c in moved)) % 97 == 1
    mail = pii.pseudonymise(frame(spark, [(1, "Hi jo.doe7@x.org and jo.doe7@x.org", None, None, 0)])).first().text
    found = re.findall(r"[a-z]{2}\.[a-z]{3}[0-9]@x\.org", mail)
    assert len(found) == 2 and len(set(found)) == 1 and "jo.doe7" not in mail


def test_pii_ibans_with_letters(spark):
    ibans = [
        "MT84MALT011000012345MTLCAST001S", "MU17BOMM0101101030300200000MUR", "SC18SSCB11010000000000001497USD",
        "BR1800360305000010009795493C1", "FR1420041010050500013M02606", "PL61109010140000071219812874", "GB82WEST12345698765432",
        "MT84 MALT 0110 0001 2345 MTLC AST0 01S",
    ]
    rows = pii.pseudonymise(frame(spark, [(i, f"x {v} y", None, None, 0) for i, v in enumerate(ibans)])).collect()
    got = {r.doc_id: r.text[2:-2] for r in rows}
    kinds = lambda v: re.sub("[A-Z]", "A", re.sub("[0-9]", "0", v))
    for i, v in enumerate(ibans):
        new = got[i].replace(" ", "")
        assert kinds(got[i]) == kinds(v) and new[:2] == v[:2]
        assert int("".join(str(int(c, 36)) for c in new[4:] + new[:4])) % 97 == 1
        same = sum(a == b for a, b in zip(new[4:], v.replace(" ", "")[4:]))
        assert same * 2 < len(new) - 4
    assert got[7].replace(" ", "") == got[0] and all(r.pii == ["iban"] for r in rows)


def test_pii_permutes_characters_one_to_one(spark):
    values = [f"{a}{b}{c}" for a in "0123456789" for b in string.ascii_uppercase for c in "0123456789"]
    rows = spark.createDataFrame([(v,) for v in values], "v string").select(pii.permuted_characters(F.col("v"), "k", "x").alias("y"))
    got = [r.y for r in rows.collect()]
    assert sorted(got) == values and got != values


def test_pii_dates_day_first_and_short(spark):
    text = "25/12/2020 1/5/2020 01/05/2020 3.2.1984 03.02.1984 31/4/2020 2021/3/9 2021-3-9"
    out = pii.pseudonymise(frame(spark, [(1, text, None, None, 0)])).first()
    new, day = out.text.split(), lambda x, f: datetime.datetime.strptime(x, f).date()
    assert out.pii == ["date"] * 7 and new[5] == "31/4/2020"
    assert new[0] != "25/12/2020" and day(new[0], "%d/%m/%Y").day > 12
    assert day(new[1], "%m/%d/%Y") == day(new[2], "%m/%d/%Y") != datetime.date(2020, 1, 5)
    assert day(new[3], "%d.%m.%Y") == day(new[4], "%d.%m.%Y") != datetime.date(1984, 2, 3)
    assert day(new[6], "%Y/%m/%d") == day(new[7], "%Y-%m-%d") != datetime.date(2021, 3, 9)
    days = [datetime.date(1900, 1, 13) + datetime.timedelta(i) for i in range(0, 70000, 97)]
    rows = [(i, f"{d:%d/%m/%Y}", None, None, 0) for i, d in enumerate(days) if d.day > 12]
    moved = [r.text for r in pii.pseudonymise(frame(spark, rows)).collect()]
    assert len(set(moved)) == len(rows) and all(day(x, "%d/%m/%Y").day > 12 for x in moved)


def test_pii_edges(spark, edge):
    rows = pii.pseudonymise(edge).collect()
    before = Counter((r.doc_id, r.text) for r in edge.collect())
    assert Counter((r.doc_id, r.text) for r in rows) == before
    assert all((r.pii is None) == (r.text is None) for r in rows)
    assert pii.pseudonymise(empty(edge)).count() == 0


# --- secrets -------------------------------------------------------------------------


def test_secrets(spark, edge):
    hexes = "0123456789abcdef" * 2
    text = f"é token = \"abcdef\" secret: token: abcdef\nuser: johndoe key {'A1b2' * 10} AKIA{'Z' * 16} {hexes}\n\nuser: lonely99 far"
    base = [
        *((m.start(), 0, "assign", m.end()) for m in re.finditer(
            r"(?ai)(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", text) if len(m[2]) >= 6),
        *((m.start(), 1, "access", m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20),
        *((m.start(), 2, "hex", m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24),
    ]
    found = secret_scan.scan(frame(spark, [(1, text, None, None, 0)])).first().found
    assert [(x.start, x.order, x.kind, x.end) for x in found if x.order < 3] == sorted(base)
    weak = {text[x.start : x.end] for x in found if x.order >= 3}
    assert weak == {"user: johndoe", "A1b2" * 10}  # the one in the next scope has no partner
    rows = secret_scan.scan(edge).collect()
    assert len(rows) == 10 and all(r.found == [] for r in rows) and "q" in rows[0]
    assert secret_scan.scan(empty(edge)).count() == 0


def test_secret_links_against_plain_loops(spark):
    """Random parts, gaps around the reach, blank lines: partners, credentials, reports."""
    rng = random.Random(21)
    kinds = [
        lambda: "token=" + "x" * rng.choice([3, 6, 250]), lambda: "AKIA" + "Q" * 20, lambda: "ab12" * rng.choice([5, 8]),
        lambda: "login: bob_" + "y" * rng.choice([1, 60]), lambda: "".join(rng.choice("GHIJKLxyz789") for _ in range(40)),
        lambda: "https://" + "h" * rng.choice([3, 250]) + ".org",
    ]
    gap = lambda: rng.choice([" ", " , ", "\n", "\n\n", " " + "z " * 99, " " + "z " * 100, " " + "z " * 40, "\n \n"])
    texts = ["".join(rng.choice(kinds)() + gap() for _ in range(rng.choice([0, 1, 2, 4, 9]))) for _ in range(150)]
    texts.append("https://" + "h" * 250 + ".org\n" + "GHIJ" * 10)
    texts.append("login: alice01 " + "z " * 99 + "GHIJ" * 10)
    rows = {r.doc_id: r.found for r in secret_scan.scan(frame(spark, [(i, t, None, None, 0) for i, t in enumerate(texts)])).collect()}
    for i, t in enumerate(texts):
        parts = []
        for order, (name, role, pattern, group, least) in enumerate(secret_scan.KINDS):
            for m in re.finditer(pattern, t, re.A):
                if len(m[group]) >= least:
                    scope = len(re.findall(secret_scan.SCOPE, t[: m.start()]))
                    parts.append((m.start(), m.end(), order, name, role, scope))
        expected = []
        for x in parts:
            mine = sorted(y for y in parts if y[5] == x[5])
            wanted = [y for y in mine if y[4] in secret_scan.COMPLETES[x[4]]]
            options = []
            for role in secret_scan.COMPLETES[x[4]]:
                back = [(y[1], y[0], y[2]) for y in wanted if y[4] == role and y < x]
                ahead = [(y[0], y[1], y[2]) for y in wanted if y[4] == role and y > x]
                options += [(max(x[0] - e, 0), s, k, e) for e, s, k in [max(back)] if x[0] - e <= 200] if back else []
                options += [(max(s - x[1], 0), s, k, e) for s, e, k in [min(ahead)] if s - x[1] <= 200] if ahead else []
            near = min(options, default=None)
            chain, far = None, None
            for y in mine:
                if far is None or y[0] - far > 200:
                    chain = y[0]
                far = max(far or 0, y[1])
                if y == x:
                    break
            if x[2] < 3 or near:
                partner = (secret_scan.KINDS[near[2]][0], near[1], near[3]) if near else None
                expected.append((x[0], x[2], x[3], x[1], partner, chain if near else None))
        got = [(f.start, f.order, f.kind, f.end, f.partner and tuple(f.partner), f.credential) for f in rows[i]]
        assert got == sorted(expected, key=lambda e: e[:2]), t
    assert [f.kind for f in rows[150]] == ["bare", "endpoint"] or [f.kind for f in rows[150]] == ["endpoint", "bare"]
    assert [f.kind for f in rows[151]] == ["user", "bare"]


# --- mixing --------------------------------------------------------------------------


def targets(sizes, cap=3):
    """Shares by weight, capped and shared again until none is above."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: i % 3 + 1.0 for i, s in enumerate(names)}
    capped, total = set(), sum(sizes.values())
    while True:
        free = [s for s in names if s not in capped]
        left = total - sum(cap * sizes[s] for s in capped)
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = {s for s in free if share[s] > cap * sizes[s]}
        if not over:
            return {s: cap * sizes[s] if s in capped else share[s] for s in names}
        capped |= over


def mixture(spark, rng):
    rows, sources = [], ["a", "b", "c", "d", None]
    for i in range(300):
        s = "a" if i % 3 == 0 else rng.choice(sources)
        rows.append((i, None if i == 7 else prose(rng, 5 if s == "b" else rng.randint(0, 400)), "en", s, 0))
    return rows


def test_mixing(spark, edge):
    rows = mixture(spark, random.Random(5))
    docs = frame(spark, rows)
    got = mixing.taken_words(docs).collect()
    size = Counter()
    for _, t, _, s, _ in rows:
        size[s] += len(words(t))
    want = targets(size)
    taken = Counter()
    for r in got:
        assert r.size == len(words(rows[r.doc_id][1])) and r.taken <= 3 * r.size and r.source_size == size[r.source]
        assert r.target == pytest.approx(want[r.source])
        taken[r.source] += r.taken
    assert len(got) == 300 and all(abs(taken[s] - want[s]) <= 2 * mixing.BLOCK * 3 for s in want)
    again = mixing.taken_words(docs.repartition(5)).collect()
    assert sorted(map(tuple, (r[:1] + r[2:] for r in again))) == sorted(map(tuple, (r[:1] + r[2:] for r in got)))
    mixed = mixing.mixed_documents(docs)
    sums = {r.doc_id: r.n for r in mixed.groupBy("doc_id").agg(F.sum(F.regexp_count("text", F.lit(WORDS.pattern))).alias("n")).collect()}
    assert sums == {r.doc_id: r.taken for r in got if r.taken} and mixed.columns == docs.columns
    parts = set(w for r in mixed.collect() for w in words(r.text))
    assert parts <= set(w for r in rows for w in words(r[1]))
    out = mixing.taken_words(edge).collect()
    assert len(out) == 10 and sum(r.size for r in out) == sum(len(words(r.text)) for r in edge.collect())
    assert mixing.mixed_documents(edge).columns == edge.columns and mixing.mixed_documents(edge).count() > 0
    assert mixing.taken_words(empty(edge)).count() == 0 == mixing.mixed_documents(empty(edge)).count()


def test_permutation_is_exact(spark):
    rows = spark.range(1000).select(mixing.permuted(F.col("id"), F.lit(1000), F.lit(3), 11).alias("y"))
    y = [r.y for r in rows.collect()]
    assert sorted(y) == list(range(1000)) and y != list(range(1000))


# --- near-duplicates -----------------------------------------------------------------


def fingerprint(text, k=3):
    ws = words(text, True)
    if not ws:
        return 0
    s = [" ".join(ws[i : i + k]) for i in range(len(ws) - k + 1)] or [" ".join(ws)]
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
    return sum(1 << j for j in range(64) if 2 * sum(x >> j & 1 for x in h) > len(h))


def unions(n, pairs):
    parent = list(range(n))

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def test_fingerprints():
    rng = random.Random(1)
    for t in ["", " \n", "One", "a B c", *(prose(rng, n) for n in (3, 40, 700))]:
        assert simhash.fingerprint(t) == fingerprint(t)
        assert simhash.fingerprint(t, 5) == fingerprint(t, 5)


@pytest.mark.parametrize("per_cell", [4096, 7])
def test_links_connect_all_near_fingerprints(spark, per_cell):
    """A dense ball, chains and scattered values; crowded cells are split in the second run."""
    rng = random.Random(2)
    values = {rng.getrandbits(64) for _ in range(150)} | {0}
    centre = rng.getrandbits(64)
    for _ in range(250):
        values.add(centre ^ sum(1 << j for j in rng.sample(range(64), rng.randint(0, 4))))
    chain = rng.getrandbits(64)
    for _ in range(40):
        chain ^= sum(1 << j for j in rng.sample(range(64), 3))
        values.add(chain)
    fps = sorted(values)
    df = spark.createDataFrame([(int(np.uint64(v).astype(np.int64)),) for v in fps], "fp long")
    got = simhash.links(df, 3, per_cell).collect()
    place = {int(np.uint64(v).astype(np.int64)): i for i, v in enumerate(fps)}
    near = [(i, j) for i in range(len(fps)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 3]
    pairs = [(place[r.a], place[r.b]) for r in got]
    assert all((fps[a] ^ fps[b]).bit_count() <= 3 for a, b in pairs)
    assert unions(len(fps), pairs) == unions(len(fps), near)
    roots = {r.node: r.root for r in components.connected(spark.createDataFrame(got, "a long, b long")).collect()}
    whole = defaultdict(set)
    for v, c in zip(fps, unions(len(fps), near)):
        key = int(np.uint64(v).astype(np.int64))
        whole[c].add(roots.get(key, key))
    assert all(len(x) == 1 for x in whole.values())


def test_near_duplicates_edges(spark, edge):
    rows = simhash.near_duplicates(edge).collect()
    assert len(rows) == 10
    by = defaultdict(set)
    for r in rows:
        by[r.component_id].add(r.doc_id)
    assert by[1] == {1, 2, 3, None} and by[4] == {4, 6}  # blank texts; equal but for case
    assert any((1 << 60) + 1 in v for v in by.values())
    kept = simhash.one_of_each(edge)
    assert kept.columns == edge.columns
    assert Counter(r.doc_id for r in kept.collect()) == Counter([1, None, 4, 5, (1 << 60) + 1])
    assert simhash.near_duplicates(empty(edge)).count() == 0 == simhash.one_of_each(empty(edge)).count()


# --- packing -------------------------------------------------------------------------


def check_packed(pieces, texts, tok, window):
    """Each document once, gapless windows of full length, ids as the tokenizer gives them."""
    by, rows = defaultdict(list), defaultdict(list)
    for r in pieces:
        by[r.doc_id].append(r)
        rows[r.sequence_id].append((r.offset, r.length))
    assert set(by) == set(texts)
    for d, rs in by.items():
        rs.sort(key=lambda r: r.start)
        ids = [*tok.encode(texts[d] or "", add_special_tokens=False).ids, 1]
        assert [r.start for r in rs] == [sum(r.length for r in rs[:i]) for i in range(len(rs))]
        assert np.frombuffer(b"".join(r.ids for r in rs), "<u4").tolist() == ids and {r.doc_tokens for r in rs} == {len(ids)}
    assert sorted(rows) == list(range(len(rows)))
    for s, rs in rows.items():
        at = 0
        for offset, length in sorted(rs):
            assert offset == at
            at += length
        assert at == window or s == max(rows)


def test_packing(spark, edge):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(packing.tokenizer_path())
    rng = random.Random(8)
    rows = [(i, prose(rng, rng.randint(0, 300)), "en", rng.choice(["a", "a", "b", "c", None]), 0) for i in range(200)]
    out = packing.pack(frame(spark, rows).repartition(3), window=256).collect()
    check_packed(out, {r[0]: r[1] for r in rows}, tok, 256)
    total = Counter()
    mix = defaultdict(Counter)
    for r in out:
        total[r.source] += r.length
        mix[r.sequence_id][r.source] += r.length
    n = sum(total.values())
    full = [m for s, m in mix.items() if 0 < s < max(mix) - 1]
    off = [abs(m[s] - 256 * total[s] / n) for m in full for s in total]
    assert sum(off) / len(off) <= packing.LEAST_PIECE
    weighted = packing.pack(frame(spark, rows), window=256, weights={"a": 1, "b": 1, "c": 1, None: 1}).collect()
    check_packed(weighted, {r[0]: r[1] for r in rows}, tok, 256)
    first = Counter()
    for r in weighted:
        if r.sequence_id < 8:
            first[r.source] += r.length
    assert max(first.values()) < 1.4 * min(first.values())
    pieces = packing.pack(edge)
    assert sum(r.length for r in pieces.collect()) == sum(len(tok.encode(r.text or "", add_special_tokens=False).ids) + 1 for r in edge.collect())
    assert {"q", "size", "doc_tokens"} <= set(pieces.columns) and packing.pack(empty(edge)).count() == 0


def test_a_worker_holds_a_part_of_a_batch(spark):
    """Long texts of one batch are worked off in parts; rows, keys and order stay."""
    size = 200_000
    rows = [(i if i % 5 else None, "" if i % 7 == 0 else chr(97 + i % 26) * size) for i in range(100)]

    def start():
        at = 0

        def make(texts):
            nonlocal at
            at += len(texts)
            return list(range(at - len(texts), at)), [sum(map(len, texts))] * len(texts), [len(t) for t in texts]

        return make

    long = ("long", pa.int64())
    docs = spark.createDataFrame(rows, "k long, t string").coalesce(1)
    out = common.appended(docs, ["k"], ["t"], {"i": long, "held": long, "n": long}, start).collect()
    assert [(r.k, r.n) for r in out] == [(k, len(t)) for k, t in rows] and [r.i for r in out] == list(range(100))
    assert max(r.held for r in out) <= 2 * common.PART_BYTES < sum(r.n for r in out)


def test_chunks_have_the_ids_of_the_text():
    chunks = packing.Chunks(packing.tokenizer_path())
    rng = random.Random(4)
    alphabet = "aAbé.,!?; \n\t'sTdİΣß1²½_#<|>́\x1c "
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 24))) for _ in range(4000)]
    texts += ["<|endoftext|>A B", "a<|startoftext|>b <|ENDOFTEXT|>", "x" * 5000, "ΑΣ, ΣΑΣ. x"]
    for t, ids in zip(texts, chunks.ids(texts)):
        assert np.frombuffer(ids, "<u4").tolist() == chunks.tok.encode(t, add_special_tokens=False).ids


# --- language models -----------------------------------------------------------------


def brute_scores(docs, test, dev, iterations, order):
    """Counts, weights and scores with dictionaries."""
    tokens = {d: [*words(t, True), None] for d, t in docs.items()}

    def counts(ids):
        c = [Counter() for _ in range(order + 1)]
        for d in ids:
            seq = ["\t", *tokens[d]]
            for i in range(1, len(seq)):
                for n in range(1, order + 1):
                    if i - n + 1 >= (0 if n > 1 else 1):
                        c[n][tuple(seq[i - n + 1 : i + 1])] += 1
        return c

    def parts(d, c, n_docs, n, v):
        seq = ["\t", *tokens[d]]
        for i in range(1, len(seq)):
            f, b = [1 / (v + 1), c[1][(seq[i],)] / max(n, 1)], [None, 0]
            for k in range(2, order + 1):
                if i - k + 1 < 0:
                    f.append(0.0), b.append(0)
                    continue
                h = seq[i - k + 1 : i]
                many = n_docs if h == ["\t"] else c[k - 1][tuple(h)]
                f.append(c[k][tuple(seq[i - k + 1 : i + 1])] / many if many else 0.0)
                b.append(int(math.log2(many)) + 1 if many else 0)
            yield f, b

    train = [d for d in docs if not test(d)]
    main = [d for d in train if not dev(d)]
    c = counts(main)
    n, v = sum(c[1].values()), len(c[1])
    events = [e for d in train if dev(d) for e in parts(d, c, len(main), n, v)]
    w = {k: [0.5 if b or k == 1 else 0.0 for b in range(64)] for k in range(1, order + 1)}
    for _ in range(iterations):
        g, left = defaultdict(float), defaultdict(float)
        for f, b in events:
            upto = [f[0]]
            for k in range(1, order + 1):
                upto.append(w[k][b[k]] * f[k] + (1 - w[k][b[k]]) * upto[-1])
            reach = 1.0
            for k in range(order, 0, -1):
                g[k, b[k]] += reach * w[k][b[k]] * f[k] / upto[order]
                left[k, b[k]] += reach * upto[k] / upto[order]
                reach *= 1 - w[k][b[k]]
        for k in w:
            last = w[k][0]
            for b in range(64):
                last = g[k, b] / left[k, b] if left[k, b] else last
                w[k][b] = min(last, 1 - 1e-6)
    c = counts(train)
    n, v = sum(c[1].values()), len(c[1])
    out = {}
    for d in docs:
        score = 0.0
        for f, b in parts(d, c, len(train), n, v):
            p = f[0]
            for k in range(1, order + 1):
                p = w[k][b[k]] * f[k] + (1 - w[k][b[k]]) * p
            score += math.log10(p)
        base = sum(math.log10((c[1][(x,)] + 1) / (n + v + 1)) for x in tokens[d])
        out[d] = (len(tokens[d]), sum(c[1][(x,)] > 0 for x in tokens[d]), n, base, score)
    return out


@pytest.mark.parametrize("order", [2, 3])
def test_interpolation(spark, order):
    rng = random.Random(6)
    docs = {i: prose(rng, rng.randint(0, 80), 60) for i in range(120)}
    df = frame(spark, [(d, t, None, None, 0) for d, t in docs.items()])
    dev = {r.doc_id for r in df.filter(F.pmod(F.xxhash64("doc_id", "text", F.lit("held-out counts")), F.lit(10)) == 0).collect()}
    got = interpolation.score_texts(df, F.col("doc_id") % 7 == 2, order=order, iterations=3).collect()
    want = brute_scores(docs, lambda d: d % 7 == 2, lambda d: d in dev, 3, order)
    assert len(got) == 120
    for r in got:
        assert (r.n_tokens, r.n_known, r.train_tokens) == want[r.doc_id][:3] and r.held_out == (r.doc_id % 7 == 2)
        assert (r.base_score, r.score) == pytest.approx(want[r.doc_id][3:])


def test_interpolation_edges(spark, edge):
    rows = interpolation.score_texts(edge, F.crc32(F.col("doc_id").cast("string")) % 7 == 2).collect()
    assert len(rows) == 10 and all(math.isfinite(r.score) and r.score < 0 for r in rows)
    assert Counter(r.doc_id for r in rows) == Counter(r.doc_id for r in edge.collect())
    assert interpolation.score_texts(empty(edge), F.lit(False)).count() == 0
    none = interpolation.score_texts(edge, F.lit(True)).collect()
    assert len(none) == 10 and all(r.n_known == 0 and r.train_tokens == 0 for r in none)


# --- search --------------------------------------------------------------------------


def test_mtree(spark):
    rng = np.random.default_rng(3)
    x = np.concatenate((rng.normal(0, 0.2, (300, 8)) + rng.normal(0, 1, (6, 8)).repeat(50, 0), np.tile(rng.normal(0, 1, 8), (150, 1))))
    rows = [(i, [float(v) for v in r], 0) for i, r in enumerate(x)]
    rows += [(900, None, 1), (901, [1.0, None], 1), (950, [float("nan")] * 8, 1), (1000, [float("inf")] * 8, 1), (1050, [2.0, -1.0], 1), (None, [1.0] * 8, 1)]
    # repeated ids: equal rows, and other vectors under a query's id
    rows += [(50, rows[50][1], 2), (100, [0.5] * 8, 2), (100, [4.0] * 8, 2), (7, rows[7][1], 2)]
    df = spark.createDataFrame(rows, "id long, embedding array<double>, label int")
    vectors = df.select("id", mtree.whole_numbers(F.col("embedding")).alias("v"))
    ok = [(i, [math.floor(256 * v) for v in r]) for i, r, _ in rows if i is not None and r and all(v is not None and math.isfinite(v) for v in r)]
    expected = []
    for n, (q, a) in enumerate(ok):
        if q % 50 == 0:
            s = sorted((-sum(x * y for x, y in zip(a, v)), i) for m, (i, v) in enumerate(ok) if m != n)[:5]
            expected += [(q, k + 1, i, -d) for k, (d, i) in enumerate(s)]
    for fan, page_rows in ((3, 16), (mtree.FAN, mtree.PAGE_ROWS)):
        got = mtree.top_k(vectors, vectors.filter("id % 50 = 0"), fan=fan, page_rows=page_rows).collect()
        assert sorted(map(tuple, got)) == sorted(expected)
    few = mtree.top_k(vectors.filter("id < 3"), vectors.filter("id = 0")).collect()
    assert len(few) == 2
    assert mtree.top_k(vectors.filter("id < 0"), vectors).count() == 0 == mtree.top_k(vectors, vectors.filter("id < 0")).count()


def test_mtree_pages_follow_the_vectors(spark):
    """Pages that ``build`` makes: full at most, each vector once, balls that hold their entries;
    on groups of vectors the bounds save most products."""
    rng = np.random.default_rng(1)
    centres = rng.normal(0, 400, (20, 8))
    x = np.floor((centres[:, None, :] + rng.normal(0, 5, (20, 50, 8))).reshape(-1, 8)).astype(int)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(i, [1] * 8) for i in range(1000, 1100)], "id long, v array<long>")
    pages = mtree.build(df, fan=4, page_rows=32).toPandas()
    ids = np.concatenate([np.frombuffer(i, "<i8") for i in pages["ids"]])
    assert sorted(ids) == list(range(1100))
    for p in pages.itertuples():
        entries, centre = np.frombuffer(p.entries, "<f8").reshape(-1, 8), np.frombuffer(p.centre, "<f8")
        away = np.sqrt(((entries - centre) ** 2).sum(1))
        assert np.allclose(away, np.frombuffer(p.away, "<f8")) and away.max() <= p.radius + 1e-9
    index = mtree.PageIndex(pages)
    found, computed = index.search(np.floor(centres[:5]), 5)
    assert computed < 5 * 1100 / 4
    for q, (score, vec) in zip(np.floor(centres[:5]), found):
        assert list(score) == sorted((x @ q).tolist() + [q.sum()] * 100, reverse=True)[:5]


# --- wrappers ------------------------------------------------------------------------

PAGE = (
    "<!DOCTYPE html><html><head><title>t</title><style>p{{}}</style><script>var t='</p>';</script></head><body>"
    "<header><p>Site name</p></header><nav><ul><li><a href='/'>home</a></li></ul></nav><div class='ad'>Buy!</div>"
    "{open}<h1>{title}</h1>{body}{close}<section class='comments'><p>Nice!</p></section>"
    "<aside><p>More</p></aside><form><p>Mail?</p></form><footer>&copy; x</footer></body></html>"
)


def page(title, paragraphs, tag="article"):
    body = "".join(f"<p><b>{html.escape(p)}<br>" if i % 2 else f"<p>{html.escape(p)}</p>" for i, p in enumerate(paragraphs))
    return PAGE.format(title=html.escape(title), body=body, open=f"<{tag}>", close=f"</{tag.split()[0]}>")


def test_main_text():
    text = wrappers.main_text(page("A & B", ["one  two", "three <x>"]))
    assert text == "A & B\n\none two\n\nthree <x>"
    assert wrappers.main_text("") == "" and wrappers.main_text("<<<a href='") == "<<<a href='".join(["", ""])
    nested = wrappers.main_text("<body><main><p>in</p><article><p>art</p></article></main><p>out</p></body>")
    assert nested == "in\n\nart"


def test_deep_and_broken_pages(spark):
    """Nesting beyond any stack, and tags without an end, in linear time."""
    deep = "<body>" + "<div>" * 100_000 + "<p>deep</p><nav>x</nav><div class='menu'>y</div><p>two" + "</div>" * 100_000 + "<p>after</p>"
    assert wrappers.main_text(deep) == "deep\n\ntwo\n\nafter"
    odd = {
        '<p title="a < b">one</p><p>two': "one\n\ntwo",
        "<p class=it's>one</p><p>two</p>": "one\n\ntwo",
        "<p title='>'>one</p><p a='>' ": "one\n\n'",  # ends at its first ">"
        "one < two <b>three</b> <": "one < two three <",
        "<p>one</p><!doctype": "one",
        "<p>one</p><!-- two": "one",
    }
    for page_, text in odd.items():
        assert wrappers.main_text(page_) == text, page_
    start = time.perf_counter()
    for s in ('<a "', '<a =">" ', "<!", "<?", "<a '>' ", '<a "<', '<b x="', "</div>", "<p>", "<"):
        wrappers.main_text(s * 50_000)
        wrappers.main_text("<p>one</p>" + s * 50_000 + ">")
    wrappers.main_text("<" + "a" * 2_000_000)
    assert time.perf_counter() - start < 60
    rows = [(i, "https://deep.org/x", deep) for i in range(3)] + [(9, "https://odd.org/", '<a "' * 20_000)]
    out = wrappers.extract(spark.createDataFrame(rows, "page_id int, url string, html string")).collect()
    assert {r.text for r in out if r.page_id < 9} == {"deep\n\ntwo\n\nafter"} and len(out) == 4


@pytest.mark.parametrize("order", [1, 2, 3])
def test_wrapper_keeps_title_and_lead(spark, order):
    """Text of a main beside its article, a title beside the parts of a page without article,
    and parts of equal weight stay; what every page repeats beside an article goes."""
    rng = random.Random(order)
    body = lambda: prose(rng, 40)
    pages, expected = [], {}
    for i in range(8):
        t, lead, a, b = f"Title {i} {body()[:20]}", body(), body(), body()
        t = t.strip()
        pages.append((i, "https://a.org/p", f"<nav>menu</nav><main><div>The daily</div><h1>{t}</h1><p class=lead>{lead}</p><article><p>{a}</p><p>Said again.</p></article></main><div>{b}</div>"))
        expected[i] = [t, lead, a, "Said again."]
        pages.append((100 + i, "https://b.org/p", f"<div class=top>Site</div><div class=post><h1>{t}</h1><div class=part1>{a}</div><div class=part2>{b}</div></div><div class=foot>All rights</div>"))
        expected[100 + i] = [t, a, b]
        pages.append((200 + i, "https://c.org/p", f"<div class=top>Site</div><div class=post><div class=part1>{a}</div><div class=part2>{b}</div></div>"))
        expected[200 + i] = [a, b]
    rng.shuffle(pages)
    df = spark.createDataFrame(pages, "page_id int, url string, html string").repartition(order)
    assert {r.page_id: r.text for r in wrappers.extract(df).collect()} == {k: "\n\n".join(v) for k, v in expected.items()}


@pytest.mark.parametrize(
    "html_",
    [
        "<head><meta><body><article><p>hello",
        "<html><head><title>t</title><article><p>hello</p></article>",
        "<html><head><title>t<body><article><p>hello</p></article>",
        "<head><title>t</head><body><article><p>hello</p><svg><title>i</title></svg></article>",
        "<head><script>a()</head><body><article><p>hello</p></article></body>",
        "<head><noscript><img><article><p>hello</p></article>",
        '<svg class="i"/><article><p>hello</p></article>',
        "<svg><title/><path/></svg><article><p>hello</p></article>",
        "<body><button>Menu<article><p>hello</p></article></body>",
        "<div><noscript>x</div><article><p>hello</p></article>",
        "<select><option>a<option>b</select><article><p>hello</p></article>",
        "<article><p>hel<button>x</button>l<svg class='i'/>o<noscript><p>no</p></noscript></p></article>",
    ],
)
def test_hidden_elements_end(html_):
    assert wrappers.main_text(html_) == "hello"


def test_alignment_generalises():
    a, b, c = (wrappers.wrapper_of(wrappers.parse(x)) for x in ("<div><p>x</p></div>", "<div><h2>t</h2><p>y</p><p>z</p></div>", "<div></div>"))
    w = wrappers.aligned(wrappers.aligned(a, b), c)
    assert w[0][0] == "div." and w[0][1] == "1"
    assert [(x[0], x[1]) for x in w[0][2]] == [("h2.", "?"), ("p.", "*")] and w[0][2][1][2][0][2] is None
    other = wrappers.aligned(a, wrappers.aligned(b, c))
    assert [(x[0], x[1]) for x in other[0][2]] == [(x[0], x[1]) for x in w[0][2]]


def test_extract(spark, edge):
    rng = random.Random(9)
    rows = []
    for i in range(40):
        parts = [prose(rng, rng.randint(5, 30)) for _ in range(rng.randint(1, 5))]
        tag = "div id='x'" if i % 2 else "article"
        rows.append((i, f"https://h{i % 2}.example.org/{i}", page(f"Title {i}", [*parts, "All rights reserved here."], tag), f"Title {i}", parts))
    df = spark.createDataFrame([r[:3] + (1, "h") for r in rows], "page_id long, url string, html string, rule int, host string")
    got = {r.page_id: r.text for r in wrappers.extract(df).collect()}
    for i, _, _, title, parts in rows:
        assert got[i].startswith("\n\n".join([title, *parts]))  # a line that all pages share may go
    bad = spark.createDataFrame([(1, None, None), (2, "x", ""), (2, "x", ""), (3, "https://a.b/", "plain")], "page_id long, url string, html string")
    assert sorted((r.page_id, r.text) for r in wrappers.extract(bad).collect())[:3] == [(1, ""), (2, ""), (2, "")]
    assert wrappers.extract(empty(bad)).count() == 0


# --- languages -----------------------------------------------------------------------


def test_language_id(spark, edge):
    rng = random.Random(11)
    sounds = {"xx": ["ka", "ti", "mo"], "yy": ["öl", "sch", "ung"], "zz": ["ção", "lh", "ei"]}
    make = lambda lang: " ".join("".join(rng.choice(sounds[lang]) for _ in range(rng.randint(1, 4))) for _ in range(rng.randint(3, 40)))
    rows = [(i, make(lang), lang, None, 0) for i in range(600) for lang in [rng.choice(list(sounds))]]
    df = frame(spark, rows)
    model = langid.fit(*langid.labelled_sample(df.filter("doc_id < 450")))
    out = {r.doc_id: r for r in langid.identify(df, model).collect()}
    assert sum(out[i].lang_pred == rows[i][2] for i in range(450, 600)) >= 147
    odd = frame(spark, [(1, None, None, None, 0), (2, "12 !? 3", None, None, 0), (3, "", None, None, 0), (4, "ß" * 3_000_000, None, None, 0)])
    found = {r.doc_id: r for r in langid.identify(odd, model).collect()}
    assert all(found[i].lang_pred == "und" and found[i].score == 0 and not found[i].accepted for i in (1, 2, 3))
    assert found[4].lang_pred in sounds and 0 <= found[4].score <= 1
    assert langid.identify(edge, model).count() == 10 and langid.identify(empty(edge), model).count() == 0
    nothing = langid.fit(*langid.labelled_sample(empty(edge)))
    assert {r.lang_pred for r in langid.identify(edge, nothing).collect()} == {"und"}


def test_sample_is_bounded_and_even(spark):
    rows = [(i, f"text {i}", "a" if i % 10 else "b", None, 0) for i in range(3000)]
    texts, langs = langid.labelled_sample(frame(spark, rows), rows=200)
    assert len(texts) <= 200 and Counter(langs) == {"a": 100, "b": 100}


def test_sample_takes_distinct_and_long_texts(spark):
    rows = [(i, f"copied {i % 50}", "a", None, 0) for i in range(3000)] + [(i, f"text {i}", "b", None, 0) for i in range(3000)]
    rows += [(i, f"{i} long text " * 3000, "c", None, 0) for i in range(20)]
    texts, langs = langid.labelled_sample(frame(spark, rows), rows=30)
    assert Counter(langs) == {"a": 10, "b": 10, "c": 10} and len(set(texts)) == 30
    assert max(map(len, texts)) == langid.SAMPLE_CHARS


# --- pipeline ------------------------------------------------------------------------


def test_pipeline_stage_by_stage(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf_dir)
        if name != "packing":
            assert out.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        out.write.parquet(str(tmp_path / name))
        seen[name] = docs = spark.read.parquet(str(tmp_path / name))
    raw = {r.doc_id: r for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    kept = {r.doc_id for r in seen["quality"].collect()}
    verdict = quality.apply_rules(spark.read.parquet(f"{sf_dir}/documents.parquet")).collect()
    assert kept == {r.doc_id for r in verdict if r.kept}
    ids = sorted(kept)
    fps = [fingerprint(raw[i].text, 5) for i in ids]
    roots = unions(len(ids), [(a, b) for a in range(len(ids)) for b in range(a) if (fps[a] ^ fps[b]).bit_count() <= 3])
    unique = {ids[r] for r in roots}
    assert {r.doc_id for r in seen["dedup"].collect()} == unique
    masked = seen["pii"].collect()
    assert {r.doc_id for r in masked} == unique
    for r in masked:
        assert not any(luhn(m) and m in raw[r.doc_id].text for m in re.findall(r"(?<!\w)\d{16}(?!\w)", r.text))
        assert r.n_chars == len(r.text)
    size, mixed = Counter(), Counter()
    for r in masked:
        size[r.source] += len(words(r.text))
    for r in seen["mixing"].collect():
        mixed[r.source] += len(words(r.text))
        assert r.n_chars == len(r.text)
    want = targets(size)
    assert all(abs(mixed[s] - want[s]) <= 6 * mixing.BLOCK for s in want)
    pieces = seen["packing"].collect()
    assert sum(r.length for r in pieces if r.start == 0 or True) == sum(
        r.n for r in packing.tokenized(seen["mixing"].select("source", "text")).select("n").collect()
    )
    whole = corpus_pipeline.run(spark, sf_dir)
    key = lambda r: (r.doc_id, r.start, r.length, r.ids_crc32)
    assert Counter(map(key, whole.collect())) == Counter(map(key, pieces))


# --- registered queries --------------------------------------------------------------


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_against_sql(name, spark, sf_dir):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "embeddings", "benchmark", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    cursor = con.execute(registry.SQL[name])
    cols = [c[0] for c in cursor.description]
    expected = sorted(cursor.fetchall())
    df = registry.QUERIES[name](spark, sf_dir)
    assert set(df.columns) == set(cols) and sorted(tuple(r) for r in df.select(cols).collect()) == expected


def test_contract_columns(spark, sf_dir):
    """What the contract of each query names, on the smallest tables."""
    import public_tokenizers  # noqa: F401
    from tokenizers import Tokenizer

    docs = {r.doc_id: r for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    tok = Tokenizer.from_file(packing.tokenizer_path())
    for r in registry.QUERIES["op1_packing"](spark, sf_dir).collect():
        ids = np.asarray([*tok.encode(docs[r.doc_id].text, add_special_tokens=False).ids, 1], "<u4")
        assert zlib.crc32(ids[r.start : r.start + r.length].tobytes()) == r.ids_crc32
    for r in registry.QUERIES["op5_simhash_dedup"](spark, sf_dir).collect():
        assert r.fingerprint == f"{fingerprint(docs[r.doc_id].text):016x}"
    out = registry.QUERIES["op10_language_id"](spark, sf_dir).collect()
    assert len(out) == len(docs) and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in out)
    right = sum(r.lang_pred == docs[r.doc_id].lang for r in out if r.held_out)
    assert right >= 0.95 * sum(r.held_out for r in out)
    shape = {"op2_deleted_interpolation": 7, "op3_secret_scan": 7, "op4_mixing": 6, "op7_pii_pseudonyms": 4}
    for name, n in shape.items():
        df = registry.QUERIES[name](spark, sf_dir)
        assert len(df.columns) == n and df.count() == len(docs)
