"""Secret scan with multipart credential linking.

Strong patterns are reported as they are.  Weak ones (a user name, a bare high-entropy
string, an endpoint) are reported only where a complementary part lies near them in the
same scope, with that part.  All of it is DataFrame functions; what is shuffled are spans, never texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import text_of

#: Kind, part of a credential, pattern, group that is measured, its least
#: length.  The first three are the strong kinds, in their order of listing.
KINDS: tuple[tuple[str, str, str, int, int], ...] = (
    ("assign", "secret",
     r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    ("access", "identifier", r"AKIA[A-Z0-9]+", 0, 20),
    ("hex", "secret", r"(?<![0-9a-f])[0-9a-f]{24,}", 0, 24),
    ("user", "identifier",
     r"""(?i)(?<![A-Za-z0-9_])(?:user(?:_?name)?|login|client_?id)["']?\x20*[:=]\x20*["']?[A-Za-z0-9@._+-]+""", 0, 6),
    ("bare", "secret", r"(?<![A-Za-z0-9+/=_-])[A-Za-z0-9+/]{40}(?![A-Za-z0-9+/=_-])", 0, 40),
    ("endpoint", "endpoint",
     r"""(?i)(?<![A-Za-z0-9_])(?:(?:https?|jdbc:[a-z]+|amqps?|postgres(?:ql)?|mysql|mongodb)://[^\x20\x09-\x0D"'<>]+"""
     r"""|(?:host|endpoint)["']?\x20*[:=]\x20*["']?[A-Za-z0-9.:/_-]+)""", 0, 6),
)
STRONG = 3
REACH = 200  # code points between the end of one part and the start of the next
#: Roles that complete a role, as they make a credential.
COMPLETES = {"identifier": ("secret",), "secret": ("identifier", "endpoint"), "endpoint": ("secret",)}
SCOPE = r"\n[\x20\t\r]*\n"  # a blank line ends a scope


def _matches(text: Column, order: int) -> Column:
    """The matches of one kind as (kind, ordinal, gap before, length, measured length,
    scopes that end in the gap); the gaps are what a split leaves between the matches."""
    _, _, pattern, group, least = KINDS[order]
    found = F.regexp_extract_all(text, F.lit(f"({pattern})" if group == 0 else pattern), group if group == 0 else 0)
    part = F.regexp_extract_all(text, F.lit(pattern), group) if group else found
    rows = F.zip_with(
        F.arrays_zip(found.alias("m"), part.alias("p")),
        F.split(text, pattern, -1),
        lambda hit, gap: F.struct(
            F.lit(order).alias("kind"),
            F.length(gap).alias("gap"),
            F.length(hit["m"]).alias("length"),
            (F.length(hit["p"]) >= least).alias("fits"),
            F.regexp_count(gap, F.lit(SCOPE)).alias("scopes"),
        ),
    )
    numbered = F.transform(rows, lambda x, i: x.withField("i", i))
    # what follows the last match has no hit
    return F.when(text.rlike(pattern), F.filter(numbered, lambda x: x["length"].isNotNull()))


def spans(docs: DataFrame, key: str = "__id", text: str = "text") -> DataFrame:
    """``key``, ``kind`` (position in ``KINDS``), ``start``, ``end``, ``scope`` of every match
    that is long enough; one row with null kind for a document without any.

    The n-th match starts after n gaps and n - 1 matches, so places are running sums over
    the matches of a document and kind, in code points."""
    rows = docs.withColumn("__t", text_of(text))
    t = F.col("__t")
    empty = F.array().cast("array<struct<kind:int,gap:int,length:int,fits:boolean,scopes:int,i:int>>")
    parts = F.concat(*(F.coalesce(_matches(t, k), empty) for k in range(len(KINDS))))
    rows = rows.select(key, F.explode_outer(parts).alias("m")).select(key, "m.*")
    upto = Window.partitionBy(key, "kind").orderBy("i")
    end = F.sum(F.col("gap") + F.col("length")).over(upto)
    rows = rows.withColumns({"end": end.cast("long"), "scope": F.sum("scopes").over(upto).cast("long")})
    rows = rows.withColumn("start", F.col("end") - F.col("length"))
    return rows.select(key, F.when(F.col("fits"), F.col("kind")).alias("kind"), "start", "end", "scope")


def linked(found: DataFrame, key: str = "__id", reach: int = REACH) -> DataFrame:
    """``found`` plus ``partner`` (kind, start, end of the nearest part that completes this one,
    null if none lies within ``reach``), ``credential`` (start of the first of the parts that
    follow each other within ``reach``, where this one has a partner) and ``reported``: strong
    kinds always, weak ones with a partner.

    An identifier needs a secret, a secret an identifier or an endpoint, an endpoint a secret.
    What lies between two parts counts, from the end of one to the start of the next, however
    long they are; parts that overlap touch.  Of two sides equally near the one before counts,
    and of several before the one that reaches farthest.  The interval join is four running values over the sorted parts of a scope: the farthest end
    so far and the next start, of the roles that complete a part.  No pairs are made."""
    role = F.get(F.array(*(F.lit(k[1]) for k in KINDS)), F.col("kind"))  # null for a match that is too short
    scope = Window.partitionBy(key, "scope")
    before = scope.orderBy("start", "end", "kind").rowsBetween(Window.unboundedPreceding, -1)
    after = scope.orderBy(F.desc("start"), F.desc("end"), F.desc("kind")).rowsBetween(Window.unboundedPreceding, -1)
    part = lambda first, second: F.struct(first, second, "kind")
    of = lambda r: F.when(role == r, F.lit(True))
    rows = found
    for r in COMPLETES:
        rows = rows.withColumns({
            f"__far_{r}": F.max(F.when(of(r), part("end", "start"))).over(before),
            f"__next_{r}": F.min(F.when(of(r), part("start", "end"))).over(after),
        })
    # the part that reaches farthest is the nearest before; one that starts next is the nearest after
    option = lambda p, gap: F.when(
        p.isNotNull() & (gap <= reach), F.struct(F.greatest(gap, F.lit(0)).alias("gap"), p["start"].alias("start"), p["kind"].alias("kind"), p["end"].alias("end"))
    )
    nearest = F.lit(None)
    for r, others in COMPLETES.items():
        sides = [s for o in others for s in (option(F.col(f"__far_{o}"), F.col("start") - F.col(f"__far_{o}.end")), option(F.col(f"__next_{o}"), F.col(f"__next_{o}.start") - F.col("end")))]
        nearest = F.when(role == r, F.array_min(F.array(*sides))).otherwise(nearest)
    fits = F.col("kind").isNotNull()
    reached = F.max(F.when(fits, F.col("end"))).over(before)
    opens = fits & (reached.isNull() | (F.col("start") - reached > reach))
    chain = F.max(F.when(F.col("__opens"), F.col("start"))).over(before.rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumn("__opens", opens).withColumn("__chain", chain).withColumn("__near", nearest)
    partner = F.when(F.col("__near").isNotNull(), F.struct("__near.kind", "__near.start", "__near.end"))
    rows = rows.withColumn("partner", partner).withColumn("credential", F.when(F.col("partner").isNotNull(), F.col("__chain")))
    reported = F.col("kind").isNotNull() & ((F.col("kind") < STRONG) | F.col("partner").isNotNull())
    return rows.withColumn("reported", reported).select(*found.columns, "partner", "credential", "reported")


def scan(docs: DataFrame, reach: int = REACH, text: str = "text") -> DataFrame:
    """All columns of ``docs`` but the text, plus ``found``: the reported spans as an array of
    (start, kind order, kind, end, partner, credential), in that order; see ``linked``.

    Every input row gives one row, repeated rows too; a null text counts as an empty one
    and has no spans; an empty table gives an empty one.  A text of any length is read a
    fixed number of times; its spans are rows of their own, so they spill."""
    kept = [c for c in docs.columns if c != text and c != "found"]
    rows = docs.withColumn("__id", F.struct(F.monotonically_increasing_id().alias("at"), F.struct(*kept).alias("row")))
    found = linked(spans(rows, "__id", text), "__id", reach)
    name = F.get(F.array(*(F.lit(k[0]) for k in KINDS)), F.col("kind"))
    other = F.get(F.array(*(F.lit(k[0]) for k in KINDS)), F.col("partner.kind"))
    partner = F.when(F.col("partner").isNotNull(), F.struct(other.alias("kind"), F.col("partner.start").alias("start"), F.col("partner.end").alias("end")))
    entry = F.when(
        F.col("reported"),
        F.struct("start", F.col("kind").alias("order"), name.alias("kind"), "end", partner.alias("partner"), "credential"),
    )
    out = found.groupBy("__id").agg(F.sort_array(F.collect_list(entry)).alias("found"))
    return out.select("__id.row.*", "found")


def op3_secret_scan(spark, sf_dir: str) -> DataFrame:
    rows = scan(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    strong = F.filter("found", lambda x: x["order"] < STRONG)
    count = lambda k: F.size(F.filter("found", lambda x: x["order"] == k)).cast("long")
    joined = lambda a: F.array_join(F.transform(a, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")
    place = lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])
    link = lambda x: F.concat_ws(">", place(x), place(x["partner"]), x["credential"].cast("string"))
    return rows.select(
        "doc_id",
        *(count(k).alias(f"n_{KINDS[k][0]}") for k in range(STRONG)),
        F.sha2(joined(strong), 256).alias("base_sha256"),
        joined("found").alias("spans"),
        F.array_join(F.transform(F.filter("found", lambda x: x["partner"].isNotNull()), link), ",").alias("links"),
    )
