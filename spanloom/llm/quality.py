"""Quality rules: a threshold table compiled into one projection, without user functions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD, text_of, word_array

SYMBOLS = "#*$%&|<>"

#: Frequent function words of English, French, German and Spanish.
STOP_WORDS = """
the of and to in is that for with was it as be by on at this are from or a an not have
le la les de des et en un une que qui dans pour par sur au du est avec pas plus ce il
der die das und den von zu mit sich auf für ist im dem nicht ein eine als auch es an
el y los se del las por con no su para al lo como más o
""".split()

#: Languages of the list; the share of stop words is null for texts of any other.
STOP_LANGUAGES = ("en", "fr", "de", "es")

#: A rule: name, measure, lowest and highest allowed value (None: no bound on that side), and
#: the number of words from which on it speaks (a ratio of few words says nothing).
Rule = tuple[str, str, float | None, float | None, int]
RULES: tuple[Rule, ...] = (
    ("length", "n_words", 10, None, 0),
    ("word_length", "mean_word_chars", 2.0, 12.0, 20),
    ("symbols", "symbols_per_word", None, 0.1, 0),
    ("letters", "letter_words_ratio", 0.8, None, 20),
    ("capitals", "upper_ratio", None, 0.5, 20),
    ("exclamations", "exclamations_per_word", None, 0.5, 0),
    ("stop_words", "stop_word_ratio", 0.05, None, 30),
    ("repeated_lines", "dup_line_ratio", None, 0.34, 0),
    ("repeated_words", "repeat_word_ratio", None, 0.2, 0),
)
WINDOW = 5


def count_chars(text: Column, chars: str) -> Column:
    """How many characters of the text are in the class ``[chars]`` (runs of others go in
    one step, which is much faster than a translation character by character)."""
    return F.length(F.regexp_replace(text, f"[^{chars}]+", "")).cast("long")


def repeated_words(windows: Column, width: int = WINDOW) -> Column:
    """Words covered by the windows (hashes by start position) that occur twice or more.

    Only texts with a repeated window are sorted: equal hashes then stand side by side,
    and a start covers ``width`` words, or as many as lie before the next start."""
    pairs = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

    def starts_of(p: Column) -> Column:
        same = lambda x, j: F.get(p, j)["h"].eqNullSafe(x["h"])
        twice = F.filter(p, lambda x, j: same(x, j - 1) | same(x, j + 1))
        return F.sort_array(F.transform(twice, lambda x: x["i"]))

    def covered(s: Column) -> Column:
        last = F.lit(width)
        ends = F.transform(s, lambda x, j: F.least(F.coalesce(F.get(s, j + 1) - x, last), last))
        return F.aggregate(ends, F.lit(0).cast("long"), lambda a, x: a + x)

    # a one-element array binds an intermediate array to a lambda variable: built once
    starts = F.transform(F.array(pairs), starts_of)
    total = F.element_at(F.transform(starts, covered), 1)
    return F.when(F.size(F.array_distinct(windows)) == F.size(windows), F.lit(0).cast("long")).otherwise(total)


def known_language(docs: DataFrame, lang: str) -> Column:
    """Whether the language tag (``en``, ``en-GB``) is one of the list; no column: false."""
    if lang not in docs.columns:
        return F.lit(False)
    return F.coalesce(F.lower(F.regexp_extract(F.col(lang).cast("string"), "^[A-Za-z]+", 0)).isin(*STOP_LANGUAGES), F.lit(False))


def measured(docs: DataFrame, text: str = "text", lang: str = "lang") -> DataFrame:
    """All columns of ``docs`` plus ``q``, a struct of counts and ratios per document."""
    t = text_of("__t")
    rows = docs.withColumn("__t", text_of(text)).withColumn("__w", word_array(t))
    words = F.col("__w")
    n = F.size(words)
    # words are hashed first: five lookups of numbers cost a third of those of strings;
    # the last four windows are cut off
    rows = rows.withColumn("__n", n.cast("long")).withColumn("__x", F.transform(words, lambda x: F.xxhash64(x)))
    hashes = F.col("__x")
    windows = F.transform(
        hashes, lambda x, i: F.xxhash64(x, *(F.get(hashes, i + k) for k in range(1, WINDOW)))
    )
    rows = rows.withColumn("__h", F.slice(windows, 1, F.greatest(F.size(hashes) - (WINDOW - 1), F.lit(0))))
    rows = rows.withColumn("__l", F.filter(F.split(t, "\n"), lambda x: x.rlike(WORD)))
    lines = F.col("__l")
    per = lambda x, base: F.when(base > 0, x / base).otherwise(F.lit(0.0))
    counts = {
        "n_words": F.col("__n"),
        "word_chars": F.length(F.array_join(words, "")).cast("long"),
        "n_symbols": count_chars(t, SYMBOLS),
        "n_dup_lines": (F.size(lines) - F.size(F.array_distinct(lines))).cast("long"),
        "n_repeat_words": repeated_words(F.col("__h")),
        "n_lines": F.size(lines).cast("long"),
        "n_stop": F.size(F.filter(words, lambda x: F.lower(x).isin(*STOP_WORDS))).cast("long"),
        "n_letter_words": F.size(F.filter(words, lambda x: x.rlike(r"\p{L}"))).cast("long"),
        # telephone numbers, dates, amounts: neither for nor against a text
        "n_number_words": F.size(F.filter(words, lambda x: x.rlike(r"^[^\p{L}]*[0-9][^\p{L}]*$"))).cast("long"),
        "n_upper": count_chars(t, r"\p{Lu}"),
        "n_letters": count_chars(t, r"\p{L}"),
        "n_exclamations": count_chars(t, "!"),
    }
    rows = rows.withColumn("q", F.struct(*(c.alias(k) for k, c in counts.items())))
    q = F.col("q")
    ratios = {
        "mean_word_chars": per(q.word_chars, q.n_words),
        "symbols_per_word": per(q.n_symbols, q.n_words),
        "letter_words_ratio": F.when(q.n_words > q.n_number_words, q.n_letter_words / (q.n_words - q.n_number_words)),
        "upper_ratio": per(q.n_upper, q.n_letters),
        "exclamations_per_word": per(q.n_exclamations, q.n_words),
        "stop_word_ratio": F.when(known_language(docs, lang), per(q.n_stop, q.n_words)),
        "dup_line_ratio": per(q.n_dup_lines, q.n_lines),
        "repeat_word_ratio": per(q.n_repeat_words, q.n_words),
    }
    rows = rows.withColumn("q", F.struct("q.*", *(c.alias(k) for k, c in ratios.items())))
    return rows.drop("__t", "__w", "__n", "__x", "__h", "__l")


def failed_rules(q: Column, rules: Sequence[Rule] = RULES) -> Column:
    """The names of the rules that a measured document breaks, in the table's order; a null
    measure breaks none."""
    checks = []
    for name, measure, low, high, words in rules:
        broken = F.lit(False)
        if low is not None:
            broken = broken | (q[measure] < low)
        if high is not None:
            broken = broken | (q[measure] > high)
        checks.append(F.when(broken & (q["n_words"] >= words), F.lit(name)))
    return F.filter(F.array(*checks), lambda x: x.isNotNull())


def apply_rules(docs: DataFrame, rules: Sequence[Rule] = RULES, text: str = "text", lang: str = "lang") -> DataFrame:
    """All rows and columns of ``docs`` plus ``q`` (measures), ``failed`` (rule names) and
    ``kept``.

    One narrow projection: no exchange, no user functions; the cost of a document is
    linear in its text (n log n if it has a repeated window).  The measures pass through a
    generator of one row, so a filter on ``kept``, ``failed`` or ``q`` reads what was
    computed; pushed below the projection it would build every measure anew.

    A null text counts as an empty one and fails ``length``.  ``stop_words`` speaks for the
    languages of the list only: texts of another, a null or no tag pass it.  Repeated rows are
    judged each on its own; an empty table gives an empty one; other columns pass through
    (``q``, ``failed``, ``kept`` of the input are replaced)."""
    docs = docs.drop("q", "failed", "kept")
    rows = measured(docs, text, lang)
    rows = rows.select(*(F.col(f"`{c}`") for c in docs.columns), F.explode_outer(F.array("q")).alias("q"))
    rows = rows.withColumn("failed", failed_rules(F.col("q"), rules))
    return rows.withColumn("kept", F.size("failed") == 0)


def kept_documents(docs: DataFrame, rules: Sequence[Rule] = RULES, text: str = "text", lang: str = "lang") -> DataFrame:
    """The rows of ``docs`` that no rule rejects, with their columns (those named like a
    verdict included)."""
    tag = F.col(lang) if lang in docs.columns else F.lit(None).cast("string")
    rows = docs.select(F.struct(*docs.columns).alias("__row"), F.col(text).alias("__text"), tag.alias("__lang"))
    return apply_rules(rows, rules, "__text", "__lang").filter("kept").select("__row.*")


def op8_quality_rules(spark, sf_dir: str) -> DataFrame:
    rows = apply_rules(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang"))
    q = F.col("q")
    base = (q.n_words < 10) | (100 * q.n_repeat_words > 20 * q.n_words)
    return rows.select(
        "doc_id",
        *(q[c].alias(c) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")),
        base.alias("base_failed"),
        (~base & F.col("kept")).alias("kept"),
    )


#: DuckDB counterpart of the registered query.
SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t,
         coalesce(lower(regexp_extract(lang, '^[A-Za-z]+')) IN ('en', 'fr', 'de', 'es'), false) AS known FROM documents),
w AS (
  SELECT rid, doc_id, t, known, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws,
         list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d),
g AS (
  SELECT rid, i, list_slice(ws, i, i + 4) AS win
  FROM w, unnest(range(1, len(ws) - 3)) AS u(i)),
r AS (SELECT rid, i, count(*) OVER (PARTITION BY rid, win) AS n FROM g),
s AS (
  SELECT rid, sum(least(5, coalesce(nx - i, 5))) AS n_rep
  FROM (SELECT rid, i, lead(i) OVER (PARTITION BY rid ORDER BY i) AS nx FROM r WHERE n > 1)
  GROUP BY rid),
m AS (
  SELECT w.doc_id, known, len(ws) AS n_words,
         length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS word_chars,
         length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
         len(ls) - len(list_distinct(ls)) AS n_dup_lines, len(ls) AS n_lines,
         CAST(coalesce(n_rep, 0) AS BIGINT) AS n_repeat_words,
         len(list_filter(ws, lambda x: list_contains(string_split('{stop}', ' '), lower(x)))) AS n_stop,
         len(list_filter(ws, lambda x: regexp_matches(x, '\p{L}'))) AS n_letter_words,
         len(list_filter(ws, lambda x: regexp_matches(x, '^[^\p{L}]*[0-9][^\p{L}]*$'))) AS n_numbers,
         length(regexp_replace(t, '\P{Lu}', '', 'g')) AS n_upper,
         length(regexp_replace(t, '\P{L}', '', 'g')) AS n_letters,
         length(regexp_replace(t, '[^!]', '', 'g')) AS n_excl
  FROM w LEFT JOIN s ON w.rid = s.rid),
b AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM m)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars,
       CAST(n_symbols AS BIGINT) AS n_symbols, CAST(n_dup_lines AS BIGINT) AS n_dup_lines,
       n_repeat_words, base_failed,
       NOT base_failed AND n_symbols / n_words <= 0.1 AND n_excl / n_words <= 0.5
         AND n_dup_lines / n_lines <= 0.34
         AND (n_words < 20 OR (word_chars / n_words BETWEEN 2.0 AND 12.0
              AND (n_words = n_numbers OR n_letter_words / (n_words - n_numbers) >= 0.8)
              AND (n_letters = 0 OR n_upper / n_letters <= 0.5)))
         AND (n_words < 30 OR NOT known OR n_stop / n_words >= 0.05) AS kept
FROM b
""".replace("{stop}", " ".join(STOP_WORDS))
