"""Format-preserving pseudonyms: personal numbers, dates and addresses are permuted with a
keyed Feistel network inside their own format, so equal values stay linked everywhere.

Everything is a column expression: one projection, no exchange, no user functions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROUNDS = 8
#: Dates are permuted among the 270 * 270 days from 1900-01-01 on (to 2099-08-05).
FIRST_DAY, DAY_GRID = "1900-01-01", 270
#: Steps that look for a day after the twelfth; one of 3 in 5 is, so none in 64 has odds of 10^-25.
DAY_STEPS = 64

#: Kind and pattern, in order of precedence at one place of the text.  Each starts where
#: no longer run can start, so that a long run of one character class is read once.
PATTERNS: tuple[tuple[str, str], ...] = (
    ("email", r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+"),
    ("iban", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}"
             r"(?:[A-Z0-9]{11,30}|(?: [A-Z0-9]{4}){2,7}(?: [A-Z0-9]{1,3})?)(?![A-Za-z0-9])"),
    ("date", r"(?<![\w/.-])(?:[0-9]{4}-[0-9]{1,2}-[0-9]{1,2}|[0-9]{4}/[0-9]{1,2}/[0-9]{1,2}"
             r"|[0-9]{1,2}\.[0-9]{1,2}\.[0-9]{4}|[0-9]{1,2}/[0-9]{1,2}/[0-9]{4})(?![\w/-])"),
    ("ssn", r"(?<![\w-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![\w-])"),
    ("ip", r"(?<![\w.])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?![\w]|\.[0-9])"),
    ("phone", r"(?<![\w+])\+[0-9]{1,3}[ .-]?(?:\([0-9]{1,4}\)[ .-]?)?[0-9]{2,4}(?:[ .-]?[0-9]{2,4}){1,4}(?!\w)"
              r"|(?<![\w(])\([0-9]{3}\) ?[0-9]{3}-[0-9]{4}(?!\w)"
              r"|(?<![\w.-])[2-9][0-9]{2}[-.][0-9]{3}[-.][0-9]{4}(?![\w-])"),
    ("card", r"(?<![\w.-])[0-9](?:[ -]?[0-9]){12,18}(?![\w-])"),
)
ANY = "|".join(p for _, p in PATTERNS)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _round(key: str, kind: str, i: Column, half: Column) -> Column:
    """The keyed round function: 60 bits of a digest."""
    word = F.concat_ws("|", F.lit(key), F.lit(kind), i.cast("string"), half.cast("string"))
    return F.conv(F.substring(F.sha2(word, 256), 1, 15), 16, 10).cast("long")


def feistel(x: Column, low: Column, high: Column, key: str, kind: str) -> Column:
    """A keyed permutation of [0, low * high): the number is written as (x div high, x mod
    high), and the two halves are added to by turns, each modulo its own range."""

    def step(s: Column, i: Column) -> Column:
        even = i % 2 == 0
        added = F.when(even, (s.a + _round(key, kind, i, s.b) % low) % low).otherwise(
            (s.b + _round(key, kind, i, s.a) % high) % high
        )
        return F.struct(F.when(even, added).otherwise(s.a).alias("a"), F.when(even, s.b).otherwise(added).alias("b"))

    start = F.struct(F.floor(x / high).cast("long").alias("a"), (x % high).cast("long").alias("b"))
    rounds = F.array(*(F.lit(i) for i in range(ROUNDS)))
    return F.aggregate(rounds, start, step, lambda s: s.a * high + s.b)


def _ten_to(n: Column) -> Column:
    return F.rpad(F.lit("1"), n + 1, "0").cast("long")


def permuted_digits(d: Column, key: str, kind: str) -> Column:
    """A digit string of 1 to 18 digits, permuted among those of its length."""

    def mixed(n: Column) -> Column:
        half = F.floor(n / 2).cast("int")
        y = feistel(d.cast("long"), _ten_to(half), _ten_to(n - half), key, kind)
        return F.lpad(y.cast("string"), n, "0")

    return F.when(F.length(d) > 0, let(F.length(d), mixed)).otherwise(d)


def only_digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def refilled(m: Column, digits: Column) -> Column:
    """``m`` with its digits replaced, in order, by those of ``digits``."""

    def char(i: Column) -> Column:
        c = F.substring(m, i, 1)
        return F.when(c.rlike("[0-9]"), F.substring(digits, F.length(only_digits(F.substring(m, 1, i))), 1)).otherwise(c)

    return F.array_join(F.transform(F.sequence(F.lit(1), F.length(m)), char), "")


def luhn_sum(d: Column) -> Column:
    """Sum of a card number's digits, every second one from the right doubled."""

    def value(i: Column) -> Column:
        x = F.substring(d, F.length(d) - i, 1).cast("int")
        return F.when(i % 2 == 1, x * 2 - F.when(x > 4, 9).otherwise(0)).otherwise(x)

    places = F.transform(F.sequence(F.lit(0), F.length(d) - 1), value)
    return F.aggregate(places, F.lit(0), lambda a, x: a + x)


def mod97(s: Column) -> Column:
    """An IBAN's characters, moved by four and read as a number, modulo 97."""
    moved = F.concat(F.substring(s, 5, 64), F.substring(s, 1, 4))

    def step(a: Column, i: Column) -> Column:
        c = F.substring(moved, i, 1)
        v = F.when(c.rlike("[0-9]"), F.ascii(c) - 48).otherwise(F.ascii(c) - 55)
        return F.when(v > 9, (a * 100 + v) % 97).otherwise((a * 10 + v) % 97)

    return F.aggregate(F.sequence(F.lit(1), F.length(moved)), F.lit(0), step)


def _card(m: Column, key: str) -> Column:
    def body(d: Column) -> Column:
        n = F.length(d)
        inner = permuted_digits(F.substring(d, 2, n - 2), key, "card")
        head = F.concat(F.substring(d, 1, 1), inner)
        check = let(F.concat(head, F.lit("0")), lambda z: (F.lit(10) - luhn_sum(z) % 10) % 10)
        return F.when(luhn_sum(d) % 10 == 0, refilled(m, F.concat(head, check.cast("string"))))

    return let(only_digits(m), body)


def _phone(m: Column, key: str) -> Column:
    def body(d: Column) -> Column:
        lead = F.length(only_digits(F.regexp_extract(m, r"^\+[0-9]{1,3}(?=[ .(-])", 0))) + 1
        tail = permuted_digits(F.substring(d, lead + 1, F.length(d)), key, "phone")
        return F.when(F.length(d).between(8, 15), refilled(m, F.concat(F.substring(d, 1, lead), tail)))

    return let(only_digits(m), body)


def _ip(m: Column, key: str) -> Column:
    def body(o: Column) -> Column:
        x = F.aggregate(o, F.lit(0).cast("long"), lambda a, v: a * 256 + v)
        fits = F.forall(o, lambda v: v <= 255)
        y = feistel(x, F.lit(65536), F.lit(65536), key, "ip")
        parts = lambda y: F.concat_ws(".", *(F.floor(y / 256**k).cast("long") % 256 for k in (3, 2, 1, 0)))
        return F.when(fits, let(y, parts))

    return let(F.transform(F.split(m, r"\."), lambda v: v.cast("long")), body)


def _ssn(m: Column, key: str) -> Column:
    def body(p: Column) -> Column:
        area, group, serial = F.get(p, 0), F.get(p, 1), F.get(p, 2)
        valid = (area > 0) & (area != 666) & (area < 900) & (group > 0) & (serial > 0)
        row = F.when(area < 666, area - 1).otherwise(area - 2) * 99 + group - 1
        y = feistel(row * 9999 + serial - 1, F.lit(898 * 99), F.lit(9999), key, "ssn")

        def text(y: Column) -> Column:
            a = F.floor(y / (99 * 9999)).cast("long")
            a = F.when(a < 665, a + 1).otherwise(a + 2)
            g = F.floor(y / 9999).cast("long") % 99 + 1
            return F.format_string("%03d-%02d-%04d", a, g, y % 9999 + 1)

        return F.when(valid, let(y, text))

    return let(F.transform(F.split(m, "-"), lambda v: v.cast("long")), body)


def _date(m: Column, key: str) -> Column:
    """Slash dates are read month first, or day first where only that is a date.  The latter
    are permuted among themselves (days after the twelfth), so no two dates become one."""
    permuted = lambda x: feistel(x, F.lit(DAY_GRID), F.lit(DAY_GRID), key, "date")
    day_of = lambda y: F.date_add(F.lit(FIRST_DAY).cast("date"), y.cast("int"))
    short = m.rlike(r"(?<![0-9])[0-9](?![0-9])")

    def late(x: Column) -> Column:
        steps = F.sequence(F.lit(1), F.lit(DAY_STEPS))
        fits = lambda y: F.dayofmonth(day_of(y)) > 12
        step = lambda s, i: F.when((i > 1) & fits(s), s).otherwise(permuted(s))
        return F.aggregate(steps, x, step)

    def read(layout: str, move: Callable[[Column], Column]) -> Column:
        loose = layout.replace("MM", "M").replace("dd", "d")

        def body(x: Column) -> Column:
            written = lambda f: F.call_function("date_format", day_of(move(x)), F.lit(f))
            return F.when((x >= 0) & (x < DAY_GRID**2), F.when(short, written(loose)).otherwise(written(layout)))

        return let(F.datediff(F.try_to_date(m, loose), F.lit(FIRST_DAY).cast("date")).cast("long"), body)

    day_first = F.try_to_date(m, "M/d/yyyy").isNull()
    return (
        F.when(m.rlike("^[0-9]{4}-"), read("yyyy-MM-dd", permuted))
        .when(m.rlike("^[0-9]{4}/"), read("yyyy/MM/dd", permuted))
        .when(m.rlike(r"^[0-9]{1,2}\."), read("dd.MM.yyyy", permuted))
        .when(day_first, read("dd/MM/yyyy", late))
        .otherwise(read("MM/dd/yyyy", permuted))
    )


def permuted_characters(s: Column, key: str, kind: str) -> Column:
    """Digits and capitals, at least three, permuted among the strings of the same classes.

    A Feistel network over three parts, numbers of mixed radix: by turns each is added to by
    the round function of both others, modulo its own range."""
    is_digit = lambda c: c.rlike("[0-9]")
    radix = lambda c: F.when(is_digit(c), F.lit(10)).otherwise(F.lit(26)).cast("long")
    value = lambda c: (F.ascii(c) - F.when(is_digit(c), 48).otherwise(65)).cast("long")
    one = F.lit(1).cast("long")

    def text(part: Column, number: Column) -> Column:
        def step(a: Column, c: Column) -> Column:
            v = (a.left % radix(c) + 1).cast("int")
            char = F.when(is_digit(c), F.substring(F.lit("0123456789"), v, 1)).otherwise(
                F.substring(F.lit("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), v, 1)
            )
            return F.struct(F.floor((a.left - a.left % radix(c)) / radix(c)).cast("long").alias("left"), F.concat(char, a.text).alias("text"))

        start = F.struct(number.alias("left"), F.lit("").alias("text"))
        return F.aggregate(F.reverse(part), start, step, lambda a: a.text)

    def mixed(parts: Column) -> Column:
        names = "abc"
        numbers = F.struct(
            *(F.aggregate(F.get(parts, i), F.lit(0).cast("long"), lambda a, c: a * radix(c) + value(c)).alias(n) for i, n in enumerate(names))
        )

        def network(high: Column) -> Column:
            def step(x: Column, i: Column) -> Column:
                out = []
                for k, n in enumerate(names):
                    others = F.concat_ws(",", *(x[o].cast("string") for o in names if o != n))
                    added = (x[n] + _round(key, kind, i, others) % F.get(high, k)) % F.get(high, k)
                    out.append(F.when(i % 3 == k, added).otherwise(x[n]).alias(n))
                return F.struct(*out)

            rounds = F.array(*(F.lit(i) for i in range(3 * ROUNDS // 2)))
            done = F.aggregate(rounds, numbers, step)
            return let(done, lambda y: F.concat(*(text(F.get(parts, i), y[n]) for i, n in enumerate(names))))

        return let(F.transform(parts, lambda p: F.aggregate(p, one, lambda a, c: a * radix(c))), network)

    def cut(n: Column) -> Column:
        width = F.ceil(n / 3).cast("int")
        chars = F.transform(F.sequence(F.lit(1), n), lambda i: F.substring(s, i, 1))
        return let(F.array(*(F.slice(chars, width * i + 1, width) for i in range(3))), mixed)

    return let(F.length(s), cut)


def _iban(m: Column, key: str) -> Column:
    """All characters of the account in their class; accounts of up to 18 digits as one number."""

    def body(s: Column) -> Column:
        land, rest = F.substring(s, 1, 2), F.substring(s, 5, 64)
        moved = F.when(rest.rlike("^[0-9]{1,18}$"), permuted_digits(rest, key, "iban")).otherwise(
            permuted_characters(rest, key, "iban")
        )

        def spaced(new: Column) -> Column:
            def char(i: Column) -> Column:
                seen = F.length(F.regexp_replace(F.substring(m, 1, i), " ", ""))
                return F.when(F.substring(m, i, 1) == " ", F.lit(" ")).otherwise(F.substring(new, seen, 1))

            return F.array_join(F.transform(F.sequence(F.lit(1), F.length(m)), char), "")

        def checked(b: Column) -> Column:
            check = F.lit(98) - mod97(F.concat(land, F.lit("00"), b))
            return let(F.concat(land, F.lpad(check.cast("string"), 2, "0"), b), spaced)

        return F.when(mod97(s) == 1, let(moved, checked))

    return let(F.regexp_replace(m, " ", ""), body)


def _email(m: Column, key: str) -> Column:
    """The local part, character by character in its class, by a digest of the address."""
    local, domain = F.regexp_extract(m, "^[^@]+", 0), F.regexp_extract(m, "@.*$", 0)

    def body(h: Column) -> Column:
        def char(i: Column) -> Column:
            c = F.substring(local, i, 1)
            v = F.conv(F.substring(h, (i * 3) % 60 + 1, 4), 16, 10).cast("int")
            pick = lambda chars: F.substring(F.lit(chars), v % len(chars) + 1, 1)
            return (
                F.when(c.rlike("[0-9]"), pick("0123456789"))
                .when(c.rlike("[a-z]"), pick("abcdefghijklmnopqrstuvwxyz"))
                .when(c.rlike("[A-Z]"), pick("ABCDEFGHIJKLMNOPQRSTUVWXYZ"))
                .otherwise(c)
            )

        new = F.array_join(F.transform(F.sequence(F.lit(1), F.length(local)), char), "")
        return F.concat(new, domain)

    return let(F.sha2(F.concat_ws("|", F.lit(key), F.lit("email"), F.lower(m)), 256), body)


MAKERS = {"email": _email, "iban": _iban, "date": _date, "ssn": _ssn, "ip": _ip, "phone": _phone, "card": _card}


def kind_of(m: Column) -> Column:
    """The kind of a match: the first pattern that it has as a whole."""
    shapes = {
        "email": "@", "iban": "^[A-Z]", "date": r"^(?:[0-9]{4}[-/][0-9]{1,2}[-/][0-9]{1,2}|[0-9]{1,2}[./][0-9]{1,2}[./][0-9]{4})$",
        "ssn": "^[0-9]{3}-[0-9]{2}-[0-9]{4}$", "ip": r"^[0-9]{1,3}(?:\.[0-9]{1,3}){3}$",
        "phone": r"^[+(]|^[2-9][0-9]{2}[-.][0-9]{3}[-.][0-9]{4}$",
    }
    kind = F.lit("card")
    for name, shape in reversed(shapes.items()):
        kind = F.when(m.rlike(shape), F.lit(name)).otherwise(kind)
    return kind


def pseudonym(m: Column, key: str) -> Column:
    """The pseudonym of a match; null if it is not valid as its kind."""
    kind = kind_of(m)
    out = F.lit(None).cast("string")
    for name, make in reversed(MAKERS.items()):
        out = F.when(kind == name, make(m, key)).otherwise(out)
    return out


def pseudonymise(docs: DataFrame, key: str = "spanloom", text: str = "text") -> DataFrame:
    """All rows and columns of ``docs``; ``text`` with its personal data replaced, plus
    ``pii``, the kinds replaced in text order.

    Kinds: e-mail addresses, card numbers (Luhn), IBANs (modulo 97), US social security
    numbers (ranges), IPv4 addresses (octets), telephone numbers (8 to 15 digits) and
    dates (calendar).  What looks like one but is not valid stays.  The same value gets the
    same pseudonym in every document; separators, lengths, the issuer's first digit, the
    country code and check digits stay valid; a date with a one-digit day or month is written
    without leading zeros.  Addresses, SSNs, dates and whole accounts are permuted one to one; an e-mail's local part is hashed within its characters'
    classes.  A null text stays null with null ``pii``, an empty one stays empty; repeated
    rows and other columns pass (``pii`` of the input is replaced); a text of any length is
    read twice, its matches rebuilt once."""
    t = F.col(text)
    hits = F.when(t.rlike("[0-9@]"), F.regexp_extract_all(t, F.lit(f"({ANY})"), 0))
    made = F.transform(
        F.col("__hits"), lambda m: F.struct(m.alias("old"), pseudonym(m, key).alias("new"), kind_of(m).alias("kind"))
    )
    rows = docs.drop("pii").withColumn("__hits", hits).withColumn("__made", made)
    glue = F.zip_with(
        F.split(t, ANY, -1),
        "__made",
        lambda gap, h: F.concat(F.coalesce(gap, F.lit("")), F.coalesce(h["new"], h["old"], F.lit(""))),
    )
    found = F.transform(F.filter("__made", lambda h: h["new"].isNotNull()), lambda h: h["kind"])
    return rows.withColumns(
        {
            text: F.when(F.size("__made") > 0, F.array_join(glue, "")).otherwise(t),
            "pii": F.when(t.isNotNull(), F.coalesce(found, F.array().cast("array<string>"))),
        }
    ).drop("__hits", "__made")


def op7_pii_pseudonyms(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    rows = pseudonymise(docs)
    return rows.select("doc_id", "text", F.array_join("pii", ",").alias("pii"), F.size("pii").cast("long").alias("n_pii"))
