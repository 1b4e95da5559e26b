"""Pseudonyms for personal data in the format of what they stand for, in DataFrame operations only.

Numbers and dates that pass their checks go through a keyed Feistel network over exactly the values of their format
(cf. NIST SP 800-38G), so the map is one to one, equal values stay linked across documents and formats, and
whoever has the key can undo it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROUNDS = 10
# Dates of 1900 to 2099, as fifty cycles of four years. Only 1900 is no leap year, so one day of the cycles is missing.
FIRST_YEAR, CYCLES = 1900, 50
MONTH_DAYS = (31, 28, 31, 30, 31, 30, 31, 31, 30, 31, 30, 31)
# A day stays among those whose day and month have as many digits and read the same in either order of the two: first
# and last day, first and last month of each class.
DAY_CLASSES, MONTH_CLASSES = ((1, 9), (10, 12), (13, 31)), ((1, 9), (10, 12))

_OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
# A secret needs its context, which its hit includes.
_CONTEXT = r"(?i:password=|token = \"|token=|secret=)"
# Formats, the first that fits at a place counts. Checks beyond the format follow below.
FORMATS = {
    "secret": rf"{_CONTEXT}[A-Za-z0-9+/_-][A-Za-z0-9+/_.-]{{6,}}[A-Za-z0-9+/_-]|(?<!\w)AKIA[0-9A-Z]{{16}}(?!\w)",
    "email": r"(?<![\w.+-])[A-Za-z0-9][\w.+-]{0,63}@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+",
    "iban": r"(?<!\w)[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?!\w)",
    "card": r"(?<![\w.-])(?:\d{13,19}|\d{4}([ -])\d{4}\1\d{4}\1\d{4}|\d{4}([ -])\d{6}\2\d{5})(?![\w]|-\d)",
    "ip": rf"(?<![\w.])(?:{_OCTET}\.){{3}}{_OCTET}(?!\w|\.\d)",
    "ssn": r"(?<![\w-])(?!000|666|9\d\d)\d{3}-(?!00)\d{2}-(?!0000)\d{4}(?![\w-])",
    # A +1 or brackets make the format plain whatever the digits; a bare area code starts with 2 to 9.
    "phone": r"(?<![\w+.-])(?:(?:\+1[ .-]?(?:\(\d{3}\) ?|\d{3}[ .-])|(?:1[ .-]?)?(?:\(\d{3}\) ?|[2-9]\d{2}[ .-]))\d{3}[ .-]\d{4}"
             r"|\+[2-9]\d{0,2}(?:[ .-]?\(?\d{2,4}\)?){2,4})(?!\w)",
    "date": r"(?<![\w./-])(?:\d{4}-\d{2}-\d{2}|\d{2}/\d{2}/\d{4}|\d{1,2}\.\d{1,2}\.\d{4})(?![\w/-]|\.\d)",
}


# The groups of the card format are the only ones that capture.
ANY = "|".join(FORMATS.values())
# What a hit that is no account number after all may hold.
INNER = "|".join(form for name, form in FORMATS.items() if name not in ("secret", "iban"))
# Every format has one of these, most texts have none.
HINT = "[0-9@=]|token|AKIA"


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once."""
    return F.transform(F.array(value), use)[0]


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, r"\D", "")


def _power(n: Column) -> Column:
    return F.get(F.array(*[F.lit(10 ** i).cast("bigint") for i in range(10)]), n)


def feistel(a: Column, b: Column, a_radix: Column, b_radix: Column, kind: str, key: str) -> Column:
    """A keyed permutation of the pairs ``(a, b)`` below their radixes, as ``struct<a, b>`` of longs."""
    def as_state(a_: Column, b_: Column, ra: Column, rb: Column) -> Column:
        return F.struct(a_.cast("bigint").alias("a"), b_.cast("bigint").alias("b"),
                        ra.cast("bigint").alias("ra"), rb.cast("bigint").alias("rb"))

    def turn(s: Column, i: Column) -> Column:
        mixed = F.sha2(F.concat_ws("|", F.lit(key), F.lit(kind), s["ra"], s["rb"], i, s["b"]), 256)
        noise = F.conv(F.substring(mixed, 1, 15), 16, 10).cast("bigint")
        return as_state(s["b"], F.pmod(s["a"] + F.pmod(noise, s["ra"]), s["ra"]), s["rb"], s["ra"])

    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), as_state(a, b, a_radix, b_radix), turn)


def permuted_digits(digits: Column, kind: str, key: str) -> Column:
    """As many digits, up to 18, permuted; fewer than two stay."""
    n, half = F.char_length(digits), F.floor(F.char_length(digits) / 2).cast("int")
    out = _let(F.struct(half.alias("u"), (n - half).alias("v")), lambda p: _let(
        feistel(F.substring(digits, F.lit(1), p["u"]), F.substring(digits, p["u"] + 1, p["v"]), _power(p["u"]), _power(p["v"]),
                kind, key),
        lambda s: F.concat(F.lpad(s["a"].cast("string"), p["u"], "0"), F.lpad(s["b"].cast("string"), p["v"], "0"))))
    return F.when(n >= 2, out).otherwise(digits)


def refill(value: Column, digits: Column) -> Column:
    """``value`` with its digits replaced in order."""
    start = F.struct(F.lit("").alias("s"), F.lit(0).alias("k"))
    return F.aggregate(F.split(value, ""), start, lambda acc, c: F.when(
        c.rlike(r"^\d$"), F.struct(F.concat(acc["s"], F.substring(digits, acc["k"] + 1, F.lit(1))).alias("s"),
                                   (acc["k"] + 1).alias("k"))).otherwise(
        F.struct(F.concat(acc["s"], c).alias("s"), acc["k"].alias("k"))))["s"]


def _card(value: Column, key: str) -> Column:
    """The first digit and the length stay, and the last digit is the check digit again."""
    def body(d: Column) -> Column:
        n = F.char_length(d)
        kept = F.concat(F.substring(d, 1, 1), permuted_digits(F.substring(d, F.lit(2), n - 2), "card", key))
        return _let(kept, lambda k: F.concat(k, F.filter(
            F.array(*map(F.lit, "0123456789")), lambda c: F.call_function("luhn_check", F.concat(k, c)))[0]))

    return _let(_digits(value), lambda d: F.when(F.call_function("luhn_check", d), refill(value, body(d))))


def _phone(value: Column, key: str) -> Column:
    """Country code and the first digits of area and exchange, which mostly may not be 0 or 1, stay."""
    def american(d: Column) -> Column:
        lead = F.substring(d, F.lit(1), F.char_length(d) - 10)
        p = permuted_digits(F.concat(F.substring(d, -9, 2), F.substring(d, -6, 6)), "phone", key)
        return F.concat(lead, F.substring(d, -10, 1), F.substring(p, 1, 2), F.substring(d, -7, 1), F.substring(p, 3, 6))

    def other(d: Column) -> Column:
        return F.concat(F.substring(d, 1, 3), permuted_digits(F.substring(d, F.lit(4), F.char_length(d) - 3), "phone", key))

    return _let(_digits(value), lambda d: F.when(
        ~value.rlike(r"^\+[2-9]") & F.char_length(d).between(10, 11), refill(value, _let(d, american)))
        .when(F.char_length(d).between(7, 15), refill(value, other(d))))


def _remainder(value: Column) -> Column:
    """An account number, moved as its check wants it, modulo 97."""
    moved = F.concat(F.substring(value, F.lit(5), F.char_length(value)), F.substring(value, 1, 4))
    return F.aggregate(F.split(moved, ""), F.lit(0), lambda r, c: F.when(
        c.rlike("^[A-Z]$"), (r * 100 + F.ascii(c) - 55) % 97).when(c.rlike(r"^\d$"), (r * 10 + F.ascii(c) - 48) % 97).otherwise(r))


def _iban(value: Column, key: str) -> Column:
    """Country, letters and all digits but the last sixteen stay; the check digits are computed anew.

    What fails the check is searched for the other formats.
    """
    def account(flat: Column) -> Column:
        rest = F.substring(flat, F.lit(5), F.char_length(flat))
        d = _digits(rest)
        body = _let(d, lambda x: F.concat(
            F.substring(x, F.lit(1), F.greatest(F.char_length(x) - 16, F.lit(0))),
            permuted_digits(F.substring(x, F.greatest(F.char_length(x) - 15, F.lit(1)), F.lit(16)), "iban", key)))
        open_ = F.concat(F.substring(flat, 1, 2), F.lit("00"), refill(rest, body))
        check = _let(open_, lambda o: F.concat(F.lpad((98 - _remainder(o)).cast("string"), 2, "0"), _digits(F.substring(o, F.lit(5), F.char_length(o)))))
        return check

    def valid(flat: Column) -> Column:
        return F.char_length(flat).between(15, 34) & (_remainder(flat) == 1) & F.substring(flat, 3, 2).between("02", "98")

    def beginning(parts: Column) -> Column:
        # Words in capitals behind the number may look like parts of it: the longest beginning that passes its check counts.
        starts = F.transform(F.sequence(F.size(parts), F.lit(1), F.lit(-1)), lambda n: F.concat_ws(" ", F.slice(parts, F.lit(1), n)))
        return F.get(F.filter(starts, lambda s: valid(F.regexp_replace(s, " ", ""))), F.lit(0))

    def with_rest(start: Column) -> Column:
        rest = F.substring(value, F.coalesce(F.char_length(start), F.lit(0)) + 1, F.char_length(value))
        moved = _let(F.regexp_replace(start, " ", ""), lambda flat: refill(start, account(flat)))
        return _let(rest, lambda r: _let(_replace_all(r, INNER, key), lambda new: F.when(start.isNull(), new).otherwise(
            F.concat(moved, F.coalesce(new, r)))))

    return _let(_let(F.split(value, " "), beginning), with_rest)


def _ip(value: Column, key: str) -> Column:
    part = F.split(value, r"\.")

    def number(p: Column) -> Column:
        return feistel(p[0].cast("bigint") * 256 + p[1].cast("bigint"), p[2].cast("bigint") * 256 + p[3].cast("bigint"),
                       F.lit(65536), F.lit(65536), "ip", key)

    return _let(_let(part, number), lambda s: F.concat_ws(
        ".", F.shiftright(s["a"], 8), s["a"] % 256, F.shiftright(s["b"], 8), s["b"] % 256))


def _array(items: Iterable) -> str:
    return f"array({', '.join(map(str, items))})"


def _month_starts(days: tuple[int, int], months: tuple[int, int]) -> list[int]:
    """How many days of a class a cycle of four years has before each of its months of the class, and in all."""
    starts = [0]
    for year in range(4):
        for month in range(months[0], months[1] + 1):
            length = MONTH_DAYS[month - 1] + (month == 2 and year == 0)
            starts.append(starts[-1] + min(days[1], length) - days[0] + 1)
    return starts


def moved_day(year: Column, month: Column, day: Column, key: str) -> Column:
    """``struct<y, m, d>`` of the day that a day of 1900 to 2099 is permuted to, within its class; null for no such day."""
    tables = F.expr(_array(_array(_month_starts(d, m)) for d in DAY_CLASSES for m in MONTH_CLASSES))
    # The day that 1900 lacks: the first cycle, after the days from the 13th on in January and the others of February.
    hole = (MONTH_DAYS[0] - 12) + (MONTH_DAYS[1] - 12)
    last = F.get(F.expr(_array(MONTH_DAYS)), month - 1) + F.when(
        (month == 2) & (year % 4 == 0) & (year != FIRST_YEAR), 1).otherwise(0)
    late, day_class = month > 9, F.when(day > 12, 2).when(day > 9, 1).otherwise(0)
    first_month, months = F.when(late, 10).otherwise(1), F.when(late, 3).otherwise(9)
    first_day = F.get(F.expr(_array(d for d, _ in DAY_CLASSES)), day_class)

    def within(starts: Column) -> Column:
        rows, in_all = (year - FIRST_YEAR) % 4, F.element_at(starts, -1)
        at = F.get(starts, rows * months + month - first_month) + day - first_day

        def once(cycle: Column, place: Column) -> Column:
            return feistel(cycle, place, F.lit(CYCLES), in_all, "date", key)

        def missing(s: Column) -> Column:
            return (day_class == 2) & ~late & (s["a"] == 0) & (s["b"] == hole)

        def written(s: Column) -> Column:
            index = F.size(F.filter(starts, lambda n: n <= s["b"])) - 1
            return _let(index, lambda i: F.struct(
                (FIRST_YEAR + s["a"] * 4 + F.floor(i / months)).cast("int").alias("y"), (first_month + i % months).cast("int").alias("m"),
                (first_day + s["b"] - F.get(starts, i)).cast("int").alias("d")))

        # One day is missing, so one more step is always enough.
        return _let(_let(once(F.floor((year - FIRST_YEAR) / 4), at),
                         lambda s: F.when(missing(s), once(s["a"], s["b"])).otherwise(s)), written)

    known = year.between(FIRST_YEAR, FIRST_YEAR + 4 * CYCLES - 1) & month.between(1, 12) & day.between(1, last)
    return F.when(known, _let(F.get(tables, day_class * 2 + late.cast("int")), within))


def _date(value: Column, key: str) -> Column:
    """A day of 1900 to 2099 for such a day, written the same way; what is no such day is no date.

    With strokes the month comes first if it can. Days from the 13th on stay among themselves, and so do days and months of
    one digit: the map is one to one on what is written, each part keeps its width, and a day has one pseudonym in all formats.
    """
    def number(parts: Column, place: Column) -> Column:
        return F.get(parts, place).cast("int")

    def write(parts: Column, order: Column) -> Column:
        def written(moved: Column) -> Column:
            new = F.transform(parts, lambda part, i: F.lpad(F.get(F.array(*[moved[x].cast("string") for x in "ymd"]), F.call_function(
                "array_position", order, i).cast("int") - 1), F.char_length(part), "0"))
            return F.when(moved.isNotNull(), F.call_function("array_join", new, F.regexp_extract(value, r"\D", 0)))

        return _let(moved_day(*[number(parts, order[i]) for i in range(3)], key), written)

    def read(parts: Column) -> Column:
        # Where year, month and day are.
        month_first = ~((number(parts, F.lit(0)) > 12) & number(parts, F.lit(1)).between(1, 12))
        order = (F.when(value.contains("-"), F.expr("array(0, 1, 2)")).when(value.contains("/") & month_first, F.expr("array(2, 0, 1)"))
                 .otherwise(F.expr("array(2, 1, 0)")))
        return _let(order, lambda o: write(parts, o))

    return _let(F.split(value, "[-/.]"), read)


def _email(value: Column, key: str) -> Column:
    """Names are no numbers: a keyed digest stands for the part before the @."""
    at = F.lower(F.substring_index(value, "@", 1))
    host = F.substring_index(value, "@", -1)
    return F.concat(F.lit("u"), F.substring(F.sha2(F.concat_ws("|", F.lit(key), F.lit("email"), at, F.lower(host)), 256), 1, 12), F.lit("@"), host)


def _secret(value: Column, key: str) -> Column:
    """A keyed digest as long as the secret, of sixteen letters; its context stays."""
    def digest(secret: Column) -> Column:
        mark = F.sha2(F.concat_ws("|", F.lit(key), F.lit("secret"), secret), 256)
        return F.substring(F.repeat(mark, F.ceil(F.char_length(secret) / 64).cast("int")), F.lit(1), F.char_length(secret))

    context = F.regexp_extract(value, f"^{_CONTEXT}", 0)
    return _let(context, lambda c: F.concat(c, _let(F.substring(value, F.char_length(c) + 1, F.char_length(value)), digest)))


def _ssn(value: Column, key: str) -> Column:
    """Permuted among the valid ones: areas 001 to 899 without 666, groups from 01 and serials from 0001 on."""
    area, group, serial = (F.substring(value, at, n).cast("int") for at, n in ((1, 3), (5, 2), (8, 4)))
    place = area - F.when(area > 666, 2).otherwise(1)
    return _let(feistel(place, (group - 1) * 9999 + serial - 1, F.lit(898), F.lit(99 * 9999), "ssn", key), lambda s: F.concat_ws(
        "-", F.lpad((s["a"] + F.when(s["a"] >= 665, 2).otherwise(1)).cast("string"), 3, "0"),
        F.lpad((F.floor(s["b"] / 9999) + 1).cast("string"), 2, "0"), F.lpad((s["b"] % 9999 + 1).cast("string"), 4, "0")))


_MAKERS = {"email": _email, "card": _card, "ip": _ip, "ssn": _ssn, "phone": _phone, "date": _date}


def _kind(hit: Column) -> Column:
    """Which format a hit has: secrets and account numbers aside, the formats exclude each other."""
    out = F.when(hit.rlike(f"^(?:{_CONTEXT}|AKIA[0-9A-Z]{{16}}$)"), "secret").when(hit.contains("@"), "email")
    out = out.when(hit.rlike(r"^[A-Z]{2}\d{2}[ A-Z0-9]{8,}$"), "iban")
    out = out.when(hit.rlike(r"^(?:\d{13,19}|\d{4}([ -])\d{4}\1\d{4}\1\d{4}|\d{4}([ -])\d{6}\2\d{5})$"), "card")
    out = out.when(hit.rlike(rf"^(?:{_OCTET}\.){{3}}{_OCTET}$"), "ip")
    out = out.when(hit.rlike(r"^\d{3}-\d{2}-\d{4}$"), "ssn")
    out = out.when(hit.rlike(r"^(?:\d{4}-\d{2}-\d{2}|\d{2}/\d{2}/\d{4}|\d{1,2}\.\d{1,2}\.\d{4})$"), "date")
    return out.otherwise("phone")


def _pseudonym(hit: Column, key: str, more: dict[str, Callable[[Column, str], Column]] | None = None) -> Column:
    """What stands for a hit; null if it fails its check."""
    def chosen(kind: Column) -> Column:
        out = F.lit(None).cast("string")
        for name, make in {**_MAKERS, **(more or {})}.items():
            out = F.when(kind == name, make(hit, key)).otherwise(out)
        return out

    return _let(_kind(hit), chosen)


def _filled(text: Column, pattern: str, hits: Column, new: Column) -> Column:
    """``text`` with those hits replaced that have something new."""
    filled = F.zip_with(hits, new, lambda old, n: F.coalesce(n, old))
    between = F.split(text, pattern, -1)
    return F.array_join(F.zip_with(between, filled, lambda b, h: F.concat(b, F.coalesce(h, F.lit("")))), "")


def _replace_all(text: Column, pattern: str, key: str) -> Column:
    """``text`` with pseudonyms for what ``pattern`` finds; null if nothing passes its check."""
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    return _let(hits, lambda h: _let(F.transform(h, lambda x: _pseudonym(x, key)), lambda new: F.when(
        F.exists(new, lambda n: n.isNotNull()), _filled(text, pattern, h, new))))


def pseudonymise(docs: DataFrame, key: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, text, n_found`` for every row: the text with pseudonyms, and how many places there are.

    Card numbers (Luhn check), account numbers (modulo 97), IPv4 addresses, US social security numbers, phone numbers and
    dates are permuted within their format, one to one; e-mail names and secrets (after ``password=``, ``token=``,
    ``secret=``; access keys), which are no numbers, become keyed digests. Whoever knows ``key`` can undo the permutations, so it has no
    default. At one place a secret goes before all other formats, whatever it looks like. What fails its check stays as it
    is, but for an account number: shorter ones, then the other formats are tried inside. Equal values have equal pseudonyms in
    all rows, repeated ones too. A null text stays null with none found; other columns are ignored; an empty table gives no
    rows. Nothing is shuffled.
    """
    text = F.col("_text")
    rows = (docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("_text"))
            .withColumn("_hits", F.when(text.rlike(HINT), F.regexp_extract_all(text, F.lit(ANY), F.lit(0))))
            .withColumn("_new", F.transform("_hits", lambda hit: _pseudonym(hit, key, {"iban": _iban, "secret": _secret}))))
    return rows.select("doc_id", F.when(F.size("_hits") > 0, _filled(text, ANY, F.col("_hits"), F.col("_new"))).otherwise(text).alias("text"),
                       F.coalesce(F.size(F.array_compact("_new")), F.lit(0)).cast("bigint").alias("n_found"))
