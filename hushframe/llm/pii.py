"""PII pseudonyms that keep their format, by keyed Feistel permutations in plain DataFrame functions.

One pattern finds all kinds in one pass over a text; each match is validated and permuted inside the set of
values of its kind and class, so equal values get equal pseudonyms in every document, different values of a kind
get different ones, and lengths, separators, check digits and calendar validity are kept. Sets are products of two
ranges that are covered exactly, so no value of one class can take the pseudonym of another:
  dates        calendar days of 1900 to 2099 are permuted among those days, others within their year; days written
               month first, with a day above 12, among the days so written; what is no calendar day stays
  phones       North American numbers with valid area and exchange codes, with an invalid area code, and with only
               an invalid exchange code, each among their like; others by digits after the country code
  cards        13 to 19 digits: the first digit stays; if the Luhn digit was right it is right again
  SSNs         areas 001-665 and 667-899, groups 01-99, serials 0001-9999 among themselves; so are those with
               another area, with group 00, and with serial 0000
  IBANs        country stays, letters and digits are permuted by class, check digits are recomputed if they
               were right
  IPv4         the two last octets' pair and the two first octets' pair are permuted
  e-mails      letters and digits of the local part are permuted within their classes; the domain stays
  secrets      AKIA keys, 32 hex digits or more, and values after password=, token= and the like

The permutation alternates two halves (a mod m, b mod n) with sums of keyed SHA-256 values, so any product
m*n is a valid domain. The key decides everything and has no default: who has it can undo the pseudonyms. The
registered query takes it from the session's setting spark.hushframe.pii.secret, a name that Spark hides in its UI and
logs; where that is unset it draws one for the run, with a warning, which then links values within that run only. Plans
hold no key either: it is a row of a local table, which joins every document.

Defined results: null texts stay null; empty texts and texts without matches come back unchanged; other
columns are left as they are; repeated rows get equal results; an empty table gives an empty result.
"""

from __future__ import annotations

import secrets
import warnings
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents

ROUNDS = 8
#: The session's setting that holds the key.
KEY_SETTING = "spark.hushframe.pii.secret"

EMAIL = r"[A-Za-z0-9][A-Za-z0-9._%+-]{0,63}@[A-Za-z0-9](?:[A-Za-z0-9.-]{0,250}[A-Za-z0-9])?\.[A-Za-z]{2,24}"
AKIA = r"(?<![A-Za-z0-9])AKIA[0-9A-Z]{16}(?![A-Za-z0-9])"
SECRET = r"(?i:password|passwd|token|secret|api_key)\s{0,3}[=:]\s{0,3}[\"']?[A-Za-z0-9]{8,}+"
HEX = r"(?<![A-Za-z0-9])(?:[0-9a-f]{32,}+|[0-9A-F]{32,}+)(?![A-Za-z0-9])"
ISO_DATE = r"(?<![0-9])[0-9]{4}-(?:0[1-9]|1[0-2])-(?:0[1-9]|[12][0-9]|3[01])(?![0-9])"
DMY_DATE = r"(?<![0-9/.])(?:0[1-9]|[12][0-9]|3[01])[./](?:0[1-9]|[12][0-9]|3[01])[./](?:19|20)[0-9]{2}(?![0-9])"
SSN = r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"
NANP = r"(?:\+1[ .-]?)?(?:\([0-9]{3}\) ?|(?<![0-9])[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9])"
ABROAD = r"\+[0-9]{1,3}[ .-]?(?:\([0-9]{1,4}\)[ .-]?)?[0-9]{2,4}(?:[ .-]?[0-9]{2,4}){1,4}(?![0-9])"
IBAN = r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"
IPV4 = r"(?<![0-9.])(?:(?:25[0-5]|2[0-4][0-9]|1?[0-9]{1,2})\.){3}(?:25[0-5]|2[0-4][0-9]|1?[0-9]{1,2})(?![0-9]|\.[0-9])"
CARD = r"(?<![0-9])[0-9](?:[ -]?[0-9]){12,18}(?![0-9])"
KINDS = {"email": EMAIL, "secret": SECRET, "akia": AKIA, "hex": HEX, "date": ISO_DATE, "dmy": DMY_DATE, "ssn": SSN, "nanp": NANP, "card": CARD, "abroad": ABROAD, "iban": IBAN, "ipv4": IPV4}
#: Kinds that begin with a letter or digit are tried only where a word begins.
_AT_WORD = "|".join(f"(?:{p})" for k, p in KINDS.items() if k not in ("nanp", "card", "abroad"))
ANY = f"(?<![A-Za-z0-9])(?:{_AT_WORD})|(?:{NANP})|(?:{CARD})|(?:{ABROAD})"
#: Every match holds one of these, so texts without them are passed over.
HINT = "[0-9@=:]|AKIA[A-Z]{16}|[a-f]{32}|[A-F]{32}"

_LOWER = "abcdefghijklmnopqrstuvwxyz"
_BASE26 = "0123456789abcdefghijklmnop"


def let(value: Column, use) -> Column:
    """use(value) with the value computed once and written into the expression once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def feistel(a: Column, b: Column, m: Column | int, n: Column | int, key: Column | str, tweak: Column | str) -> Column:
    """A keyed permutation of the pairs (a, b) with a below m and b below n, as a struct. Rounds are a fold, so
    the expression does not double in size with every round."""
    m = m if isinstance(m, Column) else F.lit(m).cast("long")
    n = n if isinstance(n, Column) else F.lit(n).cast("long")

    def step(s: Column, k: Column) -> Column:
        left = F.pmod(s["a"] + _noise_at(key, tweak, k, s["b"], m), m)
        right = F.pmod(s["b"] + _noise_at(key, tweak, k, s["a"], n), n)
        even = k % 2 == 0
        return F.struct(F.when(even, left).otherwise(s["a"]).alias("a"), F.when(even, s["b"]).otherwise(right).alias("b"))

    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), F.struct(a.cast("long").alias("a"), b.cast("long").alias("b")), step)


def _noise_at(key: Column | str, tweak: Column | str, k: Column, x: Column, modulus: Column) -> Column:
    named = [c if isinstance(c, Column) else F.lit(c) for c in (key, tweak)]
    seed = F.concat_ws("|", *named, k.cast("string"), x.cast("string"))
    return F.pmod(F.conv(F.substring(F.sha2(seed, 256), 1, 14), 16, 10).cast("long"), modulus)


def permute_run(run: Column, base: int, key: Column | str, tweak: Column | str) -> Column:
    """Permute a string of digits of one base (10, 16, 26 as 0-9a-p, or 36, lower case), 10 digits at a time; the place of
    such a block counts, so equal blocks of a value become different."""

    number = lambda t: F.when(F.length(t) == 0, F.lit(0).cast("long")).otherwise(F.conv(t, base, 10).cast("long"))
    power = lambda e: F.round(F.pow(F.lit(float(base)), e)).cast("long")
    text = lambda v, w: F.when(w == 0, F.lit("")).otherwise(F.lpad(F.lower(F.conv(v.cast("string"), 10, base)), w, "0"))

    def halves(piece: Column) -> Column:
        half = F.floor(F.length(piece) / 2).cast("int")
        return F.struct(F.substring(piece, F.lit(1), half).alias("l"), F.substring(piece, half + 1, F.length(piece)).alias("r"))

    def part(i: Column) -> Column:
        def mixed(s: Column) -> Column:
            w, x = F.length(s["l"]), F.length(s["r"])
            return let(feistel(number(s["l"]), number(s["r"]), power(w), power(x), key, F.concat_ws("|", F.lit(f"{tweak}|{base}"), i.cast("string"))), lambda f: F.concat(text(f["a"], w), text(f["b"], x)))

        return let(let(F.substring(run, i * 10 + 1, F.lit(10)), halves), mixed)

    return F.array_join(F.transform(F.sequence(F.lit(0), F.floor((F.length(run) - 1) / 10).cast("int")), part), "")


def _digits(v: Column) -> Column:
    return F.regexp_replace(v, "[^0-9]", "")


def _refill(shape: Column, digits: Column) -> Column:
    """Put digits where the shape has digits."""
    def place(s: Column, c: Column) -> Column:
        digit = c.between("0", "9")
        return F.struct(F.concat(s["out"], F.when(digit, F.substring(digits, s["used"] + 1, F.lit(1))).otherwise(c)).alias("out"), (s["used"] + digit.cast("int")).alias("used"))

    return F.aggregate(F.split(shape, ""), F.struct(F.lit("").alias("out"), F.lit(0).alias("used")), place, lambda s: s["out"])


def replace_each(text: Column, pattern: str, change) -> Column:
    """Replace every match by change(match)."""
    gaps = F.split(text, pattern, -1)
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    return F.concat(F.element_at(gaps, 1), F.array_join(F.zip_with(F.transform(hits, change), F.slice(gaps, 2, F.greatest(F.size(gaps) - 1, F.lit(0))), lambda h, g: F.concat(h, g)), ""))


def _by_class(v: Column, key: Column | str, tweak: Column | str) -> Column:
    """Permute digits, lower-case and upper-case letters, each within its class, others staying. The two halves of the value
    take turns: each character is moved within its class by a number that depends on the whole other half and its place."""
    tweak = tweak if isinstance(tweak, Column) else F.lit(tweak)

    def moved(half: Column, other: Column, k: Column) -> Column:
        noise = F.transform(F.sequence(F.lit(0), F.floor(F.length(half) / 16).cast("int")), lambda j: F.sha2(F.concat_ws("|", key if isinstance(key, Column) else F.lit(key), tweak, k.cast("string"), j.cast("string"), other), 256))

        def one(c: Column, at: Column, noise: Column) -> Column:
            step = F.conv(F.substring(F.element_at(noise, F.floor(at / 16).cast("int") + 1), F.pmod(at, F.lit(16)) * 4 + 1, F.lit(4)), 16, 10).cast("int")
            turn = lambda first, size: F.char(F.lit(ord(first)) + F.pmod(F.ascii(c) - ord(first) + step, F.lit(size)))
            return F.when(c.between("0", "9"), turn("0", 10)).when(c.between("a", "z"), turn("a", 26)).when(c.between("A", "Z"), turn("A", 26)).otherwise(c)

        return let(noise, lambda some: F.array_join(F.transform(F.split(half, ""), lambda c, at: one(c, at, some)), ""))

    def step(s: Column, k: Column) -> Column:
        even = k % 2 == 0
        new = moved(F.when(even, s["l"]).otherwise(s["r"]), F.when(even, s["r"]).otherwise(s["l"]), k)
        return let(new, lambda x: F.struct(F.when(even, x).otherwise(s["l"]).alias("l"), F.when(even, s["r"]).otherwise(x).alias("r")))

    half = F.floor(F.length(v) / 2).cast("int")
    start = F.struct(F.substring(v, F.lit(1), half).alias("l"), F.substring(v, half + 1, F.length(v)).alias("r"))
    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, step, lambda s: F.concat(s["l"], s["r"]))


def _two(v: Column, w: int) -> Column:
    return F.lpad(v.cast("string"), w, "0")


#: 17 * 4297 days from 1900-01-01 to 2099-12-31.
_SHORT, _LONG = 17, 4297


def _day(date: Column, key: Column | str) -> Column:
    """The pseudonym of a calendar day."""
    epoch = F.lit("1900-01-01").cast("date")
    since = F.datediff(date, epoch)
    side = F.lit(_LONG)
    inside = let(feistel(F.floor(since / side), F.pmod(since, side), _SHORT, _LONG, key, "date"), lambda f: F.date_add(epoch, (f["a"] * side + f["b"]).cast("int")))

    def within(s: Column) -> Column:
        m, n = F.when(s["leap"], F.lit(61)).otherwise(73).cast("long"), F.when(s["leap"], F.lit(6)).otherwise(5).cast("long")
        return let(feistel(F.floor(s["at"] / n), F.pmod(s["at"], n), m, n, key, "day"), lambda f: F.date_add(s["start"], (f["a"] * n + f["b"]).cast("int")))

    start = F.trunc(date, "year")
    other = let(F.struct(start.alias("start"), (F.datediff(F.add_months(start, 12), start) == 366).alias("leap"), (F.dayofyear(date) - 1).cast("long").alias("at")), within)
    return F.when((since >= 0) & (since < _SHORT * _LONG), inside).otherwise(other)


def _calendar(year: Column, month: Column, day: Column) -> Column:
    """The day, null if there is no such one."""
    return F.try_to_timestamp(F.concat_ws("-", year, month, day), F.lit("yyyy-MM-dd")).cast("date")


def _date(v: Column, key: Column | str) -> Column:
    day = let(_calendar(F.substring(v, 1, 4), F.substring(v, 6, 2), F.substring(v, 9, 2)), lambda d: F.date_format(_day(d, key), "yyyy-MM-dd"))
    return F.coalesce(day, v)


#: Months with 30 days or more, and with 31.
_WITH_30, _WITH_31 = [1, 3, 4, 5, 6, 7, 8, 9, 10, 11, 12], [1, 3, 5, 7, 8, 10, 12]


def _month_first(date: Column, key: Column | str) -> Column:
    """The pseudonym of a calendar day above the 12th of 1900 to 2099, among such days: the 13th to the 28th of all
    months; the 29th, 30th and 31st each over the months that have them; the 29th of February over leap years."""
    year, month, day = (F.year(date) - 1900).cast("long"), F.month(date).cast("long"), F.dayofmonth(date).cast("long")
    shown = lambda y, m, d: F.concat(_two(m, 2), _two(d, 2), (y + 1900).cast("string"))
    common = let(feistel(year * 12 + month - 1, day - 13, 2400, 16, key, "mdy"), lambda f: shown(F.floor(f["a"] / 12), f["a"] % 12 + 1, f["b"] + 13))

    def late(months: list[int], tweak: str) -> Column:
        some = F.array(*[F.lit(m).cast("long") for m in months])
        at = F.array_position(some, month) - 1
        return let(feistel(year, at, 200, len(months), key, tweak), lambda f: shown(f["a"], F.element_at(some, (f["b"] + 1).cast("int")), day))

    leap = F.floor(year / 4) - 1
    leap_day = let(feistel(F.floor(leap / 7), leap % 7, 7, 7, key, "leap"), lambda f: shown((f["a"] * 7 + f["b"] + 1) * 4, month, day))
    return F.when(day <= 28, common).when((day == 29) & (month == 2), leap_day).when(day == 31, late(_WITH_31, "31st")).otherwise(late(_WITH_30, "30th"))


def _dmy(v: Column, key: Column | str) -> Column:
    """Day first, unless only month first is a calendar day."""
    a, b, y = F.substring(v, 1, 2), F.substring(v, 4, 2), F.substring(v, 7, 4)
    day_first = let(_calendar(y, b, a), lambda d: F.date_format(_day(d, key), "ddMMyyyy"))
    month_first = let(_calendar(y, a, b), lambda d: _month_first(d, key))
    text = F.when(b.cast("int") <= 12, day_first).when(a.cast("int") <= 12, month_first)
    return F.coalesce(_refill(v, text), v)


def _nanp(v: Column, key: Column | str) -> Column:
    def numbered(d: Column) -> Column:
        ten = F.right(d, F.lit(10))
        return F.struct(
            F.when(F.length(d) == 11, F.substring(d, 1, 1)).otherwise("").alias("country"),
            ten.alias("ten"),
        )

    def new(s: Column) -> Column:
        area, exchange, line = (F.substring(s["ten"], k, n).cast("long") for k, n in ((1, 3), (4, 3), (7, 4)))
        show = lambda area, exchange, line: F.concat(s["country"], _two(area, 3), _two(exchange, 3), _two(line, 4))
        good = let(feistel((area - 200) * 100 + F.floor(line / 100), (exchange - 200) * 100 + line % 100, 80000, 80000, key, "nanp"), lambda f: show(F.floor(f["a"] / 100) + 200, F.floor(f["b"] / 100) + 200, f["a"] % 100 * 100 + f["b"] % 100))
        no_area = let(feistel(area * 100 + F.floor(line / 100), exchange * 100 + line % 100, 20000, 100000, key, "area"), lambda f: show(F.floor(f["a"] / 100), F.floor(f["b"] / 100), f["a"] % 100 * 100 + f["b"] % 100))
        no_exchange = let(feistel((area - 200) * 100 + F.floor(line / 100), exchange * 100 + line % 100, 80000, 20000, key, "exchange"), lambda f: show(F.floor(f["a"] / 100) + 200, F.floor(f["b"] / 100), f["a"] % 100 * 100 + f["b"] % 100))
        return F.when(area < 200, no_area).when(exchange < 200, no_exchange).otherwise(good)

    return _refill(v, let(let(_digits(v), numbered), new))


def _abroad(v: Column, key: Column | str) -> Column:
    """Digits after the first three, which hold the country code, are permuted."""
    return _refill(v, let(_digits(v), lambda d: F.concat(F.substring(d, 1, 3), permute_run(F.substring(d, F.lit(4), F.length(d)), 10, key, "phone"))))


def _luhn_digit(body: Column) -> Column:
    """The digit that makes body pass the Luhn test."""
    digits = F.transform(F.sequence(F.lit(0), F.lit(9)), lambda c: c.cast("string"))
    return F.element_at(F.filter(digits, lambda c: F.call_function("luhn_check", F.concat(body, c))), 1).cast("int")


def _card(v: Column, key: Column | str) -> Column:
    """The last digit keeps its distance from the right one, so right stays right and wrong stays wrong."""
    def new(d: Column) -> Column:
        n = F.length(d)
        body = F.concat(F.substring(d, 1, 1), permute_run(F.substring(d, F.lit(2), n - 2), 10, key, "card"))
        off = F.right(d, F.lit(1)).cast("int") - _luhn_digit(F.substring(d, F.lit(1), n - 1))
        return let(body, lambda x: F.concat(x, F.pmod(_luhn_digit(x) + off, F.lit(10)).cast("string")))

    return _refill(v, let(_digits(v), new))


def _ssn(v: Column, key: Column | str) -> Column:
    """Areas 001-665 and 667-899 are 898 in a row; the other 102 are 000, 666 and 900-999."""
    area, group, serial = F.substring(v, 1, 3).cast("long"), F.substring(v, 5, 2).cast("long"), F.substring(v, 8, 4).cast("long")
    row = F.when(area > 666, area - 2).otherwise(area - 1)
    odd = F.when(area == 0, 0).when(area == 666, 1).otherwise(area - 898).cast("long")
    good = lambda r: F.when(r >= 665, r + 2).otherwise(r + 1)
    bad = lambda r: F.when(r == 0, 0).when(r == 1, 666).otherwise(r + 898)
    show = lambda area, group, serial: F.concat_ws("-", _two(area, 3), _two(group, 2), _two(serial, 4))
    valid = let(feistel(row * 99 + group - 1, serial - 1, 898 * 99, 9999, key, "ssn"), lambda f: show(good(F.floor(f["a"] / 99)), f["a"] % 99 + 1, f["b"] + 1))
    other_area = let(feistel(odd * 100 + group, serial, 10200, 10000, key, "ssn area"), lambda f: show(bad(F.floor(f["a"] / 100)), f["a"] % 100, f["b"]))
    no_group = let(feistel(row, serial, 898, 10000, key, "ssn group"), lambda f: show(good(f["a"]), F.lit(0), f["b"]))
    no_serial = let(feistel(row, group - 1, 898, 99, key, "ssn serial"), lambda f: show(good(f["a"]), f["b"] + 1, F.lit(0)))
    return F.when((area == 0) | (area == 666) | (area >= 900), other_area).when(group == 0, no_group).when(serial == 0, no_serial).otherwise(valid)


def _iban_rest(plain: Column) -> Column:
    """Remainder by 97 of the rearranged number, folded over characters."""
    turned = F.concat(F.substring(plain, F.lit(5), F.length(plain)), F.substring(plain, 1, 4))
    codes = F.transform(F.split(turned, ""), lambda c: F.when(c.rlike("[0-9]"), F.ascii(c) - 48).otherwise(F.ascii(c) - 55))
    return F.aggregate(codes, F.lit(0).cast("long"), lambda s, x: F.pmod(s * F.when(x >= 10, F.lit(100)).otherwise(10) + x, F.lit(97)).cast("long"))


def _iban(v: Column, key: Column | str) -> Column:
    country = F.substring(v, 1, 2)

    def new(plain: Column) -> Column:
        body = _by_class(F.substring(plain, F.lit(5), F.length(plain)), key, "iban")
        right = _iban_rest(plain) == 1
        return let(body, lambda x: F.concat(country, F.when(right, _two(98 - _iban_rest(F.concat(country, F.lit("00"), x)), 2)).otherwise(F.substring(plain, 3, 2)), x))

    def spaced(x: Column) -> Column:
        place = lambda s, c: F.struct(F.concat(s["out"], F.when(c == " ", c).otherwise(F.substring(x, s["used"] + 1, F.lit(1)))).alias("out"), (s["used"] + (c != " ").cast("int")).alias("used"))
        return F.aggregate(F.split(v, ""), F.struct(F.lit("").alias("out"), F.lit(0).alias("used")), place, lambda s: s["out"])

    return let(let(F.replace(v, F.lit(" "), F.lit("")), new), spaced)


def _ipv4(v: Column, key: Column | str) -> Column:
    p = F.split(v, r"\.")
    o = [p[k].cast("long") for k in range(4)]
    octets = lambda x: [F.floor(x / 256).cast("string"), (x % 256).cast("string")]
    return let(feistel(o[0] * 256 + o[1], o[2] * 256 + o[3], 65536, 65536, key, "ipv4"), lambda f: F.concat_ws(".", *octets(f["a"]), *octets(f["b"])))


def _email(v: Column, key: Column | str) -> Column:
    """The name, by a permutation of its domain's own."""
    at = F.instr(v, "@")
    return let(F.substring(v, at, F.length(v)), lambda domain: F.concat(_by_class(F.substring(v, F.lit(1), at - 1), key, F.concat(F.lit("email|"), domain)), domain))


def _hex(v: Column, key: Column | str) -> Column:
    new = permute_run(F.lower(v), 16, key, "hex")
    return F.when(v.rlike("[A-F]"), F.upper(new)).otherwise(new)


def _akia(v: Column, key: Column | str) -> Column:
    return F.concat(F.lit("AKIA"), F.upper(permute_run(F.lower(F.substring(v, 5, 16)), 36, key, "akia")))


def _secret(v: Column, key: Column | str) -> Column:
    value = F.regexp_extract(v, "[A-Za-z0-9]+$", 0)
    new = F.when(value.rlike("^(?:[0-9a-f]+|[0-9A-F]+)$"), _hex(value, key)).otherwise(_by_class(value, key, "secret"))
    return F.concat(F.substring(v, F.lit(1), F.length(v) - F.length(value)), new)


_CHANGE = {"email": _email, "secret": _secret, "akia": _akia, "hex": _hex, "date": _date, "dmy": _dmy, "ssn": _ssn, "nanp": _nanp, "card": _card, "abroad": _abroad, "iban": _iban, "ipv4": _ipv4}


def pseudonym(value: Column, key: Column | str) -> Column:
    """The pseudonym of one whole match, by the first kind that it fits."""
    kinds = [(value.rlike(f"^(?:{pattern})$"), _CHANGE[kind](value, key)) for kind, pattern in KINDS.items()]
    return F.coalesce(reduce(lambda chain, case: chain.when(*case), kinds[1:], F.when(*kinds[0])), value)


def pseudonymise(docs: DataFrame, key: str, text_col: str = "text", hits_col: str | None = None) -> DataFrame:
    """docs with PII in text_col replaced; all other columns as they are. hits_col: keeps the matches there."""
    hits, secret = hits_col or _free_name(docs, "hits"), _free_name(docs, "secret")
    text = F.col(f"`{text_col}`")
    # One row; as a literal the key would stand in every plan.
    keys = docs.sparkSession.sql(f"SELECT * FROM VALUES (:key) AS t(`{secret}`)", {"key": key})
    # The matches are a column of their own, so that both uses read one search.
    found = docs.withColumn(hits, F.when(text.rlike(HINT), F.regexp_extract_all(text, F.lit(ANY), F.lit(0)))).crossJoin(F.broadcast(keys))
    changed = F.transform(F.col(f"`{hits}`"), lambda v: pseudonym(v, F.col(f"`{secret}`")))
    gaps = F.split(text, ANY, -1)
    whole = F.array_join(F.flatten(F.zip_with(gaps, F.concat(changed, F.array(F.lit(""))), lambda g, h: F.array(g, h))), "")
    out = found.withColumn(text_col, F.when(F.size(F.col(f"`{hits}`")) > 0, whole).otherwise(text)).drop(secret)
    return out if hits_col else out.drop(hits)


def _free_name(docs: DataFrame, name: str) -> str:
    while name in docs.columns:
        name += "_"
    return name


def session_key(spark: SparkSession) -> str:
    """The key of the session's setting, or one drawn for this run where it is unset."""
    key = spark.conf.get(KEY_SETTING, None)
    if not key:
        warnings.warn(f"{KEY_SETTING} is not set: pseudonyms of this run have a key of their own", stacklevel=2)
    return key or secrets.token_hex(16)


def op6_pii_feistel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its PII replaced, and how many values were."""
    found = pseudonymise(documents(spark, sf_dir).select("doc_id", "text"), session_key(spark), hits_col="hits")
    return found.select("doc_id", "text", F.when(F.size("hits") > 0, F.size("hits")).otherwise(0).cast("long").alias("n_replaced"))
