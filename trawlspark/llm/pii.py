"""Pseudonyms for personal data by format-preserving permutation, in DataFrame functions only.

Found are e-mail addresses, IPv4 addresses, phone numbers in international notation,
payment card numbers (13 to 19 digits that pass the Luhn check, spaces or hyphens
between groups allowed; other digits may stand before or after them), social security numbers (3-2-4 digits), dates and secrets
(runs of 32 to 64 letters and digits with both of them). What looks like one but does
not validate stays: a number that fails the Luhn check, an octet beyond 255, the 31st
of February.

A value's digits are permuted by an alternating Feistel network over strings of the
same length and alphabet, with a keyed SHA-256 as round function, so equal values get
equal pseudonyms in all documents and different values different ones:

* cards: all digits but the last, then a new Luhn digit; separators stay
* phones: all digits but the country code, which the plan of calling codes tells from the rest, so that a number is linked
  in all its groupings; social security numbers: all digits
* IPv4: the 32 bits, as 8 hexadecimal digits; octets written with leading zeros stay three digits long
* dates: the day's number in its block of 100,000 days, counted from 1900-01-01; the notation stays. A date with slashes is
  month first, or day first where that is no date. Years from 19 to 9839
* secrets: hexadecimal ones within hexadecimal digits, others within letters and digits
* e-mail: the local part is keyed-hashed, since its format is free; the domain becomes
  ``mail.invalid``

Defined results: a null text stays null with n_found 0, an empty one empty; repeated rows
come back as often as they are there, with the same text; where two kinds could match, the
first of e-mail, secret, date, IPv4, phone, social security number, card counts; extra columns
are kept; an empty table gives no rows; a text of any length is one row's work.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROUNDS = 10
KEY = "trawlspark"  # a default for tests; pass the corpus's own
DAYS_FROM, DAYS = "1900-01-01", 100_000
#: Days of the whole blocks within four-digit years.
BLOCKS = (-687_000, 2_899_999)
#: Calling codes of one and two digits (fixed values of the international plan); all others have three.
COUNTRY = r"^(?:[17]|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|\d{3})"
DIGITS, HEX = "0123456789", "0123456789abcdef"
ALNUM = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"

EMAIL = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+"
SECRET = r"(?<![A-Za-z0-9])(?=[A-Za-z]*[0-9])(?=[0-9]*[A-Za-z])[A-Za-z0-9]{32,64}(?![A-Za-z0-9])"
DATE = r"(?<![\w.-])(?:\d{4}-\d{2}-\d{2}|\d{2}[./]\d{2}[./]\d{4})(?![\w-]|\.\d)"
IPV4 = r"(?<![\w.])\d{1,3}(?:\.\d{1,3}){3}(?![\w]|\.\d)"
SSN = r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])"
#: Where another value starts: a number before it ends there.
OTHER = "|".join((EMAIL, DATE, IPV4, SSN))

# A phone number is at most 15 digits (ten after +1). The lookbehinds count them at the end of a match, so the groups
# given up are those beyond one number, and whatever matches validates.


def _digits(least: int, most: int) -> str:
    """Digits with separators before them; Java takes no repeated groups of several lengths in a lookbehind."""
    one = r"[ .()-]{0,3}\d"
    return one * least + f"(?:{one}" * (most - least) + ")?" * (most - least)


_VALID = rf"(?<=\+(?:\d{{1,3}}(?=[ .(-])|\d(?!\d{{0,2}}[ .(-])){_digits(7, 14)})"
_ONE_NUMBER = rf"(?<=\+1(?!\d{{1,2}}[ .(-]){_digits(7, 10)}|\+(?!1(?!\d{{1,2}}[ .(-])){_digits(8, 15)})"
_NEXT_VALUE = rf"(?!{OTHER}|\d(?:[ -]?\d){{12,18}}(?!\w|-\d)|(?<=\+{_digits(11, 15)} )(?:19|20)\d\d(?!\w|[.-]\d))"
_GROUPS = r"\d{{1,3}}[ .-]?\(?\d{{2,4}}\)?(?:(?:[ .-]{})?\d{{2,4}}){{2,4}}(?!\w)"
# By preference: +1 with its ten digits; groups up to the next value; any groups of one number; any that validate.
_PHONES = (
    r"1[ .-]?\(?\d{3}\)?[ .-]?\d{3}[ .-]?\d{4}(?!\w)", _GROUPS.format(_NEXT_VALUE) + _VALID + _ONE_NUMBER,
    _GROUPS.format("") + _VALID + _ONE_NUMBER, _GROUPS.format("") + _VALID,
)
PHONE = rf"(?<![\w+])\+(?:{'|'.join(_PHONES)})"

# A whole run of digit groups: which of them are a card, the Luhn check decides (_cards). Possessive, so that a run of any length is no recursion.
_GROUP = rf"\d++(?:-(?!{IPV4})\d++)*+(?!\w|-(?!{IPV4})\d)"
CARD = rf"(?<![\w-])(?=\d(?:[ -]?\d){{12}}){_GROUP}(?: (?!{OTHER}){_GROUP})*+"
ANY = "|".join((EMAIL, SECRET, DATE, IPV4, PHONE, SSN, CARD))


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    return F.get(F.transform(F.array(value), body), F.lit(0))


def feistel(text: Column, alphabet: str, key: str) -> Column:
    """A keyed permutation of the strings over the alphabet of text's length (2 to 64)."""
    n = len(alphabet)

    def step(s: Column, i: Column) -> Column:
        h = F.sha2(F.concat_ws("|", F.lit(key), F.lit(str(n)), i.cast("string"), F.length(s["a"]).cast("string"), s["b"]), 256)

        def add(c: Column, k: Column) -> Column:
            # Two hash digits for each place; halves of at most 32 characters have 64 of them.
            own = F.instr(F.lit(alphabet), c) - 1
            shift = F.conv(F.substr(h, k * 2 + 1, F.lit(2)), 16, 10).cast("int")
            return F.substr(F.lit(alphabet), (own + shift) % n + 1, F.lit(1))

        return F.struct(s["b"].alias("a"), F.array_join(F.transform(_chars(s["a"]), add), "").alias("b"))

    half = F.floor(F.length(text) / 2).cast("int")
    start = F.struct(F.substr(text, F.lit(1), half).alias("a"), F.substr(text, half + 1).alias("b"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, step, lambda s: F.concat(s["a"], s["b"]))


def _chars(s: Column) -> Column:
    return F.when(s == "", F.array().cast("array<string>")).otherwise(F.split(s, ""))


def digits_of(s: Column) -> Column:
    return F.regexp_replace(s, "[^0-9]", "")


def put_digits(form: Column, digits: Column) -> Column:
    """form with its digits replaced by those of digits, in order."""
    step = lambda s, c: F.when(c.between("0", "9"), F.struct(F.concat(s["out"], F.substr(digits, s["k"], F.lit(1))).alias("out"), (s["k"] + 1).alias("k"))).otherwise(F.struct(F.concat(s["out"], c).alias("out"), s["k"].alias("k")))
    return F.aggregate(_chars(form), F.struct(F.lit("").alias("out"), F.lit(1).alias("k")), step, lambda s: s["out"])


def luhn_sum(digits: Column) -> Column:
    """The Luhn sum of a number whose last digit is the check digit."""

    def value(c: Column, i: Column) -> Column:
        d = c.cast("int")
        return F.when(i % 2 == 1, F.when(d > 4, d * 2 - 9).otherwise(d * 2)).otherwise(d)

    return F.aggregate(F.transform(_chars(F.reverse(digits)), value), F.lit(0), lambda a, x: a + x)


def _renewed(s: Column, key: str) -> Column:
    """The pseudonym of a card number that passes the check."""

    def renewed(body: Column) -> Column:
        check = (10 - luhn_sum(F.concat(body, F.lit("0"))) % 10) % 10
        return put_digits(s, F.concat(body, check.cast("string")))

    return _let(digits_of(s), lambda d: _let(feistel(F.substr(d, F.lit(1), F.length(d) - 1), DIGITS, key), renewed))


def _cards(run: Column, key: str) -> Column:
    """text and n of a run of digit groups: the run with its cards replaced, and their number.

    A card is one group, or groups of four digits and more (the last of any length) or of one digit each that start as issuers' numbers do;
    the longest from each group on. Where none starts, the longest 13 to 19 digits count as one in any grouping.
    """

    def of(r: Column) -> Column:
        t, n = r["t"], F.size(r["t"])
        value = lambda i, j: F.array_join(F.slice(t, i, j - i + 1), "")
        ends = lambda i: F.sequence(i, F.least(i + 18, n))
        valid = lambda i, j: _let(digits_of(value(i, j)), lambda d: F.length(d).between(13, 19) & (luhn_sum(d) % 10 == 0))

        def shaped(i: Column, j: Column) -> Column:
            sizes = F.slice(r["sizes"], i, j - i + 1)
            form = F.forall(F.slice(sizes, F.lit(1), j - i), lambda x: x >= 4) | F.forall(sizes, lambda x: x == 1)
            return (i == j) | (form & digits_of(value(i, j)).rlike("^(?:[3-9]|2[2-7])"))

        def last(i: Column) -> Column:
            """The last group of the card that starts at group i, or 0."""
            return F.coalesce(F.array_max(F.filter(ends(i), lambda j: shaped(i, j) & valid(i, j))), F.lit(0))

        def longest(i: Column) -> Column:
            """The last group of the longest 13 to 19 digits from group i on, or 0."""
            return F.coalesce(F.array_max(F.filter(ends(i), lambda j: F.length(digits_of(value(i, j))).between(13, 19))), F.lit(0))

        def scan(lasts: Column) -> Column:
            def step(s: Column, i: Column) -> Column:
                def take(x: Column) -> Column:
                    """x: the last group of a card, or of groups that could be one."""
                    known, none_inside = F.get(lasts, i - 1) > 0, ~F.exists(F.slice(lasts, i, x - i + 1), lambda e: e > 0)
                    tried = ~known & (x > 0) & F.when(x > 0, none_inside).otherwise(False)
                    skipped = F.struct(s["next"].alias("next"), F.when(tried, x + 1).otherwise(s["tried"]).alias("tried"), F.concat(s["text"], F.get(t, i - 1)).alias("text"), s["n"].alias("n"))

                    def put(old: Column) -> Column:
                        return _let(_renewed(old, key), lambda new: F.struct((x + 1).alias("next"), (x + 1).alias("tried"), F.concat(s["text"], new).alias("text"), (s["n"] + (new != old).cast("int")).alias("n")))

                    return F.when(known | (tried & F.when(tried, valid(i, x)).otherwise(False)), _let(value(i, x), put)).otherwise(skipped)

                free = F.when(F.get(lasts, i - 1) > 0, F.get(lasts, i - 1)).when(i >= s["tried"], longest(i)).otherwise(0)
                return F.when(i < s["next"], s).otherwise(_let(free, take))

            start = F.struct(F.lit(1).alias("next"), F.lit(1).alias("tried"), F.lit("").alias("text"), F.lit(0).alias("n"))
            return F.aggregate(F.sequence(F.lit(1), n), start, step, lambda s: F.struct(s["text"].alias("text"), s["n"].alias("n")))

        return _let(F.transform(F.sequence(F.lit(1), n), last), scan)

    groups = F.split(run, "(?<=[ -])")
    return _let(F.struct(groups.alias("t"), F.transform(groups, lambda g: F.length(digits_of(g))).alias("sizes")), of)


def _ipv4(s: Column, key: str) -> Column:
    parts = F.transform(F.split(s, r"\."), lambda p: p.cast("int"))

    padded = s.rlike(r"(?:^|\.)0\d")

    def permuted(h: Column) -> Column:
        octet = lambda i: F.conv(F.substr(h, i * 2 + 1, F.lit(2)), 16, 10)
        return F.array_join(F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: F.when(padded, F.lpad(octet(i), 3, "0")).otherwise(octet(i))), ".")

    hexes = F.array_join(F.transform(parts, lambda p: F.lpad(F.lower(F.hex(p)), 2, "0")), "")
    return F.when(F.forall(parts, lambda p: p <= 255), _let(feistel(hexes, HEX, key), permuted)).otherwise(s)


def _phone(s: Column, key: str) -> Column:
    def moved(d: Column) -> Column:
        """d: all digits, the country code first."""
        code = F.length(F.regexp_extract(d, COUNTRY, 0))
        rest = F.substr(d, code + 1)
        return F.when((code > 0) & F.length(rest).between(4, 14), put_digits(s, F.concat(F.substr(d, F.lit(1), code), feistel(rest, DIGITS, key)))).otherwise(s)

    return _let(digits_of(s), moved)


def _moved(form: str, key: str) -> Callable[[Column], Column]:
    """From a day's number to the notation of its pseudonym."""
    start = F.to_date(F.lit(DAYS_FROM))

    def move(day: Column) -> Column:
        block = F.floor(day / DAYS).cast("int") * DAYS
        return F.date_format(F.date_add(start, block + feistel(F.lpad((day - block).cast("string"), 5, "0"), DIGITS, key).cast("int")), form)

    return move


def _date(s: Column, key: str) -> Column:
    out = s
    for like, form in ((r"^\d{4}-", "yyyy-MM-dd"), (r"^\d{2}\.", "dd.MM.yyyy"), (r"^\d{2}/", "dd/MM/yyyy"), (r"^\d{2}/", "MM/dd/yyyy")):  # the last that fits counts
        day = F.datediff(F.to_date(F.try_to_timestamp(s, F.lit(form))), F.to_date(F.lit(DAYS_FROM)))
        out = F.when(s.rlike(like) & F.coalesce(day.between(*BLOCKS), F.lit(False)), _let(day, _moved(form, key))).otherwise(out)
    return out


def _replaced(s: Column, key: str) -> Column:
    """text and n of one match of ANY: the match with what validates replaced, and the number of values replaced."""
    whole = lambda p: s.rlike(rf"\A(?:{p})\z")
    mail = F.concat(F.lit("u"), F.substr(F.sha2(F.concat_ws("|", F.lit(key), F.lit("mail"), F.lower(s)), 256), F.lit(1), F.lit(16)), F.lit("@mail.invalid"))
    secret = F.when(s.rlike(r"\A[0-9a-f]+\z"), feistel(s, HEX, key)).when(s.rlike(r"\A[0-9A-F]+\z"), F.upper(feistel(F.lower(s), HEX, key))).otherwise(feistel(s, ALNUM, key))
    one = (
        F.when(s.contains("@"), mail).when(whole(SECRET), secret).when(whole(DATE), _date(s, key)).when(whole(IPV4), _ipv4(s, key))
        .when(s.startswith("+"), _phone(s, key)).when(whole(SSN), put_digits(s, feistel(digits_of(s), DIGITS, key))).otherwise(s)
    )
    run = s.rlike(r"\A\d++(?:[ -]\d++)*+\z") & (F.length(digits_of(s)) >= 13)
    return F.when(run, _cards(s, key)).otherwise(_let(one, lambda new: F.struct(new.alias("text"), (new != s).cast("int").alias("n"))))


def pseudonym(s: Column, key: str = KEY) -> Column:
    """The pseudonym of one match of ANY; the match itself if it doesn't validate."""
    return _replaced(s, key)["text"]


def pseudonymize(documents: DataFrame, key: str = KEY) -> DataFrame:
    """documents with text pseudonymised, and n_found (long), the values replaced (in the place of a column of that name)."""
    kept = [F.col(f"row.`{c}`").alias(c) for c in documents.columns if c not in ("text", "n_found")]
    text = F.col("row.text")
    # Every kind has a digit or an at sign: a plain scan spares most texts the search.
    some = text.rlike("[0-9@]")
    none = F.array().cast("array<string>")
    unchanged = F.array().cast("array<struct<text:string,n:int>>")
    d = documents.select(F.struct(*(F.col(f"`{c}`") for c in documents.columns)).alias("row"))
    d = d.withColumn("found", F.when(some, F.regexp_extract_all(text, F.lit(ANY), F.lit(0))).otherwise(none))
    d = d.withColumn("new", F.when(F.size("found") > 0, F.transform("found", lambda s: _replaced(s, key))).otherwise(unchanged))
    between = F.when(F.size("found") > 0, F.split(text, ANY, -1))
    joined = F.array_join(F.flatten(F.zip_with(between, F.col("new.text"), lambda a, b: F.array(a, F.coalesce(b, F.lit(""))))), "")
    n = F.aggregate(F.col("new.n"), F.lit(0), lambda a, x: a + x)
    return d.select(*kept, F.when(F.size("found") > 0, joined).otherwise(text).alias("text"), n.cast("long").alias("n_found"))
