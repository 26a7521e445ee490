"""Format-preserving pseudonyms for personal data, on DataFrame functions alone.

Found and validated values are replaced in place. Numbers and dates go through a keyed Feistel network
on their own domain, so that the result is again a number or date of the same format, equal values get
equal pseudonyms in every document, different ones different, and the holder of the key can undo it:

* card numbers (13 to 19 digits, blanks or hyphens between, valid by the Luhn check): all digits but the
  last are permuted, the last is set so that the check holds again. Numbers that fail it are no cards.
* phone numbers (+country, 7 to 12 digits): the digits after the country code, whose length its first
  digits tell, are permuted.
* dates (2001-12-31, 31/12/2001, 12.31.2001 read as day first where possible): permuted among the
  days of their century, 36,524 or 36,525, that is 92 x 397 or 75 x 487. A date that can only be read
  month first stays one: it is permuted on until the day is above 12, so that it can be undone.
* IPv4 addresses: permuted among all addresses.

Digits are permuted without their separators and put back among them, so a number is linked however it
is written. Values without such a domain get a keyed digest in their format: the local part of e-mail
addresses, and secrets of 32 to 64 hexadecimal digits.

Texts without a digit or an at sign are not searched. Null texts stay null and empty ones empty, both
with zero counts; a date or address that does not exist is left alone; repeated rows are treated
alike; other columns pass through. ``key`` has no default: whoever has it can undo the numbers and dates
with ``pseudonym(..., undo=True)``; mail addresses and secrets cannot be undone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "ip", "phone", "date", "secret", "card")
_PATTERNS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+",
    "ip": r"(?<![\d.])\d{1,3}(?:\.\d{1,3}){3}(?!\.?\d)",
    "phone": r"(?<!\d)\+\d{1,3}[ -]?\(?\d{2,4}\)?(?:[ -]?\d){5,8}(?!\d)",
    "date": r"(?<![\d/.-])(?:\d{4}-\d{2}-\d{2}|\d{2}([/.])\d{2}\1\d{4})(?![\d/-])",
    "secret": r"(?<![0-9A-Za-z])[0-9a-f]{32,64}(?![0-9A-Za-z])",
    "card": r"(?<!\d)(?:\d{13,19}|\d{4}[ -]\d{6}[ -]\d{5}|\d{4}(?:[ -]\d{4}){2,3}(?:[ -]\d{1,4})?)(?!\d)",
}
_WHOLE = {k: "^(?:" + p + ")$" for k, p in _PATTERNS.items()}
#: The date's own group comes fourth in no other alternative, so its number is 1.
_ANY = "|".join(_PATTERNS[k] for k in KINDS)
_ROUNDS = 8


def _number(hexed: Column) -> Column:
    """A digest's first 60 bits."""
    return F.conv(F.substring(hexed, 1, 15), 16, 10).cast("long")


def feistel(left: Column, right: Column, left_size: Column, right_size: Column, kind: str, key: str, undo: bool = False) -> Column:
    """Permutes (left, right) of a domain left_size x right_size; returns a struct l, r.

    Each round adds a keyed digest of one half to the other, modulo the other's size; the halves then
    change places, so an even number of rounds leaves them where they were.
    """

    def digest(i: Column, half: Column) -> Column:
        return _number(F.sha2(F.concat_ws("|", F.lit(key), F.lit(kind), i, left_size, right_size, half), 256))

    state = F.struct(left.cast("long").alias("l"), right.cast("long").alias("r"))
    if undo:
        back = lambda s, i: F.struct(F.pmod(s["r"] - digest(i, s["l"]), F.when(i % 2 == 1, left_size).otherwise(right_size)).cast("long").alias("l"), s["l"].alias("r"))
        return F.aggregate(F.sequence(F.lit(_ROUNDS), F.lit(1), F.lit(-1)), state, back)
    step = lambda s, i: F.struct(s["r"].alias("l"), F.pmod(s["l"] + digest(i, s["r"]), F.when(i % 2 == 1, left_size).otherwise(right_size)).cast("long").alias("r"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(_ROUNDS)), state, step)


def permute_digits(digits: Column, kind: str, key: str, undo: bool = False) -> Column:
    """Permutes digit strings of equal length (2 to 36) among themselves."""
    n = F.length(digits)
    a = F.floor(n / 2).cast("int")
    size = lambda k: F.pow(F.lit(10.0), k).cast("long")
    out = feistel(F.substring(digits, F.lit(1), a), F.substring(digits, a + 1, n - a), size(a), size(n - a), kind, key, undo)
    # a HOF evaluates its input once
    return F.element_at(F.transform(F.array(out), lambda s: F.concat(F.lpad(s["l"].cast("string"), a, "0"), F.lpad(s["r"].cast("string"), n - a, "0"))), 1)


def luhn_sum(digits: Column) -> Column:
    """The Luhn sum of a digit string, check digit included."""
    from_right = F.split(F.reverse(digits), "")
    doubled = lambda c, i: F.when(i % 2 == 0, c.cast("int")).when(c.cast("int") > 4, 2 * c.cast("int") - 9).otherwise(2 * c.cast("int"))
    return F.aggregate(F.transform(F.filter(from_right, lambda c: c != ""), doubled), F.lit(0), lambda a, x: a + x)


def _only_digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _refill(value: Column, digits: Column) -> Column:
    """The value with its digits replaced in turn."""
    at = lambda i: F.length(_only_digits(F.substring(value, F.lit(1), i + 1)))
    return F.array_join(F.transform(F.split(value, ""), lambda c, i: F.when(c.rlike("^[0-9]$"), F.substring(digits, at(i), F.lit(1))).otherwise(c)), "")


def _once(value: Column, use) -> Column:
    """``use(value)`` with the value computed once."""
    return F.element_at(F.transform(F.array(value), use), 1)


#: Country codes by length: of one digit, of two; all others have three (fixed values).
_COUNTRY = r"^(?:[17]|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|\d{3})"


def card(value: Column, key: str, undo: bool = False) -> Column:
    def made(d: Column) -> Column:
        valid = luhn_sum(d) % 10 == 0
        head = permute_digits(F.substring(d, F.lit(1), F.length(d) - 1), "card", key, undo)
        checked = _once(head, lambda h: F.concat(h, F.pmod(10 - luhn_sum(F.concat(h, F.lit("0"))) % 10, F.lit(10)).cast("string")))
        return F.when(valid, _refill(value, checked)).otherwise(value)

    return _once(_only_digits(value), made)


def phone(value: Column, key: str, undo: bool = False) -> Column:
    def made(d: Column) -> Column:
        head = F.regexp_extract(d, _COUNTRY, 0)
        return _once(head, lambda h: _refill(value, F.concat(h, permute_digits(F.substring(d, F.length(h) + 1, F.length(d)), "phone", key, undo))))

    return _once(_only_digits(value), made)


def ip(value: Column, key: str, undo: bool = False) -> Column:
    parts = F.transform(F.split(value, r"\."), lambda c: c.cast("int"))

    def made(p: Column) -> Column:
        out = feistel(p[0] * 256 + p[1], p[2] * 256 + p[3], F.lit(65536).cast("long"), F.lit(65536).cast("long"), "ip", key, undo)
        text = _once(out, lambda s: F.concat_ws(".", F.floor(s["l"] / 256), s["l"] % 256, F.floor(s["r"] / 256), s["r"] % 256))
        return F.when(F.exists(p, lambda x: x > 255), value).otherwise(text)

    return _once(parts, made)


def date(value: Column, key: str, undo: bool = False) -> Column:
    iso = value.rlike(r"^\d{4}-")
    mark = F.substring(value, 3, 1)
    first = lambda d, m: F.try_to_date(F.concat(F.substring(value, 7, 4), F.lit("-"), F.substring(value, m, 2), F.lit("-"), F.substring(value, d, 2)), "yyyy-MM-dd")
    day_first, month_first = first(1, 4), first(4, 1)
    order = F.when(iso, F.lit("iso")).when(day_first.isNotNull(), F.lit("dmy")).when(month_first.isNotNull(), F.lit("mdy"))
    day = F.when(iso, F.try_to_date(value, "yyyy-MM-dd")).otherwise(F.coalesce(day_first, month_first))

    def made(x: Column) -> Column:
        late = F.year(x) >= 2000
        start = F.when(late, F.lit("2000-01-01")).otherwise(F.lit("1900-01-01")).cast("date")
        a, b = F.when(late, 75).otherwise(92).cast("long"), F.when(late, 487).otherwise(397).cast("long")
        on = lambda n: _once(feistel(F.floor(n / b), n % b, a, b, "date", key, undo), lambda s: s["l"] * b + s["r"])
        there = lambda n: F.date_add(start, n.cast("int"))
        once = on(F.datediff(x, start).cast("long"))
        # of 36,524 days 22,124 are after the 12th, so a walk of 64 steps ends but for one in 10 ** 25
        walked = F.aggregate(F.sequence(F.lit(1), F.lit(64)), once, lambda n, i: F.when(F.day(there(n)) <= 12, on(n)).otherwise(n))
        moved = there(F.when(order == "mdy", walked).otherwise(once))
        part = lambda d, p: F.date_format(d, p)
        shown = _once(
            moved,
            lambda d: F.when(order == "iso", part(d, "yyyy-MM-dd"))
            .when(order == "dmy", F.concat(part(d, "dd"), mark, part(d, "MM"), mark, part(d, "yyyy")))
            .otherwise(F.concat(part(d, "MM"), mark, part(d, "dd"), mark, part(d, "yyyy"))),
        )
        return F.when(x.isNull() | ~F.year(x).between(1900, 2099), value).otherwise(shown)

    return _once(day, made)


def email(value: Column, key: str) -> Column:
    local, domain = F.substring_index(value, "@", 1), F.substring_index(value, "@", -1)
    return F.concat(F.lit("p"), F.substring(F.sha2(F.concat_ws("|", F.lit(key), F.lit("email"), F.lower(local), F.lower(domain)), 256), 1, 12), F.lit("@"), domain)


def secret(value: Column, key: str) -> Column:
    return F.substring(F.sha2(F.concat_ws("|", F.lit(key), F.lit("secret"), value), 256), F.lit(1), F.length(value))


def kind_of(value: Column) -> Column:
    """Which pattern a found value has, in the order in which they are searched."""
    out = F.when(value.rlike(_WHOLE[KINDS[0]]), F.lit(KINDS[0]))
    for k in KINDS[1:]:
        out = out.when(value.rlike(_WHOLE[k]), F.lit(k))
    return out


def pseudonym(value: Column, key: str, undo: bool = False) -> Column:
    """The pseudonym of a found value; with ``undo`` the value of a number's or date's pseudonym."""
    turn = lambda f: lambda v, k: f(v, k, undo)
    made = {"email": email, "ip": turn(ip), "phone": turn(phone), "date": turn(date), "secret": secret, "card": turn(card)}
    kind = kind_of(value)
    out = F.when(kind == KINDS[0], made[KINDS[0]](value, key))
    for k in KINDS[1:]:
        out = out.when(kind == k, made[k](value, key))
    return out.otherwise(value)


def pseudonymise(docs: DataFrame, key: str) -> DataFrame:
    """``docs`` with pseudonyms in text, and ``__sw_found``: a map of kinds to how many values were replaced."""
    text = F.col("text")
    searched = text.rlike("[0-9@]")
    found = F.when(searched, F.regexp_extract_all(text, F.lit(f"({_ANY.replace(chr(92) + '1', chr(92) + '2')})"), F.lit(1))).otherwise(F.array().cast("array<string>"))
    marked = docs.withColumn("__sw_values", found)
    gaps = F.split(text, _ANY, -1)
    marked = marked.withColumn("__sw_pseudonyms", F.transform("__sw_values", lambda v: pseudonym(v, key)))
    pieces_of = F.col("__sw_pseudonyms")
    pieces = F.zip_with(gaps, pieces_of, lambda g, p: F.concat(g, F.coalesce(p, F.lit(""))))
    changed = F.when(F.size("__sw_values") > 0, F.array_join(pieces, "")).otherwise(text)
    changed_ones = F.zip_with("__sw_values", pieces_of, lambda v, p: F.when(v != p, kind_of(v)))
    kinds = F.filter(changed_ones, lambda k: k.isNotNull())
    number_of = lambda k: F.size(F.filter(kinds, lambda c: c == k)).cast("long")
    counts = F.create_map(*[x for k in KINDS for x in (F.lit(k), number_of(k))])
    return marked.select(*[changed.alias("text") if c == "text" else F.col(f"`{c}`") for c in docs.columns], counts.alias("__sw_found"))
