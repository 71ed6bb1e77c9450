"""Format-preserving pseudonyms for personal data, in DataFrame expressions only.

Validated numbers and dates are permuted within their own format by alternating Feistel rounds, keyed by a secret:
digits stay digits at the same places, card numbers and IBANs get the check digits of their new body, dates stay
dates, social security numbers stay ones that can be issued, IPv4 addresses stay IPv4 addresses, mail addresses keep
the shape of their local part and their domain. One value has one pseudonym under one key, so records stay linked
across documents, and with the key the permutation is undone (``restore=True``). A number that fails its check (Luhn,
mod 97, the calendar, the ranges of social security numbers) is left as it is. Telephone numbers have no check and are
taken by their shape. A date with slashes is read day first, and month first where that is no date. Not covered: IPv6
addresses, letters of IBANs, domains of mail addresses, and local parts without a letter or digit of ``ALPHABETS``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import free_name

# The shapes of personal data, in the order in which they are tried.
PATTERNS = {
    "mail": r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}._%+-]{1,64}@[A-Za-z0-9-]{1,63}(?:\.[A-Za-z0-9-]{1,63}){1,8}",
    "ipv4": r"(?<![\d.])(?:(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)\.){3}(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)(?!\d|\.\d)",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "date": r"(?<![\d/.-])(?:\d{4}-\d\d-\d\d|\d\d/\d\d/\d{4}|\d\d\.\d\d\.\d{4})(?![\d/]|[.-]\d)",
    "ssn": r"(?<![\d-])\d{3}-\d\d-\d{4}(?![\d-])",
    "phone": r"(?<![\d+])\+\d{1,3}[ .-]?\(?\d{3}\)?[ .-]?\d{3}[ .-]?\d{4}(?!\d)|(?<!\d)\(\d{3}\) ?\d{3}-\d{4}(?!\d)|(?<![\d-])\d{3}-\d{3}-\d{4}(?![\d-])",
    "card": r"(?<![A-Za-z0-9])(?:\d{13,19}|\d{4}([ -])\d{4}\1\d{4}\1\d{1,7}|\d{4}[ -]\d{6}[ -]\d{5})(?![A-Za-z0-9])",
}
# First letter and number of letters of the runs within which letters are shifted, besides ASCII.
ALPHABETS = (
    ("À", 23), ("Ø", 7), ("à", 23), ("ø", 7), ("Α", 17), ("α", 25), ("А", 32), ("а", 32), ("א", 27), ("ء", 26), ("अ", 53), ("ก", 46), ("ぁ", 86), ("ァ", 90), ("一", 20_902), ("가", 11_172),
)
LETTERS = "a-zA-Z0-9" + "".join(f"{a}-{chr(ord(a) + n - 1)}" for a, n in ALPHABETS)
ROUNDS = 8
FIRST_DAY, DAYS, SIDES = "1900-01-01", 73_049, (270, 271)  # 1900 to 2099; the sides' product is just above


class _Cipher:
    def __init__(self, key: str, restore: bool):
        self.key, self.restore = key, restore

    def _prf(self, kind: str, *parts) -> Column:
        """60 pseudorandom bits."""
        text = F.concat_ws("|", F.lit(self.key), F.lit(kind), *(p.cast("string") for p in parts))
        return F.conv(F.substring(F.sha2(text, 256), 1, 15), 16, 10).cast("long")

    def feistel(self, kind: str, left: Column, right: Column, m: Column, n: Column, tag: Column) -> Column:
        """struct(l, r) with l below m and r below n: rounds add, in turn, a function of one side to the other."""

        def turn(acc: Column, i: Column) -> Column:
            even = i % 2 == 0
            fl, fr = self._prf(kind, tag, i, acc["r"]) % m, self._prf(kind, tag, i, acc["l"]) % n
            if self.restore:
                fl, fr = m - fl, n - fr
            return F.when(even, F.struct(((acc["l"] + fl) % m).alias("l"), acc["r"].alias("r"))).otherwise(F.struct(acc["l"].alias("l"), ((acc["r"] + fr) % n).alias("r")))

        order = F.sequence(F.lit(ROUNDS - 1), F.lit(0), F.lit(-1)) if self.restore else F.sequence(F.lit(0), F.lit(ROUNDS - 1))
        return F.aggregate(order, F.struct(left.cast("long").alias("l"), right.cast("long").alias("r")), turn)

    def digits(self, kind: str, d: Column) -> Column:
        """As many digits, permuted; up to 19."""
        n = F.length(d)
        u = F.floor(n / 2).cast("int")
        v = n - u
        power = lambda k: F.rpad(F.lit("1"), k + 1, "0").cast("long")
        left = F.when(u == 0, F.lit(0)).otherwise(F.expr("0") + F.substring(d, F.lit(1), u).try_cast("long"))
        got = self.feistel(kind, left, F.substring(d, u + 1, v).cast("long"), power(u), power(v), n)
        text = lambda x, k: F.when(k == 0, F.lit("")).otherwise(F.lpad(x.cast("string"), k, "0"))
        return F.concat(text(got["l"], u), text(got["r"], v))

    def walked(self, x: Column, once, fine, steps: int) -> Column:
        """Permuted until fine: a permutation of the fine values, as the one that is walked is one of all."""
        return F.aggregate(F.sequence(F.lit(0), F.lit(steps)), x, lambda acc, i: F.when((i == 0) | ~fine(acc), once(acc)).otherwise(acc))

    def day(self, d: Column, month_first: bool = False) -> Column:
        """A date of the range to another; month_first: to one after the 12th of its month."""
        x = F.datediff(d, F.lit(FIRST_DAY).cast("date")).cast("long")
        a, b = (F.lit(s).cast("long") for s in SIDES)
        date = lambda n: F.date_add(F.lit(FIRST_DAY).cast("date"), n.cast("int"))

        def once(x: Column) -> Column:
            got = self.feistel("date", F.floor(x / b), x % b, a, b, F.lit(0))
            return F.struct((got["l"] * b + got["r"]).alias("x"))["x"]

        return date(self.walked(x, once, lambda n: (n < DAYS) & (F.dayofmonth(date(n)) > 12 if month_first else F.lit(True)), 60 if month_first else 11))

    def security(self, d: Column) -> Column:
        """Nine digits of a social security number to those of another."""
        return self.walked(d, lambda x: self.digits("ssn", x), issued, 14)

    def letters(self, s: Column) -> Column:
        """Letters and digits shifted within their kind, half against half; other characters stay."""
        chars = F.transform(F.sequence(F.lit(1), F.length(s)), lambda i: F.substring(s, i, F.lit(1)))
        n = F.length(s)
        u = F.floor(n / 2).cast("int")

        def shifted(half: Column, other: Column, i: Column) -> Column:
            bits = F.sha2(F.concat_ws("|", F.lit(self.key), F.lit("mail"), n.cast("string"), i.cast("string"), F.array_join(other, "")), 256)

            def one(c: Column, j: Column) -> Column:
                by = F.conv(F.substring(bits, (j * 3) % 60 + 1, F.lit(3)), 16, 10).cast("int")
                kind = lambda low, size: F.char(low + F.pmod(F.ascii(c) - low + (-by if self.restore else by), F.lit(size)))
                out = F.when(c.rlike("^[a-z]$"), kind(97, 26)).when(c.rlike("^[A-Z]$"), kind(65, 26)).when(c.rlike("^[0-9]$"), kind(48, 10))
                for first, size in ALPHABETS:
                    at = F.ascii(c)
                    to = ord(first) + F.pmod(at - ord(first) + (-by if self.restore else by), F.lit(size))
                    out = out.when(at.between(ord(first), ord(first) + size - 1), F.decode(F.unhex(F.lpad(F.hex(to), 4, "0")), "UTF-16BE"))
                return out.otherwise(c)

            return F.transform(half, one)

        def turn(acc: Column, i: Column) -> Column:
            return F.when(i % 2 == 0, F.struct(shifted(acc["l"], acc["r"], i).alias("l"), acc["r"].alias("r"))).otherwise(F.struct(acc["l"].alias("l"), shifted(acc["r"], acc["l"], i).alias("r")))

        order = F.sequence(F.lit(3), F.lit(0), F.lit(-1)) if self.restore else F.sequence(F.lit(0), F.lit(3))
        got = F.aggregate(order, F.struct(F.slice(chars, F.lit(1), u).alias("l"), F.slice(chars, u + 1, n - u).alias("r")), turn)
        return F.array_join(F.concat(got["l"], got["r"]), "")


def _only_digits(s: Column) -> Column:
    return F.regexp_replace(s, "[^0-9]", "")


def refill(shape: Column, digits: Column) -> Column:
    """The shape with its digits replaced, in order."""
    start = F.struct(F.lit("").alias("o"), F.lit(1).alias("k"))

    def place(acc: Column, i: Column) -> Column:
        c = F.substring(shape, i, F.lit(1))
        hit = c.rlike("^[0-9]$")
        return F.struct(F.concat(acc["o"], F.when(hit, F.substring(digits, acc["k"], F.lit(1))).otherwise(c)).alias("o"), (acc["k"] + hit.cast("int")).alias("k"))

    return F.aggregate(F.sequence(F.lit(1), F.length(shape)), start, place)["o"]


def luhn_sum(digits: Column, doubled_first: bool) -> Column:
    """Luhn sum from the right; doubled_first: the last digit counts double."""

    def add(acc: Column, i: Column) -> Column:
        x = F.substring(digits, F.length(digits) - i + 1, F.lit(1)).cast("int")
        twice = (i + int(doubled_first)) % 2 == 0
        return acc + F.when(twice, 2 * x - F.when(x > 4, 9).otherwise(0)).otherwise(x)

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), add)


def mod97(s: Column) -> Column:
    """The number of letters (A = 10) and digits, modulo 97."""

    def add(acc: Column, i: Column) -> Column:
        c = F.substring(s, i, F.lit(1))
        return F.when(c.rlike("^[0-9]$"), (acc * 10 + F.ascii(c) - 48) % 97).otherwise((acc * 100 + F.ascii(c) - 55) % 97)

    return F.aggregate(F.sequence(F.lit(1), F.length(s)), F.lit(0), add)


def issued(digits: Column) -> Column:
    """Whether nine digits are in the ranges of social security numbers."""
    area = F.substring(digits, F.lit(1), F.lit(3))
    return ~area.isin("000", "666") & (area < "900") & (F.substring(digits, F.lit(4), F.lit(2)) != "00") & (F.substring(digits, F.lit(6), F.lit(4)) != "0000")


def _dated(c: _Cipher, fmt: str):
    return lambda x: F.date_format(c.day(x, fmt == "MM/dd/yyyy"), fmt)


def pseudonym(m: Column, key: str, restore: bool = False) -> Column:
    """The pseudonym of one matched string, or null where its check fails."""
    c = _Cipher(key, restore)
    d = _only_digits(m)
    local = F.substring_index(m, "@", 1)
    mail = F.when(local.rlike(f"[{LETTERS}]"), F.concat(c.letters(local), F.lit("@"), F.substring_index(m, "@", -1)))
    octet = lambda i: F.get(F.split(m, r"\."), F.lit(i)).cast("long")
    side = F.lit(65_536).cast("long")
    ip = c.feistel("ipv4", octet(0) * 256 + octet(1), octet(2) * 256 + octet(3), side, side, F.lit(0))
    address = F.transform(F.array(ip), lambda x: F.concat_ws(".", F.floor(x["l"] / 256), x["l"] % 256, F.floor(x["r"] / 256), x["r"] % 256))[0]
    body = F.substring(d, F.lit(1), F.length(d) - 1)
    card = F.transform(F.array(c.digits("card", body)), lambda b: refill(m, F.concat(b, F.pmod(-luhn_sum(b, True), F.lit(10)).cast("string"))))[0]
    bare = F.regexp_replace(m, " ", "")
    land, account = F.substring(bare, 1, 2), F.substring(bare, F.lit(5), F.length(bare))
    moved = F.transform(F.array(c.digits("iban", F.right(_only_digits(account), F.lit(18)))), lambda x: F.concat(F.left(_only_digits(account), F.length(_only_digits(account)) - F.length(x)), x))[0]
    iban = F.transform(F.array(moved), lambda x: F.concat(F.lpad((98 - mod97(F.concat(refill(account, x), land, F.lit("00")))).cast("string"), 2, "0"), x))[0]
    number = _only_digits(F.regexp_extract(m, r"^(?:\+\d{1,3}[ .-]?)?(.*)$", 1))
    phone = refill(m, F.concat(F.left(d, F.length(d) - 10), c.digits("phone", F.right(number, F.lit(10)))))
    out = F.when(m.contains("@"), mail)
    out = out.when(m.rlike(r"^\d{1,3}(\.\d{1,3}){3}$"), address)
    out = out.when(m.rlike("^[A-Z]"), F.when((mod97(F.concat(account, F.substring(bare, 1, 4))) == 1) & (F.length(_only_digits(account)) > 1), refill(m, iban)))
    for shape, formats in ((r"^\d{4}-\d\d-\d\d$", ("yyyy-MM-dd",)), (r"^\d\d/\d\d/\d{4}$", ("dd/MM/yyyy", "MM/dd/yyyy")), (r"^\d\d\.\d\d\.\d{4}$", ("dd.MM.yyyy",))):
        found = []
        for fmt in formats:
            day = F.try_to_timestamp(m, F.lit(fmt)).cast("date")
            held = F.filter(F.array(day), lambda x: x.between(F.lit(FIRST_DAY).cast("date"), F.date_add(F.lit(FIRST_DAY).cast("date"), DAYS - 1)))
            found.append(F.get(F.transform(held, _dated(c, fmt)), F.lit(0)))
        out = out.when(m.rlike(shape), F.coalesce(*found))
    out = out.when(m.rlike(r"^\d{3}-\d\d-\d{4}$"), F.when(issued(d), refill(m, c.security(d))))
    out = out.when(m.rlike(r"^\d{3}-\d{3}-\d{4}$"), phone)
    out = out.when(m.rlike(r"^[+(]"), phone)
    return out.otherwise(F.when(F.pmod(luhn_sum(d, False), F.lit(10)) == 0, card))


def pseudonymise(docs: DataFrame, *, key: str, text_col: str = "text", count_col: str = "n_replaced", restore: bool = False) -> DataFrame:
    """docs with the text's personal data replaced and the number of replaced values in ``count_col``.

    All other columns pass through; a column of docs named like ``count_col`` is replaced. Null texts stay null with
    count 0, texts without personal data are returned unchanged. Every row is worked on alone: repeated rows get the
    same result, and an empty table gives an empty one.
    """
    pattern = "|".join(PATTERNS.values())
    text = F.col(f"`{text_col}`")
    may = text.rlike("[0-9@]")
    docs = docs.drop(count_col)
    f, n, b = (free_name(docs, x) for x in ("found", "changed", "between"))
    found = docs.withColumn(f, F.when(may, F.regexp_extract_all(text, F.lit(pattern), F.lit(0))))
    some = F.coalesce(F.size(f), F.lit(0)) > 0
    new = F.transform(f, lambda m: F.struct(m.alias("m"), pseudonym(m, key, restore).alias("p")))
    found = found.withColumn(n, F.when(some, new)).withColumn(b, F.when(some, F.split(text, pattern, -1)))
    rest = F.transform(n, lambda x: F.coalesce(x["p"], x["m"]))
    joined = F.array_join(F.flatten(F.zip_with(b, rest, lambda left, p: F.array(left, F.coalesce(p, F.lit(""))))), "")
    count = F.coalesce(F.size(F.filter(n, lambda x: x["p"].isNotNull())), F.lit(0)).cast("long")
    out = found.withColumn(count_col, F.when(some, count).otherwise(F.lit(0).cast("long"))).withColumn(text_col, F.when(some, joined).otherwise(text))
    return out.drop(f, n, b)
