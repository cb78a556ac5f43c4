"""Format-preserving pseudonyms for personal data, with DataFrame functions only.

Values are found by pattern, validated, and permuted by a keyed Feistel network within their own
format: a card stays a card with a right check digit, a date a date, an address an
address. The permutation depends on the key and the kind alone, so equal values stay equal in all
documents, and two values never become one. Of cards, phones and IBANs the bare characters are
permuted and separators laid over them, so spellings of one value stay linked as well. Values have no
greatest length. Rows are never shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROUNDS = 8

# Patterns by kind, tried in this order. Each begins and ends at a border of its own.
OCTET = r"(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
SECRET_MARKS = "password|passwd|secret|api_key|token"
# A secret has any printable ASCII but quotes, brackets, commas and semicolons, and does not end in a stop.
SECRET_CHAR = r"[!#$%&*+./0-9:=?@A-Z\\^_`a-z|~-]"
PATTERNS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}(?![A-Za-z0-9])",
    "secret": rf"(?<![A-Za-z0-9])(?i:{SECRET_MARKS}) ?[=:] ?{SECRET_CHAR}{{5,}}(?<![.!?:]){SECRET_CHAR}(?<![.!?:])",
    "access_key": r"(?<![A-Za-z0-9])AKIA[0-9A-Z]{16}(?![A-Za-z0-9])",
    "hex_key": r"(?<![A-Za-z0-9])(?=[0-9a-f]{0,39}[0-9])(?=[0-9a-f]{0,39}[a-f])[0-9a-f]{40}(?![A-Za-z0-9])",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:[A-Z0-9]{11,30}|(?: [A-Z0-9]{4}){2,7}(?: [A-Z0-9]{1,3})?)(?![A-Za-z0-9])",
    "date": r"(?<![0-9A-Za-z./-])(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{4}/[0-9]{2}/[0-9]{2}|[0-9]{2}\.[0-9]{2}\.[0-9]{4}|[0-9]{2}/[0-9]{2}/[0-9]{4})(?![0-9A-Za-z/-]|\.[0-9])",
    "ssn": r"(?<![0-9A-Za-z-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z-])",
    "ip": rf"(?<![0-9A-Za-z.]){OCTET}(?:\.{OCTET}){{3}}(?![0-9A-Za-z]|\.[0-9])",
    "card": r"(?<![0-9A-Za-z+-])(?:[0-9]{4}(?:\.[0-9]{4}){3}|[0-9](?:[ -]?[0-9]){12,18})(?![0-9A-Za-z-])",
    "phone": r"(?<![0-9A-Za-z+])(?:\+[0-9]{1,3}[ .-]?(?:\([0-9]{1,4}\)[ .-]?)?[0-9]{2,4}(?:[ .-]?[0-9]{2,4}){1,4}|\([0-9]{3}\) ?[0-9]{3}-[0-9]{4}|[0-9]{3}-[0-9]{3}-[0-9]{4}|[0-9]{3}\.[0-9]{3}\.[0-9]{4}|0[1-9][0-9]{1,3}[ /][0-9]{6,9})(?![0-9A-Za-z])",
}
ANY = "|".join(PATTERNS.values())
# A match may be several numbers with one space between. How it is read instead: first in the
# usual shapes of cards and as other kinds, then as a card of any grouping, longest first.
CARD_END = r"(?![0-9A-Za-z-])"
CARD_SHAPES = [
    r"[0-9]{4}([ -])[0-9]{4}\1[0-9]{4}\1[0-9]{4}\1[0-9]{3}", r"[0-9]{4}([ .-])[0-9]{4}\1[0-9]{4}\1[0-9]{4}",
    r"[0-9]{4}([ -])[0-9]{6}\1[0-9]{4,5}", r"[0-9]{13,19}",
]
OTHERS = "|".join(p for k, p in PATTERNS.items() if k != "card")
# The same without groups that refer back, to be joined.
CARD_PLAIN = ["[0-9]{4}(?:[ -][0-9]{4}){3}(?:[ -][0-9]{3})?", r"[0-9]{4}(?:\.[0-9]{4}){3}", "[0-9]{4}[ -][0-9]{6}[ -][0-9]{4,5}", "[0-9]{13,19}"]
SHAPED = [*(f"{p}{CARD_END}" for p in CARD_SHAPES), OTHERS]
LOOSE = [rf"[0-9](?:[ -]?[0-9]){{{n - 1}}}{CARD_END}" for n in range(19, 12, -1)]
# Nothing above matches a text without a digit, an at sign or a word that announces a secret.
WORTH_A_LOOK = f"[0-9@]|(?i:{SECRET_MARKS})"

# Dates from 1900-01-01 to 2099-12-31 are 73,049 days, which is 17 times 4,297.
FIRST_DAY, DAY_BLOCKS, DAYS_IN_BLOCK = "1900-01-01", 17, 4297
# 3 in 5 days lie beyond the 12th; that none of so many does has a chance of 1 in 10**31.
DATE_STEPS = 80
# Valid social security numbers: 898 areas and 99 groups, times 9,999 serials.
SSN_AREAS, SSN_GROUPS, SSN_SERIALS = 898, 99, 9999


def keyed_hex(key: str, kind: str, turn: Column, other: Column, bits: int) -> Column:
    return F.sha2(F.concat_ws("|", F.lit(key), F.lit(kind), turn.cast("string"), other.cast("string")), bits)


def feistel_numbers(left: Column, right: Column, a: int, b: int, key: str, kind: str) -> Column:
    """Permute the pair (left, right), 0 <= left < a, 0 <= right < b: a struct (l, r)."""

    def amount(turn: Column, other: Column) -> Column:
        return F.conv(F.substring(keyed_hex(key, kind, turn, other, 256), 1, 15), 16, 10).cast("long")

    def turn_over(s: Column, turn: Column) -> Column:
        l, r = s["l"], s["r"]
        moved_left = F.struct(((l + amount(turn, r)) % a).alias("l"), r.alias("r"))
        moved_right = F.struct(l.alias("l"), ((r + amount(turn, l)) % b).alias("r"))
        return F.when(turn % 2 == 1, moved_left).otherwise(moved_right)

    start = F.struct(left.cast("long").alias("l"), right.cast("long").alias("r"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, turn_over)


def shifted(part: Column, stream: Column, hexadecimal: bool) -> Column:
    """Move every digit and ASCII letter of `part` within its class by the key stream."""

    def move(j: Column) -> Column:
        c = F.substring(part, j, F.lit(1))
        code = F.ascii(c)
        by = F.conv(F.substring(stream, F.pmod((j - 1) * 4, F.lit(128)) + 1, F.lit(4)), 16, 10).cast("int")

        def within(first: int, size: int) -> Column:
            return F.char(F.pmod(code - first + by, F.lit(size)) + first)

        digit, lower, upper = code.between(48, 57), code.between(97, 122), code.between(65, 90)
        if hexadecimal:
            return F.lower(F.conv(F.pmod(F.conv(c, 16, 10).cast("int") + by, F.lit(16)).cast("string"), 10, 16))
        return F.when(digit, within(48, 10)).when(lower, within(97, 26)).when(upper, within(65, 26)).otherwise(c)

    places = F.sequence(F.lit(1), F.length(part))
    return F.when(F.length(part) > 0, F.array_join(F.transform(places, move), "")).otherwise("")


def feistel_text(value: Column, key: str, kind: str, hexadecimal: bool = False) -> Column:
    """Permute the digits and letters of a string; separators and letter case stay in place."""

    def turn_over(s: Column, turn: Column) -> Column:
        half = (F.length(s) / 2).cast("int")
        left, right = F.substring(s, F.lit(1), half), F.substring(s, half + 1, F.length(s))
        moved_left = F.concat(shifted(left, keyed_hex(key, kind, turn, right, 512), hexadecimal), right)
        moved_right = F.concat(left, shifted(right, keyed_hex(key, kind, turn, left, 512), hexadecimal))
        return F.when(turn % 2 == 1, moved_left).otherwise(moved_right)

    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), value, turn_over)


def laid_over(value: Column, chars: Column) -> Column:
    """`value` with its digits and letters replaced by those of `chars`, one after another; what separates
    them stays, so that a value has one pseudonym in all its spellings."""
    places = F.sequence(F.lit(1), F.length(value))

    def at(i: Column) -> Column:
        nth = F.length(F.regexp_replace(F.substring(value, F.lit(1), i), "[^0-9A-Za-z]", ""))
        own = F.substring(value, i, F.lit(1))
        return F.when(own.rlike("[0-9A-Za-z]"), F.substring(chars, nth, F.lit(1))).otherwise(own)

    return F.when(F.length(value) > 0, F.array_join(F.transform(places, at), "")).otherwise("")


def digits_of(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn_sum(digits: Column, doubled_from_end: int) -> Column:
    """Luhn sum; every second digit counts double, beginning `doubled_from_end` places from the end."""
    n = F.length(digits)

    def add(total: Column, j: Column) -> Column:
        d = F.substring(digits, n - j + 1, F.lit(1)).cast("int")
        twice = F.pmod(j, F.lit(2)) == doubled_from_end % 2
        return total + F.when(twice, d * 2 - F.when(d > 4, 9).otherwise(0)).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), n), F.lit(0), add)


def mod97(value: Column) -> Column:
    """Remainder of an IBAN read as a number, its first four characters moved to the end."""
    turned = F.concat(F.substring(value, F.lit(5), F.length(value)), F.substring(value, 1, 4))

    def add(rest: Column, j: Column) -> Column:
        code = F.ascii(F.substring(turned, j, F.lit(1)))
        return F.when(code < 58, rest * 10 + code - 48).otherwise(rest * 100 + code - 55) % 97

    return F.aggregate(F.sequence(F.lit(1), F.length(turned)), F.lit(0), add)


def date_of(value: Column) -> Column:
    """Date of a string in one of the four formats; null if there is no such day in 1900 to 2099."""
    four = F.regexp_extract(value, "[0-9]{4}", 0)
    head, tail = F.substring(value, 1, 2), F.substring(value, 4, 2)
    year_first = value.rlike("^[0-9]{4}")
    month_first = ~year_first & value.contains("/") & (tail.cast("int") > 12)
    month = F.when(year_first, F.substring(value, 6, 2)).when(month_first, head).otherwise(tail)
    day = F.when(year_first, F.substring(value, 9, 2)).when(month_first, tail).otherwise(head)
    found = F.concat_ws("-", four, month, day).try_cast("date")
    return F.when(found.between(F.lit(FIRST_DAY).cast("date"), F.lit("2099-12-31").cast("date")), found)


def kind_of(value: Column) -> Column:
    """Kind of a match, or null where it is of no valid kind."""
    is_a = {k: value.rlike(f"^(?:{p})$") for k, p in PATTERNS.items()}
    digits, bare = digits_of(value), F.replace(value, F.lit(" "), F.lit(""))
    ssn_area, ssn_group, ssn_serial = (F.substring(value, *at).cast("int") for at in ((1, 3), (5, 2), (8, 4)))
    ssn = (ssn_area > 0) & (ssn_area < 900) & (ssn_area != 666) & (ssn_group > 0) & (ssn_serial > 0)
    valid = {
        "iban": (mod97(bare) == 1) & F.substring(bare, 3, 2).between("02", "98") & (F.length(bare) <= 34),
        "date": date_of(value).isNotNull(),
        "ssn": ssn,
        "card": (luhn_sum(digits, 2) % 10 == 0) & (digits.cast("decimal(20,0)") > 0),
    }
    out = None
    for kind, found in is_a.items():
        test = found & valid[kind] if kind in valid else found
        out = F.when(test, kind) if out is None else out.when(test, kind)
    return out


def readings(value: Column) -> Column:
    """A rejected match as pieces (m, k) in order, which make it up; k is null where no value is."""
    whole = F.length(value)
    begins = F.filter(F.sequence(F.lit(1), whole), lambda i: F.substring(F.concat(F.lit(" "), value), i, F.lit(2)).rlike("^ [0-9]"))

    def of(i: Column) -> Column:
        rest = F.substring(value, i, whole)
        tries = [(0, p) for p in SHAPED] + [(1, p) for p in LOOSE]
        found = [F.struct(F.lit(r).alias("r"), F.regexp_extract(rest, f"^(?:{p})", 0).alias("m")) for r, p in tries]
        full = F.transform(
            F.filter(F.array(*found), lambda c: c["m"] != ""),
            lambda c: F.struct(c["r"].alias("r"), i.alias("i"), c["m"].alias("m"), kind_of(c["m"]).alias("k")),
        )
        return F.filter(full, lambda c: c["k"].isNotNull())

    # By shape, then from left to right, each where none taken before stands.
    tried = F.flatten(F.transform(begins, of))
    tried = F.concat(F.filter(tried, lambda c: c["r"] == 0), F.filter(tried, lambda c: c["r"] == 1))

    def take(taken: Column, c: Column) -> Column:
        meets = F.exists(taken, lambda t: (c["i"] < t["i"] + F.length(t["m"])) & (t["i"] < c["i"] + F.length(c["m"])))
        return F.when(meets, taken).otherwise(F.concat(taken, F.array(F.struct(c["i"].alias("i"), c["m"].alias("m"), c["k"].alias("k")))))

    empty = F.array().cast("array<struct<i:int,m:string,k:string>>")
    taken = F.array_sort(F.aggregate(tried, empty, take))
    start = F.struct(F.lit(1).alias("at"), F.array().cast("array<struct<m:string,k:string>>").alias("out"))

    def cover(s: Column, t: Column) -> Column:
        gap = F.struct(F.substring(value, s["at"], t["i"] - s["at"]).alias("m"), F.lit(None).cast("string").alias("k"))
        piece = F.struct(t["m"].alias("m"), t["k"].alias("k"))
        return F.struct((t["i"] + F.length(t["m"])).alias("at"), F.concat(s["out"], F.array(gap, piece)).alias("out"))

    def ended(s: Column) -> Column:
        rest = F.struct(F.substring(value, s["at"], whole).alias("m"), F.lit(None).cast("string").alias("k"))
        return F.concat(s["out"], F.array(rest))

    return F.aggregate(taken, start, cover, ended)


def pseudonym(value: Column, kind: Column, key: str) -> Column:
    """What stands in for a value of a kind; the value itself where kind is null."""
    whole = F.length(value)
    top = F.substring_index(value, ".", -1)
    email = F.concat(feistel_text(F.substring(value, F.lit(1), whole - F.length(top)), key, "email"), top)
    mark = F.regexp_extract(value, "^[A-Za-z_]+ ?[=:] ?", 0)
    secret = F.concat(mark, feistel_text(F.substring(value, F.length(mark) + 1, whole), key, "secret"))
    access = F.concat(F.lit("AKIA"), feistel_text(F.substring(value, 5, 16), key, "access_key"))
    land = F.substring(value, 1, 2)
    account = feistel_text(F.substring(F.replace(value, F.lit(" "), F.lit("")), F.lit(5), whole), key, "iban")
    iban = F.transform(
        F.array(account),
        lambda x: laid_over(value, F.concat(land, F.lpad((98 - mod97(F.concat(land, F.lit("00"), x))).cast("string"), 2, "0"), x)),
    )[0]
    days = F.date_diff(date_of(value), F.lit(FIRST_DAY).cast("date"))
    year_first, dotted = value.rlike("^[0-9]{4}"), value.contains(".")
    # With the month first, only a day beyond 12 tells so. Such dates are permuted among themselves: the
    # permutation of all days is walked on until it meets another of them.
    month_first = ~year_first & ~dotted & (F.substring(value, 4, 2).cast("int") > 12)
    epoch = F.lit(FIRST_DAY).cast("date")

    def walk(day: Column, _: Column) -> Column:
        done = (day >= 0) & (~month_first | (F.dayofmonth(F.date_add(epoch, day)) > 12))
        at = F.when(day < 0, -1 - day).otherwise(day)
        moved = feistel_numbers((at / DAYS_IN_BLOCK).cast("int"), at % DAYS_IN_BLOCK, DAY_BLOCKS, DAYS_IN_BLOCK, key, "date")
        step = F.transform(F.array(moved), lambda m: (m["l"] * DAYS_IN_BLOCK + m["r"]).cast("int"))[0]
        return F.when(done, day).otherwise(step)

    # A day not moved yet is kept as -1 - day.
    walked = F.aggregate(F.sequence(F.lit(1), F.lit(DATE_STEPS)), (-1 - days).cast("int"), walk)
    new_day = F.date_add(epoch, walked)
    date = F.transform(
        F.array(new_day),
        lambda d: F.when(value.rlike("^[0-9]{4}-"), F.date_format(d, "yyyy-MM-dd"))
        .when(year_first, F.date_format(d, "yyyy/MM/dd"))
        .when(dotted, F.date_format(d, "dd.MM.yyyy"))
        .when(month_first, F.date_format(d, "MM/dd/yyyy"))
        .otherwise(F.date_format(d, "dd/MM/yyyy")),
    )[0]
    area = F.substring(value, 1, 3).cast("int")
    area = area - 1 - F.when(area > 666, 1).otherwise(0)
    pair = area * SSN_GROUPS + F.substring(value, 5, 2).cast("int") - 1
    ssn_moved = feistel_numbers(pair, F.substring(value, 8, 4).cast("int") - 1, SSN_AREAS * SSN_GROUPS, SSN_SERIALS, key, "ssn")

    def ssn_text(s: Column) -> Column:
        at = (s["l"] / SSN_GROUPS).cast("int")
        real = at + 1 + F.when(at + 1 >= 666, 1).otherwise(0)
        parts = ((real, 3), (s["l"] % SSN_GROUPS + 1, 2), (s["r"] + 1, 4))
        return F.concat_ws("-", *[F.lpad(x.cast("string"), n, "0") for x, n in parts])

    ssn = F.transform(F.array(ssn_moved), ssn_text)[0]
    octets = F.transform(F.split(value, r"\."), lambda x: x.cast("long"))
    ip_moved = feistel_numbers(octets[0] * 256 + octets[1], octets[2] * 256 + octets[3], 65536, 65536, key, "ip")
    ip = F.transform(
        F.array(ip_moved),
        lambda s: F.concat_ws(
            ".", *[x.cast("string") for p in ("l", "r") for x in ((s[p] / 256).cast("int"), s[p] % 256)]
        ),
    )[0]
    digits = digits_of(value)
    payload = feistel_text(F.substring(digits, F.lit(1), F.length(digits) - 1), key, "card")
    card = F.transform(
        F.array(payload),
        lambda x: laid_over(value, F.concat(x, F.pmod(10 - luhn_sum(x, 1) % 10, F.lit(10)).cast("string"))),
    )[0]
    front = F.regexp_extract(value, r"^(?:\+[0-9]{1,3}(?=[ .(-]))?", 0)
    local = F.substring(value, F.length(front) + 1, whole)
    phone = F.concat(front, F.transform(F.array(feistel_text(digits_of(local), key, "phone")), lambda x: laid_over(local, x))[0])
    by_kind = {
        "email": email, "secret": secret, "access_key": access, "hex_key": feistel_text(value, key, "hex_key", True),
        "iban": iban, "date": date, "ssn": ssn, "ip": ip, "card": card, "phone": phone,
    }
    out = None
    for name, made in by_kind.items():
        out = F.when(kind == name, made) if out is None else out.when(kind == name, made)
    return out.otherwise(value)


def pseudonymise(docs: DataFrame, key: str) -> DataFrame:
    """`docs` with `text` rewritten, plus n_private and `kinds` (one per replaced value, in order).

    Null text stays null and has no values; an empty one stays empty. Every row is treated by
    itself, so repeated rows come out alike and no rows give none. Input columns n_private and
    kinds are replaced; all others are kept as they are. Values that fail validation stay.
    """
    # The row travels as one column, so that no name of its own can clash.
    others = [c for c in docs.columns if c not in ("text", "n_private", "kinds")]
    look = F.coalesce(F.col("text").rlike(WORTH_A_LOOK), F.lit(False))
    found = F.when(look, F.regexp_extract_all("text", F.lit(ANY), 0)).otherwise(F.array().cast("array<string>"))
    rows = docs.select(F.struct(*others, F.lit(1).alias("_")).alias("_row"), "text", found.alias("_found"))
    values = F.transform("_found", lambda m: F.struct(m.alias("m"), kind_of(m).alias("k")))
    # Cards of no usual shape may be several numbers as well; read again, the whole comes last.
    usual = "^(?:" + "|".join(f"(?:{p})" for p in CARD_PLAIN) + ")$"
    again = lambda v: v["k"].isNull() | ((v["k"] == "card") & ~v["m"].rlike(usual))
    rows = rows.select("_row", "text", values.alias("_once"))
    values = F.transform("_once", lambda v: F.when(again(v), readings(v["m"])).otherwise(F.array(v)))
    rows = rows.select("_row", "text", values.alias("_values"))
    pieces = F.split("text", ANY, -1)

    def replaced(p: Column, v: Column) -> Column:
        new = F.transform(v, lambda x: F.coalesce(pseudonym(x["m"], x["k"], key), F.lit("")))
        return F.concat(p, F.coalesce(F.array_join(new, ""), F.lit("")))

    joined = F.array_join(F.zip_with(pieces, "_values", replaced), "")
    kinds = F.filter(F.transform(F.flatten("_values"), lambda v: v["k"]), lambda k: k.isNotNull())
    rows = rows.withColumn("kinds", kinds)
    text = F.when(F.size("kinds") > 0, joined).otherwise(F.col("text")).alias("text")
    return rows.select(*[F.col("_row")[c].alias(c) for c in others], text, F.size("kinds").cast("long").alias("n_private"), "kinds")
