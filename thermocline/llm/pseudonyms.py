"""Format-preserving pseudonyms: validated numbers and dates are permuted within their format by a keyed Feistel network."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from thermocline.functions.binding import let

ROUNDS = 6
# The formats that are looked for, most specific first.
PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}",
    "date": r"(?<![0-9-])(?:19|20)[0-9]{2}-(?:0[1-9]|1[0-2])-(?:0[1-9]|[12][0-9]|3[01])(?![0-9-])",
    "ip": r"(?<![0-9.])(?:(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])\.){3}(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])(?![0-9]|\.[0-9])",
    "ssn": r"(?<![0-9-])(?!000|666|9[0-9]{2})[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9-])",
    "phone": r"\+1 \([2-9][0-9]{2}\) [2-9][0-9]{2}-[0-9]{4}(?![0-9])",
    "card": r"(?<![0-9A-Za-z])(?:[0-9]{13,19}|[0-9]{4}(?:[ -][0-9]{4}){3})(?![0-9A-Za-z])",
}
ANY = "|".join(PATTERNS.values())
DAYS = (250, 292)  # dates from 1900-01-01 on: 73,000 days
FIRST_DAY = "1900-01-01"


def _round(key: str, kind: str, k: int, half: Column, modulus: Column) -> Column:
    digest = F.md5(F.concat_ws("|", F.lit(f"{key}|{kind}|{k}"), half.cast("string")))
    return F.conv(F.substring(digest, 1, 14), 16, 10).cast("long") % modulus


def feistel(left: Column, left_size: Column, right: Column, right_size: Column, key: str, kind: str, inverse: bool = False) -> Column:
    """(l, r) permuted among left_size x right_size pairs: rounds add a keyed hash of one half to the other, in turns."""
    state = F.struct(left.cast("long").alias("l"), right.cast("long").alias("r"), left_size.cast("long").alias("a"), right_size.cast("long").alias("b"))
    sign = -1 if inverse else 1

    def step(k: int):
        def run(s: Column) -> Column:
            if k % 2 == 0:
                l, r = F.pmod(s["l"] + sign * _round(key, kind, k, s["r"], s["a"]), s["a"]), s["r"]  # noqa: E741
            else:
                l, r = s["l"], F.pmod(s["r"] + sign * _round(key, kind, k, s["l"], s["b"]), s["b"])  # noqa: E741
            return F.struct(l.alias("l"), r.alias("r"), s["a"].alias("a"), s["b"].alias("b"))

        return run

    steps = range(ROUNDS - 1, -1, -1) if inverse else range(ROUNDS)
    for k in steps:
        state = let(state, step(k))
    return state


def _padded(value: Column, width: Column | int) -> Column:
    return F.lpad(value.cast("string"), width if isinstance(width, int) else width.cast("int"), "0")


def _luhn_sum(digits: Column, doubled_from: int) -> Column:
    """Luhn sum of a digit string read from its end; ``doubled_from`` 0 doubles the last digit, 1 the one before."""
    places = F.transform(F.split(F.reverse(digits), ""), lambda c, i: F.struct(c.cast("int").alias("d"), i.alias("i")))
    values = F.transform(
        places, lambda x: F.when(x["i"] % 2 == doubled_from, (x["d"] * 2) % 10 + F.floor(x["d"] * 2 / 10).cast("int")).otherwise(x["d"])
    )
    return F.aggregate(values, F.lit(0), lambda a, b: a + F.coalesce(b, F.lit(0)))


def _card(m: Column, key: str, inverse: bool) -> Column:
    def permuted(digits: Column) -> Column:
        n = F.length(digits)
        rest = F.substr(digits, F.lit(7), n - 7)
        moved = feistel(F.substring(digits, 1, 6), F.lit(1_000_000), rest, F.pow(F.lit(10.0), n - 7), key, "card", inverse)
        payload = let(moved, lambda s: F.concat(_padded(s["l"], 6), _padded(s["r"], n - 7)))
        full = let(payload, lambda p: F.concat(p, ((10 - _luhn_sum(p, 0) % 10) % 10).cast("string")))
        spaced = lambda f, mark: F.concat_ws(mark, *[F.substring(f, 1 + 4 * k, 4) for k in range(4)])
        shaped = let(full, lambda f: F.when(m.contains(" "), spaced(f, " ")).when(m.contains("-"), spaced(f, "-")).otherwise(f))
        return F.when(_luhn_sum(digits, 1) % 10 == 0, shaped).otherwise(m)

    return let(F.regexp_replace(m, "[^0-9]", ""), permuted)


def _phone(m: Column, key: str, inverse: bool) -> Column:
    moved = feistel(
        F.substring(m, 5, 3).cast("long") - 200, F.lit(800),
        (F.substring(m, 10, 3).cast("long") - 200) * 10000 + F.substring(m, 14, 4).cast("long"), F.lit(8_000_000), key, "phone", inverse,
    )
    return let(
        moved,
        lambda s: F.concat(F.lit("+1 ("), (s["l"] + 200).cast("string"), F.lit(") "), F.floor(s["r"] / 10000 + 200).cast("string"), F.lit("-"), _padded(s["r"] % 10000, 4)),
    )


def _ip(m: Column, key: str, inverse: bool) -> Column:
    part = lambda k: F.split_part(m, F.lit("."), F.lit(k)).cast("long")
    moved = feistel(part(1) * 256 + part(2), F.lit(65536), part(3) * 256 + part(4), F.lit(65536), key, "ip", inverse)
    return let(moved, lambda s: F.concat_ws(".", *[x.cast("string") for h in ("l", "r") for x in (F.floor(s[h] / 256), s[h] % 256)]))


def _ssn(m: Column, key: str, inverse: bool) -> Column:
    area = F.substring(m, 1, 3).cast("long") - 1
    right = (F.substring(m, 5, 2).cast("long") - 1) * 9999 + F.substring(m, 8, 4).cast("long") - 1
    moved = feistel(F.when(area > 665, area - 1).otherwise(area), F.lit(898), right, F.lit(99 * 9999), key, "ssn", inverse)
    return let(
        moved,
        lambda s: F.concat_ws("-", _padded(F.when(s["l"] >= 665, s["l"] + 2).otherwise(s["l"] + 1), 3), _padded(F.floor(s["r"] / 9999) + 1, 2), _padded(s["r"] % 9999 + 1, 4)),
    )


def _date(m: Column, key: str, inverse: bool) -> Column:
    day = F.datediff(F.try_to_date(m), F.to_date(F.lit(FIRST_DAY)))
    moved = feistel(F.floor(day / DAYS[1]), F.lit(DAYS[0]), day % DAYS[1], F.lit(DAYS[1]), key, "date", inverse)
    back = let(moved, lambda s: F.date_format(F.date_add(F.to_date(F.lit(FIRST_DAY)), (s["l"] * DAYS[1] + s["r"]).cast("int")), "yyyy-MM-dd"))
    return F.when((day >= 0) & (day < DAYS[0] * DAYS[1]), back).otherwise(m)


def _email(m: Column, key: str) -> Column:
    """The name becomes as many letters of a keyed hash (8 to 32); an address is no number, so this is no permutation."""
    name = F.split_part(m, F.lit("@"), F.lit(1))
    digest = F.translate(F.md5(F.concat_ws("|", F.lit(f"{key}|email"), F.lower(m))), "0123456789", "ghijklmnop")
    return F.concat(F.substr(digest, F.lit(1), F.greatest(F.lit(8), F.least(F.lit(32), F.length(name)))), F.lit("@"), F.split_part(m, F.lit("@"), F.lit(2)))


def _kind(m: Column) -> Column:
    out = F.when(m.contains("@"), F.lit("email"))
    for kind in ("date", "ip", "ssn", "phone"):
        out = out.when(m.rlike(f"^(?:{PATTERNS[kind]})$"), F.lit(kind))
    return out.otherwise(F.lit("card"))


def pseudonym(match: Column, key: str, inverse: bool = False) -> Column:
    """The pseudonym of one match; equal matches have equal pseudonyms under one key, and all but addresses can be inverted."""

    def by_kind(kind: Column) -> Column:
        return (
            F.when(kind == "email", match if inverse else _email(match, key))
            .when(kind == "date", _date(match, key, inverse)).when(kind == "ip", _ip(match, key, inverse))
            .when(kind == "ssn", _ssn(match, key, inverse)).when(kind == "phone", _phone(match, key, inverse))
            .otherwise(_card(match, key, inverse))
        )

    return let(_kind(match), by_kind)


def pseudonymise(docs: DataFrame, key: str, inverse: bool = False) -> DataFrame:
    """``docs`` with ``text`` rewritten and ``n_replaced``, the number of values that changed hands.

    Card numbers (13 to 19 digits with a valid Luhn digit), North American phone numbers, IPv4 addresses, social security
    numbers and ISO dates are permuted among the valid values of their format by a Feistel network whose rounds add keyed hashes modulo the
    size of each half; the check digit is computed anew. Mail addresses get a keyed name. Invalid numbers stay, and
    so does everything else. A null text stays null; rows are independent, so ties and repeated rows need no rule; a column
    ``n_replaced`` of ``docs`` is replaced. Nothing is shuffled. The key must be kept apart from the data.
    """
    text = F.col("text")
    matches = F.regexp_extract_all(text, F.lit(f"({ANY})"), F.lit(1))
    swapped = let(matches, lambda ms: F.struct(ms.alias("was"), F.transform(ms, lambda m: pseudonym(m, key, inverse)).alias("now")))

    def rebuilt(s: Column) -> Column:
        pieces = F.zip_with(F.split(text, ANY, -1), s["now"], lambda p, n: F.concat(F.coalesce(p, F.lit("")), F.coalesce(n, F.lit(""))))
        changed = F.size(F.filter(F.zip_with(s["was"], s["now"], lambda a, b: a != b), lambda x: x))
        return F.struct(F.array_join(pieces, "").alias("text"), changed.cast("long").alias("n"))

    # Texts without a digit or an address are not searched further.
    found = F.when(text.rlike("[0-9@]"), let(swapped, rebuilt))
    return docs.withColumn("_found", found).withColumns(
        {"text": F.coalesce(F.col("_found.text"), text), "n_replaced": F.coalesce(F.col("_found.n"), F.lit(0).cast("long"))}
    ).drop("_found")
