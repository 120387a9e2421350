"""Names and numbers: cell names, list numbers, colours, packed dates, serial dates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Roman numerals of 0 to 9 at each place.
ROMAN = [
    ["", "I", "II", "III", "IV", "V", "VI", "VII", "VIII", "IX"],
    ["", "X", "XX", "XXX", "XL", "L", "LX", "LXX", "LXXX", "XC"],
    ["", "C", "CC", "CCC", "CD", "D", "DC", "DCC", "DCCC", "CM"],
    ["", "M", "MM", "MMM"],
]


def column_name(col: Column) -> Column:
    """0 -> A, 25 -> Z, 26 -> AA, up to three letters."""
    letter = lambda n: F.chr(n.cast("int") + 65)
    low = F.pmod(col, F.lit(26))
    second = F.floor(col / 26) - 1
    third = F.floor(second / 26) - 1
    return F.when(col < 26, letter(low)).when(col < 702, F.concat(letter(second), letter(low))).otherwise(F.concat(letter(third), letter(F.pmod(second, F.lit(26))), letter(low)))


def a1_name(col: Column, row: Column, absolute_col: bool = False, absolute_row: bool = False) -> Column:
    return F.concat(F.lit("$" * absolute_col), column_name(col), F.lit("$" * absolute_row), (row + 1).cast("string"))


def a1_position(name: Column) -> Column:
    """struct(col, row) of a cell name, either with $."""
    plain = F.upper(F.regexp_replace(name, "\\$", ""))
    letters, digits = F.regexp_extract(plain, "^([A-Z]{1,3})[0-9]+$", 1), F.regexp_extract(plain, "^[A-Z]{1,3}([0-9]+)$", 1)
    number = F.aggregate(F.split(letters, "(?!^)(?!$)"), F.lit(0), lambda a, c: a * 26 + F.ascii(c) - 64)
    return F.when(digits != "", F.struct((number - 1).alias("col"), (digits.cast("int") - 1).alias("row")))


def roman(n: Column, lower: bool = False) -> Column:
    """1..3999; other numbers give the first numeral, as list labels do."""
    own = F.when((n > 0) & (n < 4000), n).otherwise(F.lit(1)).cast("int")
    place = lambda k: F.element_at(F.array(*map(F.lit, ROMAN[k])), F.pmod(F.floor(own / 10**k), F.lit(10)).cast("int") + 1)
    out = F.concat(*(place(k) for k in (3, 2, 1, 0)))
    return F.lower(out) if lower else out


def from_roman(text: Column) -> Column:
    """The value of a Roman numeral; null for other texts."""
    digits = {"M": 1000, "D": 500, "C": 100, "L": 50, "X": 10, "V": 5, "I": 1}
    up = F.upper(F.trim(text))
    value = lambda c: F.coalesce(F.element_at(F.create_map(*(F.lit(x) for kv in digits.items() for x in kv)), c), F.lit(0))
    chars = F.split(up, "(?!^)(?!$)")
    sums = F.aggregate(F.reverse(chars), F.struct(F.lit(0).alias("sum"), F.lit(0).alias("most")), lambda a, c: F.struct(F.when(value(c) < a["most"], a["sum"] - value(c)).otherwise(a["sum"] + value(c)).alias("sum"), F.greatest(a["most"], value(c)).alias("most")), lambda a: a["sum"])
    return F.when(up.rlike("^M{0,3}(CM|CD|D?C{0,3})(XC|XL|L?X{0,3})(IX|IV|V?I{0,3})$") & (up != ""), sums)


def alphabetic(n: Column, lower: bool = False) -> Column:
    """1 -> A, 26 -> Z, 27 -> AA; numbers under 1 give A."""
    out = column_name(F.greatest(n, F.lit(1)) - 1)
    return F.lower(out) if lower else out


def list_label(n: Column, kind: str) -> Column:
    """kind: 1, A, a, I, i, or none."""
    return {"1": lambda: n.cast("string"), "A": lambda: alphabetic(n), "a": lambda: alphabetic(n, True), "I": lambda: roman(n), "i": lambda: roman(n, True)}.get(kind, lambda: F.lit(""))()


# Serial numbers: days; fractions of a day.

EPOCH = "1899-12-30"


def serial_to_date(serial: Column, strict: bool = False) -> Column:
    """The day of a serial number, counted from 1899-12-30. Null beyond 10000 years either way.

    strict: as readers of legacy files give it: serial 1 is 1900-01-01, and a day's last
    four tenths count to the next day."""
    known = F.abs(serial) <= 3650000
    if strict:
        days = serial - F.when(serial > 0, F.lit(1.6)).otherwise(F.lit(2.6))
        days = F.when(days >= 0, F.floor(days)).otherwise(F.ceil(days))
        return F.when(known, F.date_add(F.lit("1900-01-01").cast("date"), days.cast("int")))
    return F.when(known, F.date_add(F.lit(EPOCH).cast("date"), F.floor(serial).cast("int")))


def date_to_serial(day: Column) -> Column:
    return F.datediff(day, F.lit(EPOCH).cast("date"))


def serial_to_time(serial: Column) -> Column:
    """Seconds of the day, rounded; null outside 0..1."""
    return F.when((serial >= 0) & (serial <= 1), F.floor(serial * 86400 + 0.5).cast("int"))


def time_text(seconds: Column) -> Column:
    return F.format_string("%02d:%02d:%02d", F.floor(seconds / 3600).cast("int"), F.floor(F.pmod(seconds, F.lit(3600)) / 60).cast("int"), F.pmod(seconds, F.lit(60)).cast("int"))


def packed_datetime(day: Column, time: Column) -> Column:
    """YYYYMMDD and HHMMSScc as an ISO text; null where they are no date."""
    d, t = F.lpad(day.cast("string"), 8, "0"), F.lpad(time.cast("string"), 8, "0")
    text = F.concat(F.substring(d, 1, 4), F.lit("-"), F.substring(d, 5, 2), F.lit("-"), F.substring(d, 7, 2), F.lit("T"), F.substring(t, 1, 2), F.lit(":"), F.substring(t, 3, 2), F.lit(":"), F.substring(t, 5, 2))
    return F.when(F.try_to_timestamp(text).isNotNull(), F.concat(text, F.lit("."), F.substring(t, 7, 2)))


# Texts, colours, geometry.


def split_first(text: Column, delimiter: str) -> Column:
    """struct(head, tail) at the first delimiter; an empty tail without one."""
    at = F.instr(text, delimiter)
    return F.struct(F.when(at > 0, F.substring(text, F.lit(1), at - 1)).otherwise(text).alias("head"), F.when(at > 0, F.substring(text, at + len(delimiter), F.length(text))).otherwise(F.lit("")).alias("tail"))


def simplified(text: Column) -> Column:
    """Runs of characters outside ASCII become one @."""
    return F.regexp_replace(text, "[^\\x00-\\x7F]+", "@")


def printable(text: Column) -> Column:
    """Without control characters but tab and line ends."""
    return F.regexp_replace(text, "[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F]", "")


def blended(a: Column, b: Column, share: Column) -> Column:
    """A colour between two 24-bit ones; share 1 is a."""
    out = F.lit(0)
    for shift in (16, 8, 0):
        part = lambda c, s=shift: F.shiftright(c, s).bitwiseAND(F.lit(255))
        out = out + F.floor(share * part(a) + (1 - share) * part(b)).cast("int") * (1 << shift)
    return out


def colour_text(colour: Column) -> Column:
    return F.concat(F.lit("#"), F.lower(F.lpad(F.hex(colour.bitwiseAND(F.lit(0xFFFFFF))), 6, "0")))


def rotated(x: Column, y: Column, angle: Column, cx: Column, cy: Column) -> Column:
    """A point turned by an angle in degrees about a centre."""
    a = F.radians(angle)
    return F.struct((F.cos(a) * (x - cx) - F.sin(a) * (y - cy) + cx).alias("x"), (F.sin(a) * (x - cx) + F.cos(a) * (y - cy) + cy).alias("y"))


# Units to the inch.
UNITS = {"twip": 1440, "point": 72, "inch": 1}


def scaled(value: Column, unit: str, to: str) -> Column:
    return value * (UNITS[to] / UNITS[unit])
