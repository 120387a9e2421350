"""Character sets of legacy documents, by number."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Codecs from a number on. Numbers between the lists have no character set.
CODECS = {
    0: "cp1252 cp1252 mac_roman cp437 cp850 cp860 cp861 cp863 cp865",
    10: "symbol cp1252 cp1252 cp1250 iso8859_3 iso8859_4 cp1251 iso8859_6 cp1253 iso8859_8 cp1254 iso8859_14 cp1252 cp737 cp775 cp852 cp855 cp857 cp862 cp864 cp866 cp869 cp874 cp1250 cp1251 cp1253 cp1254 cp1255 cp1256 cp1257 cp1258",
    42: "mac_latin2 mac_croatian mac_cyrillic",
    47: "mac_greek",
    51: "mac_iceland mac_romanian",
    54: "mac_turkish mac_cyrillic gb2312 big5 shift_jis euc_kr cp932 gbk cp949 cp950 shift_jis gb2312 gb2312 gbk big5 euc_jp gb2312",
    74: "koi8_r utf_7 utf_8 iso8859_10 iso8859_13 euc_kr",
    81: "jis_x_0201 jis_x_0208 jis_x_0212 johab",
    86: "big5hkscs tis_620 koi8_u iscii",
    0xFFFE: "utf_32_be utf_16_be",
}
BY_NUMBER = {first + k: name for first, names in CODECS.items() for k, name in enumerate(names.split())}


def _own(data: bytes, name: str) -> str:
    """Sets without a codec of their own."""
    if name == "symbol":  # a font's own glyphs, in the private area
        return "".join(chr(0xF000 + b) if b >= 32 else chr(b) for b in data)
    if name == "jis_x_0201":
        return "".join("¥" if b == 0x5C else "‾" if b == 0x7E else chr(b) if b < 0x80 else chr(0xFF61 + b - 0xA1) if 0xA1 <= b <= 0xDF else "�" for b in data)
    if name in ("jis_x_0208", "jis_x_0212"):  # rows and cells, as the set's plane of EUC
        lead = b"\x8f" if name == "jis_x_0212" else b""
        return "".join((lead + bytes([data[k] | 0x80, data[k + 1] | 0x80])).decode("euc_jp", "replace") for k in range(0, len(data) - 1, 2))
    # Devanagari: the letters lie in the order of the Unicode block, with two gaps.
    table = {0xA1 + k: 0x901 + k for k in range(3)} | {0xEA: 0x964} | {0xF1 + k: 0x966 + k for k in range(10)}
    letters = [0x905, 0x906, 0x907, 0x908, 0x909, 0x90A, 0x90B, 0x90E, 0x90F, 0x910, 0x90D, 0x912, 0x913, 0x914, 0x911, *range(0x915, 0x92F), 0x92F, 0x95F, *range(0x930, 0x93A)]
    table |= dict(zip(range(0xA4, 0xD9), letters, strict=False))
    table |= dict(zip(range(0xDA, 0xE9), [0x93E, 0x93F, 0x940, 0x941, 0x942, 0x943, 0x946, 0x947, 0x948, 0x945, 0x94A, 0x94B, 0x94C, 0x949, 0x94D], strict=False))
    return "".join(chr(b) if b < 0x80 else chr(table.get(b, 0xFFFD)) for b in data)


#: Bytes that a code page leaves open stand for themselves.
def decode(data: bytes, number: int) -> str:
    name = BY_NUMBER.get(number, "cp1252")
    if name in ("symbol", "jis_x_0201", "jis_x_0208", "jis_x_0212", "iscii"):
        return _own(data, name)
    try:
        return data.decode(name)
    except UnicodeDecodeError:
        if name.startswith(("cp125", "cp87", "iso8859")):
            return "".join(_one(data[k : k + 1], name) for k in range(len(data)))
        return data.decode(name, "replace")


def _one(b: bytes, name: str) -> str:
    try:
        return b.decode(name)
    except UnicodeDecodeError:
        return chr(b[0])


def positions(data: bytes, number: int) -> tuple[str, list[int]]:
    """The text, and the byte at which each of its characters begins."""
    name = BY_NUMBER.get(number, "cp1252")
    text = decode(data, number)
    if len(text) == len(data):
        return text, list(range(len(data)))
    if name in ("jis_x_0208", "jis_x_0212"):
        return text, list(range(0, 2 * len(text), 2))
    import codecs

    step, out, starts, start = codecs.getincrementaldecoder(name)("replace"), [], [], 0
    for k in range(len(data)):
        own = step.decode(data[k : k + 1], k + 1 == len(data))
        if own:
            out.append(own)
            starts += [start] * len(own)
            start = k + 1
    return "".join(out), starts


@F.pandas_udf(StringType())
def decoded(data: pd.Series, number: pd.Series) -> pd.Series:
    """Bytes in the character set of a number."""
    return pd.Series([None if d is None or n != n else decode(bytes(d), int(n)) for d, n in zip(data, number, strict=True)], dtype=object)
