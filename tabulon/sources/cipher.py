"""The password cipher of legacy documents, and the mask of whole streams."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

# The key by which passwords themselves are enciphered.
PASSWORD_KEY = bytes([0xAB, 0x9E, 0x43, 0x05, 0x38, 0x12, 0x4D, 0x44, 0xD5, 0x7E, 0xE3, 0x84, 0x98, 0x23, 0x3F, 0xBA])
SIZE = 16


def apply(data: bytes, key: bytes) -> bytes:
    """The cipher, either way: a running key of 16 bytes, each changed by its neighbour once used."""
    if not key:
        return data
    if len(key) != SIZE:
        raise ValueError("a key has 16 bytes")
    running, out = bytearray(key), bytearray(data)
    for k in range(len(out)):
        i = k % SIZE
        out[k] ^= running[i] ^ (running[0] * i & 0xFF)
        running[i] = (running[i] + running[(i + 1) % SIZE]) & 0xFF or 1
    return bytes(out)


def key_of(password: str | bytes) -> bytes:
    raw = password.encode("latin-1", "replace") if isinstance(password, str) else password
    return apply(raw[:SIZE].ljust(SIZE, b" "), PASSWORD_KEY)


def stamp(date: int, time: int) -> bytes:
    return f"{date:08x}{time:08x}".encode()


def fits(key: bytes, date: int, time: int, check: bytes) -> bool:
    """Does a key turn the document's date and time into its check value? Without date and time nothing can be told."""
    return not date and not time or apply(stamp(date, time), key) == check


def guessed(date: int, time: int, check: bytes) -> bytes | None:
    """The key, from the check value alone: the sum of its first two bytes decides all others, so 256 sums are tried. Of those that give a password without zeros, the one with most spaces at its end; None unless there is just one."""
    if len(check) != SIZE or not date and not time:
        return None
    source, found = stamp(date, time), []
    for total in range(256):
        key = bytes(s ^ c ^ (total * k & 0xFF) for k, (s, c) in enumerate(zip(source, check, strict=True)))
        if 0 in key or ((key[0] + key[1]) & 0xFF or 1) != total:
            continue
        password = apply(key, PASSWORD_KEY)
        if 0 not in password:
            found.append((len(password) - len(password.rstrip(b" ")), key))
    most = max((n for n, _ in found), default=0)
    best = [k for n, k in found if n == most]
    return best[0] if len(best) == 1 else None


def swapped(b: int) -> int:
    return b >> 4 | (b & 15) << 4


def mask_for(seen: int, wanted: int) -> int:
    """The mask under which a byte reads as wanted."""
    return swapped(seen) ^ wanted


def unmasked(data: bytes, mask: int) -> bytes:
    """A stream with its half-bytes swapped and a mask over them. Mask 0 leaves it as it is."""
    return data.translate(bytes(swapped(b) ^ mask for b in range(256))) if mask else data


def masked(data: bytes, mask: int) -> bytes:
    return data.translate(bytes(swapped(b ^ mask) for b in range(256))) if mask else data


@F.pandas_udf(BinaryType())
def enciphered(data: pd.Series, password: pd.Series) -> pd.Series:
    return pd.Series([None if d is None or p is None else apply(bytes(d), key_of(p)) for d, p in zip(data, password, strict=True)], dtype=object)
