"""Byte-level BPE by dynamic programming over prefixes.

For a byte string, exactly one token can end the encoding of each of its prefixes. It is
the token t that ends there and for which the pair (last token of the prefix before t, t)
encodes to itself. Storing that token per prefix gives the whole encoding by walking
back, lets bytes be appended without looking at earlier ones again, and lets an edit be
re-encoded from where it begins until the table agrees with the old one for as many
positions as the longest token has bytes.

Texts are cut into matches of a pattern first, each encoded separately. Special tokens
do not exist here. Matches are cached in each worker, in dictionaries of bounded size.

Defined results: null text counts as empty, with no ids; repeated rows are encoded each;
an empty table gives an empty one; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from tabulon.llm.runtime import table
from tabulon.llm.tokens import LITTLE, encoder

#: Entries that a worker's dictionary may hold before it starts anew.
CACHED = 400_000
#: Bytes of the longest match whose prefixes are stored for others to use.
SHARED = 48
#: Unicode white space, as the pattern's \s means it.
SPACE = "\\t-\\r\\x20\\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"


class PrefixBpe:
    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.tokens = {i: b for b, i in ranks.items()}
        self.longest = max(map(len, ranks))
        self.pairs: dict[tuple[int, int], bool] = {}
        self.known: dict[bytes, int] = {}
        #: Tokens that merging can reach, by their bytes. The others stand only for a whole match.
        self.usable: dict[bytes, int] = {}
        halves: dict[bytes, tuple[bytes, bytes]] = {}
        for b, i in ranks.items():
            steps: list[tuple[bytes, bytes]] = []
            if self.merged(b, steps) == [i]:
                self.usable[b] = i
                if steps:
                    halves[b] = steps[-1]
        #: A token's parts at either end, each with the rank of the part it goes into.
        self.heads = {i: self._ends(b, halves, 0) for b, i in self.usable.items()}
        self.tails = {i: self._ends(b, halves, 1) for b, i in self.usable.items()}
        self.ends: dict[bytes, tuple[int, ...]] = {}
        self.longer: dict[bytes, set[int]] = {}
        for b in self.usable:
            if len(b) > 4:
                self.longer.setdefault(b[-4:], set()).add(len(b))

    def _ends(self, token: bytes, halves: dict, side: int) -> list[tuple[bytes, int]]:
        out, into = [], 1 << 60
        while True:
            out.append((token, into))
            if token not in halves:
                return out
            into, token = self.ranks[token], halves[token][side]

    def merged(self, data: bytes, steps: list | None = None) -> list[int]:
        """The encoding by merging, for short strings. steps: gets the pairs merged, in order."""
        parts = [data[k : k + 1] for k in range(len(data))]
        while len(parts) > 1:
            best, at = min(((self.ranks.get(a + b, 1 << 60), k) for k, (a, b) in enumerate(zip(parts, parts[1:], strict=False))), default=(1 << 60, 0))
            if best == 1 << 60:
                break
            if steps is not None:
                steps.append((parts[at], parts[at + 1]))
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [self.ranks[p] for p in parts]

    def follows(self, left: int, right: int) -> bool:
        """Does the pair encode to itself? It does unless some part at the end of the left token
        merges with one at the head of the right before either goes into a larger part. Of equal
        ranks the one further left merges first."""
        known = self.pairs.get((left, right))
        if known is None:
            if len(self.pairs) >= CACHED:
                self.pairs.clear()
            rank, heads, known = self.ranks.get, self.heads[right], True
            for a, a_into in self.tails[left]:
                for b, b_into in heads:
                    crossing = rank(a + b)
                    if crossing is not None and crossing < a_into and crossing <= b_into:
                        known = False
                        break
                if not known:
                    break
            self.pairs[left, right] = known
        return known

    def _sizes(self, end: bytes) -> tuple[int, ...]:
        """Lengths of the tokens that can end in these last (at most four) bytes, longest first."""
        if len(self.ends) > CACHED:
            self.ends.clear()
        own = {k for k in range(1, len(end) + 1) if end[-k:] in self.usable}
        if len(end) == 4:
            own |= self.longer.get(end, set())
        self.ends[end] = tuple(sorted(own, reverse=True))
        return self.ends[end]

    def last(self, data: bytes, stop: int, table: list[int]) -> int:
        """The last token of data[:stop]; table[i]: that of data[:i], for all i < stop."""
        usable, pairs = self.usable.get, self.pairs.get
        for start in range(max(0, stop - self.longest), stop):
            token = usable(data[start:stop])
            if token is not None:
                if not start:
                    return token
                ok = pairs((table[start], token))
                if ok or ok is None and self.follows(table[start], token):
                    return token
        raise ValueError("a byte has no token")

    def prefixes(self, data: bytes) -> list[int]:
        table = [-1]
        for stop in range(1, len(data) + 1):
            table.append(self.last(data, stop, table))
        return table

    def walk(self, table: list[int]) -> list[int]:
        """The encoding that a table of last tokens stands for."""
        out, at = [], len(table) - 1
        while at:
            out.append(table[at])
            at -= len(self.tokens[table[at]])
        return out[::-1]

    def piece(self, data: bytes) -> list[int]:
        """A match's ids: a token of just these bytes comes first."""
        whole = self.ranks.get(data)
        if whole is not None:
            return [whole]
        return self.shared(data) if len(data) <= SHARED else self.walk(self.prefixes(data))

    def shared(self, data: bytes) -> list[int]:
        """As walk(prefixes(data)), with one table for the prefixes of all matches: a prefix's last token doesn't depend on what follows."""
        known, usable, pairs, tokens, ends = self.known, self.usable.get, self.pairs.get, self.tokens, self.ends
        if len(known) > 2 * CACHED:
            known.clear()
        stop = len(data)
        while stop and data[:stop] not in known:
            stop -= 1
        while stop < len(data):
            stop += 1
            end = data[stop - 4 : stop] if stop > 4 else data[:stop]
            for size in ends.get(end) or self._sizes(end):
                start = stop - size
                token = usable(data[start:stop]) if start >= 0 else None
                if token is not None:
                    if not start:
                        break
                    before = known[data[:start]]
                    ok = pairs((before, token))
                    if ok or ok is None and self.follows(before, token):
                        break
            known[data[:stop]] = token
        out = []
        while stop:
            token = known[data[:stop]]
            out.append(token)
            stop -= len(tokens[token])
        return out[::-1]

    def decode(self, ids) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))


class Growing:
    """A byte string with its table of last tokens, to append to and to edit."""

    def __init__(self, bpe: PrefixBpe, data: bytes = b""):
        self.bpe, self.data, self.table = bpe, b"", [-1]
        self.append(data)

    def append(self, data: bytes) -> None:
        self.data += data
        for stop in range(len(self.table), len(self.data) + 1):
            self.table.append(self.bpe.last(self.data, stop, self.table))

    def edit(self, start: int, stop: int, new: bytes) -> int:
        """Puts new in place of data[start:stop]; returns how many table entries were computed."""
        old, shift = self.table, len(new) - (stop - start)
        self.data = self.data[:start] + new + self.data[stop:]
        self.table = old[: start + 1]
        same = computed = 0
        while len(self.table) <= len(self.data):
            at = len(self.table)
            self.table.append(self.bpe.last(self.data, at, self.table))
            computed += 1
            before = at - shift
            same = same + 1 if at > start + len(new) and old[before] == self.table[at] else 0
            if same >= self.bpe.longest:  # no later token reaches back past these
                self.table += old[before + 1 :]
                break
        return computed

    def ids(self) -> list[int]:
        return self.bpe.walk(self.table)


class TextBpe:
    """Whole texts: matches of a pattern, each by PrefixBpe."""

    #: How far a match of the public pattern looks past its end.
    AHEAD = 3
    ODD = re.compile("\\s ").search

    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.bpe = PrefixBpe(ranks)
        self.matches = regex.compile(pattern.replace("[^\\s", "[^" + SPACE).replace("\\s", f"[{SPACE}]").replace("\\S", f"[^{SPACE}]"))
        self.pieces: dict[str, bytes] = {}
        self.words: dict[str, bytes] = {}

    def _piece(self, match: str) -> bytes:
        found = self.pieces.get(match)
        if found is None:
            found = np.array(self.bpe.piece(match.encode()), LITTLE).tobytes()
            if len(match) <= 64:
                if len(self.pieces) >= CACHED:
                    self.pieces.clear()
                self.pieces[match] = found
        return found

    def _whole(self, text: str) -> bytes:
        return b"".join(map(self._piece, self.matches.findall(text)))

    def encode(self, text: str) -> np.ndarray:
        """A space between characters that aren't white space begins a match, so texts are cut there and words cached."""
        if self.ODD(text):
            return np.frombuffer(self._whole(text), LITTLE)
        first, *rest = text.split(" ")
        out, known = [self._whole(first)], self.words
        for word in rest:
            found = known.get(word)
            if found is None:
                found = self._whole(" " + word)
                if len(word) <= 64:
                    if len(known) >= CACHED:
                        known.clear()
                    known[word] = found
            out.append(found)
        return np.frombuffer(b"".join(out), LITTLE)

    def edited(self, text: str, ids: np.ndarray, start: int, stop: int, new: str) -> tuple[str, np.ndarray]:
        """text with new in place of text[start:stop], and its ids: only matches near the edit are encoded again."""
        after = text[:start] + new + text[stop:]
        head = tail = 0  # characters that keep their matches at each end
        old = [m.span() for m in self.matches.finditer(text)]
        for _, end in old:
            if end > start - self.AHEAD:
                break
            head = end
        starts, shift, at = {s for s, _ in old if s >= stop}, len(new) - (stop - start), head
        middle = []
        while at < len(after):
            if at >= start + len(new) and at - shift in starts:
                tail = at - shift
                break
            m = self.matches.match(after, at)
            middle.append(m[0])
            at = m.end()
        else:
            tail = len(text)
        sizes = lambda spans: sum(len(self._piece(text[a:b])) // 4 for a, b in spans)
        before, behind = sizes(x for x in old if x[1] <= head), sizes(x for x in old if x[0] >= tail)
        own = np.frombuffer(b"".join(map(self._piece, middle)), LITTLE)
        return after, np.concatenate([ids[:before], own, ids[len(ids) - behind :]])

    def decode(self, ids: np.ndarray) -> bytes:
        return self.bpe.decode(ids.tolist())


def _mapped(df: DataFrame, columns: list[str], make, schema: str) -> DataFrame:
    """make: gets lists of the columns' values, gives lists of the results'."""
    from pyspark.sql.types import StructType

    fields = StructType.fromDDL(schema).names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = None
        for batch in batches:
            for at in range(0, max(1, batch.num_rows), 512):
                part = batch.slice(at, 512)
                made = make(*(part.column(k).to_pylist() for k in range(part.num_columns)))
                kinds = kinds or [arrow_kind(t) for t in schema.split(", ")]
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(c, k) for c, k in zip(made, kinds[1:], strict=True))], fields)

    return df.select(*columns).mapInArrow(run, schema)


def arrow_kind(field: str) -> pa.DataType:
    return {"long": pa.int64(), "string": pa.string(), "binary": pa.binary(), "array<int>": pa.list_(pa.int32())}[field.split(" ")[1]]


def encode_texts(df: DataFrame, text_col: str = "text", id_col: str = "doc_id", ranks: str | None = None) -> DataFrame:
    """id, ids."""
    import public_tokenizers

    path, pattern = ranks or public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
    return _mapped(df, [id_col, text_col], lambda _, texts: ([encoder(TextBpe, path, pattern).encode(t or "").astype(np.int32) for t in texts],), f"{id_col} long, ids array<int>")


def decode_ids(df: DataFrame, ids_col: str = "ids", id_col: str = "doc_id", ranks: str | None = None) -> DataFrame:
    """id, data."""
    import public_tokenizers

    path, pattern = ranks or public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
    return _mapped(df, [id_col, ids_col], lambda _, rows: ([encoder(TextBpe, path, pattern).bpe.decode(x or []) for x in rows],), f"{id_col} long, data binary")


def op6_prefix_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path, pattern = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN

    def digest(_, texts: list) -> tuple:
        own = encoder(TextBpe, path, pattern)
        ids = [own.encode(t or "") for t in texts]
        return [len(x) for x in ids], [hashlib.sha256(x).hexdigest() for x in ids], [hashlib.sha256(own.decode(x)).hexdigest() for x in ids]

    return _mapped(table(spark, sf_dir, "documents"), ["doc_id", "text"], digest, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


QUERIES = {"op6_prefix_bpe": op6_prefix_bpe}
