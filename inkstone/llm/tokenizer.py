"""Encoding of a corpus with a public byte-level BPE vocabulary, as a streaming transducer.

Pre-tokens are read one after the other; no later character moves a boundary once the next pre-token has begun. Within a
pre-token the transducer keeps, for every prefix, the last token of that prefix's encoding: a token that begins where a prefix
ends is the last one of the longer prefix if and only if it can follow that prefix's last token, which holds for (a, b) if
bytes(a) + bytes(b) encodes to just these two. Between two characters that no entry spans, nothing has to be looked ahead;
elsewhere the lookahead is the length of the longest vocabulary entry: every token that
ends later begins at one of the last so many bytes, so tokens that the encodings of all prefixes ending there share are stable
and are emitted. Memory is that of a lookahead, whatever the length of the text.
"""

from __future__ import annotations

import base64
import codecs
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from ..session import spread

#: The pre-token pattern of the byte-level vocabularies.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: The same with white space as the vocabularies' own implementation understands it, without the information separators.
_PATTERN = PATTERN.replace(r"[^\s", r"[^\p{White_Space}").replace(r"\S", r"\P{White_Space}").replace(r"\s", r"\p{White_Space}")
#: Bytes after which stable tokens are looked for; pre-tokens and pairs of tokens remembered.
EMIT_EVERY, KNOWN_PIECES, KNOWN_PAIRS = 512, 200_000, 500_000

_loaded: dict[tuple[str, str], "Transducer"] = {}


class Transducer:
    """Encoder and decoder of one vocabulary file of ranks."""

    def __init__(self, path: str):
        import regex

        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.bytes_of = {i: b for b, i in self.ranks.items()}
        self.lookahead = max(map(len, self.ranks))
        self.pieces = regex.compile(_PATTERN)
        #: Every entry with its rank, and -1 for what only begins entries: where a lookup fails, no longer entry matches.
        self.matches = dict(self.ranks)
        for b in self.ranks:
            for k in range(1, len(b)):
                self.matches.setdefault(b[:k], -1)
        #: By last and first byte: the two parts of each entry that spans the beginning of a character of several bytes.
        self.spanning: dict[tuple[int, int], list[tuple[bytes, bytes]]] = {}
        for b in self.ranks:
            for k in range(1, len(b)):
                if b[k] >= 0xC0:
                    self.spanning.setdefault((b[k - 1], b[k]), []).append((b[:k], b[k:]))
        self._apart: dict[str, bool] = {}
        self._pairs: dict[tuple[int, int], bool] = {}
        self._known: dict[str, tuple[int, ...]] = {}

    def _merged(self, piece: bytes) -> list[bytes]:
        """The parts of a few bytes after all merges, the one of the lowest rank first."""
        parts = [piece[i : i + 1] for i in range(len(piece))]
        ranks = self.ranks
        while len(parts) > 1:
            best = min(range(len(parts) - 1), key=lambda i: ranks.get(parts[i] + parts[i + 1], 1 << 60))
            if parts[best] + parts[best + 1] not in ranks:
                break
            parts[best : best + 2] = [parts[best] + parts[best + 1]]
        return parts

    def compatible(self, a: int, b: int) -> bool:
        """Whether token b can follow token a within a pre-token."""
        known = self._pairs.get((a, b))
        if known is None:
            if len(self._pairs) > KNOWN_PAIRS:
                self._pairs.clear()
            x, y = self.bytes_of[a], self.bytes_of[b]
            known = self._merged(x + y) == [x, y]
            self._pairs[a, b] = known
        return known

    def stream(self, piece: bytes) -> Iterator[int]:
        """Tokens of one pre-token of any length, each as soon as it is stable."""
        n, done = len(piece), 0
        if n <= EMIT_EVERY:
            yield from self._short(piece)
            return
        matches = self.matches
        last: dict[int, tuple[int, int]] = {0: (-1, 0)}  # end of a prefix -> (its last token, where that starts)

        def chain(end: int) -> list[int]:
            ends = []
            while end > done:
                ends.append(end)
                end = last[end][1]
            return ends

        for start in range(n):
            if start - done > 4 * self.lookahead and start % EMIT_EVERY == 0:
                common: set[int] | None = None
                for end in range(start - self.lookahead + 1, start + 1):
                    if end in last:
                        common = set(chain(end)) if common is None else common & set(chain(end))
                if common:
                    stable = max(common)
                    for e in reversed(chain(stable)):
                        yield last[e][0]
                    last = {e: x for e, x in last.items() if e >= stable}
                    done = stable
            if start not in last:
                continue
            a = last[start][0]
            for end in range(start + 1, n + 1):
                token = matches.get(piece[start:end])
                if token is None:
                    break
                if token >= 0 and end not in last and (a < 0 or self.compatible(a, token)):
                    last[end] = (token, start)
        for e in reversed(chain(n)):
            yield last[e][0]

    def _short(self, piece: bytes) -> list[int]:
        """The same for a pre-token of which nothing is emitted before its end."""
        n = len(piece)
        token_at, start_of = [-1] * (n + 1), [-1] * (n + 1)
        matches, pairs = self.matches.get, self._pairs.get
        start_of[0] = 0
        for start in range(n):
            if start_of[start] < 0:
                continue
            a = token_at[start]
            for end in range(start + 1, n + 1):
                token = matches(piece[start:end])
                if token is None:
                    break
                if token >= 0 and start_of[end] < 0:
                    if a >= 0:
                        fits = pairs((a, token))
                        if not (self.compatible(a, token) if fits is None else fits):
                            continue
                    token_at[end], start_of[end] = token, start
        out = []
        while n:
            out.append(token_at[n])
            n = start_of[n]
        return out[::-1]

    def apart(self, pair: str) -> bool:
        """Whether no entry can span the boundary between two characters, the second one of several bytes, whatever is around them."""
        a, b = pair[0].encode(), pair[1].encode()
        if b[0] < 0xC0:
            return False
        return not any((a.endswith(x) or x.endswith(a)) and (b.startswith(y) or y.startswith(b)) for x, y in self.spanning.get((a[-1], b[0]), ()))

    def part(self, piece: str) -> Iterable[int]:
        """Tokens of a pre-token, or of a part of one that no entry spans the end of; those of short ones are remembered."""
        found = self._known.get(piece)
        if found is None:
            found = self.stream(piece.encode())
            if len(piece) <= 64:
                found = tuple(found)
                if len(self._known) >= KNOWN_PIECES:
                    self._known.clear()
                self._known[piece] = found
        return found

    def parts(self, text: str) -> Iterator[Iterable[int]]:
        """Tokens of a text, part by part: pre-tokens, cut further where no entry spans two characters.

        No merge crosses such a place, which therefore needs no lookahead.
        """
        known, apart, part = self._known.get, self._apart, self.part
        for m in self.pieces.finditer(text):
            piece = m.group()
            found = known(piece)
            if found is not None:
                yield found
                continue
            start = 0
            if not piece.isascii():
                for i in range(1, len(piece)):
                    pair = piece[i - 1 : i + 1]
                    cut = apart.get(pair)
                    if cut is None:
                        if len(apart) > KNOWN_PAIRS:
                            apart.clear()
                        cut = apart[pair] = self.apart(pair)
                    if cut:
                        found = known(piece[start:i])
                        yield part(piece[start:i]) if found is None else found
                        start = i
            yield part(piece[start:])

    def encode(self, text: str | None) -> list[int]:
        """Token ids; null and empty texts give an empty list. Special tokens' strings are ordinary text."""
        ids: list[int] = []
        for found in self.parts(text) if text else ():
            ids.extend(found)
        return ids

    def count(self, text: str | None) -> int:
        """The number of token ids."""
        return sum(len(x) if isinstance(x, tuple) else sum(1 for _ in x) for x in self.parts(text)) if text else 0

    def decode(self, ids) -> str:
        """Text of ids by an incremental UTF-8 state machine: one token's bytes at a time, incomplete characters kept as state."""
        machine = codecs.getincrementaldecoder("utf-8")("replace")
        parts = [machine.decode(self.bytes_of[i]) for i in ids]
        return "".join(parts) + machine.decode(b"", True)


def transducer(name: str, folder: str) -> Transducer:
    if (name, folder) not in _loaded:
        _loaded[name, folder] = Transducer(f"{folder}/{name}.tiktoken")
    return _loaded[name, folder]


def encode_corpus(df: DataFrame, key: str = "doc_id", text: str = "text", name: str = "byte_bpe_50k", folder: str = "/opt/tokenizers") -> DataFrame:
    """(key, ids) for every row: one Arrow pass over two columns, no shuffle beyond spreading a single small file.

    Null, empty and blank texts: ids is empty for null and empty texts; blank ones have the tokens of their white space.
    Repeated rows come out as often as they came in; other columns are dropped, whatever their names.
    """
    source = spread(df.select(key, text), key)
    schema = T.StructType([source.schema[key], T.StructField("ids", T.ArrayType(T.IntegerType(), False), False)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = transducer(name, folder)
        for batch in batches:
            for part in (batch.slice(i, 512) for i in range(0, batch.num_rows, 512)):
                rows = [t.encode(x) for x in part.column(1).to_pylist()]
                offsets = np.zeros(len(rows) + 1, np.int32)
                np.cumsum([len(r) for r in rows], out=offsets[1:])
                flat = np.fromiter((i for r in rows for i in r), np.int32, int(offsets[-1]))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))], [key, "ids"])

    return source.mapInArrow(run, schema)


def count_tokens(df: DataFrame, text: str = "text", out: str = "n_tokens", name: str = "byte_bpe_50k", folder: str = "/opt/tokenizers") -> DataFrame:
    """The rows without their text, with its number of tokens (0 for null and empty texts)."""
    kept = [c for c in df.columns if c not in (text, out)]
    source = df.select(*kept, text)
    schema = T.StructType([*(source.schema[c] for c in kept), T.StructField(out, T.LongType(), False)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = transducer(name, folder)
        for batch in batches:
            sizes = [t.count(x) for x in batch.column(len(kept)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(kept))), pa.array(sizes, pa.int64())], [*kept, out])

    return source.mapInArrow(run, schema)


def decode_corpus(df: DataFrame, key: str = "doc_id", ids: str = "ids", name: str = "byte_bpe_50k", folder: str = "/opt/tokenizers") -> DataFrame:
    """(key, text) from (key, ids); null ids give null, empty ids an empty text."""
    source = df.select(key, ids)
    schema = T.StructType([source.schema[key], T.StructField("text", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = transducer(name, folder)
        for batch in batches:
            texts = [None if x is None else t.decode(x) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], [key, "text"])

    return source.mapInArrow(run, schema)
