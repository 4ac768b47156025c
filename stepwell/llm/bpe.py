"""Byte-pair encoding and decoding.

Encoder: a text is cut into pieces by the tokenizer's pattern; each different piece is encoded once per worker by
backtracking. An Aho-Corasick automaton gives every vocabulary entry that ends at each byte, hence the longest one
that starts at each byte. The encoder walks through the piece taking the longest entry that is compatible with its
left neighbour; where none is, it steps back and shortens that neighbour. Two entries are compatible if merging the
bytes of both, side by side, by rank would leave exactly the two; a sequence all of whose neighbours are compatible is
the very sequence that rank-by-rank merging makes. Every position is given up at most once, so time is linear.

Decoder: the bytes of all entries stand in one blob with an offset table; the bytes of a sequence of ids are one gather.

Defined results: null and empty texts have no ids and decode to the empty text. A special entry's text inside a
document gives its id, unless ``specials_as_text``. Very long texts are encoded in slices cut where a piece must begin.
"""

from __future__ import annotations

import hashlib
import json
import re
import struct
from collections.abc import Iterator
from itertools import chain

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stepwell.llm.common import text_bytes

#: White space as the tokenizers library's pattern has it, and the byte-level pattern.
SPACE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
PIECES = rf"'(?:[stmd]|re|ve|ll)| ?\p{{L}}+| ?\p{{N}}+| ?[^{SPACE}\p{{L}}\p{{N}}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+"
ASCII_PIECES = r"'(?:[stmd]|re|ve|ll)| ?[A-Za-z]+| ?[0-9]+| ?[^\t-\r A-Za-z0-9]+|[\t-\r ]+(?![^\t-\r ])|[\t-\r ]+"
#: A slice of a long text ends before a blank between two ASCII letters: a piece always begins at such a blank.
SLICE = 1 << 20
JOINT = regex.compile(r"(?<=[A-Za-z])(?= [A-Za-z])")
#: Pieces remembered by a worker in each of two generations (some 200 bytes each), fewer where the library encodes the
#: others, and the longest piece remembered.
REMEMBERED, REMEMBERED_BY_LIBRARY, REMEMBERED_LETTERS = 200_000, 50_000, 64


def byte_letters() -> list[str]:
    """The letter that byte-level vocabularies write for each byte: itself if it prints, else one from U+0100 on."""
    prints = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = iter(range(0x100, 0x200))
    return [chr(b) if b in prints else chr(next(others)) for b in range(256)]


def read_vocabulary(path: str) -> bytes:
    """The tokenizer file, read by the driver; a few MB at most, as vocabularies are of fixed size."""
    with open(path, "rb") as f:
        return f.read()


def vocabulary_size(vocabulary: bytes) -> int:
    """One more than the largest id."""
    spec = json.loads(vocabulary)
    return max([*spec["model"]["vocab"].values(), *(t["id"] for t in spec.get("added_tokens", []))]) + 1


class Codec:
    """Encoder and decoder of one byte-level BPE vocabulary, given as the JSON of the tokenizers library."""

    def __init__(self, vocabulary: bytes, specials_as_text: bool = False, library: bool = False):
        """library: encode pieces not yet seen by the tiktoken library (the same merges) instead of by backtracking."""
        spec = json.loads(vocabulary)
        letters = {c: b for b, c in enumerate(byte_letters())}
        ids = spec["model"]["vocab"]
        specials = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        size = max([*ids.values(), *specials.values()]) + 1
        self.entries: list[bytes] = [b""] * size
        for text, i in ids.items():
            self.entries[i] = bytes(letters[c] for c in text)
        for text, i in specials.items():
            self.entries[i] = text.encode()
        self.dtype = np.dtype("<u4")
        self.specials = {} if specials_as_text else specials
        self.special_pattern = regex.compile("|".join(map(regex.escape, sorted(self.specials, key=len, reverse=True)))) if self.specials else None

        self.of: dict[bytes, int] = {bytes(letters[c] for c in t): i for t, i in ids.items()}
        self.library = tiktoken.Encoding("pieces", pat_str=r"[^\n]+|\n", mergeable_ranks=self.of, special_tokens={}) if library else None
        if not library:
            self._backtracking(spec["model"]["merges"], ids)
        self.shorter: dict[int, int] = {}
        self.fits: dict[tuple[int, int], bool] = {}
        self.younger: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

        self.sizes = list(map(len, self.entries))
        self.offsets = np.zeros(size + 1, np.int64)
        np.cumsum(self.sizes, out=self.offsets[1:])
        self.blob = np.frombuffer(b"".join(self.entries), np.uint8)
        self.find_ascii, self.find = re.compile(ASCII_PIECES, re.ASCII).findall, regex.compile(PIECES).findall

    def _backtracking(self, merges: list, ids: dict[str, int]) -> None:
        """rank[i]: when entry i is made (bytes: before all merges); halves[i]: what it is made of; the automaton."""
        self.rank = [-1] * len(self.entries)
        self.halves: list[tuple[int, int]] = [(i, i) for i in range(len(self.entries))]
        self.merged: dict[tuple[int, int], int] = {}
        for r, m in enumerate(merges):
            left, right = (ids[x] for x in (m if isinstance(m, list) else m.split(" ")))
            whole = self.of[self.entries[left] + self.entries[right]]
            self.merged[left, right] = r
            if self.rank[whole] < 0:
                self.rank[whole], self.halves[whole] = r, (left, right)
        self.automaton = ahocorasick.Automaton()
        for entry, i in self.of.items():
            self.automaton.add_word(entry.decode("latin-1"), (len(entry), i))
        self.automaton.make_automaton()

    # ------------------------------------------------------------------ encoding

    def _compatible(self, a: int, b: int) -> bool:
        """Whether merging by rank never joins bytes across the border of a and b (the pair table, filled on demand)."""
        key = (a, b)
        known = self.fits.get(key)
        if known is None:
            if len(self.fits) > 500_000:
                self.fits.clear()
            known = self.fits[key] = self._border_stays(a, b)
        return known

    def _border_stays(self, a: int, b: int) -> bool:
        """Undo the merges of both sides latest first; at each moment the two entries that touch the border may not be
        ones that would be merged before the next step that made one of them."""
        rank, halves, merged = self.rank, self.halves, self.merged
        undone = len(merged)  # the step that made the entry last taken apart; at first, after all steps
        undone_left = False
        while True:
            joint = merged.get((a, b))
            # Equal steps: one merge is applied from left to right, so the occurrence further left comes first.
            if joint is not None and (joint < undone or joint == undone and not undone_left):
                return False
            if rank[a] < 0 and rank[b] < 0:
                return True
            if rank[a] > rank[b]:
                undone, undone_left, a = rank[a], True, halves[a][1]
            else:
                undone, undone_left, b = rank[b], False, halves[b][0]

    def _cut_back(self, i: int) -> int:
        """The longest vocabulary entry that is a proper prefix of entry i, or -1."""
        got = self.shorter.get(i)
        if got is None:
            entry, got = self.entries[i], -1
            for n in range(len(entry) - 1, 0, -1):
                if (got := self.of.get(entry[:n], -1)) >= 0:
                    break
            self.shorter[i] = got
        return got

    def encode_piece(self, piece: bytes) -> list[int]:
        n = len(piece)
        longest = [-1] * n
        reach = [0] * n
        for end, (size, i) in self.automaton.iter(piece.decode("latin-1")):
            start = end - size + 1
            if size > reach[start]:
                reach[start], longest[start] = size, i
        fits, sizes = self.fits, self.sizes
        dead: set[int] = set()  # places from which the rest can't be encoded after what stands before them
        out: list[int] = []
        at, before = 0, -1
        token = longest[0] if n else -1
        while at < n:
            end = at + sizes[token]
            if end not in dead and (before < 0 or (fits.get((before, token)) or self._compatible(before, token))):
                out.append(token)
                at, before = end, token
                if at < n:
                    token = longest[at]
                continue
            shorter = self._cut_back(token)
            if shorter >= 0:
                token = shorter
            else:
                dead.add(at)
                token = out.pop()
                at -= sizes[token]
                before = out[-1] if out else -1
        return out

    def _piece(self, piece: str) -> bytes:
        """The ids of a piece as bytes. Pieces are remembered in two generations: the older one goes when the younger is full."""
        ids = self.older.get(piece)
        if ids is None:
            data = piece.encode("utf-8", "surrogatepass")
            found = self.library._encode_single_piece(data) if self.library else self.encode_piece(data)
            ids = struct.pack(f"<{len(found)}I", *found)
        if len(piece) <= REMEMBERED_LETTERS:
            if len(self.younger) >= (REMEMBERED_BY_LIBRARY if self.library else REMEMBERED):
                self.older = dict(self.younger)
                self.younger.clear()
            self.younger[piece] = ids
        return ids

    def _plain(self, text: str) -> Iterator[bytes]:
        at, get, other = 0, self.younger.get, self._piece
        while at < len(text):
            end = len(text)
            if end - at > 2 * SLICE and (joint := JOINT.search(text, at + SLICE)):
                end = joint.start()
            part = text[at:end]
            yield b"".join([get(p) or other(p) for p in (self.find_ascii if part.isascii() else self.find)(part)])
            at = end

    def encode(self, text: str) -> np.ndarray:
        """The ids of a text."""
        parts: list[bytes] = []
        at = 0
        for m in self.special_pattern.finditer(text) if self.special_pattern else ():
            parts += [*self._plain(text[at : m.start()]), np.array([self.specials[m[0]]], self.dtype).tobytes()]
            at = m.end()
        parts += self._plain(text[at:] if at else text)
        return np.frombuffer(b"".join(parts), self.dtype)

    # ------------------------------------------------------------------ decoding

    def decode(self, ids: np.ndarray) -> bytes:
        """The UTF-8 bytes of a sequence of ids; broken characters become U+FFFD."""
        out = []
        for k in range(0, len(ids), SLICE):
            part = ids[k : k + SLICE].astype(np.int64)
            starts = self.offsets[part]
            sizes = self.offsets[part + 1] - starts
            ends = np.cumsum(sizes)
            where = np.repeat(starts - (ends - sizes), sizes)
            where += np.arange(len(where))
            out.append(self.blob[where].tobytes())
        data = b"".join(out)
        try:
            data.decode()
        except UnicodeDecodeError:
            return data.decode("utf-8", "replace").encode()
        return data


_CODECS: dict[tuple, Codec] = {}


def codec_of(vocabulary: bytes, specials_as_text: bool = False, library: bool = False) -> Codec:
    """One codec a worker process, kept between tasks."""
    key = (hashlib.md5(vocabulary).hexdigest(), specials_as_text, library)
    if key not in _CODECS:
        _CODECS[key] = Codec(vocabulary, specials_as_text, library)
    return _CODECS[key]


def texts_of(column: pa.Array) -> Iterator[str]:
    """Texts one by one from a column of UTF-8 bytes, so that a batch is never held as Python objects."""
    for x in column:
        yield x.as_py().decode("utf-8", "replace")


def encode_documents(docs: DataFrame, vocabulary: str, id_column: str = "doc_id", text_column: str = "text", decoded: bool = True) -> DataFrame:
    """doc_id, ids (little-endian unsigned 32-bit integers) and, if asked for, the decoded text of each row of docs."""
    shipped = docs.sparkSession.sparkContext.broadcast(read_vocabulary(vocabulary))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = codec_of(shipped.value)
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                part = batch.slice(k, 256)
                ids = [codec.encode(t) for t in texts_of(part.column("text"))]
                cols = {"doc_id": part.column("doc_id"), "ids": pa.array([x.tobytes() for x in ids], pa.binary())}
                if decoded:
                    cols["decoded"] = pa.array([codec.decode(x) for x in ids], pa.binary())
                yield pa.RecordBatch.from_pydict(cols)

    rows = docs.select(F.col(id_column).alias("doc_id"), text_bytes(text_column))
    return rows.mapInArrow(run, f"doc_id {docs.schema[id_column].dataType.simpleString()}, ids binary" + ", decoded binary" * decoded)


def digests(encoded: DataFrame) -> DataFrame:
    """doc_id, n_tokens and the SHA-256 of ids and decoded text."""
    return encoded.select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
