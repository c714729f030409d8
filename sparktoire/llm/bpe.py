"""Byte-level BPE: a priority queue of merge ranks over a doubly linked list of symbols.

A text is split at special tokens and then by the byte-level pattern; the symbols of a pre-token
stand in a linked list, and a heap holds the rank of every mergeable neighbour pair. An entry whose
pair has changed since it was pushed is stale and skipped. Results are kept per worker in a cache
of two generations, so its size is bounded. Decoding concatenates the vocabulary strings.

Defined results: a null text counts as empty (no ids, the digest of an empty string); the text of a
special token is that token, as in the tokenizers library; repeated rows are encoded one by one; an
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from functools import lru_cache
from hashlib import sha256
from heapq import heapify, heappop, heappush

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

CACHE_ENTRIES = 500_000
EMPTY = sha256(b"").hexdigest()
SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
AFTER, BEFORE = list(range(1, 65)), list(range(-1, 63))
_SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
PATTERN = regex.compile(rf"'(?:[sdmt]|ll|ve|re)| ?\p{{L}}+| ?\p{{N}}+| ?[^{_SPACE}\p{{L}}\p{{N}}]+|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+")
#: The same pattern for texts of code points up to U+00FF, with their letters, numbers and spaces written out.
_LETTER, _NUMBER, _BLANK = r"A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\xff", r"0-9\xb2\xb3\xb9\xbc-\xbe", r"\t-\r \x85\xa0"
NARROW = re.compile(rf"'(?:[sdmt]|ll|ve|re)| ?[{_LETTER}]+| ?[{_NUMBER}]+| ?[^{_BLANK}{_LETTER}{_NUMBER}]+|[{_BLANK}]+(?![^{_BLANK}])|[{_BLANK}]+")


def pretokens(text: str) -> list[str]:
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return PATTERN.findall(text)
    return NARROW.findall(text)


def byte_characters() -> dict[int, str]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    others = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(others)}


class Bpe:
    """A tokenizer file's vocabulary and merges; ``encode`` and ``decode`` are each other's inverse."""

    def __init__(self, content: str):
        data = json.loads(content)
        vocab, characters = data["model"]["vocab"], byte_characters()
        byte_of = {c: b for b, c in characters.items()}
        self.special = {x["content"]: x["id"] for x in data["added_tokens"]}
        self.text = {str(i): bytes(byte_of[c] for c in s) for s, i in vocab.items() if s not in self.special}
        self.text |= {str(i): s.encode() for s, i in self.special.items()}
        self.first = [vocab.get(characters[b], -1) for b in range(256)]
        pairs = (m if isinstance(m, list) else m.split(" ") for m in data["model"]["merges"])
        self.rank: dict[int, int] = {}
        self.made: list[int] = []
        for rank, (a, b) in enumerate(pairs):
            self.rank[vocab[a] << 20 | vocab[b]] = rank
            self.made.append(vocab[a + b])
        self.cut = regex.compile("|".join(map(regex.escape, self.special))) if self.special else None
        self.pair = [self.rank.get(a << 20 | b, -1) for a in self.first for b in self.first]
        self.new: dict[str, str] = {}
        self.old: dict[str, str] = {}

    def merge(self, data: bytes) -> list[int]:
        """The ids of one pre-token.

        A heap entry holds the rank above the position; it is stale if the pair that now starts at its
        position has another rank, or none.
        """
        ids = [self.first[b] for b in data]
        n, pair = len(ids), self.pair
        shift = 10 if n <= 1024 else 40
        low = (1 << shift) - 1
        now = [pair[a << 8 | b] for a, b in zip(data, data[1:], strict=False)]
        heap = [r << shift | i for i, r in enumerate(now) if r >= 0]
        if not heap:
            return ids
        heapify(heap)
        rank_of, made_of = self.rank.get, self.made
        after, before = (AFTER[:n], BEFORE[:n]) if n <= 64 else (list(range(1, n + 1)), list(range(-1, n - 1)))
        now.append(-1)
        while heap:
            entry = heappop(heap)
            i, rank = entry & low, entry >> shift
            if now[i] != rank:
                continue
            j = after[i]
            ids[i] = made = made_of[rank]
            ids[j] = now[j] = -1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                now[i] = r = rank_of(made << 20 | ids[k], -1)
                if r >= 0:
                    heappush(heap, r << shift | i)
            else:
                now[i] = -1
            h = before[i]
            if h >= 0:
                now[h] = r = rank_of(ids[h] << 20 | made, -1)
                if r >= 0:
                    heappush(heap, r << shift | h)
        return [x for x in ids if x >= 0]

    def miss(self, piece: str) -> str:
        """The ids of a pre-token or special token, joined by commas; remembered."""
        found = self.old.get(piece) or (str(self.special[piece]) if piece in self.special else ",".join(map(str, self.merge(piece.encode()))))
        if len(piece) <= 64 and len(self.new) < CACHE_ENTRIES:
            self.new[piece] = found
        return found

    def split(self, text: str) -> list[str]:
        """The pre-tokens and special tokens of the text, in order. No pre-token has the text of a special one."""
        if not any(s in text for s in self.special):
            return pretokens(text)
        out, at = [], 0
        for m in self.cut.finditer(text):
            out += [*pretokens(text[at : m.start()]), m[0]]
            at = m.end()
        return out + pretokens(text[at:])

    def ids(self, pieces: list[str]) -> list[str]:
        """The ids of each pre-token or special token, joined by commas."""
        if len(self.new) >= CACHE_ENTRIES:
            self.old, self.new = self.new, {}
        known = self.new.get
        return [known(x) or self.miss(x) for x in pieces]

    def parts(self, text: str) -> list[str]:
        return self.ids(self.split(text))

    def encode(self, text: str) -> list[int]:
        return [int(i) for ids in self.parts(text) for i in ids.split(",")]

    def decode(self, ids: list[int]) -> str:
        """Unknown ids raise ``KeyError``; bytes that are no UTF-8 become U+FFFD."""
        return b"".join(self.text[str(i)] for i in ids).decode(errors="replace")

    def digests(self, text: str) -> tuple[int, str, str]:
        """Number of ids, digest of the ids and of the text decoded from them."""
        if not text:
            return 0, EMPTY, EMPTY
        ids = ",".join(self.parts(text))
        each = ids.split(",")
        decoded = b"".join(map(self.text.__getitem__, each)).decode(errors="replace")
        return len(each), sha256(ids.encode()).hexdigest(), sha256(decoded.encode()).hexdigest()


@lru_cache(maxsize=2)
def tokenizer(content: str) -> Bpe:
    """One for all tasks of a worker."""
    return Bpe(content)


def content_of(path: str) -> str:
    with open(path, encoding="utf-8") as file:
        return file.read()


def encode_decode(docs: DataFrame, path: str) -> DataFrame:
    """Encode and decode every whole text; ``path``: a tokenizer file, which the driver reads and sends to the workers."""
    content = docs.sparkSession.sparkContext.broadcast(content_of(path))
    schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = tokenizer(content.value)
        for batch in batches:
            rows = [bpe.digests(x.as_py() or "") for x in batch.column(1)]
            n, ids, back = map(list, zip(*rows, strict=True)) if rows else ([], [], [])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(back, pa.string())], schema=schema)

    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text")).mapInArrow(run, SCHEMA)
