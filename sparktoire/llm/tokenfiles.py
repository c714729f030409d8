"""Token ids of a corpus as flat binary files that training reads through memory maps.

A dataset is a folder of shards and a manifest. A shard has two files: ``<name>.bin``, the ids of its
documents one after the other as unsigned little-endian integers (16 bits where the vocabulary allows
it, else 32), and ``<name>.idx``, the 64-bit ids of its documents followed by one more 64-bit offsets
than documents into the ``.bin`` file, in ids. Documents stand in ascending order of ``doc_id``,
within a shard and from shard to shard. The manifest ``dataset.json`` lists the shards with their
bases, the prefix sums of documents and ids of the shards before them.

Texts are encoded once and never shuffled; what is dealt to the shards are packed ids. Which shard a
document goes to follows from quantiles of ``doc_id``; an id with so many rows that it spans several
quantiles is dealt to all of them. A task writes under names of its own and the manifest names what
counts, so a task that is lost and repeated leaves a file that nobody reads, which goes at the end.

Defined results: a null or empty text has only the end id; rows without an id come first; rows of one
id stand next to each other, all of them; an empty table gives a dataset without shards; texts are
taken whole; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import json
import re
import uuid
import zlib
from bisect import bisect_right
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyarrow import fs as arrow_fs
from pyspark.sql import DataFrame, SparkSession, functions as F
from tokenizers import Tokenizer

from sparktoire.llm.bpe import content_of
from sparktoire.operators import storage

#: Documents of a shard on average, where there are many; with fewer, every core of the cluster writes shards.
SHARD_DOCUMENTS = 65_536
LEAST_DOCUMENTS = 1_024
#: Pre-tokens that a worker remembers, at most twice as many; those that the library gets at once, and characters of the
#: texts that are encoded together.
PIECES, TOGETHER, STEP_CHARACTERS = 500_000, 512, 1 << 20
#: Documents of a batch that is read back.
READ_DOCUMENTS = 4_096
MANIFEST = "dataset.json"

# How a tokenizer file describes pre-tokens that never hold white space.
WORD_NORMALIZER = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: The same pattern for lower-case text of code points up to U+00FF, with their letters, numbers and blanks written out;
#: such text is its own NFC.
_LETTER, _NUMBER, _BLANK = r"a-z\xaa\xb5\xba\xdf-\xf6\xf8-\xff", r"0-9\xb2\xb3\xb9\xbc-\xbe", r"\t-\r \x85\xa0"
NARROW_PIECES = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTER}]+|[{_NUMBER}]|[^{_BLANK}{_LETTER}{_NUMBER}]+")
#: What Python splits at and the tokenizer doesn't.
SEPARATORS = "\x1c\x1d\x1e\x1f"


# ---- encoding -----------------------------------------------------------------------------------


class Cache(dict):
    """Packed ids of strings in two generations: when the new one is full it becomes the old one."""

    def __init__(self, most: int):
        self.most, self.old = most, {}

    def missing(self, keys: set[str]) -> list[str]:
        """The keys that neither generation has; those of the old one come into the new one."""
        unknown = keys.difference(self)
        found = unknown & self.old.keys() if self.old else ()
        for k in found:
            self[k] = self.old[k]
        return list(unknown.difference(found)) if found else list(unknown)

    def turn(self) -> None:
        if len(self) >= self.most:
            self.old = dict(self)
            self.clear()


class Encoder:
    """The library's tokenizer, with the ids of pre-tokens it has seen.

    Where the file says that white space is dropped and parts pre-tokens, a text's ids are those of
    its pre-tokens, one after the other, and the library gets new ones many at a time, with a blank
    between. With any other file it gets whole texts.
    """

    def __init__(self, content: str):
        data = json.loads(content)
        self.library = Tokenizer.from_str(content)
        self.library.no_truncation()
        self.library.no_padding()
        self.dtype = dtype_of(content)
        normalizer, pre, end = data.get("normalizer") or {}, data.get("pre_tokenizer") or {}, data["model"].get("end_of_word_suffix")
        first = (pre.get("pretokenizers") or [{}])[0]
        self.special = [x["content"] for x in data["added_tokens"]]
        self.by_word = normalizer.get("normalizers") == WORD_NORMALIZER and first.get("pattern") == {"Regex": WORD_PATTERN} and first.get("invert") is True and first.get("behavior") == "Removed" and not data.get("post_processor") and bool(end) and all(x.startswith("<|") for x in self.special)
        if self.by_word:
            vocab = data["model"]["vocab"]
            self.ends = np.zeros(max(vocab.values()) + len(self.special) + 1, bool)
            self.ends[[i for s, i in vocab.items() if s.endswith(end)]] = True
        self.pieces = Cache(PIECES)

    def ids(self, text: str) -> np.ndarray:
        return np.array(self.library.encode(text, add_special_tokens=False).ids, self.dtype)

    def learn_pieces(self, pieces: list[str]) -> None:
        """A piece's last id is the only one that ends a word."""
        width = self.dtype.itemsize
        for i in range(0, len(pieces), TOGETHER):
            some = pieces[i : i + TOGETHER]
            ids = self.ids(" ".join(some))
            at = (np.flatnonzero(self.ends[ids]) + 1).tolist()
            if len(at) == len(some):
                data = ids.tobytes()
                self.pieces.update((p, data[a * width : b * width]) for p, a, b in zip(some, [0, *at], at, strict=False))
            else:
                self.pieces.update((p, self.ids(p).tobytes()) for p in some)

    def parts(self, text: str) -> list[str]:
        """Pre-tokens, and whole words where they hold other characters or a special token; no word is also a pre-token."""
        narrow = fits(text)
        if narrow and not ("<|" in text and any(x in text for x in self.special)):
            return NARROW_PIECES.findall(text.lower())
        if any(c in text for c in SEPARATORS):
            return [text]
        out = []
        for w in text.split():
            if (narrow or fits(w)) and not ("<|" in w and any(x in w for x in self.special)):
                out += NARROW_PIECES.findall(w.lower())
            else:
                out.append(w)
        return out

    def encode_all(self, texts: list[str]) -> list[bytes]:
        if not self.by_word:
            return [self.ids(t).tobytes() for t in texts]
        out, i = [], 0
        while i < len(texts):
            j, size = i, 0
            while j < len(texts) and (size == 0 or size + len(texts[j]) <= STEP_CHARACTERS):
                size, j = size + len(texts[j]), j + 1
            lists = [self.parts(t) for t in texts[i:j]]
            seen = set().union(*lists)
            new = self.pieces.missing(seen)
            self.learn_pieces([p for p in new if fits(p) and "<|" not in p])
            self.pieces.update((p, self.ids(p).tobytes()) for p in new if p not in self.pieces)
            known = self.pieces.__getitem__
            out += [b"".join(map(known, x)) for x in lists]
            for p in [p for p in new if len(p) > 64]:
                self.pieces.pop(p, None)
            self.pieces.turn()
            i = j
        return out


def fits(text: str) -> bool:
    """All code points are up to U+00FF."""
    if text.isascii():
        return True
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


@lru_cache(maxsize=2)
def encoder(content: str) -> Encoder:
    """One for all tasks of a worker."""
    return Encoder(content)


def dtype_of(content: str) -> np.dtype:
    data = json.loads(content)
    most = max([*data["model"]["vocab"].values(), *(x["id"] for x in data["added_tokens"])])
    return np.dtype("<u2" if most < 1 << 16 else "<u4")


def shard_bounds(docs: DataFrame, n: int) -> np.ndarray:
    """The quantiles of ``doc_id`` that end the shards but the last; no others are read than that column's values."""
    if n < 2:
        return np.empty(0, np.int64)
    cuts = [i / n for i in range(1, n)]
    found = docs.agg(F.percentile_approx(F.coalesce(F.col("doc_id"), F.lit(-(1 << 63))), cuts, 100 * n)).first()[0]
    return np.array(found, np.int64)


def shard_of(key: np.ndarray, salt: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """The shard of each id: those up to its bound; an id that is several bounds is dealt to their shards by ``salt``."""
    low = np.searchsorted(bounds, key, "left")
    spread = np.maximum(np.searchsorted(bounds, key, "right") - low, 1)
    return low + salt % spread


def encoded(docs: DataFrame, content: str, end_id: int, bounds: np.ndarray) -> DataFrame:
    """``shard, doc_id, crc, n, ids`` of every document; ``ids`` are packed, the end id with them."""
    sent = docs.sparkSession.sparkContext.broadcast((content, bounds))
    schema = pa.schema([("shard", pa.int32()), ("doc_id", pa.int64()), ("crc", pa.int64()), ("n", pa.int64()), ("ids", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        text_encoder, ends = encoder(sent.value[0]), sent.value[1]
        end, width = np.array([end_id], text_encoder.dtype).tobytes(), text_encoder.dtype.itemsize
        for batch in batches:
            ids = [x + end for x in text_encoder.encode_all([x or "" for x in batch.column(1).to_pylist()])]
            key = batch.column(0).fill_null(-(1 << 63)).to_numpy()
            shard = shard_of(key, batch.column(2).to_numpy(), ends)
            columns = [pa.array(shard, pa.int32()), batch.column(0), pa.array([zlib.crc32(x) for x in ids], pa.int64()), pa.array([len(x) // width for x in ids], pa.int64()), pa.array(ids, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, schema=schema)

    salt = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(1 << 31))
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text"), salt.alias("salt"))
    return rows.mapInArrow(run, "shard int, doc_id long, crc long, n long, ids binary")


# ---- files --------------------------------------------------------------------------------------


def file_system(path: str) -> tuple[arrow_fs.FileSystem, str]:
    """The file system of a path, as any worker sees it, and the path there."""
    if path.startswith("file:"):
        path = "/" + path[5:].lstrip("/")
    return arrow_fs.FileSystem.from_uri(path) if "://" in path else (arrow_fs.LocalFileSystem(), path)


class Shard:
    """A shard that is being written: ids go to the file as they come, only offsets are held."""

    def __init__(self, folder: str, number: int):
        self.fs, self.root = file_system(folder)
        self.number, self.name = number, f"shard-{number:06d}-{uuid.uuid4().hex}"
        self.out = self.fs.open_output_stream(f"{self.root}/{self.name}.bin")
        self.doc_ids: list[np.ndarray] = []
        self.counts: list[np.ndarray] = []
        self.nulls = 0

    def add(self, rows: pa.RecordBatch) -> None:
        packed = rows.column("ids")
        at = np.frombuffer(packed.buffers()[1], np.int32)[packed.offset : packed.offset + len(packed) + 1]
        self.out.write(packed.buffers()[2][int(at[0]) : int(at[-1])])
        self.doc_ids.append(rows.column("doc_id").fill_null(0).to_numpy())
        self.counts.append(rows.column("n").to_numpy())
        self.nulls += rows.column("doc_id").null_count

    def close(self) -> tuple[int, str, int, int, int]:
        self.out.close()
        counts = np.concatenate(self.counts)
        offsets = np.append(0, np.cumsum(counts)).astype("<u8")
        with self.fs.open_output_stream(f"{self.root}/{self.name}.idx") as out:
            out.write(np.concatenate(self.doc_ids).astype("<i8").tobytes())
            out.write(offsets.tobytes())
        return self.number, self.name, len(counts), int(offsets[-1]), self.nulls


def write(docs: DataFrame, tokenizer: str, folder: str, end_id: int, shard_documents: int = SHARD_DOCUMENTS) -> dict:
    """Encode every whole text with a tokenizer file and write the dataset; returns its manifest.

    The driver gets one row per shard, nothing per document.
    """
    spark, content = docs.sparkSession, content_of(tokenizer)
    rows = docs.count()
    n = max(1, min(rows // LEAST_DOCUMENTS, 2 * spark.sparkContext.defaultParallelism), -(-rows // shard_documents))
    fs, root = file_system(folder)
    fs.create_dir(root, recursive=True)
    dtype = dtype_of(content)
    schema = pa.schema([("shard", pa.int32()), ("name", pa.string()), ("n_docs", pa.int64()), ("n_tokens", pa.int64()), ("n_nulls", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_shard, done = None, []
        for batch in batches:
            shard = batch.column("shard").to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(shard)) + 1).tolist(), len(batch)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                if a == b:
                    continue
                if open_shard is None or open_shard.number != shard[a]:
                    if open_shard:
                        done.append(open_shard.close())
                    open_shard = Shard(folder, int(shard[a]))
                open_shard.add(batch.slice(a, b - a))
        if open_shard:
            done.append(open_shard.close())
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in done], f.type) for i, f in enumerate(schema)], schema=schema)

    dealt = encoded(docs, content, end_id, shard_bounds(docs, n)).repartitionById(n, F.col("shard"))
    ordered = dealt.sortWithinPartitions("shard", F.col("doc_id").asc_nulls_first(), "crc", "n")
    with storage.without_leftovers(spark):
        found = sorted(ordered.mapInArrow(run, "shard int, name string, n_docs long, n_tokens long, n_nulls long").collect())
    shards, base_doc, base_token = [], 0, 0
    for x in found:
        shards.append({"name": x["name"], "n_docs": x["n_docs"], "n_tokens": x["n_tokens"], "n_nulls": x["n_nulls"], "base_doc": base_doc, "base_token": base_token})
        base_doc, base_token = base_doc + x["n_docs"], base_token + x["n_tokens"]
    manifest = {"dtype": dtype.str, "end_id": end_id, "n_docs": base_doc, "n_tokens": base_token, "shards": shards}
    kept = {f"{x['name']}.{end}" for x in shards for end in ("bin", "idx")}
    for name in storage.names(spark, folder):
        if name.startswith("shard-") and name not in kept:
            storage.delete(spark, f"{folder}/{name}")
    storage.write_json(spark, f"{folder}/{MANIFEST}", manifest)
    return manifest


class Flat:
    """A flat file of one type: a memory map where the store is a mounted file system, else reads of ranges."""

    def __init__(self, path: str, dtype: str):
        self.dtype = np.dtype(dtype)
        store, at = file_system(path)
        self.map = self.file = None
        if isinstance(store, arrow_fs.LocalFileSystem):
            self.map = np.memmap(at, np.uint8, "r")
        else:
            self.file = store.open_input_file(at)

    def read(self, start: int, n: int, skip: int = 0) -> np.ndarray:
        """``n`` numbers from number ``start`` on, after ``skip`` bytes."""
        a = skip + start * self.dtype.itemsize
        size = n * self.dtype.itemsize
        return self.map[a : a + size].view(self.dtype) if self.map is not None else np.frombuffer(self.file.read_at(size, a), self.dtype)


def documents(spark: SparkSession, folder: str, ids: bool = False) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of every document of a dataset, and its ``ids`` if asked for.

    Each task maps one shard and walks it in blocks of documents.
    """
    manifest = storage.read_json(spark, f"{folder}/{MANIFEST}")
    dtype = manifest["dtype"]
    fields = [("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())] + ([("ids", pa.list_(pa.int64()))] if ids else [])
    schema = pa.schema(fields)

    def of_shard(name: str, n_docs: int, n_nulls: int, base: int) -> Iterator[pa.RecordBatch]:
        tokens = Flat(f"{folder}/{name}.bin", dtype)
        doc_ids, offsets = Flat(f"{folder}/{name}.idx", "<i8"), Flat(f"{folder}/{name}.idx", "<u8")
        for a in range(0, n_docs, READ_DOCUMENTS):
            n = min(READ_DOCUMENTS, n_docs - a)
            at = offsets.read(a, n + 1, 8 * n_docs).astype(np.int64)
            parts = [tokens.read(int(s), int(e - s)).astype("<u4") for s, e in zip(at, at[1:], strict=False)]
            columns = [pa.array(doc_ids.read(a, n), pa.int64(), mask=np.arange(a, a + n) < n_nulls), pa.array(base + at[:-1], pa.int64()), pa.array(np.diff(at), pa.int64()), pa.array([zlib.crc32(x.tobytes()) for x in parts], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns + ([pa.array([x.astype(np.int64) for x in parts], pa.list_(pa.int64()))] if ids else []), schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                yield from of_shard(row["name"], row["n_docs"], row["n_nulls"], row["base_token"])

    shards = manifest["shards"]
    rows = spark.createDataFrame([(x["name"], x["n_docs"], x["n_nulls"], x["base_token"]) for x in shards], "name string, n_docs long, n_nulls long, base_token long")
    return rows.repartition(max(1, len(shards))).mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long" + (", ids array<long>" if ids else ""))


class Dataset:
    """Random access to a dataset's ids by their place in the whole corpus, as a training loop reads it."""

    def __init__(self, spark: SparkSession, folder: str):
        self.folder, self.manifest = folder, storage.read_json(spark, f"{folder}/{MANIFEST}")
        self.bases = [x["base_token"] for x in self.manifest["shards"]]
        self.maps: dict[int, Flat] = {}

    def __len__(self) -> int:
        return self.manifest["n_tokens"]

    def window(self, start: int, n: int) -> np.ndarray:
        """``n`` ids from ``start`` on, across shards; fewer at the end of the corpus."""
        parts, end = [], min(start + n, len(self))
        while start < end:
            i = bisect_right(self.bases, start) - 1
            shard = self.manifest["shards"][i]
            if i not in self.maps:
                self.maps[i] = Flat(f"{self.folder}/{shard['name']}.bin", self.manifest["dtype"])
            take = min(end, shard["base_token"] + shard["n_tokens"]) - start
            parts.append(self.maps[i].read(start - shard["base_token"], take))
            start += take
        return np.concatenate(parts) if parts else np.empty(0, self.manifest["dtype"])
