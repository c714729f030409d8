"""Written and read back, against the library's ids of whole texts."""

import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from sparktoire.llm import tokenfiles
from sparktoire.llm.queries import tokenizer_path
from sparktoire.operators import storage

PATH = tokenizer_path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def want(library, rows, end=2):
    """``(doc_id, start, n, crc)`` in order; rows of one id by their checksum."""
    made = [(i, [*library.encode(t or "", add_special_tokens=False).ids, end]) for i, t in rows]
    made = [(i, len(x), zlib.crc32(np.array(x, "<u4").tobytes())) for i, x in made]
    out, at = [], 0
    for i, n, crc in sorted(made, key=lambda r: (r[0] is not None, r[0] or 0, r[2], r[1])):
        out.append((i, at, n, crc))
        at += n
    return out


def got(df):
    return sorted(((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in df.collect()), key=lambda r: r[1])


ODD = ["", None, " ", "Plain words, it's 1234 o'clock!", "don't 'll 'RE 's", "tab\tand\x0bline\x0cfeed\r\n", "a\x1cb c\x1d d", "no\x85break\xa0space wide　x", "<|endoftext|>", "x<|startoftext|>y <|endoftext|>z <| endoftext |>", "Ünïcödé ÉÉ İ İ ΣΑΣ ΟΔΟΣ é ̈x ẞ", "日本語 テキスト 한국어 ١٢٣ Ⅷ ½", "🙂🙃 👩‍👩‍👧", "\x00\x01 \x7f", "'" * 50 + " ''s", "A" * 3000, "1" * 500 + "." * 500, "ﬁ Å Ω Å"]


def test_equals_the_library(spark, documents, library, prose, tmp_path):
    rows = [(10 * i - 40, t) for i, t in enumerate(ODD)] + [(1000 + i, prose(i, 30 * i)) for i in range(40)]
    docs = documents(rows).withColumns({"shard": F.lit("x"), "salt": F.lit(1), "ids": F.lit(2), "start": F.lit(3)})
    manifest = tokenfiles.write(docs.repartition(3), PATH, str(tmp_path / "a"), 2, shard_documents=9)
    assert len(manifest["shards"]) > 3 and manifest["dtype"] == "<u2"
    read = tokenfiles.documents(spark, str(tmp_path / "a"), ids=True)
    assert got(read) == want(library, rows)
    texts = dict(rows)
    assert all(r.ids == [*library.encode(texts[r.doc_id] or "", add_special_tokens=False).ids, 2] for r in read.collect())


def test_windows_cross_shards(spark, documents, library, prose, tmp_path):
    rows = [(i, prose(i, 25)) for i in range(60)]
    folder = str(tmp_path / "b")
    tokenfiles.write(documents(rows), PATH, f"file://{folder}", 2, shard_documents=7)
    data = tokenfiles.Dataset(spark, folder)
    flat = np.array([x for _, t in rows for x in (*library.encode(t, add_special_tokens=False).ids, 2)])
    assert len(data) == len(flat) and (data.window(0, len(flat) + 5) == flat).all()
    assert all((data.window(a, 700) == flat[a : a + 700]).all() for a in range(0, len(flat), 331)) and len(data.window(len(flat), 3)) == 0


def test_null_repeated_and_extreme_ids(spark, documents, library, prose, tmp_path):
    texts = [prose(i, 12) for i in range(6)]
    rows = [(7, texts[i % 3]) for i in range(400)] + [(None, texts[3]), (None, None)] + [((1 << 63) - 1, texts[4]), (-(1 << 63), texts[5]), (1 << 62, "")] + [(i, f"x{i}") for i in range(100)]
    manifest = tokenfiles.write(documents(rows).repartition(4), PATH, str(tmp_path / "c"), 2, shard_documents=40)
    assert max(x["n_docs"] for x in manifest["shards"]) < 100  # the one id of most rows is spread
    x = got(tokenfiles.documents(spark, str(tmp_path / "c")))
    plain = want(library, rows)
    assert sorted((repr(r[0]), *r[2:]) for r in x) == sorted((repr(r[0]), *r[2:]) for r in plain)
    assert [r[0] for r in x] == [r[0] for r in plain]
    assert all(a[1] + a[2] == b[1] for a, b in zip(x, x[1:], strict=False))


def test_empty_table_and_a_very_long_text(spark, documents, library, prose, tmp_path):
    assert tokenfiles.write(documents([]), PATH, str(tmp_path / "d"), 2)["shards"] == []
    assert tokenfiles.documents(spark, str(tmp_path / "d")).count() == 0 and len(tokenfiles.Dataset(spark, str(tmp_path / "d")).window(0, 5)) == 0
    long = " ".join([prose(1, 2000)] * 100)
    tokenfiles.write(documents([(1, long), (2, "x")]), PATH, str(tmp_path / "e"), 2)
    assert got(tokenfiles.documents(spark, str(tmp_path / "e"))) == want(library, [(1, long), (2, "x")])


def test_files_of_lost_attempts_go_and_other_tokenizers_work(spark, documents, prose, tmp_path):
    folder, rows = str(tmp_path / "f"), [(i, prose(i, 20)) for i in range(20)]
    storage.write_text(spark, f"{folder}/shard-000000-lost.bin", "xx")
    path = tokenizer_path("byte_bpe_50k.json")
    tokenfiles.write(documents(rows), path, folder, 50256)
    assert "shard-000000-lost.bin" not in storage.names(spark, folder)
    assert got(tokenfiles.documents(spark, folder)) == want(Tokenizer.from_file(path), rows, 50256)
