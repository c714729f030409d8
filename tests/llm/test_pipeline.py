import random
from hashlib import sha256

import corpus_pipeline
import public_tokenizers
import test_decontaminate
import test_near_dedup
import test_quality
from tokenizers import Tokenizer


def cut(rows, length=50):
    """What is left of each text without the strings of smaller ids."""
    least = {}
    for i, t in rows:
        b = t.encode()
        for k in range(len(b) - length + 1):
            least[b[k : k + length]] = min(least.get(b[k : k + length], i), i)
    out = []
    for i, t in rows:
        b = t.encode()
        gone = [False] * len(b)
        for k in range(len(b) - length + 1):
            if least[b[k : k + length]] < i:
                gone[k : k + length] = [True] * length
        out.append((i, bytes(x for x, g in zip(b, gone) if not g).decode(errors="ignore")))
    return out


def brute(rows, items):
    rows = [(i, t) for i, t in rows if test_quality.brute(t)[-1]]
    classes = dict(test_near_dedup.brute(rows))
    rows = cut([(i, t) for i, t in rows if classes[i] == i])
    leaks = {i for i, *_ in test_decontaminate.brute(rows, items)}
    reference, out = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), []
    for i, t in rows:
        if i not in leaks:
            ids = reference.encode(t, add_special_tokens=False).ids
            out.append((i, len(ids), sha256(",".join(map(str, ids)).encode()).hexdigest(), sha256(reference.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    return sorted(out)


def test_pipeline_matches_brute_force(spark, documents, prose, tmp_path):
    r = random.Random(12)
    items = [(i, prose(900 + i, 25)) for i in range(6)]
    passage = prose(77, 40)
    rows = [(i, prose(i, r.randint(0, 90))) for i in range(50)]
    rows += [(100 + i, test_near_dedup.edited(r, rows[20 + i % 9][1], 1)) for i in range(20)]
    rows += [(200 + i, f"{prose(300 + i, 40)} {passage} {prose(400 + i, 40)}") for i in range(6)]
    rows += [(210 + i, f"{prose(500 + i, 40)} {items[i][1]} {prose(600 + i, 40)}") for i in range(6)]
    rows += [(220, "same line here\n" * 40), (221, None), (222, ""), (223, rows[3][1])]
    documents(rows).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    got = sorted(tuple(x) for x in corpus_pipeline.run(spark, str(tmp_path)).collect())
    assert got == brute(rows, items) and 40 < len(got) < len(rows) - 20


def test_large_near_duplicate_group_leaves_one_document(spark, documents, prose, tmp_path):
    r = random.Random(4)
    origin = prose(2000, 260).replace("\n", "")
    rows = [(i, t) for i, t in enumerate([*test_near_dedup.star(r, origin, 60, 4), origin])] + [(100 + i, prose(i, 60)) for i in range(20)]
    assert {c for i, c in test_near_dedup.brute(rows) if i < 100} == {0}
    kept = corpus_pipeline.minhash_near_dedup(spark, documents(rows), str(tmp_path))
    assert sorted(x.doc_id for x in kept.collect()) == [0, *range(100, 120)]


def test_stages_keep_columns_and_take_odd_rows(spark, documents, prose, tmp_path):
    spark.createDataFrame([(None, None)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    rows = [(1, prose(1, 40)), (1, prose(1, 40)), (None, prose(2, 40)), (3, None)]
    docs = documents(rows).selectExpr("*", "1 AS bucket", "'x' AS owner")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        for x in (docs, docs.limit(0)):
            out = stage(spark, x, str(tmp_path))
            assert out.columns == docs.columns and out.dtypes == docs.dtypes, name
            assert out.count() <= 4
    kept = corpus_pipeline.minhash_near_dedup(spark, docs, str(tmp_path))
    assert sorted((r.doc_id for r in kept.collect()), key=repr) == [1, 3, None]
