"""The pipeline against its operators' brute-force forms, stage by stage."""

import hashlib
import zlib

import corpus_pipeline
import numpy as np
import pytest
from stemma.llm import common, decontaminate, jaccard_join, quality, token_store
from tests.llm.test_operators import classes_of, edited, prose, shingles


@pytest.fixture(scope="module")
def folder(make, spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("sf"))
    items = [(i, prose(30, 8000 + i)) for i in range(5)]
    rows = [(i, prose(80, i) + "\n" + prose(30, 700 + i), f"s{i % 4}") for i in range(60)]
    rows += [(100 + i, edited(rows[i][1], 1, i), "s9") for i in range(10)] + [(200 + i, rows[i][1], "s9") for i in range(5)]
    rows += [(300 + i, prose(60, 900 + i) + " " + items[i][1], "s1") for i in range(5)] + [(400, "too short", "s1"), (401, None, None)]
    make(rows).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    return d, rows, items


def test_stages_take_effect(spark, folder):
    d, rows, items = folder
    docs, seen = common.table(spark, d, "documents"), []
    for name, stage in corpus_pipeline.STAGES:
        path = common.new_folder(spark, "test")
        stage(spark, docs, d).write.parquet(path)
        docs = spark.read.parquet(path)
        seen.append(docs)
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    kept = {i: t for i, t, _ in rows if t and len(t.split()) >= quality.MIN_WORDS}
    assert {r.doc_id for r in seen[0].collect()} == set(kept)
    s = {i: shingles(t, 3) for i, t in kept.items()}
    links = [(a, b) for a in s for b in s if a < b and 100 * len(s[a] & s[b]) >= jaccard_join.PERCENT * len(s[a] | s[b])]
    want = {i for i, c in classes_of(s, links).items() if i == c}
    assert {r.doc_id for r in seen[1].collect()} == want and len(want) < len(kept)
    clean = {i for i in want if all(100 * decontaminate.best_edit_distance(x, b" ".join(common.words(kept[i], True)).decode())[0] > 20 * len(x) for _, x in items)}
    assert {r.doc_id for r in seen[2].collect()} == clean and len(clean) == len(want) - 5
    mixed = [r.doc_id for r in seen[3].collect()]
    assert set(mixed) <= clean and len(mixed) > len(clean)
    from tokenizers import Tokenizer

    t, start = Tokenizer.from_file(token_store.default_tokenizer()), 0
    got = sorted(seen[4].collect(), key=lambda r: r.start)
    assert [r.doc_id for r in got] == sorted(mixed)
    for r in got:
        ids = np.array([*t.encode(kept[r.doc_id], add_special_tokens=False).ids, 0], "<u4")
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)


def test_run_repeats_itself(spark, folder):
    digest = lambda: hashlib.sha256(repr(sorted(map(tuple, corpus_pipeline.run(spark, folder[0]).collect()))).encode()).hexdigest()
    assert digest() == digest()


def test_near_copies_between_the_limits_go(spark, make, tmp_path):
    base, rows = [prose(120, 30 + i) for i in range(8)], []
    for i, t in enumerate(base):
        w = t.split(" ")
        w[40:45] = [f"other{j}x{i}" for j in range(5)]
        rows += [(i, t, "s"), (100 + i, " ".join(w), "s")]
        s3, s5 = ((len(shingles(t, k) & shingles(rows[-1][1], k)), len(shingles(t, k) | shingles(rows[-1][1], k))) for k in (3, 5))
        assert 100 * s3[0] < 90 * s3[1] and 100 * s5[0] >= 80 * s5[1]
    assert {r.doc_id for r in corpus_pipeline.near_copies(spark, make(rows), str(tmp_path)).collect()} == set(range(8))
