"""The pipeline's stages on small tables, each against its own brute force."""

from __future__ import annotations

import random
import zlib

import pytest

pytest.importorskip("tracefold.llm")

import corpus_pipeline  # noqa: E402
from tests.llm.test_operators import ascii_words, brute_components, brute_quality, vocabulary  # noqa: E402
from tracefold.llm import packing, quality, toxicity  # noqa: E402
from tracefold.session import ship  # noqa: E402


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    ship(spark)
    rng, vocab, root = random.Random(11), vocabulary(), str(tmp_path_factory.mktemp("sf"))
    items = [(k, " ".join(rng.choice(vocab) for _ in range(30))) for k in range(5)]
    docs, labels = [], []
    for i in range(260):
        w = [rng.choice(vocab) for _ in range(rng.randint(60, 120))]
        if i % 10 == 0:
            w[5:5] = ["zorgul", "qwibble"]
        if i % 13 == 0:
            w[20:20] = items[i % 5][1].split()
        text = (" | " if i % 9 == 0 else " ").join(w)
        docs.append((i, text, "en", "src0", len(text)))
        labels.append((i, int(i % 9 != 0), int(i % 10 == 0)))
        if i % 17 == 1:
            docs.append((1000 + i, text.capitalize(), "en", "src1", len(text)))
        if i % 19 == 2:
            docs.append((2000 + i, " ".join([*w[:-1], "other"]), "en", "src1", len(text)))
    docs += [(3000, None, "en", None, None), (3001, "", None, "x", 0), docs[4], (None, docs[7][1] + " with some more words at its end", "en", "x", 9)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").repartition(4).write.parquet(f"{root}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{root}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{root}/benchmark.parquet")
    return root


def test_stages(spark, sf_dir, tmp_path):
    labels, benchmark = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("labels", "benchmark"))
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns = docs.columns
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality rules", "toxicity", "MinHash near-dedup", "benchmark decontamination", "best-fit packing"]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        before = [(r.doc_id, r.text) for r in docs.collect()]
        stage(spark, docs, sf_dir).write.parquet(f"{tmp_path}/{k}")
        after = spark.read.parquet(f"{tmp_path}/{k}")
        if k == 4:
            break
        assert after.columns == columns
        kept = [(r.doc_id, r.text) for r in after.collect()]
        if k == 0:
            failed = {i for i, t in before if brute_quality(t)[0] < 50 or 100 * brute_quality(t)[4] > 50 * brute_quality(t)[0]}
            want = [x for x in before if x[0] not in failed and "|" not in (x[1] or "")]
            assert {r.doc_id for r in quality.score_quality(docs, labels).where("not kept").collect()} == {i for i, _ in before} - {i for i, _ in want}
        elif k == 1:
            want = [x for x in before if "zorgul" not in x[1].lower()]
            assert toxicity.train(docs, labels)[0]
        elif k == 2:
            keep = {i for i, _, c in brute_components(before) if i == c}
            want = [x for x in dict.fromkeys(before) if x[0] in keep]
            assert len(want) < len(before)
        else:
            texts = [b" ".join(ascii_words(r.text)) for r in benchmark.collect()]
            want = [x for x in before if not any(t in b" ".join(ascii_words(x[1])) for t in texts)]
            assert len(want) < len(before)
        assert sorted(kept, key=str) == sorted(want, key=str), k
        docs = after
    rows = lambda df: sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in df.collect())
    packed = rows(after)
    assert packed == rows(packing.pack_documents(docs)) and {r[0] for r in packed} == {i for i, _ in before}
    assert rows(corpus_pipeline.run(spark, sf_dir)) == packed
    assert corpus_pipeline.ORACLE_SQL is None and zlib.crc32(b"") == 0


def test_empty_table(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").where("false")
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        assert docs.count() == 0


def test_odd_rows_and_clashing_columns(spark, sf_dir, tmp_path):
    """Very long, null and empty texts and columns named like the stages' own: columns pass, and no stage fails."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    long = " ".join(f"{w} {k}" for k, w in enumerate(vocabulary() * 60))
    more = spark.createDataFrame([(7000, long, "en", "x", len(long)), (7001, long, "en", "x", len(long)), (7002, None, None, None, None), (7003, "", "", "", 0)], docs.schema)
    clashing = ["dropped_doc_id", "again_doc_id", "leaked_doc_id", "class", "component_id", "kept", "score", "ratio", "hashes", "count", "sequence_id", "bin"]
    docs = docs.unionByName(more)
    for name in clashing:
        docs = docs.withColumn(name, docs["source"])
    columns = docs.columns
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        if k < 4:
            assert docs.columns == columns
            ids = {r.doc_id for r in docs.select("doc_id").collect()}
            assert 7000 in ids and 7002 not in ids and 7003 not in ids and (7001 in ids) == (k < 2)
    assert docs.where("doc_id = 7000").agg({"length": "sum"}).first()[0] > 40_000
