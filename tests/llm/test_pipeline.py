"""The corpus pipeline: stages' contracts on whole small tables."""

from __future__ import annotations

from collections import Counter

from pyspark.sql import functions as F

from paxlens.llm import quality, simhash, toxicity
from paxlens.llm.common import read, written


def test_stages(spark, sf_dir):
    import corpus_pipeline

    docs = read(spark, sf_dir, "documents")
    labels = {r.doc_id: r for r in read(spark, sf_dir, "labels").collect()}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = docs
        docs = written(stage(spark, docs, sf_dir), "stage")
        if k < 4:
            assert docs.columns == before.columns, name
        ids = Counter(r.doc_id for r in docs.select("doc_id").collect())
        was = Counter(r.doc_id for r in before.select("doc_id").collect())
        assert set(ids) <= set(was)
        if k == 0:
            clean = [i for i in was if i in labels and labels[i].quality == 1]
            assert sum(i in ids for i in clean) >= 0.97 * len(clean) and sum(i in ids for i in was if i in labels and labels[i].quality == 0) <= 2
        if k == 1:
            assert sum(i in ids for i in was if i in labels and labels[i].toxic == 1) <= 2
            clean = [i for i in was if i in labels and labels[i].toxic == 0]
            assert sum(i in ids for i in clean) >= 0.97 * len(clean)
        if k == 2:
            assert set(ids) == {r.component_id for r in simhash.simhash_components(before).collect()}
        if k == 3:
            assert max(ids.values()) <= 2
        if k == 4:
            text = {r.doc_id: r.text for r in before.collect()}
            assert set(ids) == set(text)
    assert set(docs.columns) >= {"doc_id", "start", "length", "sequence_id", "offset"}


def test_models_are_reproducible(spark, sf_dir):
    from pyspark.sql import functions as F

    docs, labels = read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")
    a, b = (quality.train(d, labels, F.lit(True)) for d in (docs, docs.repartition(3)))
    assert (a.w == b.w).all()
    a, b = (toxicity.train(d, labels, F.lit(True), {1: 5, 0: 20}) for d in (docs, docs.repartition(3)))
    assert (a.emb == b.emb).all()


def test_stages_on_odd_rows(spark, sf_dir):
    """Nulls in any column, empty and very long texts, ties, repeated rows, and columns named like those of the stages."""
    import corpus_pipeline

    docs = read(spark, sf_dir, "documents")
    clean = [r.text for r in docs.join(read(spark, sf_dir, "labels").where("quality = 1 and toxic = 0"), "doc_id").orderBy("doc_id").limit(6).collect()]
    long = " ".join(clean * 60)
    rows = [(None, clean[0], "en", "src0", 1), (None, clean[1], None, None, None), (None, clean[2], "xx", "src0", 1), (7, clean[3], "en", "src1", 1), (7, clean[4], "en", "src1", 1), (8, clean[5], "en", "src1", 1), (8, clean[5], "en", "src1", 1)]
    rows += [(9, None, "en", "src2", 0), (10, "", "en", "src2", 0), (11, " \t", None, None, 3), (12, long, "de", "src2", 9), (13, long, "de", "src3", 9), (None, None, None, None, None)]
    clash = ("row", "score", "toxic", "threshold", "fp", "_row", "hash", "keep", "least", "size", "key", "range", "taken", "copy", "cell", "t", "y", "more", "a.b", "doc id", "run")
    odd = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").select("*", *(F.lit(f"own {c}").alias(c) for c in clash), F.create_map(F.lit("k"), F.lit(1)).alias("map"), F.array(F.lit(None).cast("int")).alias("list"))
    kept = odd
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        whole = stage(spark, odd, sf_dir).collect()  # each on all the rows, too
        empty = stage(spark, odd.limit(0), sf_dir)
        assert empty.count() == 0, name
        before, kept = kept, written(stage(spark, kept, sf_dir), "odd-stage")
        got = kept.collect()
        if k < 4:
            assert kept.columns == odd.columns == empty.columns and kept.dtypes == odd.dtypes, name
            assert all(r[c] == f"own {c}" for r in got + whole for c in clash) and all(r["map"] == {"k": 1} and r["list"] == [None] for r in got + whole), name
            assert {r.text for r in got} <= {r.text for r in before.collect()} or k == 3, name
        texts = Counter(r.text for r in whole) if k < 4 else None
        if k < 2:
            assert all(texts[t] == sum(r[1] == t for r in rows) for t in clean) and texts[long] in (0, 2), name
        if k == 2:
            assert all(texts[t] == 1 for t in clean) and texts[long] == 1 and sum(texts.values()) == 8, name  # all blank texts are one group
            assert next(r.doc_id for r in whole if r.text == long) == 12 and next(r.doc_id for r in whole if not (r.text or "").strip()) == 9
        if k == 3:
            assert all(r.text.strip() for r in whole if r.text is not None) and not any(r.text is None for r in whole)
        if k == 4:
            assert sorted((r.doc_id or 0) for r in whole if r.start == 0) == sorted((r[0] or 0) for r in rows)
