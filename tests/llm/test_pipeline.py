import random

import corpus_pipeline
from bgpforge.llm import common

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, row string"


def sentence(n, seed):
    draw = random.Random(seed)
    return " ".join("".join(draw.choice("abcdefgh") for _ in range(6)) for _ in range(n))


def test_stages_on_planted_documents(spark, tmp_path):
    """Toxic documents and near copies go, personal data is replaced, clean ones, nulls and empty texts do not crash; every piece is in one sequence."""
    toxic = lambda i: " ".join(f"{sentence(8, 900 + 10 * i + k)} qoxpwvz" for k in range(8))
    rows = [(i, sentence(60, i)) for i in range(60)] + [(100 + i, toxic(i)) for i in range(30)]
    rows += [(200, sentence(60, 1) + " more"), (201, sentence(60, 1)), (202, f"{sentence(40, 500)} a.b@mail.org"), (300, None), (301, ""), (None, sentence(30, 600)), (302, sentence(4000, 700))]
    folder = str(tmp_path)
    docs = spark.createDataFrame([(i, t, "en", None if i == 5 else "ab"[(i or 0) % 2], len(t or ""), "own") for i, t in rows], COLUMNS)
    docs.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i >= 100)) for i, _ in rows if i is not None and i < 200], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    kept = docs
    after = {}
    for name, stage in corpus_pipeline.STAGES[:3]:
        kept = stage(spark, kept, folder).cache()
        assert kept.columns == docs.columns, name
        after[name] = {r["doc_id"]: r for r in kept.collect()}
    first, second, third = after.values()
    assert not any(100 <= i < 130 for i in first if i is not None) and {i for i, _ in rows} - set(range(100, 130)) == set(first)
    assert set(first) - set(second) == {200, 201} and set(third) == set(second)
    assert third[202]["text"].endswith("[EMAIL]") and third[202]["n_chars"] == len(third[202]["text"]) and third[300]["text"] is None
    pieces = corpus_pipeline.run(spark, folder).toPandas()
    assert pieces.groupby("sequence_id")["length"].sum().max() <= 2048 and not pieces["doc_id"].isin([*range(100, 130), 200, 201]).any()


def test_stages_on_empty_tables(spark, tmp_path):
    folder = str(tmp_path)
    docs = spark.createDataFrame([], "doc_id long, text string, source string")
    docs.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    assert corpus_pipeline.run(spark, folder).count() == 0


def test_stages_begin_with_collected_executors(spark, monkeypatch):
    """A JVM keeps the heap of its largest stage beside the Python workers of later ones, unless it is told to collect."""
    beans = list(spark._jvm.java.lang.management.ManagementFactory.getGarbageCollectorMXBeans())
    full = lambda: sum(x.getCollectionCount() for x in beans if "Young" not in x.getName())
    before = full()
    common.collect(spark)
    assert full() > before
    called = []
    monkeypatch.setattr(common, "collect", called.append)
    for name in ("reject", "keep_one", "redact", "repeat", "pack"):
        for module in (corpus_pipeline.toxicity, corpus_pipeline.minhash_dedup, corpus_pipeline.pii, corpus_pipeline.mixing, corpus_pipeline.packing):
            monkeypatch.setattr(module, name, lambda docs, *a, **b: docs, raising=False)
    docs = spark.createDataFrame([(1, "a", "s")], "doc_id long, text string, source string")
    for n, (_, stage) in enumerate(corpus_pipeline.STAGES, 1):
        stage(spark, docs, "/root/testdata/sf0.001")
        assert len(called) == n


def test_stages_begin_with_a_driver_that_gave_back(spark, monkeypatch):
    """What the driver's Python and its JVM's compilers have freed would stay with it beside later stages."""
    called = []
    monkeypatch.setattr(common, "give_back", lambda: called.append(1))
    common.collect(spark)
    assert called == [1]
    assert common.collect_driver(spark) or int(spark._jvm.java.lang.System.getProperty("java.version").split(".")[0]) < 17
