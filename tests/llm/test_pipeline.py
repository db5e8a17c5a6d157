import corpus_pipeline as p
from notelake.sources.scratch import materialize
from tests.llm.conftest import DOCS, rows, words


def write(spark, folder, docs):
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, words(30, 99))], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")


def test_stages_take_effect(spark, tmp_path):
    docs = [(i, words(50, i), "en", f"s{i % 3}", 1) for i in range(30)]
    docs += [(40, "too short", "en", "s0", 1), (41, words(50, 1), "en", "s1", 1), (42, words(50, 2).replace("x10", "y"), "en", "s1", 1), (43, words(20, 7) + " " + words(30, 99), "en", "s1", 1)]
    folder = f"file://{tmp_path}"
    write(spark, folder, docs)
    now, ids = spark.read.parquet(f"{folder}/documents.parquet"), []
    for name, stage in p.STAGES:
        now = materialize(stage(spark, now, folder), "stage")
        ids.append(sorted(r.doc_id for r in now.collect()))
        if name != p.STAGES[-1][0]:
            assert now.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    assert ids[0] == [*range(30), 41, 42, 43]
    assert ids[1] == [*range(30), 43]
    assert ids[2] == [*range(30)]
    assert set(ids[3]) <= set(ids[2]) and ids[4] == ids[3] and ids[3]
    assert p.run(spark, folder).count() == len(ids[4])


def test_empty_documents(spark, tmp_path):
    folder = f"file://{tmp_path}"
    write(spark, folder, [])
    assert p.run(spark, folder).count() == 0


def test_odd_rows_through_all_stages(spark, tmp_path):
    """Nulls, empty and very long texts, ties, repeated rows and extra columns whose names clash."""
    folder = f"file://{tmp_path}"
    write(spark, folder, [])
    bench = spark.createDataFrame([(1, words(30, 3)), (None, words(30, 3)), (2, None), (3, "")], "item_id long, text string")
    bench.write.mode("overwrite").parquet(f"{folder}/benchmark.parquet")
    spark.createDataFrame([(1, None, None), (None, 1, 0), (1, 1, 1)], "doc_id long, quality int, toxic int").write.mode("overwrite").parquet(f"{folder}/labels.parquet")
    now, ids = spark.createDataFrame(rows(), DOCS), []
    for name, stage in p.STAGES:
        now = materialize(stage(spark, now, folder), "stage")
        ids.append(sorted((r.doc_id for r in now.collect()), key=str))
        if name != p.STAGES[-1][0]:
            assert now.columns == [c.split(" ")[0] for c in DOCS.split(", ")]
            assert now.where("rid <> 'r' or key <> 'k' or hash <> 1 or not kept or label <> 'l'").count() == 0
    assert ids[0] == [1, 11, 13, 14, 2, 3, 4, 8, 8, 8, None, None]
    assert not {2, 3} & set(ids[1]) and ids[1].count(8) == 2 and ids[1].count(None) == 1
    assert None not in ids[2] and set(ids[1]) - {None} == set(ids[2])
    assert set(ids[3]) <= set(ids[2]) and ids[4] == ids[3]


def test_two_runs_at_once(spark, tmp_path):
    """Runs in two threads do not drop each other's tables."""
    import threading

    folder, counts = f"file://{tmp_path}", []
    write(spark, folder, [(i, words(50, i), "en", f"s{i % 3}", 1) for i in range(12)])
    runs = [threading.Thread(target=lambda: counts.append(p.run(spark, folder).count())) for _ in range(2)]
    for r in runs:
        r.start()
    for r in runs:
        r.join()
    assert len(counts) == 2 and counts[0] == counts[1] > 0
