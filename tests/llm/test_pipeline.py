"""The pipeline over odd tables: columns of any name, rows without ids or texts, repeated rows, empty tables."""

import corpus_pipeline

EXTRA = "score string, n_lines string, _rid string, rid string, component string, kept string"
SCHEMA = f"doc_id long, text string, lang string, source string, n_chars long, {EXTRA}"


def written(spark, folder, docs):
    prose = "The committee met on {} and agreed that the plan for the harbour would go ahead after a long debate about {}."
    good = [prose.format(f"day {i}", " ".join(f"w{i * 31 + j}" for j in range(30))) for i in range(40)]
    junk = [f"buy now!!! $$$ {i} click $$$ {i}\n" * 5 for i in range(40)]
    rows = [(i, t) for i, t in enumerate(good + junk)] + docs(good)
    spark.createDataFrame([(i, t, "en", "s", 1, *["mine"] * 6) for i, t in rows], SCHEMA).repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(i, int(i < 40), 0) for i in range(80)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, " ".join(good[7].split()[-25:]))], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return str(folder)


def test_stages_keep_all_columns(spark, tmp_path):
    folder = written(spark, tmp_path, lambda good: [(None, good[3]), (None, None), (90, good[4]), (90, good[4]), (91, good[5].replace("harbour", "harbor")), (92, "")])
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    seen = []
    for no, (_, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        stage(spark, docs, folder).write.parquet(f"{tmp_path}/stage{no}")
        docs = spark.read.parquet(f"{tmp_path}/stage{no}")
        assert docs.columns == [x.split()[0] for x in SCHEMA.split(", ")]
        rows = docs.collect()
        assert {x for r in rows for x in r[5:]} == {"mine"}
        seen.append({r.doc_id for r in rows})
    quality, exact, near, clean = seen
    assert set(range(40)) <= quality and not quality & set(range(40, 80))
    assert {3, 4} <= exact and 90 not in exact and 91 in exact and {5} <= near and 91 not in near
    assert clean == near - {7}
    ids = corpus_pipeline.STAGES[-1][1](spark, docs, folder)
    assert ids.count() == docs.count() and {r.doc_id for r in ids.collect()} == clean


def test_an_empty_table(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert out.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] and out.count() == 0
