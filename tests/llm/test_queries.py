import corpus_pipeline
from tessera.llm import queries


def test_every_operator_has_a_query():
    assert [k.split("_")[0] for k in queries.QUERIES] == [f"op{n}" for n in range(1, 14)]
    assert set(queries.ORACLES) <= set(queries.QUERIES)


def test_pipeline_stages_keep_the_columns(spark):
    names = ("_key", "_left", "_id", "_own", "key", "fp", "row", "n_words", "kept", "_words", "bin", "length", "stays")
    rows = [(i, " ".join(f"w{(i * j) % 89}" for j in range(40 + i)), "en", "s", 5) for i in range(12)] + [(12, None, None, None, None), (13, "short", "en", "s", 5), (3, "again", "en", "s", 5)]
    docs = spark.createDataFrame([(*r, *names) for r in rows], "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{n}` string" for n in names))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, "")
        assert out.columns == docs.columns, name
        assert all(r[n] == n for r in out.collect() for n in names), name
        assert stage(spark, docs.limit(0), "").count() == 0, name
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, "")
    assert packed.where("piece = 0").count() == len(rows)
