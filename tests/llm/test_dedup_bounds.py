"""Sizes of groups in one task, and reads that number their rows differently."""

import hashlib
import random

from pyspark.sql import functions as F

from tessera.llm import dedup

SCHEMA = "doc_id long, text string"


def common_passage(n, seed=1):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    passage = " ".join(word() for _ in range(60))
    return [(i, f"{' '.join(word() for _ in range(40))} {passage} {' '.join(word() for _ in range(40))}") for i in range(n)]


def test_rows_of_a_shard_do_not_grow_with_the_texts(spark, tmp_path, monkeypatch):
    """A passage in all texts, split down to single windows: a route hands the judge one row, not one for each text."""
    judge = dedup._judge
    log = str(tmp_path)

    def counting(width, shard_bytes):
        run = judge(width, shard_bytes)

        def counted(batches):
            import uuid
            from collections import Counter

            rows = Counter()

            def seen():
                for batch in batches:
                    rows.update(batch.column("route").to_pylist())
                    yield batch

            yield from run(seen())
            if rows:
                with open(f"{log}/{uuid.uuid4().hex}", "w") as f:
                    f.write(str(max(rows.values())))

        return counted

    monkeypatch.setattr(dedup, "_judge", counting)
    docs = spark.createDataFrame(common_passage(60), SCHEMA)
    removed = {r["doc_id"]: r["n_removed"] for r in dedup.deduplicate(docs, max_contexts=4).collect()}
    assert all(n >= 410 for n in removed.values())
    assert max(int(p.read_text()) for p in tmp_path.iterdir()) <= 4


def test_anchors_of_equal_texts_are_one_row(spark):
    """Rows on the way follow the different texts, not the copies and not the number of parts."""
    n = len(dedup.anchors([common_passage(1)[0][1].encode()])[0])
    rows = [(i, common_passage(1)[0][1]) for i in range(50)] + [(99, common_passage(1, 7)[0][1])]
    texts = spark.createDataFrame(rows, SCHEMA).repartition(10).select(dedup.text_key(F.col("text")).alias("key"), "text")
    different = texts.groupBy("key").agg(F.first("text").alias("text"), F.count("*").alias("copies"))
    made = dedup.map_arrow(different, dedup._anchor_batch(dedup.WIDTH), "anchor long, key binary, ordinal int, sure boolean")
    other = len(dedup.anchors([rows[-1][1].encode()])[0])
    assert made.count() == n + other and made.where("key is null").count() == n
    assert dedup.repeated_anchors(different, dedup.WIDTH).count() == 0


def test_a_common_anchor_is_a_row_a_batch(spark):
    docs = spark.createDataFrame(common_passage(400), SCHEMA).select(dedup.text_key(F.col("text")).alias("key"), "text", F.lit(1).cast("long").alias("copies")).coalesce(1)
    made = dedup.map_arrow(docs, dedup._anchor_batch(dedup.WIDTH), "anchor long, key binary, ordinal int, sure boolean")
    most = made.groupBy("anchor").count().agg(F.max("count")).collect()[0][0]
    assert most <= 2
    flagged = dedup.repeated_anchors(docs, dedup.WIDTH).collect()
    assert len(flagged) == 400 and all(len(r["ordinals"]) >= 3 for r in flagged)


def test_reads_in_any_order(spark):
    """No row numbers are used: a frame whose rows come in another order at every read gives the same."""
    text = common_passage(1)[0][1]
    docs = spark.createDataFrame([(i, text) for i in range(5)], SCHEMA).orderBy(F.rand())
    got = dedup.deduplicate(docs).collect()
    assert {(r["n_removed"], r["kept_sha256"]) for r in got} == {(len(text), hashlib.sha256(b"").hexdigest())}
