"""The pipeline's stages on their own inputs."""

import collections
import re

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from meterlake.llm import registry

DATA = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    docs, out = spark.read.parquet(f"{DATA}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path_factory.mktemp("stage") / name)
        stage(spark, docs, DATA).write.parquet(path)
        after = spark.read.parquet(path)
        out.append((name, docs, after))
        docs = after
    return {name: (before, after) for name, before, after in out}


def test_all_but_the_last_keep_the_columns(stages):
    for name, (before, after) in stages.items():
        assert name == "packing" or sorted(before.columns) == sorted(after.columns)


def test_filters_keep_clean_documents(spark, stages):
    labels = spark.read.parquet(f"{DATA}/labels.parquet")
    for name in ("language_id", "quality_rules"):
        before, after = stages[name]
        lost = before.join(after, "doc_id", "left_anti").join(labels.where("quality = 1"), "doc_id")
        assert lost.where(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")) >= 20).count() == 0
    before, after = stages["quality_rules"]
    assert after.join(labels.where("quality = 0"), "doc_id").count() == 0


def test_one_document_of_each_group_stays(stages):
    before, after = stages["near_dedup"]
    seen = {tuple(WORD.findall(r["text"].lower())) for r in after.collect()}
    assert len(seen) == after.count() and {tuple(WORD.findall(r["text"].lower())) for r in before.collect()} >= seen


def test_mixture_takes_its_targets(spark, stages):
    from meterlake.llm import mixing

    before, after = stages["mixing"]
    want = {r["source"]: r["target"] for r in mixing.mix(before.withColumn("origin", F.col("source")), carry=("origin",)).select(F.col("origin").alias("source"), "target").distinct().collect()}
    have, texts = collections.Counter(), {r["doc_id"]: r["text"] for r in before.collect()}
    for r in after.collect():
        have[r["source"]] += len(WORD.findall(r["text"]))
        assert texts[r["doc_id"]].startswith(r["text"]) and r["n_chars"] == len(r["text"])
    for source, target in want.items():
        assert abs(have[source] - target) <= 1


def test_packing_holds_all_words(stages):
    before, after = stages["packing"]
    assert sum(len(WORD.findall(r["text"])) for r in before.collect()) == sum(r["n_words"] for r in after.collect()) == sum(len(r["text"].split(" ")) for r in after.collect())


def test_odd_rows_pass(spark, docs_schema):
    text = "Words that make up a sentence of some length, so that it is kept by the rules of quality and of language. "
    rows = [(1, text * 1, "en", "a", 3), (1, text, "en", "a", 3), (None, text + "More.", None, None, 1), (2, None, "en", "a", 0), (3, "", None, None, None), (4, text + "Other words follow here.", "en", None, 2)]
    docs = spark.createDataFrame(rows, docs_schema).withColumn("taken", F.lit("clash"))
    for frame in (docs, docs.limit(0)):
        for name, stage in corpus_pipeline.STAGES:
            after = stage(spark, frame, DATA)
            after.collect()
            if name != "packing":
                assert sorted(after.columns) == sorted(frame.columns)


def test_unlike_texts_of_one_id_stay(spark, docs_schema, tmp_path):
    make = lambda k: " ".join(f"w{k}x{i}" for i in range(40))
    near = make(1) + " tail"
    rows = [(7, make(k), "en", "s", k) for k in range(1, 5)] + [(7, make(2), "en", "s", 5), (3, near, "en", "s", 6), (9, near, "en", "s", 7), (8, make(9), "en", "s", 8), (None, make(3), "en", "s", 9)]
    frame = spark.createDataFrame(rows, docs_schema)
    frame.repartition(3).write.parquet(str(tmp_path / "docs"))
    for docs in (frame, spark.read.parquet(str(tmp_path / "docs"))):
        got = sorted((r["doc_id"] or 0, r["text"]) for r in corpus_pipeline.one_of_each(spark, docs, DATA).collect())
        assert got == sorted([(3, near), (7, make(2)), (7, make(3)), (7, make(4)), (8, make(9))])


def test_rows_without_ids_are_compared(spark, docs_schema, tmp_path):
    make = lambda k: " ".join(f"w{k}x{i}" for i in range(40))
    rows = [(None, make(1), "en", "s", k) for k in range(3)] + [(None, make(2), "en", "s", 9), (5, make(2), "en", "s", 8), (None, None, "en", "s", 7), (None, "", "en", "s", 7)]
    frame = spark.createDataFrame(rows, docs_schema).withColumns({"stage_key": F.lit(1), "_metadata": F.lit("clash"), "stage_row": F.lit(2)})
    frame.repartition(3).write.parquet(str(tmp_path / "docs"))
    for docs in (frame, spark.read.parquet(str(tmp_path / "docs"))):
        got = corpus_pipeline.one_of_each(spark, docs, DATA)
        assert got.columns == docs.columns
        assert sorted((str(r["doc_id"]), str(r["text"])) for r in got.collect()) == sorted([("None", make(1)), ("5", make(2)), ("None", "None"), ("None", "")])


@pytest.mark.parametrize("own", ["id", "id div 2", "nullif(id, 7)"])
def test_keys_over_many_files(spark, docs_schema, tmp_path, own):
    """A thousand files: keys are distinct and the same at every read, in whatever splits; ids serve if each row has its own."""
    rows = spark.range(4_000).selectExpr(f"{own} as doc_id", "string(id) as text", "'en' as lang", "'s' as source", "1L as n_chars")
    rows.repartition(1_000).write.parquet(str(tmp_path / "docs"))
    docs = corpus_pipeline.keyed(spark, spark.read.parquet(str(tmp_path / "docs")), "k")
    first = {(r["text"], r["k"]) for r in docs.collect()}
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "64k")
    again = {(r["text"], r["k"]) for r in docs.repartition(7).collect()}
    spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert len({k for _, k in first}) == 4_000 and first == again
    assert docs.where("doc_id = k").count() == 4_000 or own != "id"


def test_ids_and_stored_numbers_keep_the_same_rows(spark, monkeypatch):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    got = {r["doc_id"] for r in corpus_pipeline.one_of_each(spark, docs, DATA).collect()}
    stored = lambda spark, docs, key: corpus_pipeline.Scratch(spark, "keyed").keep(docs.withColumn(key, F.monotonically_increasing_id()), "docs")
    monkeypatch.setattr(corpus_pipeline, "keyed", stored)
    assert got == {r["doc_id"] for r in corpus_pipeline.one_of_each(spark, docs, DATA).collect()} and len(got) < docs.count()


def test_every_operator_has_a_query():
    numbers = sorted(int(re.match(r"op(\d+)_", n)[1]) for n in registry.queries())
    assert numbers == list(range(1, 14)) and set(registry.oracle_sql()) <= set(registry.queries())


def test_mixing_matches_its_oracle(spark):
    import duckdb

    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{DATA}/documents.parquet'")
    cursor = con.execute(registry.oracle_sql()["op5_mixing"])
    names = [d[0] for d in cursor.description]
    want = sorted(tuple(dict(zip(names, r, strict=True))[c] for c in sorted(names)) for r in cursor.fetchall())
    df = registry.queries()["op5_mixing"](spark, DATA)
    assert sorted(df.columns) == sorted(names) and sorted(tuple(r[c] for c in sorted(names)) for r in df.collect()) == want
