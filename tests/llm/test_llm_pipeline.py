"""The pipeline's stages on small documents: what goes, what stays, columns, odd inputs, plans' bounds."""

from __future__ import annotations

import random
import time
from collections import Counter

import pytest
from pyspark.sql import functions as F

import brute
import corpus_pipeline
from ddlscope.llm import tables

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, score double, runs string, others int, place int"


def rows_of(rng):
    def prose(n):
        return " ".join(f"{rng.choice('abcdefgh')}{rng.choice('klmnopqr')}{rng.randrange(5000)}" for _ in range(n))

    docs, labels = {}, {}
    for d in range(300):
        docs[d] = "\n".join(prose(rng.randint(5, 60)) for _ in range(rng.randint(1, 4)))
        if d % 3 == 0:
            docs[d] += " you worthless scum, pathetic loser"
        if d % 2 == 0:
            labels[d] = int(d % 3 == 0)
    line = "This line stands in many documents and is longer than forty characters."
    for d in range(400, 408):
        docs[d] = f"{prose(30)}\n{line}\n{prose(10)}"
    long = prose(120)
    docs[500], docs[501] = long, long + " more"
    passage = prose(60)
    docs[600], docs[601] = prose(40) + " " + passage + " " + prose(50), prose(70) + " " + passage
    docs[700], docs[701] = None, ""
    return docs, labels, line, passage


@pytest.fixture(scope="module")
def world(spark, tmp_path_factory):
    docs, labels, line, passage = rows_of(random.Random(21))
    folder = str(tmp_path_factory.mktemp("sf"))
    rows = [(d, t, "en", "s", len(t) if t is not None else None, 0.5, "r", 1, 2) for d, t in docs.items()]
    rows += [(None, "no id at all", "en", "s", 12, 0.5, "r", 1, 2), rows[410 - 102]]
    spark.createDataFrame(rows, COLUMNS).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(list(labels.items()), "doc_id long, toxic int").write.parquet(f"{folder}/labels.parquet")
    return folder, docs, line, passage


def test_stages_in_turn(spark, world):
    folder, docs, line, passage = world
    now = tables.documents(spark, folder)
    columns, after = now.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        now = tables.written(stage(spark, now, folder), name)
        after[name] = now
        if name != "packing":
            assert now.columns == columns
            assert now.filter("text is not null and n_chars <> length(text)").count() == 0
            assert now.filter("doc_id is null").count() == 1
    text = {name: {r.doc_id: r.text for r in df.collect()} for name, df in after.items() if name != "packing"}
    toxic = {d for d, t in docs.items() if t and "scum" in t}
    assert set(docs) - set(text["toxicity"]) == toxic
    # one document keeps the shared line
    assert [d for d in range(400, 408) if line in text["line_dedup"][d]] == [407]
    before = [(d, t) for d, t in text["line_dedup"].items() if d is not None]
    groups = brute.near_components(before, corpus_pipeline.SHINGLE, corpus_pipeline.PERCENT)
    assert set(text["near_dedup"]) - {None} == {d for d, root in groups.items() if d == root} and 501 not in text["near_dedup"]
    assert Counter(r.doc_id for r in after["near_dedup"].collect()).most_common(1)[0][1] == 1
    kept = sorted(((d, t) for d, t in text["near_dedup"].items()), key=str)
    for d, _, _, _, rest in brute.repeated_bytes(kept, corpus_pipeline.REPEAT):
        found = text["suffix_dedup"][d]
        assert (found or "").encode() == rest and (found is None) == (docs.get(d, "") is None)
    assert all(passage not in (t or "") for t in text["suffix_dedup"].values())
    packed = Counter()
    for r in after["packing"].collect():
        packed[r.doc_id] += r.n_tokens
    assert packed == {d: len((t or "").encode()) + 1 for d, t in text["suffix_dedup"].items()}


def test_near_duplicates_of_rows_that_share_an_id(spark):
    rng = random.Random(8)
    texts = [" ".join(f"{rng.choice('abcdefgh')}{rng.randrange(5000)}" for _ in range(60)) for _ in range(46)]
    # a placeholder id of 40 texts; near copies of six of them and six other texts under ids of their own
    rows = [(-1, t) for t in texts[:40]] + [(10 + i, t + " more") for i, t in enumerate(texts[:6])] + [(20 + i, t) for i, t in enumerate(texts[40:])]
    # the same id and group twice; a group whose smallest id is repeated with another text; rows without words or id
    rows += [(-1, texts[7]), (-1, texts[8] + " zz"), (5, texts[45] + " b"), (5, texts[45] + " a"), (30, ""), (30, ""), (30, None), (None, texts[9])]
    docs = spark.createDataFrame([(d, t, "en", "s", len(t or ""), 0.5, "r", 1, 2) for d, t in rows], COLUMNS).repartition(5)
    got = Counter((r.doc_id, r.text) for r in corpus_pipeline.drop_near_duplicates(spark, docs, "").collect())
    want = Counter([(-1, t) for t in texts[:40]] + [(20 + i, t) for i, t in enumerate(texts[40:45])])
    want.update([(5, texts[45] + " a"), (30, ""), (30, ""), (30, None), (None, texts[9])])
    assert got == want


def test_run_matches_the_stages_and_takes_an_empty_table(spark, world, tmp_path):
    folder = world[0]
    assert corpus_pipeline.run(spark, folder).count() > 200
    empty = str(tmp_path / "empty")
    tables.documents(spark, folder).limit(0).write.parquet(f"{empty}/documents.parquet")
    tables.table(spark, folder, "labels").limit(0).write.parquet(f"{empty}/labels.parquet")
    assert corpus_pipeline.run(spark, empty).count() == 0


def test_a_written_table_leaves_no_shuffle_files(spark):
    def shuffled():
        files = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
        return {files.apply(i).getName() for i in range(files.length()) if files.apply(i).getName().endswith(".data")}

    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    setting, before = spark.conf.get(name), shuffled()
    summed = spark.range(20_000).groupBy((F.col("id") % 977).alias("k")).agg(F.sum("id").alias("n"))
    table = tables.written(summed.join(summed.select("k", (F.col("n") + 1).alias("m")).hint("merge"), "k"), "summed")
    for _ in range(50):  # the executors are told to remove them and not waited for
        if not shuffled() - before:
            break
        time.sleep(0.2)
    assert not shuffled() - before
    assert spark.conf.get(name) == setting
    assert table.filter("m = n + 1").count() == 977
