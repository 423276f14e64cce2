import os
import random

import pytest

import corpus_pipeline
from helpers import ODD, WORDS, documents, extra, prose
from resalekit.llm.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"


def folder(spark, path, rows, benchmark, labels):
    documents(spark, rows).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(benchmark, "item_id bigint, text string").write.parquet(f"{path}/benchmark.parquet")
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return str(path)


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    rng = random.Random(3)
    rows, labels = [], []
    for i in range(300):
        words = prose(rng.randint(60, 90), 5000 + i, 3000).split()
        if i % 5 == 1:
            for _ in range(4):
                words.insert(rng.randrange(len(words)), "grubber")
        labels.append((i, 1, int(i % 5 == 1)))
        rows.append((i, " ".join(words)))
    near = rows[10][1].split()
    near[-1] = "changed"
    passage, item = prose(70, 1, 3000), prose(20, 2, 3000)
    rows += [(1000, " ".join(near)), (1001, rows[10][1]), (1002, f"{prose(80, 3, 3000)} {passage}"), (1003, f"{passage} {prose(90, 4, 3000)}"),
             (1004, f"{prose(50, 6, 3000)} {item}"), (1005, f"{prose(800, 7, 3000)} {item}"), *((2000 + i, t) for i, t in enumerate(ODD[:-1]))]
    return folder(spark, tmp_path_factory.mktemp("corpus"), rows, [(1, item), (2, None)], labels), dict(rows)


def test_each_stage_decides_and_leaves_the_rest(spark, corpus):
    """Against what a plain reading of the rows says."""
    path, texts = corpus
    docs, seen = spark.read.parquet(f"{path}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, path)
        if name != "packing":
            assert out.columns == docs.columns and out.schema.simpleString() == docs.schema.simpleString()
            docs = spark.createDataFrame(out.collect(), docs.schema)
            seen.append({r.doc_id: r.text for r in docs.collect()})
    toxic = {i for i in texts if i < 300 and i % 5 == 1}
    assert set(seen[0]) == set(texts) - toxic
    assert set(seen[0]) - set(seen[1]) == {1000, 1001} and all(seen[1][i] == texts[i] for i in seen[1])
    changed = {i for i in seen[1] if seen[2].get(i) != seen[1][i]}
    assert changed == {1003} and WORDS.findall(seen[2][1003]) == prose(90, 4, 3000).split()
    assert set(seen[2]) - set(seen[3]) == {1004}
    packed = corpus_pipeline.run(spark, path).collect()
    assert {r.doc_id for r in packed} == set(seen[3])


def test_odd_columns_and_empty_tables(spark, corpus, tmp_path):
    path, _ = corpus
    docs = extra(spark.read.parquet(f"{path}/documents.parquet").limit(40))
    empty = folder(spark, tmp_path, [], [], [])
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, path).count() > 0, name
        assert stage(spark, spark.read.parquet(f"{empty}/documents.parquet"), empty).count() == 0


def test_registry():
    import __spark_entry__ as entry
    q = entry.queries()
    assert {f"op{n}" for n in range(1, 14)} == {k.split("_")[0] for k in QUERIES} and set(QUERIES) | {"pipeline"} <= set(q)
    assert set(ORACLE_SQL) <= set(QUERIES) and [n for n, _ in corpus_pipeline.STAGES] == [
        "toxicity", "ngram_join", "substring", "decontaminate", "packing"]


@pytest.mark.skipif(not os.path.isdir(SF), reason="no driver data")
@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_oracle_parity(spark, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in ("documents", "benchmark", "pages", "labels", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    cur = con.execute(ORACLE_SQL[name])
    names = [d[0] for d in cur.description]
    want = sorted(cur.fetchall(), key=str)
    df = QUERIES[name](spark, SF)
    assert set(df.columns) == set(names)
    assert sorted((tuple(r[c] for c in names) for r in df.collect()), key=str) == want
