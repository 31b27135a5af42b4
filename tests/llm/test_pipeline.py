"""The pipeline stage by stage against plain Python, and its queries against SQL."""

import duckdb
import pytest

import __spark_entry__ as contract_entry
import corpus_pipeline
from logloom.llm import queries
from oracle_check import compare, connect
from test_operators import contaminated, linked, shards_hold

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_query_against_sql(spark, name):
    assert compare(spark, connect(SF), name, queries.QUERIES[name], queries.ORACLE[name], SF) is None


def test_all_are_registered():
    names = contract_entry.queries()
    assert "pipeline" in names
    for n in range(1, 11):
        assert len([q for q in names if q.startswith(f"op{n}_")]) == 1


@pytest.fixture(scope="module")
def stages(spark):
    """The rows that go into each stage and come out of the last."""
    docs = queries.table(spark, SF, "documents")
    out = [docs]
    for name, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.stored(stage(spark, docs, SF), name)
        out.append(docs)
    return out


def rows(df):
    return {r["doc_id"]: r for r in df.collect()}


def test_stages_keep_the_columns(stages):
    assert all(s.columns == stages[0].columns for s in stages[:-1])
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_dedup", "decontamination", "mixing", "sharding"]


def test_toxic_documents_go(spark, stages):
    toxic = {r["doc_id"] for r in queries.table(spark, SF, "labels").where("toxic = 1").collect()}
    before, after = rows(stages[0]), rows(stages[1])
    clean = {r["doc_id"] for r in queries.table(spark, SF, "labels").where("toxic = 0").collect()}
    assert len(clean & before.keys() - after.keys()) <= 0.02 * len(clean)
    assert len(toxic & after.keys()) < len(toxic & before.keys()) / 2


def test_one_of_each_group_stays(stages):
    before, after = rows(stages[1]), rows(stages[2])
    ids = sorted(before)
    want = {i for k, i in enumerate(ids) if linked([before[j]["text"] for j in ids])[k][1] == k} if len(ids) < 5 else None
    if want is None:
        found = linked([before[j]["text"] for j in ids])
        want = {i for k, i in enumerate(ids) if found[k][1] == k}
    assert set(after) == want


def test_contaminated_documents_go(spark, stages):
    before, after = rows(stages[2]), rows(stages[3])
    items = [(r["item_id"], r["text"]) for r in queries.table(spark, SF, "benchmark").collect()]
    ids = sorted(before)
    judged = contaminated([before[i]["text"] for i in ids], items)
    assert set(after) == {i for i, j in zip(ids, judged) if not j[4]}


def test_the_mixture_takes_what_sql_takes(stages):
    con = duckdb.connect()
    con.register("stage", stages[3].toPandas())
    want = con.sql(f"WITH {queries.mix_sql('stage', corpus_pipeline.SHARE, corpus_pipeline.EPOCHS)} SELECT doc_id FROM taken WHERE n_epochs > 0").fetchall()
    assert set(rows(stages[4])) == {i for (i,) in want}


def test_the_rest_is_sharded(stages):
    texts = {i: r["text"] for i, r in rows(stages[4]).items()}
    placed = stages[5].collect()
    assert len(placed) == len(texts)
    shards_hold(placed, texts)


def test_pipeline_on_odd_and_empty_tables(spark):
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint, n_epochs int, contaminated string, shard int, items int"
    odd = [(1, None, None, None, None, 1, "x", 2, 3), (None, "a b c", "en", "src1", 5, 1, "x", 2, 3), (2, "", "en", "src1", 0, None, None, None, None),
           (3, "some words of a text", "de", "x", 20, 1, "x", 2, 3), (3, "some words of a text", "de", "x", 20, 1, "x", 2, 3)]
    for data in (odd, []):
        docs = spark.createDataFrame(data, schema)
        for name, stage in corpus_pipeline.STAGES[:-1]:
            docs = corpus_pipeline.stored(stage(spark, docs, SF), name)
            assert docs.columns == [c.split()[0] for c in schema.split(", ")]
        corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()
