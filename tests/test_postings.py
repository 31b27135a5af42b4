import random

import pytest
from conftest import entry
from pyspark.sql import functions as F

from logloom.functions.fuzzy import allowed_edits, edit_distance
from logloom.operators import postings as PO
from logloom.operators import search as S
from logloom.operators import sketches as SK
from logloom.streaming import ingest as IN

WORDS = ["payment", "gateway", "timeout", "error", "user", "login", "a", "failed", "cache", "internationalisierungsmassnahme"]


def make_logs(logs, n=120, seed=1):
    rng = random.Random(seed)
    docs = []
    for i in range(n):
        message = " ".join(rng.choices(WORDS, k=rng.randint(0, 9)))
        error = {"type": "TimeoutException", "message": " ".join(rng.choices(WORDS, k=3))} if i % 3 == 0 else None
        docs.append(entry(id=f"log-{i % 100}", timestamp=f"2024-01-{1 + i % 5:02d}T10:00:00Z" if i % 7 else None, message=message, error=error,
                          tags=rng.sample(["x", "retry", "search"], k=rng.randint(0, 2)), request={"path": rng.choice(["/api/pay", "/api/user"])}))
    docs += [docs[3], docs[3], entry(id=None, message="payment without an id"), entry(id="n", message=None, tags=None)]
    return logs(*docs)


@pytest.fixture(scope="module")
def indexed(spark, logs, tmp_path_factory):
    rows = make_logs(logs).cache()
    path = str(tmp_path_factory.mktemp("index"))
    PO.write(rows.where("id is null or id < 'log-5'"), path, batch_id=0)
    PO.write(rows.where("id >= 'log-5'"), path, batch_id=1)
    return rows, PO.Index.read(spark, path)


def scores(df):
    return sorted((str(r["id"]), str(r["timestamp"]), round(r["score"], 9)) for r in df.select("id", "timestamp", "score").collect())


@pytest.mark.parametrize("query", ["payment", "payment timeout", "user error login", "the", "zzz", "a payment without"])
@pytest.mark.parametrize("operator", ["and", "or"])
def test_match_equals_the_row_form(indexed, query, operator):
    rows, index = indexed
    assert scores(PO.rows_of(rows, PO.match(index, query, operator=operator))) == scores(S.match(rows, query, operator=operator))


@pytest.mark.parametrize("query,slop", [("payment timeout", 0), ("payment timeout", 3), ("user login user", 4), ("error", 0)])
def test_phrase_equals_the_row_form(indexed, query, slop):
    rows, index = indexed
    assert scores(PO.rows_of(rows, PO.match_phrase(index, query, slop))) == scores(S.match_phrase(rows, query, slop))


@pytest.mark.parametrize("query", ["paymnet gatway", "tiemout usr", "internationalisirungsmasnahme", "/api/pai", "timeout"])
def test_fuzzy_equals_the_row_form(indexed, query):
    rows, index = indexed
    assert scores(PO.rows_of(rows, PO.multi_match(index, query))) == scores(S.multi_match(rows, query))


def test_a_page_is_looked_up_by_its_ids(indexed):
    rows, index = indexed
    found = PO.multi_match(index, "paymnt")
    page = PO.rows_of(rows, PO.page(found, 5, 2), named=True).select("id", "score").collect()
    best = sorted((r["score"] for r in found.collect()), reverse=True)[2:7]
    assert {round(r["score"], 9) for r in page} == {round(s, 9) for s in best}


def test_only_the_buckets_of_the_terms_are_read(indexed):
    _, index = indexed
    plan = PO.match(index, "payment timeout")._jdf.queryExecution().executedPlan().toString()
    buckets = PO.buckets_of(["payment", "timeout"])
    filters = [x.split("]")[0] for x in plan.split("PartitionFilters: [")[1:]]
    assert any(f"IN ({','.join(map(str, buckets))})" in x and x.startswith("bucket#") for x in filters)
    assert "In(term, [payment,timeout])" in plan
    assert "levenshtein" not in plan.lower()


def test_expansions_are_all_words_within_the_edits(spark):
    rng = random.Random(2)
    words = {"".join(rng.choices("abcd", k=rng.randint(1, 9))) for _ in range(1500)}
    words |= {"x" * 24, "x" * 25, "x" * 26, "x" * 27, "y" + "x" * 23}
    statistics = spark.createDataFrame([("message", w, 1, None, None) for w in words], "field string, term string, df bigint, n bigint, total bigint")
    index = PO.Index(statistics, statistics, PO.variants(statistics))
    for query in ["abcd", "ab", "abcabcd", "abdcabc", "ddddccc", "x" * 23, "x" * 26, "x" * 28]:
        got = {(r["term"], r["edits"]) for r in PO.expansions(index, S.MESSAGE, [query]).collect()}
        edits = edit_distance(F.col("term"), query, allowed_edits(query))
        boost = S._boost(edits, F.col("term"), query)
        want = statistics.where(boost > 0).select("term", edits.alias("edits")).collect()
        assert got == {(r["term"], r["edits"]) for r in want}, query


def test_a_record_stored_twice_is_found_twice_and_scored_once(spark, logs, tmp_path):
    rows = logs(entry(id="a", message="payment timeout"), entry(id="a", message="payment timeout"), entry(id="a", message="payment"))
    PO.write(rows, str(tmp_path / "i"))
    index = PO.Index.read(spark, str(tmp_path / "i"))
    assert scores(PO.rows_of(rows, PO.match(index, "payment"))) == scores(S.match(rows, "payment"))
    assert PO.match(index, "payment").count() == 2


def test_stream_writes_the_index_and_replaces_it(spark, tmp_path, lines):
    layout = IN.Layout(str(tmp_path / "out"))
    IN.process_batch(lines(entry(id="a", message="first words")), 1, layout, with_postings=True)
    IN.process_batch(lines(entry(id="b", message="other words")), 1, layout, with_postings=True)
    index = PO.Index.read(spark, layout.postings)
    assert [r["id"] for r in PO.match(index, "words").collect()] == ["b"]
    assert PO.match(index, "first").count() == 0


def test_sketches_merge_over_batches(spark, logs):
    docs = [entry(id=str(i), timestamp=f"2024-01-0{1 + i % 2}T00:00:00Z", metrics={"response_time_ms": i}) for i in range(200)]
    parts = [SK.value_sketches(logs(*docs[k::3])) for k in range(3)]
    both = parts[0].unionByName(parts[1]).unionByName(parts[2]).where("number = 'response_time_ms'")
    whole = {r["percent"]: r["value"] for r in SK.quantiles(both, [0, 50, 100]).collect()}
    assert whole[0] == 0 and whole[100] == 199 and abs(whole[50] - 99.5) <= 1
    days = SK.quantiles(both, [100], ("log_date",)).collect()
    assert sorted((str(r["log_date"]), r["n"], r["value"]) for r in days) == [("2024-01-01", 100, 198.0), ("2024-01-02", 100, 199.0)]
    nothing = SK.value_sketches(logs(entry(metrics=None)))
    assert nothing.count() == 0


def test_postings_are_gathered_in_the_record(spark, logs):
    rows = logs(
        entry(id="a", message="error payment error the error", tags=["x", "retry"]),
        entry(id="b", message=""), entry(id="c", message=None, tags=None), entry(id="d", message="the a"),
        entry(id="e", message=" ".join(["error", "user", "the"] * 400)),
    )
    found = PO.postings(rows)
    got = {(r["id"], r["field"], r["term"]): (r["positions"], r["length"]) for r in found.collect()}
    message = {k: v for k, v in got.items() if k[1] == "message"}
    assert message == {
        ("a", "message", "error"): ([0, 2, 4], 4), ("a", "message", "payment"): ([1], 4),
        ("e", "message", "error"): (list(range(0, 1200, 3)), 800), ("e", "message", "user"): (list(range(1, 1200, 3)), 800),
    }
    assert {k[2]: v for k, v in got.items() if k[:2] == ("a", "tags")} == {"x": ([0], 2), "retry": ([1], 2)}
    # words of one record are together already: no aggregate, one shuffle
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" not in plan and plan.count("RepartitionByExpression") == 1


@pytest.mark.parametrize("batch_id", [None, 3])
def test_written_buckets_are_sorted_by_term(spark, logs, tmp_path, batch_id):
    import glob

    import pyarrow.parquet as pq

    PO.write(make_logs(logs), str(tmp_path / "i"), batch_id=batch_id)
    files = glob.glob(f"{tmp_path}/i/postings/**/*.parquet", recursive=True)
    assert files
    several = 0
    for path in files:
        table = pq.ParquetFile(path).read(columns=["field", "term"]).to_pydict()
        keys = list(zip(table["field"], table["term"]))
        assert keys == sorted(keys)
        several += len(set(keys)) > 1
    assert several
    if batch_id is not None:
        assert all(f"/batch={batch_id}/bucket=" in path for path in files)
        batches = PO.Index.read(spark, str(tmp_path / "i"))
        for table in (batches.postings, batches.statistics, batches.variants):
            assert [r["batch"] for r in table.select("batch").distinct().collect()] == [batch_id]


def test_the_index_deals_its_events_out(spark, sf_dir):
    from contract.text_queries import _index

    logs, _ = _index(spark, sf_dir)
    assert "RepartitionByExpression" in logs._jdf.queryExecution().optimizedPlan().toString()
