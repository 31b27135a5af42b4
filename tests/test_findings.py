"""One small case for each finding of a review."""

import time
from datetime import datetime

import pytest
from conftest import entry

import contract
from contract import ingest_queries as Q
from logloom.functions import analysis, fuzzy
from logloom.operators import search as S
from logloom.sources import validation
from logloom.streaming import ingest

EVENTS = "event_id bigint, ts timestamp, user_id bigint, event_type string, value double, props string"


def events(spark, *numbers, value=490.0):
    rows = [(n, datetime(2024, 1, 5), 7, "click", value, '{"k": 1}') for n in numbers]
    return spark.createDataFrame(rows, EVENTS)


def test_format_bytes_beyond_64_bits(spark, tmp_path):
    events(spark, 0, 100_000, 6_000_000).coalesce(1).write.parquet(str(tmp_path / "events.parquet"))
    found = contract.QUERIES["format_bytes"](spark, str(tmp_path)).orderBy("event_id").collect()
    # 37 * 6,000,000 ** 3 / 1024 ** 4 = 7268681656.569…
    assert [r["size"] for r in found] == ["0 B", "33651.30 TB", "7268681656.57 TB"]


@pytest.mark.parametrize("text", ["de x x x la un", "la x x de la un", "la un x x de x la un", "un la la de x de un la un"])
def test_windows_that_end_at_one_place(spark, text):
    slots = [(0, "de"), (1, "la"), (2, "un")]
    words = text.split()
    spots = [{i - p for i, w in enumerate(words) if w == t} for p, t in slots]
    ends = {}
    for a in sorted(set().union(*spots)):
        if all(max(s) >= a for s in spots):
            ends[max(min(x for x in s if x >= a) for s in spots)] = a
    expected = sum(1 / (1 + b - a) for b, a in ends.items() if b - a <= 6)
    row = spark.createDataFrame([(words,)], "terms array<string>")
    found = row.select(S.phrase_frequency(row["terms"], slots, 6).alias("f")).head()["f"]
    assert found == pytest.approx(expected)


def test_documents_have_the_named_faults_only(spark):
    """A duration beyond an integer is none of the faults of the made documents."""
    checked = validation.validate(Q.raw_lines(events(spark, 20, 18_000_008, value=189.5)))
    assert validation.rejects(checked).count() == 0
    durations = validation.accepted(checked).select("id", "request.duration_ms").collect()
    assert {r["id"]: r["duration_ms"] for r in durations} == {"20": 3790, "18000008": None}


def test_term_df_takes_time_by_the_length_of_a_text(spark, tmp_path):
    """Two texts of 20,000 different words; with a search of the whole text for each word this took minutes."""
    long = " ".join(f"w{i} w{i}" for i in range(20_000))
    rows = [(1, long, "en", "s"), (2, long + " w7 the", "en", "s"), (3, None, "en", "s")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    start = time.time()
    found = {r["term"]: (r["tf"], r["df"]) for r in contract.QUERIES["term_df"](spark, str(tmp_path)).collect()}
    assert time.time() - start < 30
    assert len(found) == 20_000 and found["w7"] == (5, 2) and found["w8"] == (4, 2)


def test_validation_reads_each_object_once(spark):
    """One cast for each object, and no lambda around the tests; before it was one path for each field."""
    lines = spark.range(1).selectExpr("concat('{\"id\":', id, '}') AS value")
    plan = validation.validate(lines)._jdf.queryExecution().optimizedPlan().toString()
    assert ", $.service.name," not in plan and ", $.geo.location," not in plan
    assert "lambda" not in plan.split("reject_reasons")[-1].split("exists(")[0] and "isnotnull(lambda" not in plan


def test_points_without_an_object(spark, lines):
    """Fields that are missing, null, of another kind or in unusual forms are read as before."""
    texts = [
        '{"id":1}', '{"id":2,"geo":{"location":[3,4]}}', '{"id":3,"geo":{"location":["3","4.5"]}}',
        '{"id":4,"geo":{"location":{"type":"Point","coordinates":[1,2,3]}}}', '{"id":5,"geo":{"location":null}}',
        '{"id":6,"geo":null}', '{"id":7,"geo":[]}', '{"id":8,"service":{}}', '{"id":9,"service":"x"}',
        '{"id":10,"geo":{"location":{"type":"Point","coordinates":7}}}', '{"id":11,"geo":{"location":[]}}',
        '{"id":12,"tags":["a{",1,null]}', '{"id":13,"tags":[[{"a":1}]]}', '{"id":14,"tags":{}}', '{"id":15,"message":"{x"}',
        '{"id":16,"geo":{"location":{"lat":"1","lon":true}}}', '{"id":17,"ID":5,"level":1.50,"category":1e3}',
    ]
    rows = validation.validate(lines(*texts)).collect()
    found = {r["id"]: r for r in rows}
    refused = {k: [x["field"] for x in r["reject_reasons"]] for k, r in found.items() if r["reject_reasons"]}
    points = {k: tuple(r["geo"]["location"]) for k, r in found.items() if r["geo"] and r["geo"]["location"] and k not in refused}
    assert refused == {
        "7": ["geo"], "9": ["service"], "10": ["geo.location"], "11": ["geo.location"], "14": ["tags"],
    }
    assert points == {"2": (4.0, 3.0), "3": (4.5, 3.0), "4": (2.0, 1.0), "16": (1.0, 1.0)}
    assert found["6"]["geo"] is None and found["8"]["service"] is not None and found["1"]["service"] is None
    assert found["12"]["tags"] == ["a{", "1", None] and found["15"]["message"] == "{x"
    assert (found["17"]["level"], found["17"]["category"]) == ("1.5", "1000.0")


def _edits(a, b):
    """Plain edits and exchanges of neighbours, any number of them around each other up to two."""
    near, seen = {a}, {a: 0}
    letters = set(b) | {"?"}
    for k in (1, 2):
        made = set()
        for w in near:
            made |= {w[:i] + w[i + 1 :] for i in range(len(w))}
            made |= {w[:i] + c + w[i:] for i in range(len(w) + 1) for c in letters}
            made |= {w[:i] + c + w[i + 1 :] for i in range(len(w)) for c in letters}
            made |= {w[:i] + w[i + 1] + w[i] + w[i + 2 :] for i in range(len(w) - 1)}
        near = made - seen.keys()
        seen.update(dict.fromkeys(near, k))
    return seen.get(b)


def test_cheap_test_passes_every_near_word(spark):
    """The terms of a row pass it before any edits are worked out; it lets all near words through."""
    words = ["thatin", "htatin", "thaitn", "htaitn", "tathin", "that", "xthatxin", "thatinxx", "nitaht", "atin", "ht", "htatnix"]
    rows = spark.createDataFrame([(w,) for w in words], "t string")
    found = rows.select(
        "t", fuzzy.edit_distance(rows["t"], "thatin", 2).alias("edits"), fuzzy.may_be_near(rows["t"], "thatin", 2).alias("may")
    ).collect()
    for r in found:
        assert r["edits"] == _edits("thatin", r["t"]), r
        assert r["may"] or r["edits"] is None


def test_long_runs_are_looked_for_from_their_start(spark):
    """Runs of 255 characters are no long words; with a look from every character this took 128 times as long."""
    assert analysis._NOT_PLAIN.startswith(r"(?:^|\s)")
    text = " ".join(["x" * 255] * 20 + ["y" * 257])
    row = spark.createDataFrame([(text,)], "t string")
    sizes = [len(w) for w in row.select(analysis.tokenize("t").alias("w")).head()["w"]]
    assert sizes == [255] * 21 + [2]


def test_generated_records_use_all_cores(spark, tmp_path, monkeypatch):
    """A source of one partition made one task of all records; now its numbers are dealt out."""
    seen = []
    monkeypatch.setattr(ingest, "process_batch", lambda lines, *_: seen.append((lines.rdd.getNumPartitions(), lines.count())))
    ingest.generate(spark, ingest.Layout(str(tmp_path)), 100, 50, "2024-01-01", partitions=1)
    assert seen == [(spark.sparkContext.defaultParallelism, 50)] * 2


def _moved(df):
    """What each shuffle of a plan moves and each sort orders, as the plan says it."""
    plan = df.sparkSession._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")
    return [p for p in plan.split("\n\n") if any(f") {kind}" in p.strip().split("\n")[0] for kind in ("Exchange", "Sort"))]


def test_repeats_are_found_without_shuffling_records(spark, lines, tmp_path):
    """Only ids, days and numbers are shuffled; before it was the whole records, twice for each batch."""
    layout = ingest.Layout(str(tmp_path))
    ingest.process_batch(lines(entry(id="a"), entry(id="b")), 1, layout, remember_ids="1 hour")
    docs = [entry(id=i) for i in ("b", "c", "c", None, None)] + [entry(id="a", timestamp="2024-01-02T00:00:00Z"), "{oops"]
    docs += [entry(id=f"n{i % 150}") for i in range(300)]
    checked = ingest._numbered(validation.validate(lines(*docs)), layout, 2)
    new = ingest.new_documents(validation.accepted(checked), layout, 2, "1 hour")
    moved = _moved(new)
    assert moved and not [p for p in moved if "message" in p or "service" in p]
    kept = sorted(str(r["id"]) for r in new.collect())
    assert kept == sorted(["None", "None", "a", "c", *[f"n{i}" for i in range(150)]])
    assert new.columns == validation.accepted(checked).drop(ingest.ROW).columns


def test_a_batch_that_remembers_caches_nothing(spark, lines, tmp_path, monkeypatch):
    """The checked and the new rows were cached, on disk where memory ends; now there are working files, gone at the end."""
    layout, seen = ingest.Layout(str(tmp_path / "l")), []
    whole = ingest.metrics.partials

    def look(good):
        cached = spark._jsc.sc().getPersistentRDDs().size() - before
        seen.append((cached, (tmp_path / "l/working/batch=1").exists(), sorted(r["id"] for r in good.collect())))
        return whole(good)

    monkeypatch.setattr(ingest.metrics, "partials", look)
    before = spark._jsc.sc().getPersistentRDDs().size()
    ingest.process_batch(lines(entry(id="a"), entry(id="a"), entry(id="b"), "{"), 1, layout, remember_ids="1 hour")
    assert seen == [(0, True, ["a", "b"])] and not (tmp_path / "l/working/batch=1").exists()
    # a batch of refused documents stores nothing, and the next finds no table
    other = ingest.Layout(str(tmp_path / "o"))
    ingest.process_batch(lines("{"), 1, other, remember_ids="1 hour")
    ingest.process_batch(lines(entry(id="a")), 2, other, remember_ids="1 hour")
    assert [tuple(r) for r in ingest.read_ledger(spark, other).select("batch_id", "rows", "inserted", "failed").orderBy("batch_id").collect()] == [
        (1, 1, 0, 1), (2, 1, 1, 0)
    ]


def _run(spark, tmp_path, monkeypatch, name):
    events(spark, *range(20)).write.parquet(str(tmp_path / "in/events.parquet"))
    monkeypatch.setattr(Q, "_folder", lambda _, kind: str(tmp_path / kind))
    rows = contract.QUERIES[name](spark, str(tmp_path / "in")).collect()
    files = [f.name for f in (tmp_path / "incoming").glob("part-*")]
    return rows, files, ingest.read_ledger(spark, ingest.Layout(str(tmp_path / "ingested"))).orderBy("batch_id").collect()


def test_repeated_files_are_compressed(spark, tmp_path, monkeypatch):
    """One copy of the documents is a batch; their texts lay there as they are, dealt out by a shuffle of all of them."""
    rows, files, ledger = _run(spark, tmp_path, monkeypatch, "stream_ingest_dedupe")
    assert sum(r["n"] for r in rows) == 20
    assert files and all(f.endswith(".gz") for f in files)
    assert [(r["rows"], r["inserted"], r["failed"]) for r in ledger] == [(20, 20, 0), (20, 0, 0)]


def test_resent_files_and_rejects_are_compressed(spark, tmp_path, monkeypatch):
    """Both rounds lay their documents down compressed; refused documents, written whole, are compressed as well."""
    rows, files, ledger = _run(spark, tmp_path, monkeypatch, "resend_after_reject")
    found = {(r["what"], r["day"]): r["n"] for r in rows}
    assert found == {("accepted", "2024-01-05"): 20, ("rejected", None): 4, ("ledger rows", None): 40, ("ledger inserted", None): 20}
    assert files and all(f.endswith(".gz") for f in files)
    refused = [f.name for f in (tmp_path / "ingested/rejects").glob("*/part-*")]
    assert refused and all(f.endswith(".json.gz") for f in refused)
    assert [(r["rows"], r["inserted"], r["failed"]) for r in ledger] == [(20, 16, 4), (20, 4, 0)]
