import duckdb
import pytest
from conftest import entry
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from logloom.functions import analysis, fuzzy
from logloom.functions.stemming import porter2, stem
from logloom.operators import search as S
from logloom.operators.filters import LogFilters
from logloom.plans import api
from logloom.sources.events import load_documents, load_logs

STEMS = """consigned consign|consistency consist|consolatory consolatori|conspicuously conspicu|
constables constabl|knackeries knackeri|knavish knavish|kneeling kneel|knightly knight|
knitted knit|knives knive|skies sky|dying die|news news|hopping hop|hoping hope|
relational relat|generously generous|generate generat|communism communism|ponies poni|ties tie|
cries cri|gas gas|gaps gap|this this|happy happi|by by|say say|enjoyed enjoy|youth youth|
proceed proceed|proceeding proceed|inning inning|john's john|ability abil|sensibly sensibl|
technology technolog|beautifully beauti|authentication authent|successful success|
synchronization synchron|latency latenc|inventory inventori|agreed agre|feed feed"""
PAIRS = [tuple(p.split()) for p in STEMS.replace("\n", "").split("|")]


def test_stems(spark):
    df = spark.createDataFrame(PAIRS, "word string, expected string")
    wrong = df.select("*", stem(F.col("word")).alias("got")).where("got <> expected").collect()
    assert wrong == []


def words(spark, text, **kw):
    df = spark.createDataFrame([(text,)], "t string")
    return df.select(analysis.tokenize("t").alias("w")).head()["w"]


@pytest.mark.parametrize(
    "text, expected",
    [
        ("It's node.js, v1.2 (3,000.5)!", ["it's", "node.js", "v1.2", "3,000.5"]),
        ("a_b __ --x-- a1.b", ["a_b", "x", "a1", "b"]),
        ("Über ÉCOLE", ["über", "école"]),
        ("end. of; line:", ["end", "of", "line"]),
        ("", []),
        ("x" * 300, ["x" * 255, "x" * 45]),
    ],
)
def test_words(spark, text, expected):
    assert words(spark, text) == expected
    df = spark.createDataFrame([(text,)], "t string")
    terms = df.select(analysis.analyze("t").alias("w")).head()["w"]
    assert len(terms) == len(expected)


def test_positions_keep_the_gaps(spark):
    df = spark.createDataFrame([("the user is in the house",), (None,)], "t string")
    got = [r["w"] for r in df.select(analysis.analyze("t").alias("w")).collect()]
    assert got == [[None, "user", None, None, None, "hous"], None]


def test_long_texts_are_read_whole(spark):
    text = "word " * 50_000 + "needle " + "1,2,3," * 20_000 + " 9"
    df = spark.createDataFrame([(1, text), (2, "word word")], "id int, text string")
    found = S.match(df, "needles", S.TextField("text")).select("id").collect()
    assert [r["id"] for r in found] == [1]


def test_highlight(spark):
    df = spark.createDataFrame([("Timeouts: the payment-gateway TIMED out",)], "t string")
    terms = F.array(F.lit("timeout"), F.lit("gateway"))
    got = df.select(analysis.highlight("t", terms).alias("h")).head()["h"]
    assert got == "<em>Timeouts</em>: the payment-<em>gateway</em> TIMED out"


LETTERS = st.text(alphabet="abcd", min_size=1, max_size=8)


@settings(max_examples=15, deadline=None, suppress_health_check=list(HealthCheck))
@given(LETTERS, st.lists(LETTERS, min_size=1, max_size=40))
def test_edit_distance(spark, word, others):
    others = sorted(set(others) | {word})
    df = spark.createDataFrame([(o,) for o in others], "t string")
    for k in (0, 1, 2):
        got = df.select("t", fuzzy.edit_distance(F.col("t"), word, k).alias("d")).collect()
        for row in got:
            true = duckdb.execute("SELECT damerau_levenshtein(?, ?)", [row["t"], word]).fetchone()[0]
            assert row["d"] == (true if true <= k else None)


def test_allowed_edits():
    assert [fuzzy.allowed_edits("x" * n) for n in (1, 2, 3, 5, 6, 20)] == [0, 0, 1, 1, 2, 2]


def found(df):
    return sorted(r["id"] for r in df.select("id").collect())


@pytest.fixture(scope="module")
def messages(logs):
    texts = {
        "a": "inventory synchronization delayed",
        "b": "inventory near synchronization delayed detected",
        "c": "inventory a b c synchronization delayed",
        "d": "synchronization inventory delayed",
        "e": "user authentication successful",
        "f": "the payment gateway reported errors after a timeout",
    }
    return logs(*[entry(id=k, message=v, tags=[k]) for k, v in texts.items()]).cache()


def test_match(messages):
    assert found(S.match(messages, "Payment gateway timeouts error")) == ["f"]
    assert found(S.match(messages, "payment inventory")) == []
    assert found(S.match(messages, "payment inventory", operator="or")) == ["a", "b", "c", "d", "f"]
    assert found(S.match(messages, "the of")) == []


@pytest.mark.parametrize(
    "slop, expected", [(0, ["a"]), (1, ["a", "b"]), (2, ["a", "b", "d"]), (3, ["a", "b", "c", "d"])]
)
def test_phrase_slop(messages, slop, expected):
    assert found(S.match_phrase(messages, "inventory synchronization delayed", slop)) == expected


def test_phrase_with_a_repeated_word(logs):
    rows = logs(entry(id="1", message="retry later"), entry(id="2", message="retry retry later"))
    assert found(S.match_phrase(rows, "retry retry", 2)) == ["2"]


def test_fuzzy(messages):
    asked = "user authentikation succesful"
    assert found(S.multi_match(messages, asked, [S.MESSAGE, S.TAGS])) == ["e"]
    hit = api.search_logs(messages, asked).rows.head()
    assert hit["highlight"]["message"] == "<em>user</em> <em>authentication</em> <em>successful</em>"


def test_keyword_fields_take_the_whole_value(logs):
    rows = logs(entry(id="1", message="x", tags=["search-demo"]), entry(id="2", message="y", tags=["demo"]))
    assert found(S.multi_match(rows, "serch-demo", [S.TAGS])) == ["1"]


def test_search_within_filters(logs):
    rows = logs(
        entry(id="1", message="disk failure", level="error"), entry(id="2", message="disk failure"),
        entry(id="3", message="all fine", level="error"),
    )
    page = api.search_logs(rows, "disc", LogFilters(levels=["error"]))
    assert [r["id"] for r in page.rows.collect()] == ["1"]
    assert page.info.head()["total"] == 1
    every = api.search_logs(rows, "", LogFilters(levels=["error"]))
    assert found(every.rows) == ["1", "3"]
    assert found(api.logs(rows, LogFilters(search_text="disc")).rows) == ["1", "2"]
    series = api.log_aggregations(rows, LogFilters(search_text="disc"), "1h")
    assert series.where("section = 'total_logs'").head()["value"] == 2.0


def test_similar(logs):
    same = [entry(id=f"s{i}", message="disk quota exceeded on volume") for i in range(6)]
    rest = [entry(id=f"r{i}", message="request served from cache") for i in range(6)]
    rows = logs(*same, *rest, entry(id="s0", timestamp="2023-01-01T00:00:00Z", message="other"))
    got = api.similar_logs(rows, "s0", 3).collect()
    assert [r["id"] for r in got] == ["s1", "s2", "s3"]
    assert api.similar_logs(rows, "nobody").count() == 0


def test_stored_terms_give_the_same_result(spark, sf_dir, tmp_path):
    logs = load_logs(spark, sf_dir)
    S.store_terms(logs).write.parquet(str(tmp_path / "t"))
    stored = spark.read.parquet(str(tmp_path / "t"))
    for query in (
        lambda d: S.match(d, "database timeouts"),
        lambda d: S.match_phrase(d, "connection database", 3),
        lambda d: S.multi_match(d, "databse timeot"),
        lambda d: S.more_like_this(d, "96"),
    ):
        def plain(d):
            return sorted((r["id"], round(r["score"], 9)) for r in query(d).select("id", "score").collect())

        assert plain(stored) == plain(logs) != []
    plan = S.match(stored, "database")._jdf.queryExecution().executedPlan().toString()
    assert "ArrowEvalPython" not in plan


def test_raw_text_test_never_loses_a_word(spark, sf_dir):
    """The cheap test before the analysis passes every word with the stem."""
    docs = load_documents(spark, sf_dir)
    vocabulary = docs.select(F.explode(analysis.tokenize("text")).alias("w")).distinct()
    for row in vocabulary.collect():
        word, term = row["w"], porter2(row["w"])
        part = term[: max(1, len(term) - 2)]
        assert any(c in part for c in "'’‘＇") or part in word, (word, term)
    for word, term in PAIRS:
        assert term[: max(1, len(term) - 2)] in word


def test_searches_move_no_text(spark, sf_dir):
    docs = load_documents(spark, sf_dir)
    field = S.TextField("text", stem=False)
    plan = S.match(docs, "reth anthe", field)._jdf.queryExecution().executedPlan().toString()
    main = plan.split("Subquery")[0]
    assert "Join" not in plan and "Exchange hashpartitioning" not in main
