"""Analysis, search, relevance, similarity and highlight."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logloom.functions import analysis, stemming
from logloom.operators import paging
from logloom.operators import postings as PO
from logloom.operators import search as S
from logloom.operators.filters import LogFilters, apply_filters
from logloom.plans import api
from logloom.session import checkpoint_dir
from logloom.sources.events import dealt_logs, load_documents, load_logs
from logloom.sources.synthetic import search_profile

from .registry import ORACLE, query
from .sql import TOKEN, corpus, iso, quote, stemmed_corpus, stems, with_logs

TEXT = S.TextField("text", stem=False)
STEMMED_TEXT = S.TextField("text")
SOURCE = S.TextField("source", keyword=True)
DOCS = corpus("documents", "doc_id", "text")


def _postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load_documents(spark, sf_dir)
    return docs.select("doc_id", F.posexplode(analysis.analyze("text", False)).alias("pos", "term"))


@query("tokens", f"WITH {DOCS} SELECT k AS doc_id, pos::BIGINT AS pos, term FROM postings")
def tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = _postings(spark, sf_dir).where(F.col("term").isNotNull())
    return kept.withColumn("pos", F.col("pos").cast("bigint"))


@query(
    "term_df",
    f"""WITH {DOCS} SELECT term, count(*) AS tf, count(DISTINCT k) AS df
    FROM postings GROUP BY 1""",
)
def term_df(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load_documents(spark, sf_dir)
    # each text gives its words as they stand, and every term once for the document frequency:
    # work in proportion to its length
    terms = analysis.present(analysis.analyze("text", False))
    # however few row groups the file has, all cores take part in the analysis
    per_text = docs.repartition("doc_id").select(terms.alias("terms")).select(
        F.inline(
            F.array(
                F.struct(F.col("terms"), F.lit(True).alias("word")),
                F.struct(F.array_distinct("terms").alias("terms"), F.lit(False).alias("word")),
            )
        )
    )
    counted = per_text.select("word", F.explode("terms").alias("term")).groupBy("term")
    return counted.agg(F.count_if("word").alias("tf"), F.count_if(~F.col("word")).alias("df"))


# -- stems -----------------------------------------------------------------------

@query(
    "stemmed_vocabulary",
    f"""WITH {DOCS}, vocabulary AS (SELECT DISTINCT term FROM postings), {stems('vocabulary')}
    SELECT term, stem FROM stems""",
)
def stemmed_vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    vocabulary = (
        _postings(spark, sf_dir).where(F.col("term").isNotNull()).select("term").distinct()
    )
    return vocabulary.select("term", stemming.stem(F.col("term")).alias("stem"))


# -- search ----------------------------------------------------------------------

_NORM = "1.2 * (0.25 + 0.75 * dl / avgdl)"


def _idf(n: str = "n", df: str = "df") -> str:
    return f"ln(1 + ({n} - {df} + 0.5) / ({df} + 0.5))"


def _exact_ctes(terms: list[str]) -> str:
    listed = ", ".join(map(quote, terms))
    return f"""
tf AS (SELECT k, term, count(*) AS tf FROM postings WHERE term IN ({listed}) GROUP BY 1, 2),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1),
scored AS (SELECT k, count(*) AS matched, sum({_idf()} * tf / (tf + {_NORM})) AS score
  FROM tf JOIN df USING (term) JOIN lengths USING (k) CROSS JOIN whole GROUP BY 1)""".strip()


def _scores(df: DataFrame, key: str = "doc_id") -> DataFrame:
    return df.select(key, F.round("score", 6).alias("score"))


WORDS = ["nd", "re"]


@query(
    "match_all_terms",
    f"""WITH {DOCS}, {_exact_ctes(WORDS)}
    SELECT k AS doc_id, round(score, 6) AS score FROM scored WHERE matched = 2""",
)
def match_all_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scores(S.match(load_documents(spark, sf_dir), "Nd the RE", TEXT))


@query(
    "match_any_term",
    f"""WITH {DOCS}, {_exact_ctes(['reth', 'anthe', 'pas', 'zzz'])}
    SELECT k AS doc_id, round(score, 6) AS score FROM scored""",
)
def match_any_term(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load_documents(spark, sf_dir)
    return _scores(S.match(docs, "reth anthe pas zzz", TEXT, operator="or"))


@query(
    "bm25_top",
    f"""WITH {DOCS}, {_exact_ctes(['de', 'reth', 'las'])}
    SELECT k AS doc_id, round(score, 6) AS score FROM scored
    ORDER BY scored.score DESC, k LIMIT 10""",
)
def bm25_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = S.match(load_documents(spark, sf_dir), "de reth las", TEXT, operator="or")
    return _scores(found.orderBy(*S.by_score(None, "doc_id")).limit(10))


def _phrase_ctes(slots: list[tuple[int, str]], slop: int) -> str:
    values = ", ".join(f"({i}, {p}, {quote(t)})" for i, (p, t) in enumerate(slots))
    weight = " + ".join(f"(SELECT {_idf()} FROM df CROSS JOIN whole WHERE term = {quote(t)})"
                        for _, t in slots)
    return f"""
slots AS (SELECT * FROM (VALUES {values}) AS v(slot, shift, term)),
df AS (SELECT term, count(DISTINCT k) AS df FROM postings JOIN slots USING (term) GROUP BY 1),
occ AS (SELECT k, slot, pos - shift AS spot FROM postings JOIN slots USING (term)),
lefts AS (SELECT DISTINCT k, spot AS a FROM occ),
nexts AS (SELECT k, a, slot, min(spot) AS b FROM lefts JOIN occ USING (k) WHERE spot >= a GROUP BY ALL),
windows AS (SELECT k, a, max(b) AS b FROM nexts GROUP BY 1, 2 HAVING count(*) = {len(slots)}),
minimal AS (SELECT k, b, max(a) AS a FROM windows GROUP BY 1, 2),
phrases AS (SELECT k, sum(1.0::DOUBLE / (1 + b - a)) AS f FROM minimal WHERE b - a <= {slop}
  GROUP BY 1),
scored AS (SELECT k, ({weight}) * f / (f + {_NORM}) AS score
  FROM phrases JOIN lengths USING (k) CROSS JOIN whole)""".strip()


@query(
    "phrase_exact",
    f"""WITH {DOCS}, {_phrase_ctes([(0, 'de'), (1, 'la')], 0)}
    SELECT k AS doc_id, round(score, 6) AS score FROM scored""",
)
def phrase_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scores(S.match_phrase(load_documents(spark, sf_dir), "de la", 0, TEXT))


@query(
    "phrase_slop",
    f"""WITH {DOCS}, {_phrase_ctes([(0, 'de'), (1, 'la'), (2, 'un')], 6)}
    SELECT k AS doc_id, round(score, 6) AS score FROM scored""",
)
def phrase_slop(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scores(S.match_phrase(load_documents(spark, sf_dir), "de la un", 6, TEXT))


def _edits(term: str) -> int:
    return 0 if len(term) <= 2 else 1 if len(term) <= 5 else 2


# The SQL function counts bytes, so each accented letter becomes one capital first;
# terms are in lower case.
_ACCENTED, _CAPITALS = "äöüßéèêëàâáçîïíìôóòûùúñœæ", "ABCDEFGHIJKLMNOPQRSTUVWXY"
_EDITS = (
    f"damerau_levenshtein(translate(term, '{_ACCENTED}', '{_CAPITALS}'), "
    f"translate(q, '{_ACCENTED}', '{_CAPITALS}'))"
)


def _fuzzy_ctes(terms: list[str], prefix: str = "", postings: str = "postings",
                lengths: str = "lengths", whole: str = "whole") -> str:
    values = ", ".join(f"({quote(t)}, {_edits(t)})" for t in terms)
    p = prefix
    return f"""
{p}q AS (SELECT * FROM (VALUES {values}) AS v(q, k_max)),
{p}tf AS (SELECT k, term, count(*) AS tf FROM {postings} GROUP BY 1, 2),
{p}df AS (SELECT term, count(*) AS df FROM {p}tf GROUP BY 1),
{p}near AS (SELECT q, term, df,
    1 - {_EDITS}::DOUBLE / least(length(term), length(q)) AS boost
  FROM {p}df, {p}q WHERE abs(length(term) - length(q)) <= k_max AND {_EDITS} <= k_max),
{p}ranked AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY boost DESC, term) AS rank
  FROM {p}near WHERE boost > 0),
{p}expanded AS (SELECT q, term, boost, rank, df, max(df) OVER (PARTITION BY q) AS most
  FROM {p}ranked),
{p}scored AS (SELECT k, sum(boost * {_idf(df='most')} * tf / (tf + {_NORM})) AS score
  FROM {p}tf JOIN {p}expanded USING (term) JOIN {lengths} USING (k) CROSS JOIN {whole}
  GROUP BY 1)""".strip()


FUZZY = ["tionhe", "reth", "anthe"]


@query(
    "fuzzy_terms",
    f"""WITH {DOCS}, {_fuzzy_ctes(sorted(FUZZY))}
    SELECT q AS word, term, round(boost, 6) AS boost, df, rank FROM expanded""",
)
def fuzzy_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = sorted(FUZZY)
    found = S.expansions(load_documents(spark, sf_dir), TEXT, asked)
    return found.select(
        F.element_at(F.array(*[F.lit(w) for w in asked]), F.col("q") + 1).alias("word"),
        "term",
        F.round("boost", 6).alias("boost"),
        "df",
        F.col("rank").cast("bigint").alias("rank"),
    )


def _keyword_ctes(query_text: str, source: str, key: str, column: str) -> str:
    return _fuzzy_ctes([query_text], "kw_", "kw_postings", "kw_lengths", "kw_whole"), f"""
kw_postings AS (SELECT {key} AS k, {column} AS term FROM {source} WHERE {column} IS NOT NULL),
kw_lengths AS (SELECT DISTINCT k, 1 AS dl FROM kw_postings),
kw_whole AS (SELECT count(*) AS n, 1.0::DOUBLE AS avgdl FROM kw_lengths)""".strip()


@query(
    "fuzzy_search",
    f"""WITH {DOCS}, {_fuzzy_ctes(sorted(FUZZY))}
    SELECT k AS doc_id, round(score, 6) AS score FROM scored""",
)
def fuzzy_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scores(S.multi_match(load_documents(spark, sf_dir), " ".join(FUZZY), [TEXT]))


@query(
    "fuzzy_search_common",
    f"""WITH {DOCS}, {_fuzzy_ctes(['thatin'])}
    SELECT k AS doc_id, round(score, 6) AS score FROM scored""",
)
def fuzzy_search_common(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A word that very many others are near to."""
    return _scores(S.multi_match(load_documents(spark, sf_dir), "thatin", [TEXT]))


_KW, _KW_BASE = _keyword_ctes("scr12", "documents", "doc_id", "source")


@query(
    "fuzzy_fields",
    f"""WITH {DOCS}, {_fuzzy_ctes(['scr12'])}, {_KW_BASE}, {_KW},
    best AS (SELECT k, score FROM scored UNION ALL SELECT k, score FROM kw_scored)
    SELECT k AS doc_id, round(max(score), 6) AS score FROM best GROUP BY 1""",
)
def fuzzy_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A text field and a keyword field; the better one counts."""
    return _scores(S.multi_match(load_documents(spark, sf_dir), "scr12", [TEXT, SOURCE]))


@query(
    "highlight",
    f"""WITH {DOCS}, {_exact_ctes(WORDS)},
    hits AS (SELECT k, score FROM scored WHERE matched = 2 ORDER BY score DESC, k LIMIT 10),
    pieces AS (SELECT doc_id, regexp_extract_all(text, '(?s){TOKEN}|.') AS parts
      FROM documents JOIN hits ON k = doc_id)
    SELECT doc_id, array_to_string(list_transform(parts, lambda p:
      CASE WHEN lower(p) IN ('nd', 're') THEN '<em>' || p || '</em>' ELSE p END), '')
      AS highlight FROM pieces""",
)
def highlight(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = " ".join(WORDS)
    found = S.match(load_documents(spark, sf_dir), asked, TEXT)
    page = found.orderBy(*S.by_score(None, "doc_id")).limit(10)
    return S.query_highlight(page, asked, TEXT).select(
        "doc_id", F.col("highlight.text").alias("highlight")
    )


def _like_sql(select: str, like: str) -> str:
    return f"""WITH {DOCS},
    mine AS (SELECT term, count(*) AS like_tf FROM postings WHERE k = {like} GROUP BY 1),
    tf AS (SELECT k, term, count(*) AS tf FROM postings JOIN mine USING (term) GROUP BY 1, 2),
    df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1),
    chosen AS (SELECT term, like_tf, df,
        like_tf * (1 + ln(((SELECT count(*) FROM documents) + 1.0) / (df + 1.0))) AS value
      FROM mine JOIN df USING (term) WHERE df >= 5 ORDER BY value DESC, term LIMIT 12),
    scored AS (SELECT k, count(*) AS matched, sum({_idf()} * tf / (tf + {_NORM})) AS score
      FROM tf JOIN chosen USING (term) JOIN lengths USING (k) CROSS JOIN whole
      WHERE k <> {like} GROUP BY 1)
    {select}"""


@query(
    "similar_terms",
    _like_sql("SELECT term, like_tf AS tf, df, round(value, 6) AS value FROM chosen", "3"),
)
def similar_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    told = S.similar_terms(load_documents(spark, sf_dir), F.lit(3), [TEXT], "doc_id", None)
    return told.select("term", F.col("tf").cast("bigint").alias("tf"), "df", F.round("value", 6).alias("value"))


@query(
    "more_like_this",
    _like_sql(
        """SELECT k AS doc_id, round(score, 6) AS score FROM scored
        WHERE matched >= greatest(1, floor((SELECT count(*) FROM chosen) * 0.3))""",
        "3",
    ),
)
def more_like_this(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load_documents(spark, sf_dir)
    return _scores(S.more_like_this(docs, F.lit(3), [TEXT], "doc_id", None))


# -- the log searches --------------------------------------------------------------

# The search profile as SQL: the record's number picks a phrase and its form.
_PHRASE_OF = "([" + ", ".join(
    map(quote, [
        "payment gateway timeout error",
        "user authentication successful",
        "order processing completed",
        "high latency detected",
        "inventory synchronization delayed",
    ])
) + "])[(event_id % 5)::INT + 1]"

SEARCHED = f"""
searched AS (SELECT * REPLACE (
    CASE WHEN event_id % 2 = 0 THEN {_PHRASE_OF}
         WHEN event_id % 5 = 0 THEN {_PHRASE_OF} || ' resolved after retry'
         WHEN event_id % 7 = 0 THEN regexp_replace({_PHRASE_OF}, ' ', ' near ') || ' detected'
         ELSE message END AS message,
    CASE WHEN event_id % 2 = 0 THEN list_append(tags, 'search-demo')
         WHEN event_id % 5 = 0 THEN list_concat(tags, ['search-demo', 'retry'])
         WHEN event_id % 7 = 0 THEN list_concat(tags, ['search-demo', 'near-match'])
         ELSE tags END AS tags) FROM logs)""".strip()


def _stemmed(prefix: str, column: str) -> str:
    return stemmed_corpus("searched", "event_id", column, prefix)


def _field(prefix: str, column: str, terms: list[str]) -> str:
    return _stemmed(prefix, column) + ",\n" + _fuzzy_ctes(
        terms, prefix, f"{prefix}postings", f"{prefix}lengths", f"{prefix}whole"
    )


def _search_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search_profile(load_logs(spark, sf_dir), F.col("id").cast("bigint"))


@query(
    "search_profile",
    with_logs("SELECT id, message, array_to_string(tags, ',') AS tags FROM searched", SEARCHED),
)
def search_profile_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    logs = _search_logs(spark, sf_dir)
    return logs.select("id", "message", F.array_join("tags", ",").alias("tags"))


@query(
    "match_query",
    with_logs(
        f"""SELECT k::VARCHAR AS id, round(score, 6) AS score, message, array_to_string(tags, ',')
          AS tags, '<em>payment</em> <em>gateway</em> <em>timeout</em> <em>error</em>'
          || replace(replace(message, 'payment gateway timeout error', ''), 'zzz', '') AS highlight
        FROM scored JOIN searched ON k = event_id WHERE matched = 4
        ORDER BY scored.score DESC, ts DESC, id LIMIT 5""",
        SEARCHED,
        _stemmed("", "message"),
        _exact_ctes(["payment", "gateway", "timeout", "error"]),
    ),
)
def match_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = "payment gateway timeout error"
    page = S.match(_search_logs(spark, sf_dir), asked).orderBy(*S.by_score()).limit(5)
    return S.query_highlight(page, asked).select(
        "id",
        F.round("score", 6).alias("score"),
        "message",
        F.array_join("tags", ",").alias("tags"),
        F.col("highlight.message").alias("highlight"),
    )


@query(
    "phrase_query",
    with_logs(
        """SELECT k::VARCHAR AS id, round(score, 6) AS score, message
        FROM scored JOIN searched ON k = event_id""",
        SEARCHED,
        _stemmed("", "message"),
        _phrase_ctes([(0, "inventori"), (1, "synchron"), (2, "delay")], 2),
    ),
)
def phrase_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = S.match_phrase(_search_logs(spark, sf_dir), "inventory synchronization delayed", 2)
    return found.select("id", F.round("score", 6).alias("score"), "message")


TYPO = "user authentikation succesful"
_TYPO_STEMS = ["authentik", "succes", "user"]
_TAG_BASE = """
kw_postings AS (SELECT DISTINCT event_id AS k, unnest(tags) AS term FROM searched),
kw_lengths AS (SELECT DISTINCT k, 1 AS dl FROM kw_postings),
kw_whole AS (SELECT count(DISTINCT k) AS n, count(*)::DOUBLE / count(DISTINCT k) AS avgdl
  FROM kw_postings)""".strip()


@query(
    "fuzzy_multi_match",
    with_logs(
        """SELECT k::VARCHAR AS id, round(max(score), 6) AS score
        FROM (SELECT k, score FROM scored UNION ALL SELECT k, score FROM kw_scored) GROUP BY 1""",
        SEARCHED,
        _field("", "message", _TYPO_STEMS),
        _TAG_BASE,
        _fuzzy_ctes([TYPO], "kw_", "kw_postings", "kw_lengths", "kw_whole"),
    ),
)
def fuzzy_multi_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = S.multi_match(_search_logs(spark, sf_dir), TYPO, [S.MESSAGE, S.TAGS])
    return _scores(found, "id")


API_QUERY = "databse connecton timout"
_API_STEMS = ["connecton", "databs", "timout"]
_API_FILTERS = LogFilters(environments=["production", "staging"], min_response_time=50)
_API_WHERE = "environment IN ('production', 'staging') AND response_time_ms >= 50"
_PATH_BASE = """
kw_postings AS (SELECT event_id AS k, request_path AS term FROM searched
  WHERE request_path IS NOT NULL),
kw_lengths AS (SELECT DISTINCT k, 1 AS dl FROM kw_postings),
kw_whole AS (SELECT count(*) AS n, 1.0::DOUBLE AS avgdl FROM kw_lengths)""".strip()
_API_FOUND = f"""found AS (SELECT k, max(score) AS score FROM (
    SELECT k, score FROM m_scored UNION ALL SELECT k, score FROM e_scored
    UNION ALL SELECT k, score FROM kw_scored) JOIN searched ON k = event_id
  WHERE {_API_WHERE} GROUP BY 1)"""


def _api_sql(select: str) -> str:
    return with_logs(
        select,
        SEARCHED,
        _field("m_", "message", _API_STEMS),
        _field("e_", "error_message", _API_STEMS),
        _PATH_BASE,
        _fuzzy_ctes([API_QUERY], "kw_", "kw_postings", "kw_lengths", "kw_whole"),
        _API_FOUND,
    )


@query(
    "search_logs",
    _api_sql(
        f"""SELECT id, {iso('ts')} AS timestamp, round(score, 6) AS score, message
        FROM found JOIN searched ON k = event_id
        ORDER BY round(found.score, 9) DESC, ts DESC, id LIMIT 20 OFFSET 5"""
    ),
)
def search_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    page = api.search_logs(_search_logs(spark, sf_dir), API_QUERY, _API_FILTERS, 20, 5)
    return page.rows.select(
        "id",
        F.date_format("timestamp", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'").alias("timestamp"),
        F.round("score", 6).alias("score"),
        "message",
    )


@query(
    "search_logs_info",
    _api_sql(
        """SELECT count(*) AS total, 25 < count(*) AS has_next_page, true AS has_previous_page
        FROM found"""
    ),
)
def search_logs_info(spark: SparkSession, sf_dir: str) -> DataFrame:
    return api.search_logs(_search_logs(spark, sf_dir), API_QUERY, _API_FILTERS, 20, 5).info


@query(
    "logs_with_text",
    _api_sql(
        f"""SELECT id, {iso('ts')} AS timestamp, message FROM found JOIN searched ON k = event_id
        ORDER BY ts DESC, id LIMIT 20"""
    ),
)
def logs_with_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    from dataclasses import replace

    asked = replace(_API_FILTERS, search_text=API_QUERY)
    return api.logs(_search_logs(spark, sf_dir), asked).rows.select(
        "id",
        F.date_format("timestamp", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'").alias("timestamp"),
        "message",
    )


@query(
    "log_aggregations",
    _api_sql(
        """SELECT section, key, value FROM (
        SELECT 'by_level' AS section, level AS key, count(*)::DOUBLE AS value
          FROM found JOIN searched ON k = event_id GROUP BY 2
        UNION ALL SELECT 'by_service', service, count(*)
          FROM found JOIN searched ON k = event_id GROUP BY 2
        UNION ALL SELECT 'time_series', strftime(d, '%Y-%m-%dT00:00:00.000Z'), count(day)
          FROM (SELECT unnest(range(min(day)::TIMESTAMP, max(day)::TIMESTAMP + INTERVAL 1 DAY, INTERVAL 1 DAY)) AS d
            FROM (SELECT ts::DATE AS day FROM found JOIN searched ON k = event_id))
          LEFT JOIN (SELECT ts::DATE AS day FROM found JOIN searched ON k = event_id) ON day = d GROUP BY 2
        UNION ALL SELECT 'total_logs', 'total', count(*) FROM found)"""
    ),
)
def log_aggregations(spark: SparkSession, sf_dir: str) -> DataFrame:
    from dataclasses import replace

    asked = replace(_API_FILTERS, search_text=API_QUERY)
    out = api.log_aggregations(_search_logs(spark, sf_dir), asked, "1d")
    return out.select("section", "key", "value")


_SIMILAR = """
postings AS (SELECT 0 AS f, k, term FROM m_postings UNION ALL SELECT 1, k, term FROM e_postings
  UNION ALL SELECT 2, event_id, error_type FROM logs WHERE error_type IS NOT NULL),
lengths AS (SELECT 0 AS f, k, dl FROM m_lengths UNION ALL SELECT 1, k, dl FROM e_lengths
  UNION ALL SELECT 2, event_id, 1 FROM logs WHERE error_type IS NOT NULL),
whole AS (SELECT f, count(*) AS n, avg(dl) AS avgdl FROM lengths GROUP BY 1),
mine AS (SELECT f, term, count(*) AS like_tf FROM postings WHERE k = 96 GROUP BY 1, 2),
tf AS (SELECT f, k, term, count(*) AS tf FROM postings JOIN mine USING (f, term) GROUP BY ALL),
df AS (SELECT f, term, count(*) AS df FROM tf GROUP BY 1, 2),
chosen AS (SELECT f, term, df, like_tf * (1 + ln(((SELECT count(*) FROM logs) + 1.0) / (df + 1.0))) AS value
  FROM mine JOIN df USING (f, term) WHERE df >= 5 ORDER BY value DESC, f, term LIMIT 12)""".strip()


@query(
    "similar_logs",
    with_logs(
        f"""SELECT k::VARCHAR AS id, message, round(score, 6) AS score FROM (
          SELECT k, count(*) AS matched, sum({_idf()} * tf / (tf + {_NORM})) AS score
          FROM tf JOIN chosen USING (f, term) JOIN lengths USING (f, k) JOIN whole USING (f)
          WHERE k <> 96 GROUP BY 1) JOIN logs ON k = event_id
        WHERE matched >= greatest(1, floor((SELECT count(*) FROM chosen) * 0.3))
        ORDER BY round(score, 9) DESC, id LIMIT 10""",
        stemmed_corpus("logs", "event_id", "message", "m_"),
        stemmed_corpus("logs", "event_id", "error_message", "e_"),
        _SIMILAR,
    ),
)
def similar_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = api.similar_logs(load_logs(spark, sf_dir), "96", 10)
    return found.select("id", "message", F.round("score", 6).alias("score"))


# -- the written search index -----------------------------------------------------------


def _index(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, PO.Index]:
    """The log table, and its postings written in two loads."""
    logs = search_profile(dealt_logs(spark, sf_dir), F.col("id").cast("bigint"))
    path = f"{checkpoint_dir(spark)}/index-{uuid.uuid4().hex}"
    for half in (0, 1):
        PO.write(logs.where(F.col("id").cast("bigint") % 2 == half), path, batch_id=half)
    return logs, PO.Index.read(spark, path)


@query("postings_match", ORACLE["match_query"])
def postings_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All terms of a query, by the postings of these terms; the page's records are looked up."""
    logs, index = _index(spark, sf_dir)
    asked = "payment gateway timeout error"
    page = PO.rows_of(logs, PO.page(PO.match(index, asked), 5), named=True)
    return S.query_highlight(page, asked).select(
        "id",
        F.round("score", 6).alias("score"),
        "message",
        F.array_join("tags", ",").alias("tags"),
        F.col("highlight.message").alias("highlight"),
    )


@query("postings_phrase", ORACLE["phrase_query"])
def postings_phrase(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A phrase by intersecting positions."""
    logs, index = _index(spark, sf_dir)
    found = PO.rows_of(logs, PO.match_phrase(index, "inventory synchronization delayed", 2))
    return found.select("id", F.round("score", 6).alias("score"), "message")


@query("postings_fuzzy", ORACLE["fuzzy_multi_match"])
def postings_fuzzy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Misspelt words, expanded by the remains of the vocabulary's words."""
    _, index = _index(spark, sf_dir)
    return PO.multi_match(index, TYPO, [S.MESSAGE, S.TAGS]).select("id", F.round("score", 6).alias("score"))


@query("postings_search", ORACLE["search_logs"])
def postings_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The search of the API within its filters, by the index."""
    logs, index = _index(spark, sf_dir)
    found = PO.rows_of(apply_filters(logs, _API_FILTERS), PO.multi_match(index, API_QUERY))
    rows = paging.page_rows(found, 20, 5, S.by_score())
    return rows.select(
        "id",
        F.date_format("timestamp", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'").alias("timestamp"),
        F.round("score", 6).alias("score"),
        "message",
    )
