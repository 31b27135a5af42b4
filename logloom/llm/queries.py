"""The queries of the operators, and the SQL of those that SQL can express."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (
    collocations, decontaminate, exact_dedup, html_extract, line_dedup, minhash, mixing, secret_scan, sharding, spelling, suffix_dedup,
    token_count, toxicity,
)
from .common import Query

QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("op9_exact_dedup", r"""
WITH n AS (
  SELECT doc_id, length(coalesce(text, '')) AS points,
    regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm FROM documents),
w AS (
  SELECT doc_id, norm, count(*) OVER (PARTITION BY norm) AS group_size,
    first_value(doc_id) OVER (PARTITION BY norm ORDER BY points DESC, doc_id) AS keep_id FROM n)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(norm) AS text_sha256 FROM w
""")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return exact_dedup.exact_dedup(docs).drop("text")


# The mixture: shares of the domains, of the languages in a domain, of the sources in a language.
DOMAIN_WEIGHTS = {"web": 5, "news": 2, "forum": 1, "books": 2}
LANGUAGE_WEIGHTS = {"en": 6, "de": 2, "fr": 2, "es": 1}
MIX_SHARE, MIX_EPOCHS, MIX_SEED = 0.6, 3, 17


def _case(value: str, weights: dict[str, int]) -> str:
    return f"CASE {value} " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in weights.items()) + " ELSE 1 END"


def mix_levels(lang: str = "lang", source: str = "source") -> list[mixing.Level]:
    """Domain by the number in the source's name, language, source."""
    number = f"try_cast(regexp_extract({source}, '([0-9]+)$', 1) AS bigint)"
    domain = f"coalesce(element_at(array('web', 'news', 'forum', 'books'), cast({number} % 4 + 1 AS int)), 'other')"
    return [
        mixing.Level("domain", F.expr(domain), F.expr(_case(f"({domain})", DOMAIN_WEIGHTS))),
        mixing.Level("lang", F.col(lang), F.expr(_case(f"coalesce({lang}, '')", LANGUAGE_WEIGHTS))),
        mixing.Level("source", F.col(source), F.expr(f"coalesce(1 + {number} % 3, 1)")),
    ]


def _fill_sql(k: int, path: list[str], above: list[str], name: str) -> str:
    part = f"PARTITION BY {', '.join(above)}" if above else ""
    keys, budget = ", ".join(path), "budget" if above else "least(b.budget, b.reach)"
    source = f"JOIN q{k - 1} p USING ({', '.join(above)})" if above else "CROSS JOIN b"
    budget = "p.quota" if above else budget
    return f"""
n{k} AS (SELECT {keys}, sum(supply)::HUGEINT AS supply, max(w_{name})::HUGEINT AS weight FROM leaves GROUP BY {keys}),
m{k} AS (SELECT {', '.join(f'n.{c}' for c in path)}, n.supply, n.weight, {budget}::HUGEINT AS budget FROM n{k} n {source}),
s{k} AS (SELECT *, (budget - coalesce(sum(supply) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) * weight
    >= supply * sum(weight) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS sated
  FROM m{k} WINDOW o AS ({part} ORDER BY supply::DOUBLE / weight::DOUBLE, {name})),
r{k} AS (SELECT *, (budget - sum(CASE WHEN sated THEN supply ELSE 0 END) OVER ({part}))::HUGEINT AS rb,
    greatest(sum(CASE WHEN sated THEN 0 ELSE weight END) OVER ({part}), 1)::HUGEINT AS rw FROM s{k}),
e{k} AS (SELECT *, (rb * weight) // rw AS even, (rb * weight) % rw AS remainder FROM r{k}),
q{k} AS (SELECT {keys}, CASE WHEN sated THEN supply ELSE even +
    (row_number() OVER ({part} ORDER BY sated, remainder DESC, {name})
      <= rb - sum(CASE WHEN sated THEN 0 ELSE even END) OVER ({part}))::INT END AS quota FROM e{k}),"""


def mix_sql(docs: str = "documents", share: float = MIX_SHARE, epochs: int = MIX_EPOCHS) -> str:
    """The CTEs up to ``taken``: doc_id, domain, lang, source, tokens, n_epochs for the rows of ``docs``."""
    path = ["domain", "lang", "source"]
    fills = "".join(_fill_sql(k, path[: k + 1], path[:k], path[k]) for k in range(3))
    return rf"""
numbered AS (SELECT *, try_cast(regexp_extract(coalesce(source, ''), '([0-9]+)$', 1) AS BIGINT) AS number FROM {docs}),
tokened AS (SELECT doc_id, coalesce(source, '') AS source, coalesce(lang, '') AS lang,
    coalesce((['web', 'news', 'forum', 'books'])[number % 4 + 1], 'other') AS domain, coalesce(1 + number % 3, 1) AS w_source,
    len(regexp_extract_all(coalesce(text, ''), '[^ 	-
]+'))::BIGINT AS tokens FROM numbered),
leaves AS (SELECT domain, lang, source, sum(tokens) AS tokens, sum(tokens) * {epochs} AS supply, max(w_source) AS w_source,
    max({_case('domain', DOMAIN_WEIGHTS)}) AS w_domain, max({_case('lang', LANGUAGE_WEIGHTS)}) AS w_lang
  FROM tokened GROUP BY ALL),
b AS (SELECT floor(sum(tokens)::DOUBLE * {share})::HUGEINT AS budget, sum(supply)::HUGEINT AS reach FROM leaves),{fills}
goals AS (SELECT domain, lang, source, (quota // greatest(tokens, 1))::BIGINT AS full_, quota % greatest(tokens, 1) AS part
  FROM leaves JOIN q2 USING (domain, lang, source)),
keyed AS (SELECT t.*, g.full_, g.part, md5(concat_ws('|', '{MIX_SEED}', full_::VARCHAR, coalesce(doc_id::VARCHAR, ''))) AS k
  FROM tokened t JOIN goals g USING (domain, lang, source)),
taken AS (SELECT doc_id, domain, lang, source, tokens, (full_ + CASE WHEN part > 0 AND
    sum(tokens) OVER (PARTITION BY domain, lang, source ORDER BY k RANGE UNBOUNDED PRECEDING) <= part THEN 1 ELSE 0 END)::INT AS n_epochs
  FROM keyed)"""


@query("op1_source_mixing", f"WITH {mix_sql()} SELECT doc_id, domain, lang, source, tokens, n_epochs FROM taken")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    return mixing.mix_sources(docs, mix_levels(), MIX_SHARE, MIX_EPOCHS, MIX_SEED).drop("text")


@query("op2_toxicity")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    lexicon = toxicity.learn(docs, table(spark, sf_dir, "labels"))
    return toxicity.score_toxicity(docs, lexicon).drop("text")


@query("op3_html_extract")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    model = html_extract.learn(pages)
    return html_extract.extract_main_text(pages, model).select("page_id", "url", "text", "n_chars")


@query("op4_token_counts")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return token_count.count_tokens(docs, public_tokenizers.path("word_bpe_49k.json")).drop("text")


@query("op7_line_dedup", r"""
WITH lines AS (
  SELECT page_id, lower(coalesce(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:]+)', 1), '')) AS host,
    list_filter(list_transform(string_split(regexp_replace(regexp_replace(regexp_replace(regexp_replace(
      coalesce(html, ''), '(?is)<script.*?</script>', chr(10), 'g'), '(?is)<style.*?</style>', chr(10), 'g'),
      '(?s)<!--.*?-->', chr(10), 'g'), '<[^>]*>', chr(10), 'g'), chr(10)),
      lambda x: regexp_replace(x, '^[\x09-\x0D\x20]+|[\x09-\x0D\x20]+$', '', 'g')), lambda x: x <> '') AS lines
  FROM pages),
totals AS (SELECT host, count(*) AS host_pages FROM lines GROUP BY host),
common AS (
  SELECT host, line FROM (SELECT host, unnest(list_distinct(lines)) AS line FROM lines) JOIN totals USING (host)
  GROUP BY host, line HAVING count(*) >= 2 AND count(*) > 0.5 * any_value(host_pages)),
sites AS (SELECT host, list(line) AS common FROM common GROUP BY host),
kept AS (
  SELECT page_id, host, host_pages, lines,
    list_filter(lines, lambda x: NOT list_contains(coalesce(common, []), x)) AS kept
  FROM lines JOIN totals USING (host) LEFT JOIN sites USING (host))
SELECT page_id, host, host_pages, len(lines) AS n_lines, len(lines) - len(kept) AS n_dropped,
  array_to_string(kept, chr(10)) AS text FROM kept
""")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return line_dedup.line_dedup(
        pages, "page_id", line_dedup.host_of(F.col("url")), line_dedup.html_lines(F.col("html"))
    ).drop("url", "html")


@query("op5_sharding")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return sharding.shard_documents(docs).drop("text")


def contamination_sql(docs: str = "documents") -> str:
    """The CTEs up to ``judged``: one row for each document of ``docs``, by comparing all windows."""
    words = (r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), "
             r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')")
    return f"""
items AS (SELECT coalesce(item_id::VARCHAR, '') AS item, {words} AS w FROM benchmark),
windows AS (SELECT DISTINCT item, least(len(w), 13) AS n, array_to_string(w[s + 1 : s + least(len(w), 13)], ' ') AS k
  FROM (SELECT item, w, unnest(range(0, greatest(len(w) - 13, 0) + 1)) AS s FROM items WHERE len(w) > 0)),
texts AS (SELECT doc_id, {words} AS w FROM {docs}),
places AS (SELECT doc_id, n, s, array_to_string(w[s + 1 : s + n], ' ') AS k
  FROM (SELECT doc_id, w, n, unnest(range(0, len(w) - n + 1)) AS s FROM texts, (SELECT DISTINCT n FROM windows) WHERE len(w) >= n)),
hits AS (SELECT doc_id, s, n, item FROM places JOIN windows USING (n, k)),
covered AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + n)) AS p FROM hits) GROUP BY doc_id),
found AS (SELECT doc_id, count(DISTINCT item) AS n_items, string_agg(item, ',' ORDER BY item) AS ids
  FROM (SELECT DISTINCT doc_id, item FROM hits) GROUP BY doc_id),
judged AS (SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
    sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
  FROM texts LEFT JOIN covered USING (doc_id) LEFT JOIN found USING (doc_id))"""


@query("op6_decontaminate", f"WITH {contamination_sql()} SELECT * FROM judged")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark")).drop("text", "items")


@query("op10_minhash")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), columns=[])


@query("op8_suffix_dedup")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.suffix_dedup(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text", "kept")


@query("op11_spelling_variants")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.spelling_variants(table(spark, sf_dir, "documents"))


@query("op12_collocations", r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
texts AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
totals AS (SELECT lang, sum(len(w))::BIGINT AS n FROM texts GROUP BY lang),
places AS (SELECT lang, m, array_to_string(w[s : s + m - 1], ' ') AS phrase
  FROM (SELECT lang, w, m, unnest(range(1, len(w) - m + 2)) AS s FROM texts, range(1, 6) sizes(m) WHERE len(w) >= m)),
grams AS (SELECT lang, m, phrase, count(*) AS a FROM places GROUP BY ALL HAVING count(*) >= 100),
split AS (SELECT *, string_split(phrase, ' ') AS w FROM grams),
nested AS (SELECT DISTINCT lang, part FROM (
    SELECT lang, a, array_to_string(w[s : s + k - 1], ' ') AS part
    FROM (SELECT *, unnest(range(1, m - k + 2)) AS s FROM (SELECT *, unnest(range(2, m)) AS k FROM split WHERE m > 2))) longer
  JOIN grams g USING (lang) WHERE g.phrase = part AND 100 * longer.a >= 100 * g.a),
cuts AS (SELECT *, array_to_string(w[1 : k], ' ') AS first_part, array_to_string(w[k + 1 : m], ' ') AS rest
  FROM (SELECT *, unnest(range(1, m)) AS k FROM split WHERE m > 1 AND (lang, phrase) NOT IN (SELECT lang, part FROM nested))),
scored AS (SELECT c.lang, c.phrase, c.a, x.a AS l, y.a AS r, t.n, c.k,
    ((1000::HUGEINT * c.a * t.n) // (x.a::HUGEINT * y.a))::BIGINT AS score
  FROM cuts c JOIN totals t USING (lang) JOIN grams x ON x.lang = c.lang AND x.phrase = first_part
  JOIN grams y ON y.lang = c.lang AND y.phrase = rest),
best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
ranked AS (SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score FROM best)
SELECT * FROM ranked WHERE rank <= 2000
""")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"))


@query("op13_secret_scan")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    vocabulary = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return secret_scan.scan_secrets(docs, vocabulary, public_tokenizers.PATTERN).drop("text")
