"""SQL building blocks of the oracle: the log view and the text corpus."""

from __future__ import annotations

from logloom import schema as S
from logloom.functions import stemming


def quote(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def sql_list(values: list[str]) -> str:
    return "[" + ", ".join(quote(v) for v in values) + "]"


def pick(values: list[str], index: str) -> str:
    return f"({sql_list(values)})[(({index}) % {len(values)})::INT + 1]"


def by_weight(values: list[str], weights: list[int], point: str) -> str:
    out, upper = "CASE", 0
    for value, weight in zip(values[:-1], weights):
        upper += weight
        out += f" WHEN {point} < {upper} THEN {quote(value)}"
    return out + f" ELSE {quote(values[-1])} END"


def by_key(key: str, options: dict[str, list[str]], index: str, default: str | None = None) -> str:
    out = "CASE"
    for name, values in options.items():
        out += f" WHEN {key} = {quote(name)} THEN {pick(values, index)}"
    return out + (f" ELSE {quote(default)}" if default else "") + " END"


def iso(ts: str) -> str:
    return f"strftime({ts}, '%Y-%m-%dT%H:%M:%S.%gZ')"


def iso_ms(ms: str) -> str:
    return iso(f"epoch_ms(({ms})::BIGINT)")


_H = "(event_id // 100)"
LOGS = f"""
base AS (
  SELECT *, {by_weight(S.SERVICES, S.SERVICE_WEIGHTS, '(user_id % 100)')} AS service,
    {by_weight(S.LEVELS, S.LEVEL_WEIGHTS, '(event_id % 100)')} AS level,
    {pick(S.ERROR_TYPES, 'event_id')} AS any_type
  FROM events),
logs AS (
  SELECT event_id, user_id, value, props, event_type, event_id::VARCHAR AS id, ts, service, level,
    CASE WHEN {_H} % 10 < 7 THEN 'production' WHEN {_H} % 10 < 9 THEN 'staging'
         ELSE 'development' END AS environment,
    concat_ws('.', 1 + event_id % 3, event_id % 10, event_id % 21) AS version,
    CASE event_type WHEN 'click' THEN 'application' WHEN 'signup' THEN 'security'
         WHEN 'purchase' THEN 'performance' WHEN 'view' THEN 'audit'
         WHEN 'error' THEN 'system' END AS category,
    replace({by_key('level', S.MESSAGES, _H)}, '{{service}}', service) AS message,
    level IN ('error', 'fatal') AS critical,
    CASE WHEN level IN ('error', 'fatal') THEN any_type END AS error_type,
    CASE WHEN level IN ('error', 'fatal')
         THEN {by_key('any_type', S.ERROR_MESSAGES, _H)} END AS error_message,
    CASE WHEN level IN ('error', 'fatal')
         THEN upper(any_type[1:2]) || '_' || (1000 + event_id % 9000) END AS error_code,
    CASE WHEN event_id % 5 <> 0
         THEN {by_key('service', S.API_PATHS, 'event_id', S.DEFAULT_API_PATH)} END AS request_path,
    CASE WHEN event_id % 5 <> 0 THEN (50 + floor(value * 20))::INT END AS duration_ms,
    CASE WHEN service = 'payment-service' AND event_id % 10 < 7
         THEN value::DECIMAL(18, 2) END AS amount,
    regexp_extract(props, '(\\d+)', 1)::DOUBLE AS cpu_usage,
    (128 + (event_id * 7919) % 1921)::INT AS memory_mb,
    (10 + floor(value * 10))::INT AS response_time_ms,
    (5 + event_id % 496)::INT AS db_query_time_ms,
    list_concat([service],
      CASE WHEN level IN ('error', 'fatal') THEN ['critical'] ELSE [] END,
      CASE WHEN event_id % 10 < 3 THEN ['monitoring'] ELSE [] END) AS tags,
    {pick(S.COUNTRIES, 'user_id')} AS country,
    {pick(S.CITIES, 'user_id')} AS city,
    (user_id % 181 - 90)::DOUBLE AS lat, (user_id * 7 % 361 - 180)::DOUBLE AS lon
  FROM base)"""


def with_logs(body: str, *ctes: str) -> str:
    return "WITH " + ",\n".join([LOGS.strip(), *ctes]) + "\n" + body


_L = r"\p{L}(?:\p{M}*[.:''’‘·]\p{L})*\p{M}*"
_N = r"\p{N}(?:[.,;''’‘]\p{N})*"
TOKEN = rf"(?:{_L}|{_N}|[_\p{{M}}])+"
STOP = ("a an and are as at be but by for if in into is it no not of on or such that the "
        "their then there these they this to was will with").split()


def words(text: str) -> str:
    """List of the words of a text."""
    return (
        f"list_filter(regexp_extract_all(lower({text}), '{TOKEN}'), "
        r"lambda t: regexp_matches(t, '[\p{L}\p{N}]'))"
    )


def _measures(p: str) -> str:
    return f"""{p}lengths AS (SELECT k, count(*) AS dl FROM {p}postings GROUP BY k),
{p}whole AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM {p}lengths)"""


def _tokens(p: str, source: str, key: str, text: str) -> str:
    return f"""{p}tokens AS (SELECT {key} AS k, unnest({words(text)}) AS term,
    generate_subscripts({words(text)}, 1) - 1 AS pos FROM {source})"""


_NOT_STOP = f"term NOT IN ({', '.join(map(quote, STOP))})"


def corpus(source: str, key: str, text: str, p: str = "") -> str:
    """CTEs ``postings(k, pos, term)``, ``lengths(k, dl)`` and ``whole(n, avgdl)``."""
    return f"""{_tokens(p, source, key, text)},
{p}postings AS (SELECT * FROM {p}tokens WHERE {_NOT_STOP}),
{_measures(p)}"""


def stemmed_corpus(source: str, key: str, text: str, p: str = "") -> str:
    """The same with stems for terms."""
    return f"""{_tokens(p, source, key, text)},
{p}raw AS (SELECT * FROM {p}tokens WHERE {_NOT_STOP}),
{p}vocabulary AS (SELECT DISTINCT term FROM {p}raw),
{stems(f'{p}vocabulary', p)},
{p}postings AS (SELECT k, pos, stem AS term FROM {p}raw JOIN {p}stems USING (term)),
{_measures(p)}"""


_SHORT = "(?:[^aeiouy][aeiouy][^aeiouywxY]|^[aeiouy][^aeiouy])$"
_REGION = "[^aeiouy]*[aeiouy]+[^aeiouy]"


def _case(column: str, table: dict[str, str]) -> str:
    whens = " ".join(f"WHEN {quote(k)} THEN {quote(v)}" for k, v in table.items())
    return f"CASE {column} {whens} END"


def _in(column: str, values) -> str:
    return f"{column} IN ({', '.join(map(quote, values))})"


def _ending(suffixes) -> str:
    """The longest of the suffixes ``w`` ends in, or an empty string."""
    by_length = sorted(suffixes, key=len, reverse=True)
    return "CASE " + " ".join(
        f"WHEN ends_with(w, {quote(x)}) THEN {quote(x)}" for x in by_length
    ) + " ELSE '' END"


# The suffix tables of the published Porter2 rules, written out here so that the SQL does not
# share them with the code it checks.
_AFTER_1A = "inning outing canning herring earring proceed exceed succeed".split()
_STEP2 = {
    "ization": "ize", "ational": "ate", "fulness": "ful", "ousness": "ous", "iveness": "ive",
    "tional": "tion", "biliti": "ble", "lessli": "less", "entli": "ent", "ation": "ate",
    "alism": "al", "aliti": "al", "ousli": "ous", "iviti": "ive", "fulli": "ful", "enci": "ence",
    "anci": "ance", "abli": "able", "izer": "ize", "ator": "ate", "alli": "al", "bli": "ble",
    "ogi": "og", "li": "",
}
_STEP3 = {
    "ational": "ate", "tional": "tion", "alize": "al", "icate": "ic", "iciti": "ic", "ative": "",
    "ical": "ic", "ness": "", "ful": "",
}
_STEP4 = "ement ance ence able ible ment ant ent ism ate iti ous ive ize ion al er ic".split()
_WHOLE_WORDS = {
    "skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl",
    "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl",
    "sky": "sky", "news": "news", "howe": "howe", "atlas": "atlas", "cosmos": "cosmos",
    "bias": "bias", "andes": "andes",
}


def stems(vocabulary: str, p: str = "") -> str:
    """CTEs that end in ``stems(term, stem)`` for a vocabulary of distinct terms."""
    cut = "w[:length(w) - length(e)]"
    return f"""
{p}s0 AS (SELECT term, CASE WHEN regexp_replace(regexp_replace(term, '[’‘＇]', '''', 'g'),
         '^''|''s''$|''s$|''$', '', 'g') = '' THEN term
       ELSE regexp_replace(regexp_replace(term, '[’‘＇]', '''', 'g'),
         '^''|''s''$|''s$|''$', '', 'g') END AS w FROM {vocabulary}),
{p}s1 AS (SELECT term, regexp_replace(regexp_replace(w, '^y', 'Y'), '([aeiouy])y', '\\1Y', 'g') AS w
  FROM {p}s0),
{p}s2 AS (SELECT *, length(regexp_extract(w, '^(?:gener|commun|arsen|{_REGION})')) AS h FROM {p}s1),
{p}s3 AS (SELECT term, w, CASE WHEN h > 0 THEN h ELSE length(w) END AS r1 FROM {p}s2),
{p}s4 AS (SELECT *, length(regexp_extract(w[r1 + 1:], '^{_REGION}')) AS h FROM {p}s3),
{p}s5 AS (SELECT term, w, r1, CASE WHEN h > 0 THEN r1 + h ELSE length(w) END AS r2 FROM {p}s4),
{p}s6 AS (SELECT term, r1, r2, CASE WHEN ends_with(w, 'sses') THEN w[:-3]
    WHEN ends_with(w, 'ied') OR ends_with(w, 'ies')
      THEN CASE WHEN length(w) > 4 THEN w[:-3] ELSE w[:-2] END
    WHEN ends_with(w, 'us') OR ends_with(w, 'ss') THEN w
    WHEN regexp_matches(w, '[aeiouy].+s$') THEN w[:-2] ELSE w END AS w FROM {p}s5),
{p}s7 AS (SELECT *, {_in('w', _AFTER_1A)} AS done,
    {_ending(['eedly', 'ingly', 'edly', 'eed', 'ing', 'ed'])} AS e FROM {p}s6),
{p}s8 AS (SELECT term, r1, r2, done, e NOT IN ('', 'eed', 'eedly') AND NOT done
      AND regexp_matches({cut}, '[aeiouy]') AS removed,
    CASE WHEN done THEN w WHEN e IN ('eed', 'eedly')
      THEN CASE WHEN length(w) - length(e) >= r1 THEN {cut} || 'ee' ELSE w END
    WHEN e <> '' AND regexp_matches({cut}, '[aeiouy]') THEN {cut} ELSE w END AS w FROM {p}s7),
{p}s9 AS (SELECT term, r1, r2, done, CASE WHEN NOT removed THEN w
    WHEN regexp_matches(w, '(at|bl|iz)$') THEN w || 'e'
    WHEN regexp_matches(w, '(bb|dd|ff|gg|mm|nn|pp|rr|tt)$') THEN w[:-2]
    WHEN length(w) <= r1 AND regexp_matches(w, '{_SHORT}') THEN w || 'e' ELSE w END AS w FROM {p}s8),
{p}s10 AS (SELECT term, r1, r2, done, CASE WHEN NOT done AND regexp_matches(w, '^.+[^aeiouy][yY]$')
    THEN w[:-2] || 'i' ELSE w END AS w FROM {p}s9),
{p}s11 AS (SELECT *, {_ending(_STEP2)} AS e FROM {p}s10),
{p}s12 AS (SELECT term, r1, r2, done, CASE WHEN done OR e = '' OR length(w) - length(e) < r1 THEN w
    WHEN e = 'ogi' AND NOT ends_with({cut}, 'l') THEN w
    WHEN e = 'li' AND NOT regexp_matches({cut}, '[cdeghkmnrt]$') THEN w
    ELSE {cut} || {_case('e', _STEP2)} END AS w FROM {p}s11),
{p}s13 AS (SELECT *, {_ending(_STEP3)} AS e FROM {p}s12),
{p}s14 AS (SELECT term, r1, r2, done, CASE WHEN done OR e = ''
      OR length(w) - length(e) < CASE e WHEN 'ative' THEN r2 ELSE r1 END THEN w
    ELSE {cut} || {_case('e', _STEP3)} END AS w FROM {p}s13),
{p}s15 AS (SELECT *, {_ending(_STEP4)} AS e FROM {p}s14),
{p}s16 AS (SELECT term, r1, r2, done, CASE WHEN done OR e = '' OR length(w) - length(e) < r2 THEN w
    WHEN e = 'ion' AND NOT regexp_matches({cut}, '[st]$') THEN w ELSE {cut} END AS w FROM {p}s15),
{p}s17 AS (SELECT term, CASE WHEN done THEN w
    WHEN ends_with(w, 'e') THEN CASE WHEN length(w) - 1 >= r2 OR (length(w) - 1 >= r1
      AND NOT regexp_matches(w[:-2], '{_SHORT}')) THEN w[:-2] ELSE w END
    WHEN ends_with(w, 'll') AND length(w) - 1 >= r2 THEN w[:-2] ELSE w END AS w FROM {p}s16),
{p}stems AS (SELECT term, CASE WHEN length(term) <= 2 THEN term
    WHEN {_in('term', _WHOLE_WORDS)} THEN {_case('term', _WHOLE_WORDS)}
    ELSE replace(w, 'Y', 'y') END AS stem FROM {p}s17)""".strip()
