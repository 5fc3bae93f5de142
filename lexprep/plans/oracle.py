"""DuckDB restatements of each query (the correctness oracle).

Each entry is plain SQL over the pre-registered views of the test tables.
The derived inputs are restated as CTEs with the same rules as
sources/fixtures.py. RE2 differs from Java regex (no lookaround, no
possessive loops, no backreferences), so patterns are restated, not
shared, where needed.
"""

from __future__ import annotations

import json

from lexprep import constants as C


def q(s: str) -> str:
    """SQL string literal."""
    return "'" + s.replace("'", "''") + "'"


def sql_list(items) -> str:
    return "[" + ", ".join(q(x) for x in items) + "]"


# -- derived inputs -----------------------------------------------------------

RESPONSES = f"""responses AS (
  SELECT event_id AS resp_id,
    CASE WHEN event_id % 97 = 0 THEN NULL
         WHEN user_id % 5 = 0 THEN {q(C.URL_STRIP_CHARS)} || CAST(user_id AS VARCHAR) || '/agravo'
         WHEN user_id % 11 = 0 THEN 'https://tj-sp.jusbrasil.com.br/processos/' || CAST(user_id AS VARCHAR)
         ELSE {q(C.URL_STRIP_CHARS)} || CAST(user_id + 100000 AS VARCHAR) || '/inteiro-teor-' || CAST(user_id AS VARCHAR)
    END AS url,
    CASE WHEN event_id % 101 = 0 THEN NULL
         WHEN event_type = 'signup' THEN {q(C.GRADES[0])}
         WHEN event_type = 'view' THEN {q(C.GRADES[1])}
         WHEN event_type = 'click' THEN {q(C.GRADES[2])}
         WHEN event_type = 'purchase' THEN {q(C.GRADES[3])}
         ELSE {q(C.GRADES[4])}
    END AS grade
  FROM events)"""

DECISIONS = """decisions AS (
  SELECT doc_id, lang AS corpus,
    CASE WHEN doc_id % 50 = 49 THEN NULL ELSE
      '<p>RECORRENTE: ' || source || '</p><table><tr>ADVOGADO ' || lang || '</tr></table><p>' || text || '</p>'
      || CASE WHEN doc_id % 3 = 0 THEN '<p>Lei 13.709/2018 (LGPD), Lei Geral de Proteção de Dados</p>' ELSE '' END
      || CASE WHEN doc_id % 4 = 0 THEN '<a href="http://www.jusbrasil.com.br/topicos/' || CAST(doc_id AS VARCHAR)
              || '/artigo-' || CAST(doc_id AS VARCHAR) || '-lei" title="Artigo ' || CAST(doc_id AS VARCHAR) || '">ver</a>'
              WHEN doc_id % 4 = 1 THEN '<a href="/outro">ver</a>' ELSE '' END
    END AS html
  FROM documents)"""

PREDICTIONS = """predictions AS (
  SELECT d.doc_id, d.source AS run_key, CAST(l.quality AS BIGINT) AS label,
    CAST(CASE WHEN d.n_chars % 3 = 0 THEN 0 ELSE 1 END AS BIGINT) AS prediction,
    CAST(d.n_chars % 101 AS DOUBLE) / 100 AS prob
  FROM documents d JOIN labels l ON d.doc_id = l.doc_id)"""

CV_SCORES = """cv_scores AS (
  SELECT CAST(label AS BIGINT) AS candidate, vec_id % 5 AS fold,
         CAST((vec_id * 7919) % 1000 AS DOUBLE) / 1000 AS score FROM embeddings)"""

ENTITIES = """entities AS (
  SELECT doc_id, regexp_extract_all(text, '[A-Z][a-z]{4,}') AS ents FROM documents)"""

LATEST = """latest AS (
  SELECT url, resp_id, grade FROM (
    SELECT *, row_number() OVER (PARTITION BY url ORDER BY resp_id DESC) AS rn FROM responses) WHERE rn = 1)"""


def decision_id_sql(u: str) -> str:
    t = f"trim({u}, {q(C.URL_STRIP_CHARS)})"
    item = (f"CASE WHEN contains({t}, {q(C.FULLTEXT_MARKER)}) THEN string_split({t}, {q(C.FULLTEXT_SPLIT)})[2] "
            f"ELSE string_split({t}, '/')[1] END")
    return f"CASE WHEN regexp_full_match({item}, '\\s*[+-]?[0-9]+\\s*') THEN TRY_CAST({item} AS BIGINT) END"


GRADED = f"""graded AS (
  SELECT resp_id, url, grade, {decision_id_sql('url')} AS doc_id,
    CAST(CASE WHEN grade IN ({', '.join(q(g) for g in C.RELEVANT_GRADES)}) THEN 1 ELSE 0 END AS BIGINT) AS label
  FROM latest WHERE url IS NOT NULL AND grade IS NOT NULL)"""

LABELLED = """labelled AS (
  SELECT g.resp_id, g.doc_id, g.grade, g.label, d.html
  FROM graded g JOIN decisions d ON g.doc_id = d.doc_id)"""


def with_(*ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n"


# -- text expressions (RE2) ---------------------------------------------------

WS = C.WS_RUN


def ws_tokens(x: str) -> str:
    return f"list_filter(regexp_split_to_array({x}, {q(WS)}), lambda t: t <> '')"


def remove_punct_sql(x: str) -> str:
    return f"translate({x}, {q(C.PUNCTUATION)}, {q(' ' * len(C.PUNCTUATION))})"


def clean_plain_sql(x: str, stop: list[str]) -> str:
    toks = ws_tokens(f"lower({remove_punct_sql(x)})")
    return (f"array_to_string(list_filter({toks}, lambda t: length(t) > 1 AND NOT list_contains({sql_list(stop)}, t)),"
            f" ' ')")


def _json_map_sql(d: dict) -> str:
    return f"CAST(json({q(json.dumps({str(k): v for k, v in d.items()}))}) AS MAP(VARCHAR, VARCHAR))"


CHARREF_RE2 = C.CHARREF.replace(r"\x00\x01", r"\x01")


def decode_ref_sql(r: str) -> str:
    """One reference (starting with '&') to its text."""
    s = f"substr({r}, 2)"
    digits = f"regexp_extract({s}, '^#[xX]?0*([0-9a-fA-F]*)', 1)"
    num = (f"(CASE WHEN length({digits}) > 12 THEN 1114112 WHEN length({digits}) = 0 THEN 0 "
           f"WHEN {s}[2:2] IN ('x', 'X') THEN TRY_CAST(('0x' || {digits}) AS BIGINT) "
           f"ELSE TRY_CAST({digits} AS BIGINT) END)")
    charref = f"{_json_map_sql(C.invalid_charrefs())}[CAST({num} AS VARCHAR)]"
    invalid = ", ".join(str(i) for i in C.invalid_codepoints())
    numeric = (f"coalesce({charref}, CASE WHEN ({num} BETWEEN 55296 AND 57343) OR {num} > 1114111 THEN chr(65533) "
               f"WHEN {num} IN ({invalid}) THEN '' ELSE chr(CAST({num} AS INTEGER)) END)")
    legacy = C.html_legacy_entities()
    lmap = _json_map_sql(legacy)
    prefixes = ", ".join(
        f"CASE WHEN length({s}) > {k} THEN {lmap}[{s}[1:{k}]] || {s}[{k + 1}:] END"
        for k in range(max(len(k) for k in legacy), 1, -1))
    named = f"coalesce({_json_map_sql(C.html_named_entities())}[{s}], {prefixes}, {r})"
    return f"(CASE WHEN starts_with({s}, '#') THEN {numeric} ELSE {named} END)"


def decode_entities_sql(x: str) -> str:
    refs = f"regexp_extract_all({x}, {q(CHARREF_RE2)})"
    parts = f"regexp_split_to_array({x}, {q(CHARREF_RE2)})"
    tail = f"array_to_string(list_transform({refs}, lambda r, i: {decode_ref_sql('r')} || {parts}[i + 1]), '')"
    return f"(CASE WHEN contains({x}, '&') THEN {parts}[1] || {tail} ELSE {x} END)"


def marked_sql(x: str) -> str:
    return decode_entities_sql(f"regexp_replace({x}, {q(C.MARKUP_RE2)}, chr(1), 'g')")


def html_text_sql(x: str) -> str:
    return f"replace({marked_sql(x)}, chr(1), '')"


def html_text_spaced_sql(x: str) -> str:
    return f"regexp_replace(trim({marked_sql(x)}, chr(1)), '\\x01+', ' ', 'g')"
