"""The same queries as plain SQL, for checking on an independent engine.

Written from the operators' definitions: relational joins and windows instead of
array expressions, one recursive query where verdicts make pages depend on each
other.
"""

from __future__ import annotations

from pagebundle import fixed
from pagebundle.sources.adapters import TRIAL_PATTERNS, TRIAL_TYPES

ORACLE: dict[str, str] = {}


def _q(text: str | None) -> str:
    return "NULL" if text is None else "'" + text.replace("'", "''") + "'"


# --- building blocks --------------------------------------------------------------------------

def _norm(x: str) -> str:
    ascii_only = (
        f"regexp_replace(strip_accents(replace(replace({x},'ł','l'),'Ł','L')),"
        r"'[^\x00-\x7F]','','g')"
    )
    return rf"trim(regexp_replace(upper({ascii_only}),'[ \t\n\x0B\f\r\x1c-\x1f]+',' ','g'))"


def _fold(x: str) -> str:
    return f"translate({x},'{fixed.OCR_DIGITS}','{fixed.OCR_LETTERS}')"


def _alnum(x: str) -> str:
    return rf"length(regexp_replace({x},'[^\p{{L}}\p{{N}}]','','g'))"


_LINES = r"""
pg AS (
  SELECT doc_id AS bundle_id, unnest(range(1, len(parts) + 1))::INTEGER AS page_number,
         unnest(parts) AS text
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents))"""

_TURNS = """
pg AS (SELECT conv_id AS bundle_id, (turn + 1)::INTEGER AS page_number,
              coalesce(text, '') AS text FROM conversations)"""

_BLANKED = _LINES.replace("pg AS", "full_pg AS") + """,
pg AS (SELECT bundle_id, page_number,
              CASE WHEN (bundle_id * 7 + page_number) % 5 = 0 THEN '' ELSE text END AS text
       FROM full_pg)"""


def _ink(source: str) -> str:
    return f"""
hist AS (
  SELECT bundle_id, page_number, level, pixels FROM (
    SELECT bundle_id, page_number, unnest([40, 200, 230, 255]) AS level,
      unnest([CASE WHEN (bundle_id + page_number) % 2 = 0 THEN (page_number % 3) * 50
                   ELSE 900 + page_number END,
              page_number % 7, 500, 99000]) AS pixels
    FROM {source} WHERE page_number % 11 <> 0)),
ink AS (
  SELECT bundle_id, page_number,
         CASE WHEN sum(pixels) > 0
              THEN sum(CASE WHEN level <= 200 THEN pixels ELSE 0 END)::DOUBLE / sum(pixels)
              ELSE 0.0::DOUBLE END AS ink_ratio
  FROM hist GROUP BY ALL)"""


_OCR = """
ocr AS (
  SELECT p.bundle_id, p.page_number,
         CASE WHEN (p.bundle_id + p.page_number) % 3 = 0 THEN '' ELSE b.text END AS ocr_text
  FROM pg p JOIN benchmark b
    ON b.item_id = (p.bundle_id + p.page_number) % (SELECT count(*) FROM benchmark)
  WHERE p.text = '')"""

_READS = _BLANKED + "," + _ink("pg") + "," + _OCR + f""",
flagged AS (
  SELECT p.*, {_alnum('p.text')} < 25 AS candidate,
         {_alnum('p.text')} < 25 AND coalesce(i.ink_ratio <= 0.002::DOUBLE, FALSE) AS blank,
         coalesce(o.ocr_text, '') AS ocr_text
  FROM pg p LEFT JOIN ink i USING (bundle_id, page_number)
            LEFT JOIN ocr o USING (bundle_id, page_number)),
merged AS (
  SELECT *, candidate AND NOT blank AND {_alnum('ocr_text')} > {_alnum('text')} AS filled
  FROM flagged),
rd AS (
  SELECT bundle_id, page_number, CASE WHEN filled THEN ocr_text ELSE text END AS text, blank
  FROM merged)"""


def _values(rows: list[str], name: str, columns: str) -> str:
    return f"{name}({columns}) AS (VALUES " + ", ".join(rows) + ")"


_DICTIONARY = (
    _values(
        [
            f"({i}, {_q(t)}, {_q(h)}, {w}::DOUBLE)"
            for i, t, h, _, _, w, active in TRIAL_PATTERNS if active
        ],
        "raw_dict", "idx, dtype, header, weight",
    )
    + ",\n"
    + f"dict AS (SELECT *, {_fold(_norm('header'))} AS hfold FROM raw_dict "
    + f"WHERE {_norm('header')} <> ''),\n"
    + _values(
        [
            f"({i}, {pos}, {_q(p)})"
            for i, _, _, phrases, _, _, active in TRIAL_PATTERNS if active
            for pos, p in enumerate(phrases)
        ],
        "raw_phr", "idx, pos, phrase",
    )
    + ",\n"
    + f"phr AS (SELECT r.*, {_norm('phrase')} AS nphrase FROM raw_phr r "
    + "SEMI JOIN dict USING (idx)),\n"
    + _values(
        [
            f"({i}, {_q(p)})"
            for i, _, _, _, excluded, _, active in TRIAL_PATTERNS if active for p in excluded
        ],
        "raw_exc", "idx, phrase",
    )
    + f",\nexc AS (SELECT idx, {_norm('phrase')} AS nphrase FROM raw_exc)"
)


def _rules(source: str, tenant: bool = False) -> str:
    """np, sc (scores), hits, cls (classification), aff (ordered affinities)."""
    dict_cols = ", dict_id" if tenant else ""
    on_dict = "AND d.idx >= np.first_idx" if tenant else ""
    return f"""
np AS (SELECT *, {_norm('text')} AS norm FROM {source}),
zoned AS (SELECT *, {_fold('substring(norm, 1, 1200)')} AS zone FROM np),
ex AS (SELECT DISTINCT np.bundle_id, np.page_number, e.idx
       FROM np JOIN exc e ON contains(np.norm, e.nphrase)),
hits AS (SELECT np.bundle_id, np.page_number, d.idx, d.dtype, p.pos, p.phrase
         FROM np JOIN phr p ON contains(np.norm, p.nphrase)
         JOIN dict d ON d.idx = p.idx {on_dict}
         ANTI JOIN ex ON ex.bundle_id = np.bundle_id AND ex.page_number = np.page_number
                     AND ex.idx = p.idx),
counted AS (SELECT bundle_id, page_number, idx, count(*) AS n FROM hits GROUP BY ALL),
sc AS (
  SELECT np.bundle_id, np.page_number{dict_cols}, d.idx, d.dtype, d.header,
         contains(np.zone, d.hfold) AS hm, coalesce(c.n, 0) AS n,
         greatest(0.0::DOUBLE, least(1.0::DOUBLE,
           (CASE WHEN contains(np.zone, d.hfold) THEN 0.80::DOUBLE * d.weight ELSE 0 END)
           + (CASE WHEN coalesce(c.n, 0) > 0 THEN 0.10::DOUBLE * c.n * d.weight ELSE 0 END)
         )) AS confidence
  FROM zoned np JOIN dict d ON TRUE {on_dict}
  LEFT JOIN counted c ON c.bundle_id = np.bundle_id AND c.page_number = np.page_number
                     AND c.idx = d.idx
  ANTI JOIN ex ON ex.bundle_id = np.bundle_id AND ex.page_number = np.page_number
              AND ex.idx = d.idx),
best AS (SELECT * FROM sc QUALIFY row_number() OVER (
           PARTITION BY bundle_id, page_number ORDER BY confidence DESC, idx) = 1),
cls AS (
  SELECT np.bundle_id, np.page_number,
         coalesce(b.confidence >= 0.70::DOUBLE, FALSE) AS is_first,
         CASE WHEN b.confidence >= 0.50::DOUBLE THEN b.dtype
              ELSE '{fixed.UNKNOWN_DOCUMENT_TYPE}' END AS document_type,
         CASE WHEN b.confidence >= 0.50::DOUBLE THEN b.confidence ELSE 0.20::DOUBLE END
           AS confidence,
         CASE WHEN b.confidence >= 0.50::DOUBLE
              THEN concat_ws('|', CASE WHEN b.hm THEN 'header_match:' || b.header END,
                                  CASE WHEN b.n > 0 THEN 'phrase_hits:' || b.n END)
              ELSE 'no_pattern_match' END AS signals
  FROM np LEFT JOIN best b USING (bundle_id, page_number)),
aff AS (SELECT bundle_id, page_number, dtype, phrase, min(idx * 1000 + pos) AS ord
        FROM hits GROUP BY ALL)"""


def _blank_facts(mode: str, share: str = "0.5") -> str:
    """facts: classification + is_empty, confirmed, removable (blank-aware reads)."""
    tripped = f"cand > 0 AND (cand::DOUBLE / total > {share}::DOUBLE OR cand >= total)"
    removable = "e.confirmed AND NOT br.tripped" if mode == "remove" else "FALSE"
    return f"""
em AS (SELECT bundle_id, page_number, {_alnum('text')} <= 0 AS is_empty,
              blank AND {_alnum('text')} <= 0 AS confirmed FROM rd),
br AS (SELECT *, ({tripped}) AND '{mode}' = 'remove' AS tripped
       FROM (SELECT bundle_id, count(*) FILTER (confirmed) AS cand, count(*) AS total,
                    max(page_number) AS last_page FROM em GROUP BY ALL)),
facts AS (SELECT c.*, e.is_empty, e.confirmed, {removable} AS removable
          FROM cls c JOIN em e USING (bundle_id, page_number) JOIN br USING (bundle_id))"""


_PLAIN_FACTS = f"""
facts AS (SELECT c.*, {_alnum('np.text')} <= 0 AS is_empty, FALSE AS confirmed,
                 FALSE AS removable
          FROM cls c JOIN np USING (bundle_id, page_number))"""

# page states from facts (is_first, document_type, ...) with plain running windows
_STATES = f"""
w AS (
  SELECT *,
    sum(is_first::INT) OVER run AS first_n,
    coalesce(sum((NOT removable)::INT) OVER prev, 0) AS live_before,
    coalesce(bool_or(is_first) OVER prev, FALSE) AS first_before,
    last_value(CASE WHEN is_first THEN document_type END IGNORE NULLS) OVER run AS current_type
  FROM facts
  WINDOW run AS (PARTITION BY bundle_id ORDER BY page_number
                 ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
         prev AS (PARTITION BY bundle_id ORDER BY page_number
                  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
w2 AS (SELECT *, is_first OR (NOT removable AND live_before = 0 AND NOT first_before) AS is_start
       FROM w),
st0 AS (
  SELECT *, (sum(is_start::INT) OVER run)::INTEGER AS segment_id, first_n > 0 AS known,
    last_value(CASE WHEN is_start THEN page_number END IGNORE NULLS) OVER run AS start_page
  FROM w2 WINDOW run AS (PARTITION BY bundle_id ORDER BY page_number
                         ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
affine AS (SELECT DISTINCT bundle_id, page_number, dtype AS current_type FROM aff),
st AS (
  SELECT s.*, CASE WHEN is_first THEN 'first'
                   WHEN known AND a.bundle_id IS NOT NULL THEN 'phrase'
                   WHEN removable THEN 'removed' ELSE 'unmatched' END AS kind
  FROM st0 s LEFT JOIN affine a USING (bundle_id, page_number, current_type))"""

_DOCS = f"""
docs AS (
  SELECT bundle_id, segment_id AS document_index,
    CASE WHEN any_value(known) THEN any_value(current_type)
         ELSE '{fixed.UNKNOWN_DOCUMENT_TYPE}' END AS document_type,
    coalesce(max(CASE WHEN is_first THEN confidence END), 0.20::DOUBLE) AS confidence,
    bool_or(kind = 'unmatched' AND known)
      OR coalesce(max(CASE WHEN is_first THEN confidence END), 0.20::DOUBLE) < 0.80::DOUBLE
      AS requires_review,
    min(page_number) AS start_page,
    max(page_number) FILTER (kind <> 'removed') AS end_page,
    any_value(known) AS known
  FROM st WHERE segment_id > 0 GROUP BY bundle_id, segment_id)"""

_FILE_NAME = (
    "printf('%s_strony_%03d-%03d.pdf', translate({t}, ' /\\:', '____'), {a}, {b})"
)
_DOC_COLUMNS = (
    "bundle_id, document_index, document_type, confidence, requires_review, start_page, "
    "end_page, " + _FILE_NAME.format(t="document_type", a="start_page", b="end_page")
    + " AS output_file_name"
)


def _with(*parts: str) -> str:
    return "WITH RECURSIVE " + ",\n".join(p.strip() for p in parts) + "\n"


_SPLIT = _with(_LINES, _DICTIONARY, _rules("pg"), _PLAIN_FACTS, _STATES, _DOCS)
_SCAN = {
    name: _with(_READS, _DICTIONARY, _rules("rd"), _blank_facts(mode, share), _STATES, _DOCS)
    for name, mode, share in (
        ("remove", "remove", "0.5"), ("report", "report", "0.5"), ("strict", "remove", "0.12")
    )
}
_REMOVED = """
removed AS (SELECT s.bundle_id, d.document_index, s.page_number
            FROM st s JOIN docs d ON d.bundle_id = s.bundle_id AND s.kind = 'removed'
             AND s.page_number BETWEEN d.start_page AND d.end_page)"""

# --- sources -------------------------------------------------------------------------------------

ORACLE["scan_pages"] = _with(_TURNS) + "SELECT * FROM pg"
ORACLE["explode_pages"] = _with(_LINES) + "SELECT * FROM pg"

_RAW_DICT = """
raw AS (
  SELECT p_partkey AS row_no,
    CASE WHEN p_partkey % 10 = 3 THEN NULL ELSE ' ' || p_type END AS dtype,
    CASE WHEN p_partkey % 7 = 2 THEN '  ' ELSE p_name || ' ' END AS header,
    CASE WHEN p_partkey % 5 = 4 THEN NULL
         ELSE p_brand || '; ;' || p_name || ' ;' END AS phrases,
    CASE WHEN p_partkey % 3 = 0 THEN p_brand ELSE '' END AS excluded,
    CASE WHEN p_partkey % 4 = 1 THEN NULL ELSE p_size / 10.0::DOUBLE END AS weight
  FROM part),
pat AS (
  SELECT row_no::INTEGER AS pattern_idx, coalesce(trim(dtype), '') AS document_type,
         trim(header) AS header, phrases, excluded,
         coalesce(weight, 1.0::DOUBLE) AS weight
  FROM raw WHERE trim(header) <> '')"""


def _phrase_list(x: str) -> str:
    return (
        f"list_filter(list_transform(string_split(coalesce({x}, ''), ';'), "
        "lambda s: trim(s)), lambda s: s <> '')"
    )


ORACLE["dictionary_load"] = _with(_RAW_DICT) + f"""
SELECT pattern_idx, document_type, header,
       array_to_string({_phrase_list('phrases')}, '|') AS phrases,
       array_to_string({_phrase_list('excluded')}, '|') AS excluded_phrases, weight
FROM pat"""
ORACLE["dictionary_join"] = """
SELECT p_partkey AS type_id, p_name AS type_name, l_orderkey AS row_id, l_linenumber AS row_no,
       l_quantity AS weight
FROM part JOIN lineitem ON l_partkey = p_partkey
WHERE p_type = 'ECONOMY' AND NOT p_size > 45 AND p_retailprice < 1500 AND l_returnflag <> 'R'"""
ORACLE["patterns_json"] = f"""
SELECT p_partkey::VARCHAR AS payload_id, i.idx::INTEGER AS pattern_idx,
       p_type AS document_type, CASE WHEN i.idx = 0 THEN p_name ELSE 'x' END AS header,
       CASE WHEN i.idx = 0 THEN 'a|b' ELSE '' END AS phrases,
       CASE WHEN i.idx = 0 THEN p_size::DOUBLE ELSE 1.0::DOUBLE END AS weight,
       NULL::VARCHAR AS error
FROM part, (VALUES (0), (1)) i(idx)
WHERE p_partkey % 6 IN (0, 5) AND p_partkey % 30 NOT IN (0, 5, 6, 11, 12)
UNION ALL
SELECT p_partkey::VARCHAR, NULL, NULL, NULL, NULL, NULL, '{fixed.PATTERNS_ERROR}'
FROM part WHERE p_partkey % 6 IN (1, 2, 4) OR p_partkey % 30 IN (0, 5, 6, 11, 12)"""
ORACLE["split_no_patterns"] = _with(_LINES) + f"""
SELECT bundle_id, 1 AS document_index, '{fixed.UNKNOWN_DOCUMENT_TYPE}' AS document_type,
       0.20::DOUBLE AS confidence, TRUE AS requires_review, 1 AS start_page,
       max(page_number) AS end_page,
       {_FILE_NAME.format(t=_q(fixed.UNKNOWN_DOCUMENT_TYPE), a="1", b="max(page_number)")}
         AS output_file_name
FROM pg GROUP BY bundle_id"""

_ATTACHMENTS = """
att AS (SELECT o_orderkey AS attachment_id, o_custkey AS element_id,
          'scan ' || o_orderkey AS file_name,
          CASE WHEN o_orderstatus = 'F' AND starts_with(o_orderpriority, '1')
               THEN CASE WHEN o_orderkey % 2 = 0 THEN '.PDF' ELSE 'pdf' END
               ELSE 'txt' END AS extension
        FROM orders)"""
_IS_PDF = "lower(ltrim(extension, '.')) = 'pdf'"
ORACLE["attachment_check"] = _with(_ATTACHMENTS) + f"""
SELECT element_id, n AS pdf_count, CASE WHEN n = 1 THEN m END AS attachment_id,
       CASE WHEN n = 0 THEN {_q(fixed.NO_PDF_ERROR)}
            WHEN n > 1 THEN {_q(fixed.MANY_PDF_ERROR)} END AS error
FROM (SELECT element_id, count(*) FILTER ({_IS_PDF}) AS n,
             min(attachment_id) FILTER ({_IS_PDF}) AS m FROM att GROUP BY ALL)"""
ORACLE["attachment_by_id"] = _with(_ATTACHMENTS, """
rq AS (SELECT o_orderkey AS request_id,
         CASE WHEN o_orderkey % 5 = 0 THEN o_custkey + 1 ELSE o_custkey END AS element_id,
         CASE o_orderkey % 7 WHEN 0 THEN 'abc' WHEN 1 THEN '-5' WHEN 2 THEN NULL
           WHEN 3 THEN '9' || lpad(o_orderkey::VARCHAR, 8, '0')
           WHEN 4 THEN ' ' || o_orderkey || ' ' ELSE o_orderkey::VARCHAR END AS raw_id
       FROM orders)""", """
nr AS (SELECT *, CASE WHEN try_cast(trim(coalesce(raw_id, '')) AS INTEGER) > 0
                      THEN try_cast(trim(raw_id) AS INTEGER) END AS wanted FROM rq)""", f"""
ck AS (SELECT r.*, a.file_name AS found,
         CASE WHEN wanted IS NULL
              THEN printf({_q(fixed.ATTACHMENT_BAD_ID)}, coalesce(raw_id, ''))
              WHEN a.file_name IS NULL THEN printf({_q(fixed.ATTACHMENT_MISSING)}, wanted)
              WHEN a.element_id <> r.element_id
              THEN printf({_q(fixed.ATTACHMENT_FOREIGN)}, wanted, a.element_id::VARCHAR,
                          r.element_id)
              WHEN NOT {_IS_PDF}
              THEN printf({_q(fixed.ATTACHMENT_NOT_PDF)}, a.file_name, wanted) END AS error
       FROM nr r LEFT JOIN att a ON a.attachment_id = r.wanted)""") + """
SELECT request_id, element_id, raw_id, error, CASE WHEN error IS NULL THEN found END AS file_name
FROM ck"""
ORACLE["file_name_clean"] = rf"""
SELECT p_partkey, name AS file_name,
       CASE WHEN NOT ends_with(lower(name), '.pdf') THEN {_q(fixed.ONLY_PDF_ERROR)} END AS error
FROM (SELECT p_partkey, trim(list_extract(string_split(replace(raw, '\', '/'), '/'), -1)) AS name
      FROM (SELECT p_partkey,
              CASE p_partkey % 3 WHEN 0 THEN 'C:\scans\' WHEN 1 THEN '/var/in/' ELSE ' ' END
              || p_name ||
              CASE p_partkey % 4 WHEN 0 THEN '.PDF ' WHEN 1 THEN '.pdf' WHEN 2 THEN '.txt'
                ELSE '\' END AS raw FROM part))"""

# --- text -------------------------------------------------------------------------------------------

ORACLE["normalize_text"] = _with(_LINES) + f"""
SELECT bundle_id, page_number, {_norm('text')} AS norm FROM pg"""
ORACLE["fold_digits"] = f"""
SELECT o_orderkey, {_fold("o_orderkey || ' ' || o_orderpriority")} AS folded FROM orders"""
ORACLE["alnum_count"] = _with(_LINES) + f"""
SELECT bundle_id, page_number, {_alnum('text')} AS alnum FROM pg"""


def _preview(x: str, n: int) -> str:
    flat = rf"trim(regexp_replace({x}, '[\s\x0B\x1c-\x1f]+', ' ', 'g'))"
    return (
        f"CASE WHEN length({flat}) <= {n} THEN {flat} "
        f"ELSE substring({flat}, 1, {n}) || '...' END"
    )


ORACLE["page_preview"] = f"""
SELECT doc_id, {_preview('text', 1200)} AS preview FROM documents"""
ORACLE["page_diagnostics"] = _with(_BLANKED) + f"""
SELECT bundle_id, page_number, {_alnum('text')} AS alnum, {_alnum('text')} = 0 AS empty,
       CASE WHEN {_alnum('text')} > 0 THEN {_preview('text', 1200)} END AS raw,
       CASE WHEN {_alnum('text')} > 0 THEN {_preview(_norm('text'), 300)} END AS norm
FROM pg"""
ORACLE["document_file_name"] = rf"""
SELECT p_partkey, printf('%s_strony_%03d-%03d.pdf',
         translate(p_name || '/' || p_type || '/a:b\' || p_brand, ' /\:', '____'),
         p_size, p_partkey + p_size) AS file_name FROM part"""
ORACLE["derive_name"] = r"""
SELECT p_partkey, stem || '_bez-stron.pdf' AS removed_name, stem || '_strony.pdf' AS extracted_name
FROM (SELECT p_partkey, CASE WHEN ends_with(lower(name), '.pdf')
                             THEN left(name, length(name) - 4) ELSE name END AS stem
      FROM (SELECT p_partkey, p_name || CASE p_partkey % 3 WHEN 0 THEN '.pdf' WHEN 1 THEN '.PdF'
                                          ELSE '.pdf.txt' END AS name FROM part))"""

# --- dictionary --------------------------------------------------------------------------------------

ORACLE["active_patterns"] = _with(_RAW_DICT) + """
SELECT pattern_idx, document_type, header FROM pat WHERE pattern_idx % 3 <> 0"""
ORACLE["phrase_list"] = _with(_RAW_DICT) + f"""
SELECT row_no, (unnest(range(1, len(l) + 1)) - 1)::INTEGER AS pos, unnest(l) AS phrase
FROM (SELECT row_no, {_phrase_list('phrases')} AS l FROM raw)"""
ORACLE["known_types"] = _with(_RAW_DICT) + """
SELECT DISTINCT document_type FROM pat WHERE pattern_idx % 3 <> 0"""

# --- rules ----------------------------------------------------------------------------------------------

_RULES = _with(_LINES, _DICTIONARY, _rules("pg"))
ORACLE["header_matches"] = _RULES + """
SELECT bundle_id, page_number, idx AS pattern_idx FROM sc WHERE hm"""
ORACLE["phrase_matches"] = _RULES + """
SELECT bundle_id, page_number, idx AS pattern_idx,
       (row_number() OVER (PARTITION BY bundle_id, page_number, idx ORDER BY pos) - 1)::INTEGER
         AS pos, phrase
FROM hits"""
ORACLE["excluded_patterns"] = _RULES + """
SELECT bundle_id, page_number, idx AS pattern_idx FROM ex"""
ORACLE["rule_scores"] = _RULES + """
SELECT bundle_id, page_number, idx AS pattern_idx, confidence FROM sc"""
ORACLE["rule_signals"] = _RULES + """
SELECT bundle_id, page_number, idx AS pattern_idx,
       concat_ws('|', CASE WHEN hm THEN 'header_match:' || header END,
                      CASE WHEN n > 0 THEN 'phrase_hits:' || n END) AS signals
FROM sc"""
ORACLE["best_pattern"] = _RULES + """
SELECT bundle_id, page_number, idx AS pattern_idx, confidence FROM best"""
ORACLE["page_classification"] = _RULES + "SELECT * FROM cls"
ORACLE["conversation_classification"] = (
    _with(_TURNS, _DICTIONARY, _rules("pg")) + "SELECT * FROM cls"
)
ORACLE["tenant_classification"] = _with(
    _LINES,
    """tp AS (SELECT pg.*, lang AS dict_id, CASE lang WHEN 'en' THEN 0 WHEN 'fr' THEN 1
              WHEN 'de' THEN 2 ELSE 1000 END AS first_idx
              FROM pg JOIN documents ON doc_id = bundle_id)""",
    _DICTIONARY, _rules("tp", tenant=True),
) + """
SELECT bundle_id, page_number, dict_id, is_first, document_type, confidence
FROM cls JOIN np USING (bundle_id, page_number)"""
ORACLE["tenant_classification_chunked"] = _with(
    _LINES,
    """tp AS (SELECT bundle_id * 3 + i AS bundle_id, page_number, text, dict_id, first_idx
              FROM pg, (VALUES (0, 'en', 0), (1, 'fr', 1), (2, 'es', 1000)) o(i, dict_id, first_idx))""",
    _DICTIONARY, _rules("tp", tenant=True),
) + """
SELECT bundle_id // 3 AS bundle_id, page_number, dict_id, is_first, document_type, confidence
FROM cls JOIN np USING (bundle_id, page_number)"""
ORACLE["phrase_affinities"] = _RULES + """
SELECT bundle_id, page_number, dtype AS document_type,
       string_agg(phrase, '|' ORDER BY ord) AS phrases
FROM aff GROUP BY ALL"""

# --- text acquisition, blank pages ------------------------------------------------------------------------

ORACLE["ocr_candidates"] = _with(_READS) + """
SELECT bundle_id, page_number FROM flagged WHERE candidate"""
ORACLE["ink_ratio"] = _with(_LINES, _ink("pg")) + "SELECT * FROM ink"
ORACLE["blank_pages"] = _with(_READS) + """
SELECT bundle_id, page_number, blank FROM flagged WHERE candidate"""
ORACLE["ocr_merge"] = _with(_READS) + """
SELECT bundle_id, page_number, filled, CASE WHEN filled THEN ocr_text ELSE text END AS text
FROM merged WHERE candidate"""
ORACLE["ocr_summary"] = _with(_READS) + """
SELECT bundle_id,
  count(*) FILTER (o = 'f') AS filled_pages,
  coalesce(string_agg(page_number::VARCHAR, ',' ORDER BY page_number) FILTER (o = 'f'), '')
    AS filled_list,
  count(*) FILTER (o = 'k') AS kept_pages,
  coalesce(string_agg(page_number::VARCHAR, ',' ORDER BY page_number) FILTER (o = 'k'), '')
    AS kept_list,
  count(*) FILTER (o = 's') AS skipped_pages,
  coalesce(string_agg(page_number::VARCHAR, ',' ORDER BY page_number) FILTER (o = 's'), '')
    AS skipped_list
FROM (SELECT *, CASE WHEN blank THEN 's' WHEN filled THEN 'f' ELSE 'k' END AS o
      FROM merged WHERE candidate) GROUP BY bundle_id"""
ORACLE["page_reads"] = _with(_READS) + "SELECT bundle_id, page_number, text, blank FROM rd"
ORACLE["confirmed_empty"] = _with(_READS) + f"""
SELECT bundle_id, page_number, blank AND {_alnum('text')} <= 0 AS confirmed_empty FROM rd"""
ORACLE["empty_mode"] = """
SELECT c_custkey, CASE WHEN m IN ('keep', 'report', 'remove') THEN m ELSE 'keep' END AS mode
FROM (SELECT c_custkey, lower(trim(CASE c_custkey % 5 WHEN 0 THEN ' Remove ' WHEN 1 THEN 'REPORT'
        WHEN 2 THEN 'keep' WHEN 3 THEN '' ELSE c_mktsegment END)) AS m FROM customer)"""
ORACLE["mode_warnings"] = f"""
WITH m AS (SELECT c_custkey, lower(trim(CASE c_custkey % 5 WHEN 0 THEN ' Remove ' WHEN 1 THEN 'REPORT'
        WHEN 2 THEN 'keep' WHEN 3 THEN '' ELSE c_mktsegment END)) AS m FROM customer)
SELECT c_custkey AS setting_id, '{fixed.WARN_UNKNOWN_MODE}' AS code FROM m WHERE m NOT IN ('keep', 'report', 'remove')
UNION ALL SELECT c_custkey, '{fixed.WARN_MODE_NEEDS_OCR}' FROM m WHERE m IN ('report', 'remove') AND c_custkey % 2 = 1"""
ORACLE["removal_breaker"] = _SCAN["strict"] + """
SELECT bundle_id, cand AS candidates, total, tripped FROM br"""
ORACLE["removable_pages"] = _SCAN["strict"] + """
SELECT bundle_id, page_number FROM facts WHERE removable"""

# --- segmentation ----------------------------------------------------------------------------------------------

ORACLE["segment_starts"] = _SPLIT + "SELECT bundle_id, page_number FROM st WHERE is_start"
ORACLE["segments"] = _SPLIT + "SELECT bundle_id, page_number, segment_id FROM st"
ORACLE["current_type"] = _SPLIT + "SELECT bundle_id, page_number, current_type FROM st"
ORACLE["page_decisions"] = _SCAN["remove"] + """
, ph AS (SELECT bundle_id, page_number, dtype, string_agg(phrase, ', ' ORDER BY ord) AS phrases
         FROM aff GROUP BY ALL)
SELECT s.bundle_id, s.page_number, kind AS decision, segment_id,
       coalesce(current_type, '') AS current_type, is_empty,
       CASE kind WHEN 'first' THEN replace(signals, '|', ', ') WHEN 'phrase' THEN phrases
                 ELSE '' END AS detail
FROM st s LEFT JOIN ph ON ph.bundle_id = s.bundle_id AND ph.page_number = s.page_number
                      AND ph.dtype = s.current_type"""
ORACLE["unknown_runs"] = _SPLIT + """
SELECT bundle_id, document_index, start_page, end_page FROM docs WHERE NOT known"""
ORACLE["glued_pages"] = _SPLIT + """
SELECT bundle_id, page_number, segment_id AS document_index
FROM st WHERE kind = 'unmatched' AND known"""
ORACLE["split_documents"] = _SPLIT + f"SELECT {_DOC_COLUMNS} FROM docs"
ORACLE["split_conversations"] = (
    _with(_TURNS, _DICTIONARY, _rules("pg"), _PLAIN_FACTS, _STATES, _DOCS)
    + f"SELECT {_DOC_COLUMNS} FROM docs"
)
ORACLE["split_tenants"] = _with(
    _LINES,
    """tp AS (SELECT bundle_id * 2 + i AS bundle_id, page_number, text, dict_id, first_idx
              FROM pg, (VALUES (0, 'en', 0), (1, 'fr', 1)) o(i, dict_id, first_idx))""",
    _DICTIONARY, _rules("tp", tenant=True), _PLAIN_FACTS, _STATES, _DOCS,
) + (
    "SELECT CASE WHEN bundle_id % 2 = 0 THEN 'en' ELSE 'fr' END AS dict_id, * REPLACE (bundle_id // 2 AS bundle_id)"
    f" FROM (SELECT {_DOC_COLUMNS} FROM docs)"
)
ORACLE["split_scans"] = _SCAN["remove"] + f"SELECT {_DOC_COLUMNS} FROM docs"
ORACLE["page_context"] = _with(_LINES) + """
SELECT bundle_id, page_number,
  substring(coalesce(lag(text) OVER o, ''), 1, 2000) AS previous_text,
  substring(coalesce(lead(text) OVER o, ''), 1, 2000) AS next_text
FROM pg WINDOW o AS (PARTITION BY bundle_id ORDER BY page_number)"""

# --- verdicts ----------------------------------------------------------------------------------------------------

_TYPES = ", ".join(f"({i}, {_q(t)})" for i, t in enumerate(TRIAL_TYPES))
_KNOWN = sorted({t for _, t, _, _, _, _, active in TRIAL_PATTERNS if active})
_KNOWN_LIST = ", ".join(_q(t) for t in _KNOWN)


def _replies(keep: str = "TRUE") -> str:
    """rp (content per reply), vd (parsed, guarded, accepted)."""
    return f"""
rp0 AS (SELECT bundle_id, page_number, t, current_type,
          (bundle_id * 13 + page_number * 5 + t * 7) % 120 AS n
        FROM pg, (VALUES {_TYPES}) x(t, current_type) WHERE {keep}),
rp1 AS (SELECT *, CASE n % 6 WHEN 0 THEN NULL WHEN 1 THEN 'Alpha' WHEN 2 THEN 'Beta'
                    WHEN 3 THEN 'Gamma' WHEN 4 THEN 'Delta' ELSE current_type END AS proposed,
          CASE WHEN page_number % 2 = 0 THEN (n / 100::DOUBLE)::VARCHAR ELSE n::VARCHAR END
            AS shown FROM rp0),
rpb AS (SELECT *, '```json {{"isFirstPage": '
         || CASE WHEN (bundle_id + page_number + t) % 3 = 0 THEN 'false' ELSE 'true' END
         || ', "documentType": ' || coalesce('"' || proposed || '"', 'null')
         || ', "isKnownType": ' || CASE WHEN n % 4 = 0 THEN 'true' ELSE 'false' END
         || ', "confidence": ' || shown
         || ', "reasonCodes": ["layout", "n' || n
         || '"], "suggestedNewPatterns": ["s1", "s2", "s3", "s4"]}} ```' AS body
       FROM rp1),
rp AS (SELECT *, CASE n % 17 WHEN 0 THEN 'no answer'
         WHEN 3 THEN body || ' i jeszcze {{x}}' WHEN 5 THEN replace(body, '"', '''')
         WHEN 7 THEN replace(body, '["layout"', '[7')
         WHEN 9 THEN replace(body, '["s1", "s2", "s3", "s4"]', 'null')
         WHEN 11 THEN replace(body, '"confidence": ' || shown, '"confidence": "' || shown || '"')
         ELSE body END AS content
       FROM rpb),
js0 AS (SELECT *, CASE WHEN instr(content, '{{') > 0 THEN substring(content, instr(content, '{{'),
         length(content) - instr(reverse(content), '}}') + 2 - instr(content, '{{')) END AS json
       FROM rp),
js AS (SELECT *, CASE WHEN n % 17 NOT IN (0, 3, 5, 7, 9) AND (n % 17 <> 11 OR shown::DOUBLE <= 1)
                      THEN json END AS good FROM js0),
pv AS (SELECT *, json_extract_string(good, '$.isFirstPage')::BOOLEAN AS v_first,
         coalesce(json_extract_string(good, '$.documentType'), '') AS v_type,
         json_extract_string(good, '$.isKnownType')::BOOLEAN AS v_known,
         json_extract_string(good, '$.confidence')::DOUBLE AS raw_conf
       FROM js),
vc AS (SELECT *, CASE WHEN raw_conf > 100 THEN 1.0::DOUBLE WHEN raw_conf > 1
                      THEN raw_conf / 100 ELSE raw_conf END AS v_conf FROM pv),
vd AS (SELECT *,
         CASE WHEN good IS NULL THEN NULL ELSE concat_ws('|',
           CASE WHEN NOT v_first AND current_type = '' THEN {_q(fixed.GUARD_NO_CURRENT)}
                WHEN NOT v_first AND v_type <> '' AND v_type <> current_type
                THEN printf({_q(fixed.GUARD_OTHER_TYPE)}, v_type, current_type) END,
           CASE WHEN v_known AND v_type NOT IN ({_KNOWN_LIST})
                THEN printf({_q(fixed.GUARD_NOT_KNOWN)}, v_type) END) END AS guard
       FROM vc),
vj AS (SELECT *, coalesce(good IS NOT NULL AND v_type <> '' AND guard = ''
                          AND v_conf >= 0.70::DOUBLE, FALSE) AS accepted FROM vd)"""


# one page at a time: the type current before a page picks the stored verdict
_WALK = f"""
pf AS (SELECT f.*, list(DISTINCT a.dtype) FILTER (a.dtype IS NOT NULL) AS types
       FROM facts f LEFT JOIN aff a USING (bundle_id, page_number) GROUP BY ALL),
walk AS (
  SELECT bundle_id, 0 AS page_number, NULL::VARCHAR AS cur, FALSE AS is_known, 0 AS segment_id,
         ''::VARCHAR AS kind, ''::VARCHAR AS vtype, 0.0::DOUBLE AS vconf,
         ''::VARCHAR AS vguard, FALSE AS has_verdict, FALSE AS vfirst, FALSE AS vknown
  FROM (SELECT DISTINCT bundle_id FROM pf)
  UNION ALL
  SELECT bundle_id, page_number,
    CASE WHEN kind = 'first' THEN document_type WHEN kind = 'opened' THEN v_type ELSE cur END,
    kind IN ('first', 'opened') OR is_known,
    CASE WHEN kind IN ('first', 'opened') THEN segment_id + 1
         WHEN kind = 'unmatched' AND NOT is_known AND segment_id = 0 THEN 1
         ELSE segment_id END,
    kind, coalesce(v_type, ''), coalesce(v_conf, 0.0::DOUBLE), coalesce(guard, ''),
    has_v, coalesce(v_first, FALSE), coalesce(v_known, FALSE)
  FROM (
    SELECT p.*, w.cur, w.is_known, w.segment_id, v.v_type, v.v_conf, v.guard, v.v_first, v.v_known,
      v.good IS NOT NULL AND NOT p.is_empty AS has_v,
      CASE WHEN p.is_first THEN 'first'
           WHEN w.is_known AND coalesce(list_contains(p.types, w.cur), FALSE) THEN 'phrase'
           WHEN p.removable THEN 'removed'
           WHEN NOT p.is_empty AND v.accepted AND v.v_first THEN 'opened'
           WHEN NOT p.is_empty AND v.accepted AND w.is_known AND v.v_type = w.cur THEN 'verdict'
           ELSE 'unmatched' END AS kind
    FROM walk w JOIN pf p ON p.bundle_id = w.bundle_id AND p.page_number = w.page_number + 1
    LEFT JOIN vj v ON v.bundle_id = p.bundle_id AND v.page_number = p.page_number
                  AND v.current_type = CASE WHEN w.is_known THEN w.cur ELSE '' END)),
vst AS (SELECT w.*, f.confidence, f.is_empty, f.confirmed, f.signals, f.types
        FROM walk w JOIN pf f USING (bundle_id, page_number)),
vdocs AS (
  SELECT bundle_id, segment_id AS document_index,
    CASE WHEN any_value(is_known) THEN any_value(cur)
         ELSE '{fixed.UNKNOWN_DOCUMENT_TYPE}' END AS document_type,
    coalesce(max(CASE kind WHEN 'first' THEN confidence WHEN 'opened' THEN vconf END),
             0.20::DOUBLE) AS confidence,
    bool_or(kind = 'unmatched' AND is_known) AS forced,
    min(page_number) AS start_page,
    max(page_number) FILTER (kind <> 'removed') AS end_page, any_value(is_known) AS known
  FROM vst WHERE segment_id > 0 GROUP BY bundle_id, segment_id)"""


def _verdict_split(keep: str = "TRUE") -> str:
    return _with(_READS, _DICTIONARY, _rules("rd"), _blank_facts("remove"), _replies(keep), _WALK)


ORACLE["split_with_verdicts"] = _verdict_split() + f"""
SELECT bundle_id, document_index, document_type, confidence,
       forced OR confidence < 0.80::DOUBLE AS requires_review, start_page, end_page,
       {_FILE_NAME.format(t="document_type", a="start_page", b="end_page")} AS output_file_name
FROM vdocs"""
ORACLE["pending_verdicts"] = _verdict_split("current_type <> ''") + """
SELECT bundle_id, page_number, CASE WHEN is_known THEN cur ELSE '' END AS current_type
FROM vst v WHERE kind = 'unmatched' AND NOT is_empty
  AND NOT EXISTS (SELECT 1 FROM rp WHERE rp.bundle_id = v.bundle_id
        AND rp.page_number = v.page_number
        AND rp.current_type = CASE WHEN v.is_known THEN v.cur ELSE '' END)"""

ORACLE["pending_prompts"] = _verdict_split("current_type <> ''") + f""",
cx AS (SELECT bundle_id, page_number, substring(coalesce(lag(text) OVER o, ''), 1, 2000) || '|'
         || substring(text, 1, 4000) || '|' || substring(coalesce(lead(text) OVER o, ''), 1, 2000) AS shown
       FROM rd WINDOW o AS (PARTITION BY bundle_id ORDER BY page_number)),
asked AS (SELECT bundle_id, page_number, CASE WHEN is_known THEN cur ELSE '' END AS current_type
       FROM vst WHERE kind = 'unmatched' AND NOT is_empty)
SELECT bundle_id, page_number, current_type,
  'Typy: [{", ".join('"' + t + '"' for t in _KNOWN)}]' AS system_prompt,
  '[' || CASE current_type WHEN '' THEN 'BRAK' ELSE current_type END || '] ' || shown AS user_prompt
FROM asked JOIN cx USING (bundle_id, page_number)
ANTI JOIN rp USING (bundle_id, page_number, current_type)"""

_REPLY_SQL = _with(_LINES, _replies())
ORACLE["verdict_context"] = _with(_LINES) + f"""
SELECT bundle_id, page_number,
  '[{", ".join('"' + t + '"' for t in _KNOWN)}]' AS znane_typy,
  CASE WHEN page_number % 2 = 0 THEN 'Alpha' ELSE 'BRAK' END AS typ_biezacego_dokumentu,
  substring(coalesce(lag(text) OVER o, ''), 1, 2000) AS poprzednia_strona,
  substring(text, 1, 4000) AS aktualna_strona,
  substring(coalesce(lead(text) OVER o, ''), 1, 2000) AS nastepna_strona,
  {_q(fixed.VERDICT_FORMAT)} AS format_json
FROM pg WINDOW o AS (PARTITION BY bundle_id ORDER BY page_number)"""
ORACLE["verdict_extract"] = _REPLY_SQL + """
SELECT bundle_id, page_number, current_type, json FROM js"""
ORACLE["verdict_parse"] = _REPLY_SQL + """
SELECT bundle_id, page_number, current_type, good IS NOT NULL AS usable, v_first AS is_first,
  CASE WHEN good IS NOT NULL THEN v_type END AS document_type, v_known AS is_known,
  v_conf AS confidence,
  CASE WHEN good IS NOT NULL THEN 'layout|n' || n END AS codes,
  CASE WHEN good IS NOT NULL THEN 's1|s2|s3|s4' END AS suggested
FROM vc"""
ORACLE["verdict_confidence"] = """
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice,
  CASE WHEN raw < 0 THEN NULL WHEN raw > 100 THEN 1.0::DOUBLE WHEN raw > 1 THEN raw / 100
       ELSE raw END AS confidence
FROM (SELECT *, l_quantity * 3 - 5 + l_discount AS raw FROM lineitem)"""
ORACLE["verdict_guard"] = _REPLY_SQL + """
SELECT bundle_id, page_number, current_type, guard FROM vj WHERE good IS NOT NULL"""
ORACLE["verdict_guard_tenants"] = _REPLY_SQL + f"""
SELECT bundle_id, page_number, current_type, dict_id,
  concat_ws('|',
    CASE WHEN NOT v_first AND current_type = '' THEN {_q(fixed.GUARD_NO_CURRENT)}
         WHEN NOT v_first AND v_type <> '' AND v_type <> current_type
         THEN printf({_q(fixed.GUARD_OTHER_TYPE)}, v_type, current_type) END,
    CASE WHEN v_known AND (v_type NOT IN ({_KNOWN_LIST}) OR dict_id = 't2' AND v_type IN ('Alpha', 'Delta'))
         THEN printf({_q(fixed.GUARD_NOT_KNOWN)}, v_type) END) AS guard
FROM vc, (VALUES ('t0'), ('t2')) o(dict_id) WHERE good IS NOT NULL"""
ORACLE["verdict_gate"] = _REPLY_SQL + """
SELECT bundle_id, page_number, current_type, accepted FROM vj"""

# --- documents and bundles -------------------------------------------------------------------------------------------

ORACLE["removed_pages"] = _SCAN["remove"] + "," + _REMOVED + "SELECT * FROM removed"
_PHRASES = """
pc AS (SELECT s.bundle_id, s.segment_id AS document_index, a.phrase,
         string_agg(s.page_number::VARCHAR, ',' ORDER BY s.page_number) AS pages,
         min(s.page_number) AS page_number
       FROM st s JOIN aff a ON a.bundle_id = s.bundle_id AND a.page_number = s.page_number
                           AND a.dtype = s.current_type
       WHERE s.kind = 'phrase' GROUP BY ALL),
rk AS (SELECT bundle_id, page_number, dtype, phrase,
         row_number() OVER (PARTITION BY bundle_id, page_number, dtype ORDER BY ord) - 1 AS pos
       FROM aff),
pcs AS (SELECT pc.bundle_id, pc.document_index, pc.page_number, rk.pos::INTEGER AS position,
          'phrase_continuation:' || pc.phrase || '(' || pages || ')' AS signal
        FROM pc JOIN docs d USING (bundle_id, document_index)
        JOIN rk ON rk.bundle_id = pc.bundle_id AND rk.page_number = pc.page_number
               AND rk.phrase = pc.phrase AND rk.dtype = d.document_type)"""
_SIGNALS = _PHRASES + """,
sig AS (
  SELECT bundle_id, segment_id AS document_index, 0 AS section, page_number,
    (unnest(range(1, len(l) + 1)) - 1)::INTEGER AS position, unnest(l) AS signal
  FROM (SELECT *, string_split(CASE WHEN is_first THEN signals ELSE 'unknown_run' END, '|') AS l
        FROM st WHERE is_start)
  UNION ALL
  SELECT bundle_id, segment_id, 1, page_number, 0, 'glued_unknown_page:' || page_number
  FROM st WHERE kind = 'unmatched' AND known
  UNION ALL
  SELECT bundle_id, document_index, 2, page_number, position, signal FROM pcs)"""
ORACLE["phrase_continuations"] = _SPLIT + "," + _PHRASES + """
SELECT bundle_id, document_index, page_number, position, signal FROM pcs"""
ORACLE["document_signals"] = _SPLIT + "," + _SIGNALS + "SELECT * FROM sig"

_AFF_TYPES = """
aty AS (SELECT bundle_id, page_number,
         string_agg('''' || dtype || '''', ', ' ORDER BY dtype) AS names
       FROM (SELECT DISTINCT bundle_id, page_number, dtype FROM aff) GROUP BY ALL)"""
_NO_TEXT = "printf('strona %d bez tekstu (rowniez po OCR) - dolaczona automatycznie', page_number)"


def _reasons(states: str, docs: str, known: str, opinion: str) -> str:
    return f"""
rs AS (
  SELECT bundle_id, document_index, 0 AS section, start_page AS page_number,
    {_q(fixed.REASON_UNKNOWN_TYPE)} AS reason FROM {docs} WHERE NOT known
  UNION ALL
  SELECT bundle_id, segment_id, 1, page_number,
    CASE WHEN is_empty THEN {_NO_TEXT}
         WHEN {known} THEN printf({_q(fixed.REASON_GLUED_PAGE)}, page_number, detail)
         ELSE printf({_q(fixed.REASON_UNKNOWN_PAGE)}, page_number, detail) END
  FROM (SELECT s.*, coalesce('frazy pasuja do: ' || names, 'zadna fraza nie pasuje')
               || '; ' || {opinion} AS detail
        FROM {states} s LEFT JOIN aty USING (bundle_id, page_number) WHERE kind = 'unmatched')
  UNION ALL
  SELECT bundle_id, document_index, 2, start_page,
    printf('pewnosc %.2f ponizej progu auto-akceptacji 0.80', confidence)
  FROM {docs} WHERE confidence < 0.80::DOUBLE)"""


_RULE_REASONS = _AFF_TYPES + "," + _reasons("st", "docs", "known", _q(fixed.DETAIL_NO_VERDICT))
ORACLE["review_reasons"] = _SPLIT + "," + _RULE_REASONS + "SELECT * FROM rs"
_OPINION = f"""CASE WHEN NOT has_verdict THEN {_q(fixed.DETAIL_NO_VERDICT)} ELSE
  CASE WHEN vguard <> '' THEN 'werdykt LLM odrzucony jako niespojny ('
         || replace(vguard, '|', '; ') || '); ' ELSE '' END
  || CASE WHEN vtype <> '' THEN printf('LLM proponuje %s: ''%s'' (pewnosc %.2f)',
            CASE WHEN vknown THEN 'typ' ELSE 'nowy typ' END, vtype, vconf)
          WHEN vfirst THEN {_q(fixed.DETAIL_PROBABLE_START)}
          ELSE {_q(fixed.DETAIL_UNDETERMINED)} END
  || ', sugerowane frazy: ''s1'', ''s2'', ''s3''' END"""
ORACLE["review_reasons_with_verdicts"] = (
    _verdict_split() + "," + _AFF_TYPES + "," + _reasons("vst", "vdocs", "is_known", _OPINION)
    + "SELECT * FROM rs"
)

_WARN = f"""
wn AS (
  SELECT bundle_id, 0 AS section, start_page AS page_number,
    printf({_q(fixed.WARN_UNKNOWN_RANGE)}, start_page, end_page) AS warning
  FROM docs WHERE NOT known
  UNION ALL
  SELECT bundle_id, 0, page_number, printf({_q(fixed.WARN_GLUED)}, page_number, current_type)
  FROM st WHERE kind = 'unmatched' AND known)"""


def _listed(where: str, section: int, template: str) -> str:
    return f"""
SELECT bundle_id, {section}, min(page_number), printf({_q(template)}, count(*),
  string_agg(page_number::VARCHAR, ', ' ORDER BY page_number), any_value(total))
FROM st JOIN (SELECT bundle_id, total FROM br) USING (bundle_id) WHERE {where}
GROUP BY bundle_id"""


ORACLE["bundle_warnings"] = (
    _SCAN["strict"] + "," + _WARN + "SELECT * FROM wn UNION ALL"
    + _listed("kind = 'removed'", 1, fixed.WARN_REMOVED) + f"""
UNION ALL SELECT bundle_id, 3, last_page, printf({_q(fixed.WARN_BREAKER)}, cand, total)
FROM br WHERE tripped"""
)
ORACLE["bundle_warnings_report"] = (
    _SCAN["report"] + "," + _WARN + "SELECT * FROM wn UNION ALL"
    + _listed("confirmed", 2, fixed.WARN_REPORT)
)
_SUMMARY = """
sm AS (SELECT bundle_id, page_count, coalesce(document_count, 0) AS document_count,
         coalesce(review_count, 0) AS review_count,
         CASE WHEN coalesce(review_count, 0) > 0 THEN 'requires_review' ELSE 'completed' END
           AS status
       FROM (SELECT bundle_id, count(*) AS page_count FROM st GROUP BY ALL)
       LEFT JOIN (SELECT bundle_id, count(*) AS document_count,
                         count(*) FILTER (requires_review) AS review_count
                  FROM docs GROUP BY ALL) USING (bundle_id))"""
ORACLE["bundle_status"] = _SPLIT + "," + _SUMMARY + "SELECT bundle_id, status FROM sm"
ORACLE["bundle_summary"] = _SCAN["remove"] + "," + _SUMMARY + "SELECT * FROM sm"
_DOC_LISTS = """
dl AS (
  SELECT d.*, coalesce(s.n, 0) AS n_sig, coalesce(r.n, 0) AS n_rea, coalesce(x.n, 0) AS n_rem,
    coalesce(s.l, '') AS sigs, coalesce(r.l, '') AS reas, coalesce(r.nl, '') AS rea_lines,
    coalesce(x.l, '') AS rems
  FROM docs d
  LEFT JOIN (SELECT bundle_id, document_index, count(*) AS n, string_agg(signal, ', '
               ORDER BY section, page_number, position) AS l FROM sig GROUP BY ALL) s
    USING (bundle_id, document_index)
  LEFT JOIN (SELECT bundle_id, document_index, count(*) AS n,
               string_agg(reason, '; ' ORDER BY section, page_number) AS l,
               string_agg(reason, chr(10) ORDER BY section, page_number) AS nl
             FROM rs GROUP BY ALL) r USING (bundle_id, document_index)
  LEFT JOIN (SELECT bundle_id, document_index, count(*) AS n, string_agg(page_number::VARCHAR,
               ', ' ORDER BY page_number) AS l FROM removed GROUP BY ALL) x
    USING (bundle_id, document_index))"""
_LISTS = _SCAN["remove"] + ",".join(
    ["", _REMOVED, _SIGNALS, _RULE_REASONS, _SUMMARY, _DOC_LISTS]
)
ORACLE["split_result_nested"] = _LISTS + """
SELECT sm.*, d.types, d.documents, d.signals, d.reasons, d.removed
FROM sm LEFT JOIN (SELECT bundle_id, string_agg(document_type, '|' ORDER BY document_index) AS types,
  count(*) AS documents, string_agg(coalesce(sigs, ''), '|' ORDER BY document_index) AS signals,
  string_agg(coalesce(reas, ''), '|' ORDER BY document_index) AS reasons,
  string_agg(coalesce(rems, ''), '|' ORDER BY document_index) AS removed
  FROM dl GROUP BY ALL) d USING (bundle_id)"""
ORACLE["split_result_nested_blocks"] = ORACLE["split_result_nested"]
ORACLE["child_rows"] = _LISTS + f"""
SELECT bundle_id, document_index, bundle_id AS parent_id, source AS company_id,
  document_type, requires_review,
  {_FILE_NAME.format(t="document_type", a="start_page", b="end_page")} AS output_file_name,
  rea_lines AS review_reasons_text,
  printf('Type: %s; pages %d-%d; confidence %.2f; requires review: %s', document_type,
         start_page, end_page, confidence, CASE WHEN requires_review THEN 'True' ELSE 'False' END)
  || CASE WHEN rems <> '' THEN '; usunieto puste strony: ' || rems ELSE '' END
  || CASE WHEN sigs <> '' THEN '; sygnaly: ' || sigs ELSE '' END
  || CASE WHEN reas <> '' THEN '; review reasons: ' || reas ELSE '' END AS comment
FROM dl JOIN documents ON doc_id = bundle_id"""
ORACLE["child_rows_blocks"] = ORACLE["child_rows"]
ORACLE["bundle_warnings_blocks"] = ORACLE["bundle_warnings"]
ORACLE["children_resume"] = _SPLIT + """
SELECT bundle_id, document_index, document_type FROM docs
LEFT JOIN (SELECT doc_id AS bundle_id, n_chars % 4 AS mark FROM documents WHERE lang <> 'de')
  USING (bundle_id)
WHERE document_index > coalesce(mark, 0)"""

# --- page operations ---------------------------------------------------------------------------------------------------

_REQUESTS = _LINES + """,
pcount AS (SELECT bundle_id, count(*) AS n FROM pg GROUP BY ALL),
ps AS (SELECT bundle_id, n, 'r' || bundle_id AS request_id, CASE bundle_id % 9
    WHEN 0 THEN 1 WHEN 1 THEN 1 WHEN 2 THEN 1 WHEN 7 THEN 1 END AS lo1,
  CASE bundle_id % 9 WHEN 0 THEN greatest(1, n // 2) WHEN 1 THEN 1 WHEN 2 THEN n WHEN 7 THEN 1
    END AS hi1,
  CASE bundle_id % 9 WHEN 1 THEN n WHEN 7 THEN (n + 1) // 2 END AS lo2,
  CASE bundle_id % 9 WHEN 1 THEN n WHEN 7 THEN n END AS hi2,
  CASE WHEN bundle_id % 18 = 12
         THEN 'Odwrocony zakres: ''99999999999999999999-9999999999999999'''
       WHEN bundle_id % 18 = 13
         THEN printf('Strona 99999999999999999999999999999999999999999 poza dokumentem (1-%d)', n)
       ELSE CASE bundle_id % 9 WHEN 3 THEN 'Odwrocony zakres: ''5-2'''
    WHEN 4 THEN 'Nieprawidlowy fragment zakresu: ''2-x'''
    WHEN 5 THEN printf('Strona %d poza dokumentem (1-%d)', n + 1, n)
    WHEN 6 THEN 'Zakres stron jest pusty'
    WHEN 8 THEN 'Nieprawidlowy numer strony: ''y''' END END AS error FROM pcount),
sel AS (SELECT request_id, bundle_id, n, page_number, text, coalesce(page_number
          BETWEEN lo1 AND hi1, FALSE) OR coalesce(page_number BETWEEN lo2 AND hi2, FALSE) AS chosen
        FROM ps JOIN pg USING (bundle_id) WHERE error IS NULL),
tot AS (SELECT request_id, count(*) FILTER (chosen) AS chosen_n, count(*) AS n
        FROM sel GROUP BY ALL),
ext AS (SELECT request_id, bundle_id, page_number, length(text) AS chars,
          (row_number() OVER (PARTITION BY request_id ORDER BY page_number))::INTEGER AS new_page
        FROM sel WHERE chosen),
rem AS (SELECT request_id, bundle_id, page_number, length(text) AS chars,
          (row_number() OVER (PARTITION BY request_id ORDER BY page_number))::INTEGER AS new_page
        FROM sel JOIN (SELECT request_id, chosen_n FROM tot) USING (request_id)
        WHERE NOT chosen AND chosen_n < n)"""
_EDITS = _with(_REQUESTS)
ORACLE["page_range"] = _EDITS + """
SELECT ps.request_id, error,
  CASE WHEN error IS NOT NULL THEN NULL
       WHEN lo2 IS NULL THEN lo1 || '-' || hi1
       WHEN lo2 <= hi1 + 1 THEN lo1 || '-' || greatest(hi1, hi2)
       ELSE lo1 || '-' || hi1 || ',' || lo2 || '-' || hi2 END AS intervals,
  chosen_n AS selected
FROM ps LEFT JOIN tot USING (request_id)"""
ORACLE["page_range_pages"] = _EDITS + "SELECT request_id, page_number FROM sel WHERE chosen"
ORACLE["pages_remove"] = _EDITS + "SELECT * FROM rem"
ORACLE["pages_extract"] = _EDITS + "SELECT * FROM ext"
ORACLE["pages_merge"] = _EDITS + """
SELECT bundle_id // 2 AS output_id, bundle_id, page_number, length(text) AS chars,
  (row_number() OVER (PARTITION BY bundle_id // 2
     ORDER BY CASE WHEN bundle_id % 2 = 1 THEN 1 ELSE 2 END, page_number))::INTEGER AS new_page
FROM pg"""
ORACLE["document_pages"] = _SCAN["remove"] + """
SELECT d.bundle_id, document_index, page_number,
  (row_number() OVER (PARTITION BY d.bundle_id, document_index ORDER BY page_number))::INTEGER
    AS new_page
FROM docs d JOIN st s ON s.bundle_id = d.bundle_id AND s.kind <> 'removed'
                     AND s.page_number BETWEEN d.start_page AND d.end_page"""
ORACLE["document_content"] = _SCAN["remove"] + """
SELECT d.bundle_id, document_index, count(*) AS pages,
  base64(encode(string_agg(f.text, chr(10) ORDER BY s.page_number))) AS content
FROM docs d JOIN st s ON s.bundle_id = d.bundle_id AND s.kind <> 'removed'
                     AND s.page_number BETWEEN d.start_page AND d.end_page
JOIN full_pg f ON f.bundle_id = s.bundle_id AND f.page_number = s.page_number
GROUP BY d.bundle_id, document_index"""
ORACLE["page_op_summary"] = _EDITS + """
SELECT request_id, 'scan' || bundle_id || '_strony.pdf' AS output_file_name,
       count(*) AS page_count FROM ext GROUP BY request_id, bundle_id
UNION ALL
SELECT request_id, 'scan' || bundle_id || '_bez-stron.pdf', count(*) FROM rem
GROUP BY request_id, bundle_id"""
ORACLE["pages_move"] = _EDITS + """
SELECT request_id, bundle_id, page_number, new_page, 'extracted' AS output
FROM ext JOIN tot USING (request_id) WHERE bundle_id % 2 <> 0 OR chosen_n < n
UNION ALL
SELECT request_id, bundle_id, page_number, new_page, 'source' FROM rem WHERE bundle_id % 2 = 0"""
ORACLE["pages_replace"] = _EDITS + """
SELECT request_id, bundle_id, page_number, new_page,
  CASE WHEN bundle_id % 2 = 0 THEN 'source' ELSE 'added' END AS output,
  'c' || (bundle_id % 3) AS category FROM rem
UNION ALL
SELECT request_id, bundle_id, page_number, page_number, 'source', 'c' || (bundle_id % 3)
FROM sel SEMI JOIN (SELECT request_id FROM tot WHERE chosen_n < n) t USING (request_id)
WHERE bundle_id % 2 <> 0"""
ORACLE["bundle_validate"] = f"""
SELECT o_orderkey AS bundle_id, CASE WHEN error IS NULL THEN 'accepted' ELSE 'failed' END AS status,
       error
FROM (SELECT o_orderkey, CASE WHEN o_orderpriority = '1-URGENT' THEN 'bad ' || o_orderstatus
        WHEN o_orderstatus = 'P' THEN {_q(fixed.ENCRYPTED_ERROR)} END AS error FROM orders)"""
ORACLE["prompt_render"] = _with(_LINES) + """
SELECT bundle_id, page_number,
  '{x} [' || CASE WHEN page_number % 2 = 0 THEN 'Alpha' ELSE 'BRAK' END || '] '
  || substring(text, 1, 4000) || ' <' || substring(coalesce(lag(text) OVER o, ''), 1, 2000) || '>'
  AS prompt
FROM pg WINDOW o AS (PARTITION BY bundle_id ORDER BY page_number)"""

ORACLE["prompt_formats"] = _with(_LINES, """
cx AS (SELECT bundle_id, page_number, substring(text, 1, 20) AS shown,
         CASE WHEN page_number % 2 = 0 THEN 'Alpha' ELSE 'BRAK' END AS cur,
         substring(coalesce(lag(text) OVER o, ''), 1, 3) AS before,
         substring(coalesce(lead(text) OVER o, ''), 2, 1) AS letter
       FROM pg WINDOW o AS (PARTITION BY bundle_id ORDER BY page_number))""") + """
SELECT bundle_id, page_number, CASE WHEN letter = '' THEN 'brak ' || cur ELSE
  CASE cur WHEN 'Alpha' THEN '**Alpha**' ELSE '**BRAK***' END
  || '|' || repeat(' ', 30 - length(shown)) || shown || '|' || before
  || repeat('0', 5 - length(before)) || '|' || letter || '|' || chr(39) || cur || chr(39) END AS prompt
FROM cx"""

# --- evaluation -----------------------------------------------------------------------------------------------------------

_EVAL = _with(_LINES, _replies(), f"""
cs AS (SELECT *, bundle_id || '-' || page_number || '-' || current_type AS id,
         page_number % 2 = 0 AS e_first,
         CASE page_number % 3 WHEN 0 THEN 'Alpha' WHEN 1 THEN 'O''Beta' END AS e_type,
         CASE WHEN page_number % 4 <> 0 THEN page_number % 8 < 4 END AS e_known,
         (page_number % 50) / 10.0::DOUBLE AS seconds FROM vj)""", """
er0 AS (SELECT *, CASE WHEN good IS NULL THEN '' ELSE concat_ws('|',
    CASE WHEN e_first <> v_first THEN printf('isFirstPage: oczekiwano %s, otrzymano %s',
      CASE WHEN e_first THEN 'True' ELSE 'False' END,
      CASE WHEN v_first THEN 'True' ELSE 'False' END) END,
    CASE WHEN e_type <> v_type THEN printf('documentType: oczekiwano %s, otrzymano ''%s''',
      CASE WHEN e_type = 'Alpha' THEN '''Alpha''' ELSE '"O''Beta"' END, v_type) END,
    CASE WHEN e_known <> v_known THEN printf('isKnownType: oczekiwano %s, otrzymano %s',
      CASE WHEN e_known THEN 'True' ELSE 'False' END,
      CASE WHEN v_known THEN 'True' ELSE 'False' END) END) END AS mismatches FROM cs),
er AS (SELECT id, good IS NOT NULL AND mismatches = '' AND guard = '' AS pass, seconds,
         CASE WHEN good IS NULL THEN 'unusable reply' END AS error, mismatches,
         coalesce(guard, '') AS guard FROM er0)""")
ORACLE["eval_cases"] = _EVAL + "SELECT * FROM er"
ORACLE["eval_summary"] = _EVAL + """
SELECT count(*) FILTER (pass) AS passed, count(*) AS total,
       round(sum(seconds), 1) AS total_seconds FROM er"""

# --- jobs -------------------------------------------------------------------------------------------------------------------

_EVENTS = """
ev AS (SELECT event_id AS seq, ts, user_id AS element_id, props AS error,
         CASE event_type WHEN 'signup' THEN 'submit' WHEN 'view' THEN 'running'
           WHEN 'purchase' THEN 'done' WHEN 'error' THEN 'failed' ELSE 'busy' END AS kind
       FROM events),
pk AS (SELECT *, last_value(CASE WHEN kind IN ('submit', 'done', 'failed', 'delete')
                                 THEN kind END IGNORE NULLS) OVER (
           PARTITION BY element_id ORDER BY seq
           ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM ev),
ac AS (SELECT *, kind = 'submit' AND coalesce(before <> 'submit', TRUE) AS accepted FROM pk),
lg AS (SELECT *, last_value(CASE WHEN accepted THEN seq END IGNORE NULLS) OVER r AS job_id,
         kind = 'running' AND coalesce(last_value(CASE WHEN accepted THEN 'submit'
             WHEN kind = 'running' THEN 'running' END IGNORE NULLS) OVER p = 'submit', FALSE)
           AS dequeues
       FROM ac WINDOW r AS (PARTITION BY element_id ORDER BY seq
                            ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
                      p AS (PARTITION BY element_id ORDER BY seq
                            ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
jb AS (SELECT job_id, any_value(element_id) AS element_id,
         coalesce(arg_max(CASE kind WHEN 'running' THEN 'running' WHEN 'done' THEN 'done' ELSE
           'failed' END, seq) FILTER (kind IN ('running', 'done', 'failed')), 'queued') AS status,
         min(ts) FILTER (accepted) AS created_at, max(ts) FILTER (kind = 'running') AS started_at,
         max(ts) FILTER (kind IN ('done', 'failed')) AS finished_at,
         arg_max(error, seq) FILTER (kind = 'failed') AS error
       FROM lg WHERE job_id IS NOT NULL GROUP BY job_id),
qp AS (SELECT *, CASE WHEN status = 'queued' THEN row_number() OVER (
           PARTITION BY status ORDER BY job_id) ELSE 0 END AS position FROM jb)"""
_JOBS = _with(_EVENTS)
_NOW = "TIMESTAMP '2024-02-01 00:00:00'"


def _secs(a: str, b: str) -> str:
    return f"((epoch_us({b}) - epoch_us({a})) / 1000000.0::DOUBLE)"


ORACLE["job_state"] = _JOBS + "SELECT * FROM jb"
ORACLE["dedup_submissions"] = _JOBS + """
SELECT seq, element_id, NOT accepted AS duplicate, job_id FROM lg WHERE kind = 'submit'"""
ORACLE["queue_position"] = _JOBS + "SELECT job_id, status, position FROM qp"
ORACLE["queue_stats"] = _JOBS + f"""
SELECT count(*) FILTER (status = 'queued') AS queued,
  count(*) FILTER (status = 'running') AS running, count(*) FILTER (status = 'done') AS done,
  count(*) FILTER (status = 'failed') AS failed,
  round(coalesce(max({_secs('created_at', _NOW)}) FILTER (status = 'queued'), 0), 1)
    AS oldest_queued_seconds
FROM jb"""
ORACLE["expired_jobs"] = _JOBS + f"""
SELECT job_id, status FROM jb
WHERE {_secs('finished_at', "TIMESTAMP '2024-01-20'")} > 86400"""
_JOB_STATUS = _with(
    _EVENTS, _TURNS, _DICTIONARY, _rules("pg"), _PLAIN_FACTS, _STATES, _DOCS, _SUMMARY, f"""
js AS (SELECT job_id, element_id, q.status, position,
         round(coalesce({_secs('started_at', f'coalesce(finished_at, {_NOW})')}, 0), 1)
           AS running_seconds,
         CASE WHEN q.status = 'done' THEN coalesce(page_count, 0) ELSE 0 END AS page_count,
         CASE WHEN q.status = 'done' THEN coalesce(document_count, 0) ELSE 0 END
           AS document_count,
         CASE WHEN q.status = 'done' THEN coalesce(review_count, 0) ELSE 0 END AS review_count,
         CASE WHEN q.status = 'failed' THEN error END AS error
       FROM qp q LEFT JOIN sm ON sm.bundle_id = q.element_id)""")
ORACLE["job_status"] = _JOB_STATUS + "SELECT * FROM js"
ORACLE["result_readiness"] = _JOBS + f"""
SELECT event_id AS lookup_id, event_id AS job_id,
  CASE WHEN status IS NULL THEN 404 WHEN status <> 'done' THEN 409 ELSE 200 END AS code,
  CASE WHEN status IS NULL THEN {_q(fixed.JOB_UNKNOWN)}
       WHEN status <> 'done' THEN printf({_q(fixed.JOB_NOT_FINISHED)}, status) END AS detail
FROM events LEFT JOIN jb ON jb.job_id = event_id"""
ORACLE["backlog_depth"] = _JOBS + """
SELECT seq, kind, depth, change = 1 AND depth - 1 >= 50 AS met_full_queue
FROM (SELECT *, sum(change) OVER (ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
        AS depth
      FROM (SELECT *, CASE WHEN accepted THEN 1 ELSE -1 END AS change FROM lg
            WHERE accepted OR dequeues))"""
_ATTEMPTS = """
ev2 AS (SELECT event_id AS seq, ts, user_id AS element_id, event_type FROM events),
ep AS (SELECT *, sum((event_type = 'signup')::INT) OVER (PARTITION BY element_id ORDER BY seq
         ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS epoch FROM ev2),
fa AS (SELECT *, sum((event_type = 'error')::INT) OVER (PARTITION BY element_id, epoch ORDER BY seq
         ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS attempts FROM ep),
tm AS (SELECT *, event_type = 'purchase' OR (event_type = 'error' AND attempts >= 3) AS terminal
       FROM fa),
ao AS (SELECT element_id, epoch, min(ts) AS entered_at,
         CASE arg_min(event_type, seq) FILTER (terminal) WHEN 'purchase' THEN 'GOTOWE'
              WHEN 'error' THEN 'BLAD' END AS outcome,
         coalesce(arg_min(attempts, seq) FILTER (terminal), max(attempts)) AS attempts
       FROM tm GROUP BY ALL)"""
ORACLE["attempts_outcome"] = _with(_ATTEMPTS) + "SELECT * FROM ao"
ORACLE["stalled_elements"] = _with(_ATTEMPTS) + f"""
SELECT element_id, epoch, entered_at
FROM (SELECT * FROM ao QUALIFY row_number() OVER (PARTITION BY element_id ORDER BY epoch DESC) = 1)
WHERE outcome IS NULL AND {_secs('entered_at', _NOW)} > 3600"""
ORACLE["status_text"] = _JOB_STATUS + "," + _ATTEMPTS + """
SELECT job_id, element_id, status,
  CASE status WHEN 'queued' THEN printf('%d. w kolejce', position)
    WHEN 'running' THEN printf('przetwarzanie (%d s)', round(running_seconds)::BIGINT)
    WHEN 'done' THEN printf('%d dok., %d do weryfikacji', document_count, review_count)
    ELSE CASE WHEN coalesce(attempts, 0) >= 3
              THEN printf('Zadanie %d zakonczone bledem: %s', job_id, coalesce(error, ''))
              ELSE printf('blad, ponowienie (%d): %s', coalesce(attempts, 0), coalesce(error, ''))
         END END AS text
FROM js LEFT JOIN (SELECT element_id, attempts FROM ao QUALIFY row_number() OVER (
  PARTITION BY element_id ORDER BY epoch DESC) = 1) USING (element_id)"""

ORACLE["poll_text"] = """
SELECT event_id AS job_id, user_id AS element_id,
  ['lost', 'busy', 'unreachable', 'timeout', 'failed', 'odd'][event_id % 6 + 1] AS status,
  CASE event_id % 6
    WHEN 0 THEN CASE WHEN coalesce(n, 0) >= 3 THEN printf('Zadanie %d przepadlo %d raz(y) - limit prob wyczerpany.', event_id, n)
                     ELSE printf('zadanie przepadlo, ponowienie (%d)', coalesce(n, 0)) END
    WHEN 1 THEN 'splitter zajety, ponowienie' WHEN 2 THEN 'splitter niedostepny, ponowienie'
    WHEN 3 THEN 'splitter nie odpowiada, ponowienie'
    WHEN 4 THEN CASE WHEN coalesce(n, 0) >= 3 THEN printf('Zadanie %d zakonczone bledem: %s', event_id, 'zly plik')
                     ELSE printf('blad, ponowienie (%d): %s', coalesce(n, 0), 'zly plik') END
  END AS text
FROM events LEFT JOIN (SELECT user_id, count(*) % 5 AS n FROM events WHERE user_id IS NOT NULL GROUP BY user_id) USING (user_id)"""

_METRICS = _verdict_split() + """,
jm AS (SELECT p.bundle_id, pages, coalesce(ocr_pages, 0) AS ocr_pages, llm_calls,
         coalesce(documents, 0) AS documents,
         coalesce(documents_requiring_review, 0) AS documents_requiring_review,
         n_chars / 8.0::DOUBLE AS duration_seconds
       FROM (SELECT bundle_id, count(*) AS pages, count(*) FILTER (kind = 'opened'
               OR (kind IN ('unmatched', 'verdict') AND NOT is_empty)) AS llm_calls
             FROM vst GROUP BY ALL) p
       LEFT JOIN (SELECT bundle_id, count(*) AS documents,
                    count(*) FILTER (forced OR confidence < 0.80::DOUBLE)
                      AS documents_requiring_review FROM vdocs GROUP BY ALL) d USING (bundle_id)
       LEFT JOIN (SELECT bundle_id, count(*) FILTER (filled) AS ocr_pages FROM merged
                  GROUP BY ALL) o USING (bundle_id)
       LEFT JOIN documents ON doc_id = p.bundle_id)"""
ORACLE["job_metrics"] = _METRICS + "SELECT * FROM jm"


def _totals(fn: str) -> str:
    names = ("pages", "ocr_pages", "llm_calls", "documents", "documents_requiring_review")
    review, docs = fn.format("documents_requiring_review"), fn.format("documents")
    return (
        f"{fn.replace('sum', 'count').format('bundle_id')} AS split_requests_total, "
        + ", ".join(f"{fn.format(c)}::BIGINT AS {c}_total" for c in names)
        + f", CASE WHEN {docs} > 0 THEN round({review}::DOUBLE / {docs}, 4) ELSE 0 END"
        " AS review_rate, "
        f"round({fn.format('duration_seconds')}, 3) AS processing_seconds_total"
    )


ORACLE["metrics_snapshot"] = _METRICS + f"SELECT {_totals('sum({})')} FROM jm"
ORACLE["metrics_running"] = (
    _METRICS + "SELECT bundle_id, " + _totals("sum({}) OVER r")
    + " FROM jm WINDOW r AS (ORDER BY bundle_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
)
