"""DuckDB SQL of the registered queries, written apart from the operators: it shares tables of formats with them, and no expressions."""

from __future__ import annotations

import hashlib
import re

from ..functions import dummy, patterns as P, tokens
from . import fixtures as fx
from .queries import DUMMIES, FAMILIES, KEY, NORMAL

BLOCKS = f"b AS ({fx.blocks_sql('[{}]')})"
FIELDS = f"f AS ({fx.fields_sql('[{}]')})"
VALUES = f"v AS ({fx.VALUES_SQL})"
ANSWERS = f"a AS ({fx.ANSWERS_SQL})"
_TRIAGE = "t AS (SELECT *, CASE WHEN confidence >= 0.85::DOUBLE THEN 'auto_mask' ELSE 'needs_review' END AS review_status FROM f WHERE confidence >= 0.6::DOUBLE)"


def q(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def _lines(table: str, key: str, column: str, page: str = "", order: str = "") -> str:
    page, order = page or "CAST(n // 100 + 1 AS INTEGER)", order or "CAST(n % 100 AS INTEGER)"
    extra = ", turn" if "turn" in page else ""
    y = f"{order} * 20"
    return rf"""b AS (SELECT doc_id, {page} AS page, {order} AS block_ord, 'block_' || {page} || '_' || {order} AS block_id, text,
  [0, {y}, len(text) * 8, {y} + 16] AS bbox, 0.9::DOUBLE AS confidence
  FROM (SELECT doc_id{extra}, n - 1 AS n, regexp_replace(ls[n], '^\s+|\s+$', '', 'g') AS text FROM (SELECT doc_id{extra}, ls, unnest(range(1, len(ls) + 1)) AS n FROM
  (SELECT {key} AS doc_id{extra}, string_split({column}, chr(10)) AS ls FROM {table} WHERE {key} IS NOT NULL AND {column} IS NOT NULL))) WHERE len(text) >= 2)"""


DOCUMENTS = _lines("documents", "doc_id", "text")
SOURCES = {"documents_pii": DOCUMENTS, "pages_pii": _lines("pages", "page_id", "html"), "conversations_pii": _lines("conversations", "conv_id", "text", "CAST(turn AS INTEGER)", "CAST(n AS INTEGER)")}


def re2(p: P.Pattern) -> str:
    if p.trust == "email":
        return r"[a-z0-9%+._-]+@[a-z0-9.-]+\.[a-z]{2,}"
    body = p.form.replace("#", "[0-9]").replace("_", r"\s*").replace("L", "[A-Z]")
    return rf"\b(?:{body})\b" if p.whole else body


def _hits(names=lambda n: True) -> str:
    """h: the hits of all patterns in b."""
    parts = []
    for k, p in enumerate(P.PATTERNS):
        if not names(p.name):
            continue
        sure = {"email": "0.9::DOUBLE", "id": "0.88::DOUBLE"}.get(p.trust, "least(confidence * 0.7::DOUBLE, 0.75::DOUBLE)")
        parts.append(f"SELECT doc_id, page, block_ord, block_id, bbox, {k} AS k, '{p.name}' AS field_type, regexp_extract(text, {q(re2(p))}, 0, 'i') AS text, text AS block, {sure} AS confidence, '{p.risk}' AS risk_level, '{','.join(p.regulations)}' AS regulations FROM b WHERE len(text) >= 3 AND regexp_matches(text, {q(re2(p))}, 'i')")
    return f"h AS ({' UNION ALL '.join(parts)})"


_SHOWN = "SELECT doc_id, page, block_id, field_type, text, confidence, risk_level, regulations FROM "


def _detect(blocks: str, names=lambda n: True) -> str:
    return f"WITH {blocks}, {_hits(names)} {_SHOWN} h"


def _companies() -> str:
    ends = "|".join(s.replace(".", r"\.") for s in P.SUFFIXES)
    common = " + ".join(f"CAST(contains(lower(text), ' {w} ') AS INTEGER)" for w in P.SENTENCE)
    return rf"""c AS (SELECT doc_id, page, block_ord, block_id, 'company_name' AS field_type, text, least(confidence + 0.1::DOUBLE, 0.85::DOUBLE) AS confidence, 'MEDIUM' AS risk_level, 'GDPR,KVKK' AS regulations FROM b
  WHERE len(text) >= 5 AND len(trim(text)) <= 100 AND {common} < 2 AND (regexp_matches(upper(trim(text)), {q(rf'(?s)^.+[^ ] *({ends})$')}) OR regexp_matches(upper(trim(text)), {q(chr(40) + rf'^|[^A-Z0-9_\x80-\x{{10FFFF}}])[A-Z][A-Z0-9& ]+ ({ends})([., ]|$)')})))"""


def _review() -> str:
    return f"""WITH {FIELDS}, {_TRIAGE},
d AS (SELECT *, CASE WHEN src_ord % 5 <> 3 THEN ['Y','N','Y','N','Y','A','Y','N','S','N'][CAST((doc_id * 3 + src_ord) % 10 AS INTEGER) + 1] END AS answer FROM t WHERE review_status = 'needs_review'),
m AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY page, src_ord) AS nth FROM d),
r AS (SELECT doc_id, min(nth) AS nth, arg_min(answer, nth) AS rule FROM m WHERE answer IN ('A', 'S') GROUP BY doc_id)
SELECT doc_id, src_ord, review_status FROM t WHERE review_status = 'auto_mask' UNION ALL
SELECT m.doc_id, src_ord, review_status FROM m LEFT JOIN r USING (doc_id) WHERE CASE WHEN m.nth >= r.nth THEN rule = 'A' ELSE coalesce(answer = 'Y', false) END"""


_OVERLAP = "coalesce(greatest(least({a}[3], {b}[3]) - greatest({a}[1], {b}[1]), 0)::DOUBLE * greatest(least({a}[4], {b}[4]) - greatest({a}[2], {b}[2]), 0) / nullif(least(({a}[3] - {a}[1]) * ({a}[4] - {a}[2]), ({b}[3] - {b}[1]) * ({b}[4] - {b}[2])), 0), 0)"


def _nms() -> str:
    """One field of each group after the other, with those kept so far."""
    over = _OVERLAP.format(a="x.bbox", b="r.bbox")
    same = f"(x.block_id = r.block_id AND x.key = r.key) OR (x.bbox IS NOT NULL AND r.bbox IS NOT NULL AND {over} > 0.7)"
    return f"""WITH RECURSIVE {FIELDS},
r AS (SELECT *, lower(trim(text)) AS key, row_number() OVER (PARTITION BY doc_id, page, field_type ORDER BY confidence DESC, src_ord) AS nth FROM f),
g AS (SELECT doc_id, page, field_type, src_ord, nth, true AS kept, [{{'block_id': block_id, 'key': key, 'bbox': bbox}}] AS own FROM r WHERE nth = 1 UNION ALL
SELECT r.doc_id, r.page, r.field_type, r.src_ord, r.nth, len(list_filter(g.own, lambda x: coalesce({same}, false))) = 0,
  CASE WHEN len(list_filter(g.own, lambda x: coalesce({same}, false))) = 0 THEN list_append(g.own, {{'block_id': r.block_id, 'key': r.key, 'bbox': r.bbox}}) ELSE g.own END
  FROM g JOIN r ON r.doc_id = g.doc_id AND r.page = g.page AND r.field_type = g.field_type AND r.nth = g.nth + 1)
SELECT doc_id, page, src_ord, field_type FROM g WHERE kept"""


def _namespace(c: str) -> str:
    return "CASE " + " ".join(f"WHEN contains(lower({c}), '{k}') THEN '{ns}'" for k, ns in tokens.KEYWORDS) + " ELSE 'UNK' END"


def _hmac(message: str) -> str:
    raw = KEY.encode()
    raw = (hashlib.sha256(raw).digest() if len(raw) > 64 else raw).ljust(64, b"\0")
    inner, outer = (bytes(b ^ x for b in raw).hex() for x in (0x36, 0x5C))
    return f"sha256(unhex('{outer}') || unhex(sha256(unhex('{inner}') || encode({message}))))"


def _token(value: str, ns: str) -> str:
    return f"{ns} || '-' || upper(substr({_hmac(f'{ns} || chr(58) || {value}')}, 1, 8))"


def _number(h: str) -> str:
    return f"CAST('0x' || substr({h}, 1, 8) AS BIGINT)"


SEED = _number(f"sha256('{KEY}:' || lower(trim(raw)))")


def _label(x: str) -> str:
    labels = (r"T\.?C\.?\s*KIMLIK\s*NO\.?", r"KIMLIK\s*NO\.?", "ADI?", "SOYADI?", r"ADI?\s*SOYADI?", r"V\.?K\.?N\.?", "PLAKA", r"TEL\.?", "GSM", "E-?POSTA", "ADRES")
    rest = f"trim({x})"
    for label in labels:
        rest = f"regexp_replace({rest}, {q(f'^{label}' + chr(92) + 's*:?' + chr(92) + 's*')}, '', 'i')"
    return f"(CASE WHEN trim({rest}) = '' THEN {x} ELSE trim({rest}) END)"


def _key(value: str, kind: str) -> str:
    """ASCII values only."""
    v = _label(value)
    low = rf"replace(replace(regexp_replace(trim(lower({v})), '\s+', ' ', 'g'), '#', ''), '_', '')"
    letters = f"CASE WHEN regexp_full_match(replace({low}, ' ', ''), '[0-9]+') THEN {low} ELSE translate({low}, '01|!', 'olll') END"
    return rf"""CASE WHEN regexp_matches({kind}, 'plate|license') THEN upper(regexp_replace({v}, '[\s-]+', '', 'g')) WHEN regexp_matches({kind}, 'phone|tel|fax') THEN regexp_replace({v}, '[^0-9+]', '', 'g')
 WHEN contains({kind}, 'email') THEN trim(lower({v})) WHEN regexp_matches({kind}, 'ssn|nino|insee|national_id|tax_id|id_number') THEN upper(regexp_replace({v}, '[\s.-]', '', 'g')) ELSE trim(regexp_replace({letters}, '[.,;:!?''"-]', '', 'g')) END"""


def _draw(k: str, n: int) -> str:
    return f"{_number(f'sha256(seed || chr(58) || {k})')} % {n}"


def _pick(k: str, values) -> str:
    return f"[{', '.join(map(q, values))}][CAST({_draw(k, len(values))} AS INTEGER) + 1]"


def _chars(k: str, chars: str) -> str:
    return f"substr('{chars}', CAST({_draw(k, len(chars))} AS INTEGER) + 1, 1)"


def _string(n: str, chars: str) -> str:
    return f"array_to_string(list_transform(range(1, CAST({n} AS BIGINT) + 1), lambda k: {_chars('k', chars)}), '')"


def _replacement() -> dict[str, str]:
    c = "substr(raw, CAST(k AS BIGINT), 1)"
    other = f"CASE WHEN regexp_matches({c}, '[0-9]') THEN {_chars('k', dummy.DIGITS)} WHEN contains('{dummy.SPACERS}', {c}) THEN {c} WHEN regexp_matches({c}, '[a-z]') THEN lower({_chars('k', dummy.UPPER)}) WHEN regexp_matches({c}, '[A-Z]') THEN {_chars('k', dummy.UPPER)} ELSE {_chars('k', dummy.MIXED)} END"
    same = f"array_to_string(list_transform(range(1, len(raw) + 1), lambda k: {other}), '')"
    n = "len(string_split(trim(raw), ' '))"
    parts = f"list_transform(range(1, {n} + 1), lambda k: CASE WHEN k < {n} THEN {_pick('k', dummy.FIRST)} ELSE {_pick('k', dummy.LAST)} END)"
    ending = "CASE " + " ".join(f"WHEN suffix(trim(raw), {q(e)}) THEN {q(e)}" for e in dummy.ENDINGS) + " ELSE '' END"
    body = f"trim(left(trim(raw), len(trim(raw)) - len({ending})))"
    name = f"CASE WHEN contains({body}, ' ') THEN {_pick('1', dummy.BODY)} || ' ' || {_pick('2', dummy.TRADE)} ELSE {_pick('1', dummy.BODY)} END"
    local, domain = "regexp_extract(raw, '^(.*)@', 1)", "regexp_extract(raw, '@([^@]*)$', 1)"
    day = f"(DATE '{dummy.ANCHOR}' - CAST({_draw('1', 62 * 365)} + {18 * 366} AS INTEGER))"
    short = "len(translate(raw, ' -', ''))"
    return {
        "person_name": f"CASE WHEN {n} = 1 THEN {_pick('1', dummy.FIRST + dummy.LAST)} ELSE array_to_string({parts}, ' ') END",
        "company_name": f"{name} || CASE WHEN {ending} = '' THEN '' ELSE ' ' || {ending} END",
        "phone": same, "national_id": same, "license_plate": same,
        "email": f"CASE WHEN contains(raw, '@') THEN {_string(f'greatest(len({local}), 5)', dummy.SMALL)} || '@example.' || CASE WHEN contains({domain}, '.') THEN regexp_extract({domain}, '[^.]*$') ELSE 'com' END ELSE 'user' || ({_draw('1', 900)} + 100) || '@example.com' END",
        "address": f"CASE WHEN regexp_matches(raw, '[0-9]') THEN ({_draw('1', 999)} + 1) || ' ' ELSE '' END || {_pick('2', dummy.STREET)} || CASE WHEN contains(raw, ',') OR contains(raw, chr(10)) THEN ', ' || {_pick('3', dummy.CITY)} ELSE '' END",
        "date_of_birth": f"CASE WHEN contains(raw, '/') THEN strftime({day}, '%d/%m/%Y') WHEN contains(raw, '.') OR NOT contains(raw, '-') THEN strftime({day}, '%d.%m.%Y') ELSE strftime({day}, '%Y-%m-%d') END",
        "reference": _string(f"CASE WHEN {short} < 6 THEN 8 ELSE {short} END", dummy.MIXED),
        "other": f"CASE WHEN regexp_full_match(raw, '[0-9]+') THEN {_string('len(raw)', dummy.DIGITS)} WHEN regexp_full_match(raw, '[A-Za-z]+') THEN {_string('len(raw)', dummy.UPPER)} ELSE {_string('len(raw)', dummy.MIXED)} END",
        "signature": "'[SIGNATURE]'", "stamp": "'[STAMP]'",
    }


def _dummies(kinds: str) -> str:
    made = _replacement()
    case = "CASE WHEN trim(raw) = '' THEN raw " + " ".join(f"WHEN field_type = '{k}' THEN {made[k]}" for k in kinds.split()) + " END"
    # The table's k goes under another name, as lambdas have a k.
    return f"WITH {VALUES}, s AS (SELECT k AS id, raw, field_type, {SEED} AS seed FROM v WHERE field_type IN ({', '.join(map(q, kinds.split()))})) SELECT id AS k, {case} AS replacement FROM s"


def _known() -> str:
    """n: every key where it occurs first, of the fields that the detectors find in b."""
    return f"""{BLOCKS}, {_hits()}, {_companies()},
x AS (SELECT doc_id, page, block_ord * {len(P.PATTERNS)} + k AS nth, 0 AS late, confidence, field_type, text AS raw, 'pattern_match' AS method FROM h UNION ALL SELECT doc_id, page, block_ord, 1, confidence, field_type, text, 'legal_suffix' FROM c),
y AS (SELECT *, {_key('raw', 'field_type')} AS key FROM x),
z AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY doc_id, page, confidence DESC, late, nth) AS turn FROM y),
n AS (SELECT *, {_namespace('field_type')} AS ns FROM z WHERE turn = 1)"""


def _records() -> str:
    return f"{_known()}, g AS (SELECT sha256(key) AS normalized_hash, {_token('key', 'ns')} AS token, ns AS namespace, doc_id AS document_id, 'page:' || page || '|type:' || field_type || '|method:' || method AS field_context FROM n)"


_MASKED = f"""{BLOCKS}, {_hits()}, l AS (SELECT doc_id, page, block_id, {_token('text', _namespace('field_type'))} AS new, row_number() OVER (PARTITION BY doc_id, page, block_id ORDER BY confidence, k DESC) AS back FROM h),
m AS (SELECT b.doc_id, b.page, b.block_ord, b.block_id, coalesce(l.new, b.text) AS text, l.new IS NOT NULL AS is_masked FROM b LEFT JOIN l ON b.doc_id = l.doc_id AND b.page = l.page AND b.block_id = l.block_id AND back = 1)"""


def _full(table: str) -> str:
    return f"SELECT doc_id, page, count(*) AS n_blocks, string_agg(text, ' ' ORDER BY block_ord) AS full_text FROM {table} GROUP BY doc_id, page"


def _leaks() -> str:
    forms = {"email": r"(?i)[a-z0-9%+._-]+@[a-z0-9.-]+\.[a-z]{2,}", "ssn": r"[0-9]{3}-[0-9]{2}-[0-9]{4}", "phone": r"\+?[1-9][0-9]{6,14}"}
    all_ = " UNION ALL ".join(f"SELECT doc_id, page, '{k}' AS field_type, unnest(regexp_extract_all(full_text, {q(p)})) AS text FROM w" for k, p in forms.items())
    return rf"""{BLOCKS}, {_hits()}, w AS ({_full('b')}),
p AS (SELECT * FROM ({all_}) WHERE len(text) >= 4 AND NOT regexp_matches(text, '[A-Z]{{3}}-[A-F0-9]{{8}}|\[MASKED\]|\[REDACTED\]|XXXX|\*\*\*\*')),
o AS (SELECT DISTINCT doc_id, lower(trim(text)) AS text FROM h WHERE len(trim(text)) >= 5),
e AS (SELECT b.doc_id, b.page, o.text, arg_min(b.bbox[2], block_ord) AS y1 FROM b JOIN o ON b.doc_id = o.doc_id AND contains(lower(b.text), o.text) GROUP BY b.doc_id, b.page, o.text)"""


def _verdicts() -> str:
    return f"""{_leaks()}, k AS (SELECT doc_id, count(*) AS n, count(DISTINCT page) FILTER (kind = 0) AS bad, max(kind) AS worst FROM (SELECT doc_id, page, 0 AS kind FROM p UNION ALL SELECT doc_id, page, 1 FROM e) GROUP BY doc_id),
r AS (SELECT d.doc_id, coalesce(n, 0) AS n_leaks, pages_checked, CASE WHEN n IS NULL THEN 'passed' WHEN worst = 1 THEN 'failed' ELSE 'warning' END AS status,
  CASE WHEN n IS NULL THEN 1.0::DOUBLE WHEN worst = 1 THEN 0.0::DOUBLE ELSE greatest(0.3::DOUBLE, pow(0.7::DOUBLE, bad) * 0.5::DOUBLE) END AS confidence_score
  FROM (SELECT doc_id, count(DISTINCT page) AS pages_checked FROM b GROUP BY doc_id) d LEFT JOIN k ON d.doc_id = k.doc_id)"""


def _stat(dimension: str, value: str, source: str = "f") -> str:
    return f"SELECT doc_id, '{dimension}' AS dimension, {value} AS value, count(*) AS n FROM {source} GROUP BY doc_id, {value}"


_STATS = {"stats_by_type": _stat("type", "field_type"), "stats_by_page": _stat("page", "CAST(page AS VARCHAR)"), "stats_by_regulation": _stat("regulation", "r", "(SELECT doc_id, unnest(regulations) AS r FROM f)"), "stats_by_risk": _stat("risk_level", "coalesce(risk_level, 'UNKNOWN')")}
_METHOD = "CASE WHEN field_type IN ('stamp', 'signature', 'seal', 'handwriting') OR detection_method = 'visual_detection' THEN 'contour' ELSE 'white_box_overlay' END"
_RUNS = f"""WITH {VALUES}, d AS (SELECT DISTINCT raw FROM v), c AS (SELECT raw, i, substr(raw, i, 1) AS c FROM (SELECT raw, unnest(range(1, len(raw) + 1)) AS i FROM d)),
k AS (SELECT *, CASE WHEN regexp_matches(c, '[0-9]') THEN 'D' WHEN regexp_matches(c, '[A-Za-z]') THEN 'L' WHEN contains('{dummy.SPACERS}', c) THEN 'S' ELSE 'X' END AS kind FROM c),
g AS (SELECT *, i - row_number() OVER (PARTITION BY raw, kind ORDER BY i) AS isle FROM k), r AS (SELECT raw, kind, min(i) AS i, count(*) AS length FROM g GROUP BY raw, kind, isle)
SELECT raw, CAST(row_number() OVER (PARTITION BY raw ORDER BY i) - 1 AS INTEGER) AS nth, kind, CAST(length AS INTEGER) AS length FROM r"""
_SHARE = f"WITH {FIELDS} SELECT f.doc_id, f.src_ord, g.src_ord AS other, {_OVERLAP.format(a='f.bbox', b='g.bbox')}::DOUBLE AS share FROM f JOIN f g ON f.doc_id = g.doc_id AND f.src_ord < g.src_ord WHERE f.bbox IS NOT NULL AND g.bbox IS NOT NULL"
_CLAMP = f"""WITH {FIELDS}, c AS (SELECT *, greatest(0, least(bbox[1], 119)) AS x1, greatest(0, least(bbox[2], 29)) AS y1 FROM f WHERE bbox IS NOT NULL)
SELECT doc_id, src_ord, x1, y1, greatest(x1 + 1, least(bbox[3], 120)) AS x2, greatest(y1 + 1, least(bbox[4], 30)) AS y2,
  greatest(8, least(60, CAST(trunc(trunc((bbox[4] - bbox[2]) * 0.75::DOUBLE) * 0.7::DOUBLE + trunc((bbox[3] - bbox[1]) / (len(text) * 0.55::DOUBLE)) * 0.3::DOUBLE) AS INTEGER))) AS size FROM c"""


def oracle_sql() -> dict[str, str]:
    pick = "SELECT * FROM"
    out = {
        "flagship_regulations": f"WITH {DOCUMENTS}, {_hits(lambda n: n in ('email', 'ip_address'))} SELECT regulation, count(*) AS n_fields FROM (SELECT unnest(string_split(regulations, ',')) AS regulation FROM h) GROUP BY regulation",
        "blocks_from_documents": f"WITH {DOCUMENTS} SELECT doc_id, page, block_ord, block_id, text FROM b",
        "block_stats_by_doc": f"WITH {DOCUMENTS} {_full('b')}",
        "detect_email": _detect(DOCUMENTS, lambda n: n == "email"),
        "detect_ip": _detect(DOCUMENTS, lambda n: n == "ip_address"),
        "detect_all_patterns": _detect(BLOCKS),
        "detect_company_suffix": f"WITH {BLOCKS}, {_companies()} {_SHOWN} c",
        **{name: _detect(b) for name, b in SOURCES.items()},
        "triage_counts": f"WITH {FIELDS}, {_TRIAGE} SELECT review_status, count(*) AS n FROM t GROUP BY review_status",
        "review_queue": f"WITH {FIELDS}, {_TRIAGE} SELECT doc_id, src_ord, confidence FROM t WHERE review_status = 'needs_review'",
        "review_decisions": _review(),
        "dedup_nms": _nms(),
        "bbox_overlap": _SHARE,
        "bbox_clamp": _CLAMP,
        "signature_flag": f"WITH {FIELDS} SELECT field_type, detection_method, count(*) AS n, detection_method = 'visual_detection' OR field_type IN ('stamp', 'signature') OR (regexp_matches(field_type, 'signature|stamp') AND NOT regexp_matches(field_type, 'name|number')) AS is_mark, {_METHOD} AS masking_method FROM f GROUP BY field_type, detection_method",
        "label_strip": f"WITH {BLOCKS} SELECT doc_id, block_id, {_label('text')} AS value FROM b",
        "token_hash_seed": f"WITH {VALUES}, s AS (SELECT *, {_namespace('field_type')} AS ns FROM v) SELECT k, ns, {_token('raw', 'ns')} AS token, sha256(raw) AS hash, {SEED} AS seed FROM s",
        "namespace_of": f"WITH {FIELDS} SELECT field_type, count(*) AS n, {_namespace('field_type')} AS namespace FROM f GROUP BY field_type",
        "analyze_pattern_rle": _RUNS,
        "canonical_exact": f"WITH {_known()} SELECT key, key AS leader, {_token('key', 'ns')} AS token FROM n",
        "registry_first_seen": f"WITH {_records()} {pick} g",
        "registry_stats": f"WITH {_records()} SELECT namespace, count(*) AS n_tokens FROM g GROUP BY namespace",
        "registry_merge": f"WITH {_records()} {pick} g WHERE document_id % 2 = 0 UNION ALL SELECT * REPLACE ('LATE-' || token AS token) FROM g WHERE document_id % 2 <> 0",
        "mask_blocks": f"WITH {_MASKED} SELECT doc_id, page, block_id, text, is_masked FROM m",
        "masked_full_text": f"WITH {_MASKED} {_full('m')}",
        "leak_patterns": f"WITH {_leaks()} {pick} p",
        "leak_originals": f"WITH {_leaks()} {pick} e",
        "verify_status": f"WITH {_verdicts()} SELECT doc_id, status, confidence_score, pages_checked, n_leaks FROM r",
        "verify_report": f"WITH {_verdicts()} SELECT doc_id, status AS verification_status, round(confidence_score, 3) AS confidence_score, pages_checked, n_leaks, status = 'passed' AS passed, CASE status WHEN 'failed' THEN 2 WHEN 'warning' THEN 1 ELSE 0 END AS n_todo FROM r",
        **{name: f"WITH {FIELDS} {sql}" for name, sql in _STATS.items()},
        "stats_grouping_sets": f"WITH {FIELDS} " + " UNION ALL ".join([*_STATS.values(), _stat("total", "'all'")]),
        "doc_report": f"WITH {FIELDS} SELECT doc_id, count(*) OVER (PARTITION BY doc_id) AS total_masked_fields, (SELECT count(DISTINCT page) FROM f g WHERE g.doc_id = f.doc_id) AS total_pages, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY page, src_ord) AS INTEGER) AS field_id, field_type AS type, page, {_METHOD} AS masking_method, risk_level FROM f",
        "error_report": "SELECT s_name AS document, 'failed' AS status, 'File not found: ' || s_name AS error FROM supplier WHERE s_acctbal < 0",
        "dry_run_report": f"WITH {FIELDS}, {_TRIAGE} SELECT doc_id, 'dry_run' AS status, count(*) AS n_fields, count(*) FILTER (review_status = 'auto_mask') AS n_auto, count(*) FILTER (review_status = 'needs_review') AS n_review FROM t GROUP BY doc_id",
        "batch_summary": f"WITH {FIELDS}, d AS (SELECT doc_id, count(DISTINCT page) AS p, count(*) AS n FROM f GROUP BY doc_id), x AS (SELECT count(*) AS bad FROM supplier WHERE s_acctbal < 0) SELECT count(*) + any_value(bad) AS total_documents, count(*) AS successful, any_value(bad) AS failed, CAST(sum(p) AS BIGINT) AS total_pages, CAST(sum(n) AS BIGINT) AS total_masked_fields, round(sum(n)::DOUBLE / count(*), 2) AS fields_per_document, (SELECT count(*) FROM f WHERE field_type = 'signature') AS signatures, CAST(any_value(bad) AS INTEGER) AS listed FROM d, x",
        "response_texts": f"""WITH {FIELDS}, {ANSWERS}, j AS (SELECT doc_id, page, unnest(CAST(json_extract(regexp_extract(raw, '(?s)\\{{.*\\}}'), '$.text_detections[*]') AS JSON[])) AS d FROM a WHERE contains(raw, '_detections')),
e AS (SELECT doc_id, page, d->>'block_id' AS block_id, d->>'category' AS kind, d->>'sensitive_value' AS text, d->>'label' AS label, CAST(d->>'confidence' AS DOUBLE) AS confidence, d->>'risk_level' AS risk FROM j),
g AS (SELECT doc_id, page, block_id, struct_extract(arg_max({{'x': bbox[1]}}, src_ord), 'x') AS x1 FROM f GROUP BY doc_id, page, block_id)
SELECT e.doc_id, e.block_id, coalesce(kind, 'unknown') AS field_type, text, label, coalesce(confidence, 0.5::DOUBLE) AS confidence, coalesce(risk, 'MEDIUM') AS risk_level, x1 FROM e LEFT JOIN g ON e.doc_id = g.doc_id AND e.page = g.page AND e.block_id = g.block_id""",
        "response_visuals": f"""WITH {ANSWERS}, j AS (SELECT doc_id, unnest(CAST(json_extract(regexp_extract(raw, '(?s)\\{{.*\\}}'), '$.visual_detections[*]') AS JSON[])) AS d FROM a WHERE contains(raw, '_detections'))
SELECT doc_id, d->>'element_id' AS block_id, d->>'type' AS field_type, '[' || upper(d->>'type') || ']' AS text, CAST(d->>'confidence' AS DOUBLE) AS confidence, true AS is_visual, {', '.join(f"CAST(d->'bbox'->>'{c}' AS INTEGER) AS {c}" for c in ('x1', 'y1', 'x2', 'y2'))} FROM j""",
        "response_prompts": f"""WITH {DOCUMENTS}, o AS (SELECT *, row_number() OVER (PARTITION BY doc_id, page ORDER BY block_ord, block_id) AS nth FROM b)
SELECT doc_id, page, count(*) AS n_blocks, sha256(string_agg(block_id || chr(10) || text, chr(10) ORDER BY nth)) AS asked FROM o WHERE nth <= 60 GROUP BY doc_id, page""",
        "response_language": "SELECT n_nationkey, CASE n_nationkey % 3 WHEN 0 THEN 'en,fr' WHEN 1 THEN 'en,de' ELSE 'en' END AS languages, CASE n_nationkey % 3 WHEN 0 THEN 'fr_FR' WHEN 1 THEN 'de_DE' ELSE 'en_US' END AS locale FROM nation",
        "small_functions": "WITH s AS (SELECT *, floor(o_totalprice)::DOUBLE / 4.0::DOUBLE AS x, CAST(floor(floor(o_totalprice) / 4) AS BIGINT) AS w, CAST(round_even(floor(o_totalprice)::DOUBLE / 4.0::DOUBLE - 60 * floor(floor(o_totalprice)::DOUBLE / 240.0::DOUBLE), 0) AS BIGINT) AS rest FROM orders) SELECT o_orderkey, CASE WHEN x < 60 THEN printf('%.1fs', x) WHEN x < 3600 THEN (w // 60) || 'm ' || rest || 's' ELSE (w // 3600) || 'h ' || (w % 3600 // 60) || 'm ' || rest || 's' END AS took, 'page:' || o_custkey || '|type:' || o_orderstatus || '|method:m' AS context, CASE WHEN len(o_orderpriority) * 6 > 50 THEN left(repeat(o_orderpriority, 6), 50) || '...' ELSE repeat(o_orderpriority, 6) END AS short FROM s",
        "stream_detect": f"WITH {DOCUMENTS}, {_hits()}, {_companies()} SELECT doc_id, page, block_id, field_type, text FROM h UNION ALL SELECT doc_id, page, block_id, field_type, text FROM c",
    }
    out |= {name: _detect(BLOCKS, lambda n, r=rx: bool(re.search(r, n))) for name, rx in FAMILIES.items()}
    out |= {name: f"WITH {VALUES} SELECT k, {_key('raw', 'field_type')} AS key FROM v WHERE field_type IN ({', '.join(map(q, kinds.split()))})" for name, kinds in NORMAL.items()}
    out |= {name: _dummies(kinds) for name, kinds in DUMMIES.items()}
    return out
