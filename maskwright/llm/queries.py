"""Queries of the training-data operators with production parameters, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import bpe, fingerprints, hmm_score, html_extract, jaccard_join, license_scan, mixing, quality_classifier, quality_rules, suffix_dedup

Query = Callable[[SparkSession, str], DataFrame]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _documents(operator: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, sf_dir: operator(_table(spark, sf_dir, "documents"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Query]:
    return {
        "op1_suffix_array_dedup": _documents(suffix_dedup.repeat_spans),
        "op2_document_fingerprints": _documents(fingerprints.fingerprints),
        "op3_quality_classifier": lambda spark, sf_dir: quality_classifier.classify(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")),
        "op4_html_extraction": lambda spark, sf_dir: html_extract.extract(_table(spark, sf_dir, "pages")),
        "op5_mixing_sources": _documents(mixing.copies),
        "op6_bpe_tokens": lambda spark, sf_dir: bpe.encode(_table(spark, sf_dir, "documents").select("doc_id", "text"), drop_text=True),
        "op7_quality_rules": _documents(quality_rules.quality_report),
        "op8_license_scan": _documents(license_scan.scan),
        "op9_hmm_score": _documents(hmm_score.scored),
        "op10_ngram_jaccard_join": _documents(jaccard_join.near_duplicates),
        "pipeline": pipeline,
    }


_WORD = r"[a-z0-9\x80-\x{10FFFF}]+"


def _repeats_sql(length: int = suffix_dedup.LENGTH) -> str:
    return rf"""
WITH w AS (SELECT DISTINCT doc_id, regexp_extract_all(text, '[^ \t\n\r\f\x0b]+') AS ws FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL),
p AS (SELECT doc_id, ws, unnest(range(0, len(ws) - {length - 1})) AS pos FROM w WHERE len(ws) >= {length}),
g AS (SELECT DISTINCT doc_id, pos, md5(array_to_string(ws[pos + 1:pos + {length}], ' ')) AS h FROM p),
r AS (SELECT doc_id, pos, row_number() OVER (PARTITION BY h ORDER BY doc_id, pos) AS nth, count(*) OVER (PARTITION BY h) AS n FROM g),
k AS (SELECT 'repeat' AS kind, doc_id, pos FROM r WHERE n > 1 UNION SELECT 'drop', doc_id, pos FROM r WHERE nth > 1),
b AS (SELECT *, CASE WHEN pos <= lag(pos) OVER (PARTITION BY kind, doc_id ORDER BY pos) + {length} THEN 0 ELSE 1 END AS begins FROM k),
s AS (SELECT *, sum(begins) OVER (PARTITION BY kind, doc_id ORDER BY pos) AS span FROM b)
SELECT doc_id, kind, CAST(min(pos) AS INTEGER) AS start_word, CAST(max(pos) + {length} AS INTEGER) AS end_word FROM s GROUP BY doc_id, kind, span"""


def _mixing_sql(percent: int = mixing.PERCENT, seed: int = mixing.SEED) -> str:
    return f"""
WITH d AS (SELECT doc_id, source, greatest(coalesce(n_chars, 0), 0) AS chars FROM documents),
m AS (SELECT *, CAST(1 + length(bin(chars)) AS BIGINT) AS measure FROM d),
t AS (SELECT source, count(*) AS n_rows, CAST(sum(measure) AS BIGINT) AS total, CAST(floor(sqrt(count(*))) AS BIGINT) AS weight FROM m GROUP BY source),
n AS (SELECT source, total, (sum(n_rows) OVER () * {percent} // 100) * weight // sum(weight) OVER () AS n FROM t),
r AS (SELECT m.*, CAST(n.n * measure // n.total AS BIGINT) AS whole, CAST(n.n * measure % n.total AS BIGINT) AS rest, n.total,
  (CAST(CAST('0x' || substr(md5('{seed}:' || coalesce(CAST(doc_id AS VARCHAR), 'null')), 1, 12) AS BIGINT) AS DOUBLE) + 0.5) / 281474976710656.0::DOUBLE AS u
  FROM m JOIN n ON m.source IS NOT DISTINCT FROM n.source),
q AS (SELECT *, CASE WHEN rest > 0 THEN u / (1::DOUBLE - u) * ((1::DOUBLE - rest::DOUBLE / total::DOUBLE) / (rest::DOUBLE / total::DOUBLE)) END AS q FROM r),
k AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY q NULLS LAST, doc_id, chars) AS nth, CAST(sum(rest) OVER (PARTITION BY source) AS BIGINT) // total AS many FROM q)
SELECT doc_id, source, CAST(whole + CASE WHEN q IS NOT NULL AND nth <= many THEN 1 ELSE 0 END AS BIGINT) AS copies FROM k
WHERE whole + CASE WHEN q IS NOT NULL AND nth <= many THEN 1 ELSE 0 END > 0"""


def _jaccard_sql(n: int = jaccard_join.N, num: int = jaccard_join.NUM, den: int = jaccard_join.DEN) -> str:
    return rf"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(lower(text), '{_WORD}') AS ws FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL),
t AS MATERIALIZED (SELECT DISTINCT doc_id, list_sort(list_distinct([array_to_string(ws[i:i + {n - 1}], ' ') FOR i IN range(1, greatest(2, len(ws) - {n - 2}))])) AS grams FROM w WHERE len(ws) > 0),
s AS MATERIALIZED (SELECT doc_id, grams, len(grams) AS size, row_number() OVER (ORDER BY doc_id, grams) AS u FROM t),
g AS (SELECT u, unnest(grams) AS gram FROM s),
c AS (SELECT a.u AS a, b.u AS b, count(*) AS common FROM g a JOIN g b ON a.gram = b.gram AND a.u < b.u GROUP BY a.u, b.u),
p AS MATERIALIZED (SELECT x.u AS a, x.doc_id AS d, y.u AS b, y.doc_id AS e FROM c JOIN s x ON a = x.u JOIN s y ON b = y.u WHERE common * {den} >= {num} * (x.size + y.size - common)),
l AS MATERIALIZED (SELECT d, e FROM p UNION ALL SELECT e, d FROM p),
n AS (SELECT d AS doc_id, count(*) AS n_links FROM l GROUP BY d),
o AS (SELECT DISTINCT d, e FROM l),
r AS (SELECT doc_id, doc_id AS class_id FROM n UNION SELECT r.doc_id, o.e FROM r JOIN o ON r.class_id = o.d)
SELECT n.doc_id, min(class_id) AS class_id, any_value(n_links) AS n_links FROM n JOIN r ON n.doc_id = r.doc_id GROUP BY n.doc_id"""


def _rules_sql() -> str:
    symbols = r"[#$%&*+<=>@\[\\\]^_{|}~!]"
    parts, joins, columns = [], [], []
    for n in (*quality_rules.TOP, *quality_rules.DUP):
        parts.append(f"""
g{n} AS (SELECT rid, i, array_to_string(ws[i:i + {n - 1}], ' ') AS gram, len(array_to_string(ws[i:i + {n - 1}], '')) AS chars FROM (SELECT rid, ws, unnest(range(1, len(ws) - {n - 2})) AS i FROM d WHERE len(ws) >= {n}))""")
        if n in quality_rules.TOP:
            parts.append(f"""
m{n} AS (SELECT rid, max(v) AS top FROM (SELECT rid, count(*) * any_value(chars) AS v FROM g{n} GROUP BY rid, gram HAVING count(*) > 1) GROUP BY rid)""")
            columns.append(f"CAST(least(coalesce(m{n}.top, 0), d.word_chars) AS BIGINT) AS top{n}")
        else:
            parts.append(f"""
r{n} AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, gram) AS c FROM g{n}) WHERE c > 1),
m{n} AS (SELECT rid, sum(len(ws[j])) AS dup FROM (SELECT DISTINCT r.rid, unnest(range(r.i, r.i + {n})) AS j FROM r{n} r) JOIN d USING (rid) GROUP BY rid)""")
            columns.append(f"CAST(coalesce(m{n}.dup, 0) AS BIGINT) AS dup{n}")
        joins.append(f"LEFT JOIN m{n} ON d.rid = m{n}.rid")
    over = {k: f"{k} * 100 > {limit} * {'line_chars' if k == 'dup_line' else 'raw_words' if k == 'symbol_words' else 'word_chars'}" + (f" AND n_words >= {quality_rules.TOP_FROM_WORDS}" if k.startswith("top") else "") for k, limit in quality_rules.LIMITS.items()}
    reasons = ", ".join(["CASE WHEN n_words = 0 THEN 'no_words' END", *(f"CASE WHEN {v} THEN '{k}' END" for k, v in over.items())])
    order = ", ".join(["doc_id", *quality_rules.COUNTS])
    return rf"""
WITH d0 AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),
d AS (SELECT rid, doc_id, text, regexp_extract_all(lower(text), '{_WORD}') AS ws, len(array_to_string(regexp_extract_all(lower(text), '{_WORD}'), '')) AS word_chars, regexp_extract_all(text, '[^ \t\n\r\f\x0b]+') AS raw FROM d0),
l AS (SELECT rid, sum(len(line)) AS line_chars, sum(CASE WHEN nth > 1 THEN len(line) ELSE 0 END) AS dup_line FROM
  (SELECT rid, line, row_number() OVER (PARTITION BY rid, line) AS nth FROM (SELECT rid, unnest(string_split(text, chr(10))) AS line FROM d) WHERE line <> '') GROUP BY rid),{','.join(parts)},
c AS (SELECT d.doc_id, CAST(len(d.ws) AS BIGINT) AS n_words, CAST(d.word_chars AS BIGINT) AS word_chars,
  CAST(coalesce(list_sum([CASE WHEN d.ws[i] = d.ws[i - 1] THEN len(d.ws[i]) ELSE 0 END FOR i IN range(2, len(d.ws) + 1)]), 0) AS BIGINT) AS echo, {', '.join(columns)},
  CAST(coalesce(l.line_chars, 0) AS BIGINT) AS line_chars, CAST(coalesce(l.dup_line, 0) AS BIGINT) AS dup_line, CAST(len(d.raw) AS BIGINT) AS raw_words,
  CAST(len(list_filter(d.raw, lambda x: regexp_matches(x, '{symbols}'))) AS BIGINT) AS symbol_words FROM d LEFT JOIN l ON d.rid = l.rid {' '.join(joins)}),
e AS (SELECT {order}, concat_ws(',', {reasons}) AS reasons FROM c)
SELECT *, reasons = '' AS keep FROM e"""


def _license_sql() -> str:
    k, rows = license_scan.K, []
    for name, text in sorted(license_scan.TEMPLATES.items()):
        w = license_scan.plain(text)
        rows += [f"('{name}', {len(w)}, {i}, '{' '.join(w[i : i + k])}')" for i in range(len(w) - k + 1)]
    return rf"""
WITH t(license, size, place, gram) AS (VALUES {', '.join(rows)}),
w AS (SELECT doc_id, regexp_extract_all(lower(text), '{_WORD}') AS ws FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL),
g AS (SELECT doc_id, i - 1 AS word, array_to_string(ws[i:i + {k - 1}], ' ') AS gram FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - {k - 2})) AS i FROM w WHERE len(ws) >= {k})),
v AS (SELECT DISTINCT doc_id, license, size, word, place, word - place AS diagonal FROM g JOIN t USING (gram)),
b AS (SELECT *, CASE WHEN diagonal - lag(diagonal) OVER (PARTITION BY doc_id, license ORDER BY diagonal) > {license_scan.APART} THEN 1 ELSE 0 END AS begins FROM v),
m AS (SELECT *, sum(begins) OVER (PARTITION BY doc_id, license ORDER BY diagonal RANGE UNBOUNDED PRECEDING) AS band FROM b),
z AS (SELECT doc_id, license, size, band, word, place, CASE WHEN (max(word) OVER b + {k} - min(word) OVER b) * 100 <= size * {license_scan.STRETCH} THEN 0 ELSE 1 + diagonal - min(diagonal) OVER b END AS copy FROM m WINDOW b AS (PARTITION BY doc_id, license, band)),
s AS (SELECT doc_id, license, size, CAST(min(word) AS INTEGER) AS start_word, CAST(max(word) + {k} AS INTEGER) AS end_word, count(*) AS votes,
  CAST(len(list_distinct(flatten(list(range(place, place + {k}))))) AS INTEGER) AS covered FROM z GROUP BY doc_id, license, size, band, copy),
f AS (SELECT * FROM s WHERE covered * 100 >= size * {license_scan.COVER} AND (end_word - start_word) * 100 <= size * {license_scan.STRETCH})
SELECT doc_id, license, start_word, end_word, votes, covered, size FROM f x WHERE NOT EXISTS (SELECT 1 FROM f y WHERE y.doc_id = x.doc_id AND y.start_word < x.end_word AND x.start_word < y.end_word
  AND (y.covered > x.covered OR (y.covered = x.covered AND (y.covered * x.size > x.covered * y.size OR (y.covered * x.size = x.covered * y.size AND y.license < x.license)))))"""


def oracle_sql() -> dict[str, str]:
    return {
        "op1_suffix_array_dedup": _repeats_sql(),
        "op5_mixing_sources": _mixing_sql(),
        "op7_quality_rules": _rules_sql(),
        "op8_license_scan": _license_sql(),
        "op10_ngram_jaccard_join": _jaccard_sql(),
    }
