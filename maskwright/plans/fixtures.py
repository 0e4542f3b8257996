"""Tables for the queries, computed from the star schema by expressions that Spark and DuckDB both read.

The given documents hold few kinds of personal data; these hold all.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F


def _pad(x: str, n: int) -> str:
    return f"lpad(CAST({x} AS STRING), {n}, '0')"


_K = "c_custkey"
_TEXTS = [
    f"'Contact: ' || lower(replace(c_name, '#', '.')) || '@mail' || CAST({_K} % 7 AS STRING) || '.example.com'",
    f"'SSN ' || {_pad(f'{_K} % 1000', 3)} || '-' || {_pad(f'{_K} % 100', 2)} || '-' || {_pad(f'{_K} % 10000', 4)}",
    f"'Phone +1 555 ' || {_pad(f'{_K} % 1000', 3)} || ' ' || {_pad(f'{_K} % 10000', 4)}",
    f"{_pad(f'{_K} % 81 + 1', 2)} || ' ABC ' || {_pad(f'{_K} % 1000', 3)}",
    f"'Tel +44 ' || {_pad(f'{_K} % 10000', 4)} || ' ' || {_pad(f'{_K} * 7 % 1000000', 6)} || ' ext 5'",
    f"'NI AB ' || {_pad(f'{_K} % 100', 2)} || ' 34 ' || {_pad(f'{_K} % 97', 2)} || ' C'",
    f"'Post SW' || CAST({_K} % 10 AS STRING) || 'A 1AA, London'",
    f"'Acme ' || c_mktsegment || CASE WHEN {_K} % 2 = 0 THEN ' Ltd' ELSE ' GmbH & Co. KG' END",
    f"'Server 10.' || CAST({_K} % 256 AS STRING) || '.0.' || CAST({_K} % 100 AS STRING) || ' port 80'",
    f"'TEL: +49 ' || {_pad(f'{_K} % 1000', 3)} || ' ' || {_pad(f'{_K} * 13 % 10000000', 7)} || ' and 12345678Z'",
    f"'Code RSSMRA' || {_pad(f'{_K} % 100', 2)} || 'A01H' || {_pad(f'{_K} % 1000', 3)} || 'Z'",
    "'Signed 2024-01-02, thank you for the business and goodbye Ltd'",
    f"'A' || {_pad(f'{_K} % 1000', 3)} || 'BC 77 or AB-' || {_pad(f'{_K} % 1000', 3)} || '-CD or AB12 CDE'",
    f"'ADI: ' || c_name || ' ' || CAST({_K} % 5 AS STRING) || ' +33 1 22 33 44 55 +7 999 123 45 67 +90 555 123 45 67'",
    f"'NIR 1 85 05 78 006 ' || {_pad(f'{_K} % 1000', 3)} || ' 91; AB 123 CD; 1234 BCD'",
    f"'all rights reserved ' || {_pad(_K, 6)}",
]
TEXT = f"CASE {_K} % {len(_TEXTS)} " + " ".join(f"WHEN {k} THEN {t}" for k, t in enumerate(_TEXTS)) + " END"
_SURE = "CAST(0.5 AS DOUBLE) + CAST({k} % 50 AS DOUBLE) / CAST(100 AS DOUBLE)"


def blocks_sql(array: str) -> str:
    """array: how the dialect writes one, with {} for its items."""
    box = array.format(f"10, CAST({_K} % 10 * 20 AS INT), 210, CAST({_K} % 10 * 20 + 16 AS INT)")
    page, order = f"CAST(floor(({_K} % 20) / 10) AS INT) + 1", f"CAST({_K} % 10 AS INT)"
    return f"SELECT CAST(floor({_K} / 20) AS BIGINT) AS doc_id, {page} AS page, {order} AS block_ord, 'block_' || CAST({page} AS STRING) || '_' || CAST({order} AS STRING) AS block_id, {TEXT} AS text, {box} AS bbox, {_SURE.format(k=_K)} AS confidence FROM customer"


#: Values of every type that is replaced: k, raw, field_type.
_VALUES = {
    "person_name": "CASE o_orderkey % 3 WHEN 0 THEN 'Ada' WHEN 1 THEN 'Ada Lovelace' ELSE 'Ada Maria King Noel' END || CAST(o_custkey % 50 AS STRING)",
    "company_name": "'Widget Works ' || CAST(o_custkey % 90 AS STRING) || CASE o_orderkey % 4 WHEN 0 THEN ' Ltd' WHEN 1 THEN ' & Co.' WHEN 2 THEN ' GmbH' ELSE '' END",
    "phone": f"'+1 (555) ' || {_pad('o_custkey % 1000', 3)} || '-' || {_pad('o_orderkey % 10000', 4)}",
    "national_id": f"{_pad('o_custkey % 1000', 3)} || '-' || {_pad('o_orderkey % 100', 2)} || '-' || {_pad('o_orderkey % 10000', 4)}",
    "license_plate": f"{_pad('o_custkey % 81', 2)} || ' Abc ' || {_pad('o_orderkey % 1000', 3)} || '#'",
    "email": f"CASE o_orderkey % 5 WHEN 0 THEN 'nobody' ELSE 'u' || CAST(o_custkey AS STRING) || '@mail.example.co.uk' END",
    "address": "CASE o_orderkey % 3 WHEN 0 THEN CAST(o_custkey AS STRING) || ' High Street, Leeds' WHEN 1 THEN CAST(o_custkey AS STRING) || ' High Street' ELSE 'Mill Lane' END",
    "date_of_birth": "CASE o_orderkey % 3 WHEN 0 THEN '01/02/1980' WHEN 1 THEN '1980-02-01' ELSE '01.02.1980' END || CAST(o_custkey AS STRING)",
    "reference": "CASE o_orderkey % 2 WHEN 0 THEN 'R-1' ELSE 'REF-2024-' END || CAST(o_custkey AS STRING)",
    "other": "CASE o_orderkey % 3 WHEN 0 THEN CAST(o_custkey AS STRING) WHEN 1 THEN 'abc' ELSE 'mixed ' || CAST(o_custkey AS STRING) END",
    "signature": "'J. Doe'",
    "stamp": "' '",
}
VALUE = f"CASE o_orderkey % {len(_VALUES)} " + " ".join(f"WHEN {k} THEN {v}" for k, v in enumerate(_VALUES.values())) + " END"
KIND = f"CASE o_orderkey % {len(_VALUES)} " + " ".join(f"WHEN {k} THEN '{v}'" for k, v in enumerate(_VALUES)) + " END"
VALUES_SQL = f"SELECT o_orderkey AS k, {VALUE} AS raw, {KIND} AS field_type FROM orders"
NAMES = tuple(_VALUES)


def fields_sql(array: str) -> str:
    """Fields whose boxes overlap, of lineitem: an order is a document of one page."""
    x, y = "CAST(l_quantity * 7 AS INT) % 60", "CAST(l_partkey % 3 AS INT) * 12"
    box = array.format(f"{x}, {y}, {x} + 100, {y} + 20")
    method = "CASE l_linenumber % 4 WHEN 0 THEN 'visual_detection' WHEN 1 THEN 'llm_unified' ELSE 'pattern_match' END"
    kind = "CASE WHEN l_linenumber % 5 = 4 THEN 'signature' WHEN l_partkey % 2 = 0 THEN 'person_name' WHEN l_partkey % 11 = 1 THEN 'stamp_number' ELSE 'address' END"
    return f"SELECT l_orderkey AS doc_id, CAST(l_linenumber % 2 AS INT) + 1 AS page, ((CAST(l_linenumber AS BIGINT) * 10000000 + l_partkey) * 1000000 + l_suppkey) * 100 + CAST(l_quantity AS BIGINT) AS src_ord, 'b' || CAST(l_partkey % 3 AS STRING) AS block_id, {kind} AS field_type, CASE WHEN l_suppkey % 2 = 0 THEN ' Same Value ' ELSE 'value ' || CAST(l_suppkey AS STRING) END AS text, CASE WHEN l_partkey % 13 = 0 THEN NULL ELSE {box} END AS bbox, {_SURE.format(k='l_suppkey')} AS confidence, CASE WHEN l_partkey % 7 = 0 THEN NULL ELSE {array.format(chr(39) + 'GDPR' + chr(39) + ', l_returnflag')} END AS regulations, CASE WHEN l_partkey % 9 = 0 THEN NULL ELSE l_linestatus END AS risk_level, {method} AS detection_method FROM lineitem"


ANSWERS_SQL = """SELECT o_orderkey AS doc_id, CAST(1 AS INT) AS page, CASE WHEN o_orderkey % 10 = 9 THEN 'no answer' ELSE 'Here: {"text_detections": [{"block_id": "b' || CAST(o_custkey % 4 AS STRING) || '", "full_text": "Name: P' || CAST(o_custkey AS STRING) || '", "label": "Name: ", "sensitive_value": "P' || CAST(o_custkey AS STRING) || '", "category": "person_name", "confidence": 0.' || CAST(o_custkey % 9 + 1 AS STRING) || ', "risk_level": "HIGH"}, {"block_id": "b1", "sensitive_value": "x"}], "visual_detections": [{"element_id": "sig_1", "type": "signature", "bbox": {"x1": 1, "y1": 2, "x2": ' || CAST(o_custkey % 100 + 3 AS STRING) || ', "y2": 20}, "confidence": 0.9}]} done' END AS raw FROM orders"""


def table(spark: SparkSession, folder: str, sql: str, name: str) -> DataFrame:
    """The SELECT ... FROM name over the folder's table, in Spark."""
    return spark.sql(sql.replace(f"FROM {name}", "FROM {t}"), t=spark.read.parquet(f"{folder}/{name}.parquet"))


def _once(df: DataFrame, column: str) -> DataFrame:
    """df, with a column's long expression computed once: the optimizer doesn't carry it through an explode into each of its uses."""
    return df.select(*(F.explode(F.array(c)).alias(c) if c == column else c for c in df.columns))


def blocks(spark: SparkSession, folder: str) -> DataFrame:
    return _once(table(spark, folder, blocks_sql("array({})"), "customer"), "text")


def fields(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, fields_sql("array({})"), "lineitem")


def values(spark: SparkSession, folder: str) -> DataFrame:
    return _once(table(spark, folder, VALUES_SQL, "orders"), "raw")


def answers(spark: SparkSession, folder: str) -> DataFrame:
    raw = ANSWERS_SQL[ANSWERS_SQL.index("CASE WHEN o_orderkey % 10 = 9") : ANSWERS_SQL.rindex(" AS raw FROM")]
    return spark.read.parquet(f"{folder}/orders.parquet").select(F.col("o_orderkey").alias("doc_id"), F.lit(1).alias("page"), F.expr(raw).alias("raw"))
