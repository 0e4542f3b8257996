"""The registered queries: each operator over whole tables. Their SQL is in oracle.py."""

from __future__ import annotations

import os
import re
import uuid
from collections.abc import Callable
from functools import partial

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..config import Config
from ..functions import dummy, geometry, text as T, tokens
from ..functions.normalize import normalize, without_label
from ..functions.patterns import PATTERNS
from ..operators import canonical, detect, fields as ops, mask as masking, replace as rep, report, responses, verify as ver
from ..operators.lineage import checkpoint
from ..sources import blocks as src
from . import fixtures as fx
from .pipeline import Masker

Query = Callable[[SparkSession, str], DataFrame]
#: The key of the queries' replacements, so that their SQL can give the same. Real ones come from the configuration.
KEY = "key of the registered queries"
SHOWN = ("doc_id", "page", "block_id", "field_type", "text", "confidence", "risk_level")


def _shown(df: DataFrame) -> DataFrame:
    return df.select(*SHOWN, F.array_join("regulations", ",").alias("regulations"))


def flagship(spark: SparkSession, folder: str) -> DataFrame:
    """Emails and addresses in documents, by regulation."""
    found = detect.by_patterns(src.documents(spark, folder), ("email", "ip_address"))
    return found.select(F.explode("regulations").alias("regulation")).groupBy("regulation").agg(F.count(F.lit(1)).alias("n_fields"))


def _family(names: str, spark: SparkSession, folder: str) -> DataFrame:
    return _shown(detect.by_patterns(fx.blocks(spark, folder), [p.name for p in PATTERNS if re.search(names, p.name)]))


def _lines(read: Callable, spark: SparkSession, folder: str) -> DataFrame:
    return read(spark, folder).drop("bbox", "confidence")


def _triaged(spark: SparkSession, folder: str) -> DataFrame:
    return ops.triage(fx.fields(spark, folder))


def _decisions(spark: SparkSession, folder: str) -> DataFrame:
    answer = F.element_at(F.array(*map(F.lit, "YNYNYAYNSN")), ((F.col("doc_id") * 3 + F.col("src_ord")) % 10 + 1).cast("int"))
    return _triaged(spark, folder).filter("src_ord % 5 <> 3").select("doc_id", "page", "src_ord", answer.alias("answer"))


def _deduplicated(spark: SparkSession, folder: str) -> DataFrame:
    f = fx.fields(spark, folder).select("doc_id", "page", "src_ord", "block_id", "field_type", "text", "bbox", "confidence")
    return ops.deduplicate(f).select("doc_id", "page", "src_ord", "field_type")


def _pairs(spark: SparkSession, folder: str) -> DataFrame:
    f = fx.fields(spark, folder).filter("bbox IS NOT NULL").select("doc_id", "src_ord", "bbox")
    g = f.select("doc_id", F.col("src_ord").alias("other"), F.col("bbox").alias("box2"))
    return f.join(g, "doc_id").filter("src_ord < other").select("doc_id", "src_ord", "other", geometry.overlap(F.col("bbox"), F.col("box2")).alias("share"))


def _boxes(spark: SparkSession, folder: str) -> DataFrame:
    f = fx.fields(spark, folder).filter("bbox IS NOT NULL")
    box = geometry.clamp(F.col("bbox"), F.lit(120), F.lit(30))
    return f.select("doc_id", "src_ord", *(F.get(box, F.lit(k)).alias(n) for k, n in enumerate(("x1", "y1", "x2", "y2"))), geometry.font_size(F.col("bbox"), F.col("text")).alias("size"))


def _marks(spark: SparkSession, folder: str) -> DataFrame:
    kind, method = F.col("field_type"), F.col("detection_method")
    return fx.fields(spark, folder).groupBy(kind, method).agg(F.count(F.lit(1)).alias("n")).withColumn("is_mark", geometry.is_mark(kind, method)).withColumn("masking_method", geometry.masking_method(kind, method))


def _labels(spark: SparkSession, folder: str) -> DataFrame:
    return fx.blocks(spark, folder).select("doc_id", "block_id", without_label(F.col("text")).alias("value"))


def _normal(kinds: str, spark: SparkSession, folder: str) -> DataFrame:
    return fx.values(spark, folder).filter(F.col("field_type").isin(kinds.split())).select("k", normalize(F.col("raw"), F.col("field_type")).alias("key"))


def _tokens(spark: SparkSession, folder: str) -> DataFrame:
    v = fx.values(spark, folder).withColumn("ns", tokens.namespace(F.col("field_type")))
    return v.select("k", "ns", tokens.token(KEY, F.col("raw"), F.col("ns")).alias("token"), tokens.sha256(F.col("raw")).alias("hash"), tokens.seed(KEY, F.col("raw")).alias("seed"))


def _runs(spark: SparkSession, folder: str) -> DataFrame:
    """Runs of equal class in the distinct values: values that orders share are taken apart once."""
    v = fx.values(spark, folder).select("raw").distinct()
    return v.select("raw", F.posexplode(dummy.analyze(F.col("raw"))).alias("nth", "r")).select("raw", "nth", "r.kind", "r.length")


def _dummies(kinds: str, spark: SparkSession, folder: str) -> DataFrame:
    v = fx.values(spark, folder).filter(F.col("field_type").isin(kinds.split()))
    return v.select("k", dummy.replacement(KEY, F.col("raw"), F.col("field_type")).alias("replacement"))


def _fields_of(spark: SparkSession, folder: str) -> DataFrame:
    return detect.detect(fx.blocks(spark, folder))


def _found(spark: SparkSession, folder: str) -> DataFrame:
    return canonical.values(_fields_of(spark, folder))


def _exact(spark: SparkSession, folder: str) -> DataFrame:
    known = canonical.keys(_found(spark, folder))
    return rep.dictionary(known, KEY, similar=False, mode="token").select("key", "leader", F.col("replacement").alias("token"))


def _similar(spark: SparkSession, folder: str) -> DataFrame:
    return canonical.leaders(canonical.keys(_found(spark, folder)))


def _registry(spark: SparkSession, folder: str) -> DataFrame:
    known = checkpoint(canonical.keys(_found(spark, folder)))
    return rep.registry(known, rep.dictionary(known, KEY, similar=False, mode="token")).select("normalized_hash", "token", "namespace", "document_id", "field_context")


def _registry_merge(spark: SparkSession, folder: str) -> DataFrame:
    """A registry of even documents, then what odd ones add."""
    all_ = _registry(spark, folder)
    late = all_.withColumn("token", F.concat(F.lit("LATE-"), "token"))
    return rep.merge(all_.filter("document_id % 2 = 0"), late)


def _mask(spark: SparkSession, folder: str) -> DataFrame:
    """Every pattern hit replaced by the token of its own text."""
    b = fx.blocks(spark, folder)
    f = detect.by_patterns(b).withColumn("replacement", tokens.token(KEY, F.col("text"), tokens.namespace(F.col("field_type"))))
    return masking.mask(b, f)


def _masked(spark: SparkSession, folder: str) -> DataFrame:
    return _mask(spark, folder).select("doc_id", "page", "block_id", "text", "is_masked")


def _leaks(spark: SparkSession, folder: str) -> DataFrame:
    b = fx.blocks(spark, folder)
    return ver.leaks(b, _originals(spark, folder))


def _originals(spark: SparkSession, folder: str) -> DataFrame:
    """Originals that may be left: hits of all documents, as found in unmasked blocks."""
    return detect.by_patterns(fx.blocks(spark, folder))


def _verdict(spark: SparkSession, folder: str) -> DataFrame:
    return ver.verify(fx.blocks(spark, folder), _leaks(spark, folder))


def _verify_report(spark: SparkSession, folder: str) -> DataFrame:
    found = checkpoint(_leaks(spark, folder))
    out = ver.report(ver.verify(fx.blocks(spark, folder), found), found)
    return out.select("doc_id", "verification_status", "confidence_score", "pages_checked", "n_leaks", "passed", F.coalesce(F.size("recommendations"), F.lit(0)).alias("n_todo"))


def _reports(spark: SparkSession, folder: str) -> DataFrame:
    f = fx.fields(spark, folder).withColumn("replacement", F.lit("x")).withColumn("reasoning", F.lit(None).cast("string"))
    return report.documents(f, f.groupBy("doc_id").agg(F.countDistinct("page").alias("total_pages")))


def _report_fields(spark: SparkSession, folder: str) -> DataFrame:
    return _reports(spark, folder).select("doc_id", "total_pages", "total_masked_fields", F.inline("masked_fields")).select("doc_id", "total_pages", "total_masked_fields", "field_id", "type", "page", "masking_method", "risk_level")


def _failed(spark: SparkSession, folder: str) -> DataFrame:
    s = spark.read.parquet(f"{folder}/supplier.parquet").filter("s_acctbal < 0")
    return report.failures(s.select(F.col("s_name").alias("document"), F.concat(F.lit("File not found: "), "s_name").alias("error")))


def _batch(spark: SparkSession, folder: str) -> DataFrame:
    out = report.batch_summary(_reports(spark, folder), _failed(spark, folder))
    return out.select("total_documents", "successful", "failed", "total_pages", "total_masked_fields", "fields_per_document", F.element_at("by_type", "signature").alias("signatures"), F.size("failed_documents").alias("listed"))


def _answer_blocks(spark: SparkSession, folder: str) -> DataFrame:
    return fx.fields(spark, folder).select("doc_id", "page", F.col("src_ord").alias("block_ord"), "block_id", "text", "bbox")


def _answer_texts(spark: SparkSession, folder: str) -> DataFrame:
    out = responses.text_fields(fx.answers(spark, folder), _answer_blocks(spark, folder))
    return out.select("doc_id", "block_id", "field_type", "text", "label", "confidence", "risk_level", F.get("bbox", F.lit(0)).alias("x1"))


def _answer_visuals(spark: SparkSession, folder: str) -> DataFrame:
    out = responses.visual_fields(fx.answers(spark, folder))
    return out.select("doc_id", "block_id", "field_type", "text", "confidence", "is_visual", *(F.get("bbox", F.lit(k)).alias(n) for k, n in enumerate(("x1", "y1", "x2", "y2"))))


def _prompts(spark: SparkSession, folder: str) -> DataFrame:
    """Requests of 60 blocks at most, with a hash of what is asked: the payloads' ids and texts."""
    out = responses.prompts(src.documents(spark, folder), 60)
    rows = F.transform(F.from_json("payload", "array<struct<id: string, text: string>>"), lambda b: F.concat_ws("\n", b["id"], b["text"]))
    return out.select("doc_id", "page", "n_blocks", tokens.sha256(F.concat_ws("\n", rows)).alias("asked"))


def _languages(spark: SparkSession, folder: str) -> DataFrame:
    n = spark.read.parquet(f"{folder}/nation.parquet")
    raw = F.expr("""CASE n_nationkey % 3 WHEN 0 THEN 'It is {"languages": ["fr"], "locale": "fr_FR"} so' WHEN 1 THEN '{"languages": ["en", "de"], "locale": "de_DE"}' ELSE 'unsure' END""")
    langs, locale = responses.languages(raw)
    return n.select("n_nationkey", F.array_join(langs, ",").alias("languages"), locale.alias("locale"))


def _small(spark: SparkSession, folder: str) -> DataFrame:
    """Durations, contexts and shortened texts."""
    o = spark.read.parquet(f"{folder}/orders.parquet")
    return o.select("o_orderkey", T.duration(F.floor("o_totalprice") / F.lit(4.0)).alias("took"), rep.field_context(F.col("o_custkey"), F.col("o_orderstatus"), F.lit("m")).alias("context"), T.shorten(F.repeat(F.col("o_orderpriority"), F.lit(6))).alias("short"))


def _whole(spark: SparkSession, folder: str) -> DataFrame:
    """The whole plan over documents: what is masked in them, by status of verification."""
    out = Masker(Config(key=KEY)).run(src.documents(spark, folder))
    return out.verification


def stream_detect(spark: SparkSession, folder: str) -> DataFrame:
    from ..streaming import detect as s

    return _streamed(spark, s.fields(s.documents(spark, *_stream_args(folder))).select("doc_id", "page", "block_id", "field_type", "text"))


def stream_registry(spark: SparkSession, folder: str) -> DataFrame:
    from ..streaming import detect as s

    return _streamed(spark, s.first_seen(s.fields(s.documents(spark, *_stream_args(folder)))).select("normalized_hash", "namespace"))


def _stream_args(folder: str) -> tuple[str, str]:
    """A table is one file, or a folder of them."""
    path = f"{folder}/documents.parquet"
    return (path, "*.parquet") if os.path.isdir(path) else (folder, "documents.parquet")


def _streamed(spark: SparkSession, stream: DataFrame) -> DataFrame:
    from ..operators.lineage import shared_folder
    from ..streaming.detect import write

    out = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    write(stream, f"{out}/rows", f"{out}/state").awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{out}/rows")


FAMILIES = {"detect_synthetic_ids": "^(ssn|nino|insee|cf|dni)_", "detect_synthetic_plates": "^plate_", "detect_synthetic_phones": "^phone_", "detect_synthetic_postal": "^postal_", "detect_synthetic_net": "^(email|ip_address)$"}
NORMAL = {"normalize_plate": "license_plate", "normalize_phone": "phone", "normalize_email": "email", "normalize_id": "national_id", "normalize_default": "person_name company_name address date_of_birth reference other signature stamp"}
DUMMIES = {"fpe_digits": "national_id", "fpe_plate": "license_plate", "fpe_phone": "phone", "dummy_name": "person_name", "dummy_company": "company_name", "dummy_email": "email", "dummy_address": "address", "dummy_date": "date_of_birth", "dummy_reference": "reference", "dummy_generic": "other", "dummy_marks": "signature stamp"}


def queries() -> dict[str, Query]:
    out: dict[str, Query] = {
        "flagship_regulations": flagship,
        "blocks_from_documents": partial(_lines, src.documents),
        "block_stats_by_doc": lambda s, d: src.full_text(src.documents(s, d)),
        "detect_email": lambda s, d: _shown(detect.by_patterns(src.documents(s, d), ("email",))),
        "detect_ip": lambda s, d: _shown(detect.by_patterns(src.documents(s, d), ("ip_address",))),
        "detect_all_patterns": lambda s, d: _shown(detect.by_patterns(fx.blocks(s, d))),
        "detect_company_suffix": lambda s, d: _shown(detect.by_company_suffix(fx.blocks(s, d))),
        "documents_pii": lambda s, d: _shown(detect.by_patterns(src.documents(s, d))),
        "pages_pii": lambda s, d: _shown(detect.by_patterns(src.pages(s, d))),
        "conversations_pii": lambda s, d: _shown(detect.by_patterns(src.conversations(s, d))),
        "triage_counts": lambda s, d: _triaged(s, d).groupBy("review_status").agg(F.count(F.lit(1)).alias("n")),
        "review_queue": lambda s, d: _triaged(s, d).filter("review_status = 'needs_review'").select("doc_id", "src_ord", "confidence"),
        "review_decisions": lambda s, d: ops.review(_triaged(s, d), _decisions(s, d)).select("doc_id", "src_ord", "review_status"),
        "dedup_nms": _deduplicated,
        "bbox_overlap": _pairs,
        "bbox_clamp": _boxes,
        "signature_flag": _marks,
        "label_strip": _labels,
        "token_hash_seed": _tokens,
        "namespace_of": lambda s, d: fx.fields(s, d).groupBy("field_type").agg(F.count(F.lit(1)).alias("n")).withColumn("namespace", tokens.namespace(F.col("field_type"))),
        "analyze_pattern_rle": _runs,
        "canonical_exact": _exact,
        "canonical_similar": _similar,
        "registry_first_seen": _registry,
        "registry_stats": lambda s, d: rep.statistics(_registry(s, d)),
        "registry_merge": _registry_merge,
        "mask_blocks": _masked,
        "masked_full_text": lambda s, d: src.full_text(_mask(s, d)),
        "leak_patterns": lambda s, d: ver.pattern_leaks(fx.blocks(s, d)),
        "leak_originals": lambda s, d: ver.original_leaks(fx.blocks(s, d), _originals(s, d)).select("doc_id", "page", "text", F.get("bbox", F.lit(1)).alias("y1")),
        "verify_status": _verdict,
        "verify_report": _verify_report,
        "stats_by_type": lambda s, d: report.by_type(fx.fields(s, d)),
        "stats_by_page": lambda s, d: report.by_page(fx.fields(s, d)),
        "stats_by_regulation": lambda s, d: report.by_regulation(fx.fields(s, d)),
        "stats_by_risk": lambda s, d: report.by_risk(fx.fields(s, d)),
        "stats_grouping_sets": lambda s, d: report.statistics(fx.fields(s, d)),
        "doc_report": _report_fields,
        "error_report": _failed,
        "dry_run_report": lambda s, d: report.dry_run(_triaged(s, d)),
        "batch_summary": _batch,
        "response_texts": _answer_texts,
        "response_visuals": _answer_visuals,
        "response_prompts": _prompts,
        "response_language": _languages,
        "small_functions": _small,
        "mask_documents": _whole,
        "stream_detect": stream_detect,
        "stream_registry": stream_registry,
    }
    out |= {name: partial(_family, names) for name, names in FAMILIES.items()}
    out |= {name: partial(_normal, kinds) for name, kinds in NORMAL.items()}
    out |= {name: partial(_dummies, kinds) for name, kinds in DUMMIES.items()}
    return out


