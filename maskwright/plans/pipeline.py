"""The facade: blocks in, masked blocks, registry, verification and reports out. All lazy but for the rounds that find leaders."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from ..config import Config
from ..operators import canonical, detect, fields as ops, mask as masking, replace as rep, report, verify as ver
from ..operators.lineage import checkpoint


@dataclass
class Result:
    fields: DataFrame
    masked: DataFrame
    registry: DataFrame
    leaks: DataFrame
    verification: DataFrame
    reports: DataFrame


class Masker:
    """Operations over a table of blocks with one configuration."""

    def __init__(self, config: Config):
        self.config = config

    def detect(self, blocks: DataFrame, responses: DataFrame | None = None) -> DataFrame:
        """Deduplicated and triaged fields."""
        c = self.config
        if c.use_responses and responses is None:
            raise ValueError("use_responses needs a table of responses")
        found = detect.detect(blocks, responses if c.use_responses else None)
        if not c.use_patterns:
            found = found.filter(~F.col("detection_method").isin("pattern_match", "legal_suffix"))
        return ops.triage(ops.deduplicate(found), c.auto_mask, c.review_floor)

    def approve(self, triaged: DataFrame, decisions: DataFrame | None = None) -> DataFrame:
        if decisions is not None:
            return ops.review(triaged, decisions)
        return triaged if self.config.auto_approve else triaged.filter("review_status = 'auto_mask'")

    def replacements(self, fields: DataFrame, known: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
        """fields with ``replacement``, and the registry. Values whose hash is in ``known`` keep the replacement they have there."""
        from ..functions.tokens import sha256

        c = self.config
        found = canonical.values(fields)
        keys = canonical.keys(found)
        words = rep.dictionary(keys, c.secret, by_family=c.by_family)
        if known is not None:
            old = known.select(F.col("normalized_hash").alias("h"), F.col("token").alias("old"))
            words = words.withColumn("h", sha256(F.col("leader"))).join(old, "h", "left").select("key", "leader", F.coalesce("old", "replacement").alias("replacement"))
        words = checkpoint(words)
        records = rep.registry(keys, words)
        return rep.replace(fields, found, words), records if known is None else rep.merge(known, records)

    def run(self, blocks: DataFrame, responses: DataFrame | None = None, decisions: DataFrame | None = None, known: DataFrame | None = None) -> Result:
        c = self.config
        chosen = checkpoint(self.approve(self.detect(blocks, responses), decisions))
        done, records = self.replacements(chosen, known)
        masked = masking.mask(blocks, done)
        leaks = ver.leaks(masked, chosen, c.check_originals)
        pages = blocks.groupBy("doc_id").agg(F.countDistinct("page").alias("total_pages"))
        return Result(done, masked, records, leaks, ver.verify(masked, leaks, c.verify), report.documents(done, pages))

    def dry_run(self, blocks: DataFrame, responses: DataFrame | None = None) -> DataFrame:
        return report.dry_run(self.detect(blocks, responses))
