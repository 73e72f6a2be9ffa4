"""The registered queries of this subpackage, each a function of (spark, data folder)."""

from __future__ import annotations

from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlab.llm import (
    cuckoo_dedup,
    html_text,
    licenses,
    maxent_lm,
    near_dedup,
    oracles,
    packing,
    phrases,
    pieces,
    pii,
    quality,
    sharding,
    warc,
    whitening,
)
from cohortlab.llm.common import read
from cohortlab.session import ship_package


def op1_exact_dedup(spark, sf):
    return cuckoo_dedup.exact_dedup(read(spark, sf, "documents"))


def op2_license_scan(spark, sf):
    return licenses.scan(read(spark, sf, "documents"))


def op3_near_dedup(spark, sf):
    return near_dedup.near_dedup(read(spark, sf, "documents"))


def op4_sharding(spark, sf):
    placed = sharding.shard_by_bytes(read(spark, sf, "documents"))
    return placed.select("*", F.lit("bytes").alias("law"), F.lit(None).cast("int").alias("grown_shard"))


def op5_quality_rules(spark, sf):
    return quality.judge(read(spark, sf, "documents"))


def op6_pii(spark, sf):
    return pii.find(read(spark, sf, "documents"))


def op7_packing(spark, sf):
    return packing.pack_documents(read(spark, sf, "documents"))


def op8_pieces(spark, sf):
    return pieces.checked(pieces.encode(read(spark, sf, "documents")))


def op9_html_text(spark, sf):
    return html_text.main_text(read(spark, sf, "pages"))


def op10_lm_score(spark, sf):
    return maxent_lm.score_documents(read(spark, sf, "documents"))


def op11_warc(spark, sf):
    return warc.archive_round(read(spark, sf, "pages"))


def op12_whitening(spark, sf):
    return whitening.whiten(read(spark, sf, "embeddings"))


def op13_phrases(spark, sf):
    return phrases.collocations(read(spark, sf, "documents"))


QUERIES = (
    op1_exact_dedup,
    op2_license_scan,
    op3_near_dedup,
    op4_sharding,
    op5_quality_rules,
    op6_pii,
    op7_packing,
    op8_pieces,
    op9_html_text,
    op10_lm_score,
    op11_warc,
    op12_whitening,
    op13_phrases,
)


def _ready(query):
    @wraps(query)
    def run(spark: SparkSession, sf: str) -> DataFrame:
        ship_package(spark)
        return query(spark, sf)

    return run


def all_queries() -> dict:
    return {q.__name__: _ready(q) for q in QUERIES}


def all_sql() -> dict[str, str]:
    return {name: sql for name, sql in oracles.SQL.items() if name in {q.__name__ for q in QUERIES}}
