"""The queries opN_<name> of this subpackage, over whole tables and with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sitewright.llm import embedding_dedup, fingerprints, merge_dropout, packing, pii, secret_scans, simhash_dedup, token_counts, toxicity, warc
from sitewright.llm.common import table


def op1_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scans.scan(table(spark, sf_dir, "documents"))
    count = lambda kind: F.size(F.filter("base", lambda x: x.kind == kind)).cast("long")
    return found.select("doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"), F.sha2(secret_scans.joined("base"), 256).alias("base_sha256"), secret_scans.joined("spans").alias("spans"))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.scores(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return packing.packed(docs, clusters=packing.near_clusters(docs))


def op5_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash_dedup.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op6_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """n_near: for each doc_id divisible by 20, how many other rows of the table have a fingerprint within 7 of 128 bits; else null."""
    found = fingerprints.with_next(table(spark, sf_dir, "documents"))
    asked = F.coalesce(F.col("doc_id") % 20 == 0, F.lit(False))
    near = fingerprints.near_counts(found.select("fingerprint"), found.where(asked).select("fingerprint"))
    rest = found.where(~asked).withColumn("n_near", F.lit(None).cast("long"))
    return rest.unionByName(found.where(asked).join(near, "fingerprint").withColumn("n_near", F.col("near") - 1).drop("near"))


def op7_private_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.scan(table(spark, sf_dir, "documents"))
    count = lambda kind: F.size(F.filter("base", lambda x: x.kind == kind)).cast("long")
    counts = [count(k).alias(f"n_{name}") for k, name in enumerate(pii.KINDS[:4])]
    return found.withColumn("spans", pii.all_spans()).select("doc_id", *counts, F.sha2(pii.joined("base"), 256).alias("base_sha256"), pii.joined("spans").alias("spans"))


def op8_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_duplicates(table(spark, sf_dir, "embeddings"))


def op9_merge_dropout(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merge_dropout.round_trips(table(spark, sf_dir, "documents"))


def op10_warc_from_arc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = warc.archive(table(spark, sf_dir, "pages"))
    return warc.read_archives(spark, path).where(F.col("type").isin("response", "revisit")).select("page_id", "payload_bytes", "payload_digest", F.col("type").alias("record_type"), "refers_to")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name.startswith("op") and callable(f) and name[2].isdigit()}


def oracle_sql() -> dict[str, str]:
    return {
        "op8_embedding_near_dedup": """
            with recursive good as (
                select vec_id, list_transform(embedding, lambda x: cast(x as double)) as e from embeddings
                where vec_id is not null and len(embedding) > 0 and len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) = 0 and len(list_filter(embedding, lambda x: x <> 0)) > 0),
            links as (
                select a.vec_id as a, b.vec_id as b from good a join good b on a.vec_id <> b.vec_id and len(a.e) = len(b.e)
                where list_dot_product(a.e, b.e) / sqrt(list_dot_product(a.e, a.e) * list_dot_product(b.e, b.e)) >= 0.95),
            reach as (select vec_id as id, vec_id as other from embeddings union select reach.id, links.b from reach join links on links.a = reach.other),
            counts as (select a, count(*) as n from links group by a),
            roots as (select id, min(other) as root from reach group by id)
            select vec_id, cast(coalesce(n, 0) as bigint) as n_links, root as component_id, vec_id = root as kept
            from embeddings join roots on id = vec_id left join counts on a = vec_id
        """,
        "op10_warc_from_arc": """
            with sized as (select page_id, octet_length(encode(coalesce(html, ''))) as payload_bytes, sha1(coalesce(html, '')) as payload_digest from pages),
            newest as (select *, case when payload_bytes >= 1000 then max(page_id) over (partition by payload_digest) end as last_id from sized)
            select page_id, cast(payload_bytes as bigint) as payload_bytes, payload_digest, case when last_id > page_id then 'revisit' else 'response' end as record_type,
                   case when last_id > page_id then last_id end as refers_to
            from newest
        """,
    }
