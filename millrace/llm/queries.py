"""The registered queries: each applies an operator, with production parameters, to its whole table."""

from __future__ import annotations

import zlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import alignment, decontaminate, exact_dedup, language_id, license_scan, packing, periodic_runs, pii, quality, repeats, sharding, simhash, sql, url_filter


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def byte_bpe_ranks() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_crc(packing.pack(read(spark, sf_dir, "documents"), byte_bpe_ranks())).drop("ids")


def with_crc(pieces: DataFrame) -> DataFrame:
    return pieces.withColumn("ids_crc32", F.crc32("ids"))


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.license_scan(read(spark, sf_dir, "documents"))


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read(spark, sf_dir, "pages").select("page_id", "url")
    captures = pages.withColumn("fetched_at", F.date_add(F.lit("2024-01-01").cast("date"), (F.col("page_id") * 7919 % 366).cast("int")))
    return url_filter.listed(captures, dated_entries(pages))


def dated_entries(pages: DataFrame) -> DataFrame:
    """Lists over the pages' own hosts: no table has any, so rules on a host's name date and place the entries."""
    hosts = pages.select(url_filter.host_of(F.col("url")).alias("host")).where("host is not null").distinct()
    names = hosts.select(F.explode(url_filter.domains_of(F.col("host"))).alias("domain")).distinct()
    number = (F.ascii("domain") * 37 + F.ascii(F.substring("domain", 3, 1)) * 11 + F.length("domain") * 5).cast("int")
    names = names.withColumn("k", number)

    def entry(name: str, action: str, day) -> DataFrame:
        return F.struct(F.lit(name).alias("list"), "domain", F.lit(action).alias("action"), F.date_add(F.lit("2024-01-01").cast("date"), day.cast("int")).alias("at"))

    k = F.col("k")
    entries = F.array(
        entry("ads", "add", k % 300),
        entry("ads", "remove", k % 300 + k % 60 + 1),
        entry("ads", "add", k % 300 + 90),
        entry("malware", "add", F.when(k % 3 == 0, k % 200)),
        entry("malware", "remove", F.when(k % 2 == 0, k % 200 + 100)),
        entry("adult", "add", F.when(k % 5 == 0, F.lit(-30))),
    )
    return names.select(F.inline(entries))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op5_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's columns; n_passages and passage_words tell of passages of over 50 words that other documents hold too, of any number of bytes."""
    covered = lambda spans: F.aggregate(spans, F.lit(0).cast("long"), lambda n, s: n + s["last"] - s["first"])
    return repeats.repeats(read(spark, sf_dir, "documents")).select(
        "doc_id",
        "n_bytes",
        covered("spans").alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
        F.size("passages").cast("long").alias("n_passages"),
        covered("passages").alias("passage_words"),
    )


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(read(spark, sf_dir, "documents"))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.language_id(read(spark, sf_dir, "documents"))


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(read(spark, sf_dir, "documents")).drop("row")


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_groups(read(spark, sf_dir, "documents")).select("doc_id", "fingerprint", "component_id", "kept")


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contamination(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    names = F.array_sort(F.transform("items", lambda x: x.cast("string")))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join(names, ",").cast("binary"), 256).alias("items_sha256"), "contaminated")


def op11_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    named = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    base = F.filter("spans", lambda s: s["base"])
    count = lambda kind: F.size(F.filter("spans", lambda s: s["base"] & (s["kind"] == kind))).cast("long").alias(f"n_{kind}")
    return pii.personal_data(read(spark, sf_dir, "documents")).select("doc_id", *map(count, pii.BASE), F.sha2(named(base).cast("binary"), 256).alias("base_sha256"), named(F.col("spans")).alias("spans"))


def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return alignment.align(read(spark, sf_dir, "documents"), byte_bpe_ranks(), public_tokenizers.path("piece_bpe_32k.model"))


def dealt_cycle(key: int | None, n: int) -> tuple[int, int] | None:
    """Of a tenth of the documents, by a checksum of the id, the words from some place on repeat with some period."""
    h = zlib.crc32(str(key).encode()) if key is not None else 1
    if h % 10 or not n:
        return None
    g = h // 10
    return g % n, 1 + (n - g % n) // (3 + g % 8)


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic_runs.periodic_runs(read(spark, sf_dir, "documents"), cycle=dealt_cycle)
    named = F.transform("runs", lambda r: F.concat(F.concat_ws(",", *[r[c].cast("string") for c in ("start", "length", "period")]), F.lit("\n")))
    # The greatest length / period: as a fraction, by cross multiplication.
    none = F.lit(None).cast(found.schema["runs"].dataType.elementType)
    more = lambda best, r: best.isNull() | (r["length"] * best["period"] > best["length"] * r["period"])
    found = found.withColumn("top", F.aggregate("runs", none, lambda best, r: F.when(more(best, r), r).otherwise(best)))
    return found.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        *[F.col(f"top.{c}").alias(c) for c in ("start", "length", "period")],
        F.expr("top.length * 1000 div top.period").alias("exponent_milli"),
        F.sha2(F.array_join(named, "").cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = [op1_packing, op2_license_scan, op3_url_filter, op4_quality, op5_repeats, op6_sharding, op7_language_id, op8_exact_dedup, op9_simhash, op10_decontaminate, op11_pii, op12_alignment, op13_periodic_runs]
    return {f.__name__: f for f in own}


def oracle_sql() -> dict[str, str]:
    return sql.ORACLES
