"""The queries of this folder, for ``__spark_entry__.py``: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

VOCABULARY = "word_bpe_49k.json"
#: The key of the pseudonyms; a real run passes its own.
KEY = "lexigrove"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: A mixture flattens sources and languages: their shares to these powers. Topics keep their shares.
MIX_TARGETS: dict[str, dict[str, float] | float] = {"source": 0.5, "lang": 0.8, "topic": 1.0}
#: Share of all tokens that a mixture keeps, at most.
MIX_BUDGET = 0.5


def count_of(values: Column, value: object) -> Column:
    return F.size(F.filter(values, lambda x: x == value)).cast("long")


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .packing import pack_documents

    return pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY))


def op2_audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import audio
    from .shared import materialize, scratch_path

    stored = materialize(audio.encode_audio(table(spark, sf_dir, "documents"), "doc_id"), "media", compression="zstd")
    body = audio.payload(F.col("media"))
    digests = {
        "payload_bytes": F.octet_length(body).cast("long"),
        "payload_sha256": F.sha2(body, 256),
        "tail_crc32": F.crc32(F.substring("media", -64, 64)),
        "media_bytes": F.octet_length("media").cast("long"),
        "media_sha256": F.sha2("media", 256),
    }
    media, folder = stored.withColumns(digests), scratch_path(spark, "tensors")
    manifest = audio.store_features(media, folder, "doc_id", "n_bytes", *digests)
    found = audio.read_features(manifest, folder, media.select("doc_id", "n_bytes", *digests))
    first = F.coalesce(F.get("segments", F.lit(0))["start_ms"], F.lit(-1.0))
    feature = F.concat_ws(
        ";",
        F.concat(F.lit("frames="), F.col("n_frames")),
        F.concat(F.lit("tensors="), F.size("tensors"), F.lit(":"), F.hex(F.xxhash64("tensors"))),
        F.concat(F.lit("segments="), F.size("segments")),
        F.concat(F.lit("first_ms="), F.format_number(first, 1)),
        F.concat(F.lit("db="), F.format_number("mean_db", 3)),
        F.concat(F.lit("mel="), F.array_join(F.transform("band_means", lambda x: F.format_number(x, 3)), ",")),
    )
    return found.select("doc_id", "n_bytes", *digests, feature.alias("feature"))


def op3_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .secret_scan import KINDS, scan_secrets, spelled

    found = scan_secrets(table(spark, sf_dir, "documents").select("doc_id", "text"))
    kinds = F.transform("base", lambda s: s["kind"])
    counts = [count_of(kinds, k).alias(f"n_{KINDS[k]}") for k in range(3)]
    return found.select("doc_id", *counts, F.sha2(spelled(F.col("base")), 256).alias("base_sha256"), spelled(F.array_sort(F.concat("base", "entropy"))).alias("spans"))


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .simhash import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"))


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .pii import pseudonymize

    found = pseudonymize(table(spark, sf_dir, "documents").select("doc_id", "text"), KEY)
    kinds = ("email", "phone", "ipv4", "card", "date", "iban", "ssn")
    counts = [count_of(F.col("found"), k).alias(f"n_{k}") for k in kinds]
    return found.select("doc_id", F.col("pseudonymized").alias("text"), *counts)


def op6_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .nndescent import near_duplicates

    return near_duplicates(table(spark, sf_dir, "embeddings"))


def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import langid

    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = langid.is_held_out(F.col("doc_id"))
    model = langid.fit(docs.where(~held_out))
    return langid.predict(docs.select("doc_id", held_out.alias("held_out"), "text"), model, "doc_id", "held_out")


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .warc import archive_pages, read_archives

    manifest, folder = archive_pages(table(spark, sf_dir, "pages"))
    return read_archives(manifest, folder, payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op9_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .licenses import scan_licenses

    def joined(labels: Column) -> Column:
        return F.array_join(F.array_sort(F.array_distinct(labels)), ",")

    found = scan_licenses(table(spark, sf_dir, "documents"), "doc_id")
    words = F.transform("places", lambda x: x["word"])
    base = F.transform("places", lambda x: x["label"])
    return found.select(
        "doc_id",
        "n_words",
        F.size("places").cast("long").alias("n_base"),
        F.array_min(words).alias("first_word"),
        F.array_max(words).alias("last_word"),
        joined(base).alias("base_labels"),
        joined(F.concat(base, F.transform("detections", lambda x: x["label"]))).alias("labels"),
        F.coalesce(F.array_max(F.transform("detections", lambda x: x["score"])), F.when(F.size("places") > 0, 0.5), F.lit(0.0)).alias("score"),
    )


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import mix

    return mix(table(spark, sf_dir, "documents"), MIX_TARGETS, MIX_BUDGET).select("doc_id", "source", "lang", "topic", "n_tokens", F.round("probability", 9).alias("probability"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_packing, op2_audio, op3_secrets, op4_simhash, op5_pii, op6_embeddings, op7_language, op8_warc, op9_licenses, op10_mixing)}


def oracle_sql() -> dict[str, str]:
    from .oracles import SQL

    return dict(SQL)
