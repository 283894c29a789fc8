"""Manifest, text and word-box readers, and the ingestion bookkeeping."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexloom.functions import constants as K
from lexloom.functions.text import filled, strip


def coerce_bool(c: Column, default: bool) -> Column:
    """true/1/yes/y/t and false/0/no/n/f/'' ; anything else gives the default."""
    v = F.lower(strip(c.cast("string")))
    return (
        F.when(v.isin("true", "1", "yes", "y", "t"), True)
        .when(v.isin("false", "0", "no", "n", "f", ""), False)
        .otherwise(default)
    )


def coerce_int(c: Column, default: int) -> Column:
    """All-digit strings become integers, everything else the default."""
    return F.coalesce(F.when(c.rlike("^[0-9]+$"), c.try_cast("int")), F.lit(default))


_TEXT = [
    ("source_id", "source_id_external", ""), ("title", "title", ""), ("document_type", "document_type", "act"),
    ("jurisdiction", "jurisdiction", "india"), ("legal_area", "legal_area", "patent"),
    ("status", "status", "active"), ("source_url", "source_url", ""),
    ("publication_date", "publication_date", ""), ("effective_from", "effective_from", ""),
]


def typed_manifest(raw: DataFrame) -> DataFrame:
    """Typed, defaulted and trimmed manifest from all-string rows.

    A default replaces an absent column; an empty cell stays empty, except where
    an empty value has no meaning (collection, parent, products).
    """
    have = set(raw.columns)

    def cell(name: str, default: str | None = None) -> Column:
        # An empty cell is read as null by the CSV source.
        return strip(F.coalesce(F.col(name), F.lit(""))) if name in have else F.lit(default).cast("string")

    product = filled(cell("applicable_product"), cell("applicable_products"), "all")
    kept = raw.where(F.coalesce(F.col("source_id_external"), F.lit("")) != "")
    return kept.select(
        *[cell(src, default).alias(name) for name, src, default in _TEXT],
        filled(cell("collection_name"), "legal_acts").alias("collection_name"),
        product.alias("applicable_product"),
        F.nullif(cell("parent_document"), F.lit("")).alias("parent_document"),
        coerce_int(F.coalesce(cell("authority_level"), F.lit("")), 0).alias("authority_level"),
        coerce_int(F.coalesce(cell("chunk_size"), F.lit("")), K.CHUNK_SIZE).alias("chunk_size"),
        coerce_int(F.coalesce(cell("chunk_overlap"), F.lit("")), K.CHUNK_OVERLAP).alias("chunk_overlap"),
        (coerce_bool(cell("is_amendment"), False) if "is_amendment" in have else F.lit(False)).alias("is_amendment"),
        (coerce_bool(cell("is_ingested"), False) if "is_ingested" in have else F.lit(False)).alias("is_ingested"),
        (
            coerce_bool(cell("enable_contextual_retrieval"), True)
            if "enable_contextual_retrieval" in have else F.lit(True)
        ).alias("enable_contextual"),
        F.lower(cell("embedding_provider", "")).alias("embedding_provider"),
        F.nullif(cell("embedding_model", ""), F.lit("")).alias("embedding_model"),
        F.regexp_replace(cell("pdf_path", ""), r"^[/\\]+", "").alias("path"),
    )


def read_manifest_raw(spark: SparkSession, path: str) -> DataFrame:
    """CSV with header and optional byte-order mark; all columns as text."""
    raw = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    return raw.toDF(*[c.lstrip("\ufeff") for c in raw.columns])


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    return typed_manifest(read_manifest_raw(spark, path))


def file_listing(spark: SparkSession, path: str, root: str | None = None) -> DataFrame:
    """Relative paths below ``path``: a binary-file scan that reads no content."""
    files = (
        spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path")
    )
    base = (root or path).rstrip("/") + "/"
    return files.select(F.regexp_replace(F.substring_index("path", base, -1), "^/+", "").alias("file"))


def resolve_paths(manifest: DataFrame, listing: DataFrame, base_dir: str = ".") -> DataFrame:
    """Match each manifest row to a real file: (source_id, path, resolved_path, resolved).

    Candidates in order: the path as given, below the base folder, ``data`` and
    ``../data``, each also for the parts of a comma-separated file name; then the
    same names compared without case and repeated blanks; then ``{source_id}.pdf``
    and its ``/``-separated parts. Ranked candidates meet the listing by equality,
    so the join stays a hash join at any size.
    """
    has_dir = F.col("path").contains("/")
    folder = F.when(has_dir, F.regexp_replace("path", r"/[^/]*$", "")).otherwise("")
    name = F.substring_index("path", "/", -1)
    ext = F.regexp_extract(name, r"(\.[^.]*)$", 1)
    stem = F.expr("substring(name_, 1, length(name_) - length(ext_))")
    parts = F.filter(F.transform(F.split(stem, ","), strip), lambda x: x != "")
    m = manifest.select("source_id", "path").withColumn("folder_", folder).withColumn("name_", name)
    m = m.withColumn("ext_", ext)
    variants = F.when(F.col("name_") == "", F.array().cast("array<string>")).otherwise(
        F.concat(
            F.array("name_"),
            F.when(F.col("name_").contains(","), F.transform(parts, lambda p: F.concat(p, F.col("ext_")))).otherwise(
                F.array().cast("array<string>")
            ),
        )
    )

    def below(prefix: str, tail: Column) -> Column:
        return tail if prefix in ("", ".") else F.concat(F.lit(prefix.rstrip("/") + "/"), tail)

    def joined(folder_: Column, tail: Column) -> Column:
        return F.when(folder_ == "", tail).otherwise(F.concat(folder_, F.lit("/"), tail))

    exact = F.flatten(
        F.transform(
            variants,
            lambda v: F.array(
                *[below(p, joined(F.col("folder_"), v)) for p in ("", base_dir, "data", "../data")]
            ),
        )
    )
    loose_dirs = [
        below(base_dir, F.col("folder_")) if base_dir not in ("", ".") else F.col("folder_"),
        F.when(F.col("folder_") == "", F.lit("data")).otherwise(F.concat(F.lit("data/"), F.col("folder_"))),
        F.lit("data/abs"),
    ]

    def loose_in(folder_: Column) -> Column:
        return F.transform(variants, lambda v: _loose(folder_, v))

    loose = F.flatten(F.array(*[loose_in(d) for d in loose_dirs]))
    sid = strip(F.col("source_id"))
    sids = F.concat(
        F.array(sid),
        F.when(
            sid.contains("/"), F.filter(F.transform(F.split(sid, "/"), strip), lambda x: x != "")
        ).otherwise(F.array().cast("array<string>")),
    )
    by_id = F.flatten(
        F.transform(
            sids,
            lambda s: F.array(
                *[
                    below(p, F.concat(s, F.lit(".pdf")))
                    for p in (base_dir, "abs" if base_dir in ("", ".") else base_dir + "/abs", "data/abs", "../data/abs")
                ]
            ),
        )
    )
    tagged = F.concat(
        F.transform(exact, lambda k: F.struct(F.lit("exact").alias("kind"), k.alias("key"))),
        F.transform(loose, lambda k: F.struct(F.lit("loose").alias("kind"), k.alias("key"))),
        F.transform(by_id, lambda k: F.struct(F.lit("exact").alias("kind"), k.alias("key"))),
    )
    wanted = m.select("source_id", "path", F.posexplode(tagged).alias("priority", "c")).select(
        "source_id", "path", "priority", "c.kind", "c.key"
    )
    file_dir = F.when(F.col("file").contains("/"), F.regexp_replace("file", r"[^/]*$", "")).otherwise("")
    keys = listing.select("file", F.lit("exact").alias("kind"), F.col("file").alias("key")).unionByName(
        listing.select("file", F.lit("loose").alias("kind"), _loose(file_dir, F.substring_index("file", "/", -1)).alias("key"))
    )
    hits = wanted.join(keys, ["kind", "key"]).groupBy("source_id", "path").agg(
        F.min_by("file", F.struct("priority", "file")).alias("resolved_path")
    )
    return manifest.select("source_id", "path").join(hits, ["source_id", "path"], "left").select(
        "source_id", "path", F.coalesce("resolved_path", "path").alias("resolved_path"),
        F.col("resolved_path").isNotNull().alias("resolved"),
    )


def _loose(folder: Column, name: Column) -> Column:
    tidy = F.regexp_replace(F.lower(name), r"(?U)\s+", " ")
    return F.concat(F.regexp_replace(folder, "/+$", ""), F.lit("|"), tidy)


def read_text_docs(spark: SparkSession, path: str) -> DataFrame:
    """Whole-file texts; these bypass the structure steps."""
    raw = spark.read.text(path, wholetext=True).withColumn("path", F.input_file_name())
    return raw.select("path", F.col("value").alias("text"))


def read_words(spark: SparkSession, path: str) -> DataFrame:
    """Word boxes extracted beforehand (parquet, or JSON lines)."""
    reader = spark.read.json if path.rstrip("/").endswith((".json", ".jsonl")) else spark.read.parquet
    return reader(path).select("doc_id", "page", "word_ix", "text", "top", "size", "fontname")


def format_router(manifest: DataFrame) -> DataFrame:
    """Add ``format``: text, pdf or rejected, by file extension."""
    ext = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))
    return manifest.withColumn(
        "format", F.when(ext == "txt", "text").when(ext == "pdf", "pdf").otherwise("rejected")
    )


def embedding_dims(provider: Column, model: Column) -> Column:
    """Vector size of a provider and model."""
    out = F.when(F.lower(provider).isin("gemini", "google", "google-genai"), K.EMBEDDING_DIM_HOSTED)
    for part, dim in K.EMBEDDING_DIMS:
        out = out.when(model.contains(part), dim)
    return out.otherwise(K.EMBEDDING_DIM_DEFAULT)


def mark_ingested(manifest: DataFrame, done_ids: DataFrame) -> DataFrame:
    """Set is_ingested on finished sources; other columns and their order stay."""
    done = done_ids.select("source_id").distinct().withColumn("__done", F.lit(True))
    flag = F.coalesce("__done", "is_ingested")
    return manifest.join(done, "source_id", "left").withColumn("is_ingested", flag).select(*manifest.columns)
