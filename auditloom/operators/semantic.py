"""Heading to section alignment: chunks, vectors, chunk, page and site scores."""

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as TY

from auditloom.functions import text as T
from auditloom.functions.text import let
from auditloom.operators.rollup import mean_half_even, top_messages
from auditloom.session import checkpoint
from auditloom.sources.keyed_store import KeyedStore

DIMENSIONS = 64
FIRST_LETTER = 48
BYTES = "".join(map(chr, range(256)))
BYTE_LETTERS = "".join(chr(FIRST_LETTER + b % DIMENSIONS) for b in range(256))
VECTORS = TY.StructType([TY.StructField("key", TY.StringType()), TY.StructField("vector", TY.ArrayType(TY.FloatType()))])


def text_chunks(parsed: DataFrame) -> DataFrame:
    """Sections with a heading and content; `section_position` counts all sections."""
    keep = [c for c in parsed.columns if c in ("site_id", "crawl_pos", "page_id", "url")]
    rows = parsed.select(*keep, F.inline("sections")).withColumnRenamed("pos", "section_position")
    return rows.where("heading <> '' AND content <> ''")


def bag_vector(text: Column) -> Column:
    """Unit vector of word counts over 64 md5 buckets; a stand-in where no model is at hand."""
    # the first byte of every word's md5, turned from hex at once rather than word by word
    heads = F.transform(T.words(F.lower(text)), lambda w: F.substring(F.md5(w.cast("binary")), 1, 2))
    # a letter per word, so that a bucket is counted by what its letter takes out of one short text
    letters = F.translate(F.decode(F.unhex(F.array_join(heads, "")), "ISO-8859-1"), BYTES, BYTE_LETTERS)
    counts = let(
        letters,
        lambda found: F.array(
            *[(F.length(found) - F.length(F.replace(found, F.lit(chr(FIRST_LETTER + b)), F.lit("")))).cast("double") for b in range(DIMENSIONS)]
        ),
    )
    return unit_vector(counts)


def unit_vector(vector: Column) -> Column:
    def scaled(v: Column) -> Column:
        norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda acc, x: acc + x * x))
        return let(norm, lambda n: F.transform(v, lambda x: F.when(n > 0, x / n).otherwise(F.lit(0.0)).cast("float")))

    return let(vector, scaled)


def embed_with_bag(chunks: DataFrame) -> DataFrame:
    return chunks.withColumns(
        {"heading_vector": bag_vector(F.col("heading")), "content_vector": bag_vector(F.col("content"))}
    )


def embed_with_table(chunks: DataFrame, vectors: DataFrame, on: list[str]) -> DataFrame:
    """Attach precomputed vectors (`heading_vector`, `content_vector`); an equi-join on the chunk key.

    A chunk without a vector keeps NULL vectors, so that it can be reported (`chunks_without_vector`); averages leave
    its score out.
    """
    return chunks.join(vectors, on, "left")


def chunks_without_vector(chunks: DataFrame) -> DataFrame:
    return chunks.where("heading_vector IS NULL OR content_vector IS NULL")


def embed_with_model(chunks: DataFrame, make_predict: Callable, batch_size: int = 32) -> DataFrame:
    """Run the caller's model over heading and content. `make_predict()` is called once per Python worker
    and returns a function from a batch of texts to a 2-D array; vectors are scaled to unit length."""
    from pyspark.ml.functions import predict_batch_udf

    predict = predict_batch_udf(
        make_predict, return_type=TY.ArrayType(TY.FloatType()), batch_size=batch_size
    )
    raw = chunks.withColumns({"_h": predict(F.col("heading")), "_c": predict(F.col("content"))})
    doubles = "array<double>"
    return raw.withColumns(
        {
            "heading_vector": unit_vector(F.col("_h").cast(doubles)),
            "content_vector": unit_vector(F.col("_c").cast(doubles)),
        }
    ).drop("_h", "_c")


def embed_with_store(chunks: DataFrame, make_predict: Callable, path: str, batch_size: int = 32) -> DataFrame:
    """As `embed_with_model`, but each text goes to the model once, in this run and in those before it.

    The distinct texts of headings and contents meet the vectors kept at `path`, those without one are embedded
    and added as a new run, and both vectors are joined back. Texts are told apart by their md5.
    """
    from pyspark.ml.functions import predict_batch_udf

    predict = predict_batch_udf(make_predict, return_type=TY.ArrayType(TY.FloatType()), batch_size=batch_size)
    keyed = chunks.withColumns({"_h": F.md5("heading"), "_c": F.md5("content")})
    texts = keyed.select(F.inline(F.array(*[F.struct(F.col(k).alias("key"), F.col(t).alias("text")) for k, t in (("_h", "heading"), ("_c", "content"))])))
    texts = checkpoint(texts.dropDuplicates(["key"]))
    store = KeyedStore(chunks.sparkSession, path, ["key"], VECTORS, lambda rows: rows.dropDuplicates(["key"]))
    n = store.batches()
    fresh = texts.join(store.of(texts, n).select("key"), "key", "left_anti") if n else texts
    store.put(fresh.select("key", unit_vector(predict("text").cast("array<double>")).alias("vector")), n)
    vectors = store.of(texts, n + 1)
    for key, name in (("_h", "heading_vector"), ("_c", "content_vector")):
        keyed = keyed.join(vectors.select(F.col("key").alias(key), F.col("vector").alias(name)), key, "left")
    return keyed.drop("_h", "_c")


def alignment_score(heading_vector: Column, content_vector: Column) -> Column:
    """Dot product times 100, half-even; may be negative."""
    products = F.zip_with(heading_vector, content_vector, lambda a, b: a.cast("double") * b.cast("double"))
    return T.half_even(F.aggregate(products, F.lit(0.0), lambda acc, x: acc + x) * 100)


def alignment_finding(score: Column, heading: Column) -> Column:
    return (
        F.when(score > 70, F.concat(F.lit("section.coherent:"), heading))
        .when(score > 30, F.concat(F.lit("section.drifts:"), heading))
        .otherwise(F.concat(F.lit("section.misaligned:"), heading))
    )


def alignment_recommendation(score: Column, heading: Column) -> Column:
    return F.when(score > 70, F.lit(None).cast("string")).when(
        score > 30, F.concat(F.lit("section.refocus:"), heading)
    ).otherwise(F.lit("section.rewrite"))


def score_chunks(embedded: DataFrame) -> DataFrame:
    scored = embedded.withColumn("alignment_score", alignment_score(F.col("heading_vector"), F.col("content_vector")))
    score, heading = F.col("alignment_score"), F.col("heading")
    return scored.withColumns(
        {
            "finding": alignment_finding(score, heading),
            "recommendation": alignment_recommendation(score, heading),
        }
    ).drop("heading_vector", "content_vector")


def page_semantic(chunk_scores: DataFrame) -> DataFrame:
    """Half-even mean of a page's chunk scores, its band and its sections in order."""
    keys = [c for c in ("site_id", "crawl_pos", "page_id", "url") if c in chunk_scores.columns]
    section = F.struct("section_position", "heading", "alignment_score", "finding", "recommendation")
    pages = chunk_scores.groupBy(*keys).agg(
        mean_half_even("alignment_score").alias("overall_score"),
        F.sort_array(F.collect_list(section)).alias("section_scores"),
    )
    score = F.col("overall_score")
    finding = F.when(score > 70, "page.coherent").when(score >= 40, "page.moderate").otherwise("page.poor")
    advice = F.when(score > 70, F.lit(None).cast("string")).when(score >= 40, "page.review").otherwise("page.overhaul")
    return pages.withColumns({"finding": finding, "recommendation": advice})


def top_semantic_messages(semantic_pages: DataFrame) -> DataFrame:
    pairs = F.array(
        F.struct(F.lit("finding").alias("kind"), F.col("finding").alias("message")),
        F.struct(F.lit("recommendation").alias("kind"), F.col("recommendation").alias("message")),
    )
    flat = semantic_pages.select(
        "site_id", "crawl_pos", F.lit(0).alias("category_pos"), F.lit(0).alias("pos"), F.inline(pairs)
    )
    return top_messages(flat.where("message IS NOT NULL"))


def site_semantic(semantic_pages: DataFrame, sites: DataFrame | None = None) -> DataFrame:
    """Half-even mean of page scores; pages without chunks are not in it, sites without pages get 0."""
    means = semantic_pages.groupBy("site_id").agg(mean_half_even("overall_score").alias("overall_score"))
    if sites is None:
        return means
    return sites.select("site_id").join(means, "site_id", "left").select(
        "site_id", F.coalesce("overall_score", F.lit(0)).alias("overall_score")
    )
