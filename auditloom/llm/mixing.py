"""Mix sources to target weights: hash-threshold histograms, refined only where a source's budget runs out."""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from auditloom.llm.store import own_columns_aside, stored

WORD = r"[^\x20\x09-\x0D]+"
STEP_BITS = 12
HASH_BITS = 60


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def place(doc_id: Column, text: Column) -> Column:
    """A document's place on the hash line, 60 bits. Rows alike in id and text share one place."""
    key = F.concat_ws(":", F.coalesce(doc_id.cast("string"), F.lit("")), F.md5(F.coalesce(text, F.lit(""))))
    return F.conv(F.substring(F.md5(key), 1, 15), 16, 10).cast("long")


def ranked_sources(sizes: DataFrame) -> DataFrame:
    """Adds rank (0-based, by code point, null last) to one row per source, without one task for all of them."""
    by_range = stored(
        sizes.repartitionByRange(F.col("source").asc_nulls_last()).withColumn("part", F.spark_partition_id()),
        "mix-sources",
    )
    before = (
        by_range.groupBy("part").agg(F.count("*").alias("n"))
        .withColumn("before", F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)))
    )  # one row per range
    within = F.row_number().over(Window.partitionBy("part").orderBy(F.col("source").asc_nulls_last()))
    return (
        by_range.withColumn("within", within).join(before.select("part", "before"), "part")
        .select("source", "source_size", (F.coalesce("before", F.lit(0)) + F.col("within") - 1).alias("rank"))
    )


def source_targets(sizes: DataFrame, weights: Sequence[int], share: tuple[int, int], most: int) -> DataFrame:
    """Words each source is to give: source, source_size, target.

    The budget is share[0] / share[1] of all words, dealt by weight. A source stops at most times its size; what it
    can't give is dealt again to the others by weight, until nobody is above. All sums are whole numbers; only the
    final division isn't.
    """
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    sources = stored(ranked_sources(sizes).withColumn("weight", weight.cast("long")), "mix-weights")
    full = F.lit(False)
    n_full = -1
    while True:
        total = sources.agg(
            F.sum("source_size").alias("all"), F.count(F.when(full, 1)).alias("n_full"),
            F.sum(F.when(full, F.col("source_size") * most)).alias("given"),
            F.sum(F.when(~full, F.col("weight"))).alias("weight"),
        ).first()
        # numbers times share[1], so that they stay whole
        left = (total["all"] or 0) * share[0] - (total["given"] or 0) * share[1]
        per_weight = left / (share[1] * total["weight"]) if total["weight"] else 0.0
        if total["n_full"] == n_full or not total["weight"]:
            break
        n_full = total["n_full"]
        full = F.col("source_size") * most <= F.col("weight") * F.lit(float(per_weight))
    dealt = F.col("weight") * F.lit(int(left)) / F.lit(int(share[1] * (total["weight"] or 1)))
    target = F.when(full, (F.col("source_size") * most).cast("double")).otherwise(dealt)
    return sources.select("source", "source_size", target.cast("double").alias("target"))


def mix_sources(
    docs: DataFrame, weights: Sequence[int] = (3, 1, 2), share: tuple[int, int] = (3, 2), most: int = 2
) -> DataFrame:
    """How often each document enters the mix, so that sources come near their targets.

    A source whose target is f times its words gives every document floor(f) times, and once more those below a
    threshold on the hash line that holds the rest. The threshold is found in a histogram by hash bucket; only the
    bucket in which the budget runs out is split again, until it is one place. That place is taken if this comes
    nearer to the target. Nothing is sorted by hash, and all sums are pre-aggregated.

    docs needs doc_id, text, source. Returns, per row, doc_id, size, source, source_size, target, copies, taken and
    place. Null text: size 0. Null source: a source of its own, the last. Rows alike in id and text are taken or left
    together. No rows: no rows.
    """
    slim = stored(
        docs.select("doc_id", F.col("source"), word_count(F.col("text")).alias("size"), place(F.col("doc_id"), F.col("text")).alias("place")),
        "mix-docs",
    )
    top = F.shiftright("place", HASH_BITS - STEP_BITS)
    cells = stored(
        slim.groupBy("source", top.alias("cell"))
        .agg(F.sum("size").alias("words"), F.min("place").alias("low"), F.max("place").alias("high")),
        "mix-cells",
    )
    targets = stored(
        source_targets(cells.groupBy("source").agg(F.sum("words").alias("source_size")), weights, share, most), "mix-targets"
    )
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    plan = (
        targets.withColumn("whole", F.least(whole, F.lit(most)))
        .withColumn("budget", F.col("target") - F.col("whole") * F.col("source_size"))
    )
    # the first histogram; every later one holds only the split buckets
    level = cells.join(plan.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s"))).drop("s")
    bits, cuts = STEP_BITS, None
    while True:
        order = Window.partitionBy("source").orderBy("cell")
        upto = level.withColumn("upto", F.sum("words").over(order))
        edge = upto.where((F.col("upto") > F.col("budget")) & (F.col("upto") - F.col("words") <= F.col("budget"))).select(
            "source", "cell", "low", "high", "words", (F.col("budget") - (F.col("upto") - F.col("words"))).alias("budget")
        )
        edge = stored(edge, "mix-edge")
        single = (F.col("low") == F.col("high")) | F.lit(bits >= HASH_BITS)
        # documents below the cut are taken once more
        cut = F.when(F.col("budget") * 2 > F.col("words"), F.col("low") + 1).otherwise(F.col("low"))
        found = edge.where(single).select("source", cut.alias("cut"))
        cuts = found if cuts is None else cuts.unionByName(found)
        open_cells = edge.where(~single)
        if open_cells.isEmpty():
            break
        fine = F.shiftright("place", HASH_BITS - bits - STEP_BITS)
        coarse = F.shiftright("place", HASH_BITS - bits)
        split = open_cells.select(F.col("source").alias("s"), F.col("cell").alias("c"), "budget")
        level = (
            slim.join(split, F.col("source").eqNullSafe(F.col("s")) & (coarse == F.col("c")))
            .groupBy("source", "budget", fine.alias("cell"))
            .agg(F.sum("size").alias("words"), F.min("place").alias("low"), F.max("place").alias("high"))
        )
        bits += STEP_BITS
    ends = (
        plan.withColumnRenamed("source", "s").join(cuts.withColumnRenamed("source", "t"), F.col("s").eqNullSafe(F.col("t")), "left")
        .select("s", "source_size", "target", "whole", "cut")
    )
    # a row per source and first bucket, so that a source with most rows is spread over its buckets
    per_cell = (
        cells.select("source", "cell").join(ends, F.col("source").eqNullSafe(F.col("s")))
        .select("s", F.col("cell").alias("c"), "source_size", "target", "whole", "cut")
    )
    once_more = (F.col("whole") < most) & F.coalesce(F.col("place") < F.col("cut"), F.lit(False))
    copies = F.col("whole") + F.when(once_more, 1).otherwise(0)
    return (
        slim.join(per_cell, F.col("source").eqNullSafe(F.col("s")) & (top == F.col("c")))
        .select("doc_id", "size", "source", "source_size", "target", copies.alias("copies"), "place")
        .withColumn("taken", F.col("copies") * F.col("size"))
    )


@own_columns_aside("doc_id", "text", "source")
def mix_documents(docs: DataFrame, **settings) -> DataFrame:
    """The documents of the mix with all their columns, and mix_copies (instead of an own column of that name): how often each
    enters it. Others go."""
    chosen = mix_sources(docs, **settings).where("copies > 0")
    # rows alike in id and text share a place, a source and so a decision
    key = chosen.groupBy(F.col("place").alias("mix_place"), F.col("source").alias("mix_source")).agg(F.max("copies").alias("mix_copies"))
    here = place(docs["doc_id"], docs["text"])
    return (
        docs.join(key, (here == F.col("mix_place")) & docs["source"].eqNullSafe(F.col("mix_source")))
        .drop("mix_place", "mix_source")
    )


MIX_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
    ('0x' || substr(md5(concat_ws(':', coalesce(doc_id::VARCHAR, ''), md5(coalesce(text, '')))), 1, 15))::BIGINT AS place
  FROM {docs}),
per_source AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
weighed AS (
  SELECT *, [3, 1, 2][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3) + 1]::BIGINT AS weight FROM per_source),
filled AS (
  SELECT *, sum(source_size) OVER ()::BIGINT AS total, sum(weight) OVER ()::BIGINT AS total_weight,
    coalesce(sum(2 * source_size) OVER by_fill, 0)::BIGINT AS given, coalesce(sum(weight) OVER by_fill, 0)::BIGINT AS full_weight
  FROM weighed
  WINDOW by_fill AS (ORDER BY source_size::DOUBLE / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
level AS (
  SELECT *, 2 * source_size > weight * ((3 * total - 2 * given) / (2.0 * (total_weight - full_weight))) AS open FROM filled),
first_open AS (
  SELECT given, full_weight FROM level WHERE open ORDER BY source_size::DOUBLE / weight, source NULLS LAST LIMIT 1),
targets AS (
  SELECT source, source_size, CASE WHEN 2 * source_size <= weight * ((3 * total - 2 * f.given) / (2.0 * (total_weight - f.full_weight)))
      THEN (2 * source_size)::DOUBLE
      ELSE (weight * (3 * total - 2 * f.given))::DOUBLE / (2 * (total_weight - f.full_weight))::DOUBLE END AS target
  FROM level LEFT JOIN first_open f ON true),
planned AS (
  SELECT *, CASE WHEN source_size > 0 THEN least(floor(target / source_size), 2) ELSE 0 END::BIGINT AS whole FROM targets),
placed AS (
  SELECT d.doc_id, d.size, d.place, d.source, p.source_size, p.target, p.whole, p.target - p.whole * p.source_size AS budget,
    sum(d.size) OVER at_place AS upto, sum(d.size) OVER same_place AS words
  FROM sized d JOIN planned p ON d.source IS NOT DISTINCT FROM p.source
  WINDOW at_place AS (PARTITION BY d.source ORDER BY d.place), same_place AS (PARTITION BY d.source, d.place)),
counted AS (
  SELECT *, whole + CASE WHEN whole < 2 AND source_size > 0 AND (upto <= budget OR (upto - words <= budget AND 2 * (budget - (upto - words)) > words))
    THEN 1 ELSE 0 END AS copies FROM placed)
"""
