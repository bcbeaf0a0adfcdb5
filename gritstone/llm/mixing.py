"""Mixing sources to target weights by a low-discrepancy schedule, with DataFrame functions only.

Sources share ``epochs`` times all words by their weights; a target stops at ``most`` times its source's words and the
excess is reshared by weight, which is the level at which min(most x size, level x weight) fills the whole.

Each source's documents are laid out twice, each time in an order shuffled by hash, and cut into blocks of equal
numbers of words. A Weyl sequence of the golden ratio, mapped through the cumulative targets, gives each slot of the
schedule a source; the k-th slot of a source takes its k-th block, the last of which stops at the target. The sequence
goes on for as many slots again, where a source takes the few blocks that it still lacks; slots of a source that has
none left stay empty. A document's first_slot is the earliest at which its first word is taken.

Running sums are taken within hash ranges of bounded size and then over the ranges' totals, so no task holds a source.
Two tables are ordered in one task: the sources (a row each) and, per source, the totals of ranges.

Cases: null and wordless texts have size 0 and are never taken; a null source is a source of its own, last; a null
doc_id is a key like any other; repeated rows are documents of their own, in the stage too; an empty table gives no rows.
Extra columns are ignored, and kept by the stage, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as Win
from pyspark.sql import functions as F

from ._shared import Scratch, table

WEIGHTS = (5, 2, 1)
EPOCHS = 1.5
MOST = 2.0
BLOCK = 256
#: Rows of a hash range or of a range of slots, as an expectation.
RANGE = 4096
#: floor(2**31 x (sqrt(5) - 1) / 2), which is odd: the step of the sequence modulo 2**31.
GOLDEN, PERIOD = 1327217885, 1 << 31
WORD = r"[^\x20\x09-\x0D]+"


def sizes(docs: DataFrame, text: str = "text") -> Column:
    """Words of a text; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(base: DataFrame, weights=WEIGHTS, epochs: float = EPOCHS, most: float = MOST) -> DataFrame:
    """source, n, source_size, target, w (weight) of each source; base: source, size."""
    order = Win.orderBy(F.col("source").asc_nulls_last())
    by = base.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n"))
    cycle = F.array(*[F.lit(float(x)) for x in weights])
    by = by.withColumn("w", F.element_at(cycle, (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("int")))
    by = by.withColumn("cap", F.lit(most) * F.col("source_size"))
    # Sources ascending by cap / weight: the first whose cap is at or above the level leaves that level for all after it.
    rising = Win.orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last())
    every = Win.partitionBy()
    by = by.withColumn("before", F.coalesce(F.sum("cap").over(rising.rowsBetween(Win.unboundedPreceding, -1)), F.lit(0.0)))
    by = by.withColumn("after", F.sum("w").over(rising.rowsBetween(0, Win.unboundedFollowing)))
    by = by.withColumn("level", (F.lit(epochs) * F.sum("source_size").over(every) - F.col("before")) / F.col("after"))
    by = by.withColumn("place", F.row_number().over(rising))
    by = by.withColumn("level", F.min(F.when(F.col("level") * F.col("w") <= F.col("cap"), F.struct("place", "level"))).over(every)["level"])
    return by.select("source", "n", "source_size", "w", F.least("cap", F.coalesce(F.col("level") * F.col("w"), F.col("cap"))).alias("target"))


def _same(a: str, b: str) -> Column:
    return F.col(a).eqNullSafe(F.col(b))


def layout(scratch: Scratch, base: DataFrame, by: DataFrame, rows: int) -> DataFrame:
    """source, rid, size, at: where each document begins in its source's two shuffled rounds."""
    ranges = max(1, -(-2 * rows // RANGE))
    twice = base.filter("size > 0").withColumn("round", F.explode(F.array(F.lit(0), F.lit(1))))
    twice = twice.withColumn("h", F.conv(F.substring(F.md5(F.concat_ws(":", "doc_id", "round")), 1, 15), 16, 10).cast("long"))
    twice = twice.withColumn("range", F.col("round") * ranges + F.floor(F.col("h") / F.lit(float(1 << 60)) * ranges))
    totals = twice.groupBy("source", "range").agg(F.sum("size").alias("total"))
    ahead = Win.partitionBy("source").orderBy("range").rowsBetween(Win.unboundedPreceding, -1)
    totals = totals.select(F.col("source").alias("s"), F.col("range").alias("r"), F.coalesce(F.sum("total").over(ahead), F.lit(0)).alias("ahead"))
    within = Win.partitionBy("source", "range").orderBy("h", "doc_id", "size", "rid").rowsBetween(Win.unboundedPreceding, -1)
    laid = twice.withColumn("at", F.coalesce(F.sum("size").over(within), F.lit(0)))
    laid = laid.join(totals, _same("source", "s") & (F.col("range") == F.col("r")))
    return laid.select("source", "rid", "size", (F.col("at") + F.col("ahead")).alias("at"))


def schedule(spark: SparkSession, by: DataFrame, slots: int, sources: int) -> DataFrame:
    """source, k, slot: the k-th block of each source and its slot. by: source, blocks (slots in all)."""
    order = Win.orderBy(F.col("source").asc_nulls_last())
    by = by.filter("blocks > 0").withColumn("to", F.sum("blocks").over(order)).withColumn("from", F.col("to") - F.col("blocks"))
    cells = 1 << max(4, (4 * sources - 1).bit_length())  # about a source or two in each
    scale = F.lit(float(slots))
    by = by.withColumn("from", F.col("from") / scale).withColumn("to", F.col("to") / scale)
    of = by.withColumn("cell", F.explode(F.sequence(F.floor(F.col("from") * cells), F.least(F.floor(F.col("to") * cells), F.lit(cells - 1)))))
    # Slots are drawn modulo the sequence's period, in products below 2**62.
    slot = spark.range(2 * slots).select(F.col("id").alias("slot"), (F.pmod(F.pmod(F.col("id"), F.lit(PERIOD)) * F.lit(GOLDEN), F.lit(PERIOD)) / F.lit(float(PERIOD))).alias("u"))
    slot = slot.withColumn("cell", F.floor(F.col("u") * cells))
    dealt = slot.join(of, "cell").filter((F.col("u") >= F.col("from")) & (F.col("u") < F.col("to"))).select("slot", "source", "blocks")
    dealt = dealt.withColumn("range", F.floor(F.col("slot") / RANGE))
    totals = dealt.groupBy("source", "range").agg(F.count("*").alias("total"))
    ahead = Win.partitionBy("source").orderBy("range").rowsBetween(Win.unboundedPreceding, -1)
    totals = totals.select(F.col("source").alias("s"), F.col("range").alias("r"), F.coalesce(F.sum("total").over(ahead), F.lit(0)).alias("ahead"), "total")
    rank = F.row_number().over(Win.partitionBy("source", "range").orderBy("slot")) - 1
    ranked = dealt.withColumn("k", rank).join(totals, _same("source", "s") & (F.col("range") == F.col("r"))).withColumn("k", F.col("k") + F.col("ahead"))
    ranked = ranked.filter("k < blocks").select("source", "k", "slot")
    # A source of less than a block's share may have no slot at all: its blocks come last.
    have = totals.groupBy("s").agg(F.sum("total").alias("have"))
    short = by.join(have, _same("source", "s"), "left").withColumn("have", F.coalesce("have", F.lit(0))).filter("have < blocks")
    tail = short.select("source", F.explode(F.sequence(F.col("have"), F.col("blocks") - 1)).alias("k"))
    return ranked.unionByName(tail.select("source", "k", (F.lit(2 * slots) + F.col("k")).alias("slot")))


def plan(scratch: Scratch, base: DataFrame, weights=WEIGHTS, epochs: float = EPOCHS, most: float = MOST, block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """Sources (goal_source, words, source_size, target, blocks), and of each row taken from: rid, taken, begins (slots, ascending).

    base: rid, doc_id, source, size, saved. begins has a slot for each round in which the row's first word is taken.
    """
    spark = base.sparkSession
    by = targets(base, weights, epochs, most).withColumn("words", F.round("target").cast("long")).withColumn("blocks", F.ceil(F.col("words") / F.lit(block)).cast("long"))
    by = scratch.save(by, "sources")
    rows, slots, sources = by.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("blocks"), F.lit(0)), F.count("*")).first()
    goal = by.select(F.col("source").alias("goal_source"), "words", "source_size", "target", "blocks")
    if not slots:
        return goal, spark.createDataFrame([], "rid long, taken long, begins array<long>")
    laid = layout(scratch, base, by, rows).join(goal.select(F.col("goal_source"), "words"), _same("source", "goal_source")).filter("at < words")
    parts = laid.withColumn("k", F.explode(F.sequence(F.floor(F.col("at") / block), F.floor((F.least(F.col("at") + F.col("size"), F.col("words")) - 1) / block))))
    words = F.least(F.col("at") + F.col("size"), (F.col("k") + 1) * block, F.col("words")) - F.greatest(F.col("at"), F.col("k") * block)
    dealt = schedule(spark, by, slots, sources).select(F.col("source").alias("slot_source"), F.col("k").alias("slot_k"), "slot")
    # A null source joins as one: coalesced keys with a flag keep the join an equi-join that can be split.
    met = parts.join(dealt, _same("source", "slot_source") & (F.col("k") == F.col("slot_k")))
    first = F.when(F.floor(F.col("at") / block) == F.col("k"), F.col("slot"))
    return goal, met.groupBy("rid").agg(F.sum(words).alias("taken"), F.array_sort(F.collect_list(first)).alias("begins"))


def mix(docs: DataFrame, weights=WEIGHTS, epochs: float = EPOCHS, most: float = MOST, block: int = BLOCK) -> DataFrame:
    """doc_id, size, source_size, target, taken, first_slot of every row."""
    scratch = Scratch(docs.sparkSession, "mix")
    base = scratch.save(docs.select("doc_id", "source", sizes(docs).alias("size"), F.monotonically_increasing_id().alias("rid")), "base")
    goal, taken = plan(scratch, base, weights, epochs, most, block)
    out = base.join(taken, "rid", "left").join(goal, _same("source", "goal_source"), "left")
    return scratch.finish(out.select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"), F.get("begins", F.lit(0)).alias("first_slot")))


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents", "doc_id", "text", "source"))


def content(docs: DataFrame) -> list[Column]:
    """Two 64-bit hashes of a row's whole content; rows of equal content need not be told apart."""
    columns = [F.to_json(F.struct(c)) if "map<" in kind or kind == "variant" else F.col(f"`{c}`") for c, kind in docs.dtypes]
    nulls = F.concat_ws("", *[F.when(F.col(f"`{c}`").isNull(), "1").otherwise("0") for c in docs.columns])
    return [F.xxhash64(F.lit(k), nulls, *columns).alias(f"key{k}") for k in (1, 2)]


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document, whole, at each slot at which the mix takes its first word (0, 1 or 2 times).

    Rows are dealt by hash, and each partition is in the order of slots: every file is a sample of the mix that follows the
    schedule. Documents are met again by a hash of their content, so no copy of them is written. Rows of equal content are counted
    as documents of their own, and written from one of them as often as the mix takes them all together.
    """
    scratch = Scratch(spark, "mixing")
    keys = ["key1", "key2"]
    keyed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), *content(docs), sizes(docs).alias("size"))
    base = keyed.select(F.col("row.doc_id").alias("doc_id"), F.col("row.source").alias("source"), "size", *keys, F.monotonically_increasing_id().alias("rid"))
    base = scratch.save(base.filter("size > 0"), "base")
    begins = plan(scratch, base.select("rid", "doc_id", "source", "size"))[1]
    slots = base.join(begins, "rid", "left").groupBy(*keys).agg(F.count("*").alias("rows"), F.flatten(F.collect_list("begins")).alias("slots"))
    slots = scratch.save(slots.filter("rows > 1 or size(slots) > 0"), "slots")
    once = keyed.select("row", *keys).join(slots.filter("rows = 1").select(*keys, "slots"), keys).select("row", "slots")
    several = keyed.select("row", *keys).join(slots.filter("rows > 1").select(*keys), keys, "left_semi").groupBy(*keys).agg(F.any_value("row").alias("row"))
    several = several.join(slots.filter("rows > 1").select(*keys, "slots"), keys).select("row", "slots")
    mixed = once.unionByName(several).select("row", F.explode("slots").alias("slot")).sortWithinPartitions("slot")
    return mixed.select(*[F.col("row").getField(c).alias(c) for c in docs.columns])


ORACLE = f"""
WITH base AS (
  SELECT doc_id, source, CAST(COALESCE(len(regexp_extract_all(text, '{WORD}')), 0) AS BIGINT) AS size FROM documents
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size, [5.0, 2.0, 1.0][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3]::DOUBLE AS w
  FROM base GROUP BY source
), c AS (
  SELECT *, 2.0::DOUBLE * source_size AS cap,
    COALESCE(sum(2.0::DOUBLE * source_size) OVER (ORDER BY 2.0::DOUBLE * source_size / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
    sum(w) OVER (ORDER BY 2.0::DOUBLE * source_size / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS after,
    1.5::DOUBLE * sum(source_size) OVER () AS whole
  FROM s
), l AS (
  SELECT (whole - before) / after AS level FROM c WHERE (whole - before) / after * w <= cap ORDER BY cap / w, source NULLS LAST LIMIT 1
), t AS (
  SELECT source, source_size, target, round(target)::BIGINT AS words
  FROM (SELECT source, source_size, least(cap, COALESCE((SELECT level FROM l) * w, cap)) AS target FROM c)
), laid AS (
  SELECT doc_id, source, size, COALESCE(sum(size) OVER (PARTITION BY source ORDER BY round, h, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS at
  FROM (SELECT *, ('0x' || substr(md5(doc_id || ':' || round), 1, 15))::BIGINT AS h FROM base, (SELECT unnest([0, 1]) AS round))
), cut AS (
  SELECT l.*, t.words, t.source_size, t.target FROM laid l JOIN t ON l.source IS NOT DISTINCT FROM t.source
), blocks AS (
  SELECT source, ceil(words / {BLOCK}.0::DOUBLE)::BIGINT AS blocks FROM t
), spans AS (
  SELECT source, blocks, (sum(blocks) OVER o - blocks) / n::DOUBLE AS lo, sum(blocks) OVER o / n::DOUBLE AS hi, n
  FROM (SELECT *, sum(blocks) OVER ()::BIGINT AS n FROM blocks WHERE blocks > 0) WINDOW o AS (ORDER BY source NULLS LAST)
), slots AS (
  SELECT slot, (slot % {PERIOD} * {GOLDEN}) % {PERIOD} / {PERIOD}.0::DOUBLE AS u FROM (SELECT unnest(range(0, (SELECT 2 * max(n) FROM spans))) AS slot)
), dealt AS (
  SELECT source, slot, row_number() OVER (PARTITION BY source ORDER BY slot) - 1 AS k FROM slots JOIN spans ON u >= lo AND u < hi
), firsts AS (
  SELECT cut.doc_id, COALESCE(min(slot), min(2 * n + cut.at // {BLOCK})) AS first_slot
  FROM cut JOIN spans ON cut.source IS NOT DISTINCT FROM spans.source LEFT JOIN dealt ON cut.source IS NOT DISTINCT FROM dealt.source AND cut.at // {BLOCK} = k
  WHERE cut.size > 0 AND cut.at < words GROUP BY cut.doc_id
), d AS (
  SELECT doc_id, any_value(size) AS size, source_size, target, sum(greatest(least(cut.at + size, words) - cut.at, 0))::BIGINT AS taken FROM cut GROUP BY doc_id, source_size, target
)
SELECT d.doc_id, size, source_size, target, taken, first_slot FROM d LEFT JOIN firsts ON d.doc_id IS NOT DISTINCT FROM firsts.doc_id
"""
