"""Benchmark decontamination with spaced-seed hashing (DataFrame functions only).

Words are lower-cased runs of non-blank characters, hashed once each.  Every position of
every text gets one hash for each fixed mask; a mask leaves some positions out, so that a
substituted word there does no harm.  Hashes of benchmark items are joined with those of
documents, which gives alignments; the words of each are compared one by one.  A stretch
of an alignment begins and ends with words that agree, and at least ``LEAST_IDENTITY`` of
it agree; stretches that overlap are put together, others are told apart, so what stands
between two of them takes nothing from either.

The masks hit each stretch of ``LEAST_STRETCH`` agreeing words, wherever its substitutions
are; ``SHORT_MASKS`` hit each of a shorter item that holds what it needs.  Which masks an
item has depends on its own length only.  Items under ten words need ``LEAST_IDENTITY`` of
their words (three or fewer thus all), others ``LEAST_SHARE``, or ``LEAST_WORDS`` if these
are fewer.  Defined cases: null or empty texts and items without words match nothing;
equal rows of documents or of the benchmark count once; rows that share an id are one
document or item that holds all their texts; rows without an id match nothing; other columns
are ignored; an empty table of either gives an empty result.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

# The positions that count; and those for items of so many words, from and to.
MASKS = ("11101", "100111")
SHORT_MASKS = {"1": (1, 1), "11": (2, 2), "111": (3, 15), "1101": (3, 15), "1011": (3, 15)}
#: Seed rows of a benchmark, and words of it, that are broadcast; a larger one is joined by shuffling.
BROADCAST_SEEDS, BROADCAST_WORDS = 1_000_000, 8_000_000
#: Words that must agree at least, or this share of a shorter item; and the share that must agree in a stretch.
LEAST_WORDS, LEAST_SHARE, LEAST_IDENTITY = 13, 0.5, 0.75
#: Words that must agree in a stretch that counts, if the item doesn't need fewer.
LEAST_STRETCH = 8


def _words(text: str) -> Column:
    """Hashes of the words of a text."""
    parts = F.split(F.lower(F.coalesce(F.col(text).cast("string"), F.lit(""))), r"[\x20\x09-\x0D]+")
    return F.transform(F.filter(parts, lambda w: w != ""), lambda w: F.xxhash64(w))


def _seeds(rows: DataFrame, masks: list[str]) -> DataFrame:
    """One row for each position and mask that fits: at, seed; rows has words (array of long)."""
    n = F.size("words")
    shortest = min(map(len, masks))
    placed = rows.select("*", F.explode_outer(F.when(n >= shortest, F.sequence(F.lit(0), n - shortest))).alias("at")).where(F.col("at").isNotNull())

    def seed(mask: str) -> Column:
        picked = [F.get("words", F.col("at") + i) for i, c in enumerate(mask) if c == "1"]
        return F.when(F.col("at") + len(mask) <= F.size("words"), F.xxhash64(F.lit(mask), *picked))

    return placed.withColumn("seed", F.explode(F.array(*map(seed, masks)))).where(F.col("seed").isNotNull())


def _needed(n: Column) -> Column:
    """Words of an item of n words that must agree."""
    return F.when(n < 10, F.ceil(n * LEAST_IDENTITY)).otherwise(F.least(F.lit(LEAST_WORDS), F.ceil(n * LEAST_SHARE)))


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", masks: tuple[str, ...] = MASKS) -> DataFrame:
    """One row for each document and item that overlap: doc_id, item_id, n_item_words, n_matched, first_word, last_word."""
    items = benchmark.select(F.col(item_col).alias("item_id"), _words(item_text_col).alias("words")).where((F.size("words") > 0) & F.col("item_id").isNotNull()).distinct()
    items = items.withColumn("item", F.xxhash64("item_id", "words"))
    n = F.size("words")
    longest = max(hi for _, hi in SHORT_MASKS.values())
    lengths = {r[0] for r in items.select(F.least(n, F.lit(longest + 1)).alias("n")).distinct().collect()}  # few numbers
    bounds = {m: (longest + 1, None) for m in masks} | {m: (lo, hi) for m, (lo, hi) in SHORT_MASKS.items() if any(lo <= k <= hi for k in lengths)}
    item_seeds = reduce(DataFrame.unionByName, (_seeds(items.where((n >= lo) & (n <= hi if hi else F.lit(True))), [m]) for m, (lo, hi) in bounds.items()))
    item_seeds = item_seeds.select("seed", "item", F.col("at").alias("item_at"), n.alias("n_item_words")).distinct()
    item_words = items.select("item", "item_id", F.col("words").alias("item_words"))
    if (items.agg(F.sum(n)).first()[0] or 0) <= BROADCAST_WORDS:
        item_words = F.broadcast(item_words)

    doc_words = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("doc_id"), _words(text_col).alias("words")).withColumn("text_", F.xxhash64("words"))
    shift = (F.col("at") - F.col("item_at")).alias("shift")  # where the item would begin
    near = F.slice("words", F.greatest("shift", F.lit(0)) + 1, F.col("n_item_words") + F.least("shift", F.lit(0))).alias("near")
    line = ["doc_id", "text_", "item", "n_item_words", "shift"]
    if item_seeds.count() <= BROADCAST_SEEDS:
        hits = _seeds(doc_words, list(bounds)).join(F.broadcast(item_seeds), "seed").select("words", *line[:-1], shift)
        lines = hits.select(*line, near).groupBy(*line).agg(F.min("near").alias("near"))  # all are equal
    else:  # the words don't travel with every position
        hits = _seeds(doc_words, list(bounds)).select("doc_id", "text_", "at", "seed").join(item_seeds, "seed").select(*line[:-1], shift).distinct()
        lines = hits.join(doc_words.distinct(), ["doc_id", "text_"]).select(*line, near)
    lines = lines.join(item_words, "item")
    skipped = F.greatest(-F.col("shift"), F.lit(0))
    same = F.zip_with(F.slice("item_words", skipped + 1, F.size("near")), F.col("near"), lambda a, b: a == b)
    agreed = F.filter(F.transform(same, lambda x, k: F.when(x, k + skipped)), lambda k: k.isNotNull())
    least = F.least(F.lit(LEAST_STRETCH), _needed(F.col("n_item_words")))
    lines = lines.select("doc_id", "text_", "item", "item_id", "shift", "n_item_words", agreed.alias("agreed")).where(F.size("agreed") >= least)

    # with 1 for a word that agrees and -3 for another, a stretch sums up to 0 at least: from the lowest sum before a gap to the highest after it
    line = Window.partitionBy("doc_id", "text_", "item", "item_id", "shift")
    ordered, parts = line.orderBy("k"), int(round(1 / (1 - LEAST_IDENTITY)))
    before = F.col("k") * parts - F.col("item_at") * (parts - 1)
    words = lines.select("doc_id", "text_", "item", "item_id", "shift", "n_item_words", F.posexplode("agreed").alias("k", "item_at")).withColumn("before", before)
    words = words.withColumn("low", F.min("before").over(ordered.rowsBetween(Window.unboundedPreceding, -1))).withColumn("high", F.max("before").over(ordered.rowsBetween(0, Window.unboundedFollowing)) + 1)
    words = words.withColumn("stretch", F.sum(F.when(F.col("high") < F.col("low"), 1).otherwise(0)).over(ordered.rowsBetween(Window.unboundedPreceding, 0)))
    found = words.groupBy("doc_id", "text_", "item", "item_id", "shift", "n_item_words", "stretch").agg(
        F.count(F.lit(1)).alias("agreed"), (F.col("shift") + F.min("item_at")).alias("first_word"), (F.col("shift") + F.max("item_at")).alias("last_word")
    ).where(F.col("agreed") >= least)
    pairs = found.groupBy("doc_id", "item_id", "n_item_words").agg(
        F.least(F.sum("agreed"), F.col("n_item_words").cast("long")).alias("n_matched"), F.min("first_word").cast("long").alias("first_word"), F.max("last_word").cast("long").alias("last_word")
    )
    return pairs.where(F.col("n_matched") >= _needed(F.col("n_item_words")))


def clean_documents(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents that overlap no benchmark item, with all their columns."""
    bad = contaminated(docs, benchmark, id_col, text_col).select(F.col("doc_id").alias("contaminated_")).distinct()
    return docs.join(bad, docs[id_col].eqNullSafe(bad["contaminated_"]), "left_anti")
