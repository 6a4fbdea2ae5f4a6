"""Benchmark decontamination by a prefix-filtered set join.

A window is `size` consecutive words of an item (the whole item if it has fewer). A window
occurs where all its shingles stand at their offsets. Shingles are ordered by rarity over
all documents; for exact containment one prefix shingle, the rarest, is enough to find every
candidate place. Places are cut by position and length and then verified exactly.

NULL, empty and word-less texts have no words: no hits, no items, not contaminated. Items
without words are ignored; an item with a NULL id marks words but is not named or counted.
Repeated rows get equal results. Empty tables give empty results, or documents without hits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from casestats.llm.common import KEY, fold_ascii, if_small, join_keyed, keyed, stage, without_rows

GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
SIZE = 13
SHINGLE = 4


def words(text: Column) -> Column:
    return F.array_remove(F.split(fold_ascii(text), GAP), "")


def shingles(words: Column, length: int) -> Column:
    """Array of structs of `length` consecutive words; the last ones have NULL fields."""
    parts = [words] + [F.slice(words, i + 1, F.size(words)) for i in range(1, length)]
    return F.arrays_zip(*(p.alias(f"w{i}") for i, p in enumerate(parts)))


def shingle_text(shingle: Column, length: int) -> Column:
    """Words joined by blanks (no word holds one); NULL if one is missing."""
    parts = [shingle.getField(f"w{i}") for i in range(length)]
    joined = parts[0]
    for part in parts[1:]:
        joined = F.concat(joined, F.lit(" "), part)
    return joined


def item_windows(items: DataFrame, size: int = SIZE) -> DataFrame:
    """(item_id, words of the window), one row per window."""
    split = items.select("item_id", words(F.col("text")).alias("all")).filter(F.size("all") > 0)
    start = F.explode(F.sequence(F.lit(1), F.greatest(F.size("all") - size + 1, F.lit(1))))
    return split.withColumn("start", start).select(
        "item_id", F.slice("all", F.col("start"), size).alias("words")
    )


def window_shingles(windows: DataFrame) -> DataFrame:
    """(window, length, width, offset, shingle) of distinct windows."""
    distinct = windows.select(
        F.array_join("words", " ").alias("window"),
        F.size("words").alias("length"),
        F.least(F.size("words"), F.lit(SHINGLE)).alias("width"),
        "words",
    ).distinct()
    offset = F.posexplode(
        F.transform(
            F.sequence(F.lit(1), F.col("length") - F.col("width") + 1),
            lambda i: F.array_join(F.slice(F.col("words"), i, F.col("width")), " "),
        )
    ).alias("offset", "shingle")
    return distinct.select("window", "length", "width", offset)


def occurrences(docs: DataFrame, items: DataFrame, size: int = SIZE) -> DataFrame:
    """(doc_id, text_key, start, length, window) of every window in every document."""
    parts = stage(window_shingles(item_windows(items, size)), "windows")
    widths = sorted(r[0] for r in parts.select("width").distinct().collect())  # at most 4
    known = if_small(parts.select("shingle").distinct())
    split = keyed(docs).select(*KEY, words(F.col("text")).alias("words"))
    n_words = F.size("words").alias("n_words")

    found = None
    for width in widths:
        at = split.filter(F.size("words") >= width).select(
            *KEY, n_words, F.posexplode(shingles(F.col("words"), width)).alias("at", "s")
        )
        at = at.select(*KEY, "n_words", "at", shingle_text(F.col("s"), width).alias("shingle"))
        at = at.filter(F.col("shingle").isNotNull()).join(known, "shingle")
        found = at if found is None else found.unionByName(at)
    if found is None:
        found = split.select(*KEY, n_words, F.lit(0).alias("at"), F.lit("").alias("shingle")).limit(0)
    found = stage(found.distinct(), "shingle_places")

    rarity = found.groupBy("shingle").agg(F.count(F.lit(1)).alias("places"))
    prefix = (
        parts.join(rarity, "shingle", "left")
        .groupBy("window", "length", "width")
        .agg(
            F.min_by(
                F.struct("offset", "shingle"),
                F.struct(F.coalesce("places", F.lit(0)), "offset"),
            ).alias("rarest")
        )
        .select("window", "length", "width", "rarest.offset", "rarest.shingle")
    )
    start = F.col("at") - F.col("offset")
    candidates = (
        found.join(if_small(prefix), "shingle")
        .select(*KEY, "n_words", start.alias("start"), "window", "length", "width")
        .filter((F.col("start") >= 0) & (F.col("start") + F.col("length") <= F.col("n_words")))
    )
    # The window's words, covered by shingles side by side and the last one.
    last = F.col("length") - F.col("width")
    cover = parts.filter((F.col("offset") % SHINGLE == 0) | (F.col("offset") == last))
    expected = candidates.join(
        if_small(cover.select("window", "offset", "shingle")), "window"
    ).withColumn("at", F.col("start") + F.col("offset"))
    place = found.select(
        F.col("doc_id").alias("_doc_id"),
        F.col("text_key").alias("_text_key"),
        F.col("at").alias("_at"),
        F.col("shingle").alias("_shingle"),
    )
    on = (
        F.col("doc_id").eqNullSafe(F.col("_doc_id"))
        & (F.col("text_key") == F.col("_text_key"))
        & (F.col("at") == F.col("_at"))
        & (F.col("shingle") == F.col("_shingle"))
    )
    needed = F.ceil(F.col("length") / SHINGLE).cast("int")
    return (
        expected.join(place, on, "left_semi")
        .groupBy(*KEY, "start", "length", "window")
        .agg(F.count(F.lit(1)).alias("met"))
        .filter(F.col("met") >= needed)
        .drop("met")
    )


def decontaminate(docs: DataFrame, items: DataFrame, size: int = SIZE) -> DataFrame:
    """One row per document row: doc_id, text_key, n_words, n_hit, n_items, items_sha256,
    contaminated (a twentieth of the words or more are hit)."""
    places = stage(occurrences(docs, items, size), "window_places")
    longest = places.groupBy(*KEY, "start").agg(F.max("length").alias("length"))
    order = Window.partitionBy(*KEY).orderBy("start")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    end = F.col("start") + F.col("length")
    seen = F.coalesce(F.max(end).over(before), F.lit(0))
    hit = (
        longest.withColumn("fresh", F.greatest(end - F.greatest(seen, F.col("start")), F.lit(0)))
        .groupBy(*KEY)
        .agg(F.sum("fresh").alias("n_hit"))
    )
    owners = item_windows(items, size).select(
        "item_id", F.array_join("words", " ").alias("window")
    )
    named = (
        places.select(*KEY, "window")
        .join(if_small(owners.filter(F.col("item_id").isNotNull()).distinct()), "window")
        .groupBy(*KEY)
        .agg(F.array_sort(F.collect_set(F.col("item_id").cast("string"))).alias("items"))
    )
    rows = keyed(docs).select(
        *KEY, F.size(words(F.col("text"))).cast("long").alias("n_words")
    )
    found = join_keyed(hit, named, "left")
    n_hit = F.coalesce("n_hit", F.lit(0)).cast("long")
    items_of = F.coalesce("items", F.array().cast("array<string>"))
    return join_keyed(rows, found, "left").select(
        *KEY,
        "n_words",
        n_hit.alias("n_hit"),
        F.size(items_of).cast("long").alias("n_items"),
        F.sha2(F.array_join(items_of, ","), 256).alias("items_sha256"),
        ((n_hit > 0) & (20 * n_hit >= F.col("n_words"))).alias("contaminated"),
    )


def drop_contaminated(docs: DataFrame, items: DataFrame, size: int = SIZE) -> DataFrame:
    """The rows of `docs` that are not contaminated, with all their columns."""
    return without_rows(docs, decontaminate(docs, items, size).filter("contaminated"))
