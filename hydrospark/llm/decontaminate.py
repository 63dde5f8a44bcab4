"""Benchmark decontamination as a prefix-filtered set join, in DataFrame functions only.

Item windows are sets of positioned word shingles. Shingles are ordered by
rarity in the whole corpus; a window that occurs in a document contains all of
its shingles, so its rarest one is the necessary prefix. Documents meet windows
on that shingle alone; position and length bounds drop windows that would stick
out of the document, and containment is verified exactly, on shingles that
cover the window.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hydrospark.llm.common import broadcast_if_small, cut_lineage, text_key, word_array

WINDOW = 13
SHINGLE = 3


def _shifted(words):
    """Each word with the two after it (null beyond the end)."""
    return F.arrays_zip(words, F.slice(words, 2, F.size(words)), F.slice(words, 3, F.size(words))).cast(
        "array<struct<a:string,b:string,c:string>>")


def item_windows(benchmark: DataFrame, text_col: str, id_col: str, window: int) -> tuple[DataFrame, DataFrame]:
    """(distinct windows: win, words, len) and (membership: win, item)."""
    items = benchmark.select(F.col(f"`{id_col}`").alias("item"), word_array(F.col(f"`{text_col}`")).alias("ws"))
    items = items.where(F.size("ws") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("ws") - (window - 1), F.lit(1)))
    every = items.select("item", F.explode(F.transform(starts, lambda s: F.slice("ws", s, window))).alias("words"))
    every = cut_lineage(every.distinct())
    wins = cut_lineage(every.select("words").distinct().select(
        F.monotonically_increasing_id().alias("win"), "words", F.size("words").alias("len")))
    return wins, every.join(wins.select("win", "words"), "words").select("win", "item")


def contamination(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", id_col: str = "doc_id",
                  item_text_col: str = "text", item_col: str = "item_id", window: int = WINDOW,
                  small_rows: int = 2_000_000) -> DataFrame:
    """One row per row of ``docs``: the id, ``_text_hash``/``_text_bytes``,
    ``n_words``, ``n_hit`` (words inside any occurrence of a window) and
    ``items`` (sorted texts of the ids of items with occurring windows).

    A window is ``window`` consecutive item words; an item with fewer words,
    but not none, is one window. Null texts have no words. Items without words
    or with a null id name no item (the latter's windows still mark words).
    Repeated documents are judged each; repeated items count once. Whole texts
    are read once; very long ones only lengthen their own rows. Other columns
    are ignored. Empty tables give no hits or an empty result.

    The shingles of the benchmark are broadcast up to ``small_rows``; a larger
    benchmark is a shuffle join with the same result.
    """
    wins, members = item_windows(benchmark, item_text_col, item_col, window)
    # A window's shingles: all runs of 3 words, or the whole of a shorter window.
    runs = wins.select("win", "len", F.posexplode(_shifted(F.col("words"))).alias("o", "s")).where(
        (F.col("len") < SHINGLE) & (F.col("o") == 0) | (F.col("o") <= F.col("len") - SHINGLE))
    runs = runs.select("win", "len", "o", "s.a", "s.b", "s.c")
    grams = cut_lineage(runs.select("a", "b", "c").distinct().select(
        F.monotonically_increasing_id().alias("gram"), "a", "b", "c", F.xxhash64("a", "b", "c").alias("h")))
    short = [r[0] for r in wins.where(F.col("len") < SHINGLE).select("len").distinct().collect()]  # at most 1 and 2
    runs = cut_lineage(runs.join(grams, (runs.a == grams.a) & runs.b.eqNullSafe(grams.b) & runs.c.eqNullSafe(grams.c))
                       .select("win", "len", "o", "gram"))

    text = F.col(f"`{text_col}`")
    words = docs.select(F.col(f"`{id_col}`").alias("_id"), *text_key(text), word_array(text).alias("ws"))
    words = words.withColumn("_row", F.monotonically_increasing_id())
    at = words.select("_row", "_id", "_text_hash", "_text_bytes", F.size("ws").alias("n_words"),
                      F.posexplode_outer(_shifted(F.col("ws"))).alias("pos", "s"))
    none = F.lit(None).cast("string")
    if short:
        forms = [F.struct(F.col("s.a"), F.col("s.b"), F.col("s.c"), F.lit(0).alias("form"))]
        forms += [F.struct(F.col("s.a"), F.col("s.b") if k == 2 else none.alias("b"), none.alias("c"),
                           F.lit(k).alias("form")) for k in short]
        at = at.withColumn("s", F.explode(F.array(*forms)))
    else:
        at = at.withColumn("s", F.struct("s.a", "s.b", "s.c", F.lit(0).alias("form")))
    first = F.coalesce(F.col("pos"), F.lit(0)).eqNullSafe(0) & (F.col("s.form") == 0)
    at = at.select("_row", "_id", "_text_hash", "_text_bytes", "n_words", "pos", first.alias("first"), "s.a", "s.b",
                   "s.c", F.xxhash64("s.a", "s.b", "s.c").alias("dh"))
    g = broadcast_if_small(grams, small_rows).select("gram", "h", F.col("a").alias("ga"), F.col("b").alias("gb"),
                                                     F.col("c").alias("gc"))
    same = ((F.col("dh") == F.col("h")) & (F.col("a") == F.col("ga")) & F.col("b").eqNullSafe(F.col("gb"))
            & F.col("c").eqNullSafe(F.col("gc")))
    # The only pass over the texts: shingles of the benchmark, and one row that stands for each document.
    seen = cut_lineage(at.join(g, same, "left").where(F.col("gram").isNotNull() | F.col("first"))
                       .select("_row", "_id", "_text_hash", "_text_bytes", "n_words", "pos", "first", "gram"))
    hits = seen.where("gram is not null").select("_row", "n_words", "pos", "gram").distinct()

    rarity = hits.groupBy("gram").agg(F.count(F.lit(1)).alias("n"))
    prefix = (runs.join(rarity, "gram", "left").groupBy("win", "len")
              .agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "gram", "o")).alias("p"))
              .select("win", "len", F.col("p.gram").alias("gram"), F.col("p.o").alias("o")))
    met = (hits.join(prefix, "gram").withColumn("start", F.col("pos") - F.col("o"))
           .where((F.col("start") >= 0) & (F.col("start") + F.col("len") <= F.col("n_words")))
           .select("_row", "win", "len", "start"))
    # Every third shingle and the last cover all words of a window.
    cover = runs.where((F.col("o") % SHINGLE == 0) | (F.col("o") == F.col("len") - SHINGLE))
    need = met.join(cover.select("win", "o", "gram"), "win").withColumn("pos", F.col("start") + F.col("o"))
    found = (need.join(hits.select("_row", "pos", "gram"), ["_row", "pos", "gram"])
             .groupBy("_row", "win", "len", "start").agg(F.count(F.lit(1)).alias("have")))
    parts = F.ceil(F.greatest(F.col("len") - SHINGLE, F.lit(0)) / SHINGLE) + 1
    occurs = cut_lineage(found.where(F.col("have") == parts).select("_row", "win", "start", "len"))

    zero = F.struct(F.lit(0).alias("n"), F.lit(0).alias("end"))
    cover_words = F.aggregate(
        F.array_sort(F.collect_set(F.struct("start", (F.col("start") + F.col("len")).alias("end")))), zero,
        lambda acc, s: F.struct(
            (acc["n"] + F.greatest(s["end"] - F.greatest(s["start"], acc["end"]), F.lit(0))).alias("n"),
            F.greatest(s["end"], acc["end"]).alias("end")), lambda acc: acc["n"])
    hit_words = occurs.groupBy("_row").agg(cover_words.alias("n_hit"))
    items = (occurs.select("_row", "win").distinct().join(members, "win").groupBy("_row")
             .agg(F.array_sort(F.collect_set(F.col("item").cast("string"))).alias("items")))
    return (seen.where("first").join(hit_words, "_row", "left").join(items, "_row", "left")
            .select(F.col("_id").alias(id_col), "_text_hash", "_text_bytes", F.col("n_words").cast("long").alias("n_words"),
                    F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
                    F.coalesce("items", F.expr("cast(array() as array<string>)")).alias("items")))


def is_contaminated() -> Column:
    """At least one word in twenty lies inside an occurrence."""
    return (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", id_col: str = "doc_id",
                      small_rows: int = 1_000_000, **options) -> DataFrame:
    """``docs`` without contaminated rows; all columns as they were."""
    bad = cut_lineage(contamination(docs, benchmark, text_col, id_col, **options).where(is_contaminated())
                      .select(F.col(f"`{id_col}`").alias("_bad_id"), F.col("_text_hash").alias("_bad_hash"),
                              F.col("_text_bytes").alias("_bad_bytes")).distinct())
    h, n = text_key(F.col(f"`{text_col}`"))
    same = (F.col(f"`{id_col}`").eqNullSafe(F.col("_bad_id")) & (h == F.col("_bad_hash"))
            & (n == F.col("_bad_bytes")))
    return docs.join(broadcast_if_small(bad, small_rows), same, "left_anti")
