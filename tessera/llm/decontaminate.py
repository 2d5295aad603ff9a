"""Benchmark decontamination as a prefix-filtered set join on word shingles. DataFrame operations only.

Every item is cut into windows; a window is contained in a document if its
words stand there consecutively. At full containment the necessary prefix of a
window's shingles, ordered by rarity, is its rarest one, so:

1. Count how often the benchmark's shingles occur in all documents.
2. Index each window by its rarest shingle and that shingle's offset.
3. Join the documents' shingles with the index; a match gives one start.
   Positional bound: the start isn't negative. Length bound: the window ends
   within the document. Verification: the words themselves are compared.

While the index fits a broadcast, explode, join and verification are one
code-generated stage and no text is shuffled. Beyond that bound the shingles
are joined by a shuffle and the few candidates are verified beside their text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import free, maybe_broadcast, native_words, save, small

#: Windows up to which the index is broadcast (about 200 bytes each).
INDEX_ROWS = 200_000
#: Key of the row that stands for a document's end; a shingle with this hash is still told apart by its place.
END = 0


def item_windows(items: DataFrame, window: int) -> DataFrame:
    """(item_id, window_words) of items (item_id, text); an item of fewer words, but not none, is one window."""
    words = items.select("item_id", native_words(F.col("text")).alias("w")).filter(F.size("w") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("w") - window + 1, F.lit(1)))
    return words.select("item_id", "w", F.explode(starts).alias("s")).select("item_id", F.slice("w", F.col("s"), window).alias("window_words"))


def shingle_key(words: str, at: Column, width: int) -> Column:
    """Hash of the `width` words that begin at `at`."""
    return F.xxhash64(*[F.get(F.col(words), at + k) for k in range(width)])


def window_shingles(windows: DataFrame, shingle: int) -> DataFrame:
    """(window_id, window_words, off, width, key): each shingle of each window; windows shorter than a shingle are one."""
    width = F.least(F.lit(shingle), F.size("window_words"))
    rows = windows.select("window_id", "window_words", width.alias("width"), F.explode(F.sequence(F.lit(0), F.size("window_words") - width)).alias("off"))
    key = F.lit(None).cast("long")
    for k in range(1, shingle + 1):
        key = F.when(F.col("width") == k, shingle_key("window_words", F.col("off"), k)).otherwise(key)
    return rows.withColumn("key", key)


def positions(docs: DataFrame, widths: list[int]) -> DataFrame:
    """(doc_id, fp, words, n_words, pos, key): a row for each place and width, and one for each document's end, with the key END."""
    with_words = docs.select("doc_id", F.xxhash64("text").alias("fp"), native_words(F.col("text")).alias("words"))
    ended = F.concat("words", F.array(F.lit("")))
    rows = with_words.select("doc_id", "fp", "words", F.size("words").alias("n_words"), F.posexplode(ended).alias("pos", "word")).drop("word")
    at = F.col("pos")
    if len(widths) == 1:
        return rows.withColumn("key", F.when(at < F.col("n_words"), shingle_key("words", at, widths[0])).otherwise(F.lit(END)))
    keys = F.when(at < F.col("n_words"), F.array(*[shingle_key("words", at, k) for k in widths])).otherwise(F.array(F.lit(END)))
    return rows.withColumn("key", F.explode(keys))


def verified(start: Column) -> Column:
    """Positional and length bounds, then the words themselves."""
    length = F.size("window_words")
    fits = (start >= 0) & (start + length <= F.col("n_words"))
    return fits & (F.slice("words", F.greatest(start, F.lit(0)) + 1, length) == F.col("window_words"))


def occurrences(docs: DataFrame, windows: DataFrame, shingle: int, index_rows: int) -> DataFrame:
    """(doc_id, fp, n_words, start, length, window_id): one row for each occurrence, and one with null start for each document. windows: (window_id, window_words)."""
    spread = save(window_shingles(windows, shingle), "shingles")
    widths = [r[0] for r in spread.select("width").distinct().sort("width").collect()] or [shingle]
    fits = small(windows, index_rows)
    sought = maybe_broadcast(spread.select("key").distinct(), 5 * index_rows)  # a number a row
    plain = positions(docs, widths)
    rarity = plain.filter("pos < n_words").select("key").join(sought, "key").groupBy("key").agg(F.count("*").alias("n"))
    ranked = spread.join(save(rarity, "rarity"), "key")  # a window with a shingle that occurs nowhere occurs nowhere
    whole = ranked.groupBy("window_id").agg(F.count("*").alias("found"), F.min(F.struct("n", "off", "key")).alias("rarest"), F.first("window_words").alias("window_words"), F.first("width").alias("width"))
    index = whole.filter(F.col("found") == F.size("window_words") - F.col("width") + 1)
    index = save(index.select("window_id", "window_words", F.col("rarest.off").alias("off"), F.col("rarest.key").alias("key")), "index")
    start = F.col("pos") - F.col("off")
    end = F.col("pos") == F.col("n_words")
    if fits:
        # the marker row joins each document's end, so every document leaves one row
        marked = index.unionByName(index.sparkSession.createDataFrame([(None, None, None, END)], index.schema)).withColumnRenamed("key", "sought")
        cond = (F.col("key") == F.col("sought")) & F.when(F.col("window_id").isNull(), end).otherwise(~end & verified(start))
        out = plain.join(F.broadcast(marked), cond)
        return out.select("doc_id", "fp", "n_words", start.alias("start"), F.size("window_words").alias("length"), "window_id")
    ends = plain.filter(end).select("doc_id", "fp", "n_words", F.lit(None).cast("int").alias("start"), F.lit(None).cast("int").alias("length"), F.lit(None).cast("long").alias("window_id"))
    near = plain.filter(~end).select("doc_id", "fp", "n_words", "pos", "key").join(index, "key").filter((start >= 0) & (start + F.size("window_words") <= F.col("n_words")))
    near = near.select("doc_id", "fp", start.alias("start"), "window_id").distinct()
    texts = docs.select("doc_id", F.xxhash64("text").alias("fp"), native_words(F.col("text")).alias("words")).withColumn("n_words", F.size("words")).dropDuplicates(["doc_id", "fp"]).withColumnsRenamed({"doc_id": "t_doc", "fp": "t_fp"})
    same = F.col("doc_id").eqNullSafe(F.col("t_doc")) & (F.col("fp") == F.col("t_fp"))
    sure = near.join(index.select("window_id", "window_words"), "window_id").join(texts, same).filter(verified(F.col("start")))
    return ends.unionByName(sure.select("doc_id", "fp", "n_words", "start", F.size("window_words").alias("length"), "window_id"))


def contamination(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text", window: int = 13, shingle: int = 3, share: int = 20, index_rows: int = INDEX_ROWS) -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items_sha256, contaminated) for each row of docs.

    Words are runs of letters, digits and non-ASCII characters, A-Z
    lower-cased. A document word inside any occurrence of a window is hit; a
    document is contaminated if it has hit words and share * n_hit >= n_words.
    Null and empty texts have no words; null item ids count for hits and not as
    items. Repeated rows each give their row, and repeated items count once;
    overlapping windows hit a word once. Texts are whole, of any length. Extra columns are ignored; with no documents the result is empty, with no
    items nothing is hit.
    """
    return by_text(docs, items, id_col, text_col, item_id_col, item_text_col, window, shingle, share, index_rows).drop("fp")


def by_text(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text", window: int = 13, shingle: int = 3, share: int = 20, index_rows: int = INDEX_ROWS) -> DataFrame:
    """contamination() with fp, the hash of the text, as rows of one id can have several."""
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    items = items.select(F.col(item_id_col).cast("string").alias("item_id"), F.col(item_text_col).alias("text"))
    cut = save(item_windows(items, window).distinct(), "windows")
    windows = save(cut.select("window_words").distinct().withColumn("window_id", F.monotonically_increasing_id()), "distinct")
    found = save(occurrences(docs, windows, shingle, index_rows), "occurrences")

    ends = found.filter("window_id is null").select("doc_id", "fp", "n_words")
    hits = found.filter("window_id is not null")
    # words covered: each span adds what no earlier span has reached
    before = Window.partitionBy("doc_id", "fp").orderBy("start", "length").rowsBetween(Window.unboundedPreceding, -1)
    spans = hits.select("doc_id", "fp", "start", "length").distinct().withColumn("end", F.col("start") + F.col("length"))
    reach = F.greatest("start", F.coalesce(F.max("end").over(before), F.lit(0)))
    covered = spans.select("doc_id", "fp", F.greatest(F.col("end") - reach, F.lit(0)).alias("new")).groupBy("doc_id", "fp").agg(F.sum("new").alias("n_hit"))
    named = cut.join(windows, "window_words").filter("item_id is not null").select("window_id", "item_id")
    of = hits.select("doc_id", "fp", "window_id").distinct().join(F.broadcast(named) if small(named, index_rows) else named, "window_id").select("doc_id", "fp", "item_id").distinct()
    listed = of.groupBy("doc_id", "fp").agg(F.sort_array(F.collect_list("item_id")).alias("items"))
    per_doc = covered.join(listed, (covered.doc_id.eqNullSafe(listed.doc_id)) & covered.fp.eqNullSafe(listed.fp), "left").select(covered.doc_id.alias("h_doc"), covered.fp.alias("h_fp"), "n_hit", "items")
    out = ends.join(per_doc, ends.doc_id.eqNullSafe(F.col("h_doc")) & ends.fp.eqNullSafe(F.col("h_fp")), "left")
    items_ = F.coalesce("items", F.array().cast("array<string>"))
    n_hit = F.coalesce("n_hit", F.lit(0)).cast("long")
    return out.select(
        "doc_id",
        ends.fp.alias("fp"),
        F.col("n_words").cast("long").alias("n_words"),
        n_hit.alias("n_hit"),
        F.size(items_).cast("long").alias("n_items"),
        F.sha2(F.array_join(items_, ","), 256).alias("items_sha256"),
        ((n_hit > 0) & (share * n_hit >= F.col("n_words"))).alias("contaminated"),
    )


def drop_contaminated(docs: DataFrame, items: DataFrame, **settings) -> DataFrame:
    """docs with all its columns, without the contaminated documents; those with a null id are told by their text, as are those that share an id."""
    key, mark = free(docs, "_bad", "_bad_text")
    bad = by_text(docs, items, **settings).filter("contaminated").select(F.col("doc_id").alias(key), F.col("fp").alias(mark))
    bad = save(bad.distinct(), "contaminated")
    same = F.col("doc_id").eqNullSafe(F.col(key)) & (F.xxhash64("text") == F.col(mark))
    return docs.join(F.broadcast(bad) if small(bad) else bad, same, "left_anti")
