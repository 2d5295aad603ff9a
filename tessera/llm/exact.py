"""Canonical exact digests: documents that are equal after folding share a fingerprint. DataFrame operations only.

Canonical form: NFKC, full case folding, NFKC again (ICU, which Spark ships and
`reflect` calls inside the JVM), runs of white space to one space, trimmed.
Fingerprint: two differently seeded xxhash64 of the canonical form, made once
for each text and written with the other narrow columns. The forms of texts
whose digest is not alone are made again and grouped by their bytes; where a
bucket holds different bytes, the fingerprints of its members get the SHA-256 of
their bytes appended, so equal fingerprints mean equal bytes.

Next documents: ids are cut into ranges by quantiles (a bounded list of
numbers); each range is one sort, and the topmost document of a range is also
dealt to the range above, whose lowest document it follows. The texts are
shuffled once; after that only those of shared buckets are, by id and hash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import maybe_broadcast, save

#: Ranges of ids for each shuffle partition: evens out what hashing deals to a partition.
RANGES = 4
#: Stands for a null id where texts are looked up by id.
NO_ID = -(1 << 63)


def icu(cls: str, method: str, text: Column) -> Column:
    return F.reflect(F.lit(cls), F.lit(method), text, F.lit(True))


def canonical(text: Column) -> Column:
    """NFKC, case-folded, white space folded; null counts as empty."""
    composed = icu("com.ibm.icu.text.Normalizer", "compose", F.coalesce(text, F.lit("")))
    folded = icu("com.ibm.icu.text.Normalizer", "compose", icu("com.ibm.icu.lang.UCharacter", "foldCase", composed))
    return F.trim(F.regexp_replace(folded, r"[\s\x{85}\p{Z}]+", " "))


def digest(canon: Column) -> Column:
    """128 bits."""
    return F.struct(F.xxhash64(F.lit(1), canon).alias("h"), F.xxhash64(F.lit(2), canon).alias("l"))


def ranges(docs: DataFrame, count: int) -> list[int]:
    """Largest id of each of at most `count` ranges that hold about as many rows each; read from the id column alone."""
    cuts = docs.select(F.percentile_approx("doc_id", [i / count for i in range(1, count)] or [0.5], 20 * count).alias("c")).first().c or []
    bound = F.array(*[F.lit(int(c)).cast("long") for c in sorted(set(cuts))]) if cuts else F.array().cast("array<long>")
    tops = docs.filter("doc_id is not null").groupBy(F.size(F.filter(bound, lambda b: b < F.col("doc_id"))).alias("k")).agg(F.max("doc_id").alias("top"))
    return sorted(r.top for r in tops.collect())


def in_order(docs: DataFrame, count: int, mark) -> DataFrame:
    """docs (doc_id, text) with mark (of the text), and next_doc_id, next_text, next_mark: those of the next document by descending doc_id, after the last the first.

    Rows of one id are ordered by text; null ids stand last.
    """
    tops = ranges(docs.select("doc_id"), count)
    names = docs.columns
    bound = F.array(*[F.lit(t).cast("long") for t in tops]) if tops else F.array().cast("array<long>")
    step = max(1, int(len(tops) ** 0.5))
    coarse = F.array(*[F.lit(t).cast("long") for t in tops[step - 1 :: step]]) if tops else bound
    low = F.size(F.filter(coarse, lambda b: b < F.col("doc_id"))) * step
    mine = F.when(F.col("doc_id").isNull(), F.lit(0)).otherwise(low + F.size(F.filter(F.slice(bound, low + 1, step), lambda b: b < F.col("doc_id"))))
    row = docs.withColumn("rng", mine)
    last = len(tops) - 1
    is_top = F.col("doc_id") == F.get(bound, F.col("rng"))
    seats = F.array(F.struct(F.col("rng").alias("at"), F.lit(0).alias("guest")))
    if tops:
        above = F.struct((F.col("rng") + 1).alias("at"), F.lit(1).alias("guest"))
        around = F.struct(F.lit(0).alias("at"), F.lit(2).alias("guest"))
        seats = F.when(is_top & (F.col("rng") < last), F.concat(seats, F.array(above))).when(is_top, F.concat(seats, F.array(around))).otherwise(seats)
    else:  # only null ids, or no rows
        seats = F.concat(seats, F.array(F.struct(F.lit(0).alias("at"), F.lit(2).alias("guest"))))
    dealt = row.withColumn("seat", F.explode(seats)).select(*names, F.col("seat.at").alias("rng"), F.col("seat.guest").alias("guest"))
    # only ids and texts are dealt, by every use of this table: so there is one exchange, and nothing is shuffled twice
    marked = dealt.repartition("rng").withColumn("mark", mark(F.col("text")))
    order = Window.partitionBy("rng").orderBy((F.col("guest") == 2).asc(), F.col("doc_id").desc_nulls_last(), F.col("text").desc_nulls_last())
    led = marked.withColumns({f"next_{c}": F.lead(c).over(order) for c in ("doc_id", "text", "mark")})
    return led.filter("guest = 0").drop("guest", "rng")


def edited(text: Column, next_text: Column) -> Column:
    """A text whose last third is the next document's beginning."""
    n = F.length(text)
    third = F.floor(n / 3).cast("int")
    return F.concat(F.substring(text, F.lit(1), n - third), F.substring(next_text, F.lit(1), third))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", count: int | None = None, digest_of=digest) -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) for each row of docs.

    Likeness of fingerprints of an exact digest is 1.0 if they are equal, else 0.0.
    Null texts count as empty; a lone document is its own next; rows of one id
    follow each other by text, null ids come last; repeated rows each give
    their row. Texts are whole, of any length. Extra columns are ignored; an
    empty table gives an empty result.
    digest_of: the bucket's hash of a canonical form (tests pass a poor one).
    """
    spark = docs.sparkSession
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    count = count or RANGES * int(spark.conf.get("spark.sql.shuffle.partitions"))
    ident = lambda doc_id: F.coalesce(doc_id, F.lit(NO_ID))
    sure = lambda canon: F.struct(digest_of(canon).alias("d"), F.unhex(F.sha2(canon, 256)).alias("s"))
    led = in_order(docs, count, lambda text: sure(canonical(text)))
    other = edited(F.col("text"), F.col("next_text"))
    rows = led.select(
        "doc_id", F.length("text").cast("long").alias("n_chars"), F.sha2(other, 256).alias("edited_sha256"), "mark", "next_mark", sure(canonical(other)).alias("edited_mark"),
        ident(F.col("doc_id")).alias("id"), F.xxhash64("text").alias("hash"), ident(F.col("next_doc_id")).alias("next_id"), F.xxhash64("next_text").alias("next_hash"),
    )
    rows = save(rows, "marks")  # no text

    # buckets with more than one holder, and the texts that make up the forms in them
    forms_of = F.array(F.struct(F.lit(False).alias("e"), F.col("mark.d").alias("d")), F.struct(F.lit(True).alias("e"), F.col("edited_mark.d").alias("d")))
    key, after = ["id", "hash"], ["next_id", "next_hash"]
    held = rows.select(*key, *after, F.explode(forms_of).alias("h")).select(*key, *after, "h.e", "h.d")
    full = held.groupBy("d").agg(F.count("*").alias("n")).filter("n > 1").select("d")
    holders = save(held.join(full, "d", "left_semi"), "holders")
    made = holders.filter("e").select(*key, *after).distinct()
    sought = holders.select(*key).unionByName(made.select(*[F.col(a).alias(k) for a, k in zip(after, key, strict=True)])).distinct()
    texts = docs.select(ident(F.col("doc_id")).alias("id"), F.xxhash64("text").alias("hash"), "text").join(maybe_broadcast(sought), key).dropDuplicates(key)
    then = texts.select(F.col("id").alias("next_id"), F.col("hash").alias("next_hash"), F.col("text").alias("next_text"))
    composed = made.join(texts, key).join(then, after).select(edited(F.col("text"), F.col("next_text")).alias("text"))
    # their bytes, each different form once: a bucket is mixed if it has more than one
    forms = texts.select("text").unionByName(composed).select(canonical(F.col("text")).alias("canon")).groupBy("canon").agg(F.lit(1).alias("one")).select(digest_of(F.col("canon")).alias("d"))
    mixed = forms.groupBy("d").agg(F.count("*").alias("n")).filter("n > 1").select("d", F.lit(True).alias("mixed"))
    mixed = save(mixed, "mixed")  # hardly ever a row

    name = lambda mark, mixed: F.concat(F.lower(F.lpad(F.hex(F.col(f"{mark}.d.h")), 16, "0")), F.lower(F.lpad(F.hex(F.col(f"{mark}.d.l")), 16, "0")), F.when(F.col(mixed), F.concat(F.lit("-"), F.lower(F.hex(F.col(f"{mark}.s"))))).otherwise(F.lit("")))
    own = maybe_broadcast(mixed.select(F.col("d").alias("own_d"), F.col("mixed").alias("own_mixed")))
    other = maybe_broadcast(mixed.select(F.col("d").alias("other_d"), F.col("mixed").alias("other_mixed")))
    out = rows.join(own, F.col("mark.d") == F.col("own_d"), "left").join(other, F.col("edited_mark.d") == F.col("other_d"), "left")
    return out.select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        name("mark", "own_mixed").alias("fingerprint"),
        name("edited_mark", "other_mixed").alias("edited_fingerprint"),
        (F.col("mark") == F.col("edited_mark")).cast("double").alias("near_edited"),
        (F.col("mark") == F.col("next_mark")).cast("double").alias("near_next"),
    )
