"""Interpolated modified Kneser-Ney bigrams over the tokens of a public vocabulary, counted in all trusted text.

A text is the ids of its tokens. A word that repeats the one before it is one
token of its own, and only what follows can be it, so a run of repetitions is
as unlikely throughout as it is at its beginning.

Tasks combine counts before they are shuffled, and the tables come from joins of
counts, continuation counts and counts of counts, sharded by context. They grow
with the trusted text. A table that has been checked to be small goes to the
workers, so scoring shuffles nothing; beyond that bound the documents' bigrams,
combined by text, are joined with its shards, and each text's logarithms are
summed. Logarithms are kept as whole numbers of 1 / SCALE, so sums don't depend
on their order, and both give the same to the last bit.

Trusted texts are in two halves by a hash of the text (so copies stay together),
and each text, trusted or not, is scored by the model of the other half: counts
and limits cover all trusted texts, and none is scored with its own counts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import chunks, release, save, ship, small
from .encoder import Encoder, spans
from .tokencount import Compiled, shared

#: Logarithms are multiples of 1 / SCALE. Squares of a text of up to 5 million tokens can be summed as whole numbers.
SCALE = 1 << 16
#: Rows up to which the table of bigrams is sent to the workers (12 bytes a row).
TABLE_ROWS = 6_000_000
#: Characters that a worker handles at once.
BATCH = 500_000
#: Bits of a token's number in a key.
BITS = 20
SUMS = T.StructType([T.StructField(k, T.LongType()) for k in ("tokens", "lost", "squares")])


def half(text: Column) -> Column:
    """0 or 1: which half of the texts a text is in."""
    return F.pmod(F.xxhash64(F.coalesce(text, F.lit(""))), F.lit(2)).cast("int")


class Vocabulary:
    """Numbers of tokens: those of the file, then what precedes a text, and a repetition."""

    def __init__(self, compiled: Compiled):
        self.compiled = compiled
        self.start = 1 + compiled.last
        self.repeat = self.start + 1
        #: How many can follow: all but the start.
        self.size = self.start + 1


def bigrams(encoder: Encoder, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of all tokens of texts end to end: the text's place, the token before, and the token. Texts of white space only have none."""
    s = encoder.segments([t if t.strip() else "" for t in texts])
    n = len(s.slot)
    if not n:
        return tuple(np.empty((3, 0), np.int64))
    start = 1 + encoder.last
    same = s.text[1:] == s.text[:-1]
    again = np.zeros(n, bool)
    again[1:] = same & (s.slot[1:] == s.slot[:-1])
    whole, begin = s.size[s.slot], s.begin[s.slot]
    size = np.where(again, 1, whole)
    first = np.cumsum(size) - size
    token = s.flat[spans(begin, size)].astype(np.int64)
    before = np.empty_like(token)
    before[1:] = token[:-1]
    before[first[0]] = start
    before[first[1:]] = np.where(same, s.flat[(begin + whole - 1)[:-1]], start)
    token[first[again]] = start + 1
    return np.repeat(s.text, size), before, token


def counts(texts: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """(f, b, c, n): how often c follows b in the texts (f, text) of each half."""

    ship(texts.sparkSession)
    sent = shared(texts.sparkSession, vocabulary.compiled)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder, held, rows = Encoder(sent.value), [], 0

        def out() -> pd.DataFrame:
            keys, at = np.unique(np.concatenate([k for k, _ in held]), return_inverse=True)
            n = np.bincount(at, np.concatenate([n for _, n in held])).astype(np.int64)
            held.clear()
            low = (1 << BITS) - 1
            return pd.DataFrame({"f": (keys >> 2 * BITS).astype(np.int32), "b": (keys >> BITS & low).astype(np.int32), "c": (keys & low).astype(np.int32), "n": n})

        for batch in batches:
            f = batch["f"].to_numpy(np.int64)
            for at, part in chunks(batch["text"], BATCH):
                text, b, c = bigrams(encoder, part)
                held.append(np.unique((f[at + text] << 2 * BITS) | (b << BITS) | c, return_counts=True))
                rows += len(held[-1][0])
                if rows > 1_000_000:
                    yield out()
                    rows = 0
            part = text = b = c = None
            release()
        if held:
            yield out()
        batch = encoder = None
        release()

    return texts.select("f", "text").mapInPandas(run, "f int, b int, c int, n long").groupBy("f", "b", "c").agg(F.sum("n").alias("n"))


def discounts(table: DataFrame, n: str) -> DataFrame:
    """(f, d1, d2, d3): modified Kneser-Ney discounts of counts of one, two, and three or more, from the counts of counts of each half."""
    rows = []
    for r in table.groupBy("f").agg(*[F.count(F.when(F.col(n) == k, 1)).alias(f"n{k}") for k in (1, 2, 3, 4)]).collect():  # two rows
        y = r.n1 / (r.n1 + 2 * r.n2) if r.n1 else 0.5
        each = [k - (k + 1) * y * r[f"n{k + 1}"] / r[f"n{k}"] if r[f"n{k}"] else k / 2 for k in (1, 2, 3)]
        rows.append((r.f, *(float(min(max(d, 0.05), k - 0.05)) for d, k in zip(each, (1, 2, 3), strict=True))))
    return table.sparkSession.createDataFrame(rows, "f int, d1 double, d2 double, d3 double")


def smoothed(table: DataFrame, context: list[str], n: str) -> tuple[DataFrame, DataFrame]:
    """table with `own`, the discounted share of n in its context; and the context's `back`, the weight of the lower order. A join sharded by context."""
    off = F.when(F.col(n) == 1, F.col("d1")).when(F.col(n) == 2, F.col("d2")).otherwise(F.col("d3"))
    cut = table.join(F.broadcast(discounts(table, n)), "f").withColumn("off", off)  # two rows
    totals = cut.groupBy(*context).agg(F.sum(n).alias("total"), F.sum("off").alias("taken"))
    own = cut.join(totals, context).select(*table.columns, ((F.col(n) - F.col("off")) / F.col("total")).alias("own"))
    return own, totals.select(*context, (F.col("taken") / F.col("total")).alias("back"))


def whole(p: Column) -> Column:
    """Logarithm of a probability or weight, in whole numbers of 1 / SCALE."""
    return F.round(F.log(p) * SCALE).cast("int")


class Model:
    """The tables of both halves' models, of logarithms: `seen` (f, b, c, p) has the probabilities of bigrams that occur, `back` (f, b, w) the weights of contexts, `base` (f, c, p1) the lower order, `unknown` (f, p0) that of tokens that don't occur."""

    def __init__(self, pairs: DataFrame, size: int):
        """pairs: (f, b, c, n) from the shared folder; size: how many tokens can follow."""
        single = save(pairs.groupBy("f", "c").agg(F.count("*").alias("n")), "single")  # contexts that a token continues
        own1, back1 = smoothed(single, ["f"], "n")
        unknown = save(back1.select("f", (F.col("back") / size).alias("p0")), "unknown")
        base = save(own1.join(unknown, "f").select("f", "c", (F.col("own") + F.col("p0")).alias("p1")), "base")
        own2, back2 = smoothed(pairs, ["f", "b"], "n")
        back = save(back2.select("f", "b", F.col("back").alias("w")), "back")
        seen = own2.join(back, ["f", "b"]).join(base, ["f", "c"])
        self.seen = save(seen.select("f", "b", "c", whole(F.col("own") + F.col("w") * F.col("p1")).alias("p")), "seen")
        self.back, self.base, self.unknown = back.select("f", "b", whole(F.col("w")).alias("w")), base.select("f", "c", whole(F.col("p1")).alias("p1")), unknown.select("f", whole(F.col("p0")).alias("p0"))
        self.sent = None

    def probability(self, rows: DataFrame) -> DataFrame:
        """rows (f, b, c and others) with `p`, the logarithm of the interpolated probability of c after b in the model of f; null if there is none. Joins sharded by context."""
        rows = rows.join(self.seen, ["f", "b", "c"], "left").join(self.back, ["f", "b"], "left").join(self.base, ["f", "c"], "left").join(F.broadcast(self.unknown), "f", "left")
        lower = F.coalesce("w", F.lit(0)) + F.coalesce("p1", "p0")
        return rows.withColumn("p", F.coalesce("p", lower)).drop("w", "p1", "p0")

    def table(self, vocabulary: Vocabulary):
        """The tables as arrays, sent to the workers once."""
        if self.sent is None:
            self.sent = self.seen.sparkSession.sparkContext.broadcast(Tables(self, vocabulary))
        return self.sent


class Tables:
    """A model of few enough rows, as arrays: sorted keys of each half and logarithms. NONE where a half has no model."""

    NONE = np.iinfo(np.int64).max // 4

    def __init__(self, model: Model, vocabulary: Vocabulary):
        top = vocabulary.repeat + 1
        seen = model.seen.select(F.shiftleft(F.col("f").cast("long"), 2 * BITS).bitwiseOR(F.shiftleft(F.col("b").cast("long"), BITS)).bitwiseOR(F.col("c").cast("long")).alias("key"), "p").toArrow()
        key = seen.column("key").to_numpy()
        order = np.argsort(key)
        self.key, self.p = key[order], seen.column("p").to_numpy()[order]
        self.weight, self.base = np.zeros((2, top), np.int64), np.full((2, top), self.NONE)  # at most a row for each token
        for r in model.unknown.collect():
            self.base[r.f] = r.p0
        back, base = model.back.toArrow().to_pandas(), model.base.toArrow().to_pandas()
        self.weight[back["f"], back["b"]] = back["w"]
        self.base[base["f"], base["c"]] = base["p1"]

    def logarithms(self, f: np.ndarray, b: np.ndarray, c: np.ndarray) -> np.ndarray:
        out = self.weight[f, b] + self.base[f, c]
        if len(self.key):
            key = (f << 2 * BITS) | (b << BITS) | c
            at = np.minimum(np.searchsorted(self.key, key), len(self.key) - 1)
            out = np.where(self.key[at] == key, self.p[at], out)
        return out


def summed(text: np.ndarray, values: np.ndarray, texts: int) -> np.ndarray:
    """Sums of whole numbers by text; text rises."""
    total = np.concatenate(([0], np.cumsum(values)))
    ends = np.searchsorted(text, np.arange(texts + 1))
    return total[ends[1:]] - total[ends[:-1]]


def fit(texts: DataFrame, vocabulary: Vocabulary) -> Model:
    """Models of trusted texts (column text): that of a half has the counts of the other one."""
    pairs = counts(texts.select((1 - half(F.col("text"))).alias("f"), "text"), vocabulary)
    return Model(save(pairs, "pairs"), vocabulary.size)


def scores(docs: DataFrame, model: Model, vocabulary: Vocabulary, text_col: str, out: str, table_rows: int = TABLE_ROWS) -> DataFrame:
    """docs with a struct column `out` (tokens, mean, variance): of the negative logarithms of a text's tokens. No mean without tokens, or where its half has no model."""
    ship(docs.sparkSession)
    if not small(model.seen, table_rows):
        return joined_scores(docs, model, vocabulary, text_col, out)
    sent, compiled = model.table(vocabulary), shared(docs.sparkSession, vocabulary.compiled)

    @F.pandas_udf(SUMS)
    def score(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        tables = sent.value
        encoder = Encoder(compiled.value)
        for texts, halves in batches:
            f, parts = halves.to_numpy(np.int64), [pd.DataFrame({k: np.empty(0, np.int64) for k in ("tokens", "lost", "squares")})]
            for at, part in chunks(texts, BATCH):
                text, b, c = bigrams(encoder, part)
                p = tables.logarithms(f[at + text], b, c)
                n = np.bincount(text, minlength=len(part))
                known = tables.base[f[at : at + len(part)], 0] < tables.NONE  # whether the half has a model
                p = np.where(known[text], p, 0)
                parts.append(pd.DataFrame({"tokens": n, "lost": pd.array(np.where(known, -summed(text, p, len(part)), -1), "Int64"), "squares": summed(text, p * p, len(part))}))
            out = pd.concat(parts[1:] or parts, ignore_index=True)
            out["lost"] = out["lost"].mask(out["lost"] < 0)
            texts = part = parts = text = b = c = p = None
            release()
            yield out
        encoder = None
        release()

    found = score.asNondeterministic()(F.coalesce(F.col(text_col), F.lit("")), half(F.col(text_col)))
    return docs.withColumn(out, found).withColumn(out, moments(F.col(f"{out}.tokens"), F.col(f"{out}.lost"), F.col(f"{out}.squares")))


def moments(tokens: Column, lost: Column, squares: Column) -> Column:
    """(tokens, mean, variance) from sums of whole numbers; no mean without tokens or without sums."""
    n = F.when(tokens > 0, tokens)
    mean = lost / n / SCALE
    return F.struct(tokens.alias("tokens"), mean.alias("mean"), F.when(mean.isNotNull(), F.greatest(squares / n / SCALE / SCALE - mean * mean, F.lit(0.0))).alias("variance"))


def joined_scores(docs: DataFrame, model: Model, vocabulary: Vocabulary, text_col: str, out: str) -> DataFrame:
    """scores() by joins: each distinct text's bigrams with the model's shards, and the sums with the docs."""
    sent = shared(docs.sparkSession, vocabulary.compiled)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = Encoder(sent.value)
        for batch in batches:
            t, f = (batch[k].to_numpy(np.int64) for k in ("t", "f"))
            for at, part in chunks(batch["text"], BATCH):
                text, b, c = bigrams(encoder, part)
                place, n = np.unique((text << 2 * BITS) | (b << BITS) | c, return_counts=True)
                text = at + (place >> 2 * BITS)
                yield pd.DataFrame({"t": t[text], "f": f[text], "b": place >> BITS & (1 << BITS) - 1, "c": place & (1 << BITS) - 1, "n": n})

    key = F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))
    texts = docs.select(key.alias("t"), half(F.col(text_col)).alias("f"), F.col(text_col).alias("text"))
    rows = model.probability(texts.mapInPandas(run, "t long, f int, b int, c int, n long"))
    copies = F.sum(F.when(F.col("b") == vocabulary.start, F.col("n")))  # each copy has one start
    total, p = F.sum("n"), F.col("p").cast("long")
    known = F.count("p") > 0
    sums = [F.when(known, -F.sum(F.col("n") * p)), F.when(known, F.sum(F.col("n") * p * p))]
    per = rows.groupBy("t").agg((total / copies).cast("long").alias("tokens"), copies.alias("copies"), sums[0].alias("lost"), sums[1].alias("squares"))
    # each copy of a text adds the same
    per = per.select("t", moments(F.col("tokens"), F.expr("lost div copies"), F.expr("squares div copies")).alias("s"))
    per = save(per, "scores").withColumnsRenamed({"t": f"{out}_t", "s": f"{out}_s"})
    none = F.struct(F.lit(0).cast("long").alias("tokens"), F.lit(None).cast("double").alias("mean"), F.lit(None).cast("double").alias("variance"))
    return docs.join(per, key == F.col(f"{out}_t"), "left").withColumn(out, F.coalesce(F.col(f"{out}_s"), none)).drop(f"{out}_t", f"{out}_s")
