"""Language identification by a linear-chain conditional random field over words.

A word's features are its prefixes and suffixes, its character n-grams with
word boundaries, and whether it is in a language's lexicon (the words that the
training sample has most often in that language); transitions between labels
are learned. Training sequences include joined pieces of different languages,
so switches within a text are learned too. Words are labelled by
forward-backward marginals; a text's language is the label with most letters.

Inference is exact over whole texts of any length: a text is cut into blocks
of steps, the blocks' transfer matrices are multiplied side by side, a short
scan over blocks gives each block its entry and exit messages, and the
messages run through all blocks at once.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import chunks, free, ship

#: Runs of letters (and letter-like numerals); digits and signs are not words.
WORD = re.compile(r"[^\W\d_]+")
#: Languages learned at most.
LANGUAGES = 200
#: Label of texts without a letter.
NONE = "und"
#: Steps of a block, words that a worker remembers, buckets that features are hashed to.
BLOCK, CACHE, BUCKETS = 32, 100_000, 1 << 17
#: Characters that a worker handles at once: a new word has some fifty features.
BATCH = 300_000


def spread(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return (x ^ (x >> np.uint64(29))) % np.uint64(BUCKETS)


def features(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed features of non-empty words end to end, and where each word's begin.

    Character 1-, 2- and 3-grams with boundary marks (those at a mark are
    affixes), 4-character prefix and suffix, and the whole word.
    """
    n = len(words)
    size = np.fromiter(map(len, words), np.int64, n) + 2
    text = "".join([f"\x02{w}\x03" for w in words])
    code = np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.uint64)
    word = np.repeat(np.arange(n), size)
    hashes, owners = [], []
    gram = np.zeros(len(code), np.uint64)
    for k in range(1, 6):
        if len(code) < k:
            break
        gram = gram[: len(code) - k + 1] * np.uint64(1_000_003) + code[k - 1 :]
        first = word[: len(gram)]
        inside = first == word[k - 1 :]
        if k >= 4:  # only at the marks
            begin = np.zeros(len(gram), bool)
            begin[1:] = first[1:] != first[:-1]
            begin[:1] = True
            end = np.zeros(len(gram), bool)
            last = np.arange(len(gram)) + k
            end[:] = (last == len(code)) | (word[np.minimum(last, len(code) - 1)] != first)
            inside &= begin | end
        hashes.append(gram[inside] + np.uint64(k << 40))
        owners.append(first[inside])
    whole = np.add.reduceat(code * spread(np.arange(len(code)).astype(np.uint64) - np.repeat(np.cumsum(size) - size, size).astype(np.uint64) + np.uint64(77)), np.cumsum(size) - size) if n else np.empty(0, np.uint64)
    hashes.append(whole + np.uint64(9 << 40))
    owners.append(np.arange(n))
    owner, value = np.concatenate(owners), spread(np.concatenate(hashes)).astype(np.int64)
    order = np.argsort(owner, kind="stable")
    return value[order], np.searchsorted(owner[order], np.arange(n))


class Model:
    """Weights by hashed feature and label, lexicons, and transition scores."""

    def __init__(self, labels: list[str], lexicon: dict[str, set[int]]):
        n = len(labels)
        self.labels = labels
        self.lexicon = {w: i + 1 for i, w in enumerate(lexicon)}
        self.member = np.zeros((len(lexicon) + 1, n), np.float32)
        for w, i in self.lexicon.items():
            self.member[i, [*lexicon[w]]] = 1
        self.weight = np.zeros((BUCKETS, n), np.float32)
        self.listed = np.zeros((n, n), np.float32)
        self.trans = np.zeros((n, n), np.float64)

    def lists(self, words: list[str]) -> np.ndarray:
        """A 0/1 row for each word: the languages whose lexicon has it."""
        return self.member[np.fromiter(map(self.lexicon.get, words, repeat(0)), np.int64, len(words))]

    def emissions(self, words: list[str]) -> np.ndarray:
        """Score of each label for each word."""
        if not words:
            return np.zeros((0, len(self.labels)), np.float32)
        value, begin = features(words)
        return np.add.reduceat(self.weight[value], begin, axis=0) + self.lists(words) @ self.listed


def marginals(emission: np.ndarray, trans: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Probability of each label at each step; count: steps of each sequence, whose emissions stand end to end."""
    forward, backward = messages(emission, trans, count)
    out = forward * backward
    return out / out.sum(axis=1, keepdims=True)


def messages(emission: np.ndarray, trans: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Forward and backward messages at each step, each up to a factor. A sequence's first step has no transition: all labels are as likely before it."""
    n, labels = emission.shape
    if not n:
        return np.zeros((0, labels)), np.zeros((0, labels))
    per = -(-count // BLOCK)
    blocks = int(per.sum())
    first_block = np.cumsum(per) - per
    seq = np.repeat(np.arange(len(count)), count)
    step = np.arange(n) - np.repeat(np.cumsum(count) - count, count)
    place = (first_block[seq] + step // BLOCK) * BLOCK + step % BLOCK
    e = np.ones((blocks * BLOCK, labels), np.float32)
    e[place] = np.exp(np.maximum(emission - emission.max(axis=1, keepdims=True), -60))
    real = np.zeros(blocks * BLOCK, bool)
    real[place] = True
    e = np.ascontiguousarray(e.reshape(blocks, BLOCK, labels).swapaxes(0, 1))
    real = np.ascontiguousarray(real.reshape(blocks, BLOCK).T)
    whole = real.all(axis=1)
    t = np.exp(trans - trans.max()).astype(np.float32)

    product = np.broadcast_to(np.eye(labels, dtype=np.float32), (blocks, labels, labels)).copy()
    for k in range(BLOCK):
        moved = (product.reshape(-1, labels) @ t).reshape(blocks, labels, labels)
        if not k:
            moved[first_block] = product[first_block]
        moved *= e[k][:, None, :]
        moved /= moved.max(axis=(1, 2), keepdims=True)
        product = moved if whole[k] else np.where(real[k][:, None, None], moved, product)

    enter = np.full((blocks, labels), 1 / labels, np.float32)
    leave = np.full((blocks, labels), 1.0, np.float32)
    by_size = np.argsort(-per, kind="stable")
    longest = int(per.max())
    alive = len(count) - np.searchsorted(np.sort(per), np.arange(1, longest + 1), "left")  # sequences with more than k blocks
    for k in range(1, longest):
        b = first_block[by_size[: alive[k]]] + k
        x = np.einsum("bi,bij->bj", enter[b - 1], product[b - 1])
        enter[b] = x / x.sum(axis=1, keepdims=True)
    for k in range(longest - 1, 0, -1):
        b = first_block[by_size[: alive[k]]] + k
        x = np.einsum("bij,bj->bi", product[b], leave[b])
        leave[b - 1] = x / x.max(axis=1, keepdims=True)

    alpha = np.empty((BLOCK, blocks, labels), np.float32)
    a = enter
    for k in range(BLOCK):
        x = a @ t
        if not k:
            x[first_block] = a[first_block]
        x *= e[k]
        x /= x.sum(axis=1, keepdims=True)
        a = x if whole[k] else np.where(real[k][:, None], x, a)
        alpha[k] = a
    beta = np.empty((BLOCK, blocks, labels), np.float32)
    b_ = leave
    for k in range(BLOCK - 1, -1, -1):
        beta[k] = b_
        x = (e[k] * b_) @ t.T
        x /= x.max(axis=1, keepdims=True)
        b_ = x if whole[k] else np.where(real[k][:, None], x, b_)
    return tuple(x.swapaxes(0, 1).reshape(-1, labels)[place] for x in (alpha, beta))


def expected_pairs(forward: np.ndarray, backward: np.ndarray, emission: np.ndarray, trans: np.ndarray, inner: np.ndarray) -> np.ndarray:
    """Probabilities of the pairs of labels (of the step before, of the step) at the steps `inner`, which aren't first of their sequences, summed: exact, from the two messages."""
    right = np.exp(emission[inner] - emission[inner].max(axis=1, keepdims=True)) * backward[inner]
    joint = forward[inner - 1][:, :, None] * np.exp(trans - trans.max())[None] * right[:, None, :]
    return (joint / joint.sum(axis=(1, 2), keepdims=True)).sum(axis=0)


def fit(windows: list[tuple[str, list[str]]], lexicon_words: int = 400, rounds: int = 30, rate: float = 0.2, l2: float = 1e-6, seed: int = 5) -> Model:
    """A model of (language, words) windows, by gradient ascent on the conditional likelihood (AdaGrad, whole batches)."""
    labels = sorted({lang for lang, _ in windows})
    index = {lang: i for i, lang in enumerate(labels)}
    seen = {lang: Counter() for lang in labels}
    for lang, words in windows:
        seen[lang].update(words)
    lexicon: dict[str, set[int]] = {}
    for lang, c in seen.items():
        for w, _ in sorted(c.items(), key=lambda x: (-x[1], x[0]))[:lexicon_words]:
            lexicon.setdefault(w, set()).add(index[lang])
    model = Model(labels, lexicon)
    n = len(labels)
    if n < 2:
        return model
    rng = np.random.default_rng(seed)
    sequences = [(words, [index[lang]] * len(words)) for lang, words in windows]
    order = rng.permutation(len(sequences))
    for i, j in zip(order[::2], order[1::2], strict=False):  # code-switched: the first part of one, then of another
        (a, x), (b, y) = sequences[i], sequences[j]
        p, q = -(-len(a) // 2), -(-len(b) // 2)
        sequences.append((a[:p] + b[:q], x[:p] + y[:q]))
    types = sorted({w for words, _ in sequences for w in words})
    at = {w: i for i, w in enumerate(types)}
    flat = np.array([at[w] for words, _ in sequences for w in words])
    gold = np.array([g for _, gs in sequences for g in gs])
    count = np.array([len(words) for words, _ in sequences])
    value, begin = features(types)
    owner = np.repeat(np.arange(len(types)), np.diff(np.append(begin, len(value))))
    lists = model.lists(types)
    first = np.zeros(len(flat), bool)
    first[np.cumsum(count) - count] = True
    inner = np.flatnonzero(~first)
    one = np.eye(n)[gold]
    sums = [np.full(x.shape, 1e-6) for x in (model.weight, model.listed, model.trans)]
    pairs = np.zeros((n, n))
    np.add.at(pairs, (gold[inner - 1], gold[inner]), 1)
    for _ in range(rounds):
        emission = (np.add.reduceat(model.weight[value], begin, axis=0) + lists @ model.listed)[flat]
        forward, backward = messages(emission, model.trans, count)
        m = forward * backward
        m /= m.sum(axis=1, keepdims=True)
        slope = np.stack([np.bincount(flat, (one - m)[:, k], len(types)) for k in range(n)], axis=1) / len(sequences)
        by_feature = np.stack([np.bincount(value, slope[owner, k], BUCKETS) for k in range(n)], axis=1) - l2 * model.weight
        by_pair = (pairs - expected_pairs(forward, backward, emission, model.trans, inner)) / len(sequences)
        for x, g, s in zip((model.weight, model.listed, model.trans), (by_feature, lists.T @ slope, by_pair), sums, strict=True):
            s += g * g
            x += rate * g / np.sqrt(s)
    return model


class Labeller:
    """A worker's state: emissions of the words met so far."""

    def __init__(self, model: Model):
        self.model = model
        self.clear()

    def clear(self) -> None:
        self.slots: dict[str, int] = {}
        self.scores = np.zeros((0, len(self.model.labels)), np.float32)

    def words(self, texts: list[str]) -> tuple[list[list[str]], np.ndarray]:
        """Words of each text, and the label probabilities of all words end to end."""
        if len(self.slots) > CACHE:
            self.clear()
        parts = [WORD.findall(t.lower()) for t in texts]
        count = np.fromiter(map(len, parts), np.int64, len(parts))
        flat = [w for p in parts for w in p]
        slot = np.fromiter(map(self.slots.get, flat, repeat(-1)), np.int64, len(flat))
        missing = np.flatnonzero(slot < 0).tolist()
        if missing:
            fresh = list({flat[i] for i in missing})
            self.slots.update(zip(fresh, range(len(self.slots), len(self.slots) + len(fresh)), strict=True))
            self.scores = np.concatenate((self.scores, self.model.emissions(fresh)))
            slot[missing] = [self.slots[flat[i]] for i in missing]
        self.length = np.fromiter(map(len, flat), np.int64, len(flat))
        full = count > 0
        return parts, marginals(self.scores[slot], self.model.trans, count[full])

    def texts(self, texts: list[str]) -> pd.DataFrame:
        parts, m = self.words(texts)
        n = len(self.model.labels)
        count = np.fromiter(map(len, parts), np.int64, len(parts))
        text = np.repeat(np.arange(len(texts)), count)
        share = np.stack([np.bincount(text, m[:, k] * self.length, len(texts)) for k in range(n)], axis=1)
        label = m.argmax(axis=1) if len(m) else np.empty(0, np.int64)
        same = text[1:] == text[:-1]
        switches = np.bincount(text[1:][same & (label[1:] != label[:-1])], minlength=len(texts))
        total = share.sum(axis=1)
        best = share.argmax(axis=1)
        lettered = np.array([any(map(str.isalpha, p)) or any(c.isalpha() for w in p for c in w) for p in parts], bool)
        known = lettered & (total > 0)
        score = np.where(known, share[np.arange(len(texts)), best] / np.maximum(total, 1e-12), 0.0)
        names = np.array([*self.model.labels], object)[best]
        names[~known] = NONE
        return pd.DataFrame({"lang": names, "score": np.clip(score, 0, 1), "words": count, "switches": switches})


def sample(docs: DataFrame, documents: int, windows: int, length: int, languages: int = LANGUAGES) -> list[tuple[str, list[str]]]:
    """Training windows: of each language the `documents` first different documents by a hash of the id, then of the text; of each up to `windows` runs of `length` words, evenly spaced.

    The only bounded sample: of the `languages` languages with the most
    documents, at most languages * documents * windows * length words reach the
    driver, whatever repeats. Documents that share id, language and text are one.
    """
    ship(docs.sparkSession)
    keyed = docs.filter("lang is not null and doc_id is not null and text is not null").select("doc_id", "lang", F.xxhash64("text").alias("t"), "text")
    common = keyed.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(languages).select("lang")
    ranked = keyed.join(F.broadcast(common), "lang").select("doc_id", "lang", "t").distinct().withColumn("h", F.xxhash64("doc_id"))
    order = Window.partitionBy("lang").orderBy("h", "doc_id", "t")
    chosen = ranked.withColumn("r", F.row_number().over(order)).filter(F.col("r") <= documents).select("doc_id", "lang", "t")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            langs, runs = [], []
            for text, lang in zip(batch["text"], batch["lang"], strict=True):
                words = WORD.findall(text.lower())
                starts = range(0, len(words), max(length, -(-len(words) // windows)))
                for s in starts:
                    langs.append(lang)
                    runs.append(" ".join(words[s : s + length]))
            yield pd.DataFrame({"lang": pd.Series(langs, dtype=object), "run": pd.Series(runs, dtype=object)})

    # at most languages * documents rows are sent, and as many documents come back
    held = keyed.join(F.broadcast(chosen), ["doc_id", "lang", "t"]).dropDuplicates(["doc_id", "lang", "t"]).select("text", "lang")
    rows = held.mapInPandas(run, "lang string, run string").collect()
    return sorted((r.lang, r.run.split(" ")) for r in rows if r.run)


def train(docs: DataFrame, documents: int = 200, windows: int = 6, length: int = 24, **settings) -> Model:
    """A model of docs (doc_id, text, lang); see sample() for what bounds its size."""
    return fit(sample(docs, documents, windows, length), **settings)


def language(spark, model: Model):
    """A column function: text to (lang, score, words, switches)."""
    ship(spark)
    sent = spark.sparkContext.broadcast(model)
    shape = T.StructType([T.StructField("lang", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("words", T.LongType()), T.StructField("switches", T.LongType())])

    @F.pandas_udf(shape)
    def label(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        labeller = Labeller(sent.value)
        for batch in batches:
            parts = [labeller.texts(texts) for _, texts in chunks(batch, BATCH)]
            yield pd.concat(parts, ignore_index=True) if parts else pd.DataFrame({"lang": [], "score": [], "words": [], "switches": []})

    return label.asNondeterministic()


def held_out(doc_id: Column) -> Column:
    """Whether a document is kept from training: crc32 of its id as text, modulo 4, is 2."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def identify(docs: DataFrame, model: Model, text_col: str = "text", out: str = "language") -> DataFrame:
    """docs with a struct column `out` (lang, score, words, switches).

    lang is a learned language, or `und` if the text is null or has no letter
    (score 0) or nothing was learned; score is the share of letters in it.
    Rows are independent: repeats give the same, an empty table stays empty.
    """
    if not model.labels:
        nothing = F.struct(F.lit(NONE).alias("lang"), F.lit(0.0).alias("score"), F.lit(0).cast("long").alias("words"), F.lit(0).cast("long").alias("switches"))
        return docs.withColumn(out, nothing)
    return docs.withColumn(out, language(docs.sparkSession, model)(F.col(text_col)))


def predict(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", **settings) -> DataFrame:
    """(doc_id, held_out, lang_pred, score, n_words, n_switches) for each row of docs, by a model of the rows that aren't held out.

    Neither ids nor given languages are inputs of a prediction. Null languages
    and ids are not learned from. Null and empty texts, and those without
    letters, are `und` with score 0; whole texts of any length are labelled. If
    languages have equal shares of a text's letters, it is the first in
    alphabetical order. Repeated rows give the same; extra columns are ignored;
    an empty table gives an empty result.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    model = train(rows.filter(~held_out(F.col("doc_id"))), **settings)
    named = identify(rows.select("doc_id", "text"), model)
    return named.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col("language.lang").alias("lang_pred"), F.col("language.score").alias("score"), F.col("language.words").alias("n_words"), F.col("language.switches").alias("n_switches"))


def keep_known(docs: DataFrame, model: Model, least: float = 0.5) -> DataFrame:
    """docs with all its columns, without texts that have no letters or whose letters are in no one language for the most part."""
    (name,) = free(docs, "_language")
    return identify(docs, model, out=name).filter((F.col(f"{name}.lang") != NONE) & (F.col(f"{name}.score") >= least)).drop(name)
