"""MinHash near-duplicates by tensored banding, with every link confirmed on whole shingle sets.

1. One pass over the texts makes each document's set of word shingles (64-bit
   hashes), a 128-bit digest of the set, and two small collections A and B of
   `side` minhash tuples. The side*side table keys are the pairs (A_i, B_j):
   2 * side * width minhashes do the work of side * side * 2 * width.
   Equal sets of one batch get keys once: copies cost nothing more.
2. Equal digests are one class. A key that two classes share makes candidates:
   each holder is joined to the smallest holder of the key, and the components
   of these edges are candidate groups. One map-side combined aggregate finds
   the holders of keys that have up to three (the smallest, the largest, and
   what is left of the exclusive or of all); only keys with more are joined with
   the postings again. Any two documents that share a key are in the same group,
   whatever its size.
3. Groups are verified exactly on whole sets. A group within `group_shingles`
   is verified in one task. A larger one, as common boilerplate makes them, is
   divided first: with shingles ordered by rarity within the group, two linked
   sets share one of the rarest of both (a quarter of each at 75 percent), so
   the components of such meetings are groups of their own, and sets that share
   only frequent shingles part. What is still larger, copies of one text as a
   rule, is verified by blocks of bounded size: a broadcast block of sets is
   held against all members where they lie. Either way a document is compared
   with all others of its group unless both already are in the group's largest
   class, so no link is lost, and no list of pairs is made.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import BATCH_CHARS, chunks, free, maybe_broadcast, release, save, ship
from .graph import components

PRIME = np.uint64(0x9E3779B97F4A7C15)
#: Words whose hashes a worker remembers at once.
CACHE = 200_000


class WordHashes(dict):
    """Word to 64-bit hash, filled as words come; emptied when large, so memory stays bounded."""

    def __missing__(self, word: bytes) -> int:
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser."""
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def shingle_sets(texts: list[str], words: int, cache: WordHashes) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each text, end to end, and where each text's begin (one more entry than texts).

    Words are runs without ASCII white space, A-Z lower-cased. A text with
    fewer words than a shingle has, but not none, has its whole sequence as one.
    """
    if len(cache) > CACHE:
        cache.clear()
    parts = [t.encode("utf-8", "surrogatepass").lower().split() for t in texts]
    count = np.fromiter(map(len, parts), np.int64, len(parts))
    flat = np.fromiter((cache[w] for p in parts for w in p), np.uint64, int(count.sum()))
    begin = np.concatenate(([0], np.cumsum(count)))
    total = len(flat)
    grown = np.concatenate((flat, np.zeros(words, np.uint64)))
    rolled = np.zeros(total, np.uint64)
    for k in range(words):
        rolled = rolled * PRIME + grown[k : k + total]
    rolled = mix(rolled + np.uint64(words))
    own = np.maximum(count - words + 1, 0)
    short = (count > 0) & (count < words)
    doc = np.repeat(np.arange(len(parts)), own)
    place = np.arange(int(own.sum())) - np.repeat(np.cumsum(own) - own, own) + np.repeat(begin[:-1], own)
    value = rolled[place]
    if short.any():
        sums = []
        for i in np.flatnonzero(short):
            h = 0
            for w in flat[begin[i] : begin[i + 1]].tolist():
                h = (h * int(PRIME) + w) & 0xFFFFFFFFFFFFFFFF
            sums.append(h)
        doc = np.concatenate((doc, np.flatnonzero(short)))
        value = np.concatenate((value, mix(np.array(sums, np.uint64) + count[short].astype(np.uint64) + np.uint64(1 << 40))))
    order = np.lexsort((value, doc))
    doc, value = doc[order], value[order]
    fresh = np.ones(len(doc), bool)
    fresh[1:] = (doc[1:] != doc[:-1]) | (value[1:] != value[:-1])
    doc, value = doc[fresh], value[fresh]
    return value, np.searchsorted(doc, np.arange(len(parts) + 1))


class Banding:
    """Keys of tensored banding: side*side keys from 2*side tuples of width minhashes."""

    def __init__(self, side: int, width: int, seed: int = 7):
        self.side, self.width = side, width
        rng = np.random.default_rng(seed)
        self.mul = rng.integers(1 << 62, size=2 * side * width, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.add = rng.integers(1 << 63, size=2 * side * width, dtype=np.uint64)

    def keys(self, value: np.ndarray, begin: np.ndarray) -> np.ndarray:
        """A row of keys for each set; sets must not be empty."""
        n = len(begin) - 1
        low = np.empty((len(self.mul), n), np.uint64)
        step = max(1, 60_000 * n // max(1, len(value)))  # so many sets fit a cache
        for a in range(0, n, step):
            b = min(n, a + step)
            part, starts = value[begin[a] : begin[b]], begin[a:b] - begin[a]
            for k in range(len(self.mul)):
                low[k, a:b] = np.minimum.reduceat(part * self.mul[k] + self.add[k], starts)
        tuples = np.zeros((2 * self.side, n), np.uint64)
        for t in range(2 * self.side):
            for k in range(self.width):
                tuples[t] = mix(tuples[t] * PRIME + low[t * self.width + k])
        out = np.empty((n, self.side * self.side), np.uint64)
        for i in range(self.side):
            for j in range(self.side):
                at = i * self.side + j
                out[:, at] = mix(tuples[i] * PRIME + tuples[self.side + j] + np.uint64(at))
        return out


def signatures(docs: DataFrame, words: int, side: int, width: int) -> DataFrame:
    """(doc_id, n_shingles, hi, lo, keys) for docs (doc_id, text); keys are null for empty sets and for repeats within a batch."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cache, banding = WordHashes(), Banding(side, width)
        for batch in batches:
            seen: set[bytes] = set()
            ids = batch["doc_id"]
            for start, texts in chunks(batch["text"], BATCH_CHARS):
                value, begin = shingle_sets(texts, words, cache)
                size = np.diff(begin)
                digests = [xxhash.xxh3_128_digest(value[begin[i] : begin[i + 1]].tobytes()) for i in range(len(texts))]
                first = np.zeros(len(texts), bool)
                for i, d in enumerate(digests):
                    if size[i] and d not in seen:
                        seen.add(d)
                        first[i] = True
                keys: list = [None] * len(texts)
                if first.any():
                    keep = np.repeat(first, size)
                    where = np.flatnonzero(first)
                    made = banding.keys(value[keep], np.concatenate(([0], np.cumsum(size[where])))).view(np.int64)
                    for row, i in enumerate(where):
                        keys[i] = made[row]
                pairs = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)
                yield pd.DataFrame({"doc_id": ids.iloc[start : start + len(texts)].to_numpy(), "n_shingles": size, "hi": pairs[:, 0], "lo": pairs[:, 1], "keys": keys})

    return docs.mapInPandas(run, "doc_id long, n_shingles long, hi long, lo long, keys array<long>")


def link_sets(value: np.ndarray, begin: np.ndarray, percent: int) -> np.ndarray:
    """Root (an index) of each set under links of 100 * intersection >= percent * union, exactly.

    A set is held against all others unless it already is in the largest
    class: a link between two sets that never were held against others is
    then one within that class.
    """
    n, size = len(begin) - 1, np.diff(begin)
    root = np.arange(n)
    _, token = np.unique(value, return_inverse=True)
    owner = np.repeat(np.arange(n), size)
    order = np.argsort(token, kind="stable")
    posted, at = owner[order], np.searchsorted(token[order], np.arange(token.max() + 2 if len(token) else 1))
    held = np.zeros(n, bool)
    count = np.ones(n, np.int64)  # members by root
    while True:
        top = int(np.argmax(count))
        left = np.flatnonzero(~held & ((root != top) | (count[top] == 1)))
        if not len(left):
            return root
        p = int(left[0])
        held[p] = True
        own = token[begin[p] : begin[p + 1]]
        hits = np.concatenate([posted[at[t] : at[t + 1]] for t in own]) if len(own) else np.empty(0, np.int64)
        both = np.bincount(hits, minlength=n)
        linked = np.flatnonzero((both > 0) & (100 * both >= percent * (size + size[p] - both)))
        roots = np.unique(np.append(root[linked], root[p]))
        if len(roots) > 1:
            root[np.isin(root, roots)] = roots[0]
            count[roots[0]] = count[roots].sum()
            count[roots[1:]] = 0


def link_small(sets: DataFrame, percent: int) -> DataFrame:
    """(u, v) spanning links of groups whose members all fit a task; sets: (gid, doc_id, shingles)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def done(ids: list, rows: list) -> pd.DataFrame:
            size = np.fromiter(map(len, rows), np.int64, len(rows))
            root = link_sets(np.concatenate(rows), np.concatenate(([0], np.cumsum(size))), percent)
            ids_ = np.array(ids, np.int64)
            keep = root != np.arange(len(ids_))
            return pd.DataFrame({"u": ids_[keep], "v": ids_[root[keep]]})

        now, ids, rows = None, [], []
        for batch in batches:
            for gid, doc, s in zip(batch["gid"], batch["doc_id"], batch["shingles"], strict=True):
                if gid != now:
                    if len(ids) > 1:
                        yield done(ids, rows)
                        if len(ids) > 1000:
                            release()
                    now, ids, rows = gid, [], []
                ids.append(doc)
                rows.append(np.asarray(s, np.int64))
        if len(ids) > 1:
            yield done(ids, rows)
        release()

    return sets.repartition("gid").sortWithinPartitions("gid").mapInPandas(run, "u long, v long")


def meetings(sets: DataFrame, percent: int) -> DataFrame:
    """(doc_id, gid): finer groups of sets (gid, doc_id, sid, n_shingles, shingles), read from the shared folder; who meets no one is left out.

    Sets with percent of their union in common share at least percent of each.
    In one order of all shingles, here by how many sets of the group have them,
    the first (100 - percent) percent and one more of each therefore meet. A
    shingle of one set alone meets nothing; it only takes up room among the
    first, so it is counted and not joined.
    """
    token = F.explode(F.transform("shingles", lambda s: F.xxhash64("gid", s))).alias("token")
    own = sets.select("sid", "doc_id", "n_shingles", token)
    shared = save(own.groupBy("token").agg(F.count("*").alias("n")).filter("n > 1"), "shared-shingles")
    of = Window.partitionBy("sid")
    rank, have = F.row_number().over(of.orderBy("n", "token")), F.count("*").over(of)
    ranked = own.join(maybe_broadcast(shared), "token").select("doc_id", "n_shingles", "token", rank.alias("rank"), have.alias("have"))
    alone = F.col("n_shingles") - F.col("have")
    first = ranked.filter(alone + F.col("rank") <= F.floor(F.col("n_shingles") * (100 - percent) / 100) + 1)
    first = save(first.select("doc_id", "token"), "rarest")
    low = first.groupBy("token").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).filter("low <> high")
    edges = first.join(maybe_broadcast(save(low.select("token", "low"), "lowest")), "token")
    return components(edges.select(F.col("doc_id").alias("u"), F.col("low").alias("v")).distinct()).select(F.col("node").alias("doc_id"), F.col("root").alias("gid"))


def link_large(sets: DataFrame, percent: int, bound: int) -> DataFrame:
    """(u, v) links of groups beyond the bound; sets as in meetings."""
    part = save(meetings(sets, percent), "parts")
    weight = sets.select("doc_id", "n_shingles").join(part, "doc_id").groupBy("gid").agg(F.sum("n_shingles").alias("weight"))
    part = save(part.join(weight, "gid"), "weighed")
    finer = sets.drop("gid", "sid").join(maybe_broadcast(part), "doc_id").select("gid", "doc_id", "n_shingles", "shingles", "weight")
    links = link_small(finer.filter(F.col("weight") <= bound), percent)
    if part.filter(F.col("weight") > bound).isEmpty():
        return links
    still = save(finer.filter(F.col("weight") > bound).drop("weight"), "still-large")
    return links.unionByName(link_blocks(still, percent, bound))


def link_blocks(sets: DataFrame, percent: int, block: int) -> DataFrame:
    """(u, v) links of groups of any size; sets: (gid, doc_id, n_shingles, shingles), read from the shared folder.

    Rounds: a block of sets of at most `block` shingles (one set can be more)
    goes to all tasks, each task joins its rows to the block's. First a few sets
    of each group, then those outside of the group's largest class, until every
    such set has been in a block.
    """
    spark = sets.sparkSession
    narrow = sets.select("gid", "doc_id", "n_shingles")
    label = save(narrow.select("gid", "doc_id", "n_shingles", F.col("doc_id").alias("root"), F.lit(False).alias("held")), "label")
    links = None
    rounds = 0
    while True:
        sizes = label.groupBy("gid", "root").agg(F.count("*").alias("members"))
        top = sizes.groupBy("gid").agg(F.max_by("root", F.struct("members", -F.col("root"))).alias("top"), F.max("members").alias("most"))
        open_ = label.join(top, "gid").filter("not held and (root <> top or most = 1)")
        order = F.xxhash64("doc_id", F.lit(rounds))
        # a bounded number of rows to the driver: the next sets by a hash order, to one block's worth
        rows = open_.select("gid", "doc_id", "n_shingles", order.alias("o")).orderBy("o", "doc_id").limit(max(1, block // 32) if rounds else 64).collect()
        if not rows:
            return links if links is not None else spark.createDataFrame([], "u long, v long")
        chosen, filled = [], 0
        for r in rows:
            if chosen and filled + r.n_shingles > block:
                break
            chosen.append(r.doc_id)
            filled += r.n_shingles
        picked = spark.createDataFrame([(d,) for d in chosen], "doc_id long")
        held = sets.join(F.broadcast(picked), "doc_id", "left_semi").select("gid", "doc_id", "shingles").collect()
        ids = np.array([r.doc_id for r in held], np.int64)
        gids = np.array([r.gid for r in held], np.int64)
        size = np.array([len(r.shingles) for r in held], np.int64)
        token = np.concatenate([np.array(r.shingles, np.int64) for r in held])
        by = np.argsort(token, kind="stable")
        sent = spark.sparkContext.broadcast((ids, gids, size, token[by], np.repeat(np.arange(len(ids)), size)[by]))

        def run(batches: Iterator[pd.DataFrame], sent=sent) -> Iterator[pd.DataFrame]:
            ids, gids, size, token, owner = sent.value
            for batch in batches:
                u, v = [], []
                for gid, doc, s in zip(batch["gid"], batch["doc_id"], batch["shingles"], strict=True):
                    s = np.asarray(s, np.int64)
                    a, b = np.searchsorted(token, s, "left"), np.searchsorted(token, s, "right")
                    own = np.flatnonzero(b > a)
                    hits = np.concatenate([owner[x:y] for x, y in zip(a[own], b[own], strict=True)]) if len(own) else np.empty(0, np.int64)
                    both = np.bincount(hits, minlength=len(ids))
                    near = np.flatnonzero((both > 0) & (gids == gid) & (ids != doc) & (100 * both >= percent * (size + len(s) - both)))
                    if len(near):  # the block's own links are found when its sets come by as rows
                        u += [doc] * len(near)
                        v += ids[near].tolist()
                yield spanning(u, v)

        found = save(sets.select("gid", "doc_id", "shingles").mapInPandas(run, "u long, v long"), "links")
        links = found if links is None else links.unionByName(found)
        merged = components(label.select(F.col("doc_id").alias("u"), F.col("root").alias("v")).unionByName(found))
        label = label.withColumnRenamed("root", "old").join(merged, F.col("doc_id") == F.col("node")).join(F.broadcast(picked.select("doc_id", F.lit(True).alias("now"))), "doc_id", "left")
        label = save(label.select("gid", "doc_id", "n_shingles", "root", (F.col("held") | F.coalesce("now", F.lit(False))).alias("held")), "label")
        rounds += 1


def spanning(u: list[int], v: list[int]) -> pd.DataFrame:
    """As few of these links as keep the same components."""
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while root.setdefault(x, x) != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    keep = []
    for a, b in zip(u, v, strict=True):
        x, y = find(a), find(b)
        if x != y:
            root[x] = y
            keep.append((a, b))
    return pd.DataFrame(keep, columns=["u", "v"]).astype("int64")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, percent: int = 75, side: int = 10, width: int = 2, group_shingles: int = 1_500_000) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for each row of docs.

    Two documents are linked if 100 * |A and B| >= percent * |A or B| over their
    sets of `words`-word shingles; component_id is the smallest id reachable.
    At similarity 0.75 a pair shares a key with probability 0.9995, more above.
    Texts are whole, of any length. Null and empty texts have no shingles and
    are linked with nothing. A null id
    keeps its row, without a component, kept. Rows that repeat an id count as one
    document. Extra columns are ignored; an empty table gives an empty result.
    """
    ship(docs.sparkSession)
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    signed = save(signatures(docs, words, side, width), "signatures")
    narrow = signed.select("doc_id", "n_shingles", "hi", "lo")

    # classes of equal sets; the smallest id stands for each
    full = narrow.filter("n_shingles > 0 and doc_id is not null")
    classes = full.groupBy("hi", "lo").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies"))
    same = full.join(classes.filter("copies > 1"), ["hi", "lo"]).select(F.col("doc_id").alias("u"), F.col("rep").alias("v"))

    # candidates: holders of a key, each with the smallest holder
    keyed = signed.filter("keys is not null and doc_id is not null")
    posted = keyed.select(F.explode("keys").alias("key"), "doc_id", "lo")
    shared = posted.groupBy("key").agg(F.count("*").alias("n"), F.min("doc_id").alias("low"), F.max("doc_id").alias("high"), F.bit_xor("doc_id").alias("all"), F.min("lo").alias("a"), F.max("lo").alias("b")).filter("a <> b")
    middle = F.when(F.col("n") == 3, F.col("all").bitwiseXOR(F.col("low")).bitwiseXOR(F.col("high")))
    shared = save(shared.select("key", "n", "low", "high", middle.alias("middle")), "shared")
    few = shared.filter("n <= 3").select(F.explode(F.array("high", "middle")).alias("u"), F.col("low").alias("v")).filter("u is not null")
    more = posted.select("key", "doc_id").join(maybe_broadcast(shared.filter("n > 3").select("key", "low")), "key").select(F.col("doc_id").alias("u"), F.col("low").alias("v"))
    near = few.unionByName(more).distinct()
    groups = components(near).select(F.col("node").alias("doc_id"), F.col("root").alias("gid"))

    # one member of each class and group is verified, on its whole set
    member = full.join(groups, "doc_id").groupBy("hi", "lo").agg(F.min("doc_id").alias("doc_id"), F.min("gid").alias("gid"), F.first("n_shingles").alias("n_shingles"))
    member = save(member.select("doc_id", "gid", "n_shingles"), "members")
    weight = member.groupBy("gid").agg(F.sum("n_shingles").alias("weight"), F.count("*").alias("members"))
    member = save(member.join(weight, "gid").filter("members > 1").select("doc_id", "gid", "n_shingles", "weight"), "verified")
    held = docs.filter("doc_id is not null").join(maybe_broadcast(member), "doc_id")

    def to_sets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cache = WordHashes()
        for batch in batches:
            for start, texts in chunks(batch["text"], BATCH_CHARS):
                value, begin = shingle_sets(texts, words, cache)
                value = value.view(np.int64)
                part = batch.iloc[start : start + len(texts)]
                yield pd.DataFrame({"gid": part["gid"].to_numpy(), "doc_id": part["doc_id"].to_numpy(), "n_shingles": np.diff(begin), "shingles": [value[begin[i] : begin[i + 1]] for i in range(len(texts))]})

    shape = "gid long, doc_id long, n_shingles long, shingles array<long>"
    links = link_small(held.filter(F.col("weight") <= group_shingles).select("gid", "doc_id", "text").mapInPandas(to_sets, shape), percent)
    if not member.filter(F.col("weight") > group_shingles).isEmpty():
        big = held.filter(F.col("weight") > group_shingles).select("gid", "doc_id", "text").mapInPandas(to_sets, shape)
        links = links.unionByName(link_large(save(big.withColumn("sid", F.monotonically_increasing_id()), "large"), percent, group_shingles))

    # copies hang on their class, classes on each other
    roots = components(same.unionByName(links))
    out = narrow.join(roots, F.col("doc_id") == F.col("node"), "left")
    own = F.coalesce("root", "doc_id")
    return out.select("doc_id", "n_shingles", own.alias("component_id"), F.coalesce(F.col("doc_id") == own, F.lit(True)).alias("kept"))


def keep_one(docs: DataFrame, **settings) -> DataFrame:
    """docs with all its columns, one document of each component: the smallest id. Of rows that repeat an id and its text one stays; null ids stay."""
    gone, copy = free(docs, "_gone", "_copy")
    lost = near_duplicates(docs, **settings).filter("not kept").select(F.col("doc_id").alias(gone))
    kept = docs.join(maybe_broadcast(save(lost.distinct(), "gone")), F.col("doc_id") == F.col(gone), "left_anti")
    key = F.xxhash64("doc_id", F.coalesce("text", F.lit("")))
    twice = save(docs.filter("doc_id is not null").groupBy(key.alias(copy)).agg(F.count("*").alias("n")).filter("n > 1").select(copy), "repeated")
    if twice.isEmpty():
        return kept
    marked = kept.join(maybe_broadcast(twice), (key == F.col(copy)) & F.col("doc_id").isNotNull(), "left")
    return marked.filter(F.col(copy).isNull()).drop(copy).unionByName(marked.filter(F.col(copy).isNotNull()).dropDuplicates([copy]).drop(copy))
