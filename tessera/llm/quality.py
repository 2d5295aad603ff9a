"""Quality by perplexity under an interpolated modified Kneser-Ney model of trusted text (see ngrams).

A text's mean negative logarithm is compared with those of its language's
trusted documents. As the mean of few tokens varies more, it is expressed in
standard deviations, which are estimated from the trusted documents by their
length: the variance of tokens within a document, divided by their number, and
that between documents. A document is rejected beyond quantiles of its
language's trusted documents, widened by a share of their distance.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import ngrams
from .common import free, maybe_broadcast, save
from .tokencount import compiled

#: Vocabulary file whose tokens are counted, unless another is given.
VOCABULARY = "byte_bpe_50k.json"


def vocabulary(path: str | None) -> ngrams.Vocabulary:
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path(VOCABULARY)
    return ngrams.Vocabulary(compiled(path))


def good_ids(labels: DataFrame, name: str) -> DataFrame:
    """Ids whose every label says good quality and not toxic."""
    return labels.groupBy("doc_id").agg(F.min("quality").alias("q"), F.max("toxic").alias("t")).filter("q = 1 and t = 0 and doc_id is not null").select(F.col("doc_id").alias(name))


def deviation(tokens: Column) -> Column:
    """Standard deviation of the mean of so many tokens."""
    return F.sqrt(F.col("between") + F.col("within") / tokens)


def limits(scored: DataFrame, low: float, high: float, widen: float) -> DataFrame:
    """(lang, centre, within, between, low, high) from trusted documents (lang, tokens, mean, variance): a row for each language, and one of all documents with a null lang.

    low and high are quantiles in standard deviations, `widen` times their distance further out.
    """
    every = F.when(F.col("lang").isNull(), F.array(F.lit(None).cast("string"))).otherwise(F.array("lang", F.lit(None).cast("string")))
    rows = scored.filter("tokens > 0 and mean is not null").select(F.explode(every).alias("lang"), "tokens", "mean", "variance")
    per = rows.groupBy("lang").agg(F.percentile_approx("mean", 0.5, 10_000).alias("centre"), (F.sum(F.col("variance") * F.col("tokens")) / F.sum("tokens")).alias("within"))
    beside = lambda table, of: table.join(maybe_broadcast(of.withColumnRenamed("lang", "of")), F.col("lang").eqNullSafe(F.col("of"))).drop("of")
    rows = beside(rows, save(per, "centres"))
    weight = F.sqrt("tokens")
    extra = F.pow(F.col("mean") - F.col("centre"), 2) - F.col("within") / F.col("tokens")
    spread = rows.groupBy("lang").agg(F.greatest(F.sum(weight * extra) / F.sum(weight), F.lit(1e-6)).alias("between"))
    rows = beside(rows, save(spread, "spreads"))
    z = (F.col("mean") - F.col("centre")) / deviation(F.col("tokens"))
    cut = rows.groupBy("lang").agg(*[F.first(c).alias(c) for c in ("centre", "within", "between")], F.percentile_approx(z, [low, high], 10_000).alias("q"))
    q = [F.col("q")[k] for k in (0, 1)]
    return cut.select("lang", "centre", "within", "between", (q[0] - widen * (q[1] - q[0])).alias("low"), (q[1] + widen * (q[1] - q[0])).alias("high"))


def judged(scored: DataFrame, bounds: DataFrame, score: str, lang_col: str, out: str) -> DataFrame:
    """scored, whose column `score` has (tokens, mean), with a struct column `out` (tokens, perplexity, low, high, kept); bounds: those of limits(), saved."""
    names = ["centre", "within", "between", "low", "high"]
    lang, own, all_ = free(scored, "_lang", "_own", "_all")
    table = bounds.select(F.col("lang").alias(lang), F.struct(*names).alias(own)).filter(F.col(lang).isNotNull())
    both = scored.join(maybe_broadcast(table), F.col(lang_col) == F.col(lang), "left")
    rest = bounds.filter("lang is null").first()
    every = F.struct(*[F.lit(rest[n] if rest else None).cast("double").alias(n) for n in names])
    both = both.withColumn(own, F.coalesce(own, every))
    n = F.greatest(F.col(f"{score}.tokens"), F.lit(1))
    sd = F.sqrt(F.col(f"{own}.between") + F.col(f"{own}.within") / n)
    ends = [F.exp(F.least(F.col(f"{own}.centre") + F.col(f"{own}.{k}") * sd, F.lit(700.0))) for k in ("low", "high")]
    p = F.exp(F.col(f"{score}.mean"))
    kept = (F.col(f"{score}.tokens") > 0) & F.coalesce(p.between(*ends), F.lit(True))
    return both.withColumn(out, F.struct(F.col(f"{score}.tokens").alias("tokens"), p.alias("perplexity"), ends[0].alias("low"), ends[1].alias("high"), kept.alias("kept"))).drop(lang, own)


def classify(docs: DataFrame, labels: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", low: float = 0.002, high: float = 0.998, widen: float = 0.25, table_rows: int = ngrams.TABLE_ROWS) -> DataFrame:
    """(doc_id, lang, n_tokens, perplexity, low, high, kept) for each row of docs, by models of the trusted ones.

    Trusted: every label of the id says good quality and not toxic; labels:
    (doc_id, quality, toxic). path: the vocabulary. Kept: the perplexity is
    within the limits of the language; those of all trusted documents serve a
    null language and one without any. Null and empty texts, and those of white
    space only, have no tokens and no perplexity and are not kept. Where there
    is no model (no trusted text in the other half) there is no perplexity, and
    all other texts are kept. Whole texts are scored, of any length. Rows are
    independent: repeats give the same, ids that repeat with different texts
    each give theirs. Extra columns are ignored; an empty table gives an empty
    result.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    good = save(good_ids(labels, "good"), "good")
    trusted = lambda table: table.join(maybe_broadcast(good), F.col("doc_id") == F.col("good"), "left_semi")
    words = vocabulary(path)
    model = ngrams.fit(trusted(rows), words)
    scored = save(ngrams.scores(rows, model, words, "text", "s", table_rows).select("doc_id", "lang", "s"), "scored")  # narrow
    bounds = save(limits(trusted(scored).select("lang", "s.*"), low, high, widen), "limits")
    out = judged(scored, bounds, "s", "lang", "j")
    return out.select("doc_id", "lang", F.col("j.tokens").alias("n_tokens"), *[F.col(f"j.{k}").alias(k) for k in ("perplexity", "low", "high", "kept")])


def keep_good(docs: DataFrame, labels: DataFrame, path: str | None = None, low: float = 0.002, high: float = 0.998, widen: float = 0.25, table_rows: int = ngrams.TABLE_ROWS) -> DataFrame:
    """docs (with doc_id, text, lang and any other columns) that classify() keeps. Only trusted texts are scored twice: for the limits and here."""
    name, score, verdict = free(docs, "_good", "_score", "_quality")
    good = save(good_ids(labels, name), "good")
    trusted = docs.select("doc_id", "text", "lang").join(maybe_broadcast(good), F.col("doc_id") == F.col(name), "left_semi")
    words = vocabulary(path)
    model = ngrams.fit(trusted, words)
    seen = ngrams.scores(trusted, model, words, "text", "s", table_rows).select("lang", "s.*")
    bounds = save(limits(save(seen, "trusted"), low, high, widen), "limits")
    out = judged(ngrams.scores(docs, model, words, "text", score, table_rows), bounds, score, "lang", verdict)
    return out.filter(F.col(f"{verdict}.kept")).drop(score, verdict)
