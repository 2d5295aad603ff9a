"""The registered queries opN_<name> of this subpackage and the SQL that checks them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, exact, langid, licenses, neardup, packing, phrases, pieces, quality, repeats, tokencount, toolcalls, urlfilter

#: Vocabulary file of the token counts and of packing: a parameter of those operators.
VOCABULARY = "byte_bpe_50k.json"
#: Model of the encoding in pieces.
PIECES = "piece_bpe_32k.model"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_crf_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.predict(read(spark, sf_dir, "documents"))


def op2_exact_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.fingerprints(read(spark, sf_dir, "documents"))


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokencount.token_counts(read(spark, sf_dir, "documents"), vocabulary())


def op5_license_diagonals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(read(spark, sf_dir, "documents"))


def op6_kneser_ney_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op7_minhash_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(read(spark, sf_dir, "documents"))


def op8_tool_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table has no tool messages of its own, so every turn is made one (see toolcalls.from_turns). Faults are joined by semicolons."""
    linked = toolcalls.link(toolcalls.from_turns(read(spark, sf_dir, "conversations")), toolcalls.TURN_TOOLS)
    return linked.withColumn("faults", F.array_join("faults", ";"))


def op9_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlfilter.judge_urls(read(spark, sf_dir, "pages"))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read(spark, sf_dir, "documents"), vocabulary())


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of all texts, some of which repeat words as repeats.planted() has it."""
    found = repeats.periodic_runs(repeats.planted(read(spark, sf_dir, "documents")))
    runs = F.col("found.runs")
    none = F.lit(None).cast("struct<start: long, length: long, period: long>")
    # by start, then period: of equals the first stays
    best = F.aggregate(runs, none, lambda a, x: F.when(a.isNull() | (x["length"] * a["period"] > a["length"] * x["period"]), x).otherwise(a))
    lines = F.transform(runs, lambda x: F.concat(F.concat_ws(",", x["start"], x["length"], x["period"]), F.lit("\n")))
    rows = found.select("doc_id", "found", best.alias("best"), F.array_join(lines, "").alias("lines"))
    return rows.select(
        "doc_id", F.size("found.runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period",
        F.floor(1000 * F.col("best.length") / F.col("best.period")).cast("long").alias("exponent_milli"),
        F.sha2(F.col("lines").cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("found.collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )


def op12_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = vocabulary(PIECES)
    rows = pieces.decode(pieces.encode(read(spark, sf_dir, "documents").select("doc_id", "text"), model), model)
    return rows.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join(F.col("ids").cast("array<string>"), " ").cast("binary"), 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(read(spark, sf_dir, "documents"))


QUERIES = {
    "op1_crf_language": op1_crf_language,
    "op2_exact_digest": op2_exact_digest,
    "op3_decontamination": op3_decontamination,
    "op4_token_counts": op4_token_counts,
    "op5_license_diagonals": op5_license_diagonals,
    "op6_kneser_ney_quality": op6_kneser_ney_quality,
    "op7_minhash_neardup": op7_minhash_neardup,
    "op8_tool_calls": op8_tool_calls,
    "op9_url_rules": op9_url_rules,
    "op10_packing": op10_packing,
    "op11_periodic_runs": op11_periodic_runs,
    "op12_sentencepiece": op12_sentencepiece,
    "op13_collocations": op13_collocations,
}

#: Words of the contracts on whole words, in DuckDB.
WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

#: The license templates as rows of SQL, with their words in the same way.
TEMPLATES = ", ".join("({}, '{}', {}, '{}')".format(i, label, exact, text.replace("'", "''")) for i, (text, label, exact) in enumerate([*((t, b, "true") for t, b in licenses.PHRASES), *((t, b, "false") for t, b in licenses.NOTICES)]))

ORACLE_SQL: dict[str, str] = {
    "op5_license_diagonals": f"""
        WITH d AS (SELECT doc_id, {WORDS} AS w FROM documents),
        t AS (SELECT i, label, exact, w, len(w) AS size, CASE WHEN exact OR len(w) < 12 THEN 2 ELSE 3 END AS k FROM (SELECT i, label, exact, {WORDS} AS w FROM (VALUES {TEMPLATES}) v(i, label, exact, text))),
        tg AS (SELECT i, k, place, array_to_string(list_slice(w, place + 1, place + k), ' ') AS g FROM (SELECT i, k, w, unnest(range(0, size - k + 1)) AS place FROM t)),
        dg AS (SELECT doc_id, k, pos, array_to_string(list_slice(w, pos + 1, pos + k), ' ') AS g FROM (SELECT doc_id, k, w, unnest(range(0, greatest(len(w) - k + 1, 0))) AS pos FROM d, (SELECT unnest([2, 3]) AS k))),
        votes AS (SELECT DISTINCT doc_id, i, place, pos - place AS diagonal FROM dg JOIN tg USING (k, g)),
        lines AS (SELECT doc_id, i, diagonal, count(*) AS n FROM votes GROUP BY ALL),
        base AS (SELECT l.doc_id, t.label, l.diagonal FROM lines l JOIN t USING (i) WHERE t.exact AND l.n = t.size - t.k + 1),
        covered AS (SELECT DISTINCT l.doc_id, l.i, l.diagonal, unnest(range(v.place, v.place + t.k)) AS p
                    FROM lines l JOIN t USING (i) JOIN votes v ON v.doc_id = l.doc_id AND v.i = l.i AND v.diagonal >= l.diagonal
                         AND v.diagonal <= l.diagonal + CASE WHEN t.size < 12 THEN 0 ELSE floor((CAST(1.34 AS DOUBLE) - 1) * t.size) END WHERE NOT t.exact),
        notice AS (SELECT doc_id, label, CAST(count(*) AS DOUBLE) / size AS score, CASE WHEN size < 12 THEN count(*) = size ELSE CAST(count(*) AS DOUBLE) / size >= CAST(0.75 AS DOUBLE) END AS sure FROM covered JOIN t USING (i) GROUP BY doc_id, i, diagonal, label, size),
        found AS (SELECT doc_id, label, 1.0::DOUBLE AS score FROM base UNION ALL SELECT doc_id, CASE WHEN sure THEN label END, score FROM notice),
        per AS (SELECT doc_id, string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(score) AS score FROM found GROUP BY doc_id),
        phrases AS (SELECT doc_id, count(*) AS n_base, min(diagonal) AS first_word, max(diagonal) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels FROM base GROUP BY doc_id)
        SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_base, 0) AS BIGINT) AS n_base, CAST(first_word AS BIGINT) AS first_word, CAST(last_word AS BIGINT) AS last_word,
               coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0.0::DOUBLE) AS score
        FROM d LEFT JOIN phrases USING (doc_id) LEFT JOIN per USING (doc_id)
    """,
    "op3_decontamination": f"""
        WITH d AS (SELECT doc_id, {WORDS} AS w FROM documents),
        b AS (SELECT item_id, w, least(13, len(w)) AS k FROM (SELECT item_id, {WORDS} AS w FROM benchmark) WHERE len(w) > 0),
        win AS (SELECT DISTINCT item_id, k, array_to_string(list_slice(w, s, s + k - 1), ' ') AS g
                FROM (SELECT item_id, w, k, unnest(range(1, len(w) - k + 2)) AS s FROM b)),
        sizes AS (SELECT DISTINCT k FROM win),
        dw AS (SELECT doc_id, k, s, array_to_string(list_slice(w, s, s + k - 1), ' ') AS g
               FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS s FROM d, sizes)),
        hit AS (SELECT doc_id, k, s, item_id FROM dw JOIN win USING (k, g)),
        cov AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + k)) AS p FROM hit) GROUP BY doc_id),
        its AS (SELECT doc_id, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS ids
                FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS i FROM hit) GROUP BY doc_id)
        SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
               CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
               coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
        FROM d LEFT JOIN cov USING (doc_id) LEFT JOIN its USING (doc_id)
    """,
    "op7_minhash_neardup": """
        WITH RECURSIVE w AS (
            SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
        s AS (SELECT DISTINCT doc_id, array_to_string(list_slice(w, i, i + 4), ' ') AS sh
              FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM w WHERE len(w) > 0)),
        n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
        pairs AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id <> b.doc_id GROUP BY 1, 2),
        link AS (SELECT x, y FROM pairs JOIN n p ON x = p.doc_id JOIN n q ON y = q.doc_id WHERE 100 * k >= 75 * (p.n + q.n - k)),
        reach(x, y) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.x, l.y FROM reach r JOIN link l ON r.y = l.x)
        SELECT doc_id, CAST(coalesce(max(n), 0) AS BIGINT) AS n_shingles, min(y) AS component_id, min(y) = doc_id AS kept
        FROM (SELECT x AS doc_id, y, n.n FROM reach LEFT JOIN n ON x = n.doc_id) t GROUP BY doc_id
    """,
    "op13_collocations": r"""
        WITH p AS (SELECT lang, unnest(string_split_regex(text, '[.,;:!?\x0A-\x0D]')) AS t FROM (SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents)),
        w AS (SELECT lang, regexp_extract_all(t, '[^\x20\x09]+') AS w FROM p),
        g AS (SELECT lang, k, array_to_string(list_slice(w, s, s + k - 1), ' ') AS phrase FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS s FROM w, (SELECT unnest([1, 2, 3]) AS k) WHERE len(w) >= k)),
        f AS (SELECT lang, k, phrase, count(*) AS n FROM g GROUP BY ALL HAVING count(*) >= 10),
        total AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM w GROUP BY lang),
        c AS (SELECT *, string_split(phrase, ' ') AS v FROM f WHERE k > 1),
        cuts AS (SELECT lang, phrase, n AS a, cut, array_to_string(v[1:cut], ' ') AS x, array_to_string(v[cut + 1:], ' ') AS y FROM (SELECT *, unnest(range(1, k)) AS cut FROM c)),
        scored AS (SELECT s.lang, s.phrase, s.a, s.cut, l.n AS l, r.n AS r, CAST((1000000::HUGEINT * s.a * s.a) // (l.n::HUGEINT * r.n) AS BIGINT) AS score
                   FROM cuts s JOIN f l ON l.lang = s.lang AND l.phrase = s.x JOIN f r ON r.lang = s.lang AND r.phrase = s.y),
        lowest AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
        held AS (SELECT lang, part, max(n) AS longer FROM (SELECT lang, n, array_to_string(v[1:2], ' ') AS part FROM c WHERE k = 3 UNION ALL SELECT lang, n, array_to_string(v[2:3], ' ') FROM c WHERE k = 3) GROUP BY lang, part),
        kept AS (SELECT w.* FROM lowest w LEFT JOIN held h ON h.lang = w.lang AND h.part = w.phrase WHERE h.longer IS NULL OR 100 * h.longer < 50 * w.a)
        SELECT lang, rank, phrase, a, l, r, total.n AS n, score FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept) t JOIN total USING (lang) WHERE rank <= 2000
    """,
    # what from_turns() makes of the table, by its rules; each call there needs one other at most, so a level is the weight of one path
    "op8_tool_calls": """
        WITH RECURSIVE t AS (SELECT conv_id, turn, role, CAST(to_json(coalesce(text, '')) AS VARCHAR) AS q, ((7 * conv_id + turn) % 13 + 13) % 13 AS k FROM conversations),
        calls AS (SELECT conv_id, turn, 'c' || CASE WHEN role = 'user' AND k = 4 AND turn >= 2 THEN turn - 2 ELSE turn END AS call_id,
                         CASE WHEN role = 'user' AND k = 6 THEN 'guess' WHEN role = 'user' THEN 'reply' ELSE 'configure' END AS name,
                         CASE WHEN role = 'user' AND k <> 5 THEN CASE WHEN k = 3 THEN turn + 2 WHEN k = 7 THEN turn WHEN turn >= 2 THEN turn - 2 END END AS refer, k, role, q
                  FROM t WHERE role IS DISTINCT FROM 'assistant'),
        made AS (SELECT *, CASE WHEN role = 'user' AND k = 5 THEN q WHEN role = 'user' THEN '{' || coalesce('"context":"{{c' || refer || '}}",', '') || CASE WHEN k = 2 THEN '"guess":true,' ELSE '' END ||
                                     CASE WHEN k <> 1 THEN '"text":' || q || ',' ELSE '' END || '"turn":' || CASE WHEN k = 0 THEN '"' || turn || '"' ELSE CAST(turn AS VARCHAR) END || '}'
                                ELSE '{"text":' || q || '}' END AS args,
                           CASE WHEN role IS DISTINCT FROM 'user' THEN '' WHEN k = 0 THEN 'type of turn' WHEN k = 1 THEN 'missing text' WHEN k = 2 THEN 'unknown guess' WHEN k = 5 THEN 'not JSON' WHEN k = 6 THEN 'unknown tool' ELSE '' END AS faults FROM calls),
        first AS (SELECT conv_id, call_id, min(turn) AS turn, arg_min(name, turn) AS name FROM made GROUP BY conv_id, call_id),
        needs AS (SELECT f.conv_id, f.call_id, f.turn, m.refer FROM first f JOIN made m USING (conv_id, call_id, turn)),
        walk(conv_id, call_id, place, refer, w, steps) AS (
            SELECT conv_id, call_id, turn, refer, 0, 0 FROM needs
            UNION ALL
            SELECT a.conv_id, a.call_id, n.turn, n.refer, a.w + CASE WHEN n.turn >= a.place THEN 1 ELSE 0 END, a.steps + 1
            FROM walk a JOIN needs n ON n.conv_id = a.conv_id AND n.call_id = 'c' || a.refer WHERE a.steps < 200),
        level AS (SELECT conv_id, call_id, CASE WHEN max(steps) < 200 THEN max(w) END AS level FROM walk GROUP BY conv_id, call_id),
        results AS (SELECT conv_id, turn, CASE WHEN k = 9 THEN 'none' ELSE 'c' || (turn - 1) END AS call_id, q FROM t WHERE role = 'assistant'),
        answer AS (SELECT f.conv_id, f.call_id, min(r.turn) AS result_turn FROM results r JOIN first f USING (conv_id, call_id) WHERE r.turn > f.turn GROUP BY f.conv_id, f.call_id)
        SELECT m.conv_id, m.call_id, m.name, 'call' AS kind, CASE WHEN m.turn = f.turn THEN CAST(l.level AS BIGINT) END AS level, m.turn, 0 AS nth, CASE WHEN m.turn = f.turn THEN a.result_turn END AS result_turn,
               CASE WHEN m.turn <> f.turn THEN 'repeated' WHEN l.level IS NULL THEN 'circular' WHEN a.result_turn IS NULL THEN 'open' ELSE 'answered' END AS status, m.faults,
               '{"arguments":' || m.args || ',"id":"' || m.call_id || '","name":"' || m.name || '"}' AS json
        FROM made m JOIN first f USING (conv_id, call_id) JOIN level l USING (conv_id, call_id) LEFT JOIN answer a USING (conv_id, call_id)
        UNION ALL
        SELECT r.conv_id, r.call_id, f.name, 'result', CASE WHEN r.turn = a.result_turn THEN CAST(l.level AS BIGINT) END, CASE WHEN r.turn = a.result_turn THEN f.turn ELSE r.turn END, 0, r.turn,
               CASE WHEN r.turn = a.result_turn THEN 'linked' WHEN r.turn > f.turn THEN 'repeated' ELSE 'orphan' END, '', '{"content":' || r.q || ',"tool_call_id":"' || r.call_id || '"}'
        FROM results r LEFT JOIN first f USING (conv_id, call_id) LEFT JOIN level l USING (conv_id, call_id) LEFT JOIN answer a USING (conv_id, call_id)
    """,
    # the pattern rules, one after another, are the method's; host rules come first, the longest of them
    "op9_url_rules": f"""
        WITH cut AS (SELECT page_id, url, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
        parts AS (SELECT page_id, url, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path,
                         translate(coalesce(url, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS low FROM cut),
        ruled AS (SELECT *, CASE
            WHEN (host = 'example.net' OR host LIKE '%.example.net') AND path LIKE '/en/%' THEN 'example.net/en/'
            WHEN (host = 'example.com' OR host LIKE '%.example.com') AND path LIKE '/de/%' THEN 'example.com/de/'
            WHEN (host = 'org' OR host LIKE '%.org') AND path LIKE '/fr/%' THEN 'org/fr/'
            WHEN (host = 'net' OR host LIKE '%.net') AND path LIKE '/%' THEN 'net/' END AS rule,
            CASE {" ".join(f"WHEN low LIKE '%{p.replace('_', chr(92) + '_').replace('*', '%')}%' ESCAPE '{chr(92)}' THEN '{p}'" for p in sorted(urlfilter.PATTERNS))} END AS found FROM parts)
        SELECT page_id, host, path, rule,
               CASE WHEN rule IN ('example.net/en/', 'org/fr/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block' WHEN found IS NOT NULL THEN 'block' ELSE 'allow' END AS verdict,
               CASE WHEN rule IS NULL THEN found END AS pattern
        FROM ruled
    """,
}
