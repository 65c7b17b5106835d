"""The registered queries of the subpackage and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ship_package
from . import ann, collocations, decontamination, jaccard, language_id, line_dedup, lm_scoring, mixing, periodic_runs, secret_scan, sharding, substring_dedup, token_files


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return ship_package(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = line_dedup.drop_repeated_lines(_table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_records(_table(spark, sf_dir, "documents"), 24)


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_plan(_table(spark, sf_dir, "documents"))


def op1_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(_table(spark, sf_dir, "embeddings"), F.col("id") % 100 == 0)


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.contaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    held_out = F.pmod(lm_scoring.id_crc(F.col("doc_id")), F.lit(5)) == 0
    model = language_id.train(docs, ~held_out)
    return language_id.identify(docs, model, held_out).select("doc_id", "held_out", "lang_pred", "score", "rejected")


def op5_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return lm_scoring.score_texts(docs, F.pmod(lm_scoring.id_crc(F.col("doc_id")), F.lit(7)) == 2)


def op8_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.json")  # the same on every machine
    return token_files.read_index(token_files.write_ids(_table(spark, sf_dir, "documents"), path, end=2))


def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.link_components(_table(spark, sf_dir, "documents"), k=3, num=90, den=100)


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = substring_dedup.drop_repeated_substrings(_table(spark, sf_dir, "documents"), window=50)
    return kept.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    found = periodic_runs.collapse_runs(docs.select("doc_id", periodic_runs.looped(F.col("text"), F.col("doc_id")).alias("text")))
    best = found.withColumn("best", periodic_runs.strongest(F.col("runs")))
    return best.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period",
        F.floor(F.lit(1000) * F.col("best.length") / F.col("best.period")).cast("long").alias("exponent_milli"),
        periodic_runs.run_digest(F.col("runs")).alias("runs_sha256"), F.sha2(F.col("kept").cast("binary"), 256).alias("collapsed_sha256"),
    )


def op12_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.find_secrets(_table(spark, sf_dir, "documents"))
    listed = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))), ",")
    of = lambda *kinds: F.filter("spans", lambda s: s["kind"].isin(*kinds))
    counts = [F.size(of(kind)).cast("long").alias(f"n_{kind}") for kind in secret_scan.BASE_KINDS]
    return found.select("doc_id", *counts, F.sha2(listed(of(*secret_scan.BASE_KINDS)).cast("binary"), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(_table(spark, sf_dir, "documents"))


OP3_SQL = r"""
WITH words AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), starts AS (
  SELECT doc_id, i, md5(array_to_string(w[i:i + 49], ' ')) AS h FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM words WHERE len(w) >= 50)
), firsts AS (SELECT h, min(doc_id) AS low FROM starts GROUP BY h HAVING min(doc_id) < max(doc_id)),
hits AS (
  SELECT DISTINCT starts.doc_id, i + k AS p FROM starts JOIN firsts USING (h), (SELECT unnest(range(50)) AS k) WHERE starts.doc_id > low
), flat AS (
  SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS p FROM words
), kept AS (
  SELECT flat.doc_id, string_agg(word, ' ' ORDER BY flat.p) AS text, count(*) AS n
  FROM flat LEFT JOIN hits ON flat.doc_id = hits.doc_id AND flat.p = hits.p WHERE hits.p IS NULL GROUP BY flat.doc_id
)
SELECT words.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(text, '')) AS kept_sha256
FROM words LEFT JOIN kept ON words.doc_id = kept.doc_id
"""

OP6_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), shingles AS (
  SELECT DISTINCT doc_id, s FROM (
    SELECT doc_id, unnest(CASE WHEN len(w) >= 3 THEN list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i + 2], ' '))
                               WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s FROM words)
), sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
pairs AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL
), links AS (
  SELECT x, y FROM pairs JOIN sizes p ON p.doc_id = x JOIN sizes q ON q.doc_id = y WHERE 100 * c >= 90 * (p.n + q.n - c)
), both_ways AS (SELECT x, y FROM links UNION SELECT y, x FROM links),
reach AS (SELECT doc_id AS x, doc_id AS z FROM documents UNION SELECT reach.x, both_ways.y FROM reach JOIN both_ways ON both_ways.x = reach.z)
SELECT documents.doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, component_id
FROM documents LEFT JOIN sizes ON sizes.doc_id = documents.doc_id
JOIN (SELECT x, min(z) AS component_id FROM reach GROUP BY x) r ON r.x = documents.doc_id
"""

OP7_SQL = r"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
  FROM documents
), keyed AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM lines
), frequent AS (
  SELECT k, max(doc_id) AS holder FROM keyed WHERE length(k) >= 40 GROUP BY k HAVING count(DISTINCT doc_id) >= 5
), judged AS (
  SELECT keyed.*, frequent.holder IS NOT NULL AND frequent.holder <> doc_id AS gone
  FROM keyed LEFT JOIN frequent ON keyed.k = frequent.k
)
SELECT doc_id, CAST(count(*) AS BIGINT) AS n_lines, CAST(count(*) FILTER (WHERE gone) AS BIGINT) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM judged GROUP BY doc_id
"""

OP11_SQL = r"""
WITH hashed AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
         xor(4294967295, list_reduce(
           list_prepend(CAST(4294967295 AS BIGINT), flatten(list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: [CAST(ascii(c) AS BIGINT), -1, -1, -1, -1, -1, -1, -1, -1]))),
           lambda crc, x: CASE WHEN x >= 0 THEN xor(crc, x) ELSE xor(crc >> 1, (crc & 1) * 3988292384) END)) AS h
  FROM documents
), sized AS (SELECT doc_id, w, len(w) AS n, h % 10 = 0 AND len(w) > 0 AS looped, h // 10 AS g FROM hashed),
tails AS (SELECT *, CASE WHEN looped THEN g % n ELSE n END AS a FROM sized),
texts AS (
  SELECT doc_id, n, CASE WHEN looped THEN list_transform(range(n), lambda i: w[1 + CASE WHEN i < a THEN i ELSE a + (i - a) % (1 + (n - a) // (3 + g % 8)) END]) ELSE w END AS w FROM tails
), flat AS (SELECT doc_id, n, unnest(w) AS word, generate_subscripts(w, 1) - 1 AS i FROM texts),
agree AS (
  SELECT x.doc_id, y.i - x.i AS p, x.i FROM flat x JOIN flat y ON x.doc_id = y.doc_id AND x.word = y.word AND y.i > x.i WHERE 3 * (y.i - x.i) <= x.n
), islands AS (
  SELECT doc_id, p, min(i) AS start, count(*) + p AS length FROM (SELECT *, i - row_number() OVER (PARTITION BY doc_id, p ORDER BY i) AS island FROM agree) GROUP BY doc_id, p, island
), runs AS (SELECT doc_id, start, length, min(p) AS period FROM islands WHERE length >= greatest(24, 3 * p) GROUP BY ALL),
best AS (SELECT doc_id, start, length, period FROM runs QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY CAST(length AS DOUBLE) / period DESC, start, period) = 1),
listed AS (SELECT doc_id, count(*) AS n_runs, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS lines FROM runs GROUP BY doc_id),
gone AS (SELECT DISTINCT doc_id, unnest(range(start + period, start + length)) AS i FROM runs),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS text FROM flat ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id)
SELECT doc_id, CAST(coalesce(n_runs, 0) AS BIGINT) AS n_runs, CAST(start AS BIGINT) AS start, CAST(length AS BIGINT) AS length, CAST(period AS BIGINT) AS period,
       CAST(1000 * length // period AS BIGINT) AS exponent_milli, sha256(coalesce(lines, '')) AS runs_sha256, sha256(coalesce(kept.text, '')) AS collapsed_sha256
FROM texts LEFT JOIN best USING (doc_id) LEFT JOIN listed USING (doc_id) LEFT JOIN kept USING (doc_id)
"""


def _op12_sql() -> str:
    """The base patterns by their matches and the gaps between them, windows counted one by one."""
    either = lambda word: "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in word)
    words = "|".join(["password", "passwd", "secret", "token", "api_?key"])
    assign = f"({either(words)})[\"'']?\\x20*[:=]\\x20*[\"'']?([A-Za-z0-9+/_.=-]+)"
    found = "UNION ALL".join(
        f"""
  SELECT *, {least} AS ok
  FROM (SELECT doc_id, {k} AS o, '{kind}' AS kind, unnest(string_split_regex(t, '{pattern}')) AS gap, unnest(regexp_extract_all(t, '{pattern}')) AS m, generate_subscripts(string_split_regex(t, '{pattern}'), 1) AS k FROM docs)
"""
        for k, (kind, pattern, least) in enumerate(
            [
                ("assign", assign, f"len(regexp_extract(m, '{assign}', 2)) >= {secret_scan.ASSIGN_CHARS}"),
                ("access", "AKIA[A-Z0-9]+", f"len(m) >= {secret_scan.ACCESS_CHARS}"),
                ("hex", "[0-9a-f]+", f"len(m) >= {secret_scan.HEX_CHARS}"),
                *((c.kind, f"[{c.chars.replace('-', '')}{'-' if '-' in c.chars else ''}]+", f"len(m) >= {c.window} AND " + " AND ".join(f"NOT regexp_full_match(m, '{p}')" for p in secret_scan.ALLOWED)) for c in secret_scan.CLASSES),
            ]
        )
    )
    window = lambda value: " ".join(f"WHEN {k} THEN {value(c)}" for k, c in enumerate(secret_scan.CLASSES, 3))
    return f"""
WITH docs AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
found AS ({found}),
placed AS (SELECT *, CAST(sum(len(gap) + coalesce(len(m), 0)) OVER (PARTITION BY doc_id, o ORDER BY k) - coalesce(len(m), 0) AS BIGINT) AS start FROM found),
hits AS (SELECT doc_id, o, kind, m, start FROM placed WHERE m IS NOT NULL AND ok),
base AS (SELECT doc_id, o, kind, start, start + len(m) AS stop FROM hits WHERE o < 3),
runs AS (SELECT *, CASE o {window(lambda c: c.window)} END AS width, CASE o {window(lambda c: c.limit())} END AS most, CASE o {window(lambda c: c.table().tolist())} END AS costs FROM hits WHERE o >= 3),
letters AS (
  SELECT doc_id, o, start, i, width, most, costs, ch, count(*) AS c
  FROM (SELECT *, unnest(string_split(substr(m, CAST(i + 1 AS INTEGER), width), '')) AS ch FROM (SELECT *, unnest(range(len(m) - width + 1)) AS i FROM runs)) GROUP BY ALL
), high AS (SELECT doc_id, o, start, i, width FROM letters GROUP BY ALL HAVING sum(costs[c + 1]) <= min(most)),
parts AS (SELECT *, sum(fresh) OVER (PARTITION BY doc_id, o, start ORDER BY i) AS part FROM (SELECT *, CASE WHEN i - lag(i) OVER (PARTITION BY doc_id, o, start ORDER BY i) <= width THEN 0 ELSE 1 END AS fresh FROM high)),
dense AS (SELECT doc_id, o, CASE o {window(lambda c: f"'{c.kind}'")} END AS kind, start + min(i) AS start, start + max(i) + min(width) AS stop FROM parts GROUP BY doc_id, o, parts.start, part),
spans AS (
  FROM base UNION ALL FROM dense WHERE NOT EXISTS (FROM base WHERE base.doc_id = dense.doc_id AND base.start <= dense.start AND dense.stop <= base.stop)
), told AS (
  SELECT doc_id, count(*) FILTER (WHERE o = 0) AS n_assign, count(*) FILTER (WHERE o = 1) AS n_access, count(*) FILTER (WHERE o = 2) AS n_hex,
         string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, o) FILTER (WHERE o < 3) AS base, string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, o) AS spans
  FROM spans GROUP BY doc_id
)
SELECT doc_id, CAST(coalesce(n_assign, 0) AS BIGINT) AS n_assign, CAST(coalesce(n_access, 0) AS BIGINT) AS n_access, CAST(coalesce(n_hex, 0) AS BIGINT) AS n_hex,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM documents LEFT JOIN told USING (doc_id)
"""

OP13_SQL = r"""
WITH pieces AS (
  SELECT lang, row_number() OVER () AS piece, regexp_extract_all(p, '[^\x20\x09]+') AS w
  FROM (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS p FROM documents)
), flat AS (SELECT lang, piece, unnest(w) AS w1, generate_subscripts(w, 1) AS i FROM pieces),
rows3 AS (
  SELECT lang, w1, lead(w1) OVER line AS w2, lead(w1, 2) OVER line AS w3 FROM flat WINDOW line AS (PARTITION BY piece ORDER BY i)
), one AS (SELECT lang, w1, count(*) AS f FROM rows3 GROUP BY ALL),
two AS (SELECT lang, w1, w2, count(*) AS f FROM rows3 WHERE w2 IS NOT NULL GROUP BY ALL HAVING count(*) >= 10),
three AS (SELECT lang, w1, w2, w3, count(*) AS f FROM rows3 WHERE w3 IS NOT NULL GROUP BY ALL HAVING count(*) >= 10),
totals AS (SELECT lang, sum(f) AS n FROM one GROUP BY lang),
longer AS (
  SELECT lang, a AS w1, b AS w2, max(f) AS f FROM (SELECT lang, w1 AS a, w2 AS b, f FROM three UNION ALL SELECT lang, w2, w3, f FROM three) GROUP BY ALL
), cuts AS (
  SELECT two.lang, two.w1 || ' ' || two.w2 AS phrase, two.f AS a, 1 AS k, l.f AS l, r.f AS r
  FROM two JOIN one l ON l.lang = two.lang AND l.w1 = two.w1 JOIN one r ON r.lang = two.lang AND r.w1 = two.w2
  LEFT JOIN longer ON longer.lang = two.lang AND longer.w1 = two.w1 AND longer.w2 = two.w2 WHERE coalesce(100 * longer.f < 50 * two.f, true)
  UNION ALL
  SELECT three.lang, three.w1 || ' ' || three.w2 || ' ' || three.w3, three.f, 1, l.f, r.f
  FROM three JOIN one l ON l.lang = three.lang AND l.w1 = three.w1 JOIN two r ON r.lang = three.lang AND r.w1 = three.w2 AND r.w2 = three.w3
  UNION ALL
  SELECT three.lang, three.w1 || ' ' || three.w2 || ' ' || three.w3, three.f, 2, l.f, r.f
  FROM three JOIN two l ON l.lang = three.lang AND l.w1 = three.w1 AND l.w2 = three.w2 JOIN one r ON r.lang = three.lang AND r.w1 = three.w3
), scored AS (SELECT *, (CAST(1000000 AS HUGEINT) * a * a) // (CAST(l AS HUGEINT) * r) AS score FROM cuts),
lowest AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM lowest)
SELECT lang, rank, phrase, a, l, r, CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score FROM ranked JOIN totals USING (lang) WHERE rank <= 2000
"""


def queries() -> dict:
    return {
        "op1_nearest_neighbours": op1_nearest_neighbours,
        "op2_decontamination": op2_decontamination,
        "op3_substring_dedup": op3_substring_dedup,
        "op4_language_id": op4_language_id,
        "op5_lm_scoring": op5_lm_scoring,
        "op6_jaccard_join": op6_jaccard_join,
        "op7_line_dedup": op7_line_dedup,
        "op8_token_output": op8_token_output,
        "op9_sharding": op9_sharding,
        "op10_mixing": op10_mixing,
        "op11_periodic_runs": op11_periodic_runs,
        "op12_secret_scan": op12_secret_scan,
        "op13_collocations": op13_collocations,
    }


def oracle_sql() -> dict[str, str]:
    return {"op3_substring_dedup": OP3_SQL, "op6_jaccard_join": OP6_SQL, "op7_line_dedup": OP7_SQL, "op11_periodic_runs": OP11_SQL, "op12_secret_scan": _op12_sql(), "op13_collocations": OP13_SQL}
