"""The registered queries: each operator over its whole table with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontam, language, mpeg, neardup, packing, pseudonyms, secretscan, shards, tokens, toxicity, turns, urlrules, vectorcodes

#: The vocabulary file's name; its place is asked of the installed package.
VOCABULARY = "word_bpe_49k.json"
URL_RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block")]
DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path(VOCABULARY)


def held_out() -> F.Column:
    return F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4)) == 2


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = language.learn(docs.where(~held_out()))
    out = language.identify(docs.select("doc_id", held_out().alias("held_out"), "text"), model, reject=False)
    return out.select("doc_id", "held_out", "lang_pred", "score", "distance", "rejected")


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pseudonyms.pseudonymise(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.count_tokens(table(spark, sf_dir, "documents").select("doc_id", "text"), vocabulary())


def op4_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return urlrules.judge_urls(table(spark, sf_dir, "pages").select("page_id", "url"), rules).select("page_id", "host", "path", "rule", "verdict")


OP4_SQL = """
WITH cutoff AS (
  SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE NULL END AS rest FROM pages
), parts AS (
  SELECT page_id,
    CASE WHEN rest IS NULL THEN '' ELSE translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') END AS host,
    CASE WHEN rest IS NULL THEN '' ELSE regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) END AS path
  FROM cutoff
), rules(rhost, rpath, verdict) AS (
  VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'), ('com', '/fr/', 'allow'), ('com', '/de/', 'block')
), fits AS (
  SELECT page_id, rhost || rpath AS rule, verdict, row_number() OVER (PARTITION BY page_id ORDER BY length(rhost || rpath) DESC, length(rhost) DESC, verdict DESC) AS k
  FROM parts JOIN rules ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath)
)
SELECT p.page_id, p.host, p.path, f.rule, coalesce(f.verdict, 'allow') AS verdict
FROM parts p LEFT JOIN fits f ON p.page_id = f.page_id AND f.k = 1
"""


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shards.shard_by_bytes(table(spark, sf_dir, "documents"), 8)


def op7_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents"), size=4, percent=80).drop("text_hash")


def op8_mpeg_audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mpeg.text_media(table(spark, sf_dir, "documents"))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = tokens.count_tokens(table(spark, sf_dir, "documents").select("doc_id", "text"), vocabulary())
    return packing.pack(counted.select("doc_id", "n_tokens"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    marked = table(spark, sf_dir, "labels").select("doc_id", "toxic")
    model = toxicity.learn(docs, marked.where(~held_out()))
    out = toxicity.score_toxicity(docs.select("doc_id", held_out().alias("held_out"), "text"), model)
    return out.select("doc_id", "held_out", "score", "predicted", "evidence")


def op11_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = secretscan.find_secrets(docs, secretscan.learn(docs)).select("doc_id", "found")
    base = F.filter("found", lambda x: ~x["learned"])
    listed = lambda spans: F.concat_ws(",", F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))))
    counts = [F.size(F.filter("found", lambda x: x["kind"] == k)).cast("long").alias(f"n_{k}") for k in secretscan.KINDS]
    return found.select("doc_id", *counts, F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("found")).alias("spans"))


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return turns.repair(table(spark, sf_dir, "conversations"), damaged=True)


def op12_sql() -> str:
    """A recursion from a conversation's last row to its first that keeps the least (cost, audit, lines) for each of the four last roles."""
    names, after = ["", "system", "user", "assistant"], [2, 2, 3, 2]
    option = lambda cost, edit, line, to: f"{{'c': {cost} + w.b[{to + 1}].c, 'a': '{edit}' || w.b[{to + 1}].a, 't': {line} || w.b[{to + 1}].t}}"

    def row(s: int) -> str:
        to = after[s]
        kept = f"CASE WHEN NOT r.gone AND left(r.role, 1) = '{names[to][0]}' THEN {option('r.cut', 'K', 'r.line', to)} END"
        first = f", CASE WHEN NOT r.gone AND left(r.role, 1) = 's' THEN {option('r.cut', 'K', 'r.line', 1)} END" if s == 0 else ""
        given = f"CASE WHEN NOT r.gone THEN {option('2 + r.cut', 'R', f"'{names[to]}:' || r.text || chr(10)", to)} END"
        return f"list_sort([{option('3', 'D', "''", s)}, {kept}, {given}{first}], 'ASC', 'NULLS LAST')[1]"

    def inserted(s: int) -> str:
        """What may be inserted before the rest x, two rows at most: more never pay."""
        ways, to, audit, lines = [f"x[{s + 1}]"], s, "", ""
        for k in (1, 2):
            to = after[to]
            audit, lines = audit + "I", lines + f"'{names[to]}:' || chr(10) || "
            ways.append(f"{{'c': {2 * k} + x[{to + 1}].c, 'a': '{audit}' || x[{to + 1}].a, 't': {lines}x[{to + 1}].t}}")
        return f"list_sort([{', '.join(ways)}])[1]"

    return f"""
WITH RECURSIVE crc AS (
  SELECT list(list_reduce([0, 1, 2, 3, 4, 5, 6, 7], lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i) ORDER BY i) AS t FROM range(256) x(i)
), spaced AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS key FROM conversations
), keyed AS (
  SELECT conv_id, turn, role, text, xor(list_reduce(list_transform(string_split(key, ''), lambda x: CAST(ascii(x) AS BIGINT)), lambda a, x: xor(a >> 8, t[1 + (xor(a, x) & 255)]), CAST(4294967295 AS BIGINT)), 4294967295) % 20 AS k
  FROM spaced, crc
), damaged AS (
  SELECT conv_id, turn, CASE k WHEN 4 THEN 'user' ELSE role END AS role, CASE k WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text, unnest(CASE k WHEN 3 THEN [0, 1] ELSE [0] END) AS copy
  FROM keyed WHERE k <> 0
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS i, regexp_replace(text, '[ \t-\r]', '', 'g') AS bare FROM damaged
), judged AS (
  SELECT *, bare = '' AS blank, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 AS again, lag(role) OVER (PARTITION BY conv_id ORDER BY i) AS before FROM placed
), rowed AS MATERIALIZED (
  SELECT conv_id, i, turn, role, text, before, blank, again AND NOT blank AS duplicate, NOT blank AND NOT again AND right(bare, 1) NOT IN ('.', '!', '?') AS truncated, blank OR again AS gone,
    CASE WHEN right(bare, 1) IN ('.', '!', '?') THEN 0 ELSE 1 END AS cut, role || ':' || text || chr(10) AS line FROM judged
), counted AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (blank) AS blank, count(*) FILTER (duplicate) AS duplicate, count(*) FILTER (truncated) AS truncated,
    count(*) FILTER (i > 1 AND left(before, 1) || left(role, 1) NOT IN ('su', 'ua', 'au')) AS illegal, max(i) AS n FROM rowed GROUP BY conv_id
), walk(conv_id, i, b) AS (
  SELECT conv_id, n + 1, [{{'c': CAST(0 AS BIGINT), 'a': '', 't': ''}}, {{'c': 4, 'a': 'II', 't': 'user:' || chr(10) || 'assistant:' || chr(10)}}, {{'c': 2, 'a': 'I', 't': 'assistant:' || chr(10)}}, {{'c': 0, 'a': '', 't': ''}}] FROM counted
  UNION ALL
  SELECT conv_id, i, [{', '.join(inserted(s) for s in range(4))}] FROM (
    SELECT w.conv_id, r.i, [{', '.join(row(s) for s in range(4))}] AS x FROM walk w JOIN rowed r ON r.conv_id IS NOT DISTINCT FROM w.conv_id AND r.i = w.i - 1)
)
SELECT o.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
  coalesce(w.b[1].c, 0) AS cost, coalesce(w.b[1].a, '') AS audit, sha256(coalesce(left(w.b[1].t, greatest(length(w.b[1].t) - 1, 0)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN counted c ON c.conv_id IS NOT DISTINCT FROM o.conv_id LEFT JOIN walk w ON w.conv_id IS NOT DISTINCT FROM o.conv_id AND w.i = 1
"""


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = vectorcodes.compress(table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label"))
    return out.select("vec_id", "code", "error", F.col("group_error").alias("label_error"), "codebooks_sha256")


def op13_sql(parts: int = 8, entries: int = 16, rounds: int = 6) -> str:
    """The rounds unrolled: each assigns every part to its nearest entry, then moves the entries."""
    steps = [f"""kept AS MATERIALIZED (
  SELECT vec_id, label, embedding FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), cells AS MATERIALIZED (
  SELECT vec_id, (i - 1) // (n // {parts}) AS p, (i - 1) % (n // {parts}) AS i, CAST(floor(4096 * x::DOUBLE) AS BIGINT) AS x
  FROM (SELECT vec_id, len(embedding) AS n, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS i FROM kept)
), first AS MATERIALIZED (
  SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS e FROM kept ORDER BY vec_id LIMIT {entries}
), book0 AS MATERIALIZED (SELECT p, e, i, x AS c FROM cells JOIN first USING (vec_id))"""]
    for k in range(rounds + 1):
        steps.append(f"""away{k} AS MATERIALIZED (SELECT vec_id, p, e, CAST(sum((x - c) * (x - c)) AS BIGINT) AS d FROM cells JOIN book{k} USING (p, i) GROUP BY vec_id, p, e),
near{k} AS MATERIALIZED (SELECT vec_id, p, e, d FROM (SELECT *, row_number() OVER (PARTITION BY vec_id, p ORDER BY d, e) AS k FROM away{k}) WHERE k = 1)""")
        if k < rounds:
            steps.append(f"""book{k + 1} AS MATERIALIZED (
  SELECT b.p, b.e, b.i, coalesce(m.c, b.c) AS c FROM book{k} b LEFT JOIN (
    SELECT p, e, i, CAST(sum(x) AS BIGINT) // count(*) - CASE WHEN CAST(sum(x) AS BIGINT) % count(*) < 0 THEN 1 ELSE 0 END AS c
    FROM cells JOIN near{k} USING (vec_id, p) GROUP BY p, e, i) m USING (p, e, i))""")
    steps.append(f"""coded AS MATERIALIZED (SELECT vec_id, string_agg(printf('%02x', e), '' ORDER BY p) AS code, CAST(sum(d) AS BIGINT) AS error FROM near{rounds} GROUP BY vec_id)""")
    return "WITH " + ",\n".join(steps) + f"""
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
  (SELECT sha256(string_agg(CAST(c AS VARCHAR), ',' ORDER BY p, e, i)) FROM book{rounds}) AS codebooks_sha256
FROM coded JOIN kept USING (vec_id)"""


QUERIES = {
    "op1_language_id": op1_language_id,
    "op2_pii": op2_pii,
    "op3_token_counts": op3_token_counts,
    "op4_url_filters": op4_url_filters,
    "op5_decontamination": op5_decontamination,
    "op6_sharding": op6_sharding,
    "op7_near_duplicates": op7_near_duplicates,
    "op8_mpeg_audio": op8_mpeg_audio,
    "op9_packing": op9_packing,
    "op10_toxicity": op10_toxicity,
    "op11_secret_scans": op11_secret_scans,
    "op12_conversation_repair": op12_conversation_repair,
    "op13_vector_codes": op13_vector_codes,
}
ORACLES = {"op4_url_filters": OP4_SQL, "op12_conversation_repair": op12_sql(), "op13_vector_codes": op13_sql()}
