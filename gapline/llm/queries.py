"""Registered queries of the operators in this package, one `opN_<name>` each, and their SQL checks."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from gapline.llm import chat, decontaminate, line_dedup, merkle, minhash, phrases, quality, secret_scan, sentencepiece_bridge, sharding, simhash, substring_dedup, token_files
from gapline.llm.common import Steps, prepare, table
from gapline.session import configure

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(prepare(configure(spark)), sf_dir)

        QUERIES[fn.__name__] = run
        if sql:
            SQL[fn.__name__] = sql
        return fn

    return add


@query("""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
), e AS (
  SELECT *, role = 'assistant' AS loss,
    regexp_replace(regexp_replace(text, '<(\\\\*/?s>)', '<\\\\\\1', 'g'), '\\[(\\\\*/?INST\\])', '[\\\\\\1', 'g') AS esc
  FROM t
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (WHERE loss), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE loss), '')) AS loss_sha256,
  sum(length(esc) + CASE WHEN loss THEN 7 ELSE 14 + length(role) END)::BIGINT AS formatted_chars,
  count(*) FILTER (WHERE esc <> text) AS escaped_turns,
  count(*) FILTER (WHERE loss) AS loss_spans
FROM e GROUP BY conv_id
""")
def op8_chat_round_trip(spark, sf_dir):
    """All conversations and one with control strings in its texts, formatted and read back."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = F.lit("</s>[INST] ok [/INST]")
    extra = spark.range(2).select(
        F.lit(-7).cast("bigint").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), said.alias("text"),
    )
    return chat.read_back(chat.format_conversations(turns.unionByName(extra)))


@query()
def op2_shards(spark, sf_dir):
    """Sixteen shards of near equal bytes; equal texts stay together."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    rows = sharding.shard(Steps(spark), docs, leaves=16)
    return rows.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


@query(r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, coalesce(source, '') AS owner, coalesce(lang, '') AS lang FROM documents),
p AS (
  SELECT 0 AS k, '(?i:password|passwd|secret|token|api_?key)["'']?\x20*[:=]\x20*["'']?[A-Za-z0-9+/_.=-]+' AS pat
  UNION ALL SELECT 1, 'AKIA[A-Z0-9]+' UNION ALL SELECT 2, '[0-9a-f]+' UNION ALL SELECT 3, '[A-Za-z0-9+/_-]+'
), m AS (
  SELECT doc_id, owner, lang, k, regexp_extract_all(text, pat) AS ms, string_split_regex(text, pat) AS gs FROM d, p
), f AS (
  SELECT doc_id, owner, lang, k, unnest(ms) AS s, unnest(gs[:len(ms)]) AS g, generate_subscripts(ms, 1) AS i FROM m WHERE len(ms) > 0
), o AS (
  SELECT *, length(g) + coalesce(sum(length(g) + length(s)) OVER (PARTITION BY doc_id, k ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS a,
    CASE WHEN k = 0 THEN regexp_extract(s, '^[A-Za-z_]+["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)$', 1) ELSE s END AS v
  FROM f
), c AS (
  SELECT *, len(list_distinct(string_split(v, ''))) >= 8 AND length(v) >= 16 AS live FROM o
  WHERE CASE k WHEN 0 THEN length(v) >= 6 WHEN 1 THEN length(s) >= 20 WHEN 2 THEN length(s) >= 24
    ELSE length(s) >= 16 AND regexp_matches(s, '[0-9]') AND regexp_matches(s, '[A-Za-z]') END
), w AS (SELECT v AS value, count(DISTINCT owner) AS owners FROM c GROUP BY v),
r AS (
  SELECT doc_id, k, a::BIGINT AS a, live AND owners <= 2 AS own,
    ['assign', 'access', 'hex', 'owned'][k + 1] || ':' || a::BIGINT || ':' || (a + length(s))::BIGINT AS t
  FROM c JOIN w ON value = v WHERE k < 3 OR (live AND owners <= 2)
), g AS (
  SELECT doc_id, count(*) FILTER (WHERE k = 0) AS n_assign, count(*) FILTER (WHERE k = 1) AS n_access, count(*) FILTER (WHERE k = 2) AS n_hex,
    string_agg(t, ',' ORDER BY a, k) FILTER (WHERE k < 3) AS base, string_agg(t, ',' ORDER BY a, k) AS spans,
    count(*) FILTER (WHERE k = 3) AS n_owned, count(*) FILTER (WHERE k < 3 AND own) AS n_live_base
  FROM r GROUP BY doc_id
)
SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(n_owned, 0) AS n_owned, coalesce(n_live_base, 0) AS n_live_base
FROM d LEFT JOIN g USING (doc_id)
""")
def op9_secret_ownership(spark, sf_dir):
    """Secrets of all documents, with owner-specific tokens added."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source", "lang")
    return secret_scan.per_document(secret_scan.scan(Steps(spark), docs))


@query(r"""
WITH l AS (SELECT doc_id, text, string_split(text, chr(10)) AS lines FROM documents WHERE text IS NOT NULL),
w AS (
  SELECT doc_id, i - 1 AS pos, lines[i:i + 2] AS win
  FROM (SELECT doc_id, lines, unnest(range(1, len(lines) - 1)) AS i FROM l WHERE len(lines) >= 3)
  WHERE regexp_matches(array_to_string(lines[i:i + 2], ''), '[^\x20\x09-\x0D]')
), r AS (SELECT *, row_number() OVER (PARTITION BY win ORDER BY doc_id, pos) AS nth FROM w),
gone AS (SELECT DISTINCT doc_id, pos + k AS pos FROM r, (SELECT unnest([0, 1, 2]) AS k) WHERE nth > 1),
x AS (SELECT doc_id, line, i - 1 AS pos FROM (SELECT doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) AS i FROM l)),
kept AS (SELECT doc_id, string_agg(line, chr(10) ORDER BY pos) AS text, count(*) AS n FROM x ANTI JOIN gone USING (doc_id, pos) GROUP BY doc_id)
SELECT d.doc_id, len(l.lines) AS n_lines, len(l.lines) - coalesce(k.n, 0) AS n_removed, coalesce(k.text, '') AS text
FROM documents d JOIN l USING (doc_id) LEFT JOIN kept k USING (doc_id)
""")
def op5_line_windows(spark, sf_dir):
    """All documents without the later occurrences of repeated three-line windows."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    rows = line_dedup.dedup_lines(Steps(spark), docs)
    return rows.select("doc_id", "lines.n_lines", "lines.n_removed", "text")


@query(r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents
), b AS (
  SELECT item_id::VARCHAR AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark
), bw AS (
  SELECT DISTINCT item, len(w[i:i + 12]) AS n, array_to_string(w[i:i + 12], ' ') AS win
  FROM (SELECT item, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS i FROM b WHERE len(w) > 0)
), sizes AS (SELECT DISTINCT n FROM bw),
dw AS (
  SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS win
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, sizes WHERE len(w) >= n)
), h AS (SELECT doc_id, item, i, n FROM dw JOIN bw USING (n, win)),
hits AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM h) GROUP BY doc_id),
items AS (SELECT doc_id, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS names FROM h GROUP BY doc_id)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN hits USING (doc_id) LEFT JOIN items USING (doc_id)
""")
def op7_benchmark_overlap(spark, sf_dir):
    """Benchmark windows in all documents, by a suffix automaton of the items."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    rows = decontaminate.mark(docs, table(spark, sf_dir, "benchmark"))
    hit = decontaminate.n_hit(F.col("found"))
    return rows.select(
        "doc_id", "found.n_words", hit.alias("n_hit"), F.size("found.items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("found.items", ","), 256).alias("items_sha256"),
        decontaminate.contaminated(F.col("found"), hit).alias("contaminated"),
    )


@query()
def op6_risk_controlled_rules(spark, sf_dir):
    """Counts of all documents and the verdict of base rules and risk-controlled cutoffs."""
    docs = table(spark, sf_dir, "documents")
    steps = Steps(spark)
    slim = docs.select("doc_id", "text", quality.stratum_of(docs).alias("stratum"))
    measured = steps.store(quality.measure(slim, "m").select("doc_id", "stratum", "m"))
    limits = steps.store(quality.cutoffs(measured, table(spark, sf_dir, "labels")))
    rows = quality.judge(measured, limits, F.col("stratum"), F.col("m"), "rules")
    return rows.select(
        "doc_id", "m.n_words", "m.word_chars", "m.n_symbols", "m.n_dup_lines", "m.n_repeat_words",
        quality.base_failed(F.col("m")).alias("base_failed"), (F.size("rules") == 0).alias("kept"), F.array_join("rules", ",").alias("rules"),
    )


@query()
def op3_simhash_components(spark, sf_dir):
    """Fingerprint and near-duplicate component of every document."""
    rows = simhash.near_duplicates(Steps(spark), table(spark, sf_dir, "documents").select("doc_id", "text"))
    return rows.select("doc_id", simhash.fingerprint_text(F.col("fp")).alias("fingerprint"), "component_id")


@query()
def op4_token_files(spark, sf_dir):
    """Token-id files of all documents, written and read back."""
    steps = Steps(spark)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    token_files.write(spark, docs, f"{steps.folder}/tokens", public_tokenizers.path("byte_bpe_50k.json"))
    return token_files.read_index(spark, f"{steps.folder}/tokens")


@query()
def op10_sentencepiece_bridge(spark, sf_dir):
    """All documents encoded and decoded by the rebuilt SentencePiece model."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    rows = sentencepiece_bridge.encode(docs, "pieces", public_tokenizers.path("piece_bpe_32k.model"))
    return rows.select("doc_id", "pieces.*")


@query()
def op1_repeated_passages(spark, sf_dir):
    """Class and repeated passages of every document."""
    return substring_dedup.classes(Steps(spark), table(spark, sf_dir, "documents").select("doc_id", "text"))


@query(r"""
WITH RECURSIVE x AS (
  SELECT *, coalesce('1' || lang, '0') AS g, coalesce(strlen(doc_id::VARCHAR)::VARCHAR || ':' || doc_id, '-') || coalesce(strlen(source)::VARCHAR || ':' || source, '-')
      || coalesce(strlen(lang)::VARCHAR || ':' || lang, '-') AS head,
    coalesce(strlen(text)::VARCHAR || ':' || text, '-') AS tail, doc_id::VARCHAR AS s
  FROM documents
), l AS (
  SELECT doc_id, g, sha256(head || coalesce(strlen(n_chars::VARCHAR)::VARCHAR || ':' || n_chars, '-') || tail) AS leaf,
    CASE WHEN xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, length(s) + 1), lambda i: ascii(s[i])::BIGINT)),
        lambda a, c: list_reduce(list_prepend(xor(a, c), range(8)), lambda b, i: xor(b >> 1, 3988292384 * (b & 1))))) % 7 = 0
      THEN sha256(head || coalesce(strlen((n_chars + 1)::VARCHAR)::VARCHAR || ':' || (n_chars + 1), '-') || tail) END AS bad
  FROM x
), r AS (
  SELECT *, row_number() OVER () AS id, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY g) AS n FROM l
), t AS (
  SELECT 0 AS lvl, g, pos, n, leaf AS h FROM r
  UNION ALL SELECT lvl + 1, g, pos // 2, (n + 1) // 2, sha256(string_agg(h, '' ORDER BY pos)) FROM t WHERE n > 1 GROUP BY lvl, g, pos // 2, n
), f AS (
  SELECT id, 0 AS lvl, g, pos, n, coalesce(bad, leaf) AS h, '' AS sibs FROM r
  UNION ALL
  SELECT f.id, f.lvl + 1, f.g, f.pos // 2, (f.n + 1) // 2,
    sha256(CASE WHEN f.pos % 2 = 1 THEN t.h ELSE '' END || f.h || CASE WHEN f.pos % 2 = 0 THEN coalesce(t.h, '') ELSE '' END), f.sibs || coalesce(t.h, '')
  FROM f LEFT JOIN t ON t.g = f.g AND t.lvl = f.lvl AND t.pos = xor(f.pos, 1) WHERE f.n > 1
), u AS (
  SELECT 0 AS lvl, g, row_number() OVER (ORDER BY g) - 1 AS pos, count(*) OVER () AS n, h FROM t WHERE n = 1
), v AS (
  SELECT lvl, pos, n, h FROM u
  UNION ALL SELECT lvl + 1, pos // 2, (n + 1) // 2, sha256(string_agg(h, '' ORDER BY pos)) FROM v WHERE n > 1 GROUP BY lvl, pos // 2, n
), w AS (
  SELECT f.id, 0 AS lvl, u.pos, u.n, f.h, f.sibs, u.h AS subroot FROM f JOIN u USING (g) WHERE f.n = 1
  UNION ALL
  SELECT w.id, w.lvl + 1, w.pos // 2, (w.n + 1) // 2,
    sha256(CASE WHEN w.pos % 2 = 1 THEN v.h ELSE '' END || w.h || CASE WHEN w.pos % 2 = 0 THEN coalesce(v.h, '') ELSE '' END), w.sibs || coalesce(v.h, ''), w.subroot
  FROM w LEFT JOIN v ON v.lvl = w.lvl AND v.pos = xor(w.pos, 1) WHERE w.n > 1
)
SELECT doc_id, leaf, subroot, v.h AS root, sha256(sibs) AS proof_sha256, w.h AS folded_root, w.h = v.h AS verified
FROM r JOIN w USING (id) JOIN v ON v.n = 1 WHERE w.n = 1
""")
def op12_merkle_manifest(spark, sf_dir):
    """Leaf, subroot, root and proof of every document, checked after tampering with some."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "n_chars", "text")
    return merkle.audit(merkle.manifest(Steps(spark), merkle.document_leaves(docs)))


@query(r"""
WITH p AS (
  SELECT d.i, generate_subscripts(d.ps, 1) AS j, d.lang, unnest(d.ps) AS piece
  FROM (
    SELECT row_number() OVER () AS i, coalesce(lang, 'und') AS lang,
      string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]') AS ps
    FROM documents
  ) d
), w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM p),
g AS (
  SELECT lang, m, w[s:s + m - 1] AS ws, count(*) AS f
  FROM (SELECT lang, w, m, unnest(range(1, len(w) - m + 2)) AS s FROM w, (SELECT unnest([1, 2, 3, 4]) AS m) WHERE len(w) >= m) GROUP BY ALL
), n AS (SELECT lang, sum(f)::BIGINT AS n FROM g WHERE m = 1 GROUP BY lang),
c AS (SELECT lang, m, ws, f AS a FROM g WHERE m >= 2 AND f >= 30),
k AS (
  SELECT c.*, k, x.f AS l, y.f AS r, (2000000::HUGEINT * a // (x.f::HUGEINT + y.f))::BIGINT AS score
  FROM (SELECT *, unnest(range(1, m)) AS k FROM c) c
  JOIN g x ON x.lang = c.lang AND x.ws = c.ws[1:k] JOIN g y ON y.lang = c.lang AND y.ws = c.ws[k + 1:]
), s AS (SELECT * FROM k QUALIFY row_number() OVER (PARTITION BY lang, ws ORDER BY score, k) = 1),
parts AS (SELECT lang, b, f, ws[i:i + b - 1] AS ws FROM (SELECT lang, ws, a AS f, b, unnest(range(1, m - b + 2)) AS i FROM c, (SELECT unnest([2, 3]) AS b) WHERE b < m)),
kept AS (SELECT s.* FROM s WHERE NOT EXISTS (FROM parts q WHERE q.lang = s.lang AND q.ws = s.ws AND 100 * q.f >= 80 * s.a)),
o AS (SELECT lang, array_to_string(ws, ' ') AS phrase, a, l, r, score FROM kept)
SELECT lang, rank, phrase, a, l, r, n, score
FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM o) JOIN n USING (lang) WHERE rank <= 2000
""")
def op11_collocations(spark, sf_dir):
    """The best 2,000 phrases of every language in all documents."""
    return phrases.mine(Steps(spark), table(spark, sf_dir, "documents").select("text", "lang"))


@query(r"""
WITH RECURSIVE d AS (
  SELECT row_number() OVER () AS i, doc_id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents
), s AS (
  SELECT DISTINCT i, array_to_string(w[k:k + 2], ' ') AS s FROM (SELECT i, w, unnest(range(1, greatest(len(w) - 2, 1) + 1)) AS k FROM d WHERE len(w) > 0)
), n AS (SELECT i, count(*) AS n FROM s GROUP BY i),
c AS (SELECT a.i AS a, b.i AS b, count(*) AS c FROM s a JOIN s b ON a.s = b.s AND a.i < b.i GROUP BY ALL),
e AS (SELECT a, b FROM c JOIN n x ON x.i = a JOIN n y ON y.i = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
g AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
r AS (SELECT i AS a, i AS b FROM d UNION SELECT r.a, g.b FROM r JOIN g ON g.a = r.b),
m AS (SELECT r.a AS i, min(d.doc_id) AS component_id FROM r JOIN d ON d.i = r.b GROUP BY r.a)
SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id, doc_id IS NOT DISTINCT FROM component_id AS kept FROM d JOIN m USING (i) LEFT JOIN n USING (i)
""")
def op13_minhash_components(spark, sf_dir):
    """Near-duplicate component of every document by its three-word shingles."""
    rows = minhash.near_duplicates(Steps(spark), table(spark, sf_dir, "documents").select("doc_id", "text"))
    return rows.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))
