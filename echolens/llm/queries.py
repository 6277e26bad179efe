"""The registered queries of this subpackage and their SQL counterparts."""

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from echolens.llm import chat, codes, compression, decontaminate, langid, merkle, mixing, neardup, pii, rules, secrets, shinglejoin, toxicity
from echolens.llm.exprs import joined_spans

CONTROL_TEXT = "</s>[INST] ok [/INST]"


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def sha(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def op1_chat_formatting(spark, sf):
    turns = table(spark, sf, "conversations").select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text")
    extra = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"),
                                  F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(CONTROL_TEXT).alias("text"))
    back = chat.read_back(chat.windows(turns.unionByName(extra)))
    line = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select("conv_id", F.size("turns").cast("long").alias("n_turns"), sha(line).alias("turns_sha256"),
                       F.length("target").cast("long").alias("loss_chars"), sha(F.col("target")).alias("loss_sha256"), "formatted_chars", "n_windows")


def op2_quality_classifier(spark, sf):
    return compression.classify(table(spark, sf, "documents"), table(spark, sf, "labels"))


def op3_minhash_near_dedup(spark, sf):
    return neardup.near_duplicates(table(spark, sf, "documents")).select("doc_id", "class_id")


def op4_language_id(spark, sf):
    return langid.identify(table(spark, sf, "documents"))


def op5_mixing(spark, sf):
    mixed = mixing.mix(table(spark, sf, "documents").select("doc_id", "source", "text"))
    return mixed.select("doc_id", "source", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "copies")


def op6_secret_scan(spark, sf):
    found = secrets.scan(table(spark, sf, "documents"))
    base = F.filter("spans", lambda s: s["rank"] < 3)
    count = lambda rank: F.size(F.filter("spans", lambda s: s["rank"] == rank)).cast("long")
    return found.select("doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"),
                        sha(joined_spans(base)).alias("base_sha256"), joined_spans(F.col("spans")).alias("spans"))


def op7_decontamination(spark, sf):
    found = decontaminate.decontaminate(table(spark, sf, "documents"), table(spark, sf, "benchmark"))
    return found.select("doc_id", "hits.n_words", "hits.n_hit", F.size("hits.items").cast("long").alias("n_items"),
                        sha(F.array_join("hits.items", ",")).alias("items_sha256"), (F.col("hits.n_hit") > 0).alias("contaminated"))


def op8_toxicity(spark, sf):
    return toxicity.grade_documents(table(spark, sf, "documents"), table(spark, sf, "labels"))


def op9_quality_rules(spark, sf):
    judged = rules.judge(table(spark, sf, "documents"))
    failed = (F.col("n_words") < rules.LEAST_WORDS) | (100 * F.col("n_repeat_words") > rules.MOST_REPEATED * F.col("n_words"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"),
                         (~failed & (F.col("p_good") >= 0.5)).alias("kept"), "p_good")


def op10_pii(spark, sf):
    found = pii.find(table(spark, sf, "documents"))
    count = lambda rank: F.size(F.filter("strict", lambda s: s["rank"] == rank)).cast("long")
    counts = [count(i).alias(f"n_{kind}") for i, kind in enumerate(pii.KINDS)]
    return found.select("doc_id", *counts, sha(joined_spans(F.col("strict"))).alias("base_sha256"), joined_spans(F.col("spans")).alias("spans"))


def op11_merkle_manifest(spark, sf):
    return merkle.manifest(table(spark, sf, "documents"))


def op12_vector_codes(spark, sf):
    return codes.compress(table(spark, sf, "embeddings")).select("vec_id", "code", "error", "label_error", "codebooks_sha256")


def op13_ngram_jaccard_join(spark, sf):
    return shinglejoin.similar_documents(table(spark, sf, "documents"))


def pipeline(spark, sf):
    import corpus_pipeline
    return corpus_pipeline.run(spark, sf)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (
        op1_chat_formatting, op2_quality_classifier, op3_minhash_near_dedup, op4_language_id, op5_mixing, op6_secret_scan,
        op7_decontamination, op8_toxicity, op9_quality_rules, op10_pii, op11_merkle_manifest, op12_vector_codes, op13_ngram_jaccard_join, pipeline)}


#: Written out on its own, with the query's parameters: budget 1024, history of 2 turns and 128 tokens, 4 tokens and 20 characters a turn.
CHAT_SQL = r"""
WITH turns AS (
 SELECT CAST(conv_id AS BIGINT) AS conv_id, CAST(turn AS BIGINT) AS turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
 UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
sized AS (
 SELECT *, len(regexp_extract_all(text, '\p{L}{1,6}|\p{N}{1,3}|[^ \t\n\x0B\f\r\p{L}\p{N}]')) + 4 AS tokens,
  20 + length(role) + length(text) + len(regexp_extract_all(role, '[<\[]\\*(?:/?s>|/?INST\])')) + len(regexp_extract_all(text, '[<\[]\\*(?:/?s>|/?INST\])')) AS chars FROM turns),
summed AS (
 SELECT *, row_number() OVER w AS n, sum(tokens) OVER (w ROWS UNBOUNDED PRECEDING) AS upto,
  first_value(role) OVER w = 'system' AS has_system, first_value(tokens) OVER w AS system_tokens, first_value(chars) OVER w AS system_chars
 FROM sized WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)),
strides AS (SELECT *, upto - tokens AS before, greatest(1, floor((1024 - 128 - CASE WHEN has_system THEN system_tokens ELSE 0 END) / 2)) AS stride FROM summed),
long_turns AS (SELECT *, sum(CASE WHEN tokens > stride THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY n ROWS UNBOUNDED PRECEDING) AS n_long FROM strides),
places AS (SELECT *, concat(floor((upto - 1) / stride), ' ', n_long, ' ', tokens > stride) AS place FROM long_turns),
starting AS (SELECT *, CASE WHEN place IS DISTINCT FROM lag(place) OVER (PARTITION BY conv_id ORDER BY n) THEN 1 ELSE 0 END AS starts FROM places),
repeated AS (
 SELECT *, CASE WHEN has_system AND n > 1 AND starts = 1 THEN system_chars ELSE 0 END
  + CASE WHEN (has_system AND n = 1) THEN 0 ELSE
     CASE WHEN lead(starts, 1) OVER w = 1 AND lead(before, 1) OVER w - before <= 128 THEN chars ELSE 0 END
   + CASE WHEN lead(starts, 2) OVER w = 1 AND lead(before, 2) OVER w - before <= 128 THEN chars ELSE 0 END END AS more
 FROM starting WINDOW w AS (PARTITION BY conv_id ORDER BY n))
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(concat(role, chr(10), text, chr(10)), '' ORDER BY n)) AS turns_sha256,
 CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
 sha256(coalesce(string_agg(text, '' ORDER BY n) FILTER (role = 'assistant'), '')) AS loss_sha256,
 CAST(sum(chars + more) AS BIGINT) AS formatted_chars, CAST(sum(starts) AS INTEGER) AS n_windows
FROM repeated GROUP BY conv_id"""

HITS_SQL = r"""
WITH d AS (
 SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM documents),
numbered AS (SELECT row_number() OVER () AS r, * FROM d),
i AS (
 SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM benchmark),
item_at AS (SELECT item_id, words, least(10, len(words)) AS k, unnest(range(1, greatest(len(words) - 9, 1) + 1)) AS p FROM i WHERE len(words) > 0),
item_windows AS (SELECT DISTINCT item_id, k, array_to_string(words[p:p + k - 1], ' ') AS win FROM item_at),
sizes AS (SELECT DISTINCT k FROM item_windows),
doc_at AS (SELECT r, words, k, unnest(range(1, len(words) - k + 2)) AS p FROM numbered CROSS JOIN sizes WHERE len(words) >= k),
found AS (SELECT r, p, w.k, item_id FROM (SELECT r, p, k, array_to_string(words[p:p + k - 1], ' ') AS win FROM doc_at) JOIN item_windows w USING (k, win)),
hit AS (SELECT r, count(DISTINCT place) AS n_hit FROM (SELECT r, unnest(range(p, p + k)) AS place FROM found) GROUP BY r),
items AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS listed FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS item FROM found WHERE item_id IS NOT NULL) GROUP BY r)
SELECT doc_id, len(words) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(listed, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM numbered LEFT JOIN hit USING (r) LEFT JOIN items USING (r)"""


#: Trees are numbered from 1 by language; tree 0 has the languages' roots. Digests of a run are joined in order, a level at a time.
MERKLE_SQL = r"""
WITH RECURSIVE crc_table AS (
 WITH RECURSIVE bits(byte, step, c) AS (
  SELECT range, 0, range FROM range(256) UNION ALL SELECT byte, step + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM bits WHERE step < 8)
 SELECT list(c ORDER BY byte) AS t FROM bits WHERE step = 8),
docs AS (
 SELECT row_number() OVER () AS r, doc_id, n_chars, dense_rank() OVER (ORDER BY lang NULLS FIRST) AS tree,
  list_reduce(list_prepend(4294967295, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))),
   lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1])) AS c,
  concat(coalesce(strlen(CAST(doc_id AS VARCHAR)) || ':' || doc_id, '-'), coalesce(strlen(source) || ':' || source, '-'), coalesce(strlen(lang) || ':' || lang, '-')) AS head,
  coalesce(strlen(text) || ':' || text, '-') AS tail FROM documents, crc_table),
claims AS (
 SELECT *, sha256(head || coalesce(strlen(CAST(n_chars AS VARCHAR)) || ':' || n_chars, '-') || tail) AS leaf,
  CASE WHEN xor(c, 4294967295) % 7 = 0 THEN sha256(head || coalesce(strlen(CAST(n_chars + 1 AS VARCHAR)) || ':' || (n_chars + 1), '-') || tail) END AS changed FROM docs),
leaves AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY tree) AS n FROM claims),
low(tree, lvl, i, n, d) AS (
 SELECT tree, 0, i, n, leaf FROM leaves
 UNION ALL SELECT tree, any_value(lvl) + 1, i // 2, (any_value(n) + 1) // 2, sha256(string_agg(d, '' ORDER BY i)) FROM low WHERE n > 1 GROUP BY tree, i // 2),
subroots AS (SELECT tree, d AS subroot, tree - 1 AS i, count(*) OVER () AS n FROM low WHERE n = 1),
high(tree, lvl, i, n, d) AS (
 SELECT 0, 0, i, n, subroot FROM subroots
 UNION ALL SELECT 0, any_value(lvl) + 1, i // 2, (any_value(n) + 1) // 2, sha256(string_agg(d, '' ORDER BY i)) FROM high WHERE n > 1 GROUP BY i // 2),
nodes AS MATERIALIZED (SELECT tree, lvl, i, n, d FROM low WHERE n > 1 UNION ALL SELECT tree, lvl, i, n, d FROM high WHERE n > 1),
heights AS (SELECT tree, max(lvl) AS h FROM low GROUP BY tree),
places AS (
 SELECT r, s.tree, lvl, lvl AS step, l.i // CAST(2 ** lvl AS BIGINT) AS i FROM leaves l JOIN heights s USING (tree), range(64) t(lvl) WHERE lvl < h
 UNION ALL SELECT r, 0, lvl, h + lvl, (l.tree - 1) // CAST(2 ** lvl AS BIGINT) FROM leaves l JOIN heights s USING (tree), range(64) t(lvl) WHERE lvl < (SELECT max(lvl) FROM high)),
steps AS MATERIALIZED (SELECT r, step, p.i % 2 AS side, d FROM places p LEFT JOIN nodes n ON n.tree = p.tree AND n.lvl = p.lvl AND n.i = xor(p.i, 1)),
proofs AS (SELECT r, string_agg(d, '' ORDER BY step) AS proof, count(*) AS n_steps FROM steps GROUP BY r),
folds(r, step, d) AS (
 SELECT r, 0, coalesce(changed, leaf) FROM leaves
 UNION ALL SELECT f.r, f.step + 1, sha256(CASE WHEN side = 1 THEN coalesce(s.d, '') || f.d ELSE f.d || coalesce(s.d, '') END)
 FROM folds f JOIN steps s ON s.r = f.r AND s.step = f.step)
SELECT doc_id, leaf, subroot, root, sha256(coalesce(proof, '')) AS proof_sha256, f.d AS folded_root, f.d = root AS verified
FROM leaves l JOIN subroots s USING (tree) CROSS JOIN (SELECT d AS root FROM high WHERE n = 1)
LEFT JOIN proofs p ON p.r = l.r JOIN folds f ON f.r = l.r AND f.step = coalesce(n_steps, 0)"""


_NEAREST = """SELECT p.i, p.part, arg_min(b.e, list_sum(list_transform(list_zip(p.x, b.x), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) * 64 + b.e) AS e,
  min(list_sum(list_transform(list_zip(p.x, b.x), lambda z: (z[1] - z[2]) * (z[1] - z[2])))) AS d
 FROM parts p JOIN {books} b USING (part) GROUP BY p.i, p.part"""
_MOVED = """SELECT b.part, b.e, coalesce(m.x, b.x) AS x FROM {books} b LEFT JOIN (
  SELECT part, e, list(CAST(floor(total / n) AS BIGINT) ORDER BY k) AS x FROM (
   SELECT part, e, k, count(*) AS n, sum(v) AS total FROM (SELECT part, e, unnest(range(1, len(x) + 1)) AS k, unnest(x) AS v FROM {near} JOIN parts USING (i, part)) GROUP BY part, e, k)
  GROUP BY part, e) m USING (part, e)"""
#: Every part against every entry; rounds written out one after the other.
CODES_SQL = f"""
WITH kept AS (
 SELECT row_number() OVER (ORDER BY vec_id) - 1 AS i, vec_id, label, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS q FROM embeddings
 WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
parts AS MATERIALIZED (SELECT i, part, q[part * len(q) // 16 + 1:(part + 1) * len(q) // 16] AS x FROM kept, range(16) t(part)),
b0 AS MATERIALIZED (SELECT part, i AS e, x FROM parts WHERE i < 64),
n0 AS MATERIALIZED ({_NEAREST.format(books="b0")}),
b1 AS MATERIALIZED ({_MOVED.format(books="b0", near="n0")}),
n1 AS MATERIALIZED ({_NEAREST.format(books="b1")}),
b2 AS MATERIALIZED ({_MOVED.format(books="b1", near="n1")}),
n2 AS MATERIALIZED ({_NEAREST.format(books="b2")}),
coded AS (SELECT vec_id, label, string_agg(printf('%02x', e), '' ORDER BY part) AS code, CAST(sum(d) AS BIGINT) AS error FROM n2 JOIN kept USING (i) GROUP BY i, vec_id, label)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
 (SELECT sha256(string_agg(array_to_string(x, ','), ',' ORDER BY part, e)) FROM b2) AS codebooks_sha256 FROM coded"""


#: All pairs that share a shingle are counted; components by following links to every document they reach.
JACCARD_SQL = r"""
WITH RECURSIVE d AS MATERIALIZED (
 SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words FROM documents),
s AS MATERIALIZED (SELECT DISTINCT r, array_to_string(words[p:p + 4], ' ') AS gram FROM (SELECT r, words, unnest(range(1, greatest(len(words) - 4, 1) + 1)) AS p FROM d WHERE len(words) > 0)),
n AS MATERIALIZED (SELECT r, count(*) AS n FROM s GROUP BY r),
common AS (SELECT a.r AS a, b.r AS b, count(*) AS k FROM s a JOIN s b ON a.gram = b.gram AND a.r < b.r GROUP BY a.r, b.r),
links AS MATERIALIZED (SELECT a, b FROM common JOIN n x ON x.r = a JOIN n y ON y.r = b WHERE 100 * k >= 80 * (x.n + y.n - k)),
sides AS MATERIALIZED (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach(r, t) AS (SELECT r, r FROM d UNION SELECT reach.r, b FROM reach JOIN sides ON a = t)
SELECT d.doc_id, coalesce(any_value(n.n), 0) AS n_shingles, min(o.doc_id) AS component_id
FROM d LEFT JOIN n USING (r) JOIN reach USING (r) JOIN d o ON o.r = t GROUP BY d.r, d.doc_id"""


def oracle_sql() -> dict[str, str]:
    """Trained models, samples and sketches have no SQL form; those queries are tested against brute force."""
    return {"op1_chat_formatting": CHAT_SQL, "op7_decontamination": HITS_SQL, "op11_merkle_manifest": MERKLE_SQL, "op12_vector_codes": CODES_SQL, "op13_ngram_jaccard_join": JACCARD_SQL}
