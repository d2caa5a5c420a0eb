"""The registered queries of the operators, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gapline.llm import ball_simhash, chat_format, conversation_repair, exact_dedup, length_packing, merkle, near_dedup, quality, source_mixing, substring_dedup, toxicity, vector_topk, warc
from gapline.llm.tables import table
from gapline.runtime import cut_lineage, scratch_path


def op1_length_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return length_packing.pack(table(spark, sf_dir, "documents"))


def op2_vector_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", vector_topk.scaled("embedding").alias("vec"))
    return vector_topk.top_k(vectors, vectors.where(F.col("vec_id") % 100 == 0), k=10)


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring_dedup.drop_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op4_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_mixing.draw(table(spark, sf_dir, "documents")).select("doc_id", "source", "tokens", "epoch", "block_place", "place")


def op5_toxicity_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    models, threshold, _ = toxicity.train_chain(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(docs, models, threshold)


def op6_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "\\### Assistant: </turn> ok"
    extra = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text")
    )
    out = chat_format.format_chats(rows.unionByName(extra))
    back = out.select("conv_id", "formatted", chat_format.parse(F.col("formatted")).alias("turns"), chat_format.loss_texts(F.col("formatted"), F.col("loss_spans")).alias("loss"))
    spoken = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    trained = F.array_join("loss", "")
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(spoken, 256).alias("turns_sha256"),
        F.length(trained).cast("long").alias("loss_chars"),
        F.sha2(trained, 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.label_copies(table(spark, sf_dir, "documents"))


def op8_quality_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score_quality(table(spark, sf_dir, "documents"))


def op9_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_classes(table(spark, sf_dir, "documents"))


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "warc")
    warc.write_warc(table(spark, sf_dir, "pages"), path)
    back = warc.read_warc(spark, path)
    page = lambda c: F.regexp_extract(c, r"^urn:page:(-?\d+)$", 1).try_cast("long")
    return back.select(
        page("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", page("refers_to").alias("refers_to")
    )


def damaged(rows: DataFrame) -> DataFrame:
    """Conversation rows with faults put in by a checksum of their place."""
    said = [F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn", "role", "text")]
    fault = F.crc32(F.concat(said[0], F.lit(":"), said[1]).cast("binary")) % 20
    text = F.when(fault == 1, F.lit("")).when(fault == 2, F.translate(said[3], ".!?", "")).otherwise(said[3])
    left = rows.select("conv_id", "turn", F.when(fault == 4, F.lit("user")).otherwise(said[2]).alias("role"), text.alias("text"), fault.alias("fault")).where("fault <> 0")
    return left.select("conv_id", "turn", "role", "text", F.explode(F.array_repeat(F.lit(1), F.when(F.col("fault") == 3, 2).otherwise(1))).alias("copy")).drop("copy")


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations")
    return conversation_repair.audits(damaged(rows), all_ids=rows)


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    fields = ["doc_id", "source", "lang", "n_chars", "text"]
    changed = (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0) & F.contains("text", F.lit("\n"))
    tampered = [F.replace(F.col(c), F.lit("\n"), F.lit("")) if c == "text" else F.col(c) for c in fields]
    # Only leaves that tampering changes are carried twice.
    leaves = cut_lineage(docs.select("doc_id", "source", merkle.leaf_hash(map(F.col, fields)).alias("leaf"), F.when(changed, merkle.leaf_hash(tampered)).alias("tampered")))
    out = merkle.manifest(leaves, "source", "doc_id").withColumn("folded_root", merkle.fold(F.coalesce("tampered", "leaf"), F.col("path")))
    proof = F.sha2(merkle.siblings(F.col("path")), 256)
    return out.select("doc_id", "leaf", "subroot", "root", proof.alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


def op13_ball_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ball_simhash.simhash_components(table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_length_packing": op1_length_packing,
    "op2_vector_topk": op2_vector_topk,
    "op3_substring_dedup": op3_substring_dedup,
    "op4_source_mixing": op4_source_mixing,
    "op5_toxicity_chain": op5_toxicity_chain,
    "op6_chat_format": op6_chat_format,
    "op7_exact_dedup": op7_exact_dedup,
    "op8_quality_labels": op8_quality_labels,
    "op9_near_dedup": op9_near_dedup,
    "op10_warc": op10_warc,
    "op11_conversation_repair": op11_conversation_repair,
    "op12_merkle_manifest": op12_merkle_manifest,
    "op13_ball_simhash": op13_ball_simhash,
}


def _crc32(text: str) -> str:
    """CRC-32 of an ASCII string in DuckDB, bit by bit."""
    bits = "list_reduce(list_concat([xor(c, b)], [0, 0, 0, 0, 0, 0, 0, 0]), lambda v, z: CASE WHEN v & 1 = 1 THEN xor(3988292384, v >> 1) ELSE v >> 1 END)"
    return f"xor(4294967295, list_reduce(list_concat([4294967295], [CAST(ascii(x) AS BIGINT) FOR x IN string_split({text}, '')]), lambda c, b: {bits}))"


def _hashed(value: str) -> str:
    return f"CASE WHEN {value} IS NULL THEN '-' ELSE octet_length(encode(CAST({value} AS VARCHAR))) || ':' || {value} END"


SQL = {
    "op2_vector_topk": """
WITH v AS (
  SELECT vec_id, [CAST(floor(1024 * CAST(x AS DOUBLE)) AS DOUBLE) FOR x IN embedding] AS vec
  FROM embeddings
  WHERE len(embedding) > 0 AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.vec, c.vec) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id),
r AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10""",
    "op3_substring_dedup": """
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
k AS (
  SELECT doc_id, i, array_to_string(w[i:i + 49], ' ') AS k
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM d WHERE len(w) >= 50)),
m AS (SELECT k, min(doc_id) AS f FROM k GROUP BY k),
r AS (SELECT doc_id, i FROM k JOIN m USING (k) WHERE f < doc_id),
c AS (SELECT DISTINCT doc_id, i + j AS p FROM (SELECT doc_id, i, unnest(range(0, 50)) AS j FROM r)),
x AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM d),
y AS (
  SELECT doc_id, count(*) AS n_removed_all FROM c GROUP BY doc_id),
z AS (
  SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS kept FROM x ANTI JOIN c USING (doc_id, p) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_removed_all, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN y USING (doc_id) LEFT JOIN z USING (doc_id)""",
    "op6_chat_format": """
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\\### Assistant: </turn> ok'),
e AS (
  SELECT *, lag(role) OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS before,
    length(replace(replace(replace(replace(role, '\\', '\\s'), '###', '\\h'), '</turn>', '\\t'), ':', '\\c')) AS role_size,
    length(replace(replace(replace(text, '\\', '\\s'), '###', '\\h'), '</turn>', '\\t')) AS text_size
  FROM t)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn NULLS FIRST, role, text), '')) AS loss_sha256,
  CAST(sum(text_size + 7 + CASE WHEN before = role THEN 0 ELSE role_size + 6 END) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id""",
    "op7_exact_dedup": """
WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]+', ' ', 'g') AS body FROM documents)
SELECT doc_id, min(doc_id) OVER (PARTITION BY body) AS keep_id, count(*) OVER (PARTITION BY body) AS group_size,
  doc_id IS NOT DISTINCT FROM min(doc_id) OVER (PARTITION BY body) AS kept, sha256(body) AS text_sha256
FROM n""",
    "op10_warc": """
WITH p AS (
  SELECT page_id, octet_length(encode(coalesce(html, ''))) AS size, sha256(coalesce(html, '')) AS digest FROM pages),
m AS (SELECT *, min(page_id) OVER (PARTITION BY digest) AS first_id FROM p)
SELECT page_id, CAST(size AS BIGINT) AS payload_bytes, digest AS payload_digest,
  CASE WHEN size >= 100 AND page_id <> first_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN size >= 100 AND page_id <> first_id THEN first_id END AS refers_to
FROM m""",
    "op11_conversation_repair": f"""
WITH RECURSIVE c AS (
  SELECT coalesce('s' || conv_id, 'n') AS k, conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    {_crc32("coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ')")} % 20 AS fault
  FROM conversations),
d AS (
  SELECT k, turn, CASE WHEN fault = 4 THEN 'user' ELSE role END AS role,
    CASE fault WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
    unnest(range(CASE fault WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS copy
  FROM c),
o AS (
  SELECT *, row_number() OVER (PARTITION BY k ORDER BY turn NULLS FIRST, role, sha256(text)) AS i,
    rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS core
  FROM d),
f AS (
  SELECT *, CASE WHEN core = '' THEN 'b' WHEN row_number() OVER (PARTITION BY k, role, text ORDER BY i) > 1 THEN 'd'
      WHEN right(core, 1) NOT IN ('.', '!', '?') THEN 't' ELSE '' END AS fault,
    lag(left(role, 1)) OVER (PARTITION BY k ORDER BY i) || left(role, 1) AS pair
  FROM o),
n AS (
  SELECT k, count(*) AS rows, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
    count(*) FILTER (fault = 'b') AS blank, count(*) FILTER (fault = 'd') AS duplicate, count(*) FILTER (fault = 't') AS truncated,
    count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal
  FROM f GROUP BY k),
ins(s, t, edits, price, said) AS (
  VALUES (0, 0, '', 0, []::VARCHAR[]), (1, 1, '', 0, []), (2, 2, '', 0, []), (3, 3, '', 0, []),
    (0, 2, 'I', 2, ['user:']), (1, 2, 'I', 2, ['user:']), (2, 3, 'I', 2, ['assistant:']), (3, 2, 'I', 2, ['user:']),
    (0, 3, 'II', 4, ['user:', 'assistant:']), (1, 3, 'II', 4, ['user:', 'assistant:'])),
m(s, t, edit, price, needs, said) AS (
  VALUES (0, 0, 'D', 3, NULL, NULL), (1, 1, 'D', 3, NULL, NULL), (2, 2, 'D', 3, NULL, NULL), (3, 3, 'D', 3, NULL, NULL),
    (0, 1, 'K', 0, 's', NULL), (0, 2, 'K', 0, 'u', NULL), (1, 2, 'K', 0, 'u', NULL), (2, 3, 'K', 0, 'a', NULL), (3, 2, 'K', 0, 'u', NULL),
    (0, 2, 'R', 2, NULL, 'user'), (1, 2, 'R', 2, NULL, 'user'), (2, 3, 'R', 2, NULL, 'assistant'), (3, 2, 'R', 2, NULL, 'user')),
w AS (
  SELECT DISTINCT k, CAST(0 AS BIGINT) AS i, 0 AS s, {{'cost': CAST(0 AS BIGINT), 'audit': '', 'said': []::VARCHAR[]}} AS best FROM c
  UNION ALL
  SELECT w.k, f.i, m.t, min({{'cost': w.best.cost + ins.price + m.price + CAST(m.edit <> 'D' AND f.fault = 't' AS BIGINT),
    'audit': w.best.audit || ins.edits || m.edit,
    'said': list_concat(w.best.said, ins.said, CASE WHEN m.edit = 'D' THEN [] ELSE [coalesce(m.said, f.role) || ':' || f.text] END)}})
  FROM w JOIN ins ON ins.s = w.s JOIN f ON f.k = w.k AND f.i = w.i + 1 JOIN m ON m.s = ins.t
    AND (m.edit = 'D' OR f.fault NOT IN ('b', 'd') AND (m.edit = 'R' OR m.needs = left(f.role, 1)))
  GROUP BY w.k, f.i, m.t),
z AS (
  SELECT w.k, min({{'cost': w.best.cost + ins.price, 'audit': w.best.audit || ins.edits, 'said': list_concat(w.best.said, ins.said)}}) AS best
  FROM w LEFT JOIN n USING (k) JOIN ins ON ins.s = w.s WHERE w.i = coalesce(n.rows, 0) AND ins.t IN (0, 3) GROUP BY w.k)
SELECT a.conv_id, coalesce(n.gaps, 0) AS gaps, coalesce(n.blank, 0) AS blank, coalesce(n.duplicate, 0) AS duplicate, coalesce(n.truncated, 0) AS truncated,
  coalesce(n.illegal, 0) AS illegal, z.best.cost AS cost, z.best.audit AS audit, sha256(coalesce(array_to_string(z.best.said, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT k, conv_id FROM c) a JOIN z USING (k) LEFT JOIN n USING (k)""",
    "op12_merkle_manifest": f"""
WITH RECURSIVE l AS (
  SELECT doc_id, coalesce('s' || source, 'n') AS tree,
    sha256({" || ".join(_hashed(c) for c in ("doc_id", "source", "lang", "n_chars", "text"))}) AS leaf,
    sha256({" || ".join(_hashed(c) for c in ("doc_id", "source", "lang", "n_chars", "replace(text, chr(10), '')"))}) AS other,
    {_crc32("CAST(doc_id AS VARCHAR)")} % 2 = 0 AS tampered
  FROM documents),
r AS (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i FROM l),
e(tree, up, d) AS (
  SELECT tree, 0, list(leaf ORDER BY i) FROM r GROUP BY tree
  UNION ALL
  SELECT tree, up + 1, [sha256(array_to_string(d[3 * j + 1:3 * j + 3], '')) FOR j IN range((len(d) + 2) // 3)] FROM e WHERE len(d) > 1),
t AS (SELECT tree, d[1] AS subroot, row_number() OVER (ORDER BY tree) - 1 AS i FROM e WHERE len(d) = 1),
g(up, d) AS (
  SELECT 0, list(subroot ORDER BY i) FROM t
  UNION ALL
  SELECT up + 1, [sha256(array_to_string(d[3 * j + 1:3 * j + 3], '')) FOR j IN range((len(d) + 2) // 3)] FROM g WHERE len(d) > 1),
a AS (
  SELECT r.tree, r.i, 0 AS top, e.up, e.d, CAST(floor(r.i / power(3, e.up)) AS BIGINT) AS j FROM r JOIN e USING (tree) WHERE len(e.d) > 1
  UNION ALL
  SELECT r.tree, r.i, 1, g.up, g.d, CAST(floor(t.i / power(3, g.up)) AS BIGINT) FROM r JOIN t USING (tree) JOIN g ON len(g.d) > 1),
b AS (
  SELECT tree, i, top, up, coalesce(array_to_string(d[j - j % 3 + 1:j], ''), '') AS x, coalesce(array_to_string(d[j + 2:j - j % 3 + 3], ''), '') AS y FROM a),
p AS (SELECT tree, i, list(x || '|' || y ORDER BY top, up) AS path, string_agg(x || y, '' ORDER BY top, up) AS proof FROM b GROUP BY tree, i),
v AS (
  SELECT r.doc_id, r.leaf, t.subroot, (SELECT d[1] FROM g WHERE len(d) = 1) AS root, sha256(coalesce(p.proof, '')) AS proof_sha256,
    list_reduce(list_concat([CASE WHEN tampered THEN other ELSE leaf END], coalesce(p.path, [])),
      lambda n, x: sha256(split_part(x, '|', 1) || n || split_part(x, '|', 2))) AS folded_root
  FROM r JOIN t USING (tree) LEFT JOIN p ON p.tree = r.tree AND p.i = r.i)
SELECT *, folded_root = root AS verified FROM v""",
}
