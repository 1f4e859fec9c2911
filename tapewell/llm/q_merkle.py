from pyspark.sql import functions as F

from tapewell.llm import merkle
from tapewell.llm.queries import query, table

ORACLE = """
WITH RECURSIVE bits AS (
  SELECT range AS b, range AS c, 0 AS k FROM range(256)
  UNION ALL SELECT b, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k + 1 FROM bits WHERE k < 8),
crc AS (SELECT list(c ORDER BY b) AS t FROM bits WHERE k = 8),
given AS (
  SELECT doc_id, lang, n_chars, text, source,
    xor(list_reduce(list_prepend(4294967295, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))),
      lambda a, b: xor(a >> 8, t[CAST(xor(a, b) & 255 AS INT) + 1])), 4294967295) AS h
  FROM documents, crc),
leaf AS (
  SELECT doc_id, lang, sha256(head || coalesce(strlen(CAST(n_chars AS VARCHAR)) || ':' || n_chars, '-') || tail) AS leaf,
    sha256(head || coalesce(strlen(CAST(m AS VARCHAR)) || ':' || m, '-') || tail) AS candidate
  FROM (SELECT *, CASE WHEN h % 7 = 0 THEN n_chars + 1 ELSE n_chars END AS m,
      coalesce(strlen(CAST(doc_id AS VARCHAR)) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-') AS head,
      coalesce(strlen(text) || ':' || text, '-') AS tail FROM given)),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY lang) AS w FROM leaf),
tree AS (
  SELECT lang, 0 AS level, i, leaf AS h, w FROM placed
  UNION ALL SELECT lang, level + 1, i // 2, sha256(string_agg(h, '' ORDER BY i)), (w + 1) // 2 FROM tree WHERE w > 1 GROUP BY lang, level, i // 2, w),
subroots AS (
  SELECT lang, h AS subroot, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS i, count(*) OVER () AS w FROM tree WHERE w = 1),
top AS (
  SELECT 0 AS level, i, subroot AS h, w FROM subroots
  UNION ALL SELECT level + 1, i // 2, sha256(string_agg(h, '' ORDER BY i)), (w + 1) // 2 FROM top WHERE w > 1 GROUP BY level, i // 2, w),
below AS (
  SELECT p.lang, p.i, list(CASE WHEN s.h IS NULL THEN '-' WHEN n.i % 2 = 1 THEN 'L' || s.h ELSE 'R' || s.h END ORDER BY n.level) AS steps
  FROM placed p JOIN tree n ON n.lang IS NOT DISTINCT FROM p.lang AND n.w > 1 AND n.i = p.i >> n.level
  LEFT JOIN tree s ON s.lang IS NOT DISTINCT FROM p.lang AND s.level = n.level AND s.i = xor(n.i, 1) GROUP BY 1, 2),
above AS (
  SELECT r.lang, list(CASE WHEN s.h IS NULL THEN '-' WHEN n.i % 2 = 1 THEN 'L' || s.h ELSE 'R' || s.h END ORDER BY n.level) AS steps
  FROM subroots r JOIN top n ON n.w > 1 AND n.i = r.i >> n.level LEFT JOIN top s ON s.level = n.level AND s.i = xor(n.i, 1) GROUP BY 1),
paths AS (
  SELECT p.doc_id, p.leaf, p.candidate, r.subroot, z.h AS root, list_concat(coalesce(b.steps, []), coalesce(a.steps, [])) AS path
  FROM placed p JOIN subroots r ON r.lang IS NOT DISTINCT FROM p.lang CROSS JOIN (SELECT h FROM top WHERE w = 1) z
  LEFT JOIN below b ON b.lang IS NOT DISTINCT FROM p.lang AND b.i = p.i LEFT JOIN above a ON a.lang IS NOT DISTINCT FROM p.lang),
folded AS (
  SELECT *, sha256(array_to_string(list_transform(path, lambda p: p[2:]), '')) AS proof_sha256,
    list_reduce(list_prepend(candidate, path), lambda a, p: sha256(CASE WHEN p = '-' THEN a WHEN p[1] = 'L' THEN p[2:] || a ELSE a || p[2:] END)) AS folded_root FROM paths)
SELECT doc_id, leaf, subroot, root, proof_sha256, folded_root, folded_root = root AS verified FROM folded
"""


@query("op12_merkle_manifest", ORACLE)
def op12_merkle_manifest(spark, sf_dir):
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    changed = {"n_chars": F.when(tampered, F.col("n_chars") + 1).otherwise(F.col("n_chars"))}
    out = merkle.multiproof(merkle.leaves(table(spark, sf_dir, "documents"), changed=changed))
    return out.select(
        F.col("id").alias("doc_id"), "leaf", "subroot", "root", F.sha2(merkle.proof(F.col("path")), 256).alias("proof_sha256"),
        "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))
