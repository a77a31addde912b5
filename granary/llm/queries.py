"""The registered queries: thin digests of the operators over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.llm.shared import fold, tables


def op1_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    from granary.llm.mixing import mix

    return mix(tables(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from granary.llm.line_dedup import dedup_lines

    out = dedup_lines(tables(spark, sf_dir, "documents"))
    return out.select(F.col("row.doc_id").alias("doc_id"), "n_lines", "removed", F.col("clean").alias("text"))


def word_bpe_path() -> str:
    """Where the public word-end BPE file lies."""
    import public_tokenizers

    return str(public_tokenizers.path("word_bpe_49k.json"))


def op2_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    from granary.llm.packing import pack

    return pack(tables(spark, sf_dir, "documents"), word_bpe_path())


def op3_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    from granary.llm.nearest import search

    vectors = tables(spark, sf_dir, "embeddings")
    return search(vectors, vectors.filter(F.col("vec_id") % 100 == 0))


def op4_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from granary.llm.near_dedup import near_groups

    return near_groups(tables(spark, sf_dir, "documents"), words=4).select("doc_id", "n_shingles", "component_id", "kept")


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from granary.llm.toxicity import judge, learn, training_rows

    docs = tables(spark, sf_dir, "documents")
    out = judge(docs, learn(training_rows(docs, tables(spark, sf_dir, "labels"))))
    return out.withColumn("held_out", fold(F.col("doc_id"), 3) == 1)


def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    from granary.llm.language import identify, learn_open_fold

    docs = tables(spark, sf_dir, "documents")
    out = identify(docs, learn_open_fold(docs))
    return out.withColumn("held_out", fold(F.col("doc_id"), 3) == 1)


def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    from granary.llm.secrets import digest, findings, scan

    docs = tables(spark, sf_dir, "documents")
    return digest(findings(docs, scan(docs)))


def op9_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    from granary.llm.lm_scoring import score_texts

    return score_texts(tables(spark, sf_dir, "documents"))


def op10_audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per recording (kind member: id, class_id, frames) and one per two matching classes of which
    the first holds an id divisible by 50 (kind match: id, class_id, shift, bit_error). No table holds
    recordings; every row of ``embeddings`` is played as one."""
    from granary.llm.audio import align, fingerprints, sonified

    prints = fingerprints(sonified(tables(spark, sf_dir, "embeddings")))
    members, matches = align(prints, tables(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("long").alias("id")).filter("id % 50 = 0"))
    none = F.lit(None)
    return members.select(F.lit("member").alias("kind"), "id", "class_id", F.col("frames").cast("long").alias("frames"), none.cast("long").alias("shift"), none.cast("double").alias("bit_error")).unionByName(
        matches.select(F.lit("match").alias("kind"), F.col("query_class").alias("id"), "class_id", none.cast("long").alias("frames"), F.col("shift").cast("long").alias("shift"), "bit_error")
    )


def op11_edit_prints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints as hexadecimal digits, two a slot, and the class of near texts."""
    from granary.llm.editprint import near_texts

    out = near_texts(tables(spark, sf_dir, "documents"))
    return out.withColumns({c: F.lower(F.hex(c)) for c in ("fingerprint", "edited_fingerprint")})


def byte_bpe_path() -> str:
    """Where the public byte-level BPE file lies."""
    import public_tokenizers

    return str(public_tokenizers.path("byte_bpe_50k.json"))


def piece_bpe_path() -> str:
    """Where the public piece BPE file lies."""
    import public_tokenizers

    return str(public_tokenizers.path("piece_bpe_32k.model"))


def op12_align(spark: SparkSession, sf_dir: str) -> DataFrame:
    from granary.llm.alignment import scored

    return scored(tables(spark, sf_dir, "documents"), byte_bpe_path(), piece_bpe_path())


def op13_whiten(spark: SparkSession, sf_dir: str) -> DataFrame:
    from granary.llm.whitening import whiten

    out = whiten(tables(spark, sf_dir, "embeddings"), components=4)
    return out.withColumn("deviation", F.expr("try_cast(deviation AS BIGINT)"))


QUERIES = {"op1_mix": op1_mix, "op2_pack": op2_pack, "op3_nearest": op3_nearest, "op4_near_dedup": op4_near_dedup, "op5_line_dedup": op5_line_dedup, "op6_toxicity": op6_toxicity, "op7_language": op7_language, "op8_secrets": op8_secrets,
           "op9_lm_score": op9_lm_score, "op10_audio": op10_audio, "op11_edit_prints": op11_edit_prints, "op12_align": op12_align, "op13_whiten": op13_whiten}

ORACLES = {
    "op1_mix": r"""
WITH d AS (
  SELECT doc_id, source, md5('20|' || CAST(doc_id AS VARCHAR)) AS k,
         len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size
  FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, 2 * source_size AS lim,
             [3, 1, 2][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT] AS weight FROM s),
p AS (SELECT *,
             coalesce(sum(lim) OVER (ORDER BY lim / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS fb,
             (sum(weight) OVER (ORDER BY lim / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::BIGINT AS wf,
             (sum(source_size) OVER ())::BIGINT * 1.5::DOUBLE AS total FROM w),
a AS (SELECT fb AS afb, wf AS awf, total AS att FROM p WHERE lim > (total - fb) / wf * weight ORDER BY lim / weight, source NULLS LAST LIMIT 1),
t AS (SELECT p.source, p.source_size,
             CASE WHEN a.afb IS NULL OR lim <= weight * (att - afb) / awf THEN lim::DOUBLE ELSE weight * (att - afb) / awf END AS target
      FROM p LEFT JOIN a ON true),
r AS (SELECT d.*, t.source_size, t.target, floor(t.target + 0.5)::BIGINT AS budget,
             coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY k, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
e AS (SELECT *, CASE WHEN source_size > 0 THEN budget // source_size ELSE 0 END AS epochs FROM r)
SELECT doc_id, size, source_size, target,
       (epochs * size + greatest(0, least(size, budget - epochs * source_size - before)))::BIGINT AS taken
FROM e""",
    "op4_near_dedup": r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS MATERIALIZED (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 2), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] || ' ' || w[i + 3]) END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT x, y FROM p JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 100 * c >= 80 * (nx.n + ny.n - c)),
e AS MATERIALIZED (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
r AS (SELECT doc_id, doc_id AS root FROM documents UNION SELECT e.y, r.root FROM r JOIN e ON e.x = r.doc_id WHERE r.root < e.y),
c AS (SELECT doc_id, min(root) AS component_id FROM r GROUP BY doc_id)
SELECT doc_id, coalesce(n.n, 0) AS n_shingles, component_id, doc_id = component_id AS kept FROM c LEFT JOIN n USING (doc_id)""",
    "op5_line_dedup": r"""
WITH d AS (SELECT doc_id, text, string_split(coalesce(text, ''), chr(10)) AS l FROM documents),
x AS (SELECT doc_id, l, unnest(range(len(l)))::BIGINT AS pos FROM d),
w AS (
  SELECT doc_id, pos, 3 AS span, l[pos+1] || chr(10) || l[pos+2] || chr(10) || l[pos+3] AS body FROM x
  WHERE pos + 3 <= len(l) AND (trim(l[pos+1]) <> '' OR trim(l[pos+2]) <> '' OR trim(l[pos+3]) <> '')
  UNION ALL
  SELECT doc_id, pos, 1, l[pos+1] FROM x WHERE len(regexp_extract_all(l[pos+1], '[^\x20\x09-\x0D]+')) >= 50
  UNION ALL
  SELECT doc_id, pos, 2, l[pos+1] || chr(10) || l[pos+2] FROM x WHERE pos + 2 <= len(l) AND len(regexp_extract_all(l[pos+1], '[^\x20\x09-\x0D]+')) < 50
    AND len(regexp_extract_all(l[pos+2], '[^\x20\x09-\x0D]+')) < 50 AND len(regexp_extract_all(l[pos+1] || ' ' || l[pos+2], '[^\x20\x09-\x0D]+')) >= 50),
f AS (SELECT *, min(doc_id) OVER (PARTITION BY span, body) AS fd FROM w),
g AS (SELECT *, min(CASE WHEN doc_id = fd THEN pos END) OVER (PARTITION BY span, body) AS fp FROM f),
c AS (SELECT DISTINCT doc_id, unnest(range(pos, pos + span)) AS gone FROM g WHERE doc_id <> fd OR pos >= fp + span),
k AS (SELECT x.doc_id, string_agg(l[pos+1], chr(10) ORDER BY pos) AS t FROM x ANTI JOIN c ON x.doc_id = c.doc_id AND x.pos = c.gone GROUP BY x.doc_id),
n AS (SELECT doc_id, count(*) AS removed FROM c GROUP BY doc_id)
SELECT d.doc_id, len(l)::BIGINT AS n_lines, coalesce(n.removed, 0)::BIGINT AS removed,
       CASE WHEN n.removed IS NULL THEN d.text ELSE coalesce(k.t, '') END AS text
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN k USING (doc_id)""",
}
