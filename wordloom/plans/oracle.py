"""SQL of the core queries, for an independent engine on the same tables."""

from __future__ import annotations

from wordloom.functions.text import token_pattern

MINFREQ, WINDOW, T, CDS, NEGATIVE, POWER, BUCKETS = 5, 2, 1e-4, 0.75, 5, 0.75, 10_000
DIM = 64


def _tok(pattern: str, ended: bool = True) -> str:
    found = f"regexp_extract_all(text, '{pattern}')"
    if ended:
        found = f"list_append({found}, '</s>')"
    return f"""
SELECT doc_id, CAST(i - 1 AS BIGINT) AS pos, CASE WHEN t IN (chr(10), '.') THEN '</s>' ELSE t END AS w
FROM (SELECT doc_id, unnest(found) AS t, generate_subscripts(found, 1) AS i
      FROM (SELECT doc_id, {found} AS found FROM documents WHERE text IS NOT NULL))
"""


TOK = _tok(token_pattern())


def _uniform(seed: int, *keys: str) -> str:
    return f"(('0x' || substr(md5(concat_ws(':', '{seed}', {', '.join(f'{k}::VARCHAR' for k in keys)})), 1, 8))::BIGINT / 4294967296.0::DOUBLE)"


def _h60(seed: int, *keys: str) -> str:
    return f"('0x' || substr(md5(concat_ws(':', '{seed}', {', '.join(f'{k}::VARCHAR' for k in keys)})), 1, 15))::BIGINT"


def _base(subsample_seed: int | None = None, weight: bool = False, positional: bool = True, suffix: str = "") -> str:
    """CTEs from tokens to pairs: tok, counts, kept, words, pairs."""
    s = suffix
    if subsample_seed is None:
        kept = "SELECT t.* FROM tok t SEMI JOIN vocab v ON t.w = v.w"
    else:
        drop = f"CASE WHEN v.freq > 0 THEN greatest(0.0::DOUBLE, 1 - sqrt({T}::DOUBLE / (v.freq::DOUBLE / size.n::DOUBLE))) ELSE 0 END"
        kept = f"""SELECT t.* FROM tok t JOIN vocab v ON t.w = v.w, size
 WHERE t.w = '</s>' OR {_uniform(subsample_seed, 't.doc_id', 't.pos')} > {drop}"""
    reach = f"1 + floor({_uniform(2, 'a.doc_id', 'a.pos')} * {WINDOW})" if weight else str(WINDOW)
    name = "b.w || '_' || a.k::VARCHAR" if positional else "b.w"
    return f"""kept{s} AS ({kept}),
 words{s} AS (
  SELECT doc_id, sent, (row_number() OVER (PARTITION BY doc_id, sent ORDER BY pos) - 1) AS rn, pos, w FROM (
   SELECT *, sum(CASE WHEN w = '</s>' THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY pos ROWS UNBOUNDED PRECEDING)::BIGINT AS sent FROM kept{s})
  WHERE w <> '</s>'),
 pairs{s} AS (
  SELECT a.doc_id, a.sent, a.rn, a.w, b.w AS base_w, a.k::BIGINT AS pos, {name} AS c
  FROM (SELECT *, unnest([-2, -1, 1, 2]) AS k FROM words{s}) a JOIN words{s} b
   ON a.doc_id = b.doc_id AND a.sent = b.sent AND a.rn + a.k = b.rn AND a.rn // 1000 = b.rn // 1000
  WHERE abs(a.k) <= {reach})"""


VOCAB = f"""WITH tok AS ({TOK}),
 counts AS (SELECT w, count(*) AS freq FROM tok GROUP BY w),
 vocab AS (SELECT w, max(freq) AS freq FROM (
   SELECT w, freq FROM counts WHERE freq >= {MINFREQ} UNION ALL SELECT '</s>', 0) GROUP BY w),
 size AS (SELECT sum(freq)::BIGINT AS n FROM vocab)"""
PAIRS = f"{VOCAB},\n {_base()}"
PLAIN = f"{VOCAB},\n {_base(positional=False)}"
CELLS = "cells AS (SELECT w, c, count(*) AS cooc FROM pairs GROUP BY w, c)"
TOTALS = """rows_ AS (SELECT w, sum(cooc)::BIGINT AS total FROM cells GROUP BY w),
 cols AS (SELECT c, sum(cooc)::BIGINT AS total FROM cells GROUP BY c)"""
SMOOTH = f"smooth AS (SELECT sum(pow(total::DOUBLE, {CDS})) AS cds_total FROM cols)"
PMI = f"(ln(x.cooc::DOUBLE) - ln(r.total::DOUBLE) - ln(pow(k.total::DOUBLE, {CDS})) + ln(s.cds_total))"
NPMI = f"({PMI} / -(ln(x.cooc::DOUBLE) - ln(s.cds_total)))"
SCORED = f"""{PAIRS}, {CELLS}, {TOTALS}, {SMOOTH},
 scored AS (SELECT x.w, x.c, x.cooc, {PMI} AS pmi, {NPMI} AS npmi
  FROM cells x JOIN rows_ r ON x.w = r.w JOIN cols k ON x.c = k.c, smooth s)"""

NOISE = f"""{PLAIN},
 ctx AS (SELECT v.w AS c, count(p.c) AS freq FROM vocab v LEFT JOIN pairs p ON p.c = v.w GROUP BY v.w),
 ranked AS (SELECT c, freq, row_number() OVER (ORDER BY freq DESC, c) - 1 AS idx FROM ctx),
 weights AS (SELECT c, idx, round(pow(freq::DOUBLE, {POWER}) * 1e6)::BIGINT AS q FROM ranked),
 noise AS (SELECT c, idx, q, (sum(q) OVER (ORDER BY idx ROWS UNBOUNDED PRECEDING))::BIGINT AS cum_q FROM weights WHERE q > 0),
 draws AS (SELECT e.doc_id, e.sent, e.rn, e.w, e.k, n.c FROM (
   SELECT doc_id, sent, rn, w, k, {_h60(1, 'doc_id', 'sent', 'rn', 'k')} % (SELECT max(cum_q) FROM noise) AS at
   FROM words, (SELECT unnest(generate_series(1, {NEGATIVE})) AS k)) e
  ASOF JOIN noise n ON e.at >= n.cum_q - n.q)"""
SPOOL = f"""{NOISE},
 spool AS (SELECT w, c, sum(hit)::BIGINT AS cooc, count(*) AS sampled FROM (
   SELECT w, c, 1 AS hit FROM pairs UNION ALL SELECT w, c, 0 FROM draws) GROUP BY w, c)"""

UNSEEN = f"""{VOCAB},
 {_base(1, suffix='1')},
 {_base(2, suffix='2')},
 cells AS (SELECT w, c, count(*) AS cooc FROM pairs1 GROUP BY w, c),
 asked AS (SELECT DISTINCT w, c FROM pairs2),
 looked AS (SELECT a.w, a.c, coalesce(x.cooc, 0) AS cooc FROM asked a LEFT JOIN cells x ON a.w = x.w AND a.c = x.c)"""


def _grams(chars: bool) -> str:
    """(w, ord, gram) of the vocabulary's words."""
    text, unit = ("'<' || w || '>'", 1) if chars else ("hex(encode('<' || w || '>'))", 2)
    cut = f"substr(h, {unit} * i + 1, {unit} * k)"
    gram = f"hex(encode({cut}))" if chars else cut
    return f"""SELECT w, freq, row_number() OVER (PARTITION BY w ORDER BY i, k) AS ord, gram FROM (
  SELECT w, freq, i, k, {gram} AS gram
  FROM (SELECT w, freq, {text} AS h, length({text}) // {unit} AS n FROM vocab),
   (SELECT unnest(generate_series(0, 4000)) AS i), (SELECT unnest(generate_series(3, 6)) AS k)
  WHERE k < n AND i + k <= n)"""


def _fnv(hexed: str) -> str:
    return f"""list_reduce(list_prepend(2166136261::BIGINT, list_transform(range(0, length({hexed}) // 2), lambda i: ('0x' || substr({hexed}, 2 * i + 1, 2))::BIGINT)),
  lambda a, b: xor((a * 16777619) & 4294967295, b))"""


def _long(select: str, key: str) -> str:
    """One row per component of (key, v)."""
    return f"SELECT {key}, CAST(i - 1 AS BIGINT) AS d, round(x, 6) + 0.0 AS x FROM (SELECT {key}, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM ({select}))"


_PARTS = "SELECT *, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS i FROM embeddings"

#: One epoch of training as a single step over all examples, and what it makes.
FULL_BATCH = f"""WITH init AS (
  SELECT vec_id AS r, k AS d, ({_uniform(1, 'vec_id', 'k')} - 0.5) / 4 AS w, ({_uniform(2, 'vec_id', 'k')} - 0.5) / 4 AS c
  FROM embeddings, (SELECT unnest(generate_series(0, 3)) AS k)),
 ex AS (SELECT vec_id AS w, (vec_id * 7 + 1) % (SELECT count(*) FROM embeddings) AS k, embedding[1]::DOUBLE * 4 AS y FROM embeddings),
 g0 AS (SELECT ex.w, ex.k, sum(a.w * b.c) - any_value(y) AS g FROM ex JOIN init a ON a.r = ex.w JOIN init b ON b.r = ex.k AND b.d = a.d GROUP BY ex.w, ex.k),
 dw AS (SELECT g0.w AS r, b.d, sum(g * b.c) AS x FROM g0 JOIN init b ON b.r = g0.k GROUP BY ALL),
 dc AS (SELECT g0.k AS r, a.d, sum(g * a.w) AS y FROM g0 JOIN init a ON a.r = g0.w GROUP BY ALL),
 made AS (SELECT i.r, i.d, i.w - 0.5 * coalesce(dw.x, 0) AS w, i.c - 0.5 * coalesce(dc.y, 0) AS c
  FROM init i LEFT JOIN dw ON dw.r = i.r AND dw.d = i.d LEFT JOIN dc ON dc.r = i.r AND dc.d = i.d),
 g1 AS (SELECT ex.w, ex.k, sum(a.w * b.c) - any_value(y) AS g FROM ex JOIN made a ON a.r = ex.w JOIN made b ON b.r = ex.k AND b.d = a.d GROUP BY ex.w, ex.k)"""

#: A model whose words are word0 to word9 and whose rows are the embeddings.
MODEL_ROWS = f"""known AS (SELECT unnest(generate_series(0, 9)) AS idx, 'word' || idx::VARCHAR AS w),
 parts AS ({_PARTS})"""
ASKED = f"""SELECT DISTINCT CASE WHEN t IN (chr(10), '.') THEN '</s>' ELSE t END AS w FROM (
  SELECT unnest(list_append(regexp_extract_all(text, '{token_pattern()}'), '</s>')) AS t FROM benchmark WHERE text IS NOT NULL)"""
MEANS = f"""means AS (SELECT w, i, avg(x) AS x FROM rows_ JOIN parts USING (vec_id) GROUP BY w, i)
SELECT a.w, CAST(d.i - 1 AS BIGINT) AS d, round(coalesce(m.x, 0), 6) + 0.0 AS x
FROM asked a CROSS JOIN (SELECT unnest(generate_series(1, {DIM})) AS i) d LEFT JOIN means m ON m.w = a.w AND m.i = d.i"""

ORACLE: dict[str, str] = {
    "tokenize_default": TOK,
    "tokenize_period_ws": _tok(token_pattern(True)),
    "tokenize_unterminated": f"""WITH tok AS ({_tok(token_pattern(), False)})
SELECT t.* FROM tok t JOIN (SELECT doc_id, max(pos) AS last FROM tok WHERE w = '</s>' GROUP BY doc_id) l
 ON t.doc_id = l.doc_id WHERE t.pos <= l.last""",
    "sentence_lengths": f"""WITH tok AS ({TOK})
SELECT doc_id, sent, count(*) AS n_words FROM (
 SELECT *, sum(CASE WHEN w = '</s>' THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY pos ROWS UNBOUNDED PRECEDING)::BIGINT AS sent FROM tok)
WHERE w <> '</s>' GROUP BY doc_id, sent""",
    "sentence_chunks": f"""{PAIRS}
SELECT doc_id, sent, (rn // 20)::BIGINT AS chunk, count(*) AS n_words, min(pos) AS first_pos FROM words GROUP BY ALL""",
    "vocab_counts": f"SELECT w, count(*) AS freq FROM ({TOK}) GROUP BY w",
    "raw_corpus_size": f"SELECT count(*) AS n_tokens FROM ({TOK})",
    "vocab_minfreq": f"{VOCAB} SELECT w, row_number() OVER (ORDER BY freq DESC, w) - 1 AS idx, freq FROM vocab",
    "vocab_maxvocab": f"""{VOCAB}, best AS (SELECT w, freq FROM counts WHERE freq >= {MINFREQ} ORDER BY freq DESC, w LIMIT 500),
 cut AS (SELECT w, max(freq) AS freq FROM (SELECT * FROM best UNION ALL SELECT '</s>', 0) GROUP BY w)
SELECT w, row_number() OVER (ORDER BY freq DESC, w) - 1 AS idx, freq FROM cut""",
    "vocab_ctxbreak_readded": f"""{VOCAB}, best AS (SELECT w, freq FROM counts WHERE freq >= {MINFREQ} AND w <> '</s>' ORDER BY freq DESC, w LIMIT 50)
SELECT w, row_number() OVER (ORDER BY freq DESC, w) - 1 AS idx, freq FROM (SELECT * FROM best UNION ALL SELECT '</s>', 0)""",
    "corpus_size_build": f"{VOCAB} SELECT sum(freq)::BIGINT AS corpus_size FROM counts WHERE freq >= {MINFREQ}",
    "corpus_size_stored": f"""{VOCAB}, best AS (SELECT w, freq FROM counts WHERE freq >= {MINFREQ} ORDER BY freq DESC, w LIMIT 500)
SELECT sum(freq)::BIGINT AS corpus_size FROM (SELECT w, max(freq) AS freq FROM (SELECT * FROM best UNION ALL SELECT '</s>', 0) GROUP BY w)""",
    "oov_filter": f"{PAIRS} SELECT doc_id, pos, w FROM kept",
    "ctx_slots": f"{VOCAB} SELECT w || '_' || k::VARCHAR AS c, w AS base_w, k::BIGINT AS pos FROM vocab, (SELECT unnest([-2, -1, 1, 2]) AS k)",
    "ctx_vocab_positional": f"""{PAIRS},
 slots AS (SELECT w || '_' || k::VARCHAR AS c, w AS base_w, k::BIGINT AS pos FROM vocab, (SELECT unnest([-2, -1, 1, 2]) AS k)),
 seen AS (SELECT c, count(*) AS freq FROM pairs GROUP BY c)
SELECT s.c, s.base_w, s.pos, row_number() OVER (ORDER BY coalesce(freq, 0) DESC, s.c) - 1 AS idx, coalesce(freq, 0) AS freq
FROM slots s LEFT JOIN seen ON s.c = seen.c""",
    "ctx_vocab_plain": f"{NOISE} SELECT c, idx, freq FROM ranked",
    "ctx_unknown": f"""{PAIRS}
SELECT DISTINCT c FROM pairs WHERE c NOT IN (SELECT w || '_' || k::VARCHAR FROM vocab, (SELECT unnest([-2, -1, 1, 2]) AS k))""",
    "window_pairs": f"{PAIRS} SELECT doc_id, sent, w, c, count(*) AS n FROM pairs GROUP BY ALL",
    "window_pairs_plain": f"{PLAIN} SELECT doc_id, sent, rn, w, c, pos FROM pairs",
    "window_weighted": f"{VOCAB}, {_base(weight=True)} SELECT doc_id, sent, rn, w, c FROM pairs",
    "target_only_events": f"{PAIRS} SELECT w, count(*) AS n_events FROM words GROUP BY w",
    "cooc_positional": f"{PAIRS}, {CELLS} SELECT * FROM cells",
    "cooc_plain": f"{PLAIN}, {CELLS} SELECT * FROM cells",
    "row_totals": f"{PAIRS}, {CELLS}, {TOTALS} SELECT * FROM rows_",
    "col_totals": f"{PAIRS}, {CELLS}, {TOTALS} SELECT * FROM cols",
    "cds_total": f"{PAIRS}, {CELLS}, {TOTALS}, {SMOOTH} SELECT round(cds_total, 2) AS cds_total FROM smooth",
    "marginal_logs": f"{PAIRS}, {CELLS}, {TOTALS} SELECT c, total, round(ln(pow(total::DOUBLE, {CDS})), 6) AS log_total FROM cols",
    "cooc_lookup_default0": f"{UNSEEN} SELECT * FROM looked",
    "cooc_sorted_index": f"""{NOISE}, {CELLS},
 v AS (SELECT w, row_number() OVER (ORDER BY freq DESC, w) - 1 AS w_idx FROM vocab)
SELECT w_idx, idx AS c_idx, cooc FROM cells JOIN v USING (w) JOIN ranked USING (c)""",
    "spool_estimate": f"""{PAIRS}, {CELLS}, t AS (SELECT sum(cooc)::BIGINT AS total, total * (1 + {NEGATIVE} / {2 * WINDOW}.0::DOUBLE) AS n FROM cells)
SELECT total, round(n, 3) AS lines, round(n * 28, 3) AS peak_bytes, round(n * 12, 3) AS final_bytes FROM t""",
    "assoc_pmi": f"{SCORED} SELECT w, c, cooc, round(pmi, 6) + 0.0 AS y FROM scored",
    "assoc_cpmi": f"{SCORED} SELECT w, c, cooc, round(greatest(pmi, 0), 6) + 0.0 AS y FROM scored",
    "assoc_npmi": f"{SCORED} SELECT w, c, cooc, round(npmi, 6) + 0.0 AS y FROM scored",
    "assoc_nnegpmi": f"{SCORED} SELECT w, c, cooc, round(CASE WHEN pmi >= 0 THEN pmi ELSE npmi END, 6) + 0.0 AS y FROM scored",
    "assoc_unseen": f"""{UNSEEN}, {TOTALS}, {SMOOTH},
 y AS (SELECT x.w, x.c, x.cooc, CASE WHEN x.cooc > 0 THEN {PMI.replace('ln(x.cooc::DOUBLE)', 'ln(greatest(x.cooc, 1)::DOUBLE)')} END AS pmi, CASE WHEN x.cooc > 0 THEN -(ln(greatest(x.cooc, 1)::DOUBLE) - ln(s.cds_total)) END AS width
  FROM looked x JOIN rows_ r ON x.w = r.w JOIN cols k ON x.c = k.c, smooth s)
SELECT w, c, cooc, round(CASE WHEN cooc > 0 THEN greatest(pmi, -0.5) ELSE -0.5 END, 6) + 0.0 AS cpmi,
 round(CASE WHEN cooc > 0 THEN pmi / width ELSE -1 END, 6) + 0.0 AS npmi,
 round(CASE WHEN cooc = 0 THEN -1 WHEN pmi >= 0 THEN pmi ELSE pmi / width END, 6) + 0.0 AS nnegpmi FROM y""",
    "process_all": f"{SCORED} SELECT w, count(*) AS n_cells FROM scored GROUP BY w",
    "process_gt": f"{SCORED} SELECT w, count(*) AS n_cells FROM scored WHERE npmi > 0.2500001 GROUP BY w",
    "process_leq": f"{SCORED} SELECT w, count(*) AS n_cells FROM scored WHERE npmi <= 0.2500001 GROUP BY w",
    "subsample_prob": f"""{VOCAB} SELECT w, freq, round(CASE WHEN freq > 0 THEN greatest(0.0::DOUBLE, 1 - sqrt({T}::DOUBLE / (freq::DOUBLE / n::DOUBLE))) ELSE 0 END, 6) + 0.0 AS p_drop FROM vocab, size""",
    "keep_prob": f"""{VOCAB} SELECT w, round(1 - CASE WHEN freq > 0 THEN greatest(0.0::DOUBLE, 1 - sqrt({T}::DOUBLE / (freq::DOUBLE / n::DOUBLE))) ELSE 0 END, 6) + 0.0 AS p_keep FROM vocab, size""",
    "subsampled_tokens": f"{VOCAB}, {_base(1)} SELECT doc_id, pos, w FROM kept",
    "noise_distribution": f"{NOISE} SELECT * FROM noise",
    "noise_draws": f"{NOISE} SELECT doc_id, sent, rn, k::BIGINT AS k, c FROM draws",
    "negative_pairs": f"{NOISE} SELECT w, c, count(*) AS n_draws FROM draws GROUP BY w, c",
    "cooc_em_aggregate": f"{SPOOL} SELECT * FROM spool",
    "cooc_em_replicate": f"{SPOOL} SELECT w, sum(sampled)::BIGINT AS n_lines, sum(cooc * sampled)::BIGINT AS sum_cooc FROM spool GROUP BY w",
    "cooc_em_shuffle": f"""{SPOOL}, lines AS (SELECT w, c, cooc, unnest(generate_series(1, sampled)) AS k FROM spool)
SELECT row_number() OVER (ORDER BY {_uniform(9, 'w', 'c', 'k')}, w, c, k) - 1 AS place, w, c, k, cooc FROM lines""",
    "lr_schedule": """SELECT step, round(greatest(0.025::DOUBLE * (1 - step / 50.0::DOUBLE), 0.025::DOUBLE * 1e-4), 9) AS rate
FROM (SELECT unnest(generate_series(0, 50))::BIGINT AS step)""",
    "char_ngrams": f"{VOCAB} SELECT w, ord, gram FROM ({_grams(False)})",
    "ngrams_codepoint": f"{VOCAB} SELECT w, ord, gram FROM ({_grams(True)})",
    "fnv_hash": f"{VOCAB} SELECT w, {_fnv('hex(encode(w))')} AS h FROM vocab",
    "word_subwords": f"""{VOCAB}, v AS (SELECT w, row_number() OVER (ORDER BY freq DESC, w) - 1 AS w_idx FROM vocab),
 g AS ({_grams(False)}), h AS (SELECT gram, {_fnv('gram')} AS h FROM (SELECT DISTINCT gram FROM g))
SELECT w_idx, 0::BIGINT AS ord, w_idx AS sw_idx FROM v UNION ALL
SELECT w_idx, ord, (SELECT count(*) FROM vocab) + h % {BUCKETS} AS sw_idx FROM g JOIN v USING (w) JOIN h USING (gram)""",
    "subword_file": f"""{VOCAB}, h AS (SELECT w, ceil(length(w) / 2)::BIGINT AS n FROM vocab),
 parts AS (SELECT w, unnest([substr(w, 1, n), substr(w, n + 1)]) AS sw, unnest([1, 2])::BIGINT AS ord FROM h)
SELECT w, ord, sw FROM parts""",
    "compose_vectors": f"SELECT label::BIGINT AS w_idx, CAST(i - 1 AS BIGINT) AS d, round(avg(x), 6) + 0.0 AS x FROM ({_PARTS}) GROUP BY label, i",
    "merge_context_vectors": f"""WITH parts AS ({_PARTS}), n AS (SELECT count(*) AS n FROM embeddings)
SELECT 'word' || w.vec_id::VARCHAR AS w, CAST(w.i - 1 AS BIGINT) AS d, round(w.x + c.x, 6) + 0.0 AS x
FROM n, parts w JOIN parts c ON (c.vec_id + 1) % n.n = w.vec_id AND c.i = w.i""",
    "embed_words": f"""WITH asked AS (
  SELECT DISTINCT w FROM (
   SELECT CASE WHEN t IN (chr(10), '.') THEN '</s>' ELSE t END AS w FROM (
    SELECT unnest(list_append(regexp_extract_all(text, '{token_pattern()}'), '</s>')) AS t FROM benchmark WHERE text IS NOT NULL)
   UNION ALL SELECT 'word' || label::VARCHAR FROM embeddings)),
 vocab AS (SELECT w, 0 AS freq FROM asked),
 labels AS (SELECT DISTINCT label, 'word' || label::VARCHAR AS w FROM embeddings),
 n AS (SELECT count(*) AS v, (SELECT count(*) FROM embeddings) AS r FROM labels),
 g AS ({_grams(False)}), h AS (SELECT gram, {_fnv('gram')} AS h FROM (SELECT DISTINCT gram FROM g)),
 rows_ AS (SELECT w, v + h % (r - v) AS vec_id FROM g JOIN h USING (gram), n UNION ALL SELECT w, label FROM labels),
 parts AS ({_PARTS}),
 means AS (SELECT w, i, avg(x) AS x FROM rows_ JOIN parts USING (vec_id) GROUP BY w, i)
SELECT a.w, CAST(d.i - 1 AS BIGINT) AS d, round(coalesce(m.x, 0), 6) + 0.0 AS x
FROM asked a CROSS JOIN (SELECT unnest(generate_series(1, {DIM})) AS i) d LEFT JOIN means m ON m.w = a.w AND m.i = d.i""",
    "sgd_batch_gradient": """WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings),
 ex AS (SELECT vec_id AS w_idx, (vec_id * k + 1) % (SELECT count(*) FROM v) AS c_idx, (vec_id % 5)::DOUBLE AS y FROM v, (SELECT unnest([3, 7, 11]) AS k)),
 e AS (SELECT w_idx, list_sum(list_transform(list_zip(a.v, b.v), lambda p: p[1] * p[2])) - y AS g, b.v AS cv
  FROM ex JOIN v a ON a.vec_id = w_idx JOIN v b ON b.vec_id = c_idx)
SELECT w_idx, CAST(i - 1 AS BIGINT) AS d, round(sum(g * x), 6) + 0.0 AS grad
FROM (SELECT w_idx, g, unnest(cv) AS x, generate_subscripts(cv, 1) AS i FROM e) GROUP BY w_idx, i""",
    "vectors_text": """SELECT vec_id AS idx, 'w' || vec_id::VARCHAR || ' ' || array_to_string(list_transform(embedding::DOUBLE[], lambda x: printf('%.6f', x)), ' ') AS value FROM embeddings""",
    "init_vectors": f"""SELECT vec_id AS row, k::BIGINT AS d, round(({_uniform(4, 'vec_id', 'k')} - 0.5) / 8.0::DOUBLE, 6) + 0.0 AS x
FROM embeddings, (SELECT unnest(generate_series(0, 7)) AS k)""",
    "train_full_batch": f"""{FULL_BATCH}
SELECT 0::BIGINT AS iteration, round(avg(0.5 * g * g), 9) AS half_sq_loss FROM g0
UNION ALL SELECT 1, round(avg(0.5 * g * g), 9) FROM g1""",
    "train_full_batch_vectors": f"{FULL_BATCH} SELECT r AS row, d::BIGINT AS d, round(w, 6) + 0.0 AS x FROM made",
    "file_vocab": f"{VOCAB} SELECT w, freq FROM vocab",
    "file_totals": f"{PAIRS}, {CELLS}, {TOTALS} SELECT w, total FROM rows_",
    "file_spool": """SELECT w_idx, c_idx, CAST(sum(cooc) AS BIGINT) AS cooc, count(*) AS n_lines
FROM cooc_line WHERE w_idx IS NOT NULL AND c_idx IS NOT NULL AND cooc > 0 GROUP BY w_idx, c_idx""",
    "file_vectors": _long("SELECT 'w' || vec_id::VARCHAR AS w, embedding::DOUBLE[] AS v FROM embeddings", "w"),
    "file_merge": _long("SELECT 'w' || vec_id::VARCHAR AS w, list_transform(embedding::DOUBLE[], lambda x: 3 * round(x, 6)) AS v FROM embeddings", "w"),
    "file_selected_output": """SELECT model::BIGINT AS model, name, n_lines::BIGINT AS n_lines FROM (VALUES
 (0, 'vectors.txt', 4), (0, 'vectors.txt.context', 4), (1, 'vectors.txt', 4), (1, 'vectors.txt.context', 0),
 (2, 'vectors.txt', 4), (2, 'vectors.txt.context', 0)) t(model, name, n_lines)""",
    "file_model": _long("SELECT vec_id AS row, embedding::DOUBLE[] AS v FROM embeddings", "row"),
    "embed_lines": f"""WITH {MODEL_ROWS}, asked AS ({ASKED} UNION SELECT w FROM known),
 vocab AS (SELECT w, 0 AS freq FROM asked), g AS ({_grams(False)}), h AS (SELECT gram, {_fnv('gram')} AS h FROM (SELECT DISTINCT gram FROM g)),
 rows_ AS (SELECT w, 10 + h % ((SELECT count(*) FROM embeddings) - 10) AS vec_id FROM g JOIN h USING (gram) UNION ALL SELECT w, idx FROM known),
 {MEANS}""",
    "embed_listed": f"""WITH {MODEL_ROWS}, asked AS (SELECT w FROM ({ASKED}) WHERE length(w) > 1),
 sub AS (SELECT w, unnest([hex(encode(substr(w, 1, 1))), hex(encode(substr(w, 2)))]) AS gram FROM asked),
 rows_ AS (SELECT w, 10 + {_fnv('gram')} % ((SELECT count(*) FROM embeddings) - 10) AS vec_id FROM sub
  UNION ALL SELECT w, idx FROM known JOIN asked USING (w)),
 {MEANS}""",
    "subword_list_check": f"""{VOCAB} SELECT w, unnest(['unlisted', 'malformed']) AS fault FROM vocab WHERE length(w) <= 3""",
    "p6_found": """
SELECT w_idx FROM cooc_line WHERE w_idx IS NOT NULL GROUP BY w_idx
HAVING count(*) * 100 >= (SELECT count(*) FROM cooc_line)
""",
    "p6_word_totals": """
SELECT w_idx, CAST(sum(delivered) AS BIGINT) AS n_rows,
       CAST(coalesce(sum(CASE WHEN c_idx IS NOT NULL THEN cooc END), 0) AS BIGINT) AS sum_cooc,
       count(DISTINCT CASE WHEN cooc > 0 THEN c_idx END) AS n_contexts
FROM (SELECT corpus_id, run_no, w_idx, c_idx, max(cooc) AS cooc, count(*) AS delivered
      FROM cooc_line WHERE w_idx IS NOT NULL GROUP BY ALL) GROUP BY w_idx
""",
}
