"""DuckDB SQL that recomputes each registered query from the driver tables.

Written independently of the Spark code from the pinned definitions; used by
the driver's correctness gate and by ``tools/oracle_check.py``.
"""

from __future__ import annotations

WS = r"[\t\n\x0B\f\r ]"

# documents -> chunks (length 250), the same packing rule as operators.chunk
CHUNKS_CTE = r"""
_d AS (
  SELECT doc_id, source || '/' || CAST(doc_id AS VARCHAR) || '.txt' AS filename,
    list_transform(regexp_extract_all(text, '(?s).+?[.!?]+(?:[\t\n\x0B\f\r ]+|\z)|.+\z'), lambda r, i: {
      'i': CAST(i AS INTEGER),
      's': regexp_replace(r, '^WS+|WS+$', '', 'g'),
      'w': CAST(len(list_filter(regexp_split_to_array(r, 'WS+'), lambda x: x <> '')) AS INTEGER),
      'fl': CAST(length(regexp_extract(r, '^WS*')) - length(replace(regexp_extract(r, '^WS*'), chr(12), '')) AS INTEGER),
      'ft': CAST(length(r) - length(replace(r, chr(12), '')) AS INTEGER)
    }) AS p
  FROM documents
),
_f AS (
  SELECT doc_id, filename, p,
    list_reduce(p, lambda acc, e: CASE WHEN e.w > 0 AND (acc.cur = 0 OR acc.cur + e.w > LENGTH_)
        THEN {'starts': list_append(acc.starts, e.i), 'pages': list_append(acc.pages, 1 + acc.ff + e.fl), 'cur': e.w, 'ff': acc.ff + e.ft}
        ELSE {'starts': acc.starts, 'pages': acc.pages, 'cur': acc.cur + e.w, 'ff': acc.ff + e.ft} END,
      {'starts': []::INTEGER[], 'pages': []::INTEGER[], 'cur': 0, 'ff': 0}) AS f
  FROM _d WHERE len(p) > 0
),
_c AS (
  SELECT doc_id, filename, p, f, CAST(unnest(range(0, len(f.starts))) AS INTEGER) AS chunk_no FROM _f
),
_m AS (
  SELECT doc_id, filename, chunk_no, f.pages[chunk_no + 1] AS page,
    list_filter(p[f.starts[chunk_no + 1] : coalesce(f.starts[chunk_no + 2], len(p) + 1) - 1], lambda e: e.w > 0) AS m
  FROM _c
),
chunks AS (
  SELECT md5(concat_ws(':', CAST(doc_id AS VARCHAR), CAST(chunk_no AS VARCHAR), txt)) AS chunk_id,
         doc_id, chunk_no, txt AS text, filename, page, n_words
  FROM (SELECT doc_id, chunk_no, array_to_string(list_transform(m, lambda e: e.s), ' ') AS txt, filename,
               CAST(page AS INTEGER) AS page, CAST(list_sum(list_transform(m, lambda e: e.w)) AS INTEGER) AS n_words
        FROM _m)
)""".replace("WS", WS)


def chunks_cte(length: int = 250) -> str:
    return CHUNKS_CTE.replace("LENGTH_", str(int(length)))


def with_(*ctes: str) -> str:
    return "WITH " + ",\n".join(c.strip() for c in ctes)


def recursive(*ctes: str) -> str:
    return "WITH RECURSIVE " + with_(*ctes)[5:]


SQL: dict[str, str] = {}

SQL["chunk_documents"] = with_(chunks_cte()) + "\nSELECT * FROM chunks"

SQL["word_count"] = f"""
SELECT doc_id, CAST(len(list_filter(regexp_split_to_array(text, '{WS}+'), lambda x: x <> '')) AS INTEGER) AS n_words
FROM documents"""

SQL["split_sentences"] = rf"""
SELECT doc_id, CAST(sent_no AS INTEGER) AS sent_no, sentence FROM (
  SELECT doc_id, generate_subscripts(s, 1) - 1 AS sent_no, unnest(s) AS sentence FROM (
    SELECT doc_id, list_filter(list_transform(regexp_extract_all(text, '(?s).+?[.!?]+(?:[\t\n\x0B\f\r ]+|\z)|.+\z'),
             lambda r: regexp_replace(r, '^{WS}+|{WS}+$', '', 'g')), lambda x: x <> '') AS s
    FROM documents))"""

SQL["chunk_stats"] = with_(chunks_cte(), """
_cc AS (SELECT doc_id, count(*) AS n_chunks, sum(n_words) AS n_words FROM chunks GROUP BY doc_id)""") + """
SELECT d.source, count(*) AS n_files, CAST(coalesce(sum(c.n_chunks), 0) AS BIGINT) AS n_chunks,
       CAST(coalesce(sum(c.n_words), 0) AS BIGINT) AS n_words,
       round(coalesce(sum(c.n_words) / nullif(sum(c.n_chunks), 0), 0.0), 6) AS avg_words
FROM documents d LEFT JOIN _cc c ON d.doc_id = c.doc_id GROUP BY d.source"""

# ---------------------------------------------------------------- vectors
VEC_CTE = """
vec AS (SELECT vec_id AS id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
kw AS (
  SELECT label AS keyword_id, 'label_' || CAST(label AS VARCHAR) AS keyword, list(x ORDER BY d) AS v
  FROM (SELECT label, d, avg(x) AS x
        FROM (SELECT label, CAST(unnest(embedding) AS DOUBLE) AS x, generate_subscripts(embedding, 1) AS d FROM embeddings)
        GROUP BY label, d)
  GROUP BY label)"""


def cos(a: str, b: str) -> str:
    den = f"(sqrt(list_dot_product({a}, {a})) * sqrt(list_dot_product({b}, {b})))"
    return f"(CASE WHEN {den} = 0 THEN 0.0 ELSE list_dot_product({a}, {b}) / {den} END)"


def l2(a: str, b: str) -> str:
    return f"sqrt(list_sum(list_transform(list_zip({a}, {b}), lambda p: (p[1] - p[2]) * (p[1] - p[2]))))"


def angle(c: str) -> str:
    return f"acos(greatest(-1.0, least(1.0, {c})))"


SQL["cosine"] = with_(VEC_CTE) + f"""
SELECT vec.id, round({cos('vec.v', 'kw.v')}, 6) AS cosine FROM vec JOIN kw ON vec.label = kw.keyword_id"""
SQL["angle"] = with_(VEC_CTE) + f"""
SELECT vec.id, round({angle(cos('vec.v', 'kw.v'))}, 6) AS angle FROM vec JOIN kw ON vec.label = kw.keyword_id"""
SQL["l2"] = with_(VEC_CTE) + f"""
SELECT vec.id, round({l2('vec.v', 'kw.v')}, 6) AS l2 FROM vec JOIN kw ON vec.label = kw.keyword_id"""
SQL["rbf"] = with_(VEC_CTE) + f"""
SELECT vec.id, round(exp(-1.0 * pow({l2('vec.v', 'kw.v')}, 2)), 6) AS rbf FROM vec JOIN kw ON vec.label = kw.keyword_id"""


def topk_sql(q: str, c: str, qid: str, cid: str, score: str, k: int | None, desc: bool = True,
             exclude_self: bool = False) -> str:
    """Brute-force top-k (the oracle may cross join; the Spark side never does)."""
    cond = f"WHERE {q}.{qid} <> {c}.{cid}" if exclude_self else ""
    order = "DESC" if desc else "ASC"
    lim = f"WHERE rank <= {k}" if k is not None else ""
    return f"""
SELECT * FROM (
  SELECT qid, cid, score, CAST(row_number() OVER (PARTITION BY qid ORDER BY round(score, 12) {order}, cid) AS INTEGER) AS rank
  FROM (SELECT {q}.{qid} AS qid, {c}.{cid} AS cid, {score} AS score FROM {q}, {c} {cond})) {lim}"""


SQL["retrieve_topk"] = with_(VEC_CTE) + f"""
SELECT qid AS query_id, rank, cid AS id, round(score, 6) AS score FROM ({topk_sql('kw', 'vec', 'keyword_id', 'id', cos('kw.v', 'vec.v'), 10)})"""

SQL["knn_graph"] = with_(VEC_CTE) + f"""
SELECT qid AS src, rank, cid AS dst, round({angle('score')}, 6) AS angle
FROM ({topk_sql('vec', 'vec2', 'id', 'id', cos('vec.v', 'vec2.v'), 5, exclude_self=True).replace('FROM vec, vec2', 'FROM vec, vec AS vec2')})"""

SQL["kw_text_similarity"] = with_(VEC_CTE) + f"""
SELECT kw.keyword_id, vec.id, round({cos('kw.v', 'vec.v')}, 6) AS score FROM kw, vec"""

SQL["closest"] = with_(VEC_CTE) + f"""
SELECT qid AS keyword_id, rank, cid AS id, round(score, 6) AS score FROM ({topk_sql('kw', 'vec', 'keyword_id', 'id', cos('kw.v', 'vec.v'), 5)})"""

SQL["farthest"] = with_(VEC_CTE) + f"""
SELECT qid AS keyword_id, rank, cid AS id, round(score, 6) AS score FROM ({topk_sql('kw', 'vec', 'keyword_id', 'id', cos('kw.v', 'vec.v'), 5, desc=False)})"""

SQL["nearest_to_center"] = with_(VEC_CTE) + f"""
SELECT qid AS cluster, rank, cid AS id, round(score, 6) AS dist FROM ({topk_sql('kw', 'vec', 'keyword_id', 'id', l2('kw.v', 'vec.v'), 5, desc=False)})"""


# ---------------------------------------------------------------- hashed embedding
def hashed(name: str, src: str, id_col: str, text_col: str, dim: int = 64) -> str:
    """CTEs {name}_s (id, b, x) normalised non-zero buckets and {name}_v (id, v)
    dense, with idf from the chunks CTE (which must be defined)."""
    return f"""
_voc AS (SELECT token, count(*) AS df FROM (SELECT DISTINCT chunk_id, unnest(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+')) AS token FROM chunks) GROUP BY token),
_nn AS (SELECT count(*) AS n FROM chunks),
{name}_w AS (
  SELECT o.id, CAST(('0x' || substr(md5(o.token), 1, 8))::BIGINT % {dim} AS INTEGER) AS b,
         ln((_nn.n + 1.0) / (coalesce(v.df, 0) + 1.0)) AS x
  FROM (SELECT {id_col} AS id, unnest(regexp_extract_all(lower({text_col}), '[\\p{{L}}\\p{{N}}]+')) AS token FROM {src}) o
  LEFT JOIN _voc v ON o.token = v.token, _nn),
{name}_r AS (SELECT id, b, sum(x) AS x FROM {name}_w GROUP BY id, b),
{name}_n AS (SELECT id, sqrt(sum(x * x)) AS n FROM {name}_r GROUP BY id),
{name}_s AS (SELECT r.id, r.b, CASE WHEN n.n = 0 THEN 0.0 ELSE r.x / n.n END AS x FROM {name}_r r JOIN {name}_n n USING (id)),
{name}_v AS (
  SELECT i.id, list(coalesce(s.x, 0.0) ORDER BY i.b) AS v
  FROM (SELECT {id_col} AS id, unnest(range({dim})) AS b FROM {src}) i
  LEFT JOIN {name}_s s ON i.id = s.id AND i.b = s.b GROUP BY i.id)"""


QUESTIONS_CTE = f"""
questions AS (SELECT item_id AS question_id, regexp_replace(text, '^{WS}+|{WS}+$', '', 'g') AS question FROM benchmark)"""

SQL["embed_text"] = with_(chunks_cte(), hashed("ce", "chunks", "chunk_id", "text")) + """
SELECT id, b AS bucket, round(x, 6) AS value FROM ce_s WHERE x <> 0"""

ANSWERS = with_(chunks_cte(), QUESTIONS_CTE, hashed("ce", "chunks", "chunk_id", "text"),
                hashed("qe", "questions", "question_id", "question").replace("_voc AS", "_voc2 AS").replace("_nn AS", "_nn2 AS")
                .replace("_voc v", "_voc2 v").replace(", _nn)", ", _nn2 AS _nn)"),
                f"""_top AS ({topk_sql('qe_v', 'ce_v', 'id', 'id', cos('qe_v.v', 'ce_v.v'), 10)})""",
                """answers AS (
  SELECT t.qid AS question_id, q.question, t.rank, t.cid AS chunk_id, c.filename, c.page, t.score
  FROM _top t JOIN chunks c ON t.cid = c.chunk_id JOIN questions q ON t.qid = q.question_id)""")

SQL["answer_questions"] = ANSWERS + """
SELECT question_id, question, rank, chunk_id, filename, page, round(score, 6) AS score FROM answers"""

SQL["answer_report"] = ANSWERS + """
SELECT question_id, 'question: ' || question || chr(10)
       || string_agg(CAST(rank - 1 AS VARCHAR) || '.' || filename || ' page: ' || CAST(page AS VARCHAR) || chr(10), '' ORDER BY rank)
       || repeat('=', 37) || chr(10) || chr(10) AS report
FROM answers GROUP BY question_id, question"""

# ---------------------------------------------------------------- text graph
KNN_CTE = f"""
knn AS (
  SELECT qid AS src, rank, cid AS dst, {angle('score')} AS angle
  FROM ({topk_sql('vec', 'vec2', 'id', 'id', cos('vec.v', 'vec2.v'), 5, exclude_self=True).replace('FROM vec, vec2', 'FROM vec, vec AS vec2')})),
tau AS (SELECT src AS id, sqrt(angle) AS tau FROM knn WHERE rank = 5),
ew AS (
  SELECT k.src, k.dst, CASE WHEN round(k.angle, 6) = 0 THEN 1.0 WHEN coalesce(a.tau * b.tau, 0.0) = 0 THEN 0.0
                            ELSE exp(-(k.angle * k.angle) / (a.tau * b.tau)) END AS w
  FROM knn k LEFT JOIN tau a ON k.src = a.id LEFT JOIN tau b ON k.dst = b.id),
sym AS (SELECT src, dst, sum(w) / 2 AS w FROM (SELECT src, dst, w FROM ew UNION ALL SELECT dst, src, w FROM ew) GROUP BY src, dst)"""

GRAPH = with_(VEC_CTE, KNN_CTE)

SQL["local_scale"] = GRAPH + "\nSELECT id, round(tau, 6) AS tau FROM tau"
SQL["edge_weights"] = GRAPH + "\nSELECT src, dst, round(w, 6) AS w FROM ew"
SQL["text_graph"] = GRAPH + "\nSELECT src, dst, round(w, 6) AS w FROM sym"
SQL["avg_degree"] = GRAPH + """
SELECT count(*) AS n_nodes, CAST(sum(d) / 2 AS BIGINT) AS n_edges, avg(d) AS avg_degree
FROM (SELECT src, count(DISTINCT dst) AS d FROM sym WHERE src <> dst GROUP BY src)"""

BFS_CTE = """
ue AS (SELECT DISTINCT src, dst FROM sym WHERE src <> dst),
bfs(s, v, d) USING KEY (s, v) AS (
  SELECT DISTINCT src, src, 0 FROM ue
  UNION
  SELECT b.s, ue.dst, min(b.d + 1) FROM bfs b JOIN ue ON b.v = ue.src
  WHERE NOT EXISTS (SELECT 1 FROM recurring.bfs r WHERE r.s = b.s AND r.v = ue.dst)
  GROUP BY b.s, ue.dst)"""

SQL["components"] = "WITH RECURSIVE " + with_(VEC_CTE, KNN_CTE, BFS_CTE)[5:] + """
SELECT v AS id, min(s) AS component FROM bfs GROUP BY v"""

SQL["diameter"] = "WITH RECURSIVE " + with_(VEC_CTE, KNN_CTE, BFS_CTE)[5:] + """,
comp AS (SELECT v, min(s) AS c FROM bfs GROUP BY v)
SELECT (SELECT count(*) FROM comp) AS n_nodes, (SELECT count(DISTINCT c) FROM comp) AS n_components,
       CASE WHEN (SELECT count(DISTINCT c) FROM comp) = 1 THEN CAST((SELECT max(d) FROM bfs) AS INTEGER) END AS diameter"""


SQL["text_graph_metrics"] = "WITH RECURSIVE " + with_(VEC_CTE, KNN_CTE, BFS_CTE)[5:] + """,
comp AS (SELECT v, min(s) AS c FROM bfs GROUP BY v),
deg AS (SELECT src, count(DISTINCT dst) AS d FROM sym WHERE src <> dst GROUP BY src)
SELECT (SELECT count(*) FROM comp) AS n_nodes, (SELECT CAST(sum(d) / 2 AS BIGINT) FROM deg) AS n_edges, (SELECT avg(d) FROM deg) AS avg_degree,
       (SELECT count(DISTINCT c) FROM comp) AS n_components,
       CASE WHEN (SELECT count(DISTINCT c) FROM comp) = 1 THEN CAST((SELECT max(d) FROM bfs) AS INTEGER) END AS diameter"""


# ---------------------------------------------------------------- keyword graph
def propagation_ctes(iters: int = 5, n1: int = 5, n2: int = 5) -> str:
    parts = [f"""
_close AS ({topk_sql('kw', 'vec', 'keyword_id', 'id', cos('kw.v', 'vec.v'), n1)}),
_far AS ({topk_sql('kw', 'vec', 'keyword_id', 'id', cos('kw.v', 'vec.v'), n2, desc=False)}),
seeds AS (SELECT keyword_id, id, min(seed) AS seed FROM (
  SELECT qid AS keyword_id, cid AS id, 1 AS seed FROM _close UNION ALL SELECT qid, cid, 0 FROM _far) GROUP BY keyword_id, id),
p0 AS (SELECT keyword_id, id, CAST(1 - seed AS DOUBLE) AS f0, CAST(seed AS DOUBLE) AS f1 FROM seeds)"""]
    for i in range(1, iters + 1):
        parts.append(f"""
m{i} AS (SELECT f.keyword_id, e.src AS id, sum(e.w * f.f0) AS a0, sum(e.w * f.f1) AS a1
        FROM sym e JOIN p{i - 1} f ON e.dst = f.id GROUP BY f.keyword_id, e.src),
n{i} AS (SELECT keyword_id, id, CASE WHEN a0 + a1 = 0 THEN 0.0 ELSE a0 / (a0 + a1) END AS f0,
               CASE WHEN a0 + a1 = 0 THEN 0.0 ELSE a1 / (a0 + a1) END AS f1 FROM m{i}),
p{i} AS (SELECT * FROM n{i} WHERE (f0 <> 0 OR f1 <> 0)
         AND NOT EXISTS (SELECT 1 FROM seeds s WHERE s.keyword_id = n{i}.keyword_id AND s.id = n{i}.id)
        UNION ALL SELECT keyword_id, id, CAST(1 - seed AS DOUBLE), CAST(seed AS DOUBLE) FROM seeds)""")
    parts.append(f"""
scores AS (SELECT * FROM p{iters}),
labels AS (SELECT keyword_id, id, CASE WHEN f1 > f0 THEN 1 ELSE 0 END AS label FROM scores)""")
    return ",".join(parts)


# The plain iteration, far beyond the step at which nothing moves any more.
CONVERGED_CTE = """
deg_free AS (SELECT src, dst, w FROM sym WHERE src <> dst AND w > 0),
scores(keyword_id, id, i, f0, f1) USING KEY (keyword_id, id) AS (
  SELECT keyword_id, id, 0, CAST(1 - seed AS DOUBLE), CAST(seed AS DOUBLE) FROM seeds
  UNION
  SELECT m.keyword_id, m.id, m.i, coalesce(CAST(1 - s.seed AS DOUBLE), a0 / (a0 + a1)), coalesce(CAST(s.seed AS DOUBLE), a1 / (a0 + a1))
  FROM (SELECT f.keyword_id, e.src AS id, max(f.i) + 1 AS i, sum(e.w * f.f0) AS a0, sum(e.w * f.f1) AS a1
        FROM scores f JOIN deg_free e ON e.dst = f.id GROUP BY f.keyword_id, e.src) m
  LEFT JOIN seeds s ON s.keyword_id = m.keyword_id AND s.id = m.id
  WHERE m.i <= 2500 AND a0 + a1 > 0),
labels AS (SELECT keyword_id, id, CASE WHEN f1 > f0 THEN 1 ELSE 0 END AS label FROM scores)"""
_START = propagation_ctes(iters=0).split(",\nscores AS")[0].rstrip().rstrip(",")
KWG = "WITH RECURSIVE " + with_(VEC_CTE, KNN_CTE, _START, CONVERGED_CTE)[5:]
SQL["seed_labels"] = KWG + "\nSELECT keyword_id, id, seed FROM seeds"
SQL["propagate"] = KWG + "\nSELECT keyword_id, id, round(f0, 4) AS f0, round(f1, 4) AS f1 FROM scores"
SQL["harden"] = KWG + "\nSELECT keyword_id, id, label FROM labels"
SQL["keyword_graph"] = KWG + """
SELECT a.keyword_id AS kw_a, b.keyword_id AS kw_b, count(*) AS w
FROM labels a JOIN labels b ON a.id = b.id AND a.keyword_id <> b.keyword_id
WHERE a.label = 1 AND b.label = 1 GROUP BY a.keyword_id, b.keyword_id"""

# ---------------------------------------------------------------- clusters
ASSIGN_CTE = f"""
assign AS (SELECT qid AS id, cid AS cluster, score AS dist FROM ({topk_sql('vec', 'kw', 'id', 'keyword_id', l2('vec.v', 'kw.v'), 1, desc=False)}))"""


def sample_ctes(assign: str, seed: int = 42, blocks: int = 5, name: str = "sampled") -> str:
    return f"""
_sz AS (SELECT cluster, count(*) AS n FROM {assign} GROUP BY cluster),
_ak AS (SELECT a.cluster, a.id, s.n, md5('{seed}:' || CAST(a.id AS VARCHAR)) AS key FROM {assign} a JOIN _sz s USING (cluster)),
_big AS (SELECT cluster, rank, id FROM (
  SELECT cluster, id, CAST(row_number() OVER (PARTITION BY cluster ORDER BY key, id) AS INTEGER) AS rank FROM _ak WHERE n > {blocks})
  WHERE rank <= {blocks}),
_small AS (SELECT cluster, id, row_number() OVER (PARTITION BY cluster ORDER BY key, id) - 1 AS pos FROM _ak WHERE n <= {blocks}),
_slots AS (SELECT cluster, n, CAST(unnest(range(1, {blocks + 1})) AS INTEGER) AS rank FROM _sz WHERE n <= {blocks}),
{name} AS (
  SELECT cluster, rank, id FROM _big
  UNION ALL
  SELECT s.cluster, s.rank, m.id FROM _slots s JOIN _small m ON s.cluster = m.cluster
    AND m.pos = ('0x' || substr(md5('{seed}:' || CAST(s.cluster AS VARCHAR) || ':' || CAST(s.rank AS VARCHAR)), 1, 8))::BIGINT % s.n)"""


SQL["assign_clusters"] = with_(VEC_CTE, ASSIGN_CTE) + "\nSELECT id, cluster, round(dist, 6) AS dist FROM assign"
SQL["cluster_sizes"] = with_(VEC_CTE, ASSIGN_CTE) + "\nSELECT cluster, count(*) AS n FROM assign GROUP BY cluster"
SQL["sample_members"] = with_(VEC_CTE, ASSIGN_CTE, sample_ctes("assign")) + "\nSELECT cluster, rank, id FROM sampled"


# ---------------------------------------------------------------- keywords
def _kw_consts():
    from lexgraph.operators.keywords import PROMPT, token_budget
    head = PROMPT.replace("{topic}", "public transport").replace("{l1}", "10").replace("{l2}", "3").replace("{avoid}", "")
    pre, post = head.split("{texts}")
    return token_budget(pre + post), pre, post


SRC_CTES = f"""
_cl AS (SELECT c.chunk_id AS id, d.source, v.v FROM chunks c JOIN documents d ON c.doc_id = d.doc_id JOIN ce_v v ON v.id = c.chunk_id),
_cent AS (SELECT source, list(x ORDER BY i) AS v FROM (
  SELECT source, i, avg(x) AS x FROM (SELECT source, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM _cl) GROUP BY source, i)
  GROUP BY source),
cent AS (SELECT CAST(dense_rank() OVER (ORDER BY source) - 1 AS INTEGER) AS cluster, v FROM _cent),
_center AS ({topk_sql('cent', 'ce_v', 'cluster', 'id', l2('cent.v', 'ce_v.v'), 5, desc=False)}),
_assign AS (SELECT qid AS id, cid AS cluster FROM ({topk_sql('ce_v', 'cent', 'id', 'cluster', l2('ce_v.v', 'cent.v'), 1, desc=False)})),
{sample_ctes('_assign', name='_random').strip()},
members AS (
  SELECT 'source' AS algo, qid AS cluster, 'center' AS kind, rank, cid AS id FROM _center
  UNION ALL SELECT 'source', cluster, 'random', rank, id FROM _random),
bundles AS (
  SELECT m.set_id, m.pos, m.id, c.text FROM (
    SELECT algo || ':' || CAST(cluster AS VARCHAR) AS set_id, id,
           CAST(row_number() OVER (PARTITION BY algo || ':' || CAST(cluster AS VARCHAR)
                ORDER BY CASE WHEN kind = 'center' THEN 0 ELSE 1 END, rank) AS INTEGER) AS pos
    FROM members) m JOIN chunks c ON m.id = c.chunk_id),
_tok AS (SELECT *, CAST(len(list_filter(regexp_split_to_array(text, '{WS}+'), lambda x: x <> '')) AS INTEGER) AS tokens,
                md5('42:' || set_id || ':' || CAST(pos AS VARCHAR)) AS key FROM bundles),
_run AS (SELECT *, CAST(row_number() OVER (PARTITION BY set_id ORDER BY key) AS INTEGER) AS "order",
                sum(tokens) OVER (PARTITION BY set_id ORDER BY key ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS running
         FROM _tok),
selected AS (SELECT set_id, "order", id, text, tokens FROM _run WHERE running <= BUDGET_)"""


def kw_chain() -> str:
    budget, _, _ = _kw_consts()
    return with_(chunks_cte(), hashed("ce", "chunks", "chunk_id", "text"), SRC_CTES.replace("BUDGET_", str(budget)))


TOPIC_CTE = """
_t AS (SELECT set_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') AS t FROM selected),
_g AS (SELECT set_id, unnest(list_transform(range(1, len(t) - n + 2), lambda i: array_to_string(t[i : i + n - 1], ' '))) AS keyword
       FROM _t, (VALUES (1), (2), (3)) AS ns(n) WHERE len(t) >= n),
_tf AS (SELECT set_id, keyword, count(*) AS tf FROM _g GROUP BY set_id, keyword),
_df AS (SELECT keyword, count(*) AS df FROM _tf GROUP BY keyword),
_ns AS (SELECT count(DISTINCT set_id) AS s FROM selected),
topic AS (SELECT set_id, rank, keyword, score FROM (
  SELECT t.set_id, t.keyword, t.tf * ln((_ns.s + 1.0) / (d.df + 1.0)) AS score,
         CAST(row_number() OVER (PARTITION BY t.set_id ORDER BY t.tf * ln((_ns.s + 1.0) / (d.df + 1.0)) DESC, t.keyword) AS INTEGER) AS rank
  FROM _tf t JOIN _df d USING (keyword), _ns) WHERE rank <= 10)"""

SQL["cluster_bundles"] = kw_chain() + "\nSELECT set_id, pos, id, text FROM bundles"
SQL["select_chunks"] = kw_chain() + "\nSELECT set_id, \"order\", id, text, tokens FROM selected"
_b, _pre, _post = _kw_consts()
SQL["render_prompts"] = kw_chain() + f"""
SELECT set_id, {"'" + _pre.replace("'", "''") + "'"} || string_agg(text, ' * ' ORDER BY "order") || {"'" + _post.replace("'", "''") + "'"} AS prompt
FROM selected GROUP BY set_id"""
SQL["topic_keywords"] = with_(kw_chain()[5:], TOPIC_CTE) + "\nSELECT set_id, rank, keyword, round(score, 6) AS score FROM topic"

# rounds of proposals: every state row carries the round that gave it (0: open)
ROUNDS_CTE = """
_avoid AS (SELECT DISTINCT keyword FROM topic WHERE rank = 1),
_sc AS (SELECT t.set_id, t.keyword, t.tf * ln((_ns.s + 1.0) / (d.df + 1.0)) AS score FROM _tf t JOIN _df d USING (keyword), _ns
        WHERE t.keyword NOT IN (SELECT keyword FROM _avoid)),
_rd AS (
  SELECT 0 AS turn, set_id, keyword, score, 0 AS g, true AS moved FROM _sc
  UNION ALL
  SELECT turn + 1, set_id, keyword, score, CASE WHEN win THEN turn + 1 ELSE g END, any_win FROM (
    SELECT *, max(win) OVER () AS any_win, max(CASE WHEN win OR g > 0 THEN 1 ELSE 0 END) OVER (PARTITION BY keyword) AS gone FROM (
      SELECT *, prop AND row_number() OVER (PARTITION BY keyword, prop ORDER BY score DESC, set_id) = 1 AS win FROM (
        SELECT *, g = 0 AND row_number() OVER (PARTITION BY set_id, g = 0 ORDER BY score DESC, keyword) <= 10 - held AS prop FROM (
          SELECT *, count(*) FILTER (g > 0) OVER (PARTITION BY set_id) AS held FROM _rd WHERE moved))))
  WHERE (g > 0 OR win OR gone = 0)),
rounds AS (SELECT set_id, CAST(row_number() OVER (PARTITION BY set_id ORDER BY score DESC, keyword) AS INTEGER) AS rank, keyword, score, g AS round
  FROM _rd WHERE turn = (SELECT max(turn) FROM _rd) AND g > 0)"""
SQL["keyword_rounds"] = recursive(kw_chain()[5:], TOPIC_CTE, ROUNDS_CTE) + "\nSELECT set_id, rank, keyword, round(score, 6) AS score, round FROM rounds"

PARSED = """
parsed AS (SELECT DISTINCT unnest(string_split(text, ',')) AS keyword FROM conversations WHERE role = 'assistant')"""
SQL["parse_keywords"] = with_(PARSED) + "\nSELECT keyword FROM parsed"
SQL["avoid_list"] = with_(PARSED) + "\nSELECT keyword FROM parsed ORDER BY md5('42:' || keyword), keyword LIMIT 300"
SQL["clean_keywords"] = with_(PARSED) + f"\nSELECT regexp_replace(lower(keyword), '^{WS}+', '') AS keyword FROM parsed"

TOK = "regexp_extract_all(lower(keyword), '[\\p{L}\\p{N}]+')"
DEDUP_CTE = f"""
_nk AS (SELECT keyword, count(*) AS n, array_to_string(list_sort(list_distinct({TOK})), ' ') AS key FROM parsed WHERE keyword IS NOT NULL GROUP BY keyword),
_one AS (SELECT k, arg_min(keyword, (-n, keyword)) AS keyword, sum(n) AS n FROM (
  SELECT keyword, n, CASE WHEN key <> '' THEN key ELSE chr(10) || regexp_replace(keyword, '^{WS}+|{WS}+$', '', 'g') END AS k FROM _nk) GROUP BY k),
_st AS (SELECT k, unnest(string_split(k, ' ')) AS w, len(string_split(k, ' ')) AS s FROM _one WHERE NOT starts_with(k, chr(10))),
_near AS (SELECT a.k AS a, b.k AS b FROM _st a JOIN _st b ON a.w = b.w AND a.k <> b.k
          GROUP BY a.k, b.k, a.s, b.s HAVING 5 * count(*) >= 3 * (a.s + b.s - count(*))),
_rk AS (SELECT k, row_number() OVER (ORDER BY n DESC, len(string_split(k, ' ')), k) AS r
        FROM _one WHERE k IN (SELECT a FROM _near)),
_nb AS (SELECT x.r, list(y.r) AS nb FROM _near JOIN _rk x ON x.k = a JOIN _rk y ON y.k = b GROUP BY x.r),
_walk AS (SELECT 0::BIGINT AS i, []::BIGINT[] AS kept
  UNION ALL
  SELECT r, CASE WHEN list_has_any(kept, nb) THEN kept ELSE list_append(kept, r) END FROM _walk JOIN _nb ON r = i + 1),
_lead AS (SELECT unnest(kept) AS r FROM _walk WHERE i = (SELECT max(i) FROM _walk)),
dedup AS (SELECT keyword FROM _one WHERE k NOT IN (SELECT k FROM _rk) OR k IN (SELECT k FROM _rk JOIN _lead USING (r)))"""


def split_cte(src: str, name: str) -> str:
    way = "CASE WHEN e.d{0} IS NOT NULL AND w.b{1} IS NOT NULL THEN {{'p': w.b{1}.p + 1, 'f': w.b{1}.f - e.d{0}, 's': list_append(w.b{1}.s, e.p{0})}} END"
    ways = ", ".join(way.format(x, x - 1) for x in (1, 2, 3))
    return f"""
{name}_k AS (SELECT DISTINCT keyword, {TOK} AS t FROM {src} WHERE keyword IS NOT NULL),
{name}_g AS (SELECT phrase, count(*) AS df FROM (
  SELECT DISTINCT chunk_id, unnest(list_transform(range(1, len(t) - n + 2), lambda i: array_to_string(t[i : i + n - 1], ' '))) AS phrase
  FROM (SELECT chunk_id, regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+') AS t FROM chunks), (VALUES (1), (2), (3)) AS ns(n) WHERE len(t) >= n)
  GROUP BY phrase),
{name}_e AS (SELECT keyword, len(t) AS n, j, l, array_to_string(t[j - l + 1 : j], ' ') AS phrase
  FROM (SELECT keyword, t, unnest(range(1, len(t) + 1)) AS j FROM {name}_k WHERE len(t) > 1), (VALUES (1), (2), (3)) AS ls(l) WHERE l <= j),
{name}_d AS (SELECT e.*, df, max(CASE WHEN l = n THEN df END) OVER (PARTITION BY keyword) AS whole FROM {name}_e e LEFT JOIN {name}_g USING (phrase)),
{name}_w AS (SELECT keyword, n, j, {', '.join(f"max(CASE WHEN l = {x} AND ok THEN df END) AS d{x}, max(CASE WHEN l = {x} AND ok THEN phrase END) AS p{x}" for x in (1, 2, 3))}
  FROM (SELECT *, df >= greatest(2, 4 * coalesce(whole, 0)) AND l <> n AND phrase NOT IN ('things', 'stuff', 'technology') AS ok FROM {name}_d)
  GROUP BY keyword, n, j),
{name}_r AS (
  SELECT DISTINCT keyword, 0::BIGINT AS j, {{'p': 0::BIGINT, 'f': 0::BIGINT, 's': []::VARCHAR[]}} AS b0,
         CAST(NULL AS STRUCT(p BIGINT, f BIGINT, s VARCHAR[])) AS b1, CAST(NULL AS STRUCT(p BIGINT, f BIGINT, s VARCHAR[])) AS b2 FROM {name}_w
  UNION ALL
  SELECT w.keyword, e.j, list_sort(list_filter([{ways}], lambda x: x IS NOT NULL))[1], w.b0, w.b1
  FROM {name}_r w JOIN {name}_w e ON e.keyword = w.keyword AND e.j = w.j + 1),
{name}_cut AS (SELECT r.keyword, r.b0.s AS seg FROM {name}_r r JOIN (SELECT DISTINCT keyword, n FROM {name}_w) x ON x.keyword = r.keyword AND x.n = r.j
  WHERE r.b0 IS NOT NULL),
{name}_kept AS (SELECT keyword, array_to_string(list_sort(list_distinct(t)), ' ') AS k FROM {name}_k WHERE keyword NOT IN (SELECT keyword FROM {name}_cut)),
{name} AS (SELECT keyword FROM {name}_kept UNION ALL
  SELECT keyword FROM (SELECT DISTINCT unnest(seg) AS keyword FROM {name}_cut)
  WHERE array_to_string(list_sort(list_distinct({TOK})), ' ') NOT IN (SELECT k FROM {name}_kept))"""


def broad_cte(src: str, name: str) -> str:
    return f"""
{name}_k AS (SELECT keyword, list_distinct({TOK}) AS t FROM {src} WHERE len({TOK}) > 0 AND lower(keyword) NOT IN ('things', 'stuff', 'technology')),
{name}_kt AS (SELECT keyword, len(t) AS m, unnest(t) AS token FROM {name}_k),
{name}_ct AS (SELECT DISTINCT chunk_id, unnest(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+')) AS token FROM chunks),
{name}_df AS (SELECT keyword, count(*) AS df FROM (
  SELECT kt.keyword, kt.m, ct.chunk_id, count(*) AS h FROM {name}_kt kt JOIN {name}_ct ct USING (token) GROUP BY kt.keyword, kt.m, ct.chunk_id)
  WHERE h = m GROUP BY keyword),
{name} AS (SELECT keyword FROM {name}_k WHERE keyword NOT IN (
  SELECT keyword FROM {name}_df WHERE df > 0.5 * (SELECT count(*) FROM chunks)))"""


SQL["dedup_keywords"] = recursive(PARSED, DEDUP_CTE) + "\nSELECT keyword FROM dedup"
SQL["split_keywords"] = recursive(chunks_cte(), PARSED, split_cte("parsed", "splitted")) + "\nSELECT keyword FROM splitted"
SQL["drop_broad"] = with_(chunks_cte(), PARSED, broad_cte("parsed", "kept")) + "\nSELECT keyword FROM kept"
SQL["cleanup_keywords"] = recursive(chunks_cte(), PARSED, DEDUP_CTE, split_cte("dedup", "splitted"), broad_cte("splitted", "kept")) + f"""
SELECT regexp_replace(lower(keyword), '^{WS}+', '') AS keyword FROM kept"""
SQL["flag_pattern"] = """
SELECT conv_id, turn, regexp_matches(text, '[Tt]he [a-z]+tion') AS flagged FROM conversations WHERE role = 'assistant'"""

# ------------------------------------------- what must hold of results that are not unique
SQL["kmeans_holds"] = """
SELECT * FROM (SELECT 'points' AS property, count(*) AS value FROM embeddings
UNION ALL SELECT 'points in the nearest cluster', count(*) FROM embeddings
UNION ALL SELECT 'clusters', 20
UNION ALL SELECT 'coordinates of centres that are means', 20 * max(len(embedding)) FROM embeddings
UNION ALL SELECT 'cost at most the library''s', 1)"""
SQL["extract_clusters_holds"] = """
SELECT a || ' ' || k || ': clusters of five' AS property, 1::BIGINT AS value
FROM (VALUES ('kmeans'), ('spectral')) x(a), (VALUES ('center'), ('random')) y(k)
UNION ALL SELECT 'odd groups and unknown members', 0"""
SQL["spectral_embedding_holds"] = """
SELECT 'points' AS property, count(*) AS value FROM embeddings
UNION ALL SELECT * FROM (VALUES ('columns', 25), ('orthonormal columns', 25), ('eigenvectors', 25), ('falling eigenvalues', 24))"""
SQL["spectral_clusters_holds"] = """
SELECT 'points' AS property, count(*) AS value FROM embeddings
UNION ALL SELECT 'points in the nearest cluster', count(*) FROM embeddings UNION ALL SELECT 'clusters', 20"""
SQL["keyword_network_holds"] = with_(chunks_cte()) + """
SELECT 'chunks' AS property, count(*) AS value FROM chunks UNION ALL SELECT 'vectors', count(*) FROM chunks
UNION ALL SELECT 'texts in the graph', count(*) FROM chunks
UNION ALL SELECT * FROM (VALUES ('clusters by k-means', 4), ('clusters by the spectral map', 4), ('uneven text edges', 0), ('uneven keyword edges', 0),
  ('pairs that share too many texts', 0), ('unknown keywords', 0), ('keywords and pairs', 1))"""
SQL["knn_descent_holds"] = """
SELECT 'pairs' AS property, 5 * count(*) AS value FROM embeddings
UNION ALL SELECT * FROM (VALUES ('nine in ten found', 1), ('wrong angles', 0))"""

# ---------------------------------------------------------------- html
_ENT = [("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "),
        ("&copy;", "©"), ("&middot;", "·"), ("&amp;", "&")]


def unesc(x: str) -> str:
    for a, b in _ENT:
        x = f"replace({x}, '{a}', '{b.replace(chr(39), chr(39) * 2)}')"
    return x


def attr_sql(tag: str, name: str) -> str:
    pat = f"""(?i)\\s{name}\\s*=\\s*("[^"]*"|'[^']*'|[^\\s>]+)""".replace("'", "''")
    val = f"regexp_replace(regexp_extract({tag}, '{pat}', 1), '^[\"'']|[\"'']$', '', 'g')"
    return f"CASE WHEN regexp_matches({tag}, '{pat}') THEN {unesc(val)} END"


ANCHORS_CTE = f"""
_clean AS (SELECT page_id, regexp_replace(html, '(?is)<!--.*?-->|<script\\b[^>]*>.*?</script\\s*>|<style\\b[^>]*>.*?</style\\s*>', '', 'g') AS html FROM pages),
_tags AS (SELECT page_id, unnest(regexp_extract_all(html, '(?i)<a(\\s[^>]*)?>', 0)) AS tag,
                 unnest(range(len(regexp_extract_all(html, '(?i)<a(\\s[^>]*)?>', 0)))) AS pos FROM _clean),
anchors AS (SELECT page_id, CAST(pos AS INTEGER) AS pos, {attr_sql('tag', 'href')} AS href, {attr_sql('tag', 'class')} AS class FROM _tags),
links AS (SELECT page_id, CAST(row_number() OVER (PARTITION BY page_id ORDER BY pos) - 1 AS INTEGER) AS pos, href, class
          FROM anchors WHERE href IS NOT NULL)"""

SQL["extract_links"] = with_(ANCHORS_CTE) + "\nSELECT page_id, pos, href, class FROM links"
SQL["filter_links"] = with_(ANCHORS_CTE) + "\nSELECT page_id, pos, href, class FROM links WHERE starts_with(href, '/t')"
SQL["page_title"] = f"""
SELECT page_id, replace({unesc("regexp_replace(regexp_extract(html, '(?is)<h1\\b[^>]*>(.*?)</h1>', 1), '<[^>]*>', '', 'g')")}, ' ', '_') AS title
FROM pages"""

_DL_PAT = """<a\\s[^>]*class\\s*=\\s*["''](?:[^"'']*\\s)?detail__header__button(?:\\s[^"'']*)?["''][^>]*>"""
_BOX_PAT = """(?is)<div\\b[^>]*class\\s*=\\s*["'']?[^"''>]*detail__header__column[^>]*>(.*?)</div>"""
RECORDS_CTE = f"""
_pg AS (SELECT page_id, html,
               CASE WHEN regexp_matches(html, '{_DL_PAT}') THEN regexp_extract(html, '{_DL_PAT}', 0) END AS dl,
               CASE WHEN regexp_matches(place, '(?is)<h1\\b[^>]*>.*?</h1>') THEN regexp_extract(place, '(?is)<h1\\b[^>]*>(.*?)</h1>', 1) END AS h1
        FROM (SELECT *, CASE WHEN regexp_matches(html, '{_BOX_PAT}') THEN regexp_extract(html, '{_BOX_PAT}', 1) ELSE html END AS place FROM pages)),
_trs AS (SELECT page_id, unnest(regexp_extract_all(html, '(?is)<tr\\b[^>]*>(.*?)</tr>', 1)) AS tr,
                unnest(range(len(regexp_extract_all(html, '(?is)<tr\\b[^>]*>(.*?)</tr>', 1)))) AS row FROM pages),
_cells AS (SELECT page_id, row, regexp_extract_all(tr, '(?is)<td\\b[^>]*>(.*?)</td>', 1) AS c FROM _trs),
_lv AS (SELECT page_id, row,
               regexp_replace({unesc("regexp_replace(c[1], '<[^>]*>', '', 'g')")}, '^{WS}+|{WS}+$', '', 'g') AS label,
               regexp_replace({unesc("regexp_replace(c[2], '<[^>]*>', '', 'g')")}, '^{WS}+|{WS}+$', '', 'g') AS value
        FROM _cells WHERE len(c) >= 2),
_attrs AS (SELECT page_id, max_by(value, row) FILTER (WHERE label = 'Organisatie') AS organisatie,
                  max_by(value, row) FILTER (WHERE label = 'Opleiding') AS opleiding FROM _lv GROUP BY page_id),
records AS (
  SELECT p.page_id, 'https://example.org' || ({attr_sql('p.dl', 'href')}) AS download_url,
         replace({unesc("regexp_replace(p.h1, '<[^>]*>', '', 'g')")}, ' ', '_') AS title,
         a.organisatie, a.opleiding
  FROM _pg p LEFT JOIN _attrs a ON p.page_id = a.page_id),
paths AS (
  SELECT *, CASE WHEN title IS NOT NULL THEN concat(coalesce(replace(organisatie, ' ', '_') || '/' || replace(opleiding, ' ', '_') || '/', ''),
            (CASE WHEN regexp_matches(title, '^[^.].*\\.[^.]*$') OR regexp_matches(title, '^\\..*\\.[^.]*$')
                  THEN regexp_extract(title, '^(.*)\\.[^.]*$', 1) ELSE title END) || '.pdf') END AS path
  FROM records)"""

SQL["page_records"] = with_(RECORDS_CTE) + "\nSELECT page_id, download_url, title, organisatie, opleiding FROM records"
SQL["target_path"] = with_(RECORDS_CTE) + "\nSELECT page_id, path FROM paths"
SQL["limit_records"] = with_(RECORDS_CTE) + "\nSELECT page_id, title, path FROM paths ORDER BY page_id LIMIT 1000"

# ---------------------------------------------------------------- more coverage
SQL["chunk_documents_lang"] = with_(chunks_cte()) + """
SELECT * FROM chunks"""
SQL["token_count"] = with_(chunks_cte()) + f"""
SELECT chunk_id, CAST(len(list_filter(regexp_split_to_array(text, '{WS}+'), lambda x: x <> '')) AS INTEGER) AS tokens FROM chunks"""
SQL["embed_missing"] = with_(chunks_cte(), hashed("ce", "chunks", "chunk_id", "text")) + """
SELECT s.id, s.b AS bucket, round(s.x, 6) AS value FROM ce_s s
WHERE s.x <> 0 AND s.id NOT IN (SELECT c.chunk_id FROM chunks c JOIN documents d ON c.doc_id = d.doc_id WHERE d.lang = 'en')"""
SQL["embed_keywords"] = with_(chunks_cte(), PARSED, hashed("ke", "parsed", "keyword", "keyword")) + """
SELECT id AS keyword, b AS bucket, round(x, 6) AS value FROM ke_s WHERE x <> 0"""
SQL["check_dim"] = "SELECT vec_id AS id, CAST(len(embedding) AS INTEGER) AS dim FROM embeddings"
SQL["all_embeddings"] = with_(chunks_cte()) + "\nSELECT chunk_id AS id, 64 AS dim FROM chunks"
SQL["get_by_ids"] = ANSWERS + """
SELECT chunk_id, doc_id, chunk_no, page FROM chunks WHERE chunk_id IN (SELECT chunk_id FROM answers)"""
SQL["label_keywords"] = with_(VEC_CTE) + """
SELECT keyword_id, keyword, CAST(generate_subscripts(v, 1) - 1 AS INTEGER) AS d, round(unnest(v), 6) AS value FROM kw"""
SQL["answers"] = with_(kw_chain()[5:], TOPIC_CTE) + """
SELECT set_id, string_agg(keyword, ',' ORDER BY rank) AS answer FROM topic GROUP BY set_id"""
SQL["next_page"] = with_(ANCHORS_CTE) + """,
_arrows AS (SELECT page_id, href, class, row_number() OVER (PARTITION BY page_id ORDER BY pos) AS n FROM anchors
            WHERE list_contains(regexp_split_to_array(coalesce(class, ''), '\\s+'), 'search__body__pagination__arrow'))
SELECT p.page_id, CASE WHEN list_contains(regexp_split_to_array(coalesce(a.class, ''), '\\s+'), 'is-disabled') THEN NULL ELSE a.href END AS next_href
FROM pages p LEFT JOIN (SELECT * FROM _arrows WHERE n = 2) a ON p.page_id = a.page_id"""
SQL["table_attributes"] = with_(RECORDS_CTE) + """
SELECT p.page_id, a.organisatie, a.opleiding FROM pages p LEFT JOIN _attrs a ON p.page_id = a.page_id"""
SQL["pending_downloads"] = with_(RECORDS_CTE) + """
SELECT p.page_id, p.path FROM paths p
WHERE p.path IS NOT NULL AND p.path NOT IN (SELECT q.path FROM paths q JOIN pages g ON q.page_id = g.page_id WHERE contains(g.url, '/fr/') AND q.path IS NOT NULL)"""


def rows_propagation_ctes(iters: int = 5, gamma: float = 20.0) -> str:
    parts = [f"""
_nodes AS (SELECT src AS id FROM sym UNION SELECT dst FROM sym),
_sq AS (SELECT src AS id, sum(w * w) AS s FROM sym GROUP BY src),
_dp AS (SELECT a.src AS i, b.src AS j, sum(a.w * b.w) AS d FROM sym a JOIN sym b ON a.dst = b.dst GROUP BY a.src, b.src),
_kern AS (
  SELECT n1.id AS i, n2.id AS j,
         exp(-{gamma} * greatest(coalesce(s1.s, 0) + coalesce(s2.s, 0) - 2 * coalesce(dp.d, 0), 0)) AS k
  FROM _nodes n1 CROSS JOIN _nodes n2
  LEFT JOIN _sq s1 ON s1.id = n1.id LEFT JOIN _sq s2 ON s2.id = n2.id
  LEFT JOIN _dp dp ON dp.i = n1.id AND dp.j = n2.id),
r0 AS (
  SELECT kk.keyword_id, n.id, CASE WHEN s.seed IS NULL THEN 0.0 ELSE CAST(1 - s.seed AS DOUBLE) END AS f0,
         CASE WHEN s.seed IS NULL THEN 0.0 ELSE CAST(s.seed AS DOUBLE) END AS f1
  FROM _nodes n CROSS JOIN (SELECT DISTINCT keyword_id FROM seeds) kk
  LEFT JOIN seeds s ON s.keyword_id = kk.keyword_id AND s.id = n.id)"""]
    for i in range(1, iters + 1):
        parts.append(f"""
rm{i} AS (SELECT r.keyword_id, k.i AS id, sum(k.k * r.f0) AS a0, sum(k.k * r.f1) AS a1
          FROM _kern k JOIN r{i - 1} r ON k.j = r.id GROUP BY r.keyword_id, k.i),
r{i} AS (SELECT m.keyword_id, m.id,
                CASE WHEN s.seed IS NOT NULL THEN CAST(1 - s.seed AS DOUBLE) WHEN m.a0 + m.a1 = 0 THEN 0.0 ELSE m.a0 / (m.a0 + m.a1) END AS f0,
                CASE WHEN s.seed IS NOT NULL THEN CAST(s.seed AS DOUBLE) WHEN m.a0 + m.a1 = 0 THEN 0.0 ELSE m.a1 / (m.a0 + m.a1) END AS f1
         FROM rm{i} m LEFT JOIN seeds s ON s.keyword_id = m.keyword_id AND s.id = m.id)""")
    return ",".join(parts)


SQL["propagate_rows"] = with_(VEC_CTE, KNN_CTE, propagation_ctes(iters=0), rows_propagation_ctes()) + """
SELECT keyword_id, id, round(f0, 6) AS f0, round(f1, 6) AS f1 FROM r5"""
