"""Named queries: (spark, sf_dir) -> DataFrame, one per operator."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexgraph.sources import tables as T
from lexgraph.operators import chunk as C
from lexgraph.functions.text import word_count

Q = {}


def register(name):
    def deco(fn):
        Q[name] = fn
        return fn
    return deco


def chunks_of(spark, sf_dir, length=250, persist=False):
    c = C.chunk_documents(T.corpus(spark, sf_dir), length=length)
    if persist:   # reused several times below: compute once
        from lexgraph.session import persist_step
        c = persist_step(c)
    return c


def chunk_emb_of(spark, sf_dir, chunks, dim=64):
    from lexgraph.session import persist_step
    return persist_step(EM.embed_text(chunks, id_col="chunk_id", dim=dim))


@register("chunk_documents")
def q_chunk_documents(spark, sf_dir):
    return chunks_of(spark, sf_dir)


@register("word_count")
def q_word_count(spark, sf_dir):
    return T.table(spark, sf_dir, "documents").select("doc_id", word_count("text").alias("n_words"))


@register("split_sentences")
def q_split_sentences(spark, sf_dir):
    return C.split_sentences(T.table(spark, sf_dir, "documents"))


@register("chunk_stats")
def q_chunk_stats(spark, sf_dir):
    return C.chunk_stats(chunks_of(spark, sf_dir), T.table(spark, sf_dir, "documents"), by="source")


# ------------------------------------------------------------------ vectors
from lexgraph.functions import vector as V  # noqa: E402
from lexgraph.operators import embed as EM  # noqa: E402
from lexgraph.operators import search as S  # noqa: E402


def r6(c):
    return F.round(c, 6)


def _vec_vs_center(spark, sf_dir):
    e = T.text_vectors(spark, sf_dir)
    kw = T.label_keywords(spark, sf_dir).select(F.col("keyword_id").alias("label"), F.col("embedding").alias("c"))
    return e.join(kw, "label")


@register("cosine")
def q_cosine(spark, sf_dir):
    return _vec_vs_center(spark, sf_dir).select("id", r6(V.cosine("embedding", "c")).alias("cosine"))


@register("angle")
def q_angle(spark, sf_dir):
    return _vec_vs_center(spark, sf_dir).select("id", r6(V.angle(V.cosine("embedding", "c"))).alias("angle"))


@register("l2")
def q_l2(spark, sf_dir):
    return _vec_vs_center(spark, sf_dir).select("id", r6(V.l2("embedding", "c")).alias("l2"))


@register("rbf")
def q_rbf(spark, sf_dir):
    return _vec_vs_center(spark, sf_dir).select("id", r6(V.rbf("embedding", "c", 1.0)).alias("rbf"))


@register("retrieve_topk")
def q_retrieve_topk(spark, sf_dir):
    r = S.retrieve_topk(T.label_keywords(spark, sf_dir), T.text_vectors(spark, sf_dir), k=10, q_id="keyword_id")
    return r.withColumn("score", r6("score"))


@register("knn_graph")
def q_knn_graph(spark, sf_dir):
    r = S.knn_graph(T.text_vectors(spark, sf_dir), k=5)
    return r.withColumn("angle", r6("angle"))


@register("kw_text_similarity")
def q_kw_text_similarity(spark, sf_dir):
    r = S.kw_text_similarity(T.label_keywords(spark, sf_dir), T.text_vectors(spark, sf_dir))
    return r.withColumn("score", r6("score"))


@register("closest")
def q_closest(spark, sf_dir):
    return S.closest(T.label_keywords(spark, sf_dir), T.text_vectors(spark, sf_dir), 5).withColumn("score", r6("score"))


@register("farthest")
def q_farthest(spark, sf_dir):
    return S.farthest(T.label_keywords(spark, sf_dir), T.text_vectors(spark, sf_dir), 5).withColumn("score", r6("score"))


@register("nearest_to_center")
def q_nearest_to_center(spark, sf_dir):
    centers = T.label_keywords(spark, sf_dir).select(F.col("keyword_id").alias("cluster"), F.col("embedding").alias("center"))
    r = S.nearest_to_center(T.text_vectors(spark, sf_dir), centers, blocks=5)
    return r.withColumn("dist", r6("dist"))


@register("embed_text")
def q_embed_text(spark, sf_dir):
    e = EM.embed_text(chunks_of(spark, sf_dir, persist=True), id_col="chunk_id", dim=64)
    return (e.select("id", F.posexplode("embedding").alias("bucket", "value"))
            .filter(F.col("value") != 0).withColumn("value", r6("value")))


def _answers(spark, sf_dir):
    chunks = chunks_of(spark, sf_dir, persist=True)
    return S.answer_questions(T.questions(spark, sf_dir), chunks, chunk_emb=chunk_emb_of(spark, sf_dir, chunks),
                              k=10, dim=64)


@register("answer_questions")
def q_answer_questions(spark, sf_dir):
    return _answers(spark, sf_dir).withColumn("score", r6("score"))


@register("answer_report")
def q_answer_report(spark, sf_dir):
    return S.answer_report(_answers(spark, sf_dir))


# ------------------------------------------------------------------ graphs
from lexgraph.operators import textgraph as G  # noqa: E402
from lexgraph.operators import kwgraph as H  # noqa: E402


def _knn(spark, sf_dir, k=5):
    from lexgraph.session import persist_step
    return persist_step(S.knn_graph(T.text_vectors(spark, sf_dir), k=k))   # read twice by the weights: the kernel runs once


def graph_of(spark, sf_dir, k=5):
    return G.symmetrize(G.edge_weights(_knn(spark, sf_dir, k), k))


@register("local_scale")
def q_local_scale(spark, sf_dir):
    return G.local_scale(_knn(spark, sf_dir), 5).withColumn("tau", r6("tau"))


@register("edge_weights")
def q_edge_weights(spark, sf_dir):
    return G.edge_weights(_knn(spark, sf_dir), 5).withColumn("w", r6("w"))


@register("text_graph")
def q_text_graph(spark, sf_dir):
    return G.text_graph(T.text_vectors(spark, sf_dir), k=5).withColumn("w", r6("w"))


@register("avg_degree")
def q_avg_degree(spark, sf_dir):
    return G.avg_degree(graph_of(spark, sf_dir))


@register("components")
def q_components(spark, sf_dir):
    return G.components(graph_of(spark, sf_dir))


@register("diameter")
def q_diameter(spark, sf_dir):
    return G.diameter(graph_of(spark, sf_dir))


@register("text_graph_metrics")
def q_text_graph_metrics(spark, sf_dir):
    return G.text_graph(T.text_vectors(spark, sf_dir), k=5, metrics=True)[1]


def _kw_pipeline(spark, sf_dir, n=5):
    kw = T.label_keywords(spark, sf_dir)
    emb = T.text_vectors(spark, sf_dir)
    return H.build_keyword_graph(kw, emb, graph_of(spark, sf_dir), n1=n, n2=n)


@register("seed_labels")
def q_seed_labels(spark, sf_dir):
    kw, emb = T.label_keywords(spark, sf_dir), T.text_vectors(spark, sf_dir)
    return H.seed_labels(S.closest(kw, emb, 5), S.farthest(kw, emb, 5))


@register("propagate")
def q_propagate(spark, sf_dir):
    s = _kw_pipeline(spark, sf_dir)["scores"]
    # both engines iterate to the same limit, not to the same last bits
    return s.select("keyword_id", "id", F.round("f0", 4).alias("f0"), F.round("f1", 4).alias("f1"))


@register("harden")
def q_harden(spark, sf_dir):
    return _kw_pipeline(spark, sf_dir)["labels"]


@register("keyword_graph")
def q_keyword_graph(spark, sf_dir):
    return _kw_pipeline(spark, sf_dir)["Wk"]


# ------------------------------------------------------------------ clusters
from lexgraph.operators import cluster as CL  # noqa: E402
from lexgraph.operators import keywords as KW  # noqa: E402
from lexgraph.operators import spectral as SP  # noqa: E402


def _label_centers(spark, sf_dir):
    return T.label_keywords(spark, sf_dir).select(F.col("keyword_id").alias("cluster"), F.col("embedding").alias("center"))


def _assign(spark, sf_dir):
    return CL.assign_clusters(T.text_vectors(spark, sf_dir), _label_centers(spark, sf_dir))


@register("assign_clusters")
def q_assign_clusters(spark, sf_dir):
    return _assign(spark, sf_dir).withColumn("dist", r6("dist"))


@register("cluster_sizes")
def q_cluster_sizes(spark, sf_dir):
    return CL.cluster_sizes(_assign(spark, sf_dir))


@register("sample_members")
def q_sample_members(spark, sf_dir):
    return CL.sample_members(_assign(spark, sf_dir).select("id", "cluster"), blocks=5, seed=42)


@register("kmeans")
def q_kmeans(spark, sf_dir):
    assign, _, _ = CL.kmeans(T.text_vectors(spark, sf_dir), k=20, n_init=5, seed=42)
    return assign


@register("extract_clusters")
def q_extract_clusters(spark, sf_dir):
    return CL.extract_clusters(T.text_vectors(spark, sf_dir), k=20, blocks=5, seed=42)


# ------------------------------------------------------------------ keywords
TOPIC = "public transport"


def source_members(spark, sf_dir, blocks=5, seed=42):
    """Deterministic clusters for the keyword chain: one per document source,
    centre = mean chunk vector of the source; members = centre-nearest chunks
    and seeded random chunks of the nearest-centre assignment."""
    chunks = chunks_of(spark, sf_dir, persist=True)
    ce = chunk_emb_of(spark, sf_dir, chunks)
    docs = T.table(spark, sf_dir, "documents").select("doc_id", "source")
    x = (ce.join(chunks.select(F.col("chunk_id").alias("id"), "doc_id"), "id").join(docs, "doc_id")
         .select("source", F.posexplode("embedding").alias("d", "x")))
    m = x.groupBy("source", "d").agg(F.avg("x").alias("x"))
    cent = (m.groupBy("source").agg(F.array_sort(F.collect_list(F.struct("d", "x"))).alias("v"))
            .select("source", F.transform("v", lambda s: s["x"]).alias("center")))
    from pyspark.sql import Window
    cent = cent.withColumn("cluster", (F.dense_rank().over(Window.orderBy("source")) - 1).cast("int")).select("cluster", "center")
    from lexgraph.session import persist_step
    cent = persist_step(cent)
    center = S.nearest_to_center(ce, cent, blocks).select("cluster", "rank", "id")
    assign = CL.assign_clusters(ce, cent).select("id", "cluster")
    rand = CL.sample_members(assign, blocks, seed)
    members = (center.withColumn("kind", F.lit("center")).unionByName(rand.withColumn("kind", F.lit("random")))
               .withColumn("algo", F.lit("source")).select("algo", "cluster", "kind", "rank", "id"))
    return members, chunks


def _header():
    h = KW.PROMPT.replace("{topic}", TOPIC).replace("{l1}", "10").replace("{l2}", "3").replace("{avoid}", "")
    return h.replace("{texts}", "")


def _selected(spark, sf_dir):
    members, chunks = source_members(spark, sf_dir)
    b = KW.cluster_bundles(members, chunks)
    from lexgraph.session import persist_step
    return persist_step(KW.select_chunks(b, KW.token_budget(_header()), seed=42))


@register("cluster_bundles")
def q_cluster_bundles(spark, sf_dir):
    members, chunks = source_members(spark, sf_dir)
    return KW.cluster_bundles(members, chunks)


@register("select_chunks")
def q_select_chunks(spark, sf_dir):
    return _selected(spark, sf_dir)


@register("render_prompts")
def q_render_prompts(spark, sf_dir):
    return KW.render_prompts(_selected(spark, sf_dir), TOPIC, 10, 3)


@register("topic_keywords")
def q_topic_keywords(spark, sf_dir):
    return KW.topic_keywords(_selected(spark, sf_dir), 10, 3).withColumn("score", r6("score"))


@register("keyword_rounds")
def q_keyword_rounds(spark, sf_dir):
    """Rounds of proposals; the best keyword of each set is on the avoid list."""
    from lexgraph.session import persist_step
    scored = persist_step(KW.keyword_scores(_selected(spark, sf_dir), 3))
    avoid = KW._best(scored, 1).select("keyword").distinct()
    return KW.keyword_rounds(scored, 10, avoid=avoid).withColumn("score", r6("score"))


def _parsed(spark, sf_dir):
    conv = T.table(spark, sf_dir, "conversations").filter(F.col("role") == "assistant")
    return KW.parse_keywords(conv, col="text")


@register("parse_keywords")
def q_parse_keywords(spark, sf_dir):
    return _parsed(spark, sf_dir)


@register("avoid_list")
def q_avoid_list(spark, sf_dir):
    return KW.avoid_list(_parsed(spark, sf_dir), 300, seed=42)


@register("clean_keywords")
def q_clean_keywords(spark, sf_dir):
    return KW.clean_keywords(_parsed(spark, sf_dir))


@register("dedup_keywords")
def q_dedup_keywords(spark, sf_dir):
    return KW.dedup_keywords(_parsed(spark, sf_dir))


@register("split_keywords")
def q_split_keywords(spark, sf_dir):
    return KW.split_keywords(_parsed(spark, sf_dir), chunks_of(spark, sf_dir, persist=True))


@register("drop_broad")
def q_drop_broad(spark, sf_dir):
    return KW.drop_broad(_parsed(spark, sf_dir), chunks_of(spark, sf_dir, persist=True), 0.5)


@register("cleanup_keywords")
def q_cleanup_keywords(spark, sf_dir):
    return KW.cleanup_keywords(_parsed(spark, sf_dir), chunks_of(spark, sf_dir, persist=True), 0.5)


@register("flag_pattern")
def q_flag_pattern(spark, sf_dir):
    conv = T.table(spark, sf_dir, "conversations").filter(F.col("role") == "assistant")
    return KW.flag_pattern(conv, "[Tt]he [a-z]+tion", col="text").select("conv_id", "turn", "flagged")


# ------------------------------------------------------------------ what must hold of results that are not unique
def _holds(spark, rows):
    return spark.createDataFrame(rows, "property string, value long")


@register("kmeans_holds")
def q_kmeans_holds(spark, sf_dir):
    """Every point in the cluster of its nearest centre, every centre the mean of
    its points, and the cost not above that of the library's k-means."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector
    from lexgraph.session import persist_step
    e = T.text_vectors(spark, sf_dir)
    assign, centers, cost = CL.kmeans(e, k=20, n_init=5, seed=42)
    assign = persist_step(assign)
    near = CL.assign_clusters(e, centers).select("id", F.col("cluster").alias("nearest"))
    stay = assign.join(near, "id").filter(F.col("cluster") == F.col("nearest")).count()
    x = e.select("id", F.posexplode("embedding").alias("d", "x")).join(assign, "id").groupBy("cluster", "d").agg(F.avg(F.col("x").cast("double")).alias("x"))
    c = centers.select("cluster", F.posexplode("center").alias("d", "c"))
    means = x.join(c, ["cluster", "d"]).filter(F.abs(F.col("x") - F.col("c")) < 1e-9).count()
    v = persist_step(e.select(array_to_vector(F.col("embedding").cast("array<double>")).alias("features")))
    other = min(KMeans(k=20, seed=42 + i, maxIter=20).fit(v).summary.trainingCost for i in range(5))
    return _holds(spark, [("points", assign.count()), ("points in the nearest cluster", stay), ("clusters", centers.count()),
                          ("coordinates of centres that are means", means), ("cost at most the library's", int(cost <= other * (1 + 1e-9)))])


@register("extract_clusters_holds")
def q_extract_clusters_holds(spark, sf_dir):
    """Both algorithms; in each cluster five central and five random members, all of them points."""
    from lexgraph.session import persist_step
    e = T.text_vectors(spark, sf_dir)
    m = persist_step(CL.extract_clusters(e, k=20, blocks=5, seed=42))
    per = m.groupBy("algo", "cluster", "kind").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("rank").alias("r"), F.min("rank").alias("lo"))
    good = per.filter("n = 5 AND r = 5 AND lo = 1").groupBy("algo", "kind").agg(F.count(F.lit(1)).alias("n"))
    rows = [(f"{r['algo']} {r['kind']}: clusters of five", int(r["n"] >= 2)) for r in good.collect()]
    odd = per.filter("n <> 5").count() + m.join(e.select("id"), "id", "left_anti").count()
    return _holds(spark, [*rows, ("odd groups and unknown members", odd)])


@register("spectral_embedding_holds")
def q_spectral_embedding_holds(spark, sf_dir):
    """The 25 columns are orthonormal in the degrees, are eigenvectors of the walk
    (each gives one eigenvalue at all points) and the eigenvalues fall."""
    import numpy as np
    e = T.text_vectors(spark, sf_dir)
    from lexgraph.session import persist_step
    maps = persist_step(SP.spectral_embedding(e, n_components=25, gamma=1.0, seed=42, tol=1e-4).withColumnRenamed("map", "embedding"))
    n = maps.count()
    rows, aff = SP.affinity(e, 1.0)
    deg = persist_step(aff.times(rows.select("id", F.array(F.lit(1.0)).alias("z")), 1).select("id", F.col("y")[0].alias("d")))
    m = persist_step(maps.join(deg, "id").join(aff.times(maps.select("id", F.col("embedding").alias("z")), 25), "id")
                     .select("id", "embedding", F.transform("embedding", lambda v: v * F.col("d")).alias("dv"), F.col("y").alias("av")))
    gram = SP._products(m, F.col("embedding"), F.col("dv"), 25, 25)      # V^T D V = I
    ritz = SP._products(m, F.col("embedding"), F.col("av"), 25, 25)      # V^T A V = diag(eigenvalues)
    w = np.diag(ritz)
    left = m.select(F.zip_with("av", F.zip_with("dv", F.array(*[F.lit(float(x)) for x in w]), lambda a, b: a * b), lambda a, b: a - b).alias("r"))
    worst = float(np.sqrt(np.diag(SP._products(left, F.col("r"), F.col("r"), 25, 25)).max()))
    return _holds(spark, [("points", n), ("columns", len(w)), ("orthonormal columns", int((np.abs(gram - np.eye(25)).max(axis=1) < 1e-8).sum())),
                          ("eigenvectors", int(worst < 1e-5) * 25), ("falling eigenvalues", int((np.diff(w) < 1e-9).sum()))])


@register("spectral_clusters_holds")
def q_spectral_clusters_holds(spark, sf_dir):
    """Every point has one cluster, that of the nearest centre in the map."""
    from lexgraph.session import persist_step
    e = T.text_vectors(spark, sf_dir)
    assign, centers, space = SP.spectral_clusters(e, 20, seed=42)
    space, assign = persist_step(space), persist_step(assign)
    near = CL.assign_clusters(space, centers).select("id", F.col("cluster").alias("nearest"))
    stay = assign.join(near, "id").filter(F.col("cluster") == F.col("nearest")).count()
    return _holds(spark, [("points", assign.select("id").distinct().count()), ("points in the nearest cluster", stay), ("clusters", centers.count())])


@register("keyword_network_holds")
def q_keyword_network_holds(spark, sf_dir):
    """The whole run, documents to the graph of keywords: every chunk has its vector and takes
    part in the text graph, which is symmetric; the graph of keywords is symmetric
    without loops, and no pair shares more texts than the rarer keyword has."""
    from lexgraph.plans.network import keyword_network
    t = keyword_network(T.corpus(spark, sf_dir), TOPIC, k=4, blocks=5, l1=4, n1=5, n2=5, n_init=2, seed=42)
    wt, wk = t["Wt"], t["Wk"]
    turned = lambda e, a, b: e.select(F.col(b).alias(a), F.col(a).alias(b), F.col("w").alias("back"))
    odd = wt.join(turned(wt, "src", "dst"), ["src", "dst"], "left").filter(~(F.abs(F.col("w") - F.coalesce("back", F.lit(-1.0))) < 1e-12)).count()
    odd_kw = wk.join(turned(wk, "kw_a", "kw_b"), ["kw_a", "kw_b"], "left").filter(~F.col("w").eqNullSafe(F.col("back")) | (F.col("kw_a") == F.col("kw_b"))).count()
    held = t["labels"].filter("label = 1").groupBy(F.col("keyword_id").alias("kw_a")).agg(F.count(F.lit(1)).alias("n"))
    over = wk.join(held, "kw_a", "left").filter(F.col("w") > F.coalesce("n", F.lit(0))).count()
    known = wk.join(t["keywords"].select(F.col("keyword_id").alias("kw_a")), "kw_a", "left_anti").count()
    algos = {r["algo"]: r["n"] for r in t["members"].groupBy("algo").agg(F.countDistinct("cluster").alias("n")).collect()}
    return _holds(spark, [("chunks", t["chunks"].count()), ("vectors", t["vectors"].select("id").distinct().count()),
                          ("texts in the graph", wt.select("src").distinct().count()), ("clusters by k-means", algos.get("kmeans", 0)),
                          ("clusters by the spectral map", algos.get("spectral", 0)), ("uneven text edges", odd), ("uneven keyword edges", odd_kw),
                          ("pairs that share too many texts", over), ("unknown keywords", known),
                          ("keywords and pairs", int(t["keywords"].count() > 8 and wk.count() > 0))])


@register("knn_descent")
def q_knn_descent(spark, sf_dir):
    from lexgraph.operators.descent import knn_descent
    return knn_descent(T.text_vectors(spark, sf_dir), 5)


@register("knn_descent_holds")
def q_knn_descent_holds(spark, sf_dir):
    """Of the five exact neighbours of all points, nine in ten are found; angles are exact."""
    from lexgraph.operators.descent import knn_descent
    from lexgraph.session import persist_step
    e = T.text_vectors(spark, sf_dir)
    found, exact = persist_step(knn_descent(e, 5)), S.knn_graph(e, k=5)
    both = found.join(exact.select("src", "dst", F.col("angle").alias("true")), ["src", "dst"])
    hit, right = both.agg(F.count(F.lit(1)), F.sum((F.abs(F.col("angle") - F.col("true")) < 1e-6).cast("long"))).first()
    n = found.count()
    return _holds(spark, [("pairs", n), ("nine in ten found", int(10 * hit >= 9 * n)), ("wrong angles", hit - right)])


# ------------------------------------------------------------------ html
from lexgraph.operators import html as HT  # noqa: E402


@register("extract_links")
def q_extract_links(spark, sf_dir):
    return HT.extract_links(T.table(spark, sf_dir, "pages"))


@register("filter_links")
def q_filter_links(spark, sf_dir):
    return HT.filter_links(HT.extract_links(T.table(spark, sf_dir, "pages")), "/t")


@register("page_title")
def q_page_title(spark, sf_dir):
    return T.table(spark, sf_dir, "pages").select("page_id", HT.page_title().alias("title"))


@register("page_records")
def q_page_records(spark, sf_dir):
    return HT.page_records(T.table(spark, sf_dir, "pages"), base="https://example.org")


@register("target_path")
def q_target_path(spark, sf_dir):
    return HT.target_path(HT.page_records(T.table(spark, sf_dir, "pages"))).select("page_id", "path")


@register("limit_records")
def q_limit_records(spark, sf_dir):
    return HT.limit_records(HT.target_path(HT.page_records(T.table(spark, sf_dir, "pages"))), 1000).select("page_id", "title", "path")


# ------------------------------------------------------------------ more coverage


def _long(e, id_name="id"):
    return (e.select(F.col("id").alias(id_name), F.posexplode("embedding").alias("bucket", "value"))
            .filter(F.col("value") != 0).withColumn("value", r6("value")))


@register("chunk_documents_lang")
def q_chunk_documents_lang(spark, sf_dir):
    return C.chunk_documents(T.corpus(spark, sf_dir), length=250, language="fr")


@register("token_count")
def q_token_count(spark, sf_dir):
    return chunks_of(spark, sf_dir).select("chunk_id", KW.token_count("text").alias("tokens"))


@register("embed_missing")
def q_embed_missing(spark, sf_dir):
    """Chunks of English documents already have vectors; embed the rest."""
    chunks = chunks_of(spark, sf_dir, persist=True)
    en = T.table(spark, sf_dir, "documents").filter(F.col("lang") == "en").select("doc_id")
    have = EM.embed_text(chunks.join(en, "doc_id", "left_semi"), id_col="chunk_id", dim=64, corpus=chunks)
    return _long(EM.embed_missing(chunks, have, dim=64))


@register("embed_keywords")
def q_embed_keywords(spark, sf_dir):
    kw = _parsed(spark, sf_dir)
    chunks = chunks_of(spark, sf_dir, persist=True)
    e = EM.embed_keywords(kw, chunks, dim=64, id_col="keyword", text_col="keyword")
    return _long(e, "keyword")


@register("check_dim")
def q_check_dim(spark, sf_dir):
    e = EM.check_dim(T.text_vectors(spark, sf_dir), 64)
    return e.select("id", F.size("embedding").alias("dim"))


@register("all_embeddings")
def q_all_embeddings(spark, sf_dir):
    chunks = chunks_of(spark, sf_dir, persist=True)
    e = EM.all_embeddings(chunks, chunk_emb_of(spark, sf_dir, chunks), dim=64)
    return e.select("id", F.size("embedding").alias("dim"))


@register("get_by_ids")
def q_get_by_ids(spark, sf_dir):
    from lexgraph.sources.store import get_by_ids
    a = _answers(spark, sf_dir)
    chunks = chunks_of(spark, sf_dir, persist=True)
    return get_by_ids(chunks, a.select("chunk_id")).select("chunk_id", "doc_id", "chunk_no", "page")


@register("label_keywords")
def q_label_keywords(spark, sf_dir):
    kw = T.label_keywords(spark, sf_dir)
    return kw.select("keyword_id", "keyword", F.posexplode("embedding").alias("d", "value")).withColumn("value", r6("value"))


@register("answers")
def q_answers(spark, sf_dir):
    return KW.answers_from_keywords(KW.topic_keywords(_selected(spark, sf_dir), 10, 3))


@register("next_page")
def q_next_page(spark, sf_dir):
    return HT.next_page(T.table(spark, sf_dir, "pages"))


@register("table_attributes")
def q_table_attributes(spark, sf_dir):
    return HT.table_attributes(T.table(spark, sf_dir, "pages"))


@register("pending_downloads")
def q_pending_downloads(spark, sf_dir):
    """Pages under /fr/ are already downloaded; the rest are pending."""
    pages = T.table(spark, sf_dir, "pages")
    rec = HT.target_path(HT.page_records(pages))
    have = rec.join(pages.filter(F.col("url").contains("/fr/")).select("page_id"), "page_id", "left_semi").select("path")
    return HT.pending_downloads(rec, have).select("page_id", "path")


@register("spectral_embedding")
def q_spectral_embedding(spark, sf_dir):
    return SP.spectral_embedding(T.text_vectors(spark, sf_dir), n_components=25, gamma=1.0, seed=42)


@register("spectral_clusters")
def q_spectral_clusters(spark, sf_dir):
    return CL.extract_clusters(T.text_vectors(spark, sf_dir), k=20, blocks=5, seed=42, algos=("spectral",))


@register("graph_clusters")
def q_graph_clusters(spark, sf_dir):
    return SP.graph_clusters(graph_of(spark, sf_dir), k=10)


@register("propagate_rows")
def q_propagate_rows(spark, sf_dir):
    kw, emb = T.label_keywords(spark, sf_dir), T.text_vectors(spark, sf_dir)
    seeds = H.seed_labels(S.closest(kw, emb, 5), S.farthest(kw, emb, 5))
    s = H.propagate_rows(graph_of(spark, sf_dir), seeds, gamma=20.0, iters=5, tol=None)
    return s.select("keyword_id", "id", r6("f0").alias("f0"), r6("f1").alias("f1"))
