"""Inline edge cases (FIXTURES.md section 3)."""

import math

import numpy as np
from pyspark.sql import functions as F

from lexgraph.operators import chunk as C
from lexgraph.operators import cluster as CL
from lexgraph.operators import html as HT
from lexgraph.operators import keywords as KW
from lexgraph.operators import kwgraph as H
from lexgraph.operators import search as S
from lexgraph.operators import textgraph as G


def docs(spark, *texts):
    return spark.createDataFrame([(i, t, f"f{i}.txt") for i, t in enumerate(texts)], "doc_id long, text string, filename string")


def test_long_sentence_is_one_chunk(spark):
    t = " ".join(["w"] * 300) + "."
    r = C.chunk_documents(docs(spark, t), length=250).collect()
    assert [x.n_words for x in r] == [300]


def test_packing(spark):
    sent = lambda n: " ".join(["w"] * n) + "."
    t = " ".join([sent(100), sent(100), sent(100), sent(40)])
    r = C.chunk_documents(docs(spark, t), length=250).orderBy("chunk_no").collect()
    assert [x.n_words for x in r] == [200, 140]
    assert r[0].text == sent(100) + " " + sent(100)


def test_form_feed_pages(spark):
    r = C.chunk_documents(docs(spark, "One.\fTwo.\fThree."), length=1).orderBy("chunk_no").collect()
    assert [(x.text, x.page) for x in r] == [("One.", 1), ("Two.", 2), ("Three.", 3)]


def test_no_sentence_no_chunk(spark):
    assert C.chunk_documents(docs(spark, " \n "), length=250).count() == 0
    assert [r.text for r in C.chunk_documents(docs(spark, "..."), length=250).collect()] == ["..."]   # nothing is dropped


def vecs(spark, rows):
    return spark.createDataFrame([(i, [float(x) for x in v]) for i, v in rows], "id long, embedding array<double>")


def test_identical_vectors(spark):
    e = vecs(spark, [(i, [1.0, 2.0, 3.0]) for i in range(4)])
    knn = S.knn_graph(e, k=3)
    w = G.edge_weights(knn, 3).collect()
    assert len(w) == 12 and all(x.src != x.dst for x in w)
    assert all(x.w == 1.0 and not math.isnan(x.w) for x in w)


def test_copy_next_to_others_weight_zero(spark):
    # ids 0..2 identical (tau_0 = 0 with K=2); id 3 elsewhere
    e = vecs(spark, [(0, [1, 0]), (1, [1, 0]), (2, [1, 0]), (3, [0, 1])])
    w = {(x.src, x.dst): x.w for x in G.edge_weights(S.knn_graph(e, k=2), 2).collect()}
    assert w[(3, 0)] == 0.0 or w.get((3, 1)) == 0.0


def test_rounding_angle_zero(spark):
    from lexgraph.functions.vector import angle
    r = spark.range(1).select(angle(F.lit(1.0000001)).alias("a")).first()
    assert r.a == 0.0


def edges(spark, pairs, w=1.0):
    rows = [(a, b, w) for a, b in pairs] + [(b, a, w) for a, b in pairs]
    return spark.createDataFrame(rows, "src long, dst long, w double")


def test_two_components(spark):
    e = edges(spark, [(1, 2), (2, 3), (3, 1), (4, 5), (5, 6), (6, 4)])
    d = G.diameter(e).first()
    assert d.n_components == 2 and d.diameter is None
    assert G.avg_degree(e).first().avg_degree == 2.0


def test_path_graph_diameter(spark):
    e = edges(spark, [(1, 2), (2, 3), (3, 4)])
    assert G.diameter(e).first().diameter == 3


def test_diameter_multiple_batches(spark):
    # 14 nodes on a path, few searches at a time
    e = edges(spark, [(i, i + 1) for i in range(13)])
    assert G.diameter(e, at_once=4).first().diameter == 13
    # a ring: every node has the same eccentricity, a star with two long arms
    assert G.diameter(edges(spark, [(i, (i + 1) % 15) for i in range(15)]), at_once=70).first().diameter == 7
    assert G.diameter(edges(spark, [(0, i) for i in range(1, 9)] + [(8, 9), (9, 10), (7, 11)])).first().diameter == 5


def test_seed_overlap_farthest_wins(spark):
    c = spark.createDataFrame([(0, 7)], "keyword_id int, id long")
    f = spark.createDataFrame([(0, 7)], "keyword_id int, id long")
    assert H.seed_labels(c, f).first().seed == 0


def test_unreached_node(spark):
    e = edges(spark, [(1, 2), (3, 4)])
    seeds = spark.createDataFrame([(0, 1, 1)], "keyword_id int, id long, seed int")
    s = {r.id: (r.f0, r.f1) for r in H.propagate(e, seeds).collect()}
    assert 3 not in s and 4 not in s          # no mass: 0/0 kept as 0
    lab = {r.id: r.label for r in H.harden(H.propagate(e, seeds)).collect()}
    assert lab[1] == 1 and lab.get(3, 0) == 0


def test_propagation_matches_numpy(spark):
    rng = np.random.default_rng(3)
    n = 30
    W = np.zeros((n, n))
    for i in range(n):
        for j in rng.choice(n, 4, replace=False):
            if i != j:
                W[i, j] = W[j, i] = rng.random()
    rows = [(i, j, float(W[i, j])) for i in range(n) for j in range(n) if W[i, j] > 0]
    e = spark.createDataFrame(rows, "src long, dst long, w double")
    seeds = {0: 1, 5: 0, 9: 1}
    sdf = spark.createDataFrame([(0, k, v) for k, v in seeds.items()], "keyword_id int, id long, seed int")
    Fm = np.zeros((n, 2))
    for k, v in seeds.items():
        Fm[k, v] = 1
    for _ in range(5000):
        Fn = W @ Fm
        s = Fn.sum(1, keepdims=True)
        Fn = np.divide(Fn, s, out=np.zeros_like(Fn), where=s > 0)
        for k, v in seeds.items():
            Fn[k] = 0
            Fn[k, v] = 1
        Fm = Fn
    got = {r.id: (r.f0, r.f1) for r in H.propagate(e, sdf).collect()}
    named = e.select(F.concat(F.lit("n"), "src").alias("src"), F.concat(F.lit("n"), "dst").alias("dst"), "w")
    same = H.propagate(named, sdf.withColumn("id", F.concat(F.lit("n"), "id")))
    assert {r.id: (round(r.f0, 9), round(r.f1, 9)) for r in same.collect()} == \
        {f"n{i}": (round(a, 9), round(b, 9)) for i, (a, b) in got.items()}
    for i in range(n):
        f0, f1 = got.get(i, (0.0, 0.0))
        assert abs(f0 - Fm[i, 0]) < 1e-9 and abs(f1 - Fm[i, 1]) < 1e-9


def test_shared_texts(spark):
    lab = [(0, i, 1) for i in (1, 2, 3)] + [(1, i, 1) for i in (2, 3, 4)] + [(2, 9, 1)]
    df = spark.createDataFrame(lab, "keyword_id int, id long, label int")
    r = sorted(tuple(x) for x in H.keyword_graph(df).collect())
    assert r == [(0, 1, 2), (1, 0, 2)]


def assign(spark, sizes):
    rows, i = [], 0
    for c, n in sizes.items():
        for _ in range(n):
            rows.append((i, c))
            i += 1
    return spark.createDataFrame(rows, "id long, cluster int")


def test_cluster_sampling_sizes(spark):
    r = CL.sample_members(assign(spark, {0: 1, 1: 5, 2: 6}), blocks=5, seed=1).collect()
    by = {}
    for x in r:
        by.setdefault(x.cluster, []).append(x.id)
    assert len(by[0]) == 5 and len(set(by[0])) == 1
    assert len(by[1]) == 5 and set(by[1]) <= set(range(1, 6))
    assert len(by[2]) == 5 and len(set(by[2])) == 5


def test_foreign_neighbour(spark):
    e = vecs(spark, [(0, [0.0, 0.0]), (1, [10.0, 0.0]), (2, [1.0, 0.0])])
    centers = spark.createDataFrame([(0, [0.9, 0.0])], "cluster int, center array<double>")
    r = S.nearest_to_center(e, centers, blocks=1).first()
    assert r.id == 2


def test_budget(spark):
    b = spark.createDataFrame([("s", i, f"id{i}", " ".join(["w"] * 10)) for i in range(3)],
                              "set_id string, pos int, id string, text string")
    assert KW.select_chunks(b, 20, seed=0).count() == 2
    assert KW.select_chunks(b, 19, seed=0).count() == 1


def test_answer_parsing_and_cleaning(spark):
    a = spark.createDataFrame([("Wand, Owl,Owl",)], "answer string")
    assert sorted(r.keyword for r in KW.parse_keywords(a).collect()) == sorted(["Wand", " Owl", "Owl"])
    k = spark.createDataFrame([("  Owl ",)], "keyword string")
    assert KW.clean_keywords(k).first().keyword == "owl "
    assert KW.clean_keywords(k, strict=True).first().keyword == "owl"


def test_avoid_cap(spark):
    k301 = spark.createDataFrame([(f"k{i}",) for i in range(301)], "keyword string")
    k300 = spark.createDataFrame([(f"k{i}",) for i in range(300)], "keyword string")
    assert KW.avoid_list(k301, 300).count() == 300
    assert KW.avoid_list(k300, 300).count() == 300


def page(spark, html):
    return spark.createDataFrame([(1, html)], "page_id long, html string")


DETAIL = """<div class="detail__header__column"><h1>My Thesis Title</h1>
<a class="detail__header__button" href="/files/x.pdf">get</a></div>
<table><tr><td>Organisatie</td><td> Hogeschool A </td></tr><tr><td>Opleiding</td><td>Old</td></tr>
<tr><td>Lonely</td></tr><tr><td>Opleiding</td><td> Data Science </td></tr></table>"""


def test_detail_page(spark):
    r = HT.target_path(HT.page_records(page(spark, DETAIL), base="https://b")).first()
    assert r.organisatie == "Hogeschool A" and r.opleiding == "Data Science"
    assert r.download_url == "https://b/files/x.pdf"
    assert r.title == "My_Thesis_Title"
    assert r.path == "Hogeschool_A/Data_Science/My_Thesis_Title.pdf"


def test_no_table(spark):
    r = HT.target_path(HT.page_records(page(spark, "<h1>Only Title</h1>"))).first()
    assert r.organisatie is None and r.opleiding is None and r.download_url is None
    assert r.path == "Only_Title.pdf"


def test_pagination(spark):
    arrow = "search__body__pagination__arrow"
    p1 = f'<a class="{arrow}" href="/p0">prev</a><a class="{arrow} is-disabled" href="/p2">next</a>'
    p2 = f'<a class="{arrow}" href="/p0">prev</a><a class="{arrow}" href="/p2">next</a>'
    assert HT.next_page(page(spark, p1)).first().next_href is None
    assert HT.next_page(page(spark, p2)).first().next_href == "/p2"


def test_link_without_href(spark):
    r = HT.page_records(page(spark, '<a class="detail__header__button">x</a><h1>T</h1>')).first()
    assert r.download_url is None


def test_dotted_title(spark):
    r = HT.target_path(HT.page_records(page(spark, "<h1>Plan v1.2 final</h1>"))).first()
    assert r.path == "Plan_v1.pdf"


def test_drop_broad_rules(spark):
    ch = spark.createDataFrame([(f"c{i}", t) for i, t in enumerate(
        ["the cat of", "the dog of", "the of", "a bird", "the of x"])], "chunk_id string, text string")
    kw = spark.createDataFrame([(k,) for k in ["the", "the cat", "the of", "Things", "bird"]], "keyword string")
    kept = {r.keyword for r in KW.drop_broad(kw, ch, 0.5).collect()}
    assert kept == {"the cat", "bird"}


def test_diameter_double_sweep(spark):
    e = edges(spark, [(1, 2), (2, 3), (3, 4), (2, 5)])
    assert G.diameter(e, exact=False).first().diameter == 3


def test_html_upper_case_entities_and_unquoted_values(spark):
    h = ('<DIV CLASS=detail__header__column><H1>Caf&eacute; &#233;&#x1F600; &amp;lt; &nosuch;</H1></DIV><track src=x>'
         '<A CLASS=detail__header__button HREF="/details/1?a=1&amp;b=2">x</A>'
         "<TABLE><TR><TD>Organisatie<TD></TR><TR><TD>Organisatie</TD><TD> Org A </TD></TR><TR><TD>Opleiding</TD><TD>Opl</TD></TR></TABLE>")
    r = HT.target_path(HT.page_records(page(spark, h), base="https://b")).first()
    assert r.title == "Café_é\U0001F600_&lt;_&nosuch;" and r.download_url == "https://b/details/1?a=1&b=2"
    assert (r.organisatie, r.opleiding, r.path) == ("Org A", "Opl", "Org_A/Opl/Café_é\U0001F600_&lt;_&nosuch;.pdf")
    assert [x.href for x in HT.extract_links(page(spark, h)).collect()] == ["/details/1?a=1&b=2"]


def test_html_empty_box_missing_part_and_no_path(spark):
    assert HT.page_records(page(spark, '<div class="detail__header__column"></div><h1>Out</h1>')).first().title is None
    one = '<h1>T</h1><table><tr><td>Organisatie</td><td>Org</td></tr></table>'
    rec = HT.target_path(HT.page_records(page(spark, one)))
    assert rec.first().path == "T.pdf"
    none = HT.target_path(HT.page_records(page(spark, "<p>x</p>")))
    have = spark.createDataFrame([("other.pdf",)], "path string")
    assert HT.pending_downloads(none, have).count() == 0 and HT.pending_downloads(rec, have).count() == 1


def test_html_records_need_no_exchange(spark):
    plan = HT.page_records(page(spark, "<h1>T</h1>"))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan


def test_sentences_lose_nothing(spark, sf):
    text = "Pi is 3.14 at example.com, U.S.A. ...done \n...Hello there! What?! no end"
    got = [r.sentence for r in C.split_sentences(docs(spark, text)).orderBy("sent_no").collect()]
    assert got == ["Pi is 3.14 at example.com, U.S.A.", "...done \n...Hello there!", "What?!", "no end"]
    d = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    squeeze = lambda c: F.regexp_replace(c, r"[\t\n\x0B\f\r ]+", "")
    parts = C.chunk_documents(d).groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("chunk_no", "text"))),
                                                                              lambda c: c["text"]), "").alias("all"))
    bad = d.join(parts, "doc_id").filter(squeeze(F.col("all")) != squeeze(F.col("text")))
    assert bad.count() == 0


def test_nearest_is_exact_below_six_digits(spark):
    v = lambda a: [math.cos(a), math.sin(a)]
    emb = spark.createDataFrame([(9, v(0.0)), (2, v(2e-4)), (1, v(1e-3)), (3, v(1.0))], "id long, embedding array<double>")
    near = {r.src: r.dst for r in S.knn_graph(emb, k=1).collect()}
    assert near[9] == 2


def test_components_of_a_long_path(spark):
    e = spark.createDataFrame([(f"n{i:04}", f"n{i + 1:04}") for i in range(300)] + [("z1", "z2")], "src string, dst string")
    c = G.components(e).groupBy("component").count().collect()
    assert {(r.component, r["count"]) for r in c} == {("n0000", 301), ("z1", 2)}
    d = G.diameter(spark.createDataFrame([(f"n{i}", f"n{i + 1}") for i in range(9)], "src string, dst string")).first()
    assert (d.n_nodes, d.n_components, d.diameter) == (10, 1, 9)


def test_markup_that_is_no_markup(spark):
    h = """<!-- <a href="/hidden">x</a> --><script>var s = '<a href="/script">';</script><style>a > b {}</style>
    <a title="a > b" href="/one">1</a><a data-x="href=/bad" href='/ok'>2</a><A HREF=/three CLASS=x>3</A><a name="n">4</a>
    <a alt='<!-- no' href="/four">5</a><!-- end"""
    assert [r.href for r in HT.extract_links(page(spark, h)).collect()] == ["/one", "/ok", "/three", "/four"]
    assert [r["class"] for r in HT.extract_links(page(spark, h)).collect()] == [None, None, "x", None]


def test_header_box_by_depth(spark):
    title = lambda h: page(spark, h).select(HT.page_title().alias("t")).first().t
    box = '<div class="a detail__header__column b"><div><div>x</div></div><h1>In <b>side</b></h1></div><h1>Out</h1>'
    assert title("<h1>Before</h1>" + box) == "In_side"
    assert title('<div class="detail__header__column"><div>y</div></div><div><h1>Out</h1></div>') is None
    assert title('<div class="detail__header__column-wide"><h1>Other class</h1></div>') == "Other_class"
    assert title('<!-- <div class="detail__header__column"> --><h1>A &amp; B') == "A_&_B"
    assert title("<p>none</p>") is None and title("") is None and title(None) is None


def test_table_without_end_tags(spark):
    h = ("<table><tr><th>head<td title='a > b'>Organisatie<td> Uni &amp; Co <tr><td>Opleiding</td><td>First</td></tr>"
         "<tr><td>Opleiding<td>Last<td>third</table><p>after <tr><td>only one")
    r = HT.table_attributes(page(spark, h)).first()
    assert (r.organisatie, r.opleiding) == ("Uni & Co", "Last")
