"""HTML extraction, preference formatting, token counts and toxicity."""

import numpy as np
import pytest

from lexgraph.llm import gru, html_text, preferences, toxicity, trie_counts

FILL = "word " * 40


@pytest.mark.parametrize("html, want", [
    (None, ""), ("", ""), ("<script>var a='<p>no</p>'</script>", ""), ("just text &amp; more", "just text & more"),
    ("<p>one &eacute;&#233;&amp;lt;<p>two<div>three</div><!-- unclosed <p>gone", "one éé&lt;\n\ntwo\n\nthree"),
    (f"<body><nav><a href=a>menu</a></nav><article><h1>T</h1><p>{FILL}<br>x\n y</p><p>.</p></article><footer>f</footer>",
     f"T\n\n{FILL}x y\n\n."),
    (f"<body><div class='menu'><a>a</a></div><div id=c><h2>H</h2><p>Short.</p><p>{FILL}</p></div>"
     f"<div class='sidebar'><p>{FILL}</p></div><div id='comments'><p>{FILL * 5}</p></div>", f"H\n\nShort.\n\n{FILL.strip()}"),
    (f"<body><form><p>{FILL}</p><p>more</p></form>", f"{FILL.strip()}\n\nmore"),
    (f"<body><NAV><UL><LI><A>x</A><ARTICLE><P>{FILL}", FILL.strip()),
    (f"<body><div class=cookie-notice>{FILL}</div><div hidden>{FILL}</div><main><p>{FILL}</p></main>", FILL.strip()),
    ("<div>" * 3000 + "deep" + "</div>" * 3000, "deep"),
    (f"<body><table><tr><td>{FILL}<td>b</table><p>after</p>", f"{FILL.strip()}\n\nb\n\nafter"),
    ("<p title='a>b'>quoted</p><p", "quoted\n\n<p"),
])
def test_extraction(html, want):
    assert html_text.extract_text(html) == want


@pytest.mark.parametrize("html, want", [
    (f"<article><h1>T</h1><h2 id='search-algorithms'>Search</h2><p>{FILL}</p><section id='related-work'><h2>Work</h2><p>Also.</p>"
     f"</section><p class=notice>Mind.</p><p>{FILL}</p><div class=share>Tell</div><div class='related-posts'><a href=a>one</a></div>"
     f"<div id=comments><p>{FILL}</p></div></article>",
     f"T\n\nSearch\n\n{FILL.strip()}\n\nWork\n\nAlso.\n\nMind.\n\n{FILL.strip()}"),
    (f"<div class='sidebar-right'><article><p>{FILL}</p><p>{FILL}</p></article></div><p>Other text.</p>",
     f"{FILL.strip()}\n\n{FILL.strip()}"),
    (f"<div class='header-fixed'><div><h2>H</h2><p>{FILL}</p><p>{FILL}</p></div></div><p class=copyright>Other text.</p>",
     f"H\n\n{FILL.strip()}\n\n{FILL.strip()}"),
    (f"<article><p title='the hidden cost'>{FILL}</p><p><a href='/x?id=ad-1'>here</a> {FILL}</p></article>",
     f"{FILL.strip()}\n\nhere {FILL.strip()}"),
])
def test_names_cut_no_article_text(html, want):
    assert html_text.extract_text(html) == want


def test_extraction_of_a_very_long_page():
    body = "".join(f"<p>paragraph {i} &lt;{i}&gt;</p>" for i in range(20_000))
    text = html_text.extract_text(f"<html><body><article>{body}</article></body></html>")
    assert text == "\n\n".join(f"paragraph {i} <{i}>" for i in range(20_000))


def test_extract_frame(spark):
    pages = spark.createDataFrame([(1, None, "<p>é x</p>", "t"), (1, None, "<p>é x</p>", "t"), (None, "u", None, None)],
                                  "page_id long, url string, html string, text string")
    rows = sorted((r["text"], r["n_chars"]) for r in html_text.extract(pages).collect())
    assert rows == [("", 0), ("é x", 3), ("é x", 3)]
    assert html_text.extract(pages.limit(0)).count() == 0


def test_given_pages_match_their_articles(spark, sf):
    import html
    import re
    pages = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    for r in html_text.query(spark, sf).collect():
        inner = re.search("<article>(.*?)</article>", pages[r["page_id"]], re.S)[1]
        blocks = (" ".join(html.unescape(re.sub("</?b>|<br>", " ", x)).split()) for x in re.split("</?(?:p|h1)>", inner))
        squeeze = lambda s: re.sub(r"\s", "", s)
        assert squeeze(r["text"]) == squeeze("".join(blocks)) and r["n_chars"] == len(r["text"])


def test_given_pages_without_article_tags(spark, sf):
    """Density, sums and threshold alone find the same text."""
    import re
    for r in spark.read.parquet(f"{sf}/pages.parquet").collect():
        plain = re.sub(r"<(/?)(?:article|main)(?=[\s>])", r"<\1div", r["html"])
        assert not re.search("<(article|main)", plain)
        assert html_text.extract_text(plain) == html_text.extract_text(r["html"])


# ----------------------------------------------------------------- preferences
def test_preference_pairs(spark):
    turns = [
        (0, 0, 0, "user", "hi"), (0, 0, 1, "assistant", "good"), (0, 0, 2, "user", "bye"),
        (0, 1, 0, "user", "hi"), (0, 1, 1, "assistant", "bad"),
        (1, 0, 0, "user", "a"), (1, 1, 0, "user", "a"),                      # equal
        (2, 0, 0, "user", None), (2, 1, 0, "user", ""),                      # NULL is not empty
        (3, 0, 0, "user", "alone"), (3, 0, 1, None, None),                   # no partner
        (4, 0, 0, "user", "x"), (4, 0, 0, "user", "x"), (4, 1, 0, "user", "x"),  # a repeated row
        (5, 0, 0, "user", "p"), (5, 1, 0, "user", "p"), (5, 1, 1, "assistant", "longer"),  # prefix
        (None, 0, 0, "user", "out"),
    ]
    df = spark.createDataFrame(turns, "pair_id long, side int, turn long, role string, text string")
    rows = preferences.format_pairs(df).collect()
    got = sorted((r["pair_id"], r["part"], r["turn"], r["rendered"], r["train"], r["prompt_turns"]) for r in rows if r["pair_id"] < 1)
    assert got == [(0, "chosen", 1, "<|assistant|>\ngood<|end|>\n", 1, 1), (0, "chosen", 2, "<|user|>\nbye<|end|>\n", 0, 1),
                   (0, "prompt", 0, "<|user|>\nhi<|end|>\n", 0, 1), (0, "rejected", 1, "<|assistant|>\nbad<|end|>\n", 1, 1)]
    parts = lambda p: sorted(r["part"] for r in rows if r["pair_id"] == p)
    assert parts(1) == ["prompt"] and parts(2) == ["chosen", "rejected"] and parts(3) == ["chosen", "chosen"]
    assert parts(4) == ["chosen", "chosen", "rejected"] and parts(5) == ["prompt", "rejected"]
    assert {r["pair_id"] for r in rows} == set(range(6))
    assert preferences.format_pairs(df.limit(0)).count() == 0


def test_swapped_answers_share_their_prompt(spark):
    c = [(0, 0, "user", "q"), (0, 1, "assistant", "a"), (0, 2, "user", "more"), (0, 3, "assistant", "b"), (0, 4, "user", "thanks"),
         (1, 0, "user", "other"), (1, 1, "assistant", "c"), (2, 0, "user", "alone"), (3, 0, "user", "x"), (3, 1, "assistant", "y"),
         (None, 0, "user", "n"), (4, None, "assistant", "z"), (5, 0, "assistant", "same"), (7, 0, "user", None)]
    d = spark.createDataFrame([(*x, 1) for x in c], "conv_id long, turn int, role string, text string, pair_id int")
    out = preferences.format_pairs(preferences.answers_swapped(d))
    got = {}
    for r in out.collect():
        got.setdefault(r["pair_id"], {}).setdefault(r["part"], []).append((r["turn"], r["rendered"].split("\n")[1][:-7], r["train"]))
    assert sorted(got[0]["prompt"]) == [(0, "q", 0), (1, "a", 0), (2, "more", 0)]
    assert sorted(got[0]["chosen"]) == [(3, "b", 1), (4, "thanks", 0)] and got[0]["rejected"] == [(3, "c", 1)]
    assert sorted(got[1]["prompt"]) == [(0, "other", 0)] and got[1]["rejected"] == [(1, "b", 1)]
    assert got[2] == {"chosen": [(0, "alone", 0)]} and set(got[3]) == {"chosen"}  # 2 has no answer
    assert set(got[5]) == {"chosen"} and set(got) == {0, 1, 2, 3, 4, 5, 7}
    sizes = {r["pair_id"]: r for r in preferences.paired(out).collect()}
    assert (sizes[0]["n_prompt_turns"], sizes[0]["n_chosen_turns"], sizes[0]["n_rejected_turns"]) == (3, 2, 1)
    assert sizes[0]["chosen_trained_chars"] == len("<|assistant|>\nb<|end|>\n") and sizes[2]["rejected_chars"] == 0
    assert preferences.answers_swapped(d.limit(0)).count() == 0


# ----------------------------------------------------------------- token counts
def test_trie_counts_match_a_plain_forward_pass():
    scores = {"▁": -3.0, "▁a": -2.0, "a": -2.5, "b": -2.5, "ab": -3.0, "ba": -3.0, "▁ab": -4.5, "bab": -4.0, "é": -1.0}
    rng = np.random.default_rng(0)
    words = ["".join(rng.choice(list("abé日"), rng.integers(0, 9))) for _ in range(400)]
    trie = trie_counts.Trie(scores)
    trie.learn(set(words))
    assert trie.shared > 0

    def plain(word):
        w, best = "▁" + word, [(0.0, 0)]
        for end in range(1, len(w) + 1):
            wide = len(w[end - 1].encode())
            options = [(best[end - 1][0] + trie.floor * wide, -(-best[end - 1][1] + wide))]
            options += [(best[i][0] + scores[w[i:end]], best[i][1] - 1) for i in range(end) if w[i:end] in scores]
            best.append(max(options))
        return -best[-1][1]

    assert {w: trie.counts[w] for w in words} == {w: plain(w) for w in words}


def test_token_counts_frame(spark):
    docs = spark.createDataFrame([(1, "the cat  sat", 0), (2, None, 0), (3, "", 0), (1, "the cat  sat", 0), (None, "q" * 5000, 0)],
                                 "doc_id long, text string, id int")
    rows = trie_counts.token_counts(docs, trie_counts.vocabulary()).collect()
    got = sorted(((r["doc_id"] or 0, r["n_tokens"], r["n_pretokens"]) for r in rows))
    assert got[1] == got[2] and got[1][2] == 4 and got[3:] == [(2, 0, 0), (3, 0, 0)] and got[0][1] > 0
    assert trie_counts.token_counts(docs.limit(0), trie_counts.vocabulary()).count() == 0


# ----------------------------------------------------------------- toxicity
def test_windows_cover_every_position():
    for size, stride in ((64, 32), (5, 2)):
        lengths = np.array([0, 1, 5, 6, 64, 65, 200, 97])
        start, length, text = gru.windows(lengths, size, stride)
        begin = np.cumsum(lengths) - lengths
        for i, n in enumerate(lengths):
            seen = set()
            for s, m in zip(start[text == i], length[text == i]):
                seen.update(range(s - begin[i], s - begin[i] + m))
            assert seen == set(range(n))


def test_gradients():
    net = gru.Network(["aa", "bb"])
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    words = ["aa", "bb", "ccc", "dddd"]
    idx, mask = np.array([[0, 1, 2], [3, 2, 0]]), np.array([[1, 1, 1], [1, 1, 0]], bool)
    y = np.array([1.0, 0.0])
    x = np.random.default_rng(0).standard_normal((4, gru.WORD_DIM + gru.CHAR_DIM + 1))

    def loss():
        out = net.forward(net.projected(x), idx, mask)
        return np.mean(np.logaddexp(0, out) - y * out)

    g, _, _ = net.gradients(x, net.projected(x), idx, mask, y, np.ones(2))
    for k in ("wx", "bx", "uf", "ub", "att", "out", "bias"):
        at = np.unravel_index(np.argmax(np.abs(g[k])), g[k].shape)
        keep = net.p[k][at]
        net.p[k][at] = keep + 1e-3
        up = loss()
        net.p[k][at] = keep - 1e-3
        down = loss()
        net.p[k][at] = keep
        assert abs((up - down) / 2e-3 - g[k][at]) < 2e-2 * abs(g[k][at]) + 2e-4, k


def toxic_rows(n, seed):
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        w = [f"w{x}" for x in rng.integers(0, 400, int(rng.integers(20, 300)))]
        bad = i % 4 == 0
        if bad:
            for at in rng.choice(len(w), max(2, len(w) // 20), replace=False):
                w[at] = f"vile{rng.integers(0, 50)}x"
        rows.append((i, " ".join(w), int(bad)))
    return rows


def test_toxicity_learns_and_scores_everything(spark):
    rows = toxic_rows(500, 0)
    docs = [(i, t, 0.5) for i, t, _ in rows] + [(900, None, 0.5), (901, "", 0.5), (902, "w1 " * 30_000, 0.5), (903, " \n", 0.5), (904, "!!", 0.5), (0, rows[0][1], 0.5)]
    labels = [(i, y) for i, _, y in rows] + [(0, 1), (902, None), (None, 1)]
    d = spark.createDataFrame(docs, "doc_id long, text string, score double")
    lab = spark.createDataFrame(labels, "doc_id long, toxic int")
    out = toxicity.toxicity(d, lab).collect()
    assert len(out) == len(docs)
    got = {r["doc_id"]: r for r in out}
    held = [(got[i]["predicted"], y) for i, _, y in rows if got[i]["held_out"]]
    assert len(held) > 60 and np.mean([p == y for p, y in held]) > 0.95
    assert all(got[i]["score"] == got[900]["score"] < 0.5 and got[i]["predicted"] == 0 for i in (900, 901, 903, 904)) and got[902]["predicted"] == 0
    kept = toxicity.reject_toxic(d, lab)
    assert kept.columns == d.columns and {r["doc_id"] for r in kept.collect()} == {i for i, r in got.items() if not r["predicted"]}


def test_toxicity_without_two_kinds_of_labels(spark):
    d = spark.createDataFrame([(1, "a"), (2, None)], "doc_id long, text string")
    for labels, want in (([], 0.0), ([(1, 0), (2, 0)], 0.0)):
        lab = spark.createDataFrame(labels, "doc_id long, toxic int")
        assert [r["score"] for r in toxicity.toxicity(d, lab).collect()] == [want, want]
    assert toxicity.toxicity(d.limit(0), lab).count() == 0
