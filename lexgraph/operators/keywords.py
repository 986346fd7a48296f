"""Keyword extraction and cleanup as distributed rules.

The reference asks a language model for keywords per cluster bundle and for
three cleanup passes.  Here the same steps are DataFrame rules (the model
hook ``complete`` plugs a real model in):

bundles -> budgeted random prefix -> prompt rows -> keywords per set
(n-gram tf x idf across sets) -> parse / avoid list -> dedup -> splitting ->
deletion -> clean.
"""

from __future__ import annotations

from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexgraph.functions.rand import order_key
from lexgraph.functions.text import WS, strip_ws, tokens, word_count
from lexgraph.operators.hotjoin import SHARE, hot_join
from lexgraph.session import persist_step

# Fixed values.
TOKEN_LIMIT = 3988            # prompt budget in tokens, before the header
AVOID_CAP = 300               # at most this many keywords in the avoid list
TEXT_JOINER = " * "           # between texts in a prompt
AVOID_JOINER = ", "           # between avoided keywords in a prompt
# too vague or too broad to keep (the examples the cleanup rules name)
BROAD_WORDS = ("things", "stuff", "technology")

NEAR = 0.6                    # token-set similarity from which two keywords are one
SALTS = 32                    # parts of a key that half of all rows hold
PART_WORDS = 3                # a part of a split keyword has at most so many words
FILTER_BITS = 1 << 28         # the filter of wanted phrases that goes to the tasks: 32 MB at most
SLICE = 1 << 19               # token hashes that a task counts at once

PROMPT = ("Keywords for the theme of the texts below. Topic: {topic}. At most {l1} keywords, "
          "each at most {l2} words, separated by commas. Avoid: <{avoid}>. Texts: ```{texts}```")


def cluster_bundles(members: DataFrame, chunks: DataFrame, id_col: str = "chunk_id") -> DataFrame:
    """(set_id, pos, id, text): per (algo, cluster), centre members then
    random members, each in rank order.  Random members may repeat."""
    kind_ord = F.when(F.col("kind") == "center", 0).otherwise(1)
    w = Window.partitionBy("set_id").orderBy(kind_ord, F.col("rank"))
    m = members.withColumn("set_id", F.concat_ws(":", F.col("algo"), F.col("cluster").cast("string")))
    m = m.withColumn("pos", F.row_number().over(w))
    t = chunks.select(F.col(id_col).alias("id"), "text")
    return m.join(t, "id").select("set_id", "pos", "id", "text")


def token_count(col, counter=None) -> "F.Column":
    """Tokens of a text: words, or what ``counter`` (hook K3: a function
    ``pandas.Series[str] -> pandas.Series[int]``) counts."""
    if counter is None:
        return word_count(col)
    from lexgraph.functions.hooks import token_counter_udf
    return token_counter_udf(counter)(F.col(col) if isinstance(col, str) else col)


def token_budget(header: str, limit: int = TOKEN_LIMIT, counter=None) -> int:
    """Budget left for texts once the prompt header is counted."""
    if counter is None:
        return limit - len([w for w in header.split() if w])
    import pandas as pd
    return limit - int(counter(pd.Series([header])).iloc[0])


def select_chunks(bundles: DataFrame, max_tokens: int, seed: int = 0, counter=None) -> DataFrame:
    """Shuffle each bundle (seeded) and keep texts while the running token
    total stays within ``max_tokens``; the first text past it ends the set."""
    key = order_key(seed, F.concat_ws(":", F.col("set_id"), F.col("pos").cast("string")))
    w = Window.partitionBy("set_id").orderBy(key).rowsBetween(Window.unboundedPreceding, 0)
    b = bundles.withColumn("tokens", token_count("text", counter)).withColumn("order", F.row_number().over(
        Window.partitionBy("set_id").orderBy(key)))
    b = b.withColumn("running", F.sum("tokens").over(w))
    return b.filter(F.col("running") <= F.lit(int(max_tokens))).select("set_id", "order", "id", "text", "tokens")


def render_prompts(selected: DataFrame, topic: str, l1: int = 10, l2: int = 3,
                   avoid: DataFrame | None = None) -> DataFrame:
    """(set_id, prompt): texts joined by ' * ' in selection order; the avoid
    list sorted and joined by ', '."""
    texts = (selected.groupBy("set_id")
             .agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("order", "text"))),
                                           lambda s: s["text"]), TEXT_JOINER).alias("texts")))
    if avoid is not None:
        av = avoid.agg(F.array_join(F.array_sort(F.collect_list("keyword")), AVOID_JOINER).alias("avoid"))
        av_str = av.first()["avoid"] or ""
    else:
        av_str = ""
    head = PROMPT.replace("{topic}", topic).replace("{l1}", str(l1)).replace("{l2}", str(l2)).replace("{avoid}", av_str)
    pre, post = head.split("{texts}")
    return texts.select("set_id", F.concat(F.lit(pre), F.col("texts"), F.lit(post)).alias("prompt"))


def _grams(t, longest: int):
    """All runs of 1..longest tokens of the array ``t``, joined by spaces."""
    def of(n):
        runs = F.transform(F.sequence(F.lit(1), F.size(t) - n + 1), lambda i: F.array_join(F.slice(t, i, n), " "))
        return F.when(F.size(t) >= n, runs).otherwise(F.array().cast("array<string>"))
    return F.flatten(F.array(*[of(n) for n in range(1, longest + 1)]))


def keyword_scores(selected: DataFrame, l2: int = 3) -> DataFrame:
    """(set_id, keyword, score): every n-gram of 1..l2 tokens of the texts of a set;
    score = count in the set x ln((S+1)/(sets holding it + 1))."""
    t = selected.select("set_id", tokens("text").alias("t"))
    tf = t.select("set_id", F.explode(_grams(F.col("t"), l2)).alias("keyword")).groupBy("set_id", "keyword").agg(F.count(F.lit(1)).alias("tf"))
    n_sets = selected.select("set_id").distinct().count()
    df = tf.groupBy("keyword").agg(F.count(F.lit(1)).alias("df"))
    return tf.join(df, "keyword").select("set_id", "keyword", (
        F.col("tf") * F.log((F.lit(float(n_sets)) + 1.0) / (F.col("df") + 1.0))).alias("score"))


def _best(scored: DataFrame, most) -> DataFrame:
    w = Window.partitionBy("set_id").orderBy(F.col("score").desc(), F.col("keyword"))
    return scored.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= most)


def topic_keywords(selected: DataFrame, l1: int = 10, l2: int = 3, avoid: DataFrame | None = None) -> DataFrame:
    """(set_id, rank, keyword, score): the built-in completer; the l1 best
    n-grams per set (score desc, then keyword asc), avoided keywords left out."""
    s = keyword_scores(selected, l2)
    if avoid is not None:
        s = s.join(avoid.select("keyword"), "keyword", "left_anti")
    return _best(s, l1).select("set_id", "rank", "keyword", "score")


def on_topic(keywords: DataFrame, topic: str, chunks: DataFrame, min_cos: float, dim: int = 64) -> DataFrame:
    """(keyword): those whose vector, in the corpus' space, has a cosine of at least
    ``min_cos`` to that of ``topic``."""
    from lexgraph.functions.vector import cosine
    from lexgraph.operators.embed import corpus_vocab, embed_text
    spark = keywords.sparkSession
    vocab, n = persist_step(corpus_vocab(chunks)), chunks.count()
    own = embed_text(keywords.select("keyword").distinct(), "keyword", "keyword", dim, vocab=vocab, n_docs=n)
    wanted = embed_text(spark.createDataFrame([(topic,)], "topic string"), "topic", "topic", dim, vocab=vocab, n_docs=n)
    v = wanted.first()["embedding"]        # one vector of ``dim`` numbers
    return own.filter(cosine(F.col("embedding"), F.array(*[F.lit(x) for x in v])) >= min_cos).select(F.col("id").alias("keyword"))


def keyword_rounds(scored: DataFrame, l1: int = 10, avoid: DataFrame | None = None) -> DataFrame:
    """(set_id, rank, keyword, score, round): up to l1 keywords per set, none in two sets.

    ``scored``: (set_id, keyword, score).  In each round every set that is short
    proposes its best keywords not yet avoided, as many as it lacks; a keyword
    that several propose goes to the highest score (then the least set_id), and all
    given keywords join the avoid table, which is written between rounds.  The
    rounds end when nothing is proposed: each set has l1 keywords or none is left.
    """
    scored = persist_step(scored.select("set_id", "keyword", "score"))
    given, turn = None, 0
    banned = None if avoid is None else avoid.select("keyword")
    while True:
        turn += 1
        left = scored if banned is None else scored.join(banned, "keyword", "left_anti")
        lack = F.lit(int(l1))
        if given is not None:
            held = given.groupBy("set_id").agg(F.count(F.lit(1)).alias("held"))
            left = left.join(held, "set_id", "left")
            lack = lack - F.coalesce("held", F.lit(0))
        proposed = _best(left, lack)
        won = proposed.groupBy("keyword").agg(F.min(F.struct((-F.col("score")).alias("s"), F.col("set_id").alias("set_id"))).alias("w")) \
            .select("w.set_id", "keyword", (-F.col("w.s")).alias("score"), F.lit(turn).alias("round"))
        new = persist_step(won)
        if new.isEmpty():
            break
        given = new if given is None else persist_step(given.unionByName(new))
        banned = given.select("keyword") if avoid is None else given.select("keyword").unionByName(avoid.select("keyword"))
    given = new if given is None else given
    w = Window.partitionBy("set_id").orderBy(F.col("score").desc(), F.col("keyword"))
    return given.withColumn("rank", F.row_number().over(w)).select("set_id", "rank", "keyword", "score", "round")


def complete(prompts: DataFrame, completer) -> DataFrame:
    """(set_id, answer) from a user model: ``completer(pandas.Series[str]) ->
    pandas.Series[str]`` run on Arrow batches (hook K2)."""
    from lexgraph.functions.hooks import completer_udf
    return prompts.select("set_id", completer_udf(completer)(F.col("prompt")).alias("answer"))


def answers_from_keywords(kw: DataFrame) -> DataFrame:
    """(set_id, answer): the built-in completer's keywords as one comma list."""
    return kw.groupBy("set_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "keyword"))),
                                                             lambda s: s["keyword"]), ",").alias("answer"))


def parse_keywords(answers: DataFrame, col: str = "answer") -> DataFrame:
    """Distinct comma-separated pieces (not trimmed)."""
    return answers.select(F.explode(F.split(F.col(col), ",")).alias("keyword")).distinct()


def avoid_list(kw: DataFrame, cap: int = AVOID_CAP, seed: int = 0) -> DataFrame:
    """All keywords, or ``cap`` seeded-random ones when there are more.
    A global top-``cap`` (partial per partition), no count needed."""
    return kw.select("keyword").orderBy(order_key(seed, F.col("keyword")), "keyword").limit(int(cap))


def clean_keywords(kw: DataFrame, strict: bool = False) -> DataFrame:
    """Lower-case and strip leading whitespace; ``strict`` also strips the
    right side, drops empties and duplicates."""
    c = F.regexp_replace(F.lower("keyword"), f"^{WS}+", "")
    if strict:
        c = F.regexp_replace(c, f"{WS}+$", "")
    out = kw.select(c.alias("keyword"))
    if strict:
        out = out.filter(F.col("keyword") != "").distinct()
    return out


def flag_pattern(df: DataFrame, pattern: str, col: str = "answer") -> DataFrame:
    return df.withColumn("flagged", F.col(col).rlike(pattern))


def _norm_key(col):
    """The sorted distinct tokens; a keyword without any is its own key."""
    key = F.array_join(F.array_sort(F.array_distinct(tokens(col))), " ")
    return F.when(key != "", key).otherwise(F.concat(F.lit("\n"), strip_ws(col)))


def near_pairs(sets: DataFrame, threshold: float = NEAR, wide: int = 24) -> DataFrame:
    """(a, b), a < b: keys whose token sets have a Jaccard similarity of at least
    ``threshold`` (above one half).  ``sets``: (k, t array<string> of distinct tokens), one row per set.

    Prefix filter: tokens are ordered by rising frequency.  Two such sets that
    differ share at least two tokens, and of the first s - ceil(threshold s) + 2 tokens of
    each they share two, so a pair of prefix tokens is the join key: a frequent
    token alone brings no two sets together.  Sets of more than ``wide`` tokens
    would have many such pairs and are joined by one token of a prefix one shorter,
    which is rare among that many.  Sizes are checked in the join, the overlap
    of what is left is counted.
    """
    if not 0.5 < threshold <= 1:
        raise ValueError("threshold: above 0.5, at most 1")
    share = Fraction(threshold).limit_denominator(1000)
    up = lambda n: F.floor((n * share.numerator + share.denominator - 1) / share.denominator).cast("int")
    sets = persist_step(sets.select(F.monotonically_increasing_id().alias("i"), "k", "t", F.size("t").alias("s")).filter("s > 1"))
    tok = sets.select("i", F.explode("t").alias("token"))
    df = persist_step(tok.groupBy("token").agg(F.count(F.lit(1)).alias("df")))
    n = sets.count()
    ranked = hot_join(tok, df, "token", hot=df.filter(F.col("df") > SHARE * n).select("token"))
    # a row per join key carries a number and the hashes of the tokens: equal tokens have equal
    # hashes, so no pair is lost, and the pairs that are left are counted by the tokens themselves
    prefix = ranked.groupBy("i").agg(F.array_sort(F.collect_list(F.struct("df", "token"))).alias("r")) \
        .select("i", F.transform("r", lambda x: x["token"]).alias("t"), F.size("r").alias("s")) \
        .select("i", "s", F.transform("t", lambda x: F.xxhash64(x)).alias("t"), F.slice("t", 1, F.col("s") - up(F.col("s")) + 2).alias("p"))
    pairs = F.flatten(F.transform("p", lambda x, i: F.transform(F.slice("p", i + 2, F.size("p")), lambda y: F.xxhash64(F.least(x, y), F.greatest(x, y)))))
    ones = F.transform(F.slice("p", 1, F.size("p") - 1), lambda x: F.xxhash64(x))
    none = F.array().cast("array<bigint>")
    keys = prefix.select("i", "t", "s", F.concat(
        F.when(F.col("s") <= wide, F.transform(pairs, lambda h: F.struct(F.lit(2).alias("by"), h.alias("h")))).otherwise(F.array()),
        F.when(F.col("s") >= up(F.lit(wide + 1)), F.transform(ones, lambda h: F.struct(F.lit(1).alias("by"), h.alias("h")))).otherwise(F.array())).alias("x")) \
        if n else prefix.select("i", "t", "s", F.transform(none, lambda h: F.struct(F.lit(2).alias("by"), h.alias("h"))).alias("x"))
    rows = persist_step(keys.select("i", "t", "s", F.explode("x").alias("x")).select("i", "t", "s", "x.by", "x.h"))
    a, b = (rows.select(F.col("i").alias(side), F.col("t").alias(f"t{side}"), F.col("s").alias(f"s{side}"), "by", "h") for side in "ab")
    near = a.join(b, ["by", "h"]).filter((F.col("a") < F.col("b")) & (F.least("sa", "sb") >= up(F.greatest("sa", "sb"))))
    both = F.size(F.array_intersect("ta", "tb"))
    enough = both * share.denominator >= (F.col("sa") + F.col("sb") - both) * share.numerator
    left = near.filter((F.size(F.array_distinct("ta")) < F.col("sa")) | (F.size(F.array_distinct("tb")) < F.col("sb")) | enough).select("a", "b").distinct()
    x, y = (sets.select(F.col("i").alias(side), F.col("k").alias(f"k{side}"), F.col("t").alias(f"t{side}"), F.col("s").alias(f"s{side}")) for side in "ab")
    return left.join(x, "a").join(y, "b").filter(enough).select(F.least("ka", "kb").alias("a"), F.greatest("ka", "kb").alias("b"))


def _leaders(links: DataFrame, rank: DataFrame) -> DataFrame:
    """(k): the keys that give way.  In order of rank a key leads unless it is
    linked to a better one that leads; each round decides all whose better
    neighbours are decided, so rounds are few and every decision is that of the
    one-by-one order.  ``rank``: (k, r), r unique and least first."""
    r = lambda c: rank.select(F.col("k").alias(c), F.col("r").alias(f"r{c}"))
    ends = links.join(r("a"), "a").join(r("b"), "b")
    first = F.col("ra") < F.col("rb")
    edges = persist_step(ends.select(F.when(first, F.col("b")).otherwise(F.col("a")).alias("worse"),
                                     F.when(first, F.col("a")).otherwise(F.col("b")).alias("better")))
    gone = None
    while not edges.isEmpty():
        lead = edges.select("better").distinct().join(edges.select(F.col("worse").alias("better")), "better", "left_anti")
        out = persist_step(edges.join(lead, "better", "left_semi").select("worse").distinct())
        gone = out if gone is None else gone.unionByName(out)
        edges = persist_step(edges.join(out, "worse", "left_anti").join(out.withColumnRenamed("worse", "better"), "better", "left_anti"))
    return links.select(F.col("a").alias("k")).limit(0) if gone is None else gone.withColumnRenamed("worse", "k")


def dedup_keywords(kw: DataFrame, threshold: float = NEAR) -> DataFrame:
    """Merge keywords that are the same or nearly the same.

    Keywords with one set of tokens become their most frequent spelling (then the
    smallest).  Of keywords whose token sets have a Jaccard similarity of at least
    ``threshold`` the more frequent stays, then the one of fewer tokens, then the
    smallest key; one that is near only to keywords that went stays.
    """
    c = kw.filter(F.col("keyword").isNotNull()).groupBy("keyword").agg(F.count(F.lit(1)).alias("n")).withColumn("k", _norm_key("keyword"))
    best = F.min(F.struct((-F.col("n")).alias("n"), F.col("keyword").alias("keyword")))
    one = persist_step(c.groupBy("k").agg(best.alias("best"), F.sum("n").alias("n")).select("k", "best.keyword", "n"))
    sets = one.filter(~F.col("k").startswith("\n")).select("k", F.split("k", " ").alias("t"))
    size = F.size(F.split("k", " "))
    gone = _leaders(near_pairs(sets, threshold), one.select("k", F.struct((-F.col("n")).alias("n"), size.alias("s"), F.col("k").alias("k2")).alias("r")))
    return one.join(gone, "k", "left_anti").select("keyword")


def _runs(tokens: np.ndarray, row: np.ndarray, n: int):
    """(place, a, b): start and two digests of every run of ``n`` token hashes within a row."""
    at = np.arange(max(len(tokens) - n + 1, 0))
    at = at[row[at] == row[at + n - 1]]
    out = []
    for odd in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F):
        h = np.full(len(at), n, dtype=np.uint64)
        for x in range(n):
            h = (h ^ tokens[at + x]) * np.uint64(odd)
            h ^= h >> np.uint64(29)
        out.append((h * np.uint64(0xBF58476D1CE4E5B9)).view(np.int64))
    return at, *out


def _slices(column: pa.Array):
    """Pieces of an array of token hashes, of whole rows and about ``SLICE`` hashes: (hashes, row of each)."""
    lens = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = column.flatten().to_numpy(zero_copy_only=False).view(np.uint64)
    ends = np.cumsum(lens)
    lo = 0
    while lo < len(lens):
        first = ends[lo] - lens[lo]
        hi = max(lo + 1, int(np.searchsorted(ends, first + SLICE, "right")))
        yield flat[first:ends[hi - 1]], np.repeat(np.arange(lo, hi), lens[lo:hi])
        lo = hi


def _digests(batches):
    """(phrase, a, b) of phrases given as (phrase, t array of token hashes)."""
    for rb in batches:
        t = rb.column("t")
        lens = t.value_lengths().to_numpy(zero_copy_only=False)
        flat = t.flatten().to_numpy(zero_copy_only=False).view(np.uint64)
        row, first = np.repeat(np.arange(len(lens)), lens), np.cumsum(lens) - lens
        ab = np.zeros((2, len(lens)), dtype=np.int64)
        for n in np.unique(lens[lens > 0]):
            at, a, b = _runs(flat, row, int(n))
            whole = at == first[row[at]]
            mine = lens[row[at]] == n
            ab[:, row[at[whole & mine]]] = a[whole & mine], b[whole & mine]
        yield pa.RecordBatch.from_arrays([rb.column("phrase"), pa.array(ab[0]), pa.array(ab[1])], names=["phrase", "a", "b"])


def _mark(batches):
    """(word, bits): the words of the filter, 64 places each, that hold a wanted place."""
    for rb in batches:
        at = rb.column("place").to_numpy(zero_copy_only=False)
        word, ix = np.unique(at >> 6, return_inverse=True)
        bits = np.zeros(len(word), dtype=np.uint64)
        np.bitwise_or.at(bits, ix, np.uint64(1) << (at & 63).astype(np.uint64))
        yield pa.RecordBatch.from_arrays([pa.array(word), pa.array(bits.view(np.int64))], names=["word", "bits"])


def _held_runs(wanted, mask: int, longest: int):
    """(a, b, n): runs of 1..``longest`` tokens whose place in the filter is set, and the rows of the slice that hold them."""
    def run(batches):
        for rb in batches:
            for flat, row in _slices(rb.column("t")):
                found = [[], [], []]
                for n in range(1, longest + 1):
                    at, a, b = _runs(flat, row, n)
                    place = a & mask
                    hit = (wanted.value[place >> 6] >> (place & 63).astype(np.uint64)) & np.uint64(1) != 0
                    for out, x in zip(found, (a[hit], b[hit], row[at[hit]])):
                        out.append(x)
                a, b, rows = (np.concatenate(x) for x in found)
                if not len(a):
                    continue
                order = np.argsort(a, kind="stable")       # rows of a run stay in order
                a, b, rows = a[order], b[order], rows[order]
                new = np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])]
                start = np.flatnonzero(new)
                held = np.add.reduceat((new | np.r_[True, rows[1:] != rows[:-1]]).astype(np.int64), start)
                yield pa.RecordBatch.from_arrays([pa.array(a[start]), pa.array(b[start]), pa.array(held)], names=["a", "b", "n"])
    return run


def phrase_counts(phrases: DataFrame, chunks: DataFrame, longest: int) -> DataFrame:
    """(phrase, df): chunks that hold each phrase (1..longest tokens) in a row.

    The runs of a chunk are digests of 128 bits (of 64-bit hashes of its tokens), counted in the
    task for many chunks at once.  A filter of at most ``FILTER_BITS`` bits, shipped to the tasks, leaves out
    runs that are no phrase; what it lets through by chance meets no phrase in the join."""
    hashes = lambda t: F.transform(t, lambda x: F.xxhash64(x))
    asked = persist_step(phrases.select("phrase").distinct().select("phrase", hashes(F.split("phrase", " ")).alias("t"))
                         .mapInArrow(_digests, "phrase string, a long, b long"))
    bits = min(FILTER_BITS, max(1 << 16, 1 << (16 * asked.count()).bit_length()))
    marks = asked.select(F.col("a").bitwiseAND(F.lit(bits - 1)).alias("place")).repartition(F.shiftright("place", 20)) \
        .mapInArrow(_mark, "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits"))
    wanted = np.zeros(bits >> 6, dtype=np.uint64)
    for rb in marks.toArrow().to_batches():     # at most FILTER_BITS / 64 rows of two numbers
        wanted[rb.column("word").to_numpy()] = rb.column("bits").to_numpy().view(np.uint64)
    shipped = chunks.sparkSession.sparkContext.broadcast(wanted)
    held = chunks.select(hashes(tokens("text")).alias("t")).mapInArrow(_held_runs(shipped, bits - 1, longest), "a long, b long, n long")
    return held.groupBy("a", "b").agg(F.sum("n").alias("df")).join(asked, ["a", "b"]).select("phrase", "df")


def _cut(longest: int, stop: tuple):
    """(i, seg): the best path through each lattice, null where there is none."""
    def best(n, least, places):
        part = {(j, x): (phrase, df) for j, x, phrase, df in places if df >= least and x != n and phrase not in stop}
        paths = [(0, 0, ())]
        for j in range(1, n + 1):
            ways = [(paths[j - x], *part[j, x]) for x in range(1, min(longest, j) + 1) if (j, x) in part and paths[j - x] is not None]
            paths.append(min(((p[0] + 1, p[1] - df, (*p[2], phrase)) for p, phrase, df in ways), default=None))
        return paths[n] and list(paths[n][2])

    def run(batches):
        for rb in batches:
            for lo in range(0, rb.num_rows, 512):
                part = rb.slice(lo, 512)
                e = part.column("e")
                ends = np.cumsum(e.value_lengths().to_numpy(zero_copy_only=False))
                places = list(zip(*(x.to_pylist() for x in e.flatten().flatten())))
                rows = zip(part.column("n").to_pylist(), part.column("least").to_pylist(), [0, *ends[:-1].tolist()], ends.tolist())
                seg = [best(n, least, places[first:end]) for n, least, first, end in rows]
                yield pa.RecordBatch.from_arrays([part.column("i"), pa.array(seg, pa.list_(pa.string()))], names=["i", "seg"])
    return run


def split_keywords(kw: DataFrame, chunks: DataFrame, ratio: int = 4, min_df: int = 2, longest: int = PART_WORDS,
                   stop=BROAD_WORDS) -> DataFrame:
    """Split a keyword into parts that stand on their own.

    A part is a run of at most ``longest`` tokens that at least ``min_df`` chunks hold,
    and at least ``ratio`` times as many as hold the whole keyword; words of ``stop`` are no
    parts.  Of all ways to cut the whole keyword into two or more parts (paths
    through the lattice of its token positions, by dynamic programming) the one of
    fewest parts counts, then of the most frequent parts, then the smallest.  The
    parts take the place of the keyword, without those whose tokens are a keyword
    of the list already; a keyword that cannot be cut stays.  Distinct.
    """
    k = persist_step(kw.filter(F.col("keyword").isNotNull()).select("keyword").distinct()
                     .select("keyword", tokens("keyword").alias("t"), F.monotonically_increasing_id().alias("i")))
    many = k.filter(F.size("t") > 1).select("i", "t", F.size("t").alias("n"))   # rows per place carry the number
    place = F.flatten(F.transform(F.sequence(F.lit(1), F.col("n")), lambda j: F.transform(
        F.array(*[F.lit(x) for x in range(1, longest + 1)]),
        lambda x: F.struct(j.alias("j"), x.alias("l"), F.when(x <= j, F.array_join(F.slice("t", F.greatest(j - x + 1, F.lit(1)), x), " ")).alias("phrase")))))
    edges = persist_step(many.select("i", "n", F.explode(place).alias("e")).select("i", "n", "e.j", "e.l", "e.phrase"))
    counts = persist_step(phrase_counts(edges.filter(F.col("phrase").isNotNull()), chunks, longest))
    known = hot_join(edges, counts, "phrase")
    lattice = known.groupBy("i", "n").agg(
        F.max(F.when((F.col("l") == F.col("n")) & (F.col("j") == F.col("n")), F.col("df"))).alias("whole"),
        F.collect_list(F.when(F.col("df") >= min_df, F.struct("j", "l", "phrase", "df"))).alias("e"))
    least = F.greatest(F.lit(min_df).cast("long"), F.coalesce("whole", F.lit(0).cast("long")) * ratio)
    cut = lattice.select("i", "n", least.alias("least"), "e").mapInArrow(_cut(longest, tuple(stop)), "i long, seg array<string>")
    cut = persist_step(cut.filter(F.col("seg").isNotNull()))
    kept = persist_step(k.join(cut, "i", "left_anti").select("keyword", _norm_key("keyword").alias("k")))
    parts = cut.select(F.explode("seg").alias("keyword")).distinct().withColumn("k", _norm_key("keyword")).join(kept, "k", "left_anti")
    return kept.select("keyword").unionByName(parts.select("keyword"))


def drop_broad(kw: DataFrame, chunks: DataFrame, max_df: float = 0.5, stop=BROAD_WORDS) -> DataFrame:
    """Drop stop-list keywords and keywords whose tokens all occur together
    in more than ``max_df`` of the chunks.

    Skew-safe plan: a keyword can only be broad when each of its tokens is
    broad (df > max_df * N).  Broad tokens are few by construction -- at most
    (distinct tokens per chunk) / max_df of them -- so single-token keywords
    read df from the aggregated vocabulary, keywords with any non-broad token
    are kept without counting, and only keywords made of broad tokens are
    counted exactly: chunks with the same broad tokens are counted once, and meet
    the keywords' token sets by their first token."""
    from lexgraph.operators.embed import corpus_vocab
    n = chunks.count()
    thr = F.lit(float(max_df) * n)
    k = kw.select("keyword", F.array_distinct(tokens("keyword")).alias("t")).filter(F.size("t") > 0)
    k = k.filter(~F.lower(F.col("keyword")).isin(list(stop)))
    vocab = corpus_vocab(chunks, text_col="text")
    broad_tok = vocab.filter(F.col("df") > thr).select("token")
    kt = k.select("keyword", F.size("t").alias("m"), F.explode("t").alias("token"))
    # keywords all of whose tokens are broad: the only ones that can be broad
    nb = kt.join(broad_tok, "token", "left_semi").groupBy("keyword", "m").agg(F.count(F.lit(1)).alias("nb"))
    cand = nb.filter(F.col("nb") == F.col("m")).select("keyword", "m")
    single = cand.filter(F.col("m") == 1).select("keyword")      # df(keyword) = df(token) > thr
    multi = kt.join(cand.filter(F.col("m") > 1).select("keyword"), "keyword", "left_semi")
    # a chunk is reduced to its broad tokens in its row, and chunks with the same ones
    # are one row; these meet the keywords' token sets by their first token, which
    # half of all chunks hold, hence the salt
    broad_tokens = [r["token"] for r in broad_tok.collect()]  # at most (distinct tokens per chunk) / max_df
    asked = multi.groupBy("keyword").agg(F.array_sort(F.collect_list("token")).alias("t"))
    sets = asked.select("t").distinct().select("t", F.get("t", F.lit(0)).alias("first"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    broad_array = F.array(*[F.lit(t) for t in broad_tokens]).cast("array<string>")
    held = chunks.select(F.array_sort(F.array_intersect(tokens("text"), broad_array)).alias("own")).groupBy("own").agg(F.count(F.lit(1)).alias("n"))
    hit = held.select("n", "own", F.pmod(F.xxhash64("own"), F.lit(SALTS)).cast("int").alias("salt"), F.explode("own").alias("first")) \
        .join(sets, ["first", "salt"]).filter(F.size(F.array_except("t", "own")) == 0)
    often = hit.groupBy("t").agg(F.sum("n").alias("df")).filter(F.col("df") > thr).select("t")
    multi_broad = asked.join(often, "t").select("keyword")
    broad = single.unionByName(multi_broad)
    return k.select("keyword").join(broad, "keyword", "left_anti")


def cleanup_keywords(kw: DataFrame, chunks: DataFrame, max_df: float = 0.5, strict: bool = False) -> DataFrame:
    """dedup -> splitting -> deletion -> clean, in that fixed order."""
    return clean_keywords(drop_broad(split_keywords(dedup_keywords(kw), chunks), chunks, max_df), strict=strict)
