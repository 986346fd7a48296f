"""Main text of web pages by composite text density.

Every page is cut into tags and texts and kept as a flat node list in document
order (no recursion, so depth does not matter).  Elements that are never main
text -- by tag, role or hidden state -- are left out first, then those whose
name and place or density tell the same (``_drop_named``).  Then, for every node:

* density = characters per tag, with its logarithm weight lowered by the links:
  ``C/T * log_b(C/LC * T/LT)``, ``b = ln(C/nLC * LC + LCbody/Cbody * C + e)``;
* density sum = the sum over its child elements.

The node with the largest density sum is the core.  The least density on its
path to the body is the threshold: other branches beside that path whose
density reaches it add their own largest-sum subtree.  An enclosing
``article`` or ``main`` is taken whole, and text blocks (headings, paragraphs,
lists) that share the core's parent come with it however short they are, so
the threshold picks containers and never cuts single short paragraphs out.

Defined cases: NULL or empty html, or a page without text, gives an empty
string; repeated rows give repeated rows; unclosed elements, stray end tags
and unclosed comments are repaired as browsers do (roughly); other columns of
the input are left out.  Each page is its own unit of work: no shuffle.
"""

from __future__ import annotations

import html as _html
import math
import re

from pyspark.sql import DataFrame, SparkSession

from lexgraph.llm.common import chunks_of, read

# Element names of the HTML standard by their role here.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noframes noembed".split())
HEAD = frozenset("head title base link meta style script noscript template".split())
CLOSE_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer "
                    "form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section summary table ul".split())
BLOCK = CLOSE_P | frozenset("html body li dt dd tr td th caption thead tbody tfoot option optgroup legend".split())
SIBLING = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "option": ("option",), "tr": ("tr", "td", "th"),
           "td": ("td", "th"), "th": ("td", "th"), "tbody": ("tbody", "thead", "tfoot", "tr", "td", "th"),
           "tfoot": ("tbody", "thead", "tr", "td", "th")}
SCOPE = frozenset("table ul ol dl select html body article main section div td th button".split())
TEXT_BLOCKS = frozenset("p h1 h2 h3 h4 h5 h6 pre blockquote ul ol dl table figure".split())
TEXT_PARTS = TEXT_BLOCKS | frozenset("li dt dd tr td th thead tbody tfoot caption figcaption".split())
# Left out with all they hold; main text may still sit inside the second group.
HARD = frozenset("head script style noscript template iframe object svg canvas footer aside dialog button select "
                 "textarea input datalist menu map audio video applet".split())
SOFT = frozenset("nav header form".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert form menu menubar "
                  "toolbar tablist".split())
# Words in class names and ids that tell what is not the article.
NOT_MAIN = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense adslot sponsor sponsored sponsors promo promos promotion "
    "banner banners menu menus nav navbar navigation breadcrumb breadcrumbs sidebar sidebars aside footer header "
    "masthead topbar cookie cookies consent gdpr notice notices notification alert popup modal overlay newsletter "
    "subscribe subscription signup login share sharing social related recommended recommendations comment comments "
    "commentlist disqus respond reply replies responses widget widgets toolbar pagination pager copyright search "
    "paywall trending".split())
COMMENTS = frozenset("comment comments commentlist disqus respond reply replies responses".split())
ARTICLE_WORDS = frozenset("article entry post content story main".split())
# Words that only say where or what box a named element is.
BOX_WORDS = frozenset(
    "area bar block body bottom box buttons button container fixed form group inner item items left link links list main "
    "outer panel post posts article articles results right section site slot sticky thread top unit wrap wrapper".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())

TAG = re.compile(r"""<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*+)>""")
ATTR = re.compile(r"""([^\s"'>/=][^\s"'>/=]*)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?|"[^"]*"|'[^']*'""")
NAME = re.compile(r"[a-z]+|[A-Z]+(?![a-z])|[A-Z][a-z]+")
RAW_END = {name: re.compile(rf"</{name}(?=[\s/>])", re.I) for name in RAW}


def _named_out(names: str, known: frozenset) -> bool:
    """Whether a class name or id begins or ends with one of the known words."""
    for name in names.split():
        words = [w.lower() for w in NAME.findall(name)]
        if not words:
            continue
        if words[0] in known:
            return True
        if words[-1] in known and words[0] not in ("has", "with", "no", "not", "is"):
            if words[-1] == "header" and words[0] in ARTICLE_WORDS:
                continue
            return True
    return False


def _name_kind(names: str) -> int:
    """0: no known word; 1: known and other words; 2: known words and words
    for boxes only; 3: the same, and it holds comments."""
    kind = 0
    for name in names.split():
        if _named_out(name, NOT_MAIN):
            words = {w.lower() for w in NAME.findall(name)}
            sure = words <= NOT_MAIN | BOX_WORDS
            kind = max(kind, 1 + sure + (sure and _named_out(name, COMMENTS)))
    return kind


def _left_out(tag: str, attrs: str, in_article: bool, by_name: bool) -> tuple[int, int]:
    """(0: may be main text; 1: not, but an article inside may; 2: not) and
    what the element's names tell (``_name_kind``)."""
    if tag in HARD:
        return 2, 0
    kind = named = 0
    if tag in SOFT and not (tag == "header" and in_article):
        kind = 1
    if attrs and not attrs.isspace():
        seen = set()
        for key, value in ATTR.findall(attrs):
            key, value = key.lower(), value.strip("\"'")
            if not key or key in seen:  # the first of a repeated attribute holds
                continue
            seen.add(key)
            if key == "hidden" and value.lower() != "false" or key == "aria-hidden" and value.lower() == "true":
                return 2, 0
            if key == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
                return 2, 0
            if key == "role" and value.lower() in ROLES and tag not in ("body", "main", "article"):
                kind = max(kind, 1)
            if by_name and key in ("class", "id") and tag not in ("html", "body", "main") and tag not in HEADINGS:
                named = max(named, _name_kind(value))
    return kind, named


class Page:
    """Flat tree of one page.  ``events`` holds (node, text) in page order,
    with text None where the node opens and False where it closes."""

    def __init__(self, source: str, by_name: bool = True, drop_forms: bool = True):
        self.tag, self.parent, self.out, self.first, self.last = ["#root"], [-1], [0], [0], [0]
        self.named = [0]
        self.events: list = []
        self.by_name, self.drop_forms = by_name, drop_forms
        self._stack = [0]
        self._live: dict[str, int] = {}  # open elements by name
        self._parse(source)
        while len(self._stack) > 1:
            self._pop()
        self.last[0] = len(self.events)
        if any(self.named):
            self._drop_named()

    def _pop(self):
        n = self._stack.pop()
        self._live[self.tag[n]] -= 1
        self.events.append((n, False))
        self.last[n] = len(self.events)

    def _pop_to(self, depth: int):
        while len(self._stack) > depth:
            self._pop()

    def _open(self, tag: str, attrs: str):
        stack, tags, live = self._stack, self.tag, self._live
        if tag == "html" or tag == "body":
            if len(stack) > 1 and tags[stack[-1]] in HEAD:
                self._pop_to(next(i for i, n in enumerate(stack) if tags[n] in HEAD))
            if live.get(tag):
                return
        elif live.get("head") and tag not in HEAD:
            self._pop_to(next(i for i, n in enumerate(stack) if tags[n] == "head"))
        if tag in CLOSE_P and live.get("p"):
            for i in range(len(stack) - 1, 0, -1):
                if tags[stack[i]] == "p":
                    self._pop_to(i)
                    break
                if tags[stack[i]] in BLOCK:
                    break
        if tag in SIBLING:
            ends = SIBLING[tag]
            for i in range(len(stack) - 1, 0, -1):
                if tags[stack[i]] in ends:
                    self._pop_to(i)
                    if not (len(stack) > 1 and tags[stack[-1]] in ends):
                        break
                elif tags[stack[i]] in SCOPE:
                    break
        up = stack[-1]
        n = len(tags)
        tags.append(tag)
        self.parent.append(up)
        kind, named = _left_out(tag, attrs, bool(live.get("article") or live.get("main")), self.by_name)
        if tag == "form" and not self.drop_forms and kind == 1:
            kind = 0
        if self.out[up] == 2 or self.out[up] == 1 and tag not in ("article", "main"):
            kind = max(kind, self.out[up])
        self.out.append(kind)
        self.named.append(named)
        self.first.append(len(self.events))
        self.last.append(len(self.events))
        self.events.append((n, None))
        if tag in VOID:
            self.events.append((n, False))
            self.last[n] = len(self.events)
        else:
            stack.append(n)
            live[tag] = live.get(tag, 0) + 1

    def _close(self, tag: str):
        if not self._live.get(tag):
            return
        stack, tags = self._stack, self.tag
        for i in range(len(stack) - 1, 0, -1):
            t = tags[stack[i]]
            if t == tag:
                self._pop_to(i)
                return
            if t in BLOCK and tag not in BLOCK or t in ("td", "th") and tag not in ("table", "tr", "tbody", "body", "html"):
                return

    def _text(self, s: str):
        if s:
            self.events.append((self._stack[-1], s))

    def _parse(self, s: str):
        at, end = 0, len(s)
        while at < end:
            lt = s.find("<", at)
            if lt < 0:
                self._text(s[at:])
                return
            if lt > at:
                self._text(s[at:lt])
            if s.startswith("<!--", lt):
                stop = s.find("-->", lt + 4)
                at = end if stop < 0 else stop + 3
                continue
            follow = s[lt + 1:lt + 2]
            if follow in ("!", "?"):
                stop = s.find(">", lt)
                at = end if stop < 0 else stop + 1
                continue
            m = TAG.match(s, lt)
            if not m:
                stop = s.find(">", lt) if follow.isalpha() or follow == "/" else -1
                name = re.match(r"</?([a-zA-Z][^\s/>]*)", s[lt:lt + 64])
                if stop < 0 or not name:
                    self._text("<")
                    at = lt + 1
                    continue
                closing, tag, attrs, at = follow == "/", name[1].lower(), "", stop + 1
            else:
                closing, tag, attrs, at = bool(m[1]), m[2].lower(), m[3], m.end()
            if closing:
                self._close(tag)
                continue
            self._open(tag, attrs)
            if tag in RAW:
                stop = RAW_END[tag].search(s, at)
                at = stop.start() if stop else end

    # ---------------------------------------------------------------- density
    def densities(self):
        tags, parent = self.tag, self.parent
        n = len(tags)
        chars, links, n_tags, n_links = [0] * n, [0] * n, [0] * n, [0] * n
        for node, s in self.events:
            if s and not self.out[node]:
                s = " ".join(s.split())
                chars[node] += len(_html.unescape(s) if "&" in s else s)
        linked = [False] * n
        for i in range(1, n):
            linked[i] = tags[i] == "a" or linked[parent[i]]
            if linked[i]:
                links[i] = chars[i]
        for i in range(n - 1, 0, -1):
            p = parent[i]
            chars[p] += chars[i]
            links[p] += links[i]
            if not self.out[i]:
                n_tags[p] += 1
                n_links[p] += tags[i] == "a"
            n_tags[p] += n_tags[i]
            n_links[p] += n_links[i]
        body = next((i for i in range(n) if tags[i] == "body"), 0)
        share = links[body] / max(chars[body], 1)
        density, total = [0.0] * n, [0.0] * n
        has_child = [False] * n
        for i in range(n - 1, -1, -1):
            c = chars[i]
            if c and not self.out[i]:
                lc, t, lt = max(links[i], 1), max(n_tags[i], 1), max(n_links[i], 1)
                base = math.log(c / max(c - links[i], 1) * links[i] + share * c + math.e)
                # a node without a link keeps its plain characters per tag times the log weight
                density[i] = c / t * math.log(max(c / lc * t / lt, 1.0)) / math.log(max(base, 1.0) + 1e-9) \
                    if base > 1.0 + 1e-9 else c / t * math.log(max(c * t, 1.0) + 1.0)
            if not has_child[i]:
                total[i] = density[i]
            if i and not self.out[i]:
                p = parent[i]
                total[p] += density[i]
                has_child[p] = True
        return body, chars, links, n_tags, n_links, density, total

    def _drop_named(self):
        """Leave out elements whose names tell that they are no main text.

        The holder is the article with the most text beside links or, on a page
        without one, the smallest element with more than half of it.  Names
        never count on the holder and what encloses it.  Outside the holder
        known names alone are enough, others must be less dense than the body;
        inside, comments go, link blocks go, and boxes with known names go where
        they are less dense than the holder."""
        tags, parent, out, named = self.tag, self.parent, self.out, self.named
        body, chars, links, n_tags, _, _, _ = self.densities()
        n = len(tags)
        plain = [c - x for c, x in zip(chars, links)]
        # characters beside links per tag: the composite density's logarithm says little on the few words of a box
        density = [c / max(t, 1) for c, t in zip(plain, n_tags)]
        comment = [False] * n
        for i in range(1, n):
            comment[i] = named[i] == 3 or comment[parent[i]]
        own = [i for i in range(n) if tags[i] in ("article", "main") and not out[i] and not comment[i]]
        if own:
            holder = max(own, key=lambda i: (plain[i], -i))
        else:
            said = sum(plain[i] for i in range(n) if named[i] == 3 and not comment[parent[i]])
            rest = plain[body] - said
            holder = -1
            for i in range(n):  # children come after their parents, so the last that fits is the smallest
                if i != body and tags[i] in BLOCK and tags[i] != "html" and not out[i] and not comment[i] and 2 * plain[i] > rest:
                    holder = i
        while not own and holder > 0 and tags[holder] in TEXT_PARTS:
            holder = parent[holder]
        around, x = set(), holder
        while x >= 0:
            around.add(x)
            x = parent[x]
        inside = [False] * n
        for i in range(1, n):
            inside[i] = inside[parent[i]] or i == holder and i != body
            if out[parent[i]] == 2:
                out[i] = 2
            if not named[i] or out[i] or i in around or tags[i] not in BLOCK and tags[parent[i]] in TEXT_PARTS:
                continue
            if tags[i] == "article" and named[i] != 3:
                continue
            if inside[i]:
                box = named[i] == 2 and tags[i] in ("div", "ul", "ol") and density[i] < density[holder]
                gone = named[i] == 3 or box or 2 * links[i] >= chars[i] > 0
            else:
                gone = named[i] > 1 or density[i] < density[body]
            if gone:
                out[i] = 2

    def main_text(self) -> str:
        body, chars, links, _, n_links, density, total = self.densities()
        n, parent, tags = len(self.tag), self.parent, self.tag
        if not chars[body]:
            body = 0
        if not chars[body]:
            return ""
        best = list(range(n))  # the largest density sum in each subtree, the outermost among equals
        kids: list[list[int]] = [[] for _ in range(n)]
        for i in range(n - 1, 0, -1):
            if self.out[i]:
                # an article inside a left-out wrapper still counts for the nodes above
                if not chars[i]:
                    continue
            p = parent[i]
            kids[p].append(i)
            if chars[best[i]] and total[best[i]] > (total[best[p]] if not self.out[best[p]] else -1.0):
                best[p] = best[i]
        core = best[body] if chars[best[body]] and not self.out[best[body]] else body
        path, x = [], core
        while x >= 0:
            path.append(x)
            if x == body:
                break
            x = parent[x]
        threshold = min(density[i] for i in path if not self.out[i])
        chosen, work, seen = [core], path[1:], set(path)
        while work:
            node = work.pop()
            for c in kids[node]:
                if c in seen or self.out[c] or not chars[c] or density[c] < threshold:
                    continue
                if chars[c] <= 2 * links[c]:
                    continue
                sub = best[c]
                seen.add(c)
                chosen.append(sub)
                y = parent[sub]
                while y != node and y >= 0 and y not in seen:
                    seen.add(y)
                    work.append(y)
                    y = parent[y]
        semantic = set()
        for c in chosen:
            x, holder = c, -1
            while x > 0:
                if tags[x] in ("article", "main") and not self.out[x]:
                    holder = x
                    break
                x = parent[x]
            semantic.add(holder if holder >= 0 else c)
        core_holder = next((x for x in path if tags[x] in ("article", "main") and not self.out[x]), -1)
        if core_holder >= 0:  # the page names its article: take it, and other named ones that were chosen
            semantic = {x for x in semantic if tags[x] in ("article", "main")}
        elif core != body:
            box = core  # the container of the core: the first node above that is no part of a text block
            while box != body and (tags[box] not in BLOCK or tags[box] in TEXT_PARTS):
                box = parent[box]
            box = parent[core] if box == core else box
            semantic.update(c for c in kids[box] if tags[c] in TEXT_BLOCKS and not self.out[c])
        return self._blocks(semantic, chars, links, n_links)

    def _blocks(self, chosen: set[int], chars, links, n_links) -> str:
        tags, out = self.tag, self.out
        blocks: list[str] = []
        buf: list[str] = []
        inside = int(0 in chosen)  # the root has no events of its own
        menus = 0

        def flush():
            line = " ".join(_html.unescape("".join(buf)).split())
            buf.clear()
            if line:
                blocks.append(line)

        for node, s in self.events:
            if s is None or s is False:
                is_menu = (n_links[node] >= 3 and links[node] >= 0.8 * chars[node] > 0
                           and tags[node] in ("ul", "ol", "dl", "div", "section", "table"))
                if s is None:
                    if node in chosen:
                        inside += 1
                    menus += is_menu
                if inside:
                    if tags[node] in BLOCK:
                        flush()
                    elif tags[node] == "br":
                        buf.append(" ")
                if s is False:
                    menus -= is_menu
                    if node in chosen:
                        inside -= 1
                        if not inside:
                            flush()
            elif inside and not menus and not out[node]:
                buf.append(s)
        flush()
        return "\n\n".join(blocks)


def extract_text(source: str | None) -> str:
    if not source:
        return ""
    for by_name, drop_forms in ((True, True), (True, False), (False, False)):
        text = Page(source, by_name, drop_forms).main_text()
        if text:
            return text
    return ""


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page id, url, text, n_chars), one row per page row."""
    fields = {f.name: f.dataType.simpleString() for f in pages.schema.fields}
    schema = f"`{id_col}` {fields[id_col]}, `{url_col}` {fields[url_col]}, text string, n_chars long"

    def run(batches):
        import pyarrow as pa
        for b in chunks_of(batches, 2_000, html_col, 16 << 20):
            texts = [extract_text(x) for x in b.column(html_col).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [b.column(id_col), b.column(url_col), pa.array(texts, pa.string()),
                 pa.array([len(x) for x in texts], pa.int64())], names=[id_col, url_col, "text", "n_chars"])

    return pages.select(id_col, url_col, html_col).mapInArrow(run, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(read(spark, sf_dir, "pages"))
