"""Main text of web pages by site style trees.

Every page's DOM becomes element paths (tag, class and id of the block-level
elements, digits folded), and the DOMs of one host merge into a style tree.
For each element of the tree, over the ``m`` pages that have it:

* content importance: 1 minus the mean of ``log k / log m`` over its distinct
  texts, ``k`` being the pages that show a text (shown everywhere: 0)
* presentation importance: the entropy of its child sequences, to the base m
* together ``(1 - g ** l) * presentation + g ** l * content`` with ``l`` child
  sequences; content alone for elements without block-level children

Pages with the same html count once.  An importance from few pages is drawn
towards that of the same path over all hosts, and that towards 1 (weight
``PRIOR_PAGES``); inside ``article`` it is drawn to 1 with ``ARTICLE_PAGES``, as a
repeated paragraph is still the article.

A branch goes if its score is below 0, the sum of (see :func:`branch_score`)

* what the tree says: how far the larger of its importance and the content
  importance of its whole subtree (the entropy of child sequences to the base m
  sinks as a host grows) lies above or below ``LEAST``
* its name, one prior: the elements ``nav``, ``footer``, ``aside``, forms and
  class, id or role words that say nothing but that (``comments``, ``share-bar``)
  weigh more than varied texts do, as reader comments vary as much as articles;
  such a word among others (``related-work``, ``search-algorithms``) weighs little,
  as does any word on a paragraph and an id, which may come from a heading, inside
  an article; ``header`` is no such word there
* its place: inside an ``article`` unless its name speaks against it, or beside one
* the share of its text that stands in links
* its share of the host's text; more than half of it outweighs a name (a form or
  layout element around the page), but not inside or beside an article

``main`` is layout, not an article.

Scale: a page adds one row per distinct text of a path; rows are counted with
map-side combination, so a hot host costs no more than its distinct texts, and
only (host, paths to remove or keep) meets the pages, broadcast if its measured size is
bounded and joined otherwise.  Texts are never shuffled while it is.

Defined cases: null html, and pages of which nothing is left, give an empty
text; a null URL counts as one host of its own; broken markup (open elements,
stray end tags) is closed as HTML prescribes for paragraphs and list items, and
a head left open ends at ``body`` or the first thing that cannot be in it;
formulas and drawings are inline, their visible text stays in its block (not
titles, descriptions and annotations); repeated rows each get a row.
"""

from __future__ import annotations

import hashlib
import re
from html.parser import HTMLParser

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from matchbook.llm.common import add_by_arrow, broadcast_if_fits, table, write_shared
from matchbook.llm.url_filter import host_of

DECAY = 0.9
LEAST = 0.35
PRIOR_PAGES = 20
ARTICLE_PAGES = 500
# weights of a branch's score
MOST_TEXT, MOST_WEIGHT = 0.5, 1.5
NAME_WEIGHTS = (0.0, 0.25, 2.0)            # no name, a weak one, a strong one
INSIDE_WEIGHTS = (0.5, 0.1, 0.0)           # inside an article, by name
LINK_WEIGHT = 1.2
BESIDE_WEIGHT = 0.5

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp "
                   "small span strike strong sub sup time tt u var wbr br img".split())
SILENT = frozenset("script style noscript template head title iframe object canvas audio video".split())
IN_HEAD = frozenset("base basefont bgsound head link meta noframes noscript script style template title".split())
FOREIGN = frozenset(["math", "svg"])
FOREIGN_SILENT = frozenset("annotation annotation-xml defs desc metadata script style title".split())
FOREIGN_BREAKS = frozenset("text foreignobject".split())
HOLDS_HTML = frozenset("annotation-xml desc foreignobject title".split())
# HTML elements that end a formula or drawing left open
ENDS_FOREIGN = frozenset("b big blockquote body br center code dd div dl dt em embed h1 h2 h3 h4 h5 h6 head hr i img li "
                         "menu meta nobr ol p pre ruby s small span strike strong sub sup table tt u ul var".split())
NOISE = frozenset("nav footer aside form button select textarea menu dialog".split()) | SILENT
NOISE_WORDS = frozenset(
    "ad ads advert adverts advertisement banner sponsor sponsored promo promotion sidebar menu nav navbar navigation "
    "breadcrumb breadcrumbs footer header masthead notice cookie cookies consent popup modal newsletter subscribe "
    "share sharing social related comment comments reply replies disqus widget toolbar pagination pager login "
    "signup search copyright".split())
CLOSED_BY = {"p": frozenset("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr "
                            "main nav ol p pre section table ul".split()),
             "li": frozenset(["li"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]),
             "tr": frozenset(["tr"]), "td": frozenset(["td", "th", "tr"]), "th": frozenset(["td", "th", "tr"]),
             "option": frozenset(["option"])}
KEEPS_OPEN = {"li": frozenset(["ul", "ol", "menu"]), "dt": frozenset(["dl"]), "dd": frozenset(["dl"]),
              "tr": frozenset(["table"]), "td": frozenset(["table"]), "th": frozenset(["table"])}
# words that say nothing beside a noise word
NEUTRAL_WORDS = frozenset(
    "area bar block blocks bottom box btn button buttons card cards col column container content footer head inner item items "
    "js left link links list main module outer page panel post posts right row section sections site sub thread tool tools "
    "top text title wrap wrapper zone".split())
UNNAMED = frozenset("html body main article h1 h2 h3 h4 h5 h6".split())
UNNAMED_INSIDE = frozenset(["header", "masthead"])
# a path's kind: its name, plus INSIDE within an article
UNSAID, WEAK, STRONG = range(3)
INSIDE = 3
_WORDS = re.compile(r"[a-z]+")
_DIGITS = re.compile(r"\d+")


def digest(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "big", signed=True)


def name_of(tag: str, attrs: list, inside: bool) -> int:
    """What an element's names say: UNSAID, WEAK or STRONG."""
    if tag in NOISE or (tag == "header" and not inside):
        return STRONG
    if tag in UNNAMED:
        return UNSAID
    noise = NOISE_WORDS - UNNAMED_INSIDE if inside else NOISE_WORDS
    found = UNSAID
    for key, value in attrs:
        if key not in ("class", "id", "role") or not value:
            continue
        for name in value.lower().split():
            words = set(_WORDS.findall(name))
            if noise.isdisjoint(words):
                continue
            only = words <= noise | NEUTRAL_WORDS
            found = max(found, STRONG if only and not (inside and (key == "id" or tag == "p")) else WEAK)
    return found


class Page(HTMLParser):
    """Blocks of a page in order, and the elements of its tree."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.open: list[tuple] = []          # (tag, path), block-level elements and silent ones
        self.foreign: list[str] = []         # open elements of a formula or drawing, which is inline
        self.pieces: list[str] = []
        self.blocks: list[tuple] = []        # (path, text, characters of it in links)
        self.link, self.linked = False, 0
        self.children: dict[str, list[str]] = {}
        self.kinds: dict[str, int] = {}      # of a path, UNSAID if missing
        self.articles: list[str] = []        # paths of article elements

    def handle_starttag(self, tag, attrs):
        if self.foreign and tag in ENDS_FOREIGN and HOLDS_HTML.isdisjoint(self.foreign):
            self.foreign.clear()
        if tag == "body" or tag not in IN_HEAD:
            self.end_head(tag == "body")
        if self.foreign or tag in FOREIGN:
            if tag in FOREIGN_BREAKS:
                self.pieces.append(" ")
            if tag not in VOID:
                self.foreign.append(tag)
            return
        if tag in INLINE:
            if tag == "br":
                self.pieces.append(" ")
            self.link = self.link or tag == "a"
            return
        self.cut()
        for open_tag, closers in CLOSED_BY.items():
            if tag in closers:
                self.close_to(open_tag, KEEPS_OPEN.get(open_tag, frozenset(["article", "body"])))
        if tag in VOID:
            return
        path = self.open[-1][1] if self.open else ""
        names = " ".join(sorted(v for k, v in attrs if k in ("class", "id", "role") and v)).lower()
        step = tag + ("." + _DIGITS.sub("#", names).replace("/", "|") if names else "")
        self.children.setdefault(path, []).append(step)
        path = f"{path}/{step}"
        if path not in self.kinds:
            inside = tag == "article" or any(o[0] == "article" for o in self.open)
            self.kinds[path] = name_of(tag, attrs, inside) + INSIDE * inside
        if tag == "article":
            self.articles.append(path)
        self.open.append((tag, path))

    def handle_endtag(self, tag):
        if self.foreign:
            if tag in self.foreign:
                while self.foreign.pop() != tag:
                    pass
                if tag in FOREIGN_BREAKS:
                    self.pieces.append(" ")
                return
            if tag in INLINE or not any(o[0] == tag for o in self.open):
                return
            self.foreign.clear()
        if tag == "a":
            self.link = False
        if tag not in INLINE:
            self.cut()
            self.close_to(tag, frozenset())

    def end_head(self, whole=False):
        """Close an open head, as what cannot be in it does; ``whole`` closes
        one with open elements too."""
        if self.open and (self.open[-1][0] == "head" or whole):
            self.close_to("head", frozenset(["body"]))

    def close_to(self, tag, keeps):
        """Close the innermost open ``tag`` that no element of ``keeps`` encloses."""
        for i in range(len(self.open) - 1, -1, -1):
            if self.open[i][0] == tag:
                del self.open[i:]
                return
            if self.open[i][0] in keeps:
                return

    def handle_data(self, data):
        if data.strip():
            self.end_head()
        if (not self.open or self.open[-1][0] not in SILENT) and FOREIGN_SILENT.isdisjoint(self.foreign):
            self.pieces.append(data)
            if self.link:
                self.linked += len(" ".join(data.split()))

    def cut(self):
        if self.pieces:
            text, linked = " ".join("".join(self.pieces).split()), self.linked
            self.pieces, self.linked = [], 0
            if text:
                if not any(o[0] in SILENT for o in self.open):
                    self.blocks.append((self.open[-1][1] if self.open else "", text, min(linked, len(text))))


def read_page(html: bytes | None) -> Page:
    page = Page()
    if html:
        page.feed(html.decode("utf-8", "replace"))
        page.close()
        page.cut()
    return page


def above(path: str) -> list[str]:
    """``path`` and the elements around it, without html and body."""
    parts = path.split("/")[1:]
    return ["/" + "/".join(parts[:i]) for i in range(1, len(parts) + 1)
            if parts[i - 1].split(".")[0] not in ("html", "body")]


def _elements(page: Page) -> dict[str, tuple]:
    """Per path: distinct texts and text length of the subtree, the child
    sequence, the length of its text in links, and whether it stands beside an
    article (neither in one nor around one)."""
    out: dict[str, list] = {}
    for path, text, linked in page.blocks:
        mark = digest(text)
        for p in above(path):
            got = out.setdefault(p, [set(), 0, 0])
            got[0].add(mark)
            got[1] += len(text)
            got[2] += linked

    def beside(p):
        return bool(page.articles) and not any(p == a or p.startswith(a + "/") or a.startswith(p + "/") for a in set(page.articles))
    return {p: (marks, size, page.children.get(p), linked, beside(p)) for p, (marks, size, linked) in out.items()}


def _tree_rows(cols):
    made, chars = [], []
    for html in cols[0]:
        rows = []
        page = read_page(html)
        chars.append(sum(len(text) for _, text, _ in page.blocks))
        for path, (marks, size, children, linked, beside) in _elements(page).items():
            rows.append({"path": digest(path), "kind": page.kinds.get(path, UNSAID), "size": size, "linked": linked,
                         "beside": int(beside), "form": digest(" ".join(children)) if children else None,
                         "texts": sorted(marks)})
        made.append(rows)
    return [chars, made]


def importance(pages: DataFrame, host_col: str, html_col: str) -> DataFrame:
    """Rows (host, path, kind, pages, size, linked, beside, whole, content, imp): the
    merged trees of all hosts.  ``path`` is a digest of the element path, ``size`` the
    text of its subtree, ``linked`` that in links, ``beside`` the share of pages on
    which it stands beside an article, ``whole`` the text of the host."""
    seen = add_by_arrow(pages.select(F.col(host_col).alias("host"), F.col(html_col).alias("html"),
                                     F.xxhash64(html_col).alias("same")), ["html"],
                        "chars long, elements array<struct<path:long,kind:int,size:long,linked:long,beside:int,form:long,texts:array<long>>>", _tree_rows)
    seen = seen.groupBy("host", "same").agg(F.first("chars").alias("chars"), F.first("elements").alias("elements"))
    seen = write_shared(seen.select("host", "chars", "elements"), "page-elements")
    whole = seen.groupBy(F.col("host").alias("of")).agg(F.sum("chars").alias("whole"))
    seen = seen.select("host", F.explode("elements").alias("e")).select("host", "e.*")
    rate = F.log(F.col("k")) / F.log(F.greatest(F.col("pages"), F.lit(2)).cast("double"))

    def tree(keys: list[str]) -> DataFrame:
        size = seen.groupBy(*keys).agg(F.count(F.lit(1)).alias("pages"), F.sum("size").alias("size"),
                                       F.sum("linked").alias("linked"), F.avg("beside").alias("beside"), F.max("kind").alias("kind"))
        texts = (seen.select(*keys, F.explode("texts").alias("t")).groupBy(*keys, "t").agg(F.count(F.lit(1)).alias("k"))
                     .groupBy(*keys).agg(F.sum(F.log("k")).alias("text_logs"), F.count(F.lit(1)).alias("text_n")))
        forms = (seen.filter("form is not null").groupBy(*keys, "form").agg(F.count(F.lit(1)).alias("k"))
                     .groupBy(*keys).agg(F.sum(F.col("k") * F.log("k")).alias("form_logs"),
                                         F.sum("k").alias("form_pages"), F.count(F.lit(1)).alias("forms")))
        base = F.log(F.greatest(F.col("pages"), F.lit(2)).cast("double"))
        content = 1 - F.col("text_logs") / F.col("text_n") / base
        shape = (F.log("form_pages") - F.col("form_logs") / F.col("form_pages")) / base
        keep = F.pow(F.lit(DECAY), "forms")
        both = F.when(F.col("forms").isNull(), content).otherwise((1 - keep) * shape + keep * content)
        return size.join(texts, keys).join(forms, keys, "left").select(
            *keys, "pages", "size", "linked", "beside", "kind", content.alias("content"), both.alias("imp"))

    def drawn(imp: str, pages: str, to, weight):
        known = F.col(pages) - 1
        return (known * F.col(imp) + weight * to) / (known + weight)

    host = tree(["host", "path"])
    kind = F.col("kind")
    anywhere = tree(["path"]).select("path", *[drawn(c, "pages", F.lit(1.0), F.lit(PRIOR_PAGES)).alias(f"{c}_anywhere")
                                              for c in ("content", "imp")])
    weight = F.when(kind == INSIDE + UNSAID, ARTICLE_PAGES).otherwise(PRIOR_PAGES)

    def prior(c: str):
        return F.when(kind == INSIDE + UNSAID, 1.0).otherwise(F.col(f"{c}_anywhere"))
    return host.join(anywhere, "path").join(whole, F.col("host").eqNullSafe(F.col("of"))).select(
        "host", "path", "kind", "pages", "size", "linked", "beside", "whole",
        *[drawn(c, "pages", prior(c), weight).alias(c) for c in ("content", "imp")])


def branch_score() -> Column:
    """Score of a row of :func:`importance`: below 0 the branch goes."""
    name, inside = F.col("kind") % INSIDE, F.col("kind") >= INSIDE

    def by_name(weights) -> Column:
        return F.element_at(F.array(*[F.lit(w) for w in weights]), name + 1)
    share = F.try_divide(F.col("size"), F.col("whole"))
    around = ~inside & (F.col("beside") < 0.5)
    return ((F.greatest("content", "imp") - LEAST) / (1 - LEAST) - by_name(NAME_WEIGHTS)
            + F.when(inside, by_name(INSIDE_WEIGHTS)).otherwise(0.0) - BESIDE_WEIGHT * F.col("beside")
            - LINK_WEIGHT * F.try_divide(F.col("linked"), F.col("size"))
            + F.when(around & (share > MOST_TEXT), MOST_WEIGHT).otherwise(F.least(share, F.lit(MOST_TEXT))))


def _texts(cols):
    out = []
    for html, remove, stay in zip(*cols, strict=True):
        low, stays = set(remove or ()), set(stay or ())
        page = read_page(html)
        removed: dict[str, bool] = {}
        kept = []

        def goes(path, page=page, low=low, stays=stays):
            if page.kinds.get(path, UNSAID) % INSIDE == STRONG:
                return not stays or digest(path) not in stays
            return bool(low) and digest(path) in low
        for path, text, _ in page.blocks:
            if path not in removed:
                removed[path] = any(goes(p) for p in above(path))
            if not removed[path]:
                kept.append(text)
        out.append("\n\n".join(kept))
    return [out]


def main_text(pages: DataFrame, url_col: str = "url", html_col: str = "html", text_col: str = "text") -> DataFrame:
    """``pages`` plus ``text_col``, the main text."""
    hosted = pages.withColumn("_host", host_of(F.col(url_col)))
    tree = importance(hosted, "_host", html_col).withColumn("goes", branch_score() < 0)
    # a strong name alone would remove its branch, so only those that stay are listed
    strong = F.col("kind") % INSIDE == STRONG
    judged = (tree.filter(strong != F.col("goes"))
                  .groupBy(F.col("host").alias("_host"))
                  .agg(F.collect_list(F.when(~strong, F.col("path"))).alias("_remove"),
                       F.collect_list(F.when(strong, F.col("path"))).alias("_stay")))
    joined = hosted.join(broadcast_if_fits(judged), "_host", "left")
    return add_by_arrow(joined, [html_col, "_remove", "_stay"], f"{text_col} string", _texts).drop(
        "_host", "_remove", "_stay")


def op2_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return main_text(pages).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
