"""Main text of web pages by wrapper induction.

Pages of one host share a template. Each distinct page of a host is aligned, by
simple tree matching (Yang 1991: the largest matching of two DOM trees that keeps
order and levels), with a reference page of the host and with one of its own layout.
Blocks of the reference that aligned pages repeat are constant and become the
template; the varying slots are content. What the page itself declares (article,
menus, forms, adverts and so on) bounds the slots, since menus and adverts vary too.

Each page is parsed once. Blocks that may be content travel on, html doesn't.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm._shared import bounded_batches, materialise

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q ruby rb rp rt s samp small span strike strong sub sup time tt u var wbr".split())
#: Subtrees that hold no article text whatever they say.
DROPPED = frozenset("head title script style noscript template nav footer aside form button select option textarea input iframe object svg canvas video audio menu dialog fieldset map math".split())
#: Words in class, id, role and the like that mark subtrees outside the article.
MARKS = re.compile(
    r"(?:^|[\s_-])(?:ad|ads|adv|advert|adverts|advertisement|advertising|sponsor|sponsored|promo|promotion|banner|nav|navbar|navigation|menu|breadcrumb|breadcrumbs|sidebar|aside|footer|masthead|topbar|toolbar"
    r"|cookie|cookies|consent|gdpr|notice|notices|popup|modal|overlay|newsletter|subscribe|subscription|signup|login|share|sharing|social|related|recommended|trending|comment|comments|commentlist|respond|disqus|discussion|replies|pagination|pager|complementary|contentinfo|search|widget)(?:$|[\s_-])"
)
HEADER_MARK = re.compile(r"(?:^|[\s_-])(?:header|site-header|page-header)(?:$|[\s_-])")
#: An open element of the left closes when one of the right begins.
_PARAGRAPH_ENDS = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
_CLOSES = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}


#: Cells of a table that a matching keeps at once; larger ones are halved until they fit.
TABLE = 1 << 20


def _hash(*parts: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(b"\0".join(parts), digest_size=8).digest(), "little", signed=True)


class _Tree(HTMLParser):
    """A lenient DOM: elements in page order, and the blocks of text with their elements."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.tags, self.parents, self.paths, self.depths = ["#root"], [-1], [b""], [0]
        self.dropped, self.in_article, self.in_main = [False], [False], [False]
        self.stack = [0]
        self.open: Counter[str] = Counter()
        self.run: list[str] = []
        self.blocks: list[tuple[int, str]] = []

    def flush(self):
        if self.run:
            text = " ".join("".join(self.run).split())
            self.run = []
            if text:
                at = next(i for i in reversed(self.stack) if self.tags[i] not in INLINE)
                self.blocks.append((at, text))

    def close_to(self, depth: int):
        self.open.subtract(self.tags[i] for i in self.stack[depth:])
        del self.stack[depth:]

    def close_implied(self, tag: str):
        """Close what an element of this tag ends without saying so."""
        if tag in _PARAGRAPH_ENDS and self.open["p"]:
            depth = len(self.stack) - 1
            while self.tags[self.stack[depth]] in INLINE:
                depth -= 1
            if self.tags[self.stack[depth]] == "p":
                self.close_to(depth)
        elif tag in _CLOSES:
            ends, scope = _CLOSES[tag]
            if any(self.open[e] for e in ends):
                for depth in range(len(self.stack) - 1, 0, -1):
                    name = self.tags[self.stack[depth]]
                    if name in ends:
                        self.close_to(depth)
                        if tag != "tr":
                            break
                    elif name in scope:
                        break

    def handle_starttag(self, tag, attrs):
        if tag == "br":
            self.run.append(" ")
            return
        if tag not in INLINE:
            self.flush()
            self.close_implied(tag)
        top = self.stack[-1]
        marks = " ".join(v for k, v in attrs if v and k in ("class", "id", "role", "aria-label", "itemtype")).lower()
        hidden = any(k == "hidden" or (k == "aria-hidden" and v == "true") or (k == "style" and v and re.search(r"display\s*:\s*none", v)) for k, v in attrs)
        article = self.in_article[top] or tag == "article"
        bad = tag in DROPPED or hidden or (tag not in ("html", "body", "article", "main") and bool(marks and MARKS.search(marks)))
        if not article and (tag == "header" or (tag not in ("html", "body", "main") and marks and HEADER_MARK.search(marks))):
            bad = True
        self.tags.append(tag)
        self.parents.append(top)
        self.depths.append(self.depths[top] + 1)
        self.paths.append(hashlib.blake2b(self.paths[top] + tag.encode(), digest_size=8).digest())
        self.dropped.append(self.dropped[top] or bad)
        self.in_article.append(article)
        self.in_main.append(self.in_main[top] or tag == "main" or dict(attrs).get("role") == "main")
        if tag not in VOID:
            self.stack.append(len(self.tags) - 1)
            self.open[tag] += 1

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID and self.stack[-1] == len(self.tags) - 1 and tag in ("svg", "path"):
            self.close_to(len(self.stack) - 1)

    def handle_endtag(self, tag):
        if tag not in INLINE:
            self.flush()
        if not self.open[tag]:
            return
        for depth in range(len(self.stack) - 1, 0, -1):
            if self.tags[self.stack[depth]] == tag:
                self.close_to(depth)
                break
            if tag in INLINE and self.tags[self.stack[depth]] not in INLINE:
                break

    def handle_data(self, data):
        if self.tags[self.stack[-1]] not in ("script", "style"):
            self.run.append(data)

    def fingerprint(self, at: int, text: str) -> int:
        """Of a block's place and text."""
        return _hash(self.paths[at], text.encode())


def parse(html: str) -> _Tree:
    tree = _Tree()
    tree.feed(html)
    tree.close()
    tree.flush()
    return tree


def skeleton(tree: _Tree) -> tuple[list[int], list[int], list[int], list[int]]:
    """Parents and tag codes of the tree's block elements, and the blocks' elements and fingerprints, in page order."""
    place, parents, tags = {0: 0}, [-1], [0]
    own = [0] * len(tree.tags)  # the block element that each element stands in
    for i in range(1, len(tree.tags)):
        own[i] = own[tree.parents[i]]
        if tree.tags[i] not in INLINE:
            place[i] = len(parents)
            parents.append(own[i])
            tags.append(_hash(tree.tags[i].encode()) & 0x7FFFFFFF)
            own[i] = place[i]
    return parents, tags, [place[at] for at, _ in tree.blocks], [tree.fingerprint(at, block) for at, block in tree.blocks]


def layout(tree: _Tree, levels: int = 4) -> int:
    """Of the paths of the block elements in a page's upper levels, however often each occurs."""
    return _hash(*sorted({p for p, d, t in zip(tree.paths, tree.depths, tree.tags, strict=True) if d <= levels and t not in INLINE}))


class _Shapes:
    """Subtrees by shape: equal ones (tags and order) are one number, in both trees alike."""

    def __init__(self):
        self.known: dict[tuple, int] = {}
        self.tag: list[int] = []
        self.kids: list[tuple[int, ...]] = []
        self.size: list[int] = []

    def of(self, parents: list[int], tags: list[int]) -> tuple[list[int], list[list[int]]]:
        """Each node's shape and children; parents come before their children."""
        children: list[list[int]] = [[] for _ in parents]
        for i, p in enumerate(parents):
            if p >= 0:
                children[p].append(i)
        shape = [0] * len(parents)
        for i in range(len(parents) - 1, -1, -1):
            key = (tags[i], tuple(shape[c] for c in children[i]))
            if key not in self.known:
                self.known[key] = len(self.tag)
                self.tag.append(key[0])
                self.kids.append(key[1])
                self.size.append(1 + sum(self.size[c] for c in key[1]))
            shape[i] = self.known[key]
        return shape, children


def _trim(a, b) -> tuple[int, int]:
    """How many equal items two lists begin and end with. Matching those is always best."""
    n, head, tail = min(len(a), len(b)), 0, 0
    while head < n and a[head] == b[head]:
        head += 1
    while tail < n - head and a[-1 - tail] == b[-1 - tail]:
        tail += 1
    return head, tail


class _Matching:
    """Weights of the best matchings of shapes, each computed once."""

    def __init__(self, shapes: _Shapes):
        self.s, self.known = shapes, {}

    def settled(self, a: int, b: int) -> float | None:
        s = self.s
        if s.tag[a] != s.tag[b]:
            return 0.0
        if a == b:
            return float(s.size[a])
        if not s.kids[a] or not s.kids[b]:
            return 1.0
        return self.known.get((a, b))

    def middle(self, a: int, b: int):
        ka, kb = self.s.kids[a], self.s.kids[b]
        head, tail = _trim(ka, kb)
        return ka[head : len(ka) - tail], kb[head : len(kb) - tail], sum(self.s.size[x] for x in (*ka[:head], *ka[len(ka) - tail :]))

    def weigh(self, a: int, b: int) -> None:
        """Fill in the weight of two shapes and all that it depends on, deepest first, without recursion."""
        todo = [(a, b)]
        while todo:
            a, b = todo[-1]
            if self.settled(a, b) is not None:
                todo.pop()
                continue
            ka, kb, equal = self.middle(a, b)
            other = dict.fromkeys(kb)
            lack = [(x, y) for x in dict.fromkeys(ka) for y in other if self.settled(x, y) is None]
            if lack:
                todo += lack
                continue
            self.known[a, b] = 1.0 + equal + (self.rows(ka, kb)[-1] if ka and kb else 0.0)
            todo.pop()

    def row(self, x: int, kb) -> np.ndarray:
        weight = {y: self.settled(x, y) for y in dict.fromkeys(kb)}
        return np.array([weight[y] for y in kb])

    def rows(self, ka, kb, table: bool = False):
        """The best weight of ka with each head of kb; with table, of each head of ka too."""
        now, kept, cache = np.zeros(len(kb) + 1), [], {}
        for x in ka:
            if table:
                kept.append(now)
            if x not in cache:
                if len(cache) * len(kb) > TABLE:
                    cache.clear()
                cache[x] = self.row(x, kb)
            best = np.maximum(now[1:], now[:-1] + cache[x])
            now = np.concatenate([now[:1], np.maximum.accumulate(best)])
        return np.stack([*kept, now]) if table else now

    def pairs(self, ka, kb) -> list[tuple[int, int]]:
        """Indices of matched items of two lists of shapes, in memory bounded by TABLE and the lists' length."""
        out, todo = [], [(0, len(ka), 0, len(kb))]
        while todo:
            a0, a1, b0, b1 = todo.pop()
            head, tail = _trim(ka[a0:a1], kb[b0:b1])
            out += [(a0 + k, b0 + k) for k in range(head)] + [(a1 - 1 - k, b1 - 1 - k) for k in range(tail)]
            a0, a1, b0, b1 = a0 + head, a1 - tail, b0 + head, b1 - tail
            if a0 == a1 or b0 == b1:
                continue
            if (a1 - a0 + 1) * (b1 - b0 + 1) > TABLE and a1 - a0 > 1:  # halve one list, and cut the other where both halves do best (Hirschberg 1975)
                mid = (a0 + a1) // 2
                left, right = self.rows(ka[a0:mid], kb[b0:b1]), self.rows(ka[mid:a1][::-1], kb[b0:b1][::-1])[::-1]
                cut = b0 + int((left + right).argmax())
                todo += [(a0, mid, b0, cut), (mid, a1, cut, b1)]
                continue
            m, x, y = self.rows(ka[a0:a1], kb[b0:b1], table=True), a1 - a0, b1 - b0
            while x and y:
                if m[x, y] == m[x - 1, y]:
                    x -= 1
                elif m[x, y] == m[x, y - 1]:
                    y -= 1
                else:
                    x, y = x - 1, y - 1
                    out.append((a0 + x, b0 + y))
        return out


def simple_tree_matching(a: tuple[list[int], list[int]], b: tuple[list[int], list[int]]) -> list[tuple[int, int]]:
    """Aligned nodes of two trees given by parents and tags: a largest matching that keeps order and levels."""
    shapes = _Shapes()
    (sa, kids_a), (sb, kids_b) = shapes.of(*a), shapes.of(*b)
    matching = _Matching(shapes)
    if shapes.tag[sa[0]] != shapes.tag[sb[0]]:
        return []
    pairs, todo = [], [(0, 0)]
    while todo:
        i, j = todo.pop()
        pairs.append((i, j))
        if not kids_a[i] or not kids_b[j]:
            continue
        ka, kb = tuple(sa[c] for c in kids_a[i]), tuple(sb[c] for c in kids_b[j])
        matching.weigh(sa[i], sb[j])
        todo += [(kids_a[i][x], kids_b[j][y]) for x, y in matching.pairs(ka, kb)]
    return pairs


def candidates(tree: _Tree) -> list[int]:
    """Numbers of the blocks that may be content: of the article, else of main, else of the page, that aren't marked off."""
    live = [k for k, (at, _) in enumerate(tree.blocks) if not tree.dropped[at]]
    for inside in (tree.in_article, tree.in_main):
        if any(inside[tree.blocks[k][0]] for k in live):
            return [k for k in live if inside[tree.blocks[k][0]]]
    return live


def constant_blocks(reference: tuple[list[int], ...], page: tuple[list[int], ...]) -> list[int]:
    """Blocks of the reference that the page has in the aligned node; both as skeleton() gives them."""
    if not set(reference[3]) & set(page[3]):
        return []  # whatever is aligned with what, no block is constant
    held: list[dict[int, set[int]]] = [{}, {}]
    for own, (_, _, at, prints) in zip(held, (reference, page), strict=True):
        for a, x in zip(at, prints, strict=True):
            own.setdefault(a, set()).add(x)
    return sorted({x for i, j in simple_tree_matching(reference[:2], page[:2]) if i in held[0] and j in held[1] for x in held[0][i] & held[1][j]})


_BONES = ("parents", "tags", "places", "prints")
_PARSED = "host string, layout long, parents array<int>, tags array<int>, places array<int>, prints array<bigint>, live array<int>, blocks array<string>"


def extract_main_text(pages: DataFrame, least_pages: int = 3, constant_share: float = 0.6, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row a page: page_id, url, text, n_chars.

    A block is template when the aligned node has the same text on constant_share of
    a host's distinct pages, or of those of one layout (for that layout's pages), and
    on least_pages of them: fewer can't tell a template from a copied text. Copies of
    a page count once.

    A null or empty html has an empty text. Pages with a null url, or one without a
    host, are a host of their own. Ids may be null or repeat: each row is a page. Of
    references that tie the smallest digest is taken, of equally large matchings one
    by a fixed rule. A page is held whole by one task, with about 20 times its size,
    whatever its depth or width. An empty table gives an empty result; other columns,
    whatever their names, are ignored.
    """
    read = bounded_batches(pages).select(F.col(id_col).alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    host = F.lower(F.coalesce(F.regexp_extract("url", r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)", 1), F.lit("")))
    kind = dict(read.dtypes)["page_id"]

    def parsed(batches):
        for batch in batches:
            for start in range(0, batch.num_rows, 100):
                part, cols = batch.slice(start, 100), [[] for _ in range(7)]
                for html in part.column("html").to_pylist():
                    tree = parse(html or "")
                    live = candidates(tree)
                    for c, v in zip(cols, (layout(tree), *skeleton(tree), live, [tree.blocks[k][1] for k in live]), strict=True):
                        c.append(v)
                ints, longs = pa.list_(pa.int32()), pa.list_(pa.int64())
                kinds = [pa.int64(), ints, ints, ints, longs, ints, pa.list_(pa.string())]
                yield pa.RecordBatch.from_arrays([part.column("page_id"), part.column("url"), part.column("host"), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], names=["page_id", "url", "host", "layout", *_BONES, "live", "blocks"])

    seen = materialise(read.withColumn("host", host).mapInArrow(parsed, f"page_id {kind}, url string, {_PARSED}"))
    # Copies of a page, of which there may be very many, are one. Hosts deal their pages out by their own digest.
    own = materialise(seen.select("host", "layout", *_BONES, F.xxhash64(*_BONES).alias("digest")).dropDuplicates(["host", "digest"]))
    # Scope 0 is a host's pages; where a host has several layouts, each is a scope too.
    several = own.groupBy("host", "layout").agg(F.lit(1).alias("one")).groupBy("host").agg(F.count("one").alias("layouts")).filter("layouts > 1").select("host")
    scoped = own.withColumn("scope", F.lit(0).cast("long")).unionByName(own.join(several, "host", "left_semi").withColumn("scope", F.col("layout"))).drop("layout")
    counted = scoped.groupBy("host", "scope").agg(F.count(F.lit(1)).alias("n_pages"), F.min("digest").alias("digest")).filter(F.col("n_pages") >= least_pages)
    model = counted.join(scoped, ["host", "scope", "digest"]).select("host", "scope", "n_pages", *(F.col(c).alias(f"r_{c}") for c in _BONES))

    def align(batches):
        for batch in batches:
            same = [constant_blocks(x[:4], x[4:]) for x in zip(*(batch.column(c).to_pylist() for c in (*(f"r_{c}" for c in _BONES), *_BONES)), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("host"), batch.column("scope"), batch.column("n_pages"), pa.array(same, pa.list_(pa.int64()))], names=["host", "scope", "n_pages", "same"])

    agreed = scoped.join(model, ["host", "scope"]).mapInArrow(align, "host string, scope long, n_pages long, same array<bigint>")
    votes = agreed.select("host", "scope", "n_pages", F.explode("same").alias("block")).groupBy("host", "scope", "n_pages", "block").count()
    constant = votes.filter((F.col("count") >= least_pages) & (F.col("count") >= constant_share * F.col("n_pages"))).groupBy("host", "scope").agg(F.sort_array(F.collect_set("block")).alias("template"))
    wrapper = materialise(constant.groupBy("host").agg(F.sort_array(F.collect_list(F.struct("scope", "template"))).alias("wrapper")))

    # The wrapper of a host is a bounded row (its reference's blocks), and pages without any stay where they are.
    kept = F.filter(F.arrays_zip("live", "blocks"), lambda b: ~F.array_contains(F.coalesce("template", F.array().cast("array<bigint>")), F.get("prints", b["live"])))
    text = F.concat_ws("\n", F.transform(kept, lambda b: b["blocks"]))
    mine = F.flatten(F.transform(F.filter("wrapper", lambda w: (w["scope"] == 0) | (w["scope"] == F.col("layout"))), lambda w: w["template"]))
    out = seen.select("page_id", "url", "host", "layout", "prints", "live", "blocks").join(wrapper, "host", "left").withColumn("template", mine).withColumn("text", text)
    return out.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))
