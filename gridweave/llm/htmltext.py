"""Main text of web pages by equivalence classes of template tokens.

A page is a sequence of tokens: its container elements and its text blocks. An
element's token says where it stands: the elements around it, its own name, what
it begins with, and which of its kind it is in its parent; a text block's token is
its text in its element. Over the pages of a host, a token's occurrence vector says how
often it occurs on which page; tokens of equal vectors form a class (an element counts
twice, for its two tags). Vectors are compared by page count, total and an
order-free hash, so that a host's pages never meet in one task. A class is valid if
it has two tokens or more that occur equally often on each page they are on; it nests
in the root class (the tokens on every page) if it covers at least half of the
pages. Valid classes make up the template: text blocks in it are the site's own
words, the places between its elements are the slots, one for each element and what
is in it but in no smaller element of the template.

What fills a slot over all pages of the host tells what it is for. The slot with the
most text outside links is the article's; if there are more of its kind beside it, all of
their parent is. Slots of more linked than other text are menus, and slots apart from the
article with less than an eighth of its text are adverts, notices and the
like. A page without others of its host is judged by its own slots.

Names are hints beside this. What ``article`` and ``main`` hold counts twice and is no such box. Slots inside
menus, headers, footers, sidebars, notices, adverts, forms and comments, which
are told by element, role, or the words of class and id, are never the article; but
words alone drop neither what holds most of a page
that has no text in an article outside it, nor all that is left. The elements are kept alone if the largest of them
outweighs every slot outside, the slots outside alone if one of these outweighs all
elements together (which are teasers then), and else both. Template text goes
everywhere, inside those elements too; a page that would lose all its text keeps
it, as its host's pages are then copies of each other. Elements with nothing but
template text are such copies, or a teaser on every page: they stay, without the
hint's weight, if they hold more text than any slot outside.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterable
from dataclasses import dataclass, field
from itertools import count
from urllib.parse import urlsplit

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridweave.llm.common import batches_of, mix64, stored

# Elements by their part in a page, and words that name what is not the article.
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track".split())
BREAKS = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd td th tr caption figcaption".split())
RAW = frozenset("script style noscript template textarea title svg math iframe object select option button canvas audio video head".split())
DROPPED = frozenset("nav header footer aside form menu dialog".split())
ARTICLE = frozenset("article main".split())
HINT = 2
# A slot apart from the article's is a box if it holds less than one part in so many of its text.
LEAST = 8
ROOTS = frozenset("html body".split())
DROPPED_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar".split())
COMMENT_WORDS = frozenset("comment comments reply replies disqus discussion".split())
DROPPED_WORDS = COMMENT_WORDS | frozenset(
    "nav navbar navigation menu breadcrumb breadcrumbs header masthead footer sidebar aside ad ads advert adverts advertisement advertising sponsor sponsored promo promotion "
    "banner cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup login share sharing social related recommended widget pagination pager".split()
)

_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/<>]*)((?:[^<>\"']++|\"[^\"<]*+\"|'[^'<]*+'|[\"'])*+)>")
_ATTRIBUTE = re.compile(r"(class|id|role|hidden|aria-hidden)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
# First words of names that say what an element has or lacks, and words of those whose header is the headline.
HAVING = frozenset("has have no not non without with is show hide".split())
HEADED = frozenset("article post entry story content".split())

_WORDS = re.compile(r"[a-z0-9]+")
_SPACE = re.compile(r"\s+")


def _names_part(name: str) -> bool:
    """Whether a single class or id names a part that is not the article."""
    words = _WORDS.findall(name)
    parts = DROPPED_WORDS.intersection(words)
    return bool(parts) and words[0] not in HAVING and not (parts == {"header"} and HEADED.intersection(words))


def _marks(name: str, attributes: str) -> tuple[str, bool, bool, bool]:
    """What qualifies an element, whether it is dropped, whether for holding comments, and whether its names alone drop it."""
    label, words, dropped, named = [], set(), name in DROPPED, False
    if attributes:
        for m in _ATTRIBUTE.finditer(attributes):
            key, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
            if key == "role":
                dropped |= value in DROPPED_ROLES
            elif key == "hidden" or key == "aria-hidden" and value == "true":
                dropped = True
            elif key in ("class", "id"):
                label.append(value)
                words.update(value.split())
    parts = {w for w in words if _names_part(w)} if name not in ROOTS else set()
    comments = any(COMMENT_WORDS.intersection(_WORDS.findall(w)) for w in parts)
    named = bool(parts) and name not in ARTICLE and not comments and not dropped
    return ".".join([name, *label]), dropped or comments, comments, named


@dataclass
class Outline:
    """A page's container elements in page order (the first is the page), and its text blocks."""

    token: list[int] = field(default_factory=lambda: [0])
    parent: list[int] = field(default_factory=lambda: [0])
    kind: list[int] = field(default_factory=lambda: [0])
    #: (element, text, 0 plain / 1 in an article / 2 dropped, number of the outermost article, characters in links)
    blocks: list[tuple[int, str, int, int, int]] = field(default_factory=list)

    def text_token(self, block: tuple) -> int:
        return xxhash.xxh64_intdigest(block[1], self.token[block[0]])

    def sums(self) -> tuple[list[int], list[int]]:
        """Of every element: characters outside and inside links of all kept text in it; what articles hold counts ``HINT`` times and as no link."""
        free, linked = [0] * len(self.token), [0] * len(self.token)
        for block in self.blocks:
            if block[2] < 2:
                f, k = _weight(block)
                free[block[0]] += f
                linked[block[0]] += k
        for i in range(len(free) - 1, 0, -1):
            free[self.parent[i]] += free[i]
            linked[self.parent[i]] += linked[i]
        return free, linked


def _weight(block: tuple) -> tuple[int, int]:
    return (HINT * len(block[1]), 0) if block[3] else (len(block[1]) - block[4], block[4])


def parse(page: str | None) -> Outline:
    page = page or ""
    out = Outline()
    labels, begins = [""], [None]
    articles, numbers = 0, count()
    named: list[tuple[int, ...]] = []
    stack: list[tuple[str, int, int, int, tuple[int, ...]]] = [("", 0, 0, 0, ())]  # name, element, state, article, elements dropped by name
    text: list[str] = []
    link, linked = False, 0

    def flush():
        nonlocal linked
        if text:
            raw = "".join(text)
            joined = _SPACE.sub(" ", html.unescape(raw)).strip()
            if joined:
                _, at, state, article, names = stack[-1]
                begins[at] = begins[at] or "text"
                out.blocks.append((at, joined, min(state, 2), article, len(joined) * linked // len(raw)))
                named.append(names)
            text.clear()
            linked = 0

    def add(piece: str) -> None:
        nonlocal linked
        text.append(piece)
        linked += len(piece) * link

    at, end = 0, len(page)
    while at < end:
        lt = page.find("<", at)
        if lt < 0:
            add(page[at:])
            break
        if lt > at:
            add(page[at:lt])
        if page.startswith("<!--", lt):
            stop = page.find("-->", lt + 4)
            at = stop + 3 if stop >= 0 else end
            continue
        if page[lt + 1 : lt + 2] in ("!", "?"):
            stop = page.find(">", lt)
            at = stop + 1 if stop >= 0 else end
            continue
        m = _TAG.match(page, lt)
        if not m:
            text.append("<")
            at = lt + 1
            continue
        at, closing, name = m.end(), m[1], m[2].lower()
        if name in RAW:
            flush()
            if not closing:
                stop = re.compile(rf"</{re.escape(name)}\s*>", re.I).search(page, at)
                # A head that is not closed ends where the body begins.
                stop = stop or (name == "head" and re.compile(r"(?=<body)", re.I).search(page, at)) or None
                at = stop.end() if stop else end
            continue
        if name == "a":
            link = not closing
        label, dropped, comments, by_name = _marks(name, m[3]) if not closing and (m[3] or name in DROPPED) else (name, False, False, False)
        if name in INLINE and not dropped and not by_name:
            if not (closing and any(s[0] == name for s in stack[1:])):
                continue
        flush()
        if name in VOID:
            continue
        if closing:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k][0] == name:
                    del stack[k:]
                    break
                if stack[k][0] in ROOTS or (stack[k][0] not in BREAKS and name in BREAKS):
                    break
            continue
        if stack[-1][0] == "p" and name not in INLINE:
            stack.pop()
        _, outer, state, article, names = stack[-1]
        begins[outer] = begins[outer] or name
        if name in BREAKS and not dropped and not by_name:
            continue
        link = link and name in INLINE
        if by_name:
            names = (*names, next(numbers))
        if dropped:
            state = 3 if comments or state == 3 else 2
        elif name in ARTICLE and state != 3:
            state, names = 1, ()
            if not article:
                article = articles = articles + 1
        labels.append(label)
        begins.append(None)
        out.parent.append(outer)
        stack.append((name, len(labels) - 1, state, article, names))
    flush()
    out.blocks = _without_named(out.blocks, named)
    seen: Counter = Counter()
    for i in range(1, len(labels)):
        around = out.token[out.parent[i]]
        kind = xxhash.xxh64_intdigest(f"{labels[i]} {begins[i]}", around)
        out.kind.append(kind)
        out.token.append(xxhash.xxh64_intdigest(seen[kind].to_bytes(8, "little"), kind))
        seen[kind] += 1
    return out


def _without_named(blocks: list[tuple], named: list[tuple[int, ...]]) -> list[tuple]:
    """Blocks with those of elements dropped by name as dropped, unless that takes most of the page's text or all of it."""
    if not any(named):
        return blocks
    held: Counter = Counter()
    total = 0
    for (_, text, state, _, _), names in zip(blocks, named):
        if state < 2:
            total += len(text)
            held.update(dict.fromkeys(names, len(text)))
    article = any(state == 1 and not names for (_, _, state, _, _), names in zip(blocks, named))
    gone = [state < 2 and any(article or 2 * held[n] <= total for n in names) for (_, _, state, _, _), names in zip(blocks, named)]
    if all(g or b[2] == 2 for g, b in zip(gone, blocks)):
        return blocks
    return [(at, t, 2, a, k) if g else (at, t, state, a, k) for g, (at, t, state, a, k) in zip(gone, blocks)]


def host_of(url: str | None) -> str | None:
    try:
        return urlsplit(url).netloc.lower() or None if url else None
    except ValueError:
        return None


def boxes_of(items: Iterable[tuple[int, int, int, int, int, int]]) -> set[int]:
    """Tokens of the slots that are not the article's, from (token, parent, kind, pages, free, linked) of a template's elements.

    free and linked are characters outside and inside links in the whole element,
    over all pages; the page itself has token 0.
    """
    found = {item[0]: item[1:] for item in items}
    found = {t: (x[0] if x[0] in found else 0, *x[1:]) for t, x in found.items()}
    own = {t: [free, linked] for t, (_, _, _, free, linked) in found.items()}
    kin: Counter = Counter()
    for t, (parent, kind, _, free, linked) in found.items():
        if t and parent in own:
            own[parent][0] -= free
            own[parent][1] -= linked
            kin[kind] += free > 0
    if not own:
        return set()
    main = max(own, key=lambda t: (own[t][0], t))
    region = main
    while region and kin[found[region][1]] > 1:
        region = found[region][0]
    above, t = set(), region
    while t:
        t = found[t][0]
        above.add(t)
    inside = {region: True}

    def within(t: int) -> bool:
        way = []
        while t not in inside and t:
            way.append(t)
            t = found[t][0]
        inside.update(dict.fromkeys(way, answer := inside.get(t, False)))
        return answer

    enough = own[main][0] / (found[main][2] * LEAST)
    return {t for t, (free, linked) in own.items() if linked > free or not (t in above or within(t)) and free < enough * found[t][2]}


def _vectors(it):
    """Tokens of the pages handed to a task, counted by host."""
    for batch in batches_of(it, "html", 8 << 20):
        seen: dict = {}
        keys = mix64(batch.column("page").to_numpy().view(np.uint64)).tolist()
        for key, url, page in zip(keys, batch.column("url").to_pylist(), batch.column("html").to_pylist()):
            host = host_of(url)
            if host is None:
                continue
            out = parse(page)
            free, linked = out.sums()
            tokens: dict[int, list] = {}
            for i, token in enumerate(out.token):
                tokens[token] = [1, out.token[out.parent[i]], out.kind[i], free[i], linked[i], True]
            for block in out.blocks:
                f, k = _weight(block) if block[2] < 2 else (0, 0)
                found = tokens.setdefault(out.text_token(block), [0, out.token[block[0]], 0, 0, 0, False])
                found[0] += 1
                found[3] += f
                found[4] += k
            for token, (n, around, kind, f, k, element) in tokens.items():
                mark = xxhash.xxh64_intdigest(n.to_bytes(8, "little"), key)
                old = seen.get((host, token))
                seen[host, token] = (around, kind, element, 1, n, mark, f, k) if old is None else (*old[:3], old[3] + 1, old[4] + n, old[5] ^ mark, old[6] + f, old[7] + k)
        if seen:
            number = lambda x: pa.array(np.array(list(x), np.uint64).view(np.int64))
            v = list(zip(*seen.values()))
            plain = [pa.array(v[i], pa.int64()) for i in (3, 4)] + [number(v[5])] + [pa.array(v[i], pa.int64()) for i in (6, 7)]
            yield pa.RecordBatch.from_arrays([pa.array([h for h, _ in seen]), number(t for _, t in seen), number(v[0]), number(v[1]), pa.array(v[2]), *plain], names=_VECTOR)


_VECTOR = ["host", "token", "around", "kind", "element", "pages", "total", "vector", "free", "linked"]


def template_tokens(pages: DataFrame) -> DataFrame:
    """(host, token, around, kind, element, pages, free, linked) of all tokens in valid classes that nest in their host's root class.

    Token 0 stands for the page itself, so its vector is that of the root class. A
    host of one page shares nothing with others and has no rows.
    """
    read = pages.where("html is not null and url is not null").select("url", "html", F.xxhash64("page_id").alias("page"))
    each = read.mapInArrow(_vectors, "host string, token long, around long, kind long, element boolean, pages long, total long, vector long, free long, linked long")
    sums = [F.sum(c).alias(c) for c in ("pages", "total")] + [F.expr("bit_xor(vector)").alias("vector")] + [F.sum(c).alias(c) for c in ("free", "linked")]
    each = each.groupBy("host", "token").agg(*[F.max(c).alias(c) for c in ("around", "kind", "element")], *sums)
    # What is on one page alone is in no template.
    each = stored(each.where("pages > 1"), "vectors")
    # A host's rows are dealt by token too, as one host may have a third of all pages.
    salts = 32
    hosts = each.where("token = 0").select("host", F.col("pages").alias("n"), F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"))
    likely = each.withColumn("salt", F.pmod("token", F.lit(salts)).cast("int")).join(hosts, ["host", "salt"]).where("2 * pages >= n and total % pages = 0")
    likely = stored(likely.drop("salt", "n"), "likely")
    classes = likely.groupBy("host", "pages", "total", "vector").agg(F.sum(F.when(F.col("element"), 2).otherwise(1)).alias("size")).where("size >= 2")
    return likely.join(classes, ["host", "pages", "total", "vector"]).drop("total", "vector", "size")


def templates(pages: DataFrame) -> DataFrame:
    """(host, tokens, boxes): the template's elements and texts, and those elements whose slots are boxes, of hosts with two pages or more."""

    def decide(lists: pd.Series) -> pd.Series:
        out = []
        for rows in lists:
            element = {r["token"]: [r["around"], r["kind"], r["pages"], r["free"], r["linked"]] for r in rows if r["element"]}
            for r in rows:
                # The site's own words fill no slot.
                t = r["around"]
                while not r["element"] and t in element:
                    element[t][3] -= r["free"]
                    element[t][4] -= r["linked"]
                    t = element[t][0] if t else None
            out.append(sorted(boxes_of((t, *x) for t, x in element.items())))
        return pd.Series(out)

    # On half of the pages at least: a host's rows are no more than twice the tokens of a page.
    rows = template_tokens(pages).groupBy("host").agg(F.collect_list(F.struct("token", "around", "kind", "element", "pages", "free", "linked")).alias("rows"))
    return rows.select("host", F.col("rows.token").alias("tokens"), F.pandas_udf(decide, "array<long>")("rows").alias("boxes"))


def main_text(page: str | None, template: frozenset[int] | None = None, boxes: frozenset[int] | set[int] = frozenset()) -> str:
    """The article's text, given the tokens of the host's template and its boxes; without a template the page's own slots tell."""
    out = parse(page)
    if template is None:
        template = frozenset(out.token)
        boxes = boxes_of((t, out.token[p], k, 1, f, n) for t, p, k, f, n in zip(out.token, out.parent, out.kind, *out.sums()))
    blocks = [b for b in out.blocks if b[2] < 2]
    slot = [0] * len(out.token)
    for i in range(1, len(slot)):
        slot[i] = i if out.token[i] in template else slot[out.parent[i]]
    boxed = [not b[3] and out.token[slot[b[0]]] in boxes for b in blocks]
    own = [out.text_token(b) in template for b in blocks]
    if not all(o or x for o, x in zip(own, boxed)):
        own = [o or x for o, x in zip(own, boxed)]
    if all(own):
        own = [False] * len(blocks)
    hint = HINT
    if all(o for o, b in zip(own, blocks) if b[3]):
        own, hint = [o and not b[3] for o, b in zip(own, blocks)], 1
    inside: Counter = Counter()
    outside: Counter = Counter()
    for o, (at, text, _, article, _) in zip(own, blocks):
        if not o and article:
            inside[article] += hint * len(text)
        elif not o:
            outside[slot[at]] += len(text)
    most = max(outside.values(), default=0)
    keep = (most > max(inside.values(), default=0), most <= inside.total())
    return " ".join(b[1] for o, b in zip(own, blocks) if not o and keep[b[3] > 0])


def extract(pages: DataFrame, broadcast_tokens: int = 1_000_000) -> DataFrame:
    """``pages`` (page_id, url, html) without html, with text and n_chars (replaced if there).

    Null and empty html give an empty text; pages of a null or odd url, and those
    alone on their host, are judged by themselves. Templates of up to ``broadcast_tokens`` tokens
    in all (8 MB) are broadcast, more are joined by a shuffle; the result is the
    same. Any other columns stay, whatever their names.
    """
    spark = pages.sparkSession
    found = stored(templates(pages), "templates")
    tokens = found.agg(F.sum(F.size("tokens") + F.size("boxes") + 8)).first()[0] or 0
    unsigned = lambda t: frozenset(np.asarray(t, np.int64).view(np.uint64).tolist())
    keep = [c for c in pages.columns if c not in ("html", "text", "n_chars")]
    rest = F.struct(*[F.col(f"`{c}`") for c in keep])
    rows = pages.select(rest.alias("rest"), F.col("url").alias("url"), F.col("html").alias("html"))
    if tokens <= broadcast_tokens:
        table = {r.host: (unsigned(r.tokens), unsigned(r.boxes)) for r in found.toLocalIterator()}
        told = spark.sparkContext.broadcast(table)

        def run(urls: pd.Series, texts: pd.Series) -> pd.Series:
            return pd.Series([main_text(x, *told.value.get(host_of(u), ())) for u, x in zip(urls, texts)], index=texts.index, dtype=object)

        rows = rows.withColumn("text", F.pandas_udf(run, "string")("url", "html"))
    else:

        def hosts(urls: pd.Series) -> pd.Series:
            return urls.map(host_of)

        def run_joined(texts: pd.Series, tokens: pd.Series, boxes: pd.Series) -> pd.Series:
            return pd.Series([main_text(x, *((unsigned(t), unsigned(b)) if t is not None else ())) for x, t, b in zip(texts, tokens, boxes)], index=texts.index, dtype=object)

        rows = rows.withColumn("host", F.pandas_udf(hosts, "string")("url")).join(found, "host", "left")
        rows = rows.withColumn("text", F.pandas_udf(run_joined, "string")("html", "tokens", "boxes"))
    return rows.select("rest.*", "text", F.length("text").cast("long").alias("n_chars"))
