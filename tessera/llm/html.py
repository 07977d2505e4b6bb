"""HTML extraction by wrappers inferred from pages of one host.

A page is read as a stream of tags and texts; inline markup is dropped. The streams of a host are aligned one
after another into a wrapper, a union-free regular expression kept as a tree: each node is a tag, matched in order
with the next page's, and what matches nothing becomes optional; equal neighbours become a repeated group;
a text that differs between pages becomes a slot. Alignment is associative enough to be done by
partition first and between partitions afterwards, so every page takes part and no host meets in one task.

The wrapper says where a host's main text is: of the parts that are not menus, headers, footers,
sidebars, notices, adverts, forms or reader comments (by tag, class or id), the smallest container with all texts
that vary or that only some pages have; an article is not descended into. It also says which texts inside are the template's own: the same at the same
place on all pages of the host, if at least AGREE of these differ from each other; none in an article or a main
element. Each page's blocks in that container are the result.

Nulls: a null html has empty text; a null url belongs to the host "". Rows that repeat come out each. Pages
without the host's container fall back to all of their blocks that are not in excluded parts. Empty tables give no
rows.
"""

from __future__ import annotations

import hashlib
import html as entities
import json
import re
from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import checkpointed, join_lookup, table

#: Tags that begin and end a block of text.
BLOCKS = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html iframe legend li main menu nav "
    "noscript object ol optgroup option p pre search section select summary table tbody td template textarea tfoot th thead tr ul".split()
)
#: Containers in which the main text may lie.
CONTAINERS = frozenset("html body main article section div table tbody tr td center".split())
#: Tags without content, and those whose content is not markup.
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe template xmp noembed noframes".split())
#: Tags that an opening tag ends.
ENDS = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
#: Parts that are never main text, by tag, and by a word of a class, an id or a role.
EXCLUDED_TAGS = frozenset("nav footer aside form head script style noscript template button select menu dialog iframe svg search textarea title".split())
EXCLUDED_WORDS = frozenset(
    "ad ads adv advert advertisement adverts alert banner breadcrumb breadcrumbs comment comments consent cookie cookies disqus footer form header login masthead menu menubar modal nav navbar navigation newsletter "
    "notice notices pager pagination popup promo promoted related reply replies respond search share sharing sidebar signup social sponsor sponsored subscribe toolbar widget".split()
)
#: Pages, different from each other, that must agree on a text before it counts as the template's.
AGREE = 8
#: Nesting beyond which parts are kept at one level, and hosts that a task holds at once.
DEPTH, HOSTS = 60, 2000

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)", re.S
)
_NAMES = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_WORD = re.compile(r"[a-z]+")


def _key(tag: str, attributes: str) -> tuple[str, bool]:
    """The tag with its class and id, digits dropped, and whether it is excluded."""
    names = " ".join(a or b or c for a, b, c in _NAMES.findall(attributes)) if attributes else ""
    words = _WORD.findall(names.lower())
    excluded = tag in EXCLUDED_TAGS or (tag not in ("html", "body", "main", "article") and not EXCLUDED_WORDS.isdisjoint(words))
    return f"{tag}.{'.'.join(words)}" if words else tag, excluded


def blocks(page: str) -> Iterator[tuple[tuple[str, ...], bool, str]]:
    """(path of keys, excluded, text) of each block of text, in order; white space is one space."""
    stack: list[tuple[str, str, bool]] = []  # tag, key, excluded
    parts: list[str] = []

    def flush():
        text = " ".join(entities.unescape("".join(parts)).split())
        parts.clear()
        if text:
            yield tuple(k for _, k, _ in stack[:DEPTH]), bool(stack) and stack[-1][2], text

    at, n = 0, len(page)
    while at < n:
        found = _TOKEN.search(page, at)
        parts.append(page[at : found.start() if found else n])
        if not found:
            break
        at = found.end()
        close, tag, attributes = (found[1], found[2], found[3]) if found[2] else (found[4], found[5], found[6])
        if not tag:
            continue
        tag = tag.lower()
        if tag in RAW and not close:
            end = re.compile(rf"</{tag}\s*>?", re.I).search(page, at)
            at = end.end() if end else n
            continue
        if tag == "br":
            parts.append(" ")
        if tag not in BLOCKS:
            continue
        yield from flush()
        if close:
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == tag:
                    del stack[i:]
                    break
        elif tag not in VOID:
            if tag in ENDS or tag.startswith("h") and tag[1:].isdigit():
                ends = ENDS.get(tag, {"p"})
                for i in range(len(stack) - 1, -1, -1):
                    if stack[i][0] in CONTAINERS or stack[i][0] in ("ul", "ol", "dl") and tag != "p":
                        break
                    if stack[i][0] in ends:
                        del stack[i:]
                        break
            elif tag != "hr" and stack and stack[-1][0] == "p":
                stack.pop()  # a block ends a paragraph
            key, excluded = _key(tag, attributes)
            # an article's own header is its title
            inside = any(t in ("article", "main") for t, _, _ in stack)
            if tag == "header" and not inside:
                excluded = True
            stack.append((tag, key, excluded or bool(stack) and stack[-1][2]))
    yield from flush()


def _node(key: str) -> dict:
    """k: key, t: the text if all pages agree, else absent; n: pages; m: pages with text of its own; c: characters; x: excluded; r: repeated; o: optional."""
    return {"k": key, "n": 0, "m": 0, "c": 0, "x": False, "r": False, "o": False, "s": False, "d": []}


def page_tree(page: str) -> dict:
    """A page as a wrapper of itself: equal neighbours are one repeated node. Roots have h: AGREE digests of pages at most."""
    root, found = _node(""), list(blocks(page))
    root["n"] = 1
    root["h"] = [hashlib.blake2b("\n".join(t for _, _, t in found).encode("utf-8", "replace"), digest_size=6).hexdigest()]
    for path, excluded, text in found:
        at, whole = root, True
        for i, key in enumerate(path):
            down = at["d"]
            leaf = i == len(path) - 1
            if down and down[-1]["k"] == key and not (leaf and not whole):
                nxt = down[-1]
                nxt["r"] |= leaf
            else:
                nxt = _node(key)
                nxt["n"] = 1
                down.append(nxt)
            at = nxt
        at["x"] |= excluded
        if "t" not in at and not at["s"]:
            at["t"] = text
        elif at.get("t") != text:
            at.pop("t", None)
            at["s"] = True
        at["m"] = 1
        at["c"] += len(text)
    return root


def _matches(xs: list[str], ys: list[str]) -> Iterator[tuple[int | None, int | None]]:
    """Places of keys that match, in order, and between them those of one side alone.

    At a mismatch both sides are searched ahead for the nearest pair of equal keys; what is skipped has no
    partner. The search tries no more places than it then skips, so the time is linear but for a logarithm.
    """
    places: dict[str, list[int]] = {}
    for j, key in enumerate(ys):
        places.setdefault(key, []).append(j)
    i = j = 0
    while i < len(xs) and j < len(ys):
        least, skip = len(xs) + len(ys), (len(xs) - i, len(ys) - j)
        for a in range(len(xs) - i):
            if a >= least:
                break
            held = places.get(xs[i + a], ())
            if (k := bisect_left(held, j)) < len(held) and a + held[k] - j < least:
                least, skip = a + held[k] - j, (a, held[k] - j)
        yield from ((i + a, None) for a in range(skip[0]))
        yield from ((None, j + b) for b in range(skip[1]))
        i, j = i + skip[0], j + skip[1]
        if i < len(xs) and j < len(ys):
            yield i, j
            i, j = i + 1, j + 1
    yield from ((a, None) for a in range(i, len(xs)))
    yield from ((None, b) for b in range(j, len(ys)))


def align(a: dict, b: dict) -> dict:
    """The wrapper that both match: children pair in order, those without a partner are optional."""
    out = _node(a["k"])
    out["n"], out["m"], out["c"] = a["n"] + b["n"], a["m"] + b["m"], a["c"] + b["c"]
    for f in ("x", "r", "o"):
        out[f] = a[f] or b[f]
    out["s"] = a["s"] or b["s"] or ("t" in a and "t" in b and a["t"] != b["t"])
    if not out["s"] and (t := a.get("t", b.get("t"))) is not None:
        out["t"] = t
    if "h" in a:
        out["h"] = sorted({*a["h"], *b["h"]})[:AGREE]
    xs, ys = a["d"], b["d"]
    if [x["k"] for x in xs] == [y["k"] for y in ys]:
        out["d"] = [align(x, y) for x, y in zip(xs, ys, strict=True)]
        return out
    for i, j in _matches([x["k"] for x in xs], [y["k"] for y in ys]):
        if i is None:
            out["d"].append(ys[j] | {"o": True})
        elif j is None:
            out["d"].append(xs[i] | {"o": True})
        else:
            out["d"].append(align(xs[i], ys[j]))
    # an optional group next to an equal one is a repetition
    folded: list[dict] = []
    for x in out["d"]:
        if folded and folded[-1]["k"] == x["k"]:
            one = align(folded[-1], x) | {"r": True}
            one["n"], one["m"] = max(folded[-1]["n"], x["n"]), max(folded[-1]["m"], x["m"])
            folded[-1] = one
        else:
            folded.append(x)
    out["d"] = folded
    return out


def _constant(node: dict, pages: int) -> bool:
    """Whether all pages have the node's own text; pages is 0 where too few of them differ."""
    return "t" in node and node["m"] == pages > 0


def _content(node: dict, pages: int) -> bool:
    """Whether the node itself has texts that are not excluded and vary, or that not all pages have."""
    return node["c"] > 0 and not node["x"] and not _constant(node, pages)


def _holds(node: dict, pages: int) -> bool:
    return _content(node, pages) or any(_holds(x, pages) for x in node["d"])


def rules(wrapper: dict) -> dict:
    """{"root": path of the main container, "own": [path, text] of the template's inside it}."""
    at, path = wrapper, []
    pages = wrapper["n"] if len(wrapper["h"]) >= AGREE else 0
    while at["k"].split(".")[0] not in ("article", "main") and not _content(at, pages):
        into = [x for x in at["d"] if _holds(x, pages)]
        # what lies beside would be lost
        if len(into) != 1 or into[0]["k"].split(".")[0] not in CONTAINERS:
            break
        # a repeated text container is a list of blocks, not the place of the text
        if into[0]["r"] and not into[0]["d"]:
            break
        at = into[0]
        path.append(at["k"])
    own: set[tuple[tuple[str, ...], str]] = set()

    def constants(node, path):
        if path and path[-1].split(".")[0] in ("article", "main"):
            return
        if _constant(node, pages) and not node["r"] and not re.match(r"(p|h\d|blockquote|li)\b", node["k"]):
            own.add((path, node["t"]))
        for x in node["d"]:
            constants(x, (*path, x["k"]))

    if _holds(at, pages):
        constants(at, tuple(path))
    return {"root": path, "own": sorted(own)}


def main_text(page: str | None, rule: dict | None) -> str:
    every = list(blocks(page or ""))
    if rule and rule["root"]:
        root, own = tuple(rule["root"]), {(tuple(p), t) for p, t in rule["own"]}
        inside = [t for path, x, t in every if not x and path[: len(root)] == root and (path, t) not in own]
        if inside:
            return "\n".join(inside)
    return "\n".join(t for _, x, t in every if not x)


def _host(url: str | None) -> str:
    found = re.match(r"(?:[a-zA-Z][\w+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", url or "")
    return found[1].lower() if found else ""


def _wrap(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Partial wrappers of a partition's hosts."""
    held: dict[str, dict] = {}

    def out():
        keys = list(held)
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array([json.dumps(held[k]) for k in keys], pa.string())], ["host", "wrapper"])
        held.clear()

    for batch in batches:
        for url, page in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            host, tree = _host(url), page_tree(page or "")
            held[host] = align(held[host], tree) if host in held else tree
        if len(held) > HOSTS:
            yield from out()
    yield from out()


def _merged(finish: bool):
    def run(key: tuple, part: pa.Table) -> pa.Table:
        whole = None
        for text in sorted(part["wrapper"].to_pylist()):
            tree = json.loads(text)
            whole = tree if whole is None else align(whole, tree)
        text = json.dumps(rules(whole) if finish else whole)
        return pa.table({"host": pa.array([part["host"][0].as_py()]), "wrapper": pa.array([text])})

    return run


def wrappers(pages: DataFrame) -> DataFrame:
    """Rows (host, wrapper): each host's rules as JSON, inferred from all of its pages."""
    partial = pages.select("url", "html").mapInArrow(_wrap, "host string, wrapper string")
    some = partial.groupBy("host", F.pmod(F.xxhash64("wrapper"), F.lit(16))).applyInArrow(_merged(False), "host string, wrapper string")
    return some.groupBy("host").applyInArrow(_merged(True), "host string, wrapper string")


def extract(pages: DataFrame) -> DataFrame:
    """Rows (page_id, url, text, n_chars), one per page."""
    rule = checkpointed(wrappers(pages))
    host = F.regexp_extract(F.coalesce("url", F.lit("")), r"\A(?:[a-zA-Z][\w+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", 1)
    joined = join_lookup(pages.select("page_id", "url", "html", F.lower(host).alias("host")), rule, "host")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, dict] = {}
        for batch in batches:
            texts = []
            for page, text in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                if text is not None and text not in known:
                    if len(known) > HOSTS:
                        known.clear()
                    known[text] = json.loads(text)
                texts.append(main_text(page, known.get(text)))
            n = pa.array([len(t) for t in texts], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), n], ["page_id", "url", "text", "n_chars"])

    return joined.select("page_id", "url", "html", "wrapper").mapInArrow(run, "page_id bigint, url string, text string, n_chars bigint")


def op9_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
