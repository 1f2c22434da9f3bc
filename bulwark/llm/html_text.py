"""Main text of web pages, with a suffix array over the pages of a host.

A page is parsed into blocks, each in a zone: *content* (inside the publisher's ``article`` or ``main``), *chrome* (menus,
headers, footers, sidebars, notices, adverts, forms, reader comments) or *open* (anything else).  For every host the token
streams of what lies outside the content zone are concatenated and their suffixes sorted; substrings of at least
``MIN_TOKENS`` tokens that stand on ``MIN_PAGES`` distinct pages are boilerplate, and so are whole blocks of at least
``MIN_BLOCK`` tokens that do.  Shorter repeats are phrases of the language and stay.  A page with a content zone yields that zone
whole: a paragraph that an article shares with others is still part of it.  A page without one yields its open blocks less
the covered boilerplate, so that unique runs stay.

A host with many pages is split by a hash of the page into groups of about ``GROUP_PAGES``, so no task holds a host of any
size.  There the windows and whole blocks are hashed, the distinct pages of each are counted over the whole host, and every
group is handed those of its own that repeat: the same substrings go as one suffix array over the host would find.  Defined cases: null html gives an empty text; a null or odd url is host ``''``; repeated
pages are extracted alike (they count as one page for the boilerplate test only if their ids agree); other columns are not read; an empty table
gives an empty result.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bulwark.llm.common import checkpointed, map_batches

MIN_TOKENS = 30
#: Tokens from which a whole block counts as a repeat.
MIN_BLOCK = 4
MIN_PAGES = 3
GROUP_PAGES = 256
#: Hosts above the group size, up to this many, are broadcast (host and count); more are joined by a shuffle.
BROADCAST_HOSTS = 50_000
CONTENT, OPEN, CHROME = 0, 1, 2

#: The rest of a tag after its name: attributes, whose quoted values may hold anything.
REST = re.compile(r"[^>=]*+(?:=\s*+(?:\"[^\"]*+\"|'[^']*+'|(?![\"'])[^\s>]*+)[^>=]*+)*+>")
NAME = re.compile(r"(/?)([A-Za-z][A-Za-z0-9-]*)")
#: Elements whose content is no markup, and elements that hold no text of the page; a tag of either without an end tag is passed over.
RAW = frozenset("script style title textarea iframe xmp noembed".split())
NO_TEXT = frozenset("noscript template svg select object math".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q ruby rt rp s samp small span strike strong sub sup time tt u var wbr br".split())
#: Elements that end without a tag as often as with one.
OPTIONAL_END = frozenset("p li td th tr dt dd option".split())
#: Elements that are chrome wherever they stand, and those that are so outside the content.
CHROME_TAGS = frozenset("nav aside form footer dialog menu button fieldset".split())
CHROME_OUTSIDE = frozenset(["header"])
#: Parts of a class or id that make an element chrome in any compound, and those that do only alone or beside a word of layout.
STRONG = frozenset(
    "ad ads adv advert advertisement advertising sponsor sponsored promo sidebar side-bar nav navbar navigation breadcrumb breadcrumbs footer comment comments disqus "
    "cookie cookies gdpr popup modal newsletter subscribe share sharing widget toolbar pagination pager skip-link skiplink".split()
)
WEAK = frozenset("banner promoted menu header masthead consent notice notices alert overlay signup login social related recommended copyright".split())
LAYOUT = frozenset(
    "site main top bottom left right global bar box list links link posts post articles stories items item buttons button icons icon wrapper wrap container inner outer area section "
    "block module panel row col strip sticky fixed mobile desktop primary secondary page media follow text message close dropdown toggle form".split()
)
#: Of these, what an article may hold: its own head.
HEADS = frozenset(["header", "masthead"])
NAMED = re.compile(r"(?:^|[\s\"'/])(?:class|id)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+))", re.I)
ROLE = re.compile(r"\brole\s*=\s*[\"']?(?:navigation|banner|contentinfo|complementary|search|dialog|alert|form|menu)\b", re.I)
HIDDEN = re.compile(r"(?:^|\s)hidden(?:[\s=/]|$)|aria-hidden\s*=\s*[\"']?true|display\s*:\s*none", re.I)


def chrome_name(token: str, inside: bool) -> bool:
    """Whether one class or id names chrome; ``inside`` an article its own head stays."""
    if token in STRONG:
        return True
    parts = [p for p in re.split(r"[-_]+", token) if p]
    if any(p in STRONG for p in parts):
        return True
    weak = [p for p in parts if p in WEAK and not (inside and p in HEADS)]
    return bool(weak) and all(p in WEAK or p in LAYOUT or p.isdigit() for p in parts)


@lru_cache(maxsize=4096)
def chrome_attributes(attributes: str, named: bool, inside: bool) -> bool:
    """Whether a tag's attributes make it chrome; ``named`` says that class and id count."""
    if HIDDEN.search(attributes):
        return True
    if "=" not in attributes:
        return False
    if ROLE.search(attributes):
        return True
    return named and any(chrome_name(t, inside) for m in NAMED.finditer(attributes) for t in (m[1] or m[2] or m[3] or "").lower().split())


def zone_of(name: str, attributes: str, outer: int) -> int:
    """The zone inside an element that stands in zone ``outer``."""
    if attributes and chrome_attributes(attributes, name not in ("body", "html"), outer == CONTENT):
        return CHROME
    if name in ("article", "main"):
        return CONTENT
    if name in CHROME_TAGS or name in NO_TEXT or name in CHROME_OUTSIDE and outer != CONTENT:
        return CHROME
    return outer


def marks(page: str) -> Iterator[tuple[int, int, str, bool, str]]:
    """``start, end, name, closing, attributes`` of every piece of markup, in one pass; comments, declarations and raw elements have no name.

    Whatever is looked for in vain (an end tag, a ``>``, a closing quote) is looked for once.
    """
    at, missing, plain = 0, set(), False
    while (start := page.find("<", at)) >= 0:
        m = NAME.match(page, start + 1)
        if not m:
            at = start + 1
            if page.startswith("<!--", start):
                end = page.find("-->", start + 4)
                at = end + 3 if end >= 0 else len(page)
                yield start, at, "", False, ""
            elif page.startswith(("<!", "<?", "</"), start) and ">" not in missing:
                end = page.find(">", start)
                if end < 0:
                    missing.add(">")
                else:
                    at = end + 1
                    yield start, at, "", False, ""
            continue
        name, closing = m[2].lower(), bool(m[1])
        rest = None if plain else REST.match(page, m.end())
        if not rest:  # a quote is left open: from here on a tag ends at the next >
            plain = True
            end = -1 if ">" in missing else page.find(">", m.end())
            if end < 0:
                missing.add(">")
                at = start + 1
                continue
            at = end + 1
        else:
            at = rest.end()
        attributes = page[m.end() : at - 1]
        if closing or name not in RAW and name not in NO_TEXT:
            yield start, at, name, closing, attributes
            continue
        if name in missing or name != "script" and name != "style" and attributes.endswith("/"):
            yield start, at, "", False, ""
            continue
        over = end_tag(name).search(page, at)
        if not over:
            missing.add(name)
            yield start, at, "", False, ""
        elif name in RAW:
            at = over.end()
            yield start, at, "", True, ""
        else:
            yield start, at, name, False, attributes


@lru_cache(maxsize=64)
def end_tag(name: str) -> re.Pattern:
    return re.compile(rf"</{name}\b[^>]*>?", re.I)


def blocks_of(page: str | None) -> list[tuple[int, str]]:
    """Zone and text of every block that isn't empty, in page order."""
    if not page:
        return []
    out: list[tuple[int, str]] = []
    parts: list[str] = []
    stack: list[tuple[str, int]] = []
    held: dict[str, int] = {}
    zone, at = OPEN, 0

    def close() -> None:
        if parts:
            if text := " ".join(entities.unescape("".join(parts)).split()):
                out.append((zone, text))
            parts.clear()

    def pop() -> str:
        nonlocal zone
        name, zone = stack.pop()
        held[name] -= 1
        return name

    for start, end, name, closing, attributes in marks(page):
        if start > at:
            parts.append(page[at:start])
        at = end
        if not name:
            if closing:  # a raw element stood here
                parts.append(" ")
            continue
        opened = held.get(name, 0) > 0
        if closing:
            if opened or name not in INLINE:
                close()
            while opened:
                opened = pop() != name
            continue
        if name in VOID or name in INLINE and not opened and zone_of(name, attributes, zone) == zone:
            if name not in INLINE:
                close()
            elif name == "br":
                parts.append(" ")
            continue
        close()
        if stack and (stack[-1][0] == "p" and name not in INLINE or stack[-1][0] == name and name in OPTIONAL_END):
            pop()
        if name not in OPTIONAL_END or zone_of(name, attributes, zone) != zone:
            stack.append((name, zone))
            held[name] = held.get(name, 0) + 1
            zone = zone_of(name, attributes, zone)
    if at < len(page):
        parts.append(page[at:])
    close()
    return out


def covered(streams: list[list[str]], pages: list[int], min_tokens: int = MIN_TOKENS, min_pages: int = MIN_PAGES) -> list[np.ndarray]:
    """For every stream, which of its tokens lie in substrings repeated on ``min_pages`` distinct pages.

    The suffixes of all streams, a distinct end mark after each, are sorted by prefix doubling.  Suffixes that agree in
    their first ``min_tokens`` tokens are neighbours; a longer repeat is the union of such windows.
    """
    flat = [t for s in streams for t in s]
    if not flat:
        return [np.zeros(0, bool) for _ in streams]
    sizes = np.array([len(s) for s in streams])
    starts = np.cumsum(sizes + 1) - (sizes + 1)
    n = int(sizes.sum() + len(streams))
    rank = np.empty(n, np.int64)
    ends = starts + sizes
    inside = np.ones(n, bool)
    inside[ends] = False
    codes = pd.factorize(pd.Series(flat, dtype=object))[0]
    rank[inside] = codes
    rank[ends] = codes.max() + 1 + np.arange(len(streams))
    owner = np.repeat(np.array(pages), sizes + 1)
    length = 1
    while length < min_tokens:
        step = min(length, min_tokens - length)
        second = np.full(n, -1, np.int64)
        second[: n - step] = rank[step:]
        order = np.lexsort((second, rank))
        a, b = rank[order], second[order]
        new = np.empty(n, np.int64)
        new[order] = np.concatenate([[0], np.cumsum((a[1:] != a[:-1]) | (b[1:] != b[:-1]))])
        rank, length = new, length + step
    pairs = np.unique(np.stack([rank, owner], 1), axis=0)
    spread = np.bincount(pairs[:, 0], minlength=int(rank.max()) + 1)
    hit = spread[rank] >= min_pages
    cover = np.zeros(n + 1, np.int64)
    np.add.at(cover, np.flatnonzero(hit), 1)
    np.add.at(cover, np.minimum(np.flatnonzero(hit) + min_tokens, n), -1)
    cover = np.cumsum(cover[:-1]) > 0
    return [cover[s : s + k] for s, k in zip(starts, sizes, strict=True)]


def repeated_blocks(streams: list[list[str]], pages: list[int], min_block: int = MIN_BLOCK, min_pages: int = MIN_PAGES) -> list[bool]:
    """For every stream, whether it stands as a whole on ``min_pages`` distinct pages."""
    on: dict[tuple[str, ...], set[int]] = {}
    whole = [tuple(s) for s in streams]
    for s, page in zip(whole, pages, strict=True):
        if len(s) >= min_block:
            on.setdefault(s, set()).add(page)
    return [len(on.get(s, ())) >= min_pages for s in whole]


def host_of(url: Column) -> Column:
    return F.lower(F.coalesce(F.nullif(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1), F.lit("")), F.lit("")))


def keyed(pages: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """``page_id, url, html, hh, parts, part``, and those of hosts that have several parts, if any; ``hh`` stands for the host."""
    rows = pages.select("page_id", "url", "html", F.xxhash64(F.coalesce(host_of(F.col("url")), F.lit(""))).alias("hh"))
    large = rows.groupBy("hh").agg(F.count("*").alias("pages")).filter(F.col("pages") > GROUP_PAGES).select("hh", F.ceil(F.col("pages") / GROUP_PAGES).alias("parts"))
    hosts = large.limit(BROADCAST_HOSTS + 1).count()
    rows = rows.join(F.broadcast(large) if hosts <= BROADCAST_HOSTS else large, "hh", "left")
    rows = rows.withColumn("part", F.pmod(F.xxhash64("page_id"), F.coalesce("parts", F.lit(1))))
    return rows, rows.filter("parts is not null") if hosts else None


def parsed(rows: DataFrame) -> DataFrame:
    """``page_id, url, hh, part, split, zones, blocks``; ``split`` says that the host has several parts."""

    def make():
        def each(batch: pd.DataFrame) -> pd.DataFrame:
            got = [blocks_of(h) for h in batch["html"]]
            out = batch[["page_id", "url", "hh", "part", "split"]].astype({"page_id": "Int64"})
            out["zones"] = [[z for z, _ in g] for g in got]
            out["blocks"] = [[t for _, t in g] for g in got]
            return out

        return each

    columns = ["page_id", "url", "hh", "part", F.col("parts").isNotNull().alias("split"), "html"]
    return map_batches(rows, columns, "page_id long, url string, hh long, part long, split boolean, zones array<int>, blocks array<string>", make)


def window_hashes(tokens: list[str], min_tokens: int = MIN_TOKENS) -> np.ndarray:
    """A 64-bit hash of every window of ``min_tokens`` tokens."""
    n = len(tokens) - min_tokens + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    each = pd.util.hash_array(np.array(tokens, dtype=object), categorize=False)
    out = np.zeros(n, np.uint64)
    for j in range(min_tokens):
        out = out * np.uint64(0x9E3779B97F4A7C15) + each[j : j + n]
    return out.view(np.int64)


def block_hash(tokens: list[str]) -> int:
    """A 64-bit hash of a whole block, apart from those of windows."""
    return int(pd.util.hash_array(np.array(["\0" + " ".join(tokens)], dtype=object), categorize=False).view(np.int64)[0])


def repeats(rows: DataFrame) -> DataFrame:
    """``hh, part, h``: hashes that stand on ``MIN_PAGES`` distinct pages of their host, for each part that has them."""

    def make():
        def each(batch: pd.DataFrame) -> pd.DataFrame:
            hashes = []
            for page in batch["html"]:
                found = []
                for tokens in (t.split() for z, t in blocks_of(page) if z != CONTENT):
                    found.append(window_hashes(tokens))
                    if len(tokens) >= MIN_BLOCK:
                        found.append(np.array([block_hash(tokens)]))
                hashes.append(np.unique(np.concatenate(found)) if found else np.zeros(0, np.int64))
            out = batch[["page_id", "hh", "part"]].astype({"page_id": "Int64"})
            out["h"] = hashes
            return out

        return each

    found = map_batches(rows, ["page_id", "hh", "part", "html"], "page_id long, hh long, part long, h array<bigint>", make)
    # pages whose ids agree, null among them, count once
    seen = found.select("hh", "part", F.explode("h").alias("h"), "page_id").distinct()
    per = checkpointed(seen.groupBy("hh", "part", "h").agg(F.count("*").alias("pages")))
    spread = per.groupBy("hh", "h").agg(F.sum("pages").alias("pages")).filter(F.col("pages") >= MIN_PAGES)
    return per.select("hh", "part", "h").join(spread.select("hh", "h"), ["hh", "h"], "left_semi")


def masked(block: list[str], known: set[int]) -> np.ndarray:
    """Which tokens of a block lie in windows, or a whole, among the hashes ``known``."""
    out = np.zeros(len(block), bool)
    for at, h in enumerate(window_hashes(block).tolist()):
        if h in known:
            out[at : at + MIN_TOKENS] = True
    if len(block) >= MIN_BLOCK and block_hash(block) in known:
        out[:] = True
    return out


def host_texts(group: pd.DataFrame, known: pd.DataFrame | None = None) -> pd.DataFrame:
    """Texts of the pages of one group of one host; ``known`` has the repeats of a host that is split."""
    ids = pd.factorize(group["page_id"])[0]
    streams, pages, where = [], [], []
    for row, (zones, blocks) in enumerate(zip(group["zones"], group["blocks"], strict=True)):
        for k, (zone, block) in enumerate(zip(zones, blocks, strict=True)):
            if zone != CONTENT:
                streams.append(block.split())
                pages.append(ids[row])
                where.append((row, k))
    if group["split"].any():
        hashes = set(known["h"].tolist())
        masks = {at: masked(s, hashes) for at, s in zip(where, streams, strict=True)}
    else:
        whole = repeated_blocks(streams, pages)
        masks = {at: cover | gone for at, cover, gone in zip(where, covered(streams, pages), whole, strict=True)}
    texts = []
    for row, (zones, blocks) in enumerate(zip(group["zones"], group["blocks"], strict=True)):
        keep = [b for z, b in zip(zones, blocks, strict=True) if z == CONTENT]
        if not keep:
            for k, (zone, block) in enumerate(zip(zones, blocks, strict=True)):
                if zone == OPEN:
                    rest = [t for t, gone in zip(block.split(), masks[row, k], strict=True) if not gone]
                    if rest:
                        keep.append(" ".join(rest))
        texts.append("\n".join(keep))
    out = group[["page_id", "url"]].astype({"page_id": "Int64"})
    out["text"] = texts
    return out


def main_texts(pages: DataFrame) -> DataFrame:
    """``page_id, url, text, n_chars`` of every page."""
    rows, split = keyed(pages)
    groups, schema = parsed(rows).groupBy("hh", "part"), "page_id long, url string, text string"
    if split is None:
        texts = groups.applyInPandas(lambda group: host_texts(group), schema)
    else:
        both = groups.cogroup(repeats(split).groupBy("hh", "part"))
        texts = both.applyInPandas(lambda group, known: host_texts(group, known), schema)
    return texts.withColumn("n_chars", F.length("text").cast("long"))
