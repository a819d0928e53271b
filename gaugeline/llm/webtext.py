"""Main text of web pages: explicit page furniture goes by its markup, repeated furniture by a suffix array per host.

A page is read into blocks of text. What markup names as furniture (menus, headers, footers, adverts, forms, scripts,
comments and the like) is left out; where its end tag may be omitted, it ends as HTML says. A class or id names furniture
by a whole word, or by a hyphenated one all of whose parts are known; what only its name makes furniture, but holds the
page's marked part or most of its text, is a wrapper. The marked articles are the
text, whole, if they hold most of the main part (of the page, if no main part is marked), or else the main part: copies of
an article on one host are still articles. The token streams of all pages of a host are put together, their suffixes
sorted word by word and the longest common prefixes of neighbours taken. Tokens inside
strings that more than a tenth of the host's pages share (three pages at least) are boilerplate. A block mostly of such
words, outside of all marked parts, does not count when the part is chosen. Where a page marks no part that holds most of what counts, such a
block loses them, any other block stays whole. Pages of one host with equal blocks count as one page. The sort is spread
by range over host, head and page, so a host of a third of all pages is no task of its own.

Defined cases: null and empty pages have an empty text; a page cut off in the middle is read as far as it goes, and a tag that was cut is
no text; a page
without host belongs to the empty host; a page left with fewer words than a shared string has (a mirror, a near copy that
differs in a date) keeps its whole text; an empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, functions as F

from gaugeline.llm.common import row_key, stored
from gaugeline.llm.runs import shared_runs
from gaugeline.llm.sparse import Words, mixed, selected
from gaugeline.session import small_side

#: Tokens of a string that must be shared, and pages of the host that must share it: more than a share of them, and a floor.
TOKENS, PAGES, SHARE = 8, 3, 0.1
#: The weight that the pages of a host have together which are enough.
WHOLE = 1 << 20
#: Elements that are never text, elements whose class, id or role may say so, elements that begin a block.
FURNITURE = frozenset("script style noscript template svg math head title nav header footer aside form button select textarea input label iframe object menu dialog audio video canvas".split())
BOXES = frozenset("div section ul ol dl p span table article figure details a li td tr tbody center ins small strong em".split())
BLOCKS = frozenset("html body p div section article main h1 h2 h3 h4 h5 h6 hgroup li ul ol dl dt dd table thead tbody tfoot tr caption blockquote pre figure figcaption address hr details summary center fieldset".split())
EMPTY = frozenset("area base br col embed hr img input link meta source track wbr".split())
RAW = frozenset("script style textarea title iframe noscript".split())
NAMES = frozenset("""ad ads advert advertisement advertising adsense adbox banner sponsor sponsored promo promotion comment comments respond disqus reply replies sidebar
 menu nav navbar navigation breadcrumb breadcrumbs pagination pager header footer masthead colophon cookie cookies consent gdpr notice notices alert popup modal overlay
 newsletter subscribe subscription signup login share sharing social related recommended widget widgets toolbar""".split())
PARTS = frozenset("ad ads advert advertisement comment comments sidebar cookie cookies consent navbar breadcrumb breadcrumbs newsletter sponsored disqus".split())
#: What may stand beside such a part in a hyphenated name; any other word makes it the name of something else.
BESIDE = NAMES | frozenset("site page main global primary secondary top bottom left right upper lower sticky fixed inline wrapper wrap box container block area section slot unit list item items bar panel form inner outer holder placeholder text link links footer header 1 2 3".split())
#: Furniture that stays furniture however much of a page it holds.
NEVER = frozenset("comment comments respond disqus reply replies".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar".split())
#: Elements whose end tag may be left out: the start tags that end them, those within that keep such a tag inside, and
#: the end tags of what they stand in. A paragraph or item ends with any open block around it.
_OUTER = frozenset("table td th caption object button".split())
_LISTS = _OUTER | frozenset("ul ol menu dl section article aside nav main header footer blockquote figure details form fieldset select center pre dialog".split())
_ROWS = frozenset("table thead tbody tfoot tr".split())
_GROUPS = frozenset("thead tbody tfoot".split())
_CELLS = _GROUPS | frozenset("td th tr caption".split())
OPEN_END = {
    "p": (frozenset("address article aside blockquote center details dialog div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr li dt dd main menu nav ol p pre section summary table ul".split()), _OUTER, BLOCKS - {"p"}),
    "li": (frozenset({"li"}), _LISTS, BLOCKS - {"p", "li"}),
    "td": (_GROUPS | {"td", "th", "tr"}, frozenset({"table"}), _ROWS),
    "tr": (_GROUPS | {"tr"}, frozenset({"table"}), _ROWS - {"tr"}),
    "tbody": (_GROUPS, frozenset({"table"}), frozenset({"table"})),
}
#: A tag whose quotes do not close ends at the next bracket, or with the page.
_MARKUP = re.compile(r"<!--.*?(?:--!?>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)(?:((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)|[^>]*(?:>|\Z))|</?\Z", re.S)
_NAMED = re.compile(r"""(?:^|\s)(class|id|role|hidden|aria-hidden)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I)
_SPACE = re.compile(r"[\s]+")


def is_furniture(name: str, attributes: str) -> tuple[bool, bool]:
    """Whether an element is furniture, and whether it may still turn out to wrap the story."""
    if name in FURNITURE:
        return True, name in ("form", "header")
    if name not in BOXES or not attributes or attributes.isspace():
        return False, False
    named, comments = False, False
    for key, value in _NAMED.findall(attributes):
        key, value = key.lower(), value.strip("\"'").lower()
        if key == "hidden" or (key == "aria-hidden" and value == "true"):
            return True, False
        if key == "role" and value in ROLES:
            named = True
        if key in ("class", "id"):
            for word in value.split():
                parts = frozenset(re.split(r"[-_]+", word))
                if word in NAMES or (not PARTS.isdisjoint(parts) and parts <= BESIDE):
                    named, comments = True, comments or not NEVER.isdisjoint(parts)
    return named, named and not comments


def ends(skipped: str, name: str, closing: bool, inner: list[str], opened: Counter) -> bool:
    """Whether a tag ends furniture whose end tag may be left out; ``inner`` is what is open in it, ``opened`` around it."""
    starts, barriers, around = OPEN_END[skipped]
    if closing and name in inner:
        return False
    if not closing and name in _CELLS and opened["table"] and "table" not in inner:  # the next cell ends all that is open in this one
        return skipped in ("p", "li") or name in starts
    if name not in (around if closing else starts) or (closing and not opened[name]):
        return False
    return barriers.isdisjoint(inner)


def chosen(found: list[tuple[bool, bool, str]], repeated: list[bool] | None = None) -> tuple[int, list[str]]:
    """The part that holds the text, of blocks (in an article, in a main part, text); no part goes that holds most of it.

    Blocks that are ``repeated`` on their host and stand in no marked part do not count against an article of some words.
    """
    size = Counter()
    told = sum(1 + text.count(" ") for article, _, text in found if article) >= TOKENS
    for (article, main, text), again in zip(found, repeated or [False] * len(found), strict=True):
        if not (again and told and not article and not main):
            size[article, main] += len(text)
    articles, main = size[True, False] + size[True, True], size[False, True] + size[True, True]
    if main:
        whole = 2 * size[True, True] > main
        beside = size[True, False] > main  # articles outside hold more than the main part: both are text
        if not whole:
            return 1, [text for a, m, text in found if m or (a and beside)]
    else:
        whole = 2 * articles > articles + size[False, False]
    return (2, [text for a, _, text in found if a]) if whole else (0, [text for *_, text in found])


def blocks(page: str) -> tuple[int, list[str]]:
    """The blocks of the best marked part: of articles (2), of a main part (1), or of all that is no furniture (0)."""
    return chosen(marked_blocks(page))


def marked_blocks(page: str) -> list[tuple[bool, bool, str]]:
    """All blocks that are no furniture, as (in an article, in a main part, text).

    Where furniture leaves no marked text, what was taken for it by its name but holds an article or main part, or more
    than half of the page's text, is no furniture, and the page is read again.
    """
    wraps: set[int] = set()
    while True:
        found, furniture = read_page(page, wraps)
        if any(article or main for article, main, _ in found):
            break
        whole = sum(len(text) for *_, text in found) + sum(size for _, size, _, _ in furniture)
        more = {at for at, size, marked, may in furniture if may and (marked or 2 * size > whole)}
        if not more:
            break
        wraps |= more
    return found


def read_page(page: str, wraps: set[int]) -> tuple[list[tuple[bool, bool, str]], list[tuple[int, int, bool, bool]]]:
    """The blocks of a page with what they stand in, and its furniture outside of marked parts.

    Of a piece of furniture: its place, the length of its text, whether an article or main part begins in it, and whether it
    may be a wrapper. Elements that begin at ``wraps`` are not taken for furniture.
    """
    found: list[tuple[bool, bool, str]] = []
    furniture: list[list] = []
    open_articles = open_mains = 0
    skipped, depth, outer = "", 0, (0, 0)  # the furniture we are in, how often it is nested, what it stands in
    inner: list[str] = []
    opened: Counter = Counter()
    held: list[str] = []

    def close() -> None:
        text = _SPACE.sub(" ", html.unescape("".join(held))).strip()
        held.clear()
        if text:
            found.append((open_articles > 0, open_mains > 0, text))

    at, end = 0, len(page)
    while at < end:
        m = _MARKUP.search(page, at)
        if not m:
            if not skipped:
                held.append(page[at:])
            elif outer == (0, 0):
                furniture[-1][1] += len(page[at:].strip())
            break
        if m.start() > at:
            if not skipped:
                held.append(page[at : m.start()])
            elif outer == (0, 0):
                furniture[-1][1] += len(page[at : m.start()].strip())
        begin, at = m.start(), m.end()
        name = m[2]
        if name is None:
            continue
        name, closing = name.lower(), bool(m[1])
        if not closing and name in RAW:  # its content is no markup
            stop = re.compile(rf"</{name}\b[^>]*(?:>|\Z)", re.I).search(page, at)
            at = stop.end() if stop else end
            continue
        if skipped in OPEN_END:
            if ends(skipped, name, closing, inner, opened):
                skipped = ""  # the tag itself is read as any other
            elif closing and name in inner:
                while inner.pop() != name:
                    pass
                continue
            elif closing and name == skipped and OPEN_END[skipped][1].isdisjoint(inner):
                skipped = ""
                continue
            elif not closing and name not in EMPTY and not (m[3] or "").endswith("/"):
                inner.append(name)
        elif skipped and name == skipped and name not in EMPTY:
            depth += -1 if closing else 1
            if not depth:
                skipped = ""
            continue
        if skipped:
            if outer == (0, 0) and name in ("article", "main") and not closing:
                furniture[-1][2] = True
            # furniture that was never closed ends with the article or main part it stands in
            if not (closing and ((name == "article" and outer[0]) or (name == "main" and outer[1]))):
                continue
            skipped = ""
        taken, may = (False, False) if closing or begin in wraps else is_furniture(name, m[3] or "")
        if taken:
            if name in BLOCKS or name in FURNITURE:
                close()
            if name not in EMPTY and not (m[3] or "").endswith("/"):
                skipped, depth, outer = name, 1, (open_articles, open_mains)
                inner.clear()
                if outer == (0, 0):
                    furniture.append([begin, 0, False, may])
            continue
        if name in BLOCKS:
            close()
            opened[name] = max(0, opened[name] + (-1 if closing else 1))
        elif name in ("br", "td", "th"):
            held.append(" ")
        if name == "article":
            open_articles = max(0, open_articles + (-1 if closing else 1))
        elif name == "main":
            open_mains = max(0, open_mains + (-1 if closing else 1))
    close()
    return found, [tuple(f) for f in furniture]


def tokens_of(parts: list[str]) -> tuple[list[str], list[int]]:
    """All words of some blocks, and how many each block has."""
    split = [p.split(" ") for p in parts]
    return [w for words in split for w in words], [len(words) for words in split]


def unique_runs(parts: list[str], covered: np.ndarray) -> list[str]:
    """The blocks without the covered words of those that are mostly covered; all of them, if hardly a word is left."""
    words, sizes = tokens_of(parts)
    out, at, left = [], 0, 0
    for block, n in zip(parts, sizes, strict=True):
        gone = covered[at : at + n]
        if 2 * int(gone.sum()) <= n:
            out.append(block)
            left += n
        else:
            own = [w for w, c in zip(words[at : at + n], gone, strict=True) if not c]
            out += [" ".join(own)] if own else []
            left += len(own)
        at += n
    return out if left >= TOKENS or not covered.any() else parts


def streamed(text: str, host: str) -> tuple[np.ndarray, np.ndarray]:
    """Places of a page's token stream that its strings of TOKENS words select, and 32 bits for the host and the head there."""
    place, heads = selected(Words(text.encode()), TOKENS)
    salted = mixed(heads ^ np.uint64(xxhash.xxh64_intdigest(host)))
    return place, (salted >> np.uint64(32)).astype(np.uint32).view(np.int32)


def boilerplate(pages: DataFrame) -> DataFrame:
    """(owner, places): where strings begin that enough pages of a host share, out of owner, host, row and text.

    The suffix array of a host's pages, sorted to the depth of TOKENS words, with the longest common prefixes of
    neighbours. A string selects a place (a minimiser) by its own words, so pages that share it share the head at that
    place; suffixes whose head too few pages have are left out before the sort.
    """

    def heads(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in filter(len, batches):
            found = [np.unique(streamed(text, host)[1]) for host, text in zip(batch["host"], batch["text"], strict=True)]
            weight = np.repeat(-(-WHOLE // batch["least"].to_numpy(np.int64)), [len(f) for f in found])
            yield pd.DataFrame({"head": np.concatenate(found), "weight": weight})

    def places(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in filter(len, batches):
            found = [streamed(text, host) for host, text in zip(batch["host"], batch["text"], strict=True)]
            sizes = [len(place) for place, _ in found]
            yield pd.DataFrame({
                "owner": np.repeat(batch["owner"].to_numpy(np.int64), sizes), "place": np.concatenate([p for p, _ in found]).astype(np.int32),
                "head": np.concatenate([h for _, h in found]),
            })

    def suffixes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for owner, host, text, least, starts in zip(*(batch[c] for c in ("owner", "host", "text", "least", "starts")), strict=True):
                words = text.split(" ")
                begin = {i for at in starts for i in range(at - TOKENS // 2 + 1, at + 1) if 0 <= i <= len(words) - TOKENS}
                if begin:
                    at = sorted(begin)
                    suffix = [f"{host}\n{' '.join(words[i : i + TOKENS])}" for i in at]
                    yield pd.DataFrame({"suffix": suffix, "owner": owner, "place": np.array(at, np.int32), "least": np.int32(least)})

    # copies of a page on a host are one page: the first row stands for them
    copies = pages.groupBy("owner").agg(F.count(F.lit(1)).alias("n"), F.min("row").alias("first")).where("n > 1").select("owner", "first")
    single = pages.join(small_side(copies), "owner", "left").where("first IS NULL OR row = first").select("owner", "host", "text")
    enough = F.greatest(F.lit(PAGES), F.floor(F.count(F.lit(1)) * SHARE) + 1).cast("int")
    hosts = small_side(pages.select("owner", "host").distinct().groupBy("host").agg(enough.alias("least")))
    single = single.join(hosts, "host")
    # a page weighs its part of the pages its host asks for, so one sum a head tells whether enough have it
    common = single.mapInPandas(heads, "head int, weight long").groupBy("head").agg(F.sum("weight").alias("weight")).where(F.col("weight") >= WHOLE)
    kept = single.mapInPandas(places, "owner long, place int, head int").join(small_side(common.select("head")), "head", "left_semi")
    starts = small_side(kept.groupBy("owner").agg(F.collect_list("place").alias("starts")))
    array = stored(single.join(starts, "owner").mapInPandas(suffixes, "suffix string, owner long, place int, least int"), "page-suffixes")
    return shared_runs(array, "suffix", "owner", "least", words=TOKENS).groupBy("owner").agg(F.collect_set("place").alias("places"))


def extract(pages: DataFrame, page_id: str = "page_id", url: str = "url", content: str = "html") -> DataFrame:
    """One row per page: page_id, url, text and n_chars."""

    @F.pandas_udf("marks array<int>, blocks array<string>")
    def read(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for contents in batches:
            found = [marked_blocks(c) for c in contents]
            yield pd.DataFrame({"marks": [[2 * a + m for a, m, _ in f] for f in found], "blocks": [[t for *_, t in f] for f in found]})

    rows = pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url"), F.col(content).alias("html"))
    rows = rows.withColumn("host", F.coalesce(F.lower(F.try_parse_url(F.col("url"), F.lit("HOST"))), F.lit("")))
    rows = rows.withColumn("read", read(F.coalesce("html", F.lit("")))).select("page_id", "url", "host", "read.marks", "read.blocks")
    parsed = stored(rows.withColumns({"owner": row_key("host", "blocks"), "row": F.monotonically_increasing_id()}), "pages", compression="zstd")

    @F.pandas_udf("array<string>")
    def kept(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for marks, parts, places in batches:
            out = []
            for mark, p, shared in zip(marks, parts, places, strict=True):
                found = [(m >= 2, m % 2 == 1, text) for m, text in zip(mark, p, strict=True)]
                sizes = [1 + text.count(" ") for text in p]
                covered = np.zeros(sum(sizes), bool)
                for i in () if shared is None else shared:
                    covered[i : i + TOKENS] = True
                gone = np.add.reduceat(covered.astype(np.int64), np.cumsum([0, *sizes[:-1]])) if sizes else []
                level, texts = chosen(found, [2 * int(g) > n for g, n in zip(gone, sizes, strict=True)])
                out.append(texts if level else unique_runs(texts, covered))
            yield pd.Series(out)

    shared = small_side(boilerplate(parsed.select("owner", "host", "row", F.concat_ws(" ", "blocks").alias("text"))))
    every = parsed.join(shared, "owner", "left").select("page_id", "url", kept("marks", "blocks", "places").alias("blocks"))
    text = F.concat_ws("\n", "blocks")
    return every.select("page_id", "url", text.alias("text"), F.length(text).cast("long").alias("n_chars"))
