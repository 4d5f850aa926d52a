"""HTML extraction: nearest-URL page differencing.

A page becomes lines of text, one for each block.  Pages of one host are put next to those whose
URL path is nearest: the different outlines (sequences of lines) of a host are sorted by path, in
ranges of bounded size that reach one row into their neighbours, so that every outline meets the one
before and the one behind it, whatever the size of the host.  It is aligned with both by the longest
common subsequence of their lines, and the lines shared are deleted as the host's furniture.  What
mark-up says outright is not left to chance: menus, headers, footers, asides, forms, adverts, notices,
scripts, styles and reader comments never count as text, and the lines of an explicit article
(``article``, ``main``, or such a role) are its own even where a neighbour tells the same, as an
article may be printed twice; differencing decides for pages without one.

Cases: null or empty html gives the empty text; a null URL is a host of its own without
differencing; repeated pages are kept each; an outline that a neighbour holds whole keeps its lines,
being a copy; unclosed and crossing tags are read leniently; pages of any length are read whole; an
empty table gives no rows; other columns are not looked at.
"""

from __future__ import annotations

import bisect
import html as entities
import re
from array import array
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.llm.common import chunks, durable

#: Pages with deletions, a few hundred bytes each, that may be broadcast.
BROADCAST_ROWS = 20_000

# HTML elements by what they are to a reader.
RAW = {"script", "style", "template", "noscript", "iframe", "textarea", "title", "svg", "math", "object", "canvas", "select"}
FURNITURE = {"nav", "footer", "aside", "form", "dialog", "menu", "button", "head"}
MAIN = {"article", "main"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "label", "mark", "q", "rp", "rt", "ruby", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr", "img", "math", "mrow", "mi", "mo", "mn", "msub", "msup", "mtext"}
ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "dialog", "alert", "alertdialog", "menu", "menubar", "toolbar"}
MAIN_ROLES = {"article", "main"}
#: Words of class and id that name furniture, and words that go with them without another meaning.
NAMED = r"ads?|advert(?:s|isement|ising)?|banner|breadcrumbs?|comments?|comment-list|respond|disqus|cookies?|consent|gdpr|footer|header|masthead|menu|nav|navbar|navigation|newsletter|notices?|popup|modal|promo(?:tion)?|related|share|sharing|sidebar|social|sponsor(?:ed)?|subscribe|toolbar|widget"
NAMES = re.compile(rf"(?:^|[\s_-])(?:{NAMED})(?:$|[\s_-])", re.I)
WITH_NAMES = r"area|articles?|bar|block|bottom|box|buttons?|container|form|icons?|inline|inner|items?|left|links?|lists?|outer|posts?|right|section|signup|slot|stories|top|unit|wrap(?:per)?"
#: Inside an article a class or id names furniture only if all its words do.
WHOLE_NAMES = re.compile(rf"(?:^|\s)(?:(?:{WITH_NAMES})[_-])*(?:{NAMED})(?:[_-](?:{NAMED}|{WITH_NAMES}|\d+))*(?:$|\s)", re.I)
#: Drawings and formulas: in an article their text is the article's.
FIGURES = {"svg", "math"}
TOKEN = re.compile(r"<!--.*?(?:-->|$)|<!\[CDATA\[.*?(?:\]\]>|$)|<[!?][^>]*>?|</?[a-zA-Z](?:[^>\"']|\"[^\"]*\"|'[^']*')*>?", re.S)
ATTRIBUTE = re.compile(r"""([^\s"'<>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'=<>`]+)))?""")
SPACE = re.compile(r"\s+")
ATTRIBUTES_OF_NOTE = re.compile(r"\b(?:class|id|role|hidden|style|aria-hidden)\b", re.I)


def _kind(name: str, tag: str, in_main: bool) -> str:
    """drop, main or plain."""
    if name in FURNITURE or (name == "header" and not in_main):
        return "drop"
    if ATTRIBUTES_OF_NOTE.search(tag):
        found = {m[1].lower(): entities.unescape(m[2] or m[3] or m[4] or "") for m in ATTRIBUTE.finditer(tag[len(name) + 1 :])}
        role = found.get("role", "").lower()
        if "hidden" in found or found.get("aria-hidden", "").lower() == "true" or "display:none" in found.get("style", "").replace(" ", "").lower():
            return "drop"
        if role in ROLES:
            return "drop"
        if role in MAIN_ROLES:
            return "main"
        if name not in ("html", "body", *MAIN) and any((WHOLE_NAMES if in_main else NAMES).search(found.get(k, "")) for k in ("class", "id")):
            return "drop"
    return "main" if name in MAIN else "plain"


def blocks(page: str | None) -> list[tuple[str, bool]]:
    """(text, in an explicit article) of each block that mark-up does not rule out, in page order."""
    page = page or ""
    out: list[tuple[str, bool]] = []
    text: list[str] = []
    stack: list[tuple[str, str]] = []  # (element, kind)
    dropped = mains = 0
    at = 0

    def close() -> None:
        if text:
            line = SPACE.sub(" ", "".join(text)).strip()
            text.clear()
            if line:
                out.append((line, mains > 0))

    while at < len(page):
        m = TOKEN.search(page, at)
        if not m:
            if not dropped:
                text.append(entities.unescape(page[at:]))
            break
        if not dropped and m.start() > at:
            text.append(entities.unescape(page[at : m.start()]))
        at = m.end()
        tag = m[0]
        if tag.startswith("<![CDATA[") and not dropped:
            text.append(tag[9:].removesuffix("]]>"))
        if tag[1] in "!?":
            continue
        ending = tag[1] == "/"
        name = re.match(r"[^\s/>]+", tag[1 + ending :])[0].lower()
        if name not in INLINE and not dropped:
            close()
        if not ending:
            if name in RAW and not (mains and name in FIGURES):
                if not tag.endswith("/>"):
                    end = re.compile(rf"</{re.escape(name)}(?:[\s/>]|$)", re.I).search(page, at)
                    at = len(page) if not end else page.find(">", end.start()) + 1 or len(page)
                continue
            if name in VOID or tag.endswith("/>"):
                continue
            kind = _kind(name, tag, mains > 0)
            if name == "p" and stack and stack[-1][0] == "p":  # a new paragraph ends the last
                continue
            stack.append((name, kind))
            dropped += kind == "drop"
            mains += kind == "main" and not dropped
            if kind == "drop" and dropped == 1 and name in INLINE:
                close()
        else:
            # the nearest open element of that name, and whatever is open in it, ends; but an inline
            # or paragraph end never ends a section
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == name:
                    if not dropped and any(n not in INLINE for n, _ in stack[k:]):
                        close()
                    while len(stack) > k:
                        _, kind = stack.pop()
                        mains -= kind == "main" and not dropped
                        dropped -= kind == "drop"
                    break
                if (name in INLINE or name in ("p", "li")) and stack[k][0] not in INLINE and stack[k][0] not in ("p", "li"):
                    break
    close()
    return out


def common_lines(a: list[int], b: list[int]) -> set[int]:
    """Places in ``a`` of a longest common subsequence with ``b`` (Hunt and Szymanski, 1977)."""
    start = 0
    while start < min(len(a), len(b)) and a[start] == b[start]:
        start += 1
    end = 0
    while end < min(len(a), len(b)) - start and a[-1 - end] == b[-1 - end]:
        end += 1
    out = {*range(start), *range(len(a) - end, len(a))}
    where: dict[int, list[int]] = {}
    for j in range(len(b) - end - 1, start - 1, -1):
        where.setdefault(b[j], []).append(j)
    tails: list[int] = []
    links: list[tuple] = []
    for i in range(start, len(a) - end):
        for j in where.get(a[i], ()):
            k = bisect.bisect_left(tails, j)
            link = (i, links[k - 1] if k else None)
            if k == len(tails):
                tails.append(j), links.append(link)
            else:
                tails[k], links[k] = j, link
    link = links[-1] if links else None
    while link:
        out.add(link[0])
        link = link[1]
    return out


def furniture(hashes: list[int], neighbours: list[list[int]]) -> list[int]:
    """Places of the lines shared with a neighbour; none if that were all, for then the page is a copy."""
    shared: set[int] = set()
    for other in neighbours:
        shared |= common_lines(hashes, other)
    return sorted(shared) if len(shared) < len(hashes) else []


def _url(u: Column, group: int) -> Column:
    return F.coalesce(F.regexp_extract(u, r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)([^?#]*)", group), F.lit(""))


def outline(page: list[tuple[str, bool]]) -> tuple[bytes, list[int]]:
    """A page's lines as hashes, and one hash of them all."""
    lines = [xxhash.xxh3_64_intdigest(x) - (1 << 63) for x, _ in page]
    return xxhash.xxh3_128_digest(array("q", lines).tobytes()), lines


def outlines(pages: DataFrame) -> DataFrame:
    """page_id, url, host, path, has_main, key (of the outline), hashes (of its lines): small rows that stand for pages."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches):
            got = [blocks(x) for x in batch.column(2).to_pylist()]
            keys, lines = zip(*map(outline, got)) if got else ((), ())
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    batch.column(1),
                    pa.array([any(m for _, m in p) for p in got], pa.bool_()),
                    pa.array(keys, pa.binary()),
                    pa.array(lines, pa.list_(pa.int64())),
                ],
                names=["page_id", "url", "has_main", "key", "hashes"],
            )

    rows = pages.mapInArrow(work, "page_id long, url string, has_main boolean, key binary, hashes array<long>")
    return rows.withColumns({"host": F.lower(_url(F.col("url"), 1)), "path": _url(F.col("url"), 2)})


ROW = "host string, path string, key binary, open boolean, hashes array<long>"


def neighboured(rows: DataFrame) -> DataFrame:
    """rows: host, path, key, open, hashes, one row an outline.  (host, key, drop) of the open ones, whose lines
    a neighbour shares.

    Rows are sorted by host and path over ranges; the last row of a range goes to the range behind
    it as well, the first to the range before, and each range is read in order, three rows at a time.
    """
    dealt = durable(rows.repartitionByRange("host", "path", "key").sortWithinPartitions("host", "path", "key").withColumn("p", F.spark_partition_id()))
    used = sorted(r["p"] for r in dealt.select("p").distinct().collect())  # numbers of ranges

    def ends(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last = None
        for pdf in batches:
            if not len(pdf):
                continue
            if last is None and used.index(pdf["p"].iloc[0]):
                yield pdf.iloc[:1].assign(p=used[used.index(pdf["p"].iloc[0]) - 1])
            last = pdf.iloc[-1:]
        if last is not None and last["p"].iloc[0] != used[-1]:
            yield last.assign(p=used[used.index(last["p"].iloc[0]) + 1])

    more = dealt.mapInPandas(ends, f"{ROW}, p int").withColumn("own", F.lit(False))
    whole = dealt.withColumn("own", F.lit(True)).unionByName(more)

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        two: list = []  # the rows before, at most two
        out: list[tuple] = []

        def settle(before, at, behind) -> None:
            if at.own and at.open:
                near = [list(x.hashes) for x in (before, behind) if x is not None and x.host == at.host and x.p == at.p]
                if found := furniture(list(at.hashes), near):
                    out.append((at.host, at.key, found))

        for pdf in batches:
            for row in pdf.itertuples(index=False):
                if two:
                    settle(two[0] if len(two) > 1 else None, two[-1], row)
                two = [*two[-1:], row]
            yield pd.DataFrame(out, columns=["host", "key", "drop"])
            out.clear()
        if two:
            settle(two[0] if len(two) > 1 else None, two[-1], None)
        yield pd.DataFrame(out, columns=["host", "key", "drop"])

    return whole.repartition("p").sortWithinPartitions("p", "host", "path", "key").mapInPandas(compare, "host string, key binary, drop array<int>")


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text, n_chars of every page."""
    pages = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    rows = durable(outlines(pages).filter("url is not null"))
    # pages of one outline and host are one row, at their first path; hosts without a page to difference stay out
    wanted = rows.filter("not has_main").select("host").distinct()
    distinct = rows.join(wanted, "host", "left_semi").groupBy("host", "key").agg(F.min("path").alias("path"), F.bool_or(~F.col("has_main")).alias("open"), F.first("hashes").alias("hashes"))
    drops = neighboured(distinct.select("host", "path", "key", "open", "hashes"))
    drops = rows.filter("not has_main").select("page_id", "url", "host", "key").join(drops, ["host", "key"])
    # of pages of one id and URL each outline has its own
    drops = durable(drops.groupBy("page_id", "url").agg(F.collect_set(F.struct("key", "drop")).alias("drops")))
    # mostly there are few: then they go to the pages; beyond a bound the pages are shuffled to them
    few = drops.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    drops = F.broadcast(drops) if few else drops

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches):
            text = []
            for page, drops in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                got, drop = blocks(page), ()
                whole = any(m for _, m in got)
                if drops and not whole:
                    drop = set(next((x["drop"] for x in drops if x["key"] == outline(got)[0]), ()))
                text.append(" ".join(x for k, (x, m) in enumerate(got) if (m if whole else k not in drop)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(text, pa.string()), pa.array(list(map(len, text)), pa.int64())], names=["page_id", "url", "text", "n_chars"])

    joined = pages.join(drops, pages["page_id"].eqNullSafe(drops["page_id"]) & (pages["url"] == drops["url"]), "left").select(pages["page_id"], pages["url"], "html", "drops")
    return joined.mapInArrow(work, "page_id long, url string, text string, n_chars long")
