"""Listing pages: links with their titles and times, and what the page was like, by a table function.

``ListingLinks`` turns one page into many link rows and one row of diagnostics; ``links_of`` applies
it to a table of pages by a lateral join, so the page's own columns stay beside its links.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from datetime import datetime, timedelta, timezone
from html.parser import HTMLParser
from urllib.parse import urljoin

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The zone of wall-clock times on listings, and how times are written there.
ZONE = timezone(timedelta(hours=8))
AGE_FIRST = re.compile(r"\s*(\d{1,3})\s*(m|h|d|w)\b", re.I)
AGE_AGO = re.compile(r"\b(\d{1,3})\s*(m|h|d|w|mins?|minutes?|hrs?|hours?|days?|weeks?)\s*ago\b", re.I)
FULL_DATE = re.compile(r"(20\d{2})[-/年.](\d{1,2})[-/月.](\d{1,2})\s*(?:日)?\s+(\d{1,2}):(\d{2})")
DAY_OF_YEAR = re.compile(r"(?<!\d)(\d{1,2})[-/](\d{1,2})\s+(\d{1,2}):(\d{2})")
DAY_WORD = re.compile(r"(今天|今日|昨天)\s*(\d{1,2}):(\d{2})")
NEAR = 1200  # characters around a link in which its time is looked for
_SECONDS = {"m": 60, "h": 3600, "d": 86_400, "w": 604_800}

LINK = "kind string, position int, url string, title string, snippet string, published_at timestamp, section_nodeid string, title_repaired boolean, listing_strategy string, time_source string"
COUNTS = ("raw_html_bytes", "link_count", "candidate_count", "missing_time_count", "duplicate_url_count", "title_repair_count", "parse_warning_count", "article_link_count", "article_link_candidate_count", "article_link_context_time_count")
SCHEMA = f"{LINK}, {', '.join(f'{c} int' for c in COUNTS)}"


def squeeze(text: str) -> str:
    return " ".join(text.split())


def time_in(text: str, now: datetime) -> datetime | None:
    """When an entry was posted: an age, a date, a day of this year, today or yesterday, in this order; an impossible date is none."""
    if m := AGE_FIRST.match(text) or AGE_AGO.search(text):
        return now - timedelta(seconds=int(m[1]) * _SECONDS[m[2][0].lower()])
    here = now.astimezone(ZONE)
    if m := FULL_DATE.search(text):
        parts = [int(x) for x in m.groups()]
    elif m := DAY_OF_YEAR.search(text):
        parts = [here.year, *(int(x) for x in m.groups())]
    elif m := DAY_WORD.search(text):
        day = here - timedelta(days=m[1] == "昨天")
        parts = [day.year, day.month, day.day, int(m[2]), int(m[3])]
    else:
        return None
    try:
        return datetime(*parts, tzinfo=ZONE).astimezone(timezone.utc)
    except ValueError:
        return None


@dataclass
class _Anchor:
    href: str
    title: str = ""
    aria: str = ""
    words: list[str] = field(default_factory=list)
    alts_and_words: list[str] = field(default_factory=list)


@dataclass
class _Entry:
    section: str
    anchors: list[_Anchor] = field(default_factory=list)
    words: list[str] = field(default_factory=list)


class _Listing(HTMLParser):
    """In one pass: the outermost list entries with their links, and all links of the page."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.entries: list[_Entry] = []
        self.anchors: list[_Anchor] = []
        self._sections: list[str] = []
        self._depth = 0
        self._entry: _Entry | None = None
        self._in_entry: _Anchor | None = None
        self._open: list[_Anchor] = []

    def handle_starttag(self, tag, attrs):
        a = {k: (v or "").strip() for k, v in attrs}
        if tag == "ul":
            self._sections.append(a.get("data-nodeid", ""))
        elif tag == "li":
            if not self._depth:
                self._entry = _Entry(next((s for s in reversed(self._sections) if s), ""))
            self._depth += 1
        elif tag == "a" and a.get("href"):
            anchor = _Anchor(a["href"], a.get("title", ""), a.get("aria-label", ""))
            self._open.append(anchor)
            if self._entry:
                self._in_entry = anchor
                self._entry.anchors.append(anchor)
        elif tag == "img" and self._open and (alt := squeeze(a.get("alt", ""))):
            self._open[-1].alts_and_words.append(alt)

    def handle_endtag(self, tag):
        if tag == "a":
            self._in_entry = None
            if self._open:
                self.anchors.append(self._open.pop())
        elif tag == "li" and self._depth:
            self._depth -= 1
            if not self._depth and self._entry:
                self.entries.append(self._entry)
                self._entry = self._in_entry = None
        elif tag == "ul" and self._sections:
            self._sections.pop()

    def handle_data(self, data):
        if not (text := squeeze(data)):
            return
        if self._entry:
            self._entry.words.append(text)
            if self._in_entry:
                self._in_entry.words.append(text)
        if self._open:
            self._open[-1].alts_and_words.append(text)


def _title(anchor: _Anchor) -> tuple[str, bool]:
    """The title attribute; the link's text without one, or where that goes on from a short attribute (then repaired)."""
    given, shown = squeeze(anchor.title), squeeze(" ".join(anchor.words))
    packed = "".join(given.split())
    weak = len(packed) < 8 or len(packed) < 12 and re.fullmatch("[A-Za-z0-9]+", packed) is not None
    if given and weak and len(shown) >= len(given) + 4 and shown.lower().startswith(given.lower()):
        return shown, True
    return given or shown, False


def _label_title(label: str) -> str:
    """A link's label without the age in front; with one, also without a count behind."""
    title = squeeze(label)
    rest = re.sub(r"^\d{1,3}\s*(?:m|h|d|w)\b\s*", "", title, flags=re.I).strip()
    return re.sub(r"\s+\d{1,5}$", "", rest).strip() if rest != title else rest


def _near_time(html: str, href: str, now: datetime) -> datetime | None:
    at = html.find(href)
    if at < 0:
        return None
    for part in (html[at : at + len(href) + NEAR], html[max(0, at - NEAR) : at]):
        shown = re.sub(r"(?is)<(script|style)\b[^>]*>.*?</\1>", " ", part)
        if when := time_in(squeeze(entities.unescape(re.sub("<[^>]+>", " ", shown))), now):
            return when
    return None


def is_article(url: str, patterns: list[str]) -> bool:
    def hit(p: str) -> bool:
        try:
            return re.search(p, url, re.I) is not None
        except re.error:
            return p.lower() in url.lower()

    return any(map(hit, patterns)) if patterns else "/articles/" in url


@dataclass(frozen=True)
class Link:
    url: str
    title: str
    snippet: str
    published_at: datetime | None
    section: str = ""
    repaired: bool = False
    strategy: str = "li_listing"
    time_source: str = ""


def read_listing(html: str, base_url: str, now: datetime, patterns: list[str]) -> tuple[list[Link], dict[str, int]]:
    """(links, counts): the links of list entries, each URL once; on a page without any, links to articles."""
    page, links, seen = _Listing(), [], set()
    page.feed(html)
    page.close()
    count = dict.fromkeys(COUNTS, 0)
    count["raw_html_bytes"] = len(html.encode("utf-8", "surrogatepass"))
    for entry in page.entries:
        text = " ".join(entry.words)
        when = time_in(text, now)
        for anchor in entry.anchors:
            count["link_count"] += 1
            title, repaired = _title(anchor)
            url = _join(base_url, anchor.href)
            if url in seen:
                count["duplicate_url_count"] += 1
            elif title and url:
                seen.add(url)
                count["title_repair_count"] += repaired
                links.append(Link(url, title, text, when, entry.section, repaired))
    if not links:
        for anchor in page.anchors:
            label, url = (anchor.title or anchor.aria or " ".join(anchor.alts_and_words)).strip(), _join(base_url, anchor.href)
            if not label or not url or not is_article(url, patterns):
                continue
            count["article_link_count"] += 1
            title = _label_title(label)
            if url in seen or not title:
                continue
            seen.add(url)
            when, source = time_in(label, now), "link_label"
            if when is None and (when := _near_time(html, anchor.href, now)):
                source = "nearby_article_context"
                count["article_link_context_time_count"] += 1
            links.append(Link(url, title, label, when, strategy="article_link_fallback", time_source=source if when else ""))
        count["article_link_candidate_count"] = len(links)
    count["candidate_count"] = len(links)
    count["missing_time_count"] = sum(x.published_at is None for x in links)
    count["parse_warning_count"] = int(not page.entries and not links)
    return links, count


def _join(base: str, href: str) -> str:
    try:
        return urljoin(base, href)
    except ValueError:  # such as a broken IPv6 host
        return ""


class ListingLinks:
    """Table function of (html, base_url, discovered_at, article_patterns): a row for each link, and one of kind 'page' with the counts."""

    def eval(self, html: str | None, base_url: str | None, discovered_at: datetime, patterns: list[str] | None) -> Iterator[tuple]:
        now = discovered_at if discovered_at.tzinfo else discovered_at.replace(tzinfo=timezone.utc)
        links, count = read_listing(html or "", base_url or "", now, list(patterns or []))
        naive = lambda t: t and t.astimezone(timezone.utc).replace(tzinfo=None)
        for i, x in enumerate(links):
            yield ("link", i, x.url, x.title, x.snippet, naive(x.published_at), x.section, x.repaired, x.strategy, x.time_source, *[None] * len(COUNTS))
        strategy = "article_link_fallback" if count["article_link_candidate_count"] else "li_listing"
        yield ("page", len(links), base_url, None, None, None, None, None, strategy, None, *count.values())


listing_links = F.udtf(ListingLinks, returnType=SCHEMA)


def links_of(pages: DataFrame, url: str, html: str, discovered_at: Column, patterns: list[str] | None = None) -> DataFrame:
    """The pages' columns (without their HTML) beside the rows of ``listing_links``, whose columns are in a struct ``found``.

    A null page counts as empty: no links and one row of counts. The session's time zone has to be UTC.
    """
    wanted = F.array(*map(F.lit, patterns)) if patterns else F.array().cast("array<string>")
    sent = pages.withColumns({"_now": discovered_at, "_patterns": wanted})
    rows = sent.lateralJoin(listing_links(F.col(html).outer(), F.col(url).outer(), F.col("_now").outer(), F.col("_patterns").outer()).select(F.struct("*").alias("found")))
    return rows.drop("_now", "_patterns", html)


def section_counts(links: DataFrame, page: str) -> DataFrame:
    """(page, section_nodeid, n): links of each page by the section they stand in."""
    return links.where("found.kind = 'link' AND found.section_nodeid <> ''").groupBy(page, F.col("found.section_nodeid").alias("section_nodeid")).agg(F.count(F.lit(1)).alias("n"))
