"""Collection from landed responses: a data source with a partition for each entry of a source.

A fetcher outside the engine lands responses as rows (url, status_code, content_type, text, error);
``land`` stores them by the hash of their URL. ``spark.read.format("landed")`` then collects the
sources of a catalog: feeds, listings, listings that lead on to the next page, and paged listings
behind a JSONP endpoint. Each entry is read page by page, from one response to the next, until a page
is old, empty or the last, so a task holds one page at a time, beside the row groups that its look-ups keep. Rows are of five kinds: candidate,
raw (a response that was read), error, diagnostics (of a page) and contract (what a source lacks).
"""

from __future__ import annotations

import json
import re
from bisect import bisect_right
from collections.abc import Iterator
from datetime import datetime, timedelta, timezone
from email.utils import parsedate_to_datetime
from itertools import accumulate
from urllib.parse import urlencode, urljoin
from xml.etree import ElementTree
from zlib import crc32

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from newsloom import functions as fn
from newsloom.functions.python import parse_page
from newsloom.sources.listing import COUNTS, read_listing

PARTS, ROW_GROUP = 64, 1 << 18
# Collectors by family, and the defaults of a paged listing.
FAMILIES = {"rss": ("rss",), "listing": ("listing", "media_listing"), "incremental": ("incremental_listing",), "jsonp": ("jsonp_listing", "jsonp_paged_listing")}
PAYLOAD = {"type": "updatenodelabel", "isCache": True, "cacheTime": 60, "nodeId": "{node_id}", "isNodeId": "{is_node_id}", "page": "{page}"}
NEXT_PAGE = r"href=[\"'](?P<url>[^\"']*?endIndex=\d+[^\"']*)[\"'][^>]*>\s*Load More\s*</a>"

_TEXTS = ("kind", "source_id", "collector", "url", "title", "snippet", "query", "theme_section", "section_nodeid", "entry_url", "entry_label", "entry_theme", "entry_kind", "node_id", "listing_strategy", "time_source", "content_type", "error", "next_url", "stop_reason", "text")
_INTS = ("entry_no", "page", "position", "status_code", "total_pages", *COUNTS)
SCHEMA = T.StructType(
    [T.StructField(c, T.StringType()) for c in _TEXTS]
    + [T.StructField(c, T.IntegerType()) for c in _INTS]
    + [T.StructField(c, T.BooleanType()) for c in ("title_repaired", "ok", "stale")]
    + [T.StructField(c, T.TimestampType()) for c in ("discovered_at", "published_at")]
    + [T.StructField("tags", T.ArrayType(T.StringType()))]
)


def land(responses: DataFrame, path: str, parts: int = PARTS) -> None:
    """Stores responses (url, text; status_code, content_type and error where they are there) for look-up by URL; of several for one URL the first text by order stays."""
    have = set(responses.columns)
    column = lambda c, kind, other: (F.col(c) if c in have else F.lit(other)).cast(kind).alias(c)
    rows = responses.where("url is not null").select("url", "text", column("status_code", "int", 200), column("content_type", "string", ""), column("error", "string", ""))
    one = rows.groupBy("url").agg(F.min(F.struct("text", "status_code", "content_type", "error")).alias("r")).select("url", "r.*")
    dealt = one.withColumn("part", F.pmod(F.crc32(F.col("url").cast("binary")), F.lit(parts)).cast("int")).repartition("part").sortWithinPartitions("part", "url")
    # Small row groups: a look-up reads one, however many rows its part has.
    dealt.write.mode("overwrite").option("parquet.block.size", ROW_GROUP).option("parquet.block.size.row.check.min", 4).option("parquet.page.size.row.check.min", 4).partitionBy("part").parquet(path)


class Landing:
    """Look-up of landed responses by URL: the file of a URL's part, of which the row groups that may hold it are read.

    The last row group read of each part is kept, so URLs that are asked in about their order, as the
    pages of one node are, read a group once: at most one small group for each part is held.
    """

    def __init__(self, path: str, parts: int = PARTS):
        from pyarrow import fs

        self.parts = parts
        self.held: dict[int, list] = {}
        self.bounds: dict[int, tuple[list, list, list]] = {}
        self.last: dict[int, tuple] = {}
        self.files, self.root = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path.removeprefix("file:"))

    def get(self, url: str) -> dict | None:
        part = crc32(url.encode()) % self.parts
        if part not in self.held:
            self._open(part)
        least, most, reach = self.bounds[part]
        at = bisect_right(least, url, key=lambda x: x or "") - 1
        while at >= 0 and (reach[at] is None or reach[at] >= url):  # groups of several files may overlap
            if most[at] is None or most[at] >= url:
                rows, places = self._read(part, at)
                if url in places:
                    return rows.slice(places[url], 1).to_pylist()[0]
            at -= 1
        return None

    def _open(self, part: int) -> None:
        """The row groups of a part by their least URLs, with their greatest ones and the greatest so far; None where it is not known."""
        said = [((g.row_groups[0].statistics or {}).get("url") or {"min": None, "max": None}, g) for g in self._row_groups(f"{self.root}/part={part}")]
        said.sort(key=lambda x: x[0]["min"] or "")
        least, most = [s["min"] for s, _ in said], [s["max"] for s, _ in said]
        reach = list(accumulate(most, lambda a, b: None if a is None or b is None else max(a, b)))
        self.held[part], self.bounds[part] = [g for _, g in said], (least, most, reach)

    def _read(self, part: int, at: int) -> tuple:
        """The rows of a part's row group, and the place of each URL in them."""
        if part not in self.last or self.last[part][0] != at:
            rows = self.held[part][at].to_table(use_threads=False)
            self.last[part] = (at, rows, {u: i for i, u in reversed(list(enumerate(rows["url"].to_pylist())))})
        return self.last[part][1:]

    def _row_groups(self, where: str) -> list:
        """The row groups of a part with their least and greatest URL: footers are read once."""
        import pyarrow.dataset as ds
        from pyarrow import fs

        if self.files.get_file_info(where).type != fs.FileType.Directory:
            return []
        return [g for f in ds.dataset(where, format="parquet", filesystem=self.files).get_fragments() for g in f.split_by_row_group()]


def entries_of(source: dict, family: str) -> list[dict]:
    """What a source is read from: its feeds or pages, each URL once, else its own URL; nodes of a paged listing."""
    if family == "jsonp":
        nodes = (source.get("collector_config") or {}).get("pagination_entries") or []
        named = [(str(e.get("node_id") or e.get("nodeId") or "").strip(), e) for e in nodes if isinstance(e, dict)]
        return [{"is_node_id": "true", "label": n, **e, "node_id": n} for n, e in named if n]
    word = "feed" if family == "rss" else "page"
    listed = [*(source.get(f"{word}_entries") or []), *(source.get(f"{word}_urls") or []), source.get(f"{word}_url")]
    found: dict[str, dict] = {}
    for e in [*listed, None, source.get("url")]:
        if e is None and found:
            break
        entry = dict(e) if isinstance(e, dict) else {"url": e or ""}
        url = str(entry.get("url") or entry.get("href") or "").strip()
        if url and url.lower() != "none":
            found.setdefault(url, {**entry, "url": url})
    return list(found.values())


def jsonp_url(config: dict, entry: dict, page: int) -> str:
    """The request for a page of a node: the payload's template filled in, as compact JSON in one parameter."""
    endpoint = str(config.get("pagination_url") or "").strip()
    if not endpoint:
        return ""
    texts = {"page": page, "node_id": entry.get("node_id") or "", "nodeId": entry.get("node_id") or "", "is_node_id": entry.get("is_node_id") or "true", "isNodeId": entry.get("is_node_id") or "true", "label": entry.get("label") or ""}

    def fill(value):
        if isinstance(value, dict):
            return {str(k): fill(v) for k, v in value.items()}
        if isinstance(value, list):
            return [fill(v) for v in value]
        return page if value == "{page}" else value.format(**texts) if isinstance(value, str) else value

    template = config.get("request_payload_template")
    payload = json.dumps(fill(template if isinstance(template, dict) else PAYLOAD), ensure_ascii=False, separators=(",", ":"))
    name = str(config.get("pagination_param") or "jsondata").strip() or "jsondata"
    return f"{endpoint}{'&' if '?' in endpoint else '?'}{urlencode({name: payload})}"


def jsonp_object(text: str) -> dict:
    """The object in a JSON or JSONP response; empty if there is none."""
    m = re.fullmatch(r"(?:[\w.$]+)?\((\{.*\})\)\s*;?", text.strip(), re.S)
    for body in (text, m[1] if m else ""):
        try:
            found = json.loads(body)
        except ValueError:
            continue
        return found if isinstance(found, dict) else {}
    return {}


def next_page(html: str, url: str, patterns: list[str]) -> str:
    """The URL that the first fitting pattern leads to; empty if there is none or it is this page's."""
    for p in patterns or [NEXT_PAGE]:
        try:
            m = re.search(p, html, re.I | re.S)
        except re.error:
            continue
        if m:
            found = urljoin(url, (m.groupdict().get("url") or m[1]).strip())
            if found != url:
                return found
    return ""


def is_stale(times: list[datetime | None], now: datetime, lookback_hours: float | None) -> bool:
    """Whether a page has times, and all of them are before the lookback."""
    known = [t for t in times if t]
    return bool(lookback_hours and lookback_hours > 0 and known) and max(known) < now - timedelta(hours=lookback_hours)


def contract_errors(source: dict) -> list[str]:
    """What a source lacks to be collected: an id, a known collector, an entry, an endpoint, patterns that compile."""
    family = family_of(source)
    config = source.get("collector_config") or {}
    errors = [] if str(source.get("id") or "").strip() else ["missing_id"]
    if not family:
        return [*errors, "unsupported_collector"]
    if not entries_of(source, family):
        errors.append("missing_entries")
    if family == "jsonp" and not str(config.get("pagination_url") or "").strip():
        errors.append("missing_pagination_url")
    for key in ("article_url_patterns", "next_url_patterns"):
        for p in _strings(config.get(key)):
            try:
                re.compile(p)
            except re.error:
                errors.append(f"invalid_pattern:{key}")
    return errors


def family_of(source: dict) -> str:
    name = str(source.get("collector") or "").strip()
    return next((f for f, names in FAMILIES.items() if name in names), "")


def _strings(value) -> list[str]:
    return [value] if isinstance(value, str) else [str(v) for v in value or [] if str(v).strip()]


def _number(config: dict, key: str, default: int) -> int:
    try:
        return max(int(str(config.get(key, default))), 0)
    except ValueError:
        return default


class _Entry(InputPartition):
    def __init__(self, source: dict, number: int, entry: dict | None):
        self.source, self.number, self.entry = source, number, entry


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.sources = json.loads(options["catalog"])
        self.path, self.parts, self.query = options["path"], int(options.get("parts", PARTS)), options.get("query", "")
        now = datetime.fromisoformat(options["discovered_at"].replace("Z", "+00:00"))
        self.now = now if now.tzinfo else now.replace(tzinfo=timezone.utc)
        self.lookback = float(options["lookback_hours"]) if "lookback_hours" in options else None

    def partitions(self) -> list[_Entry]:
        out = []
        for s in self.sources:
            if contract_errors(s):
                out.append(_Entry(s, -1, None))
            out += [_Entry(s, i, e) for i, e in enumerate(entries_of(s, family_of(s)))] if family_of(s) else []
        return out or [_Entry({}, -2, None)]

    def read(self, partition: _Entry) -> Iterator[tuple]:
        names = SCHEMA.fieldNames()
        for row in self._rows(partition.source, partition.number, partition.entry):
            yield tuple(row.get(c) for c in names)

    def _rows(self, source: dict, number: int, entry: dict | None) -> Iterator[dict]:
        if number == -2:
            return
        family, config = family_of(source), source.get("collector_config") or {}
        base = {"source_id": str(source.get("id") or ""), "collector": str(source.get("collector") or ""), "entry_no": number, "discovered_at": self._naive(self.now)}
        if entry is None:
            for e in contract_errors(source):
                yield {**base, "kind": "contract", "error": e}
            return
        base |= {"entry_url": entry.get("url") or None, "entry_label": entry.get("label") or entry.get("name") or None, "entry_theme": str(entry.get("theme_section") or "") or None, "entry_kind": entry.get("kind"), "node_id": entry.get("node_id")}
        tags = list(dict.fromkeys(x for x in [*_strings(source.get("tags")), *_strings(entry.get("tags")), str(entry.get("theme_section") or "").strip()] if x))
        landing, patterns = Landing(self.path, self.parts), _strings(config.get("article_url_patterns"))
        themes = {str(k): str(v) for k, v in (config.get("section_node_theme_map") or {}).items()}
        paged = family in ("incremental", "jsonp")
        last, old_pages = _number(config, "max_pages_per_entry", 3) if paged else 1, _number(config, "stale_page_stop_count", 1)
        url, seen_pages, seen, stale_run = str(entry.get("url") or ""), set(), set(), 0
        for page in range(1, last + 1):
            if family == "jsonp" and not (url := jsonp_url(config, entry, page)):
                yield {**base, "kind": "error", "page": page, "error": "missing_pagination_url"}
                return
            at = {**base, "page": page, "url": url}
            seen_pages.add(url)
            got = landing.get(url) or {"text": None, "status_code": None, "content_type": None, "error": "not_landed"}
            status, error = got["status_code"], got["error"] or ""
            ok = not error and (status is None or status < 400)
            yield {**at, "kind": "raw", "ok": ok, "status_code": status, "content_type": got["content_type"], "error": error}
            if not ok:
                yield {**at, "kind": "error", "status_code": status, "error": error or f"http_{status}"}
                return
            text, total, where = got["text"] or "", None, url
            if family == "rss":
                yield from self._feed(text, at, tags)
                return
            if family == "jsonp":
                payload = jsonp_object(text)
                total = payload.get(str(config.get("response_total_pages_field") or "totalPages"))
                total = total if isinstance(total, int) else None
                text = str(payload.get(str(config.get("response_body_field") or "body")) or "")
                where = str(source.get("page_url") or source.get("url") or "")
                if not text:
                    yield {**at, "kind": "diagnostics", "status_code": status, "total_pages": total, "candidate_count": 0, "parse_warning_count": 1, "stop_reason": "empty_body"}
                    return
            links, count = read_listing(text, where, self.now, patterns)
            if family == "incremental":
                links = [x for x in links if x.url not in seen]
                seen.update(x.url for x in links)
            for i, x in enumerate(links):
                theme = themes.get(x.section) or str(entry.get("theme_section") or "")
                yield {**at, "kind": "candidate", "position": i, "url": x.url, "title": x.title, "snippet": x.snippet, "query": self.query, "published_at": self._naive(x.published_at), "section_nodeid": x.section or None, "theme_section": theme or None, "title_repaired": x.repaired, "listing_strategy": x.strategy, "time_source": x.time_source or None, "tags": tags}
            stale = paged and is_stale([x.published_at for x in links], self.now, self.lookback)
            stale_run = stale_run + 1 if stale else 0
            following = next_page(text, url, _strings(config.get("next_url_patterns"))) if family == "incremental" else ""
            stop = "no_new_candidates" if not links else "stale_page_limit" if old_pages and stale_run >= old_pages else ""
            if family == "incremental" and not stop:
                stop = "no_next_page" if not following else "next_page_already_seen" if following in seen_pages else ""
            stop = stop or ("max_pages_reached" if paged and page >= last else "")
            yield {**at, **count, "kind": "diagnostics", "status_code": status, "content_type": got["content_type"], "total_pages": total, "stale": stale, "next_url": following or None, "stop_reason": stop or None, "listing_strategy": "article_link_fallback" if count["article_link_candidate_count"] else "li_listing"}
            if stop:
                return
            url = following

    def _feed(self, text: str, at: dict, tags: list[str]) -> Iterator[dict]:
        try:
            items = ElementTree.fromstring(text).findall(".//item")
        except ElementTree.ParseError as e:
            yield {**at, "kind": "error", "error": f"parse_error: {e}"}
            return
        said = lambda item, *names: next((t for n in names if (t := (item.findtext(n) or "").strip())), "")
        for i, item in enumerate(items):
            title, link = said(item, "title"), said(item, "link")
            if title and link:
                more = [t for c in item.findall("category") if (t := (c.text or "").strip())]
                yield {**at, "kind": "candidate", "position": i, "url": link, "title": title, "snippet": said(item, "description"), "query": self.query, "published_at": self._naive(_feed_time(said(item, "pubDate", "published"))), "theme_section": at["entry_theme"], "listing_strategy": "feed", "tags": list(dict.fromkeys([*tags, *more]))}

    @staticmethod
    def _naive(t: datetime | None) -> datetime | None:
        return t and t.astimezone(timezone.utc)


def _feed_time(text: str) -> datetime | None:
    for read in (parsedate_to_datetime, lambda x: datetime.fromisoformat(x.replace("Z", "+00:00"))):
        try:
            found = read(text)
        except (TypeError, ValueError):
            continue
        return found if found.tzinfo else found.replace(tzinfo=timezone.utc)
    return None


class LandedSource(DataSource):
    """Options: path (see ``land``), catalog (a JSON array of sources), discovered_at; lookback_hours, query, parts."""

    @classmethod
    def name(cls) -> str:
        return "landed"

    def schema(self) -> T.StructType:
        return SCHEMA

    def reader(self, schema: T.StructType) -> _Reader:
        return _Reader(dict(self.options))


def merged(collected: DataFrame) -> DataFrame:
    """One row for each source and URL (title without one), the first by entry, page and place, with all tags and entries of its repeats.

    entry_themes, entry_labels and entry_urls list those of all repeats; theme_section is that of the
    row's own entry or section, and null where the entries have several themes.
    """
    rows = collected.where("kind = 'candidate'").withColumn("_key", F.coalesce(F.nullif(fn.clean(F.col("url")), F.lit("")), fn.clean(F.col("title"))))
    place = F.struct("entry_no", "page", "position")
    ordered = lambda c: F.transform(F.array_sort(F.collect_list(F.when(F.col(c).isNotNull(), F.struct("entry_no", "page", "position", F.col(c).alias("v"))))), lambda x: x["v"])
    kept = [c for c in collected.columns if c not in ("tags", "kind")]
    out = rows.groupBy("source_id", "_key").agg(
        F.min_by(F.struct(*kept), place).alias("f"), F.count(F.lit(1)).alias("times_seen"), F.array_distinct(F.flatten(ordered("tags"))).alias("tags"),
        *(F.array_distinct(ordered(f"entry_{c}")).alias(f"entry_{c}s") for c in ("theme", "label", "url")),
    )
    section = F.when(F.size("entry_themes") > 1, F.lit(None)).otherwise(F.col("f.theme_section"))
    return out.select(*(section.alias(c) if c == "theme_section" else F.col(f"f.{c}").alias(c) for c in kept), "tags", "times_seen", "entry_themes", "entry_labels", "entry_urls")


def backfill_times(collected: DataFrame, landing: DataFrame, limit: Column | int, by: list[str] = ("source_id",)) -> DataFrame:
    """The candidates of ``collected`` with times from their own landed pages where the listing gives none.

    Of each source (or each group ``by``) the first ``limit`` candidates without a time, by entry, page
    and place, are looked up; ``backfill`` says what came of it: filled, no_time, not_landed or null.
    """
    rows = collected.where("kind = 'candidate'").withColumn("_row", F.struct(*by, "entry_no", "page", "position"))
    bare = rows.where("published_at is null and url <> ''")
    order = W.partitionBy(*by).orderBy("entry_no", "page", "position")
    first = bare.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= limit).select("_row", "url")
    detail = first.join(landing.select("url", "text"), "url", "left").withColumn("_p", parse_page("url", "text"))
    from newsloom.sources import rss_time

    found = detail.select("_row", F.col("text").isNotNull().alias("_landed"), F.when(F.col("text").isNotNull(), rss_time(F.col("_p.published"))).alias("_when"))
    both = rows.join(found, "_row", "left").drop("_row")
    said = F.when(F.col("_when").isNotNull(), "filled").when(F.col("_landed"), "no_time").when(~F.col("_landed"), "not_landed")
    return both.withColumns({"backfill": said, "published_at": F.coalesce("published_at", "_when")}).drop("_landed", "_when")
