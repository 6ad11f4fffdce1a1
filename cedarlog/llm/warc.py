"""WARC archives and their capture index.

Pages are written as WARC records (a repeated payload as a revisit of its first response), read back, and indexed. Each
archive yields a run of captures sorted by URL key and timestamp; ranges of keys of a bounded number of captures are dealt
to tasks, and each task merges the ascending runs that reach it with a tree of losers, so that the result is one globally
ordered history of captures per URL. Html is not shuffled.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
import uuid
from collections.abc import Iterator
from datetime import UTC, datetime, timedelta

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ids_back, materialize, scratch_path

#: Characters of records after which an archive ends (a larger record is an archive of its own).
ARCHIVE = 8 << 20
#: Repeated payloads that are sent to every task (about 150 bytes each); beyond it their pages are joined by page_id.
FIRSTS_BOUND = 200_000
#: Captures that a task merges, about.
MERGED = 100_000
EPOCH = datetime(2024, 1, 1, tzinfo=UTC)
END = "\r\n\r\n"
SOURCE = re.compile(r"^\s*(?:([a-z][a-z0-9+.-]*):)?(?://)?(?:[^/?#@]*@)?([^/?#:]*)(?::(\d+))?([^#]*)", re.I | re.S)
#: Page ids are strings in Python, where a column of numbers with a null would be one of doubles.
CAPTURE = "urlkey string, timestamp string, page_id string, url string, payload_bytes long, payload_digest string, record_type string, refers_to string, archive string, at long, size long"
NAMES = [x.split()[0] for x in CAPTURE.split(", ")]


def url_key(url: str | None) -> str:
    """Host labels in reverse, then path and query, lower-cased: ``com,example)/a?b=1``. The key of no URL is empty."""
    m = SOURCE.match(url or "")
    host = re.sub(r"^www\d*\.", "", m[2].lower())
    rest = m[4] or "/"
    return f"{','.join(reversed(host.split('.')))})/{rest.lower().lstrip('/')}" if url else ""


def _date(page_id: str | None) -> datetime:
    """Pages carry no time: a page's capture time is its id in seconds (within 30 years) from a fixed day."""
    return EPOCH + timedelta(seconds=int(page_id or 0) % 946_080_000)


def _record_id(page: str | None, digest: str, url: str | None) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page} {digest} {url}')}>"


def _uri(url: str | None) -> str:
    return re.sub(r"[\r\n]", " ", url or "")


def _record(page: str | None, url: str | None, html: str, digest: str, first: str | None, first_url: str | None) -> str:
    size = len(html.encode("utf-8", "replace"))
    head = [
        "WARC/1.1", f"WARC-Type: {'response' if first is None else 'revisit'}", f"WARC-Record-ID: {_record_id(page, digest, url)}", f"WARC-Date: {_date(page):%Y-%m-%dT%H:%M:%SZ}",
        f"WARC-Target-URI: {_uri(url)}", f"WARC-Payload-Digest: sha1:{base64.b32encode(bytes.fromhex(digest)).decode()}", f"X-Page-ID: {page or ''}", f"X-No-URL: {int(url is None)}",
    ]
    if first is None:
        return "\r\n".join([*head, "Content-Type: text/html; charset=utf-8", f"Content-Length: {size}"]) + END + html
    head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {_record_id(first, digest, first_url)}", f"WARC-Refers-To-Target-URI: {_uri(first_url)}"]
    return "\r\n".join([*head, f"X-Refers-To-Page: {first}", f"X-Payload-Length: {size}", "Content-Length: 0"]) + END


def _records(most: int):
    """Records, joined into archives of about ``most`` characters; an archive is one row."""

    def run(batches):
        held, size = [], 0
        for batch in batches:
            for row in zip(*(batch[c] for c in ("page_id", "url", "html", "digest", "first", "first_url")), strict=True):
                held.append(_record(*row))
                size += len(held[-1])
                if size >= most:
                    yield pd.DataFrame({"value": [END.join(held)]})
                    held, size = [], 0
        if held:
            yield pd.DataFrame({"value": [END.join(held)]})

    return run


def write_archives(pages: DataFrame, path: str, archive: int = ARCHIVE, firsts_bound: int = FIRSTS_BOUND) -> None:
    """One WARC record per row of ``pages`` under ``path``, in gzipped archives written by Spark, so in any store.

    Only digests of payloads that occur more than once are joined with pages: up to ``firsts_bound`` of them in every task,
    else through a shuffle of pages by their page_id, of which no single one grows with the copies of a payload."""
    rows = pages.select(F.col("page_id").cast("long").cast("string").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    rows = rows.withColumn("digest", F.sha1(F.encode("html", "UTF-8")))
    number = F.col("page_id").cast("long")
    same = rows.select("page_id", "url", "digest").groupBy("digest").agg(F.count("*").alias("n"), F.min(F.when(number.isNotNull(), F.struct(number.alias("page"), F.col("url").alias("url")))).alias("first"))
    firsts = materialize(same.filter("n > 1 AND first IS NOT NULL").select("digest", F.col("first.page").cast("string").alias("first"), F.col("first.url").alias("first_url")), "warc-firsts")
    if firsts.count() <= firsts_bound:
        known = rows.join(F.broadcast(firsts), "digest", "left")
    else:
        revisits = rows.select("page_id", "digest").distinct().join(firsts, "digest").withColumnsRenamed({"page_id": "p", "digest": "d"})
        known = rows.join(revisits, rows["page_id"].eqNullSafe(revisits["p"]) & (rows["digest"] == revisits["d"]), "left")
    own = F.col("first").isNull() | F.col("page_id").eqNullSafe(F.col("first"))  # decided here: an id is never a number in Python
    known = known.select("page_id", "url", "html", "digest", F.when(~own, F.col("first")).alias("first"), F.when(~own, F.col("first_url")).alias("first_url"))
    known.mapInPandas(_records(archive), "value string").write.option("lineSep", END).option("compression", "gzip").option("maxRecordsPerFile", 1).text(path)


def parse_records(data: bytes) -> Iterator[tuple[dict[str, str], bytes, int, int]]:
    """(headers, block, offset, size) of each record of an archive."""
    at = 0
    while at < len(data):
        split = data.index(b"\r\n\r\n", at)
        lines = data[at:split].decode("utf-8", "replace").split("\r\n")
        head = {k.lower(): v for k, _, v in (line.partition(": ") for line in lines[1:])}
        size = int(head["content-length"])
        yield head, data[split + 4 : split + 4 + size], at, split + 4 + size - at
        at = split + 8 + size


def _run(batches):
    """The captures of each archive, sorted: the archive's run."""
    for batch in batches:
        for path, content in zip(batch["path"], batch["content"], strict=True):
            captures = []
            for head, block, at, size in parse_records(gzip.decompress(content) if path.endswith(".gz") else bytes(content)):
                url = None if head["x-no-url"] == "1" else head["warc-target-uri"]
                revisit = head["warc-type"] == "revisit"
                digest = head["warc-payload-digest"].partition(":")[2]
                if not revisit and base64.b32encode(hashlib.sha1(block).digest()).decode() != digest:
                    raise ValueError(f"{path} at {at}: the payload does not match its digest")
                length = int(head["x-payload-length"]) if revisit else len(block)
                stamp = re.sub(r"\D", "", head["warc-date"])
                captures.append((url_key(url), stamp, head["x-page-id"] or None, url, length, digest, head["warc-type"], head["x-refers-to-page"] if revisit else None, path.rsplit("/", 1)[-1], at, size))
            captures.sort(key=_place)
            yield pd.DataFrame(captures, columns=NAMES)


def _place(capture: tuple) -> tuple:
    return capture[0], capture[1], capture[8], capture[9]


class LoserTree:
    """Merges k sorted lists; each step replays one path of the tree, about log2(k) comparisons."""

    def __init__(self, runs: list[list[tuple]], key):
        self.runs, self.key, self.at = runs, key, [0] * len(runs)
        self.k = len(runs)
        self.heads = [(key(r[0]), i) if r else None for i, r in enumerate(runs)]  # None: the run has ended
        self.losers = [-1] * self.k
        for i in range(self.k):
            self._replay(i)

    def _less(self, a: int, b: int) -> bool:
        if a < 0 or b < 0:  # not yet dealt: wins, so that it moves up
            return a < 0
        x, y = self.heads[a], self.heads[b]
        return x is not None and (y is None or x < y)

    def _replay(self, winner: int) -> None:
        node = (winner + self.k) // 2
        while node:
            if self._less(self.losers[node], winner):
                winner, self.losers[node] = self.losers[node], winner
            node //= 2
        self.losers[0] = winner

    def __iter__(self) -> Iterator[tuple]:
        while self.k and self.heads[best := self.losers[0]]:
            run, at = self.runs[best], self.at[best] + 1
            yield run[at - 1]
            self.at[best] = at
            self.heads[best] = (self.key(run[at]), best) if at < len(run) else None
            self._replay(best)


def _merge(batches):
    """Merges what reaches a task: rows come in ascending runs, as each archive's was sorted and a shuffle keeps the order of
    what it sends; a run ends where a row is less than the one before, so the result is in order however they come."""
    runs: list[list[tuple]] = []
    last = None
    for batch in batches:
        for row in zip(*(batch[c] for c in NAMES), strict=True):
            place = _place(row)
            if last is None or place < last:
                runs.append([])
            runs[-1].append(row)
            last = place
    out = []
    for row in LoserTree(runs, _place):
        out.append(row)
        if len(out) == 20_000:
            yield pd.DataFrame(out, columns=NAMES)
            out = []
    if out:
        yield pd.DataFrame(out, columns=NAMES)


def capture_index(spark, path: str, merged: int = MERGED) -> DataFrame:
    """The captures of all archives under ``path``, ordered by URL key, timestamp, archive and offset over all partitions.

    The number of ranges follows the number of captures, so that a task holds about ``merged`` of them; archive and offset
    split the captures of one URL too."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    runs = materialize(files.mapInPandas(_run, CAPTURE), "runs")
    ranges = max(1, -(-runs.count() // merged))
    return ids_back(runs.repartitionByRange(ranges, "urlkey", "timestamp", "archive", "at").mapInPandas(_merge, CAPTURE), "page_id", "refers_to")


def archive_pages(pages: DataFrame) -> DataFrame:
    """Writes ``pages`` to archives in the shared folder and returns the merged capture index that is read back.

    Null html is the empty payload; empty payloads are equal to each other; null urls have the empty key; of rows that
    share the least page_id of a payload all are responses; a null page_id never is a response that others revisit, and
    revisits one if there is any; an empty table gives an empty index; other columns are not read."""
    path = scratch_path(pages.sparkSession, "warc")
    write_archives(pages, path)
    return capture_index(pages.sparkSession, path)
