"""The job board's pages as a Python Data Source (S1), batch and stream.

``posting_pages`` reads landed answers, one JSON document ``{"results": [...]}`` a
page, in folders ``<path>/page=<n>/`` of any file system PyArrow can open by URI.
A few pages are a partition each; more of them are bundled by bytes, as a task costs
far more than a page.  Bundles are parsed side by side, and the page number is the
stream's offset: a restarted query goes on after its last committed page.  A page that cannot be parsed gives one row whose ``error`` says why, and
nothing else of the run is lost; :func:`split_pages` sets those rows apart.

    spark.dataSource.register(PostingPages)
    spark.read.format("posting_pages").option("path", root).load()
    spark.readStream.format("posting_pages").option("path", root).load()

A micro-batch takes the pages landed since the last one; pages are landed in their
order, a page below the offset is not read again.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

FIELDS = ("title", "description", "created", "redirect_url")
SCHEMA = ("page int, pos int, title string, description string, created string, redirect_url string, "
          "company struct<display_name:string>, location struct<display_name:string,area:array<string>>, error string")


# So many pages are read a task each; above, a task reads up to PARTITION_BYTES,
# every file counting OPEN_BYTES more, and at least LONE_PAGES tasks share the pages.
LONE_PAGES = 64
PARTITION_BYTES = 16 << 20
OPEN_BYTES = 64 << 10


def _files(path: str):
    """(file system, page -> (file, bytes)) of the pages below ``path``."""
    from pyarrow import fs
    system, root = fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)
    pages: dict[int, list[tuple[str, int]]] = {}
    for info in system.get_file_info(fs.FileSelector(root, allow_not_found=True, recursive=True)):
        folder, _, name = info.path.rpartition("/")
        number = folder.rpartition("page=")[2]
        if info.type == fs.FileType.File and not name.startswith(("_", ".")) and number.isdigit():
            pages.setdefault(int(number), []).append((info.path, info.size or 0))
    return system, pages


def _text(value) -> str | None:
    return value if value is None or isinstance(value, str) else json.dumps(value)


def parse_page(page: int, body: bytes):
    """Rows of a page, or the one row that says why it has none."""
    try:
        results = json.loads(body)["results"]
        if not isinstance(results, list):
            raise TypeError("results is no list")
        rows = []
        for pos, r in enumerate(results):
            company, location = r.get("company") or {}, r.get("location") or {}
            area = location.get("area")
            rows.append((page, pos, *[_text(r.get(f)) for f in FIELDS], (_text(company.get("display_name")),),
                         (_text(location.get("display_name")), None if area is None else [_text(a) for a in area]), None))
        return rows
    except (ValueError, KeyError, TypeError, AttributeError) as broken:
        return [(page, None, None, None, None, None, None, None, f"{type(broken).__name__}: {broken}"[:200])]


class Page:
    def __init__(self, number: int, files: list[tuple[str, int]]):
        self.number, self.files = number, [path for path, _ in files]
        self.weight = sum(size + OPEN_BYTES for _, size in files)


class Bundle(InputPartition):
    """Pages that one task reads, in their order."""

    def __init__(self, pages: list[Page]):
        self.pages = pages


def bundled(pages: list[Page]) -> list[Bundle]:
    if len(pages) <= LONE_PAGES:
        return [Bundle([p]) for p in pages]
    most = min(PARTITION_BYTES, sum(p.weight for p in pages) / LONE_PAGES)
    out, weight = [], most
    for p in pages:
        if weight + p.weight > most:
            out.append([])
            weight = 0
        out[-1].append(p)
        weight += p.weight
    return [Bundle(some) for some in out]


class _Pages:
    def __init__(self, options):
        self.path = options["path"]

    def pages(self, after: int = 0, last: int | None = None) -> list[Page]:
        _, found = _files(self.path)
        return [Page(n, sorted(files)) for n, files in sorted(found.items()) if n > after and (last is None or n <= last)]

    def read(self, partition: Bundle) -> Iterator[tuple]:
        from pyarrow import fs
        system = fs.FileSystem.from_uri(self.path)[0] if "://" in self.path or self.path.startswith("file:") \
            else fs.LocalFileSystem()
        for page in partition.pages:
            for file in page.files:                             # a page is one file, unless it was landed in pieces
                with system.open_input_stream(file) as f:
                    yield from parse_page(page.number, f.read())


class PageReader(_Pages, DataSourceReader):
    def partitions(self):
        return bundled(self.pages())


class PageStream(_Pages, DataSourceStreamReader):
    """Offsets are page numbers."""

    def initialOffset(self):
        return {"page": 0}

    def latestOffset(self):
        return {"page": max((p.number for p in self.pages()), default=0)}

    def partitions(self, start, end):
        return bundled(self.pages(start["page"], end["page"]))

    def commit(self, end):
        pass


class PostingPages(DataSource):
    @classmethod
    def name(cls):
        return "posting_pages"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return PageReader(self.options)

    def streamReader(self, schema):
        return PageStream(self.options)


def split_pages(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(postings, broken pages): rows without ``error``, and (page, error)."""
    return rows.where("error is null").drop("error"), rows.where("error is not null").select("page", "error")
