"""Adapters to what lies outside: recognition engines, model services, announcement sites.

An adapter is a plain function; the operators here run it over Arrow batches with
bounded concurrency and turn whatever it raises into an error column, so that a
lost call is a row and a lost executor repeats only its own rows.
"""

from __future__ import annotations

import fnmatch
import os
import time
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from typing import Protocol

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import headings

#: Engines by name: (path, content) to pages of text; others register theirs.
ENGINES: dict[str, Callable[[str, bytes], list[str]]] = {}
#: Announcement sources by name: (company, year, report type) to rows (title, url).
DOWNLOADS: dict[str, Callable[[str, int, str], list[tuple[str, str]]]] = {}


def register(table: dict, name: str):
    def keep(f):
        table[name] = f
        return f

    return keep


@register(ENGINES, "text")
def text_engine(path: str, content: bytes) -> list[str]:
    """The engine for files that are text already; a form feed ends a page."""
    return content.decode("utf-8-sig", "replace").split("\f")


def _guarded(call: Callable, *args) -> tuple[object, str]:
    try:
        return call(*args), ""
    except Exception as e:  # noqa: BLE001 - whatever an adapter raises becomes the error column
        return None, f"{type(e).__name__}: {e}"


def recognise(files: DataFrame, engine: str, max_inflight: int = 4) -> DataFrame:
    """Rows (path, page, text, error): the pages that an engine reads in each file (path, content); one row with the error if it fails."""
    call = ENGINES[engine]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with ThreadPoolExecutor(max_inflight) as pool:
            for batch in batches:
                paths = batch.column(0).to_pylist()
                for path, (pages, error) in zip(paths, pool.map(lambda pc: _guarded(call, *pc), zip(paths, batch.column(1).to_pylist()))):
                    rows = [(path, i + 1, text, "") for i, text in enumerate(pages)] if pages else [(path, None, None, error or "no pages")]
                    yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.string(), pa.int32(), pa.string(), pa.string()))], names=["path", "page", "text", "error"])

    return files.select("path", "content").mapInArrow(run, "path string, page int, text string, error string")


def describe(images: DataFrame, describer: Callable[[str, str], str], max_inflight: int = 4) -> DataFrame:
    """Rows (ref, status, text) of distinct images (ref, path, context): ok, empty, failed, or missing where there is no path."""

    def one(row: tuple) -> tuple[str, str | None]:
        ref, path, context = row
        if path is None:
            return "missing", None
        text, error = _guarded(describer, path, context or "")
        return ("failed", None) if error else ("ok", text) if (text or "").strip() else ("empty", "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with ThreadPoolExecutor(max_inflight) as pool:
            for batch in batches:
                rows = list(zip(*(batch.column(i).to_pylist() for i in range(3))))
                found = list(pool.map(one, rows))
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.string())], names=["ref", "status", "text"])

    return images.select("ref", "path", "context").mapInArrow(run, "ref string, status string, text string")


class JobService(Protocol):
    """A recognition service that works on jobs."""

    def request(self, name: str) -> str:
        """A new job's id."""

    def upload(self, job: str, name: str, content: bytes) -> None: ...

    def poll(self, job: str) -> str:
        """"done", "failed", or anything else while the job runs."""

    def fetch(self, job: str) -> list[str]:
        """The pages of a job that is done."""


def job_engine(service: JobService, interval: float = 8.0, deadline: float = 1800.0, sleep: Callable[[float], None] = time.sleep) -> Callable[[str, bytes], list[str]]:
    """An engine that asks a service: request, upload, poll every ``interval`` seconds up to ``deadline``, fetch."""

    def call(path: str, content: bytes) -> list[str]:
        job = service.request(os.path.basename(path))
        service.upload(job, os.path.basename(path), content)
        waited = 0.0
        while (state := service.poll(job)) != "done":
            if state == "failed" or waited >= deadline:
                raise RuntimeError(f"job {job} {'failed' if state == 'failed' else 'took too long'}")
            sleep(interval)
            waited += interval
        return service.fetch(job)

    return call


def documents_of(pages: DataFrame) -> DataFrame:
    """Rows (path, text, error): the pages of each file in order, each under a marker of its number; the first error if one failed."""
    part = F.concat(F.format_string("# --- PDF 物理切片：第 %d - %d 页 ---", "page", "page"), F.lit("\n\n"), F.coalesce("text", F.lit("")))
    listed = F.array_sort(F.collect_list(F.when(F.col("page").isNotNull(), F.struct("page", part.alias("part")))))
    return pages.groupBy("path").agg(F.array_join(F.transform(listed, lambda p: p["part"]), "\n\n").alias("text"), F.coalesce(F.max(F.nullif("error", F.lit(""))), F.lit("")).alias("error"))


def convert(files: DataFrame, engine: str, language: str = "zh", max_inflight: int = 4) -> DataFrame:
    """Rows (path, text, error) of files (path, content): recognised by the named engine, joined by page, headings releveled.

    Leave out files that have an output already with ``files.pending`` first. An
    unknown engine is an error that names those that exist.
    """
    if engine not in ENGINES:
        raise ValueError(f"no engine {engine}; there are {', '.join(sorted(ENGINES))}")
    joined = documents_of(recognise(files, engine, max_inflight))
    return headings.relevel(joined, language=language, promote=False)


def announcements(wanted: DataFrame, source: str, max_inflight: int = 4) -> DataFrame:
    """Rows (company, year, title, url, error): what an announcement source lists for each wanted (company, year, report_type); an error or "nothing found" is a row."""
    call = DOWNLOADS[source]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with ThreadPoolExecutor(max_inflight) as pool:
            for batch in batches:
                rows = list(zip(*(batch.column(i).to_pylist() for i in range(3))))
                out = []
                for (company, year, _), (found, error) in zip(rows, pool.map(lambda r: _guarded(call, *r), rows)):
                    out += [(company, year, title, url, "") for title, url in found or []] or [(company, year, None, None, error or "nothing found")]
                types = (pa.string(), pa.int32(), pa.string(), pa.string(), pa.string())
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate(types)], names=["company", "year", "title", "url", "error"])

    return wanted.select("company", F.col("year").cast("int"), "report_type").mapInArrow(run, "company string, year int, title string, url string, error string")


def folder_source(root: str) -> Callable[[str, int, str], list[tuple[str, str]]]:
    """A source of files that people laid down: the first pattern that matches any name gives its files."""

    def call(company: str, year: int, report_type: str) -> list[tuple[str, str]]:
        names = sorted(os.listdir(root))
        for pattern in (f"*{company}*{year}*{report_type}*", f"*{company}*{year}*", f"*{company}*"):
            found = [n for n in names if fnmatch.fnmatch(n.lower(), pattern.lower())]
            if found:
                return [(n, os.path.join(root, n)) for n in found]
        return []

    return call
