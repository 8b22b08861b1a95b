"""Chunks of a document by headings, page markers and a character window; windows of chunks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import SLICE_ANY, SLICE_LINE, lines_of, strip


def line_kinds(text: Column, heading_levels: int = 6) -> Column:
    """Lines as structs (raw, kind, level, title, page_start, page_end); kind is marker, heading, blank or text.

    A page marker looks like a heading and is told first.
    """
    heading = rf"^#{{1,{heading_levels}}}\s+" if heading_levels >= 1 else r"^\x00$"

    # three passes, so that trimming and the marker's pattern are evaluated once a line
    bare = F.transform(lines_of(text), lambda x: F.struct(x.alias("raw"), strip(x).alias("bare")))
    kind = lambda x: F.when(x["bare"].rlike(SLICE_LINE), F.lit("marker")).when(x["bare"].rlike(heading), F.lit("heading")).when(x["bare"] == "", F.lit("blank")).otherwise(F.lit("text"))
    told = F.transform(bare, lambda x: F.struct(x["raw"].alias("raw"), x["bare"].alias("bare"), kind(x).alias("kind")))

    def one(x: Column) -> Column:
        page = lambda n: F.when(x["kind"] == "marker", F.regexp_extract(x["bare"], SLICE_ANY, n).try_cast("int"))
        is_heading = x["bare"].startswith("#")
        level = F.when(is_heading, F.length(F.regexp_extract(x["bare"], r"^(#{1,6})\s", 1))).otherwise(F.lit(0))
        title = F.when(is_heading, strip(F.regexp_replace(x["bare"], r"^#{1,6}\s+", ""))).otherwise(x["bare"])
        return F.struct(x["raw"].alias("raw"), x["kind"].alias("kind"), level.alias("level"), title.alias("title"), page(1).alias("page_start"), page(2).alias("page_end"))

    return F.transform(told, one)


_STATE = "struct<stack: array<string>, page_start: int, page_end: int, held: int, chunks: array<struct<line: int, path: array<string>, page_start: int, page_end: int>>>"


def chunk_starts(lines: Column, max_chars: int) -> Column:
    """Where chunks begin: (line number, heading path, pages), by one fold over the lines.

    ``held`` is the length of the open chunk, -1 for none. The path is a stack
    that a heading cuts to less than its own level in depth. Only a new chunk
    adds to the state, so the fold is linear in the lines.
    """
    numbered = F.transform(lines, lambda x, i: F.struct(i.cast("int").alias("n"), x["kind"].alias("kind"), x["level"].alias("level"), x["title"].alias("title"), F.length(x["raw"]).alias("size"), x["page_start"].alias("page_start"), x["page_end"].alias("page_end")))

    def state(stack, start, end, held, chunks) -> Column:
        return F.struct(stack.alias("stack"), start.alias("page_start"), end.alias("page_end"), held.alias("held"), chunks.alias("chunks")).cast(_STATE)

    def opened(acc, stack, x) -> Column:
        return F.concat(acc["chunks"], F.array(F.struct(x["n"].alias("line"), stack.alias("path"), acc["page_start"].alias("page_start"), acc["page_end"].alias("page_end"))))

    def step(acc, x) -> Column:
        stack = F.concat(F.slice(acc["stack"], 1, F.least(F.size(acc["stack"]), x["level"] - 1)), F.array(x["title"]))
        fits = (acc["held"] >= 0) & (acc["held"] + 1 + x["size"] <= max_chars)
        return (
            F.when(x["kind"] == "marker", state(acc["stack"], x["page_start"], x["page_end"], F.lit(-1), acc["chunks"]))
            .when(x["kind"] == "heading", state(stack, acc["page_start"], acc["page_end"], x["size"], opened(acc, stack, x)))
            .when(x["kind"] == "blank", acc)
            .when(fits, state(acc["stack"], acc["page_start"], acc["page_end"], acc["held"] + 1 + x["size"], acc["chunks"]))
            .otherwise(state(acc["stack"], acc["page_start"], acc["page_end"], x["size"], opened(acc, acc["stack"], x)))
        )

    empty = F.lit(None).cast("int")
    start = state(F.array().cast("array<string>"), empty, empty, F.lit(-1), F.array().cast("array<struct<line: int, path: array<string>, page_start: int, page_end: int>>"))
    return F.aggregate(numbered, start, step)["chunks"]


def build_chunks(df: DataFrame, key: str = "doc_id", text: str = "text", max_chars: int = 4500, heading_levels: int = 6, strategy: str = "auto") -> DataFrame:
    """Rows (key, chunk_id, page_start, page_end, section_path, text), without a shuffle.

    A strategy says how deep headings are read: "fixed" not at all, every other
    to ``heading_levels``. A single line over the limit becomes a chunk of its
    own. Null and empty texts have no chunk.
    """
    depth = {"fixed": 0}.get(strategy, heading_levels)
    lined = df.select(F.col(key), line_kinds(F.col(text), depth).alias("_lines")).withColumn("_starts", chunk_starts(F.col("_lines"), max_chars))

    def one(c: Column, i: Column) -> Column:
        following = F.coalesce(F.try_element_at(F.col("_starts"), (i + 2).cast("int"))["line"], F.size("_lines"))
        held = F.filter(F.slice(F.col("_lines"), c["line"] + 1, following - c["line"]), lambda x: ~x["kind"].isin("marker", "blank"))
        text = strip(F.array_join(F.transform(held, lambda x: x["raw"]), "\n"))
        return F.struct(c["page_start"].alias("page_start"), c["page_end"].alias("page_end"), c["path"].alias("section_path"), text.alias("text"))

    # chunks are made inside the row, so that no chunk carries its document along; the outer form of the
    # explosion, for from the inner one Spark infers a filter that evaluates the fold a second time
    made = lined.select(key, F.transform("_starts", one).alias("_chunks"))
    exploded = made.select(key, F.posexplode_outer("_chunks").alias("_i", "_c")).where(F.col("_i").isNotNull())
    return exploded.select(key, F.format_string("chunk_%04d", F.col("_i") + 1).alias("chunk_id"), "_c.page_start", "_c.page_end", "_c.section_path", "_c.text")


def with_breadcrumb(chunk_id: Column, page_start: Column, page_end: Column, path: Column, text: Column) -> Column:
    """A chunk as context: where it stands, its headings by depth, its text. Missing pages show as None."""
    path = F.coalesce(path, F.array().cast("array<string>"))
    pages = F.concat(F.coalesce(page_start.cast("string"), F.lit("None")), F.lit("-"), F.coalesce(page_end.cast("string"), F.lit("None")))
    meta = F.concat(F.lit("["), chunk_id, F.lit("|pages:"), pages, F.lit("|section:"), F.array_join(path, " > "), F.lit("]"))
    crumbs = F.array_join(F.transform(path, lambda t, i: F.concat(F.repeat(F.lit("#"), F.least(i + 1, F.lit(6))), F.lit(" "), t)), "\n")
    return F.when(F.size(path) > 0, F.concat(meta, F.lit("\n"), crumbs, F.lit("\n---\n"), text)).otherwise(F.concat(meta, F.lit("\n"), text))


def page_range(pages: str | None) -> tuple[int, int] | None:
    """(first, last) of "5-12" or "7", in either order; anything else is an error."""
    if not pages:
        return None
    parts = [p.strip() for p in str(pages).split("-")]
    if len(parts) > 2 or not all(p.isdigit() for p in parts):
        raise ValueError(f"bad page range {pages!r}: use e.g. 5-12 or 7")
    a, b = int(parts[0]), int(parts[-1])
    return min(a, b), max(a, b)


def on_pages(chunks: DataFrame, pages: str | None, document: str = "doc_id") -> DataFrame:
    """Chunks that overlap the pages; where a document has no page marks at all, all its chunks stay."""
    bounds = page_range(pages)
    if bounds is None:
        return chunks
    marked = chunks.where(F.col("page_start").isNotNull()).select(F.col(document).alias("_doc")).distinct()
    overlaps = (F.coalesce("page_end", "page_start") >= bounds[0]) & (F.col("page_start") <= bounds[1])
    joined = chunks.join(marked, F.col(document) == F.col("_doc"), "left")
    return joined.where(F.col("_doc").isNull() | F.coalesce(overlaps, F.lit(False))).drop("_doc")


def window_numbers(sizes: Column, budget: int) -> Column:
    """For sizes in order, where windows within the budget begin (0-based); one item over it is a window."""
    state = "struct<n: int, held: bigint, starts: array<int>>"

    def step(acc, size):
        fits = (acc["held"] > 0) & (acc["held"] + size <= budget)
        return F.struct(
            (acc["n"] + 1).alias("n"), F.when(fits, acc["held"] + size).otherwise(size).cast("bigint").alias("held"),
            F.when(fits, acc["starts"]).otherwise(F.concat(acc["starts"], F.array(acc["n"]))).alias("starts"),
        ).cast(state)

    return F.aggregate(sizes, F.struct(F.lit(0).alias("n"), F.lit(0).cast("bigint").alias("held"), F.array().cast("array<int>").alias("starts")).cast(state), step)["starts"]


def pack_windows(chunks: DataFrame, budget: int = 32000, document: str = "doc_id", order: str = "chunk_id", block: Column | None = None) -> DataFrame:
    """Rows (document, window_no, n_blocks, text): blocks in order, two line ends between, packed greedily.

    Only the blocks' sizes are gathered per document; texts meet their window by
    number, so no task holds more text than a window.
    """
    text = block if block is not None else with_breadcrumb(*(F.col(c) for c in ("chunk_id", "page_start", "page_end", "section_path", "text")))
    blocks = chunks.select(document, F.col(order).alias("_o"), F.coalesce(text, F.lit("")).alias("_b"))
    numbered = blocks.withColumn("_n", F.row_number().over(Window.partitionBy(document).orderBy("_o", "_b")))
    sizes = numbered.groupBy(document).agg(F.array_sort(F.collect_list(F.struct("_n", (F.length("_b") + 2).cast("bigint").alias("s")))).alias("_s"))
    starts = sizes.select(document, F.size("_s").alias("_all"), window_numbers(F.transform("_s", lambda x: x["s"]), budget).alias("_starts"))
    windows = starts.select(document, "_all", "_starts", F.posexplode("_starts").alias("_i", "_from"))
    until = F.coalesce(F.try_element_at("_starts", F.col("_i") + 2), F.col("_all"))
    places = windows.select(F.col(document).alias("_doc"), (F.col("_i") + 1).alias("window_no"), F.explode(F.sequence(F.col("_from") + 1, until)).alias("_m"))
    same = numbered[document].eqNullSafe(places["_doc"]) & (numbered["_n"] == places["_m"])
    held = numbered.join(places, same).groupBy(document, "window_no").agg(F.array_sort(F.collect_list(F.struct("_n", "_b"))).alias("_x"))
    return held.select(document, "window_no", F.size("_x").alias("n_blocks"), F.array_join(F.transform("_x", lambda x: x["_b"]), "\n\n").alias("text"))
