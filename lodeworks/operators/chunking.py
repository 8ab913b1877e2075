"""Documents to chunks: recursive splitting, sentence windows, sections, tables, code and fences.

A document's chunks depend on each other in order, so the splitters see one document at a time, Arrow batch by batch;
everything after them is column arithmetic.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Separators tried in this order.
SEPARATORS = ("\n\n", "\n", " ", "")


def split_text(text: str, size: int = 1500, overlap: int = 100, separators: tuple[str, ...] = SEPARATORS) -> list[tuple[int, int]]:
    """Chunk bounds ``(start, end)`` of a text.

    The text is cut at the coarsest separator it has; pieces are packed up to ``size`` characters, a piece too large is
    cut at the next separator, and a chunk begins with the last whole pieces of the one before it, up to ``overlap``.
    """
    if overlap >= size:
        raise ValueError("overlap must be smaller than size")

    def pieces(start: int, end: int, level: int) -> list[tuple[int, int]]:
        while level < len(separators) - 1 and text.find(separators[level], start, end) < 0:
            level += 1
        mark = separators[level]
        if not mark:
            return [(i, min(i + size, end)) for i in range(start, end, max(1, size - overlap))]
        out, at = [], start
        while at < end:
            cut = text.find(mark, at, end)
            stop = end if cut < 0 else cut + len(mark)
            if stop - at > size:
                out.extend(pieces(at, stop, level + 1) if level + 1 < len(separators) else [(at, stop)])
            else:
                out.append((at, stop))
            at = stop
        return out

    chunks: list[tuple[int, int]] = []
    held: list[tuple[int, int]] = []
    for s, e in pieces(0, len(text), 0):
        if held and e - held[0][0] > size:
            chunks.append((held[0][0], held[-1][1]))
            while held and (held[-1][1] - held[0][0] > overlap or e - held[0][0] > size):
                held.pop(0)
        held.append((s, e))
    if held:
        chunks.append((held[0][0], held[-1][1]))
    trimmed = []
    for s, e in chunks:
        body = text[s:e]
        s, e = s + len(body) - len(body.lstrip()), e - len(body) + len(body.rstrip())
        if e > s and (not trimmed or trimmed[-1] != (s, e)):
            trimmed.append((s, e))
    return trimmed


def recursive_chunks(docs: DataFrame, size: int = 1500, overlap: int = 100) -> DataFrame:
    """``doc_id, chunk_index, char_start, char_end, chunk`` of ``docs(doc_id, text)``; null or blank texts have none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            for at in range(0, rows.num_rows, 256):
                piece = rows.slice(at, 256)
                ids, index, starts, ends, texts = [], [], [], [], []
                for doc, text in zip(piece.column(0).to_pylist(), piece.column(1).to_pylist(), strict=True):
                    for k, (s, e) in enumerate(split_text(text or "", size, overlap)):
                        ids.append(doc)
                        index.append(k)
                        starts.append(s)
                        ends.append(e)
                        texts.append(text[s:e])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids, pa.int64()), pa.array(index, pa.int32()), pa.array(starts, pa.int64()), pa.array(ends, pa.int64()), pa.array(texts, pa.string())], ["doc_id", "chunk_index", "char_start", "char_end", "chunk"]
                )

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, chunk_index int, char_start long, char_end long, chunk string")


def stride_chunks(docs: DataFrame, size: int = 1500, stride: int = 1400) -> DataFrame:
    """Fixed windows every ``stride`` characters, natively; the last window ends with the text."""
    n = F.length("text")
    starts = F.when(n > 0, F.sequence(F.lit(0), F.greatest(n - 1 - (size - stride), F.lit(0)), F.lit(stride)))
    out = docs.select("doc_id", "text", F.posexplode(starts).alias("chunk_index", "char_start"))
    return out.withColumn("char_end", F.least(F.col("char_start") + size, n)).withColumn("chunk", F.expr("substring(text, char_start + 1, char_end - char_start)")).drop("text")


def wider(text: str = "text", start: str = "char_start", end: str = "char_end", offset: int = 300) -> Column:
    """The chunk with ``offset`` characters around it."""
    return F.expr(f"substring({text}, greatest({start} - {offset}, 0) + 1, least({end} + {offset}, length({text})) - greatest({start} - {offset}, 0))")


def location_id(document: Column, page: Column, start: Column, end: Column, section: Column) -> Column:
    """Stable 24-digit place id; a missing page or section reads ``None``."""
    cell = lambda c: F.coalesce(c.cast("string"), F.lit("None"))
    return F.substring(F.sha2(F.concat_ws("|", cell(document), cell(page), cell(start), cell(end), cell(section)), 256), 1, 24)


def source_locator(page: Column, start: Column, end: Column) -> Column:
    return F.concat(F.lit("page="), page.cast("string"), F.lit("&char="), start.cast("string"), F.lit("-"), end.cast("string"))


def running_index(chunks: DataFrame, document: str = "doc_id", order: tuple[str, ...] = ("page", "char_start")) -> DataFrame:
    """``chunk_index`` counted per document over pages and sections."""
    return chunks.withColumn("chunk_index", F.row_number().over(Window.partitionBy(document).orderBy(*order)) - 1)


def union_boxes(chunks: DataFrame, spans: DataFrame, keys: tuple[str, ...] = ("doc_id", "page")) -> DataFrame:
    """Union of the boxes of text spans that a chunk touches: an interval join with equal keys, then minima and maxima.

    ``chunks(keys, chunk_id, char_start, char_end)``, ``spans(keys, span_start, span_end, x0, y0, x1, y1)``.
    """
    hit = chunks.join(spans, list(keys)).where("span_end > char_start and span_start < char_end")
    return hit.groupBy("chunk_id").agg(F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"))


def sections(pages: DataFrame) -> DataFrame:
    """Section rows of ``pages(doc_id, page, text, spans array<struct<start,end,title,path,level>>)``, trimmed; blank ones drop."""
    each = pages.select("doc_id", "page", "text", F.explode("spans").alias("s"))
    cut = F.expr("trim(substring(text, s.start + 1, s.end - s.start))")
    return each.select("doc_id", "page", F.col("s.title").alias("section_title"), F.col("s.path").alias("section_path"), F.col("s.level").alias("heading_level"), F.col("s.start").alias("char_start"), cut.alias("chunk")).where("chunk <> ''")


def row_text(headers: list[str], row: list[str]) -> str:
    return "; ".join(f"{h}: {c}" for h, c in zip(headers, row, strict=False) if c)


def markdown_table(headers: list[str], rows: list[list[str]]) -> str:
    cell = lambda c: str(c or "").replace("|", "\\|").replace("\n", " ")
    line = lambda cells: "| " + " | ".join(map(cell, cells)) + " |"
    return "\n".join([line(headers), line(["---"] * len(headers)), *map(line, rows)])


def table_chunks(headers: list[str], rows: list[list[str]], size: int = 1500) -> list[tuple[str, str]]:
    """``(markdown, text to embed)`` of a table: whole if small, else greedy groups of rows under a repeated header."""
    texts = [row_text(headers, r) for r in rows]
    most_rows, most_chars = max(1, size // 30), min(3 * size, 8192)
    if len(rows) <= most_rows and sum(map(len, texts)) + max(0, len(texts) - 1) <= most_chars:
        groups = [list(range(len(rows)))] if rows else []
    else:
        groups, held, used = [], [], 0
        for i, t in enumerate(texts):
            if held and (len(held) >= most_rows or used + 1 + len(t) > most_chars):
                groups.append(held)
                held, used = [], 0
            used += len(t) + (1 if held else 0)
            held.append(i)
        if held:
            groups.append(held)
    return [(markdown_table(headers, [rows[i] for i in g]), "\n".join(texts[i] for i in g)) for g in groups]


def code_chunks(code: str, size: int = 1500) -> list[str]:
    """Code whole if small, else greedy by lines; a line that is too long stays whole."""
    if len(code) <= min(3 * size, 8192):
        return [code] if code.strip() else []
    out, held = [], ""
    for line in code.splitlines(keepends=True):
        if held and len(held) + len(line) > size:
            out.append(held)
            held = ""
        held += line
    return [c for c in [*out, held] if c.strip()]


_FENCE = re.compile(r"^ {0,3}(`{3,}|~{3,})(.*)$")


def fenced_code(text: str) -> list[tuple[str, str, str]]:
    """``(kind, language, body)`` parts of a text; only fences that are closed count as code."""
    lines = text.splitlines()
    parts: list[tuple[str, str, str]] = []
    prose: list[str] = []
    i = 0
    while i < len(lines):
        m = _FENCE.match(lines[i])
        close = None
        if m:
            mark = m[1]
            for j in range(i + 1, len(lines)):
                e = _FENCE.match(lines[j])
                if e and e[1][0] == mark[0] and len(e[1]) >= len(mark) and not e[2].strip():
                    close = j
                    break
        if close is None:
            prose.append(lines[i])
            i += 1
            continue
        if any(x.strip() for x in prose):
            parts.append(("prose", "", "\n".join(prose)))
        prose = []
        parts.append(("code", m[2].strip().split(" ")[0], "\n".join(lines[i + 1 : close])))
        i = close + 1
    if any(x.strip() for x in prose):
        parts.append(("prose", "", "\n".join(prose)))
    return parts


def code_aware_chunks(docs: DataFrame, size: int = 1500, overlap: int = 100) -> DataFrame:
    """``doc_id, chunk_index, kind, chunk``: closed fences by lines, everything else by the recursive splitter."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            out: list[tuple] = []
            for doc, text in zip(rows.column(0).to_pylist(), rows.column(1).to_pylist(), strict=True):
                found = [(k, c) for k, _, body in fenced_code(text or "") for c in (code_chunks(body, size) if k == "code" else [body[s:e] for s, e in split_text(body, size, overlap)])]
                out += [(doc, i, k, c) for i, (k, c) in enumerate(found)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([o[0] for o in out], pa.int64()), pa.array([o[1] for o in out], pa.int32()), pa.array([o[2] for o in out], pa.string()), pa.array([o[3] for o in out], pa.string())], ["doc_id", "chunk_index", "kind", "chunk"]
            )

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, chunk_index int, kind string, chunk string")


def edge_noise(lines: DataFrame, least_pages: int = 3, share: float = 0.2, longest: int = 40) -> DataFrame:
    """Repeated header and footer texts: ``doc, band, norm`` on at least 3 pages and a fifth of the document's pages.

    ``lines(doc, page, band, text)``; the two bands are counted apart.
    """
    norm = F.regexp_replace(F.lower(F.trim("text")), r"[0-9\s]+", "")
    pages = lines.groupBy("doc").agg(F.countDistinct("page").alias("pages"))
    short = lines.where(F.length(F.trim("text")) <= longest).withColumn("norm", norm).where("norm <> ''")
    seen = short.groupBy("doc", "band", "norm").agg(F.countDistinct("page").alias("on"))
    return seen.join(pages, "doc").where((F.col("on") >= least_pages) & (F.col("on") >= share * F.col("pages"))).select("doc", "band", "norm", "on")


def drop_edge_noise(lines: DataFrame, noise: DataFrame) -> DataFrame:
    norm = F.regexp_replace(F.lower(F.trim("text")), r"[0-9\s]+", "")
    return lines.withColumn("norm", norm).join(noise.select("doc", "band", "norm"), ["doc", "band", "norm"], "left_anti").drop("norm")


def column_gutter(words: DataFrame) -> DataFrame:
    """Per page the best of 31 gutters between 35 and 65 % of the width, or none.

    ``words(doc, page, line, x0, x1, width)``; a gutter needs 3 lines on each side and at most 14 % crossing it, and the
    lowest of crossing share plus a tenth of the imbalance wins.
    """
    tries = F.transform(F.sequence(F.lit(0), F.lit(30)), lambda i: (0.35 + i * 0.01).cast("double"))
    at = words.select("doc", "page", "x0", "x1", "width", F.explode(tries).alias("share")).withColumn("x", F.col("share") * F.col("width"))
    sums = at.groupBy("doc", "page", "share").agg(
        F.count_if(F.col("x1") <= F.col("x")).alias("left"), F.count_if(F.col("x0") >= F.col("x")).alias("right"), F.avg(((F.col("x0") < F.col("x")) & (F.col("x1") > F.col("x"))).cast("double")).alias("crossing")
    )
    score = F.col("crossing") + 0.1 * F.abs(F.col("left") - F.col("right")) / (F.col("left") + F.col("right"))
    good = sums.where("left >= 3 and right >= 3 and crossing <= 0.14").withColumn("score", score)
    return good.groupBy("doc", "page").agg(F.min_by("share", F.struct("score", "share")).alias("gutter"))


def heading_level(size: Column, body: Column, bold_share: Column, text: Column) -> Column:
    """1 to 3 by font size against the body's, or bold; null for body text and sentences."""
    ratio = size / body
    ends = F.rlike(text, F.lit("[。.!?！？；;]$"))
    return F.when(ratio >= 1.9, 1).when(ratio >= 1.5, 2).when(((ratio >= 1.2) | (bold_share >= 0.98)) & ~ends, 3)
