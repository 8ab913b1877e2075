"""Files to documents ``(page_content, reference, metadata)``; Spark's readers list and open the files."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Loader = Callable[[SparkSession, str], DataFrame]

#: Extensions by the loader that claims them.
EXTENSIONS = {
    "text": ("txt", "md", "markdown"), "json": ("json", "jsonl"), "csv": ("csv", "tsv"), "html": ("html", "htm"), "excel": ("xlsx", "xlsm"), "pptx": ("pptx",), "pdf": ("pdf",), "image": ("png", "jpg", "jpeg", "bmp", "webp"),
}
_DOC = "page_content string, reference string, metadata map<string,string>"


def _documents(df: DataFrame, text: Column, reference: Column, **metadata: Column) -> DataFrame:
    cells = [x for k, v in metadata.items() for x in (F.lit(k), v.cast("string"))]
    return df.select(text.alias("page_content"), reference.alias("reference"), F.create_map(*cells).alias("metadata") if cells else F.expr("cast(map() as map<string,string>)").alias("metadata"))


def load_text(spark: SparkSession, path: str) -> DataFrame:
    """A document per file, as UTF-8."""
    df = spark.read.option("recursiveFileLookup", "true").text(path, wholetext=True)
    return _documents(df, F.col("value"), F.col("_metadata.file_path"))


def load_json(spark: SparkSession, path: str, text_key: str = "text") -> DataFrame:
    """A document per object of a JSON list or of JSON lines; broken lines are dropped, other keys become metadata.

    A file whose text is no list and no lines of objects is an error.
    """
    if not text_key:
        raise ValueError("text_key is required")
    files = spark.read.option("recursiveFileLookup", "true").text(path, wholetext=True).select(F.col("value").alias("v"), F.col("_metadata.file_path").alias("f"))
    objects = "array<map<string,string>>"
    listed = files.where(F.startswith(F.ltrim("v"), F.lit("["))).select("f", F.explode(F.from_json("v", objects)).alias("o"))
    lines = files.where(~F.startswith(F.ltrim("v"), F.lit("["))).select("f", F.explode(F.split("v", "\n")).alias("l")).where(F.trim("l") != "")
    parsed = lines.select("f", F.from_json("l", "map<string,string>").alias("o"))
    both = listed.unionByName(parsed).where(F.col("o").isNotNull() & F.col("o")[text_key].isNotNull())
    return both.select(F.col("o")[text_key].alias("page_content"), F.col("f").alias("reference"), F.map_filter("o", lambda k, _: k != text_key).alias("metadata"))


def load_csv(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """A document per row, as ``column: value`` text; files are tab-separated if the first is named so."""
    first = path if isinstance(path, str) else path[0]
    df = spark.read.option("header", "true").option("recursiveFileLookup", "true").option("sep", "\t" if first.endswith("tsv") else ",").csv(path)
    names = df.columns
    text = F.concat_ws("; ", *(F.when(F.col(f"`{c}`").isNotNull(), F.concat(F.lit(f"{c}: "), F.col(f"`{c}`"))) for c in names))
    return _documents(df, text, F.col("_metadata.file_path"), kind=F.lit("row"))


def html_text(html: Column) -> Column:
    """Visible text of markup: no scripts, styles or comments, blocks on lines of their own, entities of the markup decoded."""
    bare = F.regexp_replace(html, r"(?is)<(script|style|head|nav)\b.*?</\1\s*>|<!--.*?-->", " ")
    lines = F.regexp_replace(bare, r"(?i)</?(p|div|br|li|ul|ol|h[1-6]|tr|table|article|section)\b[^>]*>", "\n")
    plain = F.regexp_replace(lines, r"<[^>]*>", " ")
    for name, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        plain = F.replace(plain, F.lit(name), F.lit(char))
    return F.trim(F.regexp_replace(F.regexp_replace(plain, r"[ \t\r\f]+", " "), r" ?\n[ \n]*", "\n"), F.lit(" \n"))


def load_html(spark: SparkSession, path: str) -> DataFrame:
    df = spark.read.option("recursiveFileLookup", "true").text(path, wholetext=True)
    return _documents(df, html_text(F.col("value")), F.col("_metadata.file_path"), kind=F.lit("html"))


def _binary(parse: Callable[[bytes, str], Iterator[tuple[str, dict[str, str]]]]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            out = [(text, path, list(meta.items())) for path, data in zip(rows.column(0).to_pylist(), rows.column(1).to_pylist(), strict=True) for text, meta in parse(data, path)]
            yield pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], pa.string()), pa.array([o[1] for o in out], pa.string()), pa.array([o[2] for o in out], pa.map_(pa.string(), pa.string()))], ["page_content", "reference", "metadata"])

    return run


def _files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "content")


_A = "{http://schemas.openxmlformats.org/drawingml/2006/main}"
_S = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_R = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"


def parse_pptx(data: bytes, path: str) -> Iterator[tuple[str, dict[str, str]]]:
    """Per slide a document for each table and one of its text frames, from the package's XML."""
    from xml.etree import ElementTree as E

    with zipfile.ZipFile(io.BytesIO(data)) as z:
        slides = sorted((int(m[1]), n) for n in z.namelist() if (m := re.fullmatch(r"ppt/slides/slide(\d+)\.xml", n)))
        for number, name in slides:
            root = E.fromstring(z.read(name))
            text = lambda e: "".join(t.text or "" for t in e.iter(f"{_A}t"))
            inside: set = set()
            for table in root.iter(f"{_A}tbl"):
                rows = [[text(c).strip() for c in row.iter(f"{_A}tc")] for row in table.iter(f"{_A}tr")]
                inside |= {id(p) for p in table.iter(f"{_A}p")}
                if rows:
                    yield "\n".join(" | ".join(r) for r in rows), {"page_number": str(number), "kind": "table"}
            frames = [s for p in root.iter(f"{_A}p") if id(p) not in inside and (s := text(p).strip())]
            if frames:
                yield "\n".join(frames), {"page_number": str(number), "kind": "text"}


def parse_xlsx(data: bytes, path: str) -> Iterator[tuple[str, dict[str, str]]]:
    """A document per visible sheet: merged cells filled, empty rows and columns dropped, cells joined by bars."""
    from xml.etree import ElementTree as E

    def place(ref: str) -> tuple[int, int]:
        m = re.match(r"([A-Z]+)(\d+)", ref)
        col = 0
        for c in m[1]:
            col = col * 26 + ord(c) - 64
        return int(m[2]), col

    with zipfile.ZipFile(io.BytesIO(data)) as z:
        shared = []
        if "xl/sharedStrings.xml" in z.namelist():
            shared = ["".join(t.text or "" for t in si.iter(f"{_S}t")) for si in E.fromstring(z.read("xl/sharedStrings.xml")).iter(f"{_S}si")]
        links = {r.get("Id"): r.get("Target") for r in E.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
        for sheet in E.fromstring(z.read("xl/workbook.xml")).iter(f"{_S}sheet"):
            if sheet.get("state", "visible") != "visible":
                continue
            target = links[sheet.get(f"{_R}id")].lstrip("/")
            root = E.fromstring(z.read(target if target.startswith("xl/") else f"xl/{target}"))
            cells: dict[tuple[int, int], str] = {}
            for c in root.iter(f"{_S}c"):
                v, f, s = c.find(f"{_S}v"), c.find(f"{_S}f"), c.find(f"{_S}is")
                value = shared[int(v.text)] if c.get("t") == "s" and v is not None else v.text if v is not None else "".join(t.text or "" for t in s.iter(f"{_S}t")) if s is not None else f"={f.text}" if f is not None and f.text else ""
                if value:
                    cells[place(c.get("r"))] = value
            for m in root.iter(f"{_S}mergeCell"):
                (r0, c0), (r1, c1) = (place(x) for x in m.get("ref").split(":"))
                for r in range(r0, r1 + 1):
                    for c in range(c0, c1 + 1):
                        cells.setdefault((r, c), cells.get((r0, c0), ""))
            cells = {k: v for k, v in cells.items() if v}
            if cells:
                cols = sorted({c for _, c in cells})
                lines = [" | ".join(cells.get((r, c), "") for c in cols) for r in sorted({r for r, _ in cells})]
                yield "\n".join(lines), {"sheet": sheet.get("name"), "kind": "table"}


def load_pptx(spark: SparkSession, path: str) -> DataFrame:
    return _files(spark, path).mapInArrow(_binary(parse_pptx), _DOC)


def load_excel(spark: SparkSession, path: str) -> DataFrame:
    return _files(spark, path).mapInArrow(_binary(parse_xlsx), _DOC)


def unavailable(kind: str) -> Loader:
    """A loader whose parser or model is not part of this repository; ``LoaderRegistry.replace`` takes one."""

    def load(spark: SparkSession, path: str) -> DataFrame:
        raise NotImplementedError(f"{kind} files need a parser; register one with LoaderRegistry.replace({kind!r}, loader)")

    return load


class LoaderRegistry:
    """Extensions to loaders; every extension belongs to exactly one."""

    def __init__(self) -> None:
        self._loaders: dict[str, Loader] = {}
        self._by_extension: dict[str, str] = {}
        named = {"text": load_text, "json": load_json, "csv": load_csv, "html": load_html, "excel": load_excel, "pptx": load_pptx}
        for kind, extensions in EXTENSIONS.items():
            self.register(kind, named.get(kind, unavailable(kind)), extensions)

    def register(self, kind: str, loader: Loader, extensions: tuple[str, ...]) -> None:
        taken = [e for e in extensions if e.lower() in self._by_extension]
        if taken:
            raise ValueError(f"extensions {taken} are claimed already")
        self._loaders[kind] = loader
        self._by_extension |= {e.lower(): kind for e in extensions}

    def replace(self, kind: str, loader: Loader) -> None:
        if kind not in self._loaders:
            raise KeyError(kind)
        self._loaders[kind] = loader

    def kind_of(self, name: str) -> str:
        extension = name.rsplit(".", 1)[-1].lower() if "." in name else ""
        if extension not in self._by_extension:
            raise ValueError(f"no loader for {name!r}")
        return self._by_extension[extension]

    def load(self, spark: SparkSession, path: str) -> DataFrame:
        return self._loaders[self.kind_of(path)](spark, path)

    def load_directory(self, spark: SparkSession, path: str, extensions: list[str] | None = None) -> DataFrame:
        """All files below a folder whose extension is registered (or listed), one scan per kind.

        The listing is Spark's; only names of files to read come to the driver, as they do for any scan.
        """
        extension = F.lower(F.element_at(F.split("path", r"\."), -1))
        paths: dict[str, list[str]] = {}
        for r in scan_directory(spark, path).select("path", extension.alias("e")).orderBy("path").collect():
            if r["e"] in self._by_extension and (extensions is None or r["e"] in extensions):
                paths.setdefault(self._by_extension[r["e"]], []).append(r["path"])
        if not paths:
            raise ValueError(f"nothing to load in {path}")
        parts = [self._loaders[kind](spark, names) for kind, names in sorted(paths.items())]
        out = parts[0]
        for part in parts[1:]:
            out = out.unionByName(part)
        return out


def scan_directory(spark: SparkSession, path: str) -> DataFrame:
    """``path, length, modificationTime`` of files, without their contents."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length", "modificationTime")


#: File signatures by family.
SIGNATURES = (("pdf", b"%PDF-"), ("zip", b"PK\x03\x04"), ("ole", b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1"), ("png", b"\x89PNG\r\n\x1a\n"), ("jpeg", b"\xff\xd8\xff"), ("gif", b"GIF8"), ("bmp", b"BM"), ("gzip", b"\x1f\x8b"))


def container_family(content: Column) -> Column:
    """Family of a file by its first bytes, natively; text if four fifths of its first kilobyte are printable."""
    out = F.when(F.octet_length(content) == 0, "empty")
    for name, magic in SIGNATURES:
        out = out.when(F.substring(content, 1, len(magic)) == F.lit(bytearray(magic)), name)
    head = F.decode(F.substring(content, 1, 1024), "ISO-8859-1")
    printable = F.length(F.regexp_replace(head, r"[^\t\n\r\x20-\x7e\x80-\xff]", ""))
    return out.when(printable >= 0.8 * F.length(head), "text").otherwise("binary")


#: The family that an extension must have.
FAMILY_OF = {"pdf": "pdf", "xlsx": "zip", "xlsm": "zip", "pptx": "zip", "docx": "zip", "png": "png", "jpg": "jpeg", "jpeg": "jpeg", "bmp": "bmp", "txt": "text", "md": "text", "json": "text", "jsonl": "text", "csv": "text", "html": "text", "htm": "text"}


def upload_verdict(name: Column, content: Column) -> Column:
    """``accepted``, ``conflict`` (the contents are of another family) or ``unsupported``."""
    extension = F.lower(F.element_at(F.split(name, r"\."), -1))
    family = F.create_map(*(x for k, v in FAMILY_OF.items() for x in (F.lit(k), F.lit(v))))[extension]
    return F.when(family.isNull(), "unsupported").when(family == container_family(content), "accepted").otherwise("conflict")
