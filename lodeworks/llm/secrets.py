"""Secret scan with corpus-wide ownership frequency.

Every text is scanned once. The base spans are fixed patterns; further candidates are long mixed-alphabet runs of high
entropy. Hashes of all candidate values are then aggregated over the whole corpus by distinct repositories and owners:
a value that a wide share of all owners and of all repositories hold in texts of their own is a copied example, any other value of a base span is live-looking whatever its characters,
and any other further candidate is if it looks random. The method adds a ``live`` span for candidates of the latter kind that no base span covers.

Defined cases: a null text is empty (no spans, digest of the empty string); a null repository or owner counts as one
of its own; exact copies of a text count once, for the first of their owners and repositories; among four owners or fewer
one owner is a wide share, so that a text copied from one to another is an example there; repeated rows each get their result; ``doc_id`` may be null or repeated, since rows are told apart by an
internal number; texts are scanned whole; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructType

from lodeworks.llm import common

#: The base kinds in their order.
KINDS = ("assign", "access", "hex")
ASSIGN = r"""((?ai:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
#: Further candidates: runs of this alphabet and length with all three character classes and this many bits a character.
RUN = r"[A-Za-z0-9+/_-]{24,}"
LEAST_BITS = 3.0
#: Share of all owners and of all repositories that makes a value a copied example.
WIDE = 0.25

_assign = re.compile(ASSIGN).finditer
_access = re.compile(r"AKIA[A-Z0-9]{12,}").finditer  # the run is taken whole, so this is the 16+ filter
_hex = re.compile(r"[0-9a-f]{32,}").finditer  # likewise
_run = re.compile(RUN).finditer
_sign = re.compile(r"[:=]").search


def entropy(value: str) -> float:
    n = len(value)
    return -sum(c / n * math.log2(c / n) for c in Counter(value).values()) if n else 0.0


def _hash(value: str) -> str:
    return hashlib.sha256(value.encode()).hexdigest()[:32]


def scan(text: str) -> tuple[list[tuple[int, int, str]], list[tuple[int, int, str]]]:
    """Base spans ``(start, end, kind)`` in order, and candidates ``(start, end, value)`` with the values of base spans."""
    base: list[tuple[int, int, int]] = []
    values: list[tuple[int, int, str]] = []
    if _sign(text):
        for m in _assign(text):
            if len(m[2]) >= 8:
                base.append((m.start(), 0, m.end()))
                values.append((m.start(), m.end(), m[2]))
    if "AKIA" in text:
        for m in _access(text):
            base.append((m.start(), 1, m.end()))
            values.append((m.start(), m.end(), m[0]))
    for m in _hex(text):
        base.append((m.start(), 2, m.end()))
        values.append((m.start(), m.end(), m[0]))
    base.sort()
    for m in _run(text):
        v = m[0]
        if any(c.isdigit() for c in v) and any(c.islower() for c in v) and any(c.isupper() for c in v) and entropy(v) >= LEAST_BITS and not any(s < m.end() and m.start() < e for s, _, e in base):
            values.append((m.start(), m.end(), v))
    return [(s, e, KINDS[k]) for s, k, e in base], values


def render(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{kind}:{s}:{e}" for s, e, kind in spans)


_SCANNED = "doc_id long, n_assign long, n_access long, n_hex long, base string, candidates array<struct<hash:string,start:bigint,end:bigint,base:boolean,bits:double>>, same string"


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    shape = pa.list_(pa.struct([("hash", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("base", pa.bool_()), ("bits", pa.float64())]))
    for rows, texts in common.documents_in_pieces(batches, 1):
        found = [scan(t) for t in texts]
        kinds = [Counter(k for _, _, k in base) for base, _ in found]
        covered = [{(s, e) for s, e, _ in base} for base, _ in found]
        candidates = [
            [{"hash": _hash(v), "start": s, "end": e, "base": (s, e) in c, "bits": entropy(v)} for s, e, v in values] for (_, values), c in zip(found, covered, strict=True)
        ]
        yield pa.RecordBatch.from_arrays(
            [
                rows.column(0),
                *(pa.array([k[x] for k in kinds], pa.int64()) for x in KINDS),
                pa.array([render(b) for b, _ in found], pa.string()),
                pa.array(candidates, shape),
                pa.array([_hash(t) if v else None for t, (_, v) in zip(texts, found, strict=True)], pa.string()),
                rows.column(2),
                rows.column(3),
            ],
            ["doc_id", "n_assign", "n_access", "n_hex", "base", "candidates", "same", "repo", "owner"],
        )


def _holders(rows: DataFrame, *more: str) -> DataFrame:
    return rows.select(*more, F.coalesce("repo", F.lit("\0")).alias("repo"), F.coalesce("owner", F.lit("\0")).alias("owner")).distinct()


def ownership(candidates: DataFrame, docs: DataFrame) -> DataFrame:
    """Distinct owners of each candidate hash over the corpus, and the shares of all owners and repositories in ``docs``.

    The shares count every distinct text (``same``) once. Repeats are merged before the first shuffle, then counted; no
    group is gathered.
    """
    holders = _holders(candidates, "hash", "same")
    owners = holders.select("hash", "owner").distinct().groupBy("hash").agg(F.count("*").alias("owners"))
    texts = holders.groupBy("hash", "same").agg(F.min(F.struct("owner", "repo")).alias("first")).select("hash", "first.*")
    by = lambda name: texts.select("hash", name).distinct().groupBy("hash").agg(F.count("*").alias(f"{name}s_apart"))
    # one row
    every = _holders(docs).agg(F.countDistinct("owner").alias("all_owners"), F.countDistinct("repo").alias("all_repos"))
    told = owners.join(by("owner"), "hash").join(by("repo"), "hash").crossJoin(F.broadcast(every))
    return told.select("hash", "owners", (F.col("owners_apart") / F.col("all_owners")).alias("owner_share"), (F.col("repos_apart") / F.col("all_repos")).alias("repo_share"))


def _copied(copied_owners: int, wide: float) -> Column:
    return (F.col("owners") >= copied_owners) & (F.col("owner_share") >= wide) & (F.col("repo_share") >= wide)


def scan_corpus(docs: DataFrame, repo: str = "repo", owner: str = "owner", copied_owners: int = 2, least_bits: float = LEAST_BITS, wide: float = WIDE) -> DataFrame:
    """One row per document with base and added spans and the number of live-looking and copied values.

    A value held by ``copied_owners`` owners or more, and by a share of ``wide`` or more of all owners and of all
    repositories in texts of their own, is a copied example. Any other is live-looking when a base span holds it or it has
    ``least_bits`` bits a character. Returns ``doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_live, n_copied,
    live array<struct<start,end>>``.
    """
    cols = docs.select("doc_id", "text", F.col(repo).cast("string").alias("repo"), F.col(owner).cast("string").alias("owner"))
    scanned = common.settle(cols.mapInArrow(_scan, f"{_SCANNED}, repo string, owner string").withColumn("row", F.monotonically_increasing_id()), "secret-scan")
    flat = scanned.where(F.size("candidates") > 0).select("row", "repo", "owner", "same", F.explode("candidates").alias("c")).select("row", "repo", "owner", "same", "c.*")
    copied = _copied(copied_owners, wide)
    judged = flat.join(ownership(flat, scanned), "hash").select(
        "row", F.struct("start", "end", "base").alias("at"), (~copied & (F.col("base") | (F.col("bits") >= least_bits))).alias("live"), copied.alias("copied")
    )
    # bounded by the candidates of one document
    per_row = judged.groupBy("row").agg(
        F.array_sort(F.collect_list(F.when(F.col("live"), F.col("at")))).alias("live"), F.count_if("live").alias("n_live"), F.count_if("copied").alias("n_copied")
    )
    return _finish(scanned.join(per_row, "row", "left"))


def _mark(batches: Iterator[pa.RecordBatch], at: int, with_candidates: bool, names: tuple[str, str] = ("candidates", "same")) -> Iterator[pa.RecordBatch]:
    """Rows with (or without) candidates; those with them carry their candidates."""
    shape = pa.list_(pa.struct([("hash", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("base", pa.bool_()), ("bits", pa.float64())]))
    for rows, texts in common.documents_in_pieces(batches, at):
        found = [scan(t) for t in texts]
        hit = [bool(values) for _, values in found]
        kept = rows.filter(pa.array(hit if with_candidates else [not h for h in hit], pa.bool_()))
        if with_candidates:
            covered = [{(s, e) for s, e, _ in base} for base, values in found if values]
            cells = [
                [{"hash": _hash(v), "start": s, "end": e, "base": (s, e) in c, "bits": entropy(v)} for s, e, v in values]
                for (_, values), c in zip((f for f in found if f[1]), covered, strict=True)
            ]
            same = [_hash(t) for t, h in zip(texts, hit, strict=True) if h]
            kept = pa.RecordBatch.from_arrays([*kept.columns, pa.array(cells, shape), pa.array(same, pa.string())], [*kept.schema.names, *names])
        yield kept


def _blank(text: str, spans: list[tuple[int, int]]) -> str:
    out, at = [], 0
    for s, e in spans:
        if e <= at:
            continue
        out += [text[at : max(s, at)], "[SECRET]"]
        at = e
    return "".join([*out, text[at:]])


def redact(docs: DataFrame, repo: Column, owner: Column, copied_owners: int = 2, least_bits: float = LEAST_BITS, wide: float = WIDE) -> DataFrame:
    """``docs`` with live-looking values replaced by ``[SECRET]``; copied examples and all other rows stay as they are.

    Only rows with candidates take part in joins, so texts without any are never shuffled. Columns of any name stay.
    """
    columns, at = docs.columns, docs.columns.index("text")
    candidates_, same_, row_, repo_, owner_, live_ = common.fresh(columns, "candidates", "same", "row", "repo", "owner", "live")
    more = StructType([*docs.schema.fields]).add(candidates_, ArrayType(StructType().add("hash", "string").add("start", "long").add("end", "long").add("base", "boolean").add("bits", "double"))).add(same_, "string")
    hit = common.settle(docs.mapInArrow(lambda b: _mark(b, at, True, (candidates_, same_)), more).withColumns({row_: F.monotonically_increasing_id(), repo_: repo.cast("string"), owner_: owner.cast("string")}), "secret-rows")
    flat = hit.select(F.col(row_).alias("row"), F.col(repo_).alias("repo"), F.col(owner_).alias("owner"), F.col(same_).alias("same"), F.explode(candidates_).alias("c")).select("row", "repo", "owner", "same", "c.*")
    held = ownership(flat, docs.select(repo.cast("string").alias("repo"), owner.cast("string").alias("owner")))
    live = flat.join(held, "hash").where(~_copied(copied_owners, wide) & (F.col("base") | (F.col("bits") >= least_bits)))
    spans = live.groupBy(F.col("row").alias(row_)).agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias(live_))
    joined = hit.join(spans, row_, "left").select(*columns, F.coalesce(live_, F.expr("cast(array() as array<struct<start:bigint,end:bigint>>)")).alias(live_))

    def replaced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            texts = [None if t is None else _blank(t, [(x["start"], x["end"]) for x in s]) for t, s in zip(rows.column(at).to_pylist(), rows.column(len(columns)).to_pylist(), strict=True)]
            arrays = [*rows.columns[: len(columns)]]
            arrays[at] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays(arrays, columns)

    return docs.mapInArrow(lambda b: _mark(b, at, False), docs.schema).unionByName(joined.mapInArrow(replaced, docs.schema))


def _finish(joined: DataFrame) -> DataFrame:
    live = F.coalesce("live", F.expr("array()"))
    added = F.transform(F.filter(live, lambda x: ~x["base"]), lambda x: F.struct(x["start"].cast("long").alias("s"), F.lit(3).alias("k"), x["end"].cast("long").alias("e"), F.lit("live").alias("kind")))
    base = F.transform(
        F.filter(F.split("base", ","), lambda x: x != ""),
        lambda x: F.struct(
            F.split(x, ":")[1].cast("long").alias("s"),
            F.array_position(F.array(*map(F.lit, KINDS)), F.split(x, ":")[0]).cast("int").alias("k"),
            F.split(x, ":")[2].cast("long").alias("e"),
            F.split(x, ":")[0].alias("kind"),
        ),
    )
    both = F.when(F.size(added) == 0, F.col("base")).otherwise(
        F.array_join(F.transform(F.array_sort(F.concat(base, added)), lambda x: F.concat_ws(":", x["kind"], x["s"].cast("string"), x["e"].cast("string"))), ",")
    )
    return joined.select(
        "doc_id",
        "n_assign",
        "n_access",
        "n_hex",
        F.sha2("base", 256).alias("base_sha256"),
        both.alias("spans"),
        F.coalesce("n_live", F.lit(0)).cast("long").alias("n_live"),
        F.coalesce("n_copied", F.lit(0)).cast("long").alias("n_copied"),
        F.transform(live, lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"))).alias("live"),
        "row",
    ).drop("row")


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``source`` is the owner; a source's files of one language are a repository."""
    docs = common.table(spark, sf_dir, "documents").withColumn("repo", F.concat_ws("/", F.coalesce("source", F.lit("\0")), F.coalesce("lang", F.lit("\0"))))
    return scan_corpus(docs, "repo", "source").drop("live")
