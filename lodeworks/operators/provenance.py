"""Content-addressed identities: canonical digests, evidence and index identity, manifests, audit diffs, usage."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodeworks.functions.arrow import arrow_function


def canonical(value) -> str:
    """JSON with sorted keys and no spaces."""
    return json.dumps(value, ensure_ascii=False, separators=(",", ":"), sort_keys=True)


@arrow_function("string")
def canonical_json(texts: pd.Series) -> pd.Series:
    """Canonical form of JSON texts; what is no JSON becomes null. Key order is not a matter that Spark's writer can settle."""

    def one(t: str | None) -> str | None:
        try:
            return None if t is None else canonical(json.loads(t))
        except ValueError:
            return None

    return texts.map(one)


def digest(text: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(text, 256))


def struct_digest(**fields: Column) -> Column:
    """Digest of named values, natively: names are written in order, nulls are kept."""
    return digest(F.to_json(F.struct(*(v.alias(k) for k, v in sorted(fields.items()))), {"ignoreNullFields": "false"}))


def manifest_version(members: DataFrame, key: str, content: str) -> DataFrame:
    """Per collection a version that depends on its contents and not on their order, and the number of members.

    Hashes are folded by partial aggregation (sum and xor of 64-bit halves and the count), so no collection is gathered.
    """
    h = F.sha2(F.coalesce(F.col(content).cast("string"), F.lit("")), 256)
    part = lambda at: F.conv(F.substring(h, at, 15), 16, 10).cast("decimal(20,0)")
    per = members.groupBy(key).agg(F.count("*").alias("n"), F.sum(part(1)).alias("a"), F.sum(part(16)).alias("b"), F.sum(part(31)).alias("c"))
    return per.select(key, "n", F.sha2(F.concat_ws("|", F.col("n").cast("string"), *(F.col(x).cast("string") for x in "abc")), 256).alias("version"))


def evidence_identity(hits: DataFrame, most: int = 20) -> DataFrame:
    """Per query an ordered digest of its evidence: complete if there are no more than ``most`` items and all name a source.

    ``hits(qid, pos, text, source, locator)``; the list is bounded before it is gathered.
    """
    item = F.concat_ws("|", F.sha2(F.coalesce("text", F.lit("")), 256), F.coalesce("source", F.lit("")), F.coalesce("locator", F.lit("")))
    per = hits.groupBy("qid").agg(
        F.count("*").alias("n"), F.count_if(F.col("source").isNull()).alias("open"), F.array_sort(F.collect_list(F.when(F.col("pos") <= most, F.struct("pos", item.alias("item"))))).alias("items")
    )
    status = F.when((F.col("n") <= most) & (F.col("open") == 0), "complete").otherwise("partial")
    return per.select("qid", F.least("n", F.lit(most)).cast("long").alias("n"), status.alias("status"), F.sha2(F.array_join(F.transform("items", lambda x: x["item"]), "\n"), 256).alias("digest"))


def index_identity(collections: DataFrame, most: int = 32) -> DataFrame:
    """One row: sorted manifests of the collections of a request; partial if one lacks a manifest or there are too many."""
    per = collections.agg(F.count("*").alias("n"), F.count_if(F.col("manifest").isNull()).alias("open"), F.array_sort(F.collect_set(F.struct("collection", "manifest"))).alias("m"))
    status = F.when(F.col("n") == 0, "dynamic_unbound").when((F.col("open") > 0) | (F.col("n") > most), "partial").otherwise("complete")
    return per.select("n", status.alias("status"), F.sha2(F.to_json(F.slice("m", 1, most)), 256).alias("digest"))


def changes(before, after, path: str = "") -> list[tuple[str, str | None, str | None]]:
    """JSON-pointer differences, keys in order, lists by position."""
    todo, out = [(path, before, after)], []
    while todo:
        at, old, new = todo.pop()
        if old == new and type(old) is type(new):
            continue
        if isinstance(old, dict) and isinstance(new, dict):
            names = sorted({*old, *new}, key=str, reverse=True)
            todo += [(f"{at}/{str(k).replace('~', '~0').replace('/', '~1')}", old.get(k), new.get(k)) for k in names]
        elif isinstance(old, list) and isinstance(new, list):
            cell = lambda xs, i: xs[i] if i < len(xs) else None
            todo += [(f"{at}/{i}", cell(old, i), cell(new, i)) for i in reversed(range(max(len(old), len(new))))]
        elif old != new:
            out.append((at or "/", None if old is None else canonical(old), None if new is None else canonical(new)))
    return out


@arrow_function("array<struct<field:string,before:string,after:string>>")
def audit_diff(before: pd.Series, after: pd.Series) -> pd.Series:
    """Differences of two JSON texts; a missing or broken text counts as null."""

    def load(t: str | None):
        try:
            return None if t is None else json.loads(t)
        except ValueError:
            return None

    return pd.Series([[{"field": f, "before": b, "after": a} for f, b, a in changes(load(x), load(y))] for x, y in zip(before, after, strict=True)])


def usage_rollup(calls: DataFrame, stage: str, fields: list[str]) -> DataFrame:
    """Token fields summed per stage; missing counts are 0."""
    return calls.groupBy(stage).agg(F.count("*").alias("calls"), *(F.coalesce(F.sum(f), F.lit(0)).cast("long").alias(f) for f in fields))


def budget_admission(requests: DataFrame, calls: int, tokens: int) -> DataFrame:
    """Sequential admission against call and token budgets per ``run``; a refused request consumes nothing.

    ``requests(run, seq, cost)``: what is left depends on every earlier decision, so a run's requests, a bounded trace, are
    replayed together.
    """

    def replay(pdf: pd.DataFrame) -> pd.DataFrame:
        left_calls, left, out = calls, tokens, []
        for r in pdf.sort_values("seq").itertuples():
            ok = left_calls > 0 and r.cost <= left
            left_calls, left = (left_calls - 1, left - r.cost) if ok else (left_calls, left)
            out.append((r.run, r.seq, ok, left))
        return pd.DataFrame(out, columns=["run", "seq", "admitted", "tokens_left"])

    return requests.select("run", "seq", "cost").groupBy("run").applyInPandas(replay, "run long, seq long, admitted boolean, tokens_left long")


#: Keys of a configuration whose values are secrets.
SECRET_KEYS = (
    "access_token", "api_key", "aws_access_key_id", "aws_secret_access_key", "client_secret", "credential", "credentials", "password", "private_key", "secret", "token", "wallet_password",
)


def without_secrets(value, key: str | None = None):
    """A JSON value with each secret as whether it is set; the name of an environment variable may stay."""
    if key is not None and key.strip().lower() in SECRET_KEYS:
        return value if isinstance(value, dict) and set(value) == {"$env"} else {"$configured": value not in (None, "")}
    if isinstance(value, dict):
        return {k: without_secrets(v, k) for k, v in value.items()}
    return [without_secrets(v) for v in value] if isinstance(value, list) else value


@arrow_function("string")
def _plain_config(texts: pd.Series) -> pd.Series:
    def one(t: str | None) -> str | None:
        try:
            return None if t is None else canonical(without_secrets(json.loads(t)))
        except ValueError:
            return None

    return texts.map(one)


def config_digest(config: Column) -> Column:
    """Digest of a configuration in JSON, the same for any order of keys and any value of a secret; null for what is no JSON."""
    return digest(_plain_config(config))


#: What a provenance record holds, in order; ``digest`` is that of the others.
RECORD = ("answer_id", "checker_version", "config_digest", "evidence_digest", "execution_scope", "index_digest", "model", "policy_version")
SCOPES = ("online", "evaluation", "library")


def provenance_record(**fields: Column) -> Column:
    """The record of an answer as JSON with its digest; an unknown scope is ``library``, what isn't given is null."""
    scope = fields.get("execution_scope", F.lit(None).cast("string"))
    fields = fields | {"execution_scope": F.when(scope.isin(*SCOPES), scope).otherwise("library")}
    parts = {k: fields.get(k, F.lit(None)).cast("string") for k in RECORD}
    return F.to_json(F.struct(*(parts[k].alias(k) for k in RECORD), struct_digest(**parts).alias("digest")), {"ignoreNullFields": "false"})


def sanitised(record: Column) -> Column:
    """A record read through its schema: unknown keys go; null if it is no record, its scope is unknown, or its digest isn't its own."""
    shape = ", ".join(f"{k} string" for k in (*RECORD, "digest"))
    read = F.from_json(record, shape)
    own = struct_digest(**{k: read[k] for k in RECORD})
    good = (read["digest"] == own) & read["execution_scope"].isin(*SCOPES) & read["answer_id"].isNotNull()
    return F.when(good, F.to_json(read, {"ignoreNullFields": "false"}))


def bound(answers: DataFrame, records: DataFrame) -> DataFrame:
    """``answer_id, provenance, bound`` of ``answers(answer_id, evidence_digest)`` and ``records(answer_id, record)``.

    A record is bound to an answer only if it is sound and names the answer and its evidence.
    """
    one = records.groupBy("answer_id").agg(F.min(sanitised(F.col("record"))).alias("provenance"))
    joined = answers.join(one, "answer_id", "left")
    fits = F.coalesce((F.get_json_object("provenance", "$.answer_id") == F.col("answer_id").cast("string")) & F.get_json_object("provenance", "$.evidence_digest").eqNullSafe(F.col("evidence_digest")), F.lit(False))
    return joined.select("answer_id", F.when(fits, F.col("provenance")).alias("provenance"), fits.alias("bound"))
