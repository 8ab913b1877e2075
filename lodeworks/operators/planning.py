"""Plans for a question: topics, contextual rewrites, routing to collections and agents, checks of what a model proposes.

Everything is a column expression; what a model says comes in as a column and is only ever validated here. A null
question counts as empty; a null proposal is a model that failed, and the stated fallback is taken.
"""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodeworks.functions.arrow import arrow_function
from lodeworks.operators.text import anchor_terms, once
from lodeworks.operators.understanding import needs_decomposition, valid_subqueries

#: Questions that name two topics, and what is cut from a topic's ends.
TOPICS = (
    r"从(.+?)到(.+?)(?:的|，|,)",
    r"不能把(.+?)(?:直接)?当成(.+?)(?:[？?]|$)",
    r"(.+?)[，,]?是否意味着(.+?)(?:[？?]|$)",
    r"(.+?)与(.+?)(?:之间|必须一起|是否意味着)",
)
TOPIC_ENDS = r"^[，,、；;：:\s]+|[？?。！!，,；;：:\s]+$"
TOPIC_LEADS = r"^(?:为什么|如何|是否|完整|这个项目|产品中)"
#: Markers of a new topic, and of questions that want everything.
SWITCHES = ("另一个问题", "换个问题", "新问题", "题外话")
COMPREHENSIVE = ("report", "comprehensive", "compare", "comparison", "报告", "全面", "综合", "比较", "对比")
#: Fixed value: longest stand-alone question.
LONGEST = 4000

_STRINGS = "cast(array() as array<string>)"


def _contains_any(text: Column, words: tuple[str, ...]) -> Column:
    hit = F.lit(False)
    for w in words:
        hit = hit | F.contains(text, F.lit(w))
    return hit


def topics(question: Column) -> Column:
    """The two topics that a question names, or an empty array. The first pattern that gives two counts."""
    text = F.coalesce(question, F.lit(""))

    def clean(topic: Column) -> Column:
        return F.trim(F.regexp_replace(F.trim(F.regexp_replace(topic, TOPIC_ENDS, "")), TOPIC_LEADS, ""))

    pairs = [F.filter(F.array(*(clean(F.regexp_extract(text, pattern, i)) for i in (1, 2))), lambda t: F.length(t) >= 2) for pattern in TOPICS]
    return F.coalesce(F.get(F.filter(F.array(*pairs), lambda p: F.size(p) == 2), F.lit(0)), F.expr(_STRINGS))


def query_plan(question: Column, proposed: Column) -> Column:
    """Struct ``queries, decomposed, fallback, reason``: by the question's own topics, else by a model's proposals."""
    original = F.trim(F.coalesce(question, F.lit("")))
    own = valid_subqueries(original, topics(original), anchor_terms)
    theirs = valid_subqueries(original, proposed, anchor_terms)

    def plan(queries: Column, decomposed: bool, fallback: bool, reason: str) -> Column:
        return F.struct(queries.alias("queries"), F.lit(decomposed).alias("decomposed"), F.lit(fallback).alias("fallback"), F.lit(reason).alias("reason"))

    alone = F.array(original)
    return (
        F.when(~needs_decomposition(original), plan(alone, False, False, "single_topic"))
        .when(F.size(own) > 1, plan(own, True, False, "deterministic_decomposition"))
        .when(proposed.isNull(), plan(alone, False, True, "planner_failed"))
        .when(F.size(theirs) == 1, plan(alone, False, True, "no_valid_subqueries"))
        .otherwise(plan(theirs, True, False, "decomposed"))
    )


def contextual_query(question: Column, topic: Column, answer: Column, turns: Column, depends: Column, rewrite: Column) -> Column:
    """Struct ``query, depends, fallback, reason, status, queries`` of a question in a conversation.

    ``topic`` is the last earlier question, ``answer`` the last grounded answer, ``turns`` the number of usable turns;
    ``depends`` and ``rewrite`` are a model's verdict (null: it failed). A rewrite must share a term with its sources.
    """
    asked = F.trim(F.coalesce(question, F.lit("")))

    def joined(*parts: Column) -> Column:
        kept = F.filter(F.transform(F.array(*parts), lambda x: F.trim(x)), lambda x: x.isNotNull() & (x != ""))
        return F.substring(F.array_join(F.array_distinct(kept), " "), 1, LONGEST)

    safe, primary = joined(topic, answer, asked), joined(topic, asked)
    said = F.trim(F.coalesce(rewrite, F.lit("")))
    mine, theirs = anchor_terms(said), anchor_terms(F.concat_ws(" ", asked, topic, answer))
    drifted = (F.size(mine) > 0) & (F.size(theirs) > 0) & ~F.arrays_overlap(mine, theirs)
    invalid = depends.isNull() | (said == "") | (F.length(said) > LONGEST) | (~depends & (said != asked))
    reason = (
        F.when(F.coalesce(turns, F.lit(0)) == 0, "no_history")
        .when(_contains_any(asked, SWITCHES), "topic_switched")
        .when(rewrite.isNull(), "contextualizer_failed")
        .when(invalid, "invalid_output")
        .when(depends & drifted, "rewrite_drifted")
        .when(depends, "rewritten")
        .otherwise("standalone")
    )

    def told(r: Column) -> Column:
        fallback = r.isin("contextualizer_failed", "invalid_output", "rewrite_drifted")
        dependent = r == "rewritten"
        queries = F.when(dependent, F.array_distinct(F.array(primary, safe))).when(fallback, F.array_distinct(F.array(asked, safe))).otherwise(F.array(asked))
        return F.struct(
            F.when(dependent, primary).otherwise(asked).alias("query"), dependent.alias("depends"), fallback.alias("fallback"), r.alias("reason"),
            F.when(fallback, "unknown").when(dependent, "dependent").otherwise("standalone").alias("status"), queries.alias("queries"),
        )

    return once(reason, told)


def valid_strings(values: Column, most: int, longest: int = 512, excluded: Column | None = None) -> Column:
    """Struct ``kept, rejected``: trimmed new strings in order, at most ``most``, and for every other the cause.

    A null list is an invalid one: nothing kept, nothing rejected; a null item is ``<NoneType>``.
    """
    out = F.coalesce(excluded, F.expr(_STRINGS)) if excluded is not None else F.expr(_STRINGS)
    begin = F.struct(F.expr(_STRINGS).alias("kept"), F.expr(_STRINGS).alias("rejected"))

    def step(state: Column, item: Column) -> Column:
        word = F.trim(item)
        cause = (
            F.when(item.isNull(), "<NoneType>").when(word == "", "<empty>").when(F.length(word) > longest, "<too_long>").when(F.array_contains(out, word), "<previous_query>")
            .when(F.array_contains(state["kept"], word), "<duplicate>").when(F.size(state["kept"]) >= most, "<over_limit>")
        )
        return F.struct(
            F.when(cause.isNull(), F.concat(state["kept"], F.array(word))).otherwise(state["kept"]).alias("kept"),
            F.when(cause.isNull(), state["rejected"]).otherwise(F.concat(state["rejected"], F.array(cause))).alias("rejected"),
        )

    return F.aggregate(F.coalesce(values, F.expr(_STRINGS)), begin, step)


def valid_indices(values: Column, bound: Column) -> Column:
    """Struct ``kept, fallback``: distinct indices from 0 to below ``bound`` in order; a fallback when none of some is valid."""
    inside = F.array_distinct(F.filter(values, lambda i: i.isNotNull() & (i >= 0) & (i < bound)))
    kept = F.coalesce(inside, F.expr("cast(array() as array<int>)"))
    return once(kept, lambda k: F.struct(k.alias("kept"), ((F.coalesce(F.size(values), F.lit(0)) > 0) & (F.size(k) == 0)).alias("fallback")))


def agent_index(response: Column, agents: int, fallback: int = 0) -> Column:
    """Struct ``index, fallback, reason`` of exactly one one-based number in a response."""
    said = F.trim(F.coalesce(response, F.lit("")))
    number = F.when(F.rlike(said, F.lit("^[0-9]+$")), F.coalesce(said.try_cast("bigint"), F.lit(1 << 62))) - 1
    reason = F.when(number.isNull(), "invalid_index_format").when((number < 0) | (number >= agents), "index_out_of_range")
    return F.struct(F.when(reason.isNull(), number.cast("int")).otherwise(fallback).alias("index"), reason.isNotNull().alias("fallback"), reason.alias("reason"))


def route_agent(mode: Column, response: Column, searches_web: tuple[bool, ...], fallback: int = 0) -> Column:
    """``agent_index``, but a request for the web goes to the first agent that can search it."""
    chosen = agent_index(response, len(searches_web), fallback)
    if True not in searches_web:
        return chosen
    web = F.struct(F.lit(searches_web.index(True)).alias("index"), F.lit(False).alias("fallback"), F.lit("web_search_requested").alias("reason"))
    return F.when(mode.isin("web", "hybrid"), web).otherwise(chosen)


def route_collections(requests: DataFrame, collections: DataFrame, allowed: DataFrame, default: str) -> DataFrame:
    """``request, selected, rejected, fallback, reason`` for ``requests(request, picks)``.

    ``collections(name, description)`` exist, ``allowed(request, name)`` may be used. Of several usable ones the model's
    picks come first, then those without a description and the default; without any, the default or the first by name.
    The lists are bounded by the collections that one request may use.
    """
    usable = allowed.join(collections, "name").groupBy("request").agg(
        F.array_sort(F.collect_set("name")).alias("names"), F.array_sort(F.collect_set(F.when((F.coalesce("description", F.lit("")) == "") | (F.col("name") == default), F.col("name")))).alias("automatic")
    )
    per = requests.join(usable, "request", "left").withColumn("picks", F.array_distinct(F.filter(F.transform(F.coalesce("picks", F.expr(_STRINGS)), lambda x: F.trim(x)), lambda x: x != "")))
    names, automatic = F.coalesce("names", F.expr(_STRINGS)), F.coalesce("automatic", F.expr(_STRINGS))
    valid = F.array_intersect(F.col("picks"), names)
    chosen = F.array_distinct(F.concat(valid, automatic))
    first = F.array(F.when(F.array_contains(names, default), F.lit(default)).otherwise(F.get(names, F.lit(0))))
    several = F.size(names) > 1
    selected = F.when(~several, names).when(F.size(chosen) > 0, chosen).otherwise(first)
    rejected = F.when(several, F.array_except("picks", names)).otherwise(F.expr(_STRINGS))
    fallback = several & (F.size(valid) == 0)
    reason = (
        F.when(F.size(names) == 0, "no_allowed_collections").when(~several, F.lit(None)).when(F.size(chosen) == 0, "no_valid_collection_selected")
        .when(F.size(valid) == 0, "automatic_collection_fallback").when(F.size(rejected) > 0, "hallucinated_collections_filtered")
    )
    return per.select("request", selected.alias("selected"), rejected.alias("rejected"), fallback.alias("fallback"), reason.alias("reason"))


@arrow_function("string")
def comparable(texts: pd.Series) -> pd.Series:
    """Compatibility-composed, case-folded text without marks and white space; Spark has no such composition."""
    return texts.map(lambda t: re.sub(r"[\W_]+", "", unicodedata.normalize("NFKC", t or "").casefold()))


def followup_reason(candidate: Column, core: Column, previous_cores: Column, longest: int = 512) -> Column:
    """Why a follow-up question is rejected, or null; ``core`` and ``previous_cores`` are ``comparable`` texts."""
    return (
        F.when(core == "", "empty_followup_query").when(F.length(F.trim(candidate)) > longest, "followup_query_too_long").when(F.array_contains(previous_cores, core), "duplicate_followup_query")
    )


def comprehensive(question: Column) -> Column:
    """Whether a question wants a whole report or a comparison."""
    return _contains_any(F.lower(F.coalesce(question, F.lit(""))), COMPREHENSIVE)
