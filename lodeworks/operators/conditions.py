"""Conditions of conclusions: what a text restricts, and whether an evidence's restrictions carry a claim's.

Restrictions are read with patterns in expressions: a condition (single, all, any or a mixture of terms, perhaps
negated) and the conclusion that it bears on. Support between two conditions is a table over their relations; terms are
compared by containment, either way. A claim holds if each restriction of the evidence on its conclusion is told or
supported, and each restriction of its own is supported by one of the evidence.

Defined cases: null and empty texts have no restrictions; a condition without terms of two characters, or a conclusion
of under four, is none; where neither text restricts what the other concludes, the check does not apply.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Patterns of conditions (group 1) and conclusions (group 2), with what they are a source of.
PATTERNS = (
    (r"只有([^，。；;]{1,30}?)(?:才|才能|方可|可以|可|能|能够)([^，。；;]{2,60})", "required"),
    (r"仅([^，。；;]{1,24}?)(?:可以|可|能|能够|允许)([^，。；;]{2,60})", "required"),
    (r"必须([^，。；;]{1,30}?)(?:后)?(?:才|才能|方可|可以|可|能)([^，。；;]{2,60})", "required"),
    (r"除非([^，。；;]{1,40}?)[，,]?否则(?:不得|不能|禁止|不允许)([^，。；;]{2,60})", "unless"),
    (r"(?:^|[。！？!?；;，,])([^。！？!?；;，,]{2,50}?)(?:后|之后)?(?:均可|都可|即可|方可|才可|才能|可以|可|能够|能|允许)([^，。；;]{2,60})", "stated"),
)
NOT_STATED = "只有|仅|必须|除非|否则"
NEGATED = "无需|无须|不需|不必|免于|未完成|未通过|未获得"
ANY_OF = r"(?:或者|或|任一(?:条件|角色)?|任意(?:一个)?(?:条件|角色)?|\bor\b|/)"
ALL_OF = r"(?:并且|并|以及|和|与|及|、|同时|\band\b)"
BEFORE = r"^(?:只有|仅|必须|需要|需|满足|同时满足|经|已|先|完成|通过|获得|取得|由)+"
BEHIND = r"(?:之后|以后|后|时|的情况下|任一角色|任一条件|任意一个条件|条件之一|角色之一|条件|角色|之一|均|都)+$"
MODALS = "才能|能够|可以|允许|方可|才|可|能"
MARKS = r"(?U)[\s\W_]+"
NOT_TOLD = ("非", "不是", "无需", "无须", "不需", "不必", "未完成", "未通过", "未获得")


def bare(text: Column) -> Column:
    """A clause without modal words, marks and white space."""
    return F.lower(F.regexp_replace(F.regexp_replace(F.coalesce(text, F.lit("")), MODALS, ""), MARKS, ""))


def _expression(condition: Column, conclusion: Column, source: str) -> Column:
    rest = F.regexp_replace(condition, NEGATED, "")
    some, every = F.rlike(rest, F.lit(ANY_OF)), F.rlike(rest, F.lit(ALL_OF))
    pieces = F.when(some & every, F.array(rest)).when(some, F.split(rest, ANY_OF)).when(every, F.split(rest, ALL_OF)).otherwise(F.array(rest))
    terms = F.transform(pieces, lambda t: bare(F.regexp_replace(F.regexp_replace(F.trim(t), BEFORE, ""), BEHIND, "")))
    terms = F.array_sort(F.array_distinct(F.filter(terms, lambda t: F.length(t) >= 2)))
    relation = F.when(some & every, "complex").when(F.size(terms) == 1, "single").when(some, "any").when(every, "all").otherwise("single")
    return F.struct(relation.alias("relation"), terms.alias("terms"), F.rlike(condition, F.lit(NEGATED)).alias("negated"), bare(conclusion).alias("conclusion"), F.lit(source).alias("source"))


def _reader(source: str):
    return lambda p: _expression(p["a"], p["b"], source)


def restrictions(text: Column) -> Column:
    """An array of ``relation, terms, negated, conclusion, source``; stated ones only where no stronger pattern says the same."""
    text = F.coalesce(text, F.lit(""))
    found = []
    for pattern, source in PATTERNS:
        pairs = F.arrays_zip(F.regexp_extract_all(text, F.lit(pattern), F.lit(1)).alias("a"), F.regexp_extract_all(text, F.lit(pattern), F.lit(2)).alias("b"))
        if source == "stated":
            pairs = F.filter(pairs, lambda p: ~F.rlike(p["a"], F.lit(NOT_STATED)))
        read = F.transform(pairs, _reader(source))
        found.append(F.filter(read, lambda r: (F.size(r["terms"]) > 0) & (F.length(r["conclusion"]) >= 4)))
    strong, stated = F.concat(*found[:-1]), found[-1]
    new = F.filter(stated, lambda r: ~F.exists(strong, lambda s: compatible(r["conclusion"], s["conclusion"]) & (signature(r) == signature(s))))
    return F.concat(strong, new)


def signature(r: Column) -> Column:
    inner = F.when(r["relation"] == "single", F.get(r["terms"], F.lit(0))).otherwise(F.concat(r["relation"], F.lit("("), F.array_join(r["terms"], ","), F.lit(")")))
    return F.when(r["negated"], F.concat(F.lit("negated("), inner, F.lit(")"))).otherwise(inner)


def compatible(a: Column, b: Column) -> Column:
    return F.contains(a, b) | F.contains(b, a)


def _covered(needed: Column, given: Column) -> Column:
    return F.forall(needed, lambda n: F.exists(given, lambda g: compatible(n, g)))


def supported(evidence: Column, claim: Column) -> Column:
    """Whether an evidence's restriction carries a claim's: the table of relations, with terms compared by containment."""
    e, c, er, cr = evidence["terms"], claim["terms"], evidence["relation"], claim["relation"]
    claim_covered, evidence_covered = _covered(c, e), _covered(e, c)
    table = (
        F.when((er == "complex") | (cr == "complex"), (er == cr) & (F.array_sort(e) == F.array_sort(c)))
        .when(evidence["source"] == "stated", claim_covered)
        .when(er == "all", cr.isin("all", "single") & evidence_covered)
        .when(er == "any", F.when(cr == "all", F.exists(c, lambda x: F.exists(e, lambda y: compatible(x, y)))).otherwise(claim_covered))
        .otherwise(F.when(cr == "any", claim_covered).otherwise(evidence_covered))
    )
    return (evidence["negated"] == claim["negated"]) & table


def _told(r: Column, claim: Column) -> Column:
    """Whether a claim's bare text tells an evidence's condition."""
    def there(term: Column) -> Column:
        out = F.contains(claim, term)
        for form in NOT_TOLD:
            out = out & ~F.contains(claim, F.concat(F.lit(form), term))
        return out

    return ~r["negated"] & F.when(r["relation"] == "any", F.exists(r["terms"], there)).otherwise(F.forall(r["terms"], there))


def check(claim: Column, claims: Column, evidence: Column) -> Column:
    """``status, reason, missing`` of a claim; ``claims`` and ``evidence`` are restrictions of the claim and of its evidence.

    Give both as columns that are computed once (of a table or an earlier ``select``): they are used many times.
    """
    core = bare(claim)
    relevant = F.filter(evidence, lambda e: F.contains(core, e["conclusion"]) | F.exists(claims, lambda c: compatible(e["conclusion"], c["conclusion"])))
    own = F.filter(claims, lambda c: F.exists(evidence, lambda e: compatible(c["conclusion"], e["conclusion"])))
    missing = F.filter(relevant, lambda e: ~(_told(e, core) | F.exists(own, lambda c: supported(e, c))))
    open_ = F.filter(own, lambda c: ~F.exists(relevant, lambda e: supported(e, c)))
    shared = lambda a, b: F.arrays_overlap(a["terms"], b["terms"])
    either = lambda what: F.exists(missing, lambda e: F.exists(own, lambda c: shared(e, c) & what(e, c))) | F.exists(open_, lambda c: F.exists(relevant, lambda e: shared(e, c) & what(e, c)))
    wrong = (F.size(missing) > 0) | (F.size(open_) > 0)
    names = F.array_sort(F.array_distinct(F.transform(F.when(F.size(missing) > 0, missing).otherwise(open_), signature)))
    applies = (F.size(relevant) > 0) | (F.size(own) > 0)
    reason = (
        F.when(~applies, F.lit(None)).when(~wrong, "CONDITIONS_MATCH").when(either(lambda e, c: e["negated"] != c["negated"]), "CONDITION_NEGATED")
        .when(either(lambda e, c: e["relation"] != c["relation"]), "CONDITION_RELATION_MISMATCH").otherwise("CONDITION_OMITTED_OR_CHANGED")
    )
    return F.struct(F.when(~applies, "not_applicable").when(wrong, "inconsistent").otherwise("consistent").alias("status"), reason.alias("reason"), F.when(wrong, names).otherwise(F.expr("cast(array() as array<string>)")).alias("missing"))
