"""Definition-first answers: an index of sentences that define something, joined to questions by their subject.

A question for a definition names a subject; a sentence defines it if the subject occurs in it and a word of definition
follows within 160 characters, white space apart. Sentences with such a word are indexed once, by the terms in them; a
question is joined by the longest term of its subject and then decided on the whole subject. The first two evidences that
define the subject become primary, and the answer is made to begin with the first one's sentence.

Compared with a search through each question's texts, a subject must occur here with its longest term as a whole (a Latin
word, or two ideographs in a row); compatibility forms of characters are not composed.

Defined cases: a null question or one without a marker is of class ``other``; a subject without terms finds nothing; a
null text has no sentences; a sentence that comes twice in a text counts where it comes first; repeated ids are one
evidence; an empty index leaves every definition without evidence.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodeworks.operators.text import anchor_terms
from lodeworks.session import settle

#: What marks a question for a definition, in the order in which markers are cut off, and words of definition.
MARKERS = ("什么是", "是什么", "指什么", "是何", "what is", "what's", "define", "definition of")
PREFIXES = ("什么是", "what is", "what's", "define", "definition of")
SUFFIXES = ("是什么", "指什么", "是何")
RELATIONS = ("是一个", "是一种", "是指", "属于", "是", "is a", "is an", "is", "refers to")
WINDOW, PRIMARY = 160, 2
ENDS = "。！？!?；;"  # a sentence runs to these, or to the end of the text; a line that ends otherwise is none
LIST_MARK = r"^(?:#{1,6}\s+|[-*+]\s+|\d+[.)]\s+)"


def compact(text: Column) -> Column:
    return F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"\s+", "")


def _any_in(text: Column, needles: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for n in needles:
        out = out | F.contains(text, F.lit(n))
    return out


def asks_definition(question: Column) -> Column:
    return _any_in(F.trim(F.regexp_replace(F.lower(F.coalesce(question, F.lit(""))), r"\s+", " ")), MARKERS)


def subject(question: Column) -> Column:
    """The compact subject of a question: one marker is cut off its begin and one off its end."""
    text = compact(question)
    begin = F.lit(0)
    for p in reversed([p.replace(" ", "") for p in PREFIXES]):
        begin = F.when(F.startswith(text, F.lit(p)), len(p)).otherwise(begin)
    rest = F.substring(text, begin + 1, F.length(text))
    end = F.lit(0)
    for s in reversed(SUFFIXES):
        end = F.when(F.endswith(rest, F.lit(s)), len(s)).otherwise(end)
    return F.regexp_replace(F.substring(rest, F.lit(1), F.length(rest) - end), r"[^\p{L}\p{N}_.\-]+", "")


def subject_term(question: Column) -> Column:
    """The longest term of a question without its markers, the first in order of several; null without one."""
    rest = F.lower(F.coalesce(question, F.lit("")))
    for m in MARKERS:
        rest = F.replace(rest, F.lit(m), F.lit(" "))
    longest = F.array_max(F.transform(anchor_terms(rest), lambda t: F.length(t)))
    return F.get(F.filter(anchor_terms(rest), lambda t: F.length(t) == longest), F.lit(0))


def defines(sentence: Column, of: Column) -> Column:
    """Whether a sentence defines a compact subject."""
    text = compact(sentence)
    at = F.position(of, text)
    after = F.substring(text, at + F.length(of), F.lit(WINDOW))
    return (of != "") & (at > 0) & _any_in(after, tuple(r.replace(" ", "") for r in RELATIONS))


def sentences(text: Column) -> Column:
    """A text's sentences without list marks, in order."""
    # every run is taken with its end, so that no run is read twice; a mark stands for the end of the text
    marked = F.concat(F.regexp_replace(F.coalesce(text, F.lit("")), r"\n\z", ""), F.lit("\0"))
    runs = F.regexp_extract_all(marked, F.lit(rf"[^\n\x00{ENDS}]+(?:[{ENDS}]+|\x00)?"), F.lit(0))
    ended = F.transform(F.filter(runs, lambda s: F.rlike(s, F.lit(rf"[{ENDS}\x00]\z"))), lambda s: F.rtrim(s, F.lit("\0")))
    trimmed = F.transform(ended, lambda s: F.btrim(F.regexp_replace(F.btrim(s, F.lit(" \t\n\r\x0b\f")), LIST_MARK, ""), F.lit(" \t\n\r\x0b\f")))
    return F.filter(trimmed, lambda s: s != "")


def index(docs: DataFrame) -> DataFrame:
    """``term, id, n, sentence`` of ``docs(id, text)``, settled: sentences with a word of definition, once for each term in them."""
    each = docs.select("id", F.posexplode(sentences(F.col("text"))).alias("n", "sentence"))
    useful = each.where(_any_in(compact(F.col("sentence")), tuple(r.replace(" ", "") for r in RELATIONS)))
    return settle(useful.select(F.explode(anchor_terms(F.col("sentence"))).alias("term"), "id", "n", "sentence"), "definition-index")


def plans(questions: DataFrame, built: DataFrame, evidence: DataFrame | Column | None = None) -> DataFrame:
    """``qid, query_class, decision, subject, primary, sentences, reason`` of ``questions(qid, question)``.

    ``evidence(qid, id, pos)`` is what each question may use, in order; as an expression over ``id``, the place of an
    evidence or null, it is a rule for all questions; without it, everything may be used, by id. ``primary`` are the
    ids of at most two evidences that define the subject, ``sentences`` their first defining sentences.
    """
    asked = questions.select("qid", asks_definition(F.col("question")).alias("definition"), subject(F.col("question")).alias("subject"), subject_term(F.col("question")).alias("term"))
    hits = asked.where("definition").join(built, "term").where(defines(F.col("sentence"), F.col("subject")))
    first = hits.groupBy("qid", "id").agg(F.min_by("sentence", "n").alias("sentence"))
    if evidence is None:
        placed = first.withColumn("pos", F.col("id"))
    elif isinstance(evidence, Column):
        placed = first.withColumn("pos", evidence)
    else:
        placed = first.join(evidence.groupBy("qid", "id").agg(F.min("pos").alias("pos")), ["qid", "id"], "left")
    order = F.row_number().over(Window.partitionBy("qid").orderBy("pos", "id"))
    chosen = placed.where("pos is not null").withColumn("place", order).where(F.col("place") <= PRIMARY)
    told = chosen.groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("place", "id", "sentence"))).alias("p"))  # two rows at most
    outside = placed.where("pos is null").select("qid").distinct().withColumn("outside", F.lit(True))
    joined = asked.join(told, "qid", "left").join(outside, "qid", "left")
    found = F.col("p").isNotNull()
    reason = F.when(~F.col("definition") | found, F.lit(None)).when(F.col("outside"), "definition_evidence_outside_snapshot").otherwise("definition_evidence_not_found")
    none = F.expr("cast(array() as array<string>)")
    return joined.select(
        "qid", F.when(F.col("definition"), "concept_definition").otherwise("other").alias("query_class"),
        F.when(~F.col("definition"), "default").when(found, "definition_first").otherwise("fallback_default").alias("decision"),
        F.when(F.col("definition"), F.nullif("subject", F.lit(""))).alias("subject"),
        F.coalesce(F.col("p.id"), F.expr("array()").cast(f"array<{built.schema['id'].dataType.simpleString()}>")).alias("primary"), F.coalesce(F.col("p.sentence"), none).alias("sentences"), reason.alias("reason"),
    )


def first_material(answer: Column) -> Column:
    """The first line of an answer that is more than a marker, without its list mark."""
    lines = F.transform(F.split(F.coalesce(answer, F.lit("")), r"\r\n|\r|\n"), lambda s: F.trim(F.regexp_replace(F.trim(s), LIST_MARK, "")))
    return F.coalesce(F.get(F.filter(lines, lambda s: (s != "") & ~F.rlike(s, F.lit(r"^(?i)\[\s*E[1-9]\d{0,2}\s*\]$"))), F.lit(0)), F.lit(""))


def enforced(answer: Column, decision: Column, of: Column, primary: Column, told: Column) -> Column:
    """``answer, gate, fallback_used``: a definition-first answer is the first primary sentence with its marker.

    ``primary`` are evidence numbers as strings. ``fallback_used`` tells that the given answer did not begin with a
    definition of the subject that cites a primary evidence.
    """
    first = first_material(answer)
    cited = F.transform(F.regexp_extract_all(F.upper(first), F.lit(r"\[\s*E([1-9]\d{0,2})\s*\]"), F.lit(1)), lambda x: x)
    begins = F.startswith(compact(first), of) & defines(first, of) & F.arrays_overlap(cited, primary)
    sentence = F.get(told, F.lit(0))
    use = (decision == "definition_first") & sentence.isNotNull()
    return F.struct(
        F.when(use, F.concat(sentence, F.lit(" [E"), F.get(primary, F.lit(0)), F.lit("]"))).otherwise(answer).alias("answer"),
        F.when(use, "canonical_definition").otherwise("not_applicable").alias("gate"),
        F.when(use, ~F.coalesce(begins, F.lit(False))).alias("fallback_used"),
    )
