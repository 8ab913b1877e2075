"""Lists and objects in a model's output, found by one fold over its characters.

The fold keeps the depth of brackets, the open quote, and whether the last character was a backslash; a bracket within a
string is a character like others. A span is a bracket at depth 0 up to where the depth is 0 again. An answer that holds
exactly one span is that span; one with none or several is refused.

Defined cases: null gives null; what stands before ``</think>`` is dropped; a fence of backquotes with or without a name
is cut off; quotes outside brackets are text; a span that isn't closed, or is closed by the other kind of bracket, is
none, and neither is anything behind it.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_STATE = "struct<stack:string,quote:string,escaped:boolean,at:int,start:int,spans:array<struct<start:int,end:int>>,broken:boolean>"


def unwrapped(text: Column) -> Column:
    """An answer without its thoughts and its fence."""
    bare = F.trim(F.regexp_replace(text, r"(?s)^.*</think>", ""))
    return F.trim(F.regexp_replace(F.regexp_replace(bare, r"^```(?:python|json|str)?\s*", ""), r"\s*```$", ""))


def spans(text: Column) -> Column:
    """``start, end`` of every top-level bracketed span, counted in characters from 0, the end exclusive; null if one is broken."""
    start = F.from_json(F.lit('{"stack":"","escaped":false,"at":0,"start":-1,"spans":[],"broken":false}'), _STATE)

    def step(s: Column, c: Column) -> Column:
        inside, quoted = s["stack"] != "", s["quote"].isNotNull()
        opens = ~quoted & c.isin("[", "{") & ~s["broken"]
        closes = inside & ~quoted & c.isin("]", "}") & ~s["broken"]
        fits = F.right(s["stack"], F.lit(1)) == F.when(c == "]", "[").otherwise("{")
        stack = F.when(opens, F.concat(s["stack"], c)).when(closes & fits, F.substring(s["stack"], F.lit(1), F.length(s["stack"]) - 1)).otherwise(s["stack"])
        ends = closes & fits & (F.length(s["stack"]) == 1)
        quote = F.when(quoted & ~s["escaped"] & (c == s["quote"]), F.lit(None)).when(~quoted & inside & c.isin('"', "'"), c).otherwise(s["quote"])
        return F.struct(
            stack.alias("stack"), quote.alias("quote"), (quoted & ~s["escaped"] & (c == "\\")).alias("escaped"), (s["at"] + 1).alias("at"),
            F.when(opens & ~inside, s["at"]).otherwise(s["start"]).alias("start"),
            F.when(ends, F.concat(s["spans"], F.array(F.struct(s["start"].alias("start"), (s["at"] + 1).alias("end"))))).otherwise(s["spans"]).alias("spans"),
            (s["broken"] | (closes & ~fits)).alias("broken"),
        ).cast(_STATE)

    whole = lambda s: F.when(~s["broken"] & (s["stack"] == ""), s["spans"])
    return F.aggregate(F.filter(F.split(text, ""), lambda c: c != ""), start, step, whole)


def literal(text: Column) -> Column:
    """The only bracketed span of an answer, null for none, several or a broken one."""
    bare = unwrapped(text)
    cut = lambda xs: F.when(F.size(xs) == 1, F.substring(bare, xs[0]["start"] + 1, xs[0]["end"] - xs[0]["start"]))
    return F.element_at(F.transform(F.array(spans(bare)), cut), 1)
