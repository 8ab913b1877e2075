"""Personal data by weak supervision, in DataFrame expressions only.

Candidate spans come from regular expressions: the four base kinds before validation and three further kinds. Labelers
vote +1, -1 or 0 on each candidate: the validator of its kind, its shape, a gazetteer, cue words before it, and its
neighbours. Votes are counted per kind and pattern (at most ``3 ** 5`` patterns); expectation-maximisation over those
counts estimates how reliable each labeler is and how likely each pattern is personal data. A naive Bayes classifier over
context features is then trained on these soft labels, and it alone decides which of the further candidates become
spans. Base spans that pass their rules always stay.

Defined cases: a null text is empty (no spans, digest of the empty string); repeated rows each get their result, rows
being told apart by an internal number; ``doc_id`` may be null; texts are scanned whole, offsets are code points; with no
candidates, or only one vote pattern, the priors decide; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodeworks.llm import common

#: Base kinds in order, then the method's own. A local part or a number is entered only at its start (or where the last
#: match ended) and taken without giving back: the same matches, without quadratic search or deep recursion.
PATTERNS: dict[str, str] = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "local_phone": r"(?<![0-9+])(?:\([0-9]{3}\)\x20?|[0-9]{3}[.-])[0-9]{3}[.-][0-9]{4}(?![0-9])",
    "national_id": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "person": r"(?<![A-Za-z])(?:Mr|Mrs|Ms|Dr|Herr|Frau|Mme|Sr|Sra)\.\x20[A-Z][a-z]+(?:\x20[A-Z][a-z]+)?",
}
BASE = ("email", "ip", "card", "phone")
_NEEDS = {"email": "@", "ip": ".", "phone": "+", "national_id": "-", "person": ". "}
#: Gazetteers: common given and family names, large North American area codes, and numbers printed as examples.
_NAMES = (
    "James John Robert Michael William David Richard Joseph Thomas Charles Mary Patricia Jennifer Linda Elizabeth Barbara Susan Jessica Sarah Karen Anna Maria Peter Paul Hans Klaus Ursula Petra Pierre Jean Marie Luc "
    "Camille Carlos Juan Ana Carmen Jose Luis Smith Johnson Williams Brown Jones Garcia Miller Davis Rodriguez Martinez Wilson Anderson Taylor Moore Jackson Martin Lee Thompson White Lopez Lewis Clark Walker Young "
    "Mueller Schmidt Schneider Fischer Weber Meyer Wagner Becker Dubois Bernard Durand Leroy Moreau Simon Laurent Fernandez Gonzalez Perez Sanchez Ramirez Torres"
).split()
_AREAS = "201 202 206 212 213 214 215 216 301 303 305 310 312 313 314 404 408 412 415 416 503 504 510 512 514 602 604 612 614 615 617 619 702 703 713 714 716 718 720 801 804 813 818 832 847 858 904 916 917 919 949 954 972".split()
_EXAMPLES = "078-05-1120 219-09-9999 123-45-6789 111-11-1111 555-55-5555 987-65-4320".split()
#: Cue words that come before personal data, by kind.
_CUES = {
    "email": r"(?i)(mail|contact|courriel|correo|write to)",
    "ip": r"(?i)\b(ip|address|host|server|adresse)\b",
    "card": r"(?i)(card|visa|credit|karte|carte|tarjeta|iban)",
    "phone": r"(?i)(phone|tel|call|mobile|fax|contact)",
    "local_phone": r"(?i)(phone|tel|call|mobile|fax|contact)",
    "national_id": r"(?i)(ssn|social|id\b|passport|tax)",
    "person": r"(?i)(dear|name|by|from|with)\b",
}
LABELERS = ("validator", "shape", "gazetteer", "context", "neighbours")
_ROUNDS = 20


def _bind(value: Column, use) -> Column:
    return F.element_at(F.transform(F.array(value), use), 1)


def _found(kind: str) -> Column:
    """Candidates of one kind: matched text, length of the gap before it, and what stands before and after."""
    text, pattern = F.col("text"), F.lit(PATTERNS[kind])
    matches = F.regexp_extract_all(text, pattern, F.lit(0))
    if kind in _NEEDS:
        matches = F.when(F.contains(text, F.lit(_NEEDS[kind])), matches).otherwise(F.array().cast("array<string>"))
    if kind in ("card", "local_phone"):  # long runs of single digits are no card; runs are kept with 16 to 19 digits only after their place is known
        matches = F.when(F.rlike(text, F.lit("[0-9]")), matches).otherwise(F.array().cast("array<string>"))

    def placed(m: Column) -> Column:
        gaps = F.split(text, PATTERNS[kind], -1)
        return _bind(
            gaps,
            lambda g: F.transform(
                m, lambda x, i: F.struct(F.lit(kind).alias("kind"), i.alias("i"), x.alias("match"), F.length(F.get(g, i)).alias("gap"), F.right(F.get(g, i), F.lit(24)).alias("before"), F.left(F.get(g, i + 1), F.lit(1)).alias("after"))
            ),
        )

    none = F.array().cast("array<struct<kind:string,i:int,match:string,gap:int,before:string,after:string>>")
    return _bind(matches, lambda m: F.when(F.size(m) == 0, none).otherwise(placed(m)))


def _luhn(digits: Column) -> Column:
    n = F.length(digits)

    def value(i: Column) -> Column:  # i from the right, 0 first
        d = F.substring(digits, n - i, F.lit(1)).cast("int")
        twice = F.when(d > 4, 2 * d - 9).otherwise(2 * d)
        return F.when(i % 2 == 1, twice).otherwise(d)

    return F.aggregate(F.transform(F.sequence(F.lit(0), n - 1), value), F.lit(0), lambda a, x: a + x) % 10 == 0


def candidates(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The scanned rows (``row, doc_id``) and one row per candidate with its place, rule and votes."""
    text = F.coalesce("text", F.lit(""))
    scanned = docs.select("doc_id", text.alias("text")).select("doc_id", F.concat(*(_found(k) for k in PATTERNS)).alias("found"))
    rows = common.settle(scanned.withColumn("row", F.monotonically_increasing_id()), "pii-scan")
    flat = rows.where(F.size("found") > 0).select("row", F.explode("found").alias("c")).select("row", "c.*")
    # places are running sums within a text and kind; a text bounds its group
    w = Window.partitionBy("row", "kind").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    size = F.length("match")
    placed = flat.withColumn("end", F.sum(F.col("gap") + size).over(w).cast("long")).withColumn("start", F.col("end") - size)
    digits = F.regexp_replace("match", "[^0-9]", "")
    n = F.length(digits)
    kind = F.col("kind")
    part = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
    valid = (
        F.when(kind == "email", F.lit(True))
        .when(kind == "ip", F.rlike("match", F.lit(rf"^{part}\.{part}\.{part}\.{part}$")))
        .when(kind == "card", F.when(n.between(16, 19), _luhn(digits)).otherwise(False))
        .when(kind == "phone", n.between(8, 15))
        .when(kind == "local_phone", F.rlike(digits, F.lit("^[2-9][0-9]{2}[2-9][0-9]{6}$")))
        .when(kind == "national_id", ~F.rlike("match", F.lit("^(?:000|666|9)|-00-|-0000$")))
        .otherwise(F.rlike("match", F.lit(r"\x20[A-Z][a-z]{2,}")))
    )
    shape = (
        F.when(kind == "email", F.when(F.rlike("match", F.lit(r"\.[A-Za-z]{2,12}$")), 1).otherwise(-1))
        .when(kind == "ip", F.when(F.rlike("match", F.lit(r"^(?:0|127)\.|(?:^|\.)0[0-9]")), -1).otherwise(1))
        .when(kind == "card", F.when(n.between(16, 19), 1).otherwise(-1))
        .when(kind == "phone", F.when(n.between(10, 13), 1).otherwise(-1))
        .when(kind == "local_phone", F.when(F.rlike("match", F.lit(r"^[0-9]{3}([.-])[0-9]{3}\1|^\([0-9]{3}\)\x20?[0-9]{3}-")) & ~F.rlike(digits, F.lit(r"([0-9])\1{5}")), 1).otherwise(-1))
        .when(kind == "national_id", F.when(F.rlike(digits, F.lit(r"([0-9])\1{4}")), -1).otherwise(1))
        .otherwise(F.when(F.rlike("match", F.lit(r"\x20[A-Z][a-z]+\x20[A-Z][a-z]+$")), 1).otherwise(0))
    )
    gazetteer = (
        F.when(kind == "phone", F.when(F.rlike("match", F.lit(r"^\+(?:1|7|2[07]|3[0-46-9]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58])")), 1).otherwise(-1))
        .when(kind == "card", F.when(F.rlike("match", F.lit("^[3-6]")), 1).otherwise(-1))
        .when(kind == "email", F.when(F.rlike("match", F.lit(r"(?i)@(?:mail|gmail|outlook|yahoo|proton|web|gmx)")), 1).otherwise(0))
        .when(kind == "local_phone", F.when(F.left(digits, F.lit(3)).isin(*_AREAS), 1).when(F.rlike(digits, F.lit("^(?:[0-9]11|555|000)")), -1).otherwise(0))
        .when(kind == "national_id", F.when(F.col("match").isin(*_EXAMPLES), -1).otherwise(0))
        .when(kind == "person", F.when(F.arrays_overlap(F.split("match", r"[.\x20]+"), F.array(*map(F.lit, _NAMES))), 1).otherwise(0))
        .otherwise(0)
    )
    cue = F.lit(False)
    for k, words in _CUES.items():
        cue = F.when(kind == k, F.rlike("before", F.lit(words))).otherwise(cue)
    context = F.when(cue, 1).when(F.rlike("before", F.lit(r"(?i)(version|build|v|#|id=|no\.)\s?$")), -1).otherwise(0)
    joined = F.rlike("before", F.lit(r"[A-Za-z0-9_/=.-]$")) | F.rlike("after", F.lit(r"^[A-Za-z0-9_/=-]"))
    votes = placed.select(
        "row", "kind", "start", "end", "before", "after", n.alias("digits"), valid.alias("valid"),
        F.array(F.when(valid, 1).otherwise(-1), shape, gazetteer, context, F.when(joined, -1).otherwise(1)).alias("votes"),
    )
    return rows.select("row", "doc_id"), common.settle(votes, "pii-candidates")


def label_model(votes: DataFrame) -> DataFrame:
    """Per kind and vote pattern the chance of personal data, and per kind the labelers' reliabilities.

    Returns ``kind, votes, chance, prior, reliability``: the last is ``P(vote = v | y)`` for every labeler, for votes -1, 0
    and +1 and for y of 0 and 1, flat. The rounds of expectation-maximisation run inside one expression over the counted
    patterns of a kind, which are bounded.
    """
    counted = votes.groupBy("kind", "votes").agg(F.count("*").cast("double").alias("n"))
    per_kind = counted.groupBy("kind").agg(F.array_sort(F.collect_list(F.struct("votes", "n"))).alias("p"))
    cells = F.sequence(F.lit(0), F.lit(6 * len(LABELERS) - 1))  # labeler, vote + 1, y

    def start(c: Column) -> Column:
        agrees = F.when(c % 2 == 1, (F.floor(c / 2) % 3) == 2).otherwise((F.floor(c / 2) % 3) == 0)
        return F.when((F.floor(c / 2) % 3) == 1, 0.3).when(agrees, 0.6).otherwise(0.1)

    def chance(pi: Column, a: Column, v: Column) -> Column:
        def product(y: int) -> Column:
            return F.aggregate(F.sequence(F.lit(0), F.lit(len(LABELERS) - 1)), F.lit(1.0), lambda s, k: s * F.get(a, (k * 6 + (F.get(v, k) + 1) * 2 + y).cast("int")))

        return _bind(F.struct((pi * product(1)).alias("one"), ((1 - pi) * product(0)).alias("none")), lambda x: x["one"] / (x["one"] + x["none"]))

    def step(s: Column) -> Column:
        weighed = F.transform("p", lambda x: F.struct(x["votes"].alias("v"), (x["n"] * chance(s["pi"], s["a"], x["votes"])).alias("one"), x["n"].alias("n")))

        def again(q: Column) -> Column:
            one = F.aggregate(q, F.lit(0.0), lambda t, x: t + x["one"])
            n = F.aggregate(q, F.lit(0.0), lambda t, x: t + x["n"])

            def cell(c: Column) -> Column:
                mass = lambda x: F.when(c % 2 == 1, x["one"]).otherwise(x["n"] - x["one"])
                hit = lambda x: F.get(x["v"], F.floor(c / 6).cast("int")) + 1 == F.floor(c / 2) % 3
                got = F.aggregate(q, F.lit(0.0), lambda t, x: t + F.when(hit(x), mass(x)).otherwise(0.0))
                of = F.when(c % 2 == 1, one).otherwise(n - one)
                return (got + 10 * start(c)) / (of + 10)  # ten votes of prior belief

            return F.struct(((one + 5) / (n + 10)).alias("pi"), F.transform(cells, cell).alias("a"))

        return _bind(weighed, again)

    begin = F.struct(F.lit(0.5).alias("pi"), F.transform(cells, start).alias("a"))
    fitted = per_kind.withColumn("s", F.aggregate(F.sequence(F.lit(1), F.lit(_ROUNDS)), begin, lambda s, _: step(s)))
    return fitted.select("kind", "s", F.explode("p").alias("x")).select("kind", F.col("x.votes").alias("votes"), chance(F.col("s.pi"), F.col("s.a"), F.col("x.votes")).alias("chance"), F.col("s.pi").alias("prior"), F.col("s.a").alias("reliability"))


def _features() -> Column:
    """Context features of a candidate, each with few values."""
    last = F.right("before", F.lit(1))
    cls = lambda c: F.when(c == "", "edge").when(F.rlike(c, F.lit("[A-Za-z]")), "letter").when(F.rlike(c, F.lit("[0-9]")), "digit").when(F.rlike(c, F.lit(r"\s")), "space").otherwise("mark")
    word = F.lower(F.regexp_extract("before", r"([A-Za-z]+)[^A-Za-z]*$", 1))
    return F.array(
        F.concat(F.lit("before="), cls(last)),
        F.concat(F.lit("after="), cls(F.col("after"))),
        F.concat(F.lit("digits="), F.least("digits", F.lit(20)).cast("string")),
        F.concat(F.lit("length="), F.least(F.floor((F.col("end") - F.col("start")) / 4), F.lit(10)).cast("string")),
        F.concat(F.lit("word="), F.pmod(F.xxhash64(word), F.lit(256)).cast("string")),
        F.concat(F.lit("cue="), F.element_at("votes", 4).cast("string")),
        F.concat(F.lit("near="), F.element_at("votes", 5).cast("string")),
    )


def classify(cands: DataFrame) -> DataFrame:
    """Candidates with ``score``, the log odds of the trained span classifier."""
    model = label_model(cands).select("kind", "votes", "chance", "prior")
    # one row per kind and pattern: bounded by 7 * 3 ** 5
    soft = cands.withColumn("features", _features()).join(F.broadcast(model), ["kind", "votes"])
    one, none = F.sum("chance"), F.sum(1 - F.col("chance"))
    counts = soft.select("kind", "chance", F.explode("features").alias("f")).groupBy("kind", "f").agg(one.alias("one"), none.alias("none"))
    totals = soft.groupBy("kind").agg(one.alias("all_one"), none.alias("all_none"))
    # at most about 300 features a kind, gathered into one row a kind
    weights = counts.join(totals, "kind").select(
        "kind", "f", F.log((F.col("one") + 1) / (F.col("all_one") + 2) / ((F.col("none") + 1) / (F.col("all_none") + 2))).alias("w"), F.log((F.col("all_one") + 1) / (F.col("all_none") + 1)).alias("bias")
    )
    table = weights.groupBy("kind").agg(F.map_from_entries(F.collect_list(F.struct("f", "w"))).alias("w"), F.first("bias").alias("bias"))
    told = F.aggregate("features", F.col("bias"), lambda s, f: s + F.coalesce(F.element_at(F.col("w"), f), F.lit(0.0)))
    return soft.join(F.broadcast(table), "kind").withColumn("score", told).drop("w", "bias", "features")


def find(docs: DataFrame, threshold: float = 0.0) -> DataFrame:
    """``doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, found``; ``found`` lists kind, start, end and score."""
    rows, cands = candidates(docs)
    scored = classify(cands)
    order = F.create_map(*(x for i, k in enumerate(PATTERNS) for x in (F.lit(k), F.lit(i))))
    span = F.struct(order[F.col("kind")].alias("o"), "start", "end", "kind", F.round("score", 3).alias("score"))
    base = F.col("kind").isin(*BASE) & F.col("valid")
    further = ~F.col("kind").isin(*BASE) & (F.col("score") > threshold)
    per_row = scored.where(base | further).groupBy("row").agg(F.array_sort(F.collect_list(F.when(base, span))).alias("base"), F.array_sort(F.collect_list(F.when(~base, span))).alias("more"))
    apart = F.filter("more", lambda m: ~F.exists("base", lambda b: (b["start"] < m["end"]) & (m["start"] < b["end"])))
    text = lambda a: F.array_join(F.transform(a, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")
    told = rows.join(per_row.withColumn("more", apart), "row", "left")
    empty = F.expr("cast(array() as array<struct<o:int,start:bigint,end:bigint,kind:string,score:double>>)")
    told = told.withColumns({"base": F.coalesce("base", empty), "more": F.coalesce("more", empty)})
    count = lambda k: F.size(F.filter("base", lambda x: x["kind"] == k)).cast("long").alias(f"n_{k}")
    return told.select("doc_id", *(count(k) for k in BASE), F.sha2(text(F.col("base")), 256).alias("base_sha256"), text(F.concat("base", "more")).alias("spans"), F.concat("base", "more").alias("found"))


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find(common.table(spark, sf_dir, "documents")).drop("found")
