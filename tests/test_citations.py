"""Places of claims and shares of bigrams in long and odd texts."""

import time

from pyspark.sql import functions as F

from lodeworks.operators import grounding
from lodeworks.plans import trust


def test_spans_in_long_lines_without_stops():
    line = "the limit of a page is one of many words " * 700
    began = time.process_time()
    assert grounding.span_of("limit of 5 pages here", f"{line}\n{line}\nno.") == ("not_found", None, None, 0.0)
    kind, start, end, score = grounding.span_of("the size of a file", f"{line}\nthe size of one file! {line}\nlast")
    assert (kind, start, end) == ("sentence_overlap", len(line) + 1, len(line) + 22) and score > 0.5
    assert time.process_time() - began < 2  # the lines were read once for each of their characters


def test_spans_between_breaks_and_stops():
    assert grounding.span_of("alpha beta", "alpha bet x\nalpha bet?")[:3] == ("sentence_overlap", 12, 22)  # the first line has no stop
    assert grounding.span_of("alpha beta", "gamma\nalpha bet\n")[:3] == ("sentence_overlap", 6, 15)  # the end of the text is one, also before its last break
    assert grounding.span_of("straße 5", "Die STRASSE, 5.")[:3] == ("normalized_exact", 4, 14)
    assert grounding.span_of("", "x") == grounding.span_of("x", "") == grounding.span_of(None, None) == ("not_found", None, None, 0.0)


def test_texts_are_stripped_once_not_for_each_bigram(spark, tmp_path):
    text = "Ab, cd-ef gh_ij! kl. " * 8000
    letters = "".join(chr(97 + i) + chr(97 + (i * 7 + j) % 26) for i in range(26) for j in range(12))
    spark.createDataFrame([(i, text) for i in range(12)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(0, letters), (1, "gh ij kl xy")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    trust.citation_overlap(spark, str(tmp_path)).where("false").count()
    began = time.perf_counter()
    got = {r.doc_id: r.score for r in trust.citation_overlap(spark, str(tmp_path)).collect()}
    assert time.perf_counter() - began < 8
    assert len(got) == 12 and got[1] == got[11] == round(5 / 7, 6) and 0 < got[0] < 0.2


def test_overlap_compares_letters_and_numbers_only(spark, tmp_path):
    rows = [(0, "cafe\u0301 \u00b2\u00bd"), (1, "cafe")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(0, "CAFE \u00b2\u00bd"), (1, "c\u0301afe")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = trust.citation_overlap(spark, str(tmp_path)).select("doc_id", F.col("score")).collect()
    assert {tuple(r) for r in got} == {(0, 1.0), (1, 1.0)}  # as the SQL: [^\pL\pN] goes
