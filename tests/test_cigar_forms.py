"""CIGARs of the usual forms, which are read without a fold, are read as all others are."""

import random
import re

from segmentry.functions import cigar as C
from pyspark.sql import functions as F


def plain_exons(start: int, text: str) -> list[tuple[int, int]]:
    at = begin = start
    out = []
    for n, op in re.findall(r"(\d+)([MIDNSHPX=])", text):
        if op == "N":
            out.append((begin, at))
        at += int(n) if op in "MDN" else 0
        begin = at if op == "N" else begin
    return out + [(begin, at)]


def plain_normal(text: str) -> str:
    out = []
    for n, op in re.findall(r"(\d+)([MIDNSHPX=])", text):
        if int(n) and out and out[-1][1] == op:
            out[-1] = (out[-1][0] + int(n), op)
        elif int(n):
            out.append((int(n), op))
    return "".join(f"{n}{op}" for n, op in out)


def test_exons_and_normal_form_of_any_cigar(spark):
    r = random.Random(3)
    texts = ["", "5M", "3S5M", "3H2S5M4S1H", "5M7N6M", "3S5M7N6M2S", "5M7N6M8N9M", "5M0N6M", "0M", "010M", "5M\n", "4M4M", "3S3S4M", "5N", "M", "5M2I", "1S11S", "12M2N3N4M", "5M x 7N6M"]
    texts += ["".join(f"{r.choice([0, 1, 2, 11, 12, 120])}{r.choice('MMMNSIDH')}" for _ in range(r.randint(1, 6))) for _ in range(400)]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i long, t string")
    found = rows.select("i", "t", C.exons(F.col("i"), F.col("t")).alias("e"), C.normalized(F.col("t")).alias("n")).collect()
    assert {x.i: [(e.start, e.end) for e in x.e] for x in found} == {i: plain_exons(i, t) for i, t in enumerate(texts)}
    assert {x.i: x.n for x in found} == {i: plain_normal(t) for i, t in enumerate(texts)}
    assert spark.sql("select cast(null as string) t, 1L i").select(C.exons(F.col("i"), F.col("t")).alias("e"), C.normalized(F.col("t")).alias("n")).collect() == [(None, None)]


def test_usual_forms_need_no_fold(spark):
    plan = spark.range(1).select(C.exons(F.col("id"), F.lit("3S5M7N6M"))).collect()
    assert [(e.start, e.end) for e in plan[0][0]] == [(0, 5), (12, 18)]
