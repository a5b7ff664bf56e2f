"""Annotation lines."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def parse_gtf(lines: DataFrame) -> DataFrame:
    """Rows of ``line``: chrom, type, start from 0, end, strand, gene and attributes.

    Comments, lines of fewer than nine fields and chromosomes with ``_`` or ``.`` are left out.
    The gene is ``gene_name``, else ``gene``, else null; of equal attributes the first counts.
    """
    f = F.split("line", "\t", 9)
    keys, values = (F.regexp_extract_all(f[8], F.lit(r'(\w+) "([^"]*)"'), F.lit(i)) for i in (1, 2))
    pairs = F.filter(F.arrays_zip(keys.alias("k"), values.alias("v")), lambda p: p["k"].isNotNull())
    first = F.filter(pairs, lambda p, i: F.array_position(F.transform(pairs, lambda q: q["k"]), p["k"]) == i + 1)
    x = lines.where(~F.col("line").startswith("#") & (F.size(f) == 9) & ~f[0].rlike("[_.]"))
    x = x.select(f[0].alias("chrom"), f[2].alias("type"), (f[3].cast("bigint") - 1).alias("start"), f[4].cast("bigint").alias("end"), f[6].alias("strand"), F.map_from_entries(first).alias("attributes"))
    return x.withColumn("gene", F.coalesce(F.try_element_at("attributes", F.lit("gene_name")), F.try_element_at("attributes", F.lit("gene"))))


def read_gtf(spark, path: str) -> DataFrame:
    return parse_gtf(spark.read.text(path).withColumnRenamed("value", "line"))
