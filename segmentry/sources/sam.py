"""Alignments from the lines of a SAM text."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def parse_sam(lines: DataFrame) -> DataFrame:
    """One row per alignment line: the fixed fields, a start from 0, the strand of the flag, and ``tags`` by name. Header lines and short ones are left out. Of equal tags the first counts.

    The order of the lines is of no use here; ``check_header`` asks for what the header says of it.
    """
    x = lines.where(~F.col("line").startswith("@")).select(F.split("line", "\t").alias("f")).where(F.size("f") >= 11)
    flag = F.col("f")[1].cast("int")
    pairs = F.transform(F.slice("f", 12, F.size("f")), lambda t: F.struct(F.substring(t, 1, 2).alias("name"), F.regexp_replace(t, "^[^:]*:[^:]*:", "").alias("value")))
    names = F.transform(pairs, lambda p: p["name"])
    tags = F.map_from_entries(F.filter(pairs, lambda p, i: F.array_position(names, p["name"]) == i + 1))
    return x.select(
        F.col("f")[0].alias("name"), flag.alias("flag"), F.col("f")[2].alias("chrom"), (F.col("f")[3].cast("bigint") - 1).alias("ref_start"), F.when(flag.bitwiseAND(16) > 0, "-").otherwise("+").alias("strand"),
        F.col("f")[4].cast("int").alias("mapq"), F.col("f")[5].alias("cigar"), F.col("f")[9].alias("bases"), F.col("f")[10].alias("quals"), tags.alias("tags"),
    )


def check_header(lines: DataFrame, order: str = "coordinate") -> None:
    """Raise an error unless the ``@HD`` line says that the alignments are sorted by ``order``."""
    told = lines.where(F.col("line").startswith("@HD\t")).select(F.regexp_extract("line", r"\tSO:([^\t]*)", 1).alias("so")).limit(2).collect()
    if [r.so for r in told] != [order]:
        raise ValueError(f"the header must say SO:{order}, it says {[r.so for r in told] or 'nothing'}")
