"""Alignments, exons and genome derived from the star-schema tables.

An order is a long read and its line items are the segments that tile it. Reads of one
locus family share segments; families have at most 128 order keys each, so they grow in number with
the data, not in size. The SQL is the same for Spark and for the oracle.
"""

from pyspark.sql import DataFrame, SparkSession

ALIGNMENTS = """
with li as (select l_orderkey, l_partkey, l_suppkey,
    row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate) - 1 as k
  from lineitem),
s as (select *, cast(floor(l_orderkey / 128) as bigint) as fam, 200 + 10 * (cast(floor(l_orderkey / 128) as bigint) % 7) + 20 * k as m from li),
t as (select *, sum(m) over (partition by l_orderkey) as qlen,
    sum(m) over (partition by l_orderkey order by k) - m as pre,
    count(*) over (partition by l_orderkey) as nseg,
    case when k = 0 then 0 else fam % 10 - 3 end as j from s),
z as (select l_orderkey as read_id, cast(k as int) as seg_ord, cast(nseg as int) as nseg, fam,
    concat('chr', cast(1 + (fam * 3 + k * 5 * (fam % 2)) % 22 as int)) as chrom,
    cast(100000 + 100000 * fam + 5000 * k - j as bigint) as ref_start,
    case when (fam + k * (fam % 3)) % 3 = 0 then '-' else '+' end as strand,
    cast(pre - j as int) as q_start, cast(m + j as int) as q_match, cast(qlen as int) as q_len,
    cast(case when k % 2 = 1 then 700 else 0 end as int) as intron,
    cast(20 + l_suppkey % 41 as int) as mapq, cast(l_partkey % 12 as int) as nm from t),
c as (select *, cast(case when strand = '+' then q_start else q_len - q_start - q_match end as int) as lt,
    cast(case when strand = '+' then q_len - q_start - q_match else q_start end as int) as rt from z)
select read_id, seg_ord, nseg, fam, chrom, ref_start, strand, q_start, q_match, q_len, mapq, nm, lt, rt,
  concat(case when lt > 0 then concat(lt, 'S') else '' end,
    case when intron > 0 then concat(100, 'M', intron, 'N', q_match - 100, 'M') else concat(q_match, 'M') end,
    case when rt > 0 then concat(rt, 'S') else '' end) as cigar from c
"""

EXONS = """
select p.p_partkey as tx, p.p_name as gene, cast(e.i as int) as exon_no,
  concat('chr', cast(1 + (fam * 3 + locus * 5 * (fam % 2)) % 22 as int)) as chrom,
  cast(100000 + 100000 * fam + 5000 * locus + 800 * e.i as bigint) as e_start,
  cast(100000 + 100000 * fam + 5000 * locus + 800 * e.i + 100 + p.p_size as bigint) as e_end,
  case when p.p_partkey % 3 = 0 then '-' else '+' end as strand
from (select *, cast(floor(p_partkey / 8) as bigint) as fam, p_partkey % 4 as locus from part) p
cross join (select 0 as i union all select 1 union all select 2) e
"""

# Each document is a locus family; its whole text, as bases, is laid out in chunks of 5,000 that begin 100 before a locus.
_GENOME = """
select concat('chr', cast(1 + (doc_id * 3 + p * 5 * (doc_id % 2)) % 22 as int)) as chrom, cast(20 + 20 * doc_id + p as bigint) as chunk_no,
  rpad(regexp_replace(translate(substring(text, cast(5000 * p + 1 as int), 5000), 'abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'ACGTACGTACGTACGTACGTACGTACACGTACGTACGTACGTACGTACGTAC'), '[^ACGT]', 'N'GLOBAL), 5000, 'N') as seq
from (select doc_id, text, EXPLODE as p from documents where length(text) > 0) d
"""
_LAST = "cast(floor((length(text) - 1) / 5000) as int)"
#: For the oracle; Spark's form differs in how rows are made of a range.
GENOME = _GENOME.replace("GLOBAL", ", 'g'").replace("EXPLODE", f"unnest(generate_series(0, {_LAST}))")


#: What texts have besides letters: read as N at once, so that the pattern, which costs ten times as much, has little left to find.
_REST = " \n\t.,;:!?()[]{}<>/|@#%&*+=_~^$0123456789-"


def genome(spark: SparkSession, sf_dir: str) -> DataFrame:
    """chrom, chunk_no and bases; a chunk begins at 5,000 * chunk_no - 100. Texts are dealt out first, as a file of them may be one task."""
    text = _GENOME.replace("GLOBAL", "").replace("EXPLODE", f"explode(sequence(0, {_LAST}))").replace("from documents", "from {documents}")
    text = text.replace("ABCDEFGHIJKLMNOPQRSTUVWXYZ'", "ABCDEFGHIJKLMNOPQRSTUVWXYZ' || {rest}").replace("CGTACGTAC'", "CGTACGTAC' || {n}")
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").repartition("doc_id")
    return spark.sql(text, documents=documents, rest=_REST, n="N" * len(_REST))


def alignments(spark: SparkSession, sf_dir: str, ranged: bool = False) -> DataFrame:
    """One row per segment of a read: place on the genome, place in the read, CIGAR. ``ranged``: reads are dealt by ranges of their numbers, so those of a family stay together."""
    lineitem = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    if ranged:
        lineitem = lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate").repartitionByRange("l_orderkey")
    return spark.sql(ALIGNMENTS.replace("from lineitem", "from {lineitem}"), lineitem=lineitem)


def exons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per exon of a transcript."""
    return spark.sql(EXONS.replace("from part)", "from {part})"), part=spark.read.parquet(f"{sf_dir}/part.parquet"))


def genes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of genes at each locus; a name may stand at many."""
    from pyspark.sql import functions as F

    return exons(spark, sf_dir).groupBy("gene", "chrom", F.floor(F.col("e_start") / 5000).alias("locus")).agg(F.min("e_start").alias("g_start"), F.max("e_end").alias("g_end"))


# Chunks under all ends of segments, of bases made of the chunk's own digests: a genome without gaps there.
SITES_GENOME = """
select chrom, chunk_no, rpad(b, 5000, b) as seq
from (select chrom, chunk_no, translate(concat(md5(concat(chrom, ':', chunk_no)), md5(concat(chunk_no, ':', chrom))), '0123456789abcdef', 'ACGTACGTACGTACGT') as b
  from (select distinct chrom, cast(floor((case when side = 0 then ref_start else ref_end end + shift) / 5000) as bigint) as chunk_no
    from seg cross join (select 0 as side, 60 as shift union all select 0, 140 union all select 1, 60 union all select 1, 140) e) c) d
"""


def sites_genome(segments: DataFrame) -> DataFrame:
    """Chunks as ``genome`` has them, under the ends of the segments."""
    return segments.sparkSession.sql(SITES_GENOME.replace("from seg ", "from {seg} "), seg=segments.select("chrom", "ref_start", "ref_end").distinct())


#: Read sequences: bases made of the read's own digest, repeated to its length.
READS = """
select read_id, q_len, rpad(b, q_len, b) as bases
from (select read_id, q_len, translate(md5(cast(read_id as string)), '0123456789abcdef', 'ACGTACGTACGTACGT') as b
  from (select distinct read_id, q_len from alignments) a) d
"""

# Eight parts are nodes of one locus; tens of their sizes vary inner ends, and first and last exons may be missing.
NODES = """
select node_id, fam, chrom, strand, ident, genuine, e.i as i,
  cast(100000 + 100000 * fam + 800 * e.i + case when e.i = lo then 4 * (size % 3) else 0 end as bigint) as e_start,
  cast(100000 + 100000 * fam + 800 * e.i + 100 + case when e.i = hi then 4 * (size % 4) else 10 * (lot % 2) end as bigint) as e_end
from (select p_partkey as node_id, cast(floor(p_partkey / 8) as bigint) as fam, p_size as size, cast(floor(p_size / 10) as int) as lot,
    concat('chr', cast(1 + (cast(floor(p_partkey / 8) as bigint) * 3) % 22 as int)) as chrom,
    case when floor(p_partkey / 8) % 2 = 0 then '+' else '-' end as strand,
    case when p_partkey % 3 = 0 then 'HEAD' when p_partkey % 3 = 1 then 'MID' else 'TAIL' end as ident, p_size % 2 = 0 as genuine,
    case when p_partkey % 5 = 0 then 1 when p_partkey % 7 = 0 then 2 else 0 end as lo, case when p_partkey % 11 = 0 and p_partkey % 7 <> 0 then 1 else 2 end as hi
  from part) n
join (select 0 as i union all select 1 union all select 2) e on e.i between n.lo and n.hi
"""


def reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bases of each read."""
    return spark.sql(READS.replace("from alignments", "from {a}"), a=alignments(spark, sf_dir))


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per node of a locus: chrom, strand, identity, whether its end is genuine, and its exons in order."""
    from pyspark.sql import functions as F

    x = spark.sql(NODES.replace("from part)", "from {part})"), part=spark.read.parquet(f"{sf_dir}/part.parquet"))
    exon = F.struct(F.col("e_start").alias("start"), F.col("e_end").alias("end"))
    return x.groupBy("node_id", "fam", "chrom", "strand", "ident", "genuine").agg(F.array_sort(F.collect_list(exon)).alias("exons"))


# Three nodes in turn, a head, a middle and a tail, are a path; at the end of every second family one is cut in two. A line item is a read along the path of its part.
PATH_READS = "select l_orderkey * 8 + l_linenumber as read_id, cast(floor(l_partkey / 3) as bigint) as three, cast(floor(l_partkey / 16) as bigint) as two from lineitem"
PATH_EDGES = """
select a.node_id as src, b.node_id as dst, case when a.strand = '+' then a.hi else a.lo end as pos1, case when b.strand = '+' then b.lo else b.hi end as pos2, cast((a.node_id * 7) % 5 - 2 as int) as gap
from spans a join spans b on b.node_id = a.node_id + 1 and floor(b.node_id / 3) = floor(a.node_id / 3) and floor(b.node_id / 16) = floor(a.node_id / 16)
"""


def path_places(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(nodes with identity, possible edges with the ``three`` and ``two`` that their reads have, read_id, three and two of the reads)."""
    from pyspark.sql import functions as F

    from segmentry.shared import stored

    n = stored(nodes(spark, sf_dir), "nodes")
    spans = n.select("node_id", "strand", F.element_at("exons", 1)["start"].alias("lo"), F.element_at("exons", -1)["end"].alias("hi"))
    edges = spark.sql(PATH_EDGES.replace("spans", "{spans}"), spans=spans)
    reads = spark.sql(PATH_READS.replace("from lineitem", "from {l}"), l=spark.read.parquet(f"{sf_dir}/lineitem.parquet"))
    return n, edges.select("*", *_place("src")), reads


def _place(c: str):
    from pyspark.sql import functions as F

    return F.floor(F.col(c) / 3).alias("three"), F.floor(F.col(c) / 16).alias("two")


def walked(edges: DataFrame, reads: DataFrame) -> DataFrame:
    """The ``edges`` of ``path_places`` that a read has; the reads are no rows of their own."""
    return edges.join(reads.select("three", "two").distinct(), ["three", "two"], "left_semi").drop("three", "two")


def grouped_reads(reads: DataFrame) -> DataFrame:
    """read_id, n, three and two: the reads of one place only are a row for each place, by the smallest of them, and ``n`` of them; another read has a row for each of its places."""
    from pyspark.sql import Window
    from pyspark.sql import functions as F

    own = Window.partitionBy("read_id")
    before = F.lag(F.struct("three", "two")).over(own.orderBy("three", "two"))
    x = reads.withColumns({"_before": before, "_lo": F.min("three").over(own), "_hi": F.max("three").over(own), "_lo2": F.min("two").over(own), "_hi2": F.max("two").over(own)})
    x = x.where("_before is null or _before.three <> three or _before.two <> two")
    alone = (F.col("_lo") == F.col("_hi")) & (F.col("_lo2") == F.col("_hi2"))
    return x.groupBy("three", "two", F.when(~alone, F.col("read_id")).alias("_own")).agg(F.min("read_id").alias("read_id"), F.count("*").alias("n")).drop("_own")


def path_graph(spark: SparkSession, sf_dir: str, grouped: bool = False):
    """(nodes with identity, graph of the reads' paths before anything is merged, read_id and node_id of nodes in the middle of a read's path); ``grouped``: with ``grouped_reads``."""
    from segmentry.operators.contraction import Graph
    from segmentry.shared import stored

    n, edges, reads = path_places(spark, sf_dir)
    reads = stored(grouped_reads(reads) if grouped else reads, "reads")
    edge_reads = stored(edges.select("src", "dst", "three", "two").join(reads, ["three", "two"]).drop("three", "two"), "edge_reads")
    mids = n.where("ident = 'MID'").select("node_id", *_place("node_id")).join(reads, ["three", "two"]).select("read_id", "node_id")
    return n, Graph(n.select("node_id", "chrom", "strand", "exons"), walked(edges, reads), edge_reads), mids
