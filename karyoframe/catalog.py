"""Queries over the driver's tables, and the SQL that gives the same rows.

The tables hold no genomes: an alignment table is derived from ``orders`` by integer arithmetic, equal in both engines.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import cigar_ops, identity_100, plain_bases, query_span, reference_span, reverse_complement, slice_1based, whole_cigar
from .operators import filters as fi
from .operators import intervals as iv
from .operators import joins as jo
from .operators import variants as va
from .operators.chain import syntenic_chain

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def _query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def alignments(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderkey").cast("long").alias("k")).withColumn("g", F.expr("k div 5")).withColumn("kind", F.expr("g * 31 % 20"))
    o = o.selectExpr("k AS aln_id", "concat('Chr', 1 + k % 5) AS a_chr", "concat('Chr', 1 + (if(kind >= 18, k + 1, k)) % 5) AS b_chr", "1 + g * 700 + (k * 7919) % 300 AS a_start", "200 + (k * 104729) % 900 AS ln", "if(kind BETWEEN 13 AND 15 OR kind = 19, -1, 1) AS b_dir", "if(kind IN (16, 17), 90000, 0) + (k * 17) % 41 AS shift", "9001 + (k * 13) % 999 AS iden100", "k % 7 AS more", "kind")
    o = o.selectExpr("*", "a_start + ln AS a_end", "a_start + shift AS lo", "a_start + shift + ln + more AS hi", "ln + more + 1 AS b_len")
    return o.selectExpr("aln_id", "a_chr", "b_chr", "a_start", "a_end", "if(b_dir = 1, lo, hi) AS b_start", "if(b_dir = 1, hi, lo) AS b_end", "b_dir", "iden100", "ln", "b_len", "kind")


ALN = """WITH o AS (SELECT CAST(o_orderkey AS BIGINT) k, CAST(o_orderkey AS BIGINT) // 5 g FROM orders), o2 AS (SELECT *, g * 31 % 20 kind FROM o),
o3 AS (SELECT k AS aln_id, 'Chr' || (1 + k % 5) AS a_chr, 'Chr' || (1 + (CASE WHEN kind >= 18 THEN k + 1 ELSE k END) % 5) AS b_chr, 1 + g * 700 + (k * 7919) % 300 AS a_start, 200 + (k * 104729) % 900 AS ln, CASE WHEN kind BETWEEN 13 AND 15 OR kind = 19 THEN -1 ELSE 1 END AS b_dir, (CASE WHEN kind IN (16, 17) THEN 90000 ELSE 0 END) + (k * 17) % 41 AS shift, 9001 + (k * 13) % 999 AS iden100, k % 7 AS more, kind FROM o2),
o4 AS (SELECT *, a_start + ln AS a_end, a_start + shift AS lo, a_start + shift + ln + more AS hi, ln + more + 1 AS b_len FROM o3),
aln AS (SELECT aln_id, a_chr, b_chr, a_start, a_end, CASE WHEN b_dir = 1 THEN lo ELSE hi END AS b_start, CASE WHEN b_dir = 1 THEN hi ELSE lo END AS b_end, b_dir, iden100, ln, b_len, kind FROM o4)
"""
MERGED = """, f AS (SELECT *, max(a_end) OVER (PARTITION BY a_chr ORDER BY a_start, a_end ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS top FROM aln),
i AS (SELECT *, sum(CASE WHEN top IS NULL OR a_start > top THEN 1 ELSE 0 END) OVER (PARTITION BY a_chr ORDER BY a_start, a_end ROWS UNBOUNDED PRECEDING) AS island FROM f),
merged AS (SELECT a_chr, min(a_start) AS a_start, max(a_end) AS a_end FROM i GROUP BY a_chr, island)
"""


@_query(ALN + """, s AS (SELECT *, row_number() OVER (PARTITION BY a_chr ORDER BY a_start, a_end, b_start, b_end, aln_id) AS r, (ln + 1 + b_len) * iden100 AS w FROM aln WHERE a_chr = b_chr AND b_dir = 1),
g AS (SELECT a_chr, list(a_start ORDER BY r) a, list(a_end ORDER BY r) ae, list(b_start ORDER BY r) b, list(b_end ORDER BY r) be, list(w ORDER BY r) w, count(*) n FROM s GROUP BY a_chr),
c AS (WITH RECURSIVE d AS (SELECT a_chr, 0 AS k, CAST([] AS BIGINT[]) AS sc FROM g UNION ALL
 SELECT d.a_chr, d.k + 1, list_append(d.sc, CAST(g.w[d.k + 1] + coalesce(list_max(list_transform(range(1, d.k + 1), lambda i: CASE WHEN g.a[i] < g.a[d.k + 1] - 50 AND g.ae[i] < g.ae[d.k + 1] - 50 AND g.b[i] < g.b[d.k + 1] - 50 AND g.be[i] < g.be[d.k + 1] - 50 THEN d.sc[i] ELSE 0 END)), 0) AS BIGINT))
 FROM d JOIN g USING (a_chr) WHERE d.k < g.n) SELECT d.a_chr, list_max(sc) AS max_score FROM d JOIN g USING (a_chr) WHERE d.k = g.n)
SELECT a_chr, CAST(max_score AS BIGINT) AS max_score FROM c""")
def syn_chain_score(spark, sf_dir):
    return syntenic_chain(alignments(spark, sf_dir)).groupBy("a_chr").agg(F.max("max_score").alias("max_score"))


@_query()
def syn_chain_rows(spark, sf_dir):
    return syntenic_chain(alignments(spark, sf_dir))


@_query(ALN + "SELECT * FROM aln WHERE iden100 > 9000 AND ln > 100 AND b_len > 100")
def quality_filter(spark, sf_dir):
    return iv.quality_filter(alignments(spark, sf_dir))


@_query(ALN + "SELECT aln_id, least(b_start, b_end) AS b_low, greatest(b_start, b_end) AS b_high, max(greatest(b_start, b_end)) OVER (PARTITION BY b_chr) + 1 - b_start AS m_start, max(greatest(b_start, b_end)) OVER (PARTITION BY b_chr) + 1 - b_end AS m_end FROM aln")
def reverse_normalise(spark, sf_dir):
    return iv.mirror_b(iv.normalise_reverse(alignments(spark, sf_dir)), ["b_chr"]).select("aln_id", "b_low", "b_high", "m_start", "m_end")


@_query(ALN + MERGED + "SELECT * FROM merged")
def merge_ranges(spark, sf_dir):
    return iv.merge_ranges(alignments(spark, sf_dir), ["a_chr"], "a_start", "a_end")


@_query(ALN + MERGED + "SELECT a_chr, CAST(sum(a_end - a_start + 1) AS BIGINT) AS covered FROM merged GROUP BY a_chr")
def covered_length(spark, sf_dir):
    return iv.covered_length(alignments(spark, sf_dir), ["a_chr"], "a_start", "a_end")


@_query(ALN + MERGED + """, z AS (SELECT a_chr, max(a_end) + 5000 AS size FROM aln GROUP BY a_chr), x AS (SELECT *, lag(a_end) OVER (PARTITION BY a_chr ORDER BY a_start) AS p FROM merged)
SELECT a_chr, gap_start, gap_end FROM (SELECT a_chr, coalesce(p, 0) + 1 AS gap_start, a_start - 1 AS gap_end FROM x UNION ALL SELECT a_chr, max(a_end) + 1, max(size) FROM merged JOIN z USING (a_chr) GROUP BY a_chr) WHERE gap_start <= gap_end""")
def not_aligned_gaps(spark, sf_dir):
    sizes = alignments(spark, sf_dir).groupBy("a_chr").agg((F.max("a_end") + 5000).alias("size"))
    return iv.uncovered(alignments(spark, sf_dir), sizes, "a_chr", "a_start", "a_end")


@_query(ALN + """, p AS (SELECT event_id, 'Chr' || (1 + event_id % 5) AS a_chr, 1 + (event_id * 7) % (SELECT max(a_end) FROM aln) AS pos FROM events)
SELECT aln_id, event_id FROM aln JOIN p ON aln.a_chr = p.a_chr AND pos BETWEEN a_start AND a_end""")
def point_annotation(spark, sf_dir):
    aln = alignments(spark, sf_dir)
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id").crossJoin(F.broadcast(aln.agg(F.max("a_end").alias("top"))))  # one row
    e = e.selectExpr("event_id", "concat('Chr', 1 + event_id % 5) AS a_chr", "1 + (event_id * 7) % top AS r_start", "1 + (event_id * 7) % top AS r_end")
    left = aln.selectExpr("aln_id", "a_chr", "a_start AS l_start", "a_end AS l_end")
    return iv.overlap_join(left, e, "a_chr", 2000).select("aln_id", "event_id")


@_query(ALN + "SELECT x.aln_id AS l_id, y.aln_id AS r_id FROM aln x JOIN aln y ON x.a_chr = y.a_chr AND x.a_start < y.a_end AND y.a_start < x.a_end AND x.kind < 6 AND y.kind >= 6")
def interval_overlap(spark, sf_dir):
    side = lambda p, w: alignments(spark, sf_dir).where(w).selectExpr(f"aln_id AS {p}_id", "a_chr", f"a_start AS {p}_start", f"a_end AS {p}_end")
    return iv.overlap_join(side("l", "kind < 6"), side("r", "kind >= 6"), "a_chr", 2000, closed=False).select("l_id", "r_id")


@_query(ALN + """SELECT x.aln_id AS i, y.aln_id AS j FROM aln x JOIN aln y ON x.a_chr = y.a_chr AND x.a_chr = x.b_chr AND y.a_chr = y.b_chr AND x.b_dir = 1 AND y.b_dir = 1
AND y.a_start - x.a_start > 50 AND y.a_end - x.a_end > 50 AND y.b_start - x.b_start > 50 AND y.b_end - x.b_end > 50 AND y.a_start - x.a_end < 500000 AND y.b_start - x.b_end < 500000""")
def compatible_pairs(spark, sf_dir):
    return jo.compatible_pairs(alignments(spark, sf_dir).where("a_chr = b_chr and b_dir = 1"), ["a_chr"], 500_000)


PAIRS = ALN + """, f AS (SELECT *, max(a_end) OVER (PARTITION BY a_chr, b_chr ORDER BY a_start, a_end ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS top FROM aln),
i AS (SELECT *, sum(CASE WHEN top IS NULL OR a_start > top THEN 1 ELSE 0 END) OVER (PARTITION BY a_chr, b_chr ORDER BY a_start, a_end ROWS UNBOUNDED PRECEDING) AS island FROM f),
m AS (SELECT a_chr, b_chr, min(a_start) AS s, max(a_end) AS e FROM i GROUP BY a_chr, b_chr, island)"""


@_query(PAIRS + ", c AS (SELECT a_chr, b_chr, CAST(sum(e - s + 1) AS BIGINT) AS covered FROM m GROUP BY ALL) SELECT a_chr, b_chr, covered FROM (SELECT *, row_number() OVER (PARTITION BY a_chr ORDER BY covered DESC, b_chr) AS r FROM c) WHERE r = 1")
def chr_match(spark, sf_dir):
    return iv.best_partner(alignments(spark, sf_dir))


def _bins(pairs: str, size: int) -> str:
    """Majority per half-open bin, from merged ranges m (a_chr, b_chr, s, e)."""
    return f"""{pairs}, b AS (SELECT a_chr, b_chr, s, e, unnest(range(s // {size}, (e - 1) // {size} + 1)) AS bin FROM m),
h AS (SELECT a_chr, bin, b_chr, CAST(sum(least(e, (bin + 1) * {size}) - greatest(s, bin * {size})) AS BIGINT) AS held FROM b GROUP BY ALL),
best AS (SELECT a_chr, bin, b_chr, held FROM (SELECT *, row_number() OVER (PARTITION BY a_chr, bin ORDER BY held DESC, b_chr) AS r FROM h) WHERE r = 1)"""


SLIDE = """, z AS (SELECT a_chr, count(*) AS n FROM best GROUP BY a_chr), w AS (SELECT a_chr, unnest(range(n - 4)) AS i FROM z WHERE n > 50),
keep AS (SELECT DISTINCT w.a_chr, b_chr FROM w JOIN best ON best.a_chr = w.a_chr AND bin BETWEEN i AND i + 4 GROUP BY w.a_chr, i, b_chr HAVING count(*) >= 3 UNION SELECT a_chr, b_chr FROM best JOIN z USING (a_chr) WHERE n <= 50)"""
#: Merged ranges of query chromosomes, under the names that _bins() takes.
QUERY_PAIRS = ALN + """, q AS (SELECT b_chr AS a_chr, a_chr AS b_chr, least(b_start, b_end) AS a_start, greatest(b_start, b_end) AS a_end FROM aln),
f AS (SELECT *, max(a_end) OVER (PARTITION BY a_chr, b_chr ORDER BY a_start, a_end ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS top FROM q),
i AS (SELECT *, sum(CASE WHEN top IS NULL OR a_start > top THEN 1 ELSE 0 END) OVER (PARTITION BY a_chr, b_chr ORDER BY a_start, a_end ROWS UNBOUNDED PRECEDING) AS island FROM f),
m AS (SELECT a_chr, b_chr, min(a_start) AS s, max(a_end) AS e FROM i GROUP BY a_chr, b_chr, island)"""


@_query(_bins(PAIRS, 10000) + "SELECT * FROM best")
def bin_majority(spark, sf_dir):
    return iv.majority_per_bin(alignments(spark, sf_dir), "a_chr", "b_chr", 10000, "a_start", "a_end")


def _query_side(spark, sf_dir) -> DataFrame:
    return iv.normalise_reverse(alignments(spark, sf_dir)).select("aln_id", F.col("b_chr").alias("a_chr"), F.col("a_chr").alias("b_chr"), F.col("b_low").alias("a_start"), F.col("b_high").alias("a_end"), "b_dir")


@_query(_bins(QUERY_PAIRS, 10000) + "SELECT * FROM best")
def bin_majority_query(spark, sf_dir):
    return iv.majority_per_bin(_query_side(spark, sf_dir), "a_chr", "b_chr", 10000, "a_start", "a_end")


@_query(_bins(PAIRS, 2000) + SLIDE + "SELECT * FROM keep")
def sliding_majority(spark, sf_dir):
    return iv.sliding_majority(iv.majority_per_bin(alignments(spark, sf_dir), "a_chr", "b_chr", 2000, "a_start", "a_end"), "a_chr", "b_chr")


@_query("WITH r AS (" + _bins(PAIRS, 2000) + SLIDE + "SELECT * FROM keep), q AS (" + _bins(QUERY_PAIRS, 2000) + SLIDE + "SELECT b_chr AS a_chr, a_chr AS b_chr FROM keep) SELECT a_chr, b_chr FROM r JOIN q USING (a_chr, b_chr)")
def reciprocal_partners(spark, sf_dir):
    kept = lambda d: iv.sliding_majority(iv.majority_per_bin(d, "a_chr", "b_chr", 2000, "a_start", "a_end"), "a_chr", "b_chr")
    return jo.reciprocal(kept(alignments(spark, sf_dir)), kept(_query_side(spark, sf_dir)).select(F.col("b_chr").alias("a_chr"), F.col("a_chr").alias("b_chr")))


@_query(ALN + """, f AS (SELECT *, max(a_end) OVER (PARTITION BY a_chr, b_chr, b_dir ORDER BY a_start, a_end ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS top FROM aln),
i AS (SELECT *, sum(CASE WHEN top IS NULL OR a_start > top THEN 1 ELSE 0 END) OVER (PARTITION BY a_chr, b_chr, b_dir ORDER BY a_start, a_end ROWS UNBOUNDED PRECEDING) AS island FROM f),
m AS (SELECT a_chr, b_chr, b_dir, max(a_end) - min(a_start) AS n FROM i GROUP BY a_chr, b_chr, b_dir, island)
SELECT a_chr, b_chr, CASE WHEN sum(CASE WHEN b_dir = 1 THEN n ELSE 0 END) >= sum(CASE WHEN b_dir = -1 THEN n ELSE 0 END) THEN 1 ELSE -1 END AS strand FROM m GROUP BY a_chr, b_chr""")
def strand_majority(spark, sf_dir):
    return iv.strand_majority(alignments(spark, sf_dir), ["a_chr", "b_chr"])


#: What comes next in a block, the gaps m and n, and the variant by the rows of the table of gaps, with its coordinates.
GAPS = """, l AS (SELECT *, lead(a_start) OVER p AS na, lead(a_end) OVER p AS nae, lead(b_start) OVER p AS nb, lead(b_end) OVER p AS nbe FROM w WINDOW p AS (PARTITION BY block ORDER BY a_start, a_end, b_start, b_end, aln_id)),
g AS (SELECT *, na - a_end - 1 AS m, CASE WHEN b_dir = 1 THEN nb - b_end - 1 ELSE b_end - nb - 1 END AS n FROM l WHERE na IS NOT NULL),
k AS (SELECT *, CASE WHEN m >= -5 AND m <= 0 AND n > 0 THEN 'INS' WHEN m = 1 AND n = 1 THEN 'SNP' WHEN m >= 1 AND n >= 1 THEN 'HDR' WHEN m >= 1 AND n >= -5 THEN 'DEL' WHEN m >= -5 AND n < -5 THEN 'CPL' WHEN m >= -5 THEN NULL WHEN n >= -5 THEN 'CPG' WHEN abs(m - n) < 0.1 * greatest(abs(m), abs(n)) THEN NULL ELSE 'TDM' END AS kind FROM g),
c AS (SELECT *, kind = 'CPL' OR (kind = 'TDM' AND abs(m) <= abs(n)) AS loss, kind = 'CPG' OR (kind = 'TDM' AND abs(m) > abs(n)) AS gain, CAST(b_dir AS BIGINT) AS d FROM k WHERE kind IS NOT NULL),
sv AS (SELECT block, kind, m, n,
CAST(CASE WHEN loss THEN round_even(a_end - CAST(abs(n) AS DOUBLE) / abs(b_end - b_start) * (a_end - a_start), 0) WHEN gain THEN na WHEN kind = 'INS' THEN a_end ELSE a_end + 1 END AS BIGINT) AS sv_a_start,
CAST(CASE WHEN loss THEN round_even(na + CAST(abs(n) AS DOUBLE) / abs(nbe - nb) * (nae - na), 0) WHEN gain THEN a_end WHEN kind = 'INS' THEN a_end ELSE na - 1 END AS BIGINT) AS sv_a_end,
CAST(CASE WHEN loss THEN nb WHEN gain THEN round_even(b_end - CAST(abs(m) AS DOUBLE) / (a_end - a_start) * (b_end - b_start), 0) WHEN kind = 'DEL' THEN b_end ELSE b_end + d END AS BIGINT) AS sv_b_start,
CAST(CASE WHEN loss THEN b_end WHEN gain THEN round_even(nb + CAST(abs(m) AS DOUBLE) / (nae - na) * (nbe - nb), 0) WHEN kind = 'DEL' THEN b_end ELSE nb - d END AS BIGINT) AS sv_b_end FROM c)
"""
BLOCKS = ALN + """, w AS (SELECT * EXCLUDE (kind), a_chr || b_chr || '/' || (a_start // 50000) || '/' || b_dir AS block FROM aln)"""


def _blocks(spark, sf_dir) -> DataFrame:
    return alignments(spark, sf_dir).withColumn("block", F.expr("concat(a_chr, b_chr, '/', a_start div 50000, '/', b_dir)"))


@_query(BLOCKS + GAPS + "SELECT * FROM sv")
def sv_classify(spark, sf_dir):
    return va.classify_gaps(_blocks(spark, sf_dir), "block", ["a_start", "a_end", "b_start", "b_end", "aln_id"])


CIG = ALN + """, c AS (SELECT aln_id, a_start, b_start, b_dir, (10 + aln_id % 90) || '=' || (1 + aln_id % 3) || 'X' || (5 + aln_id % 11) || '=' || (1 + aln_id % 4) || 'I' || (7 + aln_id % 13) || '=' || (1 + aln_id % 5) || 'D9=2I3=1D1=2D' || (1 + aln_id % 2) || 'I3I1X4=' AS cigar FROM aln)"""


def _cigars(spark, sf_dir):
    aln = alignments(spark, sf_dir).withColumn("cigar", F.expr("concat(10 + aln_id % 90, '=', 1 + aln_id % 3, 'X', 5 + aln_id % 11, '=', 1 + aln_id % 4, 'I', 7 + aln_id % 13, '=', 1 + aln_id % 5, 'D9=2I3=1D1=2D', 1 + aln_id % 2, 'I3I1X4=')"))
    return aln.withColumn("ops", cigar_ops(F.col("cigar")))


@_query(CIG + """, t AS (SELECT aln_id, unnest(regexp_extract_all(cigar, '\\d+[=XID]')) AS t FROM c), u AS (SELECT aln_id, CAST(t[:-2] AS BIGINT) AS n, t[-1] AS op FROM t)
SELECT aln_id, CAST(sum(CASE WHEN op <> 'I' THEN n ELSE 0 END) AS BIGINT) AS rs, CAST(sum(CASE WHEN op <> 'D' THEN n ELSE 0 END) AS BIGINT) AS qs, CAST(round_even(10000 * sum(CASE WHEN op = '=' THEN n ELSE 0 END) / sum(n), 0) AS BIGINT) AS iden, true AS valid FROM u GROUP BY aln_id""")
def cigar_stats(spark, sf_dir):
    o = F.col("ops")
    return _cigars(spark, sf_dir).select("aln_id", reference_span(o).alias("rs"), query_span(o).alias("qs"), identity_100(o).cast("long").alias("iden"), whole_cigar(F.col("cigar")).alias("valid"))


EXPLODED = CIG + """, t AS (SELECT aln_id, a_start, b_start, b_dir, unnest(regexp_extract_all(cigar, '\\d+[=XID]')) AS t, generate_subscripts(regexp_extract_all(cigar, '\\d+[=XID]'), 1) AS i FROM c),
u AS (SELECT *, CAST(t[:-2] AS BIGINT) AS n, t[-1] AS op FROM t), p AS (SELECT *, CAST(coalesce(sum(CASE WHEN op <> 'I' THEN n ELSE 0 END) OVER w, 0) AS BIGINT) AS pa, CAST(coalesce(sum(CASE WHEN op <> 'D' THEN n ELSE 0 END) OVER w, 0) AS BIGINT) AS pb FROM u WINDOW w AS (PARTITION BY aln_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
x AS (SELECT *, unnest(range(n)) AS j FROM p WHERE op <> '='),
bases AS (SELECT aln_id, op, a_start + pa + CASE WHEN op = 'I' THEN -1 ELSE j END AS a_pos, b_start + b_dir * (pb + CASE WHEN op = 'D' THEN -1 ELSE j END) AS b_pos FROM x)"""


@_query(EXPLODED + "SELECT * FROM bases")
def cigar_explode(spark, sf_dir):
    return va.explode_cigar(_cigars(spark, sf_dir))


@_query(EXPLODED + """, r AS (SELECT *, CASE WHEN lag(a_pos) OVER w IS NULL OR NOT CASE WHEN op = 'I' THEN a_pos = lag(a_pos) OVER w AND b_pos = lag(b_pos) OVER w + 1 ELSE b_pos = lag(b_pos) OVER w AND a_pos = lag(a_pos) OVER w + 1 END THEN 1 ELSE 0 END AS fresh FROM bases WHERE op <> 'X' WINDOW w AS (PARTITION BY aln_id, op ORDER BY a_pos, b_pos)),
s AS (SELECT *, sum(fresh) OVER (PARTITION BY aln_id, op ORDER BY a_pos, b_pos ROWS UNBOUNDED PRECEDING) AS run FROM r)
SELECT aln_id, op, min(a_pos) AS a_from, max(a_pos) AS a_to, min(b_pos) AS b_from, max(b_pos) AS b_to, count(*) AS n FROM s GROUP BY aln_id, op, run""")
def indel_runs(spark, sf_dir):
    return va.indel_runs(va.explode_cigar(_cigars(spark, sf_dir)))


@_query("SELECT doc_id, reverse(translate(text, 'ACGTRYKMBDHVacgtrykmbdhv', 'TGCAYRMKVHDBtgcayrmkvhdb')) AS rc, substr(text, 11, 30) AS part, translate(text, 'RYSWKMBDHVryswkmbdhv', 'ACCAGACAAAaccagacaaa') AS plain FROM documents")
def revcomp(spark, sf_dir):
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return d.select("doc_id", reverse_complement(F.col("text")).alias("rc"), slice_1based(F.col("text"), F.lit(11), F.lit(40)).alias("part"), plain_bases(F.col("text")).alias("plain"))


VCF = """WITH v AS (SELECT o_orderkey AS k, 'Chr' || (1 + o_orderkey % (5 + o_orderkey % 2)) AS chrom, CAST(o_orderkey // 7 AS BIGINT) AS pos, substr('ACGTTGCA', CAST(1 + (o_orderkey // 7) % 5 AS INT), CAST(1 + o_orderkey % 3 AS INT)) AS ref, substr('GATTACAC', CAST(1 + o_orderkey % 4 AS INT), CAST(1 + o_orderkey % 2 AS INT)) AS alt FROM orders),
s AS (SELECT DISTINCT k % 2 AS side, chrom, pos, ref, alt FROM v), bad AS (SELECT chrom, pos FROM s GROUP BY side, chrom, pos HAVING count(*) > 1), u AS (SELECT * FROM s WHERE (chrom, pos) NOT IN (SELECT (chrom, pos) FROM bad)),"""


def _variants(spark, sf_dir) -> DataFrame:
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    return o.selectExpr("o_orderkey % 2 AS side", "concat('Chr', 1 + o_orderkey % (5 + o_orderkey % 2)) AS chrom", "o_orderkey div 7 AS pos", "substring('ACGTTGCA', int(1 + (o_orderkey div 7) % 5), int(1 + o_orderkey % 3)) AS ref", "substring('GATTACAC', int(1 + o_orderkey % 4), int(1 + o_orderkey % 2)) AS alt")


@_query(VCF + """ j AS (SELECT coalesce(x.chrom, y.chrom) AS chrom, coalesce(x.pos, y.pos) AS pos, x.ref AS r1, y.ref AS r2, x.alt AS a1, y.alt AS a2 FROM (SELECT * FROM u WHERE side = 0) x FULL JOIN (SELECT * FROM u WHERE side = 1) y ON x.chrom = y.chrom AND x.pos = y.pos),
own AS (SELECT * FROM j WHERE chrom IN (SELECT chrom FROM s WHERE side = 0)),
o AS (SELECT chrom, pos, CASE WHEN r2 IS NULL THEN r1 WHEN r1 IS NULL THEN r2 WHEN r1 = r2 THEN r1 WHEN length(r1) > length(r2) AND r1[:length(r2)] = r2 THEN r1 WHEN length(r2) > length(r1) AND r2[:length(r1)] = r1 THEN r2 END AS ref, r1, r2, a1, a2 FROM own)
SELECT chrom, pos, ref, CASE WHEN r2 IS NULL THEN a1 WHEN r1 IS NULL THEN a2 WHEN r1 = r2 AND a1 = a2 THEN a1 ELSE a1 || substr(ref, length(r1) + 1) || ',' || a2 || substr(ref, length(r2) + 1) END AS alts,
CASE WHEN r2 IS NULL THEN '1|0' WHEN r1 IS NULL THEN '0|1' WHEN r1 = r2 AND a1 = a2 THEN '1|1' ELSE '1|2' END AS gt FROM o WHERE ref IS NOT NULL""")
def hap_merge(spark, sf_dir):
    v = _variants(spark, sf_dir)
    return va.merge_haplotypes(v.where("side = 0"), v.where("side = 1"))


@_query(VCF + " z AS (SELECT side, chrom, pos, ref, alt FROM s) SELECT * FROM z WHERE (length(ref) = 1 AND length(alt) = 1) OR (length(ref) BETWEEN 2 AND 3 AND length(alt) BETWEEN 2 AND 3)")
def indel_size_filter(spark, sf_dir):
    return va.indel_size_filter(_variants(spark, sf_dir).distinct().withColumn("alts", F.array("alt")), 2, 3).select("side", "chrom", "pos", "ref", "alt")


_KINDS = "'SYN','INV','TRANS','INVTR','DUP','INVDP','INS','DEL','SNP','HDR','CPG','CPL','NOTAL'"
_LABELS = "'SYN','INV','TRANS','DUPA','DUPB','NOTALR','NOTALQ','SNP','INS','DEL','CPG','CPL','HDR','TDM'"


@_query(ALN + f""", e AS (SELECT a_start, a_end, b_start, b_end, [{_KINDS}][CAST(aln_id % 13 + 1 AS INT)] AS kind, aln_id % 2 = 0 AS even FROM aln),
f AS (SELECT CASE WHEN kind = 'INVTR' THEN 'TRANS' WHEN kind IN ('DUP', 'INVDP') THEN CASE WHEN even THEN 'DUPB' ELSE 'DUPA' END WHEN kind = 'NOTAL' THEN CASE WHEN even THEN 'NOTALR' ELSE 'NOTALQ' END ELSE kind END AS label, abs(a_end - a_start) + CASE WHEN kind IN ('INS', 'DEL') THEN 0 ELSE 1 END AS la, abs(b_end - b_start) + CASE WHEN kind IN ('INS', 'DEL') THEN 0 ELSE 1 END AS lb FROM e),
t AS (SELECT unnest([{_LABELS}]) AS label, unnest(range(14)) AS place), g AS (SELECT label, count(*) AS n, sum(la) AS la, sum(lb) AS lb FROM f GROUP BY label)
SELECT CAST(place AS INT) AS place, label, coalesce(n, 0) AS n, CASE WHEN label NOT IN ('DUPB', 'NOTALQ', 'INS', 'CPG') THEN CAST(coalesce(la, 0) AS BIGINT) END AS length_ref, CASE WHEN label NOT IN ('DUPA', 'NOTALR', 'DEL', 'CPL') THEN CAST(coalesce(lb, 0) AS BIGINT) END AS length_qry FROM t LEFT JOIN g USING (label)""")
def sr_summary(spark, sf_dir):
    e = alignments(spark, sf_dir).withColumn("kind", F.expr(f"element_at(array({_KINDS}), int(aln_id % 13 + 1))")).withColumn("even", F.expr("aln_id % 2 = 0"))
    e = e.withColumn("dupclass", F.expr("CASE WHEN kind IN ('DUP', 'INVDP') THEN if(even, 'copygain', 'copyloss') END"))
    gone = lambda c, other: F.when((F.col("kind") != "NOTAL") | (F.col("even") != other), F.col(c))
    return va.summary(e.withColumns({c: gone(c, c.startswith("b")) for c in ("a_start", "a_end", "b_start", "b_end")}))


@_query(ALN + "SELECT aln_id, greatest(0, a_start - 1 - 500) AS bed_start, a_end - 1 + 500 AS bed_end, a_chr AS chr FROM aln WHERE a_chr = 'Chr2' AND a_start <= 900000 AND a_end >= 1000")
def bed_region(spark, sf_dir):
    return fi.bed(fi.region(alignments(spark, sf_dir), "Chr2", 1000, 900000), 500, keep=["aln_id"]).select("aln_id", F.col("start").alias("bed_start"), F.col("end").alias("bed_end"), "chr")


@_query(ALN + "SELECT aln_id, greatest(0, least(b_start, b_end) - 1) AS bed_start, greatest(b_start, b_end) - 1 AS bed_end, b_chr AS chr FROM aln WHERE b_chr = 'Chr2' AND least(b_start, b_end) <= 900000 AND greatest(b_start, b_end) >= 1000")
def bed_region_query(spark, sf_dir):
    rows = fi.region(alignments(spark, sf_dir), "Chr2", 1000, 900000, "b")
    rows = iv.normalise_reverse(rows).withColumns({"b_start": F.col("b_low"), "b_end": F.col("b_high")})
    return fi.bed(rows, 0, "b", ["aln_id"]).select("aln_id", F.col("start").alias("bed_start"), F.col("end").alias("bed_end"), "chr")


@_query(ALN + "SELECT aln_id, row_number() OVER (ORDER BY a_chr, a_start, a_end, aln_id) AS place FROM aln")
def row_numbers(spark, sf_dir):
    return va.numbered(alignments(spark, sf_dir).select("aln_id", "a_chr", "a_start", "a_end"), ["a_chr", "a_start", "a_end", "aln_id"], "place").select("aln_id", "place")
