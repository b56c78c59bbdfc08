"""Further queries over the derived alignments: checks, joins by nearness and overlap, uniqueness, groups, rearrangements."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .catalog import ALN, BLOCKS, CIG, EXPLODED, _blocks, _cigars, _query, _variants, alignments
from .functions import clip, cigar_ops, spaced, whole_cigar, wrapped
from .operators import filters as fi
from .operators import intervals as iv
from .operators import joins as jo
from .operators import rearrangements as re_
from .operators import scaffold as sc
from .operators import variants as va
from .operators.chain import syntenic_chain
from .operators.graph import connected

COORDS = ["a_start", "a_end", "b_start", "b_end"]


# checks and predicates

#: The query's fifth chromosome has another name, and the reference's third no forward alignment.
ODD = ALN + """, odd AS (SELECT * REPLACE (CASE WHEN b_chr = 'Chr5' THEN 'ChrX' ELSE b_chr END AS b_chr, CASE WHEN a_chr = 'Chr3' THEN -1 ELSE b_dir END AS b_dir) FROM aln)"""


def _odd(spark, sf_dir) -> DataFrame:
    a = alignments(spark, sf_dir)
    return a.withColumns({"b_chr": F.when(F.col("b_chr") == "Chr5", "ChrX").otherwise(F.col("b_chr")), "b_dir": F.when(F.col("a_chr") == "Chr3", -1).otherwise(F.col("b_dir"))})


@_query(ODD + """, bad AS (SELECT DISTINCT a_chr FROM odd WHERE a_chr NOT IN (SELECT a_chr FROM odd WHERE a_chr = b_chr AND b_dir = 1))
SELECT aln_id FROM odd WHERE a_chr NOT IN (SELECT a_chr FROM bad) AND b_chr NOT IN (SELECT a_chr FROM bad)""")
def forward_partners(spark, sf_dir):
    return fi.with_forward_partner(_odd(spark, sf_dir)).select("aln_id")


@_query(ODD + " SELECT aln_id FROM odd WHERE a_chr IN (SELECT b_chr FROM odd) AND b_chr IN (SELECT a_chr FROM odd)")
def both_genomes(spark, sf_dir):
    return fi.in_both_genomes(_odd(spark, sf_dir)).select("aln_id")


@_query(ODD + """, f AS (SELECT *, max(a_end) OVER (PARTITION BY a_chr, b_dir ORDER BY a_start, a_end ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS top FROM odd WHERE a_chr = b_chr),
i AS (SELECT *, sum(CASE WHEN top IS NULL OR a_start > top THEN 1 ELSE 0 END) OVER (PARTITION BY a_chr, b_dir ORDER BY a_start, a_end ROWS UNBOUNDED PRECEDING) AS island FROM f),
m AS (SELECT a_chr, b_dir, max(a_end) - min(a_start) + 1 AS n FROM i GROUP BY a_chr, b_dir, island),
t AS (SELECT a_chr, CAST(coalesce(sum(n) FILTER (b_dir = 1), 0) AS BIGINT) AS forward, CAST(coalesce(sum(n) FILTER (b_dir = -1), 0) AS BIGINT) AS reverse FROM m GROUP BY a_chr) SELECT * FROM t WHERE reverse > forward""")
def mostly_inverted(spark, sf_dir):
    return fi.mostly_inverted(_odd(spark, sf_dir))


@_query(ALN + " SELECT 'A' AS genome, a_chr AS chr, max(greatest(a_start, a_end)) AS top FROM aln GROUP BY a_chr UNION ALL SELECT 'B', b_chr, max(greatest(b_start, b_end)) FROM aln GROUP BY b_chr")
def top_coordinates(spark, sf_dir):
    return fi.top_coordinates(alignments(spark, sf_dir))


@_query(ODD + """, t AS (SELECT 'A' AS genome, a_chr AS chr, max(greatest(a_start, a_end)) AS top FROM odd GROUP BY a_chr UNION ALL SELECT 'B', b_chr, max(greatest(b_start, b_end)) FROM odd GROUP BY b_chr),
z AS (SELECT unnest(['A', 'B']) AS genome, a_chr AS chr, max(a_end) AS size FROM aln GROUP BY a_chr) SELECT genome, chr, top, size FROM t LEFT JOIN z USING (genome, chr) WHERE size IS NULL OR top > size""")
def genome_errors(spark, sf_dir):
    sizes = alignments(spark, sf_dir).groupBy(F.col("a_chr").alias("chr")).agg(F.max("a_end").alias("size"))
    return fi.genome_errors(_odd(spark, sf_dir), sizes, sizes)


@_query(ALN + """, t AS (SELECT *, ['SNP', 'INS', 'DEL', 'HDR', '<INV>', '<SNP>', '<CPG>'][CAST(aln_id % 7 + 1 AS INT)] AS alt FROM aln) SELECT aln_id, alt FROM t WHERE alt NOT IN ('<INV>', '<CPG>')""")
def variant_classes(spark, sf_dir):
    v = alignments(spark, sf_dir).withColumn("alts", F.array(F.expr("element_at(array('SNP', 'INS', 'DEL', 'HDR', '<INV>', '<SNP>', '<CPG>'), int(aln_id % 7 + 1))")))
    return fi.short_variants(v, ("INV", "SNP", "CPG", "INS")).select("aln_id", F.col("alts")[0].alias("alt"))


@_query(ALN + """, t AS (SELECT aln_id, ['HDR', 'DEL', 'INS', 'SNP'][CAST(aln_id % 4 + 1 AS INT)] AS kind, a_end - a_start AS la, b_end - b_start AS lb FROM aln)
SELECT aln_id, CASE WHEN kind = 'HDR' OR (kind = 'DEL' AND la > 600) OR (kind = 'INS' AND lb > 600) THEN NULL ELSE 'A' END AS a_seq, CASE WHEN kind = 'HDR' OR (kind = 'DEL' AND la > 600) OR (kind = 'INS' AND lb > 600) THEN NULL ELSE 'C' END AS b_seq FROM t""")
def capped_sequences(spark, sf_dir):
    v = alignments(spark, sf_dir).withColumns({"kind": F.expr("element_at(array('HDR', 'DEL', 'INS', 'SNP'), int(aln_id % 4 + 1))"), "a_seq": F.lit("A"), "b_seq": F.lit("C")})
    return fi.capped_sequences(v, 600, diverged=False).select("aln_id", "a_seq", "b_seq")


@_query(CIG + ", d AS (SELECT aln_id, CASE aln_id % 5 WHEN 0 THEN cigar WHEN 1 THEN '7S' || cigar || '4H' WHEN 2 THEN '3M' || cigar WHEN 3 THEN '5=3Z2=' ELSE '4=2S' || cigar END AS cigar FROM c) SELECT aln_id, aln_id % 5 < 2 AS valid, CASE aln_id % 5 WHEN 1 THEN 7 ELSE 0 END AS head, CASE aln_id % 5 WHEN 1 THEN 4 ELSE 0 END AS tail FROM d WHERE aln_id % 5 <> 4 OR aln_id IS NOT NULL")
def cigar_checks(spark, sf_dir):
    c = _cigars(spark, sf_dir).withColumn("cigar", F.expr("CASE aln_id % 5 WHEN 0 THEN cigar WHEN 1 THEN concat('7S', cigar, '4H') WHEN 2 THEN concat('3M', cigar) WHEN 3 THEN '5=3Z2=' ELSE concat('4=2S', cigar) END"))
    ops = cigar_ops(F.col("cigar"))
    return c.select("aln_id", whole_cigar(F.col("cigar")).alias("valid"), clip(ops).cast("int").alias("head"), clip(ops, last=True).cast("int").alias("tail"))


# joins

#: In place: forward alignments of a chromosome to its partner; out of place: the moved and the reverse ones.
PLACED = ALN + """, low AS (SELECT * REPLACE (least(b_start, b_end) AS b_start, greatest(b_start, b_end) AS b_end) FROM aln), inp AS (SELECT * FROM low WHERE kind < 13 AND a_chr = b_chr), outp AS (SELECT * FROM low WHERE kind >= 13 AND a_chr = b_chr)"""


def _placed(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    low = iv.normalise_reverse(alignments(spark, sf_dir)).withColumns({"b_start": F.col("b_low"), "b_end": F.col("b_high")}).drop("b_low", "b_high")
    return low.where("kind < 13 and a_chr = b_chr"), low.where("kind >= 13 and a_chr = b_chr")


SIDES = PLACED + """, n AS (SELECT *, row_number() OVER (PARTITION BY a_chr ORDER BY a_start, a_end, b_start, b_end, aln_id) - 1 AS spot, count(*) OVER (PARTITION BY a_chr) AS total FROM inp),
up AS (SELECT o.aln_id, max(spot) AS l FROM outp o JOIN n ON n.a_chr = o.a_chr AND n.a_start < o.a_start - 50 AND n.a_end < o.a_end - 50 AND n.b_start < o.b_start - 50 AND n.b_end < o.b_end - 50 GROUP BY o.aln_id),
down AS (SELECT o.aln_id, min(spot) AS r FROM outp o JOIN n ON n.a_chr = o.a_chr AND n.a_start > o.a_start + 50 AND n.a_end > o.a_end + 50 AND n.b_start > o.b_start + 50 AND n.b_end > o.b_end + 50 GROUP BY o.aln_id),
tot AS (SELECT DISTINCT a_chr, total FROM n), sides AS (SELECT aln_id, coalesce(l, -1) AS "left", coalesce(r, total) AS "right" FROM outp LEFT JOIN up USING (aln_id) LEFT JOIN down USING (aln_id) JOIN tot USING (a_chr))"""


@_query(SIDES + ' SELECT aln_id, "left", "right" FROM sides')
def nearest_dominators(spark, sf_dir):
    held, out = _placed(spark, sf_dir)
    return jo.nearest(out, held)


@_query(ALN + """, syn AS (SELECT *, row_number() OVER (PARTITION BY a_chr ORDER BY a_start, a_end, b_start, b_end, aln_id) - 1 AS spot, count(*) OVER (PARTITION BY a_chr) AS total FROM aln WHERE a_chr = b_chr AND b_dir = 1), inv AS (SELECT * FROM aln WHERE a_chr = b_chr AND b_dir = -1),
up AS (SELECT o.aln_id, max(spot) AS l FROM inv o JOIN syn n ON n.a_chr = o.a_chr AND o.a_start - n.a_start > 50 AND o.a_end - n.a_end > 50 AND o.b_end - n.b_start > 50 AND o.b_start - n.b_end > 50 GROUP BY o.aln_id),
down AS (SELECT o.aln_id, min(spot) AS r FROM inv o JOIN syn n ON n.a_chr = o.a_chr AND n.a_start - o.a_start > 50 AND n.a_end - o.a_end > 50 AND n.b_start - o.b_end > 50 AND n.b_end - o.b_start > 50 GROUP BY o.aln_id),
tot AS (SELECT DISTINCT a_chr, total FROM syn) SELECT aln_id, coalesce(l, -1) AS "left", coalesce(r, total) AS "right" FROM inv LEFT JOIN up USING (aln_id) LEFT JOIN down USING (aln_id) JOIN tot USING (a_chr)""")
def inversion_neighbours(spark, sf_dir):
    a = alignments(spark, sf_dir).where("a_chr = b_chr")
    return jo.nearest(a.where("b_dir = -1"), a.where("b_dir = 1"), oriented=True)


@_query(SIDES + """, f AS (SELECT * FROM outp WHERE b_dir = 1) SELECT x.aln_id AS i, y.aln_id AS j FROM f x JOIN f y ON x.a_chr = y.a_chr AND y.a_start - x.a_start > 50 AND y.a_end - x.a_end > 50 AND y.b_start - x.b_start > 50 AND y.b_end - x.b_end > 50 AND y.a_start - x.a_end < 500000 AND y.b_start - x.b_end < 500000
JOIN sides p ON p.aln_id = x.aln_id JOIN sides q ON q.aln_id = y.aln_id WHERE (p."right" - 1 >= q."left" + 1 AND p."right" <= q."right") OR (p."left" >= q."left" AND p."left" + 1 <= q."right" - 1)""")
def td_pairs(spark, sf_dir):
    held, out = _placed(spark, sf_dir)
    return jo.compatible_pairs(out.where("b_dir = 1"), ["a_chr"], 500_000, sides=jo.nearest(out, held))


@_query(ALN + """, t AS (SELECT aln_id, a_chr, a_start, a_end, 90000000 - least(b_start, b_end) AS b_start, 90000000 - greatest(b_start, b_end) AS b_end FROM aln WHERE a_chr = b_chr AND b_dir = -1),
r AS (SELECT *, max(greatest(b_start, b_end)) OVER (PARTITION BY a_chr) + 1 - b_start AS ms, max(greatest(b_start, b_end)) OVER (PARTITION BY a_chr) + 1 - b_end AS me FROM t)
SELECT x.aln_id AS i, y.aln_id AS j FROM r x JOIN r y ON x.a_chr = y.a_chr AND y.a_start - x.a_start > 50 AND y.a_end - x.a_end > 50 AND y.ms - x.ms > 50 AND y.me - x.me > 50 AND y.a_start - x.a_end < 1000000000 AND y.ms - x.me < 1000000000""")
def inversion_pairs(spark, sf_dir):
    """Reverse alignments whose query runs backwards, so that they follow each other once it is mirrored."""
    r = iv.normalise_reverse(alignments(spark, sf_dir).where("a_chr = b_chr and b_dir = -1"))
    r = iv.mirror_b(r.withColumns({"b_start": 90_000_000 - F.col("b_low"), "b_end": 90_000_000 - F.col("b_high")}), ["a_chr"])
    return jo.wide_pairs(r.withColumns({"b_start": F.col("m_start"), "b_end": F.col("m_end")}), ["a_chr"], 1_000_000_000)


@_query(ALN + """, x AS (SELECT *, least(b_start, b_end) AS b0, greatest(b_start, b_end) AS b1 FROM aln WHERE a_chr <> b_chr)
SELECT x.aln_id AS i, y.aln_id AS j FROM x JOIN x y ON x.a_chr = y.a_chr AND x.b_chr = y.b_chr AND x.b_dir = y.b_dir AND y.a_start - x.a_start > 50 AND y.a_end - x.a_end > 50 AND y.a_start - x.a_end < 500000
AND CASE WHEN x.b_dir = 1 THEN y.b0 - x.b0 > 50 AND y.b1 - x.b1 > 50 AND y.b0 - x.b1 < 500000 ELSE x.b0 - y.b0 > 50 AND x.b1 - y.b1 > 50 AND x.b0 - y.b1 < 500000 END""")
def ctx_pairs(spark, sf_dir):
    a = iv.normalise_reverse(alignments(spark, sf_dir).where("a_chr <> b_chr")).withColumns({"b_start": F.col("b_low"), "b_end": F.col("b_high")})
    by = ["a_chr", "b_chr"]
    return jo.compatible_pairs(a.where("b_dir = 1"), by, 500_000).unionByName(jo.compatible_pairs(a.where("b_dir = -1"), by, 500_000, reverse=True))


@_query(CIG + ", k AS (SELECT a.aln_id, b.cigar FROM aln a JOIN (SELECT aln.*, cigar FROM c JOIN aln USING (aln_id)) b ON (a.a_start, a.a_end, a.b_start, a.b_end, a.a_chr, a.b_chr) = (b.a_start, b.a_end, b.b_start, b.b_end, b.a_chr, b.b_chr)) SELECT aln_id, min(cigar) AS cigar FROM k GROUP BY aln_id")
def recovered_cigars(spark, sf_dir):
    c = _cigars(spark, sf_dir)
    return jo.with_cigars(alignments(spark, sf_dir), c.select(*jo.KEYS, "cigar")).select("aln_id", "cigar")


@_query(ALN + " SELECT aln_id, 'B' || aln_id AS parent FROM aln")
def parent_lookup(spark, sf_dir):
    a = alignments(spark, sf_dir)
    return jo.with_parents(a, a.select(*jo.KEYS, F.concat(F.lit("B"), "aln_id").alias("id"))).select("aln_id", "parent")


@_query(BLOCKS + """, p AS (SELECT event_id, 'Chr' || (1 + event_id % 5) AS a_chr, 1 + (event_id * 7) % (SELECT max(a_end) FROM aln) AS a_pos, 1 + (event_id * 7) % (SELECT max(a_end) FROM aln) + event_id % 40 AS b_pos, CASE WHEN event_id % 4 = 0 THEN -1 ELSE 1 END AS b_dir FROM events)
SELECT DISTINCT block, event_id, a_pos, b_pos FROM w JOIN p ON w.a_chr = p.a_chr AND w.b_chr = p.a_chr AND w.b_dir = p.b_dir AND a_start < a_pos AND a_pos < a_end AND least(b_start, b_end) < b_pos AND b_pos < greatest(b_start, b_end)""")
def snps_in_blocks(spark, sf_dir):
    w = _blocks(spark, sf_dir)
    top = w.agg(F.max("a_end").alias("top"))
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id").crossJoin(F.broadcast(top))  # one row
    e = e.selectExpr("event_id", "concat('Chr', 1 + event_id % 5) AS a_chr", "concat('Chr', 1 + event_id % 5) AS b_chr", "1 + (event_id * 7) % top AS a_pos", "1 + (event_id * 7) % top + event_id % 40 AS b_pos", "if(event_id % 4 = 0, -1, 1) AS b_dir")
    return jo.variants_in_blocks(e, w, "block").select("block", "event_id", "a_pos", "b_pos")


@_query(ALN + " SELECT aln_id, unnest(range(a_start // 10000, (a_end - 1) // 10000 + 1)) AS bin FROM aln")
def bins_of(spark, sf_dir):
    return jo.bins_of(alignments(spark, sf_dir), 10000, "a_start", "a_end").select("aln_id", "bin")


@_query(ALN + " SELECT aln_id, CASE WHEN b_chr = 'Chr5' THEN 'ChrX' ELSE b_chr END AS far, b_chr AS back FROM aln")
def renamed_chromosomes(spark, sf_dir):
    a = alignments(spark, sf_dir)
    names = spark.createDataFrame([(f"Chr{i}", f"Chr{i}" if i < 5 else "ChrX") for i in range(1, 6)], "a_chr string, b_chr string")
    far = fi.renamed(a, names, back=True)
    return fi.renamed(far.withColumn("far", F.col("b_chr")), names).select("aln_id", "far", F.col("b_chr").alias("back"))


@_query(ALN + """, e AS (SELECT aln_id, a_chr, a_start, a_end FROM aln WHERE aln_id % 10 = 0), c AS (SELECT aln_id, aln_id - aln_id % 10 AS parent FROM aln WHERE aln_id % 10 > 0)
SELECT 'E' || aln_id AS id, NULL AS parent, 0 AS child FROM e UNION ALL SELECT 'C' || c.aln_id, 'E' || e.aln_id, 1 FROM c JOIN e ON c.parent = e.aln_id""")
def children(spark, sf_dir):
    a = alignments(spark, sf_dir).select("aln_id", "a_chr", "a_start", "a_end")
    events = a.where("aln_id % 10 = 0").withColumn("id", F.concat(F.lit("E"), "aln_id")).withColumn("parent", F.lit(None).cast("string"))
    kids = a.where("aln_id % 10 > 0").withColumn("id", F.concat(F.lit("C"), "aln_id")).withColumn("parent", F.concat(F.lit("E"), F.expr("aln_id - aln_id % 10")))
    return jo.with_children(events, kids).select("id", "parent", "child")


# uniqueness, groups, components

MERGED_IN = """, fa AS (SELECT *, max(a_end) OVER (PARTITION BY a_chr ORDER BY a_start, a_end ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS top FROM inp),
ia AS (SELECT *, sum(CASE WHEN top IS NULL OR a_start > top THEN 1 ELSE 0 END) OVER (PARTITION BY a_chr ORDER BY a_start, a_end ROWS UNBOUNDED PRECEDING) AS island FROM fa),
m AS (SELECT a_chr, min(a_start) AS s, max(a_end) AS e FROM ia GROUP BY a_chr, island)"""


@_query(PLACED + MERGED_IN + """, j AS (SELECT o.aln_id, o.a_start AS ls, o.a_end AS le, s, e, lag(e) OVER w AS last, row_number() OVER w AS k FROM outp o JOIN m ON m.a_chr = o.a_chr AND s < o.a_end AND e > o.a_start WINDOW w AS (PARTITION BY o.aln_id ORDER BY s)),
c AS (SELECT *, coalesce(last, ls) AS cur FROM j), d AS (SELECT *, s - cur < 50 AND le - e < 50 AS stop FROM c), f AS (SELECT aln_id, min(k) FILTER (stop) AS first_stop, max(e) AS far FROM d GROUP BY aln_id),
g AS (SELECT d.aln_id, sum(CASE WHEN first_stop IS NULL OR k < first_stop THEN greatest(s - cur, 0) ELSE 0 END) + max(CASE WHEN first_stop IS NULL THEN greatest(le - far, 0) ELSE 0 END) AS bp FROM d JOIN f USING (aln_id) GROUP BY d.aln_id),
x AS (SELECT o.aln_id, CAST(coalesce(bp, a_end - a_start) AS BIGINT) AS a_uni_bp, a_end - a_start AS n FROM outp o LEFT JOIN g USING (aln_id)) SELECT aln_id, a_uni_bp, a_uni_bp > 1000 OR 100 * a_uni_bp > 50 * n AS a_uni FROM x""")
def unique_bp(spark, sf_dir):
    held, out = _placed(spark, sf_dir)
    return iv.unique_test(out, held, "a_chr", "a_start", "a_end", "aln_id", "a_uni")


@_query(PLACED + MERGED_IN + ", j AS (SELECT o.aln_id, sum(least(e, a_end) - greatest(s, a_start) + 1) AS taken FROM outp o JOIN m ON m.a_chr = o.a_chr AND s <= a_end AND e >= a_start GROUP BY o.aln_id) SELECT aln_id, CAST(a_end - a_start + 1 - coalesce(taken, 0) AS BIGINT) AS a_free FROM outp LEFT JOIN j USING (aln_id)")
def free_bases(spark, sf_dir):
    held, out = _placed(spark, sf_dir)
    return iv.free_bases(out, held, "a_chr", "a_start", "a_end", "aln_id", "a_free")


@_query(BLOCKS + ", l AS (SELECT *, lag(a_end) OVER (PARTITION BY block ORDER BY a_start, a_end) AS p FROM w) SELECT block, CAST(sum(a_end - a_start + least(a_start - coalesce(p, a_start), 0) + greatest(coalesce(p, a_end) - a_end, 0)) AS BIGINT) AS bp FROM l GROUP BY block")
def union_length(spark, sf_dir):
    return iv.union_length(_blocks(spark, sf_dir), ["block"], "a_start", "a_end")


@_query(BLOCKS + " SELECT block, min(a_start) AS a_start, max(a_end) AS a_end, min(least(b_start, b_end)) AS b_start, max(greatest(b_start, b_end)) AS b_end FROM w GROUP BY block")
def block_extents(spark, sf_dir):
    return iv.extents(_blocks(spark, sf_dir), ["block"])


@_query(ALN + """, f AS (SELECT *, max(a_end) OVER (PARTITION BY a_chr ORDER BY a_start, a_end ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS top FROM aln WHERE a_end > a_start),
i AS (SELECT *, sum(CASE WHEN top IS NULL OR a_start > top THEN 1 ELSE 0 END) OVER (PARTITION BY a_chr ORDER BY a_start, a_end ROWS UNBOUNDED PRECEDING) AS island FROM f),
m AS (SELECT a_chr, min(a_start) AS s, max(a_end) AS e FROM i GROUP BY a_chr, island), z AS (SELECT a_chr, max(a_end) + 777 AS size FROM aln GROUP BY a_chr),
b AS (SELECT a_chr, size, unnest(range((size - 1) // 100000 + 1)) AS bin FROM z)
SELECT b.a_chr AS chr, bin * 100000 + least((bin + 1) * 100000, size) AS middle2, CAST(sum(CASE WHEN s IS NULL THEN 0 ELSE least(e, (bin + 1) * 100000) - greatest(s, bin * 100000) END) AS BIGINT) AS covered FROM b LEFT JOIN m ON m.a_chr = b.a_chr AND s < (bin + 1) * 100000 AND e > bin * 100000 GROUP BY b.a_chr, bin, size""")
def density(spark, sf_dir):
    a = alignments(spark, sf_dir)
    sizes = a.groupBy(F.col("a_chr").alias("chr")).agg((F.max("a_end") + 777).alias("size"))
    return iv.density(a.select(F.col("a_chr").alias("chr"), F.col("a_start").alias("start"), F.col("a_end").alias("end")), sizes).select("chr", "middle2", "covered")


#: Out-of-place alignments drawn out at their ends, so that they overlap each other.
WIDE = PLACED.replace("outp AS (SELECT * FROM low", "outp AS (SELECT * REPLACE (a_end + 2500 + aln_id % 7 * 300 AS a_end, b_end + 2500 + aln_id % 5 * 300 AS b_end) FROM low")


def _wide(spark, sf_dir) -> DataFrame:
    return _placed(spark, sf_dir)[1].withColumns({"a_end": F.expr("a_end + 2500 + aln_id % 7 * 300"), "b_end": F.expr("b_end + 2500 + aln_id % 5 * 300")})


def _folded(name: str, chr_: str, s: str, e: str) -> str:
    """Overlap groups of outp as a recursive walk over each chromosome's intervals."""
    return f""", o{name} AS (SELECT aln_id, {chr_} AS c, {s} AS s, {e} AS e, row_number() OVER (PARTITION BY {chr_} ORDER BY {s}, {e}, aln_id) AS r FROM outp),
g{name} AS (WITH RECURSIVE w AS (SELECT c, r, aln_id, s AS lft, e AS rgt, aln_id AS grp FROM o{name} WHERE r = 1 UNION ALL
 SELECT o.c, o.r, o.aln_id, CASE WHEN j THEN w.lft ELSE o.s END, CASE WHEN j THEN greatest(w.rgt, o.e) ELSE o.e END, CASE WHEN j THEN w.grp ELSE o.aln_id END
 FROM w JOIN (SELECT * FROM o{name}) o ON o.c = w.c AND o.r = w.r + 1, LATERAL (SELECT o.s <= w.rgt AND (o.e < w.rgt + 50 OR 2 * (o.e - w.rgt) < w.rgt - o.s OR 2 * (o.s - w.lft) < w.rgt - o.s) AS j) t) SELECT aln_id, grp FROM w)"""


@_query(WIDE + _folded("a", "a_chr", "a_start", "a_end") + " SELECT aln_id, grp FROM ga")
def overlap_groups(spark, sf_dir):
    return iv.overlap_groups(_wide(spark, sf_dir), "a_chr", "a_start", "a_end", "aln_id")


def _groups(spark, sf_dir) -> tuple[DataFrame, DataFrame, DataFrame]:
    out = _wide(spark, sf_dir)
    return out, iv.overlap_groups(out, "a_chr", "a_start", "a_end", "aln_id"), iv.overlap_groups(out, "b_chr", "b_start", "b_end", "aln_id")


@_query(WIDE + _folded("a", "a_chr", "a_start", "a_end") + _folded("b", "b_chr", "b_start", "b_end") + """, n AS (SELECT ga.aln_id AS id, 'A' || ga.grp AS ag, 'B' || gb.grp AS bg FROM ga JOIN gb USING (aln_id)), p AS (SELECT id, ag AS grp FROM n UNION ALL SELECT id, bg FROM n),
l AS (SELECT DISTINCT x.id AS i, y.id AS j FROM p x JOIN p y USING (grp)), r AS (WITH RECURSIVE t AS (SELECT i, j FROM l UNION SELECT t.i, l.j FROM t JOIN l ON t.j = l.i) SELECT i, min(j) AS component FROM t GROUP BY i) SELECT i AS aln_id, component FROM r""")
def overlap_components(spark, sf_dir):
    _, a, b = _groups(spark, sf_dir)
    named = lambda d, p: d.select(F.col("aln_id").alias("id"), F.concat(F.lit(p), "grp").alias("grp"))
    return connected(named(a, "A").unionByName(named(b, "B"))).withColumnRenamed("id", "aln_id")


@_query(WIDE + _folded("a", "a_chr", "a_start", "a_end") + """, h AS (SELECT outp.*, grp FROM outp JOIN ga USING (aln_id)) SELECT x.aln_id AS i, y.aln_id AS j FROM h x JOIN h y ON x.grp = y.grp AND x.aln_id <> y.aln_id AND x.a_start <= y.a_end AND y.a_start <= x.a_end
WHERE (y.a_start - 50 < x.a_start AND y.a_end + 50 > x.a_end) OR (least(x.a_end, y.a_end) - greatest(x.a_start, y.a_start)) / (x.a_end - x.a_start) > 0.8""")
def mutually_exclusive(spark, sf_dir):
    out, a, _ = _groups(spark, sf_dir)
    return jo.exclusive_pairs(out.join(a, "aln_id"), "grp", "a_start", "a_end", "aln_id")


# sequences and variants

@_query(EXPLODED + ", d AS MATERIALIZED (SELECT doc_id, substr(regexp_replace(text, '[^ -~]', 'N', 'g'), 1, 64) AS text, (SELECT count(*) FROM documents) AS n FROM documents), k AS (SELECT b.*, substr(text, CAST(1 + a_pos % 60 AS INT), 1) AS base FROM bases b JOIN d ON doc_id = b.aln_id % (SELECT any_value(n) FROM d) AND b.op <> 'I') SELECT aln_id, a_pos, base FROM k WHERE base <> ''")
def bases_at(spark, sf_dir):
    d = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.regexp_replace("text", "[^ -~]", "N").alias("text"))
    n = d.count()
    ascii_ = d.select(F.col("doc_id").cast("string").alias("chr"), "text", F.length("text").alias("len"))
    genome = ascii_.select("chr", F.explode(F.transform(F.sequence(F.lit(0), F.lit(3)), lambda k: F.struct((k * 16 + 1).cast("long").alias("begin"), F.substring("text", (k * 16 + 1), F.lit(16)).alias("seq")))).alias("x")).select("chr", "x.*").where("seq <> ''")
    b = va.explode_cigar(_cigars(spark, sf_dir)).where("op <> 'I'").withColumns({"chr_": F.expr(f"cast(aln_id % {n} AS string)"), "at": F.expr("1 + a_pos % 60")})
    return va.bases_at(b, genome, "chr_", "at", "base").where("base IS NOT NULL").select("aln_id", "a_pos", "base")


@_query("SELECT doc_id, substr(regexp_replace(text, '[^ -~]', 'N', 'g'), 5, 41) AS part FROM documents WHERE length(text) >= 45")
def region_sequences(spark, sf_dir):
    d = spark.read.parquet(f"{sf_dir}/documents.parquet").where("length(text) >= 45").select("doc_id", F.regexp_replace("text", "[^ -~]", "N").alias("text"))
    genome = d.select(F.col("doc_id").cast("string").alias("chr"), F.explode(F.transform(F.sequence(F.lit(0), F.lit(2)), lambda k: F.struct((k * 16 + 1).cast("long").alias("begin"), F.substring("text", (k * 16 + 1), F.lit(16)).alias("seq")))).alias("x")).select("chr", "x.*").where("seq <> ''")
    rows = d.select("doc_id", F.col("doc_id").cast("string").alias("chr"), F.lit(5).cast("long").alias("s"), F.lit(45).cast("long").alias("e"))
    return va.sequences_of(rows, genome, "doc_id", "chr", "s", "e", "part")


@_query(ALN + """, b AS (SELECT aln_id, ['syn', 'inv', 'TL', 'invTL', 'dup', 'invDup'][CAST(aln_id % 6 + 1 AS INT)] AS class, aln_id % 6 AS o, aln_id % 2 = 0 AS even, a_chr, a_start, a_end, b_chr, b_start, b_end FROM aln),
n AS (SELECT *, row_number() OVER (ORDER BY o, a_chr, a_start, a_end, b_chr, b_start, b_end, aln_id) AS r, ['SYN', 'INV', 'TRANS', 'INVTR', 'DUP', 'INVDP'][CAST(o + 1 AS INT)] AS kind FROM b)
SELECT aln_id AS block, kind || r AS id, CASE WHEN o >= 4 THEN CASE WHEN even THEN 'copygain' ELSE 'copyloss' END END AS dupclass, NULL AS parent FROM n UNION ALL SELECT aln_id, kind || 'AL' || r, NULL, kind || r FROM n""")
def block_names(spark, sf_dir):
    a = alignments(spark, sf_dir).withColumns({"class": F.expr("element_at(array('syn', 'inv', 'TL', 'invTL', 'dup', 'invDup'), int(aln_id % 6 + 1))"), "copies": F.expr("if(aln_id % 2 = 0, 'B', 'A')"), "block": F.col("aln_id")})
    return va.named_blocks(a.select("block", "class", "copies", "a_chr", "b_chr", *COORDS), a.select("block", "a_chr", "b_chr", *COORDS)).select("block", "id", "dupclass", "parent")


@_query("SELECT doc_id, regexp_replace(replace(substr(text, 1, 1) || repeat('N', 3) || text, chr(10), ' '), '(.{64})', '\\1' || chr(10), 'g') AS line FROM documents WHERE length(text) > 0")
def wrapped_sequences(spark, sf_dir):
    d = spark.read.parquet(f"{sf_dir}/documents.parquet").where("length(text) > 0")
    text = F.regexp_replace(spaced(F.array(F.substring("text", 1, 1), F.col("text")), 3), "\n", " ")
    # a full last line has no break behind it; the SQL's pattern adds one there
    return d.select("doc_id", F.when(F.length(text) % 64 == 0, F.concat(wrapped(text), F.lit("\n"))).otherwise(wrapped(text)).alias("line"))


# rearrangements; what depends on order is checked against planted genomes in the tests

@_query()
def inversions(spark, sf_dir):
    a = alignments(spark, sf_dir)
    return re_.inversions(a, syntenic_chain(a))


@_query()
def in_place(spark, sf_dir):
    a = alignments(spark, sf_dir)
    c = syntenic_chain(a)
    return re_.in_place(a, c, re_.inversions(a, c))


@_query()
def translocations_and_duplications(spark, sf_dir):
    held, out = _placed(spark, sf_dir)
    blocks, _ = re_.candidate_blocks(out, held)
    return re_.solved(blocks, held).join(blocks, "block")


@_query()
def synteny_blocks(spark, sf_dir):
    a = alignments(spark, sf_dir)
    events = a.where("kind >= 13").withColumn("class", F.expr("CASE WHEN kind < 16 THEN 'inv' WHEN kind < 18 THEN 'TL' WHEN kind = 18 THEN 'dup' ELSE 'invDup' END"))
    syn = syntenic_chain(a).select("aln_id").join(a, "aln_id")
    return re_.synteny_blocks(syn, events)


@_query()
def single_variants(spark, sf_dir):
    """Positions of both tables that have one variant only, told apart by side."""
    v = _variants(spark, sf_dir)
    return va.single_positions(v.where("side = 0")).withColumn("side", F.lit(0)).unionByName(va.single_positions(v.where("side = 1")).withColumn("side", F.lit(1)))


@_query()
def scaffold_partners(spark, sf_dir):
    return sc.partners(alignments(spark, sf_dir), 2000)


@_query()
def scaffold_order(spark, sf_dir):
    a = alignments(spark, sf_dir)
    sizes = a.groupBy(F.col("a_chr").alias("chr")).agg((F.max("a_end") + 777).alias("size"))
    return sc.assembled(sc.partners(a, 2000), sizes, sizes)
