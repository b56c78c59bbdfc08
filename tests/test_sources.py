import gzip
import struct

import pytest

from karyoframe import sources
from karyoframe.sinks import block_lines, fasta_lines, pseudo_chromosomes, scaffold_report, vcf_header, write_fasta, write_lines, write_names


def put(path, text):
    path.write_text(text)
    return str(path)


def test_alignment_tables(spark, tmp_path):
    row = "1\t100\t5\t104\t100\t100\t99.5\t1\t1\tChr1\tChr1"
    path = put(tmp_path / "a.tsv", f"{row}\n{row}\t100=\textra\n")
    got = sources.read_alignment_table(spark, path).collect()
    assert [(r.a_start, r.b_end, r.iden, r.b_chr, r.cigar) for r in got] == [(1, 104, 99.5, "Chr1", None), (1, 104, 99.5, "Chr1", "100=")]
    up = spark.read.csv(put(tmp_path / "b.tsv", row.replace("1\t1\tChr1", "1\t-1\tChr1") + "\t\n"), sep="\t", schema=sources.ALIGNMENT)
    assert [(r.b_start, r.b_end) for r in sources.check_alignments(up).collect()] == [(104, 5)]
    for wrong in (row.replace("\t1\t1\t", "\t-1\t1\t"), row.replace("\t1\t1\t", "\t1\t2\t"), row.replace("Chr1\tChr1", "1\tChr1")):
        with pytest.raises(ValueError):
            sources.check_alignments(sources.read_alignment_table(spark, put(tmp_path / "c.tsv", wrong)))
    mixed = row.replace("1\t1\tChr1", "1\t-1\tChr1")
    both = mixed + "\n" + mixed.replace("5\t104", "104\t5")
    with pytest.raises(ValueError):
        sources.check_alignments(sources.read_alignment_table(spark, put(tmp_path / "d.tsv", both)))


def test_sam_and_paf(spark, tmp_path):
    sam = "@HD\tx\nq1\t0\tChr1\t11\t60\t3S5=1X2I4D6=2H\t*\nq2\t16\tChr1\t1\t60\t4H10=7S\t*\nq3\t4\t*\t0\t0\t*\t*\n"
    got = {r.b_chr: r for r in sources.read_sam(spark, put(tmp_path / "a.sam", sam)).collect()}
    r = got["q1"]
    assert (r.a_start, r.a_end, r.b_start, r.b_end, r.a_len, r.b_len, r.iden, r.b_dir) == (11, 26, 4, 17, 16, 14, 61.11, 1)
    r = got["q2"]
    assert (r.a_start, r.a_end, r.b_start, r.b_end, r.b_dir) == (1, 10, 17, 8, -1)
    bad = put(tmp_path / "b.sam", sam + "q4\t0\tChr1\t1\t60\t10M\t*\nq5\t0\tChr1\t1\t60\t5=2S5=\t*\nq6\t0\tChr1\t1\t60\t5=3Z2=\t*\n")
    with pytest.raises(Exception, match="CIGAR"):
        sources.read_sam(spark, bad).collect()
    assert {r.line.split("\t")[0] for r in sources.read_sam(spark, bad, rejects=True).collect()} == {"q4", "q5", "q6"}
    records = sources.sam_records(spark, put(tmp_path / "c.sam", "a\t256\tC\t1\t0\t5=\t*\na\t0\tC\t1\t0\t5=\t*\nb\t2064\tC\t1\t0\t5=\t*\n"))
    assert [r.name for r in sources.without_primary(records).collect()] == ["b"]

    paf = "q\t100\t10\t20\t-\tChr1\t500\t99\t109\t9\t10\t60\ttp:A:P\tcg:Z:9=1X\n"
    (r,) = sources.read_paf(spark, put(tmp_path / "a.paf", paf)).collect()
    assert (r.a_start, r.a_end, r.b_start, r.b_end, r.iden, r.b_dir, r.b_chr) == (100, 109, 20, 11, 90.0, -1, "q")
    bad = put(tmp_path / "b.paf", paf + paf.replace("\tcg:Z:9=1X", "") + paf.replace("9=1X", "10M"))
    with pytest.raises(Exception, match="cg tag|CIGAR"):
        sources.read_paf(spark, bad).collect()
    assert sorted(r.reason[:5] for r in sources.read_paf(spark, bad, rejects=True).collect()) == ["a CIG", "no cg"]
    cut = sources.read_paf_as_table(spark, put(tmp_path / "c.paf", paf), 9, 89.0).collect()
    assert [(r.a_start, r.b_start, r.b_end, r.iden, r.cigar) for r in cut] == [(100, 11, 20, 90.0, "9=1X")]
    assert not sources.read_paf_as_table(spark, f"{tmp_path}/c.paf", 10, 89.0).count()


def test_bam(spark, tmp_path):
    ops = {c: k for k, c in enumerate("MIDNSHP=X")}

    def record(name, flag, ref, pos, cigar):
        body = struct.pack("<iiBBHHHiiii", ref, pos - 1, len(name) + 1, 60, 0, len(cigar), flag, 0, -1, -1, 0) + name.encode() + b"\0"
        body += b"".join(struct.pack("<I", n << 4 | ops[c]) for n, c in cigar)
        return struct.pack("<i", len(body)) + body

    text = b"@HD\n"
    data = b"BAM\1" + struct.pack("<i", len(text)) + text + struct.pack("<i", 1) + struct.pack("<i", 5) + b"Chr1\0" + struct.pack("<i", 500)
    data += record("q1", 0, 0, 11, [(3, "S"), (5, "="), (1, "X"), (2, "I"), (4, "D"), (6, "="), (2, "H")]) + record("q2", 16, 0, 1, [(4, "H"), (10, "="), (7, "S")]) + record("q3", 4, -1, 0, [])
    path = tmp_path / "a.bam"
    path.write_bytes(b"".join(gzip.compress(data[k : k + 40]) for k in range(0, len(data), 40)))  # blocks, as BGZF has them
    got = {r.b_chr: (r.a_start, r.a_end, r.b_start, r.b_end, r.iden, r.b_dir) for r in sources.read_bam(spark, [f"file://{path}"]).collect()}
    assert got == {"q1": (11, 26, 4, 17, 61.11, 1), "q2": (1, 10, 17, 8, 100.0, -1)}
    path.write_bytes(gzip.compress(data + record("q4", 0, 0, 1, [(5, "M")])))
    with pytest.raises(Exception, match="CIGAR"):
        sources.read_bam(spark, [f"file://{path}"]).collect()


def test_fasta(spark, tmp_path):
    text = ">a desc > more\nACGT\nacgt\n>b\n\n>c x\nNN\n"
    for path in (put(tmp_path / "a.fa", text), str(tmp_path / "b.fa.gz")):
        if path.endswith("gz"):
            with gzip.open(path, "wt") as f:
                f.write(text)
        assert sorted((r.chr, r.seq, r.len) for r in sources.read_fasta(spark, path).collect()) == [("a", "ACGTacgt", 8), ("b", "", 0), ("c", "NN", 2)]
    chunks = sorted((r.chr, r.begin, r.seq) for r in sources.read_fasta_chunks(spark, f"{tmp_path}/a.fa", 3).collect())
    assert chunks == [("a", 1, "ACG"), ("a", 4, "Tac"), ("a", 7, "gt"), ("c", 1, "NN")]
    with pytest.raises(Exception, match="more than one"):
        sources.read_fasta(spark, put(tmp_path / "c.fa", ">a\nA\n>a\nC\n")).collect()
    seqs = spark.createDataFrame([("a", "ACGT" * 40), ("b", "AAC"), ("c", "A" * 64)], "chr string, seq string")
    write_fasta(seqs, f"{tmp_path}/out", turned=["b"])
    back = {r.chr: r.seq for r in sources.read_fasta(spark, f"{tmp_path}/out").collect()}
    assert back == {"a": "ACGT" * 40, "b": "GTT", "c": "A" * 64}
    assert max(len(x) for r in fasta_lines(seqs).collect() for x in r.line.split("\n")) == 64


def test_vcf_snps_bed(spark, tmp_path):
    vcf = "##fileformat=VCFv4.3\n##ALT=<ID=INV,Description=x>\n##ALT=<ID=SNP,Description=x>\n#CHROM\tPOS\nc\t5\tid1\ta\tg,T\t7.5\tPASS\tEND=9;FLAG;X=a=b\tGT\t1|0\t0|1\nc\t6\t.\tA\t<INV>\t.\t.\t.\n"
    got = sources.read_vcf(spark, put(tmp_path / "a.vcf", vcf)).orderBy("pos").collect()
    r = got[0]
    assert (r.chrom, r.pos, r.id, r.ref, r.alts, r.qual, r["filter"], r.info, r.format, r.samples) == ("c", 5, "id1", "A", ["G", "T"], 7.5, "PASS", {"END": "9", "FLAG": None, "X": "a=b"}, "GT", ["1|0", "0|1"])
    assert (got[1].id, got[1].qual, got[1].info, got[1].samples, got[1].alts) == (None, None, None, None, ["<INV>"])
    assert sources.vcf_symbols(spark, f"{tmp_path}/a.vcf") == ("INV", "SNP")
    snps = sources.read_snps(spark, put(tmp_path / "s", "5\tA\t.\t7\t0\t0\t0\t0\t1\t-1\tChr1\tChr2\n")).collect()
    assert [tuple(r) for r in snps] == [(5, "A", ".", 7, 1, -1, "Chr1", "Chr2")]
    bed = put(tmp_path / "a.bed", "a\t1\t5\na\t7\t9\nb\t0\t2\n")
    assert sources.read_bed(spark, bed, grouped=True).count() == 3
    with pytest.raises(ValueError, match="chromosome a"):
        sources.read_bed(spark, put(tmp_path / "b.bed", "a\t1\t5\nb\t0\t2\na\t7\t9\n"), grouped=True)
    assert [tuple(r) for r in sources.read_faidx(spark, put(tmp_path / "a.fai", "a\t77\t3\t60\t61\n")).collect()] == [("a", 1, 77)]


def test_block_files_go_round(spark, tmp_path):
    blocks = spark.createDataFrame([("x", "syn", None, "Chr1", "Chr1", 1, 50, 1, 60), ("y", "dup", "B", "Chr1", "Chr1", 70, 90, 100, 120), ("z", "invTL", None, "Chr1", "Chr2", 95, 99, 5, 9)], "block string, class string, copies string, a_chr string, b_chr string, a_start long, a_end long, b_start long, b_end long")
    alns = spark.createDataFrame([("x", 1, 20, 1, 21), ("x", 30, 50, 40, 60), ("y", 70, 90, 100, 120), ("z", 95, 99, 9, 5)], "block string, a_start long, a_end long, b_start long, b_end long")
    lines = block_lines(blocks, alns)
    (tmp_path / "all").mkdir()
    for file in ("synOut", "dupOut", "ctxOut"):
        held = sorted((r.s, r["rank"], r.t, r.line) for r in lines.where(lines.file == file).collect())
        (tmp_path / "all" / f"{file}.txt").write_text("\n".join(x[3] for x in held) + "\n")
    found, own = sources.blocks_and_alignments(sources.read_blocks(spark, f"{tmp_path}/all/*Out.txt"))
    assert sorted((r["class"], r.a_chr, r.b_chr, r.a_start, r.a_end, r.b_start, r.b_end) for r in found.collect()) == [("dup", "Chr1", "Chr1", 70, 90, 100, 120), ("invTL", "Chr1", "Chr2", 95, 99, 5, 9), ("syn", "Chr1", "Chr1", 1, 50, 1, 60)]
    assert sorted((r.a_start, r.a_end, r.b_start, r.b_end, r.b_chr) for r in own.collect()) == [(1, 20, 1, 21, "Chr1"), (30, 50, 40, 60, "Chr1"), (70, 90, 100, 120, "Chr1"), (95, 99, 9, 5, "Chr2")]


def test_scaffold_outputs(spark, tmp_path):
    order = spark.createDataFrame([("p", 0, "s1", 1), ("p", 1, "s2", -1)], "chr string, place int, scaffold string, strand int")
    fasta = spark.createDataFrame([("s1", "AAC"), ("s2", "GGT")], "chr string, seq string")
    assert [tuple(r) for r in pseudo_chromosomes(order, fasta, 4).collect()] == [("p", "AACNNNNACC")]
    assert [r.line for r in scaffold_report(order, order.where("place = 1")).collect()] == ["p\ns1\ts2\n1\t-1\ns2\n-1"]
    write_names(spark.createDataFrame([("Chr2", "x"), ("Chr1", "y")], "a_chr string, b_chr string"), f"{tmp_path}/ids")
    assert [r.value for r in spark.read.text(f"{tmp_path}/ids").collect()] == ["Chr1\ty", "Chr2\tx"]
    write_lines(spark.range(300).selectExpr("id", "cast(id as string) AS line"), ["id"], f"{tmp_path}/lines", header=["first", "second"])
    assert [r.value for r in spark.read.text(f"{tmp_path}/lines").collect()] == ["first", "second", *map(str, range(300))]
    assert vcf_header([("a", 5)], "s")[3] == "##contig=<ID=a,length=5>"
