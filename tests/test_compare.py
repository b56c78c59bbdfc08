"""A pair of small genomes with planted rearrangements and variants, whose rows are written by hand."""

import random

import pytest

from karyoframe.plans import compare
from karyoframe.sinks import TABLE, summary_lines, table_lines, vcf_lines
from karyoframe.operators.variants import summary

COMPLEMENT = str.maketrans("ACGT", "TGCA")


def rc(s):
    return s.translate(COMPLEMENT)[::-1]


class Planted:
    """Pieces of A laid out along B; each aligned piece gives an alignment with its CIGAR."""

    def __init__(self, seed=1):
        self.rnd = random.Random(seed)
        self.a, self.b, self.aln = {}, {}, []

    def bases(self, n):
        return "".join(self.rnd.choice("ACGT") for _ in range(n))

    def put(self, chr_b, text):
        start = len(self.b.get(chr_b, "")) + 1
        self.b[chr_b] = self.b.get(chr_b, "") + text
        return start

    def align(self, a_chr, a0, a1, b_chr, turned=False, cigar=None, text=None):
        """Lays A[a0..a1] (or its copy ``text``, aligned by ``cigar``) at the end of B."""
        text = text if text is not None else self.a[a_chr][a0 - 1 : a1]
        b0 = self.put(b_chr, rc(text) if turned else text)
        b1 = b0 + len(text) - 1
        self.aln.append((a_chr, b_chr, a0, a1, b1 if turned else b0, b0 if turned else b1, -1 if turned else 1, 99.5, a1 - a0 + 1, len(text), cigar or f"{a1 - a0 + 1}="))


@pytest.fixture(scope="module")
def planted():
    p = Planted()
    p.a = {"Chr1": p.bases(120_000), "Chr2": p.bases(60_000)}
    a = p.a["Chr1"]
    p.align("Chr1", 1, 10_000, "Chr1")
    # a SNP, an insertion of 3 and a deletion of 2 within an alignment
    other = {"A": "C", "C": "G", "G": "T", "T": "A"}[a[14_999]]
    text = a[10_000:14_999] + other + a[15_000:16_000] + "GGG" + a[16_000:17_000] + a[17_002:20_000]
    p.align("Chr1", 10_001, 20_000, "Chr1", text=text, cigar="4999=1X1000=3I1000=2D2998=")
    p.align("Chr1", 20_001, 30_000, "Chr1", turned=True)  # inversion
    p.align("Chr1", 30_001, 40_000, "Chr1")
    p.align("Chr1", 40_501, 50_000, "Chr1")  # 500 bases of A deleted before it
    # 50,001-60,000 goes to behind 80,000
    p.align("Chr1", 60_001, 80_000, "Chr1")
    p.align("Chr1", 50_001, 60_000, "Chr1")  # translocation
    p.align("Chr1", 80_001, 90_000, "Chr1")
    p.put("Chr1", p.bases(3000))  # bases that B alone has
    p.align("Chr1", 90_001, 100_000, "Chr1")
    p.align("Chr1", 95_001, 99_000, "Chr1")  # a second copy of 4,000 bases in B
    p.align("Chr1", 100_001, 117_000, "Chr1")  # the last 3,000 bases of A align nowhere
    p.align("Chr2", 1, 25_000, "Chr2")
    p.align("Chr2", 30_001, 60_000, "Chr2")
    p.align("Chr2", 25_001, 30_000, "Chr1")  # to another chromosome
    return p


@pytest.fixture(scope="module")
def result(spark, planted):
    names = "a_chr string, b_chr string, a_start long, a_end long, b_start long, b_end long, b_dir int, iden double, a_len long, b_len long, cigar string"
    aln, mapped = compare.prepared(spark.createDataFrame(planted.aln, names))
    assert mapped is None
    fasta = lambda d: spark.createDataFrame([(k, v, len(v)) for k, v in d.items()], "chr string, seq string, len int")
    genomes = compare.checked_genomes(aln, fasta(planted.a), fasta(planted.b), None)
    found = compare.rearranged(aln)
    return aln, found, compare.compared(found, *genomes, hdrseq=True), genomes


def rows(df, kinds):
    return sorted((r.kind, r.a_chr, r.a_start, r.a_end, r.b_chr, r.b_start, r.b_end) for r in df.where(df.kind.isin(*kinds)).collect())


def test_rearrangements(result, planted):
    table = result[2].cache()
    at = {(r[0], r[2]): r for r in planted.aln}  # by the begin on A; the copy is a row of its own
    b = lambda c, s: (min(at[c, s][4:6]), max(at[c, s][4:6]))
    got = rows(table, ["INV", "TRANS", "DUP", "INVDP", "INVTR"])
    assert got == sorted([
        ("INV", "Chr1", 20_001, 30_000, "Chr1", *b("Chr1", 20_001)),
        ("TRANS", "Chr1", 50_001, 60_000, "Chr1", *b("Chr1", 50_001)),
        ("TRANS", "Chr2", 25_001, 30_000, "Chr1", *b("Chr2", 25_001)),
        ("DUP", "Chr1", 95_001, 99_000, "Chr1", *b("Chr1", 95_001)),
    ])
    assert {r.dupclass for r in table.where("kind = 'DUP'").collect()} == {"copygain"}
    syn = rows(table, ["SYN"])
    assert [r[2:4] for r in syn if r[1] == "Chr1"][0] == (1, 20_000)
    ids = [r.id for r in table.collect()]
    assert len(ids) == len(set(ids))
    parents = {r.parent for r in table.where("parent is not null").collect()}
    assert parents <= set(ids)


def test_blocks_and_gaps_tile_each_chromosome(result, planted):
    table = result[2]
    for side, seqs in (("a", planted.a), ("b", planted.b)):
        for chr_, seq in seqs.items():
            covered = bytearray(len(seq) + 1)
            held = [r for r in table.where("parent is null").collect() if r[f"{side}_chr"] == chr_ and r[f"{side}_start"] is not None and not (side == "a" and r.a_chr is None)]
            for r in held:
                for k in range(r[f"{side}_start"], r[f"{side}_end"] + 1):
                    covered[k] = 1
            assert all(covered[1:]), (side, chr_, covered.index(0, 1))


def test_short_variants_have_their_anchors(result, planted):
    table = result[2].collect()
    a, b = planted.a, planted.b
    snp = [r for r in table if r.kind == "SNP"]
    assert [(r.a_start, r.a_seq, r.b_seq) for r in snp] == [(15_000, a["Chr1"][14_999], b["Chr1"][14_999])]
    for r in table:
        if r.kind in ("INS", "DEL", "HDR") and r.a_seq:
            assert r.a_seq == a[r.a_chr][r.a_start - 1 : r.a_start - 1 + len(r.a_seq)], r
            text = b[r.b_chr][min(r.b_start, r.b_end) - 1 : max(r.b_start, r.b_end)]
            assert r.b_seq in (text, rc(text)) or r.kind == "DEL", r
    small = sorted((r.kind, r.a_start, r.a_end, len(r.a_seq), len(r.b_seq)) for r in table if r.kind in ("INS", "DEL") and r.a_end < 20_000)
    assert small == [("DEL", 17_000, 17_002, 3, 1), ("INS", 16_000, 16_000, 1, 4)]
    assert ("DEL", 40_000, 40_500) in [(r.kind, r.a_start, r.a_end) for r in table]


def test_files(result, tmp_path):
    spark, table, sizes = result[2].sparkSession, result[2], result[3][2]
    compare.write_all(table, sizes, str(tmp_path))
    lines = [r.value for r in spark.read.text(f"{tmp_path}/table").collect()]
    assert len(lines) == table.count() and all(len(x.split("\t")) == len(TABLE) for x in lines)
    events = [x.split("\t") for x in lines]
    first = [x[8] for x in events if x[9] == "-" and x[0] == "Chr1" and x[10] != "NOTAL"]
    starts = [int(x[1]) for x in events if x[8] in first]
    assert starts == sorted(starts)
    for k, x in enumerate(events):
        if x[9] != "-":  # a child follows its event
            back = k
            while events[back][9] != "-":
                back -= 1
            assert events[back][8] == x[9]
    vcf = [r.value for r in spark.read.text(f"{tmp_path}/vcf").collect()]
    body = [x.split("\t") for x in vcf if not x.startswith("#")]
    assert vcf[0] == "##fileformat=VCFv4.3" and sum(x.startswith("##contig") for x in vcf) == 2
    assert [int(x[1]) for x in body if x[0] == "Chr1"] == sorted(int(x[1]) for x in body if x[0] == "Chr1")
    assert any(x[4] == "<INV>" and "VarType=SR" in x[7] for x in body)
    text = [r.value for r in spark.read.text(f"{tmp_path}/summary").collect()]
    assert text == summary_lines(summary(table)) and "Translocations\t2\t15000\t15000" in text
    assert table_lines(table).count() == len(lines) and vcf_lines(table).count() == len(body)


def test_command_line(spark, planted, result, tmp_path):
    from karyoframe import cli

    for name, seqs in (("a.fa", planted.a), ("b.fa", planted.b)):
        (tmp_path / name).write_text("".join(f">{k} x\n{v}\n" for k, v in seqs.items()))
    lines = [(a, b, a0, a1, b0, b1, d, c) for a, b, a0, a1, b0, b1, d, *_, c in planted.aln]
    paf = [f"{b}\t0\t{min(b0, b1) - 1}\t{max(b0, b1)}\t{'+-'[d < 0]}\t{a}\t0\t{a0 - 1}\t{a1}\t9\t9\t60\tcg:Z:{c}" for a, b, a0, a1, b0, b1, d, c in lines]
    (tmp_path / "x.paf").write_text("\n".join(paf) + "\n")
    args = ["compare", "-c", f"{tmp_path}/x.paf", "-r", f"{tmp_path}/a.fa", "-q", f"{tmp_path}/b.fa", "-F", "P", "--dir", str(tmp_path), "--hdrseq", "--all"]
    first = cli.run_compare(spark, cli.parser().parse_args([*args, "-k"]))
    key = lambda df: sorted((r.kind, r.a_chr or "", r.a_start or 0, r.a_end or 0, r.b_chr or "", r.b_start or 0, r.b_end or 0, r.a_seq or "", r.b_seq or "") for r in df.collect())
    assert key(first) == key(result[2])
    for name in ("table", "vcf", "summary"):
        assert spark.read.text(f"{tmp_path}/out/{name}").count()
    again = cli.run_compare(spark, cli.parser().parse_args([*args, "--nosr", "--nosnp", "--prefix", ""]))
    short = [x for x in key(first) if x[0] not in ("SNP",) and not (x[0] in ("INS", "DEL") and x[3] < 20_000)]
    assert key(again) == short
    with pytest.raises(ValueError):
        cli.run_compare(spark, cli.parser().parse_args([*args, "--unip", "1.5"]))
