import duckdb
import pytest

from karyoframe import catalog, catalog_rearranged  # noqa: F401

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in ("orders", "events", "documents"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", list(catalog.QUERIES))
def test_against_sql(spark, db, name):
    df = catalog.QUERIES[name](spark, DATA)
    cols = sorted(df.columns)
    got = sorted((tuple(r[c] for c in cols) for r in df.collect()), key=str)
    assert got
    if name in catalog.ORACLE_SQL:
        rel = db.sql(catalog.ORACLE_SQL[name])
        assert sorted(rel.columns) == cols
        at = [rel.columns.index(c) for c in cols]
        assert got == sorted((tuple(r[i] for i in at) for r in rel.fetchall()), key=str)


def test_whole_tables(spark):
    aln = catalog.alignments(spark, DATA).select("a_chr", "a_start", "a_end").collect()
    merged = catalog.merge_ranges(spark, DATA).collect()
    assert all(any(m.a_chr == a.a_chr and m.a_start <= a.a_start and a.a_end <= m.a_end for m in merged) for a in aln)
    covered = {r.a_chr: r.covered for r in catalog.covered_length(spark, DATA).collect()}
    assert covered == {c: len({x for a in aln if a.a_chr == c for x in range(a.a_start, a.a_end + 1)}) for c in covered}
    gaps = catalog.not_aligned_gaps(spark, DATA).collect()
    assert gaps and not any(a.a_chr == g.a_chr and a.a_start <= g.gap_end and g.gap_start <= a.a_end for g in gaps for a in aln)
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()}
    assert max(map(len, texts.values())) > 200 and all(len(r.plain) == len(texts[r.doc_id]) for r in catalog.revcomp(spark, DATA).collect())
