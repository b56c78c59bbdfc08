import re

from pyspark.sql import functions as F

from karyoframe.llm.pii import entities, replaced, with_surrogates

ROWS = [
    (1, "Mail Ana.López42@Mail7.example.com or (499) 555-6503, +1 (017) 555-7713 from 157.212.123.28!"),
    (2, "again ana.lópez42@mail7.example.com### and +1 017 555 7713; card 4111111111111111 not 4111111111111112."),
    (3, "Mr. John Smith met Mrs Jane Smith-Jones; Mr John Smith left. г-жа Анна Каренина, κ. Νίκος Παππάς, Dr. Who"),
    (4, "123-45-6789 4111 1111 1111 1111 GB82 WEST 1234 5698 7654 32 version 2.0. 999.1.2.3 1.2.3.4.5 12/11/2020"),
    (5, None),
    (6, ""),
    (None, "jo@x.org"),
    (7, "no entities here, $1 and 'quotes' \\ stay"),
    (7, "no entities here, $1 and 'quotes' \\ stay"),
]


def luhn(s):
    d = [int(c) for c in reversed(s)]
    return sum(x if i % 2 == 0 else 2 * x - 9 * (x > 4) for i, x in enumerate(d)) % 10 == 0


def test_surrogates(spark):
    df = spark.createDataFrame([(*r, 5) for r in ROWS], "doc_id long, text string, kind int")
    out = with_surrogates(df)
    assert out.columns == ["doc_id", "text", "kind", "n_entities"] and out.count() == len(ROWS)
    got = {r.doc_id: r for r in out.collect()}
    a, b, c, d = (got[i].text for i in (1, 2, 3, 4))
    assert [got[i].n_entities for i in (1, 2, 3, 4, 5, 6, 7, None)] == [4, 3, 6, 3, 0, 0, 0, 1]
    assert got[5].text is None and got[6].text == "" and got[7].text == ROWS[7][1]
    m = re.fullmatch(r"Mail (\S+) or (\(\d{3}\) \d{3}-\d{4}), (\+1 \(\d{3}\) \d{3}-\d{4}) from (\S+)!", a)
    n = re.fullmatch(r"again (\S+)### and (\+1 \d{3} \d{3} \d{4}); card (\d{16}) not 4111111111111112\.", b)
    assert m[1].lower() == n[1] and re.fullmatch(r"[A-Z][a-z]{2}\.[A-Z][a-z]{4}\d\d@[A-Z][a-z]{3}\d\.[a-z]{7}\.com", m[1])
    assert re.sub(r"\D", "", m[3]) == re.sub(r"\D", "", n[2]) and luhn(n[3]) and n[3][0] == "4" and n[3] != "4111111111111111"
    assert all(0 < int(x) < 255 for x in m[4].split("."))
    p = re.fullmatch(r"Mr\. (\S+ \S+) met Mrs (\S+ \S+); Mr (\S+ \S+) left\. г-жа ([А-Яа-яЁё]+ [А-Яа-яЁё]+), κ\. (\S+ \S+), Dr\. (\S+)", c)
    assert p[1] == p[3] != "John Smith" and p[1].split()[0] in ("Alden", "Boris", "Carlo", "Devin", "Edgar", "Felix", "Goran", "Henri")
    assert p[2].split()[0] in ("Alba", "Berta", "Clara", "Dora", "Edith", "Flora", "Greta", "Hanna")
    q = re.fullmatch(r"(\d{3}-\d{2}-\d{4}) (\d{4} \d{4} \d{4} \d{4}) (GB\d\d [A-Z]{4} \d{4} \d{4} \d{4} \d\d) version 2\.0\. 999\.1\.2\.3 1\.2\.3\.4\.5 12/11/2020", d)
    assert q[2].replace(" ", "") == n[3] and q[1] != "123-45-6789"
    # keyed and repeatable
    assert {r.text for r in with_surrogates(df).collect()} == {r.text for r in got.values()}
    assert with_surrogates(df, "other").where("doc_id = 1").first().text != a
    assert with_surrogates(df.limit(0)).count() == 0


def test_collisions_are_drawn_again(spark):
    # names of one gender and one word have few surrogates per first name: with many entities some must collide
    rows = [(i, f"call 555-01{i % 10}-{1000 + i % 10} or mail a{i // 26 // 26 % 26}@b.io, x@{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}.de") for i in range(900)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    ents = entities(df, "k1").collect()
    assert any(r.attempt for r in ents)
    assert len({(r.kind, r.surrogate) for r in ents}) == len(ents) and not {(r.kind, r.surrogate) for r in ents} & {(r.kind, r.canon) for r in ents}
    made = {(r.kind, r.canon): r.surrogate for r in ents}
    for r in with_surrogates(df).collect():
        mails = re.findall(r"\S+@\S+?(?=,|$)", r.text)
        assert mails == [made["email", x] for x in re.findall(r"\S+@\S+?(?=,|$)", rows[r.doc_id][1])]


def test_names_of_any_length(spark):
    names = ["Mr. Juan Carlos Garcia", "Mr Ludwig van Beethoven", "Mr J. Smith", "Mrs A. B. Jones-Miller-Brown", "Frau von der Leyen", "Dr Mary O'Neill", "Mr José María de la Cruz Ortega"]
    rows = [(i, f"so {n}, who left") for i, n in enumerate(names)]
    for r in with_surrogates(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        title = names[r.doc_id].split()[0]
        assert r.n_entities == 1 and re.fullmatch(rf"so {title} [A-Z][a-z]+(?: [A-Z][a-z]+)?, who left", r.text), r.text


def test_surnames_grow_with_attempts(spark):
    df = spark.range(3).withColumn("h", F.repeat(F.sha2(F.lit("x"), 512), 2))
    made = df.select(replaced(F.lit("he:smith"), F.lit("name"), F.col("h"), F.col("id").cast("int")).alias("s")).collect()
    assert [len(r.s) for r in made] == [11, 13, 15]


def test_short_forms_and_names_without_a_title(spark):
    rows = [
        (1, "Mr John Smith met John Smith and Mr Smith; Smith left, Smithson and Jane Smith stayed."),
        (2, "Dr John Smith wrote. Later Mr John Smith and Prof. van Beethoven, Frau Ludwig van Beethoven"),
        (3, "John Smith alone is no entity here, nor is Smith."),
    ]
    got = {r.doc_id: r for r in with_surrogates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    m = re.fullmatch(r"Mr (\w+) (\w+) met (\w+) (\w+) and Mr (\w+); (\w+) left, Smithson and Jane (\w+) stayed\.", got[1].text)
    assert m[1] == m[3] != "John" and {m[2], m[4], m[5], m[6], m[7]} == {m[2]} and m[2] != "Smith" and got[1].n_entities == 5
    n = re.fullmatch(r"Dr (\w+) (\w+) wrote\. Later Mr (\w+) (\w+) and Prof\. (\w+), Frau (\w+) (\w+)", got[2].text)
    assert (n[1], n[2], n[3], n[4]) == (m[1], m[2], m[1], m[2]) and n[5] == n[7] and n[6] not in (n[1], n[5])
    assert got[3].text == rows[2][1] and got[3].n_entities == 0


def mod97(s):
    s = s.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97


def test_account_numbers_stay_valid(spark):
    rows = [(1, "pay GB82 WEST 1234 5698 7654 32, DE89370400440532013000 or GB82WEST12345698765432"), (2, "GB83 WEST 1234 5698 7654 32 is none"), (3, "DE89 3704 0044 0532 0130 00 SOON and NL91 ABNA 0417 1643 00")]
    got = {r.doc_id: r for r in with_surrogates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    a = re.fullmatch(r"pay (GB\d\d [A-Z]{4} \d{4} \d{4} \d{4} \d\d), (DE\d{20}) or (GB\d\d[A-Z]{4}\d{14})", got[1].text)
    assert [mod97(x) for x in a.groups()] == [1, 1, 1] and a[1].replace(" ", "") == a[3] and "WEST" not in a[1]
    assert got[2].text == rows[1][1] and got[2].n_entities == 0
    b = re.fullmatch(r"(DE\d\d \d{4} \d{4} \d{4} \d{4} \d\d) SOON and (NL\d\d [A-Z]{4} \d{4} \d{4} \d\d)", got[3].text)
    assert b[1].replace(" ", "") == a[2] and mod97(b[2]) == 1


def test_many_entities_of_one_kind_stay_distinct(spark):
    # 100,000 surnames of one script, and 650 of the 676 addresses that have one letter on each side
    names = spark.range(100_000).selectExpr("id AS doc_id", "concat('Mr ', initcap(translate(cast(id + 100000 AS string), '0123456789', 'abcdefghij')), ' left') AS text")
    pairs = spark.range(650).selectExpr("null AS doc_id", "concat(char(97 + id % 26), '@', char(97 + id div 26), '.io') AS text")
    for docs, n in ((names, 100_000), (pairs, 650)):
        ents = entities(docs, "k1")
        r = ents.agg(F.count("*").alias("n"), F.countDistinct("kind", "surrogate").alias("d")).first()
        assert (r.n, r.d) == (n, n)
        assert not ents.join(ents.select("kind", F.col("canon").alias("surrogate")), ["kind", "surrogate"], "left_semi").count()
        new = with_surrogates(docs)
        assert new.select("text").distinct().count() == n and new.where("n_entities <> 1").count() == 0


def test_clashing_columns_and_marks(spark):
    rows = [(None, "a@b.org \u0001 Mr Jones", 1, 2, 3, 4), (None, "a@b.org", 5, 6, 7, 8), (3, "\u0001\u0001", 1, 1, 1, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _found int, _each int, _gaps int, n_entities int")
    new = with_surrogates(docs)
    assert new.columns == ["doc_id", "text", "_found", "_each", "_gaps", "n_entities"]
    got = sorted(new.collect(), key=lambda r: r._found * 10 + (r.doc_id or 0))
    assert [(r._found, r._each, r._gaps, r.n_entities) for r in got] == [(1, 2, 3, 2), (1, 1, 1, 0), (5, 6, 7, 1)]
    mail = got[2].text
    assert re.fullmatch(rf"{re.escape(mail)} \u0001 Mr [A-Z][a-z]+", got[0].text) and got[1].text == "\u0001\u0001"
