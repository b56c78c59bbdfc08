import os
import random

from karyoframe.llm.common import shared_dir
from karyoframe.llm.jaccard import jaccard_components, without_near_copies


def brute(rows, width=4, percent=85):
    sets = []
    for _, text in rows:
        w = [x for x in (text or "").encode().lower().split()]
        sets.append({tuple(w[i : i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else ({tuple(w)} if w else set()))
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return sorted(((d, len(s), least.get(find(i)) if s else d) for i, ((d, _), s) in enumerate(zip(rows, sets))), key=str)


def got(spark, rows, **extra):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    return sorted((tuple(r) for r in jaccard_components(df).select("doc_id", "n_shingles", "component_id").collect()), key=str)


def test_against_all_pairs(spark):
    rnd = random.Random(3)
    words = [f"w{i}" for i in range(400)]
    common = [rnd.choice(words) for _ in range(40)]
    rows, d = [], 0
    for base in range(25):
        text = [rnd.choice(words) for _ in range(rnd.choice([5, 30, 80, 200]))] + common * (base % 3 == 0)
        for copy in range(rnd.choice([1, 2, 9])):
            t = list(text)
            for _ in range(rnd.choice([0, 0, 1, 2, 4])):
                t[rnd.randrange(len(t))] = rnd.choice(words)
            rows.append((d, " ".join(t)))
            d += 1
    rows += [(None, rows[0][1]), (None, "one lone text here"), (d, None), (d + 1, ""), (d + 2, " \n "), (d + 3, "a b"), (d + 4, "A  B\n"), (d + 4, "a b"), (-7, rows[5][1].upper())]
    rnd.shuffle(rows)
    assert got(spark, rows) == brute(rows)


def test_large_group_of_near_copies(spark):
    rnd = random.Random(5)
    text = [f"w{i}" for i in range(90)]
    rows = []
    for d in range(700):
        t = list(text)
        for _ in range(rnd.choice([1, 1, 2, 3])):
            t[rnd.randrange(len(t))] = f"x{d}"
        rows.append((d, " ".join(t)))
    assert got(spark, rows) == brute(rows)


def test_empty_table_and_clashing_columns(spark):
    assert got(spark, []) == []
    df = spark.createDataFrame([(1, "a b c d e", 5, "x")], "doc_id long, text string, n long, component_id string")
    assert [tuple(r) for r in jaccard_components(df).collect()] == [(1, 2, 1)]


def test_scratch_is_deleted_when_nothing_reads_it(spark):
    """Of the tables that are written on the way, the result reads only the rows themselves."""
    top = shared_dir(spark).removeprefix("file://") + "/karyoframe"
    held = lambda: set(os.listdir(top)) if os.path.isdir(top) else set()
    before = held()
    docs = spark.range(40).selectExpr("id AS doc_id", "concat('some words that two texts share ', id div 2, ' and ', id div 2, ' more') AS text")
    kept = without_near_copies(docs)
    assert [x.split("-")[0] for x in held() - before] == ["rows"]
    assert sorted(r.doc_id for r in kept.collect()) == list(range(0, 40, 2))
    between, found = held(), jaccard_components(docs)
    assert [x.split("-")[0] for x in held() - between] == ["prints"]
    assert {r.doc_id: r.component_id for r in found.collect()} == {i: i - i % 2 for i in range(40)}
