import re
from collections import Counter, defaultdict

import duckdb
from pyspark.sql import functions as F

from foldwise.llm import quality_rules as q
from foldwise.llm.queries import ORACLES
from tests.llm.helpers import SF, awkward, empty, prose, table

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def base(text):
    words = WORD.findall(text or "")
    grams = Counter(zip(words, words[1:], words[2:]))
    inside = {i + s for i, g in enumerate(zip(words, words[1:], words[2:])) if grams[g] > 1 for s in range(3)}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    return (len(words), sum(map(len, words)), sum((text or "").count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)),
            len(inside), len(words) < 50 or 100 * len(inside) > 50 * len(words))


def removed(rows):
    seen, sizes = defaultdict(set), defaultdict(set)
    norm = lambda x: " ".join(w.decode() for w in x.lower().encode().split())
    for _, t, s in rows:
        sizes[s].add(t or "")
        for x in (t or "").split("\n"):
            if norm(x):
                seen[s, norm(x)].add(t)
    bad = {k for k, v in seen.items() if len(v) > q.MIN_DOCS and len(v) > q.MAX_SHARE * len(sizes[k[0]])}
    return [sum(len(norm(x).split(" ")) for x in (t or "").split("\n") if (s, norm(x)) in bad) for _, t, s in rows]


def check(docs):
    rows = [(r.doc_id, r.text, r.source) for r in docs.select("doc_id", "text", "source").collect()]
    want = []
    for (i, t, _), gone in zip(rows, removed(rows), strict=True):
        b = base(t)
        want.append((i, *b, gone, not b[-1] and b[0] - gone >= b[0] * q.MIN_LEFT))
    got = [tuple(r) for r in q.quality_verdicts(docs).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    return got


def test_given_table(spark):
    check(table(spark, "documents", SF))


def test_frequent_lines(spark):
    rows = [(i, prose(60, i) + "\nAccept  all COOKIES now", "en", "a" if i % 2 else None, 1) for i in range(60)]
    rows += [(100 + i, prose(30, i) + ("\naccept all cookies now" * 12), "en", "a", 1) for i in range(3)]
    rows += [(200 + i, prose(70, 777), "en", "a", 1) for i in range(40)]       # copies are one document
    rows += [(300, prose(60, 99) + "\nAccept all cookies now", "en", "b", 1)]  # not frequent on this host
    got = check(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long"))
    kept = {r[0]: r[-1] for r in got}
    assert all(kept[i] for i in range(60)) and all(kept[200 + i] for i in range(40))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    clean = {r.doc_id: r.text for r in q.clean_documents(docs).collect()}
    assert clean[1] == prose(60, 1) and clean[2] == prose(60, 2) and clean[300].endswith("cookies now")
    assert set(clean) == {i for i, k in kept.items() if k}


def test_awkward_and_empty(spark):
    check(awkward(spark))
    docs = awkward(spark)
    assert q.clean_documents(docs).columns == docs.columns
    assert q.quality_verdicts(empty(spark)).count() == 0 and q.clean_documents(empty(spark)).count() == 0


def test_sql_twin(spark):
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{SF}/documents.parquet'")
    want = con.sql(ORACLES["op3_line_quality"]).df()
    got = q.quality_verdicts(table(spark, "documents", SF)).toPandas()[list(want.columns)]
    assert sorted(map(str, got.values.tolist())) == sorted(map(str, want.values.tolist()))


def test_keeps_whole_table_shape(spark):
    docs = table(spark, "documents", SF)
    assert q.quality_verdicts(docs).count() == docs.count()
    assert q.clean_documents(docs).filter(F.col("text").isNull()).count() == 0


def test_frequent_long_lines(spark):
    notice = "We use cookies " + prose(35, 777)
    rows = [(i, prose(60, i) + "\n" + notice, "en", "a", 1) for i in range(30)]
    rows += [(100 + i, prose(50, 100 + i) + f"\n{notice}\n{notice}", "en", "a", 1) for i in range(3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = {r.doc_id: (r.removed_words, r.kept) for r in q.quality_verdicts(docs).collect()}
    assert got == {i: (38, True) for i in range(30)} | {100 + i: (76, False) for i in range(3)}
    assert {r.doc_id: r.text for r in q.clean_documents(docs).collect()} == {i: prose(60, i) for i in range(30)}
    short = q.quality_verdicts(docs, max_line_words=30).collect()
    assert all(r.removed_words == 0 for r in short)
