import shutil

import corpus_pipeline as cp
from foldwise.llm import queries as q
from tests.llm import test_decontam, test_ngram_join, test_packing, test_quality_rules, test_suffix_dedup  # noqa: F401
from tests.llm.helpers import MID, SCHEMA, SF, awkward_rows, table


def test_registered_queries():
    assert sorted(int(n[2:].split("_")[0]) for n in q.QUERIES) == list(range(1, 11))
    import __spark_entry__ as entry
    names = entry.queries()
    assert "pipeline" in names and set(q.QUERIES) <= set(names) and set(q.ORACLES) <= set(entry.oracle_sql())


def test_stages_against_brute_force(spark):
    """Every stage on what its predecessor kept, held against the brute-force rules."""
    docs = table(spark, "documents", MID)
    columns = docs.columns
    good = cp.quality(spark, docs, MID).persist()
    verdict = {r[0]: r[-1] for r in test_quality_rules.check(docs)}
    assert good.columns == columns and {r.doc_id for r in good.collect()} == {i for i, k in verdict.items() if k}
    single = cp.near_duplicates(spark, good, MID).persist()
    classes = {c for _, c, _ in test_ngram_join.brute([(r.doc_id, r.text) for r in good.collect()])}
    assert single.columns == columns and {r.doc_id for r in single.collect()} == classes
    cut = cp.repeated_substrings(spark, single, MID).persist()
    want = {r[0]: r for r in test_suffix_dedup.brute([(r.doc_id, r.text) for r in single.collect()], cp.PASSAGE_BYTES)}
    for r in cut.collect():
        n = len(r.text.encode())
        assert want[r.doc_id][1] - want[r.doc_id][2] <= n <= want[r.doc_id][1] - want[r.doc_id][2] + 6 * want[r.doc_id][3]
        assert r.n_chars == len(r.text)
    assert cut.columns == columns and cut.count() == single.count()
    clean = cp.decontamination(spark, cut, MID).persist()
    norm = lambda t: f" {' '.join(''.join(c if c.isalnum() else ' ' for c in t.lower()).split())} "
    items = [norm(r.text) for r in table(spark, "benchmark", MID).collect()]
    leaking = {r.doc_id for r in cut.collect() if any(i in norm(r.text) for i in items)}
    kept = {r.doc_id for r in clean.collect()}
    assert not kept & leaking and len(kept) >= 0.98 * (cut.count() - len(leaking))
    rows = cp.packed(spark, clean, MID).collect()
    assert test_packing.check(rows, [(r.doc_id, r.text) for r in clean.collect()], (2048, 4096, 8192, 16384)) > 0.9


def test_awkward_table_runs_through(spark, tmp_path):
    rows = awkward_rows() + [(100 + i, f"word{i} " * 3 + " ".join(f"t{i}x{j}" for j in range(60)), "en", "a", 1)
                             for i in range(10)]
    folder = str(tmp_path / "sf")
    spark.createDataFrame(rows, SCHEMA).write.parquet(folder + "/documents.parquet")
    shutil.copy(f"{SF}/benchmark.parquet", folder + "/benchmark.parquet")
    out = cp.run(spark, folder)
    assert {100 + i for i in range(10)} <= {r.doc_id for r in out.collect()}


def test_empty_table_runs_through(spark, tmp_path):
    folder = str(tmp_path / "sf")
    spark.createDataFrame([], SCHEMA).write.parquet(folder + "/documents.parquet")
    shutil.copy(f"{SF}/benchmark.parquet", folder + "/benchmark.parquet")
    assert cp.run(spark, folder).count() == 0
