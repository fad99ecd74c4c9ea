"""The pipeline's stages against plain versions, and the entry's guard."""

import re

import corpus_pipeline as C
from lectern.llm import catalog
from lectern.llm.common import materialize, table


def test_stages_on_the_small_tables(spark, sf_dir):
    assert [n for n, _ in C.STAGES] == ["language_id", "ngram_jaccard", "pii_surrogates", "source_mix", "sentencepiece"]
    docs = table(spark, sf_dir, "documents")
    seen = {}
    for name, stage in C.STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name)
        seen[name] = docs
        if name != "sentencepiece":
            assert docs.columns == C.COLUMNS
    start = {r["doc_id"]: r["text"] for r in table(spark, sf_dir, "documents").collect()}
    lang = {r["doc_id"] for r in seen["language_id"].collect()}
    letters = {i for i, t in start.items() if re.search(r"[^\W\d_]", t or "")}
    assert lang <= letters and len(lang) >= 0.99 * len(letters)

    from tests.llm.test_ngram_join import brute
    ids = sorted(lang)
    keep = {i for i, _, c in brute(ids, [start[i] for i in ids]) if i == c}
    assert {r["doc_id"] for r in seen["ngram_jaccard"].collect()} == keep

    before = {r["doc_id"]: r for r in seen["ngram_jaccard"].collect()}
    after = {r["doc_id"]: r for r in seen["pii_surrogates"].collect()}
    assert set(before) == set(after)
    for i, r in after.items():
        assert r["n_chars"] == len(r["text"]) if r["text"] != before[i]["text"] else r == before[i]
        assert not re.search(r"@mail\d", r["text"])

    mixed = seen["source_mix"].collect()
    count = {}
    for r in mixed:
        count[r["doc_id"]] = count.get(r["doc_id"], 0) + 1
        assert r == after[r["doc_id"]]
    assert max(count.values()) <= 3

    final = seen["sentencepiece"].collect()
    assert len(final) == len(mixed) and all(r["round_trip"] for r in final)
    assert set(final[0].asDict()) == {"doc_id", "lang", "source", "ids", "n_ids", "round_trip"}


def test_registered_names():
    import __spark_entry__ as E
    names = set(E.queries())
    assert {"pipeline", *catalog.QUERIES} <= names
    for n in range(1, 11):
        assert sum(q.startswith(f"op{n}_") for q in names) == 1
    assert set(catalog.SQL) <= set(catalog.QUERIES)


def test_entry_without_the_subpackage(tmp_path):
    import os
    import shutil
    import subprocess
    import sys
    root = os.path.dirname(os.path.abspath(C.__file__))
    shutil.copytree(os.path.join(root, "lectern"), tmp_path / "lectern", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(os.path.join(root, "__spark_entry__.py"), tmp_path)
    code = "import __spark_entry__ as E; q = E.queries(); assert 'pipeline' not in q and len(q) > 40; E.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, timeout=120,
                   env={k: v for k, v in os.environ.items() if k != "PYTHONPATH"})


def pipeline_rows(spark, rows):
    return spark.createDataFrame([(i, t, lang, "s", len(t)) for i, (t, lang) in enumerate(rows)],
                                 "doc_id LONG, text STRING, lang STRING, source STRING, n_chars INT")


def test_near_copies_take_five_words_and_four_fifths(spark):
    base = " ".join(f"w{i}" for i in range(208))
    longer = base + " " + " ".join(f"x{i}" for i in range(45))     # 204 of 249 five-word shingles, 205 of 250 four-word ones
    other = base + " " + " ".join(f"y{i}" for i in range(60))      # 204 of 264
    docs = pipeline_rows(spark, [(base, "en"), (longer, "en"), (other, "en")])
    assert {r["doc_id"] for r in C.near_duplicates(spark, docs, "").collect()} == {0, 2}


def test_missing_languages_come_from_the_network(spark):
    en = "the house and the river with those words which they would have thought through"
    el = "το σπίτι και το ποτάμι με τις λέξεις που θα είχαν σκεφτεί όλοι μαζί"
    rows = [(f"{en} {i}", "en") for i in range(10)] + [(f"{el} {i}", "el") for i in range(10)] + [(en, None), (el, None), ("12 34", None), (el, "en")]
    got = {r["doc_id"]: r["lang"] for r in C.language_id(spark, pipeline_rows(spark, rows), "").collect()}
    assert got == {**{i: lang for i, (_, lang) in enumerate(rows[:20])}, 20: "en", 21: "el", 23: "en"}


def test_a_text_is_labelled_once(spark):
    rows = [("the house and the river", "en"), ("το σπίτι και το ποτάμι", "el"), ("12", None)]
    plan = C.language_id(spark, pipeline_rows(spark, rows), "")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("pooled(") == 1
