import random

import corpus_pipeline
from citeloom.llm import bpe, common, langid, mixing
from tests.llm.test_linededup import brute as lines_brute
from tests.llm.test_minhash import brute as groups_brute
from tests.llm.test_mixing import brute as mixing_brute


def test_against_brute_force(spark, tmp_path):
    r = random.Random(7)
    words = [f"{a}{b}" for a in "bdfgklmnpr" for b in ("an", "ee", "ist", "ou", "ent")]
    rows = []
    for i in range(60):
        text = "\n".join(" ".join(r.choice(words) for _ in range(r.randint(6, 30))) for _ in range(3))
        rows.append((i, text, r.choice(["en", "fr"]), f"src{i % 5}"))
    rows += [(100 + i, rows[i][1].replace("\n", "\nnew ", 1), "en", "src0") for i in range(8)]
    rows += [(200, None, "en", "src1"), (201, "12 34", "fr", "src1"), (202, rows[3][1], "fr", "src2")]
    docs = spark.createDataFrame([(*x, len(x[1] or "")) for x in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    got = {x.doc_id: x for x in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    model = langid.fit_language_model(docs.filter(common.doc_fold(docs.doc_id, 5) != 0))
    told = {x.doc_id: x for x in langid.predict_languages(docs, model).collect()}
    kept = {i: (t, told[i].lang_pred, s) for i, t, _, s in rows if t and any(c.isalpha() for c in t) and told[i].score >= corpus_pipeline.LEAST_SCORE}
    clean = {i: t for (i, _), t in lines_brute([(i, t) for i, (t, _, _) in kept.items()]).items()}
    clean = {i: t for i, t in clean.items() if t == kept[i][0] or t.strip()}
    groups = {d: c for d, _, c in groups_brute(list(clean.items()), 5, 80, 100)}
    alone = [(i, t, *kept[i][1:]) for i, t in clean.items() if groups[i] == i]
    want = mixing_brute(alone, 0.9, 1, mixing.WEIGHTS)
    assert set(got) == set(want) and got
    codec = bpe.codec(bpe.default_vocabulary())
    assert all(got[i].text == clean[i] and got[i].lang == told[i].lang_pred and list(got[i].token_ids) == codec.encode(clean[i]).tolist() for i in got)


def test_language_is_the_predicted_one(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    rows = [(i, "the cat and the dog" if i % 2 else "le chat et le chien", "en" if i % 2 else "fr", "s", 19) for i in range(40)]
    docs = spark.createDataFrame([*rows, (50, "the dog and the cat", None, "s", 19), (51, "12", None, "s", 2), (52, "le chien et le chat", "en", "s", 19)], schema)
    got = {r.doc_id: r.lang for r in corpus_pipeline.identify_language(spark, docs, "").collect()}
    assert got == {r[0]: r[2] for r in rows} | {50: "en", 52: "fr"}
    bare = spark.createDataFrame([(1, "some words", None, "s", 10), (2, "12 34", None, "s", 5), (3, None, None, "s", 0)], schema)
    assert [r.doc_id for r in corpus_pipeline.identify_language(spark, bare, "").collect()] == [1]


def test_low_scores_go(spark, monkeypatch):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    rows = [(i, "the cat and the dog" if i % 2 else "le chat et le chien", "en" if i % 2 else "fr", "s", 19) for i in range(40)]
    docs = spark.createDataFrame(rows, schema)
    monkeypatch.setattr(corpus_pipeline, "LEAST_SCORE", 1.1)
    assert corpus_pipeline.identify_language(spark, docs, "").count() == 0


def test_edges_and_stage_folders(spark, tmp_path, monkeypatch):
    """An empty table; repeated rows, null ids, and an extra column called like an added one; nothing but the result stays in the shared folder."""
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    shared = tmp_path / "shared"
    shared.mkdir()
    monkeypatch.setattr(corpus_pipeline.common, "shared_folder", lambda spark: str(shared))
    spark.createDataFrame([], schema).write.parquet(str(tmp_path / "none" / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path / "none")).count() == 0
    text = [" ".join(f"{w}{i}" for i in range(25)) for w in ("alpha", "beta", "gamma", "delta")]
    rows = [(1, text[0]), (1, text[0]), (None, text[1]), (2, text[2]), (2, text[3]), (3, text[2] + " more"), (4, ""), (5, None)]
    df = spark.createDataFrame([(i, t, "en", "src1", len(t or "")) for i, t in rows], schema).selectExpr("*", "'x' as n_tokens", "1 as th", "2 as removed", "3 as component_id")
    df.write.parquet(str(tmp_path / "some" / "documents.parquet"))
    got = corpus_pipeline.run(spark, str(tmp_path / "some"))
    assert got.filter("text is null or text = ''").count() == 0 and set(corpus_pipeline.COLUMNS) < set(got.columns)
    assert all(x <= 1 for x in [got.filter(f"doc_id = {i} and startswith(text, '{w}')").count() for i, w in ((1, "alpha"), (2, "gamma"), (2, "delta"), (3, "gamma"))])
    left = [p.name for top in shared.iterdir() if top.name.startswith("pipeline-") for p in top.iterdir()]
    assert left == ["bpe_encoding"] * 2
    monkeypatch.setattr(corpus_pipeline, "STAGES", [corpus_pipeline.STAGES[0], ("broken", lambda *a: 1 / 0)])
    before = sorted(p.name for p in shared.iterdir())
    try:
        corpus_pipeline.run(spark, str(tmp_path / "some"))
    except ZeroDivisionError:
        pass
    assert sorted(p.name for p in shared.iterdir()) == before


def test_documents_without_an_id_or_with_a_shared_one(spark):
    one, two = (" ".join(f"{w}{i}" for i in range(30)) for w in "ab")
    rows = [(None, one), (None, one), (1, one), (1, one), (1, two), (2, two), (3, one + " end")]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = sorted(((r.doc_id, r.text) for r in corpus_pipeline.dedup_documents(spark, docs, "").collect()), key=str)
    assert got == sorted([(None, one), (None, one), (1, one), (1, two)], key=str)
    assert corpus_pipeline.dedup_documents(spark, docs.limit(0), "").count() == 0
