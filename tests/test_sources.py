"""Readers and sinks against small files."""

import gzip
import hashlib
import json

import pytest
from pyspark.errors import PySparkException

from citeloom.operators import pools, storage
from citeloom.sources import articles, judgements

XML = """<?xml version="1.0"?>
<!DOCTYPE PubmedArticleSet>
<PubmedArticleSet>
<PubmedArticle><MedlineCitation><PMID Version="1">00012</PMID><Article><Journal><Title>A &amp; B</Title><JournalIssue><PubDate><Year>2021</Year><Month>Mar</Month></PubDate></JournalIssue></Journal>
<ArticleTitle>On <i>E. coli</i> &#946; growth</ArticleTitle>
<Abstract><AbstractText Label="AIM">We saw <i>E. coli</i> grow &lt; 5.</AbstractText><AbstractText/><AbstractText>H<sub>2</sub>O
 helps.</AbstractText></Abstract></Article>
<MeshHeadingList><MeshHeading><DescriptorName UI="D1">x</DescriptorName></MeshHeading><MeshHeading><DescriptorName UI="D2">y</DescriptorName></MeshHeading></MeshHeadingList></MedlineCitation></PubmedArticle>
<PubmedArticle><MedlineCitation><PMID>2</PMID><Article><Journal><JournalIssue><PubDate><MedlineDate>2003 Spring</MedlineDate></PubDate></JournalIssue></Journal><ArticleTitle>T</ArticleTitle></Article></MedlineCitation></PubmedArticle>
<PubmedArticle><MedlineCitation><PMID></PMID><Article><ArticleTitle>no id</ArticleTitle></Article></MedlineCitation></PubmedArticle>
<PubmedArticle><MedlineCitation><PMID>3</PMID><Article><Journal><JournalIssue><PubDate><Year>2019</Year></PubDate></JournalIssue></Journal><ArticleTitle/><Abstract><AbstractText Label="EMPTY"></AbstractText></Abstract></Article></MedlineCitation></PubmedArticle>
</PubmedArticleSet>
"""


def test_xml(spark, tmp_path):
    (tmp_path / "a.xml").write_text(XML)
    (tmp_path / "deep").mkdir()
    (tmp_path / "deep" / "b.xml.gz").write_bytes(gzip.compress(XML.replace("00012", "77").encode()))
    (tmp_path / "notes.txt").write_text("<PubmedArticle>no</PubmedArticle>")
    rows = {r.pmid: r for r in articles.read_articles_xml(spark, str(tmp_path)).collect()}
    assert sorted(rows) == ["00012", "2", "3", "77"]
    a = rows["00012"]
    assert (a.title, a.journal, a.pubdate, a.mesh, a.empty_abstract) == ("On E. coli β growth", "A & B", "2021-03", ["D1", "D2"], False)
    assert a.abstract == "AIM: We saw E. coli grow < 5. H2O\n helps."
    assert (rows["2"].abstract, rows["2"].pubdate, rows["2"].mesh, rows["2"].empty_abstract) == ("", "2003 Sp", [], True)
    assert (rows["3"].title, rows["3"].abstract, rows["3"].pubdate, rows["3"].journal) == ("", "EMPTY:", "2019", "")
    assert rows["77"].abstract == a.abstract


def test_json_lines_and_collection(spark, tmp_path):
    (tmp_path / "a.xml").write_text(XML)
    rows = articles.read_articles_xml(spark, str(tmp_path / "a.xml"))
    assert articles.write_jsonl(rows, str(tmp_path / "out.jsonl")) == 3
    (tmp_path / "more.jsonl").write_text('{"pmid": "5", "title": "t", "mesh": []}\n\n{"pmid": "", "title": "gone"}\n')
    again = articles.read_articles_jsonl(spark, [str(tmp_path / "out.jsonl"), str(tmp_path / "more.jsonl")])
    assert {r.pmid for r in again.collect()} == {"00012", "2", "3", "5"}
    got = {r.id: r.contents for r in articles.to_collection(rows).collect()}
    assert got["2"] == "T" and got["00012"].startswith("On E. coli β growth AIM:")
    ids = spark.createDataFrame([("2",), ("2",), ("none",)], "id string")
    assert sorted(map(tuple, articles.doc_texts(ids, articles.to_collection(rows)).collect())) == [("2", "T"), ("none", "")]
    assert storage.count_within(rows, 3) == 3
    with pytest.raises(ValueError):
        storage.count_within(rows, 4)


def test_topics(spark, tmp_path):
    official = [{"meta_data": {"qa_id": "1", "question": "q"}, "answer": [{"text": "One.", "existing_supported_citations": [12, 3]}, {"text": "Two.", "existing_supported_citations": None}]}]
    (tmp_path / "o.json").write_text(json.dumps(official))
    rows = sorted(map(tuple, judgements.read_topics(spark, str(tmp_path / "o.json")).collect()))
    assert rows == [("1", "q", 0, "One.", ["12", "3"]), ("1", "q", 1, "Two.", [])]
    lines = [{"metadata": {"qa_id": "2"}, "question": "p", "answer": "First. Second!"}, {"meta_data": {"qa_id": "3"}, "answer": official[0]["answer"]}]
    (tmp_path / "l.jsonl").write_text("\n".join(map(json.dumps, lines)))
    rows = sorted(map(tuple, judgements.read_topics(spark, str(tmp_path / "l.jsonl")).collect()))
    assert [r[:4] for r in rows] == [("2", "p", 0, "First."), ("2", "p", 1, "Second!"), ("3", "", 0, "One."), ("3", "", 1, "Two.")]
    for bad in ([{"meta_data": {"question": "q"}, "answer": [{"text": "x"}]}], [{"meta_data": {"qa_id": "1"}, "answer": []}], [{"meta_data": {"qa_id": "1"}, "answer": [{"text": " "}]}]):
        (tmp_path / "bad.json").write_text(json.dumps(bad))
        with pytest.raises(PySparkException):
            judgements.read_topics(spark, str(tmp_path / "bad.json")).collect()


def test_qrels_and_submissions(spark, tmp_path):
    (tmp_path / "q.jsonl").write_text('{"qa_id": "1", "sentence_id": 0, "pmid": "5", "class": "support"}\n{"qa_id": "1", "sentence_id": 0, "pmid": "6", "class": "contradict", "source": "m", "relevance": 0}\n')
    rows = {r.pmid: (r.relevance, r.source) for r in judgements.read_qrels(spark, str(tmp_path / "q.jsonl")).collect()}
    assert rows == {"5": (1, "human"), "6": (0, "m")}
    official = [{"meta_data": {"qa_id": "1"}, "answer": [{"text": "a", "supported_citations": [5, 6], "contradicted_citations": None}]}]
    (tmp_path / "s.json").write_text(json.dumps(official))
    (tmp_path / "s.jsonl").write_text(json.dumps({"qa_id": "1", "sentences": [{"sentence_id": 0, "support_pmids": ["5", "6"], "contradict_pmids": []}]}))
    want = [("1", 0, "contradict", []), ("1", 0, "support", ["5", "6"])]
    for name in ("s.json", "s.jsonl"):
        assert sorted(map(tuple, judgements.submission_cells(spark, str(tmp_path / name)).collect())) == want
    sents = spark.createDataFrame([("1", "q", 0, "a", ["9", "x"]), ("1", "q", 1, "b", []), ("2", "q", 0, "c", [])], "qa_id string, question string, sentence_id int, sentence_text string, existing array<string>")
    picks = spark.createDataFrame([("1", 0, "support", i, p) for i, p in enumerate(["30", "4", "no", "5", "6"], 1)], "qa_id string, sentence_id int, class string, pos int, pmid string")
    out = judgements.official_submission(sents, picks).collect()
    assert len(out) == 1 and [a.supported_citations for a in out[0].answer] == [[30, 4, 5], []]
    assert [a.existing_supported_citations for a in out[0].answer] == [[9], None]
    old = judgements.legacy_submission(picks).collect()
    assert [(s.sentence_id, s.support_pmids, s.contradict_pmids) for s in old[0].sentences] == [(0, ["30", "4", "no"], [])]


def test_qrels_builders(spark):
    maps = spark.createDataFrame([("1", 0, {"5": "Supports", "6": "partially supports"}, {"7": "CONTRADICTS", "8": "neutral"})], "qa_id string, sentence_id int, supported map<string,string>, contradicted map<string,string>")
    assert sorted(r["class"] + r.pmid for r in judgements.qrels_from_label_maps(maps).collect()) == ["contradict7", "partial_support6", "support5"]
    kind = "qa_id string, machine_generated_answers map<string,struct<answer_sentences:array<struct<citation_assessment:array<struct<evidence_relation:string,cited_pmid:string>>>>>>"
    runs = spark.createDataFrame([("1", {"a": ([([("supporting", "5"), ("neutral", "6")],)],), "b": ([([("Supporting", "5"), ("contradicting", "7")],)],)})], kind)
    got = sorted((r.pmid, r["class"], r.n_judgements, r.sentence_id) for r in judgements.qrels_from_runs(runs).collect())
    assert got == [("5", "support", 2, -1), ("7", "contradict", 1, -1)]


def test_digests_and_pool_order(spark, tmp_path):
    (tmp_path / "f").write_bytes(b"abc")
    assert judgements.digests(spark, str(tmp_path / "f")).first().sha256 == hashlib.sha256(b"abc").hexdigest()
    assert judgements.resolve_pool({"official": "o", "expanded": "e"}) == ("expanded", "e")
    with pytest.raises(FileNotFoundError):
        judgements.resolve_pool({})


def test_stages_are_skipped_and_reused(spark, tmp_path):
    calls = []

    def make():
        calls.append(1)
        return spark.range(3)

    one, two = str(tmp_path / "one"), str(tmp_path / "two")
    assert [storage.stage(spark, one, "a", make)[1] for _ in range(2)] == [True, False] and len(calls) == 1
    out, new = storage.stage(spark, two, "a", make, reuse_from=one)
    assert not new and out.count() == 3 and len(calls) == 1
    (tmp_path / "one" / "a" / "_SUCCESS").unlink()  # half written
    assert storage.stage(spark, one, "a", make)[1] and len(calls) == 2


def test_pool_sink(spark, tmp_path):
    kind = "qa_id string, sentence_id int, pmid string, class string, relevance int, source string, confidence double"
    human = spark.createDataFrame([("2", 0, "9", "support", 1, "human", None, 1), ("1", 0, "3", "support", 1, "human", None, 0)], kind + ", ord int")
    judged = spark.createDataFrame([("1", 1, "5", "contradict", 1, "m", 0.5), ("1", 0, "8", "support", 1, "m", 0.7)], kind)
    at = str(tmp_path / "pool")
    for _ in range(2):  # the second replaces the first
        assert pools.write_pool(human, judged, at, note="n") == 4
    lines = [json.loads(line) for f in sorted((tmp_path / "pool").glob("part-*")) for line in f.read_text().splitlines()]
    assert [r["pmid"] for r in lines] == ["3", "9", "8", "5"]
    meta = storage.read_meta(spark, at)
    assert (meta["rows"], meta["human"], meta["judged"], meta["note"]) == (4, 2, 2, "n")
    assert not [p for p in tmp_path.iterdir() if "tmp" in p.name or "old" in p.name]
