import os

import pytest

from citeloom.llm import licences
from tests.oracle import compare


def test_variants(spark):
    mit = licences.KNOWN[0][2]
    rows = [
        (1, mit),
        (2, "Copyright (c) 2020 A. Person\n\n" + mit.upper().replace(",", " ;").replace("LICENSE", "LICENCE")),
        (3, "© 1999 X\nAll rights reserved.\n" + mit.replace(" ", "  ").replace("noninfringement", "non-infringement")),
        (4, mit + " And one more thing."),
        (5, "Some text.\nLicenced under the Apache Licence (Version 2.0)\nmore"),
        (6, None),
        (7, "Copyright 2001"),
        (8, "Released under the MIT License.\nLicensed under CC BY 4.0.\nreleased under the mit license"),
        (8, "Released under the MIT License."),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'z' as digest", "1 as keep")
    got = licences.scan_licences(df).collect()
    by = {}
    for r in got:
        by.setdefault(r.doc_id, []).append(r)
    assert [by[i][0].licence for i in (1, 2, 3)] == ["MIT"] * 3
    assert by[1][0].digest == by[2][0].digest == by[3][0].digest
    assert by[4][0].licence is None and by[4][0].notices == [] and by[4][0].digest
    assert by[5][0].notices == ["Apache-2.0"] and by[5][0].licence is None
    assert by[6][0].digest is None and by[7][0].digest is None and by[6][0].notices == []
    assert sorted(map(str, (r.notices for r in by[8]))) == sorted(["['CC-BY-4.0', 'MIT']", "['MIT']"])
    assert len(got) == len(rows) and got[0].keep == 1
    assert licences.scan_licences(df.limit(0)).count() == 0
    assert [r.licence for r in licences.scan_licences(df, known=[]).collect()] == [None] * len(rows)


def test_entire_texts_over_a_table(spark):
    """Whole texts of every known licence, in unlike dress, among others; empty, very long and repeated ones too."""
    rows, want = [], {}
    for n, (licence, kind, body) in enumerate(licences.KNOWN):
        for k, t in enumerate((body, f"(c) 2024 Someone\n{body.upper()}\n\n", body.replace(". ", ".\n"))):
            rows.append((10 * n + k, t))
            want[10 * n + k] = licence
    rows += [(9000, ""), (9001, "word " * 300_000), (9002, licences.KNOWN[0][2] + "\nnot"), (9003, " \n\t")]
    got = {r.doc_id: r for r in licences.scan_licences(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {i: got[i].licence for i in want} == want
    assert all(got[i].licence is None for i in (9000, 9001, 9002, 9003)) and got[9000].digest is None and got[9001].digest


@pytest.mark.skipif(not os.path.isdir("/usr/share/common-licenses"), reason="no full licence texts on this machine")
def test_published_texts(spark):
    names = {"Apache-2.0": "Apache-2.0", "GPL-2": "GPL-2.0", "GPL-3": "GPL-3.0", "LGPL-2.1": "LGPL-2.1", "MPL-2.0": "MPL-2.0", "CC0-1.0": "CC0-1.0"}
    texts = {n: open(f"/usr/share/common-licenses/{n}", encoding="utf-8").read() for n in names if os.path.exists(f"/usr/share/common-licenses/{n}")}
    rows = [(n, t) for n, t in texts.items()] + [(n + "+", "Copyright 2020 X\n" + t.replace("  ", " ").replace("\n\n", "\n")) for n, t in texts.items()] + [(n + "!", t + "\nand more") for n, t in texts.items()]
    got = {r.doc_id: r.licence for r in licences.scan_licences(spark.createDataFrame(rows, "doc_id string, text string")).collect()}
    assert all(got[n] == got[n + "+"] == names[n] and got[n + "!"] is None for n in texts)


def test_a_large_table_is_not_broadcast(spark):
    known = [(f"id{i}", "text", f"words of licence {i}") for i in range(20)]
    df = spark.createDataFrame([(1, "WORDS, of licence 7.")], "doc_id long, text string")
    assert licences.scan_licences(df, known, digests=[("more", "0" * 32)] * licences.BROADCAST).first().licence == "id7"


def test_oracle(spark):
    assert compare(spark, licences.op5_licences, licences.SQL, "/root/testdata/sf0.01") > 0
