"""Licence scans: planted notices are found, ordinary text isn't, and the pruning bound drops nothing."""

import numpy as np
import pytest

pytest.importorskip("public_tokenizers")
from ragweave.llm import bytehash, licenses  # noqa: E402

PLANTED = {
    "apache-2.0": "licensed under the apache license, version 2.0.",
    "gpl": "this work is licensed under the gnu general public license, version 3.",
    "mit": "released under the mit license.",
    "cc-by-nc": "licensed under cc by-nc 4.0.",
    "proprietary": "all rights reserved.",
}


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet("/root/testdata/sf0.01/documents.parquet")


@pytest.fixture(scope="module")
def model(documents):
    return licenses.train(documents)


def test_planted_notices_are_found_and_nothing_else(documents, model):
    got = {r.doc_id: r for r in licenses.summary(documents, model).collect()}
    rows = documents.select("doc_id", "text").collect()
    want = {r.doc_id: ",".join(sorted(f for f, p in PLANTED.items() if p in (r.text or "").lower())) for r in rows}
    assert {i: r.families for i, r in got.items()} == want and sum(map(bool, want.values())) > 20
    assert all(r.n_confirmed <= r.n_predicted <= r.n_units for r in got.values())


def test_the_bound_loses_no_finding(documents, model):
    texts = [r.text for r in documents.limit(300).collect()]
    gain, need = model.bound()
    for t in texts[::10] + [x for ts in licenses.TEMPLATES.values() for x in ts]:
        data = np.frombuffer(t.encode(), np.uint8)
        words, first, _, _ = licenses.units(data, np.array([0, len(data)]))
        one, two = licenses.features(words, first)
        last = np.append(first[1:], len(words))
        p = model.probabilities([np.concatenate([one[a:b], two[a:b]]) for a, b in zip(first, last)])
        hope = np.add.reduceat(gain[one] + gain[two], first)
        assert not ((p[:, :-1].max(1) >= licenses.PROBABILITY) & (hope < need)).any()


def test_special_rows(spark, model):
    rows = [(1, None), (2, ""), (3, " \n "), (4, "Released under the MIT License."), (4, "Released under the MIT License."), (None, "x " * 3000 + "\nAll rights reserved.\nend")]
    table = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("doc_id", "text", "1 unit", "'x' family")
    got = sorted(((r.doc_id or 0), r.n_units, r.n_predicted, r.families) for r in licenses.summary(table, model).collect())
    assert [(i, f) for i, _, _, f in got] == [(0, "proprietary"), (1, ""), (2, ""), (3, ""), (4, "mit"), (4, "mit")]
    place = [f for r in licenses.scan(table, model).collect() if r.doc_id is None for f in r.findings][0]
    assert rows[-1][1].encode()[place.first : place.stop] == b"All rights reserved."
    assert licenses.summary(table.limit(0), model).count() == 0
    assert licenses.fit([]).families[-1] == licenses.UNKNOWN


def test_units_end_at_lines_and_sentences():
    text = "One two. three\nfour " + "w " * 100
    data = np.frombuffer(text.encode(), np.uint8)
    words, first, row, place = licenses.units(data, np.array([0, len(data)]))
    parts = [text[a:b] for a, b in place]
    assert parts[:2] == ["One two.", "three"] and max(len(p.split()) for p in parts) == licenses.LONGEST
    assert len(words) == 104 and (row == 0).all()
    assert bytehash.word_hashes(np.frombuffer(b"one", np.uint8), np.array([0, 3]))[1].tolist() == [1]


def test_long_texts_are_scanned_in_pieces(spark, model):
    text = ("plain words without any meaning\n" * 50_000) + "Released under the MIT License.\n" + "x" * 1_200_000 + " All rights reserved."
    row = licenses.scan(spark.createDataFrame([(1, text)], "doc_id long, text string"), model).first()
    assert row.n_units == 50_003 and [text.encode()[f.first : f.stop] for f in row.findings if f.family == "mit"] == [b"Released under the MIT License."]
    data = np.frombuffer(text.encode(), np.uint8)
    cut = list(licenses.pieces(data))
    assert cut[0][0] == 0 and cut[-1][1] == len(data) and all(b == c for (_, b), (c, _) in zip(cut, cut[1:]))
