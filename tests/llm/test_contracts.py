"""The numbered queries over whole small tables, against SQL or plain Python; odd tables for every operator."""

import glob
import hashlib
import os
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

pytest.importorskip("public_tokenizers")
from ragweave.llm import byte_bpe, chat, exact_dup, language_id, licenses, near_dup, packing, queries, repeats, telephony, token_counts, tokens  # noqa: E402
from ragweave.llm.queries import BYTES, PATTERN, WORDS  # noqa: E402

SF = "/root/testdata/sf0.001"


def sha(x):
    return hashlib.sha256(x if isinstance(x, bytes) else x.encode()).hexdigest()


@pytest.fixture(scope="module")
def docs(spark):
    return {r.doc_id: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_against_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    got = queries.QUERIES[name](spark, SF)
    want = con.sql(queries.ORACLES[name])
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    at = [want.columns.index(c) for c in columns]
    assert sorted(repr(tuple(r[c] for c in columns)) for r in got.collect()) == sorted(repr(tuple(r[i] for i in at)) for r in want.fetchall())


def test_op1_token_counts(spark, docs):
    import tiktoken

    first = tiktoken.Encoding("t", pat_str=PATTERN, mergeable_ranks=tokens.read_ranks(BYTES), special_tokens={})
    second = tokens.word_encoder(WORDS).library
    want = Counter()
    for i, r in docs.items():
        crc = zlib.crc32(str(i).encode())
        if crc % 7 == 0:
            continue
        again = crc % 5 == 0
        n = len(second.encode(r.text or "", add_special_tokens=False).ids) if again else len(first.encode_ordinary(r.text or ""))
        key = (r.source, r.lang, "word-49k" if again else "byte-multi-50k")
        want[key + ("docs",)] += 1
        want[key + ("tokens",)] += n
    got = Counter()
    for r in queries.op1_token_counts(spark, SF).collect():
        got[(r.source, r.lang, r.version, "docs")] += r.n_docs
        got[(r.source, r.lang, r.version, "tokens")] += r.n_tokens
    assert got == want


def test_op4_language_id(spark, docs):
    got = queries.op4_language_id(spark, SF).collect()
    assert len(got) == len(docs)
    learned = {r.lang for i, r in docs.items() if zlib.crc32(str(i).encode()) % 4 != 2}
    for r in got:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and r.lang_pred in learned | {"und"} and 0 <= r.score <= 1
    assert np.mean([r.lang_pred == docs[r.doc_id].lang for r in got if r.held_out]) > 0.9


def plain_language_id(rows, texts):
    """Predictions for ``texts`` of a model of (lang, text) rows: sets of n-grams, bits and counts in plain Python."""
    import regex

    full = 2**64 - 1
    letter = regex.compile(r"\p{L}")

    def grams(text):
        data = bytes(b if b >= 128 or chr(b).isalpha() else 32 for b in f" {text.lower()} ".encode())
        for n in language_id.SIZES:
            for i in range(len(data) - n + 1):
                g = n
                for b in data[i : i + n]:
                    g = (g * 257 + b) & full
                g = g * 0x9E3779B97F4A7C15 & full
                yield g ^ (g >> 29)

    taught = sorted({(lang, t) for lang, t in rows if lang is not None and t and letter.search(t)})
    languages = sorted({lang for lang, _ in taught})
    own = {lang: [list(grams(t)) for k, t in taught if k == lang] for lang in languages}
    counts = {lang: Counter(g for t in ts for g in t) for lang, ts in own.items()}
    rates = {lang: {g: n / sum(c.values()) for g, n in c.items() if n > 2} for lang, c in counts.items()}
    top = {}
    for r in rates.values():
        for g, x in r.items():
            top[g] = max(top.get(g, 0), x)
    places = lambda g: [(g >> 18 * i) % language_id.SLOTS for i in range(language_id.HASHES)]
    signed = lambda g: g - 2**64 if g >= 2**63 else g
    filters, false = {}, {}
    for lang, r in rates.items():
        best = sorted((g for g, x in r.items() if x >= 0.5 * top[g]), key=lambda g: (-r[g], signed(g)))[: language_id.GRAMS]
        filters[lang] = {p for g in best for p in places(g)}
        false[lang] = (len(filters[lang]) / language_id.SLOTS) ** language_id.HASHES

    def shares(found):
        hits = Counter(lang for g in found for at in [places(g)] for lang in languages if all(p in filters[lang] for p in at))
        return {lang: min(1, max(0, (hits[lang] / max(len(found), 1) - false[lang]) / (1 - false[lang]))) for lang in languages}

    usual = {lang: max(np.mean([shares(t)[lang] for t in ts]), 1e-3) for lang, ts in own.items()}
    for t in texts:
        if not t or not letter.search(t):
            yield "und", 0.0
            continue
        score = {lang: x / usual[lang] for lang, x in shares(list(grams(t))).items()}
        best = max(languages, key=lambda lang: (score[lang], -languages.index(lang)))
        yield best, score[best] / sum(score.values()) if score[best] > 0 else 0.0


def test_op4_language_id_against_plain_filters(spark, docs):
    taught = [(r.lang, r.text) for i, r in docs.items() if zlib.crc32(str(i).encode()) % 4 != 2]
    got = {r.doc_id: r for r in queries.op4_language_id(spark, SF).collect()}
    for i, (lang, score) in zip(docs, plain_language_id(taught, [r.text for r in docs.values()])):
        assert got[i].lang_pred == lang and abs(got[i].score - score) < 1e-9


def levels(pcm):
    """Number, peak, mean square and zero crossings, one sample at a time."""
    return f"n={len(pcm)} peak={max(map(abs, pcm))} ms={sum(x * x for x in pcm) // len(pcm)} zc={sum((a < 0) != (b < 0) for a, b in zip(pcm, pcm[1:]))}"


def expand_mu(byte):
    b = byte ^ 255
    size = (((b & 15) * 8 + 132) << (b // 16 % 8)) - 132
    return -size if b >= 128 else size


def expand_a(byte):
    b = byte ^ 0x55
    segment, step = b // 16 % 8, b % 16 * 16
    size = step + 8 if segment == 0 else (step + 264) * 2 ** (segment - 1)
    return size if b >= 128 else -size


def test_op5_telephony_audio(spark, docs):
    for r in queries.op5_telephony_audio(spark, SF).collect():
        raw = (docs[r.doc_id].text or "").encode()
        padded = raw + bytes(max(64, -(-len(raw) // 64) * 64) - len(raw))
        media = telephony.write_riff(padded, telephony.MU_LAW, 8000)
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(padded), sha(padded), zlib.crc32(padded[-64:]))
        assert (r.media_bytes, r.media_sha256) == (len(media), sha(media))
        pcm = list(map(expand_mu, padded))
        low = telephony.resample(np.array(pcm, np.int16), 8000, 4000).astype("<i2").tobytes()
        assert r.feature == f"{levels(pcm)} m={len(pcm) // 2} crc={zlib.crc32(low):08x}"
        stored = telephony.write_riff(low, telephony.PCM, 4000)
        assert (r.pcm_bytes, r.pcm_sha256) == (len(stored), sha(stored))
        assert r.a_law == levels(list(map(expand_a, padded)))
        assert r.adpcm == levels([int(x) for at in range(0, len(padded), 64) for x in telephony.decode_adpcm(padded[at : at + 64], 64)])


def test_op7_best_fit_packing(spark, docs):
    library = tokens.word_encoder(WORDS).library
    used, filled = {}, Counter()
    for r in queries.op7_best_fit_packing(spark, SF).collect():
        ids = np.array([*library.encode(docs[r.doc_id].text or "", add_special_tokens=False).ids, 0], "<u4")
        part = ids[r.start : r.start + r.length]
        assert r.start == 2048 * r.piece and r.length == min(2048, len(ids) - r.start) and zlib.crc32(part.tobytes()) == r.ids_crc32
        used.setdefault(r.sequence_id, []).append((r.offset, r.length))
        filled[r.doc_id] += r.length
    for spans in used.values():
        ends = np.cumsum([n for _, n in sorted(spans)])
        assert [o for o, _ in sorted(spans)] == [0, *ends[:-1]] and ends[-1] <= 2048
    assert set(filled) == set(docs) and len(used) <= -(-sum(filled.values()) // 2048) + 1


def test_op8_byte_bpe(spark, docs):
    import tiktoken

    library = tiktoken.Encoding("t", pat_str=PATTERN, mergeable_ranks=tokens.read_ranks(BYTES), special_tokens={})
    for r in queries.op8_byte_bpe(spark, SF).collect():
        text = docs[r.doc_id].text or ""
        ids = np.array(library.encode_ordinary(text), "<u4")
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), sha(ids.tobytes()), sha(text))


def odd(spark):
    """Rows with nulls in every column, repeats, ties, very long texts and columns named like outputs."""
    long = "word and another, " * 20000
    rows = [(1, "a b c d e", "en", "s", 1, "k"), (1, "a b c d e", "en", "s", 1, "k"), (2, None, None, None, None, None), (None, "a b c d e", "en", "s", 2, None), (3, "", "fr", "s", 3, "z"), (4, long, "en", "s", 4, "z"), (5, long, "en", "s", 5, "z"), (6, "x" * 100_000, "en", "s", 6, "z"), (7, "漢字😀 <|im_end|>", "de", "s", 7, "z")]
    names = "doc_id long, text string, lang string, source string, component_id int, kept string, spans string, ids string, lang_pred string, findings string, sequence_id string, text_sha256 string"
    return spark.createDataFrame([r + (None,) * 6 for r in rows], names)


def test_odd_tables(spark):
    table, n = odd(spark), 9
    plain = table.select("doc_id", "text", "lang", "source")
    for whole in (table, table.limit(0)):
        some = whole is table
        model = language_id.train(whole.select("lang", "text"))
        assert language_id.keep_identified(whole, model).columns == whole.columns
        assert near_dup.classes(whole).count() == (n if some else 0)
        assert near_dup.keep_one(whole).columns == whole.columns
        assert exact_dup.drop_copies(whole).columns == whole.columns
        assert exact_dup.annotate_copies(whole).count() == (n if some else 0)
        assert repeats.cut_repeats(whole).columns == whole.columns and repeats.report(whole).count() == (n if some else 0)
        assert licenses.summary(whole, licenses.fit([])).count() == (n if some else 0)
        assert telephony.media_features(telephony.store_texts(whole)).count() == (n if some else 0)
        assert packing.pack(packing.cut_pieces(whole, WORDS)).select("doc_id", "piece").distinct().count() > 0 or not some
        assert byte_bpe.round_trip(whole, BYTES, PATTERN).count() == (n if some else 0)
    with pytest.raises(ValueError):
        byte_bpe.encode(table, BYTES, PATTERN)
    with pytest.raises(ValueError):
        byte_bpe.spans(byte_bpe.encode(plain, BYTES, PATTERN).withColumn("Spans", F.lit(1)), BYTES)
    with pytest.raises(ValueError):
        token_counts.count_tokens(plain.selectExpr("*", "'v' version", "1 N_Tokens"), {"v": ("word", WORDS)})
    with pytest.raises(ValueError):
        language_id.predict(table, model)
    counted = token_counts.count_tokens(plain.selectExpr("*", "'v' version"), {"v": ("word", WORDS)})
    assert counted.count() == n and token_counts.rollup(counted.selectExpr("*", "'+' op")).count() == 4
    turns = plain.selectExpr("doc_id conv_id", "cast(null as long) turn", "lang role", "text", "source spans")
    assert chat.read_back(chat.format_chats(turns, BYTES, PATTERN), BYTES).count() == 8
