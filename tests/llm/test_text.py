"""Packing, token files and language ID against plain per-document code."""

import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

public_tokenizers = pytest.importorskip("public_tokenizers")

from tokenizers import Tokenizer  # noqa: E402

from aeroframe.llm.langid import Vocabulary, held_out, language_id  # noqa: E402
from aeroframe.llm.packing import first_fit, pack  # noqa: E402
from aeroframe.llm.storage import Scratch  # noqa: E402
from aeroframe.llm.textbytes import shingles, text_bytes  # noqa: E402
from aeroframe.llm.tokencache import WordMemory  # noqa: E402
from aeroframe.llm.tokenfile import read_token_files, write_token_files  # noqa: E402

WORD, BYTE = (public_tokenizers.path(n) for n in ("word_bpe_49k.json", "byte_bpe_50k.json"))
ODD = [None, "", "   ", "\n", "it's", "  a  b\n\n c\t d", "a<|endoftext|>b", "éa, ≠ İstanbul İ", "日本語 テキスト", "…  … a", "'s 't re\"'s don't,", "Zwölf Boxkämpfer jagen Viktor " * 700, "x" * 5000]


def table(spark, rows, schema="doc_id long, text string, lang string, source string"):
    return spark.createDataFrame([(*r, *[None] * (schema.count(",") + 1 - len(r))) for r in rows], schema)


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


@pytest.fixture(scope="module")
def memories():
    return {True: WordMemory(WORD, True), False: WordMemory(BYTE, False)}


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet=" \n\t'.,-aBzéÉßİ×… ́日1", max_size=40), min_size=1, max_size=12))
@pytest.mark.parametrize("drops", [True, False])
def test_remembered_ids_are_the_tokenizers(memories, drops, texts):
    m = memories[drops]
    ids, count = m.encode(pa.array(texts))
    ends = np.cumsum(count)
    for text, a, b in zip(texts, ends - count, ends):
        assert ids[a:b].tolist() == m.tokenizer.encode(text, add_special_tokens=False).ids


def test_forgetting_changes_nothing(memories, monkeypatch):
    m = memories[False]
    texts = [f"word{i} other {i}, again" for i in range(50)]
    before = m.encode(pa.array(texts))
    monkeypatch.setattr("aeroframe.llm.tokencache.REMEMBERED", 3)
    after = m.encode(pa.array(texts))
    assert (before[0] == after[0]).all() and (before[1] == after[1]).all()


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 64), max_size=60))
def test_first_fit_decreasing(sizes):
    sizes = sorted(sizes, reverse=True)
    bins, offsets = first_fit(sizes, 64)
    free, expected = [], []
    for s in sizes:
        k = next((i for i, f in enumerate(free) if f >= s), len(free))
        if k == len(free):
            free.append(64)
        expected.append((k, 64 - free[k]))
        free[k] -= s
    assert list(zip(bins, offsets)) == expected


def test_pack(spark):
    rows = [(i, t) for i, t in enumerate(ODD)] + [(5, ODD[5]), (None, "no id")] + [(100 + i, "some words " * (i % 300)) for i in range(400)]
    docs = table(spark, rows).withColumn("length", F.lit("clash")).withColumn("sequence_id", F.lit(1))
    got = pack(docs, WORD, end_id=1, length=256, group_docs=64).collect()
    t = Tokenizer.from_file(WORD)
    full = {}
    for key, text in rows:
        full.setdefault(key, [*t.encode(text or "", add_special_tokens=False).ids, 1])
    by_doc, by_sequence = {}, {}
    for r in got:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append(r)
    assert set(by_doc) == set(full)
    for key, pieces in by_doc.items():
        times = 2 if key == 5 else 1
        assert sum(p.length for p in pieces) == times * len(full[key]) and all(p.doc_tokens == len(full[key]) for p in pieces)
        for p in pieces:
            assert p.ids_crc32 == crc(full[key][p.start : p.start + p.length])
    padding = 0
    for pieces in by_sequence.values():
        at = 0
        for p in sorted(pieces, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= 256
        padding += 256 - at
    assert padding < 0.05 * sum(map(len, full.values()))
    assert pack(docs.limit(0), WORD).count() == 0


def test_token_files(spark):
    rows = [(i * 7 % 13, t) for i, t in enumerate(ODD)] + [(3, "again"), (None, "no id")]
    docs = table(spark, rows).withColumn("start", F.lit(0))
    uri = Scratch(spark, "tokens").uri
    parts = write_token_files(docs.repartition(3), uri, BYTE, end_id=2)
    got = read_token_files(spark, uri).orderBy("start").collect()
    t = Tokenizer.from_file(BYTE)
    at = 0
    expected = {}
    for key, text in rows:
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 2]
        expected.setdefault(key, []).append((len(ids), crc(ids)))
    assert [r.doc_id for r in got] == sorted((r[0] for r in rows), key=lambda k: (k is not None, k or 0))
    for r in got:
        assert r.start == at
        expected[r.doc_id].remove((r.n_tokens, r.ids_crc32))
        at += r.n_tokens
    assert sum(p["tokens"] for p in parts) == at
    assert write_token_files(docs.limit(0), uri + "-none", BYTE, end_id=2) == [] and read_token_files(spark, uri + "-none").count() == 0
    with pytest.raises(Exception, match="doesn't fit"):
        write_token_files(docs, uri + "-wide", BYTE, end_id=70_000)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.text(alphabet=" \nabAB é", max_size=30), max_size=8), st.integers(1, 5))
def test_shingles(texts, k):
    offsets, data = text_bytes(pa.array(texts, pa.string()))
    owner, hashes = shingles(data, offsets, k)
    seen = {}
    for i, text in enumerate(texts):
        low = "".join(c.lower() if c in "AB" else c for c in text)
        words = [w for w in low.replace("\n", " ").split(" ") if w]
        whole = {tuple(words[j : j + k]) for j in range(len(words) - k + 1)} if len(words) >= k else {tuple(words)} if words else set()
        mine = set(hashes[owner == i].tolist())
        assert len(mine) == len(whole) == (owner == i).sum()
        for j, other in seen.items():
            assert len(mine & set(hashes[owner == j].tolist())) == len(whole & other)
        seen[i] = whole


def test_language(spark):
    words = {"en": "the of and in to was that with from this".split(), "de": "der die und das mit von nicht über für größe".split(), "fr": "le la les des une est avec pour être où".split()}
    rng = np.random.default_rng(0)
    rows = []
    for i in range(400):
        lang = ("en", "en", "de", "fr")[i % 4]
        rows.append((i, " ".join(rng.choice(words[lang], 5 + i % 60)), lang if i % 11 else None, "s"))
    rows += [(1000, None, "en", "s"), (1001, "12 34 !!", "de", "s"), (1002, "", None, "s"), (1003, "von der größe " * 30_000, None, "s"), (1004, "le", "fr", "s"), (7, rows[7][1], "en", "s")]
    docs = table(spark, rows).withColumn("lang_pred", F.lit("xx")).withColumn("score", F.lit("clash"))
    got = {r.doc_id: r for r in language_id(docs).collect()}
    truth = {i: ("en", "en", "de", "fr")[i % 4] for i in range(400)}
    assert len(got) == 405 and all(got[i].held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i in got)
    held = [i for i in truth if got[i].held_out]
    assert np.mean([got[i].lang_pred == truth[i] for i in held]) >= 0.97
    assert all(0 <= r.score <= 1 for r in got.values())
    assert [got[i].lang_pred for i in (1000, 1001, 1002, 1003)] == ["und", "und", "und", "de"]
    # What the rows that are held out say about themselves doesn't matter.
    other = docs.withColumn("lang", F.when(held_out(F.col("doc_id")), F.lit("zz")).otherwise(F.col("lang"))).withColumn("source", F.lit("t"))
    assert {r.doc_id: (r.lang_pred, r.score) for r in language_id(other).collect()} == {k: (r.lang_pred, r.score) for k, r in got.items()}
    none = language_id(docs.withColumn("lang", F.lit(None).cast("string"))).collect()
    assert {r.lang_pred for r in none} == {"und"} and len(none) == 406
    assert language_id(docs.limit(0)).count() == 0


def test_presence_kernel():
    texts = ["abcab", "bca", "", "xyzzy Abc"]
    grams = [{t.lower()[i : i + n] for n in range(1, 5) for i in range(len(t) - n + 1)} for t in texts]
    offsets, data = text_bytes(pa.array(texts))
    from aeroframe.llm.langid import _codes
    from aeroframe.llm.textbytes import LOWER

    codes = np.concatenate([c for _, c in _codes(LOWER[data], offsets)])
    there = Vocabulary(codes).presence(data, offsets)
    product = there @ there.T
    for i, a in enumerate(grams):
        for j, b in enumerate(grams):
            assert product[i, j] == len(a & b)


def test_every_ngram_has_a_number(monkeypatch):
    import aeroframe.llm.langid as langid

    monkeypatch.setattr(langid, "_SLOT_BITS", (8, 6))
    rng = np.random.default_rng(0)
    codes = np.unique(rng.integers(1, 1 << 42, 3000, dtype=np.uint64))
    v = Vocabulary(codes)
    assert len(v.levels) > 2 and v.find(codes).tolist() == list(range(1, len(codes) + 1))
    assert not v.find(np.setdiff1d(rng.integers(1, 1 << 42, 3000, dtype=np.uint64), codes)).any()


def test_language_model_is_kernel_ridge_regression(spark):
    """With every learned text a landmark the Nystroem map is exact: outputs are those of a direct solve."""
    from aeroframe.llm.langid import RIDGE, fit

    rng = np.random.default_rng(2)
    words = {"en": "the of and in to was".split(), "de": "der die und das mit von".split(), "fr": "le la les des une est".split()}
    rows = [(i % 7, " ".join(rng.choice(words[lang], 6)) + f" {i}", lang, None) for i in range(60) for lang in [list(words)[i % 3]]]
    model = fit(table(spark, rows + rows[:9] + [(None, *rows[4][1:3], None)]))  # agreeing rows count once, those without an id are rows of their own
    texts = [r[1] for r in rows] + [rows[4][1]]
    labels = [r[2] for r in rows] + [rows[4][2]]
    grams = lambda t: {t.lower().encode()[i : i + n] for n in range(1, 5) for i in range(len(t.encode()) - n + 1)}
    sets = [grams(t) for t in texts]
    every = set().union(*sets)
    kernel = lambda a, b: len(a & b) / np.sqrt(max(1, len(a & every)) * len(b))
    gram = np.array([[kernel(a, b) for b in sets] for a in sets])
    target = np.array([[1.0 if x == lang else -1.0 for lang in sorted(words)] for x in labels])
    weights = np.linalg.solve(gram + RIDGE * len(sets) * np.eye(len(sets)), target)
    asked = [*texts[:5], "the der le", "xyz qqq", "une maison"]
    direct = np.array([[kernel(grams(t), b) for b in sets] for t in asked]) @ weights
    assert model.languages == sorted(words) and np.allclose(model.scores(pa.array(asked)), direct, atol=2e-3)


def test_language_of_repeated_ids(spark):
    """Rows that share an id, or have none, are drawn by their texts; one crowd of equal rows counts once."""
    rng = np.random.default_rng(1)
    words = {"en": "the of and in to was that with".split(), "de": "der die und das mit von nicht".split()}
    rows = [(None if i % 2 else 5, " ".join(rng.choice(words["en" if i % 3 else "de"], 12)), "en" if i % 3 else "de", None) for i in range(300)]
    from aeroframe.llm.langid import fit

    model = fit(table(spark, rows + [(None, "the of", "en", None)] * 3000))
    scores = model.scores(pa.array([r[1] for r in rows]))
    assert np.mean([model.languages[k] == r[2] for k, r in zip(scores.argmax(axis=1), rows)]) > 0.97


def colliding_words(length=4096):
    """Two words that any polynomial hash modulo 2**64 takes for one (Thue-Morse sequence and its complement)."""
    bits = [bin(i).count("1") % 2 for i in range(length)]
    return "".join("ab"[b] for b in bits), "".join("ba"[b] for b in bits)


@pytest.mark.parametrize("drops", [True, False])
def test_words_that_collide_in_polynomials(memories, drops):
    m = memories[drops]
    for length in (512, 1024, 4096):
        for text in colliding_words(length):
            assert m.encode(pa.array([text]))[0].tolist() == m.tokenizer.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("drops", [True, False])
def test_pieces_of_one_first_hash_stay_apart(drops, monkeypatch):
    import aeroframe.llm.tokencache as cache

    whole = cache.span_hashes
    monkeypatch.setattr(cache, "span_hashes", lambda *a: ((whole(*a)[0] & np.uint64(3)) + np.uint64(1), whole(*a)[1]))
    m = WordMemory(WORD if drops else BYTE, drops)
    for texts in (["some words here", "other words there"], ["words, again and other signs", "some more"], ["here and there again"]):
        ids, count = m.encode(pa.array(texts))
        ends = np.cumsum(count)
        for text, a, b in zip(texts, ends - count, ends):
            assert ids[a:b].tolist() == m.tokenizer.encode(text, add_special_tokens=False).ids


def test_span_hashes_tell_spans_apart():
    from aeroframe.llm.textbytes import span_hashes

    rng = np.random.default_rng(1)
    spans = [b"", *{rng.integers(97, 99, n).astype(np.uint8).tobytes() for n in range(1, 150) for _ in range(4)}, *(w.encode() for n in (256, 4096) for w in colliding_words(n)), b"a\0", b"a"]
    data, ends = np.frombuffer(b"".join(spans), np.uint8), np.cumsum([len(s) for s in spans])
    starts = ends - [len(s) for s in spans]
    for hashes in span_hashes(data, starts, ends):
        assert len(set(hashes.tolist())) == len(set(spans))
    alone = [span_hashes(np.frombuffer(s, np.uint8), np.array([0]), np.array([len(s)]))[0][0] for s in spans]
    assert alone == span_hashes(data, starts, ends)[0].tolist()


def test_colliding_words_share_no_shingle():
    a, b = colliding_words()
    offsets, data = text_bytes(pa.array([a, b, f"x {a} y z", f"x {b} y z"]))
    assert len(set(shingles(data, offsets, 4)[1].tolist())) == 4


def test_token_files_deal_out_a_hot_id(spark, monkeypatch):
    """Rows of one id, or of none, go to several parts, equal ones too; reruns agree."""
    import aeroframe.llm.tokenfile as tokenfile

    monkeypatch.setattr(tokenfile, "PART_BYTES", 2000)
    docs = table(spark, [(None, "same words here")] * 800 + [(5, f"words {i}") for i in range(800)] + [(6, None)])
    starts = []
    for _ in range(2):
        uri = Scratch(spark, "tokens").uri
        parts = write_token_files(docs, uri, BYTE, end_id=2)
        assert len(parts) > 2 and max(p["documents"] for p in parts) < 800
        got = read_token_files(spark, uri).orderBy("start").collect()
        assert [r.doc_id for r in got] == [None] * 800 + [5] * 800 + [6]
        starts.append([(r.start, r.ids_crc32) for r in got])
    assert starts[0] == starts[1]


@pytest.mark.parametrize("long_langs", [("en", "de"), ("de",)])
def test_languages_of_long_texts_only(spark, long_langs):
    """Long labelled texts are landmarks where a language has no short ones, so none is lost."""
    from aeroframe.llm.langid import LONGEST

    words = {"en": ["the", "with", "house", "thing", "they", "while"], "de": ["der", "und", "nicht", "schön", "über", "zwischen"]}
    rng = random.Random(7)
    rows = []
    for i in range(80):
        lang = ["en", "de"][i % 2]
        size = 4000 if lang in long_langs else 30
        rows.append((i, " ".join(rng.choices(words[lang], k=size)), lang, None))
    assert all((len(r[1].encode()) > LONGEST) == (r[2] in long_langs) for r in rows)
    got = {r.doc_id: r for r in language_id(table(spark, rows)).collect()}
    assert all(got[i].lang_pred == lang for i, _, lang, _ in rows)


def test_language_scores_need_little_memory_for_a_batch():
    import tracemalloc

    import numpy as np
    import pyarrow as pa

    from aeroframe.llm import langid

    texts = pa.array([f"alpha beta {k} gamma delta " * 40 for k in range(4000)])
    offsets, data = langid.text_bytes(texts)
    codes = np.concatenate([c for _, c in langid._codes(data[: offsets[5]], offsets[:6])])
    vocabulary = langid.Vocabulary(codes)
    model = langid.Model(["a", "b"], vocabulary, np.ones((len(vocabulary.codes), 2), np.float32))
    tracemalloc.start()
    try:
        model.scores(texts)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert peak < 25 << 20


def test_workers_hold_little_memory_between_tasks(spark):
    def held(batches):
        import re

        for batch in batches:
            with open("/proc/self/smaps_rollup") as f:
                own = sum(map(int, re.findall(r"\nPss_(?:Anon|Shmem):\s+(\d+)", f.read())))
            yield pa.RecordBatch.from_arrays([pa.array([own] * batch.num_rows)], ["kb"])

    rng = random.Random(5)
    texts = [" ".join("".join(rng.choices("abcdefghij", k=6)) for _ in range(400)) for _ in range(3000)]
    docs = table(spark, [(i, x, "en" if i % 2 else "de") for i, x in enumerate(texts)]).repartition(4).cache()
    pack(docs, WORD).write.format("noop").mode("overwrite").save()
    language_id(docs).write.format("noop").mode("overwrite").save()
    docs.unpersist()
    assert spark.range(0, 64, 1, 16).mapInArrow(held, "kb long").agg(F.max("kb")).first()[0] < 96 << 10
