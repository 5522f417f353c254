"""signature_minima: signatures are written as a table and joined where they are few, with the languages of repeated ids."""

import hashlib

from sparkalogue.operators import kernels
from sparkalogue.queries import similarity


def test_signature_minima_of_repeated_ids(spark, tmp_path, monkeypatch):
    rows = [(1, "One two", "en"), (1, "trois", "fr"), (2, "vier", "de"), (3, "...", "de"), (4, None, "xx")]
    spark.createDataFrame(rows, "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    written = []
    monkeypatch.setattr(similarity, "stored", lambda df, name, f=similarity.stored: written.append(name) or f(df, name))
    found = {(r["lang"], r["slot"]): r["v"] for r in similarity.signature_minima(spark, str(tmp_path)).collect()}
    low = lambda words, s: min(int(hashlib.md5(f"{s}:{w}".encode()).hexdigest()[:15], 16) for w in words)
    # an id's signature is of all its texts, and counts for all its languages
    words = {"en": ["one", "two", "trois"], "fr": ["one", "two", "trois"], "de": ["vier"]}
    assert found == {(lang, s): low(ws, s) for lang, ws in words.items() for s in range(16)}
    assert written == ["signatures"]


def test_short_words_are_hashed_together(monkeypatch):
    words = [b"a" * n for n in range(1, 70)] + [b"w%d" % i for i in range(1100)]
    want = [[int(hashlib.md5(b"%d:%s" % (s, w)).hexdigest()[:15], 16) for s in range(16)] for w in words]
    one_by_one, md5 = [], hashlib.md5
    monkeypatch.setattr(kernels.hashlib, "md5", lambda x: one_by_one.append(x) or md5(x))
    assert kernels._md5_rows(16)(words).tolist() == want
    # only words that don't fit one block beside the longest seed
    assert len(one_by_one) == 16 * sum(len(w) > 52 for w in words)
    assert kernels._md5_rows(16)([]).shape == (0, 16)


def test_new_words_of_many_texts_are_hashed_in_bounded_parts(monkeypatch):
    texts = [b" ".join(b"t%dw%d" % (t % 7, w) for w in range(5 + 40 * (t % 3))) for t in range(50)] + [None, b""]
    hashed, parts = kernels._md5_rows(4), []
    rows = kernels.WordRows(4, kernels.np.int64, lambda words: parts.append(len(words)) or hashed(words))
    found = rows.minima(texts)
    assert len(parts) == 1 and found[-2:] == [None, None]
    low = lambda text: hashed(kernels.word_set(text)).min(axis=0).tolist()
    assert [f.tolist() for f in found[:-2]] == [low(t) for t in texts[:-2]]
    # the same with bounds that every text exceeds
    monkeypatch.setattr(kernels, "MEET", 3)
    monkeypatch.setattr(kernels, "WAIT", 7)
    small = kernels.WordRows(4, kernels.np.int64, lambda words: parts.append(len(words)) or hashed(words))
    small.most, parts[:] = 10, []
    assert [f.tolist() for f in small.minima(texts)[:-2]] == [f.tolist() for f in found[:-2]] and max(parts) <= 3
