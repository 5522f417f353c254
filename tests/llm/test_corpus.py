"""Corpus operators against brute force, round trips and held-out rows."""

import hashlib
import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkalogue.llm import context_tree, decontaminate, html_text, labelled_pages, line_dedup, ngram_join, packing, quality_rules, suffix_dedup, token_files, tokens, toxicity
from sparkalogue.llm.common import WORD, connected_components

PATH = tokens.default_path()


def test_encoder_equals_library():
    rng = random.Random(1)
    enc = tokens.Encoder(PATH)
    odd = ["", " ", "a  b", " a", "a ", "\n\n", "it's 's", "<|endoftext|> x", "don't  stop ", "x\x1cy"]
    odd += ["".join(rng.choice(["a", "B", " ", "\n", "\t", "'s", "1", "é", " ", ".", "\x85", "中", ","]) for _ in range(25)) for _ in range(500)]
    for t in odd:
        assert enc.encode([t])[0] == np.array(enc.tokenizer.encode(t, add_special_tokens=False).ids, dtype="<u4").tobytes()


def test_packing(make_docs, texts):
    lib = tokens.Encoder(PATH).tokenizer
    got = packing.pack(make_docs(texts), PATH, capacity=256, end_id=2, group_rows=15).collect()
    by_doc, by_seq = {}, {}
    for r in got:
        by_doc.setdefault(r["doc_id"], []).append(r)
        by_seq.setdefault(r["sequence_id"], []).append(r)
    assert len(by_doc) == len(texts) + 3
    for d, rows in by_doc.items():
        rows.sort(key=lambda r: r["piece"])
        ids = [*lib.encode(texts[d] if d < 9000 else {9003: " \n\t "}.get(d, ""), add_special_tokens=False).ids, 2]
        at = 0
        for k, r in enumerate(rows):
            assert r["piece"] == k and r["start"] == at and (r["length"] == 256 or k == 0)
            assert r["ids_crc32"] == zlib.crc32(np.array(ids[at : at + r["length"]], "<u4").tobytes())
            at += r["length"]
        assert at == len(ids)
    for rows in by_seq.values():
        rows.sort(key=lambda r: r["offset"])
        assert [r["offset"] for r in rows] == np.cumsum([0, *[r["length"] for r in rows]])[:-1].tolist()
        assert sum(r["length"] for r in rows) <= 256
    assert len(by_seq) <= math.ceil(sum(r["length"] for r in got) / 256) * 1.2 + 1


def test_packing_of_nothing(make_docs):
    assert packing.pack(make_docs([], odd=False), PATH).count() == 0


def test_sum_of_squares_rule():
    rng = np.random.default_rng(0)
    sizes = rng.integers(1, 1024, 3000)
    bins, offsets, gaps = packing.sum_of_squares(sizes, 1024)
    assert (np.bincount(bins, sizes) == 1024 - gaps).all() and len(gaps) <= sizes.sum() / 1024 * 1.03 + 1


def brute_repeats(docs, least):
    seen = Counter(t[p : p + least] for t in docs for p in range(len(t) - least + 1))
    out = []
    for t in docs:
        gone = bytearray(len(t))
        for p in range(len(t) - least + 1):
            if seen[t[p : p + least]] > 1:
                gone[p : p + least] = b"\1" * least
        runs = sum(1 for i in range(len(t)) if gone[i] and not (i and gone[i - 1]))
        out.append((sum(gone), runs, hashlib.sha256(bytes(b for b, g in zip(t, gone, strict=True) if not g)).hexdigest()))
    return out


@pytest.mark.parametrize(("least", "split"), [(400, 1000), (60, 1)])
def test_suffix_dedup(make_docs, texts, monkeypatch, least, split):
    monkeypatch.setattr(suffix_dedup, "SPLIT", split)
    docs = [t.encode() for t in texts]
    want = dict(enumerate(brute_repeats(docs, least)))
    for r in suffix_dedup.remove_repeats(make_docs(texts), least).collect():
        if r["doc_id"] < 9000:
            got = (sum(s["end"] - s["start"] for s in r["spans"]), len(r["spans"]), hashlib.sha256(bytes(r["kept"])).hexdigest())
            assert got == want[r["doc_id"]] and r["n_bytes"] == len(docs[r["doc_id"]])
        else:
            assert r["spans"] == []


def test_suffix_dedup_bounds_the_parts_of_a_hot_passage(make_docs, monkeypatch):
    rng = random.Random(12)
    prose = lambda n: "".join(rng.choice("abcdefghij ") for _ in range(n))
    long, short = prose(450), prose(396)
    texts = [prose(rng.randint(420, 500)) + (long if i % 3 else short) + prose(rng.randint(420, 500)) for i in range(90)]
    texts += [prose(500) + short + texts[0][len(texts[0]) - 300 :], texts[3] + "x", texts[3]]
    plain = suffix_dedup.covered

    def bounded(parts, least):
        if len(parts) > 30:
            raise ValueError(f"{len(parts)} parts in one group")
        return plain(parts, least)

    monkeypatch.setattr(suffix_dedup, "covered", bounded)
    monkeypatch.setattr(suffix_dedup, "SPLIT", 10)
    monkeypatch.setattr(suffix_dedup, "BUCKET_BYTES", 400)
    want = brute_repeats([t.encode() for t in texts], 400)
    for r in suffix_dedup.remove_repeats(make_docs(texts, odd=False), 400).collect():
        got = (sum(s["end"] - s["start"] for s in r["spans"]), len(r["spans"]), hashlib.sha256(bytes(r["kept"])).hexdigest())
        assert got == want[r["doc_id"]]


def test_maximal_repeats_list_all_occurrences():
    data = b"xabcdeyabcdezabcdq"
    arr = np.frombuffer(data, np.uint8)
    order, lcp = suffix_dedup.suffix_array(arr, len(data) - np.arange(len(data)), 1)
    left = np.where(order == 0, -1, arr[np.maximum(order - 1, 0)].astype(np.int64))
    found = {(n, tuple(sorted(order[a : b + 1].tolist()))) for n, a, b in suffix_dedup.maximal_repeats(lcp, left, 3)}
    assert found == {(5, (1, 7)), (4, (1, 7, 13))}


def test_quality_measures(make_docs, texts):
    more = [*texts, "one two three four five six seven eight " * 3, "a b c d e f g h i a b c d e f g h", "x # y\nx # y\n\nz"]
    got = {r["doc_id"]: r for r in quality_rules.measure(make_docs(more)).collect()}
    for i, t in enumerate(more):
        w = WORD.findall(t)
        grams = Counter(tuple(w[k : k + 8]) for k in range(len(w) - 7))
        inside = {j for k in range(len(w) - 7) if grams[tuple(w[k : k + 8])] > 1 for j in range(k, k + 8)}
        lines = [x for x in t.split("\n") if WORD.search(x)]
        r = got[i]
        assert (r["n_words"], r["word_chars"], r["n_repeat_words"], r["n_dup_lines"]) == (len(w), sum(map(len, w)), len(inside), len(lines) - len(set(lines)))
        assert r["n_symbols"] == sum(t.count(c) for c in "#*$%&|<>")
        assert r["base_failed"] == (len(w) < 20 or 100 * len(inside) > 30 * len(w))
    assert got[9001]["base_failed"] and got[9001]["n_words"] == 0


def test_binomial_tail_and_cutoffs(spark):
    cases = [(50, 0), (1000, 3), (1000, 9), (20000, 100), (5, 5)]
    df = spark.createDataFrame(cases, "n long, k long").withColumn("t", quality_rules.binomial_tail(F.col("n"), F.col("k"), 0.01))
    for r in df.collect():
        n, k = r["n"], r["k"]
        want = sum(math.exp(math.lgamma(n + 1) - math.lgamma(j + 1) - math.lgamma(n - j + 1) + j * math.log(0.01) + (n - j) * math.log(0.99)) for j in range(k + 1)) if k < n * 0.01 else 1.0
        assert abs(r["t"] - want) <= 1e-6 * want
    words = [f"w{i}" for i in range(60)]
    good = [(i, " ".join(random.Random(i).sample(words, 30)), "en") for i in range(1500)]
    bad = [(10_000 + i, " ".join(w + "%%%" for w in random.Random(i).sample(words, 30)), "en") for i in range(60)]
    docs = spark.createDataFrame([*good, *bad, (20_000, None, None)], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(d, int(d < 10_000)) for d, _, _ in good + bad], "doc_id long, quality int")
    kept = {r["doc_id"]: r["kept"] for r in quality_rules.judge(docs, labels).collect()}
    assert all(kept[d] for d, _, _ in good) and not any(kept[d] for d, _, _ in bad) and not kept[20_000]


def test_html():
    w = html_text.learn(labelled_pages.PAGES)
    got = html_text.main_text(labelled_pages.PAGES[0], w).split("\n")
    assert got[0] == "Along the river to the old mill" and got[-1] == "No walk in the county is better in autumn."
    assert not any("bridge was closed" in x or "cookies" in x or "boots" in x for x in got)
    assert html_text.main_text(labelled_pages.PAGES[2], w).split("\n")[-1] == "The crust should ring when you knock."
    assert html_text.main_text(None, w) == "" and html_text.main_text("<nav>a b</nav>", w) == ""
    assert html_text.main_text("<article><p>x &lt; y &amp; z&nbsp; <b>w", w) == "x < y & z w"
    assert html_text.best_region([-1, 2, -1, 3, -5, 4]) == (1, 4) and html_text.best_region([-1.0]) == (0, 0)


def brute_lines(docs):
    sets, out = [], {}
    for i, t in docs:
        keep, gone = [], 0
        for x in t.split("\n"):
            k = set(WORD.findall(x))
            if k and any(1000 * len(k & s) >= 800 * len(k | s) for s in sets):
                gone += 1
            else:
                keep.append(x)
            if k:
                sets.append(k)
        out[i] = (gone, "\n".join(keep))
    return out


def test_line_dedup(make_docs, texts):
    lines = [x for t in texts[:12] for x in t.split("\n")]
    rng = random.Random(9)
    more = texts[:20] + ["\n".join(rng.choice(lines).replace("ka", rng.choice(["ka", "ka", "KA"])) for _ in range(5)) for _ in range(15)]
    want = brute_lines([*enumerate(more)])
    got = line_dedup.dedup(make_docs(more)).collect()
    assert "extra" in got[0].asDict()
    for r in got:
        if r["doc_id"] < 9000:
            assert (r["n_removed"], r["text"]) == want[r["doc_id"]]
        else:
            assert r["n_removed"] == 0 and r["text"] == {9001: None, 9002: "", 9003: " \n\t "}[r["doc_id"]]


def test_token_files(spark, make_docs, texts, monkeypatch):
    monkeypatch.setattr(token_files, "BLOCK_DOCS", 4)
    docs, path = make_docs(texts), token_files.new_path(spark)
    token_files.write(docs, path, PATH, end_id=0)
    got = sorted(token_files.read(spark, path).collect())
    lib, at = tokens.Encoder(PATH).tokenizer, 0
    for r in got:
        d = r["doc_id"]
        ids = [*lib.encode(texts[d] if d < 9000 else {9003: " \n\t "}.get(d, ""), add_special_tokens=False).ids, 0]
        assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)
    assert len(got) == len(texts) + 3


def test_context_tree(make_docs, texts):
    got = {r["doc_id"]: r for r in context_tree.score(make_docs(texts)).collect()}
    held = {d: zlib.crc32(str(d).encode()) % 7 == 2 for d in got}
    text = {**dict(enumerate(texts)), 9001: "", 9002: "", 9003: " \n\t "}
    tokens_of = lambda d: [*text[d].encode().lower().split(), None]
    counts = Counter(w for d in text if not held[d] for w in tokens_of(d))
    n, v = sum(counts.values()), len(counts)
    for d, r in got.items():
        t = tokens_of(d)
        assert r["held_out"] == held[d] and r["n_tokens"] == len(t) and r["n_known"] == sum(counts[w] > 0 for w in t) and r["train_tokens"] == n
        assert abs(r["base_score"] - sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in t)) < 1e-6
        assert r["score"] < 0
    assert got[9001]["score"] == got[9002]["score"]


def plain_ctw(train, depth, context, symbol):
    """Probability of a symbol by context-tree weighting, written directly over nested counts."""
    codes, p = [], 1.0
    for t in train:
        s = bytes([context_tree.START]) * context_tree.DEPTH + t + bytes([context_tree.END])
        codes += [(s[i - context_tree.DEPTH : i], s[i]) for i in range(context_tree.DEPTH, len(s))]

    def kt(a, b):
        return math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.lgamma(a + b + 1) - math.log(math.pi)

    for j in range(8):
        prefix = (1 << j) | symbol >> (8 - j)
        rows = [(c, s >> (7 - j) & 1) for c, s in codes if (1 << j) | s >> (8 - j) == prefix]

        def node(suffix):
            own = [b for c, b in rows if c.endswith(suffix)]
            e = kt(own.count(0), own.count(1))
            if len(suffix) == depth:
                return e, e, own
            kids = {c[-len(suffix) - 1 : len(c) - len(suffix)] for c, _ in rows if c.endswith(suffix)}
            below = sum(node(k + suffix)[0] for k in kids)
            return np.logaddexp(e, below) - math.log(2), (e, below), own

        q = 0.5
        seen = False
        for d in range(depth, -1, -1):
            suffix = context[len(context) - d :]
            _, parts, own = node(suffix)
            if not own:
                continue
            mine = (own.count(1) + 0.5) / (len(own) + 1)
            share = 1.0 if d == depth or not seen else 1 / (1 + math.exp(parts[1] - parts[0]))
            q, seen = share * mine + (1 - share) * q, True
        p *= q if symbol >> (7 - j) & 1 else 1 - q
    return math.log10(p)


def test_context_tree_equals_plain_version():
    train = [b"abracadabra", b"abrupt cab", b""]
    codes, _ = context_tree.grams(train)
    kinds, counts = np.unique(codes, return_counts=True)
    deep = context_tree.subtree(kinds, counts)
    top = context_tree.upper_levels(deep[deep["log_p"].notna()])
    import pandas as pd

    every = pd.concat([top, deep]).sort_values("key")
    model = context_tree.Model(every["key"].to_numpy(np.int64), every["p1"].to_numpy(), every["share"].to_numpy())
    test, _ = context_tree.grams([b"abra zcab"])
    got = model.log10(test)
    s = bytes([context_tree.START]) * context_tree.DEPTH + b"abra zcab" + bytes([context_tree.END])
    want = [plain_ctw(train, context_tree.DEPTH, s[i - context_tree.DEPTH : i], s[i]) for i in range(context_tree.DEPTH, len(s))]
    assert np.allclose(got, want, atol=1e-6)
    # the probabilities of all symbols after a context sum to one
    total = np.sum(10 ** model.log10((test[2] & ~0xFF) | np.arange(256)))
    assert abs(total - 1) < 1e-9


@pytest.mark.parametrize("bound", [0, 50, 10**9])
def test_context_tree_uses_all_nodes(make_docs, texts, monkeypatch, bound):
    for name in ("MODEL_NODES", "COMMON_STRINGS"):
        monkeypatch.setattr(context_tree, name, bound, raising=False)
    text = {**dict(enumerate(texts[:30])), 9001: "", 9002: "", 9003: " \n\t "}
    codes, _ = context_tree.grams([context_tree.prepare(t) for d, t in text.items() if zlib.crc32(str(d).encode()) % 7 != 2])
    deep = context_tree.subtree(*np.unique(codes, return_counts=True))
    import pandas as pd

    every = pd.concat([context_tree.upper_levels(deep[deep["log_p"].notna()]), deep]).sort_values("key")
    model = context_tree.Model(every["key"].to_numpy(np.int64), every["p1"].to_numpy(), every["share"].to_numpy())
    got = {r["doc_id"]: r["score"] for r in context_tree.score(make_docs(texts[:30])).collect()}
    assert got.keys() == text.keys()
    for d, t in text.items():
        want = model.log10(context_tree.grams([context_tree.prepare(t)])[0]).sum()
        assert abs(got[d] - want) < 1e-6 * (1 + abs(want))


def test_toxicity(spark):
    rng = random.Random(2)
    vocab = ["".join(rng.choice(["ka", "lo", "mi", "ten", "sur", "ox", "er"]) for _ in range(rng.randint(1, 4))) for _ in range(500)]

    def text(toxic):
        w = [rng.choice(vocab) for _ in range(rng.randint(20, 120))]
        for _ in range(4 * toxic):
            w[rng.randrange(len(w))] = rng.choice(["horrible", "zwitchig", "blasfemer"])
        return " ".join(w)

    rows = [(i, text(i % 4 == 0), i % 4 == 0) for i in range(800)]
    docs = spark.createDataFrame([(i, t, 7) for i, t, _ in rows] + [(9001, None, 7), (9002, "", 7)], "doc_id long, text string, score int")
    labels = spark.createDataFrame([(i, int(y)) for i, _, y in rows], "doc_id long, toxic int")
    got = {r["doc_id"]: r for r in toxicity.score(docs, labels).collect()}
    held = [(i, y) for i, _, y in rows if zlib.crc32(str(i).encode()) % 5 == 0]
    assert sum((got[i]["predicted"] == 1) == y for i, y in held) >= 0.95 * len(held)
    assert 0 <= got[9001]["score"] == got[9002]["score"] < 0.5
    none = toxicity.score(docs, labels.where("toxic = 1"))
    assert {r["score"] for r in none.collect()} == {0.0}


def test_decontamination(spark, make_docs, texts):
    rng = random.Random(4)
    items = [" ".join(rng.choice(texts[38].split()) for _ in range(n)) for n in (3, 9, 14, 27, 45, 59)]
    held = [texts[i] + " " + items[i].upper() + " tail words here" for i in range(6)]
    edited = items[5].split()
    edited[30] = "changed"
    held += [texts[7] + " " + " ".join(edited)]
    bench = spark.createDataFrame([*[(i, t) for i, t in enumerate(items)], (50, None), (51, ""), (52, items[2])], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]): r["similarity"] for r in decontaminate.matches(make_docs([*held, *texts[8:20]]), bench).collect()}
    for i in range(6):
        assert got[(i, i)] == 1.0
    assert (2, 52) in got and all(d < 7 for d, _ in got)
    want = set()
    for d, t in enumerate([*held, *texts[8:20]]):
        w = decontaminate.words_of(t)
        for k, item in [*enumerate(items), (52, items[2])]:
            x = decontaminate.words_of(item)
            if any(w[a : a + len(x)] == x for a in range(len(w))):
                want.add((d, k))
    assert want <= set(got)


def brute_matches(docs, items, width=5, threshold=0.8):
    """(document, item) and the best similarity over all stretches as long as the item, written directly."""
    grams = lambda w: {tuple(w[a : a + min(width, len(w))]) for a in range(max(1, len(w) - width + 1))} if w else set()
    held = Counter(s for x in items.values() for s in grams(decontaminate.words_of(x)))
    weight = lambda ss: sum(1 / (held.get(s) or 1) for s in ss)
    out = {}
    for d, t in docs.items():
        w = decontaminate.words_of(t)
        for k, x in items.items():
            x = decontaminate.words_of(x)
            own = grams(x)
            best = max((weight(own & g) / weight(own | g) for g in (grams(w[a : a + len(x)]) for a in range(len(w))) if own & g), default=0)
            if best >= threshold:
                out[d, k] = best
    return out


def test_decontamination_finds_all_near_copies(spark, make_docs):
    rng = random.Random(6)
    words = lambda n: [f"w{rng.randrange(900)}" for _ in range(n)]
    items = [words(n) for n in (2, 5, 8, 15, 24, 33, 47, 55, 59, 120)]
    items += [[*items[8][:30], *words(20)], [*items[8][:30], *words(12)]]
    docs = []
    for x in items:
        for place in {0, 1, len(x) // 2, len(x) - 2, len(x) - 1}:
            for edit in ("change", "drop", "add"):
                y = [*x[:place], *([] if edit == "drop" else ["new"]), *x[place + (edit != "add") :]]
                docs.append(" ".join([*words(rng.randrange(30)), *y, *words(rng.randrange(30))]))
    docs += [" ".join([*words(9), *items[9][:100], "new", *items[9][101:], *words(4)]), " ".join(items[9][:110]), " ".join(items[8][6:])]
    want = brute_matches(dict(enumerate(docs)), {k: " ".join(x) for k, x in enumerate(items)})
    bench = spark.createDataFrame([(k, " ".join(x)) for k, x in enumerate(items)], "item_id long, text string")
    rows = decontaminate.matches(make_docs(docs), bench).collect()
    got = {(r["doc_id"], r["item_id"]): r["similarity"] for r in rows}
    assert len(rows) == len(got) and got.keys() == want.keys() and len(want) > 40
    assert all(abs(got[p] - want[p]) < 1e-9 for p in want)


@pytest.mark.parametrize("bound", ["ITEM_BLOCK", "ITEM_BYTES"])
def test_decontamination_does_not_depend_on_blocks(spark, make_docs, monkeypatch, bound):
    rng = random.Random(8)
    words = lambda n: [f"w{rng.randrange(900)}" for _ in range(n)]
    stock = words(25)
    items = {k: " ".join([*stock, *words(20)]) for k in range(12)}
    docs = [" ".join([*words(6), *items[k].split()[: 45 - n], *words(9)]) for k in range(12) for n in (0, 2, 4)]
    docs += [" ".join([*items[k].split()[n:], *words(9)]) for k in range(12) for n in (10, 25)]
    want = brute_matches(dict(enumerate(docs)), items)
    monkeypatch.setattr(decontaminate, bound, 3 if bound == "ITEM_BLOCK" else 700)
    bench = spark.createDataFrame(list(items.items()), "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]): r["similarity"] for r in decontaminate.matches(make_docs(docs), bench).collect()}
    assert got.keys() == want.keys() and all(abs(got[p] - want[p]) < 1e-9 for p in want)


def test_ngram_join(make_docs, texts, monkeypatch):
    monkeypatch.setattr(ngram_join, "BLOCK_DOCS", 3)
    base = texts[38].split()[:200]
    near = [" ".join([*base[:i], "x", *base[i + 1 :]]) for i in range(10, 190, 18)]
    more = [*texts[:38], *near]
    sets = [{tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} for w in map(WORD.findall, more)]
    links = [[j for j in range(len(more)) if j != i and 1000 * len(sets[i] & sets[j]) >= 800 * len(sets[i] | sets[j])] for i in range(len(more))]
    root = list(range(len(more)))
    for _ in more:
        root = [min([root[i], *[root[j] for j in links[i]]]) for i in range(len(more))]
    got = {r["doc_id"]: r for r in ngram_join.join(make_docs(more)).collect()}
    assert len(got) == len(more) + 3 and got[9001]["n_links"] == 0 and got[9001]["class_id"] == 9001
    for i in range(len(more)):
        assert (got[i]["class_id"], got[i]["n_links"]) == (root[i], len(links[i]))
    bands, rows = ngram_join.choose_bands(0.8, 0.9999)
    assert 1 - (1 - 0.8**rows) ** bands >= 0.9999


def test_components(spark):
    rng = random.Random(3)
    pairs = [(rng.randrange(200), rng.randrange(200)) for _ in range(120)] + [(i, i + 1) for i in range(300, 340)]
    parent = {x: x for p in pairs for x in p}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    got = dict(connected_components(spark.createDataFrame(pairs, "a long, b long")).collect())
    assert got == {x: find(x) for a, b in pairs if a != b for x in (a, b)}
