"""Empty tables, repeated rows, several texts of one id, nulls, long texts and clashing names, for every operator on documents."""

import hashlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from sparkalogue.llm import common, context_tree, decontaminate, html_text, line_dedup, ngram_join, packing, quality_rules, suffix_dedup, token_files, tokens, toxicity

PATH = tokens.default_path()
#: Names that the operators use for columns of their own.
CLASHING = ["row", "id", "d", "doc", "gone", "copy", "copies", "lines", "n_lines", "keys", "sig", "wanted", "found", "start", "piece", "anchor", "shingles", "bands", "rep", "set_id", "class_id", "score", "held_out", "predicted", "measure", "grp", "deal", "kept", "spans", "item_id", "block", "word", "code"]
LONG = " ".join(f"w{k % 701}x{k % 13}" for k in range(60_000))
FIRST, SECOND = "alpha beta gamma delta epsilon\nzeta eta theta iota kappa lamda", "one two three four five six seven eight nine ten"


@pytest.fixture(scope="module")
def rows():
    """Rows with a null in each column, an empty text, one row twice, one id with two texts, and one very long text."""
    return [(1, FIRST, "en"), (2, None, "en"), (3, "", None), (4, SECOND, "fr"), (4, SECOND, "fr"), (5, FIRST, "en"), (5, SECOND + " more", "en"), (6, LONG, "en"), (None, "a text without an id", "en")]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumns({c: F.lit("x") for c in CLASHING}).repartition(3)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (1, 1, 0), (4, 0, 1), (None, 1, 1), (9, None, None)], "doc_id long, quality int, toxic int")


@pytest.fixture(scope="module")
def items(spark):
    return spark.createDataFrame([(1, SECOND), (1, SECOND), (2, None), (3, ""), (4, "no such words anywhere at all in here")], "item_id long, text string")


def _token_files(spark, docs):
    path = token_files.new_path(spark)
    token_files.write(docs, path, PATH)
    return token_files.read(spark, path)


@pytest.fixture(scope="module")
def operators(spark, labels, items):
    return {
        "packing": lambda d: packing.pack(d, PATH, capacity=256, group_rows=4),
        "suffix_dedup": lambda d: suffix_dedup.remove_repeats(d, least=40),
        "quality_rules": lambda d: quality_rules.judge(d, labels),
        "line_dedup": line_dedup.dedup,
        "token_files": lambda d: _token_files(spark, d),
        "context_tree": context_tree.score,
        "toxicity": lambda d: toxicity.score(d, labels),
        "decontaminate": lambda d: decontaminate.matches(d, items),
        "ngram_join": ngram_join.join,
    }


@pytest.mark.parametrize("name", ["packing", "suffix_dedup", "quality_rules", "line_dedup", "token_files", "context_tree", "toxicity", "decontaminate", "ngram_join"])
def test_empty_tables(operators, docs, name):
    assert operators[name](docs.where("doc_id = 12345")).collect() == []


def _by_id(got):
    return Counter(r["doc_id"] for r in got)


def test_one_row_each(operators, docs, rows):
    """Operators that judge each document return a row for each row, whatever the other columns are called."""
    ids = Counter(r[0] for r in rows)
    for name in ("suffix_dedup", "quality_rules", "token_files", "context_tree", "toxicity"):
        assert _by_id(operators[name](docs).collect()) == ids, name


def test_lines_of_repeated_rows(operators, docs):
    got = operators["line_dedup"](docs).orderBy("doc_id").collect()
    assert sorted((r["doc_id"] or 0, r["n_removed"]) for r in got) == [(0, 0), (1, 0), (2, 0), (3, 0), (4, 0), (4, 1), (5, 1), (5, 2), (6, 0)]
    assert {r["text"] for r in got if r["doc_id"] == 4} == {SECOND, ""}
    assert all(r[c] == "x" for r in got for c in CLASHING if c != "n_lines") and next(r["text"] for r in got if r["doc_id"] == 6) == LONG


def test_lines_under_hot_tokens(spark, monkeypatch):
    """The same lines go whether tokens count as hot or not, as brute force says."""
    import random

    rng, vocab = random.Random(8), [f"w{k}" for k in range(40)]
    texts = []
    for _ in range(40):
        base = rng.sample(vocab, rng.randint(2, 14))
        texts.append("\n".join(" ".join(rng.sample([*base, *rng.sample(vocab, 1)], len(base) + 1)) for _ in range(rng.randint(1, 5))))
    want, seen = Counter(), []
    for i, t in enumerate(texts):
        for line in t.split("\n"):
            k = set(line.split())
            want[i] += any(1000 * len(k & s) >= 800 * len(k | s) for s in seen)
            seen.append(k)
    made = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    for hot in (0, 5, 1000):
        monkeypatch.setattr(line_dedup, "HOT", hot)
        assert {r["doc_id"]: r["n_removed"] for r in line_dedup.dedup(made).collect()} == dict(want)


def test_pieces_of_repeated_rows(operators, docs):
    got = operators["packing"](docs).collect()
    assert len([r for r in got if r["doc_id"] == 4]) == 2 and len([r for r in got if r["doc_id"] in (2, 3)]) == 2
    held = sorted((r["start"], r["length"]) for r in got if r["doc_id"] == 6)
    assert all(a + n == b for (a, n), (b, _) in zip(held, held[1:], strict=False))


def test_removed_bytes_of_repeated_rows(operators, docs):
    got = operators["suffix_dedup"](docs).collect()
    for r in got:
        if r["doc_id"] in (1, 4, 5):
            assert sum(s["end"] - s["start"] for s in r["spans"]) >= 40
    assert [bytes(r["kept"]) for r in got if r["doc_id"] in (2, 3)] == [b"", b""]


def test_links_of_one_id_with_two_texts(spark):
    base = [" ".join(f"{c}{k}" for k in range(60)) for c in "ab"]
    near = [t.rsplit(" ", 1)[0] + " other" for t in base]
    made = spark.createDataFrame([(1, base[0]), (1, base[1]), (2, near[0]), (3, near[1]), (4, "alone")], "doc_id long, text string")
    got = sorted((r["doc_id"], r["class_id"], r["n_links"]) for r in ngram_join.join(made).collect())
    assert got == [(1, 1, 1), (1, 1, 1), (2, 1, 1), (3, 1, 1), (4, 4, 0)]


def test_matches_of_repeated_rows(operators, docs):
    got = Counter((r["doc_id"], r["item_id"]) for r in operators["decontaminate"](docs).collect())
    assert got == {(4, 1): 4, (5, 1): 2}  # both rows of the document, both rows of the item


def test_one_document_by_the_offset_index(spark, rows, docs):
    path = token_files.new_path(spark)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    token_files.write(docs, path, PATH)
    token_files.read(spark, path)
    assert int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) in (int(before), common.BATCH_ROWS)
    lib = tokens.Encoder(PATH).tokenizer
    for doc_id in (1, 4, 6, 77):
        want = [[*lib.encode(t or "", add_special_tokens=False).ids, 0] for i, t, _ in rows if i == doc_id]
        assert [x.tolist() for x in token_files.read_document(spark, path, doc_id)] == want


def test_new_bins_last_take_no_more_bins():
    import numpy as np

    rng = np.random.default_rng(3)
    lengths = np.clip(rng.lognormal(5.5, 0.9, 6000).astype(int), 1, 1024)
    plain, weighed = (len(packing.sum_of_squares(lengths, 1024, weigh_new=w)[2]) for w in (False, True))
    assert -(-lengths.sum() // 1024) <= plain <= weighed


def _plain_sum_of_squares(lengths, capacity):
    """The rule written down: the squared counts of open bins by gap, summed anew for every choice."""
    gaps, placed = [], []
    for s in sorted(lengths, reverse=True):
        cost = {}
        for g in sorted({g for g in gaps if g >= s}):
            now = Counter(gaps)
            now[g] -= 1
            now[g - s] += 1
            cost[g] = sum(n * n for gap, n in now.items() if gap)
        if cost:
            g = min(cost, key=lambda g: (cost[g], g))
            gaps[gaps.index(g)] = g - s
        else:
            g = capacity
            gaps.append(g - s)
        placed.append((s, g - s))
    return placed


def test_sum_of_squares_against_the_rule():
    import numpy as np

    rng = np.random.default_rng(5)
    for _ in range(20):
        lengths = rng.integers(1, 30, 60)
        bins, offsets, _ = packing.sum_of_squares(lengths, 32)
        order = np.argsort(-lengths, kind="stable")
        assert [(int(lengths[i]), 32 - int(offsets[i]) - int(lengths[i])) for i in order] == _plain_sum_of_squares(lengths.tolist(), 32)


def test_groups_of_pieces_stay_small(spark):
    """Pieces that never combine don't end in one group."""
    made = spark.createDataFrame([(k, "word " * 150) for k in range(60)], "doc_id long, text string")
    got = packing.pack(made, PATH, capacity=256, group_rows=10).collect()
    assert len({r["sequence_id"] for r in got}) == 60 and {r["offset"] for r in got} == {0}


def test_names_of_blocks():
    w = html_text.learn(html_text.PAGES)
    body = "<p>One two three four five six.</p><p>Seven eight nine.</p>"
    for name in ("layout-with-sidebar", "no-ads", "search-results-free", "post"):
        assert html_text.main_text(f'<body><div class="{name}">{body}</div></body>', w) == "One two three four five six.\nSeven eight nine."
    page = f'<body><div class="widget"><article><div class="entry-header"><h1>The title</h1></div>{body}</article></div><div class="sidebar">x y z</div></body>'
    assert html_text.main_text(page, w) == "The title\nOne two three four five six.\nSeven eight nine."


@pytest.mark.parametrize("piece", ["x <b ", '<a href="', "<a '\"", '<a ">" ', "<!-- ", "<script>", '<div class="sidebar">'])
def test_broken_markup_takes_linear_time(piece):
    import time

    w = html_text.learn(html_text.PAGES)
    took = []
    for n in (20_000, 160_000):
        began = time.process_time()
        html_text.main_text(piece * (n // len(piece)), w)
        took.append(time.process_time() - began)
    assert took[1] < 30 * max(took[0], 0.02)  # eight times the page; quadratic would be 64


def test_best_region_against_all_regions():
    import random

    rng = random.Random(4)
    for _ in range(200):
        s = [rng.choice([-3, -2, -1, 1, 2]) for _ in range(rng.randint(1, 12))]
        a, b = html_text.best_region([float(x) for x in s])
        assert sum(s[a:b]) == max([0, *[sum(s[i:j]) for i in range(len(s)) for j in range(i + 1, len(s) + 1)]])


def test_pages_of_any_kind(spark):
    rows = [(1, "u", "<article><p>One two three.</p></article>"), (1, "u", "<article><p>One two three.</p></article>"), (2, None, None), (3, "v", ""), (None, "w", "<p>Plain words here.")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit("x"))
    got = Counter((r["page_id"], r["text"]) for r in html_text.extract(pages).collect())
    assert got == {(1, "One two three."): 2, (2, ""): 1, (3, ""): 1, (None, "Plain words here."): 1}
    assert html_text.extract(pages.where("page_id = 99")).collect() == []


def test_hashes_of_kept_bytes(spark):
    text = "the same long passage of words stands here twice over. " * 2
    made = spark.createDataFrame([(1, "begin " + text + " end")], "doc_id long, text string")
    r = suffix_dedup.remove_repeats(made, least=40).first()
    data, gone = r["kept"], [(s["start"], s["end"]) for s in r["spans"]]
    whole = ("begin " + text + " end").encode()
    want = bytes(b for i, b in enumerate(whole) if not any(x <= i < y for x, y in gone))
    assert hashlib.sha256(bytes(data)).hexdigest() == hashlib.sha256(want).hexdigest() and gone


def test_held_out_texts_score_above_word_counts(spark):
    """On enough text the model's log probability of texts that it never saw is above that of add-one word counts."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    got = context_tree.score(docs).where("held_out").agg(F.sum("score").alias("score"), F.sum("base_score").alias("base")).first()
    assert got["base"] < got["score"] < 0


ARTICLE = "".join(f"<p>Sentence number {k} of the article tells of rivers, hills and the old road to the mill.</p>" for k in range(12))
ARTICLE_TEXT = "\n".join(f"Sentence number {k} of the article tells of rivers, hills and the old road to the mill." for k in range(12))


@pytest.mark.parametrize(
    ("page", "before"),
    [
        (f"<html><head><title>t</title><script>x('<div>')</script><meta a><body><div>{ARTICLE}</div>", ""),
        (f"<head>no text<div>{ARTICLE}</div>", ""),
        (f"<p>First.<!--></p>{ARTICLE}", "First.\n"),
        (f"<p>First.<!---></p>{ARTICLE}", "First.\n"),
        (f'<div class="elementor-widget elementor-widget-text-editor">{ARTICLE}</div>', ""),
        (f'<article><div class="elementor-widget text">{ARTICLE[:400]}</div><div class="elementor-widget text">{ARTICLE[400:]}</div></article>', ""),
        (f'<form id="aspnetForm"><div>{ARTICLE}</div><input></form>', ""),
        (f'<div class="tabs-content">{ARTICLE}</div>', ""),
        (f'<div class="popular-science">{ARTICLE}</div>', ""),
        (f'<div class="layout-left-menu"><div class="menu"><a href="/">Home</a> <a href="/n">News</a></div>{ARTICLE}</div>', ""),
        (f"<main><header><h1>A title</h1></header>{ARTICLE}</main>", "A title\n"),
    ],
)
def test_articles_under_names_of_furniture(page, before):
    weights = html_text.learn(html_text.PAGES)
    got = html_text.main_text(page, weights)
    assert got.replace(" ", "").replace("\n", "") == (before + ARTICLE_TEXT).replace(" ", "").replace("\n", "")


def test_comments_stay_out_however_long():
    weights = html_text.learn(html_text.PAGES)
    page = f"<article><h1>Short news</h1><p>The bridge over the river is open again after three months of work.</p></article><section class='comments'>{ARTICLE}</section>"
    assert html_text.main_text(page, weights) == "Short news\nThe bridge over the river is open again after three months of work."
