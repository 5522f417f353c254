import random

import pytest

from sparkalogue.llm import line_dedup


@pytest.mark.parametrize(("share", "rounds"), [(5, 1), (1.5, 3)])
def test_only_near_sets_are_kept_under_pairs_of_hot_tokens(spark, monkeypatch, share, rounds):
    """Where all tokens are hot, what is written under pairs of them are sets with another one near, in rounds where these are many."""
    rng = random.Random(3)
    lines = [" ".join(rng.sample([f"w{k}" for k in range(150)], 30)) for _ in range(300)]
    lines += [line.replace(" ", " x ", 1) for line in lines[:7]]
    want, seen = [], []
    for line in lines:
        k = set(line.split())
        want.append(int(any(1000 * len(k & s) >= 800 * len(k | s) for s in seen)))
        seen.append(k)
    written, write = [], line_dedup.write_table

    def spy(df, name):
        made = write(df, name)
        written.extend([made.count()] * (name == "hot-prefixes"))
        return made

    monkeypatch.setattr(line_dedup, "HOT", 1)
    monkeypatch.setattr(line_dedup, "ROUND", share)
    monkeypatch.setattr(line_dedup, "write_table", spy)
    docs = spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string").repartition(5)
    assert [r["n_removed"] for r in line_dedup.dedup(docs).orderBy("doc_id").collect()] == want
    assert sum(want) == 7
    # a set has 21 pairs of tokens and more
    assert 0 < sum(written) < 21 * len(lines) / 4
    assert len(written) == rounds
