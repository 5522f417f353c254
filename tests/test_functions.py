import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkalogue.functions import markup, scalars
from sparkalogue.operators import kernels, sets


def one(spark, column, **values):
    df = spark.range(1).select(*[F.lit(v).alias(k) if v is not None else F.lit(None).cast("string").alias(k) for k, v in values.items()])
    return df.select(column.alias("x")).first()["x"]


def test_hash_ids(spark):
    f = lambda v: one(spark, scalars.hex_to_id63(F.col("v")), v=v)
    assert f("0000000000000010ffff") == 16
    assert f("ffffffffffffffff") == 2**63 - 1
    assert f(None) is None and f("") is None and f("xyz") is None
    u = lambda v: one(spark, scalars.parse_u64(F.col("v")), v=v)
    assert u("18446744073709551615") == -1 and u("18446744073709551616") is None and u("12") == 12 and u("-1") is None


def test_numbers_and_dates(spark):
    n = lambda v: one(spark, scalars.strict_num(F.col("v")), v=v)
    assert n("-1.5") == -1.5 and n("1e3") is None and n("+1") is None and n(" 1") is None
    d = lambda v: one(spark, scalars.partial_date(F.col("v")), v=v)
    assert d("2001") == datetime.date(2001, 1, 1) and d("2001-05") == datetime.date(2001, 5, 1)
    assert d("2001-02-30") is None and d("2001-13") is None and d("x") is None
    z = lambda v: one(spark, scalars.fuzzy_date(F.col("v")), v=v)
    assert z("Sept 3rd, 1998") == "1998-09-03" and z("4 July 1999 12:00") == "1999-07-04"
    assert z("March 2000") == "2000-03" and z("1997") == "1997" and z("1998/2/30") is None and z("soon") is None


def test_text(spark):
    assert one(spark, scalars.extension(F.col("v")), v="A/B.TAR.Gz") == "gz"
    assert one(spark, scalars.extension(F.col("v")), v="a/.hidden") is None
    assert one(spark, scalars.slugify(F.col("v")), v="Crème Brûlée  2!") == "creme-brulee-2"
    assert one(spark, scalars.slug_or_hash(F.col("v")), v="日本").startswith("p-")
    assert one(spark, scalars.human_size(F.lit(1536)), v="") == "1.5 KiB"
    assert one(spark, scalars.normalize_content(F.col("v")), v="a\r\nb\n\n") == "a\nb\n"
    assert one(spark, scalars.cut_bytes(F.col("v"), 4), v="aéé") == "aé"
    assert one(spark, scalars.normalize_language(F.col("v")), v="pt-BR") == "pt-br"
    assert one(spark, scalars.normalize_language(F.col("v")), v="english") is None
    assert one(spark, scalars.trigram_similarity(F.col("v"), F.lit("word")), v="word") == 1.0
    keys = [one(spark, scalars.natural_key(F.col("v")), v=v) for v in ("Disc 2", "disc 10", "disc 010b")]
    assert keys == sorted(keys)


def test_markup(spark):
    assert one(spark, markup.wikilinks(F.col("v")), v="[[A b|x]] and [[C#d]]") == ["A b", "C"]
    assert markup.template_calls("{{Box|a=1|b={{In|x}}|[[p|q]]}}") == [("Box", {"a": "1", "b": "{{In|x}}", "3": "[[p|q]]"})]
    assert one(spark, markup.normalize_title(F.col("v")), v="  main_page ") == "Main page"
    assert bytes(one(spark, markup.parse_hexdump(F.col("v")), v="0000  41 42 |AB|\n0010  43")) == b"ABC"


M = (1 << 64) - 1


def plain_splitmix(x):
    x = (x + kernels.GOLDEN) & M
    x = ((x ^ (x >> 30)) * 0xBF58476D1CE4E5B9) & M
    x = ((x ^ (x >> 27)) * 0x94D049BB133111EB) & M
    return x ^ (x >> 31)


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def test_minhash_equals_plain_version():
    ids = [1, 77, 2**63 - 5]
    seeds = [plain_splitmix(kernels.MINHASH_BASE ^ (i * kernels.GOLDEN & M)) for i in range(128)]
    want = [signed(min(plain_splitmix(h ^ s) for h in ids)) for s in seeds]
    assert kernels.minhash(np.array(ids[::-1] + ids, dtype=np.uint64)).tolist() == want
    assert len(kernels.minhash(np.zeros(0, np.uint64))) == 0


def test_band_values_equal_plain_version():
    sig = [i * 2654435761 for i in range(128)]
    want = []
    for b in range(16):
        h = kernels.BAND_START
        for v in sig[b * 8 : b * 8 + 8]:
            h = ((h ^ v) * kernels.BAND_PRIME) & M
        want.append(signed(h))
    got = kernels.band_values(np.array(sig)).tolist()
    assert got == want
    assert kernels.band_values(np.array([1, *sig[1:]]))[0] != got[0]


def plain_opm(data, bins=128):
    out = [kernels.EMPTY_BIN] * bins
    for i in range(len(data) - 15):
        h = 0
        for c in data[i : i + 16]:
            h = (h * kernels.SHINGLE_PRIME + c) & M
        h ^= h >> 33
        h = (h * kernels.SHINGLE_MIX) & M
        h ^= h >> 33
        h &= kernels.EMPTY_BIN
        out[h >> 56] = min(out[h >> 56], h)
    return out


def test_one_permutation():
    rng = np.random.default_rng(1)
    data = rng.integers(0, 256, 20_000, dtype=np.uint8).tobytes()
    assert kernels.one_permutation(data).tolist() == plain_opm(data)
    part = kernels.one_permutation(data[:9000])
    assert kernels.one_permutation(data[9000 - 15 :], carry=part).tolist() == plain_opm(data)
    edited = bytearray(data)
    for p in rng.integers(0, len(data), 3):
        edited[p] ^= 1
    agree = np.mean(kernels.one_permutation(bytes(edited)) == kernels.one_permutation(data))
    other = np.mean(kernels.one_permutation(rng.integers(0, 256, 20_000, dtype=np.uint8).tobytes()) == kernels.one_permutation(data))
    assert agree > 0.95 and other < 0.05


def test_chunks_survive_an_insertion():
    data = np.random.default_rng(2).integers(0, 256, 3_000_000, dtype=np.uint8).tobytes()
    cut = lambda b: {b[s:e] for s, e in zip([0, *kernels.chunk_ends(b)], kernels.chunk_ends(b))}
    sizes = [len(c) for c in cut(data)]
    assert max(sizes) <= kernels.CHUNK_MAX and b"".join(data[s:e] for s, e in zip([0, *kernels.chunk_ends(data)], kernels.chunk_ends(data))) == data
    a, b = cut(data), cut(data[:1_500_000] + b"inserted" + data[1_500_000:])
    assert len(a & b) / len(a | b) > 0.8


def test_tlsh_distance():
    a = "T1" + "".join(f"{i * 7 % 256:02X}" for i in range(35))
    assert kernels.tlsh_distance(a, a) == 0 and kernels.tlsh_distance(a, a[2:]) == 0
    b = a[:-1] + ("0" if a[-1] != "0" else "3")
    assert kernels.tlsh_distance(a, b) == kernels.tlsh_distance(b, a) > 0
    assert kernels.tlsh_distance("nope", a) is None and kernels.tlsh_distance(None, a) is None


def test_sound():
    t = np.arange(44100 * 12) / 44100
    rng = np.random.default_rng(3)
    def song(seed):
        f = np.random.default_rng(seed).uniform(100, 2000, 40)
        return sum(np.sin(2 * np.pi * f[(t // 0.3).astype(int) % 40] * k * t) for k in (1, 2)) + rng.normal(0, 0.01, len(t))
    x, y = song(1), song(2)
    j = lambda a, b: len(set(a) & set(b)) / max(1, len(set(a) | set(b)))
    hx = kernels.constellation(x)
    assert (np.diff(hx) > 0).all() and hx.max() < 2**26
    assert j(hx, kernels.constellation(x)) == 1
    assert j(hx, kernels.constellation(x[2048 * 5 :])) > 0.45
    assert j(hx, kernels.constellation(y)) < 0.4
    assert kernels.cue_tracks("TRACK 01 MODE1/2352\n INDEX 01 00:00:00\nTRACK 02 AUDIO\n INDEX 01 03:30:00") == [(2, (3 * 60 + 30) * 75)]


@pytest.mark.parametrize(("a", "b", "want"), [([1, 2, 3], [2, 3, 4], 0.5), ([1], [1], 1.0), ([1], [2], 0.0), ([], [], 0.0)])
def test_jaccard(spark, a, b, want):
    df = spark.createDataFrame([(a, b)], "a array<int>, b array<int>")
    assert df.select(sets.jaccard(F.col("a"), F.col("b"))).first()[0] == want


@pytest.mark.parametrize(("a", "b", "want"), [(["x", "y"], ["x", "y"], 1.0), (["x", "y"], ["x", "z"], 0.5), (["x"], ["x", "y"], 0.0)])
def test_slot_agreement(spark, a, b, want):
    df = spark.createDataFrame([(a, b)], "a array<string>, b array<string>")
    assert df.select(sets.slot_agreement(F.col("a"), F.col("b"))).first()[0] == want


def test_signatures_take_few_texts_at_a_time(spark, tmp_path):
    """Whole texts reach Python by 1000 at most."""
    from sparkalogue.queries import similarity

    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    spark.createDataFrame([(100, "some words", "en"), (200, "some words", "en")], "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    before = spark.conf.get(key)
    try:
        for name in ("minhash_signature", "minhash_agreement", "oph_resemblance", "minhash_splitmix_slots"):
            spark.conf.set(key, "10000")
            assert similarity.QUERIES[name](spark, str(tmp_path)).count() > 0
            assert int(spark.conf.get(key)) <= 1000
    finally:
        spark.conf.set(key, before)
