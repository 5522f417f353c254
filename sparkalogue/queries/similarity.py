"""Similarity tiers over the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import catalog, kernels, sets, tiers
from ..operators.stored import stored
from .registry import Family, read

family = Family()


@family.add(
    "jaccard_shared_tokens_topk",
    """
    WITH t AS (SELECT DISTINCT doc_id AS id, unnest(regexp_split_to_array(lower(text), '[^a-z0-9]+')) AS tok FROM documents),
         f AS (SELECT id, tok FROM t WHERE tok <> ''),
         n AS (SELECT id, count(*) AS n FROM f GROUP BY id),
         c AS (SELECT q.id AS query_id, x.id AS id, count(*) AS c FROM f q JOIN f x ON q.tok = x.tok AND q.id <> x.id WHERE q.id % 100 = 0 GROUP BY 1, 2),
         s AS (SELECT query_id, c.id, CAST(c AS BIGINT) AS shared, round(c / CAST(a.n + b.n - c AS DOUBLE), 6) AS jaccard
               FROM c JOIN n a ON a.id = query_id JOIN n b ON b.id = c.id)
    SELECT query_id, id, shared, jaccard FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY jaccard DESC, id) AS rn FROM s) WHERE rn <= 10
    """,
)
def jaccard_shared_tokens_topk(spark, sf_dir):
    return sets.jaccard_topk(*_word_sets(spark, sf_dir), k=10)


def _word_sets(spark, sf_dir):
    """The query set and all sets, (id, toks)."""
    words = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), sets.words(F.col("text")).alias("toks"))
    return words.where("id % 100 = 0"), words


@family.add(
    "identical_content",
    """
    SELECT doc_id AS id, min(doc_id) OVER w AS class_id, count(*) OVER w AS members FROM documents WINDOW w AS (PARTITION BY md5(text))
    """,
)
def identical_content(spark, sf_dir):
    hashed = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.md5("text").alias("content_hash"))
    return tiers.classes(hashed, "content_hash")


@family.add(
    "content_composite_hash",
    """
    SELECT l_orderkey, sha256(unhex(string_agg(d, '' ORDER BY d))) AS content_hash
    FROM (SELECT l_orderkey, sha1(concat_ws('|', l_partkey, l_suppkey, l_linenumber)) AS d FROM lineitem) GROUP BY l_orderkey
    """,
)
def content_composite_hash(spark, sf_dir):
    files = read(spark, sf_dir, "lineitem").select("l_orderkey", F.sha1(F.concat_ws("|", "l_partkey", "l_suppkey", "l_linenumber")).alias("d"))
    return catalog.composite_digest(files, "l_orderkey", "d")


#: Seeds of the signature that SQL can compute too: minima of md5 prefixes.
_SEEDS = 16
_SQL_SIGNATURE = f"""
    t AS (SELECT DISTINCT doc_id AS id, unnest(regexp_split_to_array(lower(text), '[^a-z0-9]+')) AS tok FROM documents),
    m AS (SELECT id, s, min(('0x' || substr(md5(s || ':' || tok), 1, 15))::BIGINT) AS v FROM t, (SELECT unnest(range(0, {_SEEDS})) AS s) WHERE tok <> '' GROUP BY id, s)
"""


def _worded(spark, sf_dir):
    """(id, text) of the documents with a word."""
    return kernels.small_batches(read(spark, sf_dir, "documents")).where(kernels.has_word(F.col("text"))).select(F.col("doc_id").alias("id"), "text")


def _signatures(spark, sf_dir):
    """(id, signature): for each seed the least of 60-bit md5 prefixes over the document's words, hashed where it is read."""
    return stored(_worded(spark, sf_dir).select("id", kernels.md5_minima(F.col("text"), _SEEDS).alias("signature")), "signatures")


@family.add("minhash_signature", f"WITH {_SQL_SIGNATURE} SELECT id, CAST(s AS INTEGER) AS slot, v FROM m")
def minhash_signature(spark, sf_dir):
    return _signatures(spark, sf_dir).select("id", F.posexplode("signature").alias("slot", "v"))


_SQL_BANDS = """
    b AS (SELECT id, s // 4 AS band, string_agg(v, ',' ORDER BY s) AS h FROM m GROUP BY id, s // 4),
    c AS (SELECT DISTINCT x.id AS query_id, y.id FROM b x JOIN b y ON x.h = y.h AND x.id <> y.id WHERE x.id % 100 = 0)
"""


def _banded(spark, sf_dir):
    bands = F.transform(F.sequence(F.lit(0), F.lit(_SEEDS // 4 - 1)), lambda k: F.array_join(F.slice("signature", k * 4 + 1, 4), ","))
    return _signatures(spark, sf_dir).withColumn("bands", bands)


@family.add("lsh_candidates", f"WITH {_SQL_SIGNATURE}, {_SQL_BANDS} SELECT query_id, id FROM c")
def lsh_candidates(spark, sf_dir):
    banded = _banded(spark, sf_dir)
    return sets.lsh_candidates(banded.where("id % 100 = 0"), banded)


@family.add(
    "minhash_agreement",
    f"""
    WITH {_SQL_SIGNATURE}, {_SQL_BANDS},
    s AS (SELECT query_id, c.id, round(sum((x.v = y.v)::INT) / {_SEEDS}.0::DOUBLE, 6) AS agreement FROM c JOIN m x ON x.id = query_id JOIN m y ON y.id = c.id AND y.s = x.s GROUP BY 1, 2)
    SELECT query_id, id, agreement FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY agreement DESC, id) AS rn FROM s) WHERE rn <= 10
    """,
)
def minhash_agreement(spark, sf_dir):
    banded = _banded(spark, sf_dir)
    return sets.signature_topk(banded.where("id % 100 = 0"), banded, k=10)


def _splitmix_signatures(spark, sf_dir):
    return _worded(spark, sf_dir).select("id", kernels.splitmix_minima(F.col("text")).alias("signature"))


@family.add("minhash_splitmix")
def minhash_splitmix(spark, sf_dir):
    """Bit-exact 128-slot signatures with their 16 band hashes (tested against a plain version)."""
    # a second function over the signatures would make these a second time
    both = _worded(spark, sf_dir).select("id", kernels.splitmix_minima(F.col("text"), banded=True).alias("both"))
    return both.select("id", F.slice("both", 1, kernels.SLOTS).alias("signature"), F.slice("both", kernels.SLOTS + 1, 16).alias("bands"))


def _sql_mix(x: str) -> str:
    """SQL of the splitmix64 step in 128-bit numbers, over a column s0 of a subquery chain."""
    low = "18446744073709551615::UHUGEINT"
    one = f"SELECT * EXCLUDE (x), (x + {kernels.GOLDEN}::UHUGEINT) & {low} AS x FROM ({x})"
    two = f"SELECT * EXCLUDE (x), (xor(x, x >> 30) * {0xBF58476D1CE4E5B9}::UHUGEINT) & {low} AS x FROM ({one})"
    three = f"SELECT * EXCLUDE (x), (xor(x, x >> 27) * {0x94D049BB133111EB}::UHUGEINT) & {low} AS x FROM ({two})"
    return f"SELECT * EXCLUDE (x), xor(x, x >> 31) AS x FROM ({three})"


_SQL_SEEDS = _sql_mix(f"SELECT slot, xor({kernels.MINHASH_BASE}::UHUGEINT, (slot::UHUGEINT * {kernels.GOLDEN}::UHUGEINT) & 18446744073709551615::UHUGEINT) AS x FROM (SELECT unnest(range(0, {kernels.SLOTS})) AS slot)")
_SQL_SLOTS = f"""
    WITH t AS (SELECT DISTINCT doc_id AS id, unnest(regexp_split_to_array(lower(text), '[^a-z0-9]+')) AS tok FROM documents),
         k AS (SELECT DISTINCT tok, ('0x' || substr(sha1(tok), 1, 16))::UBIGINT::UHUGEINT & 9223372036854775807::UHUGEINT AS h FROM t WHERE tok <> ''),
         e AS ({_SQL_SEEDS}),
         v AS ({_sql_mix("SELECT tok, slot, xor(h, e.x) AS x FROM k, e")}),
         m AS (SELECT id, slot, min(v.x) AS low FROM t JOIN v USING (tok) GROUP BY id, slot)
    SELECT id, slot::INTEGER AS slot, (CASE WHEN low >= 9223372036854775808::UHUGEINT THEN low::HUGEINT - 18446744073709551616::HUGEINT ELSE low::HUGEINT END)::BIGINT AS v FROM m
"""


@family.add("minhash_splitmix_slots", _SQL_SLOTS)
def minhash_splitmix_slots(spark, sf_dir):
    """The slots of the bit-exact signatures, a row each."""
    return _splitmix_signatures(spark, sf_dir).select("id", F.posexplode("signature").alias("slot", "v"))


_SQL_RESEMBLANCE = f"""
    WITH m AS ({_SQL_SLOTS}),
         b AS (SELECT id, slot // 8 AS band, list(v ORDER BY slot) AS h FROM m GROUP BY 1, 2),
         c AS (SELECT DISTINCT x.id AS query_id, y.id FROM b x JOIN b y ON x.h = y.h AND x.id <> y.id WHERE x.id % 100 = 0),
         s AS (SELECT query_id, c.id, round(sum((x.v = y.v)::INT) / 128.0::DOUBLE, 6) AS agreement FROM c JOIN m x ON x.id = query_id JOIN m y ON y.id = c.id AND y.slot = x.slot GROUP BY 1, 2)
    SELECT query_id, id, agreement FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY agreement DESC, id) AS rn FROM s) WHERE rn <= 10
"""


@family.add("chunk_resemblance", _SQL_RESEMBLANCE)
def chunk_resemblance(spark, sf_dir):
    """Neighbours by agreement of 128-slot signatures behind 16 x 8 bands."""
    signed = stored(minhash_splitmix(spark, sf_dir), "signatures")
    return sets.signature_topk(signed.where("id % 100 = 0"), signed, k=10)


@family.add("oph_resemblance")
def oph_resemblance(spark, sf_dir):
    """The nearest of all documents by agreement of one-permutation signatures over the bytes of whole texts, whether or not a band of these is equal."""
    signed = kernels.small_batches(read(spark, sf_dir, "documents")).select(F.col("doc_id").alias("id"), kernels.one_permutation_udf(F.col("text").cast("binary")).alias("signature"))
    # a hash begins with its bin, so equal ones are of one slot; the mark of an empty bin gets its own number
    slots = F.transform("signature", lambda v, i: F.when(v == kernels.EMPTY_BIN, -1 - i).otherwise(v))
    signed = stored(signed.select("id", slots.alias("toks")), "signatures")
    # all have as many slots, so those that share most are those of the highest Jaccard
    near = sets.jaccard_topk(signed.where("id % 100 = 0"), signed, k=10)
    return near.select("query_id", "id", F.round(F.col("shared") / kernels.SLOTS, 6).alias("agreement"))


@family.add("content_defined_chunks")
def content_defined_chunks(spark, sf_dir):
    """Shared chunks of whole texts, with how many documents hold each (small chunk sizes suit texts)."""
    cut = kernels.chunks(read(spark, sf_dir, "documents"), "doc_id", "text", least=256, average=1024, most=4096)
    return cut.groupBy("chunk_id").agg(F.countDistinct("id").alias("n_docs"), F.max("size").alias("size")).where("n_docs > 1")


_SQL_TRACKS = """
    t AS (SELECT DISTINCT conv_id AS build, turn AS track, unnest(regexp_split_to_array(lower(text), '[^a-z0-9]+')) AS tok FROM conversations),
    f AS (SELECT * FROM t WHERE tok <> ''),
    n AS (SELECT count(DISTINCT build) AS n FROM f),
    d AS (SELECT tok, count(DISTINCT build) AS df FROM f GROUP BY tok),
    i AS (SELECT tok, df, ln((n + 1) / (df + 1)::DOUBLE) AS idf FROM d, n WHERE df <= greatest(50, floor(0.05 * n)))
"""


def _tracks(spark, sf_dir):
    return read(spark, sf_dir, "conversations").select(F.col("conv_id").alias("build"), F.col("turn").alias("track"), F.explode(sets.words(F.col("text"))).alias("tok")).distinct()


@family.add("audio_idf", f"WITH {_SQL_TRACKS} SELECT tok, df, round(idf, 6) AS idf FROM i")
def audio_idf(spark, sf_dir):
    return tiers.token_idf(_tracks(spark, sf_dir)).withColumn("idf", F.round("idf", 6))


_SQL_BEST_TRACKS = f"""
    WITH {_SQL_TRACKS},
    q AS (SELECT f.build, track, f.tok, idf FROM f JOIN i USING (tok)),
    w AS (SELECT build, track, sum(idf) AS w FROM q GROUP BY 1, 2),
    s AS (SELECT a.build AS q_build, a.track AS q_track, b.build, b.track, sum(a.idf) AS w FROM q a JOIN q b ON a.tok = b.tok AND a.build <> b.build WHERE a.build % 100 = 0 GROUP BY 1, 2, 3, 4),
    j AS (SELECT q_build, q_track, s.build, s.track, round(s.w / nullif(x.w + y.w - s.w, 0), 6) AS sim
          FROM s JOIN w x ON x.build = q_build AND x.track = q_track JOIN w y ON y.build = s.build AND y.track = s.track),
    b AS (SELECT q_build, q_track, build, track, sim FROM (SELECT *, row_number() OVER (PARTITION BY q_build, q_track, build ORDER BY sim DESC, track) AS rn FROM j WHERE sim IS NOT NULL) WHERE rn = 1)
"""


def _best_tracks(spark, sf_dir, least):
    turns = read(spark, sf_dir, "conversations").select(F.col("conv_id").alias("build"), F.col("turn").alias("track"), sets.words(F.col("text")).alias("toks"))
    return tiers.similar_tracks(turns, F.coalesce(F.col("build") % 100 == 0, F.lit(False)), least)


@family.add("audio_similar_tracks", f"{_SQL_BEST_TRACKS} SELECT * FROM b WHERE sim >= 0.05")
def audio_similar_tracks(spark, sf_dir):
    return _best_tracks(spark, sf_dir, 0.05)


@family.add(
    "audio_matched_builds",
    f"{_SQL_BEST_TRACKS} SELECT q_build, build, count(*) FILTER (WHERE sim >= 0.55) AS matched, max(sim) AS best FROM b GROUP BY 1, 2 HAVING count(*) FILTER (WHERE sim >= 0.55) > 0",
)
def audio_matched_builds(spark, sf_dir):
    return tiers.matched_builds(_best_tracks(spark, sf_dir, tiers.TRACK_MATCH))  # a build without a match has no row


@family.add(
    "embedding_cosine_topk",
    """
    WITH e AS (SELECT vec_id AS id, embedding::DOUBLE[] AS v FROM embeddings),
    s AS (SELECT q.id AS query_id, e.id, round(list_cosine_similarity(q.v, e.v), 6) AS cosine FROM e q JOIN e ON q.id <> e.id WHERE q.id % 100 = 0)
    SELECT query_id, id, cosine FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY cosine DESC, id) AS rn FROM s) WHERE rn <= 10
    """,
)
def embedding_cosine_topk(spark, sf_dir):
    vectors = read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"))
    return tiers.cosine_topk(vectors.where("id % 100 = 0"), vectors, k=10)


_SQL_FUSED = """
    WITH h AS (SELECT doc_id AS id, md5(text) AS h FROM documents),
    t AS (SELECT DISTINCT doc_id AS id, unnest(regexp_split_to_array(lower(text), '[^a-z0-9]+')) AS tok FROM documents),
    f AS (SELECT * FROM t WHERE tok <> ''), n AS (SELECT id, count(*) AS n FROM f GROUP BY id),
    c AS (SELECT q.id AS query_id, x.id, count(*) AS c FROM f q JOIN f x ON q.tok = x.tok AND q.id <> x.id WHERE q.id % 100 = 0 GROUP BY 1, 2),
    files AS (SELECT query_id, c.id, round(c / CAST(a.n + b.n - c AS DOUBLE), 6) AS sim FROM c JOIN n a ON a.id = query_id JOIN n b ON b.id = c.id),
    content AS (SELECT a.id AS query_id, b.id, 1.0 AS sim FROM h a JOIN h b ON a.h = b.h AND a.id <> b.id WHERE a.id % 100 = 0),
    v AS (SELECT coalesce(f.query_id, c.query_id) AS query_id, coalesce(f.id, c.id) AS id, coalesce(f.sim, 0) AS fs, coalesce(c.sim, 0) AS cs FROM files f FULL JOIN content c ON f.query_id = c.query_id AND f.id = c.id),
    l AS (SELECT DISTINCT doc_id FROM labels),
    k AS (SELECT v.*, x.doc_id IS NOT NULL AND y.doc_id IS NOT NULL AS both_labelled FROM v LEFT JOIN l x ON x.doc_id = query_id LEFT JOIN l y ON y.doc_id = v.id)
    SELECT query_id, id, score FROM (SELECT query_id, id, round(CASE WHEN both_labelled THEN (0.25 * cs + 0.20 * fs) / 0.45 ELSE fs END, 6) AS score FROM k) WHERE score > 0.01
"""


#: Rows of marks, 64 ids each, that are sent to every task at most.
_MARKS = 1 << 20


def _marked(docs, labels):
    """docs with l, whether labels has the doc_id. Ids are sent as a bit each in rows of 64, so texts aren't shuffled for a list of ids."""
    bit = lambda i: F.call_function("shiftleft", F.lit(1).cast("long"), i.bitwiseAND(F.lit(63)).cast("int"))
    row, doc_id = F.shiftright(F.col("doc_id").cast("long"), 6), F.col("doc_id").cast("long")
    marks = stored(labels.where("doc_id is not null").select(row.alias("row"), bit(doc_id).alias("bit")).groupBy("row").agg(F.bit_or("bit").alias("bits")), "labels")
    marks = F.broadcast(marks) if marks.count() <= _MARKS else marks
    has = F.coalesce(F.col("bits").bitwiseAND(bit(doc_id)) != 0, F.lit(False))
    return docs.withColumn("row", row).join(marks, "row", "left").withColumn("l", has).drop("row", "bits")


@family.add("fused_similarity", _SQL_FUSED)
def fused_similarity(spark, sf_dir):
    """Two tiers fused; every document can have the files tier, labelled ones the content tier too.

    Equal texts with words have equal sets, so both tiers of a pair are known where its sets meet;
    only texts without words need a join by content.
    """
    w = tiers.WEIGHTS
    texts = _marked(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))
    content = F.conv(F.substring(F.md5("text"), 1, 15), 16, 10).cast("bigint")
    docs = texts.select(F.col("doc_id").alias("id"), sets.words(F.col("text")).alias("toks"), content.alias("content"), "l")
    pairs = sets.jaccard_above(docs.where("id % 100 = 0"), docs, least=0.01)
    same = F.when((F.col("jaccard") == 1) & (F.col("query_content") == F.col("content")), 1.0).otherwise(0.0)
    both = F.round((w["content"] * same + w["files"] * F.col("jaccard")) / (w["content"] + w["files"]), 6)
    scored = pairs.select("query_id", "id", F.when(F.col("query_l") & F.col("l"), both).otherwise(F.col("jaccard")).alias("score")).where("score > 0.01")
    wordless = texts.where(~F.col("text").rlike("[A-Za-z0-9]") & ~F.lower("text").rlike("[a-z0-9]")).where("l").select(F.col("doc_id").alias("id"), F.md5("text").alias("h"))
    alone = tiers.equal_key(wordless.where("id % 100 = 0"), wordless, "h", "content")
    return scored.union(alone.select("query_id", "id", F.round(w["content"] * F.col("sim") / (w["content"] + w["files"]), 6)))


@family.add("signature_minima", f"WITH {_SQL_SIGNATURE} SELECT lang, CAST(s AS INTEGER) AS slot, min(v) AS v FROM m JOIN documents ON doc_id = id GROUP BY 1, 2")
def signature_minima(spark, sf_dir):
    """Signatures of languages from those of their documents."""
    langs = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "lang")
    return sets.elementwise_min(_signatures(spark, sf_dir).join(langs, "id"), "lang", "signature").select("lang", F.posexplode("signature").alias("slot", "v"))


@family.add(
    "text_documents",
    """SELECT o_orderkey, concat_ws(' ', o_orderpriority, p) AS text_doc FROM orders LEFT JOIN (SELECT l_orderkey, string_agg(replace(l_returnflag || '/' || p_name, '/', ' '), ' ' ORDER BY replace(l_returnflag || '/' || p_name, '/', ' ')) AS p
       FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY 1) ON l_orderkey = o_orderkey""",
)
def text_documents(spark, sf_dir):
    parts = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), "p_name")
    paths = read(spark, sf_dir, "lineitem").join(parts, "l_partkey").select(F.col("l_orderkey").alias("o_orderkey"), F.concat_ws("/", "l_returnflag", "p_name").alias("path"))
    return sets.text_document(read(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority"), paths, "o_orderkey", ["o_orderpriority"], "path")


QUERIES, ORACLE_SQL = family.queries, family.sql
