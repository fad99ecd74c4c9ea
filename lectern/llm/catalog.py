"""Registered queries of the training-data operators and their SQL."""

from __future__ import annotations

import uuid
import zlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm import (caps, curves, language, mixing, ngram_join, periodic, pii, quality, repeats, secret_scan,
                         sentencepiece, tokens, variants)
from lectern.llm.common import crc_mod, materialize, table
from lectern.session import scratch_path


def tokenizer_path(name: str) -> str:
    import public_tokenizers
    return str(public_tokenizers.path(name))


def op1_quality_votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document, learned from the rows that are not held out."""
    docs = table(spark, sf_dir, "documents")
    voter = quality.fit(docs, table(spark, sf_dir, "labels"), crc_mod("doc_id", 3) != 1)
    scored = quality.score(docs.select("doc_id", "text"), voter)
    return scored.select("doc_id", F.coalesce(crc_mod("doc_id", 3) == 1, F.lit(False)).alias("held_out"), "score",
                         (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op2_hilbert_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest vectors found for every query vector."""
    return curves.nearest(table(spark, sf_dir, "embeddings"), 20, F.col("vec_id") % 20 == 0)


def op3_cap_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and classes of all vectors."""
    return caps.links(table(spark, sf_dir, "embeddings"))


def op4_suffix_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What stays of every document without repeated byte strings: its digest,
    and its text (bytes of a character that was cut in two read as U+FFFD)."""
    found = repeats.remove(table(spark, sf_dir, "documents"))
    return found.withColumn("text", F.make_valid_utf8(F.col("kept").cast("string"))).drop("kept")


def op5_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-copy classes of all documents."""
    return ngram_join.join(table(spark, sf_dir, "documents"))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, learned from the rows that are not held out."""
    docs = table(spark, sf_dir, "documents")
    held = F.coalesce(crc_mod("doc_id", 5) == 0, F.lit(False))
    net = language.train(language.training_sample(docs, crc_mod("doc_id", 5) != 0))
    return (language.classify(docs.select("doc_id", "text"), net)
            .select("doc_id", held.alias("held_out"), "lang_pred", "score"))


def op7_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that the mix takes from every document."""
    docs = table(spark, sf_dir, "documents")
    sized = materialize(docs.select("doc_id", "source", mixing.word_count(F.col("text")).alias("size"),
                                    F.xxhash64("doc_id", "text").alias("key")), "sizes")
    mixed = mixing.mix(sized, key=F.col("key"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken", "copies")


def op8_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every document, and whether they decode to its text."""
    path = tokenizer_path("piece_bpe_32k.model")
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    both = sentencepiece.decode_ids(sentencepiece.encode_texts(docs, path), path)
    return both.select("doc_id", F.size("ids").alias("n_ids"), F.xxhash64("ids").alias("ids_hash"),
                       F.col("decoded").eqNullSafe(F.col("text")).alias("round_trip"))


def op9_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with surrogates for personal data."""
    return pii.replace(table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "text"))


def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token files of all documents, written and read back."""
    docs = table(spark, sf_dir, "documents")
    folder = scratch_path(spark, f"llm-tokens-{uuid.uuid4().hex}")
    manifest = tokens.write_sequences(docs, folder, tokenizer_path("byte_bpe_50k.json"), end_id=2)
    return tokens.read_documents(manifest)


def misspelt(doc_id, words: list[str]) -> list[str]:
    """A document's words, a few of them (by a checksum) without one code point."""
    if doc_id is None:
        return words
    crc32 = zlib.crc32
    seed, out = crc32(f"{doc_id}:".encode()), []
    for word in words:
        h = crc32(word.encode(), seed)
        if h % 97 == 0:
            at = h % len(word)
            word = word[:at] + word[at + 1:]
        out.append(word)
    return out


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The words of all documents, under their most frequent spelling."""
    return variants.group(variants.count_words(table(spark, sf_dir, "documents"), misspelt))


def with_repeats(docs: DataFrame) -> DataFrame:
    """``doc_id, text``: every tenth text (by a checksum) repeats from some word on."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    words = F.when(h % 10 == 0, F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0)))
    split = docs.select("doc_id", "text", F.floor(h / 10).alias("g"), words.alias("words"))
    split = split.withColumn("n", F.size("words")).withColumn("a", F.when(F.col("n") > 0, F.col("g") % F.col("n")))
    split = split.withColumn("p", 1 + F.floor((F.col("n") - F.col("a")) / (3 + F.col("g") % 8)))
    place = lambda i: F.when(i < F.col("a"), i).otherwise(F.col("a") + (i - F.col("a")) % F.col("p"))
    text = F.array_join(F.transform(F.sequence(F.lit(0), F.col("n") - 1),
                                    lambda i: F.element_at("words", (place(i) + 1).cast("int"))), " ")
    return split.select("doc_id", F.when(F.col("n") > 0, text).otherwise(F.col("text")).alias("text"))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of words that repeat, and what stays of every document without the repeats."""
    found = periodic.detect(with_repeats(table(spark, sf_dir, "documents")))
    longest = F.array_min(F.transform("runs", lambda r: F.struct((-r["length"]).alias("m"), r["start"], r["period"])))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(
        F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")
    out = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), longest.alias("r"),
                       F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
    length, period = -F.col("r.m"), F.col("r.period")
    return out.select("doc_id", "n_runs", F.col("r.start").alias("start"), length.alias("length"), period.alias("period"),
                      F.floor(1000 * length / period).alias("exponent_milli"), "runs_sha256", "collapsed_sha256")


def op13_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every document."""
    found = secret_scan.find(table(spark, sf_dir, "documents"))
    of = lambda kind: F.size(F.filter("secrets", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("secrets", lambda x: x["kind"].isin("assign", "access", "hex"))
    return found.select("doc_id", of("assign"), of("access"), of("hex"), F.sha2(secret_scan.listed(base), 256).alias("base_sha256"),
                        secret_scan.listed("secrets").alias("spans"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages of the corpus pipeline over all documents."""
    import corpus_pipeline
    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {
    "pipeline": pipeline,
    "op1_quality_votes": op1_quality_votes,
    "op2_hilbert_ann": op2_hilbert_ann,
    "op3_cap_filters": op3_cap_filters,
    "op4_suffix_repeats": op4_suffix_repeats,
    "op5_ngram_jaccard": op5_ngram_jaccard,
    "op6_language_id": op6_language_id,
    "op7_source_mix": op7_source_mix,
    "op8_sentencepiece": op8_sentencepiece,
    "op9_pii_surrogates": op9_pii_surrogates,
    "op10_token_files": op10_token_files,
    "op11_spelling_variants": op11_spelling_variants,
    "op12_periodic_runs": op12_periodic_runs,
    "op13_secret_scan": op13_secret_scan,
}

SQL: dict[str, str] = {
    "op3_cap_filters": """
WITH RECURSIVE v AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings),
u AS (SELECT vec_id, label, e, sqrt(list_inner_product(e, e)) AS r FROM v),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON a.label = b.label AND a.vec_id <> b.vec_id
  WHERE list_inner_product(a.e, b.e) >= 0.93 * a.r * b.r),
r(vec_id, m) AS (SELECT vec_id, vec_id FROM v UNION SELECT l.b, r.m FROM r JOIN l ON l.a = r.vec_id),
c AS (SELECT vec_id, min(m) AS component_id FROM r GROUP BY 1),
n AS (SELECT a AS vec_id, count(*) AS n FROM l GROUP BY 1)
SELECT v.vec_id, coalesce(n.n, 0) AS n_links, c.component_id, v.vec_id = c.component_id AS kept
FROM v JOIN c USING (vec_id) LEFT JOIN n USING (vec_id)""",
    "op5_ngram_jaccard": r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
         'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
sh AS (
  SELECT DISTINCT doc_id, CASE WHEN len(ws) >= 4 THEN array_to_string(ws[i:i+3], ' ') ELSE array_to_string(ws, ' ') END AS s
  FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 2, 2))) AS i FROM w WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY 1),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
r(doc_id, m) AS (SELECT doc_id, doc_id FROM w UNION SELECT l.b, r.m FROM r JOIN l ON l.a = r.doc_id)
SELECT w.doc_id, coalesce(any_value(n.n), 0) AS n_shingles, min(r.m) AS component_id
FROM w LEFT JOIN n USING (doc_id) JOIN r ON r.doc_id = w.doc_id GROUP BY 1""",
    "op11_spelling_variants": """
WITH RECURSIVE t AS (
  SELECT list(c ORDER BY i) AS t FROM (SELECT i, list_reduce(range(8), lambda c, k:
    CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i) AS c FROM range(256) r(i))),
occ AS (
  SELECT doc_id, run, count(*) AS c FROM (
    SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                             '[a-zÀ-ÿ]+')) AS run FROM documents) GROUP BY 1, 2),
b AS (
  SELECT run, c, flatten(list_transform(string_split(doc_id::VARCHAR || ':' || run, ''), lambda x:
    CASE WHEN unicode(x) < 128 THEN [unicode(x)::BIGINT] ELSE [195, unicode(x)::BIGINT - 64] END)) AS b FROM occ),
h AS (
  SELECT run, c, xor(list_reduce(b, lambda a, x: xor(a >> 8, t.t[(xor(a, x) & 255) + 1]), 4294967295), 4294967295) AS h
  FROM b, t),
words AS (
  SELECT word, sum(c)::BIGINT AS n FROM (
    SELECT c, CASE WHEN h % 97 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word
    FROM h) WHERE length(word) >= 5 GROUP BY 1 HAVING sum(c) >= 3),
cut AS (SELECT word, i, substr(word, 1, i) || substr(word, i + 2) AS v FROM (SELECT word, unnest(range(length(word))) AS i FROM words)),
two AS (SELECT a.word AS a, b.word AS b FROM cut a JOIN cut b ON a.v = b.v AND a.i = b.i AND a.word <> b.word
  UNION SELECT a.word, b.word FROM cut a JOIN words b ON a.v = b.word
  UNION SELECT b.word, a.word FROM cut a JOIN words b ON a.v = b.word),
best AS (SELECT a, b, n, count(*) OVER (PARTITION BY a) AS k, row_number() OVER (PARTITION BY a ORDER BY n DESC, b) AS r
  FROM two JOIN words ON word = b),
form AS (SELECT w.word, CASE WHEN best.n >= 2 * w.n THEN b END AS form, w.n, coalesce(k, 0) AS n_near,
  CASE WHEN best.n >= 2 * w.n THEN best.n END AS form_n FROM words w LEFT JOIN best ON a = word AND r = 1),
walk(word, top) AS (SELECT word, word FROM words UNION ALL
  SELECT walk.word, form.form FROM walk JOIN form ON form.word = walk.top WHERE form.form IS NOT NULL)
SELECT form.word, form.form, walk.top AS root, form.n, form.n_near, form.form_n
FROM form JOIN walk USING (word) JOIN form last ON last.word = walk.top AND last.form IS NULL""",
    "op12_periodic_runs": r"""
WITH t AS (
  SELECT list(c ORDER BY i) AS t FROM (SELECT i, list_reduce(range(8), lambda c, k:
    CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i) AS c FROM range(256) r(i))),
h AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws,
    xor(list_reduce(list_transform(string_split(doc_id::VARCHAR, ''), lambda x: unicode(x)::BIGINT), lambda a, x:
      xor(a >> 8, t.t[(xor(a, x) & 255) + 1]), 4294967295), 4294967295) AS h FROM documents, t),
a AS (SELECT doc_id, ws, len(ws) AS n, h, h // 10 AS g, CASE WHEN len(ws) > 0 THEN (h // 10) % len(ws) ELSE 0 END AS a FROM h),
w AS (
  SELECT doc_id, n, CASE WHEN h % 10 = 0 AND n > 0 THEN list_transform(range(n), lambda i:
    ws[CASE WHEN i < a THEN i ELSE a + (i - a) % (1 + (n - a) // (3 + g % 8)) END + 1]) ELSE ws END AS ws FROM a),
k AS (SELECT doc_id, n, list_transform(ws, lambda x: hash(x)) AS k FROM w),
p AS (SELECT doc_id, n, k, unnest(range(1, n // 4 + 1)) AS p FROM k),
same AS (SELECT doc_id, p, unnest(list_filter(range(n - p), lambda i: k[i + 1] = k[i + p + 1])) AS i FROM p),
found AS (
  SELECT doc_id, p AS period, min(i) AS start, count(*) + p AS length FROM (
    SELECT doc_id, p, i, i - row_number() OVER (PARTITION BY doc_id, p ORDER BY i) AS island FROM same)
  GROUP BY doc_id, p, island HAVING count(*) + p >= greatest(6, 4 * p)),
runs AS (SELECT * FROM found f WHERE NOT EXISTS (SELECT 1 FROM found o WHERE o.doc_id = f.doc_id AND o.start = f.start
  AND o.length = f.length AND o.period < f.period AND f.period % o.period = 0)),
per AS (
  SELECT doc_id, count(*) AS n_runs, sha256(string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period)) AS s,
    min_by({'start': start, 'length': length, 'period': period}, (-length, start, period)) AS r FROM runs GROUP BY 1),
word AS (SELECT doc_id, unnest(range(n)) AS i, unnest(ws) AS word FROM w),
gone AS (SELECT DISTINCT doc_id, i FROM (SELECT doc_id, unnest(range(start + period, start + length)) AS i FROM runs)),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS kept FROM word ANTI JOIN gone USING (doc_id, i) GROUP BY 1)
SELECT w.doc_id, coalesce(n_runs, 0) AS n_runs, r.start AS start, r.length AS length, r.period AS period,
  1000 * r.length // r.period AS exponent_milli, coalesce(s, sha256('')) AS runs_sha256, sha256(coalesce(kept, '')) AS collapsed_sha256
FROM w LEFT JOIN per USING (doc_id) LEFT JOIN kept USING (doc_id)""",
}


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
