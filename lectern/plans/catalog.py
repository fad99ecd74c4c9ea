"""Registered queries (one per operator group of SURVEY 2) and their DuckDB
oracles.  Every query reads whole driver tables.

Floating-point outputs are rounded to 6 decimals on both sides; nested
results are compared as joined strings.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lectern.functions import text as TX
from lectern.functions.vectors import cosine_distance, sq_l2
from lectern.operators import adapt, encode, feedback as fb, knn, parse, retrieve, train
from lectern.operators.scan import small_table
from lectern.plans import standins as S
from lectern.session import scratch_path

R = 6  # decimals of every floating-point output


def _r(c, n=R):
    return F.round(c, n)


# ---------------------------------------------------------------------------
# A - sources and feedback store
# ---------------------------------------------------------------------------

def a1_text_file_books(spark, sf):
    """A1 end to end: the stand-in books are written as plain text files
    (one file per book, lines in order), read back with line numbers and
    parsed.  Must give the same verses as ``b_parse_verses``."""
    from lectern.sources import text_files
    path = scratch_path(spark, f"books-{uuid.uuid4().hex}")
    # Ranges of lines, several for a large book: part files are numbered in
    # range order, so a book's files follow each other in line order.
    lines = S.book_lines(spark, sf)
    (lines.repartitionByRange("file", "line_no").sortWithinPartitions("file", "line_no")
          .select("file", "raw").write.partitionBy("file").text(path))
    read = text_files.read_lines(spark, f"{path}/*/*.txt")
    # The book's file name is the partition folder name ``file=<name>``; its
    # line numbers go on from one part file to the next.
    name, part = F.regexp_extract("file", r"file=([^/]+)/[^/]*$", 1), F.regexp_extract("file", r"([^/]+)$", 1)
    read = read.select(name.alias("file"), part.alias("part"), "line_no", "raw")
    sizes = read.groupBy("file", "part").agg(F.max("line_no").alias("n"))
    before = Window.partitionBy("file").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = small_table(sizes.select("file", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before")), "parts")
    read = (read.join(sizes, ["file", "part"])
            .select("file", (F.col("before") + F.col("line_no")).alias("line_no"), "raw"))
    return parse.parse_verses(read).select("verse_id", "text", "source")


def a2_book_titles(spark, sf):
    # One file per source: the listing, not the book lines, gives the files.
    files = (S.table(spark, sf, "documents")
             .select(S.book_file().alias("file")).distinct())
    files = parse.with_titles(files)
    return files.select("file", "title", TX.first_token("title").alias("spec"))


def a8_feedback_scan(spark, sf):
    from lectern.sources import feedback_store
    path = scratch_path(spark, f"feedback-{uuid.uuid4().hex}")
    feedback_store.append(S.feedback(spark, sf), path)
    return feedback_store.read(spark, path)


def a7_feedback_append(spark, sf):
    """Requests stamped with the time and an id, appended and read back."""
    from lectern.sources import feedback_store
    path = scratch_path(spark, f"feedback-{uuid.uuid4().hex}")
    requests = S.feedback(spark, sf).select("query", "verse_id", "is_relevant")
    feedback_store.append(feedback_store.stamp(requests), path)
    now = feedback_store.utc_now(spark)
    return (feedback_store.read(spark, path)
            .withColumn("recent", F.abs(F.unix_timestamp(now) - F.unix_timestamp("timestamp")) < 3600)
            .groupBy("query", "verse_id", "is_relevant")
            .agg(F.count(F.lit(1)).alias("n"), F.countDistinct("fid").alias("n_ids"), F.min("recent").alias("recent")))


def a9_feedback_consume(spark, sf):
    store = S.feedback(spark, sf)
    used = fb.latest(store)
    return fb.consume(store, used, mode="used")


def a9_compacted_feedback(spark, sf):
    """Two appends, two runs that consume and two compactions, the
    files they folded removed; the store as the next reader sees it."""
    from lectern.sources import feedback_store
    path = scratch_path(spark, f"feedback-{uuid.uuid4().hex}")
    records = S.feedback(spark, sf)
    for run, (part, used) in enumerate((("fid % 2 = 0", "fid % 5 = 0"), ("fid % 2 <> 0", "fid % 7 = 0"))):
        feedback_store.append(records.filter(part), path)
        feedback_store.consume(feedback_store.read(spark, path).filter(used), path, f"run-{run}")
        feedback_store.compact(spark, path)
    feedback_store.vacuum(spark, path, grace=0.0)
    return feedback_store.read(spark, path)


def e11_two_publishers(spark, sf):
    """Two publishers that began on the same state each write the
    vectors under a scale of their own.  One publishes, the other is refused
    and its folder goes.  The rows are the vectors that readers get, summed."""
    from lectern.sources import index_store
    root = scratch_path(spark, f"index-{uuid.uuid4().hex}")
    vectors = S.table(spark, sf, "embeddings").select("vec_id", "embedding")
    seen = index_store.published(spark, root)
    refused = 0
    for scale in (2.0, 4.0):
        folder = index_store.new_folder("scaled")
        index_store.write_vectors(
            vectors.withColumn("embedding", F.transform("embedding", lambda x: x * F.lit(scale))), root, folder)
        try:
            index_store.publish_version(spark, root, "scaled", folder, seen)
        except index_store.Conflict:
            index_store.drop_folder(spark, root, folder)
            refused += 1
    left = index_store.vacuum(spark, root, grace=0.0)
    version = index_store.resolve_version(spark, root)
    total = F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x)
    return index_store.read_vectors(spark, root, version).select(
        "vec_id", F.lit(version).alias("version"), _r(total).alias("total"),
        F.lit(refused).cast("long").alias("refused"), F.lit(left).cast("long").alias("left_over"))


def e11_adapt_publish_consume(spark, sf):
    """The base index is built where it is
    missing, an adapted version is trained and published, and the feedback
    it was trained on is consumed.  Where none of the newest records names a
    verse, the version is published under a scale of ones.  The rows are the
    store as the next run reads it, with the version that readers resolve."""
    from lectern.plans import jobs
    from lectern.sources import feedback_store, index_store
    root = scratch_path(spark, f"index-{uuid.uuid4().hex}")
    store = f"{root}/feedback"
    verses = S.verses_with_repeated_ids(spark, sf).withColumn("source", F.lit("documents"))

    def build():
        jobs.publish_corpus(spark, encode.encode_hashed(verses, "text", 64), root)

    index_store.build_if_missing(spark, root, index_store.BASE_VERSION, build)
    index_store.build_if_missing(spark, root, index_store.BASE_VERSION, build)     # there already
    feedback_store.append(S.feedback(spark, sf), store)
    jobs.adapt_from_feedback(spark, root, store, "adapted-1", dim=64, steps=2, publish_unchanged=True)
    vectors, _, weights = jobs.current_index(spark, root, 64)
    n = vectors.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("embedding")).alias("dim")).first()
    return feedback_store.read(spark, store).select(
        "fid", F.lit(index_store.resolve_version(spark, root)).alias("version"),
        F.lit(n["n"]).cast("long").alias("n_vectors"), F.lit(n["dim"]).cast("long").alias("dim"),
        F.lit(0 if weights is None else len(weights)).cast("long").alias("n_weights"))


def a10_feedback_stream(spark, sf):
    from lectern.streaming import feedback_ingest
    out = scratch_path(spark, f"feedback-stream-{uuid.uuid4().hex}")
    feedback_ingest.ingest_events_once(spark, sf, out)
    return feedback_ingest.read_ingested(spark, out).select(
        "fid", "query", "verse_id", "is_relevant", "timestamp")


def a10_latest_stream(spark, sf):
    """The newest records kept by a stream; every third request is
    sent twice, and the query is started again when it has ended."""
    from lectern.streaming import feedback_ingest, latest_stream
    out = scratch_path(spark, f"latest-stream-{uuid.uuid4().hex}")
    raw = feedback_ingest.event_requests(spark, sf)
    sent = raw.unionByName(feedback_ingest.event_requests(spark, sf).filter("fid % 3 = 0"))
    for _ in range(2):
        feedback_ingest.finish(latest_stream.start_latest(
            feedback_ingest.validated_stream(sent), f"{out}/newest", f"{out}/checkpoint"))
    return latest_stream.read_latest(spark, f"{out}/newest")


def a11_feedback_validate(spark, sf):
    checked = fb.validate_records(S.raw_feedback(spark, sf))
    return checked.select("fid", "query", "verse_id", "is_relevant", "reason")


# ---------------------------------------------------------------------------
# B - parsing
# ---------------------------------------------------------------------------

def b2_line_kinds(spark, sf):
    kinds = parse.classify_lines(S.book_lines(spark, sf))
    return kinds.groupBy("file", "kind").agg(
        F.count(F.lit(1)).alias("n_lines"),
        F.sum(F.length("t")).cast("long").alias("n_chars"))


def b_parse_verses(spark, sf):
    return parse.parse_verses(S.book_lines(spark, sf)).select("verse_id", "text", "source")


def b9_roman_numerals(spark, sf):
    orders = S.table(spark, sf, "orders").select("o_orderkey")
    n = (F.col("o_orderkey") % 399 + 1).cast("int")
    hundreds = F.array(*[F.lit(x) for x in ["", "C", "CC", "CCC"]])
    tens = F.array(*[F.lit(x) for x in ["", "X", "XX", "XXX", "XL", "L", "LX", "LXX", "LXXX", "XC"]])
    units = F.array(*[F.lit(x) for x in ["", "I", "II", "III", "IV", "V", "VI", "VII", "VIII", "IX"]])
    numeral = F.concat(F.element_at(hundreds, (F.floor(n / 100) + 1).cast("int")),
                       F.element_at(tens, (F.floor(n / 10) % 10 + 1).cast("int")),
                       F.element_at(units, (n % 10 + 1).cast("int")))
    numeral = F.when(F.col("o_orderkey") % 2 == 0, F.lower(numeral)).otherwise(numeral)
    staged = orders.select("o_orderkey", numeral.alias("numeral"))
    return staged.select("o_orderkey", "numeral", TX.roman_to_int("numeral").alias("value"))


def b13_verses_per_book(spark, sf):
    # The file list is a cheap listing (one name per source), not a second
    # pass over the book lines.
    files = S.table(spark, sf, "documents").select(S.book_file().alias("file"))
    verses = parse.parse_verses(S.book_lines(spark, sf))
    return parse.verses_per_file(verses, files)


def b14_id_decomposition(spark, sf):
    return parse.decompose_ids(parse.parse_verses(S.book_lines(spark, sf)))


# ---------------------------------------------------------------------------
# C - encoding and index build
# ---------------------------------------------------------------------------

def c1_term_buckets(spark, sf):
    docs = S.table(spark, sf, "documents", spread=True)
    return encode.term_buckets(docs, "doc_id", "text").withColumnRenamed("id", "doc_id")


def _vector_summary(df, id_col):
    v = F.col("embedding")
    return df.select(
        id_col,
        F.size(F.filter(v, lambda x: x != 0)).cast("long").alias("n_nonzero"),
        _r(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double"))).alias("w_sum"),
        _r(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
        .alias("w_sq"))


def c1_encode_documents(spark, sf):
    docs = S.table(spark, sf, "documents", spread=True).select("doc_id", "text")
    return _vector_summary(encode.encode_hashed(docs, "text"), "doc_id")


def c1q_encode_queries(spark, sf):
    bench = S.table(spark, sf, "benchmark", spread=True).select("item_id", "text")
    return _vector_summary(encode.encode_hashed(bench, "text"), "item_id")


def c2_dimensions(spark, sf):
    emb = encode.dimension_check(S.vectors(spark, sf)).withColumn("source", F.lit("embeddings"))
    bench = encode.encode_hashed(S.table(spark, sf, "benchmark", spread=True), "text")
    enc = encode.dimension_check(bench).withColumn("source", F.lit("benchmark"))
    return emb.unionByName(enc)


def c3_vec_ids(spark, sf):
    verses = parse.parse_verses(S.book_lines(spark, sf))
    return encode.assign_vec_ids(verses).select("vec_id", "verse_id")


def c5_published_index(spark, sf):
    """Verses written and read back (required columns
    checked), index built and published under ``base``, then resolved and
    read back as a reader would."""
    from lectern.plans import jobs
    from lectern.sources import index_store
    root = scratch_path(spark, f"index-{uuid.uuid4().hex}")
    verses = parse.parse_verses(S.book_lines(spark, sf))
    index_store.write_verses(verses, f"{root}/verses")
    lines_back = index_store.read_verses(spark, f"{root}/verses")
    corpus = encode.encode_hashed(encode.assign_vec_ids(lines_back), "text")
    jobs.publish_corpus(spark, corpus, root, "base")
    vectors, meta, _ = jobs.current_index(spark, root)
    return meta.join(vectors, "vec_id").select(
        "vec_id", "verse_id", "source", F.size("embedding").cast("long").alias("dim"))


def c4c_current_version(spark, sf):
    from lectern.sources import index_store
    labels = S.table(spark, sf, "labels")
    versions = labels.select(F.col("doc_id").cast("string").alias("version"),
                             F.col("doc_id").alias("created"),
                             (F.col("quality") == 1).alias("published"))
    return index_store.current_version(versions)


# ---------------------------------------------------------------------------
# D - retrieval
# ---------------------------------------------------------------------------

def d1_squared_distance(spark, sf):
    e = S.vectors(spark, sf)
    n = e.count()
    a = e.select("vec_id", ((F.col("vec_id") * 7 + 1) % n).alias("partner_id"),
                 F.col("embedding").alias("a"))
    b = e.select(F.col("vec_id").alias("partner_id"), F.col("embedding").alias("b"))
    return a.join(b, "partner_id").select("vec_id", "partner_id", _r(sq_l2("a", "b")).alias("d2"))


def _centroid_query(e: DataFrame) -> DataFrame:
    dims = e.select(F.posexplode("embedding").alias("i", "x")).groupBy("i").agg(
        F.avg(F.col("x").cast("double")).alias("m"))
    return dims.agg(F.array_sort(F.collect_list(F.struct("i", "m"))).alias("c")).select(
        F.lit(0).cast("long").alias("qid"), F.transform("c", lambda s: s["m"]).alias("qvec"))


def d2_top_k_single(spark, sf):
    e = S.vectors(spark, sf)
    hits = knn.nearest(e, _centroid_query(e), k=retrieve.DEFAULT_K)
    return hits.select("qid", "rk", "vec_id", _r("d2").alias("d2"),
                       _r(1.0 / (1.0 + F.col("d2"))).alias("score"))


def _text_queries(spark, sf, queries):
    """``queries`` (qid, text), hashed to the vector length of ``embeddings``."""
    dim = encode.vector_dimension(S.vectors(spark, sf))
    return encode.encode_hashed(queries, "text", dim, out_col="qvec")


def _text_hits(spark, sf, queries, k=None, **options):
    return knn.nearest(S.vectors(spark, sf), _text_queries(spark, sf, queries), k=k, **options)


def _benchmark_queries(spark, sf):
    return S.table(spark, sf, "benchmark", spread=True).select(F.col("item_id").alias("qid"), "text")


def d3_batch_top_k(spark, sf):
    """Every turn of ``conversations`` as a query, in several blocks."""
    turns = S.table(spark, sf, "conversations", spread=True).select(
        (F.col("conv_id") * 100 + F.col("turn")).alias("qid"), "text")
    # A small bound (2,048 queries), the same at any size.
    hits = _text_hits(spark, sf, turns, 3, broadcast_cap=8 * 64 * 2048)
    return hits.select("qid", "rk", "vec_id", _r("d2").alias("d2"),
                       _r(1.0 / (1.0 + F.col("d2"))).alias("score"))


def d3_own_k(spark, sf):
    """Every query with a k of its own: a few of 1 to 7, one in 50 of 300."""
    k = F.when(F.col("qid") % 50 == 0, 300).otherwise(1 + F.col("qid") % 7)
    hits = _text_hits(spark, sf, _benchmark_queries(spark, sf).withColumn("k", k), k_col="k")
    return hits.select("qid", "rk", "vec_id", _r("d2").alias("d2"))


def c3_grown_index(spark, sf):
    """An index built from a third of ``embeddings``, grown by
    the rest in two steps, searched, compacted and searched again."""
    from lectern.sources import cluster_index as ci
    root = scratch_path(spark, f"clusters-{uuid.uuid4().hex}")
    e = S.vectors(spark, sf).select("vec_id", "embedding")
    third = lambda k: e.filter(F.pmod("vec_id", F.lit(3)) == k)
    queries = _text_queries(spark, sf, _benchmark_queries(spark, sf))
    ci.build(third(0), root)
    ci.add(third(1), root)
    ci.add(third(2), root)
    grown, _ = ci.search(spark, root, queries, k=4)
    ci.compact(spark, root)
    compacted, _ = ci.search(spark, root, queries, k=4)
    rows = lambda hits, name: hits.select(F.lit(name).alias("index"), "qid", "rk", "vec_id", _r("d2").alias("d2"))
    return rows(grown, "grown").unionByName(rows(compacted, "compacted"))


def d3_text_queries_top_k(spark, sf):
    """``benchmark`` texts, hashed to the vector length of ``embeddings``,
    retrieve their 10 nearest vectors."""
    hits = _text_hits(spark, sf, _benchmark_queries(spark, sf), retrieve.MAX_K)
    return hits.select("qid", "rk", "vec_id", _r("d2").alias("d2"))


def _scored(spark, sf):
    hits = _text_hits(spark, sf, _benchmark_queries(spark, sf), 3)
    return retrieve.attach_metadata(hits, S.labelled_metadata(spark, sf))


def d5_metadata_hits(spark, sf):
    s = _scored(spark, sf)
    return s.select("qid", "rk", "vec_id", "verse_id", "verse", "source", _r("score").alias("score"))


def d6_dropped_hits(spark, sf):
    hits = _text_hits(spark, sf, _benchmark_queries(spark, sf), 3)
    dropped = retrieve.dropped_hits(hits, S.labelled_metadata(spark, sf))
    return dropped.groupBy("qid").agg(F.count(F.lit(1)).alias("n_dropped"))


def _conversation_queries(spark, sf):
    conv = S.table(spark, sf, "conversations")
    return conv.select(
        (F.col("conv_id") * 100 + F.col("turn")).alias("qid"),
        F.when(F.col("conv_id") % 7 == 0, F.lit(" \t\n ")).otherwise(F.col("text")).alias("query"),
        F.when(F.col("turn") == 7, F.lit(None)).otherwise(F.col("turn") * 2).cast("int").alias("k"))


def d7_query_validation(spark, sf):
    q = _conversation_queries(spark, sf)
    retr = retrieve.validate_queries(q, check_k=True)
    ans = retrieve.validate_queries(q, check_k=False).select(
        "qid", F.col("reason").alias("answer_reason"))
    return retr.select("qid", "k", "reason").join(ans, "qid")


def _nested(spark, sf, keep_ids=False):
    queries = S.table(spark, sf, "benchmark").select(
        F.col("item_id").alias("qid"), F.concat(F.lit("q"), F.col("item_id").cast("string")).alias("query"))
    return retrieve.nest_results(queries, _scored(spark, sf), keep_verse_id=keep_ids)


def d8_response_rows(spark, sf):
    return retrieve.response_rows(_scored(spark, sf)).withColumn("score", _r("score"))


def d9_nested_results(spark, sf):
    n = _nested(spark, sf)
    return n.select(
        "qid", "query", F.size("results").cast("long").alias("n_results"),
        F.array_join(F.transform("results", lambda h: h["source"]), "|").alias("sources"),
        _r(F.aggregate("results", F.lit(0.0), lambda s, h: s + h["score"])).alias("score_sum"))


def d10_context(spark, sf):
    n = _nested(spark, sf)
    return n.select("qid", retrieve.context_text("results").alias("context"))


def d11_prompt(spark, sf):
    a = retrieve.answer_rows(_nested(spark, sf, keep_ids=True))
    return a.select("qid", "query",
                    F.array_join(F.transform("context", lambda h: h["verse_id"]), "|").alias("verse_ids"),
                    F.col("prompt")[0]["content"].alias("system_msg"),
                    F.col("prompt")[1]["content"].alias("user_msg"))


def d12_listing(spark, sf):
    return retrieve.formatted_listing(_scored(spark, sf))


def t_text_retrieval(spark, sf):
    """End to end: books from documents -> verses -> hashed vectors ->
    benchmark texts as queries (k = 5) -> hits with metadata."""
    from lectern.plans import jobs
    return jobs.text_retrieval(spark, sf).select(
        "qid", "rk", "verse_id", "source", _r("score").alias("score"))


def t_answer_batch(spark, sf):
    """End to end with request semantics: ``conversations`` turns are the
    requests (per-request k, some blank, some out of range); valid ones are
    answered from the verses of the stand-in books."""
    from lectern.plans import jobs
    corpus = jobs.corpus_from_lines(S.book_lines(spark, sf))
    requests = _conversation_queries(spark, sf)
    out = jobs.answer_batch(corpus.select("vec_id", "embedding"),
                                corpus.select("vec_id", "verse_id", "text", "source"),
                                requests)
    rows = lambda name, hits: out[name].select(
        "qid", F.lit(name).alias("kind"), F.lit(None).cast("string").alias("reason"),
        F.size(hits).cast("long").alias("n_results"),
        F.array_join(F.transform(hits, lambda h: h["source"]), "|").alias("sources"),
        _r(F.aggregate(hits, F.lit(0.0), lambda a, h: a + h["score"])).alias("score_sum"))
    refused = lambda name, kind: out[name].select(
        "qid", F.lit(kind).alias("kind"), "reason", F.lit(0).cast("long").alias("n_results"),
        F.lit("").alias("sources"), F.lit(0.0).alias("score_sum"))
    return (rows("responses", "results").unionByName(rows("answers", "context"))
            .unionByName(refused("rejected", "responses")).unionByName(refused("rejected_answers", "answers")))


# ---------------------------------------------------------------------------
# E - feedback and training
# ---------------------------------------------------------------------------

def e1_latest_feedback(spark, sf):
    return fb.latest(S.feedback(spark, sf))


def e3_split(spark, sf):
    pos, neg = fb.split_by_relevance(fb.latest(S.feedback(spark, sf)))
    return (pos.withColumn("side", F.lit("positive"))
               .unionByName(neg.withColumn("side", F.lit("negative")))
               .select("fid", "query", "verse_id", "side"))


def _pairs(spark, sf):
    return fb.labelled_pairs(fb.latest(S.feedback(spark, sf)),
                             S.verses_with_repeated_ids(spark, sf))


def e4_training_pairs(spark, sf):
    return _pairs(spark, sf).withColumn("ord", F.col("ord").cast("long"))


def e4_missing_ids(spark, sf):
    recent = fb.latest(S.feedback(spark, sf))
    missing = fb.missing_ids(recent, S.verses_with_repeated_ids(spark, sf))
    return missing.agg(F.count(F.lit(1)).alias("n_missing"))


def e6_guards(spark, sf):
    return fb.guard_counts(fb.latest(S.feedback(spark, sf)))


def e7_batches(spark, sf):
    return adapt.batches(_pairs(spark, sf)).select("fid", "batch")


def e8_schedule(spark, sf):
    return adapt.schedule(_pairs(spark, sf)).withColumn("epochs", F.col("epochs").cast("long"))


def _vector_pairs(spark, sf):
    e = S.vectors(spark, sf)
    n = e.count()
    a = e.select("vec_id", ((F.col("vec_id") * 7 + 1) % n).alias("partner_id"),
                 F.col("embedding").alias("a"), F.col("label").alias("la"))
    b = e.select(F.col("vec_id").alias("partner_id"), F.col("embedding").alias("b"),
                 F.col("label").alias("lb"))
    return a.join(b, "partner_id").withColumn(
        "label", (F.col("la") == F.col("lb")).cast("double"))


def e9_contrastive_loss(spark, sf):
    out = adapt.contrastive_loss(_vector_pairs(spark, sf))
    return out.select(F.col("n_pairs").cast("long"), _r("loss").alias("loss"),
                      _r("mean_distance").alias("mean_distance"))


def e10_adapt_weights(spark, sf):
    """Weights after one gradient step, and the loss before and after it."""
    pairs = _vector_pairs(spark, sf)
    dim = encode.vector_dimension(S.vectors(spark, sf))
    w, losses = adapt.fit_scale(pairs, dim, steps=1)
    return adapt.weights_table(spark, w, "adapted").select(
        "dim", _r("weight").alias("weight"), _r(F.lit(losses[0])).alias("loss_before"))


def e10_minibatch_fit(spark, sf):
    """One epoch in 16 mini-batches.  Every step's batch, size and
    rate, the batch's loss under the encoder that training starts from, and
    whether the map that came out has a lower loss over all pairs."""
    pairs = small_table(_vector_pairs(spark, sf).select(F.col("vec_id").alias("fid"), "a", "b", "label"), "pairs")
    dim = encode.vector_dimension(S.vectors(spark, sf))
    size = max(adapt.BATCH_SIZE, -(-pairs.count() // 16))
    learned, log = train.fit_metric(pairs, dim, batch_size=size)
    better = train.mean_loss(pairs, learned) < train.mean_loss(pairs, train.Metric.start(dim))
    before = adapt.contrastive_loss(adapt.numbered_batches(pairs, "fid", size), group_cols=["batch"])
    steps = spark.createDataFrame([(s["batch"], s["n_pairs"], s["rate"]) for s in log], "batch LONG, n_pairs LONG, rate DOUBLE")
    return steps.join(before.select("batch", _r("loss").alias("loss_before")), "batch").select(
        "batch", "n_pairs", _r("rate").alias("rate"), "loss_before", F.lit(better).alias("better"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "a1_text_file_books": a1_text_file_books,
    "a2_book_titles": a2_book_titles,
    "a7_feedback_append": a7_feedback_append,
    "a8_feedback_scan": a8_feedback_scan,
    "a9_feedback_consume": a9_feedback_consume,
    "a9_compacted_feedback": a9_compacted_feedback,
    "a10_feedback_stream": a10_feedback_stream,
    "a10_latest_stream": a10_latest_stream,
    "a11_feedback_validate": a11_feedback_validate,
    "b2_line_kinds": b2_line_kinds,
    "b_parse_verses": b_parse_verses,
    "b9_roman_numerals": b9_roman_numerals,
    "b13_verses_per_book": b13_verses_per_book,
    "b14_id_decomposition": b14_id_decomposition,
    "c1_term_buckets": c1_term_buckets,
    "c1_encode_documents": c1_encode_documents,
    "c1q_encode_queries": c1q_encode_queries,
    "c2_dimensions": c2_dimensions,
    "c3_vec_ids": c3_vec_ids,
    "c4c_current_version": c4c_current_version,
    "c5_published_index": c5_published_index,
    "d1_squared_distance": d1_squared_distance,
    "d2_top_k_single": d2_top_k_single,
    "d3_batch_top_k": d3_batch_top_k,
    "d3_text_queries_top_k": d3_text_queries_top_k,
    "d3_own_k": d3_own_k,
    "c3_grown_index": c3_grown_index,
    "d5_metadata_hits": d5_metadata_hits,
    "d6_dropped_hits": d6_dropped_hits,
    "d7_query_validation": d7_query_validation,
    "d8_response_rows": d8_response_rows,
    "d9_nested_results": d9_nested_results,
    "d10_context": d10_context,
    "d11_prompt": d11_prompt,
    "d12_listing": d12_listing,
    "t_text_retrieval": t_text_retrieval,
    "t_answer_batch": t_answer_batch,
    "e1_latest_feedback": e1_latest_feedback,
    "e3_split": e3_split,
    "e4_training_pairs": e4_training_pairs,
    "e4_missing_ids": e4_missing_ids,
    "e6_guards": e6_guards,
    "e7_batches": e7_batches,
    "e8_schedule": e8_schedule,
    "e9_contrastive_loss": e9_contrastive_loss,
    "e10_adapt_weights": e10_adapt_weights,
    "e10_minibatch_fit": e10_minibatch_fit,
    "e11_adapt_publish_consume": e11_adapt_publish_consume,
    "e11_two_publishers": e11_two_publishers,
}
