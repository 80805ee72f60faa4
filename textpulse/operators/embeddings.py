"""Word vectors: training, text vectors, nearest words."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.feature import Word2Vec, Word2VecModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textpulse.functions.vectors import as_doubles, cosine, dot, literal_vector, norm, unit
from textpulse.operators.joins import estimated_bytes
from textpulse.operators.terms import n_docs, smoothed_idf
from textpulse.operators.unnest import unnest
from textpulse.session import discard, importable, stage

VECTOR_SIZE = 200
#: Words whose vectors of the default size take about 2 GB.
MAX_WORDS = 1_000_000
MIN_CORPUS_TOKENS = 5
MIN_LSA_TOKENS = 10
#: Column with the number of a block of documents.
BLOCK = "__block"
#: Stored bytes of a block's token lists at most, on average, and tokens that a task adds up at a time.
BLOCK_BYTES, BLOCK_PLACES = 16 * 1024 * 1024, 500_000
#: Blocks per task slot whose words' vectors are dealt at a time.
WAVE_BLOCKS = 4
#: Whether a join takes only sides that are dealt by all its keys.
ALL_KEYS = "spark.sql.requireAllClusterKeysForCoPartition"


def longer_than(df: DataFrame, tokens: str, n: int) -> DataFrame:
    return df.where(F.size(tokens) > n)


def training_corpus(frames: list[DataFrame], tokens: str = "tokens", longer: int = MIN_CORPUS_TOKENS) -> DataFrame:
    """Union of the token lists longer than ``longer``."""
    corpus = frames[0].select(tokens)
    for frame in frames[1:]:
        corpus = corpus.unionByName(frame.select(tokens))
    return longer_than(corpus, tokens, longer)


def train_word_vectors(
    corpus: DataFrame, tokens: str = "tokens", size: int = VECTOR_SIZE, partitions: int = 1,
    min_count: int = 5, seed: int = 1, max_words: int = MAX_WORDS,
) -> Word2VecModel:
    """Spark's word2vec. The driver and every task hold all vectors while training, so more than ``max_words`` words of
    at least ``min_count`` occurrences are an error; ``skipgram.train_by_blocks`` and ``cooccurrence.pmi_vectors`` have no such limit."""
    counts = unnest(corpus, [], F.col(tokens), "word").groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    found = counts.where(F.col("n") >= min_count).count()
    if found > max_words:
        raise ValueError(f"{found} words are more than the {max_words} whose vectors the driver may hold")
    return Word2Vec(
        inputCol=tokens, outputCol="vector", vectorSize=size, numPartitions=partitions, minCount=min_count, seed=seed
    ).fit(corpus)


def word_table(model: Word2VecModel) -> DataFrame:
    """``(word, vector array<double>)``."""
    return model.getVectors().select("word", vector_to_array("vector").alias("vector"))


def text_vectors(
    postings: DataFrame, vectors: DataFrame, row_id: str, size: int,
    term: str = "term", weight: str = "tfidf", documents: DataFrame | None = None,
) -> DataFrame:
    """``(row_id, vector)``: weighted mean of the word vectors of a document's terms.

    Unknown words count neither in the sum nor in the weight; a weight of 0 gives the zero vector.
    Documents are dealt in blocks, and each block gets the vectors of its words once, see ``block_means``.
    ``documents`` holds the row ids to return; by default those of the postings.
    """
    table = vectors.select(F.col("word").alias(term), "vector")
    mine = in_blocks(postings.select(row_id, term, F.col(weight).cast("double").alias("w")), row_id).where(F.col("w") != 0)
    needed = mine.select(BLOCK, term).distinct().join(table, term)
    means = block_means(mine, needed, row_id, term, F.col("w"), size).select(row_id, "vector")
    every = postings.select(row_id).distinct() if documents is None else documents.select(row_id)
    return _with_zeros(every, means, row_id, size)


def tfidf_vectors(
    df: DataFrame, row_id: str, tokens: str, vectors: DataFrame, size: int, documents: DataFrame | None = None, waves: int | None = None
) -> DataFrame:
    """``(row_id, vector, l1)`` of each row of ``df``, or of ``documents``: the mean of its words' vectors weighed by
    smoothed TF-IDF, and the L1 norm of all its weights.

    The same as ``text_vectors`` of ``smoothed_tfidf``, but postings never leave their block of documents: document
    frequencies are summed from counts per block and word, which also tell who needs a word's weight and vector. A
    task goes through the tokens of one block, see ``_weigh_block``. Blocks get their words in ``waves`` of ``WAVE_BLOCKS``
    per task slot, so that disk holds the vectors of one wave and not those of all blocks; ``df`` is read once per wave.
    """
    spark = df.sparkSession
    importable(spark)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # The size of a stored table is known; for others it may be a guess far too high.
    blocks = max(parts, min(estimated_bytes(df) // BLOCK_BYTES, 64 * parts))
    waves = waves or -(-blocks // (WAVE_BLOCKS * spark.sparkContext.defaultParallelism))
    numbers = part_numbers(spark, blocks)
    dealt = in_blocks(df.select(row_id, F.col(tokens).alias("tokens")), row_id, blocks, numbers)
    cells = unnest(dealt, [BLOCK], F.array_distinct("tokens"), "term").groupBy(BLOCK, "term").agg(F.count(F.lit(1)).alias("n"))
    # A word has one entry per block at most.
    table = cells.groupBy("term").agg(F.sum("n").alias("df"), F.collect_list(BLOCK).alias("blocks"))
    table = table.select("term", "blocks", smoothed_idf("df", n_docs(df)).alias("idf"))
    # A number that is missing adds nothing.
    vector = F.when(F.col("vector").isNotNull(), F.array(*[F.expr(f"coalesce(CAST(vector[{i}] AS DOUBLE), 0D)") for i in range(size)]))
    known = table.join(vectors.select(F.col("word").alias("term"), vector.alias("vector")), "term", "left")
    known = stage(known, "term-vectors") if waves > 1 else known
    schema = T.StructType([df.schema[row_id], T.StructField("vector", T.ArrayType(T.DoubleType())), T.StructField("l1", T.DoubleType())])

    def weigh(documents: pa.Table, words: pa.Table) -> pa.Table:
        return _weigh_block(documents, words, row_id, size)

    means = None
    for w in range(waves):
        mine, places = dealt, F.col("blocks")
        if waves > 1:
            own = numbers[w::waves]
            # Told before the rows are dealt: by the row's id alone.
            mine = in_blocks(df.select(row_id, F.col(tokens).alias("tokens")), row_id, blocks, numbers, own)
            places = F.array_intersect(places, F.lit(own))
        needed = known.select(F.explode(places).alias(BLOCK), "term", "idf", "vector").repartition(blocks, BLOCK)
        found = stage(mine.groupBy(BLOCK).cogroup(needed.groupBy(BLOCK)).applyInArrow(weigh, schema), "means")
        means = found if means is None else means.unionByName(found)
    if waves > 1:
        discard(known)
    every = df if documents is None else documents
    return _with_zeros(every.select(row_id), means, row_id, size).withColumn("l1", F.coalesce("l1", F.lit(0.0)))


def _weigh_block(documents: pa.Table, words: pa.Table, row_id: str, size: int) -> pa.Table:
    """``(row_id, vector, l1)`` of the ids with a weight that is not 0, from the token lists of a block and the rows
    ``(term, idf, vector)`` of its words. Weights are frequencies times idf, so tokens are added up one by one."""
    ids = documents[row_id].combine_chunks().dictionary_encode()
    row = pc.fill_null(ids.indices, -1).to_numpy()  # a missing id meets none
    n = len(ids.dictionary)
    terms = words["term"].combine_chunks().dictionary_encode()
    word, m = terms.indices.to_numpy(), len(terms.dictionary)
    idf = words["idf"].to_numpy()
    known = pc.is_valid(words["vector"]).to_numpy() & (idf != 0)
    vectors = np.zeros((len(idf), size))
    vectors[pc.is_valid(words["vector"]).to_numpy()] = pc.list_flatten(words["vector"]).to_numpy().reshape(-1, size)
    # By term, which may have several vectors; a row's tokens stand together, so they are added up in order.
    table = np.stack([np.bincount(word, x, m) for x in (*(vectors * idf[:, None]).T, idf * known, known, np.abs(idf))], axis=1)
    out, at = np.zeros((n, size + 3)), 0
    for lists in documents["tokens"].chunks:
        lengths = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
        found = pc.fill_null(pc.index_in(lists.flatten(), terms.dictionary), -1).to_numpy()
        of = np.repeat(row[at : at + len(lists)], lengths)
        at += len(lists)
        held = (found >= 0) & (of >= 0)
        found, of = found[held], of[held]
        for i in range(0, len(of), BLOCK_PLACES):
            x, y = found[i : i + BLOCK_PLACES], of[i : i + BLOCK_PLACES]
            first = np.flatnonzero(np.r_[True, y[1:] != y[:-1]])
            np.add.at(out, y[first], np.add.reduceat(table[x], first, axis=0))
    out = out.T
    *sums, weight, n_known, l1 = out
    has_mean = (n_known > 0) & (weight != 0)
    means = np.divide(np.array(sums), weight, out=np.zeros((size, n)), where=has_mean).T
    kept = np.flatnonzero(l1 > 0)
    offsets = pa.array(np.arange(len(kept) + 1, dtype=np.int32) * size)
    vector = pa.ListArray.from_arrays(offsets, pa.array(means[kept].ravel()), mask=pa.array(~has_mean[kept]))
    return pa.table([ids.dictionary.take(pa.array(kept)), vector, pa.array(l1[kept])], names=[row_id, "vector", "l1"])


def part_numbers(spark: SparkSession, parts: int) -> list[int]:
    """A number for each of so many parts of a shuffle, the first whose hash leads to it. A part that no number leads to, if any, has none."""
    number = F.col("id").cast("int")
    tried = spark.range(parts * 32).groupBy(F.pmod(F.hash(number), F.lit(parts)).alias("part")).agg(F.min(number).alias("n"))
    return sorted(r["n"] for r in tried.collect())


def in_blocks(df: DataFrame, row_id: str, blocks: int | None = None, numbers: list[int] | None = None, own: list[int] | None = None) -> DataFrame:
    """``df`` dealt in as many blocks of whole documents as a shuffle has parts, one in each, with the block's number;
    or the documents of the blocks ``own`` of them."""
    parts = blocks or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    numbers = numbers or part_numbers(df.sparkSession, parts)
    # By place in the list: a part that no number leads to goes without rows.
    place = F.pmod(F.xxhash64(row_id), F.lit(len(numbers))).cast("int")
    dealt = df.withColumn(BLOCK, F.get(F.lit(numbers), place))
    return (dealt if own is None else dealt.where(F.col(BLOCK).isin(own))).repartition(parts, BLOCK)


def block_means(postings: DataFrame, needed: DataFrame, row_id: str, term: str, weight: Column, size: int) -> DataFrame:
    """``(row_id, vector, l1)`` from postings that lie in blocks and what each block needs: ``(block, term, ..., vector)``.

    Only ``needed`` is shuffled, a row per block and word, so what moves grows with the documents and not with them
    times the parts, as partial sums per document would. Both sides are dealt by the block alone, which serves the
    join as well as the sums; the means are stored.
    """
    spark = postings.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    met = postings.join(needed.repartition(parts, BLOCK), [BLOCK, term])
    met = met.select(BLOCK, row_id, weight.alias("w"), "vector")
    sums = [F.expr(f"sum(w * vector[{i}]) AS s{i}") for i in range(size)]
    known = F.sum(F.when(F.col("vector").isNotNull(), F.col("w"))).alias("known")
    found = met.where(F.col("w") != 0).groupBy(BLOCK, row_id).agg(*sums, known, F.sum(F.abs("w")).alias("l1"))
    means = F.array(*[F.try_divide(F.coalesce(f"s{i}", F.lit(0.0)), F.col("known")) for i in range(size)])
    # Else Spark would deal both sides anew, by block and word.
    before = spark.conf.get(ALL_KEYS)
    spark.conf.set(ALL_KEYS, "false")
    try:
        return stage(found.select(row_id, means.alias("vector"), "l1"), "means")
    finally:
        spark.conf.set(ALL_KEYS, before)


def _with_zeros(every: DataFrame, means: DataFrame, row_id: str, size: int) -> DataFrame:
    """Every row id; one without known weight gets the zero vector."""
    zero = F.array_repeat(F.lit(0.0), size)
    joined = every.join(means, row_id, "left")
    found = F.when(F.get("vector", F.lit(0)).isNotNull(), F.col("vector")).otherwise(zero)
    return joined.select(row_id, found.alias("vector"), *[c for c in means.columns if c == "l1"])


def vector_of(table: DataFrame, key: str, value, vector: str = "vector") -> Column:
    """The vector of one row as a literal; an unknown key raises."""
    found = table.where(F.col(key) == F.lit(value)).select(as_doubles(vector).alias("v")).take(1)
    if not found:
        raise KeyError(value)
    return literal_vector(found[0]["v"])


def nearest(table: DataFrame, key: str, query: Column, k: int = 10, vector: str = "vector") -> DataFrame:
    """``(key, similarity)`` of the ``k`` rows with the highest cosine to ``query``.

    The row a query vector came from is not left out.
    """
    scored = table.select(key, as_doubles(vector).alias("v")).select(key, cosine(F.col("v"), query).alias("similarity"))
    # Filtered after the limit, so that the similarity is worked out once per row.
    return scored.orderBy(F.desc_nulls_last("similarity"), key).limit(k).where(F.col("similarity").isNotNull())


def nearest_to_word(table: DataFrame, word: str, k: int = 10) -> DataFrame:
    """Nearest words of a word, the word itself left out."""
    return nearest(table.where(F.col("word") != word), "word", vector_of(table, "word", word), k)


def nearest_each(
    table: DataFrame, key: str, queries: DataFrame, query: str, k: int = 10, vector: str = "vector", digits: int | None = None
) -> DataFrame:
    """``(query, rank, key, similarity)``: for each row of ``queries(query, vector)`` the ``k`` rows of ``table`` with the
    highest cosine, in one scan of ``table``.

    The queries are one value, so there are to be some hundreds at most. A task keeps ``k`` rows per query before
    the shuffle (group limit). With ``digits`` similarities are rounded before they are ranked. Zero vectors drop out.
    """
    asked = queries.agg(F.collect_list(F.struct(F.col(query).alias("query"), unit(as_doubles("vector")).alias("u")))).scalar()
    rows = table.select(F.col(key).alias("key"), as_doubles(vector).alias("v")).withColumn("length", norm("v")).withColumn("asked", asked)
    scored = F.transform("asked", lambda q: F.struct(q["query"].alias("query"), F.try_divide(dot(F.col("v"), q["u"]), F.col("length")).alias("similarity")))
    pairs = rows.select("key", F.explode(scored).alias("pair")).select("key", "pair.query", "pair.similarity")
    pairs = pairs if digits is None else pairs.withColumn("similarity", F.round("similarity", digits))
    rank = F.row_number().over(W.partitionBy("query").orderBy(F.desc_nulls_last("similarity"), "key"))
    top = pairs.withColumn("rank", rank).where(F.col("rank") <= k).where(F.col("similarity").isNotNull())
    return top.select(F.col("query").alias(query), "rank", F.col("key").alias(key), "similarity")
