"""Importance resampling towards a target distribution of hashed n-grams (operator 13)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from clausewright.llm.staging import staged

#: Buckets of features, words of the longest feature, words of the shortest document that can be drawn, percent of these that are drawn.
BUCKETS, LONGEST, LEAST_WORDS, PERCENT = 10_000, 3, 20, 5
SEED = "42"
_CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: What stands between words once A-Z are small letters.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_PLACE_BITS = 33  # of monotonically_increasing_id, below the partition's number


def words(text: Column) -> Column:
    """The words of a text in order, A-Z lower-cased and no other letter; none for null."""
    lowered = F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(F.translate(text, _CAPITALS, _CAPITALS.lower()))
    return F.array_remove(F.split(lowered, BETWEEN), "")


def features(rows: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """``rows`` (keys, words) to their features: keys, at (place of the first word; null without words), k (words less one), bucket
    (null where there is no such run). The outer forms are used because for the plain ones Spark would test the arrays' sizes first, and so
    build them twice."""
    word, following = F.col("word"), [F.get("words", F.col("at") + k) for k in range(1, LONGEST)]
    runs = [F.concat(word, *(x for w in following[:k] for x in (F.lit(" "), w))) for k in range(LONGEST)]
    each = rows.select(*keys, "words", F.posexplode_outer("words").alias("at", "word"))
    grams = each.select(*keys, "at", F.posexplode_outer(F.array(*runs)).alias("k", "gram"))
    return grams.select(*keys, "at", "k", (F.crc32(F.col("gram").cast("binary")) % BUCKETS).cast("int").alias("bucket"))


def bucket_counts(texts: DataFrame) -> DataFrame:
    """``texts`` (text, any other columns) to bucket and n, the number of features in it; BUCKETS rows at most."""
    found = features(texts.select(words(F.col("text").cast("string")).alias("words")))
    return found.where("bucket is not null").groupBy("bucket").agg(F.count("*").alias("n"))


def gains(corpus: DataFrame, target: DataFrame) -> DataFrame:
    """A row for each bucket: how much likelier it is in ``target`` than in ``corpus`` (both bucket, n), as the floor of a thousand
    logarithms with one feature added to each bucket. BUCKETS rows, whatever the input."""
    sizes = [x.agg(F.coalesce(F.sum("n"), F.lit(0)).cast("double").alias(name)) for x, name in ((corpus, "all_s"), (target, "all_t"))]
    each = corpus.sparkSession.range(BUCKETS).select(F.col("id").cast("int").alias("bucket"))
    for x, name in ((corpus, "s"), (target, "t")):
        each = each.join(x.select("bucket", F.col("n").cast("double").alias(name)), "bucket", "left").fillna(0.0, [name])
    each = each.join(F.broadcast(sizes[0])).join(F.broadcast(sizes[1]))  # a single row each
    ratio = (F.col("t") + 1) * (F.col("all_s") + BUCKETS) / ((F.col("s") + 1) * (F.col("all_t") + BUCKETS))
    return each.select("bucket", F.floor(F.log(ratio) * 1000).alias("gain"))


def weighed(docs: DataFrame, gain: DataFrame, seed: str = SEED) -> DataFrame:
    """``docs`` (doc_id, text) to one row per row: doc_id, n_words, n_features, weight (the sum of its features' gains), score (weight
    and a Gumbel variate drawn by doc_id), copy (which of several equal rows, from 1).

    A document's features are summed where it is read, before anything is shuffled. Equal rows are weighed as one and dealt out again.
    """
    text = F.col("text").cast("string")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("hash"), F.xxhash64(F.lit("more"), text).alias("more"), words(text).alias("words"))
    keys = ("doc_id", "hash", "more")
    joined = features(rows, keys).join(F.broadcast(gain), "bucket", "left")
    a_word, a_row = (F.col("k") == 0) & F.col("bucket").isNotNull(), (F.col("k") == 0) & (F.coalesce("at", F.lit(0)) == 0)
    total = joined.groupBy(*keys).agg(F.count_if(a_row).alias("copies"), F.count_if(a_word).alias("n_words"), F.count("bucket").alias("n_features"), F.coalesce(F.sum("gain"), F.lit(0)).alias("weight"))
    drawn = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.col("doc_id").cast("string")).cast("binary"), 256), 1, 8), 16, 10).cast("double")
    luck = F.floor(F.log(-F.log((drawn + 0.5) / 4294967296.0)) * -1000)
    one = [F.expr(f"{name} div copies").alias(name) for name in ("n_words", "n_features", "weight")]
    each = total.select("doc_id", *one, F.explode(F.sequence(F.lit(1).cast("long"), "copies")).alias("copy"))
    return each.withColumn("score", F.col("weight") + luck)


def ranked(rows: DataFrame, order: list[Column]) -> DataFrame:
    """``rows`` with place (from 1) in the total ``order``. The rows are sorted by ranges and written; a row's place is its place in its range and
    the number of rows in the ranges before, of which there are as many as partitions."""
    table = staged(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id()), "ranges")
    part, within = F.shiftright("at", _PLACE_BITS), F.col("at").bitwiseAND((1 << _PLACE_BITS) - 1)
    sizes = table.groupBy(part.alias("part")).agg(F.count("*").alias("n"))
    before = sizes.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    return table.withColumn("part", part).join(F.broadcast(before), "part").withColumn("place", F.col("before") + within + 1).drop("part", "before", "at")


def resampled(docs: DataFrame, target: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS, seed: str = SEED) -> DataFrame:
    """``docs`` (doc_id, text, any other columns) resampled towards the distribution of ``target`` (text): one row per row, with
    doc_id, n_features, weight, score, and rank (from 1) for those that are drawn: the ``percent`` percent with the highest scores of
    those with ``least_words`` words or more, ties to the smaller doc_id. Without replacement, each draw follows exp(weight / 1000).

    1. A text's features are its runs of one to three words; CRC-32 modulo BUCKETS gives each a bucket.
    2. The features of all documents and of all target texts are counted by bucket, which makes BUCKETS rows at most.
    3. The gains, one for each bucket, are sent to the documents' features and summed by document.
    4. Scores are sorted by ranges; partition offsets turn places in them into ranks.

    Null and empty texts, and texts without a word, have no features and weight 0. A row without a doc_id is weighed, has no score and
    isn't drawn from. Rows that repeat a doc_id are documents of their own. With an empty ``target`` all weights follow the
    documents' own counts. Other columns are ignored.
    """
    gain = gains(staged(bucket_counts(docs), "buckets"), bucket_counts(target))
    rows = staged(weighed(docs, gain, seed), "weights")
    able = rows.where(F.col("doc_id").isNotNull() & (F.col("n_words") >= least_words))
    most = percent * able.count() // 100
    placed = ranked(able, [F.col("score").desc(), F.col("doc_id").asc(), F.col("copy").asc()])
    others = rows.where(F.col("doc_id").isNull() | (F.col("n_words") < least_words)).withColumn("place", F.lit(None).cast("long"))
    return placed.unionByName(others).select("doc_id", "n_features", "weight", "score", F.when(F.col("place") <= most, F.col("place")).alias("rank"))


def op13_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five percent of the documents, drawn towards the benchmark's texts."""
    docs, target = (spark.read.parquet(f"{sf_dir}/{name}.parquet").select(*columns) for name, columns in (("documents", ("doc_id", "text")), ("benchmark", ("text",))))
    return resampled(docs, target)


QUERIES = {"op13_importance_resampling": op13_importance_resampling}

ORACLES = {
    "op13_importance_resampling": r"""
WITH poly AS (SELECT list_transform(range(256), lambda n: list_reduce(list_prepend(n, range(8)), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t),
texts AS (SELECT 0 AS side, doc_id AS id, text FROM documents UNION ALL SELECT 1, item_id, text FROM benchmark),
w AS (SELECT side, id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM texts),
g AS (SELECT side, id, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]), list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]))) AS gram FROM w),
c AS (SELECT side, id, gram, count(*) AS n FROM g GROUP BY ALL),
h AS (SELECT gram, hex(gram) AS h FROM (SELECT DISTINCT gram FROM c)),
b AS (SELECT gram, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, length(h), 2), lambda i: ((instr('0123456789ABCDEF', h[i]) - 1) * 16 + instr('0123456789ABCDEF', h[i + 1]) - 1)::BIGINT)), lambda s, x: xor(s >> 8, poly.t[(xor(s, x) & 255) + 1])), 4294967295) % 10000 AS bucket FROM h, poly),
k AS (SELECT side, id, bucket, sum(n) AS n FROM c JOIN b ON b.gram = c.gram GROUP BY ALL),
counts AS (SELECT r.range AS bucket, coalesce(sum(n) FILTER (side = 0), 0)::DOUBLE AS s, coalesce(sum(n) FILTER (side = 1), 0)::DOUBLE AS t FROM range(10000) r LEFT JOIN k ON k.bucket = r.range GROUP BY 1),
gain AS (SELECT bucket, floor(1000 * ln((t + 1) * ((SELECT sum(s) FROM counts) + 10000) / ((s + 1) * ((SELECT sum(t) FROM counts) + 10000))))::BIGINT AS gain FROM counts),
sums AS (SELECT id, sum(n)::BIGINT AS n_features, sum(n * gain)::BIGINT AS weight FROM k JOIN gain ON gain.bucket = k.bucket WHERE side = 0 GROUP BY id),
scored AS (SELECT w.id AS doc_id, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight, len(w) AS n_words, coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || sha256('42:' || w.id)[:8])::BIGINT + 0.5) / 4294967296)))::BIGINT AS score FROM w LEFT JOIN sums ON sums.id = w.id WHERE side = 0),
placed AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS place, count(*) OVER () AS n FROM scored WHERE n_words >= 20)
SELECT s.doc_id, n_features, weight, score, CASE WHEN place <= 5 * n // 100 THEN place END AS rank FROM scored s LEFT JOIN placed p ON p.doc_id = s.doc_id
""",
}
