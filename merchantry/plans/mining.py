"""Text functions, word mining, vectors, groups and events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from merchantry.functions import codecs, numbers, times, urls
from merchantry.functions import text as tx
from merchantry.operators import phrases, vectors, words
from merchantry.session import cut, new_folder, spread
from merchantry.sources.tables import table
from merchantry.streaming import incremental, keyed


def _documents(spark: SparkSession, sf: str) -> DataFrame:
    return spread(table(spark, sf, "documents"))


def strip_punct(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", tx.strip_marks(F.col("text")).alias("stripped"))


def tokenise(spark: SparkSession, sf: str) -> DataFrame:
    tokens = tx.tokenise(F.col("text"))
    return table(spark, sf, "documents").select("doc_id", F.size(tokens).alias("n_tokens"), F.md5(F.array_join(tokens, "|").cast("binary")).alias("digest"))


def capitalised(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "part").select("p_partkey", tx.capitalise(F.concat_ws("_", "p_name", F.lower("p_brand"))).alias("shown"), tx.clean(F.concat("p_brand", F.lit("-"), "p_name")).alias("cleaned"))


def salted_hashes(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "customer").select("c_custkey", codecs.salted_hash(F.col("c_name"), F.lit("pepper")).alias("hashed"))


def hour_marks(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").select("event_id", times.hour_mark(F.col("ts")).alias("mark"))


def url_parts(spark: SparkSession, sf: str) -> DataFrame:
    url = F.col("url")
    return table(spark, sf, "pages").select("page_id", urls.host(url).alias("host"), urls.query_value(url, "page").alias("page"))


def ngram_freq(spark: SparkSession, sf: str) -> DataFrame:
    freq = words.frequencies(_documents(spark, sf), tx.token_stream(F.col("text")), 3, least=20)
    return freq.select("word", "len", "freq", F.round("prob", 10).alias("prob"))


def neighbour_entropy(spark: SparkSession, sf: str) -> DataFrame:
    both = words.entropies(_documents(spark, sf), tx.token_stream(F.col("text")), 2, least=50)
    return both.select("word", F.round("entropy_left", 6).alias("entropy_left"), F.round("entropy_right", 6).alias("entropy_right"))


def word_accept(spark: SparkSession, sf: str) -> DataFrame:
    found = words.discover(_documents(spark, sf), tx.token_stream(F.col("text")), longest=3, ratio=3, freq=10, single_freq=300, least_entropy=1.0)
    return found.select("word", "freq", F.round("prob", 10).alias("prob"), F.round("entropy", 6).alias("entropy"))


def ngram_freq_all(spark: SparkSession, sf: str) -> DataFrame:
    """Runs of up to 5 tokens, all of them, as the source counts."""
    freq = words.frequencies(_documents(spark, sf), tx.token_stream(F.col("text")), 5)
    return freq.select("word", "len", "freq", F.round("prob", 10).alias("prob"))


def neighbour_entropy_all(spark: SparkSession, sf: str) -> DataFrame:
    both = words.entropies(_documents(spark, sf), tx.token_stream(F.col("text")), 5)
    return both.select("word", F.round("entropy_left", 6).alias("entropy_left"), F.round("entropy_right", 6).alias("entropy_right"))


def word_accept_all(spark: SparkSession, sf: str) -> DataFrame:
    """Words of up to 5 tokens under the source's thresholds, which are the defaults."""
    found = words.discover(_documents(spark, sf), tx.token_stream(F.col("text")))
    return found.select("word", "freq", F.round("prob", 10).alias("prob"), F.round("entropy", 6).alias("entropy"))


def vector_topk(spark: SparkSession, sf: str) -> DataFrame:
    return vectors.top_terms(_documents(spark, sf), "doc_id", tx.token_stream(F.col("text")), 20)


def _cosines(spark: SparkSession, sf: str, least: float) -> DataFrame:
    found = vectors.similar_counts(_documents(spark, sf), "doc_id", tx.token_stream(F.col("text")), F.col("doc_id") % 100 == 0, least)
    return found.select("query", "doc_id", F.round("cosine", 6).alias("cosine"))


def cosine_sparse(spark: SparkSession, sf: str) -> DataFrame:
    """Every hundredth document against all, by counts of all terms, from a high cosine on."""
    return _cosines(spark, sf, 0.8)


def cosine_sparse_all(spark: SparkSession, sf: str) -> DataFrame:
    """The same from a low cosine on, which a third of all pairs has."""
    return _cosines(spark, sf, 0.3)


def cosine_dense(spark: SparkSession, sf: str) -> DataFrame:
    """Each vector with the first vector of its label; the build side is one row a label."""
    rows = table(spark, sf, "embeddings")
    firsts = rows.groupBy("label").agg(F.min_by("embedding", "vec_id").alias("lead"))
    return rows.join(firsts, "label").select("vec_id", F.round(numbers.dense_cosine(F.col("embedding"), F.col("lead")), 5).alias("cosine"))


def part_items(spark: SparkSession, sf: str) -> DataFrame:
    """Parts as items to group: category, item, price, and the vector of the name's words (T14), brands as terms."""
    parts = table(spark, sf, "part")
    segments = parts.select("p_partkey", F.explode(tx.tokenise(F.lower("p_name"))).alias("segment"))
    known = segments.groupBy(F.col("segment").alias("word")).agg(F.count(F.lit(1)).alias("freq"))
    banned = parts.where("p_size = 1").select(F.substring_index(F.lower("p_name"), " ", 1).alias("word")).distinct().where("word < 'c'")
    brands = parts.select("p_partkey", F.col("p_brand").alias("term"))
    terms = vectors.item_vectors(segments, known, banned, brands, "p_partkey")
    own = terms.groupBy("p_partkey").agg(F.array_sort(F.collect_list(F.struct("term", "weight"))).alias("v"))
    named = parts.join(own, "p_partkey")
    return named.select(F.col("p_type").alias("category"), F.col("p_partkey").alias("item"), F.col("p_retailprice").alias("price"), F.col("v.term").alias("terms"), F.col("v.weight").alias("weights"))


def leader_groups(spark: SparkSession, sf: str) -> DataFrame:
    """Groups of parts in keyed state: items arrive in three deliveries, in order, and the stream is started on each."""
    folder, items = new_folder(spark, "groups"), cut(part_items(spark, sf))
    low, high = items.agg(F.min("item"), F.max("item")).first()
    for k in range(3):
        items.where(F.floor((F.col("item") - low) * 3 / (high - low + 1)) == k).write.mode("append").parquet(f"{folder}/in")
        source = incremental.files(spark, f"{folder}/in", items.schema, per_batch=1_000_000)
        found = keyed.leader_group_stream(source, f"{folder}/out", f"{folder}/checkpoint")
    return found


def _mined(spark: SparkSession, sf: str) -> DataFrame:
    """word and freq of the pairs of tokens that stand 30 times or more."""
    found = words.frequencies(_documents(spark, sf), tx.token_stream(F.col("text")), 2, least=30)
    return cut(found.where("len = 2").select("word", "freq"))


def clean_title(spark: SparkSession, sf: str) -> DataFrame:
    """Whole texts without the phrases of a mined blacklist."""
    return phrases.cleaned(_documents(spark, sf), "doc_id", "text", _mined(spark, sf)).withColumnRenamed("cleaned", "title")


def extract_brand(spark: SparkSession, sf: str) -> DataFrame:
    """Brands named in part names, and the one chosen."""
    brands = table(spark, sf, "part").select(F.col("p_brand").alias("word")).distinct().withColumn("freq", F.octet_length("word"))
    rows = table(spark, sf, "part").select("p_partkey", phrases.plain_tokens(F.concat_ws(" ", "p_name", "p_brand", F.lit("new"))).alias("tokens"))
    found = phrases.extracted(cut(rows), "p_partkey", brands)
    return found.select("p_partkey", F.array_join("found", ",").alias("brands"), tx.choose_brand(F.col("found")).alias("brand"))


def extract_phrases(spark: SparkSession, sf: str) -> DataFrame:
    """The mined pairs that a search of each whole text comes to."""
    rows = _documents(spark, sf).select("doc_id", phrases.plain_tokens(F.col("text")).alias("tokens"))
    found = phrases.extracted(rows, "doc_id", _mined(spark, sf))
    return found.select("doc_id", F.size("found").alias("n_found"), F.md5(F.array_join("found", ",").cast("binary")).alias("digest"))


def segment_texts(spark: SparkSession, sf: str) -> DataFrame:
    """Whole texts split into mined words of one to three tokens."""
    docs = _documents(spark, sf)
    mined = words.frequencies(docs, tx.token_stream(F.col("text")), 3, least=30).select("word", "freq")
    rows = docs.where("text is not null").select("doc_id", tx.tokenise(F.col("text")).alias("tokens"))
    found = phrases.segmented(rows, "doc_id", cut(mined))
    return found.select("doc_id", F.size("segments").alias("n_segments"), F.md5(F.array_join("segments", "|").cast("binary")).alias("digest"))


def dictionary_filter(spark: SparkSession, sf: str) -> DataFrame:
    """Tokens of part names that no dictionary entry bans, as an anti-join: exact segments need no trie."""
    rows = table(spark, sf, "part").select("p_partkey", F.posexplode(F.split("p_name", " ")).alias("pos", "segment"))
    banned = table(spark, sf, "part").where("p_size = 1").select(F.substring_index("p_name", " ", 1).alias("segment")).distinct().where("segment < 'm'")
    left = rows.join(banned, "segment", "left_anti").groupBy("p_partkey").agg(F.array_sort(F.collect_list(F.struct("pos", "segment"))).alias("s"))
    return left.select("p_partkey", F.array_join(F.transform("s", lambda s: s["segment"]), " ").alias("kept"))


def event_windows(spark: SparkSession, sf: str) -> DataFrame:
    events = table(spark, sf, "events").withColumn("t", F.col("ts").cast("timestamp"))
    grouped = events.groupBy(F.window("t", "1 day").alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return grouped.select(F.date_format("w.start", "yyyy-MM-dd").alias("day"), "event_type", "n", "total")


QUERIES = {
    f.__name__: f
    for f in (
        strip_punct, tokenise, capitalised, salted_hashes, hour_marks, url_parts, ngram_freq, neighbour_entropy, word_accept,
        ngram_freq_all, neighbour_entropy_all, word_accept_all,
        vector_topk, cosine_sparse, cosine_sparse_all, cosine_dense, leader_groups, clean_title, extract_brand, extract_phrases, segment_texts,
        dictionary_filter, event_windows,
    )
}

_TOKENS = r"SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}][-\p{L}\p{N}_+]*|[^\s\p{P}\p{S}]') AS t FROM documents"


def _grams(longest: int) -> str:
    return f"""tok AS ({_TOKENS}), pos AS (SELECT t, unnest(range(1, len(t) + 1)) AS i FROM tok),
        g AS (SELECT array_to_string(t[i:i + k - 1], ' ') AS word, CAST(k AS INTEGER) AS len,
                     CASE WHEN i > 1 THEN t[i - 1] END AS l, t[i + k] AS r
              FROM pos, range(1, {longest + 1}) AS ks(k) WHERE i + k - 1 <= len(t))"""


def _found(titles: str, key: str, names: str) -> str:
    """x: key and found, of titles (key, s) and names (word, freq)."""
    tokens = r"list_filter(regexp_extract_all(lower({}), '[\p{{L}}\p{{N}}]+|[^ ]'), lambda w: regexp_matches(w, '^[\p{{L}}\p{{N}}_]'))"
    return f"""names AS ({names}), p AS (SELECT word, freq, {tokens.format('word')} AS ws FROM names),
        d AS (SELECT {key}, {tokens.format('s')} AS t FROM ({titles}) titles),
        k AS (SELECT DISTINCT len(ws) AS n FROM p WHERE len(ws) > 0),
        h AS (SELECT {key}, i, max(n) AS n FROM (SELECT {key}, i, n, t[i:i + n - 1] AS ws FROM (SELECT *, unnest(range(1, len(t) + 1)) AS i FROM d), k
              WHERE i + n - 1 <= len(t)) JOIN (SELECT DISTINCT ws FROM p) USING (ws) GROUP BY ALL),
        f AS (SELECT {key}, unnest(list_reduce(list_prepend([0], list([i, n] ORDER BY i)), lambda a, x:
              if(x[1] >= a[1], list_concat([x[1] + x[2]], list_append(a[2:], x[1])), a))[2:]) AS i FROM h GROUP BY {key}),
        u AS (SELECT DISTINCT {key}, word, freq FROM f JOIN h USING ({key}, i) JOIN d USING ({key}) JOIN p ON p.ws = t[i:i + n - 1]),
        x AS (SELECT {key}, list(word ORDER BY freq DESC, word COLLATE C) AS found FROM u GROUP BY {key})"""


_ENTROPY = """SELECT word, -sum(CASE WHEN {s} IS NOT NULL THEN n / m * ln(n / m) ELSE {e} END) AS h FROM (
    SELECT word, {s}, CAST(count(*) AS DOUBLE) AS n, CAST(sum(CASE WHEN {c} THEN count(*) END) OVER (PARTITION BY word) AS DOUBLE) AS m
    FROM g GROUP BY word, {s}) x GROUP BY word"""

def _cosine_sql(least: float) -> str:
    return f"""WITH v AS (SELECT doc_id, term, CAST(count(*) AS DOUBLE) AS w
            FROM (SELECT doc_id, unnest(t) AS term FROM ({_TOKENS}) x) y GROUP BY ALL),
        n AS (SELECT doc_id, sqrt(sum(w * w)) AS n FROM v GROUP BY doc_id),
        d AS (SELECT q.doc_id AS query, v.doc_id, sum(q.w * v.w) AS dot FROM v JOIN v q ON v.term = q.term AND q.doc_id % 100 = 0
              AND v.doc_id <> q.doc_id GROUP BY ALL)
        SELECT query, d.doc_id, round(dot / (a.n * b.n), 6) AS cosine FROM d JOIN n a ON a.doc_id = d.query JOIN n b ON b.doc_id = d.doc_id
        WHERE dot / (a.n * b.n) >= {least}"""


SQL = {
    # RE2 has no class intersection: the ASCII marks that are not kept, and no others occur in these texts.
    "strip_punct": r"""SELECT doc_id, regexp_replace(text, '["#$%()*,/:;<=>?\[\\\]^{|}~]', ' ', 'g') AS stripped FROM documents""",
    "tokenise": r"""
        SELECT doc_id, CAST(len(t) AS INTEGER) AS n_tokens, md5(array_to_string(t, '|')) AS digest
        FROM (SELECT doc_id, regexp_extract_all(text, '[\p{L}\p{N}]+|[^ ]') AS t FROM documents) x""",
    "capitalised": r"""
        SELECT p_partkey, array_to_string(list_transform(regexp_extract_all(p_name || '_' || lower(p_brand), '[A-Za-z]+|[^A-Za-z]+'),
               lambda w: upper(w[1]) || w[2:]), '') AS shown, lower(regexp_replace(p_brand || '-' || p_name, '[\p{P}`]', '', 'g')) AS cleaned
        FROM part""",
    "salted_hashes": "SELECT c_custkey, sha1('pepper' || md5(c_name) || 'pepper') AS hashed FROM customer",
    "hour_marks": "SELECT event_id, strftime(ts, '%Y%m%d%I') AS mark FROM events",
    "url_parts": r"""
        SELECT page_id, regexp_extract(url, '^https?://([^/?#:]+)', 1) AS host,
               nullif(regexp_extract(url, '[?&]page=([^&#]*)', 1), '') AS page FROM pages""",
    "ngram_freq": f"""WITH {_grams(3)}, n AS (SELECT count(*) AS total FROM g)
        SELECT word, len, count(*) AS freq, round(count(*) / (SELECT total FROM n), 10) AS prob FROM g GROUP BY word, len HAVING count(*) >= 20""",
    "neighbour_entropy": f"""WITH {_grams(2)}, f AS (SELECT word FROM g GROUP BY word HAVING count(*) >= 50),
        a AS ({_ENTROPY.format(s="l", c="TRUE", e="n / m * ln(1 / m)")}), b AS ({_ENTROPY.format(s="r", c="r IS NOT NULL", e="0")})
        SELECT word, round(coalesce(a.h, 0), 6) + 0 AS entropy_left, round(coalesce(b.h, 0), 6) + 0 AS entropy_right
        FROM f JOIN a USING (word) JOIN b USING (word)""",
    "word_accept": f"""WITH {_grams(3)}, n AS (SELECT count(*) AS total FROM g),
        f AS (SELECT word, len, count(*) AS freq, count(*) / (SELECT total FROM n) AS prob FROM g GROUP BY word, len),
        a AS ({_ENTROPY.format(s="l", c="l IS NOT NULL", e="0")}), b AS ({_ENTROPY.format(s="r", c="r IS NOT NULL", e="0")}),
        k AS (SELECT word, string_split(word, ' ') AS t, unnest(range(1, len)) AS i FROM f WHERE len > 1 AND freq >= 10),
        c AS (SELECT k.word, min(x.prob * y.prob) AS p FROM k JOIN f x ON x.word = array_to_string(t[1:i], ' ')
              JOIN f y ON y.word = array_to_string(t[i + 1:], ' ') GROUP BY k.word)
        SELECT word, freq, round(prob, 10) AS prob, round(least(a.h, b.h), 6) AS entropy
        FROM f JOIN a USING (word) JOIN b USING (word) LEFT JOIN c USING (word)
        WHERE ((len > 1 AND freq >= 10 AND prob / c.p >= 3) OR (len = 1 AND length(word) > 1 AND freq >= 300))
              AND least(a.h, b.h) >= 1.0""",
    "word_accept_all": f"""WITH {_grams(5)}, n AS (SELECT count(*) AS total FROM g),
        f AS (SELECT word, len, count(*) AS freq, count(*) / (SELECT total FROM n) AS prob FROM g GROUP BY word, len),
        a AS ({_ENTROPY.format(s="l", c="l IS NOT NULL", e="0")}), b AS ({_ENTROPY.format(s="r", c="r IS NOT NULL", e="0")}),
        k AS (SELECT word, string_split(word, ' ') AS t, unnest(range(1, len)) AS i FROM f WHERE len > 1 AND freq >= 10),
        c AS (SELECT k.word, min(x.prob * y.prob) AS p FROM k JOIN f x ON x.word = array_to_string(t[1:i], ' ')
              JOIN f y ON y.word = array_to_string(t[i + 1:], ' ') GROUP BY k.word)
        SELECT word, freq, round(prob, 10) AS prob, round(least(a.h, b.h), 6) AS entropy
        FROM f JOIN a USING (word) JOIN b USING (word) LEFT JOIN c USING (word)
        WHERE ((len > 1 AND freq >= 10 AND prob / c.p >= 200) OR (len = 1 AND length(word) > 1 AND freq >= 300))
              AND least(a.h, b.h) >= 2.8""",
    "vector_topk": f"""
        SELECT doc_id, term, CAST(n AS DOUBLE) AS weight, CAST(place AS INTEGER) AS place FROM (
          SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, term COLLATE C) AS place
          FROM (SELECT doc_id, term, count(*) AS n FROM (SELECT doc_id, unnest(t) AS term FROM ({_TOKENS}) x) y GROUP BY ALL) z) w WHERE place <= 20""",
    "cosine_sparse": _cosine_sql(0.8),
    "cosine_sparse_all": _cosine_sql(0.3),
    "extract_brand": f"""WITH {_found("SELECT p_partkey, p_name || ' ' || p_brand || ' new' AS s FROM part", "p_partkey", "SELECT DISTINCT p_brand AS word, strlen(p_brand) AS freq FROM part")}
        SELECT p_partkey, array_to_string(found, ',') AS brands, array_to_string(list_transform(regexp_extract_all(found[1], '[A-Za-z]+|[^A-Za-z]+'),
               lambda w: upper(w[1]) || w[2:]), '') AS brand FROM x""",
    "extract_phrases": f"""WITH {_grams(2)}, {_found("SELECT doc_id, text AS s FROM documents", "doc_id", "SELECT word, count(*) AS freq FROM g WHERE len = 2 GROUP BY word HAVING count(*) >= 30")}
        SELECT doc_id, CAST(len(found) AS INTEGER) AS n_found, md5(array_to_string(found, ',')) AS digest FROM x""",
    "cosine_dense": """
        WITH e AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
        f AS (SELECT label, arg_min(v, vec_id) AS lead FROM e GROUP BY label)
        SELECT vec_id, round(list_cosine_similarity(v, lead), 5) AS cosine FROM e JOIN f USING (label)""",
    "dictionary_filter": """
        WITH s AS (SELECT p_partkey, i, string_split(p_name, ' ')[i] AS segment
                   FROM (SELECT *, unnest(range(1, len(string_split(p_name, ' ')) + 1)) AS i FROM part) x),
        b AS (SELECT string_split(p_name, ' ')[1] AS segment FROM part WHERE p_size = 1 AND string_split(p_name, ' ')[1] < 'm')
        SELECT p_partkey, string_agg(segment, ' ' ORDER BY i) AS kept FROM s WHERE segment NOT IN (SELECT segment FROM b) GROUP BY p_partkey""",
    "event_windows": """
        SELECT strftime(ts, '%Y-%m-%d') AS day, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL""",
}
