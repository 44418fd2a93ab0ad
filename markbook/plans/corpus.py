"""Token windows over the whole document corpus."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.vectors import mask_all_but_last
from ..operators import ordering as O
from ..operators import windows as W
from .registry import query, table

TOKENS = """tok AS (SELECT doc_id, unnest(string_split(trim(text, ' '), ' ')) AS word,
   unnest(range(len(string_split(trim(text, ' '), ' ')))) AS i FROM documents),
 pos AS (SELECT *, row_number() OVER (ORDER BY doc_id, i) - 1 AS place FROM tok)"""


def docs(spark, folder):
    return table(spark, folder, "documents").select("doc_id", "text")


def words():
    return W.words(F.col("text"))


def shown(df, *keys):
    return df.select(*keys, F.md5(F.array_join("tokens", " ")).alias("digest"), F.size("tokens").alias("n"))


@query("win4_prefix_sum", """SELECT doc_id, n AS n_tokens, coalesce(sum(n) OVER (ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start
 FROM (SELECT doc_id, len(string_split(trim(text, ' '), ' ')) AS n FROM documents)""")
def win4(spark, folder):
    return W.with_offsets(docs(spark, folder), "doc_id", words()).select("doc_id", "n_tokens", "start")


@query("smp4_sample_windows", f"""WITH {TOKENS}, total AS (SELECT max(place) + 1 AS n FROM pos),
 starts AS (SELECT i AS "window", (i * 7368787 + 1299709) % (n - 256) AS low FROM range(128) r(i), total)
 SELECT "window", md5(string_agg(word, ' ' ORDER BY place)) AS digest, CAST(256 AS INTEGER) AS n
 FROM starts JOIN pos ON place >= low AND place < low + 256 GROUP BY 1""")
def smp4(spark, folder):
    # Starts are spread by a prime; seeded random ones are tested against plain Python.
    corpus = docs(spark, folder)
    total = W.corpus_tokens(corpus, "doc_id", words())
    starts = spark.range(128).select(F.col("id").alias("window"), ((F.col("id") * 7368787 + 1299709) % (total - 256)).alias("low"))
    return shown(W.windows_at(corpus, "doc_id", words(), starts, 256), "window")


@query("smp5_crop_documents", """WITH d AS (SELECT doc_id, string_split(trim(text, ' '), ' ') AS t, (doc_id * 1103515245 + 12345) % 2147483648 AS h FROM documents),
 c AS (SELECT * FROM d WHERE len(t) >= 100 ORDER BY h, doc_id LIMIT 128)
 SELECT doc_id, md5(array_to_string(t[h % greatest(len(t) - 100, 1) + 1 : h % greatest(len(t) - 100, 1) + 100], ' ')) AS digest,
   CAST(100 AS INTEGER) AS n FROM c""")
def smp5(spark, folder):
    # Doc ids stay below 2**31 at every scale the check runs at; a wider id would be hashed first.
    order = (F.col("doc_id") * 1103515245 + 12345) % 2147483648
    return shown(W.crop_documents(docs(spark, folder), "doc_id", words(), 128, 100, order), "doc_id")


@query("smp6_corpus_head", f"""WITH {TOKENS} SELECT doc_id, md5(string_agg(word, ' ' ORDER BY place)) AS digest, CAST(count(*) AS INTEGER) AS n
 FROM pos WHERE place < 16384 AND doc_id < 1100 GROUP BY doc_id""")
def smp6(spark, folder):
    return shown(W.corpus_head(docs(spark, folder), "doc_id", words(), 1100, 256 * 64), "doc_id")


@query("smp7_label_mask", """SELECT doc_id, CAST(len(t) AS INTEGER) AS n, CAST(-100 * (len(t) - 1) + length(t[-1]) AS BIGINT) AS total
 FROM (SELECT doc_id, string_split(trim(text, ' '), ' ') AS t FROM documents)""")
def smp7(spark, folder):
    ids = F.transform(words(), lambda w: F.length(w))
    masked = docs(spark, folder).select("doc_id", mask_all_but_last(ids).alias("m"))
    return masked.select(
        "doc_id", F.size("m").alias("n"), F.aggregate("m", F.lit(0).cast("long"), lambda a, x: a + x).alias("total")
    )


@query("smp8_consecutive_windows", f"""WITH {TOKENS} SELECT place // 256 AS "window", md5(string_agg(word, ' ' ORDER BY place)) AS digest, CAST(256 AS INTEGER) AS n
 FROM pos GROUP BY 1 HAVING count(*) = 256""")
def smp8(spark, folder):
    return shown(W.consecutive_windows(docs(spark, folder), "doc_id", words(), 256), "window")


@query("win4_global_index", "SELECT row_number() OVER (ORDER BY l_extendedprice * 100, k) - 1 AS idx, k FROM (SELECT o_totalprice AS l_extendedprice, o_orderkey AS k FROM orders) ORDER BY k")
def win4_index(spark, folder):
    cents = F.round(F.col("o_totalprice") * 100).cast("decimal(20,0)")
    unique = table(spark, folder, "orders").select(
        F.col("o_orderkey").alias("k"), (cents * F.lit(10**9).cast("decimal(10,0)") + F.col("o_orderkey")).cast("decimal(38,0)").alias("place")
    )
    return O.with_index(unique, "place").select("idx", "k")
