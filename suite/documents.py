"""Chunking, embeddings, vector and text search."""

import math
import re

from pyspark.sql import functions as F

from tidemark.functions.columns import combine_embeddings, cosine
from tidemark.operators.docs import build_context, chunk, embed, number_chunks
from tidemark.operators.text import bm25, keyword_search, match_all
from tidemark.operators.vector import hybrid_ranked, hybrid_search, ivf_build, ivf_search, nearest, score, vector_search
from tidemark.session import reliable, scratch_path
from tidemark.sources.read import read_documents

from . import near, query

# A text file of documents is one row when it is read, so larger inputs are more files.
FILE_BYTES = 8 * 1024 * 1024


def sql_last(mark: str) -> str:
    """Offset of the last occurrence of a break in a piece, or -1 (0-based)."""
    return f"length(piece) - length(list_last(string_split(piece, {mark}))) - length({mark})"


def sql_chunk_rows(size: int, overlap: int, tail: bool = False) -> str:
    """Recursive form of the chunking rule; a piece without a break gives a negative offset."""
    marks = ["'. '", "chr(10) || chr(10)", "chr(10)", "' '"]
    whens = " ".join(
        f"when {sql_last(m)} > {size // 2} then a + {sql_last(m)} + length({m})" for m in marks
    )

    more = f"greatest(b - {overlap}, a + 1) < length(text)" if tail else "b < length(text)"

    def step(source: str) -> str:
        return f"""
            select doc_id, text, pos, a, case when least(a + {size}, length(text)) >= length(text) then length(text)
                {whens} else a + {size} end as b
            from (select *, substr(text, a + 1, {size}) as piece from ({source}))
        """

    return f"""
        with recursive c as (
            {step("select doc_id, text, 0 as pos, 0 as a from documents where length(text) > 0")}
            union all
            {step(f"select doc_id, text, pos + 1 as pos, greatest(b - {overlap}, a + 1) as a from c where {more}")}
        )
        select doc_id, pos, a as start_char, b as end_char,
               trim(substr(text, a + 1, b - a), ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || chr(160)) as text from c
    """


@query(sql_chunk_rows(1000, 200))
def chunks(t):
    return chunk(t.documents.select("doc_id", "text"), "text")


@query(f"select doc_id, pos, start_char, end_char, length(text) as size from ({sql_chunk_rows(1000, 50, True)})")
def chunks_with_tail(t):
    """With the ever shorter rests at the end of a text."""
    pieces = chunk(t.documents.select("doc_id", "text"), "text", 1000, 50, tail=True)
    return pieces.select("doc_id", "pos", "start_char", "end_char", F.length("text").alias("size"))


@query(
    f"select row_number() over (order by doc_id, pos) - 1 as chunk_id, doc_id, start_char, end_char, length(text) as size from ({sql_chunk_rows(500, 50)})"
)
def chunks_numbered(t):
    """Dense numbers over all documents."""
    pieces = reliable(chunk(t.documents.select("doc_id", "text"), "text", 500, 50))
    return number_chunks(pieces, "doc_id").select(
        "chunk_id", "doc_id", "start_char", "end_char", F.length("text").alias("size")
    )


@query(
    """
    select doc_id, 256 as dim, case when regexp_matches(text, '[\\p{L}\\p{N}]') then 1.0 else 0.0 end as norm from documents
    """
)
def embedded_documents(t):
    """Hashed word counts of unit length; a text without words has a zero vector."""
    vectors = embed(t.documents, "text")
    length = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    return vectors.select("doc_id", F.size("embedding").alias("dim"), F.round(length, 4).alias("norm"))


SQL_CENTRES = """
    centres as (select label, list(m order by i) as centre from (
        select label, i, avg(embedding[i]::double) as m from embeddings, (select unnest(range(1, 65)) as i) group by label, i) group by label)
"""
SQL_DISTANCE = {
    "cosine": "1 - list_cosine_similarity(centre, embedding::double[])",
    "l2": "list_distance(centre, embedding::double[])",
    "l1": "list_sum(list_transform(list_zip(centre, embedding::double[]), lambda p: abs(p[1] - p[2])))",
    "inner_product": "-list_inner_product(centre, embedding::double[])",
}


def sql_nearest(metric: str, k: int, vectors: str = "embeddings", extra: str = "") -> str:
    return f"""
        with {SQL_CENTRES},
        near as (select c.label as query, vec_id, round({SQL_DISTANCE[metric]}, 9) as distance from centres c, {vectors}),
        top as (select *, row_number() over (partition by query order by distance, vec_id) as rank from near)
        select query, vec_id, rank, round(1e-9 + distance, 6) as distance {extra} from top where rank <= {k}
    """


def centres(t):
    """The mean vector of every label."""
    parts = t.embeddings.select("label", F.posexplode("embedding"))
    means = parts.groupBy("label", "pos").agg(F.avg(F.col("col").cast("double")).alias("m"))
    ordered = F.sort_array(F.collect_list(F.struct("pos", "m")))
    return means.groupBy(F.col("label").alias("query")).agg(F.transform(ordered, lambda x: x["m"]).alias("centre"))


def _topk(t, metric, k=10, **how):
    found = vector_search(t.embeddings, centres(t), "vec_id", "embedding", "query", "centre", metric, k, **how)
    return found.withColumn("distance", near("distance", 6))


@query(sql_nearest("cosine", 10))
def vector_topk_cosine(t):
    return _topk(t, "cosine")


@query(sql_nearest("l2", 10))
def vector_topk_l2(t):
    return _topk(t, "l2")


@query(sql_nearest("l1", 10))
def vector_topk_l1(t):
    return _topk(t, "l1")


@query(sql_nearest("inner_product", 10))
def vector_topk_inner(t):
    return _topk(t, "inner_product")


@query(sql_nearest("cosine", 10))
def vector_topk_grid(t):
    """The path for query sets too big to broadcast."""
    return _topk(t, "cosine", query_bytes=1024)


@query(sql_nearest("l2", 5, extra=", round(1e-9 + 1 / (1 + distance), 6) as score"))
def vector_scores(t):
    found = vector_search(t.embeddings, centres(t), "vec_id", "embedding", "query", "centre", "l2", 5)
    return found.withColumns({"score": near(score("distance", "l2"), 6), "distance": near("distance", 6)})


@query(
    f"""
    with q as (select list(m order by i) as centre from (select i, avg(embedding[i]::double) as m
               from embeddings, (select unnest(range(1, 65)) as i) group by i))
    select vec_id, label, round(1e-9 + round({SQL_DISTANCE['cosine']}, 9), 6) as distance from embeddings, q
    order by round({SQL_DISTANCE['cosine']}, 9), vec_id limit 10
    """
)
def vector_nearest(t):
    """One query vector; the winners come back with all their columns."""
    parts = t.embeddings.select(F.posexplode("embedding")).groupBy("pos").agg(F.avg(F.col("col").cast("double")).alias("m"))
    mean = [r["m"] for r in parts.orderBy("pos").collect()]  # one number per dimension
    return nearest(t.embeddings, "vec_id", "embedding", mean).select("vec_id", "label", near("distance", 6).alias("distance"))


@query(sql_nearest("cosine", 10))
def ivf_all_lists(t):
    """The inverted-file index with every list probed equals exact search."""
    rows, middles = ivf_build(t.embeddings, "embedding", nlist=16)
    found = ivf_search(rows, middles, centres(t), "vec_id", "embedding", "query", "centre", nprobe=16)
    return found.withColumn("distance", near("distance", 6))


@query(f"with {SQL_CENTRES} select label as query, 10 as found, true as recalled from centres")
def ivf_topk(t):
    """Few probes of an index written by list: found rows per query, and whether at least half of the true ones are among them."""
    rows, middles = ivf_build(t.embeddings, "embedding", nlist=16)
    place = scratch_path(t.spark, "index")
    rows.write.partitionBy("list").parquet(place)
    index = t.spark.read.parquet(place)
    plan = index.filter("list in (1, 2)")._jdf.queryExecution().executedPlan().toString()
    if not re.search(r"PartitionFilters: \[[^]]*list", plan):
        raise AssertionError("probed lists are not read alone")
    asked = centres(t)
    found = ivf_search(index, middles, asked, "vec_id", "embedding", "query", "centre", nprobe=10)
    exact = vector_search(t.embeddings, asked, "vec_id", "embedding", "query", "centre")
    both = found.select("query", "vec_id").join(exact.select("query", "vec_id", F.lit(1).alias("hit")), ["query", "vec_id"], "left")
    return both.groupBy("query").agg(F.count("*").cast("int").alias("found"), (F.count("hit") >= 5).alias("recalled"))


@query(
    f"""
    with {SQL_CENTRES}
    select vec_id, round(1e-9 + list_cosine_similarity(centre, embedding::double[]), 6) as similarity,
        round(1e-9 + list_sum(list_transform(list_zip(centre, embedding::double[]), lambda p: 0.3 * p[1] + 0.7 * p[2])), 6) as weighted_sum,
        round(1e-9 + list_sum(list_transform(list_zip(centre, embedding::double[]), lambda p: (p[1] + p[2]) / 2)), 6) as average_sum,
        128 as joined_size
    from embeddings join centres using (label)
    """
)
def combined_embeddings(t):
    pairs = t.embeddings.join(centres(t).withColumnRenamed("query", "label"), "label")

    def total(c):
        return near(F.aggregate(c, F.lit(0.0), lambda s, x: s + x), 6)

    return pairs.select(
        "vec_id",
        near(cosine("centre", "embedding"), 6).alias("similarity"),
        total(combine_embeddings("centre", "embedding", "weighted_sum", 0.3, 0.7)).alias("weighted_sum"),
        total(combine_embeddings("centre", "embedding", "average")).alias("average_sum"),
        F.size(combine_embeddings("centre", "embedding", "concatenate")).alias("joined_size"),
    )


@query(
    "select doc_id, source, n_chars from documents where contains(text, 'tion') or contains(source, 'tion') order by doc_id limit 50"
)
def keyword_hits(t):
    return keyword_search(t.documents, ["text", "source"], "tion", ["doc_id"], 50).select("doc_id", "source", "n_chars")


SQL_TEXT = r"""
    d as (select doc_id, list_filter(regexp_split_to_array(strip_accents(lower(concat_ws(' ', text, lang))), '[^\p{L}\p{N}]+'), lambda x: x <> '') as w from documents),
    q as (select item_id, list_distinct(list_filter(regexp_split_to_array(strip_accents(lower(text)), '[^\p{L}\p{N}]+'), lambda x: x <> '')) as w from benchmark),
    terms as (select item_id, len(w) as n_terms, unnest(w) as term from q),
    tf as (select doc_id, length, term, count(*) as tf from (select doc_id, len(w) as length, unnest(w) as term from d)
           where term in (select term from terms) group by all)
"""


def sql_bm25(match: str) -> str:
    return f"""
        with {SQL_TEXT},
        n as (select count(*) as docs, avg(len(w)) as length from d),
        idf as (select term, greatest(ln((docs - count(*) + 0.5) / (count(*) + 0.5)), 1e-6) as idf from tf, n group by term, docs),
        s as (select item_id, doc_id, n_terms, count(*) as hit,
                     round(-sum(idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * tf.length / n.length))), 9) as distance
              from tf join terms using (term) join idf using (term), n group by item_id, doc_id, n_terms),
        r as (select *, row_number() over (partition by item_id order by distance, doc_id) as rank from s {match})
        select item_id, doc_id, rank, round(1e-9 + distance, 5) as distance from r where rank <= 5
    """


def _bm25(t, match, **how):
    out = bm25(t.documents, "doc_id", ["text", "lang"], t.benchmark, "item_id", "text", 5, match, **how)
    return out.withColumn("distance", near("distance", 5))


@query(sql_bm25(""))
def bm25_any(t):
    return _bm25(t, "any")


@query(sql_bm25("where hit = n_terms"))
def bm25_all(t):
    return _bm25(t, "all")


SQL_MATCH = f"""
    with {SQL_TEXT},
    hits as (select item_id, doc_id, round(sum(tf) / length, 9) as text_rank from tf join terms using (term)
             group by item_id, doc_id, n_terms, length having count(*) = n_terms)
"""


@query(
    SQL_MATCH + """
    select item_id, doc_id, rank, round(1e-9 + text_rank, 6) as text_rank from
        (select *, row_number() over (partition by item_id order by text_rank desc, doc_id) as rank from hits) where rank <= 5
    """
)
def match_all_terms(t):
    out = match_all(t.documents, "doc_id", ["text", "lang"], t.benchmark, "item_id", "text", 5)
    return out.withColumn("text_rank", near("text_rank", 6))


@query(
    sql_nearest("cosine", 5, "(select vec_id, embedding from embeddings join documents on vec_id = doc_id where contains(text, 'tion')) x")
)
def hybrid_keyword(t):
    """Keyword filter over the documents, then vector ranking."""
    rows = t.embeddings.join(t.documents.select(F.col("doc_id").alias("vec_id"), "text"), "vec_id")
    found = hybrid_search(rows, ["text"], "tion", centres(t), "vec_id", "embedding", "query", "centre", "cosine", 5)
    return found.withColumn("distance", near("distance", 6))


@query(
    SQL_MATCH + f""",
    {SQL_CENTRES.replace('centre', 'middle')},
    near as (select item_id, vec_id, text_rank,
                    round(1 - list_cosine_similarity(middle, embedding::double[]), 9) as distance
             from hits join embeddings e on doc_id = vec_id join middles m on m.label = item_id % 10)
    select item_id, vec_id, round(1e-9 + text_rank, 6) as text_rank, round(1e-9 + distance, 6) as distance, rank from
        (select *, row_number() over (partition by item_id order by distance, vec_id) as rank from near) where rank <= 5
    """
)
def hybrid_text_rank(t):
    """All terms must match; the nearest vector comes first."""
    rows = t.embeddings.join(
        t.documents.select(F.col("doc_id").alias("vec_id"), "text", "lang"), "vec_id"
    )
    asked = t.benchmark.withColumn("query", (F.col("item_id") % 10).cast("int")).join(centres(t), "query")
    out = hybrid_ranked(rows, ["text", "lang"], asked, "vec_id", "embedding", "item_id", "text", "centre", "cosine", 5)
    return out.withColumns({"text_rank": near("text_rank", 6), "distance": near("distance", 6)})


@query(
    """
    select conv_id, string_agg(text, chr(10) order by turn) as context, count(*) as passages from conversations where turn < 4 group by 1
    """
)
def conversation_context(t):
    """The first four turns of every conversation as one context."""
    ranked = t.conversations.withColumn("rank", F.col("turn") + 1)
    return build_context(ranked, ["conv_id"], "text", "rank", 4, "\n")


@query(sql_bm25(""))
def bm25_by_join(t):
    """The path for query sets whose term matrix is too big to broadcast."""
    return _bm25(t, "any", matrix_bytes=0)


SQL_REPEATED = sql_bm25("").replace("order by distance, doc_id)", "order by distance, doc_id // 2)")
SQL_REPEATED = SQL_REPEATED.replace("select item_id, doc_id, rank,", "select path, item_id, doc_id // 2 as doc_id, rank,")
SQL_REPEATED = SQL_REPEATED.replace("from r where", "from r, (select unnest(['matrix', 'join']) as path) where")


@query(SQL_REPEATED)
def bm25_repeated_ids(t):
    """Rows that share a document id are documents of their own, on either path."""
    docs = t.documents.withColumn("doc_id", F.floor(F.col("doc_id") / 2))
    out = None
    for path, how in (("matrix", {}), ("join", {"matrix_bytes": 0})):
        part = bm25(docs, "doc_id", ["text", "lang"], t.benchmark, "item_id", "text", 5, "any", **how)
        part = part.withColumns({"distance": near("distance", 5), "path": F.lit(path)})
        out = part if out is None else out.unionByName(part)
    return out


@query("select sum(length(text) + 1)::bigint as size, true as named from documents")
def document_files(t):
    """Documents written as text files and loaded file by file."""
    place = scratch_path(t.spark, "files")
    size = t.documents.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    t.documents.select("text").repartition(max(4, math.ceil(size / FILE_BYTES))).write.text(place)
    files = read_documents(t.spark, place)
    return files.agg(F.sum("size").alias("size"), F.bool_and(F.endswith("source", "filename")).alias("named"))


@query(
    """
    select doc_id, length(text)::double as size, (length(text) - length(replace(text, ' ', '')))::double as spaces, true as others_kept from documents
    """
)
def embedded_by_model(t):
    """A caller's model, started once per task; its values, and the other columns as they were."""

    def model():
        return lambda texts: [[len(x), x.count(" ")] for x in texts]

    vectors = embed(t.documents, "text", model)
    kept = F.col("n_chars") == F.length("text")
    return vectors.select(
        "doc_id",
        F.get("embedding", F.lit(0)).cast("double").alias("size"),
        F.get("embedding", F.lit(1)).cast("double").alias("spaces"),
        kept.alias("others_kept"),
    )
