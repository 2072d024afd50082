"""The operators applied to their whole tables, as named queries."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def register(fn: Callable[[SparkSession, str], DataFrame]):
        QUERIES[fn.__name__] = fn
        if sql:
            ORACLE[fn.__name__] = sql
        return fn

    return register


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


EXACT_SQL = """
with t as (select doc_id, sha256(coalesce(text, '')) as h, coalesce(text, '') as txt from documents),
g as (select txt, max(doc_id) as keep_id, count(*) as group_size from t group by txt)
select doc_id, keep_id, group_size, doc_id = keep_id as kept, h as text_sha256 from t join g using (txt)
"""


@query(EXACT_SQL)
def op10_exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Every document with the document that stays for its text; a fresh digest index is filled."""
    from .exact_dedup import decide, own_index

    decided = decide(table(spark, folder, "documents"), own_index(spark))
    return decided.select(
        F.col("id").alias("doc_id"), "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256")
    )


@query()
def op2_simhash(spark: SparkSession, folder: str) -> DataFrame:
    """Fingerprint and near-duplicate group of every document."""
    from .simhash import hex_digits, near_duplicates

    found = near_duplicates(table(spark, folder, "documents"), shingle=3, max_bits=3)
    return found.select(F.col("id").alias("doc_id"), hex_digits().alias("fingerprint"), "component_id")


@query()
def op9_best_fit_packing(spark: SparkSession, folder: str) -> DataFrame:
    """Every piece of every document with its place in a sequence of 1024 tokens."""
    from .packing import pack, pieces

    cut = pieces(table(spark, folder, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN, end_id=2)
    return pack(cut, 1024).withColumnRenamed("id", "doc_id")


@query()
def op4_prefix_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Bytes and tokens of every document, whether it is over 2048 tokens, and how many characters fit these.

    All of it is read from the stored token counts at the ends of words.
    """
    from .common import stored
    from .token_counts import fits_budget, n_tokens, prefix_tables

    prefixes = prefix_tables(table(spark, folder, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    known = stored(prefixes, "token-prefixes").withColumn("n_tokens", n_tokens())
    over = F.col("n_tokens") > 2048
    return known.select(
        F.col("id").alias("doc_id"), "n_bytes", "n_tokens", over.alias("over_limit"), fits_budget(2048).cast("long").alias("fitting_chars")
    )


@query()
def op5_secret_scan(spark: SparkSession, folder: str) -> DataFrame:
    """Secrets in every document."""
    from .secret_scan import scan

    ranks = public_tokenizers.path("byte_bpe_50k.tiktoken")
    found = scan(table(spark, folder, "documents"), ranks, public_tokenizers.PATTERN)
    return found.withColumnRenamed("id", "doc_id")


CHAT_SQL = r"""
with t as (
    select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
    union all values (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')),
s as (
    select *, regexp_extract_all(role || text, '<\|im_start\|>|<\|im_sep\|>|<\|im_end\|>|<\|endoftext\|>|<s>|</s>|\[INST\]|\[/INST\]|<<SYS>>|<</SYS>>') as marks
    from t)
select conv_id, count(*) as n_turns,
    sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn)) as turns_sha256,
    coalesce(sum(length(text)) filter (role = 'assistant'), 0)::bigint as loss_chars,
    sha256(coalesce(string_agg(text, '' order by turn) filter (role = 'assistant'), '')) as loss_sha256,
    sum(33 + 2 * length(role || text) - length(replace(role || text, chr(92), '')) + len(marks))::bigint as formatted_chars
from s group by conv_id
"""


@query(CHAT_SQL)
def op6_chat_format(spark: SparkSession, folder: str) -> DataFrame:
    """Every conversation, and one made of control strings, formatted and read back."""
    from .chat import digests, fold, render

    turns = table(spark, folder, "conversations").select("conv_id", "turn", "role", "text")
    odd = spark.sql(
        "select -1L as conv_id, t as turn, r as role, '</s>[INST] ok [/INST]' as text "
        "from values (0L, 'user'), (1L, 'assistant') as v(t, r)"
    )
    filled = turns.unionByName(odd).fillna("", ["role", "text"])
    # a table of turns is no log: rows that repeat or share a turn are messages of their own
    same = Window.partitionBy("conv_id", "turn", "role").orderBy("text")
    events = filled.select(
        "conv_id", F.col("turn").alias("seq"), F.lit("delta").alias("kind"), "turn", "role", "text", F.row_number().over(same).alias("message")
    )
    return digests(render(fold(events, "message")))


@query()
def op8_quality_discriminant(spark: SparkSession, folder: str) -> DataFrame:
    """Quality score of every document."""
    from .quality import classify

    labels = table(spark, folder, "labels").select(F.col("doc_id").alias("id"), F.col("quality").alias("label"))
    return classify(table(spark, folder, "documents"), labels, threshold=0.3, folds=5).withColumnRenamed("id", "doc_id")


@query()
def op1_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    """Every stretch of a document that holds a passage of a benchmark item."""
    from .decontaminate import find_passages

    found = find_passages(table(spark, folder, "documents"), table(spark, folder, "benchmark"))
    return found.withColumnRenamed("id", "doc_id")


REPEATS_SQL = r"""
with d as (
    select doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') as w from documents),
p as (select doc_id, w, unnest(range(1, len(w) - 18)) as s from d),
r as (select doc_id, s, row_number() over (partition by array_to_string(w[s : s + 19], ' ') order by doc_id, s) > 1 as later from p),
g as (select doc_id, list(distinct i) as gone from (select doc_id, unnest(range(s, s + 20)) as i from r where later) group by doc_id)
select doc_id, len(w)::bigint as n_words, coalesce(len(gone), 0)::bigint as n_removed,
    sha256(array_to_string(list_filter(w, lambda x, i: not list_contains(coalesce(gone, []), i)), ' ')) as kept_sha256
from d left join g using (doc_id)
"""


@query(REPEATS_SQL)
def op3_repeated_passages(spark: SparkSession, folder: str) -> DataFrame:
    """Words of every document that belong to passages found earlier."""
    from .repeats import repeated_words

    found = repeated_words(table(spark, folder, "documents"), window=20)
    return found.select(F.col("id").alias("doc_id"), "n_words", "n_removed", "kept_sha256")


@query()
def op7_katz_scores(spark: SparkSession, folder: str) -> DataFrame:
    """Every document scored by a model of nine tenths of them."""
    from .katz import fit, score

    return score(fit(table(spark, folder, "documents"), folds=10)).withColumnRenamed("id", "doc_id")


@query()
def op12_source_mix(spark: SparkSession, folder: str) -> DataFrame:
    """Words the mix takes of every document."""
    from .mixing import mix

    return mix(table(spark, folder, "documents"), weights=(1, 2, 3), most=3).withColumnRenamed("id", "doc_id")


NEGATIVES_SQL = """
with v as (
    select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label,
        list_transform(embedding, lambda x: floor(256 * x::double)) as q
    from embeddings
    where vec_id is not null and label is not null and embedding is not null
        and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (
    select a.vec_id as anchor_id, b.vec_id as other_id, a.label = b.label as same, list_inner_product(a.q, b.q)::bigint as score
    from v a join v b on a.vec_id <> b.vec_id and len(a.q) = len(b.q) where a.vec_id % 50 = 0),
p as (select anchor_id, other_id as positive_id, score as positive_score from s where same
    qualify row_number() over (partition by anchor_id order by score desc, other_id) <= 5),
n as (
    select anchor_id, positive_id, other_id as negative_id, positive_score, score as negative_score,
        row_number() over (partition by anchor_id, positive_id order by score desc, other_id)::int as rank
    from p join s using (anchor_id)
    where not same and 100 * score >= 50 * positive_score and 100 * score <= 95 * positive_score)
select anchor_id, positive_id, rank, negative_id, positive_score, negative_score from n where rank <= 3
"""


@query(NEGATIVES_SQL)
def op11_hard_negatives(spark: SparkSession, folder: str) -> DataFrame:
    """Hard negatives of every fiftieth vector, with every seventh label moved on."""
    from .hard_negatives import mine

    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = table(spark, folder, "embeddings").withColumn("label", moved)
    return mine(rows, F.col("vec_id") % 50 == 0, scale=256, positives=5, negatives=3, window=(50, 95))


PHRASES_SQL = r"""
with t as (
    select doc_id, coalesce(lang, 'und') as lang,
        unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) as piece
    from documents),
w as (select lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda x: x <> '') as w from t),
n as (select lang, sum(len(w))::bigint as n from w group by lang),
g as (
    select lang, w[s : s + k - 1] as p, k, count(*) as f
    from (select lang, w, unnest(range(1, len(w) + 1)) as s from w), (select unnest([1, 2, 3, 4]) as k)
    where s + k - 1 <= len(w) group by all having count(*) >= 30),
c as (
    select a.lang, a.p, a.f as a, cut, x.f as l, y.f as r, ((2000000::hugeint * a.f) // (x.f + y.f))::bigint as score
    from (select *, unnest(range(1, k)) as cut from g where k > 1) a
    join g x on x.lang = a.lang and x.p = a.p[:cut] join g y on y.lang = a.lang and y.p = a.p[cut + 1:]),
m as (select * from c qualify row_number() over (partition by lang, p order by score, cut) = 1),
i as (
    select lang, p[s : s + j - 1] as p, max(f) as around
    from (select *, unnest(range(1, k - j + 2)) as s from (select *, unnest(range(2, k)) as j from g where k > 2)) group by all),
o as (
    select m.lang, array_to_string(m.p, ' ') as phrase, a, l, r, score from m left join i on i.lang = m.lang and i.p = m.p
    where around is null or 100 * around < 80 * a),
z as (select *, row_number() over (partition by lang order by score desc, a desc, encode(phrase)) as rank from o)
select lang, rank, phrase, a, l, r, n, score from z join n using (lang) where rank <= 2000
"""


@query(PHRASES_SQL)
def op13_collocations(spark: SparkSession, folder: str) -> DataFrame:
    """The best 2000 phrases of every language."""
    from .collocations import collocations

    return collocations(table(spark, folder, "documents"), least=30, k=2000)
