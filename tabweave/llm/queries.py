"""Registered queries of the training-data operators, with their SQL where it can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, decontamination, fixity, languages, near_duplicates, neighbours, ngrams, packing, phrases, quality, repeats, secrets, sharding, spellings, token_counts

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


#: DuckDB: lower-case A-Z only.
LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
SQL["op1_wu_manber"] = rf"""
with item as (
    select item_id, regexp_extract_all({LOWER.format("text")}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') w from benchmark where text is not null
), win as (
    select distinct cast(item_id as varchar) item_id, w[i:i + 9] win
    from (select item_id, w, unnest(range(1, greatest(len(w) - 8, 2))) i from item where len(w) > 0)
), doc as (
    select doc_id, coalesce(regexp_extract_all({LOWER.format("text")}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) w from documents
), spot as (
    select doc_id, w, unnest(range(1, len(w) + 1)) i, n from doc, (select distinct len(win) n from win)
), hit as (
    select doc_id, i, n, item_id from spot join win on win = w[i:i + n - 1] and len(win) = n
), covered as (
    select doc_id, count(distinct p) n_hit from (select doc_id, unnest(range(i, i + n)) p from hit) group by 1
), named as (
    select doc_id, count(*) n_items, string_agg(item_id, ',' order by item_id) ids from (select distinct doc_id, item_id from hit) group by 1
)
select doc_id, len(w) n_words, coalesce(n_hit, 0) n_hit, coalesce(n_items, 0) n_items, sha256(coalesce(ids, '')) items_sha256, n_hit is not null contaminated
from doc left join covered using (doc_id) left join named using (doc_id)"""


@query
def op1_wu_manber(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark windows in all documents."""
    found = decontamination.find_benchmark(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "benchmark"), ["doc_id"])
    n_hit = F.aggregate("hits", F.lit(0).cast("long"), lambda n, x: n + (x["past"] - x["first"]))
    return found.select("doc.doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.size("items") > 0).alias("contaminated"))


@query
def op2_hilbert_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of 1024 ids, along the Hilbert curve."""
    return packing.packed(common.table(spark, sf_dir, "documents"), packing.default_tokenizer(), 1024)


@query
def op3_ftrl_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of all documents."""
    docs = common.table(spark, sf_dir, "documents")
    found = languages.predict(docs, languages.train(languages.training_rows(docs)), ["doc_id"])
    return found.select("doc.doc_id", (ngrams.id_text_crc(F.col("doc.doc_id")) % 3 == 1).alias("held_out"), F.col("lang").alias("lang_pred"), "score")


@query
def op4_subword_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The quality of all documents."""
    docs = common.table(spark, sf_dir, "documents")
    found = quality.score(docs, quality.train(docs, quality.training_labels(common.table(spark, sf_dir, "labels"))), ["doc_id"])
    return found.select("doc.doc_id", (ngrams.id_text_crc(F.col("doc.doc_id")) % 5 == 0).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


@query
def op5_balanced_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 16 contiguous shards of near equal bytes."""
    out = sharding.balanced_shards(common.table(spark, sf_dir, "documents"), 16)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


SQL["op6_merkle_fixity"] = """
with m as (
    select page_id, strlen(url) || ':' || url || strlen(html) || ':' || html as body from pages
), r as (
    select page_id, strlen(url) || ':' || url || strlen(h) || ':' || h as body
    from (select page_id, url, case when page_id % 50 = 7 then html || '!' else html end as h from pages where page_id % 211 <> 3)
)
select page_id, cast(sum(strlen(m.body)) over (order by page_id) as bigint) - strlen(m.body) as first, cast(sum(strlen(m.body)) over (order by page_id) as bigint) as past,
    sha256(m.body) as hash, sha256(r.body) as replica_hash, coalesce(m.body = r.body, false) as intact
from m left join r using (page_id)"""


@query
def op6_merkle_fixity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages against a replica in which some are altered and some are lost."""
    pages = common.table(spark, sf_dir, "pages")
    altered = F.when(F.col("page_id") % 50 == 7, F.concat("html", F.lit("!"))).otherwise(F.col("html"))
    replica = pages.where("page_id % 211 <> 3").withColumn("html", altered)
    return fixity.audit(pages, replica, "page_id", ["url", "html"])


@query
def op7_hamming_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate components of all documents."""
    return near_duplicates.near_duplicates(common.table(spark, sf_dir, "documents"), 85)


@query
def op8_radix_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes of all documents that repeat earlier ones."""
    out = repeats.without_repeats(common.table(spark, sf_dir, "documents"), 100)
    n_removed = F.aggregate("removed", F.lit(0).cast("long"), lambda n, s: n + (s["past"] - s["first"]))
    return out.select("doc_id", "n_bytes", n_removed.alias("n_removed"), F.size("removed").cast("long").alias("n_spans"), "kept_sha256")


def _of_kind(kind: str):
    return lambda span: span["kind"] == kind


@query
def op9_trigram_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in all documents."""
    found = secrets.find_secrets(common.table(spark, sf_dir, "documents"), ["doc_id"])
    listed = F.array_join(F.transform("spans", lambda s: F.concat_ws(":", s["kind"], s["first"].cast("string"), s["past"].cast("string"))), ",")
    counts = [F.size(F.filter("spans", _of_kind(k))).cast("long").alias(f"n_{k}") for k in ("assign", "access", "hex")]
    return found.select("doc.doc_id", *counts, F.sha2(listed, 256).alias("base_sha256"), listed.alias("spans"))


@query
def op10_nn_descent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and components of all embeddings at a cosine of 0.9."""
    return neighbours.near_vectors(common.table(spark, sf_dir, "embeddings"), 0.9)


SQL["op11_rabin_karp_phrases"] = rf"""
with piece as (
    select doc_id, coalesce(lang, 'und') lang, unnest(regexp_split_to_array({LOWER.format("text")}, '[.,;:!?
-]')) p from documents
), word as (
    select lang, regexp_extract_all(p, '[^ 	]+') w from piece
), total as (
    select lang, cast(sum(len(w)) as bigint) n from word group by 1
), gram as materialized (
    select lang, k, array_to_string(w[i:i + k - 1], ' ') phrase, count(*) a
    from (select lang, w, k, unnest(range(1, len(w) - k + 2)) i from word, range(1, 6) r(k)) group by 1, 2, 3 having count(*) >= 100
), inner_one as (
    select lang, a, unnest([array_to_string(w[1:k - 1], ' '), array_to_string(w[2:k], ' ')]) phrase from (select *, string_split(phrase, ' ') w from gram where k > 2)
), cut as (
    select lang, phrase, a, c, array_to_string(w[1:c], ' ') head, array_to_string(w[c + 1:k], ' ') tail
    from (select *, string_split(phrase, ' ') w, unnest(range(1, k)) c from gram where k > 1 and (lang, phrase, a) not in (select lang, phrase, a from inner_one))
), scored as (
    select lang, cut.phrase, cut.a, l.a l, r.a r, n, c, cast(cast(1000 as hugeint) * cut.a * n // (cast(l.a as hugeint) * r.a) as bigint) score
    from cut join total using (lang) join gram l using (lang) join gram r using (lang) where l.phrase = head and r.phrase = tail
), worst as (
    select * from scored qualify row_number() over (partition by lang, phrase order by score, c) = 1
)
select lang, row_number() over (partition by lang order by score desc, a desc, phrase) rank, phrase, a, l, r, n, score from worst qualify rank <= 2000"""


@query
def op11_rabin_karp_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first collocations of each language in all documents."""
    return phrases.collocations(common.table(spark, sf_dir, "documents"))


@query
def op12_resynchronised_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of all documents."""
    found = token_counts.count_tokens(common.table(spark, sf_dir, "documents"), ["doc_id"])
    return found.select("doc.doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > 4096).alias("over_limit"))


#: CRC-32 byte by byte over a list of bytes; the table is made by the rule of the polynomial.
SQL["op13_partenum_spellings"] = f"""
with recursive tab as (
    select list(v order by i) t from (
        select i, list_reduce(list_prepend(i, [0, 0, 0, 0, 0, 0, 0, 0]::bigint[]), lambda c, z: case when c % 2 = 1 then xor(c >> 1, 3988292384) else c >> 1 end) v from range(256) r(i))
), run as (
    select coalesce(cast(doc_id as varchar), '') id, {LOWER.format("unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+'))")} w from documents
), own as (
    select id, w, count(*) k from run where length(w) >= 7 group by 1, 2
), sum as (
    select w, k, xor(list_reduce(list_prepend(4294967295, list_transform(range(0, strlen(id || ':' || w)), lambda i: cast('0x' || substr(hex(encode(id || ':' || w)), cast(2 * i + 1 as int), 2) as bigint))),
        lambda c, b: xor(c >> 8, t[xor(c, b) % 256 + 1])), 4294967295) h
    from own, tab
), cut as (
    select case when h % 31 = 0 then substr(w, 1, cast(h % length(w) as int)) || substr(w, cast(h % length(w) as int) + 2) else w end word, k from sum
), word as materialized (
    select word, cast(sum(k) as bigint) n from cut where length(word) >= 7 group by 1 having sum(k) >= 2
), less as materialized (
    select word, i, substr(word, 1, cast(i as int)) || substr(word, cast(i as int) + 2) d from (select word, unnest(range(0, length(word))) i from word)
), pair as materialized (
    select a.word, b.word near from less a join less b on a.i = b.i and a.d = b.d and a.word <> b.word
    union select less.word, word.word from less join word on less.d = word.word
    union select word.word, less.word from less join word on less.d = word.word
), best as (
    select pair.word, count(*) n_near, min(row(-n, near)) b from pair join word on word.word = near group by 1
), form as materialized (
    select word, n, coalesce(n_near, 0) n_near, case when -b[1] >= 10 * n then b[2] end form, case when -b[1] >= 10 * n then -b[1] end form_n from word left join best using (word)
), chain as (
    select word, word root from form union all select chain.word, form.form from chain join form on form.word = chain.root where form.form is not null
)
select form.word, form, root, n, n_near, form_n from form join chain using (word) where root in (select word from form where form is null)"""


@query
def op13_partenum_spellings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spelling variants among the words of all documents."""
    return spellings.spelling_groups(common.table(spark, sf_dir, "documents"))
