"""Queries over words, sentences, text retrieval and text quality."""

from __future__ import annotations

from pyspark.sql import functions as F

from spanloom import tables as T
from spanloom.functions import numbers as N
from spanloom.functions import text as X
from spanloom.operators import retrieval as R
from spanloom.operators import scorecards as Y
from spanloom.operators import sentences as S
from spanloom.scratch import Scratch
from spanloom.tables import with_tables

QUERIES, ORACLES = {}, {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


OPEN = ", ".join(f"'{w}'" for w in S.OPEN_WORDS)
SENTENCES = f""", w0 as (select *, lead(start_ms) over (partition by media_id order by pos) as nxt, regexp_matches(w, '[{S.FINAL_MARKS}]$') as fin from words),
 w1 as (select *, (fin or coalesce(nxt - end_ms >= 500, false)) as ends from w0),
 w2 as (select *, coalesce(sum(cast(ends as bigint)) over (partition by media_id order by pos rows between unbounded preceding and 1 preceding), 0) as sid from w1),
 sent as (select media_id, cast(sid as bigint) as sent_id, min(start_ms) as start_ms, max(end_ms) as end_ms, string_agg(w, ' ' order by pos) as text, count(*) as n_words,
   not (lower(regexp_replace(arg_max(w, pos), '\\p{{P}}', '', 'g')) in ({OPEN})) and (bool_or(fin and nxt_pos) or bool_or(has_next)) as complete
   from (select *, pos = max(pos) over (partition by media_id, sid) as nxt_pos, (pos = max(pos) over (partition by media_id, sid) and nxt is not null) as has_next from w2) group by media_id, sid)"""


def sentences(spark, d, of=None, text=True):
    """of: spans (media_id, in_ms, out_ms); only sentences of the recordings that these name, written, as those who ask for
    them read them more than once. text: false leaves that column out."""
    rows = S.segment_rows(T.transcripts(spark, d, of), text=text)
    return rows if of is None else Scratch(spark, "sentences").save(rows)


@query("q5_1_segment_sentences", with_tables("words", SENTENCES + " select media_id, sent_id, start_ms, end_ms, complete, n_words, md5(text) as text_md5 from sent"))
def segment(spark, d):
    return sentences(spark, d).select("media_id", "sent_id", "start_ms", "end_ms", "complete", "n_words", F.md5(F.col("text").cast("binary")).alias("text_md5"))


@query("q5_2_dangling_fragments", with_tables("words", SENTENCES + " select media_id, sent_id, n_words from sent where not complete"))
def dangling(spark, d):
    return sentences(spark, d).where("not complete").select("media_id", "sent_id", "n_words")


@query("q5_3_anchors", with_tables("words", SENTENCES + " select media_id, min(start_ms) as anchor_in_ms, max(end_ms) as anchor_out_ms from sent where complete group by media_id"))
def anchors(spark, d):
    return S.anchors(sentences(spark, d))


@query("q5_4_deliverable_order", with_tables("words", SENTENCES + " select media_id, sent_id from (select *, lag(end_ms + case when n_words % 5 = 0 then 900 else 0 end) over (partition by media_id order by start_ms, sent_id) as b from sent) where b > start_ms"))
def order(spark, d):
    """Some sentences are held longer than the next one waits."""
    held = F.col("end_ms") + F.when(F.col("n_words") % 5 == 0, 900).otherwise(0)
    return S.out_of_order(sentences(spark, d).withColumn("end_ms", held)).select("media_id", "sent_id")


@query("q5_24_dead_air", with_tables("words", ", g as (select media_id, pos, start_ms - lag(end_ms) over (partition by media_id order by start_ms) as gap_ms from words) select media_id, pos, gap_ms from g where gap_ms > 700"))
def dead_air(spark, d):
    return S.gaps(T.words(spark, d), "media_id", 700).select("media_id", "pos", "gap_ms")


@query("q5_26_word_cut_points", with_tables("words", ", g as (select media_id, start_ms as cut_ms, start_ms - lag(end_ms) over (partition by media_id order by start_ms) as gap_ms from words) select media_id, cut_ms from g where gap_ms >= 120"))
def word_cuts(spark, d):
    return S.gaps(T.words(spark, d), "media_id", 119).select("media_id", F.col("start_ms").alias("cut_ms"))


@query("q1_28_build_srt", with_tables("words", SENTENCES + """, n as (select *, row_number() over (partition by media_id order by start_ms, sent_id) as k from sent where complete),
 tm as (select *, format('{:02d}:{:02d}:{:02d},{:03d}', start_ms // 3600000, start_ms // 60000 % 60, start_ms // 1000 % 60, start_ms % 1000) as a, format('{:02d}:{:02d}:{:02d},{:03d}', end_ms // 3600000, end_ms // 60000 % 60, end_ms // 1000 % 60, end_ms % 1000) as z from n)
 select media_id, md5(string_agg(k || chr(10) || a || ' --> ' || z || chr(10) || text || chr(10), chr(10) order by k)) as srt_md5, count(*) as n_cues from tm group by media_id"""))
def srt(spark, d):
    from spanloom.sources import documents as J

    got = J.srt(sentences(spark, d).where("complete"), "media_id", "sent_id")
    return got.select("media_id", F.md5(F.col("srt").cast("binary")).alias("srt_md5"), "n_cues")


TOKENS = r""" tok as (select doc_id, unnest(list_filter(string_split_regex(regexp_replace(text, '\p{P}', '', 'g'), '\s+'), lambda x: x <> '')) as term from documents)"""


@query("q8_13_index_tokens", "with" + TOKENS + " select doc_id, count(*) as n_tokens, count(distinct term) as n_terms from tok group by doc_id")
def tokens(spark, d):
    return R.words_field(T.read(spark, d, "documents")).groupBy("doc_id").agg(F.count("*").alias("n_tokens"), F.countDistinct("term").alias("n_terms"))


@query("q8_14_character_ngrams", r"with t as (select item_id, unnest(list_filter(string_split_regex(regexp_replace(text, '\p{P}', '', 'g'), '\s+'), lambda x: x <> '')) as w from benchmark), p as (select item_id, chr(2) || w || chr(3) as w from t), g as (select item_id, substr(w, i, 3) as gram from (select item_id, w, unnest(range(1, greatest(length(w) - 1, 2))) as i from p)) select item_id, count(*) as n_grams, count(distinct gram) as n_distinct from g group by item_id")
def ngrams(spark, d):
    field = R.words_field(T.read(spark, d, "benchmark"), "item_id")
    return R.ngrams_field(field).groupBy(F.col("doc_id").alias("item_id")).agg(F.count("*").alias("n_grams"), F.countDistinct("term").alias("n_distinct"))


BM25 = """{n}_tf as (select term, doc_id, count(*) as tf from {field} group by 1, 2), {n}_len as (select doc_id, sum(tf) as len from {n}_tf group by 1), {n}_tot as (select count(*) as n, avg(len) as mean from {n}_len),
 {n}_q as (select query_id, term, count(*) as qtf from {asked} group by 1, 2), {n}_df as (select term, count(*) as df from {n}_tf group by 1),
 {n}_s as (select query_id, t.doc_id, sum(qtf * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (1 - 0.75 + 0.75 * len / mean))) as score from {n}_q q join {n}_tf t on t.term = q.term join {n}_df d on d.term = q.term join {n}_len l on l.doc_id = t.doc_id cross join {n}_tot group by 1, 2)"""
GRAMS = ", {out} as (select {id}, substr(w, i, 3) as term from (select {id}, w, unnest(range(1, greatest(length(w) - 1, 2))) as i from (select {id}, chr(2) || term || chr(3) as w from {field})))"
ASKED = r""", ask as (select item_id as query_id, unnest(list_filter(string_split_regex(regexp_replace(text, '\p{P}', '', 'g'), '\s+'), lambda x: x <> '')) as term from benchmark)"""


def asked(spark, d):
    """The whole text of each benchmark item is a query."""
    return T.read(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))


@query("q6_4_field_score", "with" + TOKENS + ASKED + ", " + BM25.format(n="w", field="tok", asked="ask") + " select query_id, doc_id, round(score, 6) as score from w_s")
def field_score(spark, d):
    q = asked(spark, d).select("query_id", F.explode(X.tokens("query")).alias("term"))
    docs = T.read(spark, d, "documents").select("doc_id", F.coalesce(X.tokens("text"), F.array().cast("array<string>")).alias("tokens"))
    return R.score_all(docs, q).select("query_id", "doc_id", F.round("score", 6).alias("score"))


@query("q6_1_bm25_index", "with" + TOKENS + " select term, count(distinct doc_id) as df, count(*) as cf from tok group by term")
def bm25_index(spark, d):
    """Counts of terms, read from the stored index that searches use."""
    index = R.build_index(R.spread(T.read(spark, d, "documents")), f"{Scratch(spark, 'bm25').root}/index")
    return R.term_counts(index)


@query("q6_5_bm25_search", "with" + TOKENS + ASKED + GRAMS.format(out="tok3", id="doc_id", field="tok") + GRAMS.format(out="ask3", id="query_id", field="ask") + ", " + BM25.format(n="w", field="tok", asked="ask") + ", " + BM25.format(n="g", field="tok3", asked="ask3") + """,
 j as (select coalesce(w.query_id, g.query_id) as query_id, coalesce(w.doc_id, g.doc_id) as doc_id, coalesce(w.score, 0) as ws, coalesce(g.score, 0) as gs from w_s w full outer join g_s g on w.query_id = g.query_id and w.doc_id = g.doc_id),
 r as (select *, ws + 0.5 * gs as score, row_number() over (partition by query_id order by round(ws + 0.5 * gs, 9) desc, doc_id) as rank from j)
 select query_id, doc_id, round(ws, 6) as word_score, round(score, 6) as score, rank from r where rank <= 10""")
def search(spark, d):
    return R.search(T.read(spark, d, "documents"), asked(spark, d), 10).select("query_id", "doc_id", F.round("word_score", 6).alias("word_score"), F.round("score", 6).alias("score"), "rank")


@query("q6_2_bm25_from_sentences", with_tables("words", SENTENCES + r" select media_id, sent_id, len(list_filter(string_split_regex(regexp_replace(text, '\p{P}', '', 'g'), '\s+'), lambda x: x <> '')) as n_tokens from sent"))
def sentence_docs(spark, d):
    return sentences(spark, d).select("media_id", "sent_id", F.size(X.tokens("text")).cast("long").alias("n_tokens"))


COS = """v as (select vec_id, embedding, sqrt(list_sum(list_transform(embedding, lambda x: cast(x as double) * cast(x as double)))) as n from embeddings), q as (select * from v where vec_id % 20 = 0),
 c as (select q.vec_id as query_id, v.vec_id, list_sum(list_transform(list_zip(v.embedding, q.embedding), lambda z: cast(z[1] as double) * cast(z[2] as double))) / (v.n * q.n) as sim from v, q where v.n > 0 and q.n > 0),
 r as (select *, row_number() over (partition by query_id order by round(sim, 9) desc, vec_id) as rank from c)"""


@query("q6_6_vector_retrieve", "with " + COS + " select query_id, vec_id, round(sim, 6) as similarity, rank from r where rank <= 50")
def retrieve(spark, d):
    v = T.read(spark, d, "embeddings")
    q = v.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))
    return R.nearest_vectors(v, q, 50).select("query_id", "vec_id", F.round("similarity", 6).alias("similarity"), "rank")


def _newest_first(pdf):
    """A stand-in for a model: higher ids are better."""
    return pdf[["query_id", "vec_id"]].assign(new_score=pdf["vec_id"].astype(float))


@query("q6_7_rerank_and_keep", "with " + COS + ", k as (select query_id, vec_id, row_number() over (partition by query_id order by vec_id desc) as rank from r where rank <= 50) select query_id, vec_id, cast(vec_id as double) as new_score, rank from k where rank <= 5")
def rerank(spark, d):
    v = T.read(spark, d, "embeddings")
    q = v.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))
    return R.rerank(R.nearest_vectors(v, q, 50), _newest_first, "query_id long, vec_id long, new_score double", 5)[0]


@query("q2_7_embedding_contract", "select vec_id, len(embedding) as n_dims, not exists_bad and norm > 0 as valid, round(norm, 6) as norm from (select vec_id, embedding, len(list_filter(embedding, lambda x: isnan(x) or isinf(x))) > 0 as exists_bad, sqrt(list_sum(list_transform(embedding, lambda x: cast(x as double) * cast(x as double)))) as norm from embeddings)")
def embedding_contract(spark, d):
    v = T.read(spark, d, "embeddings")
    bad = F.exists("embedding", lambda x: F.isnan(x) | (F.abs(x) == float("inf")))
    return v.select("vec_id", F.size("embedding").cast("long").alias("n_dims"), (~bad & (N.norm("embedding") > 0)).alias("valid"), F.round(N.norm("embedding"), 6).alias("norm"))


@query("q2_8_uniform_index", "select label, count(*) as n, count(distinct len(embedding)) as n_sizes, count(*) - count(distinct vec_id) as n_duplicates from embeddings group by label")
def uniform_index(spark, d):
    from spanloom.operators.reports import index_report

    return index_report(T.read(spark, d, "embeddings"), "label", "vec_id", "embedding")


@query("q8_16_semantic_similarity", "with v as (select vec_id, embedding, sqrt(list_sum(list_transform(embedding, lambda x: cast(x as double) * cast(x as double)))) as n from embeddings) select a.vec_id, round(greatest(0.0, least(1.0, list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda z: cast(z[1] as double) * cast(z[2] as double))) / (a.n * b.n))), 6) as similarity from v a join v b on b.vec_id = a.vec_id + 1")
def semantic_similarity(spark, d):
    v = T.read(spark, d, "embeddings")
    b = v.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    return v.join(b, "vec_id").select("vec_id", F.round(N.similarity01("embedding", "other"), 6).alias("similarity"))


@query("q8_1_normalize", "select doc_id, md5(regexp_replace(translate(replace(text, 'ه' || chr(8204), 'ە'), 'يك٠١٢٣٤٥٦٧٨٩۰۱۲۳۴۵۶۷۸۹', 'یک01234567890123456789'), '^\\s+|\\s+$', '', 'g')) as norm_md5 from documents")
def normalize(spark, d):
    return T.read(spark, d, "documents").select("doc_id", F.md5(X.normalize("text").cast("binary")).alias("norm_md5"))


@query("q8_4_normalize_transcript", "select doc_id as media_id, sha256(text) as source_sha256, length(trim(text, ' ' || chr(9) || chr(10) || chr(13))) as n_chars from documents")
def normalize_transcript(spark, d):
    return T.read(spark, d, "documents").select(F.col("doc_id").alias("media_id"), F.sha2("text", 256).alias("source_sha256"), F.length(X.normalize("text")).cast("long").alias("n_chars"))


HYP = f"""h as (select item_id, translate(text, '{T.LETTERS}', {T.ONE_BYTE}) as ref, translate(replace(replace(text, 'th', 't'), 'on', 'om'), '{T.LETTERS}', {T.ONE_BYTE}) as hyp from benchmark)"""


def _hyp(spark, d):
    b = T.read(spark, d, "benchmark")
    return b.select("item_id", F.col("text").alias("ref"), F.replace(F.replace("text", F.lit("th"), F.lit("t")), F.lit("on"), F.lit("om")).alias("hyp"))


@query("q8_5_edit_distance", "with " + HYP + " select item_id, levenshtein(ref, hyp) as edits from h")
def edit_distance(spark, d):
    return _hyp(spark, d).select("item_id", F.levenshtein("ref", "hyp").cast("long").alias("edits"))


@query("q8_7_cer", "with " + HYP + " select item_id, round(levenshtein(ref, hyp) / cast(length(ref) as double), 9) as cer from h")
def cer(spark, d):
    return _hyp(spark, d).select("item_id", F.round(X.cer("ref", "hyp"), 9).alias("cer"))


@query("q8_8_normalized_cer", "with " + HYP + " select item_id, round(levenshtein(trim(ref), trim(hyp)) / cast(length(trim(ref)) as double), 9) as cer from h")
def normalized_cer(spark, d):
    return _hyp(spark, d).select("item_id", F.round(X.cer(X.normalize("ref"), X.normalize("hyp")), 9).alias("cer"))


@query("q8_9_spacing_free_cer", "with " + HYP + r", n as (select item_id, ref, regexp_replace(ref, '\s+', '', 'g') as a, regexp_replace(hyp, '\s+', '', 'g') as b from h) select item_id, round(levenshtein(a, b) / cast(length(a) as double), 9) as cer from n")
def spacing_free(spark, d):
    return _hyp(spark, d).select("item_id", F.round(X.spacing_free_cer("ref", "hyp"), 9).alias("cer"))


@query("q8_18_materially_disagree", "with " + HYP + " select item_id, case when trim(ref) = '' or trim(hyp) = '' then ref <> hyp else levenshtein(ref, hyp) / cast(length(ref) as double) >= 0.15 end as disagree from h")
def disagree(spark, d):
    return _hyp(spark, d).select("item_id", X.disagree("ref", "hyp").alias("disagree"))


@query("q8_10_named_entity_error", r"with e as (select b.item_id, replace(replace(b.text, 'th', 't'), 'on', 'om') as hyp, list_filter(string_split_regex(b.text, '\s+'), lambda x: regexp_matches(x, '^\p{Lu}')) as names from benchmark b) select item_id, round(len(list_filter(names, lambda n: not contains(hyp, n))) / cast(nullif(len(names), 0) as double), 9) as error_rate from e")
def entity_error(spark, d):
    names = F.filter(F.split("ref", r"\s+"), lambda x: x.rlike(r"^\p{Lu}")).alias("names")
    return _hyp(spark, d).select("item_id", names, "hyp").select("item_id", F.round(X.missing_share("hyp", "names"), 9).alias("error_rate"))


@query("q8_15_text_similarity", r"with s as (select item_id, list_distinct(list_filter(string_split_regex(text, '\s+'), lambda x: x <> '')) as ws from benchmark) select a.item_id, round(case when len(a.ws) = 0 or len(b.ws) = 0 then 0.0 else len(list_intersect(a.ws, b.ws)) / cast(len(list_distinct(list_concat(a.ws, b.ws))) as double) end, 9) as similarity from s a join s b on b.item_id = a.item_id + 1")
def text_similarity(spark, d):
    s = T.read(spark, d, "benchmark").select("item_id", F.filter(F.split("text", r"\s+"), lambda x: x != "").alias("ws"))
    return s.join(s.select((F.col("item_id") - 1).alias("item_id"), F.col("ws").alias("other")), "item_id").select("item_id", F.round(X.jaccard("ws", "other"), 9).alias("similarity"))


@query("q2_23_letter_share", r"select doc_id, round(coalesce(length(regexp_replace(text, '[^a-mA-M]', '', 'g')) / cast(nullif(length(regexp_replace(text, '[^\p{L}]', '', 'g')), 0) as double), 0.0), 9) as share from documents")
def letter_share(spark, d):
    return T.read(spark, d, "documents").select("doc_id", F.round(X.letter_share("text", "a-mA-M"), 9).alias("share"))


@query("q2_24_assert_letter_share", r"select doc_id from documents where coalesce(length(regexp_replace(text, '[^a-zA-Z]', '', 'g')) / cast(nullif(length(regexp_replace(text, '[^\p{L}]', '', 'g')), 0) as double), 0.0) >= 0.97")
def assert_share(spark, d):
    return T.read(spark, d, "documents").where(X.letter_share("text", "a-zA-Z") >= 0.97).select("doc_id")


@query("q4_1_measure_collisions", r"with n as (select text as raw, lower(regexp_replace(text, '\p{P}', '', 'g')) as norm from documents) select count(*) as n_items, count(*) filter (where raw <> norm) as n_changed, count(distinct raw) as n_raw, count(distinct norm) as n_norm, round(count(*) filter (where raw <> norm) / cast(nullif(count(*), 0) as double), 9) as changed_rate, round((count(distinct raw) - count(distinct norm)) / cast(nullif(count(distinct raw), 0) as double), 9) as collision_rate from n")
def collisions(spark, d):
    docs = T.read(spark, d, "documents").select(F.col("text").alias("raw"), F.lower(F.regexp_replace("text", r"\p{P}", "")).alias("norm"))
    return Y.collisions(docs, "raw", "norm").withColumns({c: F.round(c, 9) for c in ("changed_rate", "collision_rate")})


@query("q3_17_slice_text", with_tables("words verbal", ", o as (select v.candidate_id, string_agg(w.w, ' ' order by w.pos) as t, count(*) as n_words from verbal v join words w on w.media_id = v.media_id and w.start_ms < v.out_ms and v.in_ms < w.end_ms group by 1) select candidate_id, n_words, md5(t) as text_md5 from o"))
def slice_text(spark, d):
    from spanloom.operators.spans import overlap_join

    v = T.candidates(spark, d, "click").select("candidate_id", "media_id", "in_ms", "out_ms")
    met = overlap_join(v, T.words(spark, d, v, whole=False), "media_id", ("in_ms", "out_ms"), ("start_ms", "end_ms"))
    got = met.groupBy("candidate_id").agg(F.count("*").alias("n_words"), F.array_sort(F.collect_list(F.struct("pos", "w"))).alias("ws"))
    return got.select("candidate_id", "n_words", F.md5(F.array_join(F.transform("ws", lambda x: x["w"]), " ").cast("binary")).alias("text_md5"))


@query("q3_15_sentences_within", with_tables("words verbal", SENTENCES + " select v.candidate_id, s.sent_id from verbal v join sent s on s.media_id = v.media_id and s.complete and v.in_ms <= s.start_ms and s.end_ms <= v.out_ms"))
def sentences_within(spark, d):
    from spanloom.operators.spans import overlap_join

    v = T.candidates(spark, d, "click").select("candidate_id", "media_id", "in_ms", "out_ms")
    met = overlap_join(v, sentences(spark, d, v, text=False).where("complete"), "media_id", ("in_ms", "out_ms"), ("start_ms", "end_ms"))
    return met.where("in_ms <= start_ms and end_ms <= out_ms").select("candidate_id", "sent_id")


@query("q3_16_sentences_overlapping", with_tables("words verbal", SENTENCES + " select v.candidate_id, s.sent_id from verbal v join sent s on s.media_id = v.media_id and s.complete and v.in_ms < s.end_ms and s.start_ms < v.out_ms"))
def sentences_overlapping(spark, d):
    from spanloom.operators.spans import overlap_join

    v = T.candidates(spark, d, "click").select("candidate_id", "media_id", "in_ms", "out_ms")
    return overlap_join(v, sentences(spark, d, v, text=False).where("complete"), "media_id", ("in_ms", "out_ms"), ("start_ms", "end_ms")).select("candidate_id", "sent_id")


@query("q5_45_sentence_runs", with_tables("words verbal", SENTENCES + """, m as (select v.candidate_id, s.sent_id, s.start_ms, s.end_ms from verbal v join sent s on s.media_id = v.media_id and s.complete and v.in_ms <= s.start_ms and s.end_ms <= v.out_ms),
 r as (select *, sent_id - row_number() over (partition by candidate_id order by sent_id) as run from m), a as (select candidate_id, run, min(sent_id) as first_sent, max(sent_id) as last_sent, max(end_ms) - min(start_ms) as ms from r group by 1, 2),
 k as (select *, row_number() over (partition by candidate_id order by ms desc, first_sent) as k from a) select candidate_id, first_sent, last_sent, ms from k where k = 1"""))
def sentence_runs(spark, d):
    from spanloom.operators.spans import overlap_join, runs

    v = T.candidates(spark, d, "click").select("candidate_id", "media_id", "in_ms", "out_ms")
    met = overlap_join(v, sentences(spark, d, v, text=False).where("complete"), "media_id", ("in_ms", "out_ms"), ("start_ms", "end_ms")).where("in_ms <= start_ms and end_ms <= out_ms")
    a = runs(met, ["candidate_id"], "sent_id").groupBy("candidate_id", "run").agg(F.min("sent_id").alias("first_sent"), F.max("sent_id").alias("last_sent"), (F.max("end_ms") - F.min("start_ms")).alias("ms"))
    best = a.groupBy("candidate_id").agg(F.min_by(F.struct("first_sent", "last_sent", "ms"), F.struct(-F.col("ms"), "first_sent")).alias("b"))
    return best.select("candidate_id", "b.*")
