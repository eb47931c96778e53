"""Queries over lexicons counted from the documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from spanloom import tables as T
from spanloom.functions import text as X
from spanloom.operators import lexicon as L

QUERIES, ORACLES = {}, {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


#: The lexicon: words the documents hold so often; the particle, and the endings a word may carry.
LEAST, PARTICLE, ENDINGS = 20, "an", ("s", "en", "ing")
_KNOWN = " or ".join([f"exists (select 1 from lex where lex.word = {{w}})", *(f"(ends_with({{w}}, '{s}') and length({{w}}) > {len(s)} and exists (select 1 from lex where lex.word = left({{w}}, length({{w}}) - {len(s)})))" for s in ENDINGS)])
_SQL = rf"""with norm as (select doc_id, regexp_replace(translate(replace(text, 'ه' || chr(8204), 'ە'), 'يك٠١٢٣٤٥٦٧٨٩۰۱۲۳۴۵۶۷۸۹', 'یک01234567890123456789'), '^\s+|\s+$', '', 'g') as text from documents),
 tok as (select doc_id, unnest(regexp_extract_all(text, '[\p{{L}}\p{{N}}_]+')) as word from norm), cnt as (select word, count(*) as n from tok group by 1), lex as (select word from cnt where n >= {LEAST})"""


def normalized(spark, d):
    return T.read(spark, d, "documents").select("doc_id", X.normalize("text").alias("text"))


@query("q8_3_is_word", _SQL + f", told as (select word, ({_KNOWN.format(w='cnt.word')}) as known from cnt) select n.doc_id, count(t.word) as n_tokens, count(*) filter (where known) as n_words from norm n left join tok t on t.doc_id = n.doc_id left join told on told.word = t.word group by 1")
def is_word(spark, d):
    """How many words of each document the lexicon has, as they stand or with one of the endings."""
    docs = normalized(spark, d)
    return L.word_shares(docs, "doc_id", L.from_texts(docs, LEAST), ENDINGS)


@query("q8_2_separate_particle", _SQL + rf""", cand as (select word, substr(word, {len(PARTICLE) + 1}) as rest from cnt where starts_with(word, '{PARTICLE}') and length(word) > {len(PARTICLE)}),
 split as (select word from cand where ({_KNOWN.format(w='cand.rest')}) and not ({_KNOWN.format(w='cand.word')})),
 piece as (select doc_id, unnest(p) as piece, unnest(range(len(p))) as i from (select doc_id, regexp_extract_all(text, '[\p{{L}}\p{{N}}_]+|[^\p{{L}}\p{{N}}_]+') as p from norm)),
 cut as (select p.doc_id, i, s.word is not null as yes, case when s.word is not null then '{PARTICLE} ' || substr(piece, {len(PARTICLE) + 1}) else piece end as piece from piece p left join split s on s.word = p.piece)
 select n.doc_id, count(*) filter (where yes) as n_splits, md5(coalesce(string_agg(piece, '' order by i), '')) as text_md5 from norm n left join cut c on c.doc_id = n.doc_id group by 1""")
def separate(spark, d):
    """Documents with a joined particle separated, after the letters were normalised."""
    docs = normalized(spark, d)
    out = L.separate(docs, "doc_id", L.from_texts(docs, LEAST), PARTICLE, ENDINGS)
    return out.select("doc_id", "n_splits", F.md5(F.coalesce("text", F.lit("")).cast("binary")).alias("text_md5"))
