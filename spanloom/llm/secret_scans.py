"""Secret scans with corpus-wide ownership frequency.

Fixed patterns give the base spans. Beside them, strings that look random are candidates: they mix letters
and digits, are 20 characters or longer and have a high character entropy. Every find is hashed inside the scan, the
value of a base span (group 2 of `assign`, else the match) as well as a candidate, and its hash is aggregated over the
corpus by distinct repositories and by distinct owners: a key that many hold as `token=...` and one holds bare is
the same key. What several owners hold, or one owner in many repositories, is a copied example: a licence key of
a tutorial, a test vector, a template. What one owner holds in few repositories looks live. Live candidates are
added as spans of kind `owned`; base spans all stay, and carry their verdict.

Hashes are pre-aggregated by (hash, repository, owner) before the shuffle, so a string that a third of all
rows hold costs one row for each task and repository; where finds meet their verdicts, heavy hashes are dealt.

Defined cases: a null or empty text has no spans; a null repository or owner counts as one of its own; rows
that are equal in id and text get equal results, each its own row; a null id keeps its row; spans that begin
together are ordered by kind; a very long text is scanned whole, as one string of its task; columns of any name
are carried along by `redact`, which works beside a struct of the whole row.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanloom.llm import common as C
from spanloom.operators.skew import spread_join
from spanloom.scratch import Scratch

KINDS = ("assign", "access", "hex")
#: The base patterns, with the least length of group 2, of the match, and of the match.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS, HEX = re.compile(r"AKIA[A-Z0-9]{16,}"), re.compile(r"[0-9a-f]{24,}")
LEAST_VALUE = 6
#: Candidates: least length, least bits of entropy a character, and most owners and repositories of a string that looks live.
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
LEAST_ENTROPY, MOST_OWNERS, MOST_REPOS = 3.5, 1, 2
_KEYWORD = re.compile(r"pass|secret|token|api", re.IGNORECASE | re.ASCII)
_DIGIT, _LETTER = re.compile(r"[0-9]"), re.compile(r"[A-Za-z]")


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, end, index of the kind), by start and kind. Offsets are code points, ends exclusive."""
    found = []
    if _KEYWORD.search(text):
        found += [(m.start(), m.end(), 0) for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST_VALUE]
    if "AKIA" in text:
        found += [(m.start(), m.end(), 1) for m in ACCESS.finditer(text)]
    found += [(m.start(), m.end(), 2) for m in HEX.finditer(text)]
    return sorted(found, key=lambda x: (x[0], x[2]))


def entropy(value: str) -> float:
    n = len(value)
    return -sum(c / n * math.log2(c / n) for c in Counter(value).values())


def digest(value: str) -> bytes:
    return hashlib.sha256(value.encode()).digest()[:16]


def base_value(text: str, span: tuple[int, int, int]) -> str:
    """What a base span holds: the value given to the name of an `assign`, else all of it."""
    found = text[span[0] : span[1]]
    return ASSIGN.fullmatch(found)[2] if span[2] == 0 else found


def candidates(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, bytes]]:
    """(start, end, hash) of strings that look random and are not part of a base span."""
    out, at = [], 0
    base = sorted(base)
    for m in CANDIDATE.finditer(text):
        value = m[0]
        if not _DIGIT.search(value) or not _LETTER.search(value):
            continue
        while at < len(base) and base[at][1] <= m.start():
            at += 1
        if any(b[0] < m.end() and m.start() < b[1] for b in base[at : at + 4]):
            continue
        if entropy(value) >= LEAST_ENTROPY:
            out.append((m.start(), m.end(), digest(value)))
    return out


def finds(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int, bytes]]:
    """(start, end, index of the kind, hash) of base spans and candidates."""
    return [(*b, digest(base_value(text, b))) for b in base] + [(s, e, len(KINDS), h) for s, e, h in candidates(text, base)]


def line(spans) -> str:
    return ",".join(f"{kind}:{start}:{end}" for start, end, kind in spans)


SCHEMA = "doc_id long, repo string, owner string, row_key binary, n_assign long, n_access long, n_hex long, base array<struct<start:long,stop:long,kind:int>>, found array<struct<start:long,stop:long,kind:int,hash:binary>>"
_SPAN = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64()), ("kind", pa.int32())]))
_FOUND = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64()), ("kind", pa.int32()), ("hash", pa.binary())]))


def row_key(doc_id: int | None, text: bytes) -> bytes:
    """A digest of id and text, which names a row in joins."""
    return hashlib.sha256(f"{doc_id}\0".encode() + text).digest()[:16]


def _name(of) -> Column:
    return (F.col(of) if isinstance(of, str) else of).cast("string")


def scan(docs: DataFrame, repo="source", owner="source") -> DataFrame:
    """Base spans, and base spans and candidates with their hashes, of every whole text; row_key is a digest of id and text."""

    def run(batches):
        for b in batches:
            ids = b.column("doc_id").to_pylist()
            for lo, hi, data, at in C.chunks(b.column("text")):
                keys, counts, spans, found = [], ([], [], []), [], []
                raw = data.tobytes()
                for i, s, e in zip(ids[lo:hi], at[:-1].tolist(), at[1:].tolist()):
                    text = raw[s:e].decode()
                    base = base_spans(text)
                    keys.append(row_key(i, raw[s:e]))
                    for k, c in enumerate(counts):
                        c.append(sum(x[2] == k for x in base))
                    spans.append([{"start": x, "stop": y, "kind": k} for x, y, k in base])
                    found.append([{"start": x, "stop": y, "kind": k, "hash": h} for x, y, k, h in finds(text, base)])
                yield pa.RecordBatch.from_arrays(
                    [*(b.column(c)[lo:hi] for c in ("doc_id", "repo", "owner")), pa.array(keys, pa.binary()), *(pa.array(c, pa.int64()) for c in counts), pa.array(spans, _SPAN), pa.array(found, _FOUND)],
                    names=["doc_id", "repo", "owner", "row_key", "n_assign", "n_access", "n_hex", "base", "found"],
                )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), _name(repo).alias("repo"), _name(owner).alias("owner"), "text")
    return rows.mapInArrow(run, SCHEMA)


def ownership(found: DataFrame) -> DataFrame:
    """hash, n_repos, n_owners, n_uses over all finds of (hash, repo, owner)."""
    held = found.groupBy("hash", "repo", "owner").agg(F.count("*").alias("n"))
    nul = F.lit("\0")
    return held.groupBy("hash").agg(F.countDistinct(F.coalesce("repo", nul)).alias("n_repos"), F.countDistinct(F.coalesce("owner", nul)).alias("n_owners"), F.sum("n").alias("n_uses"))


def verdict(most_owners: int = MOST_OWNERS, most_repos: int = MOST_REPOS) -> Column:
    """What n_owners and n_repos say of a find: `live`, or a `copied` example."""
    return F.when((F.col("n_owners") <= most_owners) & (F.col("n_repos") <= most_repos), "live").otherwise("copied")


def find_table(scanned: DataFrame, most_owners: int = MOST_OWNERS, most_repos: int = MOST_REPOS) -> DataFrame:
    """row_key, doc_id, start, stop, kind, hash, n_repos, n_owners, n_uses, verdict of every find of a scanned table."""
    found = scanned.where(F.size("found") > 0).select("doc_id", "row_key", "repo", "owner", F.explode("found").alias("f")).select("doc_id", "row_key", "repo", "owner", "f.*")
    held = Scratch(scanned.sparkSession, "secret_owners").save(ownership(found).withColumn("verdict", verdict(most_owners, most_repos)))
    total = held.agg(F.coalesce(F.sum("n_uses"), F.lit(0))).first()[0]
    return spread_join(found.drop("repo", "owner"), held, ["hash"], "n_uses", total)


def judge(docs: DataFrame, repo="source", owner="source", most_owners: int = MOST_OWNERS, most_repos: int = MOST_REPOS) -> DataFrame:
    """One row for each document: counts, base spans, and `all`: base spans and live candidates, by start and kind, each with its verdict. repo, owner: columns."""
    scanned = Scratch(docs.sparkSession, "secret_scans").save(scan(docs, repo, owner), "scanned")
    told = find_table(scanned, most_owners, most_repos).where((F.col("kind") < len(KINDS)) | (F.col("verdict") == "live"))
    span = F.struct("start", "kind", "stop", "verdict")
    # Rows equal in id and text share a key, and so would tell each span several times.
    spans = told.groupBy("row_key").agg(F.sort_array(F.collect_set(span)).alias("all"))
    plain = scanned.select("doc_id", "row_key", "n_assign", "n_access", "n_hex", "base", F.size("found").alias("n_found"))
    none = F.array().cast(spans.schema["all"].dataType)
    with_found = plain.where("n_found > 0").join(spans, "row_key", "left")
    both = with_found.unionByName(plain.where("n_found = 0").withColumn("all", none))
    return both.select("doc_id", "row_key", "n_assign", "n_access", "n_hex", "base", F.coalesce("all", none).alias("all"))


def span_text(column: str):
    names = F.array(*[F.lit(k) for k in (*KINDS, "owned")])
    return F.array_join(F.transform(column, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["stop"].cast("string"))), ",")


def verdict_text(column: str) -> Column:
    return F.array_join(F.transform(column, lambda s: s["verdict"]), ",")


def redacted(text: str, spans: list, mark: str) -> str:
    """The text with each span replaced by the mark; of spans that overlap, only what is beyond the last end goes."""
    out, at = [], 0
    for x in spans:
        if x["start"] >= at:
            out += [text[at : x["start"]], mark]
        at = max(at, x["stop"])
    return "".join(out) + text[at:]


def redact(docs: DataFrame, repo="source", owner="source", mark: str = "[REDACTED]") -> DataFrame:
    """The documents with every found span replaced by the mark; n_chars, where there is one, follows the text."""
    names = docs.columns
    spans = judge(docs, repo, owner).where(F.size("all") > 0).groupBy("row_key").agg(F.first("all").alias("spans"))
    text = F.coalesce(F.col("text"), F.lit(""))
    key = F.substring(F.unhex(F.sha2(F.concat(F.coalesce(F.col("doc_id").cast("long").cast("string"), F.lit("None")), F.lit("\0"), text), 256)), 1, 16)
    rows = docs.select(F.struct("*").alias("row"), key.alias("row_key")).join(spans.hint("merge"), "row_key", "left").select("row", "spans")

    def run(batches):
        for b in batches:
            cols, spans = dict(zip(names, b.column("row").flatten())), b.column("spans")
            hit = spans.is_valid()
            which = np.flatnonzero(hit.to_numpy(zero_copy_only=False))
            texts = [redacted(cols["text"][i].as_py(), spans[i].as_py(), mark) for i in which.tolist()]
            cols["text"] = pc.replace_with_mask(cols["text"], hit, pa.array(texts, pa.string()))
            if "n_chars" in cols:
                sizes = pa.array([len(t) for t in texts], pa.int64()).cast(cols["n_chars"].type)
                cols["n_chars"] = pc.replace_with_mask(cols["n_chars"], hit, sizes)
            yield pa.RecordBatch.from_arrays(list(cols.values()), names=names)

    return rows.mapInArrow(run, docs.schema)


def repository() -> Column:
    """The table names no repositories: a source's section in one language stands for one, and the source for its owner."""
    return F.concat_ws("/", "source", "lang")


def op7(spark, sf_dir: str) -> DataFrame:
    out = judge(C.read(spark, sf_dir, "documents"), repository())
    return out.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2(span_text("base"), 256).alias("base_sha256"), span_text("all").alias("spans"), verdict_text("all").alias("verdicts"))


ORACLE = r"""
WITH texts AS (SELECT doc_id, source, concat_ws('/', source, lang) AS repo, coalesce(text, '') AS text FROM documents),
patterns(kind, place, pattern, least) AS (
  VALUES ('assign', 0, '([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)', 0),
         ('access', 1, 'AKIA[A-Z0-9]+', 20), ('hex', 2, '[0-9a-f]+', 24), ('owned', 3, '[A-Za-z0-9+/_=-]+', 20)),
cut AS (
  SELECT doc_id, source, repo, kind, place, least, pattern, regexp_extract_all(text, pattern) AS found, string_split_regex(text, pattern) AS between
  FROM texts, patterns),
matches AS (
  SELECT doc_id, source, repo, kind, place, least, pattern, unnest(found) AS value, unnest(between[:len(found)]) AS before, unnest(range(len(found))) AS i FROM cut),
placed AS (
  SELECT *, CAST(sum(length(before) + length(value)) OVER (PARTITION BY doc_id, kind ORDER BY i) AS BIGINT) AS stop FROM matches),
spans AS (
  SELECT doc_id, source, repo, kind, place, pattern, value, stop - length(value) AS start, stop FROM placed
  WHERE length(value) >= least AND (kind <> 'assign' OR length(regexp_extract(value, pattern, 2)) >= 6)),
base AS (SELECT doc_id, source, repo, kind, place, start, stop, CASE kind WHEN 'assign' THEN regexp_extract(value, pattern, 2) ELSE value END AS value FROM spans WHERE kind <> 'owned'),
random AS (
  SELECT * EXCLUDE (pattern) FROM spans s WHERE kind = 'owned' AND regexp_matches(value, '[0-9]') AND regexp_matches(value, '[A-Za-z]')
    AND NOT EXISTS (SELECT 1 FROM base b WHERE b.doc_id = s.doc_id AND b.start < s.stop AND s.start < b.stop)),
letters AS (
  SELECT value, letter, count(*) AS n FROM (SELECT value, unnest(string_split(value, '')) AS letter FROM (SELECT DISTINCT value FROM random)) GROUP BY ALL),
mixed AS (SELECT value FROM letters GROUP BY value HAVING -sum(n / length(value) * log2(n / length(value))) >= 3.5),
found AS (SELECT * FROM base UNION ALL BY NAME SELECT random.* FROM random JOIN mixed USING (value)),
owners AS (
  SELECT value, CASE WHEN count(DISTINCT coalesce(source, chr(1))) = 1 AND count(DISTINCT coalesce(repo, chr(1))) <= 2 THEN 'live' ELSE 'copied' END AS verdict FROM found GROUP BY value),
every AS (SELECT doc_id, kind, place, start, stop, verdict FROM found JOIN owners USING (value) WHERE kind <> 'owned' OR verdict = 'live'),
lines AS (
  SELECT doc_id, count(*) FILTER (WHERE kind = 'assign') AS n_assign, count(*) FILTER (WHERE kind = 'access') AS n_access, count(*) FILTER (WHERE kind = 'hex') AS n_hex,
    string_agg(concat_ws(':', kind, start, stop), ',' ORDER BY start, place) FILTER (WHERE kind <> 'owned') AS base,
    string_agg(concat_ws(':', kind, start, stop), ',' ORDER BY start, place) AS spans, string_agg(verdict, ',' ORDER BY start, place) AS verdicts
  FROM every GROUP BY doc_id)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(verdicts, '') AS verdicts
FROM documents LEFT JOIN lines USING (doc_id)
"""
