"""Substring deduplication with suffix automata of reference shards.

A word of a document goes if it lies in a run of WINDOW words that also begins in a document with a smaller id.
No automaton of a whole corpus fits a task, so the automata are not broadcast: each passage is sent only to the
shards that can hold its runs.

1. Every window names an anchor, its 5-word gram of the least hash; windows with equal words have equal anchors.
   Neighbouring windows with one anchor are one snippet (21 words at most). For each anchor the corpus is asked
   for the smallest and the largest id, and whether all its snippets are equal: pre-aggregated, and joined back
   with the heavy anchors dealt over tasks.
2. Where all snippets of an anchor are equal, its reference is the document with the smallest id. A document's
   neighbouring snippets with one reference are one passage, which goes to that document's shard; the reference
   sends its own passages, and they make up the shard's suffix automaton over words.
3. The other anchors are shards of their own: of each the distinct snippets, with the smallest id that has them.
4. Distinct passages are streamed through the automaton of their shard (thousands of copies are one). Each state
   knows the smallest id it occurs in, so the matching statistics give the maximal spans of at least WINDOW
   words, cut where that id changes.
5. A shard with more than SHARD_SNIPPETS distinct snippets (a common phrase in many contexts) is split by longer
   anchors, of 9 words and then of a whole window; a reference with many passages is copied to several tasks,
   which share the passages. An automaton holds BLOCK words; a longer reference is met in overlapping blocks.
6. Spans go back to the documents that have the passage; those whose id is smaller than the document's own go.

Windows are judged on the input, not on what is left. The words themselves decide in the automata; passages are
known by two independent 64-bit hashes (of the anchor or reference, and of all words).

Defined cases: null and empty texts have no words and stay as they are; a row with a null id comes after all
others and is never a reference; rows with equal ids do not remove each other's words, each is judged by its own
text; a very long text is one row of a task, and its automaton is met in blocks; columns of any name are carried
along, since the work is done beside a struct of the whole row.
"""

from __future__ import annotations

import hashlib
from itertools import compress

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.llm import common as C
from spanloom.operators.skew import spread_join
from spanloom.scratch import Scratch

WINDOW = 13
#: Words of an anchor, at first and where a shard is split.
ANCHOR, LONGER = 5, (9, WINDOW)
#: Most distinct passages of a shard before it is split or dealt; characters of passages for one task of a reference; words of an automaton.
SHARD_SNIPPETS, SHARD_CHARS, BLOCK = 1000, 4_000_000, 50_000
#: Stands for a null id: after all others.
LAST_ID = (1 << 63) - 1
_R = 0x9E3779B97F4A7C15
_R_INVERSE = pow(_R, -1, 1 << 64)


_inverse = np.ones(1, np.uint64)


def _inverse_powers(n: int) -> np.ndarray:
    """At least n powers of the inverse of the hash base, kept between calls."""
    global _inverse
    if len(_inverse) < n:
        steps = np.full(max(n, 4096), np.uint64(_R_INVERSE))
        steps[0] = 1
        _inverse = np.multiply.accumulate(steps)
    return _inverse


def anchors(data: np.ndarray, at: np.ndarray, words: int = ANCHOR) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, key, snippet hash, first word in the row, words) of each snippet, in order."""
    starts, _, bounds = C.words(data, at)
    where = C.starts_in_rows(bounds, WINDOW)
    if not len(where):
        empty = np.zeros(0, np.int64)
        return empty, empty, empty, empty, empty
    hashes = C.span_hashes(data, starts, C.WORD_KEYS)
    gram = C.grams(hashes, words)
    n = len(gram) - (WINDOW - words)
    best, off = gram[:n].copy(), np.zeros(n, np.int8)
    for k in range(1, WINDOW - words + 1):
        less = gram[k : k + n] < best
        np.copyto(best, gram[k : k + n], where=less)
        np.copyto(off, k, where=less)
    place = where + off[where]
    fresh = np.ones(len(where), bool)
    fresh[1:] = (place[1:] != place[:-1]) | (where[1:] != where[:-1] + 1)
    first = np.flatnonzero(fresh)
    last = np.append(first[1:], len(where)) - 1
    s, e, p = where[first], where[last] + WINDOW, place[first]
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(hashes * C.powers(len(hashes))[: len(hashes)])))
    whole = (sums[e] - sums[s]) * _inverse_powers(len(hashes))[s]
    snippet = C.mix(whole + (e - s).astype(np.uint64) * C.GRAM_KEYS[50] + (p - s).astype(np.uint64) * C.GRAM_KEYS[51])
    row = np.searchsorted(bounds, s, "right") - 1
    return row, gram[p].view(np.int64), snippet.view(np.int64), s - bounds[row], e - s


def with_key(docs: DataFrame) -> DataFrame:
    """doc, text, and t, a hash of the text that tells rows of one id (or of none) apart."""
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST_ID)).alias("doc"), "text", F.xxhash64("text").alias("t"))


def occurrences(docs: DataFrame) -> DataFrame:
    """k, g, doc, r of each snippet, once for each row; r is t where the id is null (so that such rows are not one group), else 0."""

    def run(batches):
        for b in batches:
            ids, texts = b.column("doc").to_numpy(), b.column("t").to_numpy()
            rest = np.where(ids == LAST_ID, texts, 0)
            for lo, hi, data, at in C.chunks(b.column("text")):
                row, key, snippet, _, _ = anchors(data, at)
                own = C.mix(key.view(np.uint64) + row.astype(np.uint64) * C.GRAM_KEYS[52]) + snippet.view(np.uint64)
                _, once = np.unique(own, return_index=True)
                row, key, snippet = row[once], key[once], snippet[once]
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(snippet), pa.array(ids[lo:hi][row]), pa.array(rest[lo:hi][row])], names=["k", "g", "doc", "r"])

    return with_key(docs).mapInArrow(run, "k long, g long, doc long, r long")


def shared_keys(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """doc, r, keys: the anchors that a row shares with another id, each with its reference (null where its snippets differ)."""
    found = occurrences(docs).groupBy("k").agg(F.min("doc").alias("least"), F.max("doc").alias("last"), F.min("g").alias("g0"), F.max("g").alias("g1"), F.count("*").alias("n"))
    found = found.where("least < last").select("k", F.expr("case when g0 = g1 then least end as reference"), "n")
    found = scratch.save(found, "anchors")
    total = found.agg(F.sum("n")).first()[0] or 0
    hits = spread_join(occurrences(docs).select("k", "doc", "r"), found, ["k"], "n", total)
    return hits.groupBy("doc", "r").agg(F.collect_list(F.struct("k", "reference")).alias("keys"))


PASSAGES = "ref int, k long, g long, doc long, t long, starts array<long>, passage string"


def passages(docs: DataFrame, shared: DataFrame) -> DataFrame:
    """What each row sends to which shard: ref 1 and k a reference's id, or ref 0 and k an anchor; the words, and where the row has them."""
    names = [x.split()[0] for x in PASSAGES.split(", ")]
    kinds = (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.string())

    def of_row(raw: bytes, keys, key, snippet, start, size):
        """(ref, k, g, words of the passage) and the places of each passage of one text."""
        known, reference = keys.flatten()
        known, reference = known.to_numpy(), reference.fill_null(LAST_ID).to_numpy()
        order = np.argsort(known, kind="stable")
        known, reference = known[order], reference[order]
        place = np.minimum(np.searchsorted(known, key), len(known) - 1)
        shared = known[place] == key
        owner = np.where(shared, reference[place], LAST_ID)
        words, places = raw.split(), {}
        single = np.flatnonzero(shared & (owner == LAST_ID))
        for k, g, s, n in zip(key[single].tolist(), snippet[single].tolist(), start[single].tolist(), size[single].tolist()):
            places.setdefault((0, k, g, n), []).append(s)
        joined = owner != LAST_ID
        first = joined.copy()
        first[1:] &= ~joined[:-1] | (owner[1:] != owner[:-1])
        last = joined.copy()
        last[:-1] &= ~joined[1:] | (owner[1:] != owner[:-1])
        i, j = np.flatnonzero(first), np.flatnonzero(last)
        for k, s, n in zip(owner[i].tolist(), start[i].tolist(), (start[j] + size[j] - start[i]).tolist()):
            g = int.from_bytes(hashlib.blake2b(b" ".join(words[s : s + n]), digest_size=8).digest(), "little", signed=True)
            places.setdefault((1, k, g, n), []).append(s)
        return words, places

    def run(batches):
        for b in batches:
            ids, hashes, keys = b.column("doc").to_pylist(), b.column("t").to_pylist(), b.column("keys")
            for lo, hi, data, at in C.chunks(b.column("text")):
                row, key, snippet, start, size = anchors(data, at)
                edge = np.searchsorted(row, np.arange(hi - lo + 1))
                raw, cols = data.tobytes(), [[] for _ in kinds]
                for i in range(hi - lo):
                    a, z = edge[i], edge[i + 1]
                    if a == z or not len(keys[lo + i].values):
                        continue
                    words, places = of_row(raw[at[i] : at[i + 1]], keys[lo + i].values, key[a:z], snippet[a:z], start[a:z], size[a:z])
                    for (ref, k, g, n), where in places.items():
                        text = b" ".join(words[where[0] : where[0] + n]).decode()
                        for col, x in zip(cols, (ref, k, g, ids[lo + i], hashes[lo + i], where, text)):
                            col.append(x)
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=names)

    keyed = with_key(docs).withColumn("r", F.when(F.col("doc") == LAST_ID, F.col("t")).otherwise(0))
    return keyed.join(shared.hint("merge"), ["doc", "r"]).select("doc", "t", "text", "keys").mapInArrow(run, PASSAGES)


class SuffixAutomaton:
    """All substrings of the word sequences added; each state knows the smallest id it occurs in."""

    def __init__(self) -> None:
        self.next: list[dict[str, int]] = [{}]
        self.link, self.size, self.least = [-1], [0], [LAST_ID]

    def _state(self, size: int, follow: dict[str, int], link: int, least: int) -> int:
        self.next.append(follow)
        self.link.append(link)
        self.size.append(size)
        self.least.append(least)
        return len(self.size) - 1

    def _split(self, p: int, word: str, q: int) -> int:
        """The state for the shorter strings of q that end with p's and the word."""
        copy = self._state(self.size[p] + 1, dict(self.next[q]), self.link[q], self.least[q])
        self.link[q] = copy
        while p >= 0 and self.next[p].get(word) == q:
            self.next[p][word] = copy
            p = self.link[p]
        return copy

    def add(self, words: list[str], doc: int) -> None:
        following, link, size, least, last = self.next, self.link, self.size, self.least, 0
        for word in words:
            q = following[last].get(word)
            if q is not None:
                last = q if size[q] == size[last] + 1 else self._split(last, word, q)
                if doc < least[last]:
                    least[last] = doc
                continue
            new, p = len(size), last
            following.append({})
            link.append(0)
            size.append(size[last] + 1)
            least.append(doc)
            while p >= 0:
                follow = following[p]
                if word in follow:
                    q = follow[word]
                    link[new] = q if size[q] == size[p] + 1 else self._split(p, word, q)
                    break
                follow[word] = new
                p = link[p]
            last = new

    def settle(self) -> None:
        """Carry the smallest ids from longer strings to their suffixes."""
        link, least = self.link, self.least
        for s in np.argsort(np.array(self.size))[:0:-1].tolist():
            up = link[s]
            if least[s] < least[up]:
                least[up] = least[s]

    def matches(self, words: list[str], size: int) -> list[tuple[int, int]]:
        """(start, smallest id) of each run of `size` words that occurs."""
        following, link, sizes, least = self.next, self.link, self.size, self.least
        state = length = 0
        out = []
        for i, word in enumerate(words, 1 - size):
            to = following[state].get(word)
            while to is None and state:
                state = link[state]
                length = sizes[state]
                to = following[state].get(word)
            if to is not None:
                state, length = to, length + 1
            if length >= size:
                # A match no longer than `size` is longer than what its state's link stands for.
                while length > size and sizes[link[state]] >= size:
                    state = link[state]
                    length = sizes[state]
                out.append((i, least[state]))
        return out


def cut(snippets: DataFrame, words: int) -> DataFrame:
    """The rows of shards that are too large, cut by anchors of more words: at is where a piece begins in its passage."""

    def run(batches):
        for b in batches:
            for lo, hi, data, at in C.chunks(b.column("passage")):
                row, key, _, start, size = anchors(data, at, words)
                raw = data.tobytes()
                texts = [raw[s:e].split() for s, e in zip(at[:-1].tolist(), at[1:].tolist())]
                pieces = [b" ".join(texts[i][s : s + n]).decode() for i, s, n in zip(row.tolist(), start.tolist(), size.tolist())]
                own, cols = pa.array(lo + row), {name: b.column(name) for name in b.schema.names}
                cols = {name: c.take(own) for name, c in cols.items()}
                cols |= {"shard": pa.array(key), "at": pa.array((cols["at"].to_numpy() + start).astype(np.int32)), "passage": pa.array(pieces, pa.string())}
                yield pa.RecordBatch.from_arrays([cols[n] for n in b.schema.names], names=b.schema.names)

    return snippets.mapInArrow(run, snippets.schema)


def dealt(distinct: DataFrame, scratch: Scratch) -> DataFrame:
    """ref, shard, salt, k, g, copies, doc, at, passage and own: what each task of a shard builds its automaton from, and (own) streams through it."""
    rows, out = distinct.select("ref", F.col("k").alias("shard"), "k", "g", "copies", "doc", F.lit(0).alias("at"), "passage"), None
    for level, words in enumerate((*LONGER, None)):
        loads = rows.groupBy("ref", "shard").agg(F.count("*").alias("n"), F.sum(F.length("passage")).alias("chars"))
        loads = scratch.save(loads, f"loads{level}")
        got = loads.agg(F.sum("n").alias("n"), F.max(F.when(F.col("ref") == 0, F.col("n"))).alias("most")).first()
        placed = spread_join(rows, loads, ["ref", "shard"], "n", got["n"] or 0)
        large = (F.col("ref") == 0) & (F.col("n") > SHARD_SNIPPETS)
        split = words is not None and (got["most"] or 0) > SHARD_SNIPPETS
        here = placed.where(~large) if split else placed
        out = here if out is None else out.unionByName(here)
        if not split:
            break
        rows = scratch.save(cut(placed.where(large).select(*rows.columns), words), f"cut{level}")
    salts = F.when(F.col("ref") == 1, F.greatest(F.ceil(F.col("chars") / SHARD_CHARS), F.ceil(F.col("n") / SHARD_SNIPPETS))).otherwise(1).cast("int")
    mine = F.pmod(F.xxhash64("g"), salts).cast("int")
    builds = (F.col("ref") == 1) & (F.col("doc") == F.col("shard"))
    out = out.withColumn("mine", mine).withColumn("salt", F.explode(F.when(builds, F.sequence(F.lit(0), salts - 1)).otherwise(F.array("mine"))))
    return out.select("ref", "shard", "salt", "k", "g", "copies", "doc", "at", "passage", (F.col("salt") == F.col("mine")).alias("own"))


def blocks(references: list[tuple[list[str], int]]):
    """The references (words, id) in lots of at most BLOCK words; a longer one is cut with an overlap that keeps every snippet whole."""
    lot, held, overlap = [], 0, 2 * WINDOW
    for words, doc in references:
        for s in range(0, max(1, len(words) - overlap), BLOCK):
            part = words[s : s + BLOCK + overlap]
            if lot and held + len(part) > BLOCK + overlap:
                yield lot
                lot, held = [], 0
            lot.append((part, doc))
            held += len(part)
    if lot:
        yield lot


def spans_in(references: list[tuple[list[str], int]], streams: list[list[str]]) -> list[tuple[list[int], list[int], list[int]]]:
    """For each stream the starts, ends and smallest ids of its maximal spans of WINDOW words or more that occur in a reference."""
    found: list[list[tuple[int, int]]] = [[] for _ in streams]
    for lot in blocks(references):
        automaton = SuffixAutomaton()
        for words, doc in lot:
            automaton.add(words, doc)
        automaton.settle()
        for k, words in enumerate(streams):
            more = automaton.matches(words, WINDOW)
            if more and found[k]:
                best = dict(found[k])
                best.update((i, doc) for i, doc in more if doc < best.get(i, LAST_ID))
                more = sorted(best.items())
            found[k] = more or found[k]
    out = []
    for hits in found:
        starts, ends, ids, after = [], [], [], -1
        for i, doc in hits:
            if doc == LAST_ID:
                continue
            if i == after and doc == ids[-1]:
                ends[-1] += 1
            else:
                starts.append(i)
                ends.append(i + WINDOW)
                ids.append(doc)
            after = i + 1
        out.append((starts, ends, ids))
    return out


SPANS = "ref int, k long, g long, copies long, starts array<int>, ends array<int>, least array<long>"


def matched(rows: DataFrame) -> DataFrame:
    """For each passage streamed through its shard's automaton: its spans, and the smallest id that has each."""
    names = [x.split()[0] for x in SPANS.split(", ")]
    kinds = (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(pa.int64()))

    def run(batches):
        for table, edges in C.groups_of(batches, ["ref", "shard", "salt"]):
            cols = [[] for _ in kinds]
            ref, shard, k, g, copies, doc, place, own = (table.column(c).to_pylist() for c in ("ref", "shard", "k", "g", "copies", "doc", "at", "own"))
            for s, e in zip(edges[:-1].tolist(), edges[1:].tolist()):
                words = [x.split(" ") for x in table.column("passage").slice(s, e - s).to_pylist()]
                references = [(w, doc[i]) for i, w in enumerate(words, s) if ref[i] == 0 or doc[i] == shard[i]]
                asked = [i for i in range(s, e) if own[i]]
                for i, (first, last, least) in zip(asked, spans_in(references, [words[i - s] for i in asked])):
                    at = place[i]
                    for col, x in zip(cols, (ref[i], k[i], g[i], copies[i], [x + at for x in first], [x + at for x in last], least)):
                        col.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=names)

    return rows.repartition("ref", "shard", "salt").sortWithinPartitions("ref", "shard", "salt").mapInArrow(run, SPANS).where("size(starts) > 0")


def removals(docs: DataFrame) -> DataFrame:
    """doc, t and spans (places of a passage; starts and ends in it that go), for the rows that lose words."""
    scratch = Scratch(docs.sparkSession, "substring_dedup")
    shared = scratch.save(shared_keys(docs, scratch), "shared")
    rows = scratch.save(passages(docs, shared), "passages")
    distinct = rows.groupBy("ref", "k", "g").agg(F.min("doc").alias("doc"), F.first("passage").alias("passage"), F.count("*").alias("copies"))
    distinct = scratch.save(distinct, "distinct")
    spans = scratch.save(matched(dealt(distinct, scratch)), "spans")
    total = distinct.agg(F.sum("copies")).first()[0] or 0
    back = spread_join(rows.select("ref", "k", "g", "doc", "t", F.col("starts").alias("places")), spans, ["ref", "k", "g"], "copies", total)
    gone = F.filter(F.arrays_zip("starts", "ends", "least"), lambda x: x["least"] < F.col("doc"))
    back = back.select("doc", "t", "places", gone.alias("gone")).where("size(gone) > 0")
    back = back.select("doc", "t", F.struct("places", F.col("gone.starts").alias("starts"), F.col("gone.ends").alias("ends")).alias("span"))
    plan = scratch.save(back.groupBy("doc", "t").agg(F.collect_list("span").alias("spans")), "plan")
    scratch.drop("anchors", "shared", "passages", "distinct", "spans", *(f"{n}{level}" for n in ("loads", "cut") for level in range(len(LONGER) + 1)))
    return plan


def removed_words(texts: pa.Array, spans: pa.Array):
    """(bytes of the text, its words, mask of removed words or None) of each row."""
    for lo, hi, data, at in C.chunks(texts):
        raw = data.tobytes()
        for j, s, e in zip(range(lo, hi), at[:-1].tolist(), at[1:].tolist()):
            words, mask = raw[s:e].split(), None
            if spans[j].is_valid:
                cover = np.zeros(len(words) + 1, np.int64)
                for x in spans[j].as_py():
                    np.add.at(cover, np.add.outer(x["places"], x["starts"]).reshape(-1), 1)
                    np.add.at(cover, np.add.outer(x["places"], x["ends"]).reshape(-1), -1)
                mask = np.cumsum(cover[:-1]) > 0
            yield raw[s:e], words, mask


def with_spans(docs: DataFrame) -> DataFrame:
    """row (all columns of a document) and spans (null where nothing goes)."""
    key = F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST_ID)).alias("doc"), F.xxhash64("text").alias("t")
    return docs.select(F.struct("*").alias("row"), *key).join(removals(docs).hint("merge"), ["doc", "t"], "left").select("row", "spans")


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed and the sha256 of the kept words joined by blanks."""

    def run(batches):
        for b in batches:
            counts, gone, shas = [], [], []
            for _, words, mask in removed_words(b.column("text"), b.column("spans")):
                counts.append(len(words))
                gone.append(0 if mask is None else int(mask.sum()))
                shas.append(hashlib.sha256(b" ".join(words if mask is None else compress(words, ~mask))).hexdigest())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(counts, pa.int64()), pa.array(gone, pa.int64()), pa.array(shas, pa.string())], names=["doc_id", "n_words", "n_removed", "kept_sha256"])

    rows = with_spans(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")).select("row.*", "spans")
    return rows.mapInArrow(run, "doc_id long, n_words long, n_removed long, kept_sha256 string")


def without(text: bytes, mask: np.ndarray) -> bytes:
    """The text without the masked words and the white space after each."""
    starts, _, _ = C.words(np.frombuffer(text, np.uint8), np.array([0, len(text)]))
    pieces = np.concatenate(([0], starts, [len(text)]))
    keep = np.concatenate(([True], ~mask))
    return b"".join(text[s:e] for s, e, k in zip(pieces[:-1].tolist(), pieces[1:].tolist(), keep.tolist()) if k)


def remove(docs: DataFrame) -> DataFrame:
    """The documents without their repeated words; the rest of each text stays as it was, and n_chars, where there is one, follows it."""
    names = docs.columns

    def run(batches):
        for b in batches:
            cols = dict(zip(names, b.column("row").flatten()))
            was = cols["text"]
            new = [text if mask is None else without(text, mask) for text, _, mask in removed_words(was, b.column("spans"))]
            cols["text"] = pa.array([t.decode() if ok else None for t, ok in zip(new, was.is_valid().to_pylist())], pa.string())
            if "n_chars" in cols:
                changed = pc.fill_null(pc.not_equal(cols["text"], was), False)
                cols["n_chars"] = pc.if_else(changed, pc.utf8_length(cols["text"]).cast(cols["n_chars"].type), cols["n_chars"])
            yield pa.RecordBatch.from_arrays(list(cols.values()), names=names)

    return with_spans(docs).mapInArrow(run, docs.schema)


def op2(spark, sf_dir: str) -> DataFrame:
    return digests(C.read(spark, sf_dir, "documents"))


_REST = " || ' ' || ".join(f"lead(word, {k}) OVER w" for k in range(1, WINDOW))
ORACLE = r"""
WITH words AS (
  SELECT doc_id, unnest(ws) AS word, unnest(range(len(ws))) AS pos
  FROM (SELECT doc_id, list_filter(string_split_regex(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents)),
windows AS (
  SELECT doc_id, pos, word || ' ' || {rest} AS run FROM words WINDOW w AS (PARTITION BY doc_id ORDER BY pos)),
firsts AS (SELECT run, min(doc_id) AS least FROM windows WHERE run IS NOT NULL GROUP BY run),
gone AS (
  SELECT DISTINCT doc_id, pos + k AS pos
  FROM (SELECT doc_id, pos, unnest(range(13)) AS k FROM windows JOIN firsts USING (run) WHERE least < doc_id)),
kept AS (
  SELECT doc_id, count(*) AS n_words, count(g.at) AS n_removed, string_agg(word, ' ' ORDER BY pos) FILTER (WHERE g.at IS NULL) AS kept
  FROM words LEFT JOIN (SELECT doc_id, pos, pos AS at FROM gone) AS g USING (doc_id, pos) GROUP BY doc_id)
SELECT doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM documents LEFT JOIN kept USING (doc_id)
""".replace("{rest}", _REST)
