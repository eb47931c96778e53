"""URL filters as a sort-merge range join.

A host is written with its labels reversed, each closed by a dot (`www.example.com` -> `com.example.www.`).
A rule for a host and all its subdomains is then an interval of such keys: those that begin with the rule's
own. Both sides are cut at the same bounds: a URL lies in one range, a rule goes to each range that its interval
touches. Sorted together by (key, rules first, path), one sweep of a range keeps the rules whose intervals hold
the current key on a stack. Rules on the stack are nested; among those whose path begins the URL's path the
longest wins, of equal texts the later in order, of one text with both verdicts `block`.

Bounds come from a bounded sample of URLs and decide only how evenly the work is spread. They are places in the
order of (key, hash of the row), so that one host with a third of all rows is cut into many ranges. Rules are a
table of any size; neither side is held in memory.

Defined cases: a null URL, or one without `://`, has an empty host and path and no rule; a rule with an empty
host fits every URL that has one; a URL without a rule gets the verdict `default`; repeated rows and null ids
keep their rows; a very long URL is one string of its task; other columns are carried along untouched under
their own names, and what is found comes in one struct whose name gets `_` appended until it is free.
"""

from __future__ import annotations

from bisect import bisect_right

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spanloom.llm import common as C

#: URLs of the sample for each range.
SAMPLE = 100
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Verdict, host, path.
Rule = tuple[str, str, str]


def host(url: Column) -> Column:
    """What is between the first `://` and the next `/`, `?`, `#` or the end, with A-Z in lower case."""
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1), UPPER, LOWER)


def path(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def reversed_key(name: Column) -> Column:
    return F.when(name == "", F.lit("")).otherwise(F.concat(F.array_join(F.reverse(F.split(name, r"\.")), "."), F.lit(".")))


def found_name(pages: DataFrame) -> str:
    """The name of the struct that apply_rules adds."""
    name, taken = "found", {c.lower() for c in pages.columns}
    while name in taken:
        name += "_"
    return name


def range_bounds(placed: DataFrame, ranges: int) -> list[str]:
    """Places that cut the URLs into about equal ranges, from SAMPLE URLs a range."""
    rows = placed.select("place").orderBy(F.xxhash64("place")).limit(SAMPLE * ranges).toPandas()
    some = sorted(rows["place"])
    return sorted({some[len(some) * k // ranges] for k in range(1, ranges)}) if some else []


def touched(bounds: list[str], key: str) -> range:
    """The ranges that hold places beginning with the key."""
    first = last = bisect_right(bounds, key)
    while last < len(bounds) and bounds[last].startswith(key):
        last += 1
    return range(first, last + 1)


class Sweeper:
    """Follows one range in order: rules are opened as they come, URLs are judged by the open ones."""

    def __init__(self) -> None:
        self.stack: list[tuple[str, str, str, str]] = []
        self.last, self.answer = None, (None, None)

    def open(self, key: str, path: str, text: str, verdict: str) -> None:
        while self.stack and not key.startswith(self.stack[-1][0]):
            self.stack.pop()
        self.stack.append((key, path, text, verdict))
        self.last = None

    def judge(self, key: str, path: str) -> tuple[str | None, str | None]:
        """(rule text, verdict) of the longest rule that fits, or nulls."""
        if (key, path) != self.last:
            while self.stack and not key.startswith(self.stack[-1][0]):
                self.stack.pop()
            fit = [(len(text), text, verdict) for _, begin, text, verdict in self.stack if key and path.startswith(begin)]
            self.answer = max(fit)[1:] if fit else (None, None)
            self.last = (key, path)
        return self.answer


def apply_rules(pages: DataFrame, rules, url: str = "url", default: str = "allow", ranges: int | None = None) -> DataFrame:
    """pages with a struct (see found_name) of host, path, rule and verdict; rule is the host and path of the rule that won.

    rules: a list of (verdict, host, path), or a table of columns verdict, host and path.
    """
    spark = pages.sparkSession
    if not isinstance(rules, DataFrame):
        rules = spark.createDataFrame(list(rules), "verdict string, host string, path string")
    ranges = ranges or int(spark.conf.get("spark.sql.shuffle.partitions"))
    keyed = pages.select(F.struct("*").alias("row"), host(F.col(url)).alias("host"), path(F.col(url)).alias("path"))
    keyed = keyed.withColumn("key", reversed_key(F.col("host")))
    keyed = keyed.withColumn("place", F.concat("key", F.lit("\0"), F.hex(F.xxhash64("row"))))
    bounds = range_bounds(keyed, ranges)

    def deal(batches):
        for b in batches:
            part = [bisect_right(bounds, p) for p in b.column("place").to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(part, pa.int32())], names=[*b.schema.names[:-1], "part"])

    def copy(batches):
        for b in batches:
            rows = [(*r.values(), p) for r in b.to_pylist() for p in touched(bounds, r["key"])]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*rows)) or [()] * 5, (*[pa.string()] * 4, pa.int32()))], names=["key", "path", "text", "verdict", "part"])

    row = keyed.schema["row"].dataType
    schema = T.StructType([*keyed.schema.fields[:-1], T.StructField("part", T.IntegerType())])
    urls = keyed.mapInArrow(deal, schema).select("part", "key", F.lit(1).alias("kind"), "path", "host", "row", F.lit(None).cast("string").alias("text"), F.lit(None).cast("string").alias("verdict"))
    name = F.translate(F.coalesce("host", F.lit("")), UPPER, LOWER)
    begin = F.coalesce("path", F.lit(""))
    ready = rules.select(reversed_key(name).alias("key"), begin.alias("path"), F.concat(F.coalesce("host", F.lit("")), begin).alias("text"), "verdict").distinct()
    opened = ready.mapInArrow(copy, "key string, path string, text string, verdict string, part int")
    opened = opened.select("part", "key", F.lit(0).alias("kind"), "path", F.lit(None).cast("string").alias("host"), F.lit(None).cast(row).alias("row"), "text", "verdict")
    both = urls.unionByName(opened).repartitionById(ranges, "part").sortWithinPartitions("part", "key", "kind", "path")
    names, added = pages.columns, found_name(pages)
    found_type = T.StructType([T.StructField(c, T.StringType()) for c in ("host", "path", "rule", "verdict")])

    def run(batches):
        state, now = Sweeper(), None
        for b in batches:
            part, key, kind, path, text, verdict = (b.column(c).to_pylist() for c in ("part", "key", "kind", "path", "text", "verdict"))
            which, got = [], []
            for i in range(b.num_rows):
                if part[i] != now:
                    state, now = Sweeper(), part[i]
                if kind[i]:
                    which.append(i)
                    got.append(state.judge(key[i], path[i]))
                else:
                    state.open(key[i], path[i], text[i], verdict[i])
            pick = pa.array(which, pa.int64())
            found = [b.column("host").take(pick), b.column("path").take(pick), pa.array([g[0] for g in got], pa.string()), pa.array([g[1] or default for g in got], pa.string())]
            struct = pa.StructArray.from_arrays(found, names=["host", "path", "rule", "verdict"])
            yield pa.RecordBatch.from_arrays([*b.column("row").take(pick).flatten(), struct], names=[*names, added])

    return both.mapInArrow(run, T.StructType([*pages.schema.fields, T.StructField(added, found_type)]))


#: The rules of the query.
RULES: list[Rule] = [
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
]


def op3(spark, sf_dir: str) -> DataFrame:
    return apply_rules(C.read(spark, sf_dir, "pages").select("page_id", "url"), RULES).select("page_id", "found.*")


ORACLE = """
with u as (
  select page_id, coalesce(strpos(url, '://'), 0) as p, url from pages
), s as (
  select page_id, case when p > 0 then substr(url, p + 3) else '' end as rest from u
), h as (
  select page_id, regexp_extract(rest, '^[^/?#]*') as raw_host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) as path from s
), l as (
  select page_id, path, translate(raw_host, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host from h
), r(verdict, rule_host, rule_path) as (
  values ('allow', 'com', '/'), ('block', 'example.com', '/en/'), ('allow', 'www.example.com', '/en/'), ('block', 'net', '/es/'), ('block', 'net', '/fr/')
), f as (
  select l.page_id, l.host, l.path, r.rule_host || r.rule_path as rule, r.verdict,
         row_number() over (partition by l.page_id order by length(r.rule_host || r.rule_path) desc nulls last, r.rule_host || r.rule_path desc) as k
  from l left join r on (l.host = r.rule_host or ends_with(l.host, '.' || r.rule_host)) and starts_with(l.path, r.rule_path)
)
select page_id, host, path, rule, coalesce(verdict, 'allow') as verdict from f where k = 1
"""
