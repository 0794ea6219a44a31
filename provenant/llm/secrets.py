"""Secret scans by a trigram inverted index; DataFrame and SQL functions only.

Each rule's regular expression is parsed, and a Boolean query is derived from it: literals that stand next to each other in every
match are joined, through alternations, short classes and optional parts as long as the strings are few, and every match must hold one string of each
set that this gives; a string holds all its trigrams. Documents have keys in [0, 2 x documents);
the index has, for each trigram that a query names and each run of 32,768 keys, a bitmap of the documents that hold
it (postings). A query intersects the bitmaps of a string's trigrams, unites the strings of a set and intersects the sets; only the
candidates are verified with the regular expression. A rule without mandatory trigrams scans every document.
The postings of trigrams that no rule asks for are never needed, so they aren't stored.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Sealed, broadcast_if_small, stage

#: Documents in a bitmap; Spark's bitmap functions fix it.
BITMAP = 32_768
#: Most strings that literals are joined to.
STRINGS = 24


def exact(nodes) -> set[str] | None:
    """All strings that a parsed expression matches, in lower case; None if they are too many or can't be told."""
    out = {""}
    for op, arg in nodes:
        name, some = str(op), None
        if name == "LITERAL":
            some = {chr(arg).lower()} if arg < 128 else None
        elif name == "IN" and all(str(k) in ("LITERAL", "RANGE") for k, _ in arg):
            codes = [c for k, v in arg for c in ([v] if str(k) == "LITERAL" else range(v[0], v[1] + 1))]
            some = {chr(c).lower() for c in codes} if len(codes) <= STRINGS and max(codes) < 128 else None
        elif name == "MAX_REPEAT" and int(arg[1]) <= 4 and (part := exact(arg[2])) is not None:
            some, runs = set(), {""}
            for n in range(int(arg[1]) + 1):
                some |= runs if n >= arg[0] else set()
                runs = {x + y for x in runs for y in part}
        elif name == "SUBPATTERN":
            some = exact(arg[3])
        elif name == "BRANCH":
            parts = [exact(x) for x in arg[1]]
            some = None if None in parts else set().union(*parts)
        elif name == "AT":
            some = {""}
        if some is None or len(out) * len(some) > STRINGS:
            return None
        out = {x + y for x in out for y in some}
    return out


def mandatory(nodes) -> list[set[str]]:
    """Sets of strings of three or more characters, in lower case: every match of a parsed expression holds one string of each."""
    found: list[set[str]] = []
    run = {""}

    def close() -> None:
        if min(map(len, run)) >= 3 and run not in found:
            found.append(run)

    for node in nodes:
        some = exact([node])
        if some is not None and "" not in some and len(run) * len(some) <= STRINGS:
            run = {x + y for x in run for y in some}
            continue
        close()
        run = some if some is not None and "" not in some else {""}
        if some is not None:
            continue
        name, arg = str(node[0]), node[1]
        if name == "SUBPATTERN":
            found += mandatory(arg[3])
        elif name == "MAX_REPEAT" and arg[0] >= 1:
            found += mandatory(arg[2])
        elif name == "BRANCH":
            sides = [mandatory(x) for x in arg[1]]
            if all(sides):
                found.append(set().union(*(max(x, key=lambda s: min(map(len, s))) for x in sides)))
    close()
    return found


@dataclass(frozen=True)
class Rule:
    """A kind of secret. A match counts if its ``group`` (0: the whole) has ``least`` characters or more."""

    kind: str
    regex: str
    least: int = 1
    group: int = 0
    probe: str | None = None  # matches wherever a counting match is, and is quicker to find; None: the regex

    def query(self) -> list[list[list[str]]]:
        """Sets of strings by their trigrams, derived from the regular expression: all sets, of a set any string, of a string all trigrams. Empty: scans fully."""
        return [[sorted({x[i : i + 3] for i in range(len(x) - 2)}) for x in sorted(strings)] for strings in mandatory(re._parser.parse(self.regex))]


BASE = (
    Rule("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 12, 2),
    Rule("access", r"AKIA[A-Z0-9]+", 18),
    Rule("hex", r"[0-9a-f]+", 16, probe=r"[0-9a-f]{16}"),
)
ADDED = (
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]+"),
)
RULES = BASE + ADDED


def with_keys(docs: DataFrame, key: str, text: str, n: int) -> DataFrame:
    """``docs`` with _k in [0, n), a function of the key, or of the text where that is null. Documents that share one share a bit: more candidates, no fewer."""
    return docs.withColumn("_k", F.pmod(F.when(F.col(key).isNull(), F.xxhash64(text)).otherwise(F.xxhash64(key)), F.lit(n)))


def postings(docs: DataFrame, trigrams: list[str], text: str) -> DataFrame:
    """The inverted index over ``trigrams`` (lower case): (trigram, bucket, bits).

    A document is one row with the numbers of its trigrams until it is in its bucket's task, where bitmaps are made; so a sparse trigram costs no bitmap in every task.
    """
    low = docs.select(F.expr("bitmap_bucket_number(_k + 1)").alias("bucket"), F.expr("bitmap_bit_position(_k + 1)").cast("int").alias("at"), F.lower(text).alias("low"))
    held = F.filter(F.array(*(F.when(F.contains("low", F.lit(t)), F.lit(i).cast("short")) for i, t in enumerate(trigrams))), lambda t: t.isNotNull())
    rows = low.select("bucket", "at", held.alias("held")).repartition("bucket")
    # explode would add a filter for lists that aren't empty, which is pushed below and lower-cases a text for each trigram
    index = rows.select("bucket", "at", F.explode_outer("held").alias("n")).where("n is not null").groupBy("bucket", "n").agg(F.expr("bitmap_construct_agg(at)").alias("bits"))
    return index.select(F.element_at(F.array(*map(F.lit, trigrams)), F.col("n") + 1).alias("trigram"), "bucket", "bits")


def candidates(index: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """(bucket, one bitmap column for each rule with a query): postings intersected within strings, united over a set, intersected over sets."""
    table = [(r.kind, g, i, t, len(x)) for r in rules for g, strings in enumerate(r.query()) for i, x in enumerate(strings) for t in x]
    table = index.sparkSession.createDataFrame(table, "kind string, part int, string int, trigram string, needs int")  # of the rules, not the data
    met = index.join(F.broadcast(table), "trigram").groupBy("kind", "part", "string", "needs", "bucket").agg(F.expr("bitmap_and_agg(bits)").alias("bits"), F.count("*").alias("n"))
    sets = met.where("n = needs").groupBy("kind", "part", "bucket").agg(F.expr("bitmap_or_agg(bits)").alias("bits"))
    with_all = lambda r: F.when(F.count_if(F.col("kind") == r.kind) == len(r.query()), F.expr(f"bitmap_and_agg(case when kind = '{r.kind}' then bits end)"))
    return sets.groupBy("bucket").agg(*(with_all(r).alias(f"_in_{r.kind}") for r in rules if r.query()))


def bit(bits: Column, position: Column) -> Column:
    """Whether a bitmap has the bit; false for null."""
    byte = F.conv(F.hex(F.substring(bits, (position / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return F.coalesce(F.pmod(F.floor(byte / F.pow(F.lit(2), F.pmod(position, F.lit(8)))), F.lit(2)) == 1, F.lit(False))


def found(rule: Rule, text: str) -> Column:
    """Spans [start, end) of a rule's matches, in characters, that are long enough.

    The pieces between matches and the matches themselves, in turn, give the places.
    """
    re = F.lit(rule.regex)
    gaps, hits = F.split(F.col(text), rule.regex, -1), F.regexp_extract_all(F.col(text), re, F.lit(0))
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("got"))
    sizes = F.transform(hits, F.length)
    groups = F.transform(F.regexp_extract_all(F.col(text), re, F.lit(rule.group)), F.length) if rule.group else sizes
    parts = F.arrays_zip(F.slice(F.transform(gaps, F.length), F.lit(1), F.size(hits)).alias("gap"), sizes.alias("size"), groups.alias("group"))
    parts = F.transform(parts, lambda p: F.struct(p["gap"].alias("gap"), p["size"].alias("size"), p["group"].alias("group")))
    step = lambda a, p: F.struct(
        (a["at"] + p["gap"] + p["size"]).alias("at"),
        F.when(p["group"] >= rule.least, F.concat(a["got"], F.array(F.struct((a["at"] + p["gap"]).alias("start"), (a["at"] + p["gap"] + p["size"]).alias("end"))))).otherwise(a["got"]).alias("got"),
    )
    return F.aggregate(parts, zero, step, lambda a: a["got"])


def named(found: Column, rank: int, kind: str) -> Column:
    """Spans with their rule."""
    return F.transform(found, lambda s: F.struct(s["start"].alias("start"), F.lit(rank).alias("rank"), F.lit(kind).alias("kind"), s["end"].alias("end")))


def scan(docs: DataFrame, *, rules: tuple[Rule, ...] = RULES, key: str = "doc_id", text: str = "text", spans: str = "_spans") -> DataFrame:
    """``docs`` with an array column ``spans`` of struct<start, rank, kind, end>, sorted: secrets in characters, end exclusive.

    Matches of a rule are leftmost and don't overlap; those of different rules may. rank is the rule's place among ``rules``.
    A null or empty text has none. Keys may be null or repeated. Other columns pass through; one named ``spans`` is replaced.
    """
    sealed = Sealed(docs, spans)
    key = sealed[key]
    n = -(-2 * max(docs.count(), 1) // BITMAP) * BITMAP
    keyed = with_keys(sealed.df.withColumn("_text", F.coalesce(F.col(sealed[text]), F.lit(""))), key, "_text", n)
    trigrams = sorted({t for r in rules for strings in r.query() for x in strings for t in x})
    if trigrams:
        maybe = stage(candidates(postings(keyed, trigrams, "_text"), rules), "secrets").withColumnRenamed("bucket", "_bucket")
        # 4 KB a rule and bucket: broadcast only if that is little, else join by bucket
        maybe = broadcast_if_small(maybe, rows=1 << 10)
        keyed = keyed.join(maybe, F.expr("bitmap_bucket_number(_k + 1)") == F.col("_bucket"), "left")
    none = F.array().cast("array<struct<start:int,end:int>>")
    lists = []
    for rank, rule in enumerate(rules):
        test = F.col("_text").rlike(rule.probe or rule.regex)
        if rule.query():
            test = bit(F.col(f"_in_{rule.kind}"), F.expr("bitmap_bit_position(_k + 1)")) & test
        some = F.when(test, found(rule, "_text")).otherwise(none)
        lists.append(named(some, rank, rule.kind))
    return sealed.open(keyed, **{spans: F.array_sort(F.concat(*lists))})


def listed(spans: Column) -> Column:
    """``kind:start:end`` of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
