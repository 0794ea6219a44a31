"""Repair of conversation structure: cheapest edits by a dynamic programme that shares prefixes in a trie.

The rows of a conversation, in order, become a signature: a sign for each row's role and fault. Signatures are distinct in far
fewer forms than conversations. Sorted, they are the walk of a prefix trie: each keeps the programme's layers of the prefix that it shares with
the one before and computes the rest, and the answer stands at its end. A layer has the cheapest edits, of equal costs the least in ASCII, from each state of the wanted
pattern ``(s?(ua)+)?`` to each other, so layers of consecutive pieces can be joined: edits of equal cost over the same rows are never
prefixes of each other, since they differ in insertions then, which cost.

A conversation may hold a third of all rows. Rows are put in order by range partitions, a partition's share of a conversation is cut into pieces of ``PIECE`` signs,
and pieces are joined ``FAN`` at a time, in rounds. Equal rows are counted before they are shuffled. Only the last pass over the texts takes a conversation's rows
one after the other: it streams them and holds a row and the edits, since a digest of all texts in order can't be made from parts.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import broadcast_if_small, mapped, stage

KEEP, REROLE, DELETE, INSERT = "K", "R", "D", "I"
REROLE_COST, DELETE_COST, INSERT_COST, TRUNCATED_COST = 1, 2, 5, 5
LEGAL = ("su", "ua", "au")
ROLES = {"u": "user", "a": "assistant"}
MUST_GO = "x"
#: Signs of a piece, and pieces that are joined in a round.
PIECE, FAN = 64, 64
#: Characters of a text that rows of one turn are ordered by, before its hash.
HEAD = 64

# States: nothing yet, after s, after u, after a. The first and the last are ends.
START, SYSTEM, USER, ASSISTANT = range(4)
NEXT = {"s": {START: SYSTEM}, "u": {START: USER, SYSTEM: USER, ASSISTANT: USER}, "a": {USER: ASSISTANT}}
ENDS = (START, ASSISTANT)
Vector = list  # of (cost, edits) or None, by state


def better(a: tuple | None, b: tuple | None) -> tuple | None:
    """The cheaper edits, of equal costs the least."""
    return b if a is None else a if b is None else min(a, b)


def inserted(v: Vector) -> Vector:
    """With any insertions: two are as many as lead to a state at less cost than by another way."""
    for _ in range(2):
        new = list(v)
        for role in ROLES:
            for s, t in NEXT[role].items():
                if v[s] is not None:
                    new[t] = better(new[t], (v[s][0] + INSERT_COST, v[s][1] + INSERT))
        v = new
    return v


def after(v: Vector, sign: str) -> Vector:
    """After a row: deleted, or kept or reroled where the pattern has room for it. Capital signs are truncated rows."""
    v = inserted(v)
    new = [None if x is None else (x[0] + DELETE_COST, x[1] + DELETE) for x in v]
    if sign == MUST_GO:
        return new
    role, more = sign.lower(), TRUNCATED_COST if sign.isupper() else 0
    for r, edit, cost in ((role, KEEP, 0), *((r, REROLE, REROLE_COST) for r in ROLES)):
        for s, t in NEXT.get(r, {}).items():
            if v[s] is not None:
                new[t] = better(new[t], (v[s][0] + cost + more, v[s][1] + edit))
    return new


def identity() -> list[Vector]:
    """No rows: each state leads to itself."""
    return [[(0, "") if s == e else None for s in range(4)] for e in range(4)]


def joined(one: list[Vector], two: list[Vector]) -> list[Vector]:
    """The rows of one piece and then those of another."""
    out = identity()
    for e in range(4):
        for s in range(4):
            found = None
            for q in range(4):
                if one[e][q] is not None and two[q][s] is not None:
                    found = better(found, (one[e][q][0] + two[q][s][0], one[e][q][1] + two[q][s][1]))
            out[e][s] = found
    return out


def answer(layer: list[Vector]) -> tuple[int, str]:
    """Cost and edits of a whole conversation."""
    v = inserted(layer[START])
    return min(x for s in ENDS if (x := v[s]) is not None)


def trie_walk(signatures: Iterator[str]) -> Iterator[tuple[str, list[Vector]]]:
    """The layer at the end of each of some sorted signatures; layers of a shared prefix are computed once."""
    path, before = [identity()], ""
    for signature in signatures:
        shared = 0
        while shared < min(len(before), len(signature)) and before[shared] == signature[shared]:
            shared += 1
        del path[shared + 1 :]
        for sign in signature[shared:]:
            path.append([after(v, sign) for v in path[-1]])
        before = signature
        yield signature, path[-1]


LAYER = "costs array<bigint>, edits array<string>"


def flat(layer: list[Vector]) -> tuple[list, list]:
    """A layer as two lists of 16, null where there is no way."""
    cells = [x for v in layer for x in v]
    return [None if x is None else x[0] for x in cells], [None if x is None else x[1] for x in cells]


def unflat(costs: list, edits: list) -> list[Vector]:
    """What ``flat`` made flat."""
    cells = [None if c is None else (c, e) for c, e in zip(costs, edits, strict=True)]
    return [cells[i : i + 4] for i in range(0, 16, 4)]


def damage(rows: DataFrame, *, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv, turn, role, text, copies): conversations with faults, a few of each kind, by a checksum of conversation and turn.

    0 of 20 drops a row (copies 0), 1 empties its text, 2 takes its final marks away, 3 repeats it, 4 makes the user say it. Nulls in names, roles and texts are one space.
    """
    shown = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat_ws(":", shown(conv), shown(turn)).cast("binary")) % 20
    said = F.when(kind == 1, "").when(kind == 2, F.regexp_replace(shown(text), "[.!?]", "")).otherwise(shown(text))
    return rows.select(F.col(conv).alias("conv"), F.col(turn).cast("long").alias("turn"), F.when(kind == 4, "user").otherwise(shown(role)).alias("role"), said.alias("text"), F.when(kind == 0, 0).when(kind == 3, 2).otherwise(1).cast("long").alias("copies"))


SUMS = ("blank", "duplicate", "truncated", "illegal", "turns")
STATS = "blank bigint, duplicate bigint, truncated bigint, illegal bigint, turns bigint, low bigint, high bigint, first_turn bigint, last_turn bigint, first_role string, last_role string"
STAT_NAMES = [x.split()[0] for x in STATS.split(", ")]
BASE = ["cid", "slice", "piece"]
ARROW = {"string": pa.string(), "bigint": pa.int64(), "array<bigint>": pa.list_(pa.int64()), "array<string>": pa.list_(pa.string()), "boolean": pa.bool_()}


def record(rows: list[dict], schema: str) -> pa.RecordBatch:
    """Rows as a batch."""
    fields = [x.split() for x in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([r[name] for r in rows], ARROW[kind]) for name, kind in fields], names=[name for name, _ in fields])


def merged(a: dict, b: dict) -> dict:
    """Counts of two consecutive pieces."""
    out = {c: a[c] + b[c] for c in SUMS}
    out["illegal"] += (a["last_role"] + b["first_role"]) not in LEGAL
    out["turns"] -= a["last_turn"] is not None and a["last_turn"] == b["first_turn"]
    known = lambda c, f: f((x for x in (a[c], b[c]) if x is not None), default=None)
    return out | {"low": known("low", min), "high": known("high", max), "first_turn": a["first_turn"], "last_turn": b["last_turn"], "first_role": a["first_role"], "last_role": b["last_role"]}


PIECES = f"cid string, slice bigint, piece bigint, open boolean, signature string, {STATS}"


def pieces_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces of the conversations in a partition of ordered rows. ``open``: there may be other pieces of the conversation."""
    part, rows = TaskContext.get().partitionId(), []
    current: dict | None = None
    first_cid = None

    def sign(row: dict, c: str, *, fault: str | None) -> None:
        """One row more."""
        nonlocal current
        if current is not None and (current["cid"] != row["cid"] or len(current["signs"]) >= PIECE):
            close(same=current["cid"] == row["cid"])
        one = {c_: 0 for c_ in SUMS} | {"low": row["turn"], "high": row["turn"], "first_turn": row["turn"], "last_turn": row["turn"], "first_role": row["initial"], "last_role": row["initial"], "turns": int(row["turn"] is not None)}
        if fault:
            one[fault] = 1
        if current is None or "signs" not in current:
            nth = current["piece"] + 1 if current else 0
            current = {"cid": row["cid"], "slice": part, "piece": nth, "signs": [c], "stats": one}
        else:
            current["signs"].append(c)
            current["stats"] = merged(current["stats"], one)

    def close(*, same: bool, last: bool = False) -> None:
        """A piece is done; ``same``: its conversation goes on."""
        nonlocal current
        opened = same or last or current["piece"] > 0 or current["cid"] == first_cid
        rows.append({"cid": current["cid"], "slice": part, "piece": current["piece"], "open": opened, "signature": "".join(current["signs"])} | current["stats"])
        current = {"cid": current["cid"], "piece": current["piece"]} if same else None

    for batch in batches:
        for row in batch.to_pylist():
            first_cid = row["cid"] if first_cid is None else first_cid
            copies = row["n"]
            if row["sign"] != MUST_GO:
                sign(row, row["sign"], fault="truncated" if row["sign"].isupper() else None)
                copies -= 1
            for _ in range(copies):
                sign(row, MUST_GO, fault="blank" if row["blank"] else "duplicate")
                if len(rows) >= 4096:
                    yield record(rows, PIECES)
                    rows.clear()
        if rows:
            yield record(rows, PIECES)
            rows.clear()
    if current is not None:
        close(same=False, last=True)
        yield record(rows, PIECES)


def layers_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The layer at the end of each signature of a sorted partition."""
    walk = trie_walk(s for batch in batches for s in batch.column(0).to_pylist())
    rows = []
    for signature, layer in walk:
        costs, edits = flat(layer)
        rows.append({"signature": signature, "costs": costs, "edits": edits})
        if len(rows) >= 1024:
            yield record(rows, f"signature string, {LAYER}")
            rows = []
    if rows:
        yield record(rows, f"signature string, {LAYER}")


PART = f"cid string, slice bigint, piece bigint, {STATS}, {LAYER}"


def join_pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (cid, slice, piece, parts) as one piece each."""
    for batch in batches:
        rows = []
        for r in batch.to_pylist():
            stats, layer = None, None
            for p in r["parts"]:
                mine = {c: p[c] for c in STAT_NAMES}
                stats = mine if stats is None else merged(stats, mine)
                layer = unflat(p["costs"], p["edits"]) if layer is None else joined(layer, unflat(p["costs"], p["edits"]))
            costs, edits = flat(layer)
            rows.append({"cid": r["cid"], "slice": r["slice"], "piece": r["piece"], "costs": costs, "edits": edits} | stats)
        yield record(rows, PART)


def audits_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Cost and audit of whole conversations."""
    for batch in batches:
        rows = []
        for r in batch.to_pylist():
            cost, audit = answer(unflat(r["costs"], r["edits"]))
            gaps = 0 if r["low"] is None else r["high"] - r["low"] + 1 - r["turns"]
            rows.append({"cid": r["cid"], "gaps": gaps, "cost": cost, "audit": audit} | {c: r[c] for c in ("blank", "duplicate", "truncated", "illegal")})
        yield record(rows, AUDITS)


COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
AUDITS = ", ".join(["cid string", *(f"{c} bigint" for c in COUNTS), "audit string"])


def repaired(audit: str, rows: Iterator[tuple[str, str]]) -> Iterator[tuple[str, str, str]]:
    """(edit, role, text) of the rows that a conversation has in the end."""
    expected = "u"
    rows = iter(rows)
    for edit in audit:
        role, text = (None, "") if edit == INSERT else next(rows)
        if edit == DELETE:
            continue
        if edit != KEEP:
            role = ROLES[expected]
        expected = "a" if role[:1] == "u" else "u"
        yield edit, role, text


@dataclass
class Repair:
    """``audits``: a row for each conversation (conv, gaps, blank, duplicate, truncated, illegal, cost, audit); ``rows``: what its edits apply to, in no order."""

    audits: DataFrame
    rows: DataFrame

    def stream(self, run, schema: T.StructType) -> DataFrame:
        """``run`` over (audit, iterator of role and text) of each conversation, one after the other; it gives batches of ``schema``."""
        heads = self.audits.select("cid", F.lit(0).alias("kind"), F.struct("conv", *COUNTS, "audit").alias("head"))
        order = ("turn", "role", "near", "h1", "h2")
        bodies = self.rows.select("cid", F.lit(1).alias("kind"), *order, "text", "n")
        both = heads.unionByName(bodies, allowMissingColumns=True).repartition("cid").sortWithinPartitions("cid", "kind", *order)

        def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
            for batch in batches:
                yield from batch.to_pylist()

        def conversations(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[dict, Iterator[tuple[str, str]]]]:
            rows, ahead = rows_of(batches), [None]

            def body() -> Iterator[tuple[str, str]]:
                for r in rows:
                    if r["kind"] == 0:
                        ahead[0] = r
                        return
                    for _ in range(r["n"]):
                        yield r["role"], r["text"]
                ahead[0] = None

            ahead[0] = next(rows, None)
            while ahead[0] is not None:
                mine = body()
                yield ahead[0]["head"], mine
                for _ in mine:  # what the reader left
                    pass

        return mapped(both.select("cid", "kind", "head", "role", "text", "n"), lambda batches: run(conversations(batches)), schema)

    def turns(self) -> DataFrame:
        """(conv, place, edit, role, text): the conversations as they are after repair; place counts from 0."""
        conv = self.audits.schema["conv"]
        schema = T.StructType([conv, T.StructField("place", T.LongType()), *(T.StructField(c, T.StringType()) for c in ("edit", "role", "text"))])
        kinds = [T.ArrayType(f.dataType) for f in schema]
        arrow = [_arrow(k.elementType) for k in kinds]

        def run(conversations) -> Iterator[pa.RecordBatch]:
            out = []
            for head, body in conversations:
                for n, (edit, role, text) in enumerate(repaired(head["audit"], body)):
                    out.append((head["conv"], n, edit, role, text))
                    if len(out) >= 1024:
                        yield _batch(out, schema.names, arrow)
                        out = []
            if out:
                yield _batch(out, schema.names, arrow)

        return self.stream(run, schema)

    def digests(self) -> DataFrame:
        """``audits`` with sha256, lower-case hex, of the repaired rows as ``role:text``, joined by newlines."""
        conv = self.audits.schema["conv"]
        schema = T.StructType([conv, *(T.StructField(c, T.LongType()) for c in COUNTS), T.StructField("audit", T.StringType()), T.StructField("sha256", T.StringType())])
        arrow = [_arrow(f.dataType) for f in schema]

        def run(conversations) -> Iterator[pa.RecordBatch]:
            out = []
            for head, body in conversations:
                digest = hashlib.sha256()
                for n, (_, role, text) in enumerate(repaired(head["audit"], body)):
                    digest.update(f"{chr(10) * (n > 0)}{role}:{text}".encode("utf-8", "surrogatepass"))
                out.append((head["conv"], *(head[c] for c in COUNTS), head["audit"], digest.hexdigest()))
                if len(out) >= 1024:
                    yield _batch(out, schema.names, arrow)
                    out = []
            if out:
                yield _batch(out, schema.names, arrow)

        return self.stream(run, schema)


def _arrow(kind: T.DataType) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(kind)


def _batch(rows: list[tuple], names: list[str], kinds: list[pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)


def repair(rows: DataFrame, *, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", copies: Column | None = None) -> Repair:
    """Faults and cheapest edits of each conversation.

    Rows stand in order of turn, nulls first; those of one turn by role, then by the first characters of their text, then by its hash; equal rows are together. A row's
    first fault counts: blank (no character but space and tab to carriage return), duplicate (role and text stood before), truncated (its last other character
    isn't one of ``.!?``). Blank and duplicate rows are deleted (2 each); a row may be kept, given to user or assistant (1) or deleted (2), rows without text be inserted anywhere (5),
    a truncated row that stays costs 5 more. Roles are known by their first letter. ``gaps`` counts turns that are missing between the first and the last.
    ``copies`` (an expression over ``rows``) says how often a row stands there; conversations of which nothing is left have zeros and an empty audit. A null conversation is one of its own;
    nulls in roles and texts are one space. No rows: no conversations. Other columns are left out.
    """
    n = F.lit(1).cast("long") if copies is None else copies
    spoken = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    x = rows.select(F.col(conv).alias("conv"), F.col(turn).cast("long").alias("turn"), spoken(role).alias("role"), spoken(text).alias("text"), n.cast("long").alias("n"))
    there = F.col("n") > 0
    x = x.select("conv", *(F.when(there, F.col(c)).alias(c) for c in ("turn", "role", "text")), "n").groupBy("conv", "turn", "role", "text").agg(F.sum("n").alias("n"))
    cid = F.when(F.col("conv").isNull(), "").otherwise(F.concat(F.lit("="), F.col("conv").cast("string")))
    last = F.regexp_extract("text", r"([^\x20\x09-\x0D])[\x20\x09-\x0D]*\z", 1)
    x = x.select(cid.alias("cid"), "*", F.substring("text", 1, HEAD).alias("near"), F.xxhash64("text").alias("h1"), F.xxhash64(F.lit(7), "text").alias("h2"), (last == "").alias("blank"), (~last.isin(".", "!", "?")).alias("cut"))
    x = stage(x, "rows")
    said = x.where("n > 0")
    light = said.drop("conv", "text").withColumn("at", F.coalesce(F.col("turn").cast("string"), F.lit("")))

    # Which rows are the first of their role and text: equal keys on both sides are one row each.
    firsts = light.groupBy("cid", "role", "h1", "h2").agg(F.min(F.struct(F.col("turn").isNotNull(), "turn", "at"))["at"].alias("at")).withColumn("first", F.lit(True))
    light = light.join(firsts, ["cid", "role", "h1", "h2", "at"], "left")
    initial = F.substring("role", 1, 1)
    letter = F.when(initial.isin("s", "u", "a"), initial).otherwise("o")
    stays = ~F.col("blank") & F.coalesce("first", F.lit(False))
    sign = F.when(~stays, MUST_GO).when(F.col("cut"), F.upper(letter)).otherwise(letter)
    ordered = light.select("cid", "turn", "role", "near", "h1", "h2", "n", "blank", initial.alias("initial"), sign.alias("sign")).repartitionByRange("cid", "turn", "role", "near", "h1", "h2").sortWithinPartitions("cid", "turn", "role", "near", "h1", "h2")
    pieces = stage(mapped(ordered.select("cid", "turn", "n", "blank", "initial", "sign"), pieces_of, PIECES), "pieces")

    # The programme, over distinct signatures in order.
    sorted_ = pieces.select("signature").distinct().repartitionByRange("signature").sortWithinPartitions("signature")
    layers = stage(mapped(sorted_, layers_of, f"signature string, {LAYER}"), "layers")
    solved = pieces.join(broadcast_if_small(layers), "signature")
    columns = [*BASE, *STAT_NAMES, "costs", "edits"]
    whole = solved.where("not open").select(*columns)
    open_ = stage(solved.where("open").select(*columns), "open")
    for level in ("piece", "slice"):
        while open_.where(F.col(level) > 0).limit(1).count():
            above = [F.floor(F.col(c) / FAN).cast("long").alias(c) if c == level else F.col(c) for c in BASE]
            keyed = open_.select(*above, F.struct(*(F.col(c) for c in columns)).alias("p"))
            grouped = keyed.groupBy(*BASE).agg(F.array_sort(F.collect_list("p")).alias("parts"))  # FAN at most
            open_ = stage(mapped(grouped, join_pieces, PART), "open")
    audits = mapped(whole.unionByName(open_.select(*columns)), audits_of, AUDITS)
    every = x.groupBy("cid").agg(F.first("conv").alias("conv"))
    found = every.join(audits, "cid", "left").select("cid", "conv", *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in COUNTS), F.coalesce("audit", F.lit("")).alias("audit"))
    return Repair(stage(found, "audits"), said)
