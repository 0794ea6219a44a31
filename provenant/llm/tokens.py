"""Token-ID output as length-delimited binary records, with an offset index beside each shard.

A shard ``part-PPPPPP-SSSSSS-A.rec`` is a run of records, each framed as

    uint64 length | uint32 masked crc32 of those 8 bytes | payload | uint32 masked crc32 of the payload

with all integers little-endian and ``masked(c) = ((c >> 15 | c << 17) + 0xA282EAD8) mod 2**32``, so that a
checksum stored beside other checksummed bytes stays a good check. A payload is

    uint8 bytes per id (2 or 4) | uint8 kind of key | key | the ids

where the key is of kind 0, an int64; 1, null, of no bytes; or 2, a uint32 length and so many bytes of UTF-8.

The index ``part-....idx`` has for each record: int64 offset, int64 ids before it in the shard, int64 ids in it.
Shuffled readers seek by it; sequential readers check both checksums. Shards are numbered in ascending order
of key and hold about ``shard_bytes``. Their names end in the number of the task's attempt (A), and the manifest lists those
of the attempt that Spark took, so attempts at once, or one whose executor was lost, never touch each other's files.
"""

from __future__ import annotations

import json
import struct
import unicodedata
import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from .common import fresh_path, mapped, single, stage, steps, utf8
from .words import WORD_P, Words

SHARD_BYTES = 32 << 20
#: Pieces that a worker keeps from task to task (some 33 bytes each), the most ids and bytes of one that is kept, and pieces encoded at once.
SLOTS, PIECE_IDS, PIECE_BYTES, NEW_PIECES = 1 << 19, 8, 64, 2_000
#: Bytes of a long text whose pieces are looked up together.
PORTION = 1 << 20
#: Kinds of bytes where pieces are cut: at blanks and line ends, and between a letter or digit and a mark.
KINDS = np.full(256, 3, np.uint8)
KINDS[[10, 32]] = 0
KINDS[48:58] = KINDS[65:91] = KINDS[97:123] = 1
KINDS[[ord(c) for c in ".,;:!?"]] = 2
AS_IT_IS = np.arange(256, dtype=np.uint8)
#: How byte-level vocabularies spell bytes: visible characters of Latin-1 stand for themselves, the others in turn for 256 and on.
_VISIBLE = [*range(33, 127), *range(161, 173), *range(174, 256)]
BYTE_LETTERS = {b: 256 + n for n, b in enumerate(x for x in range(256) if x not in _VISIBLE)}
HEAD, INDEX = struct.Struct("<QI"), struct.Struct("<qqq")
MANIFEST = "shard string, records long, n_tokens long"


def masked(data: bytes) -> int:
    """The masked checksum of some bytes."""
    c = zlib.crc32(data)
    return (((c >> 15) | (c << 17)) + 0xA282EAD8) & 0xFFFFFFFF


def framed(payload: bytes) -> bytes:
    """A record."""
    length = struct.pack("<Q", len(payload))
    return length + struct.pack("<I", masked(length)) + payload + struct.pack("<I", masked(payload))


def records(stream) -> Iterator[bytes]:
    """The payloads of a shard in order; raises ValueError if a checksum is wrong or the shard is cut off."""
    while head := stream.read(HEAD.size):
        if len(head) < HEAD.size or HEAD.unpack(head)[1] != masked(head[:8]):
            raise ValueError("a record's length is damaged")
        body = stream.read(HEAD.unpack(head)[0] + 4)
        payload = body[:-4]
        if len(body) != HEAD.unpack(head)[0] + 4 or struct.unpack("<I", body[-4:])[0] != masked(payload):
            raise ValueError("a record's payload is damaged")
        yield payload


def read_record(fs: pafs.FileSystem, path: str, nth: int) -> bytes:
    """The payload of the nth record of a shard, by its offset index: what a shuffled reader does."""
    with fs.open_input_file(path.removesuffix(".rec") + ".idx") as index:
        offset = INDEX.unpack(index.read_at(INDEX.size, nth * INDEX.size))[0]
    with fs.open_input_file(path) as shard:
        shard.seek(offset)
        return next(records(shard))


Key = int | str | None


def head(key: Key, width: int) -> bytes:
    """What stands before the ids of a payload."""
    if isinstance(key, str):
        data = key.encode()
        return struct.pack("<BBI", width, 2, len(data)) + data
    return struct.pack("<BB", width, 1) if key is None else struct.pack("<BBq", width, 0, key)


def packed(key: Key, ids: np.ndarray) -> bytes:
    """The payload of a document."""
    return head(key, ids.dtype.itemsize) + ids.tobytes()


def unpacked(payload: bytes) -> tuple[Key, np.ndarray]:
    """Key and ids of a payload."""
    width, kind = struct.unpack_from("<BB", payload)
    key, at = None, 2
    if kind == 0:
        (key,), at = struct.unpack_from("<q", payload, 2), 10
    elif kind == 2:
        at = 6 + struct.unpack_from("<I", payload, 2)[0]
        key = payload[6:at].decode()
    return key, np.frombuffer(payload, f"<u{width}", offset=at)


def separates(settings: dict) -> bool:
    """Whether a tokenizer with these settings gives a text the ids of its pieces (``KINDS``) one after the other.

    Its normaliser may only change characters by themselves or runs of white space, and its first pre-tokenizer must drop white space.
    A pattern that keeps what it matches is tried on characters of all kinds beside white space.
    """
    import regex

    parts = lambda x, name: [] if x is None else x[name] if x["type"] == "Sequence" else [x]
    for n in parts(settings.get("normalizer"), "normalizers"):
        if n["type"] not in ("NFC", "NFD", "Lowercase", "StripAccents") and not (n["type"] == "Replace" and n["pattern"].get("Regex") == r"\s+" and n["content"] == " "):
            return False
    first = next(iter(parts(settings.get("pre_tokenizer"), "pretokenizers")), {"type": None})
    if first["type"] == "Split":
        if first["behavior"] != "Removed" or not first["invert"] or "Regex" not in first["pattern"]:
            return False
        pattern, kinds = regex.compile(first["pattern"]["Regex"]), ("", "a", "É", "1", "'", "'s", ".", "-", "_", "́", "語")
        if any(regex.search(r"\s", m[0]) for x in kinds for y in kinds for m in pattern.finditer(f"{x} {y}")):
            return False
        if any(regex.search("[a-zA-Z0-9][.,;:!?]", m[0]) for x in "aZ1" for y in ".,;:!?" for z in kinds for m in pattern.finditer(f"{x}{y}{z}")):
            return False
    elif first["type"] not in ("Whitespace", "WhitespaceSplit", "BertPreTokenizer"):
        return False
    return settings.get("post_processor") is None and not any(t["lstrip"] or t["rstrip"] or " " in t["content"] for t in settings["added_tokens"])


class Encoder:
    """Ids of whole texts.

    With a tokenizer that ``separates`` at blanks, each distinct piece is encoded once and kept: in a table of fixed size, in the slot that its
    hash names, until another takes that. Pieces are told apart by two 64-bit hashes, and only short ones are kept. With any other tokenizer each text is encoded as a whole.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.by_piece = separates(json.loads(self.tokenizer.to_str()))
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        self.model = self.tokenizer.model if only_folds(json.loads(self.tokenizer.to_str())) else None
        if self.by_piece:
            self.one, self.two, self.many, self.ids = np.zeros(SLOTS, np.uint64), np.zeros(SLOTS, np.uint64), np.zeros(SLOTS, np.uint8), np.zeros((SLOTS, PIECE_IDS), self.dtype)

    def encode(self, raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in turn, and where those of each begin; texts are given as bytes and offsets."""
        if not self.by_piece:
            texts = [raw[a:b].tobytes().decode() for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
            ids = [np.array(e.ids, self.dtype) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
            return np.concatenate([*ids, np.zeros(0, self.dtype)]), np.cumsum([0, *map(len, ids)])
        if len(offsets) == 2 and len(raw) > PORTION:  # pieces of a long text don't meet across blanks
            ids = np.concatenate([self.by_pieces(x, np.array([0, len(x)]))[0] for x in portions(raw)])
            return ids, np.array([0, len(ids)])
        return self.by_pieces(raw, offsets)

    def by_pieces(self, raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The same, piece by piece."""
        pieces = Words(raw, offsets, kinds=KINDS, fold=AS_IT_IS, second=WORD_P)
        parts, counts = [np.zeros(0, self.dtype)], np.zeros(len(offsets), np.int64)
        for low, high, first in pieces.parts():
            ids, at = self.look_up(pieces, low, high)
            parts.append(ids)
            counts[1:] += np.diff(at[first])
        return np.concatenate(parts), np.cumsum(counts)

    def look_up(self, pieces: Words, low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
        """The ids of some pieces, and where those of each begin."""
        one, two = pieces.hash[low:high], pieces.other[low:high]
        slot = (one & np.uint64(SLOTS - 1)).astype(np.int64)
        known = (self.one[slot] == one) & (self.two[slot] == two) & (self.many[slot] > 0)
        many = self.many[slot].astype(np.int64)
        lacking = np.flatnonzero(~known)
        _, some, back = np.unique(one[lacking], return_index=True, return_inverse=True)
        some = lacking[some]
        new, cut = self.learn([pieces.raw[a:b].tobytes().decode() for a, b in zip(pieces.start[low + some].tolist(), pieces.end[low + some].tolist(), strict=True)])
        size = np.diff(cut)
        many[lacking] = size[back]
        at = np.concatenate([[0], np.cumsum(many)])
        out = np.empty(int(at[-1]), self.dtype)
        mine = np.flatnonzero(known)
        for k in range(PIECE_IDS):
            mine = mine[many[mine] > k]
            out[at[mine] + k] = self.ids[slot[mine], k]
        n = many[lacking]
        within = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        out[np.repeat(at[:-1][lacking], n) + within] = new[np.repeat(cut[:-1][back], n) + within]
        # of new pieces for one slot the last takes it
        short = (size > 0) & (size <= PIECE_IDS) & (pieces.end[low + some] - pieces.start[low + some] <= PIECE_BYTES)
        _, last = np.unique(slot[some][short][::-1], return_index=True)
        chosen = np.flatnonzero(short)[::-1][last]
        to = slot[some[chosen]]
        self.one[to], self.two[to], self.many[to] = one[some[chosen]], two[some[chosen]], size[chosen]
        for k in range(PIECE_IDS):
            has = size[chosen] > k
            self.ids[to[has], k] = new[cut[:-1][chosen[has]] + k]
        return out, at

    def learn(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of some pieces, and where those of each begin."""
        ids = [self.of_letters(p) for p in pieces]
        other = [i for i, x in enumerate(ids) if x is None]
        for i in range(0, len(other), NEW_PIECES):
            part = other[i : i + NEW_PIECES]
            for k, e in zip(part, self.tokenizer.encode_batch_fast([pieces[k] for k in part], add_special_tokens=False), strict=True):
                ids[k] = e.ids
        cut = np.cumsum([0, *map(len, ids)])
        return np.fromiter((x for p in ids for x in p), self.dtype, int(cut[-1])), cut

    def of_letters(self, piece: str) -> list[int] | None:
        """The ids of a piece of letters by the tokenizer's model alone; None if it isn't one, or the tokenizer may do more to it."""
        if self.model is None or not piece.isalpha():
            return None
        if piece.isascii():
            return [t.id for t in self.model.tokenize(piece.lower())]
        folded = "".join(c.lower() for c in unicodedata.normalize("NFC", piece))  # letter by letter, as the tokenizer does
        return [t.id for t in self.model.tokenize(folded.encode().decode("latin-1").translate(BYTE_LETTERS))] if folded.isalpha() else None


def only_folds(settings: dict) -> bool:
    """Whether a tokenizer composes and lower-cases a word of letters, spells its bytes, and does no more before its model sees it."""
    names = [n["type"] for n in settings["normalizer"]["normalizers"]] if (settings.get("normalizer") or {}).get("type") == "Sequence" else []
    split = settings["pre_tokenizer"]["pretokenizers"] if (settings.get("pre_tokenizer") or {}).get("type") == "Sequence" else []
    letters = len(split) == 2 and split[0]["type"] == "Split" and "[\\p{L}]+" in split[0]["pattern"].get("Regex", "").split("|")
    return names == ["NFC", "Replace", "Lowercase"] and letters and split[1]["type"] == "ByteLevel" and not split[1]["add_prefix_space"] and not split[1]["use_regex"]


def portions(raw: np.ndarray) -> Iterator[np.ndarray]:
    """A text's bytes, cut after blanks into portions of PORTION bytes or less, or what a longer piece takes."""
    a = 0
    while len(raw) - a > PORTION:
        blanks = np.flatnonzero(KINDS[raw[a : a + PORTION]] == 0)
        size = int(blanks[-1]) + 1 if len(blanks) else PORTION
        while not len(blanks) and a + size < len(raw):  # a piece that is longer than that
            blanks = np.flatnonzero(KINDS[raw[a + size : a + size + PORTION]] == 0)
            size += int(blanks[0]) + 1 if len(blanks) else PORTION
        yield raw[a : min(a + size, len(raw))]
        a = min(a + size, len(raw))
    if a < len(raw):
        yield raw[a:]


@lru_cache(maxsize=1)
def encoder(path: str) -> Encoder:
    """A worker's encoder, kept from task to task."""
    return Encoder(path)


class ShardWriter:
    """Writes records to shards of about ``most`` bytes, each with its index."""

    def __init__(self, uri: str, task: int, attempt: int, most: int):
        self.fs, self.root = pafs.FileSystem.from_uri(uri)
        self.fs.create_dir(self.root, recursive=True)
        self.task, self.attempt, self.most, self.nth, self.done, self.stream = task, attempt, most, 0, [], None

    def add(self, payload: bytes, n: int) -> None:
        if self.stream is None:
            self.name = f"part-{self.task:06d}-{self.nth:06d}-{self.attempt}"
            self.stream, self.at, self.n, self.index = self.fs.open_output_stream(f"{self.root}/{self.name}.rec"), 0, 0, []
        record = framed(payload)
        self.stream.write(record)
        self.index.append(INDEX.pack(self.at, self.n, n))
        self.at, self.n = self.at + len(record), self.n + n
        if self.at >= self.most:
            self.roll()

    def roll(self) -> None:
        if self.stream is None:
            return
        self.stream.close()
        with self.fs.open_output_stream(f"{self.root}/{self.name}.idx") as out:
            out.write(b"".join(self.index))
        self.done.append((self.name, len(self.index), self.n))
        self.stream, self.nth = None, self.nth + 1


def write_tokens(docs: DataFrame, uri: str, tokenizer: str, *, end_id: int | None, key: str = "doc_id", text: str = "text", shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Write the ids of all documents, in ascending order of key, under ``uri``; returns the staged manifest, a row for each shard.

    Keys are whole numbers or strings; others are written as strings, in their own order. A null text is an empty one: only the end
    id. Null keys come first; rows of one key are ordered by text, so reruns agree. Repeated rows are each written. No rows: no
    shard. Other columns are not read.
    """
    order = F.asc_nulls_first("k")
    slim = docs.select(F.col(key).alias("k"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    ordered = slim.repartitionByRange(order).sortWithinPartitions(order, "t").select(F.col("k").cast(key_type(docs, key)).alias("k"), "t")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(tokenizer)
        context = TaskContext.get()
        writer = ShardWriter(uri, context.partitionId(), context.taskAttemptId(), shard_bytes)
        tail = np.array([] if end_id is None else [end_id], coder.dtype).tobytes()
        width = coder.dtype.itemsize
        for batch in batches:
            keys = single(batch, "k").to_pylist()
            raw, offsets = utf8(single(batch, "t"))
            for i, j in steps(offsets):
                ids, at = coder.encode(raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                for k, a, b in zip(keys[i:j], at[:-1].tolist(), at[1:].tolist(), strict=True):
                    writer.add(head(k, width) + ids[a:b].tobytes() + tail, b - a + len(tail) // width)
        writer.roll()
        names, counts, tokens = zip(*writer.done, strict=True) if writer.done else ((), (), ())
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(counts, pa.int64()), pa.array(tokens, pa.int64())], names=["shard", "records", "n_tokens"])

    return stage(mapped(ordered, run, MANIFEST), "manifest")


def key_type(docs: DataFrame, key: str) -> str:
    """What a key is in a record: long for whole numbers, else string."""
    return "long" if isinstance(docs.select(key).schema[0].dataType, T.IntegralType) else "string"


def read_tokens(manifest: DataFrame, uri: str, derive: Callable[[Key, np.ndarray], tuple], schema: str, *, key: str = "long") -> DataFrame:
    """A row for each record of the shards: key (of type ``key``, long or string), start (ids of all records before it), n_tokens, and what ``derive(key, ids)`` gives.

    Only the manifest, a row for each shard, is put in order in one task; the shards are read in parallel, each checked by its checksums.
    """
    before = F.sum("n_tokens").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1))
    shards = manifest.withColumn("base", F.coalesce(before, F.lit(0)))
    tasks = max(1, min(manifest.count(), 10_000))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = pafs.FileSystem.from_uri(uri)
        for batch in batches:
            for name, base in zip(single(batch, "shard").to_pylist(), single(batch, "base").to_pylist(), strict=True):
                rows, at = [], base
                with fs.open_input_stream(f"{root}/{name}.rec", buffer_size=1 << 20) as stream:
                    for payload in records(stream):
                        key, ids = unpacked(payload)
                        rows.append((key, at, len(ids), *derive(key, ids)))
                        at += len(ids)
                        if len(rows) >= 20_000:
                            yield table(rows)
                            rows = []
                if rows:
                    yield table(rows)

    kinds = T.StructType.fromDDL(f"key {key}, start long, n_tokens long{', ' + schema if schema else ''}")
    arrow = pa.schema([(f.name, to_arrow_type(f.dataType)) for f in kinds])

    def table(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), arrow, strict=True)], schema=arrow)

    return mapped(shards.repartition(tasks, "shard"), run, kinds)


def ids_crc32(key: Key, ids: np.ndarray) -> tuple[int]:
    """Unsigned crc32 of ids as little-endian unsigned 32-bit integers."""
    return (zlib.crc32(ids.astype("<u4").tobytes()),)


def token_output(docs: DataFrame, tokenizer: str, *, uri: str | None = None, end_id: int | None = 2, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Write, read back, and give a row for each document: key, start, n_tokens, ids_crc32."""
    uri = uri or fresh_path(docs.sparkSession, "tokens")
    manifest = write_tokens(docs, uri, tokenizer, end_id=end_id, key=key, text=text)
    out = read_tokens(manifest, uri, ids_crc32, "ids_crc32 long", key=key_type(docs, key))
    return out.withColumn("key", F.col("key").cast(docs.select(key).schema[0].dataType))
