"""Language identification by compression.

Case is folded first. For each language, learning texts make a zstandard raw-content dictionary of bounded size. A text is cut into blocks;
each block is compressed with every language's dictionary, and the language with the least total size wins: the text is
most like what its dictionary holds. A language's share of the learning rows counts as the bits it takes to name it, which
decides between sizes that are all but equal. The score compares the two best sizes; where the margin between them is narrow,
the prediction is rejected. Blocks keep a long text from becoming its own dictionary; every byte is in one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Sealed, mapped, single

#: Bytes of learning text in a language's dictionary, and texts that it is drawn from: a bounded sample.
DICTIONARY_BYTES, DICTIONARY_TEXTS = 96 << 10, 256
BLOCK_BYTES = 1024
LEVEL = 6
#: Relative margin between the two best sizes under which a prediction is rejected.
MARGIN = 0.01
UNKNOWN = "und"


Learned = dict[str, tuple[bytes, int]]


def learn_dictionaries(docs: DataFrame, learn: Column, *, key: str = "doc_id", text: str = "text", lang: str = "lang", texts: int = DICTIONARY_TEXTS, size: int = DICTIONARY_BYTES) -> Learned:
    """A raw dictionary for each non-null language of the learning rows, and its number of rows.

    Languages are cut into ``texts`` hash ranges of the text, and the text with the least hash of each range is drawn, once for all
    its copies; so only hashes are grouped, with partial sums. Of each drawn text one piece from a hashed place comes to the driver;
    pieces are sized so that all of them, with short texts whole, fill ``size`` bytes and none is dropped.
    """
    rows = docs.where(learn & F.col(lang).isNotNull() & F.col(text).isNotNull())
    rows = rows.select(F.col(lang).cast("string").alias("l"), F.col(text).alias("t"), F.xxhash64(F.lit(5), F.col(text)).alias("_h"), F.octet_length(F.col(text)).alias("bytes"))
    drawn = F.when(F.col("bytes") > 0, F.struct("_h", "bytes"))
    least = rows.groupBy("l", F.pmod("_h", F.lit(texts)).alias("r")).agg(F.min(drawn).alias("d"), F.count("*").alias("n")).collect()
    counts: dict[str, int] = {}
    sizes: dict[str, dict[int, int]] = {}
    for r in least:
        counts[r["l"]] = counts.get(r["l"], 0) + r["n"]
        mine = sizes.setdefault(r["l"], {})
        if r["d"]:
            mine[r["d"]["_h"]] = r["d"]["bytes"]
    caps = {x: share(list(mine.values()), size - len(mine) + 1) for x, mine in sizes.items()}
    samples: dict[str, list[bytes]] = {x: [] for x in sizes}
    chosen = [(x, h, caps[x]) for x, mine in sizes.items() for h in mine]
    if chosen:
        near = F.broadcast(docs.sparkSession.createDataFrame(chosen, "l string, _h long, cap int"))
        chars = F.char_length("t")
        take = F.when(F.col("bytes") <= F.col("cap"), chars).otherwise(F.greatest(F.lit(1), F.floor(F.col("cap") / F.col("bytes") * chars))).cast("int")
        place = F.pmod(F.xxhash64(F.lit(6), F.col("t")), (chars - take + 1).cast("long")).cast("int") + 1
        picked = rows.join(near, ["l", "_h"]).select("l", "_h", "cap", F.substring(F.col("t"), place, take).alias("t")).groupBy("l", "_h", "cap").agg(F.min("t").alias("t"))
        for r in sorted(picked.collect(), key=lambda r: (r["l"], r["_h"])):
            samples[r["l"]].append(r["t"].lower().encode()[: r["cap"]])  # a piece's characters may be a few bytes longer than the text's are on average
    return {x: (b"\n".join(parts), counts[x]) for x, parts in samples.items()}


def share(sizes: list[int], most: int) -> int:
    """The largest cap with which sizes cut to it have at most ``most`` in all."""
    left, cap = most, 0
    for i, n in enumerate(sorted(sizes)):
        cap = left // (len(sizes) - i)
        if n > cap:
            return max(cap, 1)
        left -= n
    return max(sizes, default=0)


class Classifier:
    """Compressors with the languages' dictionaries, languages in ascending order."""

    def __init__(self, learned: Learned):
        self.langs = sorted(learned)
        rows = np.array([learned[x][1] for x in self.langs], float)
        self.named = -np.log2(rows / rows.sum()) / 8 if len(rows) else rows
        self.compressors = []
        for lang in self.langs:
            content = zstandard.ZstdCompressionDict(learned[lang][0], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            how = zstandard.ZstdCompressionParameters.from_level(LEVEL, source_size=BLOCK_BYTES, dict_size=DICTIONARY_BYTES, write_content_size=False, write_dict_id=False)
            content.precompute_compress(compression_params=how)
            self.compressors.append(zstandard.ZstdCompressor(compression_params=how, dict_data=content))

    def sizes(self, text: bytes) -> np.ndarray:
        """Compressed size by language, summed over the blocks of the whole text."""
        total = np.zeros(len(self.compressors))
        for i in range(0, len(text), BLOCK_BYTES):
            block = text[i : i + BLOCK_BYTES]
            total += [len(c.compress(block)) for c in self.compressors]
        return total + self.named

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        """Language, score in [0, 1], whether rejected. A text that is null or has no letter is unknown, with score 0, and rejected."""
        if not text or not self.langs or not any(map(str.isalpha, text)):
            return UNKNOWN, 0.0, True
        data = text.lower().encode()
        sizes = self.sizes(data)
        order = np.argsort(sizes, kind="stable")  # of equal sizes the first language
        best = float(sizes[order[0]])
        if len(order) == 1:
            return self.langs[0], 1.0, False
        margin = (float(sizes[order[1]]) - best) / best
        return self.langs[order[0]], float(1 - 0.5 * np.exp(-margin * 20)), margin < MARGIN


def predict(docs: DataFrame, dictionaries: Learned, *, text: str = "text", lang: str = "_lang", score: str = "_score", rejected: str = "_rejected") -> DataFrame:
    """``docs`` with the predicted language, its score and whether the margin was too narrow; columns of these names are replaced.

    Texts that are null, empty or without a letter are ``und``; so is every text if nothing was learned.
    """
    sealed = Sealed(docs, lang, score, rejected)
    column = sealed[text]
    shared = docs.sparkSession.sparkContext.broadcast(dictionaries)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classifier = Classifier(shared.value)
        for batch in batches:
            out = [classifier.predict(t.as_py()) for t in single(batch, column)]
            names, scores, narrow = zip(*out, strict=True) if out else ((), (), ())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(names, pa.string()), pa.array(scores, pa.float64()), pa.array(narrow, pa.bool_())], names=[*batch.schema.names, "_lang", "_score", "_rejected"])

    added = [T.StructField("_lang", T.StringType()), T.StructField("_score", T.DoubleType()), T.StructField("_rejected", T.BooleanType())]
    found = mapped(sealed.df, run, T.StructType([*sealed.df.schema.fields, *added]))
    return sealed.open(found, **{lang: F.col("_lang"), score: F.col("_score"), rejected: F.col("_rejected")})
