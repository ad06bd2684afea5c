"""Best-fit packing of documents into training sequences by sums of squares.

A text's token ids and one end make a document; a longer one than a sequence is cut from its end into whole sequences, so
only its first piece may be shorter. Whole pieces are sequences of their own. The others are placed one by one: of the open
bins' gaps that hold the piece, and a new bin, that choice is taken after which the squared numbers of open bins per gap
sum to least; of equal ones the one that leaves the smallest gap. The numbers per gap are all that a choice needs, so a
piece costs one pass over an array as long as a sequence, whatever is open. Pieces come in the order of a hash, because
sums of squares keep bins of every gap ready for what comes next, and pieces in order of size would waste that.

Packing is distributed: pieces are dealt by hash to shards of some SHARD pieces, which are packed apart. The bins of a shard
that end with a gap over a POOR-th of a sequence are taken apart, and their pieces, from all shards, are dealt to
fewer shards in the next round, until one shard is left or a round settles less than half. Only numbers of pieces
and their lengths are shuffled for that.

Token ids are those of the tokenizers library. Texts are cut where the vocabulary's pattern always starts a new match and the parts looked up in bounded caches
of their ids' bytes; the library encodes what the caches lack.

Defined cases: a null text is an empty one, whose only token is the end. Rows that repeat an id, and null ids, are documents
of their own. A document of exactly one sequence is one piece. An empty table gives an empty result. Other columns don't matter,
whatever their names.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache, reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType
from tokenizers import Tokenizer

from reachlake.llm.bpe import byte_alphabet
from reachlake.llm.common import whole, written

LENGTH = 2048
END_ID = 0
#: Pieces of a shard, on average, and the part of a sequence that a settled bin leaves at most.
SHARD, POOR = 1 << 16, 8
#: Cached parts of texts, and the longest that is cached.
CACHE_PARTS, CACHE_CHARS = 1 << 19, 64
DIGITS = "0123456789"
#: Marks of ASCII but for the apostrophe.
MARKS = "".join(c for c in map(chr, range(0x21, 0x7F)) if not c.isalnum() and c != "'")


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class Irregular(Exception):
    """A part that white space joins to the next one."""


class Cache(dict):
    """Texts' ids as bytes, in two generations: when the young one is full it becomes the old one, so what is frequent stays."""

    def __init__(self, make: Callable[[str], bytes]) -> None:
        super().__init__()
        self.make, self.old = make, {}

    def __missing__(self, text: str) -> bytes:
        found = self.old.get(text)
        if found is None:
            found = self.make(text)
        if len(text) <= CACHE_CHARS:
            if len(self) >= CACHE_PARTS:
                self.old = dict(self)
                self.clear()
            self[text] = found
        return found


class Parts:
    """The ids of texts as little-endian unsigned 32-bit integers.

    The vocabulary's pattern starts a new match at a space after anything but white space, at a line feed between two such characters and behind it, and where letters or digits end and
    marks begin (but for apostrophes, which it joins to some letters). A text is cut at its spaces, and a part that wasn't seen before at the others."""

    def __init__(self, tokenizer: Tokenizer) -> None:
        self.tokenizer, self.model, self.alphabet = tokenizer, tokenizer.model, dict(enumerate(byte_alphabet()))
        self.spaced, self.bare = Cache(lambda part: self.cut(part, self.spaced, " ")), Cache(lambda part: self.cut(part, self.bare, ""))
        self.line_feed = self.ids("\n")

    def ids(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def word(self, text: str) -> bytes:
        """The ids of one match of the pattern, which needs no more than the merges."""
        return np.array([x.id for x in self.model.tokenize(text.encode().decode("latin-1").translate(self.alphabet))], "<u4").tobytes()

    def cut(self, part: str, own: Cache, lead: str) -> bytes:
        """The ids of lead and a part that doesn't end in white space."""
        if not part or part[-1].isspace():
            raise Irregular
        first, feed, rest = part.partition("\n")
        if feed and first and not first[-1].isspace() and not rest[0].isspace():
            return own[first] + self.line_feed + self.bare[rest]
        word = part.rstrip(MARKS)
        if word and len(word) < len(part) and (word[-1].isalpha() or word[-1] in DIGITS) and "<|" not in part:
            return own[word] + self.bare[part[len(word) :]]
        # Letters alone, with a space or without, are one match.
        return self.word(lead + part) if part.isalpha() else self.ids(lead + part)

    def encode(self, text: str) -> bytes:
        first, *parts = text.split(" ")
        if first and not first[-1].isspace():
            try:
                return b"".join([self.bare[first], *map(self.spaced.__getitem__, parts)])
            except Irregular:
                pass
        joined = [[first]]
        for part in parts:
            last = joined[-1][-1]
            if not last or last[-1].isspace():
                joined[-1].append(part)
            else:
                joined.append([part])
        head, *rest = [" ".join(x) for x in joined]
        tail = [self.ids(" " + x) if not x or x[-1].isspace() else self.spaced[x] for x in rest[-1:]]
        return b"".join([self.ids(head) if head else b"", *map(self.spaced.__getitem__, rest[:-1]), *tail])


@lru_cache(maxsize=2)
def parts_of(path: str) -> Parts:
    """One per Python worker."""
    return Parts(Tokenizer.from_file(path))


def pieces_of(docs: DataFrame, id_col: str, text_col: str, length: int, path: str) -> DataFrame:
    """The pieces of each row of docs as a written table: id, uid (a number of its own), piece, start, length, ids_crc32."""
    own = StructType([StructField("id", docs.schema[id_col].dataType), StructField("piece", IntegerType()), *(StructField(n, LongType()) for n in ("start", "length", "ids_crc32"))])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = parts_of(path).encode
        end = np.array([END_ID], "<u4").tobytes()
        for batch in batches:
            rows, pieces = [], []
            for i, text in enumerate(batch.column("text")):
                ids = encode(text.as_py()) + end
                n, start = len(ids) // 4, 0
                size = n % length or min(n, length)
                for piece in range(-(-n // length)):
                    rows.append(i)
                    pieces.append((piece, start, size, zlib.crc32(memoryview(ids)[4 * start : 4 * (start + size)])))
                    start, size = start + size, length
            columns = [batch.column("id").take(pa.array(rows, pa.int64())), *(pa.array([p[k] for p in pieces], t) for k, t in enumerate((pa.int32(), pa.int64(), pa.int64(), pa.int64())))]
            yield pa.RecordBatch.from_arrays(columns, names=own.names)

    cuts = docs.select(F.col(id_col).alias("id"), whole(text_col).alias("text")).mapInArrow(cut, own)
    return written(cuts.withColumn("uid", F.monotonically_increasing_id()), "pieces")


def place(sizes: list[int], length: int) -> tuple[list[int], list[int], list[int]]:
    """For each size, in turn, the number of its bin and its offset there; and the gaps that the bins are left with."""
    # Full bins and unopened ones aren't open: their places in count stay 0 and make no square.
    count = np.zeros(length + 1, np.int64)
    bins: list[list[int]] = [[] for _ in range(length + 1)]
    gaps: list[int] = []
    placed, offsets = [], []
    for size in sizes:
        before, after = count[size:], count[: length + 1 - size]
        # What the sum of squares grows by, halved and rounded up the same for every choice but the two ends.
        growth = 2 * (after - before) + 2
        growth[0] -= 1
        growth[-1] -= 1
        growth[:-1][before[:-1] == 0] = np.iinfo(np.int64).max
        gap = size + int(growth.argmin())
        if gap == length:
            number = len(gaps)
            gaps.append(length)
        else:
            number = bins[gap].pop()
            count[gap] -= 1
        placed.append(number)
        offsets.append(length - gap)
        gaps[number] = left = gap - size
        if left:
            bins[left].append(number)
            count[left] += 1
    return placed, offsets, gaps


def packer(length: int) -> Callable[[pd.DataFrame], pd.DataFrame]:
    def pack(df: pd.DataFrame) -> pd.DataFrame:
        df = df.sort_values(["order", "uid"])
        placed, offsets, gaps = place(df["length"].tolist(), length)
        uid = df["uid"].to_numpy()
        first = np.empty(len(gaps), np.int64)
        for i in range(len(placed) - 1, -1, -1):
            first[placed[i]] = uid[i]
        return pd.DataFrame({"uid": uid, "length": df["length"].to_numpy(), "sequence_id": first[placed], "offset": offsets, "gap": np.array(gaps, np.int64)[placed]})

    return pack


def pack_sequences(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, path: str | None = None) -> DataFrame:
    """One row per piece of a row of docs: id, piece, start, length, ids_crc32, sequence_id and offset."""
    pieces = pieces_of(docs, id_col, text_col, length, path or vocabulary_path())
    active = pieces.filter(F.col("length") < length).select("uid", "length")
    settled, n = [], active.count()
    while n:
        shards = -(-n // SHARD)
        # Another order and other shards in each round.
        order = F.xxhash64("uid", F.lit(len(settled)))
        dealt = active.withColumns({"order": order, "shard": F.pmod(order, F.lit(shards))})
        packed = written(dealt.repartition(shards, "shard").groupBy("shard").applyInPandas(packer(length), "uid long, length long, sequence_id long, offset long, gap long"), "packed")
        poor = F.col("gap") * POOR > length
        left = packed.filter(poor).count() if shards > 1 else 0
        if 2 * left > n:
            left = 0
        settled.append(packed.filter(~poor) if left else packed)
        active, n = packed.filter(poor).select("uid", "length"), left
    out = [F.col("id").alias(id_col), "piece", "start", "length", "ids_crc32"]
    alone = pieces.filter(F.col("length") == length).select(*out, F.col("uid").alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    if not settled:
        return alone
    places = reduce(DataFrame.unionAll, settled).select("uid", "sequence_id", "offset")
    return alone.unionAll(pieces.filter(F.col("length") < length).join(places, "uid").select(*out, "sequence_id", "offset"))
