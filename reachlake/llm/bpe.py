"""BPE encoding and decoding with a public word-level vocabulary (word ends, lower case).

A word's symbols are merged by a segment tree over its adjacent pairs: a leaf holds the rank of the pair that
starts there (infinite if it isn't a merge), an inner node the smaller of its children with the left one winning
ties, so the root names the leftmost lowest-ranked merge. A merge changes three leaves, each in logarithmic time; it
goes on until the root is infinite. Words are looked up first in a bounded cache. A word of any length is
merged whole in O(n log n).

The file's own pipeline comes before: added tokens are cut out, NFC, white space, lower case character by
character, the split by pattern and the byte alphabet. The file names no decoder, so decoding joins the tokens'
strings with spaces, as the library does.

Defined cases: a null text is an empty one and has no ids; its decoded text is empty. Rows that repeat are encoded
again. An empty table gives an empty result. Other columns don't matter, whatever their names.
"""

from __future__ import annotations

import hashlib
import json
import unicodedata
from array import array
from functools import lru_cache

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from reachlake.llm.common import whole

#: The letters and digits that Unicode 16 added, and later capitals' small letters. The library's pattern knows
#: Unicode 16, its small letters 17; Python's unicodedata may be older, the regex module newer.
UNICODE_16 = (
    (0x1C89, 0x1C8A), (0xA7CB, 0xA7CD), (0xA7DA, 0xA7DC), (0x105C0, 0x105F3), (0x10D40, 0x10D49), (0x10D4A, 0x10D65), (0x10D6F, 0x10D85),
    (0x10EC2, 0x10EC4), (0x11380, 0x11389), (0x1138B, 0x1138B), (0x1138E, 0x1138E), (0x11390, 0x113B5), (0x113B7, 0x113B7), (0x113D1, 0x113D1),
    (0x113D3, 0x113D3), (0x116D0, 0x116E3), (0x11BC0, 0x11BE0), (0x11BF0, 0x11BF9), (0x13460, 0x143FA), (0x16100, 0x1611D), (0x16130, 0x16139), (0x16D40, 0x16D6C),
    (0x16D70, 0x16D79), (0x18CFF, 0x18CFF), (0x1CCF0, 0x1CCF9), (0x1E5D0, 0x1E5ED), (0x1E5F0, 0x1E5F0), (0x1E5F1, 0x1E5FA),
)
LOWER_16 = {0x1C89: 0x1C8A, 0xA7CB: 0x264, 0xA7CC: 0xA7CD, 0xA7CE: 0xA7CF, 0xA7D2: 0xA7D3, 0xA7D4: 0xA7D5, 0xA7DA: 0xA7DB, 0xA7DC: 0x19B} | {c: c + 0x20 for c in range(0x10D50, 0x10D66)} | {c: c + 0x1B for c in range(0x16EA0, 0x16EB9)}
#: Words of a generation of the cache. A word takes some 200 bytes, its ids as two bytes each, so both generations take some 100 MB of a worker.
CACHE_WORDS = 1 << 18
#: Words longer than this aren't cached, which bounds the cache's bytes.
CACHE_CHARS = 64


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def byte_alphabet() -> list[str]:
    """The printable stand-in of each byte: itself where Latin-1 prints it, else the next character from 256 on."""
    own = {*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)}
    rest = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(rest)) for b in range(256)]


def of_known_letters(pattern: str) -> str:
    """The pattern with the letters and numbers of Unicode 16 and no later ones."""
    everything = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    new = [ord(c) for c in regex.findall(r"[\p{L}\p{N}]", everything) if unicodedata.category(c) == "Cn" and not any(a <= ord(c) <= b for a, b in UNICODE_16)]
    starts = [c for c, before in zip(new, [-1, *new], strict=False) if c != before + 1]
    ends = [c for c, after in zip(new, [*new[1:], -1], strict=True) if after != c + 1]
    known = "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in zip(starts, ends, strict=True))
    return regex.sub(r"\\p\{([LN])\}", lambda m: rf"[\p{{{m[1]}}}--[{known}]]", pattern) if known else pattern


NONE = 1 << 62


def merge_symbols(ids: list[int], merges: dict[int, int]) -> list[int]:
    """The symbols after all merges; merges has rank << 16 | merged symbol by left << 16 | right.

    The segment tree's leaf i is the entry of the pair that starts at symbol i, and an inner node the smaller of its two
    children, so the root is the lowest rank; going down to the left while the left child has it ends at the leftmost such
    pair. The updates stand here and not in functions, because a word of ordinary length takes a few microseconds.
    """
    n = len(ids)
    size, get = 1 << (n - 1).bit_length(), merges.get
    tree = [NONE] * (2 * size)
    at, left = size, ids[0]
    for right in ids[1:]:
        tree[at] = get(left << 16 | right, NONE)
        at, left = at + 1, right
    for i in range(size - 1, 0, -1):
        a, b = tree[2 * i], tree[2 * i + 1]
        tree[i] = a if a <= b else b
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    while (low := tree[1]) != NONE:
        i = 1
        while i < size:
            i *= 2
            if tree[i] != low:
                i += 1
        at = i - size
        gone = after[at]
        beyond, prior = after[gone], before[at]
        ids[at] = new = low & 0xFFFF
        ids[gone] = -1
        after[at] = beyond
        changed = [(gone + size, NONE)]
        if beyond < n:
            before[beyond] = at
            changed.append((i, get(new << 16 | ids[beyond], NONE)))
        else:
            changed.append((i, NONE))
        if prior >= 0:
            changed.append((prior + size, get(ids[prior] << 16 | new, NONE)))
        for i, value in changed:
            tree[i] = value
            while i > 1:
                other = tree[i ^ 1]
                if other < value:
                    value = other
                i >>= 1
                if tree[i] == value:
                    break
                tree[i] = value
    return [x for x in ids if x >= 0]


class Tokenizer:
    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model = spec["model"]
        self.vocab: dict[str, int] = dict(model["vocab"])
        self.end: str = model["end_of_word_suffix"] or ""
        self.tokens = {i: t for t, i in self.vocab.items()}
        self.added = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.tokens |= {i: t for t, i in self.added.items()}
        #: left << 16 | right -> rank << 16 | merged
        self.merges: dict[int, int] = {}
        for rank, pair in enumerate(model["merges"]):
            left, right = pair.split(" ") if isinstance(pair, str) else pair
            self.merges[self.vocab[left] << 16 | self.vocab[right]] = rank << 16 | self.vocab[left + right]
        split = next(x for x in spec["pre_tokenizer"]["pretokenizers"] if x["type"] == "Split")
        self.pattern = regex.compile("(?V1)" + of_known_letters(split["pattern"]["Regex"]))
        self.cut = regex.compile("(" + "|".join(map(regex.escape, sorted(self.added, key=len, reverse=True))) + ")")
        letters = byte_alphabet()
        self.inner = [self.vocab[x] for x in letters]
        self.last = [self.vocab[x + self.end] for x in letters]
        #: Two generations: a full young one becomes the old one, so frequent words stay.
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def merge(self, word: str) -> list[int]:
        raw = word.encode("utf-8", "surrogatepass")
        ids = list(map(self.inner.__getitem__, raw))
        ids[-1] = self.last[raw[-1]]
        return merge_symbols(ids, self.merges) if len(ids) > 1 else ids

    def unseen(self, chunk: str) -> bytes:
        """The ids of a chunk that the young generation lacks, two bytes each (merges hold no larger ones)."""
        ids = self.old.get(chunk)
        if ids is None:
            words = self.pattern.findall(chunk.translate(LOWER_16))
            if words == [chunk]:
                ids = array("H", self.merge(chunk)).tobytes()
            else:
                # A word with a comma is a word and a comma, and each of them is known, or will be.
                ids = b"".join([self.young.get(word) or self.unseen(word) for word in words])
        if len(chunk) <= CACHE_CHARS:
            if len(self.young) >= CACHE_WORDS:
                self.old, self.young = self.young, {}
            self.young[chunk] = ids
        return ids

    def encode(self, text: str) -> list[int]:
        out: list[bytes] = []
        for piece in self.cut.split(text):
            if piece in self.added:
                out.append(array("H", [self.added[piece]]).tobytes())
                continue
            # A capital sigma at a word's end is an ordinary sigma here: letters are lowered one by one.
            plain = unicodedata.normalize("NFC", piece).replace("Σ", "σ").lower()
            known = self.young.get
            # No match of the pattern holds a space, so what stands between spaces is split and merged alone.
            for chunk in plain.replace("\n", " ").split(" "):
                ids = known(chunk)
                if ids is None:
                    ids = self.unseen(chunk)
                    known = self.young.get
                out.append(ids)
        return array("H", b"".join(out)).tolist()

    def decode(self, ids: list[int]) -> str:
        return " ".join([self.tokens[i] for i in ids])


@lru_cache(maxsize=2)
def tokenizer(path: str) -> Tokenizer:
    """One per Python worker."""
    return Tokenizer(path)


DIGESTS = StructType([StructField("n_tokens", LongType()), StructField("ids_sha256", StringType()), StructField("decoded_sha256", StringType())])


def encode_decode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """One row per row of docs: id, n_tokens, ids_sha256 and decoded_sha256."""
    path = path or vocabulary_path()

    @F.pandas_udf(DIGESTS)
    def digests(texts: pd.Series) -> pd.DataFrame:
        own, rows = tokenizer(path), []
        for text in texts:
            ids = own.encode(text)
            rows.append((len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(own.decode(ids).encode()).hexdigest()))
        return pd.DataFrame(rows, columns=DIGESTS.names)

    return docs.select(F.col(id_col).alias("doc_id"), digests(whole(text_col)).alias("d")).select(F.col("doc_id").alias(id_col), "d.*")


def encode(docs: DataFrame, text_col: str = "text", path: str | None = None) -> DataFrame:
    """docs with token_ids; an own column of that name goes."""
    path = path or vocabulary_path()

    @F.pandas_udf("array<int>")
    def ids(texts: pd.Series) -> pd.Series:
        own = tokenizer(path)
        return pd.Series([own.encode(x) for x in texts], dtype=object)

    return docs.withColumn("token_ids", ids(whole(text_col)))


def decode(rows: DataFrame, ids_col: str = "token_ids", path: str | None = None) -> DataFrame:
    """rows with decoded, the text of their token ids; null ids decode as none."""
    path = path or vocabulary_path()

    @F.pandas_udf("string")
    def texts(lists: pd.Series) -> pd.Series:
        own = tokenizer(path)
        return pd.Series([own.decode([] if x is None else list(x)) for x in lists], dtype=object)

    return rows.withColumn("decoded", texts(F.col(ids_col)))
