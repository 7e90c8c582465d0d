"""Packing of tokenised documents into fixed-length sequences.

Documents are dealt at random (by a hash) to groups of about GROUP documents and no more than about GROUP_BYTES
of text; each group is packed by itself. A document that is there more than COPIES times is dealt copy by copy. A document is cut at multiples of the sequence length; whole sequences stand
alone, and the rests go, longest first, into the first sequence with room. That sequence is found
in a tournament tree whose leaves are the remaining capacities and whose inner nodes hold the
larger of their two.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import parts_for, table, text_key

LENGTH, GROUP, GROUP_BYTES, COPIES = 2048, 2048, 1 << 24, 64
#: Entries of a worker's cache of tokenised words and pieces, more than a usual group has (some 250,000, or 50 MB). It's
#: emptied after each group, so that an idle worker holds nothing.
CACHE = 400_000
#: Characters for which lower case, white space, letters and digits mean the same to Python and to the tokenizer.
_PLAIN = re.compile("[\t\n\r -~\u00a1-\u00b1\u00b4-\u00b8\u00ba\u00bb\u00bf-\u012f\u0131-\u024f]*").fullmatch
#: The bytes of Latin-1 that aren't in it.
_NOT_PLAIN = bytes(i for i in range(256) if not _PLAIN(chr(i)))

#: From 0 to 31 ids to their bytes.
_PACKS = [struct.Struct(f"<{n}I").pack for n in range(32)]

PIECES = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"


def is_plain(text: str) -> bool:
    try:
        return not _has_others(text.encode("latin-1"))
    except UnicodeEncodeError:
        return _PLAIN(text) is not None


def _has_others(data: bytes) -> bool:
    return len(data.translate(None, _NOT_PLAIN)) < len(data)


class WordCache:
    """Token ids of whole texts, as little-endian unsigned 32-bit numbers.

    The tokenizer normalises to lower case, cuts a text at white space and each word into pieces by a
    pattern, and merges the bytes of every piece by itself. Words and pieces recur, so their ids are kept
    (a piece is also the only piece of the word that it is).
    Texts with characters outside _PLAIN, or with a special token's string, go to the tokenizer
    whole, as do all texts if the file's steps are others than these.
    """

    def __init__(self, path: str) -> None:
        import json

        from tokenizers import Tokenizer, pre_tokenizers

        self.of = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.special = [t["content"] for t in spec["added_tokens"]]
        self.words: dict[str, bytes] = {}
        bytes_as, self.as_char = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False), {}
        for code in (*range(0x80, 0x800), *range(0x800, 0xD800, 0x800), 0xE000, 0xF000):  # these have every byte of such words; ASCII stays
            self.as_char.update(zip(chr(code).encode(), bytes_as.pre_tokenize_str(chr(code))[0][0], strict=True))
        normal = [x["type"] for x in (spec.get("normalizer") or {}).get("normalizers", [])]
        cuts = (spec.get("pre_tokenizer") or {}).get("pretokenizers", [])
        self.by_word = (
            normal == ["NFC", "Replace", "Lowercase"] and [x["type"] for x in cuts] == ["Split", "ByteLevel"] and cuts[0]["behavior"] == "Removed"
            and not cuts[1]["use_regex"] and not cuts[1]["add_prefix_space"] and not spec.get("post_processor")
        )
        if self.by_word:
            # the same pattern in Python's terms, over _PLAIN characters
            pattern = cuts[0]["pattern"]["Regex"]
            for theirs, ours in (("[^\\s\\p{L}\\p{N}]+", "(?:[^\\w\\s]|_)+"), ("[\\p{L}]+", "[^\\W\\d_]+"), ("[\\p{N}]", "\\d")):
                pattern = pattern.replace(theirs, ours)
            self.by_word, self.cut = "\\p" not in pattern, re.compile(pattern).findall

    def _piece(self, piece: str) -> bytes:
        mapped = piece if piece.isascii() else piece.encode().decode("latin-1").translate(self.as_char)
        ids = [t.id for t in self.of.model.tokenize(mapped)]
        return _PACKS[len(ids)](*ids) if len(ids) < len(_PACKS) else struct.pack(f"<{len(ids)}I", *ids)

    def _word(self, word: str) -> bytes:
        if word.isalpha():
            return self._piece(word)
        known, out = self.words, []
        for piece in self.cut(word):
            ids = known.get(piece)
            if ids is None:
                ids = known[piece] = self._piece(piece)
            out.append(ids)
        return b"".join(out)

    def encode(self, text: str) -> bytes:
        if not self.by_word or not is_plain(text) or any(s in text for s in self.special):
            return np.array(self.of.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        words, known = text.lower().split(), self.words
        try:
            return b"".join([known[w] for w in words])
        except KeyError:
            pass
        if len(known) > CACHE:
            self.forget()
        for w in words:
            if w not in known:
                known[w] = self._word(w)
        return b"".join([known[w] for w in words])


    __call__ = encode

    def forget(self) -> None:
        self.words.clear()


_caches: dict[str, WordCache] = {}


def word_cache(path: str) -> WordCache:
    """The worker's own encoder; the vocabulary is loaded once for all its tasks."""
    if path not in _caches:
        _caches[path] = WordCache(path)
    return _caches[path]


def first_fit(sizes: list[int], capacity: int) -> tuple[list[int], list[int]]:
    """Bin and offset of each size (decreasing), each in the first bin with room."""
    leaves = 1
    while leaves < len(sizes):
        leaves *= 2
    room = [capacity] * (2 * leaves)  # a bin that nothing is in yet has all its capacity
    bins, offsets = [], []
    for size in sizes:
        at = 1
        while at < leaves:
            at *= 2
            if room[at] < size:
                at += 1
        bins.append(at - leaves)
        offsets.append(capacity - room[at])
        room[at] -= size
        while at > 1:
            at //= 2
            room[at] = max(room[2 * at], room[2 * at + 1])
    return bins, offsets


def pack(docs: DataFrame, encoder: Callable[[], Callable[[str], bytes]], end_id: int = 1, length: int = LENGTH, group: int = GROUP, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each piece: doc_id, start, length, ids (binary), doc_tokens, sequence_id, offset.

    encoder() gives, on the worker, the function from a text to its ids as little-endian unsigned
    32-bit numbers (its forget(), if it has one, is called after a group); end_id follows each document. A null text counts as empty: end_id alone. Repeated
    rows are packed as often as they occur. Equal lengths are taken in the order of doc_id. An empty
    table gives no rows. Sequences are not padded here: the ids after the last offset are free. Only the id and
    the text are read: other columns, whatever their names, play no part.
    """
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    counts = docs.groupBy("doc_id", F.octet_length("text").alias("size")).agg(F.count(F.lit(1)).alias("copies"))  # of no fewer rows than are equal
    n, size, most = counts.agg(F.sum("copies"), F.sum(F.col("copies") * F.coalesce("size", F.lit(0))), F.max("copies")).first()
    n = n or 0
    groups = max(1, -(-n // group), -(-(size or 0) // GROUP_BYTES))
    end = np.array([end_id], "<u4").tobytes()

    def packed(g: pd.DataFrame) -> pd.DataFrame:
        encode = encoder()
        g = g.sort_values(["doc_id", "text"], kind="stable", na_position="first")
        ids = [(encode(t) if t is not None else b"") + end for t in g["text"]]
        getattr(encode, "forget", int)()
        whole = [len(x) // 4 for x in ids]
        pieces = [(d, at, min(length, n - at)) for d, n in enumerate(whole) for at in range(0, n, length)]
        full = [p for p in pieces if p[2] == length]
        rest = sorted((p for p in pieces if p[2] < length), key=lambda p: -p[2])
        bins, offsets = first_fit([p[2] for p in rest], length)
        base = int(g["group"].iloc[0]) << 32
        placed = [(p, base + i, 0) for i, p in enumerate(full)]
        placed += [(p, base + len(full) + b, o) for p, b, o in zip(rest, bins, offsets, strict=True)]
        doc = [p[0] for p, _, _ in placed]
        return pd.DataFrame({
            "doc_id": g["doc_id"].iloc[doc].to_numpy(), "start": [p[1] for p, _, _ in placed], "length": [p[2] for p, _, _ in placed],
            "ids": [ids[p[0]][4 * p[1] : 4 * (p[1] + p[2])] for p, _, _ in placed], "doc_tokens": [whole[d] for d in doc],
            "sequence_id": [s for _, s, _ in placed], "offset": [o for _, _, o in placed],
        })

    rows = docs.withColumn("copy", F.lit(0).cast("long"))
    if (most or 0) > COPIES:  # one row of each such document, and as many copies of it as there are, each with a number
        many = docs.groupBy("doc_id", text_key(F.col("text")).alias("key")).agg(F.count(F.lit(1)).alias("copies")).filter(F.col("copies") > COPIES)
        alike = (F.col("r.doc_id").eqNullSafe(F.col("m.doc_id"))) & (F.col("r.key") == F.col("m.key"))
        keyed = rows.withColumn("key", text_key(F.col("text"))).alias("r")
        once = keyed.join(many.alias("m"), alike).groupBy("r.doc_id", "r.key").agg(F.first("r.text").alias("text"), F.first("m.copies").alias("copies"))
        dealt_out = once.select("doc_id", "text", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))).alias("copy"))
        rows = keyed.join(many.alias("m"), alike, "left_anti").select("doc_id", "text", "copy").unionByName(dealt_out)
    dealt = rows.withColumn("group", F.pmod(F.xxhash64("doc_id", F.length("text"), "copy"), F.lit(groups))).drop("copy")
    parts = parts_for(groups, 2, docs.sparkSession)
    return dealt.repartition(parts, "group").groupBy("group").applyInPandas(packed, PIECES)


def padded_to(used: int, length: int = LENGTH) -> int:
    """Stored length of a sequence: as it is at a power of two, else the full length."""
    return used if used and used & (used - 1) == 0 else length


def public_encoder(file: str = "word_bpe_49k.json") -> Callable[[], Callable[[str], bytes]]:
    def load() -> Callable[[str], bytes]:
        import public_tokenizers

        return word_cache(public_tokenizers.path(file))

    return load


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = pack(table(spark, sf_dir, "documents"), public_encoder())
    return pieces.select("doc_id", "start", "length", F.crc32("ids").cast("long").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
