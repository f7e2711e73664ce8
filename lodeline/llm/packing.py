"""Best-fit packing of token sequences: bounded-space online best fit.

Documents are tokenised where they are read. Only the lengths of their pieces are shuffled, into
groups of bounded size; each group is packed in one task, in the order of the input, with a fixed
small number of open bins. The open bins stand in lists by their free space, and the bits of one integer tell which lists are not
empty: the lowest set bit from a piece's length on is the best fit. When one bin too many is
open, the fullest closes.
"""

from __future__ import annotations

import re
import unicodedata
import zlib
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodeline.llm.common import byte_alphabet, map_arrow
from lodeline.session import stored

END_ID = 0
GROUP_TOKENS = 1 << 23
GROUP_PIECES = 500_000
OPEN_BINS = 256
CACHE_WORDS = 800_000
LONG_WORD = 64

# Text may be cut at ASCII white space without changing its tokens: the tokenizer drops white
# space, and neither its pattern nor its normal form joins what white space parts.
_chunks = re.compile(r"[^ \t\n\r\f\v]+").findall

# Texts of characters below U+0180 are their own normal form and fall into words by a fixed
# pattern, so their lower-cased words can be looked up. Other texts, and those with a character
# that lower-cases to two or with the mark of a special token, are given to the tokenizer.
SIMPLE = 0x180
_special = re.compile(f"[^\\x00-{chr(SIMPLE - 1)}]|\u0130|<\\|").search


def _class(kind: str) -> str:
    return "".join(re.escape(chr(i)) for i in range(SIMPLE) if unicodedata.category(chr(i))[0] == kind)


# The tokenizer's own pattern of words.
_words = re.compile(
    rf"'s|'t|'re|'ve|'m|'ll|'d|[{_class('L')}]+|[{_class('N')}]|[^ \t\n\r\f\v\x85\xa0{_class('L')}{_class('N')}]+"
).findall
_state: dict = {}


class _Encoder:
    """Ids of texts as little-endian 32-bit bytes, with a bounded cache of short words."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer, self.cache = Tokenizer.from_file(path), {}
        self.merge = self.tokenizer.model.tokenize
        self.stand_in = {ord(byte): char for char, byte in byte_alphabet().items()}

    def _chunk_ids(self, chunks: list[str]) -> list[bytes]:
        return [array("I", e.ids).tobytes() for e in self.tokenizer.encode_batch_fast(chunks, add_special_tokens=False)]

    def _word_ids(self, word: str) -> bytes:
        """A word that is in normal form, lower case and one match of the pattern needs the merges alone."""
        return array("I", [t.id for t in self.merge(word.encode().decode("latin-1").translate(self.stand_in))]).tobytes()

    def encode(self, texts: list[str | None]) -> list[bytes]:
        cache, parts, chunks, words = self.cache, [], set(), set()
        if len(cache) > CACHE_WORDS:
            cache.clear()
        for t in texts:
            odd = t and _special(t)
            parts.append([] if not t else _chunks(t) if odd else _words(t.lower()))
            (chunks if odd else words).update(parts[-1])
        new = [*(w for w in words if w not in cache), *(w for w in chunks - words if w not in cache)]
        cache.update((w, self._word_ids(w)) for w in words if w not in cache)
        chunks = [w for w in chunks if w not in cache]
        cache.update(zip(chunks, self._chunk_ids(chunks)))
        out = [b"".join(map(cache.__getitem__, ws)) for ws in parts]
        for w in new:
            if len(w) > LONG_WORD:
                del cache[w]
        return out


def _encoder(path: str) -> _Encoder:
    if path not in _state:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        _state[path] = _Encoder(path)
    return _state[path]


def token_pieces(docs: DataFrame, tokenizer: str, size: int = 2048, keep_ids: bool = False) -> DataFrame:
    """(row, doc_id, piece, start, length, ids_crc32[, ids]) of ``docs`` (doc_id, text).

    A document is its ids and one end id; longer ones are cut into pieces of ``size``. A null or
    empty text is the end id alone. ``row`` numbers the rows, so repeated doc_ids stay apart.
    ``tokenizer`` is the path of a vocabulary file that every machine has.
    """
    end = np.array([END_ID], "<u4").tobytes()

    def run(part: pa.RecordBatch):
        cols: dict[str, list] = {c: [] for c in ("row", "doc_id", "piece", "start", "length", "ids_crc32", "ids")}
        rows, docs_, texts = (part[c].to_pylist() for c in ("row", "doc_id", "text"))
        for lo in range(0, len(texts), 256):
            ids_of = _encoder(tokenizer).encode(texts[lo : lo + 256])
            for row, doc, ids in zip(rows[lo:], docs_[lo:], ids_of):
                ids += end
                for piece, at in enumerate(range(0, len(ids), 4 * size)):
                    cut = ids[at : at + 4 * size]
                    for c, v in zip(cols, (row, doc, piece, at // 4, len(cut) // 4, zlib.crc32(cut), cut)):
                        cols[c].append(v)
        if not keep_ids:
            del cols["ids"]
        types = {"piece": pa.int32(), "ids": pa.binary()}
        yield pa.RecordBatch.from_arrays([pa.array(v, types.get(c, pa.int64())) for c, v in cols.items()], list(cols))

    ddl = "row long, doc_id long, piece int, start long, length long, ids_crc32 long" + (", ids binary" if keep_ids else "")
    keyed = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    return map_arrow(keyed, run, ddl)


def best_fit(lengths, size: int, open_bins: int) -> tuple[list[int], list[int]]:
    """(bin, offset) of each length, in order of arrival; bins are numbered from 0."""
    bins, offsets = [], []
    by_free: list[list[int]] = [[] for _ in range(size + 1)]
    free_bits, n_open, n_bins = 0, 0, 0
    for length in lengths:
        if length >= size:
            bins.append(n_bins)
            offsets.append(0)
            n_bins += 1
            continue
        fit = free_bits >> length
        if fit:
            free = length + (fit & -fit).bit_length() - 1
            here = by_free[free].pop()
            if not by_free[free]:
                free_bits &= ~(1 << free)
            n_open -= 1
        else:
            here, free = n_bins, size
            n_bins += 1
        bins.append(here)
        offsets.append(size - free)
        if free - length:
            by_free[free - length].append(here)
            free_bits |= 1 << (free - length)
            n_open += 1
        if n_open > open_bins:
            fullest = (free_bits & -free_bits).bit_length() - 1
            by_free[fullest].pop()
            if not by_free[fullest]:
                free_bits &= ~(1 << fullest)
            n_open -= 1
    return bins, offsets


def pack(pieces: DataFrame, size: int = 2048, open_bins: int = OPEN_BINS, group_tokens: int = GROUP_TOKENS) -> DataFrame:
    """Stored ``pieces`` with their ``sequence_id`` and ``offset``.

    The pieces are dealt by hash into groups of about ``group_tokens`` tokens and at most about
    ``GROUP_PIECES`` pieces, so one task never holds more. Within a group they arrive in the order of
    the input, and at most ``open_bins`` sequences are open. Groups only serve to pack in parallel. The
    order is fixed by the pieces, so a task that runs again packs alike.
    """
    tokens, n = pieces.agg(F.sum("length"), F.count("*")).first()
    groups = max(1, -(-(tokens or 0) // group_tokens), -(-n // GROUP_PIECES))
    order = F.xxhash64("row", "piece", "length")
    slim = pieces.select("row", "piece", "length", F.pmod(order, F.lit(groups)).alias("g"))

    def run(key, rows):
        rows = rows.sort_values(["row", "piece"])
        bins, offsets = best_fit(rows["length"].tolist(), size, open_bins)
        rows["sequence_id"] = np.array(bins, np.int64) * groups + int(key[0])
        rows["offset"] = np.array(offsets, np.int64)
        return rows[["row", "piece", "sequence_id", "offset"]]

    placed = slim.groupBy("g").applyInPandas(run, "row long, piece int, sequence_id long, offset long")
    return pieces.join(placed, ["row", "piece"])


def pack_documents(docs: DataFrame, tokenizer: str, size: int = 2048, open_bins: int = OPEN_BINS) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset): each piece's place."""
    pieces = stored(token_pieces(docs, tokenizer, size), "pieces")
    return pack(pieces, size, open_bins).drop("row")


def sequences(docs: DataFrame, tokenizer: str, size: int = 2048, open_bins: int = OPEN_BINS) -> DataFrame:
    """(sequence_id, ids, n_pieces): the packed sequences, ids as little-endian 32-bit bytes."""
    pieces = stored(token_pieces(docs, tokenizer, size, keep_ids=True), "pieces")
    placed = pack(pieces.drop("ids"), size, open_bins).select("row", "piece", "sequence_id", "offset")
    whole = pieces.select("row", "piece", "ids").join(placed, ["row", "piece"])
    inside = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    joined = F.aggregate(inside, F.lit(b""), lambda acc, x: F.concat(acc, x["ids"]))
    return whole.groupBy("sequence_id").agg(joined.alias("ids"), F.count("*").alias("n_pieces"))
