"""Subword lattice likelihood: the probability of a text over all its segmentations.

The unigram vocabulary is the pieces of an existing subword vocabulary, inner and final ones, and
the training words as pieces of their own. A text is its words and one end; a word is one word
piece, or any sequence of inner pieces and a final piece that spell it. Its marginal probability
sums over all segmentations, by the forward recursion in log space. Word pieces are scored by
their counts less a discount; the discounted mass goes to spelled words, whose pieces are scored
by the segmentations of the training words, each counted once, since new words resemble the
list of words rather than running text. All probabilities sum to one over all texts.

Work is done once per distinct word, not per token: words are counted with partial sums, each
distinct word's lattice is summed once, and documents meet the word table. Frequent words (a
share of more than 1/``HEAD`` of all tokens, so fewer than ``HEAD`` words) are sent to the tasks;
the others are joined.
"""

from __future__ import annotations

import json
import math
from collections import Counter
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodeline.llm.common import byte_alphabet, bytes_words, crc_mod, map_arrow
from lodeline.session import stored

HEAD = 200_000
HEAD_BYTES = 64
FLUSH = 100_000
DOCS_AT_ONCE = 500
FINAL = "Ā"  # stands for the end of a word; the other characters of a lattice are bytes
MARK = "</w>"

_state: dict = {}


class Pieces:
    """The pieces of a vocabulary file and the segmentation of whole words that its merges give."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        special = {t["id"] for t in spec["added_tokens"]}
        self.tokenizer = Tokenizer.from_file(path)
        self.merge = self.tokenizer.model.tokenize
        back = byte_alphabet()
        self.stand_in = {ord(byte): char for char, byte in back.items()}
        self.spelled: dict[int, str] = {}
        for piece, i in spec["model"]["vocab"].items():
            if i not in special:
                body = piece.removesuffix(MARK)
                self.spelled[i] = "".join(back[c] for c in body) + (FINAL if piece != body else "")
        self.size = max(self.spelled) + 1

    def count(self, words: Iterable[bytes], out: np.ndarray) -> None:
        """Add how often each piece occurs in words, each taken once."""
        for w in words:
            for t in self.merge(w.decode("latin-1").translate(self.stand_in)):
                out[t.id] += 1


def pieces_of(path: str) -> Pieces:
    if path not in _state:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        _state[path] = Pieces(path)
    return _state[path]


class Lattice:
    """Log probabilities of words: all pieces that match at any place, summed forward."""

    def __init__(self, pieces: Pieces, log_p: np.ndarray):
        import ahocorasick

        self.find = ahocorasick.Automaton()
        for i, s in pieces.spelled.items():
            self.find.add_word(s, (len(s), float(log_p[i])))
        self.find.make_automaton()

    def log_prob(self, word: bytes) -> float:
        s = word.decode("latin-1") + FINAL
        none = -math.inf
        alpha = [none] * (len(s) + 1)
        alpha[0] = 0.0
        log1p, exp = math.log1p, math.exp
        for end, (length, lp) in self.find.iter(s):
            new = alpha[end + 1 - length] + lp
            old = alpha[end + 1]
            if old == none:
                alpha[end + 1] = new
            elif new > old:
                alpha[end + 1] = new + log1p(exp(old - new))
            else:
                alpha[end + 1] = old + log1p(exp(new - old))
        return alpha[-1]


def _lattice(path: str, log_p: bytes) -> Lattice:
    key = (path, hash(log_p))
    if _state.get("lattice_key") != key:
        _state["lattice"], _state["lattice_key"] = Lattice(pieces_of(path), np.frombuffer(log_p)), key
    return _state["lattice"]


def word_counts(docs: DataFrame, train: str = "train") -> DataFrame:
    """(word, c): every word of ``docs`` (text, train) and how often training texts have it; zero for others."""

    def run(parts):
        seen: Counter = Counter()

        def flush():
            if seen:
                words, counts = list(seen), list(seen.values())
                seen.clear()
                yield pa.RecordBatch.from_arrays([pa.array(words, pa.binary()), pa.array(counts, pa.int64())], ["word", "c"])

        for part in parts:
            for text, learn in zip(part["text"].to_pylist(), part[train].to_pylist()):
                words = bytes_words(text)
                seen.update(words if learn else dict.fromkeys(words, 0))
                if len(seen) > FLUSH:
                    yield from flush()
        yield from flush()

    return docs.select("text", train).mapInArrow(run, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c"))


def piece_log_probs(words: DataFrame, vocabulary: str, smooth: float = 0.5) -> np.ndarray:
    """Natural log of each piece's share among the pieces of all training words, each word taken once."""

    def run(parts):
        pieces = pieces_of(vocabulary)
        total = np.zeros(pieces.size, np.int64)
        for part in parts:
            pieces.count((w for w, c in zip(part["word"].to_pylist(), part["c"].to_pylist()) if c), total)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at], pa.int64())], ["piece", "n"])

    counted = words.mapInArrow(run, "piece long, n long").groupBy("piece").agg(F.sum("n").alias("n"))
    pieces = pieces_of(vocabulary)
    counts = np.zeros(pieces.size)
    for r in counted.collect():  # a row for each piece of the vocabulary at most
        counts[r["piece"]] = r["n"]
    used = np.zeros(len(counts), bool)
    used[[*pieces.spelled]] = True
    return np.where(used, np.log((counts + smooth) / (counts[used].sum() + smooth * used.sum())), -np.inf)


def word_model(n_words: int, n_types: int, once: int, twice: int, ends: int):
    """(log probability of an end, function of a word's count and spelled log probability).

    The discount is the usual estimate from the words seen once and twice.
    """
    end = (ends + 0.5) / (n_words + ends + 1)
    discount = min(0.95, max(0.1, once / (once + 2 * twice))) if once else 0.5
    spelled_share = math.log(discount * n_types / n_words) if n_words else 0.0
    go_on = math.log1p(-end)

    def log_p(c: int, spelled: float) -> float:
        low = spelled_share + spelled
        if not c:
            return go_on + low
        high = math.log((c - discount) / n_words)
        return go_on + max(low, high) + math.log1p(math.exp(-abs(high - low)))

    return math.log(end), log_p


def lattice_scores(docs: DataFrame, vocabulary: str, folds: int = 5, held: int = 1) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Documents whose crc32(doc_id as text) modulo ``folds`` is ``held`` are held out; the others are
    learned from. A null doc_id is held out. A null or empty text is one end. ``base_score`` is the
    word unigram with add-a-half counts; ``score`` is the log10 marginal probability of the lattice.
    Repeated rows are scored each. Without training rows every word is spelled.
    """
    spark = docs.sparkSession
    keyed = docs.select(
        F.monotonically_increasing_id().alias("row"),
        F.col("doc_id").cast("long").alias("doc_id"),
        "text",
        F.coalesce(crc_mod("doc_id", folds) != held, F.lit(False)).alias("train"),
    )
    words = stored(word_counts(keyed), "words")
    ends = keyed.where("train").count()
    c = F.col("c")
    sums = words.agg(F.sum(c).alias("n"), F.count_if(c > 0).alias("v"), F.count_if(c == 1).alias("n1"), F.count_if(c == 2).alias("n2")).first()
    n_words = sums["n"] or 0
    n, v = n_words + ends, sums["v"] + (ends > 0)
    sent_p = spark.sparkContext.broadcast(piece_log_probs(words, vocabulary).tobytes())
    counted = (n_words, sums["v"], sums["n1"], sums["n2"], ends)

    def sum_lattice(part: pa.RecordBatch):
        lattice, (_, log_p), ten = _lattice(vocabulary, sent_p.value), word_model(*counted), math.log(10)
        score = [log_p(c, lattice.log_prob(w)) / ten for w, c in zip(part["word"].to_pylist(), part["c"].to_pylist())]
        yield pa.RecordBatch.from_arrays([part["word"], part["c"], pa.array(score, pa.float64())], ["word", "c", "lp"])

    scored = stored(map_arrow(words, sum_lattice, "word binary, c long, lp double"), "scored-words")
    short = F.length("word") <= HEAD_BYTES
    often = (F.col("c") * HEAD > n) & short
    head = {bytes(r["word"]): (r["c"], r["lp"]) for r in scored.where(often).collect()}
    norm = n + 0.5 * (v + 1)
    base = lambda c: math.log10((c + 0.5) / norm)
    end = (1 if ends else 0, base(ends), word_model(*counted)[0] / math.log(10))
    sent = spark.sparkContext.broadcast({w: (base(c), lp) for w, (c, lp) in head.items()})

    def run(part: pa.RecordBatch):
        known = sent.value
        types = {"word": pa.binary(), "base": pa.float64(), "score": pa.float64()}
        for lo in range(0, part.num_rows, DOCS_AT_ONCE):
            cols: dict[str, list] = {c: [] for c in ("row", "word", "tf", "doc_id", "n_tokens", "n_known", "base", "score")}
            add = [x.append for x in cols.values()]
            few = part.slice(lo, DOCS_AT_ONCE)
            for row, doc, text in zip(*(few[c].to_pylist() for c in ("row", "doc_id", "text"))):
                words = bytes_words(text)
                n_known, b, s = end
                for w, tf in Counter(words).items():
                    at = known.get(w)
                    if at is None:
                        for put, x in zip(add, (row, w, tf, None, None, None, None, None)):
                            put(x)
                    else:
                        n_known += tf
                        b += tf * at[0]
                        s += tf * at[1]
                # What the sent words gave; this key is no word, as words hold no blanks, and no hot key.
                for put, x in zip(add, (row, b" %d" % row, 0, doc, len(words) + 1, n_known, b, s)):
                    put(x)
            yield pa.RecordBatch.from_arrays([pa.array(x, types.get(c, pa.int64())) for c, x in cols.items()], list(cols))

    ddl = "row long, word binary, tf long, doc_id long, n_tokens long, n_known long, base double, score double"
    tokens = map_arrow(keyed.select("row", "doc_id", "text"), run, ddl)
    rest = scored.where(~often | F.col("c").isNull())
    part_base = F.col("tf") * F.log10((F.col("c") + 0.5) / F.lit(float(norm)))
    joined = tokens.join(rest, "word", "left").select(
        "row", "doc_id", "n_tokens",
        F.coalesce("n_known", F.when(F.col("c") > 0, F.col("tf")).otherwise(0)).alias("n_known"),
        F.coalesce("base", part_base).alias("base"),
        F.coalesce("score", F.col("tf") * F.col("lp")).alias("score"),
    )
    each = joined.groupBy("row").agg(
        F.max("doc_id").alias("doc_id"),
        F.max("n_tokens").alias("n_tokens"),
        F.sum("n_known").alias("n_known"),
        F.sum("base").alias("base_score"),
        F.sum("score").alias("score"),
    )
    return each.select(
        "doc_id",
        F.coalesce(crc_mod("doc_id", folds) == held, F.lit(True)).alias("held_out"),
        "n_tokens",
        "n_known",
        F.lit(n).cast("long").alias("train_tokens"),
        "base_score",
        "score",
    )
