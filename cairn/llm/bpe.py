"""BPE encoding and decoding (5): batched numpy merge rounds.

``encode`` turns whole texts into token ids with the merges of a public vocabulary file, ``decode`` turns ids back. The
different words of a step lie in one flat array of symbols. In each round every pair of neighbours looks up its rank by
binary search over the sorted pair keys ``left * n + right``; each word merges all places of its lowest pair, left to
right, and words without a known pair leave the array. Words of over ``LONG`` bytes, whose rounds would be many, are
merged together by rank instead: a round takes the lowest rank of all, merges its places and looks up the pairs that
are new, so that each symbol is touched as often as it changes. No Python code runs a symbol or a pair at a time.

Words beyond the Latin letters are normalised and cut by the library, all of a step in one text; merging stays here.

The files read here are of one kind: NFC, white space folded, small letters, pieces cut by a pattern that drops white
space, byte letters, an end-of-word suffix, no decoder (tokens are joined by spaces). Others raise ``ValueError``.

Edge cases: a null or empty text has no ids and decodes to the empty text; texts of any length are encoded whole; equal
texts have equal ids; a null ``doc_id`` passes through; an empty table gives an empty table; other columns are not read.
"""

from __future__ import annotations

import heapq
import json
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.llm import base
from cairn.llm.wordcache import WordCoder, by_pieces

NEVER = np.int64(1 << 40)
#: Bytes of a word beyond which it is merged by rank.
LONG = 1024
#: Characters that the library cuts at once.
CUT = 1 << 16


class Bpe:
    """The tables of a vocabulary file and the merge rounds over them."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        kinds = [n["type"] for n in (spec["normalizer"] or {}).get("normalizers", [])]
        if model["type"] != "BPE" or kinds != ["NFC", "Replace", "Lowercase"] or spec["decoder"] or not model["end_of_word_suffix"] or model["ignore_merges"]:
            raise ValueError("not a word-level BPE file")
        vocab, suffix = model["vocab"], model["end_of_word_suffix"]
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.special = re.compile("|".join(re.escape(t) for t in sorted(self.added, key=len, reverse=True)) or r"(?!)")
        from tokenizers import Tokenizer

        # words beyond the Latin letters are cut by the library, whose Unicode version counts; merging stays here
        self.library = Tokenizer.from_file(path)
        letters = base.byte_letters()
        self.byte_of = {ord(c): b for b, c in enumerate(letters)}
        self.inner = np.array([vocab[c] for c in letters], np.int64)
        self.final = np.array([vocab[c + suffix] for c in letters], np.int64)
        self.n = max(*vocab.values(), *self.added.values()) + 1
        merges = [(vocab[a], vocab[b], vocab[a + b]) for a, b in model["merges"]]
        left, right, made = (np.array(x, np.int64) for x in zip(*merges))
        key = left * self.n + right
        order = np.argsort(key, kind="stable")
        self.key, self.rank, self.made = key[order], order.astype(np.int64), made[order]
        self.by_rank = left, right, made
        # merging all places of a pair at once is the same as one by one if no token is used by an earlier merge than made it
        born = np.full(self.n, -1)
        np.maximum.at(born, made, np.arange(len(made)))
        used = np.minimum(np.arange(len(made)) - born[left], np.arange(len(made)) - born[right])
        self.ordered = bool((used > 0).all())
        names = {i: t for t, i in vocab.items()} | {i: t for t, i in self.added.items()}
        self.names = [names.get(i, "").encode() for i in range(self.n)]

    def merge(self, words: list[bytes]) -> list[np.ndarray]:
        """Ids of each non-empty word of UTF-8 bytes."""
        if not words:
            return []
        size = np.fromiter(map(len, words), np.int64, len(words))
        sym = self.inner[raw := np.frombuffer(b"".join(words), np.uint8)]
        last = np.cumsum(size) - 1
        sym[last] = self.final[raw[last]]
        word = np.repeat(np.arange(len(words)), size)
        # merging all places of a rank at once needs the vocabulary's order
        long = size[word] > (LONG if self.ordered else len(raw))
        parts = [self._by_round(sym[~long], word[~long]), self._by_rank(sym[long], word[long])]
        sym, word = (np.concatenate(x) for x in zip(*parts))
        order = np.argsort(word, kind="stable")
        return np.split(sym[order].astype("<u4"), np.cumsum(np.bincount(word, minlength=len(words)))[:-1])

    def _ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        pair = left * self.n + right
        at = np.searchsorted(self.key, pair)
        at[at == len(self.key)] = 0
        return np.where(self.key[at] == pair, self.rank[at], NEVER)

    def _by_round(self, sym: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Symbols and their words after all merges; each round merges the lowest pair of every word."""
        done_sym, done_word = [sym[:0]], [word[:0]]
        while len(sym):
            rank = np.append(np.where(word[1:] == word[:-1], self._ranks(sym[:-1], sym[1:]), NEVER), NEVER)
            heads = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
            low = np.repeat(np.minimum.reduceat(rank, heads), np.diff(np.append(heads, len(sym))))
            over = low == NEVER
            if over.any():
                done_sym.append(sym[over])
                done_word.append(word[over])
            pick = (rank == low) & ~over
            spots = np.flatnonzero(pick)
            if not self.ordered:
                spots = spots[np.append(True, word[spots[1:]] != word[spots[:-1]])] if len(spots) else spots
            elif len(spots):
                spots = spots[_alternate(np.diff(spots) == 1)]
            sym[spots] = self.by_rank[2][rank[spots]]
            keep = ~over
            keep[spots + 1] = False
            sym, word = sym[keep], word[keep]
        return np.concatenate(done_sym), np.concatenate(done_word)

    def _by_rank(self, sym: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The same; each round merges all places of the lowest pair of all words, which are a linked list."""
        n = len(sym)
        left, right, made = self.by_rank
        # place n stands behind the end: in no word, never merged
        sym, word, live = np.append(sym, -1), np.append(word, -1), np.append(np.ones(n, bool), False)
        after, before = np.minimum(np.arange(n + 1) + 1, n), np.arange(n + 1) - 1
        waiting: dict[int, list[np.ndarray]] = {}
        heap: list[int] = []

        def look(spots: np.ndarray) -> None:
            ends = after[spots]
            spots, ends = (x[word[spots] == word[ends]] for x in (spots, ends))
            rank = self._ranks(sym[spots], sym[ends])
            known = rank < NEVER
            spots, rank = spots[known], rank[known]
            order = np.argsort(rank, kind="stable")
            spots, rank = spots[order], rank[order]
            heads = np.flatnonzero(np.append(True, rank[1:] != rank[:-1])) if len(rank) else []
            for r, group in zip(rank[heads].tolist(), np.split(spots, heads[1:])) if len(rank) else ():
                if r not in waiting:
                    waiting[r] = []
                    heapq.heappush(heap, r)
                waiting[r].append(group)

        look(np.arange(n))
        while heap:
            r = heapq.heappop(heap)
            spots = np.unique(np.concatenate(waiting.pop(r)))
            ends = after[spots]
            spots = spots[live[spots] & (sym[spots] == left[r]) & (sym[ends] == right[r]) & (word[spots] == word[ends])]
            if not len(spots):
                continue
            spots = spots[_alternate(after[spots[:-1]] == spots[1:])]
            gone = after[spots]
            sym[spots] = made[r]
            live[gone] = False
            after[spots] = after[gone]
            before[after[gone]] = spots
            ahead = before[spots]
            look(np.unique(np.concatenate([spots, ahead[ahead >= 0]])))
        return sym[live], word[live]

    def encode_pieces(self, pieces: list[str]) -> list[bytes]:
        return [x.tobytes() for x in self.merge([p.encode() for p in pieces])]

    def cut(self, text: str) -> tuple[str, list[bytes], np.ndarray]:
        """The normal form of a text without special tokens, its pieces and where they start in it."""
        normal = self.library.normalizer.normalize_str(text)
        found = self.library.pre_tokenizer.pre_tokenize_str(normal)
        return normal, [p.translate(self.byte_of).encode("latin-1") for p, _ in found], np.array([a for _, (a, _) in found], np.int64)

    def encode_words(self, words: list[str]) -> list[bytes]:
        """Ids of words of any script, special tokens included; the pieces of all are merged together."""
        owner, pieces, fixed = [], [], []  # a piece, or the id of a special token

        def alone(i: int) -> None:
            at = 0
            for m in [*self.special.finditer(words[i]), None]:
                part = words[i][at : m.start() if m else len(words[i])]
                found = self.cut(part)[1] if part else []
                pieces.extend(found)
                owner.append(np.full(len(found), i))
                fixed.append(np.full(len(found), -1))
                if m:
                    pieces.append(b"")
                    owner.append(np.array([i]))
                    fixed.append(np.array([self.added[m.group()]]))
                    at = m.end()

        def together(run: list[int]) -> None:
            normal, found, starts = self.cut(" ".join([words[i] for i in run]))
            spaces = np.flatnonzero(np.frombuffer(normal.encode("utf-32-le"), "<u4") == 32)
            if len(spaces) != len(run) - 1:
                for i in run:
                    alone(i)
                return
            pieces.extend(found)
            owner.append(np.array(run)[np.searchsorted(spaces, starts)])
            fixed.append(np.full(len(found), -1))

        run, size = [], 0
        for i, w in enumerate(words):
            if self.special.search(w) or w.split() != [w]:
                alone(i)
                continue
            run.append(i)
            size += len(w)
            if size > CUT:
                together(run)
                run, size = [], 0
        if run:
            together(run)
        if not pieces:
            return [b""] * len(words)
        owner, fixed = np.concatenate(owner), np.concatenate(fixed)
        merged = iter(self.merge([p for p in pieces if p]))
        coded = [next(merged) if p else np.array([f], "<u4") for p, f in zip(pieces, fixed.tolist())]
        order = np.argsort(owner, kind="stable")
        flat = np.concatenate([coded[k] for k in order.tolist()]).astype("<u4").tobytes()
        ends = np.cumsum(np.bincount(owner, np.fromiter(map(len, coded), np.int64, len(coded)), len(words))).astype(np.int64) * 4
        return [flat[a:b] for a, b in zip([0, *ends[:-1].tolist()], ends.tolist())]

    def encode_text(self, text: str) -> bytes:
        """Ids of any text, special tokens and other scripts included."""
        return self.encode_words([text])[0]

    def decode(self, ids: np.ndarray) -> bytes:
        return b" ".join(map(self.names.__getitem__, ids.tolist()))


def _alternate(touch: np.ndarray) -> np.ndarray:
    """Of places in order the first, third, ... of each run; ``touch`` says which go on the run before them."""
    head = np.append(True, ~touch)
    index = np.arange(len(head))
    return (index - np.maximum.accumulate(np.where(head, index, 0))) % 2 == 0


_CODERS: dict[str, tuple[Bpe, WordCoder]] = {}


def coder(vocab: str) -> tuple[Bpe, WordCoder]:
    """Tables and word cache of a file; one of each a Python worker, kept between tasks."""
    if vocab not in _CODERS:
        bpe = Bpe(vocab)
        # a worker lives on between tasks and stages, so what it keeps is small
        _CODERS[vocab] = bpe, WordCoder(by_pieces(bpe.encode_pieces, bpe.encode_words), most=100_000)
    return _CODERS[vocab]


def encode(docs: DataFrame, vocab: str) -> DataFrame:
    """(doc_id, ids) of every whole text; ids as little-endian unsigned 32-bit integers."""

    def run(batches):
        _, words = coder(vocab)
        for batch in base.text_steps(batches):
            ids, o = words.column(batch.column("text"))
            offsets = pa.py_buffer((o * 4).astype(np.int32))
            column = pa.Array.from_buffers(pa.binary(), len(o) - 1, [None, offsets, pa.py_buffer(ids.astype("<u4"))])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), column], ["doc_id", "ids"])

    return base.columns(docs, "doc_id", text="text").mapInArrow(run, "doc_id long, ids binary")


def decode(encoded: DataFrame, vocab: str) -> DataFrame:
    """``encoded`` (doc_id, ids) with the decoded text beside them."""

    def run(batches):
        bpe, _ = coder(vocab)
        for batch in batches:
            ids = batch.column("ids")
            sizes = np.diff(base.flat(ids)[1])
            start = 0
            while start < len(ids):
                room = np.cumsum(sizes[start:])
                stop = start + max(1, int(np.searchsorted(room, 2 * base.STEP_BYTES, side="right")))
                part = batch.slice(start, stop - start)
                texts = [bpe.decode(np.frombuffer(b.as_buffer(), "<u4")) if b.is_valid else None for b in part.column("ids")]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(texts, pa.binary()).cast(pa.string())], ["doc_id", "ids", "text"])
                start = stop

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, ids binary, text string")


def round_trip(docs: DataFrame, vocab: str) -> DataFrame:
    """(doc_id, ids, text): every whole text encoded, and decoded from its ids; both in one pass by one worker a task."""

    def run(batches):
        bpe, words = coder(vocab)
        for batch in base.text_steps(batches, base.STEP_BYTES // 4):
            ids, o = words.column(batch.column("text"))
            codes = ids.astype("<u4")
            parts = [codes[a:b] for a, b in zip(o[:-1].tolist(), o[1:].tolist())]
            texts = pa.array([bpe.decode(x) for x in parts], pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array([x.tobytes() for x in parts], pa.binary()), texts], ["doc_id", "ids", "text"])

    return base.columns(docs, "doc_id", text="text").mapInArrow(run, "doc_id long, ids binary, text string")


def op5_bpe_codec(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    vocab = public_tokenizers.path("word_bpe_49k.json")
    out = round_trip(spark.read.parquet(f"{sf_dir}/documents.parquet"), vocab)
    return out.select("doc_id", F.expr("cast(octet_length(ids) div 4 as bigint)").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.encode("text", "UTF-8"), 256).alias("decoded_sha256"))
