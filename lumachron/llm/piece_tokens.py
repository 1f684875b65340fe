"""SentencePiece BPE encoding by vectorised merge rounds, and decoding by table lookup.

Texts are cut between two characters that stand next to each other in no piece of the vocabulary (so before each word
mark), since no merge can cross there. The distinct new words so made are held as one flat array of symbols. Each
round takes, for every word at once, the least rank of its pairs, merges all pairs of that rank, leftmost first where they overlap,
and compacts; words without a pair leave. A merge may make a pair that comes before the others of the round (as a piece may be older
than a part of it): merges of a word end with the first that does, so the order is that of sequential merging, in words of any length.

Ids are those of the model; characters outside it become byte pieces. Null and empty texts give no ids. Other columns
are kept; one that has the name of the new column is replaced. Decoding drops the mark that encoding puts in front.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .words import binary_array, flat_text, gather_ranges, slices

MARK = "▁"
NONE = np.int64(2**31 - 1)
#: Words whose ids a worker remembers.
REMEMBERED = 150_000
#: Text bytes encoded at once; merge rounds take some 20 times as much memory.
AT_ONCE = 1 << 20


class PieceModel:
    """Tables of a model. They are worked out once, on the driver, and broadcast, as the library and what it takes to make them are larger than they."""

    def __init__(self, path: str):
        self.path = path
        sp = self.library()
        n = sp.vocab_size()
        text = [sp.id_to_piece(i) for i in range(n)]
        byte, plain = [sp.is_byte(i) for i in range(n)], [not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i)) for i in range(n)]
        ids = {p: i for i, p in enumerate(text) if plain[i]}
        scores = sorted({sp.get_score(i) for i in range(n) if plain[i]}, reverse=True)
        rank = {s: r for r, s in enumerate(scores)}
        pairs = sorted((ids[p[:k]] << 32 | ids[p[k:]], rank[sp.get_score(i)], i) for p, i in ids.items() for k in range(1, len(p)) if p[:k] in ids and p[k:] in ids)
        self.keys, self.ranks, self.merged = (np.array(x, np.int64) for x in zip(*pairs))
        self.n, self.bytes_at = n, {int(p[3:5], 16): i for i, p in enumerate(text) if byte[i]}
        self.char = np.arange(0x110000, dtype=np.int32) + np.int32(n)  # a character outside the vocabulary is a symbol of its own
        for p, i in ids.items():
            if len(p) == 1:
                self.char[ord(p)] = i
        out = [bytes([int(p[3:5], 16)]) if byte[i] else p.replace(MARK, " ").encode() if plain[i] else b"" if sp.is_control(i) else " ⁇ ".encode() for i, p in enumerate(text)]
        self.out = pa.array(out, pa.binary())
        self.joins = np.zeros((256, 256), bool)  # bytes that follow each other within a piece
        for p in (p.replace(MARK, " ").encode() for p in ids):
            for a, b in zip(p, p[1:]):
                self.joins[a, b] = True
        self.joins[:, 0x80:0xC0] = True  # within a character
        self.marked = np.array([plain[i] and text[i].startswith(MARK) for i in range(n)])

    def library(self):
        import sentencepiece

        return sentencepiece.SentencePieceProcessor(model_file=self.path)

    def pairs(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and merged piece of each pair of symbols."""
        key = left << 32 | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        found = self.keys[at] == key
        return np.where(found, self.ranks[at], NONE), self.merged[at]

    def spelled(self, symbols: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Symbols as ids, and the word of each: those outside the vocabulary in bytes."""
        odd = symbols >= self.n
        if not odd.any():
            return symbols, owner
        kinds, which = np.unique(symbols[odd], return_inverse=True)
        ids = [[self.bytes_at[b] for b in chr(s - self.n).encode()] for s in kinds.tolist()]
        size = np.array([len(x) for x in ids], np.int64)
        many = np.ones(len(symbols), np.int64)
        many[odd] = size[which]
        out = np.repeat(symbols, many)
        out[np.repeat(odd, many)] = np.concatenate(ids)[gather_ranges((np.cumsum(size) - size)[which], size[which])]
        return out, np.repeat(owner, many)

    def rounds(self, symbols: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words end to end, and how many each has; symbols of all words end to end."""
        n, words = len(lengths), np.arange(len(lengths))
        ended: list[np.ndarray] = [np.zeros(0, np.int64)]
        owners: list[np.ndarray] = [np.zeros(0, np.int64)]
        rank, merged = self.pairs(symbols, np.append(symbols[1:], -1))
        rank[np.cumsum(lengths) - 1] = NONE
        while len(words):
            ends = np.cumsum(lengths)
            least = np.minimum.reduceat(rank, ends - lengths)
            done = least == NONE
            keep = np.repeat(~done, lengths)
            if done.any():
                ended.append(symbols[~keep])
                owners.append(np.repeat(words[done], lengths[done]))
                if done.all():
                    break
            at, piece, many = self.merges(symbols, rank, merged, ends, lengths, least)
            symbols[at] = piece
            keep[at + 1] = False
            now = np.cumsum(keep)[at] - 1  # where the merged symbols are after compaction
            lengths = (lengths - many)[~done]
            symbols, rank, merged, words = symbols[keep], rank[keep], merged[keep], words[~done]
            last = np.zeros(len(symbols) + 1, bool)
            last[np.cumsum(lengths) - 1] = True
            rank[now] = NONE
            right = now[~last[now]]
            back = now[(now > 0) & ~last[now - 1]] - 1
            for x in (right, back):
                rank[x], merged[x] = self.pairs(symbols[x], symbols[x + 1])
        ids, owner = self.spelled(np.concatenate(ended), np.concatenate(owners))
        return ids[np.argsort(owner, kind="stable")], np.bincount(owner, minlength=n)

    def merges(self, symbols: np.ndarray, rank: np.ndarray, merged: np.ndarray, ends: np.ndarray, lengths: np.ndarray, least: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Places of the pairs that a round merges, the pieces that they become, and how many each word has."""
        at = np.flatnonzero(rank == np.repeat(np.where(least == NONE, -1, least), lengths))
        fresh = np.append(True, at[1:] != at[:-1] + 1)
        at = at[(at - at[fresh][np.cumsum(fresh) - 1]) % 2 == 0]  # of overlapping pairs, every second
        word, piece = np.searchsorted(ends, at, "right"), merged[at]
        same = word[1:] == word[:-1]
        if same.any():  # words of several merges
            some = np.flatnonzero(np.append(same, False) | np.append(False, same))
            own, of, new = at[some], word[some], piece[some]
            # the pairs that each merge makes, with the merges left of it done
            left = np.where(own > (ends - lengths)[of], symbols[own - 1], -1)
            touch = np.flatnonzero((own[1:] == own[:-1] + 2) & (of[1:] == of[:-1]))
            left[touch + 1] = new[touch]
            right = np.where(own + 2 < ends[of], symbols[np.minimum(own + 2, len(symbols) - 1)], -1)
            first = np.minimum(self.pairs(left, new)[0], self.pairs(new, right)[0]) <= least[of]
            before = np.cumsum(first) - first
            kept = np.ones(len(at), bool)
            kept[some] = before == before[np.searchsorted(of, of)]
            at, word, piece = at[kept], word[kept], piece[kept]
        return at, piece, np.bincount(word, minlength=len(lengths))

    def words(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words end to end, and how many each has."""
        text = [w.decode().replace(" ", MARK) for w in words]
        lengths = np.array([len(x) for x in text], np.int64)
        return self.rounds(self.char[np.frombuffer("".join(text).encode("utf-32-le"), np.uint32)].astype(np.int64), lengths)


class PieceCoder:
    """Encodes and decodes arrays, and remembers words."""

    def __init__(self, model: str | PieceModel):
        self.model = PieceModel(model) if isinstance(model, str) else model
        self.forget()

    def forget(self) -> None:
        self.known: dict[bytes, int] = {}
        self.ids, self.starts, self.sizes = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def learn(self, words: list[bytes]) -> None:
        ids, sizes = self.model.words(words)
        self.known.update(zip(words, range(len(self.known), len(self.known) + len(words))))
        self.starts = np.append(self.starts, len(self.ids) + np.cumsum(sizes) - sizes)
        self.ids, self.sizes = np.append(self.ids, ids.astype(np.int32)), np.append(self.sizes, sizes)

    def encode(self, texts: pa.Array) -> pa.ListArray:
        texts = texts.cast(pa.string()).fill_null("") if not pa.types.is_large_string(texts.type) else texts.fill_null("")
        texts = pc.replace_substring(texts, MARK, " ")
        texts = pc.if_else(pc.equal(pc.binary_length(texts), 0), texts, pc.binary_join_element_wise(" ", texts, ""))
        raw, at = flat_text(texts)
        first = np.ones(len(raw) + 1, bool)
        first[1:-1] = ~self.model.joins[raw[:-1], raw[1:]]
        first[at] = True
        starts = np.flatnonzero(first[: len(raw)])
        coded = binary_array(raw, np.append(starts, len(raw))).dictionary_encode()
        distinct = coded.dictionary.to_pylist()
        if len(self.known) + len(distinct) > REMEMBERED:
            self.forget()
        if new := [w for w in distinct if w not in self.known]:
            self.learn(new)
        word = np.array([self.known[w] for w in distinct], np.int64)[np.asarray(coded.indices)] if distinct else np.zeros(0, np.int64)
        each = self.sizes[word]
        tokens = self.ids[gather_ranges(self.starts[word], each)]
        offsets = np.append(0, np.cumsum(each))[np.searchsorted(starts, at)]
        return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(tokens, pa.int32()))

    def decode(self, ids: pa.ListArray) -> pa.Array:
        ids = ids.fill_null([]) if ids.null_count else ids
        flat, at = np.asarray(ids.flatten()), np.append(0, np.cumsum(np.asarray(pc.list_value_length(ids))))
        taken = self.model.out.take(pa.array(flat, pa.int32())) if len(flat) else pa.array([], pa.binary())
        raw, ends = flat_text(taken)
        ends = ends[at]
        some = np.flatnonzero(at[1:] > at[:-1])
        lead = some[self.model.marked[flat[at[:-1][some]]]] if len(some) else some
        keep = np.ones(len(raw), bool)
        keep[ends[lead]] = False
        dropped = np.zeros(len(ends), np.int64)
        dropped[lead + 1] = 1
        out = binary_array(raw[keep], ends - np.cumsum(dropped), pa.binary())
        try:
            return out.cast(pa.string())
        except pa.ArrowInvalid:  # byte pieces that are no UTF-8
            library = self.model.library()
            return pa.array([library.decode(x) for x in ids.to_pylist()], pa.string())


def with_piece_ids(docs: DataFrame, model_path: str, text: str = "text", out: str = "ids") -> DataFrame:
    """docs with a column of the ids of each whole text; narrow, no shuffle."""
    docs = docs.select(*[f"`{c}`" for c in docs.columns if c != out])
    schema = T.StructType([*docs.schema.fields, T.StructField(out, T.ArrayType(T.IntegerType(), False))])
    shared = docs.sparkSession.sparkContext.broadcast(PieceModel(model_path))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pa.default_memory_pool().release_unused()  # what tasks before this one left in the worker
        coder = PieceCoder(shared.value)
        for batch in batches:
            for part in slices(batch, text, AT_ONCE):
                yield pa.RecordBatch.from_arrays([*part.columns, coder.encode(part.column(part.schema.get_field_index(text)))], [*part.schema.names, out])

    return docs.mapInArrow(encode, schema)


def with_decoded(docs: DataFrame, model_path: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """docs with a column of the text that each list of ids stands for."""
    docs = docs.select(*[f"`{c}`" for c in docs.columns if c != out])
    schema = T.StructType([*docs.schema.fields, T.StructField(out, T.StringType())])
    shared = docs.sparkSession.sparkContext.broadcast(PieceModel(model_path))

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = PieceCoder(shared.value)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, coder.decode(batch.column(batch.schema.get_field_index(ids)))], [*batch.schema.names, out])

    return docs.mapInArrow(decode, schema)
