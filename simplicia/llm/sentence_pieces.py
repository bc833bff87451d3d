"""SentencePiece encoding and decoding, with batched numpy Viterbi.

Texts are cut where no piece of the model can reach across.  Distinct parts of
equal length advance together through the Viterbi recursion: at every end, the
hashes of the substrings of each length probe the sorted hashes of the pieces
of that length, and vectorised maxima keep the best score and a backpointer.

In a unigram model a path's score is the sum of its pieces' scores.  In a BPE
model two pieces may stand side by side only if the merges of their joined
text leave the boundary between them open; every other step scores minus
infinity.  A sequence whose neighbours all pass that test is what the merges
make of the whole text, and there is just one, so the recursion finds it.
"""

from __future__ import annotations

import struct
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field
from pathlib import Path

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from simplicia.llm.kernel import U64, byte_prefix, mix, power_tables, slices, span_hashes, text_buffers
from simplicia.llm.shared import with_columns_by

MODEL = "piece_bpe_32k.model"
SPACE = "▁"
#: Text that a task looks at together, in bytes.
TOGETHER = 1 << 20
#: Parts that a task remembers; beyond that it starts anew, which costs time only.
REMEMBERED = 1 << 19
#: Slots for pairs of pieces that a task remembers, and for hashes of pieces; powers of two.
PAIR_SLOTS = 1 << 21
PIECE_SLOTS = 1 << 16

# Fixed values of the model file's format: fields of the messages, and kinds of pieces and models.
_PIECE, _TRAINER, _NORMALIZER = 1, 2, 3
_NORMAL, _UNKNOWN, _CONTROL, _BYTE = 1, 2, 3, 6
_UNIGRAM, _BPE = 1, 2
#: What an unknown character costs in a unigram model, below the lowest score.
_UNKNOWN_COST = 10.0


def _fields(message: bytes) -> Iterator[tuple[int, int | bytes]]:
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = message[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(message):
        tag = varint()
        if tag & 7 == 0:
            yield tag >> 3, varint()
        else:
            size = {1: 8, 5: 4}.get(tag & 7) or varint()
            yield tag >> 3, message[at : at + size]
            at += size


def _char_weights(codes: np.ndarray) -> np.ndarray:
    return mix(codes.astype(U64) + U64(0x51_7C_C1_B7_27_22_0A_95))


def _string_hash(strings: list[str]) -> np.ndarray:
    """Hashes of strings of one length, as _Lattice has them for substrings."""
    codes = np.frombuffer("".join(strings).encode("utf-32-le"), np.uint32).reshape(len(strings), -1)
    power, _ = power_tables(codes.shape[1] + 1)
    return mix((_char_weights(codes) * power[: codes.shape[1]]).sum(1, dtype=U64))


@dataclass
class Pieces:
    """Tables of a model: symbols are its pieces by id, then characters that are
    no pieces but stand in some, then one symbol for all other characters."""

    strings: list[str]
    kind: int
    score: np.ndarray  # by symbol
    keys: dict[int, tuple[np.ndarray, np.ndarray]]  # by length: sorted hashes, symbols
    bigrams: np.ndarray  # sorted pairs of characters that are neighbours in some piece
    byte_id: np.ndarray
    byte_of: np.ndarray  # byte of each id, -1 for other pieces
    other: int
    longest: int
    # for a BPE model: scores of each symbol's merges in order, its outer symbols before each, and scores of pairs
    merges: np.ndarray = field(default_factory=lambda: np.zeros((0, 1)))
    left: np.ndarray = field(default_factory=lambda: np.zeros((0, 1), np.int64))
    right: np.ndarray = field(default_factory=lambda: np.zeros((0, 1), np.int64))
    pair_keys: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    pair_score: np.ndarray = field(default_factory=lambda: np.zeros(0))

    @property
    def size(self) -> int:
        return len(self.strings)

    def apart(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether merging the joined text of symbols a and b leaves them as they are."""
        out = np.ones(len(a), bool)
        open_ = np.flatnonzero((a != self.other) & (b != self.other))
        a, b = a[open_], b[open_]
        i, j = np.zeros(len(a), np.int64), np.zeros(len(a), np.int64)
        last = self.merges.shape[1] - 1
        while len(open_):
            sa, sb = self.merges[a, np.minimum(i, last)], self.merges[b, np.minimum(j, last)]
            key = self.right[a, np.minimum(i, last)] * (self.other + 1) + self.left[b, np.minimum(j, last)]
            at = np.minimum(np.searchsorted(self.pair_keys, key), max(len(self.pair_keys) - 1, 0))
            across = np.where(self.pair_keys[at] == key, self.pair_score[at], -np.inf) if len(self.pair_keys) else np.full(len(a), -np.inf)
            # the highest score goes first, of equal ones the leftmost
            crossed = (across > sa) & (across >= sb)
            out[open_[crossed]] = False
            more = ~crossed & ~(np.isneginf(sa) & np.isneginf(sb))
            first = sa >= sb
            i, j = i + first, j + ~first
            open_, a, b, i, j = open_[more], a[more], b[more], i[more], j[more]
        return out


def _merge_history(text: str, symbol: dict[str, int], score: dict[str, float]) -> tuple[list[float], list[int], list[int]]:
    """Scores of the merges that a text goes through, and its outer symbols before each and at the end."""
    parts = list(text)
    scores, left, right = [], [symbol[parts[0]]], [symbol[parts[-1]]]
    while len(parts) > 1:
        found = [(score.get(parts[k] + parts[k + 1], -np.inf), -k) for k in range(len(parts) - 1)]
        best, k = max(found)
        if np.isneginf(best):
            break
        parts[-k : 2 - k] = [parts[-k] + parts[1 - k]]
        scores.append(best)
        left.append(symbol[parts[0]])
        right.append(symbol[parts[-1]])
    if len(parts) > 1:
        left[-1] = -1  # it does not become one piece
    return scores, left, right


def load_pieces(path: str | None = None) -> Pieces:
    """Read a model file: unigram or BPE, with byte fallback, a space before the text, and no normalisation."""
    strings, scores, kinds = [], [], []
    trainer: dict[int, int | bytes] = {}
    normalizer: dict[int, int | bytes] = {}
    for number, value in _fields(Path(path or public_tokenizers.path(MODEL)).read_bytes()):
        if number == _PIECE:
            piece = dict(_fields(value))
            strings.append(piece[1].decode())
            scores.append(struct.unpack("<f", piece.get(2, b"\0\0\0\0"))[0])
            kinds.append(piece.get(3, _NORMAL))
        elif number == _TRAINER:
            trainer = dict(_fields(value))
        elif number == _NORMALIZER:
            normalizer = dict(_fields(value))
    kind = trainer.get(3, _UNIGRAM)
    byte_id = np.full(256, -1, np.int64)
    byte_of = np.full(len(strings), -1, np.int64)
    for k, s in enumerate(strings):
        if kinds[k] == _BYTE:
            byte_id[int(s[3:5], 16)] = k
            byte_of[k] = int(s[3:5], 16)
    plain = normalizer.get(1) == b"identity" and normalizer.get(3, 1) == 1 and normalizer.get(4, 1) == 0 and normalizer.get(5, 1) == 1
    if kind not in (_UNIGRAM, _BPE) or not plain or (byte_id < 0).any() or set(kinds) - {_NORMAL, _UNKNOWN, _CONTROL, _BYTE}:
        raise ValueError("the model file is of a kind that isn't supported")

    normal = {s: k for k, s in enumerate(strings) if kinds[k] == _NORMAL}
    lone = sorted({c for s in normal for c in s} - normal.keys())
    symbol = normal | {c: len(strings) + k for k, c in enumerate(lone)}
    other = len(strings) + len(lone)
    lowest = min((scores[k] for k in normal.values()), default=0.0) - _UNKNOWN_COST
    score = np.full(other + 1, lowest, np.float32)
    score[list(normal.values())] = [scores[k] for k in normal.values()]
    p = Pieces(strings, kind, score, {}, np.zeros(0, np.int64), byte_id, byte_of, other, max(map(len, normal), default=1))
    usable = dict(symbol)
    if kind == _BPE:
        by_string = {s: scores[k] for s, k in normal.items()}
        history = {s: _merge_history(s, symbol, by_string) for s in symbol}
        depth = max(len(h[0]) for h in history.values()) + 1
        p.merges = np.full((other + 1, depth), -np.inf)
        p.left = np.full((other + 1, depth), other, np.int64)
        p.right = np.full((other + 1, depth), other, np.int64)
        for s, (steps, left, right) in history.items():
            if left[-1] != symbol[s]:
                del usable[s]
                continue
            k = symbol[s]
            p.merges[k, : len(steps)] = steps
            p.left[k, : len(left)] = left
            p.right[k, : len(right)] = right
            p.left[k, len(left) :], p.right[k, len(right) :] = left[-1], right[-1]
        pairs = {symbol[s[:k]] * (other + 1) + symbol[s[k:]]: scores[n] for s, n in normal.items() for k in range(1, len(s)) if s[:k] in symbol and s[k:] in symbol}
        p.pair_keys = np.array(sorted(pairs), np.int64)
        p.pair_score = np.array([pairs[k] for k in p.pair_keys.tolist()])
    by_length: dict[int, list[str]] = defaultdict(list)
    for s in usable:
        by_length[len(s)].append(s)
    for n, found in by_length.items():
        h = _string_hash(found)
        order = np.argsort(h)
        if len(np.unique(h)) < len(h):
            raise ValueError("two pieces have one hash")
        p.keys[n] = h[order], np.array([symbol[s] for s in found], np.int64)[order]
    p.bigrams = np.array(sorted({ord(a) << 32 | ord(b) for s in normal for a, b in zip(s, s[1:])}), np.int64)
    return p


def ragged(at: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the entries of lists ``which``, one list after the other, and where each begins."""
    sizes = at[which + 1] - at[which]
    out_at = np.concatenate([[0], np.cumsum(sizes)])
    return np.arange(out_at[-1]) + np.repeat(at[which] - out_at[:-1], sizes), out_at


class _Memory:
    """A map from sorted 64-bit keys to places."""

    def __init__(self, dtype) -> None:
        self.keys, self.place = np.zeros(0, dtype), np.zeros(0, np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        if not len(self.keys):
            return np.full(len(keys), -1)
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, self.place[at], -1)

    def add(self, keys: np.ndarray, place: np.ndarray) -> None:
        """New keys, sorted."""
        at = np.searchsorted(self.keys, keys)
        self.keys, self.place = np.insert(self.keys, at, keys), np.insert(self.place, at, place)


class Encoder:
    """Encodes batches of texts with the tables of a model; remembers parts and pairs that it has seen."""

    def __init__(self, pieces: Pieces) -> None:
        self.p = pieces
        self.pair = np.full(PAIR_SLOTS, -1, np.int64)  # the pair that a slot holds
        self.pair_allowed = np.zeros(PAIR_SLOTS, bool)
        # slots without any piece spare most searches
        self.filled = {n: np.bincount((h & U64(PIECE_SLOTS - 1)).astype(np.int64), minlength=PIECE_SLOTS) > 0 for n, (h, _) in pieces.keys.items()}
        self.forget()

    def forget(self) -> None:
        self.seen, self.ids, self.at = _Memory(U64), np.zeros(0, np.int32), np.zeros(1, np.int64)

    def _allowed(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        if self.p.kind != _BPE:
            return np.ones(len(a), bool)
        key = a * (self.p.other + 1) + b
        slot = (mix(key.view(U64)) & U64(PAIR_SLOTS - 1)).astype(np.int64)
        allowed = self.pair_allowed[slot]
        new = np.flatnonzero(self.pair[slot] != key)
        if len(new):
            allowed[new] = self.p.apart(a[new], b[new])
            self.pair[slot[new]] = key[new]
            # of pairs that want one slot the last stays, in both tables
            mine = new[self.pair[slot[new]] == key[new]]
            self.pair_allowed[slot[mine]] = allowed[mine]
        return allowed

    def best_paths(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For texts of equal length, a row of characters each: symbols, and where each text's begin."""
        m, n = codes.shape
        p = self.p
        power, inverse = power_tables(n + 1)
        prefix = np.zeros((n + 1, m), U64)
        np.cumsum((_char_weights(codes) * power[:n]).T, axis=0, dtype=U64, out=prefix[1:])
        best = np.full((n + 1, m), -np.inf, np.float32)  # as the library adds up
        best[0] = 0
        length = np.zeros((n + 1, m), np.int16)  # the backpointers
        last = np.full((n + 1, m), p.other, np.int64)
        for end in range(1, n + 1):
            for size in range(min(end, p.longest), 0, -1):  # of equal scores the longest piece stays
                start = end - size
                open_ = best[start] > -np.inf
                if size in p.keys:
                    hashes, symbols = p.keys[size]
                    h = mix((prefix[end] - prefix[start]) * inverse[start])
                    hit = np.flatnonzero(open_ & self.filled[size][(h & U64(PIECE_SLOTS - 1)).astype(np.int64)])
                    at = np.minimum(np.searchsorted(hashes, h[hit]), len(hashes) - 1)
                    sure = hashes[at] == h[hit]
                    hit, found = hit[sure], symbols[at[sure]]
                else:
                    hit = found = np.zeros(0, np.int64)
                if size == 1:
                    # a character without a piece is a symbol too
                    one = np.full(m, p.other)
                    one[hit] = found
                    hit = np.flatnonzero(open_)
                    found = one[hit]
                if not len(hit):
                    continue
                symbol = found
                score = best[start, hit] + p.score[symbol]
                if start:
                    score[~self._allowed(last[start, hit], symbol)] = -np.inf
                better = score > best[end, hit]
                hit = hit[better]
                best[end, hit], length[end, hit], last[end, hit] = score[better], size, symbol[better]
        # all texts walk back together
        steps, rows = [], []
        at, row = np.full(m, n), np.arange(m)
        while len(row):
            steps.append(last[at[row], row])
            rows.append(row)
            at[row] = at[row] - length[at[row], row]
            row = row[at[row] > 0]
        of, symbols = np.concatenate(rows)[::-1], np.concatenate(steps)[::-1]
        order = np.argsort(of, kind="stable")
        return symbols[order], np.concatenate([[0], np.cumsum(np.bincount(of, minlength=m))])

    def _encode_parts(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of each distinct part, and where each part's begin."""
        p = self.p
        codes = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32).astype(np.int64)
        part_at = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
        cut = np.ones(len(codes), bool)
        key = codes[:-1] << 32 | codes[1:]
        if len(p.bigrams):
            at = np.minimum(np.searchsorted(p.bigrams, key), len(p.bigrams) - 1)
            cut[1:] = p.bigrams[at] != key
        cut[part_at[:-1]] = True
        start = np.flatnonzero(cut)
        end = np.append(start[1:], len(codes))
        # distinct runs of each length go through the recursion once
        size = end - start
        symbols: list[np.ndarray] = []
        first = np.zeros(len(start), np.int64)
        count = np.zeros(len(start), np.int64)
        total = 0
        for n in np.unique(size).tolist():
            mine = np.flatnonzero(size == n)
            rows = codes[start[mine][:, None] + np.arange(n)]
            _, one, back = np.unique(mix((_char_weights(rows) * power_tables(n + 1)[0][:n]).sum(1, dtype=U64)), return_index=True, return_inverse=True)
            for i in range(0, len(one), step := max(1, TOGETHER // (4 * n))):
                found, at = self.best_paths(rows[one[i : i + step]])
                inside = np.flatnonzero((back >= i) & (back < i + step))
                first[mine[inside]] = total + at[back[inside] - i]
                count[mine[inside]] = np.diff(at)[back[inside] - i]
                symbols.append(found)
                total += len(found)
        flat = np.concatenate(symbols)
        run_at = np.concatenate([[0], np.cumsum(count)])
        take = np.arange(run_at[-1]) + np.repeat(first - run_at[:-1], count)
        found = flat[take]
        symbol_at = run_at[np.searchsorted(start, part_at)]
        unknown = np.flatnonzero(found >= p.size)
        if len(unknown):
            # bytes in place of a character without a piece: its place is the end of the symbols before it
            width = np.ones(len(found), np.int64)
            lengths = np.ones(len(found), np.int64)
            known = found < p.size
            lengths[known] = np.array([len(s) for s in p.strings])[found[known]]
            place = np.cumsum(lengths) - lengths
            chars = [chr(c).encode("utf-8") for c in codes[place[unknown]].tolist()]
            width[unknown] = [len(c) for c in chars]
            out_at = np.concatenate([[0], np.cumsum(width)])
            out = np.repeat(np.where(known, found, 0), width)
            spots = np.repeat(out_at[unknown], width[unknown]) + ragged_offsets(width[unknown])
            out[spots] = p.byte_id[np.frombuffer(b"".join(chars), np.uint8)]
            return out.astype(np.int32), out_at[symbol_at]
        return found.astype(np.int32), symbol_at

    def encode(self, column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Ids of whole texts and where each text's begin, some megabytes of text at a time."""
        _, whole = text_buffers(column)
        for first, last in slices(whole, TOGETHER):
            n = last - first
            # the mark inside a text is a space to the model; a part of the batch at a time, for less memory
            data, offsets = text_buffers(pc.replace_substring(column.slice(first, n), SPACE, " "))
            at = offsets + np.arange(n + 1)
            part = np.full(at[-1], 0x20, np.uint8)  # a space stands before each text
            mask = np.ones(len(part), bool)
            mask[at[:-1]] = False
            part[mask] = data
            space = part == 0x20
            begin = space.copy()
            begin[1:] &= ~space[:-1]
            begin[at[:-1]] = True
            # an empty text has no part at all
            begin[at[:-1][np.diff(at) == 1]] = False
            start = np.flatnonzero(begin)
            stop = np.append(start[1:], len(part))
            of = np.searchsorted(at, start, side="right") - 1
            stop = np.minimum(stop, at[of + 1])
            hashes = span_hashes(byte_prefix(part), start, stop)
            u, one = np.unique(hashes, return_index=True)
            if len(self.seen.keys) + len(u) > REMEMBERED:
                self.forget()
            new = self.seen.find(u) < 0
            if new.any():
                texts = [part[a:b].tobytes().decode("utf-8").replace(" ", SPACE) for a, b in zip(start[one[new]].tolist(), stop[one[new]].tolist(), strict=True)]
                ids, ids_at = self._encode_parts(texts)
                self.seen.add(u[new], np.arange(len(texts)) + len(self.at) - 1)
                self.at = np.concatenate([self.at, ids_at[1:] + self.at[-1]])
                self.ids = np.concatenate([self.ids, ids])
            take, part_at = ragged(self.at, self.seen.find(hashes))
            yield self.ids[take], part_at[np.searchsorted(start, at)]


def ragged_offsets(sizes: np.ndarray) -> np.ndarray:
    """0, 1, .. for each size in turn."""
    ends = np.cumsum(sizes)
    return np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - sizes, sizes)


class Decoder:
    """Texts of ids: pieces joined, marks as spaces, the space before the text taken away."""

    def __init__(self, pieces: Pieces) -> None:
        # kinds without text, such as begin and end, decode to nothing
        shown = set(np.concatenate([symbols for _, symbols in pieces.keys.values()]).tolist()) if pieces.keys else set()
        found = [bytes([b]) if (b := int(pieces.byte_of[k])) >= 0 else s.replace(SPACE, " ").encode() if k in shown else b"" for k, s in enumerate(pieces.strings)]
        self.at = np.concatenate([[0], np.cumsum([len(x) for x in found])]).astype(np.int64)
        self.pool = np.frombuffer(b"".join(found), np.uint8)
        self.spaced = np.array([k in shown and s.startswith(SPACE) for k, s in enumerate(pieces.strings)])

    def decode(self, ids: np.ndarray, at: np.ndarray) -> list[str]:
        """One text for each list of ids; bytes that aren't UTF-8 become U+FFFD."""
        take, byte_at = ragged(self.at, ids.astype(np.int64))
        data = self.pool[take]
        begin, end = byte_at[at[:-1]], byte_at[at[1:]]
        filled = np.flatnonzero(at[1:] > at[:-1])
        begin[filled] += self.spaced[ids[at[filled]]]
        return [data[a:b].tobytes().decode("utf-8", "replace") for a, b in zip(begin.tolist(), end.tolist(), strict=True)]


def encode_texts(docs: DataFrame, *, model: str | None = None, ids: str = "ids") -> DataFrame:
    """All columns of ``docs`` and the ids of every whole text, as the library gives them.

    ``docs`` has a column text; ``model`` is the path of a model file that the
    driver reads; its tables, whose size the vocabulary bounds, are broadcast.
    No begin, end or added symbols; strings of control symbols inside texts
    are ordinary text.  A null or empty text has no ids.  A column that is
    named as the new one is replaced.  Every input row
    gives one row, repeated rows too; an empty table none.  No row moves
    between tasks.  Parts of texts are told apart by 64-bit hashes.
    """
    tables = docs.sparkSession.sparkContext.broadcast(load_pieces(model))
    docs = docs.drop(ids)

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[pa.Array]]]:
        encoder = Encoder(tables.value)
        for batch in batches:
            done = 0
            for found, at in encoder.encode(batch.column("text")):
                n = len(at) - 1
                yield batch.slice(done, n), [pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(found))]
                done += n

    return with_columns_by(docs, [T.StructField(ids, T.ArrayType(T.IntegerType()))], encoded)


def decode_ids(tokens: DataFrame, *, model: str | None = None, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """All columns of ``tokens`` and the text of the array column ``ids``; of null or no ids it is empty.

    Ids outside the vocabulary and null ids raise an error.
    """
    tables = tokens.sparkSession.sparkContext.broadcast(load_pieces(model))
    tokens = tokens.drop(text)

    def decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[pa.Array]]]:
        decoder = Decoder(tables.value)
        for batch in batches:
            column = batch.column(ids)
            sizes = np.array([0 if n is None else n for n in column.value_lengths().to_pylist()], np.int64)
            flat = column.flatten()
            if flat.null_count:
                raise ValueError("an id is null")
            texts = decoder.decode(flat.to_numpy(zero_copy_only=False), np.concatenate([[0], np.cumsum(sizes)]))
            yield batch, [pa.array(texts, pa.string())]

    return with_columns_by(tokens, [T.StructField(text, T.StringType())], decoded)


def encode_and_decode(docs: DataFrame, *, model: str | None = None) -> DataFrame:
    """doc_id, n_pieces, ids, decoded_sha256 and round_trip (the ids decode to the text) of every whole text.

    A text with the mark U+2581 in it comes back with spaces there, as the
    library has it, so its round_trip is false.
    """
    rows = docs.select("doc_id", "text")
    tables = docs.sparkSession.sparkContext.broadcast(load_pieces(model))
    added = [T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("decoded", T.StringType())]

    def both(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[pa.Array]]]:
        encoder, decoder = Encoder(tables.value), Decoder(tables.value)
        for batch in batches:
            done = 0
            for found, at in encoder.encode(batch.column("text")):
                yield batch.slice(done, len(at) - 1), [pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(found)), pa.array(decoder.decode(found, at), pa.string())]
                done += len(at) - 1

    return with_columns_by(rows, added, both).select(
        "doc_id",
        F.size("ids").cast("long").alias("n_pieces"),
        "ids",
        F.sha2("decoded", 256).alias("decoded_sha256"),
        (F.col("decoded") == F.coalesce("text", F.lit(""))).alias("round_trip"),
    )
