"""SentencePiece encoding with seeded merge-dropout, and decoding.

Text is cut where no merge can reach: between two characters that no piece holds side by side. Each chunk has an agenda of
candidate merges, the best score first and the leftmost of equals. A candidate that comes up is skipped for good where a keyed hash
of the seed, the text, its place in the text and its piece falls under the dropout; else it is merged and offers new candidates.

Chunks of about the same length lie side by side in columns, and a round takes the head of every column's agenda. Nothing is kept
between texts, so the work and the memory depend on the text at hand only.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .text import _A, _B, mix, slices, span_hashes, text_bytes

SPACE = "▁"
#: Longer chunks, in characters, have an agenda of their own.
WIDEST = 96
#: About how many bytes of text are encoded, and ids decoded, at once.
SLICE_BYTES = 1_000_000
DECODED_IDS = 250_000
GONE, NOT_SIDE_BY_SIDE, FREE, NEVER = -1, -2, -1, np.iinfo(np.int32).max
_STEP, _ROUND, _PIECE = np.uint64(0xD6E8FEB86659FD93), np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
_FULL = 2**64 - 1
_LOADED: dict[str, Pieces] = {}


class PairTable:
    """What two symbols give: a piece, -1 if they only lie side by side in one, -2 if in none. Open addressing."""

    def __init__(self, pairs: dict[int, int]):
        bits = max(4, (4 * len(pairs)).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys, self.values = np.full(1 << bits, FREE, np.int64), np.full(1 << bits, NOT_SIDE_BY_SIDE, np.int32)
        for key, value in pairs.items():
            at = int(self.place(np.array([key]))[0])
            while self.keys[at] != FREE:
                at = (at + 1) & self.mask
            self.keys[at], self.values[at] = key, value

    def place(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * _ROUND) >> self.shift).astype(np.int64)

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        at = self.place(keys)
        met = self.keys[at]
        out = np.where(met == keys, self.values[at], NOT_SIDE_BY_SIDE)
        open_ = np.flatnonzero((met != keys) & (met != FREE))
        at = at[open_]
        while len(open_):
            at = (at + 1) & self.mask
            met = self.keys[at]
            same = met == keys[open_]
            out[open_[same]] = self.values[at[same]]
            on = ~same & (met != FREE)
            open_, at = open_[on], at[on]
        return out


def mix_one(x: int) -> int:
    """text.mix of one number."""
    x = ((x ^ x >> 30) * int(_A)) & _FULL
    x = ((x ^ x >> 27) * int(_B)) & _FULL
    return x ^ x >> 31


class Pieces:
    """The vocabulary of a merge model, as tables. Symbols are piece ids, then characters that only occur inside pieces, then all others."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.n = n = model.get_piece_size()
        byte = {int(model.id_to_piece(i)[3:5], 16): i for i in range(n) if model.is_byte(i)}
        if len(byte) != 256:
            raise ValueError("the model needs byte fallback")
        self.byte = np.array([byte[b] for b in range(256)], np.int32)
        plain = [i for i in range(n) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))]
        names = {i: model.id_to_piece(i) for i in plain}
        symbol = {name: i for i, name in names.items()}
        for name in names.values():
            for c in name:
                symbol.setdefault(c, n + len(symbol) - len(plain))
        self.other = n + len(symbol) - len(plain)
        self.symbols = self.other + 1
        self.of_char = np.full(0x110000, self.other, np.int32)
        for name, i in symbol.items():
            if len(name) == 1:
                self.of_char[ord(name)] = i
        self.of_char[32], self.of_char[ord(SPACE)] = self.of_char[ord(SPACE)], self.other  # the sign itself is spelt in bytes
        pairs: dict[int, int] = {}
        for name in names.values():
            for a, b in zip(name, name[1:], strict=False):
                pairs.setdefault(symbol[a] * self.symbols + symbol[b], -1)
            for k in range(1, len(name)):
                if name[:k] in symbol and name[k:] in symbol:
                    pairs[symbol[name[:k]] * self.symbols + symbol[name[k:]]] = symbol[name]
        self.pairs, self.pair = pairs, PairTable(pairs)
        # by score, pieces of equal score by id
        self.of_rank = np.array(sorted(plain, key=lambda i: (-model.get_score(i), i)), np.int32)
        self.rank = np.zeros(n, np.int32)
        self.rank[self.of_rank] = np.arange(len(plain))
        self.spelt = [bytes([int(model.id_to_piece(i)[3:5], 16)]) if model.is_byte(i) else b"" if model.is_control(i) or model.is_unknown(i) else model.id_to_piece(i).replace(SPACE, " ").encode() for i in range(n)]
        self.spelt_size = np.array([len(x) for x in self.spelt])
        self.spelt_at, self.spelt_flat = np.cumsum(self.spelt_size) - self.spelt_size, np.frombuffer(b"".join(self.spelt), np.uint8)

    def merge_columns(self, symbols: np.ndarray, offered: np.ndarray, start: np.ndarray, size: np.ndarray, skipped) -> None:
        """Merge chunks of at most WIDEST characters in place; offered holds the piece of each character and the next one.

        skipped(place, piece) tells which candidates are left out. A merged symbol stands at its first character, the others are GONE.
        """
        width = int(size.max())
        bits = np.int32(width.bit_length())
        rows = np.arange(width, dtype=np.int32)[:, None]
        where = np.minimum(start + rows, len(symbols) - 1)
        inside = rows < size
        sym = np.where(inside, symbols[where], self.other)
        piece = np.where(rows < size - 1, offered[where], -1)
        agenda = np.where(piece >= 0, (self.rank[piece] << bits) | rows, NEVER)
        after, before = np.broadcast_to(rows + 1, sym.shape).copy(), np.broadcast_to(rows - 1, sym.shape).copy()
        while True:
            head = agenda.min(0)
            going = head < NEVER
            left = int(going.sum())
            if left < 0.6 * len(going):
                done = np.flatnonzero(~going)
                within = inside[:, done]
                symbols[where[:, done][within]] = sym[:, done][within]
                if not left:
                    return
                going = np.flatnonzero(going)
                agenda, sym, after, before, where, inside = (np.take(x, going, 1) for x in (agenda, sym, after, before, where, inside))
                start, size, head, going = start[going], size[going], head[going], np.ones(left, bool)
            n = len(start)
            flat_sym, flat_agenda, flat_after, flat_before = (x.reshape(-1) for x in (sym, agenda, after, before))
            col = np.flatnonzero(going)
            at = head[col] & ((1 << bits) - 1)
            piece = self.of_rank[head[col] >> bits]
            here = at * n + col
            flat_agenda[here] = NEVER
            kept = ~skipped(start[col] + at, piece)
            col, at, piece, here = col[kept], at[kept], piece[kept], here[kept]
            right = flat_after[here] * n + col
            beyond = flat_after[right]
            flat_sym[here], flat_sym[right], flat_agenda[right], flat_after[here] = piece, GONE, NEVER, beyond
            b = np.flatnonzero(beyond < size[col])
            there = beyond[b] * n + col[b]
            flat_before[there] = at[b]
            new = self.pair(piece[b].astype(np.int64) * self.symbols + flat_sym[there])
            flat_agenda[here[b]] = np.where(new >= 0, (self.rank[new] << bits) | at[b], NEVER)
            ahead = flat_before[here]
            b = np.flatnonzero(ahead >= 0)
            there = ahead[b] * n + col[b]
            new = self.pair(flat_sym[there].astype(np.int64) * self.symbols + piece[b])
            flat_agenda[there] = np.where(new >= 0, (self.rank[new] << bits) | ahead[b], NEVER)

    def merge_long(self, symbols: np.ndarray, offered: np.ndarray, start: int, size: int, skipped) -> None:
        """The same for one chunk of any length, with a heap; skipped takes one candidate."""
        sym, pairs, count = symbols[start : start + size].tolist(), self.pairs, self.symbols
        after, before = list(range(1, size + 1)), list(range(-1, size - 1))
        first = offered[start : start + size - 1]
        some = np.flatnonzero(first >= 0)
        agenda = list(zip(self.rank[first[some]].tolist(), some.tolist(), (some + 1).tolist(), first[some].tolist(), strict=True))
        heapq.heapify(agenda)
        while agenda:
            _, left, right, piece = heapq.heappop(agenda)
            if sym[left] == GONE or after[left] != right or pairs.get(sym[left] * count + sym[right]) != piece or skipped(start + left, piece):
                continue
            sym[left], sym[right] = piece, GONE
            after[left] = beyond = after[right]
            if beyond < size:
                before[beyond] = left
            for a, b in ((left, beyond), (before[left], left)):
                new = pairs.get(sym[a] * count + sym[b], -1) if a >= 0 and b < size else -1
                if new >= 0:
                    heapq.heappush(agenda, (int(self.rank[new]), a, b, new))
        symbols[start : start + size] = sym

    def __call__(self, data: np.ndarray, offsets: np.ndarray, dropout: float, seed: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, where each text's begin and the end); data and offsets are UTF-8, each text led by a space."""
        code = np.frombuffer(data.tobytes().decode().encode("utf-32-le"), np.uint32)
        begins = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])[offsets]
        symbols = self.of_char[code]
        if len(code):
            offered = np.append(self.pair(symbols[:-1].astype(np.int64) * self.symbols + symbols[1:]), NOT_SIDE_BY_SIDE)
            offered[begins[1:][begins[1:] > 0] - 1] = NOT_SIDE_BY_SIDE
            stops = np.flatnonzero(offered == NOT_SIDE_BY_SIDE) + 1
            starts = np.concatenate([[0], stops[:-1]])
            salts = mix(span_hashes(data, offsets[:-1], offsets[1:]) ^ mix(np.array([seed % 2**64], np.uint64)))
            of_char = np.repeat(np.arange(len(offsets) - 1, dtype=np.int32), np.diff(begins))
            bound = np.uint64(int(dropout * 2.0**64))

            def skipped(place: np.ndarray, piece: np.ndarray) -> np.ndarray:
                if not dropout:
                    return np.zeros(len(place), bool)
                text = of_char[place]
                return mix(salts[text] ^ mix((place - begins[text]).astype(np.uint64) * _STEP + piece.astype(np.uint64) * _PIECE)) < bound

            def skipped_one(place: int, piece: int) -> bool:
                text = of_char[place]
                step = ((place - int(begins[text])) * int(_STEP) + piece * int(_PIECE)) & _FULL
                return mix_one(int(salts[text]) ^ mix_one(step)) < int(bound)

            size = stops - starts
            order = np.argsort(size, kind="stable")
            ordered = size[order]
            lo = int(np.searchsorted(ordered, 2))
            while lo < len(order) and ordered[lo] <= WIDEST:
                # chunks of a length and up to a quarter longer
                hi = int(np.searchsorted(ordered, min(WIDEST, ordered[lo] + ordered[lo] // 4), "right"))
                self.merge_columns(symbols, offered, starts[order[lo:hi]], size[order[lo:hi]], skipped)
                lo = hi
            for k in order[lo:].tolist():
                self.merge_long(symbols, offered, int(starts[k]), int(size[k]), skipped_one)
        counts = (symbols >= 0).astype(np.int64)
        spelt = np.flatnonzero(symbols >= self.n)
        wide = 1 + (code[spelt] >= 0x80).astype(np.int64) + (code[spelt] >= 0x800) + (code[spelt] >= 0x10000)
        counts[spelt] = wide
        ends = np.concatenate([[0], np.cumsum(counts)])
        out = np.zeros(int(ends[-1]), np.int32)
        known = np.flatnonzero((symbols >= 0) & (symbols < self.n))
        out[ends[known]] = symbols[known]
        raw = np.frombuffer(code[spelt].tobytes().decode("utf-32-le").encode(), np.uint8)
        out[np.repeat(ends[spelt] - np.cumsum(wide) + wide, wide) + np.arange(len(raw))] = self.byte[raw]
        return out, ends[begins]

    def text_of(self, ids: np.ndarray, bounds: np.ndarray) -> list[bytes]:
        """What each ids[begin:end] spells."""
        sizes = self.spelt_size[ids]
        stop = np.concatenate([[0], np.cumsum(sizes)])
        data = self.spelt_flat[np.repeat(self.spelt_at[ids] - stop[:-1], sizes) + np.arange(stop[-1])].tobytes()
        return [data[b:e] for b, e in zip(stop[bounds[:-1]].tolist(), stop[bounds[1:]].tolist(), strict=True)]


def pieces_of(path: str) -> Pieces:
    if path not in _LOADED:
        _LOADED.clear()
        _LOADED[path] = Pieces(path)
    return _LOADED[path]


def encoded(texts: pa.Array, model_path: str, dropout: float, seed: int) -> pa.Array:
    """The piece ids of each text; null where it is null."""
    filled = pc.fill_null(texts, "")
    led = pc.if_else(pc.equal(pc.binary_length(filled), 0), "", pc.binary_join_element_wise("", filled, " "))
    ids, bounds = pieces_of(model_path)(*text_bytes(led), dropout, seed)
    return pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32), mask=np.append(texts.is_null().to_numpy(zero_copy_only=False), False)), pa.array(ids))


def decoded(ids: pa.Array, model_path: str) -> pa.Array:
    """The text of each array of ids; null where it is null."""
    bounds = np.concatenate([[0], np.cumsum(pc.fill_null(pc.list_value_length(ids), 0).to_numpy(zero_copy_only=False).astype(np.int64))])
    spelt = pieces_of(model_path).text_of(ids.flatten().to_numpy(), bounds)
    return pa.array([None if none else x.decode(errors="replace")[1:] for none, x in zip(ids.is_null().to_pylist(), spelt, strict=True)], pa.string())


def encode(docs: DataFrame, model_path: str, text_col: str = "text", ids_col: str = "ids", dropout: float = 0.1, seed: int = 9, decoded_col: str | None = None) -> DataFrame:
    """docs with `ids_col`, the piece ids of `text_col` (array<int>), and with `decoded_col`, if named, their text; columns of these names are replaced.

    With dropout 0 the ids are the model's own, except that the sign for a space within the text is spelt in bytes. The same seed
    gives the same ids for the same text; another seed, text or place in the text other merges of the same word. A null text gives
    null, an empty one an empty array, repeated rows equal ids. A text is encoded as one, so the longest one bounds the memory.
    """
    if not 0 <= dropout < 1:
        raise ValueError("dropout lies in [0, 1)")
    added = [ids_col] if decoded_col is None else [ids_col, decoded_col]
    kept = [c for c in docs.columns if c not in added]

    def run(batches):
        for batch in batches:
            for part in slices(batch, text_col, SLICE_BYTES):
                ids = encoded(part.column(text_col), model_path, dropout, seed)
                both = [ids] if decoded_col is None else [ids, decoded(ids, model_path)]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in kept), *both], [*kept, *added])

    schema = docs.select(*kept).schema.add(ids_col, T.ArrayType(T.IntegerType()))
    return docs.select(*docs.columns if text_col in added else kept).mapInArrow(run, schema if decoded_col is None else schema.add(decoded_col, "string"))


def decode(docs: DataFrame, model_path: str, ids_col: str = "ids", text_col: str = "decoded") -> DataFrame:
    """docs with `text_col`, the text of `ids_col`: exactly what was encoded, whatever the dropout. Null gives null; unknown and control ids give nothing."""
    kept = [c for c in docs.columns if c != text_col]

    def run(batches):
        for batch in batches:
            count, begin = pc.fill_null(pc.list_value_length(batch.column(ids_col)), 0).to_numpy(zero_copy_only=False).astype(np.int64), 0
            total = np.cumsum(count)
            while begin < batch.num_rows:
                end = max(begin + 1, int(np.searchsorted(total, (total[begin - 1] if begin else 0) + DECODED_IDS, "right")))
                part, begin = batch.slice(begin, end - begin), end
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in kept), decoded(part.column(ids_col), model_path)], [*kept, text_col])

    return docs.select(*kept).mapInArrow(run, docs.select(*kept).schema.add(text_col, "string"))


def digest(ids: str):
    """A checksum of an array of ids."""
    return F.crc32(F.array_join(F.col(ids).cast("array<string>"), ",").cast("binary"))
