"""Best-fit packing of tokenised documents into sequences of fixed length.

Documents become pieces of at most `capacity` tokens. The histogram of piece lengths is packed on the driver: it has at most
`capacity` rows whatever the input. Its configuration linear program is solved by multiplicative weights, each step priced by a
knapsack dynamic program; the configurations are rounded to whole numbers and what is left goes best-fit. The plan, whose size
is bounded by the capacity and the number of steps, is then dealt to the pieces by their rank among those of equal length.
"""

from __future__ import annotations

import json
import unicodedata
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .chunks import ChunkCache
from .common import Scratch
from .text import LOWER, slices, text_bytes, word_spans

_END, _CUT = "", ""
_LOADED: dict[str, ChunkIds] = {}


class ChunkIds(ChunkCache):
    """Token ids of white-space separated chunks, kept by hash for as many as `most` chunks.

    No token of the vocabulary crosses white space, so a text's ids are its chunks' ids in order. Chunks of printable Latin
    characters go through the same merges in a faster encoder, all others through the tokenizer itself.
    """

    def __init__(self, path: str, most: int = 2_000_000):
        import regex
        import tiktoken
        from tokenizers import Tokenizer

        super().__init__(most)
        self.tokenizer = Tokenizer.from_file(path)
        with open(path) as f:
            model = json.load(f)["model"]
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        hidden = [b for b in range(256) if b not in shown]
        of_char = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}
        end = _END.encode()

        def plain(token: str) -> bytes:
            last = token.endswith("</w>")
            return bytes(of_char[c] for c in (token[:-4] if last else token)) + end * last

        ids = {plain(k): v for k, v in model["vocab"].items()}
        ranks = {bytes([b]): b for b in range(256)}
        for b in [end[:2], end, *(bytes([b]) + end for b in range(256))]:
            ranks.setdefault(b, len(ranks))
        for m in model["merges"]:
            ranks.setdefault(plain("".join(m if isinstance(m, list) else m.split(" "))), len(ranks))
        self.ids = np.array([ids.get(b, 0) for b in ranks] + [0xFFFFFFFF], np.uint32)
        self.encoder = tiktoken.Encoding("chunks", pat_str=f"[^{_END}]+{_END}", mergeable_ranks=ranks, special_tokens={_CUT: len(ranks)})
        self.words = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|\p{{L}}+|\p{{N}}|[^\s\p{{L}}\p{{N}}{_CUT}]+|{_CUT}")
        self.simple = regex.compile(r"(?!.*<\|)[\x21-\x7e¡-ɏ]+", regex.S)

    def encode(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all chunks in order, number of ids of each)."""
        easy = [i for i, x in enumerate(chunks) if self.simple.fullmatch(x)]
        rest = sorted(set(range(len(chunks))) - set(easy))
        out: list = [None] * len(chunks)
        if easy:
            marked = "".join([w if w == _CUT else w + _END for w in self.words.findall(_CUT.join([unicodedata.normalize("NFC", chunks[i]).lower() for i in easy]))])
            found = self.ids[np.frombuffer(self.encoder._core_bpe.encode_to_tiktoken_buffer(marked, {_CUT}), np.uint32)]
            for i, part in zip(easy, np.split(found, np.flatnonzero(found == 0xFFFFFFFF)), strict=True):
                out[i] = part[1:] if len(part) and part[0] == 0xFFFFFFFF else part
        for i, e in zip(rest, self.tokenizer.encode_batch([chunks[i] for i in rest], add_special_tokens=False) if rest else [], strict=True):
            out[i] = np.array(e.ids, np.uint32)
        return np.concatenate(out), np.array([len(x) for x in out], np.int64)


def chunk_ids(path: str) -> ChunkIds:
    if path not in _LOADED:
        _LOADED[path] = ChunkIds(path)
    return _LOADED[path]


def pieces(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = 2048, end_id: int = 0, with_ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32[, ids]) of each document's ids with `end_id` after them, cut only where longer than `capacity`."""

    def run(batches):
        tail = np.uint32(end_id).tobytes()
        for batch in batches:
            for part in slices(batch, "text"):
                data, offsets = text_bytes(part.column("text"))
                starts, ends, first = word_spans(data, offsets)
                flat, bounds = chunk_ids(tokenizer_path)(data, starts, ends, LOWER[data])
                bounds = bounds[first].tolist()
                rows = []
                for d, doc in enumerate(part.column("doc_id").to_pylist()):
                    own = flat[bounds[d] : bounds[d + 1]].tobytes() + tail
                    rows += [(doc, k, k * capacity, len(x) // 4, zlib.crc32(x), x) for k in range(-(-len(own) // (4 * capacity))) for x in [own[4 * capacity * k : 4 * capacity * (k + 1)]]]
                cols = [pa.array(x, t) for x, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()), strict=True)]
                if with_ids:
                    ids = np.frombuffer(b"".join(r[5] for r in rows), "<u4").astype(np.int32)
                    cols[5] = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum([r[3] for r in rows])]).astype(np.int32)), pa.array(ids))
                yield pa.RecordBatch.from_arrays(cols[: 5 + with_ids], ["doc_id", "piece", "start", "length", "ids_crc32", "ids"][: 5 + with_ids])

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, schema)


def knapsack(worth: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(the largest total worth, the length added last) for each room: an unbounded knapsack; worth[x] is that of length x, -inf where it does not occur."""
    capacity, short = len(worth) - 1, int(np.flatnonzero(worth > -np.inf)[0])
    best, took = np.zeros(capacity + 1), np.zeros(capacity + 1, np.int64)
    for room in range(1, capacity + 1):
        best[room] = best[room - 1]
        if room >= short:
            value = best[room - short :: -1] + worth[short : room + 1]
            k = int(value.argmax())
            if value[k] > best[room]:
                best[room], took[room] = value[k], k + short
    return best, took


def fills(took: np.ndarray, rooms: np.ndarray) -> np.ndarray:
    """(depth, rooms): the lengths that fill each room best, 0 where there is no further one."""
    last = np.maximum.accumulate(np.where(took > 0, np.arange(len(took)), 0))
    out = []
    while True:
        rooms = last[rooms]
        piece = took[rooms]
        if not piece.any():
            return np.array(out, np.int64).reshape(len(out), len(rooms))
        out.append(piece)
        rooms = rooms - piece


def fractional(counts: dict[int, int], capacity: int, gap: float = 0.01, most_rounds: int = 16) -> tuple[dict[tuple, float], float, float]:
    """`cover` with 2 rounds, or twice as many until its total and its bound are within `gap`, at most `most_rounds`."""
    rounds, bound, best = 2, 0.0, None
    while True:
        used, total, some = cover(counts, capacity, rounds)
        bound = max(bound, some)
        if best is None or total < best[1]:
            best = used, total
        if best[1] <= (1 + gap) * bound or 2 * rounds > most_rounds:
            return *best, bound
        rounds *= 2


def cover(counts: dict[int, int], capacity: int, rounds: int, rate: float = 0.2, near: float = 0.02) -> tuple[dict[tuple, float], float, float]:
    """(configurations with how often each is used, their total, a lower bound of any packing): the covering program, solved by multiplicative weights.

    A configuration is a tuple of (length, how many), longest first. Each step prices, by one knapsack, the configuration of most
    dual weight that holds each length. Those within `near` of the best are used, the best first, until some length of theirs is
    covered once more in this step; the dual weights then fall exponentially with what is covered, so the next step uses other
    lengths. When every length is covered `rounds` times, the mean of the rounds is the solution. The bound is the best of the dual
    solutions and of the tokens over the capacity; more rounds and a lower rate bring the two closer.
    """
    lengths = np.array(sorted(x for x in counts if counts[x] > 0))
    n = np.array([counts[x] for x in lengths.tolist()], float)
    at = np.zeros(capacity + 1, np.int64)
    at[lengths] = np.arange(len(lengths))
    y, lack = (lengths / capacity) ** 1.02, rounds * n
    bound, used = float(n @ lengths) / capacity, {}
    while True:
        open_ = lack > 1e-6 * n
        if not open_.any():
            break
        worth = np.full(capacity + 1, -np.inf)
        worth[lengths[open_]] = y[open_]
        best, took = knapsack(worth)
        bound = max(bound, float(n[open_] @ y[open_]) / best[capacity])
        value = y[open_] + best[capacity - lengths[open_]]
        order = np.argsort(-value, kind="stable")
        order = order[value[order] >= (1 - near) * best[capacity]]
        forced = lengths[open_][order]
        columns = fills(took, capacity - forced).T
        room = np.minimum(n, lack)
        for i, length in enumerate(forced.tolist()):
            if room[at[length]] <= 0:
                continue
            held, often = np.unique(np.append(columns[i][columns[i] > 0], length), return_counts=True)
            of = at[held]
            mass = float((room[of] / often).min())
            if mass > 1e-6:
                room[of] -= mass * often
                key = tuple(zip(held[::-1].tolist(), often[::-1].tolist(), strict=True))
                used[key] = used.get(key, 0.0) + mass / rounds
        done = np.minimum(n, lack) - room
        lack = lack - done
        y = y * np.exp(-rate * done / n)
    return used, sum(used.values()), bound


def rounded(counts: dict[int, int], capacity: int, share: float = 0.5) -> list[tuple[dict[int, int], int]]:
    """The configurations of the program in whole numbers, the fullest first, each as often as its pieces are there; the rest goes best-fit, into their free room too.

    A use is rounded up, as long as no more than `share` of the program's total is taken, but one sequence at least: what is left to
    best-fit then has enough short pieces to fill up with.
    """
    used, total, _ = fractional(counts, capacity)
    left, out, open_ = dict(counts), [], max(1, int(share * total))
    for key, x in sorted(used.items(), key=lambda kx: (capacity - sum(length * a for length, a in kx[0]), -kx[1], kx[0])):
        often = min(int(np.ceil(x)), open_, *(left[length] // a for length, a in key))
        if often > 0:
            out.append((dict(key), often))
            open_ -= often
            for length, a in key:
                left[length] -= a * often
    return best_fit(left, capacity, out)


def best_fit(counts: dict[int, int], capacity: int, begun: list[tuple[dict[int, int], int]] = ()) -> list[tuple[dict[int, int], int]]:
    """Best-fit decreasing on a histogram, into `begun` sequences first: (what a sequence holds, how many such sequences)."""
    free: dict[int, list] = {}
    for held, m in begun:
        free.setdefault(capacity - sum(x * a for x, a in held.items()), []).append((held, m))
    for x in sorted((x for x in counts if counts[x] > 0), reverse=True):
        left = counts[x]
        for room in [r for r in sorted(free) if r >= x]:
            # a sequence takes as many as fit, so it is visited once for each length
            groups, free[room] = free.pop(room), []
            for held, m in groups:
                fit = room // x
                full = min(m, left // fit)
                odd = 1 if full < m and left - full * fit > 0 else 0
                for many, a in ((full, fit), (odd, left - full * fit)):
                    if many:
                        a = min(a, fit)
                        free.setdefault(room - a * x, []).append((held | {x: held.get(x, 0) + a}, many))
                        left -= many * a
                if m - full - odd:
                    free[room].append((held, m - full - odd))
            if not free.get(room):
                free.pop(room, None)
            if not left:
                break
        fit = capacity // x
        if left // fit:
            free.setdefault(capacity - fit * x, []).append(({x: fit}, left // fit))
        if left % fit:
            free.setdefault(capacity - left % fit * x, []).append(({x: left % fit}, 1))
    return [g for groups in free.values() for g in groups]


def plan(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """Rows (length, first rank, ranks, in a sequence, first sequence, offset) that place every piece once."""
    rows, used, sequence = [], dict.fromkeys(counts, 0), 0
    for held, m in rounded(counts, capacity):
        offset = 0
        for x, a in held.items():
            rows.append((x, used[x], a * m, a, sequence, offset))
            used[x] += a * m
            offset += a * x
        sequence += m
    if used != counts:
        raise AssertionError("the plan places every piece once")
    return rows


def pack(found: DataFrame, tmp: Scratch, capacity: int = 2048, rows_per_salt: int = 20_000) -> DataFrame:
    """Add sequence_id and offset to a stored table of pieces (doc_id, piece, length, ...); lengths lie in 1..capacity."""
    spark = found.sparkSession
    counts = {r["length"]: r["n"] for r in found.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most `capacity` rows
    schema = "length long, r0 long, ranks long, in_one long, s0 long, o0 long"
    placed = F.broadcast(spark.createDataFrame(plan(counts, capacity) if counts else [], schema))
    salts = -(-max(counts.values(), default=1) // rows_per_salt)
    salted = found.withColumn("_salt", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(salts)))
    tally = salted.groupBy("length", "_salt").agg(F.count(F.lit(1)).alias("_n"))
    before = tally.withColumn("_before", F.sum("_n").over(Window.partitionBy("length").orderBy("_salt")) - F.col("_n")).drop("_n")
    ranked = salted.withColumn("_rn", F.row_number().over(Window.partitionBy("length", "_salt").orderBy("doc_id", "piece"))).join(before, ["length", "_salt"])
    ranked = ranked.withColumn("_rank", F.col("_before") + F.col("_rn") - 1)
    at = ranked.join(placed, "length").where("_rank >= r0 and _rank < r0 + ranks").withColumn("_k", F.col("_rank") - F.col("r0"))
    out = at.withColumn("sequence_id", F.expr("s0 + _k div in_one")).withColumn("offset", F.expr("o0 + (_k % in_one) * length"))
    return out.select(*found.columns, "sequence_id", "offset")


def pack_documents(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = 2048, end_id: int = 0, with_ids: bool = False) -> DataFrame:
    """One row for each piece: doc_id, piece, start, length, ids_crc32[, ids], sequence_id, offset.

    A null or empty text is its end id alone. Rows that repeat an id are packed each; a null id is kept as null. Other columns
    are ignored; an empty table gives no rows. ids are those of the tokenizer file without special tokens, then `end_id`.
    """
    tmp = Scratch(docs.sparkSession)
    return pack(tmp.table(pieces(docs, tokenizer_path, id_col, text_col, capacity, end_id, with_ids)), tmp, capacity)
