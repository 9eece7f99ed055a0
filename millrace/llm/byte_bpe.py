"""Byte-level BPE encoding and decoding on length-bucketed, padded numpy matrices.

Every pre-token is a row of token ids. Each round, every row merges its leftmost pair of minimum rank: the ranks of all
adjacent pairs come from an open-addressing hash table held in numpy arrays, finished rows are compacted away, and
matrices get narrower as rows shrink. Only pre-tokens a worker has not met since its last reset are merged.

Null texts encode as empty; empty texts give no ids; ids that the vocabulary lacks raise ValueError on decoding.
"""

from __future__ import annotations

import base64
import heapq
import itertools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cache, free_name, lean, steps, table, with_field, without

VOCABULARY = "byte_bpe_50k.tiktoken"
NO_RANK = np.int32(2**31 - 1)
#: Longer pre-tokens would need quadratic matrix work; a heap merges them in the same order.
MATRIX_WIDTH = 256
#: Pre-tokens a worker remembers before it starts anew (bounds its memory).
REMEMBERED = 600_000
#: Characters that are split and merged in one vectorised step.
TEXT_STEP = 1 << 19
#: A place inside a long text where every pre-token before it has ended.
CUT = regex.compile(r"[^\s\x1c-\x1f][ \n]")


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(VOCABULARY)


def default_pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


class Splitter:
    """Splits texts into pre-tokens.

    The public pattern is evaluated on arrays of code point classes; any other pattern by the ``regex`` module.
    """

    def __init__(self, pattern: str):
        self.pattern = regex.compile(pattern)
        self.vectorised = pattern == default_pattern()
        if self.vectorised:
            every = "".join(map(chr, itertools.chain(range(0xD800), range(0xE000, 0x110000))))
            self.classes = np.full(0x110000, OTHER, np.uint8)
            for name, value in ((r"\s", SPACE), (r"\p{L}", LETTER), (r"\p{N}", NUMBER)):
                for m in regex.finditer(name, every):
                    self.classes[ord(m[0])] = value
            self.classes[ord(" ")] = BLANK

    def starts(self, points: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Places where pre-tokens (and the marks at ``ends`` of texts) begin."""
        n = len(points)
        kind = self.classes[points]
        kind[ends] = MARK
        run = np.maximum(kind, SPACE)  # a blank is a space here
        start = np.ones(n, bool)
        start[1:] = run[1:] != run[:-1]
        start[ends] = True
        word = np.flatnonzero(start[1:] & (run[1:] != MARK) & (run[1:] != SPACE) & (run[:-1] == SPACE)) + 1
        start[word - 1] = True
        start[word] = kind[word - 1] != BLANK
        quote = np.flatnonzero(points == 39)
        quote = quote[start[quote] & (quote + 1 < n)]
        quote = quote[kind[quote + 1] == LETTER]
        if len(quote):
            one = points[quote + 1]
            two = np.where(quote + 2 < n, points[np.minimum(quote + 2, n - 1)], 0)
            two = np.where(np.isin(np.minimum(quote + 2, n - 1), ends), 0, two)
            size = np.where(np.isin(one, [115, 116, 109, 100]), 2, 0)
            size[(two == 101) & ((one == 114) | (one == 118))] = 3
            size[(one == 108) & (two == 108)] = 3
            quote, size = quote[size > 0], size[size > 0]
            start[quote + 1] = False
            start[(quote + size)[quote + size < n]] = True
        return np.flatnonzero(start)


BLANK, SPACE, LETTER, NUMBER, OTHER, MARK = range(6)
POWER = np.uint64(0x9E3779B97F4A7C15)
POWER_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


_powers: dict[int, np.ndarray] = cache("powers")


def powers(base: np.uint64, n: int) -> np.ndarray:
    """1, base, base^2, ... modulo 2^64."""
    out = _powers.get(int(base))
    if out is None or len(out) < n:
        out = np.full(1 << max(10, (n - 1).bit_length()), base, np.uint64)
        out[0] = 1
        out = _powers[int(base)] = np.multiply.accumulate(out)
    return out[:n]


class PairTable:
    """(left id, right id) -> id of the merged token, by multiplicative hashing with linear probing."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.bits = max(4, int(np.ceil(np.log2(max(1, len(keys)) * 4))))
        size = 1 << self.bits
        self.keys = np.full(size + 64, -1, np.int64)
        self.values = np.full(size + 64, NO_RANK, np.int32)
        slot, left, self.probes = self._slot(keys), np.arange(len(keys)), 0
        while len(left):
            self.probes += 1
            if self.probes > 64:
                raise ValueError("pair table is too crowded")
            at = slot[left]
            free = left[self.keys[at] == -1]
            first = free[np.unique(slot[free], return_index=True)[1]]
            self.keys[slot[first]], self.values[slot[first]] = keys[first], values[first]
            left = np.setdiff1d(left, first, assume_unique=True)
            slot[left] += 1

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks of pairs; a negative id (padding) has none."""
        keys = (left.astype(np.int64) << 32) | right
        shape, keys = keys.shape, keys.ravel()
        out = np.full(len(keys), NO_RANK, np.int32)
        todo = np.flatnonzero((left.ravel() >= 0) & (right.ravel() >= 0))
        slot = self._slot(keys[todo])
        for _ in range(self.probes):
            seen = self.keys[slot]
            hit = seen == keys[todo]
            out[todo[hit]] = self.values[slot[hit]]
            more = ~hit & (seen != -1)
            if not more.any():
                break
            todo, slot = todo[more], slot[more] + 1
        return out.reshape(shape)


class ByteBpe:
    """One vocabulary: encodes texts to id arrays and ids back to bytes."""

    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        self.splitter = Splitter(pattern)
        self.split = self.splitter.pattern
        self.bytes_id = np.array([self.ranks[bytes([i])] for i in range(256)], np.int32)
        lefts, rights, merged = [], [], []
        for token, rank in self.ranks.items():
            for i in range(1, len(token)):
                a, b = self.ranks.get(token[:i]), self.ranks.get(token[i:])
                if a is not None and b is not None:
                    lefts.append(a)
                    rights.append(b)
                    merged.append(rank)
        self.pairs = PairTable((np.array(lefts, np.int64) << 32) | np.array(rights, np.int64), np.array(merged, np.int32))
        self.pair_dict = dict(zip(zip(lefts, rights), merged))
        top = max(self.ranks.values()) + 1
        self.token_len = np.full(top, -1, np.int64)
        by_id = [b""] * top
        for token, rank in self.ranks.items():
            by_id[rank], self.token_len[rank] = token, len(token)
        self.token_start = np.concatenate([[0], np.cumsum(np.maximum(self.token_len, 0))])[:-1]
        self.blob = np.frombuffer(b"".join(by_id), np.uint8)
        self._forget()

    def _forget(self) -> None:
        self.index: dict[str, int] = {}
        self.starts, self.lens, self.flat = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32)

    def merge_rows(self, rows: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of pre-tokens one after another, and the number of each, from padded matrices of rows of like length."""
        lengths = np.fromiter(map(len, rows), np.int64, len(rows))
        parts, order, sizes, low = [], [], np.zeros(len(rows), np.int64), 0
        for i in np.flatnonzero(lengths > MATRIX_WIDTH):
            parts.append(self._merge_long(rows[i]))
            order.append(np.array([i]))
            sizes[i] = len(parts[-1])
        for high in (2, 4, 6, 8, 12, 16, 24, 32, 64, MATRIX_WIDTH):
            members = np.flatnonzero((lengths > low) & (lengths <= high))
            for part in np.array_split(members, max(1, len(members) * high // 200_000)):
                if len(part):
                    ids, size = self._merge_matrix([rows[i] for i in part], lengths[part], high)
                    parts.append(ids[np.arange(ids.shape[1]) < size[:, None]])
                    order.append(part)
                    sizes[part] = size
            low = high
        if not parts:
            return np.zeros(0, np.int32), sizes
        flat, order = np.concatenate(parts), np.concatenate(order)
        begin = np.empty(len(rows), np.int64)
        begin[order] = np.cumsum(sizes[order]) - sizes[order]
        return flat[np.repeat(begin - (np.cumsum(sizes) - sizes), sizes) + np.arange(len(flat))], sizes

    def _merge_matrix(self, rows: list[bytes], size: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        raw = np.frombuffer(b"".join(r.ljust(width, b"\0") for r in rows), np.uint8).reshape(len(rows), width)
        ids = np.where(np.arange(width) < size[:, None], self.bytes_id[raw], np.int32(-1))
        rank = np.full(ids.shape, NO_RANK, np.int32)
        rank[:, :-1] = self.pairs.find(ids[:, :-1], ids[:, 1:])
        final, final_size, places, size = np.full(ids.shape, -1, np.int32), size.copy(), np.arange(len(rows)), size.copy()
        while True:
            at = rank.argmin(1)
            row = np.arange(len(at))
            best = rank[row, at]
            done = best == NO_RANK
            if done.any():
                final[places[done], :width], final_size[places[done]] = ids[done], size[done]
                keep = ~done
                places, size, at, best = places[keep], size[keep], at[keep], best[keep]
                if not len(places):
                    return final, final_size
                width = int(size.max())
                ids, rank = ids[keep, :width], rank[keep, :width]
                row = np.arange(len(at))
            source = np.arange(width) + (np.arange(width) > at[:, None])
            np.minimum(source, width - 1, out=source)
            ids, rank = np.take_along_axis(ids, source, 1), np.take_along_axis(rank, source, 1)
            size -= 1
            ids[row, at] = best
            ids[row, size] = -1
            rank[row, size - 1] = rank[row, size] = NO_RANK
            after = np.where(at + 1 < size, ids[row, np.minimum(at + 1, width - 1)], -1)
            before = np.where(at > 0, ids[row, np.maximum(at - 1, 0)], -1)
            rank[row, at] = self.pairs.find(best, after)
            left = at > 0
            rank[row[left], at[left] - 1] = self.pairs.find(before[left], best[left])

    def _merge_long(self, piece: bytes) -> np.ndarray:
        """The same order of merges by a heap of (rank, place), for very long pre-tokens."""
        ids = self.bytes_id[np.frombuffer(piece, np.uint8)].tolist()
        n, find = len(ids), self.pair_dict.get
        nxt, prev = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i) for i in range(n - 1) if (r := find((ids[i], ids[i + 1]))) is not None]
        heapq.heapify(heap)
        while heap:
            r, i = heapq.heappop(heap)
            j = nxt[i] if ids[i] is not None else n
            if j >= n or find((ids[i], ids[j])) != r:
                continue
            ids[i], ids[j] = r, None
            nxt[i] = nxt[j]
            if nxt[i] < n:
                prev[nxt[i]] = i
                if (x := find((r, ids[nxt[i]]))) is not None:
                    heapq.heappush(heap, (x, i))
            if prev[i] >= 0 and (x := find((ids[prev[i]], r))) is not None:
                heapq.heappush(heap, (x, prev[i]))
        return np.array([x for x in ids if x is not None], np.int32)

    def _learn(self, pieces: list[str]) -> None:
        """Encode pre-tokens not met before; a pre-token that is itself a token stays whole."""
        raw = [p.encode() for p in pieces]
        whole = np.array([self.ranks.get(b, -1) for b in raw], np.int32)
        rest = np.flatnonzero(whole < 0)
        merged, sizes = self.merge_rows([raw[i] for i in rest])
        lens = np.ones(len(pieces), np.int64)
        lens[rest] = sizes
        begin = np.cumsum(lens) - lens
        ids = np.empty(int(lens.sum()), np.int32)
        ids[begin[whole >= 0]] = whole[whole >= 0]
        ids[np.repeat(begin[rest] - (np.cumsum(sizes) - sizes), sizes) + np.arange(len(merged))] = merged
        base = len(self.starts)
        self.starts = np.concatenate([self.starts, len(self.flat) + begin])
        self.lens = np.concatenate([self.lens, lens])
        self.flat = np.concatenate([self.flat, ids])
        self.index.update(zip(pieces, range(base, base + len(pieces))))

    def _places(self, pieces: list[str]) -> np.ndarray:
        """Where the ids of distinct pre-tokens are remembered; new ones are merged first."""
        new = [p for p in pieces if p not in self.index]
        if new and len(self.index) + len(new) > REMEMBERED:
            self._forget()
            new = pieces
        if new:
            self._learn(new)
        return np.fromiter(map(self.index.__getitem__, pieces), np.int64, len(pieces))

    def _pieces(self, texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Distinct pre-tokens, the one of each pre-token in order, and how many each text has."""
        if not self.splitter.vectorised:
            found = [self.split.findall(t) for t in texts]
            number: dict[str, int] = {}
            which = [number.setdefault(p, len(number)) for f in found for p in f]
            return list(number), np.array(which, np.int64), np.fromiter(map(len, found), np.int64, len(found))
        joined = "\n".join(texts) + "\n"
        points = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
        ends = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 1) - 1
        start = self.splitter.starts(points, ends)
        stop = np.append(start[1:], len(points))
        true = np.ones(len(start), bool)
        true[np.searchsorted(start, ends)] = False
        count = np.diff(np.searchsorted(start[true], ends), prepend=0)
        start, stop = start[true], stop[true]
        if not len(start):
            return [], np.zeros(0, np.int64), count
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum((points + np.uint64(1)) * powers(POWER, len(points)), dtype=np.uint64)])
        print_ = (total[stop] - total[start]) * powers(POWER_INVERSE, len(points))[start]
        _, first, which = np.unique(print_, return_index=True, return_inverse=True)
        lens = stop - start
        same = lens == lens[first][which]
        if same.all():
            at = np.arange(int(lens.sum())) - np.repeat(np.cumsum(lens) - lens, lens)
            same = points[at + np.repeat(start, lens)] == points[at + np.repeat(start[first][which], lens)]
        if not same.all():  # two pre-tokens with one fingerprint: count by the strings themselves
            number = {}
            which = np.array([number.setdefault(joined[a:b], len(number)) for a, b in zip(start, stop)], np.int64)
            return list(number), which, count
        return [joined[a:b] for a, b in zip(start[first].tolist(), stop[first].tolist())], which, count

    def encode_step(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of several texts one after another, and the number of each."""
        pieces, which, count = self._pieces(texts)
        if not pieces:
            return np.zeros(0, np.int32), np.zeros(len(texts), np.int64)
        at = self._places(pieces)[which]
        lens = self.lens[at]
        ends = np.cumsum(lens)
        ids = self.flat[np.repeat(self.starts[at] - (ends - lens), lens) + np.arange(ends[-1])]
        return ids, np.diff(np.concatenate([[0], ends])[np.cumsum(count)], prepend=0)

    def encode_many(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """As encode_step, with null as empty; a long text is cut where a blank or line feed follows a non-space, where pre-tokens always end."""
        parts, owner = [], []
        for i, t in enumerate(texts):
            t, at = t or "", 0
            while len(t) - at > 2 * TEXT_STEP and (m := CUT.search(t, at + TEXT_STEP)):
                parts.append(t[at : m.start() + 1])
                owner.append(i)
                at = m.start() + 1
            parts.append(t[at:])
            owner.append(i)
        ids, lens, begin, size = [], [], 0, 0
        for k, p in enumerate([*parts, None]):
            if p is None or size and size + len(p) > TEXT_STEP:
                a, b = self.encode_step(parts[begin:k])
                ids.append(a)
                lens.append(b)
                begin, size = k, 0
            size += len(p or "")
        total = np.zeros(len(texts), np.int64)
        if parts:
            np.add.at(total, owner, np.concatenate(lens))
        return np.concatenate([np.zeros(0, np.int32), *ids]), total

    def encode(self, text: str | None) -> np.ndarray:
        """Ids of a whole text (null: none)."""
        return self.encode_many([text])[0]

    def decode_flat(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of ids one after another, and the length of each id's bytes."""
        if len(ids) and (ids.min() < 0 or ids.max() >= len(self.token_len) or (self.token_len[ids] < 0).any()):
            raise ValueError("the vocabulary lacks an id")
        lens = self.token_len[ids]
        shift = np.repeat(self.token_start[ids] - (np.cumsum(lens) - lens), lens)
        return self.blob[shift + np.arange(len(shift))], lens


_loaded: dict[tuple[str, str], ByteBpe] = cache("tokenizers")


def tokenizer(path: str | None = None, pattern: str | None = None) -> ByteBpe:
    """The vocabulary at ``path``, loaded once in each Python process."""
    key = (path or default_path(), pattern or default_pattern())
    if key not in _loaded:
        _loaded[key] = ByteBpe(*key)
    return _loaded[key]


def _encoding(at: int, output: str, path: str | None = None, pattern: str | None = None) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = tokenizer(path, pattern)
        for batch in batches:
            for part in steps(batch, at):
                ids, lens = bpe.encode_many(part.column(at).to_pylist())
                offsets = pa.array(np.concatenate([[0], np.cumsum(lens)]).astype(np.int32))
                made = pa.ListArray.from_arrays(offsets, pa.array(ids, pa.int32()))
                yield pa.RecordBatch.from_arrays([*part.columns, made], [*part.schema.names, output])

    return run


def _decoding(at: int, output: str, path: str | None = None, pattern: str | None = None) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = tokenizer(path, pattern)
        for batch in batches:
            for start in range(0, max(1, batch.num_rows), 256):
                part = batch.slice(start, 256)
                column = part.column(at)
                flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
                count = pa.compute.fill_null(pa.compute.list_value_length(column), 0).to_numpy()
                data, lens = bpe.decode_flat(flat)
                ends = np.concatenate([[0], np.cumsum(lens)])[np.concatenate([[0], np.cumsum(count)])]
                made = pa.BinaryArray.from_buffers(pa.binary(), len(part), [None, pa.py_buffer(ends.astype(np.int32).tobytes()), pa.py_buffer(data.tobytes())])
                if column.null_count:
                    made = pa.compute.if_else(column.is_valid(), made, pa.scalar(None, pa.binary()))
                yield pa.RecordBatch.from_arrays([*part.columns, made], [*part.schema.names, output])

    return run


def encode(df: DataFrame, text: str = "text", output: str = "token_ids", path: str | None = None, pattern: str | None = None) -> DataFrame:
    """Add ``output`` (array<int>): the ids of every whole text, as ``encode_ordinary`` of the tiktoken library gives them."""
    df = without(df, output)
    run = _encoding(df.columns.index(text), output, path, pattern)
    return df.mapInArrow(lean(run, "tokenizers"), with_field(df.schema, T.StructField(output, T.ArrayType(T.IntegerType()))))


def decode(df: DataFrame, ids: str = "token_ids", output: str = "decoded", path: str | None = None, pattern: str | None = None) -> DataFrame:
    """Add ``output`` (binary): the bytes that the ids stand for (null ids: null)."""
    df = without(df, output)
    run = _decoding(df.columns.index(ids), output, path, pattern)
    return df.mapInArrow(lean(run, "tokenizers"), with_field(df.schema, T.StructField(output, T.BinaryType())))


def digests(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Key, number of ids, SHA-256 of the decimal ids joined by a space, SHA-256 of the decoded bytes; a row for each row."""
    ids = free_name(df, "token_ids")
    picked = df.select(key, text)
    encoding, decoding = _encoding(1, ids), _decoding(1, "decoded")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Both in one Python worker, so that a task has one tokenizer."""
        return decoding(batch.select([0, 2]) for batch in encoding(batches))

    schema = with_field(T.StructType(picked.schema.fields[:1]), T.StructField(ids, T.ArrayType(T.IntegerType())), T.StructField("decoded", T.BinaryType()))
    coded = picked.mapInArrow(lean(run, "tokenizers"), schema)
    return coded.select(
        key,
        F.size(ids).cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col(ids).cast("array<string>"), " ").cast("binary"), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "documents"))
