"""All pairs of word lists that may reach an edit similarity, without loss: prefix filter over the rarest word pairs.

A list of n words has n tokens: each word with the one before it, the first with a mark; a repeated token has its
occurrence number. One edit changes two tokens of a list at most, so of two lists with edit similarity s or more each
loses at most floor(2 (1 - s) n) of its n tokens, by its own length. Tokens are put in one order for all lists, rarest
first. So the c smallest tokens that two such lists share are among the first floor(2 (1 - s) n) + c of each. A list has
these as keys, with c = 1 + n div 32; two lists are a pair if they share as many keys as the smaller c says. Below
similarity 0.75 single words are the tokens. Any order is right; the order by frequency, taken from a sample of texts,
keeps buckets small.

Keys are dealt into parts, packed as bytes, and each part is sorted as arrays. Lists of different roots that share a key
are counted (lists already in one class need no test, and cost nothing), where lengths allow the similarity. Keys have
48 bits; a collision can only add a pair. Copies of one text share hundreds of keys, in all parts; so keys whose lists make
more than `CROWD` pairs are dealt once more, by their largest class, and what two lists share there is counted in one task
and told in one row. All pairs of a key are made in one task, in bounded portions.

A pair is thinned out by signs(): an edit changes the parity of two words' counts at most, an insertion or deletion of one.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .wordtape import Tape, mix, pair, tapes

SAMPLE, CELLS, WORD_CELLS, SHARE, ROWS, PORTION, CROWD = 8192, 1 << 22, 1 << 17, 32, 1 << 15, 4_000_000, 16
_U = np.uint64
_LOW48 = _U((1 << 48) - 1)


def _size(similarity: float) -> int:
    return 2 if similarity >= 0.75 else 1


def least(n: np.ndarray) -> np.ndarray:
    """How many keys a list of n words shares with any similar one that is not shorter."""
    return 1 + n // SHARE


def tokens(t: Tape, size: int) -> np.ndarray:
    if size == 1 or not len(t.words):
        return t.words
    before = np.empty_like(t.words)
    before[1:] = t.words[:-1]
    before[t.first[:-1][np.diff(t.first) > 0]] = _U(7)
    return pair(before, t.words)


def frequencies(docs: DataFrame, plain: Callable, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """A byte for each cell of tokens, and of words: how frequent they are in docs (_th, text), from some SAMPLE of its rows."""
    size = _size(similarity)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(CELLS + WORD_CELLS, np.int32)
        for b in batches:
            for t, _ in tapes(plain(b["text"])):
                held[:CELLS] += np.bincount((tokens(t, size) % _U(CELLS)).astype(np.int64), minlength=CELLS).astype(np.int32)
                held[CELLS:] += np.bincount((t.words % _U(WORD_CELLS)).astype(np.int64), minlength=WORD_CELLS).astype(np.int32)
        cells = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array(cells.astype(np.int32)), pa.array(held[cells].astype(np.int64))], names=["cell", "n"])

    every = max(1, docs.count() // SAMPLE)
    some = docs.where(F.pmod(F.xxhash64("_th"), F.lit(every)) == 0).select("text").mapInArrow(run, "cell int, n long")
    got = some.groupBy("cell").agg(F.sum("n").alias("n")).where("n > 1").toArrow()
    ranks = np.zeros(CELLS + WORD_CELLS, np.uint8)
    ranks[got["cell"].to_numpy()] = np.minimum(255, np.round(10 * np.log2(1 + got["n"].to_numpy())))
    return ranks[:CELLS], ranks[CELLS:]


def keys(t: Tape, ranks: tuple[np.ndarray, np.ndarray], similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """The keys of a tape's rows (below 2 ** 16 rows) and where each row's keys begin."""
    n = np.diff(t.first)
    size = _size(similarity)
    of, of_word = ranks
    token = tokens(t, size)
    word = of_word[(t.words % _U(WORD_CELLS)).astype(np.int64)]
    rank = of[(token % _U(CELLS)).astype(np.int64)].astype(_U)
    row = t.row_of()
    # a row's tokens by rank of the token, then of its last word; of those alike, by hash
    order = (row.astype(_U) << _U(48)) | (rank << _U(40)) | (word.astype(_U) << _U(32)) | (mix(token) >> _U(32))
    order.sort()
    place = np.arange(len(order))
    again = np.append(False, order[1:] == order[:-1]) if len(order) else np.zeros(0, bool)
    nth = place - np.maximum.accumulate(np.where(again, 0, place)) if len(order) else place
    count = np.minimum(n, np.floor(n * (size * (1 - similarity)) + 1e-9).astype(np.int64) + least(n))
    kept = place - t.first[row] < count[row]
    return mix((order[kept] & _LOW48) + nth[kept].astype(_U) * _U(0x9E3779B97F4A7C15)) & _LOW48, np.append(0, np.cumsum(count))


def packed(k: np.ndarray) -> np.ndarray:
    """48-bit keys as six bytes each."""
    return np.ascontiguousarray(k.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6]).reshape(-1)


def signs(t: Tape) -> list[bytes]:
    """For each row the parities of how many of its words fall on each of so many bits: a power of two, four a word or more."""
    out = []
    h = mix(t.words)
    for x, y in zip(t.first[:-1].tolist(), t.first[1:].tolist(), strict=True):
        bits = max(64, 1 << (4 * (y - x) - 1).bit_length())
        odd = np.bincount((h[x:y] & _U(bits - 1)).astype(np.int64), minlength=bits) & 1
        out.append(np.packbits(odd.astype(np.uint8)).tobytes())
    return out


def _flips(x: bytes, y: bytes) -> int:
    """How many parities differ; the longer row of bits is folded, which is what fewer bits would have held."""
    p, q = sorted((np.frombuffer(x, np.uint8), np.frombuffer(y, np.uint8)), key=len)
    return int(np.bitwise_count(p ^ np.bitwise_xor.reduce(q.reshape(-1, len(p)), 0)).sum())


def _likely(similarity: float) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, m = b["_n"].to_numpy(), b["_m"].to_numpy()
            # of k edits at most, |n - m| at least change one parity only
            most = 2 * np.floor(np.maximum(n, m) * (1 - similarity) + 1e-9) - np.abs(n - m)
            flips = [_flips(x, y) for x, y in zip(b["_x"].to_pylist(), b["_y"].to_pylist(), strict=True)]
            yield b.select(["a", "b"]).filter(pa.array(np.array(flips, float) <= most))

    return run


def likely(pairs: DataFrame, signed: DataFrame, similarity: float) -> DataFrame:
    """Those of pairs (a, b) that the parities of signed (node, n, signs) allow; no similar one is turned away."""
    one = pairs.join(signed.select(F.col("node").alias("a"), F.col("n").alias("_n"), F.col("signs").alias("_x")), "a")
    both = one.join(signed.select(F.col("node").alias("b"), F.col("n").alias("_m"), F.col("signs").alias("_y")), "b")
    return both.select("a", "b", "_n", "_m", "_x", "_y").mapInArrow(_likely(similarity), "a long, b long")


def _unpacked(raw: np.ndarray) -> np.ndarray:
    out = np.zeros((len(raw) // 6, 8), np.uint8)
    out[:, :6] = raw.reshape(-1, 6)
    return out.reshape(-1).view("<u8")


def _bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    column = column.cast(pa.large_binary())
    at = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    buf = column.buffers()[2]
    data = np.frombuffer(buf, np.uint8) if buf is not None and buf.size else np.zeros(0, np.uint8)
    return data[at[0] : at[-1]], np.diff(at)


def _dealt(parts: int) -> Callable:
    """Rows (node, root, n, keys) to rows (part, lists, entries): the lists with a key in the part, and (key, list) entries."""

    def flush(held: list) -> Iterator[pa.RecordBatch]:
        node, root, n, key, of = (np.concatenate(x) for x in zip(*held, strict=True))
        part = (key % _U(parts)).astype(np.int64)
        order = np.argsort(part, kind="stable")
        key, of, part = key[order], of[order], part[order]
        cuts = np.flatnonzero(np.append(True, part[1:] != part[:-1]))
        for x, y in zip(cuts.tolist(), [*cuts[1:].tolist(), len(part)], strict=True):
            here, local = np.unique(of[x:y], return_inverse=True)
            lists = np.rec.fromarrays([node[here], root[here], n[here]], dtype=[("node", "<i8"), ("root", "<i8"), ("n", "<i4")]).tobytes()
            entries = np.rec.fromarrays([key[x:y] // _U(parts) & _U(0xFFFFFFFF), local], dtype=[("key", "<u4"), ("of", "<u4")]).tobytes()
            yield pa.RecordBatch.from_arrays([pa.array([int(part[x])], pa.int32()), pa.array([lists], pa.binary()), pa.array([entries], pa.binary())], names=["part", "lists", "entries"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, lists, size = [], 0, 0
        for b in batches:
            if not b.num_rows:
                continue
            raw, lengths = _bytes(b["keys"])
            of = np.repeat(np.arange(lists, lists + b.num_rows), lengths // 6)
            held.append((b["node"].to_numpy(), b["root"].to_numpy(), b["n"].to_numpy(), _unpacked(raw), of))
            lists, size = lists + b.num_rows, size + len(of)
            if size > PORTION:
                yield from flush(held)
                held, lists, size = [], 0, 0
        if size:
            yield from flush(held)

    return run


_LIST = [("node", "<i8"), ("root", "<i8"), ("n", "<i4")]
_COUNTS = ["a", "b", "c", "least"]


def _counted(lists: np.ndarray, key: np.ndarray, of: np.ndarray, similarity: float, crowd: int | None) -> Iterator[tuple[list, list | None]]:
    """([a, b, shared keys, least], None) of the lists of different roots in one part; a pair may come several times, its counts
    add up. Of keys with more than `crowd` pairs ([], [largest class, lists]) instead."""
    node, at = np.unique(lists["node"], return_inverse=True)
    root, n = np.empty(len(node), np.int64), np.empty(len(node), np.int64)
    root[at], n[at] = lists["root"], lists["n"]
    of = at[of]
    order = np.lexsort((of, root[of], key))
    key, of = key[order], of[order]
    new = np.append(True, (key[1:] != key[:-1]) | (of[1:] != of[:-1]))
    key, of = key[new], of[new]
    r = root[of]

    def ends(first: np.ndarray) -> np.ndarray:
        begin = np.flatnonzero(first)
        end = np.append(begin[1:], len(first))
        return np.repeat(end, end - begin)

    bucket = np.append(True, key[1:] != key[:-1])
    start, end = ends(bucket | np.append(True, r[1:] != r[:-1])), ends(bucket)
    if crowd is not None:
        first = np.flatnonzero(bucket)
        many = np.add.reduceat(end - start, first) > crowd
        for x in first[many].tolist():
            y = int(end[x])
            roots, sizes = np.unique(r[x:y], return_counts=True)
            held = np.rec.fromarrays([node[of[x:y]], r[x:y], n[of[x:y]]], dtype=_LIST).tobytes()
            yield [], [int(roots[np.argmax(sizes)]), held]
        start = np.where(np.repeat(many, np.diff(np.append(first, len(key)))), end, start)
    left = np.flatnonzero(end > start)
    left = left[np.argsort(of[left], kind="stable")]  # all pairs of a list in one portion, so far as it holds them
    many = end[left] - start[left]
    total = np.cumsum(many)
    x = 0
    while x < len(left):
        y = max(x + 1, int(np.searchsorted(total, (total[x - 1] if x else 0) + PORTION, "right")))
        m = many[x:y]
        a = of[np.repeat(left[x:y], m)]
        b = of[np.repeat(start[left[x:y]] - (np.cumsum(m) - m), m) + np.arange(m.sum())]
        fits = np.abs(n[a] - n[b]) <= np.floor(np.maximum(n[a], n[b]) * (1 - similarity) + 1e-9)
        a, b = a[fits], b[fits]
        got, c = np.unique(np.minimum(a, b) * len(node) + np.maximum(a, b), return_counts=True)
        a, b = got // len(node), got % len(node)
        yield [node[a], node[b], c.astype(np.int64), least(np.minimum(n[a], n[b]))], None
        x = y


def _meet(similarity: float) -> Callable:
    """Rows (a, b, c, least) of pairs, and (hub, lists) of crowds, the other columns null."""
    names = [*_COUNTS, "hub", "lists"]

    def told(crowds: list) -> pa.RecordBatch:
        none = pa.nulls(len(crowds), pa.int64())
        return pa.RecordBatch.from_arrays([none] * 4 + [pa.array([h for h, _ in crowds], pa.int64()), pa.array([x for _, x in crowds], pa.binary())], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        for b in batches:
            for part, lists, entries in zip(*(b[c].to_pylist() for c in ("part", "lists", "entries")), strict=True):
                held.setdefault(part, []).append((np.frombuffer(lists, _LIST), np.frombuffer(entries, [("key", "<u4"), ("of", "<u4")])))
        while held:
            pieces = held.popitem()[1]
            base = np.cumsum([0, *(len(x) for x, _ in pieces)])
            lists = np.concatenate([x for x, _ in pieces])
            key = np.concatenate([e["key"] for _, e in pieces])
            of = np.concatenate([e["of"].astype(np.int64) + k for (_, e), k in zip(pieces, base, strict=False)])
            crowds = []
            for counts, crowd in _counted(lists, key, of, similarity, CROWD):
                if crowd is not None:
                    crowds.append(crowd)
                    if len(crowds) < 256:
                        continue
                if crowds:
                    yield told(crowds)
                    crowds = []
                if counts:
                    none = [pa.nulls(len(counts[0]), pa.int64()), pa.nulls(len(counts[0]), pa.binary())]
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in counts] + none, names=names)
            if crowds:
                yield told(crowds)

    return run


def _crowds(similarity: float) -> Callable:
    """The pairs of crowds (hub, lists); those of one hub are counted together."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        for b in batches:
            for hub, lists in zip(b["hub"].to_pylist(), b["lists"].to_pylist(), strict=True):
                held.setdefault(hub, []).append(np.frombuffer(lists, _LIST))
        while held:
            pieces = held.popitem()[1]
            lists, of = np.unique(np.concatenate(pieces), return_inverse=True)
            key = np.repeat(np.arange(len(pieces)), [len(x) for x in pieces])
            for counts, _ in _counted(lists, key, of, similarity, None):
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in counts], names=_COUNTS)

    return run


def pairs(rows: DataFrame, similarity: float) -> DataFrame:
    """Pairs (a, b) to verify, a < b, of rows (node, root, n, keys); keys are packed, and a node may come several times."""
    parts = max(1, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    dealt = rows.select("node", "root", "n", "keys").mapInArrow(_dealt(parts), "part int, lists binary, entries binary").repartition(parts, "part")
    kind = "a long, b long, c long, least long"
    met = common.stored(dealt.mapInArrow(_meet(similarity), f"{kind}, hub long, lists binary"))
    crowds = met.where("hub is not null").select("hub", "lists").repartition(parts, "hub").mapInArrow(_crowds(similarity), kind)
    counted = met.where("hub is null").select(*_COUNTS).union(crowds).groupBy("a", "b").agg(F.sum("c").alias("c"), F.max("least").alias("least"))
    out = common.cut(counted.where("c >= least").select("a", "b"))
    common.discard(met)
    return out
