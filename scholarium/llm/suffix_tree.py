"""Language-model scores of documents by a probabilistic suffix tree (Ron, Singer and Tishby 1996) of words.

A state is a context: the empty one, a word, or two words in a row. The empty one has the add-one distribution. A longer
context is a candidate if the training documents hold it LEAST times, and is kept if its next words diverge from what its
longest kept suffix says: count times Kullback-Leibler divergence of at least DIVERGENCE, with the next words that were seen
once as one class. Of a kept context, next words seen twice or more have their counts, and the weight of the others, and PSEUDO
more, goes to the longest kept suffix's distribution, so that each state's sums to one. A word is scored by the longest
kept context that it follows.

All documents are counted, and neither the counts nor the tree is ever in one place. Documents are encoded once, in blocks of about
BLOCK bytes. A block sends each of its distinct words, pairs and later triples once, packed, to the bucket of its hash,
where the blocks' counts meet; the bucket answers each block for what it has sent. So a word or pair that a third of all
text consists of costs one entry a block. Sums of a context's divergence meet in the same way, from each block's share.
Words are told apart by 128 bits of BLAKE2b, pairs and triples by 40 bits within their bucket.
"""

from __future__ import annotations

import hashlib
import io
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scholarium.llm import hashing as H
from scholarium.llm.frames import materialise, partitions

#: Of doc_id's crc32: documents with this remainder are held out.
MODULUS, HELD_OUT = 7, 2
#: Least count of a context, least divergence in nats for each next word that it has counts of, weight for other words.
LEAST, DIVERGENCE, PSEUDO = 16, 6.0, 4.0
BLOCK = 5 << 20
_PARTS = "block long, kind string, bucket int, data binary"
U = np.uint64
#: Stands for the end of a text; no word has a space.
_END = b" "


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays as compressed bytes, each by the places of its bytes, which the compression likes."""
    out = io.BytesIO()
    for x in arrays:
        np.lib.format.write_array(out, np.ascontiguousarray(np.ascontiguousarray(x).view(np.uint8).reshape(len(x), -1).T if len(x) else np.zeros((1, 0), np.uint8)), allow_pickle=False)
    raw = out.getvalue()
    return len(raw).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def unpack(data: bytes, *types: type) -> list[np.ndarray]:
    raw = io.BytesIO(pa.decompress(data[8:], int.from_bytes(data[:8], "little"), codec="zstd", asbytes=True))
    return [np.ascontiguousarray(np.lib.format.read_array(raw, allow_pickle=False).T).reshape(-1).view(t) for t in types]


#: Bits of an n-gram's key, the bucket's number is above them; bytes that a word's and an n-gram's request have, after the key.
KEY_BITS = 40
_ASKED = {"words": (16, [np.uint32]), "pairs": (5, [np.uint32]), "triples": (5, [np.uint32]), "single": (5, [U, np.float32, np.uint32, np.float32, np.float32])}
_ASKED["double"] = _ASKED["single"]


def planes(*arrays: np.ndarray) -> np.ndarray:
    """A column of bytes for each place of the arrays."""
    return np.concatenate([np.ascontiguousarray(x).view(np.uint8).reshape(len(x), x.itemsize) for x in arrays], axis=1).T


def values(rows: np.ndarray, *types: type) -> list[np.ndarray]:
    """Arrays from the rows of bytes that planes has made."""
    out, at = [], 0
    for t in types:
        size = np.dtype(t).itemsize
        out.append(np.ascontiguousarray(rows[at : at + size].T).reshape(-1).view(t) if rows.shape[1] else np.zeros(0, t))
        at += size
    return out


def _rows(data: bytes, width: int) -> np.ndarray:
    return np.frombuffer(data, np.uint8).reshape(width, -1)


def _encoded(docs: DataFrame) -> DataFrame:
    """Blocks as parts with data: doc_ids, tokens of each document, whether it is held out, all tokens as numbers of the
    block's words (most frequent first), and halves of the words' keys. `other` has the other halves."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = TaskContext.get().partitionId() << 32
        for batch in batches:
            data, at = H.utf8(batch.column(1))
            first = 0
            while first < batch.num_rows:
                end = max(first + 1, int(np.searchsorted(at, at[first] + BLOCK, "right")) - 1)
                ids = batch.column(0).slice(first, end - first).to_numpy()
                whole, other = _block(data, at[first : end + 1], ids)
                yield from _parts([(block, "block", 0, whole)]).append_column("other", pa.array([other], pa.binary())).to_batches()
                first, block = end, block + 1

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).where("doc_id is not null").mapInArrow(encode, f"{_PARTS}, other binary")


def _block(data: np.ndarray, at: np.ndarray, ids: np.ndarray) -> tuple[bytes, bytes]:
    h, first, end, doc = H.words(data, at, H.NONSPACE)
    number = H.exact_words(data, at, h, first, end)
    index = np.zeros(int(number.max(initial=-1)) + 1, np.int64)
    index[number[::-1]] = np.arange(len(number))[::-1]
    order = np.argsort(-np.bincount(number, minlength=len(index)), kind="stable")
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order)) + 1  # 0 is the end
    low, index = H.LOWER[data[at[0] : at[-1]]].tobytes(), index[order]
    digest = lambda word: hashlib.blake2b(word, digest_size=16).digest()
    keys = np.frombuffer(b"".join([digest(_END), *[digest(low[a:b]) for a, b in zip(first[index].tolist(), end[index].tolist(), strict=True)]]), U).reshape(-1, 2)
    sizes = np.bincount(doc, minlength=len(ids))
    tokens = np.insert(place[number] if len(number) else np.zeros(0, np.int64), np.cumsum(sizes), 0).astype(np.uint32)
    held = np.array([zlib.crc32(str(i).encode()) % MODULUS == HELD_OUT for i in ids.tolist()], np.uint8)
    return pack(ids.astype(np.int64), (sizes + 1).astype(np.uint32), held, tokens, keys[:, 0].copy()), keys[:, 1].tobytes()


class Block:
    """A block's tokens with what the buckets have answered so far."""

    def __init__(self, data: bytes, buckets: int):
        self.buckets = buckets
        self.ids, self.sizes, self.held, tokens, self.key = unpack(data, np.int64, np.uint32, np.uint8, np.uint32, U)
        self.tokens = tokens.astype(np.int64)
        self.doc = np.repeat(np.arange(len(self.ids)), self.sizes)
        self.train = self.held[self.doc] == 0
        at = np.arange(len(tokens)) - np.repeat(np.cumsum(self.sizes) - self.sizes, self.sizes)
        #: Tokens that follow one word, and two words, of their document.
        self.second, self.third = np.flatnonzero(at > 0), np.flatnonzero(at > 1)

    def _distinct(self, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Distinct n-grams by bucket and key, and the number of each place's."""
        return np.unique(_placed(prints, self.buckets), return_inverse=True)

    def pairs(self) -> None:
        """pair: of each token of `second`, the number of the distinct pair that it ends."""
        self.pair_print = H.mix(self.key[self.tokens[self.second - 1]] * H.FACTORS[0] + self.key[self.tokens[self.second]])
        self.pair_keys, self.pair = self._distinct(self.pair_print)

    def triples(self, count: np.ndarray, least: int) -> None:
        """Of tokens whose context of two words has the least count: the tokens (`ends`), the places in `second` of their
        `context` and `last` pair, and the number of their `triple`. A triple whose last pair was not seen twice was not
        either; it is not asked for, and its number is -1."""
        place = np.zeros(len(self.tokens), np.int64)
        place[self.second] = np.arange(len(self.second))
        before = place[self.third - 1]
        often = count[self.pair[before]] >= least
        self.ends, self.context, self.last = self.third[often], before[often], place[self.third[often]]
        asked = count[self.pair[self.last]] >= 2
        self.triple = np.full(len(self.ends), -1)
        self.triple_keys, self.triple[asked] = self._distinct(H.mix(self.pair_print[self.context[asked]] * H.FACTORS[1] + self.key[self.tokens[self.ends[asked]]]))

    def requests(self, kind: str, keys: np.ndarray, *arrays: np.ndarray) -> Iterator[tuple[int, str, bytes]]:
        """What goes to each bucket of n-grams sorted by bucket and key."""
        asked = np.concatenate([planes(keys)[: KEY_BITS // 8], planes(*arrays)])
        ends = _ends(keys, self.buckets)
        for i in np.flatnonzero(np.diff(ends)).tolist():
            yield i, kind, asked[:, ends[i] : ends[i + 1]].tobytes()

    def words(self, other: bytes) -> Iterator[tuple[int, str, bytes]]:
        """What goes to each bucket of words; answers come in the same order."""
        times = np.bincount(self.tokens[self.train], minlength=len(self.key)).astype(np.uint32)
        order, ends = self.dealt()
        asked = planes(self.key[order], np.frombuffer(other, U)[order], times[order])
        for i in np.flatnonzero(np.diff(ends)).tolist():
            yield i, "words", asked[:, ends[i] : ends[i + 1]].tobytes()

    def dealt(self) -> tuple[np.ndarray, np.ndarray]:
        """The words by their buckets, and where each bucket's begin."""
        bucket = self.key % U(self.buckets)
        order = np.argsort(bucket, kind="stable")
        return order, np.searchsorted(bucket[order], np.arange(self.buckets + 1).astype(U))


def _placed(prints: np.ndarray, buckets: int) -> np.ndarray:
    return (prints % U(buckets) << U(KEY_BITS)) | (prints >> U(64 - KEY_BITS))


def _ends(keys: np.ndarray, buckets: int) -> np.ndarray:
    return np.searchsorted(keys >> U(KEY_BITS), np.arange(buckets + 1).astype(U))


def _meet(bucket: int, kind: str, blocks: list[int], data: list[bytes], divergence: float) -> Iterator[tuple[int, str, int, bytes]]:
    """The answers of a bucket to blocks (in order)."""
    width, types = _ASKED[kind]
    width += sum(np.dtype(t).itemsize for t in types)
    parts = [_rows(x, width) for x in data]
    sizes, rows = [p.shape[1] for p in parts], np.concatenate(parts, axis=1)
    if kind == "words":
        first, second, times = values(rows, U, U, *types)
        order = np.lexsort((second, first))
        fresh = np.ones(len(order), bool)
        fresh[1:] = (first[order][1:] != first[order][:-1]) | (second[order][1:] != second[order][:-1])
        number = np.empty(len(order), np.int64)
        number[order] = np.cumsum(fresh) - 1
        total = np.bincount(number, times).astype(np.int64)
        yield -1, kind, bucket, planes(np.array([total.sum(), (total > 0).sum()])).tobytes()
        answers = [planes(total[n]).tobytes() for n in _split(number, sizes)]
    else:
        keys = np.zeros((8, rows.shape[1]), np.uint8)
        keys[: KEY_BITS // 8] = rows[: KEY_BITS // 8]
        _, number = np.unique(values(keys, U)[0], return_inverse=True)
        n, asked = int(number.max(initial=-1)) + 1, values(rows[KEY_BITS // 8 :], *types)
        if len(types) == 1:
            total = np.bincount(number, asked[0], n).astype(np.int64)
            answers = [np.packbits(total[i] >= 2).tobytes() + planes(total[i][total[i] >= 2]).tobytes() for i in _split(number, sizes)]
        else:
            count = np.zeros(n, np.int64)
            count[number] = asked[0].astype(np.int64)
            kept = _kept(divergence, count, *(np.bincount(number, a, n) for a in asked[1:]))
            answers = [planes(kept[i]).tobytes() for i in _split(number, sizes)]
    yield from ((b, kind, bucket, x) for b, x in zip(blocks, answers, strict=True))


def _split(x: np.ndarray, sizes: list[int]) -> list[np.ndarray]:
    return np.split(x, np.cumsum(sizes)[:-1])


def _kept(divergence: float, count: np.ndarray, gain: np.ndarray, again: np.ndarray, covered: np.ndarray, symbols: np.ndarray) -> np.ndarray:
    """Of contexts: how many of their occurrences have a next word that was seen again, 0 if the context is not kept."""
    rest, left = np.maximum(count - again, 0), np.clip(1 - covered, 1e-9, None)
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = gain + np.where(rest > 0, rest * np.log(rest / np.maximum(count, 1) / left), 0)
    return np.where((again > 0) & (gain >= divergence * symbols), again, 0).astype(np.int64)


def _answers(table: pa.Table, kind: str) -> dict[int, bytes]:
    some = pa.array([i for i, k in enumerate(table.column("kind").to_pylist()) if k == kind], pa.int64())
    return dict(zip(table.column("bucket").take(some).to_pylist(), table.column("data").take(some).to_pylist(), strict=True))


def _sparse(answers: dict[int, bytes], keys: np.ndarray, buckets: int) -> np.ndarray:
    """Counts of distinct n-grams, 0 for those below two."""
    out, ends = np.zeros(len(keys), np.int64), _ends(keys, buckets)
    for i, data in answers.items():
        n = int(ends[i + 1] - ends[i])
        bits = (n + 7) // 8
        out[ends[i] : ends[i + 1]][np.unpackbits(np.frombuffer(data, np.uint8, bits), count=n).astype(bool)] = values(_rows(data[bits:], 8), np.int64)[0]
    return out


class Model:
    """What a block knows of the tree, as far as it has been asked for."""

    def __init__(self, table: pa.Table, buckets: int, total: int, different: int, least: int):
        self.block = block = Block(_answers(table, "block")[0], buckets)
        self.count = np.zeros(len(block.key), np.int64)
        order, ends = block.dealt()
        for i, data in _answers(table, "words").items():
            self.count[order[ends[i] : ends[i + 1]]] = values(_rows(data, 8), np.int64)[0]
        self.root = (self.count + 1) / (total + different + 1)
        block.pairs()
        self.pair_count = _sparse(_answers(table, "pairs"), block.pair_keys, buckets)
        block.triples(self.pair_count, least)
        #: Of the tokens of `second`: the word before, the count of the pair, and the empty context's probability.
        self.before, self.again = block.tokens[block.second - 1], self.pair_count[block.pair]
        self.plain = self.root[block.tokens[block.second]]
        # single words that are candidates, by bucket and key
        self.single = np.unique(self.before)
        self.single = self.single[self.count[self.single] >= least]
        self.single_keys, at = np.unique(_placed(block.key[self.single], buckets), return_index=True)
        self.single = self.single[at]

    def first(self, table: pa.Table) -> None:
        """q: of the tokens of `second`, the probability by the longest kept context of one word at most."""
        kept = np.zeros(len(self.block.key), np.int64)
        kept[self.single] = _dense(_answers(table, "single"), self.single_keys, self.block.buckets)
        c, n = self.count[self.before], kept[self.before]
        self.q = np.where(n > 0, (self.again + (c - n + PSEUDO) * self.plain) / (c + PSEUDO), self.plain)
        self.triple_count = np.append(_sparse(_answers(table, "triples"), self.block.triple_keys, self.block.buckets), 0)  # the last: of -1
        self.double, self.of = np.unique(self.block.pair[self.block.context], return_inverse=True)

    def scores(self, table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        """log10 of each token's probability, in the empty context and in the longest kept one."""
        block = self.block
        kept = _dense(_answers(table, "double"), block.pair_keys[self.double], block.buckets)
        base = np.log10(self.root)[block.tokens]
        best = base.copy()
        best[block.second] = np.log10(self.q)
        c, n = self.pair_count[block.pair[block.context]], kept[self.of]
        p = (self.triple_count[block.triple] + (c - n + PSEUDO) * self.q[block.last]) / (c + PSEUDO)
        best[block.ends[n > 0]] = np.log10(p[n > 0])
        return base, best


def _dense(answers: dict[int, bytes], keys: np.ndarray, buckets: int) -> np.ndarray:
    out, ends = np.zeros(len(keys), np.int64), _ends(keys, buckets)
    for i, data in answers.items():
        out[ends[i] : ends[i + 1]] = values(_rows(data, 8), np.int64)[0]
    return out


def _shares(context: np.ndarray, n: int, count: np.ndarray, total: np.ndarray, p: np.ndarray, train: np.ndarray) -> tuple[np.ndarray, ...]:
    """A block's share of the sums of n contexts, from its training tokens: of each its context, its n-gram's
    count, the context's count and the suffix's probability. Gains, occurrences, suffix's probability, different words."""
    some = train & (count >= 2)
    context, count, total, p = context[some], count[some], total[some], p[some]
    add = lambda w: np.bincount(context, w, n)
    return add(np.log(count / total / p)).astype(np.float32), np.bincount(context, minlength=n).astype(np.uint32), add(p / count).astype(np.float32), add(1 / count).astype(np.float32)


def _exchange(requests: DataFrame, n: int, divergence: float) -> DataFrame:
    """Parts of answers to parts of requests."""

    def meet(table: pa.Table) -> pa.Table:
        order = np.argsort(table.column("block").to_numpy(), kind="stable")
        blocks, kinds, data = (table.column(c).take(pa.array(order)).to_pylist() for c in ("block", "kind", "data"))
        bucket, rows = table.column("bucket")[0].as_py(), []
        for kind in sorted(set(kinds)):
            some = [i for i, k in enumerate(kinds) if k == kind]
            rows += _meet(bucket, kind, [blocks[i] for i in some], [data[i] for i in some], divergence)
        return _parts(rows)

    return materialise(requests.repartition(n, "bucket").groupBy("bucket").applyInArrow(meet, _PARTS), tidy=True)


def _parts(rows: list[tuple[int, str, int, bytes]]) -> pa.Table:
    types = (pa.int64(), pa.string(), pa.int32(), pa.binary())
    return pa.table([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [()] * 4, types, strict=True)], names=["block", "kind", "bucket", "data"])


def score_texts(docs: DataFrame, least: int = LEAST, divergence: float = DIVERGENCE) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every row of docs (doc_id, text).

    Tokens are runs of anything but ASCII white space, with A-Z in lower case, and one end of each text; a null text is
    empty. Documents are held out by the crc32 of their doc_id, and all others are learned from, whole and as often as they
    occur. base_score sums log10 of add-one probabilities, score those of the tree. Rows without doc_id are left out and
    not learned from; rows that repeat one are each scored. Contexts do not cross texts. An empty table gives an
    empty one; without training texts both scores are 0. Other columns are ignored.
    """
    blocks = materialise(_encoded(docs))
    size = blocks.agg(F.coalesce(F.sum(F.length("data")), F.lit(0))).first()[0]
    n = partitions(docs, size, 16 << 20)
    buckets = min(4 * n, 1 << (64 - KEY_BITS))

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, data, other in zip(batch.column(0).to_pylist(), batch.column(3), batch.column(4), strict=True):
                block = Block(data.as_py(), buckets)
                block.pairs()
                times = np.bincount(block.pair[block.train[block.second]], minlength=len(block.pair_keys)).astype(np.uint32)
                rows = [*block.words(other.as_py()), *block.requests("pairs", block.pair_keys, times)]
                yield from _parts([(at, kind, i, x) for i, kind, x in rows]).to_batches()

    def step(rows: list[DataFrame], work: Callable[[pa.Table], pa.Table], schema: str) -> DataFrame:
        parts = rows[0]
        for more in rows[1:]:
            parts = parts.unionByName(more)
        return parts.where("block >= 0").repartition(n, "block").groupBy("block").applyInArrow(work, schema)

    known = [blocks.drop("other"), _exchange(blocks.mapInArrow(ask, _PARTS), n, divergence)]
    total = different = 0
    for row in known[1].where("block < 0").toLocalIterator():  # one a bucket
        a, b = values(_rows(bytes(row.data), 8), np.int64)[0].tolist()
        total, different = total + a, different + b

    def singles(table: pa.Table) -> pa.Table:
        m = Model(table, buckets, total, different, least)
        place = np.full(len(m.block.key), -1)
        place[m.single] = np.arange(len(m.single))
        context = place[m.before]
        some = context >= 0
        sums = _shares(context[some], len(m.single), m.again[some], m.count[m.before[some]], m.plain[some], m.block.train[m.block.second][some])
        times = np.bincount(m.block.triple[m.block.train[m.block.ends] & (m.block.triple >= 0)], minlength=len(m.block.triple_keys)).astype(np.uint32)
        rows = [*m.block.requests("single", m.single_keys, m.count[m.single].astype(U), *sums), *m.block.requests("triples", m.block.triple_keys, times)]
        at = table.column("block")[0].as_py()
        return _parts([(at, kind, i, x) for i, kind, x in rows])

    def doubles(table: pa.Table) -> pa.Table:
        m = Model(table, buckets, total, different, least)
        m.first(table)
        b = m.block
        sums = _shares(m.of, len(m.double), m.triple_count[b.triple], m.pair_count[b.pair[b.context]], m.q[b.last], b.train[b.ends])
        at = table.column("block")[0].as_py()
        return _parts([(at, kind, i, x) for i, kind, x in b.requests("double", b.pair_keys[m.double], m.pair_count[m.double].astype(U), *sums)])

    def final(table: pa.Table) -> pa.Table:
        m = Model(table, buckets, total, different, least)
        m.first(table)
        base, best = m.scores(table)
        b = m.block
        of = lambda w: np.bincount(b.doc, w, len(b.ids))
        return pa.table({"doc_id": b.ids, "held_out": b.held.astype(bool), "n_tokens": b.sizes.astype(np.int64), "n_known": of(m.count[b.tokens] > 0).astype(np.int64), "train_tokens": np.full(len(b.ids), total), "base_score": of(base), "score": of(best)})

    for work in (singles, doubles):
        known.append(_exchange(step(known, work, _PARTS), n, divergence))
    return step(known, final, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")

