"""Packing documents into windows by lexical retrieval over sharded BM25 indexes."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docframe.llm.common import text_of
from docframe.llm.shingles import mix, text_words

SCHEMA = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"
#: Words are told apart by so many bits of their hashes in the corpus's counts, which thus have a fixed size.
BITS = 18
#: Rows of the counts that stand for the documents and the words of the corpus.
_DOCS, _WORDS = -1, -2
_LAST = np.iinfo(np.int64).max


@dataclass(frozen=True)
class Packing:
    """tokenizer: the path of a tokenizers file; None for the public word_bpe_49k.json. A shard has at most shard_docs
    documents and about shard_bytes of text."""

    window: int = 4096
    end_id: int = 2
    tokenizer: str | None = None
    shard_docs: int = 1024
    shard_bytes: int = 3 << 20
    k1: float = 1.2
    b: float = 0.75


@dataclass(frozen=True)
class Corpus:
    """Of the whole corpus: the documents of each word (by BITS of its hash), the documents and their mean length."""

    df: np.ndarray
    docs: int
    mean: float


class Index:
    """BM25 over the words of a shard's documents, with the corpus's counts."""

    def __init__(self, texts: pa.Array, corpus: Corpus, packing: Packing):
        found = list(text_words(texts, BITS))
        doc, word, times = (np.concatenate([x[k] for x in found]) if found else np.zeros(0, np.int64) for k in range(3))
        self.n = len(texts)
        size = np.bincount(doc, weights=times, minlength=self.n)
        norm = packing.k1 * (1 - packing.b + packing.b * size / max(1.0, corpus.mean))
        df = np.maximum(corpus.df[word], 1)
        idf = np.log1p(np.maximum(corpus.docs - df, 0) / (df + 0.5))
        weight = idf * times * (packing.k1 + 1) / (times + norm[doc])
        order = np.argsort(word, kind="stable")
        self.word, self.owner, self.weight = word[order], doc[order], weight[order]
        # where each entry's postings begin and end
        edges = np.flatnonzero(np.diff(self.word, prepend=-1, append=-1))
        run = np.repeat(np.arange(len(edges) - 1), np.diff(edges))
        self.first, self.last = np.empty(len(word), np.int64), np.empty(len(word), np.int64)
        self.first[order], self.last[order] = edges[run], edges[run + 1]
        self.own = np.searchsorted(doc, np.arange(self.n + 1))

    def neighbours(self, seed: int) -> np.ndarray:
        """The other documents that share a word with the seed, the best first."""
        first, last = (x[self.own[seed] : self.own[seed + 1]] for x in (self.first, self.last))
        size = last - first
        at = np.repeat(first - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
        score = np.bincount(self.owner[at], weights=self.weight[at], minlength=self.n)
        score[seed] = 0
        found = np.flatnonzero(score > 0)
        return found[np.argsort(-score[found], kind="stable")]


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The documents of each word that a task has."""
    df, docs, words = np.zeros(1 << BITS, np.int64), 0, 0
    for batch in batches:
        docs += batch.num_rows
        for _, word, times in text_words(batch.column(0), BITS):
            words += int(times.sum())
            df += np.bincount(word, minlength=1 << BITS)
    some = np.flatnonzero(df)
    yield pa.RecordBatch.from_arrays([pa.array(np.append(some, [_DOCS, _WORDS])), pa.array(np.append(df[some], [docs, words]))], ["word", "n"])


def corpus_counts(texts: DataFrame, text_col: str = "text") -> Corpus:
    """Counts over all documents; what comes to the driver has at most 2 ** BITS + 2 rows, whatever the corpus."""
    rows = texts.select(text_col).mapInArrow(_counted, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")).toArrow()
    word, n = rows.column("word").to_numpy(), rows.column("n").to_numpy()
    df = np.zeros(1 << BITS, np.int64)
    df[word[word >= 0]] = n[word >= 0]
    docs, words = int(n[word == _DOCS].sum()), int(n[word == _WORDS].sum())
    return Corpus(df, docs, words / max(1, docs))


def _dealt(packing: Packing, corpus):
    """Rows (doc_id, text, deal, one, two): one and two are the rarest words of a document that others have as well."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df = corpus.value.df
        # words that are met once fall into all places alike, so that many a place has about as many as the mean
        floor = 1 + 2 * int(df.sum() // len(df))
        for batch in batches:
            h = batch.column(2).to_numpy()
            one, two = np.full(batch.num_rows, -1, np.int64), np.full(batch.num_rows, -1, np.int64)
            for doc, word, _ in text_words(batch.column(1), BITS):
                if not len(doc):
                    continue
                rank = np.where(df[word] > floor, df[word] << BITS | word, _LAST)
                begins = np.flatnonzero(np.diff(doc, prepend=-1))
                own = doc[begins]
                for out in (one, two):
                    least = np.minimum.reduceat(rank, begins)
                    out[own] = np.where(least < _LAST, least, -1)
                    rank[rank == np.repeat(least, np.diff(begins, append=len(doc)))] = _LAST
            parts = lambda x: -(-(x >> BITS) // packing.shard_docs)
            # what shares its rarest word is about one shard; more are dealt by the next one, copies of one text by the id
            some, both = one >= 0, two >= 0
            by_word = np.where(both, mix(two.view(np.uint64)) % np.maximum(1, parts(one)).view(np.uint64), 0)
            by_id = mix(h.view(np.uint64)) % np.maximum(1, np.where(both, np.minimum(parts(one), parts(two)), parts(one))).view(np.uint64)
            deal = mix(mix(mix(one.view(np.uint64)) + by_word.astype(np.uint64)) + by_id)
            deal = np.where(some, deal, mix(h.view(np.uint64)))
            cols = [batch.column(0), batch.column(1), batch.column(2), pa.array(deal.view(np.int64)), pa.array(one), pa.array(two)]
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "text", "h", "deal", "one", "two"])

    return run


class _Window:
    """The sequence that is being filled, and the rows of those that are full."""

    def __init__(self, packing: Packing, first_id: int):
        self.size, self.next_id = packing.window, first_id
        self.pieces: list[tuple] = []
        self.used = 0
        self.rows: list[tuple] = []

    def close(self) -> None:
        offset = 0
        for doc_id, raw, start, length in self.pieces:
            self.rows.append((doc_id, start, length, raw[4 * start : 4 * (start + length)], len(raw) // 4, self.next_id, offset))
            offset += length
        self.pieces, self.used = [], 0
        self.next_id += 1

    def add(self, doc_id, raw: bytes) -> bool:
        """Puts a document in, through as many windows as it takes; whether a window was closed."""
        total, start, closed = len(raw) // 4, 0, False
        while start < total:
            length = min(total - start, self.size - self.used)
            self.pieces.append((doc_id, raw, start, length))
            start, self.used = start + length, self.used + length
            if self.used == self.size:
                self.close()
                closed = True
        return closed

    def finish(self) -> None:
        """Cuts the last window's rest into sequences of powers of two, so that nothing is padded."""
        rest, left = self.pieces, self.used
        self.pieces, self.used = [], 0
        while left:
            size = 1 << (left.bit_length() - 1)
            need = size
            while need:
                doc_id, raw, start, length = rest.pop(0)
                take = min(need, length)
                self.pieces.append((doc_id, raw, start, take))
                if take < length:
                    rest.insert(0, (doc_id, raw, start + take, length - take))
                need -= take
            self.close()
            left -= size


def _fill(ids: list, raws: list[bytes], index: Index, window: _Window) -> None:
    """Greedy: a seed, then its unused neighbours, until a window is full; then the next seed. A document that is cut
    goes on in the next window and is its seed."""
    free = np.ones(len(raws), bool)
    at, seed = 0, -1
    while True:
        if seed < 0:
            while at < len(raws) and not free[at]:
                at += 1
            if at == len(raws):
                return
            seed, free[at] = at, False
            window.add(ids[seed], raws[seed])
        new_seed = -1
        for j in index.neighbours(seed):
            if free[j]:
                free[j] = False
                if window.add(ids[j], raws[j]):
                    new_seed = j if window.used else -1
                    break
        seed = new_seed


def shards(batches: Iterator[pa.RecordBatch], packing: Packing) -> Iterator[tuple[list, pa.Array]]:
    """(ids, texts) of the runs of rows (doc_id, text) that share an index."""
    ids, texts, held = [], [], 0
    for batch in batches:
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            ids.append(doc_id)
            texts.append(text.as_py())
            held += len(texts[-1])
            if held >= packing.shard_bytes or len(texts) >= packing.shard_docs:
                yield ids, pa.array(texts, pa.large_string())
                ids, texts, held = [], [], 0
    if texts:
        yield ids, pa.array(texts, pa.large_string())


def _packed(packing: Packing, corpus):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path = packing.tokenizer
        if path is None:
            import public_tokenizers

            path = public_tokenizers.path("word_bpe_49k.json")
        tokens, end = _tokens(path), np.array([packing.end_id], "<u4").tobytes()
        window = _Window(packing, TaskContext.get().partitionId() << 40)

        def flush() -> pa.RecordBatch:
            cols = list(zip(*window.rows, strict=True)) if window.rows else [[]] * 7
            window.rows = []
            types = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"])

        for ids, texts in shards(batches, packing):
            offsets = np.frombuffer(texts.buffers()[1], np.int64)[: len(texts) + 1]
            found, edges = tokens.encode(np.frombuffer(texts.buffers()[2] or b"", np.uint8)[: offsets[-1]], offsets)
            raw = found.tobytes()
            raws = [raw[4 * a : 4 * z] + end for a, z in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)]
            _fill(ids, raws, Index(texts, corpus.value, packing), window)
            yield flush()
        window.finish()
        yield flush()

    return run


_loaded: dict = {}


def _tokens(path: str):
    """A Python worker keeps its tokenizer from task to task."""
    from docframe.llm.tokens import BlockTokens

    if path not in _loaded:
        _loaded[path] = BlockTokens(path)
    return _loaded[path]


def dealt(docs: DataFrame, corpus, *, id_col: str = "doc_id", text_col: str = "text", packing: Packing = Packing()) -> DataFrame:
    """Rows (doc_id, text) as they are packed: documents that share their rarest words in one task, one after another."""
    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text"))
    keyed = src.withColumn("h", F.xxhash64("doc_id", "text")).mapInArrow(_dealt(packing, corpus), "doc_id long, text string, h long, deal long, one long, two long")
    return keyed.repartition("deal").sortWithinPartitions("one", "two", "deal", "h", "doc_id").select("doc_id", "text")


def pack(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", packing: Packing = Packing()) -> DataFrame:
    """One row per piece: doc_id, start, length, ids (little-endian unsigned 32-bit), doc_tokens, sequence_id, offset.

    The documents of each word are counted over the whole corpus, in a table of fixed size. Documents are dealt out by
    their rarest word that others have as well, so that those a seed would retrieve are near it: where more than a shard
    share it, also by the next rarest, and copies of one text by a hash of the row, so that neither a source nor a group
    of copies meets in one task. In the order of these words every shard_docs documents (or shard_bytes of text) make a
    shard with an inverted index of its own, scored by BM25 with the corpus's counts, so that a task's memory doesn't
    grow with the data. What is left of the last window goes on into the next shard; at the end of a task it is cut into
    powers of two.

    Defined results: null text counts as empty: the end id alone; a null id is carried along; repeated rows are packed
    each; no rows give no rows; other columns are not read. Texts of any length are packed whole.
    """
    corpus = docs.sparkSession.sparkContext.broadcast(corpus_counts(docs.select(text_of(text_col).alias("text"))))
    rows = dealt(docs, corpus, id_col=id_col, text_col=text_col, packing=packing)
    return rows.mapInArrow(_packed(packing, corpus), SCHEMA)
