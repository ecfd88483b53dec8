"""Repeated passages by collinear chaining of shared k-mer seeds."""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docframe.llm.common import arrow_rows, bounded, discard, text_of, written
from docframe.llm.shingles import blocks, run_hashes, window_hashes, word_ends, word_hashes


@dataclass(frozen=True)
class Passages:
    """k words make a seed; of `spread` seeds in a row at least one is kept (the least hash), so that any k + spread - 1
    equal words share one. gap: cost of each word between seeds, on either side, against k for a seed. A passage has
    least_words on both sides, and least_percent of the longer side's words match. Of a document that more than hot_rows
    chains refer to, a task has about hot_rows at most."""

    k: int = 5
    spread: int = 10
    gap: float = 0.025
    least_words: int = 50
    least_percent: int = 75
    drop: int = 8
    hot_rows: int = 256


def _seeds(passages: Passages):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, data, bounds in blocks(batch.column(1)):
                hashes, starts, _ = word_hashes(data, bounds)
                runs = window_hashes(hashes, passages.k)
                n = len(runs) - passages.spread + 1
                if len(runs) == 0:
                    continue
                if n > 0:
                    views = np.lib.stride_tricks.sliding_window_view(runs, passages.spread)
                    kept = np.unique(np.arange(n) + views.argmin(axis=1))
                else:
                    kept = np.array([int(runs.argmin())])
                owner = np.searchsorted(starts, kept, side="right") - 1
                inside = kept + passages.k <= starts[np.minimum(owner + 1, len(starts) - 1)]
                kept, owner = kept[inside], owner[inside]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(runs[kept].view(np.int64)), batch.column(0).take(pa.array(owner + at)), pa.array((kept - starts[owner]).astype(np.int32))], ["seed", "doc", "pos"]
                )

    return run


class _Fenwick:
    """Prefix maxima."""

    def __init__(self, n: int):
        self.best = [(float("-inf"), -1)] * (n + 1)

    def raise_to(self, i: int, value: tuple[float, int]) -> None:
        i += 1
        while i < len(self.best):
            if value > self.best[i]:
                self.best[i] = value
            i += i & -i

    def below(self, i: int) -> tuple[float, int]:
        found = (float("-inf"), -1)
        while i > 0:
            if self.best[i] > found:
                found = self.best[i]
            i -= i & -i
        return found


def chains(anchors: list[tuple[int, int]], passages: Passages) -> list[list[tuple[int, int]]]:
    """Best chains first: anchors (pos, ref pos) that rise on both sides, each in one chain at most. An anchor adds k to
    the score, the words passed on both sides cost `gap` each."""
    anchors = sorted(set(anchors))
    ranks = sorted({r for _, r in anchors})
    tree, score, prior = _Fenwick(len(ranks)), [0.0] * len(anchors), [-1] * len(anchors)
    waiting: list[tuple[int, tuple[float, int]]] = []
    last = None
    for i, (p, r) in enumerate(anchors):
        if p != last:  # anchors at one place don't follow one another
            for rank, value in waiting:
                tree.raise_to(rank, value)
            waiting, last = [], p
        rank = bisect_left(ranks, r)
        found, j = tree.below(rank)
        gained = found - passages.gap * (p + r)
        score[i] = passages.k + max(0.0, gained)
        prior[i] = j if gained > 0 else -1
        waiting.append((rank, (score[i] + passages.gap * (p + r), i)))
    used, out = [False] * len(anchors), []
    for i in sorted(range(len(anchors)), key=lambda i: -score[i]):
        chain, at = [], i
        while at >= 0 and not used[at]:
            used[at] = True
            chain.append(anchors[at])
            at = prior[at]
        if chain:
            out.append(chain[::-1])
    return out


def _regions(places: list[int], passages: Passages) -> tuple[list[int], list[int]]:
    """Where the words of shared seeds at most `spread` apart begin and end, widened by what a window can hold besides
    its seeds: any least_words equal words lie in one of them on both sides."""
    starts, ends, room = [], [], passages.spread - 1
    first = last = None
    for p in [*places, None]:
        if first is not None and (p is None or p - last > passages.spread):
            if last + passages.k - first + 2 * room >= passages.least_words:
                starts.append(max(0, first - room))
                ends.append(last + passages.k + room)
            first = None
        first, last = p if first is None else first, p
    return starts, ends


def _chained(passages: Passages):
    """A document's chains, and its regions in a row without rdoc."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for doc, matches in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                by_ref: dict[int, list[tuple[int, int]]] = {}
                for m in matches:
                    if m["rdoc"] != doc:
                        by_ref.setdefault(m["rdoc"], []).append((m["pos"], m["rpos"]))
                starts, ends = _regions(sorted({m["pos"] for m in matches}), passages)
                if starts:
                    rows.append((doc, None, starts, ends))
                for ref, anchors in by_ref.items():
                    if len(anchors) < 2:
                        continue
                    for chain in chains(anchors, passages):
                        # what the ends can still grow by is less than one step between seeds on each side
                        room = 2 * (passages.spread + passages.k)
                        if len(chain) > 1 and chain[-1][0] - chain[0][0] + passages.k + room >= passages.least_words:
                            rows.append((doc, ref, [p for p, _ in chain], [r for _, r in chain]))
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 4
            types = [pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int32())]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], ["doc", "rdoc", "at", "rat"])

    return run


def _words(text: str) -> tuple[list[bytes], bytes]:
    raw = text.encode()
    return raw.lower().split(), raw


def _matches(a: list, b: list) -> int:
    """Most words in common order of two short lists."""
    if a == b:
        return len(a)
    if not a or not b:
        return 0
    row = [0] * (len(b) + 1)
    for x in a:
        left = 0
        for j, y in enumerate(b):
            up = row[j + 1]
            row[j + 1] = left + 1 if x == y else max(up, row[j])
            left = up
    return row[-1]


def _grown(a: list, b: list, i: int, j: int, step: int, drop: int) -> tuple[int, int]:
    """How far (words, matches) equal places go on from (i, j): up to the last match before the score falls by `drop`."""
    best = at = score = hits = best_hits = 0
    top = 0
    while 0 <= i < len(a) and 0 <= j < len(b) and score > top - drop:
        at += 1
        same = a[i] == b[j]
        hits += same
        score += 1 if same else -2
        if same and score > top:
            top, best, best_hits = score, at, hits
        i, j = i + step, j + step
    return best, best_hits


def _accepted(words: list, ref: list, at: list[int], rat: list[int], passages: Passages) -> list[tuple[int, int, int, int, int, list]]:
    """The passages (first, last, first and last of ref, matches, stretches of equal words) of a chain: the whole of it if that is equal enough,
    else those of its parts before and after the step with the most unequal words."""
    k, steps = passages.k, []
    for p, q, p2, q2 in zip(at, rat, at[1:], rat[1:], strict=False):
        if p2 - p == q2 - q and words[p:p2] == ref[q:q2]:
            steps.append((p2 - p, 0))
        else:
            step = min(k, p2 - p, q2 - q)
            hits = step + _matches(words[p + step : p2], ref[q + step : q2])
            steps.append((hits, max(p2 - p, q2 - q) - hits))
    out, todo = [], [(0, len(at) - 1)]
    while todo:
        a, z = todo.pop()
        left, more_left = _grown(words, ref, at[a] - 1, rat[a] - 1, -1, passages.drop)
        right, more_right = _grown(words, ref, at[z] + k, rat[z] + k, 1, passages.drop)
        hits = more_left + sum(h for h, _ in steps[a:z]) + k + more_right
        first, last, ref_first, ref_last = at[a] - left, at[z] + k + right, rat[a] - left, rat[z] + k + right
        n, n_ref = last - first, ref_last - ref_first
        if min(n, n_ref) >= passages.least_words and 100 * hits >= passages.least_percent * max(n, n_ref):
            exact, begin = [], a
            for i in range(a, z + 1):
                if i == z or steps[i][1]:
                    exact.append((at[begin], at[i] + k))
                    begin = i + 1
            out.append((first, last, ref_first, ref_last, hits, exact))
        elif a < z and max(n, n_ref) >= passages.least_words:
            cut = max(range(a, z), key=lambda i: (steps[i][1], -i))
            if steps[cut][1]:
                todo += [(cut + 1, z), (a, cut)]
    return out


def _aligned(passages: Passages):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            text_of_doc, words, raw = None, [], b""
            for r in batch.to_pylist():
                if r["text"] is not text_of_doc:
                    text_of_doc = r["text"]
                    words, raw = _words(text_of_doc)
                ref, k, base = r["ref"].encode().lower().split(), passages.k, r["rfrom"]
                at, rat = r["at"], [x - base for x in r["rat"]]
                for first, last, ref_first, ref_last, hits, exact in _accepted(words, ref, at, rat, passages):
                    n, n_ref = last - first, ref_last - ref_first
                    rows.append((r["doc"], r["rdoc"], first, n, ref_first + base, n_ref, hits / max(n, n_ref), *_offsets(raw, first, last), [a for a, _ in exact], [z for _, z in exact]))
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 11
            types = [pa.int64()] * 6 + [pa.float64()] + [pa.int64()] * 2 + [pa.list_(pa.int32())] * 2
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], [*(c.split()[0] for c in SCHEMA.split(", ")), "exact", "exact_end"])

    return run


SCHEMA = "doc_id long, other_id long, start_word long, n_words long, other_start_word long, other_n_words long, similarity double, start_char long, end_char long"


def _offsets(raw: bytes, first: int, last: int) -> tuple[int, int]:
    """Code points at which the words from first to before last begin and end."""
    data = np.frombuffer(raw, np.uint8)
    _, _, starts = word_hashes(data, np.array([0, len(data)]))
    a, z = int(starts[first]), int(starts[last - 1])
    end = z + len(raw[z:].split(None, 1)[0])
    before = len(raw[:a].decode())
    return before, before + len(raw[a:end].decode())


WINDOWS = "doc_id long, start_word long, start_char long, end_char long, hash long"


def _windowed(passages: Passages):
    """A hash of each least_words words in a document's regions, but for those within a stretch that equals a smaller
    document's: that one has them, or one that is smaller still."""
    size = passages.least_words

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc, starts, ends, exact, exact_end, text in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                data = np.frombuffer(text.encode(), np.uint8)
                hashes, _, begins = word_hashes(data, np.array([0, len(data)]))
                chars = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
                begin, end = chars[begins], chars[word_ends(data)]
                reach = np.zeros(len(hashes) + 1, np.int64)
                for a, z in zip(exact or (), exact_end or (), strict=True):
                    reach[a] = max(reach[a], z)
                reach = np.maximum.accumulate(reach)
                for a, z in zip(starts, ends, strict=True):
                    found = run_hashes(hashes[a:z], size).view(np.int64)
                    at = a + np.arange(len(found))
                    new = reach[at] < at + size
                    at, found = at[new], found[new]
                    if len(found):
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(np.full(len(found), doc)), pa.array(at), pa.array(begin[at]), pa.array(end[at + size - 1]), pa.array(found)], [c.split()[0] for c in WINDOWS.split(", ")]
                        )

    return run


def uncovered(spans: list[tuple[int, int]], pos: np.ndarray, ref: np.ndarray, rpos: np.ndarray, size: int) -> list[tuple[int, int]]:
    """Of a document's windows of `size` words (at pos, rising, with their first place) the runs (first and last index)
    that spans (first word, end) leave uncovered: after them each window's words lie in a span or run at one of the
    window's places at least, and each word of a window lies in one."""
    breaks = np.flatnonzero((np.diff(pos) != 1) | (np.diff(ref) != 0) | (np.diff(rpos) != 1)) + 1
    firsts, lasts = np.concatenate([[0], breaks]), np.concatenate([breaks, [len(pos)]]) - 1
    covered, reach = np.zeros(int(pos[-1]) + size + 1, bool), np.zeros(int(pos[-1]) + 1, np.int64)
    for a, z in spans:
        covered[a:z] = True
        if a < len(reach):
            reach[a] = max(reach[a], z)
    whole = np.maximum.accumulate(reach)[pos] >= pos + size
    places = list(zip(ref.tolist(), rpos.tolist(), strict=True))
    seen, out = {places[i] for i in np.flatnonzero(whole)}, []
    for a, z in zip(firsts.tolist(), lasts.tolist(), strict=True):
        own = places[a : z + 1]
        if not seen.issuperset(own):
            seen.update(own)
            covered[pos[a] : pos[z] + size] = True
            out.append((a, z))
    ends = np.zeros(len(covered) + 1, np.int64)  # how many windows are open at each word
    ends[pos] += 1
    ends[pos + size] -= 1
    need = np.flatnonzero((np.cumsum(ends)[:-1] > 0) & ~covered)
    at = 0
    while at < len(need):
        i = int(np.searchsorted(pos, need[at], side="right")) - 1
        run = int(np.searchsorted(firsts, i, side="right")) - 1
        out.append((int(firsts[run]), int(lasts[run])))
        at = int(np.searchsorted(need, pos[lasts[run]] + size))
    return out


def _settled(passages: Passages):
    """The equal runs that a document's aligned passages leave uncovered."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["start_word", "start_char", "end_char", "rdoc", "rpos"]
        for batch in batches:
            rows: list[tuple] = []
            for doc, windows, spans in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist(), strict=True):
                held = windows.values
                pos, a_char, z_char, ref, rpos = (held.field(held.type.get_field_index(c)).to_numpy() for c in names)
                _, kept = np.unique(pos, return_index=True)
                pos, a_char, z_char, ref, rpos = pos[kept], a_char[kept], z_char[kept], ref[kept], rpos[kept]
                for a, z in uncovered([(x["start_word"], x["end_word"]) for x in spans or []], pos, ref, rpos, passages.least_words):
                    n = pos[z] - pos[a] + passages.least_words
                    rows.append((doc, ref[a], pos[a], n, rpos[a], n, 1.0, a_char[a], z_char[z]))
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 9
            types = [pa.int64()] * 6 + [pa.float64()] + [pa.int64()] * 2
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], [c.split()[0] for c in SCHEMA.split(", ")])

    return run


def repeats(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", passages: Passages = Passages()) -> DataFrame:
    """One row for each passage of a document that another document (of a smaller id) has too: see SCHEMA. Words and
    code points count from 0; end_char is exclusive; of three documents with a passage the two later ones have rows.

    Each seed's first place (smallest id, then position) is what its other places are matched with, so that a passage of
    n documents has n - 1 matches, not all pairs. A document's matches are gathered in its own row, bounded by its
    length, chained for each other document by a Fenwick tree, and chains are aligned word by word between their seeds
    and outwards from their ends; one that isn't equal enough is split.

    What that leaves is matched exactly: each run of least_words words among shared seeds is hashed, and a run that lies
    in no passage yet is matched with its first place, whichever document that is in. So the text of every least_words
    equal words, and each of their words, lies in a row of every document but the first that has them. Passages without
    least_words equal words in a row are found by their seeds' first places alone.

    Defined results: null text, and texts with fewer than least_words words, have no passages; a row of null id has
    none; rows of one id are one document; texts are compared with A-Z lowered; no rows give no rows; other columns are
    not read.
    """
    texts = docs.select(F.col(id_col).cast("long").alias("id"), text_of(text_col).alias("text")).where("id is not null")
    seeds = texts.mapInArrow(_seeds(passages), "seed long, doc long, pos int")
    first = seeds.groupBy("seed").agg(F.min(F.struct("doc", "pos")).alias("first"), F.max("doc").alias("last")).where("first.doc <> last")
    # written, so that the join has exchanges of its own on both sides and a hot seed's rows can be split among tasks
    first = written(first.select("seed", F.col("first.doc").alias("rdoc"), F.col("first.pos").alias("rpos")))
    gathered = seeds.join(first, "seed").groupBy("doc").agg(F.collect_list(F.struct("rdoc", "pos", "rpos")).alias("matches"))
    chained = written(gathered.mapInArrow(_chained(passages), "doc long, rdoc long, at array<int>, rat array<int>"))
    dealt = texts.repartition("id")  # one exchange of the texts, read from both sides
    room = passages.least_words
    start = F.greatest(F.element_at("rat", 1) - room, F.lit(0))
    inner = F.split(F.trim(F.col("text"), F.lit(" \t\n\x0b\f\r")), r"[\x20\x09-\x0D]+")
    cut = F.array_join(F.slice(inner, start + 1, F.element_at("rat", -1) + passages.k + room - start), " ")
    matched = chained.where("rdoc is not null")
    # documents that many others are matched with are dealt to several tasks, and their texts are there as often
    parts = F.ceil(F.col("n") / F.lit(passages.hot_rows)).cast("int")
    hot = written(matched.groupBy("rdoc").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > passages.hot_rows).select("rdoc", parts.alias("parts")))
    n_hot = hot.count()
    named = dealt.withColumnRenamed("id", "rdoc")
    columns = ["doc", "rdoc", "at", "rat", start.alias("rfrom"), cut.alias("ref")]
    with_ref = (matched.join(bounded(hot, n_hot), "rdoc", "left_anti") if n_hot else matched).join(named, "rdoc").select(*columns)
    if n_hot:
        rows = matched.join(bounded(hot, n_hot), "rdoc").withColumn("part", F.pmod(F.xxhash64("doc"), F.col("parts")).cast("int")).drop("parts")
        copies = texts.withColumnRenamed("id", "rdoc").join(bounded(hot, n_hot), "rdoc").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")
        with_ref = with_ref.unionByName(rows.join(copies, ["rdoc", "part"]).select(*columns))
    both = with_ref.join(dealt.withColumnRenamed("id", "doc"), "doc").select("doc", "rdoc", "at", "rat", "rfrom", "ref", "text")
    aligned = written(both.mapInArrow(_aligned(passages), SCHEMA + ", exact array<int>, exact_end array<int>"))
    each = F.struct("start_word", (F.col("start_word") + F.col("n_words")).alias("end_word"))
    lists = [F.flatten(F.collect_list(c)).alias(c) for c in ("exact", "exact_end")]
    spans = written(aligned.groupBy("doc_id").agg(F.collect_list(each).alias("spans"), *lists))
    regions = chained.where("rdoc is null").join(spans.select(F.col("doc_id").alias("doc"), "exact", "exact_end"), "doc", "left")
    windows = regions.join(texts.withColumnRenamed("id", "doc"), "doc").select("doc", "at", "rat", "exact", "exact_end", "text")
    windows = written(windows.mapInArrow(_windowed(passages), WINDOWS))
    discard(chained)
    aligned = aligned.drop("exact", "exact_end")
    discard(first)
    first = windows.groupBy("hash").agg(F.min(F.struct("doc_id", "start_word")).alias("first"), F.max("doc_id").alias("last")).where("first.doc_id <> last")
    first = written(first.select("hash", F.col("first.doc_id").alias("rdoc"), F.col("first.start_word").alias("rpos")))
    later = windows.join(first, "hash").where("doc_id <> rdoc").groupBy("doc_id").agg(F.collect_list(F.struct("start_word", "start_char", "end_char", "rdoc", "rpos")).alias("windows"))
    rest = later.join(spans.select("doc_id", "spans"), "doc_id", "left").select("doc_id", "windows", "spans")
    with arrow_rows(docs.sparkSession, 256):
        rest = written(rest.mapInArrow(_settled(passages), SCHEMA))
    discard(windows, first, spans)
    return aligned.unionByName(rest)
