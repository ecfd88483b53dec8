"""Personal data: patterns, and a character-level BiLSTM-CRF that adds spans to theirs."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docframe.llm.bilstm_crf import Tagger
from docframe.llm.common import smallest_hashes, text_of

KINDS = ("email", "ip", "card", "phone")
TAGGED = (*KINDS, "secret")  # what the tagger tells apart: passwords, tokens and keys too
LABELS = 1 + 2 * len(TAGGED)  # none, then a first and a further one of each kind

_LOCAL_END = re.compile(r"[A-Za-z0-9._%+-]+\Z")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_TRIGGER = re.compile(r"[0-9@]")
_WORD = re.compile(r"\S+")
#: Signs of the tagger: the characters here by themselves, letters, digits and the rest as classes.
_OWN = "@.-+() _%:/=\"'#,\n"
SIGNS = len(_OWN) + 5


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        x = int(d) * (1 + k % 2)
        total += x - 9 * (x > 9)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """The patterns' spans by kind, then start: leftmost, not overlapping within a kind, failing matches dropped."""
    found = []
    at, done = text.find("@"), 0
    while at >= 0:
        first = at
        while first > done and text[first - 1] in _LOCAL:
            first -= 1
        m = _DOMAIN.match(text, at) if first < at else None
        if m:
            found.append(("email", first, m.end()))
            done = m.end()
        at = text.find("@", max(at + 1, done))
    if re.search("[0-9]", text):
        found += [("ip", m.start(), m.end()) for m in _IP.finditer(text) if all(len(x.lstrip("0")) <= 3 and int(x.lstrip("0") or 0) <= 255 for x in m[0].split("."))]
        for m in _CARD.finditer(text):
            digits = re.sub("[^0-9]", "", m[0])
            if 16 <= len(digits) <= 19 and luhn(digits):
                found.append(("card", m.start(), m.end()))
        found += [("phone", m.start(), m.end()) for m in _PHONE.finditer(text) if 8 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return found


def signs_of(text: str) -> np.ndarray:
    codes = np.frombuffer(text.encode("utf-32-le"), "<u4")
    out = np.full(len(codes), len(_OWN), np.int8)
    out[(codes >= 97) & (codes <= 122)] = len(_OWN) + 1
    out[(codes >= 65) & (codes <= 90)] = len(_OWN) + 2
    out[(codes >= 48) & (codes <= 57)] = len(_OWN) + 3
    out[codes > 127] = len(_OWN) + 4
    for k, c in enumerate(_OWN):
        out[codes == ord(c)] = k
    return out


@dataclass(frozen=True)
class Training:
    """Labelled spans: `made` ones that a rule writes into the prose of at most most_docs documents with a trigger and at
    most most_chars characters (the smallest hashes of the id), in forms that the patterns have and in others, beside
    numbers that are nobody's; and the patterns' own in those documents. Of a text at most most_each windows are drawn,
    from anywhere in it, and of all at most most_windows. A span counts from a mean posterior of least_confidence on."""

    most_docs: int = 200
    most_chars: int = 20_000
    made: int = 800
    window: int = 64
    hidden: int = 16
    epochs: int = 14
    most_each: int = 24
    most_windows: int = 2_400
    least_confidence: float = 0.8


def _made(n: int, carriers: list[str] = (), seed: int = 11) -> list[tuple[str, list[tuple[str, int, int]]]]:
    """Texts with one span each, or with a number that isn't personal, between words of the carriers."""
    rng = np.random.default_rng(seed)
    digits = lambda k: "".join(map(str, rng.integers(0, 10, k)))
    of = lambda signs, k: "".join(rng.choice(list(signs), k))
    word = lambda: of("aeinorst", rng.integers(2, 9))
    pick = lambda *xs: xs[rng.integers(0, len(xs))]
    words = [w for c in carriers for w in c.split() if not _TRIGGER.search(w)]

    def prose(k: int) -> str:
        if words and rng.random() < 0.8:
            at = rng.integers(0, len(words))
            return " ".join(words[at : at + k])
        return " ".join(word() for _ in range(k))

    def card() -> str:
        d = str(rng.integers(3, 7)) + digits(14)
        return d + next(str(k) for k in range(10) if luhn(d + str(k)))

    def phone() -> str:
        a, b, c, s = digits(3), digits(3), digits(4), pick(" ", "-", ".")
        return pick(f"({a}) {b}-{c}", f"{a}{s}{b}{s}{c}", f"+{rng.integers(1, 99)} ({a}) {b}-{c}", f"00{rng.integers(1, 99)} {a} {b} {c}", f"0{digits(3)} {digits(6)}", f"0{digits(2)}/{digits(7)}", f"+{rng.integers(1, 99)}{s}{a}{s}{b}{s}{c}")

    def secret() -> tuple[str, str, str]:
        value = pick(of("0123456789abcdef", rng.integers(12, 41)), of("abcdefghijkmnpqrstuvwxyz23456789", rng.integers(10, 33)), of("ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789abcdefghijkm", rng.integers(12, 41)))
        value = value if re.search("[0-9]", value) else value + digits(2)
        name = pick("password", "passwd", "pwd", "token", "api_key", "secret", "access_token", "key")
        return pick((f"{name}=", value, ""), (f'{name} = "', value, '"'), (f"{name}: ", value, ""), (f"{name}='", value, "'"), ("", pick("AKIA", "ghp_", "sk-") + of("ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", 15) + digits(1), ""))

    def one() -> tuple[str, str, str, str]:
        """Kind, what stands before and after, with the span in between."""
        k = rng.integers(0, 12)
        if k < 3:
            return "phone", pick("", "", "tel: ", "tel. "), phone(), ""
        if k < 5:
            d, s = card(), pick("", " ", "-", ".", "/")
            return "card", "", s.join(d[j : j + 4] for j in range(0, 16, 4)), ""
        if k == 5:
            return "email", pick("", "", "<", "mailto:"), f"{word()}{pick('', '.', '_', '+')}{pick(digits(2), word())}@{pick(word(), word() + digits(1), word() + '-' + word())}.{pick('com', 'org', 'example.com')}", ""
        if k == 6:
            return "ip", "", ".".join(str(x) for x in rng.integers(0, 256, 4)), ""
        if k < 9:
            before, value, after = secret()
            return "secret", before, value, after
        y, m, d = rng.integers(1900, 2030), rng.integers(1, 13), rng.integers(1, 29)
        other = pick(
            f"{y}-{m:02d}-{d:02d}", f"{d:02d}.{m:02d}.{y}", f"{m}/{d}/{y}", f"{y}-{m:02d}-{d:02d}T{digits(2)}:{digits(2)}:{digits(2)}", f"version {rng.integers(1, 9)}.{rng.integers(0, 9)}.{rng.integers(0, 20)}",
            digits(rng.integers(1, 8)), f"{rng.integers(1, 999)},{digits(3)},{digits(3)}", f"{rng.integers(0, 99)}.{digits(rng.integers(1, 9))}", f"978-{digits(1)}-{digits(2)}-{digits(6)}-{digits(1)}", f"{y}-{y + 4}",
            f"{digits(2)}:{digits(2)}", f"{digits(2)} %", f"${digits(3)}.{digits(2)}", f"{word()}{digits(2)}", f"#{digits(5)}", f"{digits(1)}.{digits(1)}.{digits(1)}.", f"[{digits(2)}]", f"x{digits(1)}y{digits(1)}",
        )
        return "", other, "", ""

    out = []
    for _ in range(n):
        text, spans = prose(rng.integers(0, 12)), []
        for _ in range(rng.integers(1, 3)):
            kind, before, span, after = one()
            text += " " + before
            if kind:
                spans.append((kind, len(text), len(text) + len(span)))
            text += span + after + pick("", ".", ",", "", ";") + " " + prose(rng.integers(2, 12))
        out.append((text, spans))
    return out


def _windows(text: str, size: int) -> list[int]:
    """Where windows begin, half a window apart, that meet a word with a digit or an at sign, or are next to one that does.
    No span is accepted without either (see _possible), so the others could decode to none."""
    step, some = size // 2, set()
    for m in _WORD.finditer(text) if _TRIGGER.search(text) else ():
        if _TRIGGER.search(m[0]):
            some.update(range(m.start() // step - 2, (m.end() - 1) // step + 2))
    return [k * step for k in sorted(some) if k >= 0 and k * step < len(text)]


def trained(labelled: list[tuple[str, list[tuple[str, int, int]]]], training: Training = Training()) -> Tagger:
    xs, ys, size = [], [], training.window
    rng = np.random.default_rng(3)
    for text, spans in labelled:
        signs, labels = signs_of(text), np.zeros(len(text), np.int64)
        for kind, a, b in spans:
            k = TAGGED.index(kind)
            labels[a], labels[a + 1 : b] = 1 + 2 * k, 2 + 2 * k
        starts = _windows(text, size)
        if len(starts) > training.most_each:
            starts = sorted(rng.choice(starts, training.most_each, replace=False).tolist())
        for at in starts:
            x, y = np.full(size, len(_OWN)), np.zeros(size, np.int64)
            own = signs[at : at + size]
            x[: len(own)], y[: len(own)] = own, labels[at : at + size]
            xs.append(x)
            ys.append(y)
    banned = [(a, 2 + 2 * k) for k in range(len(TAGGED)) for a in range(LABELS) if a not in (1 + 2 * k, 2 + 2 * k)]
    tagger = Tagger(SIGNS, LABELS, training.hidden, banned)
    if xs:
        order = np.random.default_rng(1).permutation(len(xs))[: training.most_windows]
        tagger.train(np.array(xs)[order], np.array(ys)[order], training.epochs)
    return tagger


def _possible(kind: str, span: str, before: str, after: str) -> bool:
    """What a kind can't be without; the rest is the tagger's to say. before and after: the characters on either side."""
    digits = sum("0" <= c <= "9" for c in span)
    if kind == "secret":
        return len(span) >= 8 and digits > 0 and not any(c.isspace() for c in span)
    if before.isalnum() or after.isalnum():
        return False
    if kind == "email":
        return span.count("@") == 1 and not any(c.isspace() for c in span)
    if kind == "ip":
        parts = span.split(".")
        return len(parts) == 4 and all(p.isdecimal() and p.isascii() and len(p) <= 3 and int(p) <= 255 for p in parts)
    return digits >= (12 if kind == "card" else 7)


def _added(texts: list[str], base: list[list[tuple[str, int, int]]], tagger: Tagger, training: Training = Training(), every: bool = False) -> list[list[tuple[str, int, int]]]:
    """Spans of the tagger beside the patterns'. Windows overlap by half; a character takes its label from the window in
    whose middle it is most, and spans are read from the labels of the whole text. every: windows without a digit or an
    at sign too, which gives the same."""
    size = training.window
    labels, sure, written = {}, {}, {}
    waiting: list[tuple[int, int, np.ndarray]] = []

    def settle() -> None:
        if not waiting:
            return
        x = np.stack([w[2] for w in waiting])
        got = tagger.decode(x)
        some = np.flatnonzero(got.any(axis=1))
        posterior = np.ones(got.shape, np.float32)
        if len(some):
            posterior[some] = tagger.marginals(x[some], got[some])
        for (i, at, _), row, p in zip(waiting, got, posterior, strict=True):
            # windows come in order: the first quarter is the one's before, if there is one, and the last quarter is the
            # next one's, who writes over it
            first = size // 4 if written.get(i) == at - size // 2 else 0
            labels[i][at + first : at + size] = row[first : len(labels[i]) - at]
            sure[i][at + first : at + size] = p[first : len(labels[i]) - at]
            written[i] = at
        waiting.clear()

    for i, text in enumerate(texts):
        starts = list(range(0, len(text), size // 2)) if every else _windows(text, size)
        if not starts:
            continue
        signs = signs_of(text)
        labels[i], sure[i] = np.zeros(len(text), np.int8), np.zeros(len(text), np.float32)
        for at in starts:
            x = np.full(size, len(_OWN), np.int8)
            own = signs[at : at + size]
            x[: len(own)] = own
            waiting.append((i, at, x))
            if len(waiting) == 512:
                settle()
    settle()
    out: list[list[tuple[str, int, int]]] = [[] for _ in texts]
    for i, own in labels.items():
        text, taken = texts[i], sorted((a, b) for _, a, b in base[i])
        spans, open_ = [], None
        for at in np.flatnonzero(own).tolist():
            y = int(own[at])
            if open_ and at == open_[2] and y == 2 + 2 * open_[0]:
                open_[2] += 1
                continue
            open_ = [(y - 1) // 2, at, at + 1]
            spans.append(open_)
        for k, a, b in spans:
            while a < b and text[a] in " .-,:;=\"'":
                a += 1
            while a < b and text[b - 1] in " .-,(:;=\"'":
                b -= 1
            clear = all(b <= c or d <= a for c, d in taken)
            if a < b and clear and sure[i][a:b].mean() >= training.least_confidence and _possible(TAGGED[k], text[a:b], text[a - 1 : a], text[b : b + 1]):
                out[i].append((TAGGED[k], a, b))
    return out


def _joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(spans, key=lambda s: (TAGGED.index(s[0]), s[1], s[2])))


def _found(tagger, training: Training):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).to_pylist()
            base = [base_spans(t) if _TRIGGER.search(t) else [] for t in texts]
            more = _added(texts, base, tagger.value, training)
            counts = [pa.array([sum(s[0] == kind for s in b) for b in base], pa.int64()) for kind in KINDS]
            own, every = [_joined(b) for b in base], [_joined(b + [s for s in m if s[0] in KINDS]) for b, m in zip(base, more, strict=True)]
            secrets = [_joined([s for s in m if s[0] not in KINDS]) for m in more]
            digest = pa.array([hashlib.sha256(s.encode()).hexdigest() for s in own], pa.string())
            total = pa.array([len(b) + len(m) for b, m in zip(base, more, strict=True)], pa.int64())
            cols = [batch.column(0), *counts, digest, pa.array(every, pa.string()), pa.array(secrets, pa.string()), total]
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", *[f"n_{k}" for k in KINDS], "base_sha256", "spans", "secrets", "n_spans"])

    return run


def labelled(sample: list[str], training: Training) -> list[tuple[str, list[tuple[str, int, int]]]]:
    """The labelled texts: made ones, and passages of the sample in which all that has a digit or an at sign lies in a
    span of the patterns; what else a text holds isn't labelled, so it teaches nothing."""
    own = []
    for text in sample:
        spans, step = base_spans(text), 2 * training.window
        for at in range(0, len(text), step):
            part = [(k, a - at, b - at) for k, a, b in spans if at <= a and b <= at + step]
            clear = "".join(" " if any(a <= m < b for _, a, b in part) else c for m, c in enumerate(text[at : at + step]))
            if part and not _TRIGGER.search(clear):
                own.append((text[at : at + step], part))
    return own + _made(training.made, sample)


def find(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", training: Training = Training()) -> DataFrame:
    """One row per row of docs: doc_id, n_<kind> (spans of the patterns), base_sha256, spans (of the patterns and of the
    tagger, kind:start:end in code points, by kind, then start), secrets (the tagger's spans of passwords, tokens and
    keys, likewise) and n_spans, how many all these are.

    Defined results: null text counts as empty, with no spans; texts of any length are read whole; repeated rows have a
    result each; no rows give no rows; other columns are not read; without documents to learn from the tagger learns from
    made spans alone.
    """
    spark = docs.sparkSession
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text"))
    # at most most_docs ids of texts that aren't long, then their texts
    ids = smallest_hashes(texts.where(F.col("text").rlike("[0-9@]") & (F.length("text") <= training.most_chars)).select("doc_id"), "doc_id", training.most_docs)
    sample = texts.join(F.broadcast(ids.distinct()), "doc_id").where(F.length("text") <= training.most_chars).groupBy("doc_id").agg(F.max("text").alias("text")).orderBy("doc_id")
    tagger = spark.sparkContext.broadcast(trained(labelled([r["text"] for r in sample.collect()], training), training))
    schema = "doc_id long, " + ", ".join(f"n_{k} long" for k in KINDS) + ", base_sha256 string, spans string, secrets string, n_spans long"
    return texts.mapInArrow(_found(tagger, training), schema)
