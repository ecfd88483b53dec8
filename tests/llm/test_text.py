"""Language ID, packing, personal data, repeated passages, Jaccard join, HTML and the pipeline."""

import hashlib
import math
import random
import re
import zlib
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pytest

from docframe.llm import components, html_extract, jaccard_join, language_id, packing, pii, substring_dedup
from docframe.llm import queries as Q
from docframe.llm.tokens import BlockTokens
from tests.compare import connect, difference
from tests.llm.fixtures import awkward_docs, empty_docs, prose


def no_sites(spark):
    return spark.createDataFrame([], "id long, host string, markup string")


def test_language_by_text_and_sites(spark, sf_dir):
    docs = Q.table(spark, sf_dir, "documents")
    want = {r["doc_id"]: r["lang"] for r in docs.collect()}
    got = {r["doc_id"]: r for r in Q.op5_language_id(spark, sf_dir).collect()}
    assert got.keys() == want.keys()
    assert sum(got[k]["language"] == v for k, v in want.items()) / len(want) > 0.98
    assert sum(got[k]["text_language"] == v for k, v in want.items()) / len(want) > 0.95
    assert all(got[k]["kept"] for k in want)


def test_language_edges(spark):
    got = language_id.identify(awkward_docs(spark), no_sites(spark), evidence=language_id.Evidence(least_rows=3)).collect()
    assert len(got) == 16
    assert [(r["language"], r["posterior"], r["kept"]) for r in got if r["doc_id"] == 4] == [(None, 0.0, False)]
    assert language_id.identify(empty_docs(spark), no_sites(spark)).count() == 0


def check_pieces(pieces, ids_of):
    by_doc, by_sequence = {}, {}
    for p in pieces:
        by_doc.setdefault(p["doc_id"], []).append(p)
        by_sequence.setdefault(p["sequence_id"], []).append(p)
    assert by_doc.keys() == ids_of.keys()
    for doc, own in by_doc.items():
        ids, at = np.array(ids_of[doc], "<u4"), 0
        for p in sorted(own, key=lambda p: p["start"]):
            assert p["start"] == at and p["doc_tokens"] == len(ids)
            assert p["ids_crc32"] == zlib.crc32(ids[at : at + p["length"]].tobytes())
            at += p["length"]
        assert at == len(ids)
    for own in by_sequence.values():
        at = 0
        for p in sorted(own, key=lambda p: p["offset"]):
            assert p["offset"] == at
            at += p["length"]
        assert at == 4096 or at & (at - 1) == 0


def test_packing_against_the_tokenizer(spark, sf_dir):
    import public_tokenizers
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    texts = {r["doc_id"]: r["text"] for r in Q.table(spark, sf_dir, "documents").collect()}
    check_pieces(Q.op6_packing(spark, sf_dir).collect(), {k: tokenizer.encode(t, add_special_tokens=False).ids + [2] for k, t in texts.items()})


def test_packing_edges(spark):
    got = packing.pack(awkward_docs(spark)).collect()
    assert sum(p["doc_id"] is None for p in got) >= 2
    assert [(p["length"], p["doc_tokens"], bytes(p["ids"])) for p in got if p["doc_id"] == 4] == [(1, 1, b"\2\0\0\0")]
    assert sum(p["length"] for p in got if p["doc_id"] == 7) == 2 * next(p["doc_tokens"] for p in got if p["doc_id"] == 7)
    assert packing.pack(empty_docs(spark)).count() == 0


def encoded(tokens, texts):
    raws = [t.encode() for t in texts]
    bounds = np.concatenate([[0], np.cumsum([len(r) for r in raws])])
    ids, edges = tokens.encode(np.frombuffer(b"".join(raws), np.uint8), bounds)
    return [ids[a:z].tolist() for a, z in zip(edges[:-1], edges[1:], strict=True)]


@pytest.mark.parametrize("most_bytes", [1 << 22, 100])
def test_block_tokens_equal_the_tokenizer(most_bytes):
    import public_tokenizers

    tokens = BlockTokens(public_tokenizers.path("word_bpe_49k.json"), most_bytes=most_bytes)
    rng, signs = random.Random(4), "abcXYZ 'éÉßİı Σσ .,!?-_<|>  \t\n0129²½ë中\U0001f600\x1c\x85́ſK<|endoftext|>×÷ÀÖØÞ'srelvmdt¿¡«»"
    texts = ["".join(rng.choice(signs) for _ in range(rng.randint(0, 60))) for _ in range(2000)]
    texts += ["<|endoftext|>", "I'LL we'Re", "", "a'", "'s", "''s", "x's'd", "internationalization" * 4 + " abc", "'", "ab" * 5000]
    for at in range(0, len(texts), 500):
        part = texts[at : at + 500]
        assert encoded(tokens, part) == [tokens.tokenizer.encode(t, add_special_tokens=False).ids for t in part]
    assert encoded(tokens, []) == [] and encoded(tokens, ["", " "]) == [[], []]


def corpus_of(texts):
    df = np.zeros(1 << packing.BITS, np.int64)
    found = list(packing.text_words(pa.array(texts), packing.BITS))
    for _, word, _ in found:
        df += np.bincount(word, minlength=1 << packing.BITS)
    return packing.Corpus(df, len(texts), sum(int(t.sum()) for *_, t in found) / len(texts))


def plain_bm25(texts, seed, p):
    words = [t.lower().split() for t in texts]
    mean, n = sum(map(len, words)) / len(words), len(words)
    score = {}
    for j, own in enumerate(words):
        total = 0.0
        for w in set(words[seed]) & set(own):
            df, tf = sum(w in x for x in words), own.count(w)
            total += math.log1p((n - df) / (df + 0.5)) * tf * (p.k1 + 1) / (tf + p.k1 * (1 - p.b + p.b * len(own) / mean))
        if total > 0 and j != seed:
            score[j] = total
    return score


def test_bm25_neighbours_against_plain_python():
    texts = [prose(k, 20 + k) + f" rare{k % 7} rare{k % 5}x" for k in range(40)] + ["", prose(3, 23) + " rare3 rare3x"]
    p = packing.Packing()
    index = packing.Index(pa.array(texts), corpus_of(texts), p)
    for seed in (0, 3, 17, 40):
        want = plain_bm25(texts, seed, p)
        got = index.neighbours(seed).tolist()
        assert set(got) == set(want)
        assert all(want[a] >= want[b] - 1e-9 for a, b in zip(got, got[1:], strict=False))


def test_packing_deals_neighbours_together(spark, sf_dir):
    """Of the best neighbour by an index over all documents, how often is it in the document's shard; dealing by a hash
    would have it there as often as shards are parts of the whole."""
    texts = {r["doc_id"]: r["text"] for r in Q.table(spark, sf_dir, "documents").collect()}
    p = packing.Packing(shard_docs=20)
    corpus = spark.sparkContext.broadcast(packing.corpus_counts(Q.table(spark, sf_dir, "documents")))
    runs = packing.dealt(Q.table(spark, sf_dir, "documents"), corpus, packing=p).rdd.mapPartitionsWithIndex(lambda i, rows: [(i, [r["doc_id"] for r in rows])]).collect()
    shard = {d: (i, k // 20) for i, own in runs for k, d in enumerate(own)}
    assert shard.keys() == texts.keys()
    ids = list(texts)
    index = packing.Index(pa.array([texts[i] for i in ids]), corpus.value, p)
    near = [(i, ids[index.neighbours(k)[0]]) for k, i in enumerate(ids) if len(index.neighbours(k))]
    assert sum(shard[a] == shard[b] for a, b in near) / len(near) > 2 * 20 / len(ids)


def plain_base(text):
    found = [("email", m.start(), m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    found += [("ip", m.start(), m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(x) <= 255 for x in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = re.sub("[^0-9]", "", m[0])
        if 16 <= len(digits) <= 19 and pii.luhn(digits):
            found.append(("card", m.start(), m.end()))
    return found + [("phone", m.start(), m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 8 <= len(re.sub("[^0-9]", "", m[0])) <= 15]


def test_pii_base_equals_plain_patterns():
    rng = random.Random(2)
    for _ in range(3000):
        text = "".join(rng.choice("ab@@..1234567890+-() \U0001f600é_%") for _ in range(rng.randint(0, 80)))
        assert pii.base_spans(text) == plain_base(text)
    assert pii.base_spans("9" * 200_000 + " a@b") == []


@pytest.fixture(scope="module")
def tagger():
    return pii.trained(pii.labelled([prose(k, 120) for k in range(20)], pii.Training()))


def other_spans(seed, n):
    """Texts with a span each, by a rule of its own: other words, names and separators than the training's."""
    rng = random.Random(seed)
    d = lambda k: "".join(rng.choice("0123456789") for _ in range(k))
    out = []
    for _ in range(n):
        kind = rng.choice(["phone", "card", "secret", "email"])
        span = {
            "phone": rng.choice([f"({d(3)}) {d(3)}-{d(4)}", f"{d(3)}-{d(3)}-{d(4)}", f"{d(3)} {d(3)} {d(4)}"]),
            "card": rng.choice(["-", " ", "."]).join(["5" + d(3), d(4), d(4), d(4)]),
            "secret": "".join(rng.choice("0123456789abcdef") for _ in range(rng.randint(20, 36))) + "7",
            "email": f"{rng.choice(['info', 'jane.roe', 'x_y'])}@{rng.choice(['corp', 'mail-box'])}.{rng.choice(['net', 'co.uk', 'de'])}",
        }[kind]
        before = {"phone": "call me on ", "card": "the number ", "secret": rng.choice(["password=", "token: ", "api_key = "]), "email": "write to "}[kind]
        head = f"{prose(rng.randint(0, 999), rng.randint(0, 20))} {before}"
        out.append((f"{head}{span} {prose(rng.randint(0, 999), 12)}", (kind, len(head), len(head) + len(span))))
    return out


def test_pii_tagger_finds_spans_of_another_generator(tagger):
    held_out = other_spans(5, 300)
    added = pii._added([t for t, _ in held_out], [[] for _ in held_out], tagger)
    assert sum(want in a for a, (_, want) in zip(added, held_out, strict=True)) / len(held_out) >= 0.9


def test_pii_tagger_spares_clean_text(tagger):
    clean = [prose(k, 100) + f" version {k}.2 of 2024-10-1{k % 10}, {k},250 of 1{k}.5 % and 12:3{k % 10} in {1950 + k}. " + prose(k, 20) for k in range(40)]
    assert pii._added(clean, [[] for _ in clean], tagger) == [[] for _ in clean]


def test_pii_windows_without_a_digit_change_nothing(tagger):
    texts = [prose(k, 60) + " " + t + " " + prose(k + 1, 80) for k, (t, _) in enumerate(other_spans(6, 40))] + ["", "7", "x" * 200 + "5" + "y" * 200]
    base = [pii.base_spans(t) for t in texts]
    assert pii._added(texts, base, tagger) == pii._added(texts, base, tagger, every=True)


def test_pii_of_a_very_long_text(spark):
    text = "0123 " * 400_000 + "mail a.b@c.de"
    docs = spark.createDataFrame([(1, text, "x", "x"), (1, text[-40:], "x", "x"), (None, None, "x", "x")], "doc_id long, text string, spans string, n_email string")
    got = pii.find(docs, training=pii.Training(made=50, epochs=1)).collect()
    assert sorted(r["n_email"] for r in got) == [0, 1, 1]
    assert any(f"email:{len(text) - 8}:{len(text)}" in r["spans"] for r in got)


def test_pii_possible_spans():
    assert pii._possible("phone", "555-1234", " ", ".") and not pii._possible("phone", "555-12", " ", " ") and not pii._possible("phone", "555-1234", "a", " ")
    assert pii._possible("ip", "10.0.0.7", " ", ".") and not pii._possible("ip", "10.0.0.700", " ", "") and not pii._possible("ip", "10.0.0", " ", "")
    assert pii._possible("secret", "abcdef12", "=", "") and not pii._possible("secret", "abcdefgh", "=", "") and not pii._possible("email", "a b@c", "", "")


def test_pii_training_draws_from_whole_texts(monkeypatch):
    seen = []
    monkeypatch.setattr(pii.Tagger, "train", lambda self, x, y, epochs: seen.append((len(x), (y > 0).any())))
    late = "1 " * 6000 + "mail a.b@c.de " * 3000
    pii.trained([(late, pii.base_spans(late))])
    pii.trained([("1 " * 500, [])] * 9, pii.Training(most_each=5, most_windows=30))
    assert seen == [(24, True), (30, False)]


def test_pii_rows(spark):
    text = "x" * 100 + " mail a.b@c.de, \U0001f600 1.2.3.4 or +1 (555) 123-4567"
    docs = awkward_docs(spark).select("doc_id", "text").unionByName(spark.createDataFrame([(50, text)], "doc_id long, text string"))
    got = {r["doc_id"]: r for r in pii.find(docs).collect()}
    base = ",".join(f"{k}:{a}:{b}" for k, a, b in plain_base(text))
    assert (got[50]["n_email"], got[50]["n_ip"], got[50]["n_card"], got[50]["n_phone"]) == (1, 1, 0, 1)
    assert got[50]["base_sha256"] == hashlib.sha256(base.encode()).hexdigest() and got[50]["spans"].startswith("email:106:114")
    assert got[4]["spans"] == "" and got[4]["base_sha256"] == hashlib.sha256(b"").hexdigest()
    assert pii.find(docs.limit(0)).count() == 0


def shingles(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    return {tuple(words[k : k + 5]) for k in range(len(words) - 4)} if len(words) >= 5 else {tuple(words)} if words else set()


def plain_classes(rows):
    sets = [(i, shingles(t)) for i, t in rows if i is not None]
    root = {i: i for i, _ in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for x, (i, a) in enumerate(sets):
        for j, b in sets[x + 1 :]:
            if a and b and Fraction(len(a & b), len(a | b)) >= Fraction(3, 4):
                lo, hi = sorted((find(i), find(j)))
                root[hi] = lo
    return {i: (len(s), find(i)) for i, s in sets}


def near_copies(spark, seed, n):
    rng = random.Random(seed)
    base = prose(seed, 90).split()
    rows = []
    for k in range(n):
        words = list(base)
        for _ in range(rng.randint(0, 4)):
            words[rng.randrange(len(words))] = f"w{rng.randint(0, 999)}"
        rows.append((k * 7 % 1000, " ".join(words[: rng.randint(70, 90)])))
    return rows


def test_jaccard_classes_of_awkward_rows(spark):
    docs = awkward_docs(spark)
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    want = plain_classes(rows)
    got = jaccard_join.classes(docs).collect()
    assert len(got) == 16
    for r in got:
        assert (r["n_shingles"], r["component_id"]) == want[r["doc_id"]] if r["doc_id"] is not None else r["component_id"] is None
    assert jaccard_join.classes(empty_docs(spark)).count() == 0
    kept = jaccard_join.one_of_each(docs)
    assert kept.columns == docs.columns and 2 not in {r["doc_id"] for r in kept.collect()}


@pytest.mark.parametrize("seed", [3, 8])
def test_jaccard_classes_of_a_hot_group(spark, seed):
    rows = near_copies(spark, seed, 140) + [(2000 + k, prose(900 + k, 60)) for k in range(40)]
    got = jaccard_join.classes(spark.createDataFrame(rows, "doc_id long, text string"), join=jaccard_join.Join(order_size=64, spread_parts=3, block_rows=4)).collect()
    want = plain_classes(rows)
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == want


def test_jaccard_on_documents(spark, sf_dir):
    rows = [(r["doc_id"], r["text"]) for r in Q.table(spark, sf_dir, "documents").collect()]
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in Q.op9_jaccard_join(spark, sf_dir).collect()}
    assert got == plain_classes(rows)


def test_jaccard_equals_sql(spark, sf_dir):
    assert difference(Q.op9_jaccard_join(spark, sf_dir), connect(sf_dir), Q.OP9_SQL) is None


def test_components_of_paths_and_stars(spark):
    links = [(k, k + 1) for k in range(60)] + [(100, k) for k in range(101, 140)] + [(5, 5)]
    got = {r["node"]: r["component"] for r in components.components(spark.createDataFrame(links, "u long, v long")).collect()}
    assert got == {k: 0 for k in range(1, 61)} | {k: 100 for k in range(101, 140)}
    assert components.components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_passages_against_brute_force(spark, sf_dir):
    texts = {r["doc_id"]: r["text"] for r in Q.table(spark, sf_dir, "documents").collect()}
    owners = {}
    for i, t in texts.items():
        words = t.lower().split()
        for k in range(len(words) - 49):
            owners.setdefault(tuple(words[k : k + 50]), set()).add(i)
    want = {i for own in owners.values() if len(own) > 1 for i in own - {min(own)}}
    got = Q.op8_substring_dedup(spark, sf_dir).collect()
    assert want <= {r["doc_id"] for r in got}
    for r in got:
        words = texts[r["doc_id"]][r["start_char"] : r["end_char"]].split()
        assert len(words) == r["n_words"] >= 50 and words == texts[r["doc_id"]].split()[r["start_word"] :][: r["n_words"]]
        assert 0.75 <= r["similarity"] <= 1 and r["other_id"] < r["doc_id"]


def test_passages_planted_and_clean(spark):
    passage = prose(50, 70)
    fuzzy = " ".join(w if k % 20 else "edit" for k, w in enumerate(passage.split()))
    words = [f"u{k}" for k in range(4000)]
    fresh = lambda k: " ".join(words[200 * k : 200 * k + 150])
    rows = [(1, fresh(1) + " " + passage), (2, passage + " " + fresh(2)), (3, fresh(3) + " " + fuzzy + " " + fresh(4)), (4, fresh(5)), (5, fresh(6) + " " + " ".join(passage.split()[:30]))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = substring_dedup.repeats(docs).collect()
    assert {(r["doc_id"], r["other_id"]) for r in got} == {(2, 1), (3, 1)}
    assert all(r["n_words"] >= 60 for r in got)
    edges = substring_dedup.repeats(awkward_docs(spark)).collect()
    assert {(2, 1), (3, 1), (12, 1)} <= {(r["doc_id"], r["other_id"]) for r in edges}
    assert substring_dedup.repeats(empty_docs(spark)).count() == 0


def uncovered_windows(texts, rows, size=50):
    """Windows of `size` words that a smaller id has too: those whose text lies in no row, and words in no row."""
    texts = {i: t.lower().split() for i, t in texts.items()}
    owner, lost = {}, []
    for i in sorted(texts):
        for k in range(len(texts[i]) - size + 1):
            owner.setdefault(tuple(texts[i][k : k + size]), i)
    for i, words in texts.items():
        spans = [(r["start_word"], r["start_word"] + r["n_words"]) for r in rows if r["doc_id"] == i]
        covered = {w for a, z in spans for w in range(a, z)}
        whole = {tuple(words[k : k + size]) for a, z in spans for k in range(a, z - size + 1)}
        for k in range(len(words) - size + 1):
            window = tuple(words[k : k + size])
            if owner[window] < i and (window not in whole or not covered.issuperset(range(k, k + size))):
                lost.append((i, k))
    return lost


def passage_rows(spark, texts):
    rows = [r.asDict() for r in substring_dedup.repeats(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()]
    for r in rows:
        words = texts[r["doc_id"]][r["start_char"] : r["end_char"]].split()
        assert len(words) == r["n_words"] and words == texts[r["doc_id"]].split()[r["start_word"] :][: r["n_words"]]
        if r["similarity"] == 1:
            other = texts[r["other_id"]].lower().split()[r["other_start_word"] :][: r["other_n_words"]]
            assert [w.lower() for w in words] == other
    return rows


def fresh_words(name, n):
    return " ".join(f"é{name}{k}" for k in range(n))


def test_passages_whose_first_places_are_elsewhere(spark):
    p = prose(60, 80).split()
    part = lambda i, a, z: f"{fresh_words(f'x{i}', 30)} {' '.join(p[a:z])} {fresh_words(f'y{i}', 30)}"
    texts = {11: part(11, 0, 42), 12: part(12, 38, 80), 13: part(13, 0, 80), 14: part(14, 0, 80)}
    rows = passage_rows(spark, texts)
    assert (14, 13, 80) in {(r["doc_id"], r["other_id"], r["n_words"]) for r in rows}
    assert uncovered_windows(texts, rows) == []


def test_passages_with_a_period(spark):
    line = "one line of seven words comes again "
    texts = {
        1: fresh_words("a", 20) + " no" * 70 + " " + fresh_words("b", 20), 2: "no " * 200 + fresh_words("c", 9), 3: fresh_words("d", 40) + " " + line * 12, 4: line * 40 + fresh_words("e", 3),
        5: "no " * 300,
    }
    rows = passage_rows(spark, texts)
    assert {r["doc_id"] for r in rows} == {2, 4, 5}
    assert uncovered_windows(texts, rows) == []


@pytest.mark.parametrize("between", [1, 40, 100, 400, 900])
def test_passages_apart_and_beside_a_stray_seed(spark, between):
    one, two, stray = prose(61, 60), prose(62, 60).split(), "stray words that are shared"
    two[20], edited = "edit", " ".join(two)
    two = prose(62, 60)
    texts = {1: f"{one} {fresh_words('g', between)} {two} {fresh_words('k', between)} {stray}", 2: f"{one} {fresh_words('h', between)} {two} {fresh_words('l', between)} {stray}"}
    texts[3] = f"{one} {fresh_words('m', between)} {edited}"
    rows = passage_rows(spark, texts)
    assert uncovered_windows(texts, rows) == []
    # the edited one has no 50 equal words
    assert any(r["doc_id"] == 3 and r["start_word"] + r["n_words"] >= 60 + between + 58 for r in rows)


def test_passages_cover_each_repeated_window(spark):
    rng = random.Random(8)
    pool = [prose(70 + k, 120).split() for k in range(6)] + [["la"] * 90, ["do", "re", "mi"] * 40]
    texts = {}
    for i in range(60):
        parts = []
        for _ in range(rng.randrange(1, 5)):
            p = rng.choice(pool)
            a = rng.randrange(0, len(p) - 50)
            parts += p[a : a + rng.randrange(30, 100)]
            parts += fresh_words(f"n{i}x{len(parts)}z", rng.randrange(0, 60)).split()
        texts[i] = " ".join(parts)
    assert uncovered_windows(texts, passage_rows(spark, texts)) == []


def test_passages_cover_the_documents(spark, sf_dir):
    texts = {r["doc_id"]: r["text"] for r in Q.table(spark, sf_dir, "documents").collect()}
    assert uncovered_windows(texts, Q.op8_substring_dedup(spark, sf_dir).collect()) == []


def test_chains_rise_on_both_sides():
    anchors = [(0, 10), (5, 15), (10, 20), (12, 3), (15, 25)]
    best = substring_dedup.chains(anchors, substring_dedup.Passages())[0]
    assert best == [(0, 10), (5, 15), (10, 20), (15, 25)]


PAGE = """<!DOCTYPE html><html lang="en"><head><title>t</title><style>p{{}}</style></head><body><header class="site"><h1>Site name</h1></header>
<nav><ul><li><a href="/">Home</a></li></ul></nav><div id="cookie-notice"><p>We use cookies on this site, agree now.</p></div><div class="wrap w-12">
<div class="sidebar"><p>Side text that is long enough to be mistaken for something.</p></div><div class="{cls}"><h2>Title {k}</h2><p>First&nbsp;para
of &lt;text&gt; &amp; more.<p>Second <b>bold</b> and <a href="x">link</a> words here.</p><ul><li>one<li>two</ul><script>var x = "<p>no</p>";</script>
<form><input><label>Your mail</label></form></div><div class="comments"><p>Nice post, thank you very much indeed for all of it.</p></div></div><footer>&copy; site</footer></body></html>"""


def test_html_pages(spark):
    pages = [(k, f"https://a.example/p/{k}", PAGE.format(cls="post-body", k=k)) for k in range(5)]
    pages += [(90, None, "plain &eacute; text"), (91, "x", None), (92, "https://b.example", ""), (93, "https://a.example/q", "<p>a<p>b<br>c <div>d"), (0, "https://a.example/p/0", PAGE.format(cls="post-body", k=0))]
    got = html_extract.extract(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()
    text = {r["page_id"]: r["text"] for r in got}
    assert len(got) == 10
    assert text[3] == "Title 3\nFirst para of <text> & more.\nSecond bold and link words here.\none\ntwo"
    assert (text[90], text[91], text[92], text[93]) == ("plain é text", "", "", "a\nb c\nd")
    assert all(r["n_chars"] == len(r["text"]) for r in got)
    assert html_extract.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_html_winning_path_beats_a_longer_block(spark):
    short = '<body><div class="main-text"><p>Short.</p></div><div class="blurb"><p>{}</p></div></body>'
    long = '<body><div class="main-text"><p>{}</p></div><div class="blurb"><p>Tiny.</p></div></body>'
    pages = [(k, f"http://h.example/{k}", long.format(prose(k, 60))) for k in range(6)] + [(9, "http://h.example/9", short.format(prose(9, 40)))]
    got = {r["page_id"]: r["text"] for r in html_extract.extract(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    assert got[9] == "Short."


@pytest.mark.parametrize("around", ["<article class='post overflow-hidden'>{}</article>", "<div class='has-sidebar'>{}</div>", "<div class='search'>{}</div>", "<article class='comment'>{}</article>"])
def test_html_names_do_not_drop_an_article(around):
    inner = f"<h2 id='search'>Search</h2><p>{prose(1, 50)}</p><section id='related-work'><p>{prose(2, 50)}</p></section>"
    page = html_extract.parsed("<body>" + around.format(inner) + "<div class='site-footer widget'><p>Site.</p></div><div class='social-share' ><p>Tell.</p></div><div hidden><p>Gone</p></div></body>")
    assert html_extract.text_in(page, html_extract.best(page)).split("\n") == ["Search", prose(1, 50), prose(2, 50)]
    assert "Site." not in html_extract.text_in(page, 0) and "Tell." not in html_extract.text_in(page, 0) and "Gone" not in html_extract.text_in(page, 0)


def test_html_all_containers_of_the_winning_path(spark):
    page = "<body><div class='part'><p>{}</p></div><p>between</p><div class='part'><p>{}</p></div></body>"
    pages = [(k, f"http://w.example/{k}", page.format(prose(k, 90), "Tail." if k < 6 else prose(k + 50, 60))) for k in range(7)]
    got = {r["page_id"]: r["text"] for r in html_extract.extract(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    assert got[6] == prose(6, 90) + "\n" + prose(56, 60) and got[0] == prose(0, 90) + "\nTail."


def test_html_votes_decide_without_an_article(spark):
    """Short pages alone would be taken whole, with what stands beside the text; their host's path leaves it out."""
    page = '<body><div class="post-{k}"><p>{text}</p></div><section><p>{beside}</p></section></body>'
    long = [(k, f"http://v.example/{k}", page.format(k=k, text=prose(k, 90), beside="Beside.")) for k in range(8)]
    short = [(20 + k, f"http://v.example/s{k}", page.format(k=k, text=prose(k, 4), beside=prose(k + 50, 3))) for k in range(3)]
    alone = [(40, "http://alone.example/", page.format(k=1, text=prose(1, 4), beside=prose(51, 3)))]
    pages = spark.createDataFrame(long + short + alone, "page_id long, url string, html string")
    for options in ({}, {"broadcast_hosts": 0, "salts": 3}):
        got = {r["page_id"]: r["text"] for r in html_extract.extract(pages, **options).collect()}
        assert len(got) == 12
        assert all(got[k] == prose(k, 90) for k in range(8)) and all(got[20 + k] == prose(k, 4) for k in range(3))
        assert got[40] == prose(1, 4) + "\n" + prose(51, 3)


def test_html_of_odd_pages(spark):
    """Ties, repeated rows, clashing columns, and long pages with nothing closed, in time that grows with their length."""
    odd = ["<a title=\"x" * 20_000, "<svg>" * 30_000, "<div>" * 3_000 + "deep", "<p>" + "word " * 400_000, "<script>" * 20_000, "<!--" * 50_000, "<a href='" + "y" * 300_000 + "'>link</a> text"]
    rows = [(k, "http://o.example/", h, "x", "x", "x") for k, h in enumerate(odd)] + [(1, "http://o.example/", odd[1], "x", "x", "x")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, host string, path string, salt string")
    text = {}
    for r in html_extract.extract(pages).collect():
        text.setdefault(r["page_id"], []).append(r["text"])
    assert len(text[1]) == 2 and text[2] == ["deep"] and len(text[3][0]) == 5 * 400_000 - 1 and text[6][0] == "link text"


def test_html_on_pages(spark, sf_dir):
    import html

    rows = {r["page_id"]: r["html"] for r in Q.table(spark, sf_dir, "pages").collect()}
    for r in Q.op10_html_extraction(spark, sf_dir).collect():
        article = re.search(r"<article>(.*?)</article>", rows[r["page_id"]], re.S)[1]
        blocks = (" ".join(html.unescape(re.sub(r"<[^>]*>", "", b)).split()) for b in re.split(r"</?(?:p|h1)>", article))
        assert r["text"] == "\n".join(b for b in blocks if b)


def test_pipeline_stages(spark, sf_dir):
    import corpus_pipeline

    docs = Q.table(spark, sf_dir, "documents")
    columns, seen = docs.columns, [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = Q.written(stage(spark, docs, sf_dir))
        seen.append(docs.count())
        assert docs.columns == columns, name
        if name == "exact_dedup":
            rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
            assert len({t for _, t in rows}) == len(rows)
        if name == "jaccard_join":
            want = plain_classes(rows)
            assert {r["doc_id"] for r in docs.select("doc_id").collect()} == {i for i, (_, c) in want.items() if c == i}
    assert seen[0] == seen[1] > seen[2] >= seen[3] > seen[4] > 0
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir)
    assert pieces.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    assert {r["doc_id"] for r in pieces.select("doc_id").distinct().collect()} == {r["doc_id"] for r in docs.select("doc_id").collect()}
