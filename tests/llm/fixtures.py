"""Small tables with every awkward case."""

import random

WORDS = "the of and to in that is was for on are with as by at be this from or have an they which one you had were all her she there would their we him been has when who will no more if out so up said what its about than into them can only other time new some could these two may first then do any like my now over such our man me even most made after also did many before must well back through years where much your way down should because long".split()


def prose(seed, n):
    rng = random.Random(seed)
    out = [rng.choice(WORDS) + ("." if rng.random() < 0.1 else "") for _ in range(n)]
    return " ".join(out)


def awkward_docs(spark):
    """doc_id, text, lang, source, n_chars and columns with clashing names; null and empty texts, null ids, repeated
    rows, exact and near copies, a very long text."""
    base = prose(1, 120)
    near = base.replace(base.split()[60], "changed", 1)
    rows = [
        (1, base, "en", "src0"), (2, base, "en", "src0"), (3, near, "en", "src1"), (4, None, "en", None), (5, "", None, "src1"), (6, "", "en", "src1"),
        (7, "one two", "fr", "src1"), (7, "one two", "fr", "src1"), (8, "One two", "fr", "src2"), (None, base, "en", "src2"), (None, "alone here", None, None),
        (9, " \t\n ", "en", "src0"), (10, prose(2, 20_000), "en", "src0"), (11, prose(3, 300), "en", "src3"), (12, base + " " + prose(4, 100), "en", "src3"), (13, "ÉÉ!! ## 12", "en", "src3"),
    ]
    clash = {c: "x" for c in ("row", "h", "id", "kept", "token", "n", "class", "keep_id", "text_sha256", "host", "salt", "body")}
    rows = [(*r, len(r[1] or ""), *clash.values()) for r in rows]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` string" for c in clash))


def empty_docs(spark):
    return awkward_docs(spark).limit(0)
