"""Documents with everything that goes wrong, and plain re-computations to compare with."""

import hashlib
import re
from collections import defaultdict

import numpy as np

SPACE = re.compile(r"[^\x20\x09-\x0D]+")
PASSAGE = " ".join(f"passage{i}" for i in range(45))
COLUMNS = (
    "doc_id long, text string, lang string, source string, n_chars long, "
    "score string, kept int, ids string, shard string, key string, node string, row string, component string, "
    "spans string, start string, rank string, TOKENS array<string>"
)


def words(text):
    return SPACE.findall(text or "")


def texts():
    """``(doc_id, text)``: copies, near copies, shared passages, nulls, empty and very long texts."""
    rng = np.random.default_rng(5)
    vocabulary = [f"w{i}" for i in range(400)]

    def prose(n):
        return " ".join(rng.choice(vocabulary, n))

    base = prose(150)
    rows = [(1, base), (2, base), (3, base.upper()), (4, "  ".join(base.split(" ")) + "\n")]
    rows += [(5, None), (6, ""), (7, " \t\n\v\f\r "), (8, "one"), (9, "one two three"), (10, "One two  three")]
    for i in range(11, 31):  # near copies of document 1, some of them only of each other
        changed = base.split(" ")
        for at in rng.choice(150, rng.integers(1, 9), replace=False):
            changed[at] = "new" + str(rng.integers(4))
        rows.append((i, " ".join(changed)))
    for i in range(31, 51):
        rows.append((i, f"{prose(int(rng.integers(5, 60)))} {PASSAGE} {prose(int(rng.integers(5, 60)))}"))
    rows += [(51, "same " * 500), (52, "same " * 30), (53, "a b " * 60), (54, "x" * 200_000), (55, prose(30_000))]
    rows += [(56, "naïve café ÀÉ x \U0001f600 中文 é   <|endoftext|> don't I'LL 123 ''' \x1c ok")]
    rows += [(57, 'api_key = "abcdef123456" and token:abc PASSWORD="hunter22" AKIA' + "ABCD1234" * 2 + " " + "0af3" * 8)]
    rows += [(58, "é token = deadbeefdeadbeefdeadbeefdeadbeef secret:x token=token:abcdefg AKIA123")]
    rows += [(59, "line one here\nline one here\n\nline two\n" * 8), (60, "### $$$ %%% " * 30 + prose(20))]
    rows += [(60, prose(40)), (1, base), (1, base), (None, base), (None, None), (None, prose(50)), (None, prose(50))]
    rows += [(i, prose(int(rng.integers(10, 300)))) for i in range(100, 160)]
    return rows


def documents(spark, rows=None, schema=COLUMNS):
    rows = texts() if rows is None else rows
    wide = [
        (i, t, None if k % 7 == 0 else f"l{k % 2}", None if k % 5 == 0 else "s", len(t or ""), *(["clash", 7] + ["clash"] * 9), ["x"])
        for k, (i, t) in enumerate(rows)
    ]
    return spark.createDataFrame(wide, schema).repartition(3)


def key(doc_id):
    return (1 << 63) - 1 if doc_id is None else doc_id


def removed_words(rows, window=20):
    """Per row: words, and for each whether an earlier equal window covers it."""
    first = {}
    split = [(key(i), words(t)) for i, t in rows]
    for doc, w in split:
        for at in range(len(w) - window + 1):
            run = tuple(w[at : at + window])
            first[run] = min(first.get(run, (doc, at)), (doc, at))
    out = []
    for doc, w in split:
        gone = [False] * len(w)
        for at in range(len(w) - window + 1):
            if first[tuple(w[at : at + window])] < (doc, at):
                gone[at : at + window] = [True] * window
        out.append((w, gone))
    return out


def near_groups(rows, size, percent=80):
    """Per row: shingles, component name and whether it is kept."""
    sets = []
    for _, text in rows:
        w = words(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        sets.append({tuple(w[i : i + size]) for i in range(max(len(w) - size + 1, 1))} if w else set())
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            common = len(sets[a] & sets[b])
            near = common and 100 * common >= percent * (len(sets[a]) + len(sets[b]) - common)
            if near or (rows[a][0] is not None and rows[a][0] == rows[b][0] and sets[a] and sets[b]):
                parent[find(a)] = find(b)
    members = defaultdict(list)
    for i in range(len(rows)):
        members[find(i)].append(i)
    out = [None] * len(rows)
    for group in members.values():
        ids = [rows[i][0] for i in group if rows[i][0] is not None]
        name = min(ids) if ids else None
        for i in group:
            out[i] = (len(sets[i]), name, rows[i][0] == name)
    return out


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def multiset(rows):
    return sorted(map(repr, rows))
