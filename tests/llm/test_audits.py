"""Filter interaction, hard negatives and decontamination against brute force, on edge cases and on hot groups."""

import hashlib
import itertools
import math
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lakegauge.llm import contamination, interaction, negatives

WORD, PLAIN = re.compile(r"[^\x20\x09-\x0D]+"), re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LONG = " ".join(f"word{i % 977}x{i}" for i in range(20000))
SCHEMA = "doc_id bigint, text string, lang string, source string, mask int, good int, digest string, n int, uid int, id int, kind string"


# --- filter interaction -----------------------------------------------------------------------------------------

def walked(rows, labels):
    """Every order applied to every document, one after the other."""
    least = {}
    for i, t, _ in rows:
        if i is not None:
            least[t or ""] = min(i, least.get(t or "", i))
    good, toxic = ({i for i, *v in labels if i is not None and v[k] == 1} for k in (0, 1))
    documents = []
    for i, t, lang in rows:
        t = t or ""
        w = WORD.findall(t)
        fails = "".join(f for f, bad in zip("ABCDE", (
            len(w) < 100, 100 * len(set(w)) < 80 * len(w), 100 * len(re.findall("[A-Z]", t)) > 10 * len(t),
            re.search("[#$%&*|]", t), i is not None and i > least[t])) if bad)
        documents.append((lang or "", fails, i in good, i in toxic))
    out, shapley = {}, {}
    for part in {d[0] for d in documents}:
        own = [d for d in documents if d[0] == part]
        for order in itertools.permutations("ABCDE"):
            left = own
            for step, f in enumerate(order, 1):
                gone, left = [d for d in left if f in d[1]], [d for d in left if f not in d[1]]
                shapley[part, f] = shapley.get((part, f), 0) + len(gone)
                out[part, "".join(order), step] = [len(left), len(gone), sum(f in d[1] for d in own) - len(gone), sum(d[1] == f for d in own),
                                                   sum(d[2] for d in gone), sum(d[3] for d in gone)]
    return {k: (*v, shapley[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def audited(spark, rows, labels):
    docs = spark.createDataFrame([(i, t, lang, "s", 1, 2, "d", 3, 4, 5, "k") for i, t, lang in rows], SCHEMA)
    marks = spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")
    got = interaction.audit(interaction.masks(docs, marks)).collect()
    assert len(got) == len({r[:3] for r in got})
    return {r[:3]: r[3:] for r in got}


def test_orders_against_walking_them(spark):
    pick = random.Random(3)
    plain = [" ".join(f"w{pick.randrange(900)}" for _ in range(n)) for n in (3, 99, 100, 150, 400)]
    texts = [*plain, " ".join(["same"] * 120), "A" * 40 + " b" * 200, plain[3] + " #", "WORD " * 130 + "| x", LONG, "", None, " \t\n ", "x" * 300000]
    rows = [(i, pick.choice(texts), pick.choice(["en", "fr", None, ""])) for i in range(150)]
    rows += [(7, texts[3], "en"), (7, texts[3], "en"), (7, texts[2], "xx"), (None, texts[3], "en"), (None, texts[3], None), (-5, LONG, "en")]
    labels = [(i, pick.choice([0, 1, None]), pick.choice([0, 1, None])) for i in range(0, 150, 2)] + [(7, 1, 0), (7, 0, 1), (None, 1, 1), (999, 1, 1)]
    assert audited(spark, rows, labels) == walked(rows, labels)


def test_a_third_in_one_text_and_no_rows(spark):
    rows = [(i, "a b c" if i % 3 else f"own {i}", "en") for i in range(600)]
    got = audited(spark, rows, [])
    assert got == walked(rows, []) and len(got) == 600
    assert audited(spark, [], []) == {}


def test_intervals_cover_each_rank_once():
    orders = list(itertools.permutations(range(5)))
    for mask in range(1, 32):
        seen = {}
        for m, step, f, first, end in interaction.intervals():
            if m == mask:
                for rank in range(first, end):
                    assert rank not in seen and orders[rank][step - 1] == f
                    seen[rank] = step
        assert seen == {r: next(i for i, f in enumerate(o, 1) if mask >> f & 1) for r, o in enumerate(orders)}


# --- hard negatives ---------------------------------------------------------------------------------------------

def by_all_scores(rows, asks):
    kept = [(i, [math.floor(256 * float(np.float32(x))) for x in v], label) for i, v, label in rows
            if i is not None and v is not None and label is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for a, (i, v, label) in enumerate(kept):
        if asks(i):
            scores = [(sum(x * y for x, y in zip(v, w)), j, other) for b, (j, w, other) in enumerate(kept) if b != a]
            for p, j, _ in sorted((s for s in scores if s[2] == label), key=lambda s: (-s[0], s[1]))[:5]:
                there = sorted((s for s in scores if s[2] != label and 50 * p <= 100 * s[0] <= 95 * p), key=lambda s: (-s[0], s[1]))
                out += [(i, j, rank, k, p, n) for rank, (n, k, _) in enumerate(there[:3], 1)]
    return sorted(out)


def mined(spark, rows):
    df = spark.createDataFrame([(*r, 1, 2, "x") for r in rows], "vec_id bigint, embedding array<float>, label int, uid int, part int, v string")
    return sorted(tuple(r) for r in negatives.mined(df, F.col("vec_id") % 3 == 0).collect())


def vectors(n, dims, seed, spread=0.3):
    pick = np.random.default_rng(seed)
    centre = pick.normal(0, 0.4, dims)
    return [(i, [float(x) for x in centre + pick.normal(0, spread, dims)], int(pick.integers(0, 4))) for i in range(n)]


@pytest.mark.parametrize("blocks", [(8192, 2048), (17, 5)])
def test_negatives_against_all_scores(spark, monkeypatch, blocks):
    """Whole and cut into many blocks, with ties, repeated ids, odd vectors and large components."""
    monkeypatch.setattr(negatives, "_ROWS", blocks[0])
    monkeypatch.setattr(negatives, "_ANCHORS", blocks[1])
    rows = vectors(90, 10, 5)
    same = [0.25] * 10
    rows += [(i, same, i % 2) for i in range(100, 130)]  # one vector many times: only ids decide
    rows += [(7, rows[7][1], rows[7][2]), (200, None, 1), (201, [None] * 10, 1), (202, [float("nan")] * 10, 1), (203, [float("inf")] + same[1:], 1),
             (204, same, None), (None, same, 1), (205, [], 2), (206, [1.0, -1.0], 1), (207, [3000.0, -2999.5] + same[2:], 0), (208, [0.0] * 10, 3)]
    got = mined(spark, rows)
    assert got == by_all_scores(rows, lambda i: i % 3 == 0) and len(got) > 100


def test_negatives_of_few_rows(spark):
    assert mined(spark, []) == [] and mined(spark, [(3, [1.0], 1)]) == [] and mined(spark, [(3, [1.0], 1), (4, [1.0], 1)]) == []
    rows = [(3, [1.0], 1), (4, [1.0], 1), (5, [0.5], 2), (6, [0.95], 2), (8, [0.96], 2), (9, [0.49], 2)]
    assert mined(spark, rows) == by_all_scores(rows, lambda i: i % 3 == 0)


def test_scan_keeps_exact_scores_and_dismisses():
    """What the scan leaves are the true scores; rows far from the best are dismissed before their last column."""
    pick = np.random.default_rng(1)
    columns = np.floor(pick.normal(0, 30, (64, 3000)))
    columns[:, :40] *= 4
    anchor, seen = columns[:, 0].copy(), []

    def dead(low, high):
        seen.append(len(low))
        return high < negatives.nth_highest(low, 5)

    alive, score = negatives.Block(columns).scan(anchor, np.arange(3000), dead)
    exact = (anchor[:, None] * columns).sum(axis=0).astype(np.int64)
    assert (score == exact[alive]).all() and set(np.argsort(-exact)[:5]) <= set(alive.tolist()) and seen[-1] < 1500
    large = np.full((2, 3), float(1 << 27)) + np.arange(3)
    _, score = negatives.Block(large).scan(large[:, 2], np.arange(3), lambda low, high: np.zeros(len(low), bool))
    assert score.tolist() == [2 * ((1 << 27) + i) * ((1 << 27) + 2) for i in range(3)]


# --- decontamination --------------------------------------------------------------------------------------------

def plain_words(text):
    return PLAIN.findall(re.sub("[A-Z]+", lambda m: m[0].lower(), text or ""))


def by_windows(docs, items):
    held = {}
    for item, text in items:
        w = plain_words(text)
        size = min(10, len(w))
        for s in range(len(w) - size + 1 if w else 0):
            held.setdefault(tuple(w[s:s + size]), set()).add("" if item is None else str(item))
    out = []
    for i, text in docs:
        w = plain_words(text)
        hit, names = set(), set()
        for size in {len(k) for k in held}:
            for s in range(len(w) - size + 1):
                found = held.get(tuple(w[s:s + size]))
                if found:
                    hit |= set(range(s, s + size))
                    names |= found
        out.append((i, len(w), len(hit), len(names), hashlib.sha256(",".join(sorted(names)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=repr)


def reported(spark, docs, items):
    d = spark.createDataFrame([(i, t, "en", "s", 1, 2, "d", 3, 4, 5, "k") for i, t in docs], SCHEMA)
    b = spark.createDataFrame([(i, t, 1, "x", "y") for i, t in items], "item_id bigint, text string, size int, digest string, kind string")
    return sorted((tuple(r) for r in contamination.report(d, b).collect()), key=repr)


def passages(seed=2):
    pick = random.Random(seed)
    say = lambda n: " ".join(f"t{pick.randrange(60)}" for _ in range(n))
    items = [(i, say(n)) for i, n in enumerate([40, 30, 10, 11, 12, 60])]
    items += [(10, items[0][1]), (11, items[0][1][:-3] + " other"), (12, "one TWO, three!"), (13, "naïve café 日本語"), (14, ""), (15, None), (16, "?!"),
              (None, say(14)), (2, items[2][1]), (17, "solo"), (18, "w " * 10 + "end")]
    docs = [(i, f"{say(30)} {pick.choice(items)[1] or ''} {say(12)}") for i in range(60)]
    docs += [(70, items[0][1].upper().replace(" ", ", ")), (71, " ".join(items[0][1].split()[3:12])), (72, " ".join(items[0][1].split()[3:13])),
             (73, f"{items[0][1]} {items[0][1]}"), (74, "Solo"), (75, "one two three one two three"), (76, None), (77, ""), (78, "..."),
             (79, "w " * 400), (None, items[1][1]), (70, "NAÏVE café 日本語"), (80, "naïve CAFÉ 日本語"), (80, "naïve café 日本語"), (81, LONG + " " + items[3][1]),
             (82, "x" * 1000000 + " " + items[4][1])]
    return docs, items


def test_contamination_against_all_windows(spark):
    docs, items = passages()
    got = reported(spark, docs, items)
    assert got == by_windows(docs, items) and sum(r[5] for r in got) > 20


def test_contamination_of_many_copies(spark, monkeypatch):
    """A passage that most documents hold, and a window that most items hold: the broadcast side and kinds of windows."""
    head = " ".join(f"h{i}" for i in range(12))
    items = [(i, f"{head} item number {i}") for i in range(80)]
    docs = [(i, f"before {head} after {i}") for i in range(1500)] + [(2000 + i, f"{head} item number {i}") for i in range(80)]
    got = reported(spark, docs, items)
    assert got == by_windows(docs, items) and all(r[3] >= 80 for r in got)


def test_contamination_without_rows(spark):
    docs, items = passages()
    assert reported(spark, [], items) == []
    got = reported(spark, docs, [])
    assert len(got) == len(docs) and not any(r[2] or r[3] or r[5] for r in got)
    assert not any(r[5] for r in reported(spark, docs, [(1, None), (2, " ")]))


def test_equal_windows_share_a_fingerprint():
    pick = np.random.default_rng(4)
    a, b = pick.integers(0, 1 << 62, 200).astype(np.uint64), pick.integers(0, 1 << 62, 90).astype(np.uint64)
    b[30:45] = a[100:115]
    one, two = contamination._fingerprints(a, 10, 5), contamination._fingerprints(b, 10, 5)
    assert len(one) == 191 and (one[100:106] == two[30:36]).all()
    assert contamination._plain(pa.array(["A-z09é\x7f", ""])).to_pylist() == ["a z09é ", ""]
