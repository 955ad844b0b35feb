"""Periodic runs, personal data and hard negatives against plain versions, with nulls, empty and long texts, ties, repeated rows and clashing columns."""

import hashlib
import math
import random
import re
import time

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from litprops.llm import hard_negatives, pii, queries, runs, store

DOCS = "doc_id long, text string, key string, base int, runs int, start int, kept string"


# ---- runs


def plain_runs(s, min_words=24, min_exponent=3):
    out = {}
    for q in range(1, len(s) // min_exponent + 1):
        i = 0
        while i + q < len(s):
            j = i
            while j + q < len(s) and s[j] == s[j + q]:
                j += 1
            n = j + q - i
            if j > i and n >= min_words and n >= min_exponent * q:
                out.setdefault((i, n), q)  # a multiple of the smallest period has the same extent
            i = j + 1
    return sorted(((a, n, q) for (a, n), q in out.items()), key=lambda r: (r[0], r[2]))


def plain_collapse(words):
    found = plain_runs(words)
    drop = {k for a, n, q in found for k in range(a + q, a + n)}
    return found, b" ".join(w for k, w in enumerate(words) if k not in drop)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(0, 2), max_size=40), st.lists(st.integers(0, 3), min_size=1, max_size=9), st.integers(1, 12), st.lists(st.integers(0, 2), max_size=20), st.sampled_from([(24, 3), (6, 3), (4, 2)]))
def test_runs_of_any_sequence(head, unit, times, tail, least):
    s = head + unit * times + tail
    assert runs.runs_of(s, *least) == plain_runs(s, *least)


def test_link_cut_access_recolours_paths():
    """Old colours of a path's segments are the last ends of the sequences in them."""
    rng = random.Random(3)
    s = [rng.randrange(3) for _ in range(120)]
    link, size, ends = runs.suffix_automaton(s)
    tree = runs.LastOccurrence(link, size)
    for i, state in enumerate(ends):
        got = tree.access(state, i)
        assert [n for _, n in got] == sorted((n for _, n in got), reverse=True)
        for n in range(1, i + 2):
            want = max((e for e in range(n - 1, i) if s[e - n + 1 : e + 1] == s[i - n + 1 : i + 1]), default=-1)
            assert want == max((e for e, longest in got if n <= longest), default=-1)


def run_texts():
    rng = random.Random(11)
    vocabulary = ["a", "b", "été", "漢字", "x.", "cc"]
    some = lambda n, k=6: [rng.choice(vocabulary[:k]) for _ in range(n)]
    texts = [None, "", " \t\n\x0b ", "one two", " ".join(["go"] * 24), " ".join(["go"] * 23), "a b c " * 30, " ".join(["q"] * 50)]
    for _ in range(40):
        unit = some(rng.randint(1, 20))
        texts.append("\n".join(some(rng.randint(0, 60)) + unit * rng.randint(1, 9) + some(rng.randint(0, 30))))
    texts.append("  ".join(some(300) + some(700) * 6))
    texts.append(" ".join(f"w{i % 20_011}" for i in range(70_000)))  # long, three periods and a half
    return texts


def test_collapse_runs(spark):
    texts = run_texts()
    rows = [(None if i == 3 else i, t, "k", 1, 2, 3, "x") for i, t in enumerate(texts)]
    got = {r.doc_id: r for r in runs.collapse_runs(spark.createDataFrame(rows + rows[8:9], DOCS)).collect()}
    assert len(got) == len(texts)
    for (i, text, *_) in rows[:-1]:
        words = (text or "").encode().split()
        found, kept = plain_collapse(words)
        assert (got[i].n_words, [(r.start, r.length, r.period) for r in got[i].runs], got[i].kept.encode()) == (len(words), found, kept)
    assert [(r.start, r.length, r.period) for r in got[len(texts) - 1].runs] == [(0, 70_000, 20_011)]
    assert runs.collapse_runs(spark.createDataFrame([], DOCS)).count() == 0
    assert runs.collapse_runs(spark.createDataFrame(rows + rows, DOCS)).count() == 2 * len(rows)


def plain_op13(doc_id, text):
    import zlib

    words = (text or "").encode().split()
    n, h = len(words), zlib.crc32(str(doc_id).encode())
    if doc_id is not None and h % 10 == 0 and n:
        g = h // 10
        a, p = g % n, 1 + (n - g % n) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    found, kept = plain_collapse(words)
    top = min(found, key=lambda r: (-r[1] / r[2], r[0], r[2])) if found else (None,) * 3
    milli = 1000 * top[1] // top[2] if found else None
    lines = "".join(f"{a},{n},{q}\n" for a, n, q in found)
    return (len(found), *top, milli, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(kept).hexdigest())


def test_query_of_runs(spark, tmp_path):
    texts = run_texts()[:-1]
    rows = [(None if i == 5 else 1000 + i, t, "k", 1, 2, 3, "x") for i, t in enumerate(texts * 4)]
    spark.createDataFrame(rows, DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: (r.n_runs, r.start, r.length, r.period, r.exponent_milli, r.runs_sha256, r.collapsed_sha256) for r in queries.op13_periodic_runs(spark, str(tmp_path)).collect()}
    assert got == {r[0]: plain_op13(r[0], r[1]) for r in rows}


# ---- hard negatives

VECTORS = "vec_id long, label int, embedding array<float>, q int, rank int, tile string"


def plain_negatives(rows):
    kept = {}
    for i, label, v, *_ in rows:
        if i is None or label is None or v is None or any(x is None or not math.isfinite(x) or abs(x) * 256 >= 1 << 26 for x in v):
            continue
        one = (label, [math.floor(256 * x) for x in v])
        kept[i] = min(kept.get(i, one), one)
    score = lambda a, b: sum(x * y for x, y in zip(kept[a][1], kept[b][1]))
    out = []
    for a in kept:
        if a % 100:
            continue
        near = sorted((-score(a, b), b) for b in kept if b != a and kept[b][0] == kept[a][0])[:5]
        for p, b in near:
            fit = sorted((-score(a, c), c) for c in kept if kept[c][0] != kept[a][0] and 30 * -p <= 100 * score(a, c) <= 90 * -p)[:10]
            out += [(a, b, k + 1, c, -p, -s) for k, (s, c) in enumerate(fit)]
    return sorted(out)


@pytest.mark.parametrize("leaf, grove, at_once", [(256, 32_768, 8192), (4, 37, 3)])
def test_hard_negatives(spark, leaf, grove, at_once):
    import numpy as np

    rng = np.random.default_rng(7)
    rows = [(int(i * 5), int(rng.integers(0, 3)), [float(np.float32(x)) for x in rng.normal(size=6).round(1)], 1, 2, "t") for i in range(400)]
    rows += [(2000 + i, i % 3, [0.5] * 6, 1, 2, "t") for i in range(250)]  # copies of one vector: ties
    rows += [(3000, 1, [0.0] * 6, 1, 2, "t"), (3100, 1, [-0.3] * 6, 1, 2, "t"), (3200, 2, [0.25, 0.5], 1, 2, "t"), (3300, 2, [], 1, 2, "t"), (3400, 9, [1.0] * 6, 1, 2, "t")]
    rows += [(None, 1, [9.0] * 6, 1, 2, "t"), (3501, None, [9.0] * 6, 1, 2, "t"), (3502, 1, None, 1, 2, "t"), (3503, 1, [9.0, None], 1, 2, "t"), (3504, 1, [float("nan")] * 6, 1, 2, "t")]
    rows += [(3505, 1, [float("inf")] * 6, 1, 2, "t"), (3506, 1, [1e30] * 6, 1, 2, "t"), (3600, 0, [200_000.0] * 6, 1, 2, "t"), (3601, 0, [150_000.0] * 6, 1, 2, "t"), (3602, 1, [100_000.0] * 6, 1, 2, "t")]
    rows += rows[:3] + [(0, 2, [0.1] * 6, 1, 2, "t"), (-100, 0, [0.4] * 6, 1, 2, "t")]
    got = hard_negatives.mine(spark.createDataFrame(rows, VECTORS), F.col("vec_id") % 100 == 0, leaf=leaf, grove=grove, at_once=at_once)
    assert sorted(tuple(r) for r in got.collect()) == plain_negatives(rows)


def test_hard_negatives_of_nothing(spark):
    assert hard_negatives.mine(spark.createDataFrame([], VECTORS), F.col("vec_id") % 100 == 0).count() == 0
    no_anchor = spark.createDataFrame([(1, 1, [1.0], 1, 2, "t")], VECTORS)
    assert hard_negatives.mine(no_anchor, F.col("vec_id") % 100 == 0).count() == 0


def test_boxes_bound_scores_and_prune():
    """The search visits few leaves of clustered vectors, and its boxes hold every score."""
    import numpy as np

    rng = np.random.default_rng(5)
    x = np.concatenate([rng.normal(c, 0.2, (256, 4)) * 50 for c in rng.normal(0, 6, (32, 4))]).astype(np.int64).astype(float)
    x = np.concatenate([x[k] for k in hard_negatives.str_leaves(x, 64)])
    ids, labels = np.arange(len(x)), np.zeros(len(x), np.int64)
    tree = hard_negatives.Tree(x, ids, labels, np.append(np.arange(0, len(x), 64), len(x)))
    a = x[100]
    for (lo, hi), cuts in zip(tree.bounds(a[None]), tree.spans[:1]):
        scores = x @ a
        for k in range(len(cuts) - 1):
            assert lo[0, k] <= scores[cuts[k] : cuts[k + 1]].min() and scores[cuts[k] : cuts[k + 1]].max() <= hi[0, k]
    touched = []

    class Watched(np.ndarray):
        def __getitem__(self, key):
            touched.append(key) if isinstance(key, slice) else None
            return super().__getitem__(key)

    tree.x = x.view(Watched)
    windows = [[-(1 << 62), 1 << 62, 5, []]]
    tree.search(a, -1, 0, [(lo[0], hi[0]) for lo, hi in tree.bounds(a[None])], True, windows)
    assert windows[0][3] == sorted((-int(s), int(i)) for i, s in enumerate(x @ a))[:5]
    assert 0 < len(touched) < 40  # of 128 leaves


# ---- personal data

BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def plain_spans(text):
    def fits(kind, found):
        digits = [int(c) for c in found if c in "0123456789"]
        if kind == "ip":
            return all(int(p) <= 255 for p in found.split("."))
        if kind == "card":
            odd = sum(digits[::-1][0::2]) + sum(sum(divmod(2 * d, 10)) for d in digits[::-1][1::2])
            return 14 <= len(digits) <= 19 and odd % 10 == 0
        return kind != "phone" or 10 <= len(digits) <= 15

    spans = [(m.start(), k, kind, m.end()) for k, (kind, p) in enumerate(BASE.items()) for m in re.finditer(p, text or "") if fits(kind, m.group())]
    return sorted(spans)


def found_in(spark, texts, extra=()):
    rows = [(i, t, "k", 1, 2, 3, "x") for i, t in enumerate(texts)]
    return {r.doc_id: ([tuple(s) for s in r.base], [tuple(s) for s in r.learned]) for r in pii.find_personal_data(spark.createDataFrame(rows, DOCS)).collect()}


def test_base_entities(spark):
    rng = random.Random(4)
    pieces = ["a.b+c@d.e", "x@y", "@", "q_@w.v.u.", "1.2.3.4", "256.1.1.1", "0001.002.3.4.5", "1.2.3", "4111 1111 1111 1111", "4111-1111-1111-1112", "378282246310005", "+1 (132) 555-1352",
              "+49", "+1-2-3", "++4915112345678", "été", "漢", " ", "  ", "\n", "-", ".", "12", "0" * 14, "%", "_"]
    texts = [None, "", "漢字 a@b.c", "a@b.c.+x@d.e", "a@b.c_x@d.e", "1" * 40, "1.1.1.1.1.1.1.1", " ".join(["9.9.9.9"] * 700), "a" * 20_000, "7 " * 50_000, "a." * 60_000 + "@" + "b." * 60_000, "(" * 100_000 + "1", "+1" + "(" * 50_000]
    texts += ["".join(rng.choice(pieces) for _ in range(rng.randint(1, 25))) for _ in range(400)]
    got = found_in(spark, texts)
    assert {i: spans for i, (spans, _) in got.items()} == {i: plain_spans(t) for i, t in enumerate(texts)}


def test_time_grows_with_the_text(spark):
    """Texts on which backtracking patterns take quadratic time, a hundred times longer."""
    start = time.time()
    got = found_in(spark, ["a" * 2_000_000, "a." * 1_000_000, "1" * 2_000_000, "1 " * 1_000_000, "(" * 2_000_000 + "1", "+1" + "(" * 2_000_000, "," * 1_000_000 + "1", "9.9.9.9 " * 20_000])
    assert [len(got[i][0]) for i in range(8)] == [0] * 7 + [20_000]
    assert time.time() - start < 120


@pytest.mark.parametrize("sent", [2_000_000, 0])
def test_contexts_find_unseen_identifiers(spark, monkeypatch, sent):
    """Also with patterns too many to be sent to every task."""
    monkeypatch.setattr(store, "MAX_BROADCAST_IDS", sent)
    seeds = [f"please call me at +1 (132) 555-{n} soon" for n in (1352, 2210, 3301, 4404, 5510, 6600)]
    mails = [f"write to the address {name}@mail.example.com or not" for name in ("ann", "bob", "cid", "dan", "eve")]
    other = ["we met at noon", "the year 1999 was", "the address of the house", "order 555-0001 came", "the the 1234567890123456 the the"]
    hidden = ["do call me at 555-123-4567 today", "write to the address fay@intranet please", "call me at noon"]
    texts = seeds + mails + other + hidden + [None, ""]
    got = found_in(spark, texts)
    at = len(seeds + mails + other)
    assert got[at][1] == [(14, 3, "phone", 26)] and texts[at][14:26] == "555-123-4567"
    assert got[at + 1][1] == [(21, 0, "email", 33)] and texts[at + 1][21:33] == "fay@intranet"
    assert all(not learned for i, (_, learned) in got.items() if i not in (at, at + 1))
    assert all(base == plain_spans(t) for t, (base, _) in zip(texts, (got[i] for i in range(len(texts)))))


def test_personal_data_of_unusual_rows(spark):
    rows = [(None, "a@b.c", "k", 1, 2, 3, "x"), (None, "1.2.3.4", "k", 1, 2, 3, "x"), (7, "a@b.c", "k", 1, 2, 3, "x"), (7, "a@b.c", "k", 1, 2, 3, "x"), (7, "x", "k", 1, 2, 3, "x")]
    got = sorted((str(r.doc_id), str(r.base)) for r in pii.find_personal_data(spark.createDataFrame(rows, DOCS)).collect())
    assert len(got) == 5 and sum("email" in b for _, b in got) == 3 and sum("ip" in b for _, b in got) == 1
    assert pii.find_personal_data(spark.createDataFrame([], DOCS)).count() == 0


def test_query_of_personal_data(spark, tmp_path):
    texts = ["a@b.c and 1.2.3.4", None, "+1 (132) 555-1352 or 4111 1111 1111 1111"]
    spark.createDataFrame([(i, t, "k", 1, 2, 3, "x") for i, t in enumerate(texts)], DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in queries.op12_pii(spark, str(tmp_path)).collect()}
    for i, t in enumerate(texts):
        told = ",".join(f"{kind}:{a}:{b}" for a, _, kind, b in plain_spans(t))
        assert (got[i].spans, got[i].base_sha256) == (told, hashlib.sha256(told.encode()).hexdigest())
        assert [got[i][f"n_{k}"] for k in pii.KINDS] == [sum(s[2] == k for s in plain_spans(t)) for k in pii.KINDS]
