"""Licence scans, hard negatives and the filter audit against brute force, with nulls, ties, repeats, long texts and clashing columns."""

import itertools
import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from vicinage.llm import filter_audit, hard_negatives, licences

rnd = random.Random(11)
BASE = {"gpl": "gnu general public license", "apache": "apache license", "cc-by": "cc by", "mit": "mit license"}


# --- licences


def words_by_pattern(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered)


def base_by_pattern(text):
    words = words_by_pattern(text)
    hits = [(label, i) for label, p in BASE.items() for i in range(len(words)) if words[i : i + len(p.split())] == p.split()]
    starts = [i for _, i in hits]
    return len(words), len(hits), min(starts, default=None), max(starts, default=None), ",".join(sorted({label for label, _ in hits}))


def soup(n):
    return " ".join(rnd.choice(["gnu", "General", "public", "license", "MIT", "mit-license", "cc", "BY", "apache", "é", "İ", "cc  by", "GNU general\npublic LICENSE", "\x7f", "x"]) for _ in range(n))


LICENSED = [
    None,
    "",
    " ,.; ",
    "cc by cc by cc by",
    "Released under the MIT License.",
    "Licensed under the Apache License, Version 2.0.",
    "This work is licensed under the GNU General Public License, version 3.",
    "Licensed under CC BY-NC 4.0.",
    "x " * 400_000 + "mit license",
    "mit " + "licens" * 300_000,
    *[soup(n) for n in range(0, 120, 3)],
    (None, "MIT License"),
    (3, "mit license"),
    (3, "mit license"),
]


def licence_rows(spark, texts):
    made = [t if isinstance(t, tuple) else (i, t) for i, t in enumerate(texts)]
    return spark.createDataFrame([(i, t, "f", 1) for i, t in made], "doc_id long, text string, found string, n_words int")


def test_base_phrases_equal_brute_force(spark, monkeypatch):
    got = licences.summary(licences.scan_licences(licence_rows(spark, LICENSED))).collect()
    made = [t if isinstance(t, tuple) else (i, t) for i, t in enumerate(LICENSED)]
    want = Counter((i, *base_by_pattern(t or "")) for i, t in made)
    assert Counter((r["doc_id"], r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) for r in got) == want
    for r in got:
        assert set(filter(None, r["base_labels"].split(","))) <= set(r["labels"].split(","))
        assert 0 <= r["score"] <= 1 and (r["n_base"] == 0 or r["score"] == 1.0)
    assert licences.scan_licences(licence_rows(spark, [])).count() == 0


def test_stretches_do_not_change_what_is_found(monkeypatch):
    vocabulary = {w for t in (*licences.PHRASES, *licences.NOTICES) for x in (t.text, *t.phrases) for w in licences.listed(x)}
    index = licences.Index(licences.PHRASES, licences.NOTICES, {w: 1 + len(w) / 9 for w in vocabulary})
    texts = [soup(200) + " " + rnd.choice(licences.NOTICES).text + " " + soup(50) for _ in range(60)]
    whole = [index.scan(t.encode()) for t in texts]
    monkeypatch.setattr(licences, "STRETCH", 32)
    assert [index.scan(t.encode()) for t in texts] == whole


def test_notices_with_edits(spark):
    """A notice is found with words changed, lost or put in, and not without one of its key phrases."""
    notice = next(t for t in licences.NOTICES if t.label == "isc")
    words = notice.text.split()
    texts, wanted = [], []
    for k in range(len(words)):
        for edited in ([*words[:k], *words[k + 1 :]], [*words[:k], "zebra", *words[k + 1 :]], [*words[:k], "zebra", *words[k:]]):
            text = f"some code here {' '.join(edited)} and more"
            texts.append(text)
            flat = " ".join(words_by_pattern(text))
            wanted.append(all(p in flat for p in notice.phrases))
    texts += ["permission to use fee software hereby", notice.text * 2]
    got = {r["doc_id"]: r["labels"] for r in licences.summary(licences.scan_licences(licence_rows(spark, texts))).collect()}
    assert [got[k] == "isc" for k in range(len(wanted))] == wanted
    assert got[len(wanted)] == "" and got[len(wanted) + 1] == "isc"


def test_own_labels_of_short_notices(spark):
    got = {r["doc_id"]: (r["base_labels"], r["labels"]) for r in licences.summary(licences.scan_licences(licence_rows(spark, LICENSED[:8]))).collect()}
    assert got[4] == ("mit", "mit") and got[5] == ("apache", "apache,apache-2.0")
    assert got[6] == ("gpl", "gpl,gpl-3.0") and got[7] == ("cc-by", "cc-by,cc-by-nc-4.0")


# --- hard negatives


def mined_by_brute_force(rows, positives=5, negatives=10):
    """rows: (vec_id, codes as Python ints, label)."""
    score = lambda a, b: sum(x * y for x, y in zip(a[1], b[1]))
    out = []
    for at, a in enumerate(rows):
        if a[0] % 100:
            continue
        others = [r for k, r in enumerate(rows) if k != at]
        first = sorted(((-score(a, r), r[0]) for r in others if r[2] == a[2]))[:positives]
        for p, pid in first:
            found = sorted((-score(a, r), r[0]) for r in others if r[2] != a[2] and 30 * -p <= 100 * score(a, r) <= 90 * -p)[:negatives]
            out += [(a[0], pid, k + 1, i, -p, -s) for k, (s, i) in enumerate(found)]
    return Counter(out)


def points(seed, n, dim, spread, ids, hot=0.0, grid=None):
    r = np.random.default_rng(seed)
    common = r.normal(0.5, 0.3, dim)
    out = []
    for k in range(n):
        v = common if r.random() < hot else r.normal(0.4, spread, dim)
        v = v if grid is None else np.round(v / grid) * grid
        out.append((int(ids(k)), [float(x) for x in v], int(r.integers(0, 3))))
    return out


@pytest.mark.parametrize(
    "made",
    [
        points(1, 700, 6, 0.5, lambda k: k),
        points(2, 400, 3, 0.5, lambda k: k, grid=0.25),  # scores that tie often
        points(3, 600, 4, 0.3, lambda k: k * 1000, hot=0.5),  # half of all rows hold one vector, all are anchors
        points(4, 300, 4, 40.0, lambda k: k % 150 * 50 - 3000),  # repeated and negative ids, large and negative scores
        points(5, 250, 1, 2.9e6, lambda k: k * (2**53)),  # codes beyond 32 bits, ids over all digits
    ],
)
def test_hard_negatives_equal_brute_force(spark, monkeypatch, made):
    monkeypatch.setattr(hard_negatives, "ROWS", 64)
    monkeypatch.setattr(hard_negatives, "ANCHORS", 16)
    extra = [(None, [1.0] * 3, 1), (7, None, 1), (8, [1.0, None], 2), (9, [float("nan")], 1), (10, [float("inf")], 1), (100, [0.5] * 3, None), (11, [], 1), (12, [9.0], 2)]
    df = spark.createDataFrame([(i, v, y, "s", 0) for i, v, y in made + extra], "vec_id long, embedding array<double>, label int, state string, search int").repartition(5)
    got = hard_negatives.mine(df, F.col("vec_id") % 100 == 0)
    usable = made + [extra[6], extra[7]]
    want = mined_by_brute_force([(i, [math.floor(256 * x) for x in v], y) for i, v, y in usable])
    assert Counter(map(tuple, got.collect())) == want and want
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]


def test_hard_negatives_without_rows_or_range(spark):
    schema = "vec_id long, embedding array<float>, label int"
    assert hard_negatives.mine(spark.createDataFrame([], schema), F.col("vec_id") % 100 == 0).count() == 0
    assert hard_negatives.mine(spark.createDataFrame([(1, [1.0], 1)], schema), F.col("vec_id") % 100 == 0).count() == 0
    with pytest.raises(Exception, match="2\\^62"):
        hard_negatives.mine(spark.createDataFrame([(0, [1e30], 1)], schema), F.col("vec_id") % 100 == 0).count()


# --- filters


def audited_by_brute_force(docs, labels):
    """docs: (doc_id, text, source); labels: (doc_id, quality, toxic)."""
    good, toxic = {d for d, q, _ in labels if q == 1}, {d for d, _, t in labels if t == 1}
    rows = []
    for d, t, s in docs:
        t = t or ""
        words = re.findall("[^\x20\x09-\x0d]+", t)
        fails = set()
        if len(words) < 200:
            fails.add("A")
        if 100 * len(set(words)) < 50 * len(words):
            fails.add("B")
        if 100 * len(re.findall("[A-Z]", t)) > 2 * len(t):
            fails.add("C")
        if re.search(r"[#$%&*|]", t):
            fails.add("D")
        if d is not None and any(e is not None and e < d and (u or "") == t for e, u, _ in docs):
            fails.add("E")
        rows.append((s or "", fails, d is not None and d in good, d is not None and d in toxic))
    out = {}
    for part in {r[0] for r in rows}:
        shares = Counter()
        for order in itertools.permutations("ABCDE"):
            alive = [r for r in rows if r[0] == part]
            gone = []
            for step, f in enumerate(order):
                lost = [r for r in alive if f in r[1]]
                redundant = sum(f in r[1] for r in gone)
                alive, gone = [r for r in alive if f not in r[1]], gone + lost
                alone = sum(r[1] == {f} for r in rows if r[0] == part)
                shares[f] += len(lost)
                out[part, "".join(order), step + 1] = [len(alive), len(lost), redundant, alone, sum(r[2] for r in lost), sum(r[3] for r in lost)]
        for (p, order, step), values in out.items():
            if p == part:
                values.append(shares[order[step - 1]])
    return {k: tuple(v) for k, v in out.items()}


def mixed(n, seed):
    r = random.Random(seed)
    word = lambda: r.choice(["ab", "Cd", "é", "x$", "longer", "AB", "q" * r.randint(1, 3), str(r.randint(0, 400))])
    return r.choice(["", " ", "\t"]) + r.choice([" ", "\n", "\x0b "]).join(word() for _ in range(n)) + r.choice(["", " "])


def test_filter_audit_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(filter_audit, "STRETCH", 64)
    monkeypatch.setattr(filter_audit, "HELD", 2)
    texts = [mixed(rnd.choice([0, 3, 50, 199, 200, 201, 600]), k) for k in range(60)] + [" ".join(str(k) for k in range(300))] * 5 + [None, "", None]
    docs = [(k, t, rnd.choice(["a", "b", None, "", "c c", "a"])) for k, t in enumerate(texts)]
    docs += [(None, texts[3], "a"), (None, "", "b"), (2, texts[2], "a"), (2, texts[2], "a"), (500, texts[3], None)]
    labels = [(k, k % 2, k % 3 == 0) for k in range(40)] + [(1, 0, 1), (1, 1, None), (None, 1, 1), (9999, 1, 1)]
    labels = [(d, q, None if t is None else int(t)) for d, q, t in labels]
    df = spark.createDataFrame([(d, t, s, 1, "x") for d, t, s in docs], "doc_id long, text string, source string, failed int, part string").repartition(4)
    got = filter_audit.audit_filters(df, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    want = audited_by_brute_force(docs, labels)
    columns = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    rows = got.collect()
    assert len(rows) == len(want) == 600 * len({s or "" for _, _, s in docs})
    assert {(r["part"], r["filter_order"], r["step"]): tuple(r[c] for c in columns) for r in rows} == want


def test_filter_audit_of_string_ids_and_empty_tables(spark):
    labels = spark.createDataFrame([("b", 1, 1)], "doc_id string, quality int, toxic int")
    rows = spark.createDataFrame([("a", "same", "s"), ("b", "same", "s")], "doc_id string, text string, source string")
    got = {r["filter_order"]: r for r in filter_audit.audit_filters(rows, labels).where("step = 1 AND filter_order IN ('EABCD', 'ABCDE')").collect()}
    assert (got["EABCD"]["removed"], got["EABCD"]["good_lost"], got["ABCDE"]["removed"]) == (1, 1, 2)
    assert filter_audit.audit_filters(rows.limit(0), labels).count() == 0


def test_bitmaps_of_many_parts():
    r = np.random.default_rng(3)
    parts = r.integers(0, 57, 1000)
    parts[parts == 5] = 6  # a part without rows isn't in a batch's dictionary; others have all lengths
    parts = np.unique(parts, return_inverse=True)[1]
    flags = r.random(1000) < 0.4
    maps = filter_audit.Bitmaps(parts, parts.max() + 1)
    assert maps.counted(maps.packed(flags)).tolist() == np.bincount(parts, weights=flags).astype(int).tolist()


def test_the_smaller_distance_of_a_place_stays():
    from vicinage.llm.decontamination import _keep_least

    places = {4: 3, 9: 0}
    _keep_least(places, {4: 7, 9: 1, 11: 5})
    _keep_least(places, {4: 2})
    assert places == {4: 2, 9: 0, 11: 5}
