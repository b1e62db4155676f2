"""Each corpus operator against brute force on small tables with nulls, ties, repeats, long texts and extra columns."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from vicinage.llm import chat, chunk_dedup, decontamination, exact_dedup, near_dedup, packing, pii, quality, tokens, toxicity

SF = "/root/testdata/sf0.001"
PATH = public_tokenizers.path("byte_bpe_50k.json")
SCHEMA = "doc_id long, text string, lang string, _row string, count int, _h string"
rnd = random.Random(4)
WORDS = ["".join(rnd.choice("abcdefghijklmnop") for _ in range(rnd.randint(2, 8))) for _ in range(3000)]


def prose(n, seed):
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) for _ in range(n))


def table(spark, texts):
    """Rows with columns whose names an operator might use itself; ids as given or in order."""
    made = [t if isinstance(t, tuple) else (i, t) for i, t in enumerate(texts)]
    return spark.createDataFrame([(i, t, "en", "x", 7, "y") for i, t in made], SCHEMA)


ODD = [None, "", " ", "\n\t ", "a", "x" * 50_000, prose(8000, 1), "😀 é 中文 <|endoftext|> ok", (None, "no id"), (None, None), (3, "same id"), (3, "same id"), "  two  spaces \n\n end "]


@pytest.fixture(scope="module")
def odd(spark):
    return table(spark, ODD)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(i, i % 2, i % 2) for i in range(40)] + [(None, 1, 0), (4, None, None), (4, 1, 1)], "doc_id long, quality int, toxic int")


@pytest.fixture(scope="module")
def items(spark):
    return spark.createDataFrame([(k, prose(20 + 5 * k, 100 + k)) for k in range(6)] + [(10, None), (11, ""), (12, "only three words"), (None, "a b")], "item_id long, text string")


def every(spark, docs, labels, items):
    """Name, result and whether it has a row for each row of docs."""
    conv = docs.selectExpr("doc_id AS conv_id", "doc_id AS turn", "lang AS role", "text", "_row")
    return [
        ("tokens", tokens.count_tokens(docs, PATH), True),
        ("packing", packing.pack_documents(docs, PATH), False),
        ("chat", chat.read_back(chat.format_turns(chat.canonical_turns(conv))), False),
        ("exact", exact_dedup.duplicate_groups(docs), True),
        ("decontamination", decontamination.contaminations(docs, items), False),
        ("near", near_dedup.near_duplicates(docs), True),
        ("pii", pii.find_personal_data(docs), True),
        ("toxicity", toxicity.score_toxicity(docs, labels), True),
        ("quality", quality.score_quality(docs, labels), True),
        ("chunks", chunk_dedup.repeated_passages(docs), False),
    ]


def test_odd_rows(spark, odd, labels, items):
    for name, df, whole in every(spark, odd, labels, items):
        n = df.count()
        assert not whole or n == len(ODD), name


def test_empty_tables(spark, odd, labels, items):
    for name, df, _ in every(spark, odd.limit(0), labels.limit(0), items.limit(0)):
        assert df.count() == 0, name


def test_token_counts(spark, odd):
    t = Tokenizer.from_file(PATH)
    alphabet = ["a", "the", " ", "  ", "\n", "é", "ß", "中", "'s", "1", "<|endoftext|>", "<|", "!", "𐥀", "\x85", "　", "\x1c", "ing"]
    r = random.Random(2)
    texts = [x[1] if isinstance(x, tuple) else x for x in ODD] + ["".join(r.choice(alphabet) for _ in range(r.randint(0, 12))) for _ in range(400)]
    got = tokens.count_tokens(table(spark, texts), PATH).orderBy("doc_id").collect()
    for row, text in zip(got, texts):
        n = len(t.encode(text or "", add_special_tokens=False).ids)
        assert (row.n_tokens, row.n_bytes, row.over_limit) == (n, len((text or "").encode()), n > 1024)


def test_packing(spark):
    texts = [prose(random.Random(k).randint(0, 900), k) for k in range(150)] + [prose(9000, 7), None, "a<|endoftext|>b"]
    got = packing.pack_documents(table(spark, texts), PATH, keep_ids=True).toPandas()
    t = Tokenizer.from_file(PATH)
    for k, text in enumerate(texts):
        ids = np.array(t.encode(text or "", add_special_tokens=False).ids + [0], "<u4").tobytes()
        own = got[got.doc_id == k].sort_values("piece")
        assert b"".join(own.ids) == ids and list(own.piece) == list(range(len(own)))
        assert [zlib.crc32(ids[4 * s : 4 * (s + n)]) for s, n in zip(own.start, own.length)] == list(own.ids_crc32)
        assert set(own.length[own.piece > 0]) <= {2048}
    for _, own in got.sort_values("offset").groupby("sequence_id"):
        assert list(own.offset) == [0, *own.length.cumsum()[:-1]] and own.length.sum() <= 2048
    assert got.sequence_id.nunique() <= -(-got.length.sum() // 2048) + 1


def sequential_best_fit(lengths, capacity):
    gaps = []
    for length in sorted(lengths, reverse=True):
        fit = min((g for g in range(len(gaps)) if gaps[g] >= length), key=lambda g: gaps[g], default=None)
        if fit is None:
            gaps.append(capacity)
            fit = -1
        gaps[fit] -= length
    return len(gaps)


@pytest.mark.parametrize("counts", [{}, {1: 5000}, {2047: 3, 1: 3}, {1025: 10, 1023: 10}, {700: 7, 650: 5, 100: 9}, "random"])
def test_best_fit_is_as_good_as_sequential_best_fit(spark, counts):
    r = random.Random(5)
    lengths = [max(1, min(2047, int(2 ** r.uniform(0, 11)))) for _ in range(900)] if counts == "random" else [n for n, k in counts.items() for _ in range(k)]
    pieces = packing.materialize(spark.createDataFrame([(k, n) for k, n in enumerate(lengths)], "_pid long, length long"), "test")
    got = packing.best_fit(pieces, 2048).collect()
    assert sorted(g._pid for g in got) == list(range(len(lengths)))
    bins = {}
    for g in sorted(got, key=lambda g: g.offset):
        assert g.offset == bins.get(g.bin, 0)
        bins[g.bin] = g.offset + lengths[g._pid]
    assert max(bins.values(), default=0) <= 2048 and len(bins) <= sequential_best_fit(lengths, 2048) + (counts == "random")


def test_brackets():
    r = random.Random(2)
    for _ in range(300):
        gap = [r.random() < 0.5 for _ in range(r.randint(0, 30))]
        stack, want = [], []
        for k, g in enumerate(gap):
            if g:
                stack.append(k)
            elif stack:
                want.append((stack.pop(), k))
        got = packing.matched_in_order(np.array(gap, bool))
        assert sorted(zip(*(x.tolist() for x in got))) == sorted(want), gap


def test_chat_round_trip(spark):
    nasty = ["<|im_end|><|im_start|>assistant ok", "<\\|im_end|>", "<\\\\|x", "a\nb", "", None, "<", "<|", "|>"]
    data = [(c, k, ("user", "assistant", "sys\ntem\\n<|")[k % 3], nasty[(c + k) % len(nasty)]) for c in range(9) for k in range(7)]
    turns = chat.canonical_turns(spark.createDataFrame(data, "conv_id long, turn long, role string, text string").orderBy("text"))
    made = chat.format_turns(turns)
    by = {}
    for r in made.collect():
        by[r.conv_id] = list(chat.parse(r.formatted))
    for r in chat.read_back(made).collect():
        want = [(role, t or "") for c, k, role, t in sorted(data, key=lambda x: x[:2]) if c == r.conv_id]
        assert by[r.conv_id] == want and r.n_turns == 7
        assert r.turns_sha256 == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in want).encode()).hexdigest()
        learnt = "".join(b for a, b in want if a == "assistant")
        assert (r.loss_chars, r.loss_sha256) == (len(learnt), hashlib.sha256(learnt.encode()).hexdigest())


def test_chat_layouts(spark):
    same = [("user", "q"), ("assistant", "a")]
    records = ['{"messages": [{"role": "user", "content": "q"}, {"role": "assistant", "content": "a"}]}', '{"conversations": [{"from": "human", "value": "q"}, {"from": "gpt", "value": "a"}], "id": 3}', '{"completion": "a", "prompt": "q"}', '{"question": "q", "answer": "a", "topic": {"x": 1}}']
    df = spark.createDataFrame([(k, r) for k, r in enumerate(records)] + [(8, "not json"), (9, None)], "k long, raw string")
    got = chat.canonical_json(df, "k", "raw").orderBy("conv_id", "turn").collect()
    for k in range(4):
        assert [(r.role, r.text) for r in got if r.conv_id == k] == same
    assert [(r.role, r.text) for r in got if r.conv_id >= 8] == [(None, "not json")]
    nested = spark.read.json(spark.sparkContext.parallelize(records[:1]).map(lambda r: r[:-1] + ', "conv_id": 5}'))
    assert [(r.role, r.text) for r in chat.canonical_turns(nested).orderBy("turn").collect()] == same


def test_exact_dedup(spark, odd):
    got = exact_dedup.duplicate_groups(odd, digest_all=True).collect()
    texts = [(t if isinstance(t, tuple) else (i, t)) for i, t in enumerate(ODD)]
    sizes = Counter(t or "" for _, t in texts)
    assert Counter((r.doc_id, r.text_sha256, r.group_size) for r in got) == Counter((i, hashlib.sha256((t or "").encode()).hexdigest(), sizes[t or ""]) for i, t in texts)
    assert sum(r.kept for r in got) == len(sizes)
    assert sorted(t or "" for _, t, *_ in exact_dedup.drop_duplicates(odd).collect()) == sorted(sizes)
    lazy = {r.doc_id: r.text_sha256 for r in exact_dedup.duplicate_groups(odd).collect()}
    assert lazy[4] is None and lazy[0] is not None
    exact_dedup.BROADCAST_BYTES, keep = -1, exact_dedup.BROADCAST_BYTES
    try:
        assert sorted(map(str, exact_dedup.duplicate_groups(odd, digest_all=True).drop("text_sha256").collect())) == sorted(str(r) for r in spark.createDataFrame(got).select("doc_id", "keep_id", "group_size", "kept").collect())
    finally:
        exact_dedup.BROADCAST_BYTES = keep


def shingles(text):
    w = (text or "").lower().split(" ")
    w = [x for x in re.split(r"[\x20\x09-\x0D]+", (text or "").lower()) if x]
    return [tuple(w[i : i + 5]) for i in range(len(w) - 4)], len(w)


def test_decontamination(spark, items):
    r = random.Random(9)
    bench = {k: prose(20 + 5 * k, 100 + k).split() for k in range(6)}
    texts = []
    for trial in range(60):
        w = list(bench[trial % 6])
        for _ in range(trial % 4):
            at = r.randrange(len(w))
            w[at : at + r.randint(0, 1)] = [r.choice(WORDS)] * r.randint(0, 1)
        texts.append(prose(40, trial) + " " + " ".join(w).upper() + "\n" + prose(30, trial + 500))
    texts += [prose(300, k + 900) for k in range(20)] + ["this is only three words here"]
    want = {}
    for d, text in enumerate(texts[:80]):
        sh, _ = shingles(text)
        for k, words in bench.items():
            own = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
            m, best = sum(own.values()), 0
            for at in range(-(m - 1), len(sh)):
                win = Counter(sh[max(0, at) : max(0, at + m)])
                both = sum((win & own).values())
                best = max(best, both / (sum(win.values()) + m - both))
            if best >= 0.75:
                want[d, k] = round(best, 9)
    want[80, 12] = 1.0
    docs = table(spark, texts)
    got = {(r.doc_id, r.item_id): round(r.similarity, 9) for r in decontamination.contaminations(docs, items).collect()}
    assert got == want and len(want) > 20
    decontamination.ITEM_BYTES, keep = 700, decontamination.ITEM_BYTES
    try:  # a benchmark that goes to the executors in slices
        assert {(r.doc_id, r.item_id): round(r.similarity, 9) for r in decontamination.contaminations(docs, items).collect()} == want
    finally:
        decontamination.ITEM_BYTES = keep
    assert {r.doc_id for r in decontamination.drop_contaminated(docs, items).collect()} == set(range(81)) - {d for d, _ in want}


@pytest.mark.parametrize("together", [200_000, 300])
def test_decontamination_of_swapped_parts(spark, monkeypatch, together):
    """No shared shingle of the best window stands at its own place in the item; whole, cut at an end, and by brute force."""
    monkeypatch.setattr(decontamination, "TOGETHER", together)
    bench = {k: prose(n, 700 + k).split() for k, n in enumerate((40, 59, 33, 90))}
    texts = []
    for k, w in bench.items():
        for cut in (len(w) // 2, len(w) // 3, len(w) // 4):
            for before, after in ((30, 30), (0, 30), (30, 0), (0, 0)):
                texts.append(" ".join([prose(before, k + 40), *w[cut:], *w[:cut], prose(after, k + 60)]))
        texts.append(" ".join([prose(20, k), *w[20:], *w[10:20], *w[:10]]))
        texts.append(" ".join([*w[len(w) // 2 :], *w[3 : len(w) // 2], prose(9, k)]))
    want = {}
    for d, text in enumerate(texts):
        sh, _ = shingles(text)
        for k, words in bench.items():
            own = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
            m, best = sum(own.values()), (0, 0)
            for at in range(-(m - 1), len(sh)):
                win = Counter(sh[max(0, at) : max(0, at + m)])
                both = sum((win & own).values())
                best = max(best, (both / (sum(win.values()) + m - both), -max(0, at)))
            if best[0] >= 0.75:
                want[d, k] = round(best[0], 9), -best[1]
    items = spark.createDataFrame([(k, " ".join(w)) for k, w in bench.items()], "item_id long, text string")
    docs = table(spark, texts)
    got = {(r.doc_id, r.item_id): (round(r.similarity, 9), r.start_word) for r in decontamination.contaminations(docs, items).collect()}
    assert got == want and len(want) > 30
    assert want[0, 0] == (0.8, 30)


@pytest.mark.parametrize("small", [400, 5])
def test_near_duplicates(spark, small):
    r = random.Random(6)
    texts = ["", None, "one two", "ONE  two", "one two three"]
    for g in range(12):
        base = prose(60, 50 + g).split()
        for _ in range(14):
            w = list(base)
            for _ in range(r.randint(0, 5)):
                w[r.randrange(len(w))] = r.choice(WORDS)
            texts.append(" ".join(w))
    sets = []
    for t in texts:
        sh, n = shingles(t)
        sets.append(set(sh) if n >= 5 else {tuple((t or "").lower().split())} if n else set())
    parent = list(range(len(texts)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(texts)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 75 * len(sets[i] | sets[j]):
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    keep = near_dedup.SMALL, near_dedup.TOGETHER
    near_dedup.SMALL, near_dedup.TOGETHER = small, 40 * small
    try:
        got = near_dedup.near_duplicates(table(spark, texts)).orderBy("doc_id").collect()
    finally:
        near_dedup.SMALL, near_dedup.TOGETHER = keep
    assert [(r.n_shingles, r.component_id, r.kept) for r in got] == [(len(s), root(k), root(k) == k) for k, s in enumerate(sets)]


def test_components(spark):
    r = random.Random(8)
    edges = [(r.randrange(200), r.randrange(200)) for _ in range(150)] + [(k, k + 1) for k in range(300, 340)] + [(400, k) for k in range(401, 440)]
    parent = {}
    find = lambda x: x if parent.setdefault(x, x) == x else find(parent[x])
    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    got = {r.id: r.component for r in near_dedup.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {k: find(k) for a, b in edges for k in (a, b) if a != b}


EMAIL, IP = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD, PHONE = re.compile(r"[0-9]([\x20-]?[0-9])+"), re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def plain_spans(text):
    digits = lambda m: re.findall("[0-9]", m[0])
    out = [(0, *m.span()) for m in EMAIL.finditer(text)]
    out += [(1, *m.span()) for m in IP.finditer(text) if all(int(p) <= 255 for p in m[0].split("."))]
    out += [(2, *m.span()) for m in CARD.finditer(text) if 16 <= len(digits(m)) <= 19 and pii.luhn("".join(digits(m)))]
    return out + [(3, *m.span()) for m in PHONE.finditer(text) if 8 <= len(digits(m)) <= 15]


def test_personal_data_patterns():
    r = random.Random(1)
    parts = ["a", "b.c", "@", ".", "-", "+", "1", "23", "255", "256", "192.168.0.1", "4111111111111111", "(", ")", " ", "%", "x@y.z", "é", "+1 (555) 010-9999", "0000000000000000"]
    for _ in range(6000):
        text = "".join(r.choice(parts) for _ in range(r.randint(0, 14)))
        assert pii.base_spans(text) == plain_spans(text), text
    assert pii.base_spans("1" * 100_000 + "@" * 50_000) is not None


def test_field_adds_a_repeated_number():
    text = ["reach me at +1 (826) 555-4081 or jo@ex.org please", "the year 1999 and v2.0 are plain"] * 40
    field = pii.fit(text)
    found = pii.added_spans(["call +1 (826) 555-4081 190.137.2 now"], [pii.base_spans("call +1 (826) 555-4081 190.137.2 now")], field)
    assert (3, 5, 22) in found[0]
    assert pii.added_spans(["the year 1999 and v2.0"], [[]], field) == [[]]


def test_toxicity_chain():
    r = random.Random(3)
    y = np.array([k % 5 == 0 for k in range(600)], float)
    texts = [set(r.sample(WORDS[:300], 40)) | ({r.choice(["idiot", "moron", "stupid", "worthless"])} if t else set()) for t in y]
    chain = toxicity.fit_chain(texts[:400], y[:400])
    scores = np.array([chain.scores(t)[-1] for t in texts[400:]])
    assert ((scores >= 0.5) == (y[400:] == 1)).mean() > 0.98
    # The chain by hand: each model's own words, the bias and the earlier probabilities.
    for words in texts[400:420]:
        earlier = []
        for model in chain.models:
            x = model.bias + sum(w for word, w in model.words.items() if word in words) + sum(a * b for a, b in zip(model.earlier, earlier))
            earlier.append(1 / (1 + np.exp(-x)))
        assert np.allclose(earlier, chain.scores(words))
    # Categories come from the data: rows of one telling word are one cluster.
    found = toxicity.clusters(texts[:400], y[:400], 3)
    assert set(found[y[:400] == 0]) == {-1} and set(found[y[:400] == 1]) == {0, 1, 2}
    names = [t & {"idiot", "moron", "stupid", "worthless"} for t in texts[:400]]
    assert all(len({found[i] for i in np.flatnonzero(y[:400]) if w in names[i]}) == 1 for w in ("idiot", "moron", "stupid", "worthless"))


def test_quality_attention():
    y = np.array([k % 3 > 0 for k in range(300)], float)
    texts = [(prose(150, k) if t else prose(90, k) + "\n" + "| ".join(prose(60, k).split())).encode() for k, t in enumerate(y)]
    model = quality.fit([quality.features_of(t) for t in texts[:200]], y[:200])
    assert ((model.scores(texts[200:]) >= 0.3) == (y[200:] == 1)).mean() > 0.95
    assert 0 <= model.scores([b""])[0] <= 1
    # One at a time, by the definition: passages, encodings, attention weights that sum to one, weighted sum.
    for text in (texts[0], texts[1], b"", b"x" * 1500):
        x = np.concatenate([quality.passages([text])[0]])
        h = np.tanh(np.clip((x - model.mean) / model.scale, -6, 6) @ model.p["w"] + model.p["b"])
        e = [float(np.dot(np.tanh(v @ model.p["v"]) / (1 + np.exp(-(v @ model.p["u"]))), model.p["a"])) for v in h]
        weight = np.exp(np.array(e)) / np.exp(np.array(e)).sum()
        want = 1 / (1 + np.exp(-float((weight[:, None] * h).sum(0) @ model.p["o"] + model.p["c"][0])))
        assert abs(model.scores([text])[0] - want) < 1e-9
    assert np.allclose(model.scores(texts[:9]), [model.scores([t])[0] for t in texts[:9]])


def test_quality_of_long_texts_in_stretches(monkeypatch):
    monkeypatch.setattr(quality, "TOGETHER", 2048)
    text = prose(2000, 3).encode()
    assert len(quality.features_of(text)) == -(-len(text) // quality.PASSAGE) and len(quality.features_of(text, 7)) == 7
    model = quality.fit([quality.features_of(text), quality.features_of(b"| 1 | 2")], np.array([1.0, 0.0]), steps=20)
    assert np.allclose(model.scores([b"a", text, b""])[1], model.scores([text])[0])


def test_chunks(spark):
    for text in ["", "é" * 400, prose(500, 2), "\0" * 3000, "中文" * 300]:
        raw = text.encode()
        cuts = chunk_dedup.cuts_of(np.frombuffer(raw, np.uint8))
        assert (cuts[-1:] or [0]) == [len(raw)] and cuts == sorted(set(cuts))
        for a, b in zip([0, *cuts], cuts):
            raw[a:b].decode()
            assert b - a <= chunk_dedup.LONGEST
    texts = []
    for k in range(60):
        shared = prose(52, 1000 + k)
        texts += [prose(70, k) + " " + shared + " " + prose(50, k + 300), prose(33, k + 600) + " é " + shared + " " + prose(80, k + 900)]
    texts += [prose(200, k + 5000) for k in range(30)]
    docs = table(spark, texts)
    found = chunk_dedup.repeated_passages(docs)
    got = found.collect()
    assert {r.doc_id for r in got} >= set(range(118)) and max(r.doc_id for r in got) < 120
    for r in got:
        assert texts[r.doc_id][r.start : r.end] in texts[r.doc_id ^ 1] and r.kept == (r.doc_id % 2 == 0)
    cut = {r.doc_id: r.text for r in chunk_dedup.cut_repeats(docs, found).collect()}
    assert all(cut[k] == texts[k] for k in range(0, 120, 2)) and all(len(cut[k]) < len(texts[k]) for k in range(1, 118, 2) if k in {r.doc_id for r in got})


IDS = {"int": lambda k: k, "string": lambda k: None if k is None else f"d{k:03}"}


@pytest.mark.parametrize("kind", IDS)
def test_stages_tell_rows_by_id_and_text(spark, kind, items):
    """Repeated and missing ids, ids of other types, and columns with the names that the operators might use themselves."""
    of = IDS[kind]
    t, x, y = prose(60, 11), prose(60, 12), prose(60, 13)
    item = prose(20, 100)
    names = "_id string, _sha string, _score double, _spans string, _digest string, _row int, _lost_id int, class string, `a.b` int"
    frame = lambda data: spark.createDataFrame([(of(k), v, "i", "s", 0.5, "p", "d", 1, 2, "c", n) for n, (k, v) in enumerate(data)], f"doc_id {kind}, text string, {names}")
    left = lambda df: sorted((str(r.doc_id), r.text or "") for r in df.collect())
    said = lambda data: sorted((str(of(k)), v or "") for k, v in data)

    rows = [(1, t), (2, t), (1, x), (None, y), (None, t), (4, ""), (5, None), (2, t), (6, y + " more")]
    made = frame(rows)
    got = exact_dedup.drop_duplicates(made)
    assert got.columns == made.columns and left(got) == said([(2, t), (1, x), (None, y), (5, None), (6, y + " more")])

    rows = [(3, t), (5, t + " more"), (5, x), (None, t), (None, y), (None, y), (7, ""), (7, None), (9, x), (3, t), (8, "a b"), (10, "A  B")]
    made = frame(rows)
    got = near_dedup.drop_near_duplicates(made)
    assert got.columns == made.columns and left(got) == said([(3, t), (5, x), (None, y), (7, ""), (7, None), (8, "a b")])
    told = near_dedup.near_duplicates(made).collect()
    assert sorted((str(r.doc_id), str(r.component_id), r.kept) for r in told) == sorted((str(of(a)), str(of(b)), c) for a, b, c in [
        (3, 3, True), (3, 3, True), (5, 3, False), (5, 5, True), (None, 3, False), (None, None, True), (None, None, True), (7, 7, True), (7, 7, True), (9, 5, False), (8, 8, True), (10, 8, False)])

    rows = [(5, prose(9, 1) + " " + item), (5, x), (6, y), (None, item), (None, t), (7, None)]
    made = frame(rows)
    got = decontamination.drop_contaminated(made, items)
    assert got.columns == made.columns and left(got) == said([(5, x), (6, y), (None, t), (7, None)])
    for stage in (exact_dedup.drop_duplicates, near_dedup.drop_near_duplicates, lambda d: decontamination.drop_contaminated(d, items)):
        assert stage(made.limit(0)).columns == made.columns and stage(made.limit(0)).count() == 0


@pytest.mark.parametrize("together", [1, 40, 10_000])
def test_decontamination_in_groups(together, monkeypatch):
    """Groups of texts that end with a batch, one text that is a group, and none at all."""
    monkeypatch.setattr(decontamination, "TOGETHER", together)
    assert decontamination.candidates([], decontamination.Index([(0, decontamination.word_hashes(prose(30, 1)).tobytes())])) == {}
    assert decontamination.Index([]).sizes == {}


def test_decontamination_runs_no_python(spark, monkeypatch):
    """Only SQL functions in any plan that runs; pairs and distances are those of the search on arrays."""
    monkeypatch.setattr(decontamination, "TOGETHER", 300)
    r = random.Random(31)
    bench = [prose(n, 1300 + n).split() for n in (3, 7, 11, 19, 40, 63, 260)]
    texts = [" ".join([*prose(r.randint(0, 90), k).split(), *bench[k % 7], *prose(r.randint(0, 400), k + 50).split()]) for k in range(28)] + [None, ""]
    seen = []
    wrote = decontamination.materialize
    monkeypatch.setattr(decontamination, "materialize", lambda df, label: (seen.append(df), wrote(df, label))[1])
    out = decontamination.contaminations(table(spark, texts), spark.createDataFrame(list(enumerate(map(" ".join, bench))), "item_id long, text string"))
    rows = out.collect()
    for df in [*seen, out]:
        assert not re.search("EvalPython|InPandas|InArrow|PythonUDF", df._jdf.queryExecution().executedPlan().toString())
    index = decontamination.Index([(k, decontamination.word_hashes(" ".join(w)).tobytes()) for k, w in enumerate(bench)])
    want = decontamination.candidates([decontamination.word_hashes(t or "") for t in texts], index)
    got = {(r.doc_id, r.item_id): r.hamming for r in rows}
    assert len(got) >= 28 and {k: min(want[k].values()) for k in got} == got
    assert all(got[k, k % 7] == 0 for k in range(28))


def test_near_duplicates_of_long_texts(spark, monkeypatch):
    """Sets beyond the bytes that are compared together."""
    monkeypatch.setattr(near_dedup, "TOGETHER", 20_000)
    base = prose(6000, 77).split()
    texts = [" ".join(base), " ".join(base[:5500]), " ".join(base[300:]), prose(6000, 78), " ".join(base[:100])]
    got = near_dedup.near_duplicates(table(spark, texts)).orderBy("doc_id").collect()
    assert [r.component_id for r in got] == [0, 0, 0, 3, 4]


def mentions(seed, number):
    """Texts with personal data, said again without its cue, next to like data that wasn't said before: (text, spans of the second mentions, spans of the others)."""
    r, out = random.Random(seed), []
    for k in range(number):
        d = lambda n: "".join(r.choice("0123456789") for _ in range(n))
        full = {0: f"ann.{d(3)}@host{d(1)}.example.com", 1: f"{r.randint(100, 255)}.{r.randint(100, 255)}.{r.randint(10, 99)}.{r.randint(10, 99)}", 3: f"+1 ({d(3)}) 555-{d(4)}"}
        kind = r.choice([0, 1, 3])
        other = {0: f"bob.{d(3)}@host{d(1)}.example.com", 1: f"{r.randint(100, 255)}.{r.randint(100, 255)}.{r.randint(10, 99)}.{r.randint(10, 99)}", 3: f"+1 ({d(3)}) 555-{d(4)}"}[kind]
        again, new = pii.mention(kind, full[kind]), pii.mention(kind, other)
        text = prose(r.randint(3, 60), k) + " " + full[kind] + " " + prose(r.randint(20, 200), k + 1) + " "
        first, second = (again, new) if r.random() < 0.5 else (new, again)
        a = len(text)
        text += first + " " + prose(5, k) + " "
        b = len(text)
        text += second
        at = {first: (a, a + len(first)), second: (b, b + len(second))}
        out.append((text, (kind, *at[again]), (kind, *at[new])))
    return out


def test_field_finds_second_mentions_by_its_skip_edges():
    field = pii.fit([t[: min(a[1], b[1])] for t, a, b in mentions(1, 300)])  # the mentions are cut off
    held = mentions(2, 200)
    texts = [t for t, _, _ in held]
    base = [pii.base_spans(t) for t in texts]
    got = pii.added_spans(texts, base, field)
    over = lambda spans, want: any(k == want[0] and s < want[2] and want[1] < e for k, s, e in spans)
    hit, wrong = sum(over(g, w) for g, (_, w, _) in zip(got, held)), sum(over(g, w) for g, (_, _, w) in zip(got, held))
    assert hit >= 180 and wrong <= 10
    cut = pii.Field(field.unary, np.stack([field.pair[0], np.zeros((5, 5))]))  # without skip edges
    blind = pii.added_spans(texts, base, cut)
    assert sum(over(g, w) for g, (_, w, _) in zip(blind, held)) < hit / 2


def test_personal_data_columns_equal_brute_force(spark):
    texts = ["", None, "mail a.b@c.de or +1 (555) 010-9999 now", "1.2.3.4 4111 1111 1111 1111", *(t for t, _, _ in mentions(3, 40)), "x" * 300_000 + "@y.z", "1" * 4000 + ".1.1.1 ²"]
    got = pii.find_personal_data(table(spark, texts)).orderBy("doc_id").collect()
    for r, text in zip(got, texts):
        want = sorted(plain_spans(text or ""))
        said = ",".join(f"{pii.KINDS[k]}:{a}:{b}" for k, a, b in want)
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == n for k, _, _ in want) for n in range(4)]
        assert r.base_sha256 == hashlib.sha256(said.encode()).hexdigest()
        spans = [x.split(":") for x in r.spans.split(",") if x]
        assert set(said.split(",")) - {""} <= set(r.spans.split(",")) and [(pii.KINDS.index(k), int(a)) for k, a, _ in spans] == sorted((pii.KINDS.index(k), int(a)) for k, a, _ in spans)


def test_chat_rows_in_any_order(spark):
    """Formatted rows written and dealt out again, with conversations of several segments."""
    data = [(c, k, ("user", "assistant")[k % 2], f"{c} {k} " + "x" * 300) for c in (1, 2, 3, None) for k in range(9)]
    turns = chat.canonical_turns(spark.createDataFrame(data, "conv_id long, turn long, role string, text string"))
    chat.SEGMENT, keep = 700, chat.SEGMENT
    try:
        made = packing.materialize(chat.format_turns(turns), "test")
    finally:
        chat.SEGMENT = keep
    assert made.groupBy("conv_id").count().where("count > 1").count() == 4
    got = {r.conv_id: r for r in chat.read_back(made.orderBy(chat.F.rand(3)).repartition(5)).collect()}
    for c in (1, 2, 3, None):
        own = [(role, text) for conv, _, role, text in data if conv == c]
        assert got[c].n_turns == 9 and got[c].turns_sha256 == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in own).encode()).hexdigest()
        learnt = "".join(b for a, b in own if a == "assistant")
        assert (got[c].loss_chars, got[c].loss_sha256) == (len(learnt), hashlib.sha256(learnt.encode()).hexdigest())


def test_chat_records_without_one_layout(spark):
    odd = ['{"messages": ["hello", null]}', '{"messages": [{"role": "user", "content": "q"}, "x"]}', '{"messages": null}', '{"prompt": "q", "completion": "a", "response": "b"}', '{"prompt": "q", "response": "a", "question": "q", "answer": "b"}', '[1]', '{}']
    df = spark.createDataFrame(list(enumerate(odd)), "k long, raw string")
    assert [(r.role, r.text) for r in chat.canonical_json(df, "k", "raw").orderBy("conv_id").collect()] == [(None, x) for x in odd]
    assert chat.mapping_for({"prompt", "response", "system", "extra"}).name == "guided response"
    assert chat.mapping_for({"prompt", "completion", "response"}) is None


@pytest.mark.parametrize("kind", IDS)
def test_cut_repeats_tells_rows_by_id_and_text(spark, kind):
    of = IDS[kind]
    shared = prose(60, 5)
    texts = [(1, prose(20, 1) + " " + shared), (2, prose(20, 2) + " " + shared + " " + prose(9, 3)), (2, prose(40, 4)), (None, shared + " " + prose(30, 6)), (5, None), (6, "")]
    rows = [(of(k), t, "i", "s", 3) for k, t in texts]
    docs = spark.createDataFrame(rows, f"doc_id {kind}, text string, _id string, _spans string, _hash int")
    found = packing.materialize(chunk_dedup.repeated_passages(docs), "test")
    assert sorted((str(r.doc_id), r.kept) for r in found.collect()) == sorted([(str(of(1)), False), (str(of(2)), False), ("None", True)])
    cut = chunk_dedup.cut_repeats(docs, found)
    assert cut.columns == docs.columns
    got = {(str(r.doc_id), len(r.text or "") if r.doc_id == of(2) else 0): r.text for r in cut.collect()}
    assert got["None", 0] == texts[3][1] and got[str(of(5)), 0] is None and got[str(of(2)), len(texts[2][1])] == texts[2][1]
    assert len(got[str(of(1)), 0]) < 250 and shared not in "".join(v or "" for (k, _), v in got.items() if k != "None")


def test_repeated_passages_equal_brute_force(spark):
    """Runs of chunks by a loop over all documents."""
    r = random.Random(8)
    pool = [prose(40, 3000 + k) for k in range(6)]
    texts = [" ".join([prose(r.randint(0, 30), k), *(r.choice(pool) for _ in range(r.randint(0, 3))), prose(r.randint(0, 30), k + 50)]) for k in range(40)]
    made = []
    for d, text in enumerate(texts):
        raw = text.encode()
        cuts = [0, *chunk_dedup.cuts_of(np.frombuffer(raw, np.uint8))]
        made.append([(raw[a:b], a, b) for a, b in zip(cuts, cuts[1:])])
    holders, first = {}, {}
    for d, own in enumerate(made):
        for k, (piece, _, _) in enumerate(own):
            holders.setdefault(piece, []).append(d)
            first.setdefault(piece, d)
    want = set()
    for d, own in enumerate(made):
        run = []
        for piece in [*own, None]:
            if piece and len(set(holders[piece[0]])) > 1:
                run.append(piece)
                continue
            size = sum(b - a for _, a, b in run)
            if size >= chunk_dedup.PASSAGE:
                want.add((d, run[0][1], run[-1][2], len(run), size, first[run[0][0]], max(len(holders[p]) for p, _, _ in run), all(first[p] == d for p, _, _ in run)))
            run = []
    got = {(x.doc_id, x.start, x.end, x.n_chunks, x.n_bytes, x.first_doc_id, x.n_copies, x.kept) for x in chunk_dedup.repeated_passages(table(spark, texts)).collect()}
    assert got == want and len(want) > 20


def test_chunks_are_handed_over_in_bounded_batches(monkeypatch):
    """A batch of many texts doesn't become one batch of all their chunks."""
    import pyarrow as pa

    from vicinage.llm import tables

    batch = pa.record_batch({"a": list(range(1203))})
    cut = list(tables.pieces_of(iter([batch, batch.slice(0, 0)]), 500))
    assert [b.num_rows for b in cut] == [500, 500, 203] and pa.Table.from_batches(cut)["a"].to_pylist() == list(range(1203))
