import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from bgpforge.llm import common, embedding_dedup, labelled, minhash_dedup, mixing, neighbours, packing, pii, quality, tables, token_counts, tokens, toxicity

DOCS = "doc_id long, text string, source string, key string"
PATH = tokens.default_path()


def docs(spark, texts):
    return spark.createDataFrame([(i, t, s, "other") for i, t, s in texts], DOCS)


def words(n, seed):
    draw = random.Random(seed)
    return " ".join("".join(draw.choice("abcdefg") for _ in range(5)) for _ in range(n))


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and long texts, repeated rows, near copies."""
    base = words(60, 1)
    near = base.rsplit(" ", 1)[0] + " zzzzz"
    return [(1, base, "a"), (1, base, "a"), (2, near, "b"), (3, None, None), (4, "", "a"), (None, base, "a"), (5, "two words", "b"), (6, "Two\tWORDS", None), (7, words(9000, 2), "c"), (8, base, "a")]


def empty(spark):
    return spark.createDataFrame([], DOCS)


def reference(text, end=None):
    from tokenizers import Tokenizer

    ids = Tokenizer.from_file(PATH).encode(text or "", add_special_tokens=False).ids + ([] if end is None else [end])
    return np.array(ids, "<u4").tobytes()


def test_parts_encode_as_the_whole():
    draw, enc = random.Random(3), tokens.Encoder(PATH)
    signs = ["a", "The", " ", "  ", "\n", "\n\n", "\t", "'s", "<|endoftext|>", "1", "é", "中", "🙂", ".", ",", "***", "_", "\r\n", "’"]
    texts = ["".join(draw.choice(signs) for _ in range(draw.randint(0, 25))) for _ in range(3000)]
    assert [x for _, x in tokens.by_bytes(texts, enc)] == [np.array(x.ids, "<u4").tobytes() for x in enc.model.encode_batch(texts, add_special_tokens=False)]


def test_a_worker_remembers_one_operator():
    """Workers are used again by later stages: what one remembers for an operator goes when it turns to another."""
    enc = tokens.encoder(PATH)
    assert list(common.giving_back(iter, "tokens")([1])) == [1] and tokens.encoder(PATH) is enc
    assert list(common.giving_back(iter)([1])) == [1] and tokens.encoder(PATH) is not enc


@pytest.mark.parametrize("bounds", [{}, {"REMEMBERED": 20, "SLOTS": 16}, {"LONGEST": 3}])
def test_parts_that_come_once_are_not_remembered(monkeypatch, bounds):
    for k, v in bounds.items():
        monkeypatch.setattr(tokens, k, v)
    draw, enc = random.Random(4), tokens.Encoder(PATH)
    words = ["".join(draw.choice("abcdeé,.0漢") for _ in range(draw.randint(1, 9))) for _ in range(3000)]
    texts = [" ".join(words[i : i + 100]) for i in range(0, 3000, 100)]
    whole = [np.array(x.ids, "<u4").tobytes() for x in enc.model.encode_batch(texts, add_special_tokens=False)]
    held = []
    for _ in range(3):
        assert [y for x in texts for y in enc.ids([x])] == whole
        held.append(len(enc.known))
    assert held[0] < 1500
    if not bounds:
        assert held[0] < held[1] == held[2]


def test_tables_without_ids(spark, odd, tmp_path):
    manifest = tables.write_tables(docs(spark, odd), PATH, 2, f"file://{tmp_path}/t")
    got = tables.read_tables(spark, manifest, with_ids=False)
    assert got.columns == ["doc_id", "start", "n_tokens", "ids_crc32"]
    assert sorted(got.collect(), key=str) == sorted(tables.read_tables(spark, manifest).drop("ids").collect(), key=str)


def test_token_counts(spark, odd):
    out = sorted(token_counts.token_counts(docs(spark, odd), PATH).collect(), key=str)
    assert out == sorted([(i, len((t or "").encode()), n := len(reference(t)) // 4, n > 512) for i, t, _ in odd], key=str)
    assert token_counts.token_counts(empty(spark), PATH).count() == 0


def test_tables(spark, odd, tmp_path):
    manifest = tables.write_tables(docs(spark, odd), PATH, 2, f"file://{tmp_path}/t")
    got = sorted(tables.read_tables(spark, manifest).collect(), key=lambda r: r["start"])
    assert sum(r["n_tokens"] for r in got) == sum(len(reference(t, 2)) // 4 for _, t, _ in odd)
    start = 0
    for r, i in zip(got, sorted((i for i, _, _ in odd), key=lambda i: (i is not None, i)), strict=True):
        assert (r["doc_id"], r["start"]) == (i, start) and r["ids_crc32"] == zlib.crc32(r["ids"])
        start += r["n_tokens"]
    found = []
    for row in manifest.collect():
        with open(row["path"].removeprefix("file://"), "rb") as f:
            import os

            found += tables.Reader(f, os.fstat(f.fileno()).st_size).get(1)
    assert found == [reference(odd[0][1], 2)] * 2
    none = tables.write_tables(empty(spark), PATH, 2, f"file://{tmp_path}/e")
    assert tables.read_tables(spark, none).count() == 0


def test_packing(spark, odd):
    got = packing.pack(docs(spark, odd), PATH).toPandas()
    assert got["length"].sum() == sum(len(reference(t, 0)) // 4 for _, t, _ in odd)
    for _, g in got.groupby("sequence_id"):
        g = g.sort_values("offset")
        assert g["length"].sum() <= 2048 and list(g["offset"]) == [0, *np.cumsum(g["length"])[:-1]]
    assert packing.pack(empty(spark), PATH).count() == 0
    assert sum(s for s, _ in packing.best_fit([(3, b""), (5, b""), (2, b"")], 5)) == 10 and len(list(packing.best_fit([(3, b""), (5, b""), (2, b"")], 5))) == 2


def test_near_duplicates(spark, odd):
    got = sorted(minhash_dedup.near_duplicates(docs(spark, odd), 3, 85).select("doc_id", "component_id", "kept").collect(), key=str)
    want = [(1, 1, True), (1, 1, True), (2, 1, False), (3, 3, True), (4, 4, True), (None, None, True), (5, 5, True), (6, 5, False), (7, 7, True), (8, 1, False)]
    assert got == sorted(want, key=str)
    kept = minhash_dedup.keep_one(docs(spark, odd), 3, 85)
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == ["1", "3", "4", "5", "7", "None"] and kept.columns == ["doc_id", "text", "source", "key"]
    assert minhash_dedup.near_duplicates(empty(spark)).count() == 0


def test_components(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(1, 40)] + [(100, 90), (90, 95)], "a long, b long")
    want = {i: 1 for i in range(1, 41)} | {90: 90, 95: 90, 100: 90}
    assert dict(common.components(links).collect()) == want
    settled = common._settled(common.written(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")), "test"))
    assert dict(settled.collect()) == {k: v for k, v in want.items() if k != v}


@pytest.fixture(scope="module")
def points():
    draw = np.random.default_rng(4)
    centre = draw.standard_normal((6, 16))
    rows = [(i, (centre[i % 6] + 0.12 * draw.standard_normal(16)).tolist(), i % 2) for i in range(200)]
    return rows + [(200, None, 1), (201, [0.0] * 16, 1), (202, [float("nan")] * 16, 1), (203, rows[0][1], None), (204, rows[0][1], 0), (205, [1.0, 2.0], 0), (206, [1.0, None], 0), (207, [], 0)]


def brute(points):
    ok = [(i, np.array(v), c) for i, v, c in points if v and None not in v and np.isfinite(v).all() and np.any(v)]
    return [(i, v / np.linalg.norm(v), c) for i, v, c in ok]


def test_embedding_dedup(spark, points):
    got = {r["vec_id"]: r for r in embedding_dedup.near_duplicates(spark.createDataFrame(points, "vec_id long, embedding array<double>, label int"), 0.93, cell=20, block=16).collect()}
    ok = brute(points)
    for i, v, c in ok:
        assert got[i]["n_links"] == sum(1 for j, w, d in ok if j != i and c is not None and c == d and len(v) == len(w) and v @ w >= 0.93)
    assert len(got) == len(points) and all(got[i]["n_links"] == 0 and got[i]["kept"] for i in (200, 201, 202, 203))
    assert got[204]["component_id"] == got[0]["component_id"]


@pytest.fixture(scope="module")
def scattered():
    """Vectors without clusters in ten labels, some with near copies in chains, some with exact ones."""
    draw = np.random.default_rng(11)
    rows = [(i, draw.standard_normal(64), i % 10) for i in range(2000)]
    for i in range(0, 400, 4):
        at = rows[i]
        for k in range(3):
            at = (len(rows), at[1] + 0.3 * draw.standard_normal(64) * (k != 1), at[2])
            rows.append(at)
    return [(i, [float(x) for x in v.astype("f4")], c) for i, v, c in rows]


@pytest.mark.parametrize("bounds", [{}, {"cell": 40, "block": 30}, {"cell": 30, "block": 500}])
def test_embedding_dedup_of_scattered_vectors(spark, scattered, bounds):
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in embedding_dedup.near_duplicates(spark.createDataFrame(scattered, "vec_id long, embedding array<float>, label int"), 0.93, **bounds).collect()}
    x = np.array([v for _, v, _ in scattered])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    of = np.array([c for _, _, c in scattered])
    linked = (x @ x.T >= 0.93) & (of[:, None] == of[None])
    least, seen = np.arange(len(x)), None
    while seen is None or (seen != least).any():
        seen, least = least, np.where(linked, least[None], len(x)).min(axis=1)
    assert got == {i: (int(linked[i].sum()) - 1, int(least[i])) for i in range(len(x))}


def test_embedding_dedup_sends_scattered_vectors_once(spark, scattered):
    """Labels that fit a cell are not cut: what is shuffled stays near the size of the vectors, whatever the number of labels."""
    table = spark.createDataFrame(scattered, "vec_id long, embedding array<float>, label int")
    store, bus = (getattr(spark.sparkContext._jsc.sc(), x)() for x in ("statusStore", "listenerBus"))

    def shuffled():
        bus.waitUntilEmpty()
        return sum(store.executorList(True).apply(i).totalShuffleWrite() for i in range(store.executorList(True).size()))

    before = shuffled()
    embedding_dedup.near_duplicates(table, 0.93, cell=250).count()
    assert shuffled() - before < 2 * 256 * len(scattered)


def test_neighbours(spark, points):
    table = spark.createDataFrame(points, "vec_id long, embedding array<double>, label int")
    got = neighbours.search(table, F.col("vec_id") % 10 == 0, rows=50, queries=5).toPandas()
    ok, hits, total = brute(points), 0, 0
    for i, v, _ in ok:
        if i % 10 == 0:
            near = sorted((-(v @ w), j) for j, w, _ in ok if j != i and len(w) == len(v))[:5]
            hits += len({j for _, j in near} & set(got[got.query_id == i].vec_id))
            total += len(near)
    assert hits >= 0.95 * total and neighbours.search(table.where("vec_id < 0"), F.lit(True)).count() == 0


def test_rows_with_keys_are_set_apart_without_a_shuffle(spark):
    rows = spark.range(3000).select(F.md5(F.col("id").cast("string")).alias("key"), "id")
    keys = rows.where("id % 100 = 7").select("key")
    some, rest = pii._apart(rows, keys)
    a, b = ([r["id"] for r in x.collect()] for x in (some, rest))
    assert sorted(a + b) == list(range(3000)) and {i for i in range(3000) if i % 100 == 7} <= set(a) and len(a) < 300
    assert all("hashpartitioning" not in x._jdf.queryExecution().executedPlan().toString() for x in (some, rest))
    assert pii._apart(rows, keys.limit(0))[0].count() == 0


def test_pii(spark):
    text = "ü write a.b@c.de, 1.2.3.4 or 999.1.1.1, 4111 1111 1111 1111 and 4111111111111112, +1 (242) 555-3475 x@y z_q@w.org"
    got = pii.digest(docs(spark, [(1, text, ""), (2, None, ""), (None, "", "")])).orderBy(F.desc("spans")).collect()
    spans = [(k, *m.span()) for k, p in (("email", r"a\.b@c\.de|z_q@w\.org"), ("ip", r"1\.2\.3\.4"), ("card", "4111 1111 1111 1111"), ("phone", r"\+1 \(242\) 555-3475")) for m in re.finditer(p, text)]
    assert got[0]["spans"] == ",".join(f"{k}:{a}:{b}" for k, a, b in spans)
    assert pii.redact(docs(spark, [(1, text, ""), (2, None, "")])).orderBy("doc_id").collect()[1]["text"] is None
    clean = pii.redact(docs(spark, [(1, "mail a@b.cd now", "")])).first()["text"]
    assert clean == "mail [EMAIL] now"
    many = [(i, f"{words(20, i)} Wernher writes from boss@firm.org {words(20, i + 99)}", "") for i in range(6)] + [(9, f"{words(30, 77)} with Wernher there", "")]
    many += [(50 + i, words(20, 500 + i), "") for i in range(60)]
    found = {r["doc_id"]: r["spans"] for r in pii.digest(docs(spark, many)).collect()}
    assert "term:" in found[9] and pii.digest(empty(spark)).count() == 0
    long = "1 " * 60000 + "a@" + "b." * 40000
    assert pii.digest(docs(spark, [(1, long, "")])).first()["n_email"] == 1


def test_disclosing_terms_of_rare_entities(spark):
    """Entities that stand in one text each, or in two, and terms far away from them."""
    far = lambda i: words(30, 3000 + i)
    rows = [(i, f"Quillon {far(i)} u{i}@h{i}.org", "") for i in range(4)] + [(10, f"{far(10)} Quillon", "")]
    rows += [(20 + i, f"Brackwell {far(20 + i)} 10.20.30.40 {far(40 + i)}", "") for i in range(2)]
    rows += [(60, f"Solitary {far(60)} a@lone.net", ""), (61, f"{far(61)} org", "")] + [(100 + i, far(100 + i), "") for i in range(90)]
    copies = [(500 + i, rows[7][1], "") for i in range(3)]
    got = {r["doc_id"]: r["spans"] for r in pii.digest(docs(spark, [*rows, *copies])).collect()}
    place = lambda i, w: f"term:{(at := next(t for k, t, _ in rows if k == i).index(w))}:{at + len(w)}"
    for i in (0, 1, 2, 3, 10):
        assert place(i, "Quillon") in got[i]
    for i in (20, 21):
        assert place(i, "Brackwell") in got[i]
    assert all("term:" not in got[i] for i in (60, 61, *range(100, 190)))


def test_mixing(spark, odd):
    rows = [*odd, *[(100 + i, words(20 + i, i), "abc"[i % 3]) for i in range(60)]]
    got = mixing.mix(docs(spark, rows)).toPandas()
    for _, g in got.groupby("source", dropna=False):
        assert abs(g["taken"].sum() - min(g["target"].iloc[0], 2 * g["size"].sum())) <= mixing.PACKET
    assert got["taken"].sum() == int(1.5 * got["size"].sum())
    assert abs(got.groupby("source", dropna=False)["target"].first().sum() - 1.5 * got["size"].sum()) < 1e-6 and (got["taken"] <= 2 * got["size"]).all()
    assert mixing.mix(empty(spark)).count() == 0
    assert mixing.repeat(docs(spark, rows)).columns == ["doc_id", "text", "source", "key"]


def fair_queue(rows, packet):
    """Words taken of each doc_id by a plain simulation: water-filling by bisection, one sorted queue, cut at the budget."""
    import hashlib

    sizes = {i: len(t.split()) for i, t, _ in rows}
    names = sorted({s for _, _, s in rows if s is not None}) + [None] * any(s is None for _, _, s in rows)
    weight = dict(zip(names, [3, 1, 2] * len(names), strict=False))
    total = {s: sum(sizes[i] for i, _, x in rows if x == s) for s in names}
    low, high = 0.0, 2.0 * sum(total.values())
    for _ in range(200):
        level = (low + high) / 2
        low, high = (level, high) if sum(min(level * weight[s], 2 * total[s]) for s in names) < 1.5 * sum(total.values()) else (low, level)
    queue = []
    for s in names:
        target, at = min(high * weight[s], 2.0 * total[s]), 0
        mine = sorted((i for i, _, x in rows if x == s), key=lambda i: hashlib.md5(f"mix:{i}".encode()).hexdigest())
        for i in mine * 2:
            step = sizes[i] if at + sizes[i] <= target + 1e-6 else packet
            for k in range(0, sizes[i], step or 1):
                if at < target - 1e-6:
                    queue.append(((at + min(k + step, sizes[i])) / target, s is None, s or "", at % total[s], i, min(step, sizes[i] - k)))
            at += sizes[i]
    taken, left = dict.fromkeys(sizes, 0), int(1.5 * sum(total.values()))
    for *_, i, n in sorted(queue):
        taken[i] += min(n, left)
        left -= min(n, left)
    return taken


@pytest.mark.parametrize("seed", [1, 2])
def test_mixing_is_the_cut_queue(spark, seed):
    rows = [(i, words(random.Random(seed * 1000 + i).choice([3, 17, 40, 333]), i), random.Random(seed + i * 7).choice(["a", "b", "b", "b", "c", "d", None])) for i in range(150)]
    got = {r["doc_id"]: r["taken"] for r in mixing.mix(docs(spark, rows)).collect()}
    assert got == fair_queue(rows, mixing.PACKET)


def test_classifiers(spark):
    rows, marks = [], []
    for i in range(240):
        bad = i % 4 == 0
        rows.append((i, words(40, i) + (" you qopwvx idiotz" if bad else "") + (" ***!!" * 20 if i % 3 == 0 else ""), "a"))
        marks.append((i, int(i % 3 != 0), int(bad)))
    rows += [(None, "x", "a"), (900, None, "a"), (901, "", "a")]
    labels = spark.createDataFrame(marks, "doc_id long, quality int, toxic int")
    for module, column in ((toxicity, 2), (quality, 1)):
        got = {r["doc_id"]: r for r in module.classify(docs(spark, rows), labels).collect()}
        held = [m for m in marks if got[m[0]]["held_out"]]
        assert len(got) == len(rows) and sum(got[m[0]]["predicted"] == m[column] for m in held) >= 0.9 * len(held)
        assert all(0 <= r["score"] <= 1 for r in got.values())
        assert module.classify(empty(spark), labels).count() == 0
        assert module.classify(docs(spark, rows[:3]), labels.where("doc_id < 0")).count() == 3


def test_subsequence_kernel():
    """The kernel against a direct count of gapped subsequences."""
    from itertools import combinations

    def direct(a, b):
        def features(w):
            w, out = "\n" + w, {}
            for x in combinations(range(len(w)), toxicity.ORDER):
                if x[-1] - x[0] < toxicity.SPAN and all(i == 0 or w[i].isalnum() for i in x):
                    key = "".join(w[i] for i in x)
                    out[key] = out.get(key, 0.0) + toxicity.DECAY ** (x[-1] - x[0] + 1)
            return out

        x, y = features(a), features(b)
        dot = lambda p, q: sum(v * q.get(k, 0.0) for k, v in p.items())
        low = (dot(x, x) * dot(y, y)) ** 0.5
        k = dot(x, y) / low if low else 0.0
        return k**toxicity.POWER if k >= toxicity.FLOOR else 0.0

    marks = ["idiot", "worthless", "réeux", "anananan", "a"]
    some = ["idiot", "i.d.i.o.t", "idxiot", "idi*ot", "worthles", "réeuxment", "banana", "", "x", "***", "IDIOT".lower() * 3, "中文字符"]
    got = toxicity.Landmarks(marks).kernels(some)
    want = [[direct(a, b) for b in marks] for a in some]
    assert np.allclose(got, want, atol=2e-3)
    assert got[1][0] > 0.25 and got[2][0] > 0.1 and got[0][0] > 0.999


def test_toxicity_of_languages_and_spellings(spark):
    """Held-out recall and specificity for each language, spelled-out insults, and a hard negative: one telling word in a long clean text."""
    draw = random.Random(8)
    speech = {"a": ["onra", "theo", "ing", "bel", "sta", "mor"], "b": ["lich", "kei", "ung", "sch", "end", "ver"]}
    insult = {"a": ["qopwvx", "zuckrab"], "b": ["achfel", "grubko"]}
    rows, marks, kind = [], [], {}
    for i in range(500):
        of, bad = "ab"[i % 2], i % 5 == 0
        text = [draw.choice(speech[of]) + draw.choice(speech[of]) for _ in range(200)]
        for at in draw.sample(range(200), 5 if bad else int(i % 3 == 0)):
            text[at] = draw.choice(insult[of]) + (draw.choice(speech[of]) if of == "b" else "")
        rows.append((i, " ".join(text), of))
        marks.append((i, 1, int(bad)))
        kind[i] = of, bad
    rows += [(1000, " ".join(rows[1][1].split()[:100] + [".".join("qopwvx"), "q o p w v x", "qop*wvx", "zuck-rab"] * 2), "a"), (1001, None, "a"), (1002, "word " * 200_000, "a")]
    labels = spark.createDataFrame(marks, "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r for r in toxicity.classify(docs(spark, rows), labels).collect()}
    for of in "ab":
        for bad in (True, False):
            held = [i for i, k in kind.items() if k == (of, bad) and got[i]["held_out"]]
            assert sum(got[i]["predicted"] == int(bad) for i in held) >= 0.9 * len(held), (of, bad)
    assert got[1000]["predicted"] == 1 and got[1001]["predicted"] == 0 and got[1002]["predicted"] == 0
    kept = toxicity.reject(docs(spark, rows).withColumn("score", F.lit(7)), labels)
    assert kept.columns == ["doc_id", "text", "source", "key", "score"]
    assert {r["doc_id"] for r in kept.collect()} == {i for i, r in got.items() if r["predicted"] == 0}
    assert toxicity.reject(empty(spark), labels).count() == 0


def test_toxicity_is_not_learned_in_the_driver(spark, monkeypatch):
    """Its tables of words take hundreds of MB beside the driver's JVM: one task learns, also from nothing."""
    rows = [(i, " ".join(words(6, 10 * i + k) + (" qoxpwvz" if i % 2 else "") for k in range(4)), "a") for i in range(40)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, toxic int")
    found = labelled.sample(docs(spark, rows), labels, "toxic", toxicity.MODULUS, toxicity.REMAINDER, 30, 10_000)
    machine, *curve = toxicity.learn(found[1], found[0])
    monkeypatch.setattr(toxicity, "train", None)  # the workers have their own
    (marks, weights, noise), *same = toxicity.fit(docs(spark, rows), labels, 30, 10_000)
    assert marks == machine.marks and np.allclose(weights, machine.weights) and np.isclose(noise, machine.noise)
    assert np.allclose(same[0], curve[0]) and np.isclose(same[1], curve[1])
    monkeypatch.undo()
    assert toxicity.fit(empty(spark), labels) == (None, [0.0] * 3, 0.0)


def components_by_brute_force(rows, width, percent):
    """{doc_id: (n_shingles, component)} from all pairs' full sets."""
    sets = {}
    for i, text in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
        sets[i] = {tuple(w[k : k + width]) for k in range(max(1, len(w) - width + 1))} if w else set()
    root = {i: i for i in sets}
    for i in sorted(sets):
        for j in sorted(sets):
            shared = len(sets[i] & sets[j])
            if i < j and shared and 100 * shared >= percent * len(sets[i] | sets[j]) and root[i] != root[j]:
                low, high = sorted((root[i], root[j]))
                root = {k: low if r == high else r for k, r in root.items()}
    return {i: (len(sets[i]), root[i]) for i in sets}


@pytest.mark.parametrize("bounds", [{}, {"SMALL": 3, "WIDE": 8, "SIDE": 7, "WHOLE": 2, "EARLY": 1, "HOT": 1}])
def test_near_duplicates_by_brute_force(spark, monkeypatch, bounds):
    """Families of copies around the threshold, copies of a third of the rows, a passage that many share; every path, by lowered bounds."""
    for name, value in bounds.items():
        monkeypatch.setattr(minhash_dedup, name, value)
    draw, rows = random.Random(12), []
    passage = words(45, 99)
    for family in range(6):
        base = words(60 + 15 * family, family).split()
        for _ in range(18):
            copy = list(base)
            for at in draw.sample(range(len(copy)), draw.randint(0, 4)):
                copy[at] = words(1, draw.random())
            rows.append(" ".join(copy))
    rows += [rows[0]] * 40 + [f"{passage} {words(draw.randint(1, 14), 1000 + i)}" for i in range(40)] + [words(30, 2000 + i) for i in range(20)] + ["", None, " \t", "one", "One", "one two"]
    draw.shuffle(rows)
    rows = list(enumerate(rows))
    table = spark.createDataFrame([(i, t, i, "x") for i, t in rows], "doc_id long, text string, id long, in_group string")
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in minhash_dedup.near_duplicates(table, 3, 85).collect()}
    assert got == components_by_brute_force(rows, 3, 85)
    if bounds:
        kept = minhash_dedup.keep_one(table, 3, 85)
        assert kept.columns == table.columns and {r["doc_id"] for r in kept.collect()} == {i for i, (_, c) in got.items() if i == c}


def test_columns_of_any_name_pass(spark):
    names = ["__text", "__key", "m_email", "s_email", "s_term", "places", "row", "copy", "__copy", "words", "cut0", "of", "size", "taken", "ticket"]
    table = spark.createDataFrame([(i, f"mail u{i}@host.org {words(9, i)}", "ab"[i % 2], *([f"own {i}"] * len(names))) for i in range(6)], "doc_id long, text string, source string, " + ", ".join(f"{c} string" for c in names))
    for changed in (pii.redact(table), mixing.repeat(table)):
        assert changed.columns == table.columns
        assert all(r[c] == f"own {r['doc_id']}" for r in changed.collect() for c in names)
    assert {r["text"][:12] for r in pii.redact(table).collect()} == {"mail [EMAIL]"}
    assert pii.redact(empty(spark)).count() == 0 and mixing.repeat(empty(spark)).count() == 0


def test_few_candidates(spark):
    """A query whose only candidate is its antipode finds it."""
    v = [1.0, 2.0, 0.5, 0.1, 0.2, 0.3, 0.4]
    table = spark.createDataFrame([(50, v), (51, [-x for x in v])], "vec_id long, embedding array<double>")
    assert [(r["query_id"], r["vec_id"]) for r in neighbours.search(table, F.col("vec_id") % 50 == 0).collect()] == [(50, 51)]
