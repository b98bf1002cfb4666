"""Set joins, embeddings, decontamination, conversations and secrets against brute force on small tables."""

import random
import re
from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessera.llm import chat, decontamination, itq, secrets, set_join, shingles
from tessera.llm.common import components

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


class Forest(dict):
    def find(self, x):
        while self.setdefault(x, x) != x:
            x = self[x]
        return x

    def tie(self, a, b):
        a, b = self.find(a), self.find(b)
        self[max(a, b)] = min(a, b)


def shingle_set(text):
    words = WORD.findall((text or "").translate(LOW))
    return frozenset(tuple(words[k : k + 5]) for k in range(len(words) - 4)) if len(words) >= 5 else frozenset([tuple(words)] if words else [])


# components


def test_components_of_chains_stars_and_pairs(spark):
    edges = [(k, k + 1) for k in range(100, 130)] + [(5, k) for k in range(200, 260)] + [(1, 2), (2, 1), (3, 3), (900, 901)]
    found = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    forest = Forest()
    for a, b in edges:
        forest.tie(a, b)
    assert found == {x: forest.find(x) for a, b in edges for x in (a, b) if a != b}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


# set join


def test_shingles_equal_those_of_words(monkeypatch):
    texts = [None, "", "  \t\n", "One", "a b c d", "a b c d e", "A  B\tc\nd E f", "ä Ä É x y z é", "w " * 50, " ".join(f"x{k % 7}" for k in range(400)), "é" * 100, "end"]
    for piece in (1 << 20, 64):
        monkeypatch.setattr(shingles, "PIECE", piece)
        found = list(shingles.sets(pa.array(texts)))
        assert [len(x) for x in found] == [len(shingle_set(t)) for t in texts]
    hashes = {}
    for t, x in zip(texts, shingles.sets(pa.array([*texts, "A B C D E"])), strict=False):
        hashes.setdefault(shingle_set(t), set()).add(tuple(x.tolist()))
    assert all(len(v) == 1 for v in hashes.values())
    sliced = pa.array(["zz", *texts]).slice(1)
    assert [x.tolist() for x in shingles.sets(sliced)] == [x.tolist() for x in shingles.sets(pa.array(texts))]


@pytest.mark.parametrize("s", range(1, 41))
def test_bounds_hold_for_all_sizes(s):
    assert set_join.prefix(s) == s - -(-4 * s // 5) + 1
    for t in range(s, 5 * s // 4 + 1):
        least = next(o for o in range(s + 1) if 100 * o >= 80 * (s + t - o))
        assert least == set_join.shared(s, t)
        assert s - least < s - (8 * s + 8) // 9 + 1
        assert s > 16 or least in set_join.subset_sizes(s)
        assert t > 16 or least in set_join.subset_sizes(t)


def texts_with_copies(seed):
    rng = random.Random(seed)
    word = lambda: rng.choice("abcdefghijklmnop") + rng.choice("aeiou")
    passage = [word() for _ in range(30)]
    out = []
    for _ in range(45):
        base = [word() for _ in range(rng.choice([0, 1, 2, 3, 4, 5, 6, 8, 10, 12, 15, 20, 30, 60, 120]))]
        if rng.random() < 0.3:
            base[len(base) // 2 : len(base) // 2] = passage
        out.append(" ".join(base))
        for _ in range(rng.randint(0, 4)):
            copy = list(base)
            for _ in range(rng.randint(0, 3)):
                if copy:
                    at = rng.randrange(len(copy))
                    copy[at : at + rng.randint(0, 1)] = [word()] * rng.randint(0, 2)
            out.append(" ".join(copy).upper() if rng.random() < 0.2 else "  ".join(copy))
    base = [word() for _ in range(40)]
    out += [" ".join([*base[:k], word(), *base[k + 1 :]]) for k in range(40)] + [" ".join(base)] * 5
    rng.shuffle(out)
    return [*out, None, "", None]


@pytest.mark.parametrize("seed", [1, 2])
def test_components_equal_brute_force(spark, monkeypatch, seed):
    if seed == 2:  # frequent members, several counting groups, blocks and the unbroadcast way, on few rows
        monkeypatch.setattr(set_join, "FREQUENT_FROM", 3)
        monkeypatch.setattr(set_join, "BROADCAST_ROWS", 0)
        monkeypatch.setattr(set_join, "COUNTED", 500)
        monkeypatch.setattr(set_join, "HELD", 100)
    texts = texts_with_copies(seed)
    rows = [(100 - k, t) for k, t in enumerate(texts)]
    sets = {i: shingle_set(t) for i, t in rows}
    forest = Forest()
    for (i, x), (j, y) in combinations(sets.items(), 2):
        if x and y and 100 * len(x & y) >= 80 * len(x | y):
            forest.tie(i, j)
    docs = spark.createDataFrame([(i, t, 1, "b") for i, t in rows] + [(rows[5][0], rows[5][1], 1, "b")], "doc_id long, text string, doc int, sid string").repartition(3)
    found = set_join.components_by_jaccard(docs).collect()
    assert len(found) == len(rows) + 1
    assert {(r["doc_id"], r["n_shingles"], r["component_id"]) for r in found} == {(i, len(x), forest.find(i)) for i, x in sets.items()}


def test_set_join_of_nothing_and_of_null_ids(spark):
    schema = "doc_id long, text string"
    assert set_join.components_by_jaccard(spark.createDataFrame([], schema)).count() == 0
    found = set_join.components_by_jaccard(spark.createDataFrame([(None, "a b c d e f"), (4, "a b c d e f"), (5, "z")], schema)).collect()
    assert {tuple(r) for r in found} == {(None, 2, None), (4, 2, None), (5, 1, 5)}


@pytest.mark.parametrize("pairs", [0, 500_000])
def test_links_of_rows_that_share_an_id_or_have_none(spark, monkeypatch, pairs):
    monkeypatch.setattr(set_join, "BROADCAST_ROWS", pairs)
    texts = [t for t in texts_with_copies(3) if t]
    rows = [(None if k % 3 == 0 else 7 if k % 3 == 1 else 100 + k, t) for k, t in enumerate(texts)]
    rows += [(None, t) for _, t in rows[::5]]
    sets = [shingle_set(t) for _, t in rows]
    forest = Forest()
    for i, j in combinations(range(len(rows)), 2):
        if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
            forest.tie(i, j)
    least: dict = {}
    for k, (i, _) in enumerate(rows):
        least.setdefault(forest.find(k), []).append(i)
    expected = sorted((str(i), len(sets[k]), str(None if None in (ids := least[forest.find(k)]) else min(ids))) for k, (i, _) in enumerate(rows))
    found = set_join.components_by_jaccard(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert sorted((str(r["doc_id"]), r["n_shingles"], str(r["component_id"])) for r in found) == expected


# embeddings


def test_links_equal_brute_force(spark):
    rng = np.random.default_rng(4)
    base = rng.standard_normal((60, 32))
    rows = [(k, int(k % 3), (v * 3).tolist()) for k, v in enumerate(base)]
    rows += [(1000 + k, int(k % 60 % 3), (base[k % 60] + 0.04 * rng.standard_normal(32)).tolist()) for k in range(240)]
    rows += [(2000 + k, 0, base[0].tolist()) for k in range(30)] + [(3000, 1, base[0].tolist()), (3001, None, base[0].tolist())]
    odd = [(4000, 0, None), (4001, 0, [0.0] * 32), (4002, 0, [float("nan")] * 32), (4003, 0, [None] * 32), (4004, 0, [float("inf")] + [1.0] * 31), (4005, 0, []), (4006, 0, [1.0, 2.0]), (4007, 0, [1.0, 2.0])]
    df = spark.createDataFrame([(*r, "x") for r in rows + odd], "vec_id long, label int, embedding array<double>, node string")
    found = {r["vec_id"]: r for r in itq.links(df).collect()}
    assert len(found) == len(rows) + len(odd)
    ids, v = np.array([r[0] for r in rows]), np.array([r[2] for r in rows])
    unit = v / np.linalg.norm(v, axis=1, keepdims=True)
    label = np.array([-1 if r[1] is None else r[1] for r in rows])
    near = (unit @ unit.T >= 0.98) & (label[:, None] == label[None, :]) & (label[:, None] >= 0)
    np.fill_diagonal(near, False)
    forest = Forest()
    for i, j in zip(*np.nonzero(near), strict=True):
        forest.tie(int(ids[i]), int(ids[j]))
    links = sum(r["n_links"] for i, r in found.items() if i < 4000)
    assert 0.97 * near.sum() <= links <= near.sum()
    assert all(found[int(i)]["n_links"] <= n for i, n in zip(ids, near.sum(axis=1), strict=True))
    assert sum(found[int(i)]["component_id"] == forest.find(int(i)) for i in ids) >= 0.97 * len(ids)
    assert all(found[i]["n_links"] == 0 and found[i]["component_id"] == i and found[i]["kept"] for i in range(4000, 4006))
    assert found[4006]["n_links"] == found[4007]["n_links"] == 1
    assert found[3001]["n_links"] == 0
    assert all(r["kept"] == (i == r["component_id"]) for i, r in found.items())
    assert itq.links(df.limit(0)).count() == 0


def test_long_lists_are_compared_in_blocks(spark, monkeypatch):
    rng = np.random.default_rng(6)
    rows = [(k, 1, (np.ones(16) + 0.001 * rng.standard_normal(16)).tolist()) for k in range(70)]
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>")
    monkeypatch.setattr(itq, "BLOCK", 16)
    found = itq.links(df).collect()
    assert all(r["component_id"] == 0 for r in found)
    assert all(r["n_links"] == 69 for r in found)


def test_recall_of_pairs_just_above_the_threshold(spark):
    rng = np.random.default_rng(9)
    one = rng.standard_normal((2000, 64))
    one /= np.linalg.norm(one, axis=1, keepdims=True)
    off = rng.standard_normal((2000, 64))
    off -= (off * one).sum(axis=1, keepdims=True) * one
    off /= np.linalg.norm(off, axis=1, keepdims=True)
    cosine = rng.uniform(0.9801, 0.985, (2000, 1))
    other = cosine * one + np.sqrt(1 - cosine**2) * off
    rows = [(k, 1, v.tolist()) for k, v in enumerate(np.concatenate([one, other]))] + [(0, 1, one[0].tolist())]
    found = itq.links(spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>")).collect()
    assert len(found) == 4001
    linked = sum(r["component_id"] == r["vec_id"] - 2000 for r in found if r["vec_id"] >= 2000)
    assert linked >= 0.99 * 2000
    # Rows that repeat a vec_id are vectors of their own with that id.
    assert [r["n_links"] for r in found if r["vec_id"] == 0] == [2, 2]


# decontamination


def test_overlaps_survive_substitutions(spark):
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(4))
    items = [[word() for _ in range(40)], [word() for _ in range(14)], [word() for _ in range(5)], []]
    swapped = list(items[0])
    for at in (6, 13, 20, 27, 34):
        swapped[at] = "other"
    noise = lambda n: [word() for _ in range(n)]
    docs = {
        1: [*noise(50), *items[0], *noise(30)], 2: [*noise(7), *swapped, *noise(3)], 3: items[1], 4: [*noise(20), *items[0][:20], *noise(20)], 5: noise(200), 6: [*noise(30), *items[0][5:14], *noise(30)], 7: items[2], 8: [],
        9: [w.upper() + "," for w in items[1]],
    }
    schema = "doc_id long, text string, item string, words int"
    df = spark.createDataFrame([(i, " ".join(w), "i", 0) for i, w in docs.items()] + [(10, None, "i", 0), (1, " ".join(docs[1]), "i", 0), (None, " ".join(items[0]), "i", 0)], schema)
    bench = spark.createDataFrame([(k, " ".join(w)) for k, w in enumerate(items)] + [(9, None)], "item_id long, text string")
    found = {(r["doc_id"], r["item_id"]): r for r in decontamination.overlaps(df, bench).collect()}
    assert set(found) == {(1, 0), (2, 0), (3, 1), (4, 0), (9, 1), (None, 0)}
    assert (found[1, 0]["score"], found[1, 0]["item_start"], found[1, 0]["item_end"]) == (40, 0, 40)
    assert (found[2, 0]["matches"], found[2, 0]["score"]) == (35, 25)
    assert found[4, 0]["score"] == 20
    assert {r["doc_id"] for r in decontamination.clean(df, bench).collect()} == {5, 6, 7, 8, 10}
    assert decontamination.overlaps(df.limit(0), bench).count() == decontamination.overlaps(df, bench.limit(0)).count() == 0


def test_short_items_survive_substitutions(spark):
    rng = random.Random(13)
    text = lambda n: ["".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(n)]
    items = {n: text(n) for n in (1, 3, 5, 8, 9, 12, 14, 15, 18, 19)}
    docs, hit = [], set()
    for n, item in items.items():
        most = 0 if n < 9 else n - -(-85 * n // 100)
        for at in combinations(range(n), most):
            docs.append((n, [*text(rng.randint(0, 9) if n >= 5 else 0), *["other" if k in at else w for k, w in enumerate(item)], *text(rng.randint(0, 9) if n >= 5 else 0)]))
    wrong = [[*text(3), *items[3], *text(2)], [*text(3), *items[8][:7], *text(4)], [*items[12][:4], "x", "y", "z", *items[12][7:]]]
    rows = [(k, " ".join(w)) for k, (_, w) in enumerate(docs)] + [(-1 - k, " ".join(w)) for k, w in enumerate(wrong)]
    hit = {(k, n) for k, (n, _) in enumerate(docs)}
    df = spark.createDataFrame(rows, "doc_id long, text string")
    bench = spark.createDataFrame([(n, " ".join(w)) for n, w in items.items()], "item_id long, text string")
    assert {(r["doc_id"], r["item_id"]) for r in decontamination.overlaps(df, bench, short_items=True).collect()} == hit
    assert {r["doc_id"] for r in decontamination.clean(df, bench, short_items=True).collect()} == {-1, -2, -3}


def brute_overlaps(docs, items):
    """(document, item) of all alignments at which a stretch, or 85 % of a short item, matches."""
    words = lambda t: [w for w in re.split(r"[\W_]+", (t or "").lower()) if w]
    hit = set()
    for i, text in docs:
        a = words(text)
        for j, item in items:
            b = words(item)
            for shift in range(-len(b) + 1, len(a)):
                same = [0 <= k + shift < len(a) and a[k + shift] == w for k, w in enumerate(b)]
                inside = [s for k, s in enumerate(same) if 0 <= k + shift < len(a)]
                best = score = 0
                for s in inside:
                    score = max(0, score + (1 if s else -2))
                    best = max(best, score)
                if len(b) >= 9 and (best >= min(13, len(b)) or len(b) < 20 and 100 * sum(same) >= 85 * len(b)):
                    hit.add((i, j))
    return hit


def test_overlaps_equal_brute_force_with_runs_of_words(spark):
    rng = random.Random(17)
    word = lambda: rng.choice("abcdefghijklmnopqrstuvwxyz") + rng.choice("aeiou")
    items = [(k, " ".join(word() for _ in range(n))) for k, n in enumerate((9, 12, 16, 25, 40))]
    items += [(10, "la " * 30), (11, "la " * 12 + " ".join(word() for _ in range(9))), (12, "do re " * 12), (13, " ".join(word() for _ in range(6)) + " mi fa so" * 6)]
    docs = []
    for i in range(70):
        w = [word() for _ in range(rng.randint(0, 40))]
        for _ in range(rng.randint(0, 2)):
            part = rng.choice(items)[1].split()
            lo = rng.randint(0, len(part) // 3)
            part = part[lo : lo + rng.randint(9, 40)]
            for _ in range(rng.randint(0, 3)):
                part[rng.randrange(len(part))] = "other"
            at = rng.randint(0, len(w))
            w[at:at] = part
        docs.append((i, " ".join(w)))
    docs += [(100, "la " * 4000), (101, "la " * 50 + items[6][1]), (102, "do re " * 300), (103, "re do " * 7), (104, "mi fa so " * 50), (105, items[8][1] + " mi fa so" * 9), (106, "la " * 8)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    found = {(r["doc_id"], r["item_id"]) for r in decontamination.overlaps(df, spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert found == brute_overlaps(docs, items)


def test_clean_rows_without_an_id_of_their_own_stay(spark):
    rng = random.Random(12)
    text = lambda n: " ".join("".join(rng.choice("abcdefghij") for _ in range(4)) for _ in range(n))
    item = text(30)
    dirty = [(i, f"{text(9)} {item} {text(k)}") for k, i in enumerate([None, None, 7, 8])]
    fine = [(i, text(40)) for i in [None, None, None, 7, 7, 9]] + [(None, None), (7, "")]
    df = spark.createDataFrame([*dirty, *fine], "doc_id long, text string")
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    assert sorted(map(str, map(tuple, decontamination.clean(df, bench).collect()))) == sorted(map(str, fine))
    assert sorted(str(r["doc_id"]) for r in decontamination.overlaps(df, bench).collect()) == ["7", "8", "None", "None"]


def test_decontamination_stays_in_the_jvm(spark, sf):
    from tessera.llm.queries import queries

    plan = queries()["op5_spaced_seed_decontamination"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


# conversations


def test_maximal_conversations_equal_brute_force(spark):
    rng = random.Random(9)
    said = lambda: rng.choice(["hi", "yes", "no", None, ""])
    logs = {}
    for k in range(60):
        if logs and rng.random() < 0.5:
            turns = list(rng.choice(list(logs.values())))[: rng.randint(1, 9)]
        else:
            turns = []
        logs[k] = turns + [(rng.choice(["user", "assistant", None]), said()) for _ in range(rng.randint(0 if turns else 1, 4))]
    rows = [(k, n, r, t, 5) for k, turns in logs.items() for n, (r, t) in enumerate(turns)]
    rng.shuffle(rows)
    # Turns of one number, in order of role and text; rows without a conversation, one of them as a conversation has it.
    logs |= {98: sorted([("user", f"x{k:03}") for k in range(60)] + [("user", "x007")] * 40), 99: [("user", "x")], 97: [("user", "y" * 100_000)]}
    logs |= {"a": [("user", "lone")], "b": [("user", "lone")], "c": [("user", "x")], "d": [(None, None)], "e": [(None, "")]}
    rows += [(k, None if k > 97 else 3, *t, 5) for k in (97, 98, 99) for t in logs[k]] + [(None, n, *logs[k][0], 5) for n, k in enumerate("abcde")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, at int")
    found = chat.render(df).collect()
    logs = {(j if isinstance(j, int) else None, j): t for j, t in logs.items()}
    expected = set()
    for (k, name), turns in logs.items():
        same = [j for j, t in logs.items() if t == turns]
        if (k, name) == min(same, key=lambda j: (j[0] is None, str(j[1]) if j[0] is None else j[0])) and not any(len(t) > len(turns) and t[: len(turns)] == turns for t in logs.values()):
            expected.add((k, len(turns), len(same), "".join(f"<|{r or ''}|>\n{t or ''}<|end|>\n" for r, t in turns)))
    assert {tuple(r) for r in found} == expected
    assert chat.render(df.limit(0)).count() == 0


# secrets


def test_the_forest_keeps_keys_and_drops_what_looks_like_them(spark):
    labelled = secrets.findings(spark, 6000)
    assert labelled.exceptAll(secrets.findings(spark, 6000)).count() == 0
    model = secrets.train(labelled.filter("id % 5 <> 0"), trees=12)
    from pyspark.ml.feature import VectorAssembler

    held = model.transform(VectorAssembler(inputCols=secrets.FEATURES, outputCol="features").transform(secrets.features(labelled.filter("id % 5 = 0"))))
    assert held.filter("prediction = label").count() >= 0.95 * held.count()
    key = "f3a9c1d2e4b5a6978877665544332211aabbccdd"
    texts = [f'some words token = "{key}" and more', f"see commit {key} for more", "call 4556737586899855 now", None, "", "nothing here", f'api_key: {key}\nagain secret="{key}"', "x" * 100_000 + " y"]
    docs = spark.createDataFrame([(k, t, "src1", "w") for k, t in enumerate(texts)] + [(0, texts[0], None, "w")], "doc_id long, text string, source string, word string")
    found = [(r["doc_id"], r["candidate"]) for r in secrets.scan(docs, model).collect()]
    assert sorted(found) == [(0, key), (0, key), (6, key), (6, key)]
    assert secrets.scan(docs.limit(0), model).count() == 0
    assert not re.search("Python|Pandas|Arrow", secrets.scan(docs, model)._jdf.queryExecution().executedPlan().toString())


def test_planted_secrets_are_found_in_corpus_text_and_little_else(spark, sf):
    """Secrets and what looks like them, made by other rules than the labelled findings, among the words of the corpus."""
    rng = random.Random(23)
    chars = lambda letters, n: "".join(rng.choice(letters) for _ in range(n))
    low, up, num = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
    secret = [
        lambda: f'token = "{chars(num + "abcdef", 40)}"', lambda: f"password={chars(low + up + num, 6)}!{chars(low + num, 4)}", lambda: f"api_key: {chars(low + up + num, 32)}", lambda: f'secret = "{chars(low + up, 24)}"',
        lambda: f"AKIA{chars(up + num, 16)}", lambda: f"Bearer: eyJ{chars(low + up + num, 20)}.eyJ{chars(low + up + num, 40)}.{chars(low + up + num + '_-', 43)}", lambda: f"ghp_{chars(low + up + num, 36)}", lambda: f"passwd: '{chars(up + low + num, 12)}'",
    ]
    fake = [
        lambda: f"commit {chars(num + 'abcdef', 40)}", lambda: f"uuid: {'-'.join(chars(num + 'abcdef', n) for n in (8, 4, 4, 4, 12))}", lambda: f"card {chars(num, 16)}", lambda: "password = ${DB_PASSWORD}", lambda: f"mail: {chars(low, 6)}.{chars(num, 2)}@mail.example.com",
        lambda: "api_key=your_api_key_here", lambda: f"see /var/log/service/output/{chars(num, 4)}", lambda: "secret = xxxxxxxxxxxxxxxxxxxx",
    ]
    rows, planted = [], {}
    docs = spark.read.parquet(f"{sf}/documents.parquet").filter("not coalesce(text, '') rlike '(?i)token'").select("text").limit(160).collect()
    for k, r in enumerate(docs):
        words = (r["text"] or "").split(" ")[:300]
        made = rng.choice(secret)() if k % 2 else rng.choice(fake)()
        words.insert(rng.randrange(len(words) + 1), made)
        planted[k] = made
        rows.append((k, " ".join(words), "src0"))
    found = {}
    for r in secrets.scan(spark.createDataFrame(rows, "doc_id long, text string, source string"), secrets.train(secrets.findings(spark))).collect():
        found.setdefault(r["doc_id"], []).append(r["candidate"])
    caught = sum(any(c in planted[k] for c in found.get(k, [])) for k in planted if k % 2)
    wrong = sum(len([c for c in v if not (k % 2 and c in planted[k])]) for k, v in found.items())
    assert caught >= 0.9 * sum(k % 2 for k in planted)
    assert wrong <= 0.05 * len(planted)
