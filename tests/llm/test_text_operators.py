"""Line dedup, packing, language, toxicity and url rules on small tables, with nulls, empties, ties, repeats and clashing names."""

import random
import zlib
from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessera.llm import langid, line_dedup, packing, toxicity, url_rules

VOCAB = None


def tokenizer_path():
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


# packing


TEXTS = [None, "", "Hello, World's 12 tests!", "don't   stop\n\nnow", "naïve café ÉÀ ßtraße", "<|endoftext|> x", "İstanbul Σίσυφος 漢字 ́a", "word " * 5000, "a" * 3000, "\x1c\x85 odd spaces", "x'sure ''re 're", "_a_b__c 1a2b ²½"]


def test_pieces_hold_every_token_once(spark):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(tokenizer_path())
    docs = spark.createDataFrame([(k, t, 1, "x") for k, t in enumerate(TEXTS)] + [(1, "", 1, "x"), (None, "null id", 1, "x")], "doc_id long, text string, length int, start string")
    rows = packing.pack(docs, tokenizer_path()).collect()
    assert len({r["sequence_id"] for r in rows}) == len(rows)
    assert all(r["length"] & (r["length"] - 1) == 0 and r["length"] <= 4096 and r["length"] == 1 << r["bucket"] and r["offset"] == 0 for r in rows)
    for k, t in enumerate(TEXTS):
        own = sorted((r for r in rows if r["doc_id"] == k), key=lambda r: r["start"])
        if k == 1:
            assert [(r["length"], r["doc_tokens"]) for r in own] == [(1, 1), (1, 1)]
            continue
        ids = np.frombuffer(b"".join(r["ids"] for r in own), "<u4").tolist()
        assert ids == [*tokenizer.encode(t or "", add_special_tokens=False).ids, 2]
        assert [r["start"] for r in own] == np.cumsum([0, *[r["length"] for r in own]])[:-1].tolist()
        assert {r["doc_tokens"] for r in own} == {len(ids)}
    assert packing.pack(docs.limit(0), tokenizer_path()).count() == 0


def test_words_merge_as_the_tokenizer_merges_them():
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(tokenizer_path())
    table = packing.ranks(tokenizer_path())
    assert table is not None
    words, rng = packing.WordTokens(tokenizer, *table), random.Random(3)
    for _ in range(3000):
        text = "".join(rng.choice("aeiourstnlmdhcé ÜßA19'-.,!#") for _ in range(rng.randint(1, 24)))
        assert np.frombuffer(packing.encode(text, tokenizer, words), "<u4").tolist() == tokenizer.encode(text, add_special_tokens=False).ids


def test_every_ordinary_character_is_split_as_the_tokenizer_splits_it():
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(tokenizer_path())
    words = packing.WordTokens(tokenizer, *packing.ranks(tokenizer_path()))
    ordinary = [c for c in map(chr, [*range(0xD800), *range(0xE000, 0x10000)]) if packing._PLAIN.fullmatch(c)]
    texts = [t for c in ordinary for t in (c, f"a{c}b", f" {c}{c} ", f"1{c}2 é{c}", f"x{c}'s {c}'ll", f"Word.{c}, {c}!_")]
    found = packing.encode_all(pa.array(texts), tokenizer, words)
    assert [np.frombuffer(ids, "<u4").tolist() for ids in found] == [e.ids for e in tokenizer.encode_batch(texts, add_special_tokens=False)]


@pytest.mark.parametrize("together", [1, 40, 1 << 20])
def test_texts_together_give_the_ids_of_each(monkeypatch, together):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(tokenizer_path())
    monkeypatch.setattr(packing, "_TOGETHER", together)
    texts = ["", "  \n", " a  b ", *(t or "" for t in TEXTS), "", "İ", "last word"]
    want = [tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
    for table in (packing.ranks(tokenizer_path()), (None, None)):
        found = packing.encode_all(pa.array([*texts, "not read"]).slice(0, len(texts)), tokenizer, packing.WordTokens(tokenizer, *table))
        assert [np.frombuffer(ids, "<u4").tolist() for ids in found] == want
    assert list(packing.encode_all(pa.array([], pa.string()), tokenizer, packing.WordTokens(tokenizer, None, None))) == []


def test_a_word_is_merged_once_for_texts_together():
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(tokenizer_path())
    words, merged = packing.WordTokens(tokenizer, *packing.ranks(tokenizer_path()), 10), []
    merger = words.merger
    words.merger = type("Counting", (), {"encode_single_piece": lambda self, raw: merged.append(raw) or merger.encode_single_piece(raw)})()
    text = " ".join(["the", *(a + b for a in "bcdfg" for b in ("ara", "ele", "oro", "unu"))] * 50)
    ids = packing.encode(text, tokenizer, words)
    assert np.frombuffer(ids, "<u4").tolist() == tokenizer.encode(text, add_special_tokens=False).ids
    assert len(merged) == len(set(merged)) == 21


@pytest.mark.parametrize("n", [1, 2, 3, 4095, 4096, 4097, 10000])
def test_lengths(n):
    found = packing.lengths(n, 4096)
    assert sum(found) == n
    assert found == sorted(found, reverse=True)


# line dedup


def brute_dedup(docs, how):
    """Each document in order of its id loses the compared chunks that an earlier one, or it itself, has had."""
    had, out = {}, []
    for doc_id, text in sorted(docs, key=lambda d: d[0]):
        lines = (text or "").split("\n")
        kept, own = [], set()
        for a, b, compared in how.chunks(text or "") if text else []:
            chunk = "\n".join(lines[a:b])
            if not (compared and (chunk in own or had.get(chunk, doc_id) < doc_id)):
                kept += lines[a:b]
            if compared:
                own.add(chunk)
        for chunk in own:
            had.setdefault(chunk, doc_id)
        out.append((doc_id, "\n".join(kept) if text else text))
    return out


def test_repeated_chunks_go_from_all_but_the_first_document(spark):
    rng = random.Random(5)
    line = lambda n: " ".join(rng.choice("abcdefgh") * rng.randint(1, 4) for _ in range(n))
    passage, long_line = "\n".join(line(12) for _ in range(8)), line(60)
    docs = []
    for k in range(40):
        parts = [line(rng.randint(1, 20)) for _ in range(rng.randint(0, 6))]
        if k % 3 == 0:
            parts.insert(rng.randint(0, len(parts)), passage)
        if k % 4 == 0:
            parts.insert(rng.randint(0, len(parts)), long_line)
        docs.append((k, "\n".join(parts)))
    docs += [(50, docs[3][1]), (51, docs[3][1]), (52, ""), (53, None), (54, passage + "\n" + passage)]
    df = spark.createDataFrame([(i, t, "r", 7) for i, t in docs], "doc_id long, text string, row string, chunks int")
    done = line_dedup.dedup(df)
    assert done.columns == ["doc_id", "text", "row", "chunks", line_dedup.REPORT]
    assert sorted((r["doc_id"], r["text"]) for r in done.collect() if r["text"] is not None) == [d for d in brute_dedup(docs, line_dedup.Chunking()) if d[1] is not None]
    assert sum(long_line in (r["text"] or "") for r in done.collect()) == 1
    assert done.filter("doc_id = 53 and text is null and row = 'r' and chunks = 7").count() == 1
    assert line_dedup.dedup(df.limit(0)).count() == 0


def test_ids_that_repeat_or_are_null(spark):
    text = "\n".join(f"word number {k} of a line with some more words in it" for k in range(6))
    df = spark.createDataFrame([(7, text), (7, text), (None, text), (8, text)], "doc_id long, text string")
    kept = {(r["doc_id"], r["text"] == text) for r in line_dedup.dedup(df).collect()}
    assert kept == {(None, True), (7, False), (8, False)}


def test_an_inserted_line_moves_no_other_boundary():
    how = line_dedup.Chunking()
    lines = [f"line {k} has a few words" for k in range(60)]
    cut = lambda ls: {"\n".join(ls[a:b]) for a, b, _ in how.chunks("\n".join(ls))}
    assert len(cut(lines) - cut([*lines[:30], "something new", *lines[30:]])) <= 2


def covered(text, earlier, least=50):
    """The lines of ``text`` in runs of more than ``least`` words that stand in a row in one of ``earlier``."""
    lines, gone = text.split("\n"), set()
    for other in earlier:
        theirs = other.split("\n")
        for a in range(len(lines)):
            for c in range(len(theirs)):
                n = 0
                while a + n < len(lines) and c + n < len(theirs) and lines[a + n] == theirs[c + n]:
                    n += 1
                if len(" ".join(lines[a : a + n]).split()) > least:
                    gone.update(range(a, a + n))
    return gone


def test_planted_passages_of_several_lines_go_whole(spark):
    rng = random.Random(11)
    line = lambda n: " ".join("".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(n))
    docs = []
    for k in range(40):
        lines = [line(rng.randint(1, 30)) for _ in range(rng.randint(3, 12))]
        if k and k % 2:
            theirs = docs[rng.randrange(len(docs))][1].split("\n")
            a = rng.randrange(len(theirs))
            at = rng.randint(0, len(lines))
            lines[at:at] = theirs[a : a + rng.randint(2, 9)]
        docs.append((k, "\n".join(lines)))
    docs += [(100, docs[4][1]), (101, "\n".join(["same line of words"] * 40))]
    done = line_dedup.dedup(spark.createDataFrame(docs, "doc_id long, text string"), line_dedup.Chunking(passages=True))
    kept = {r["doc_id"]: r for r in done.collect()}
    planted = 0
    for n, (k, text) in enumerate(docs[:-1]):
        gone = covered(text, [t for _, t in docs[:n]])
        planted += len(gone)
        lines, left = text.split("\n"), kept[k]["text"].split("\n")
        assert not {lines[x] for x in gone} & set(left)
        seen = {x for _, t in docs[:n] for x in t.split("\n")}
        assert all(x in left or x in seen for x in lines)
    assert planted > 40
    assert kept[100]["text"] == ""
    assert 50 < len(kept[101]["text"].split()) <= 56


def test_a_repeated_id_loses_nothing_by_another_of_its_texts(spark):
    line = lambda k: f"words of line {k} that are said only here {k}"
    one, other = "\n".join(map(line, range(9))), "\n".join(map(line, range(20, 29)))
    df = spark.createDataFrame([(1, one), (7, one), (7, other)], "doc_id long, text string")
    assert sorted(r["text"] for r in line_dedup.dedup(df, line_dedup.Chunking(passages=True)).collect()) == ["", one, other]


def test_chunks_that_share_a_hash_are_told_apart_by_text(spark):
    rng = random.Random(31)
    line = lambda: " ".join(rng.choice("abcdefghijklmnop") * 3 for _ in range(9))
    passages = [[line() for _ in range(6)] for _ in range(5)]
    docs = [(k, "\n".join([line(), *rng.choice(passages), line(), line()])) for k in range(40)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    rows = lambda bits: sorted(tuple(r) for r in line_dedup.dedup(df, line_dedup.Chunking(bits=bits)).select("doc_id", "text").collect())
    assert rows(3) == rows(128)
    assert rows(128) != sorted(docs)


def test_repeated_chunks_and_passages_are_compared_by_bytes(spark):
    line = lambda c, k: " ".join(f"{c}{k}x{w}" for w in range(9))
    run = [line("p", k) for k in range(20)]
    docs = [(k, "\n".join([line("a", k), *run, line("z", k)])) for k in range(3)]
    df = spark.createDataFrame(docs, "doc long, text string")
    for how in (line_dedup.Chunking(), line_dedup.Chunking(passages=True)):
        ends = line_dedup._rows(df, how).groupBy("h1", "h2").agg(F.min("doc").alias("a"), F.max("doc").alias("b")).filter("a <> b")
        had = spark.sparkContext.broadcast(line_dedup._map(ends))
        found = {bytes(r["text"]).decode() for r in line_dedup.groups(df, how, had).filter("first <> last").collect()}
        inside = [(a, b) for a, b, compared in how.chunks(docs[0][1]) if compared and a > 0 and b < 22]
        lines = docs[0][1].split("\n")
        whole = {"\n".join(lines[a:b]) for a, b in inside}
        assert whole <= found
        assert any(len(x.split()) > how.long_line for x in whole)
        if how.passages:
            assert {"\n".join(run[k : k + 6]) for k in range(15)} <= found


@pytest.mark.parametrize("bits", [0, 3, 64])
def test_passages_that_share_a_hash_are_told_apart_by_text(spark, bits):
    rng = random.Random(37)
    line = lambda n: " ".join("".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(n))
    docs = []
    for k in range(30):
        lines = [line(rng.randint(1, 60)) for _ in range(rng.randint(2, 9))]
        if k % 2:
            theirs = docs[rng.randrange(len(docs))][1].split("\n")
            at = rng.randint(0, len(lines))
            lines[at:at] = theirs[rng.randrange(len(theirs)) :]
        docs.append((k, "\n".join(lines)))
    docs += [(40, docs[5][1]), (None, docs[3][1]), (7, docs[8][1]), (41, ""), (42, None)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    rows = lambda n: sorted(tuple(map(str, r)) for r in line_dedup.dedup(df, line_dedup.Chunking(passages=True, bits=n)).select("doc_id", "text", f"{line_dedup.REPORT}.n_lines_removed").collect())
    exact = rows(128)
    assert rows(bits) == exact
    assert sum(int(r[2]) for r in exact) > 20


def test_all_lines_but_short_rests_are_in_compared_chunks():
    rng = random.Random(41)
    for how in (line_dedup.Chunking(), line_dedup.Chunking(window=3)):
        for _ in range(30):
            words = [rng.choice([0, 1, 3, 8, 20, 70]) for _ in range(rng.randint(1, 150))]
            lines = [" ".join(f"w{rng.randrange(99)}" for _ in range(n)) for n in words]
            cut = how.chunks("\n".join(lines))
            assert [k for a, b, _ in cut for k in range(a, b)] == list(range(len(lines)))
            for a, b, compared in cut:
                rest = b == len(lines) or words[b] > how.long_line or b - a == how.max_lines
                assert compared or (rest and (b - a < 2 or sum(words[a:b]) < how.min_words))


# language and toxicity


def held(doc_id):
    return zlib.crc32(str(doc_id).encode()) % 5 == 0


def test_languages_are_told_apart_on_held_out_texts(spark):
    rng = random.Random(1)
    words = {"de": ["und", "nicht", "schön", "straße", "auch"], "en": ["the", "and", "not", "which", "street"], "fr": ["être", "où", "cette", "jamais", "rue"]}
    rows = [(k, " ".join(rng.choice(words[lang]) for _ in range(12)), lang) for k in range(300) for lang in [rng.choice(list(words))]]
    rows += [(1000, None, "de"), (1001, "", None), (1002, "123 ...", "en"), (1003, "und nicht " * 40000, None), (None, "the and", "en")]
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, lang string, score int")
    found = {r["doc_id"]: r for r in langid.predict(df, langid.fit(df.filter(~toxicity.held_out()))).collect()}
    assert len(found) == len(rows)
    truth = [(found[i]["lang_pred"], lang) for i, _, lang in rows[:300] if held(i)]
    assert len(truth) > 30
    assert sum(a == b for a, b in truth) >= 0.98 * len(truth)
    assert all(found[i]["lang_pred"] == "und" and found[i]["score"] == 0 for i in (1000, 1001, 1002))
    assert found[1003]["lang_pred"] == "de"
    assert all(0 <= r["score"] <= 1 for r in found.values())
    assert langid.predict(df, langid.fit(df.limit(0))).filter("lang_pred = 'und'").count() == len(rows)


@pytest.mark.parametrize("held", [4_000_000, 300])
def test_more_than_64_languages_are_learned(spark, monkeypatch, held):
    monkeypatch.setattr(langid, "HELD", held)
    rng = random.Random(4)
    own = {f"l{k}": [chr(0x4E00 + 20 * k + j) * 2 for j in range(20)] for k in range(90)}
    rows = [(n, " ".join(rng.choice(words) for _ in range(12)), lang) for n, (lang, words) in enumerate((x for x in own.items() for _ in range(2 if x[0] == "l89" else 4)))]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    found = {r["doc_id"]: r["lang_pred"] for r in langid.predict(df, langid.fit(df)).collect()}
    assert found == {n: lang for n, _, lang in rows}


def test_pieces_keep_every_ngram(monkeypatch):
    text = "Über die Straße, und weiter! -- 12 " * 50 + "," * 300 + "a.b" * 40
    whole = np.concatenate([b for b, _, _ in langid._pieces([text])])
    for piece in (1, 2, 97, 250):
        monkeypatch.setattr(langid, "PIECE", piece)
        cut = np.concatenate([b for b, _, _ in langid._pieces([text])])
        assert np.array_equal(np.sort(whole), np.sort(cut))


def test_equal_rows_and_ties_of_languages(spark):
    rows = [(1, "aaa", "b"), (2, "aaa", "a"), (1, "aaa", "b"), (2, "aaa", "a")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    found = [tuple(r) for r in langid.predict(df, langid.fit(df)).collect()]
    assert len(found) == 4
    assert {lang for _, lang, _ in found} == {"a"}
    assert langid.predict(df.limit(0), langid.fit(df)).count() == 0


def test_toxic_documents_score_higher(spark):
    rng = random.Random(2)
    syllables = ["ter", "an", "sho", "li", "men", "ra", "ti", "on", "be", "gu"]
    word = lambda: "".join(rng.choice(syllables) for _ in range(rng.randint(1, 4)))
    bad = ["grobnik", "vuzzle", "skarpo"]
    rows, labels = [], []
    for k in range(900):
        words, toxic = [word() for _ in range(rng.randint(30, 80))], k % 3 == 0
        for _ in range(rng.randint(3, 6) if toxic else 0):
            words.insert(rng.randrange(len(words)), rng.choice(bad))
        rows.append((k, " ".join(words)))
        labels.append((k, int(toxic)))
    rows += [(5000, None), (5001, ""), (5002, "vuzzle skarpo grobnik " * 20000)]
    docs = spark.createDataFrame([(*r, "c") for r in rows], "doc_id long, text string, y string")
    model = toxicity.fit(docs, spark.createDataFrame(labels, "doc_id long, toxic int").filter(~toxicity.held_out()))
    found = {r["doc_id"]: r for r in toxicity.score(docs, model).collect()}
    judged = [(found[k]["predicted"], y) for k, y in labels if held(k)]
    assert sum(a == b for a, b in judged) >= 0.95 * len(judged)
    assert found[5000]["predicted"] == found[5001]["predicted"] == 0
    assert found[5002]["predicted"] == 1
    kept = toxicity.accepted(docs, model)
    assert kept.columns == docs.columns
    assert kept.count() == sum(r["predicted"] == 0 for r in found.values())
    none = toxicity.fit(docs, spark.createDataFrame([], "doc_id long, toxic int"))
    assert toxicity.score(docs, none).filter("score = 0 and predicted = 0").count() == len(rows)


# urls


def test_given_and_mined_rules(spark):
    urls = [(k, f"http://{'www.' if k % 2 else ''}h{k % 7}.example.{top}/{lang}/{k}") for k, (top, lang) in enumerate([(t, lang) for t in ("net", "com", "org") for lang in ("en", "de", "fr", "es")] * 20)]
    odd = [(9000, None), (9001, ""), (9002, "no scheme/x"), (9003, "HTTPS://A.B.EXAMPLE.NET/en/x?q#f"), (9004, "http://example.net"), (9005, "http://notexample.net/en/"), (9006, "http://x.net:80/en/"), (9007, "http://n?x/://y.net/"), (9003, "http://example.com/de/")]
    pages = spark.createDataFrame([(*u, "extra") for u in urls + odd], "page_id long, url string, rule string")
    labelled = pages.select("url", url_rules.given_rule(url_rules.host(F.col("url")), url_rules.path(F.col("url")), url_rules.RULES, 2).alias("label"))
    mined = url_rules.mine(labelled)
    found = url_rules.judge(pages, url_rules.RULES, mined).collect()
    assert len(found) == len(urls) + len(odd)
    by = {(r["page_id"], r["host"]): r for r in found}
    expect = {("a.b.example.net", "/en/x"): ("example.net/en/", "allow"), ("example.net", ""): (None, None), ("notexample.net", "/en/"): ("net/", "block"), ("x.net:80", "/en/"): (None, None), ("example.com", "/de/"): ("example.com/de/", "block"), ("n", ""): (None, None)}
    for (h, p), (rule, verdict) in expect.items():
        r = next(r for r in found if r["host"] == h and r["path"] == p)
        assert r["rule"] == rule
        assert verdict in (None, r["verdict"])
    for i in (9000, 9001, 9002):
        assert (by[i, ""]["path"], by[i, ""]["rule"], by[i, ""]["verdict"]) == ("", None, "allow")
    assert all(r["rule"] == "org/fr/" and r["verdict"] == "allow" for r in found if r["host"].endswith(".org") and r["path"].startswith("/fr/"))
    assert any(r["rule"] is None and r["mined_rule"] for r in found)
    brute = {r["page_id"]: next((m[1] for m in mined if set(m[0]) <= set(url_rules.tokens(u))), "allow") for (_, u) in urls for r in [next(x for x in found if x["page_id"] == _)] if r["rule"] is None}
    assert all(by_id == next(r["verdict"] for r in found if r["page_id"] == i) for i, by_id in brute.items())
    assert url_rules.mine(labelled.limit(0)) == []
    assert url_rules.judge(pages.limit(0), url_rules.RULES, mined).count() == 0


def test_mined_rules_equal_those_of_all_subsets(spark):
    rng = random.Random(21)
    urls = []
    for k in range(240):
        words = [w for w in "abcdefgh" if rng.random() < 0.45]
        label = "block" if {"a", "b"} <= set(words) or "c" in words and rng.random() < 0.9 else rng.choice(["allow", "allow", "block", None]) if "d" in words else "allow"
        urls.append((f"http://h{k % 3}.x.net/{'/'.join(words)}?q={k}", label))
    df = spark.createDataFrame([(*u, "t") for u in [*urls, (None, "block"), *urls[:5]]], "url string, label string, tokens string")
    found = url_rules.mine(df, min_support=0.03, min_confidence=0.8)
    baskets = [(frozenset(url_rules.tokens(u)), v) for u, v in [*urls, *urls[:5]] if v]
    rules = {}
    for size in (1, 2, 3):
        for key in combinations(sorted({t for b, _ in baskets for t in b}), size):
            having = [v for b, v in baskets if set(key) <= b]
            for label in ("allow", "block"):
                n = having.count(label)
                if n < max(5, 0.03 * len(baskets)) or n / len(having) < 0.8:
                    continue
                shorter = [rules[s] for j in range(1, size) for s in combinations(key, j) if s in rules]
                if not any(s[0] == label and s[1] >= n / len(having) for s in shorter):
                    rules[key] = (label, n / len(having), n / len(baskets))
    assert {r[0]: (r[1], round(r[2], 9), round(r[3], 9)) for r in found} == {k: (v[0], round(v[1], 9), round(v[2], 9)) for k, v in rules.items()}
    assert len({len(r[0]) for r in found}) > 1
    assert [r[2] for r in found] == sorted((r[2] for r in found), reverse=True)


def test_long_urls_and_few_rows_are_mined_in_bounded_time(spark):
    long_ = "http://h.example.net/" + "/".join(f"w{chr(97 + k % 26)}{k // 26}x" for k in range(60))
    few = spark.createDataFrame([(f"{long_}/{'/'.join(f'z{k}y{j}' for j in range(200))}", "allow" if k else "block") for k in range(5)], "url string, label string")
    assert all(len(r[0]) <= 3 for r in url_rules.mine(few))
    more = spark.createDataFrame([(long_, "allow" if k % 2 else "block") for k in range(12)], "url string, label string")
    assert url_rules.mine(more) == []
