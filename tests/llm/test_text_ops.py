"""Operators on documents against brute force, with nulls, ties, repeats, empty tables and clashing columns."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lexisieve.llm import arrays, bpe, chunks, langid, lm, minhash, packing, pretokens, secrets, substring
from lexisieve.llm.spark_utils import connected_components

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def low(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(5)
    words = ["Ab", "cd", "e", "été", "日本", "ghij", "K", "lm,", "n.", "ſ"]
    out = []
    for _ in range(90):
        out.append(" ".join(rng.choice(words) + (str(rng.randint(0, 40)) if rng.random() < 0.6 else "") for _ in range(rng.choice([0, 1, 2, 3, 8, 30, 60, 90]))))
    for _ in range(60):  # copies, near copies and shared passages
        base = WORD.findall(rng.choice(out))
        if base:
            if rng.random() < 0.5:
                base[rng.randrange(len(base))] = "zz"
            out.append("\n".join(rng.choice(WORD.findall(rng.choice(out)) or ["q"]) for _ in range(3)) + "\t" + " ".join(base))
    out += [None, "", " \n ", "x", "X", "a b", "A B", out[10], out[10], "w " * 3000, "same " * 25]
    return list(enumerate(out))


@pytest.fixture(scope="module")
def docs(spark, texts):
    return spark.createDataFrame(texts, "doc_id long, text string").repartition(3)


def shingle_set(t, k):
    w = WORD.findall(low(t))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def brute_components(texts, k, percent):
    sets = {i: shingle_set(t, k) for i, t in texts}
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b]:
                n = len(sets[a] & sets[b])
                if 100 * n >= percent * (len(sets[a]) + len(sets[b]) - n):
                    x, y = sorted((find(a), find(b)))
                    parent[y] = x
    return sets, {i: find(i) for i in ids}


@pytest.mark.parametrize(("k", "percent"), [(3, 85), (5, 80)])
def test_minhash_equals_brute_force(docs, texts, k, percent, monkeypatch):
    sets, want = brute_components(texts, k, percent)
    for small in (600, 4):  # 4: candidate groups go through chunks and pivots
        monkeypatch.setattr(minhash, "SMALL", small)
        got = minhash.components(docs, k=k, percent=percent).collect()
        assert {r["doc_id"]: r["component_id"] for r in got} == want
        assert all(r["n_shingles"] == len(sets[r["doc_id"]]) and r["kept"] == (r["doc_id"] == r["component_id"]) for r in got)


def test_minhash_edges(spark):
    df = spark.createDataFrame([(None, "a b c d"), (3, "a b c d"), (3, "a b c d"), (2, "A b c d"), (7, None)], "doc_id long, text string").withColumn("band", F.lit(1)).withColumn("rep", F.lit(2))
    got = sorted((str(r["doc_id"]), str(r["component_id"]), r["kept"]) for r in minhash.components(df).collect())
    assert got == [("2", "2", True), ("3", "2", False), ("3", "2", False), ("7", "7", True), ("None", "None", True)]
    assert minhash.near_duplicates(df).columns == df.columns and minhash.near_duplicates(df).count() == 3  # 2, 7 and the one without an id
    assert minhash.components(df.where("false")).count() == 0


def test_components_of_a_long_shuffled_chain(spark):
    rng, n = np.random.default_rng(2), 5000
    ids = rng.permutation(n) * 7
    edges = [(int(a), int(b)) for a, b in zip(ids[:-1], ids[1:])] + [(100_001, 100_003), (100_003, 100_002), (100_009, 100_009)]
    got = {r["id"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {int(i): 0 for i in ids} | dict.fromkeys((100_001, 100_002, 100_003), 100_001)


def test_minhash_follows_a_long_chain(spark):
    rng, n = random.Random(6), 400
    ids = rng.sample(range(n), n)
    rows = [(ids[i], " ".join(f"w{j}" for j in range(2 * i, 2 * i + 60))) for i in range(n)]  # neighbours share 56 of 60 five-word shingles
    assert {r["component_id"] for r in minhash.components(spark.createDataFrame(rows, "doc_id long, text string")).collect()} == {0}


def test_linked_equals_all_pairs():
    rng = np.random.default_rng(4)
    for percent in (80, 85, 100):
        base = [np.sort(rng.choice(4000, rng.integers(1, 80), replace=False)).astype(np.uint64) for _ in range(12)]
        sets = [np.unique(np.where(rng.random(len(b)) < 0.08, rng.integers(0, 4000, len(b)).astype(np.uint64), b)) for b in base for _ in range(6)] + [np.arange(3000, dtype=np.uint64)] * 2
        n = len(sets)
        links = [(a, b) for a in range(n) for b in range(a) if 100 * len(np.intersect1d(sets[a], sets[b])) >= percent * len(np.union1d(sets[a], sets[b]))]

        def trees(edges):
            root = list(range(n))
            for a, b in edges:
                x, y = root[a], root[b]
                root = [y if r == x else r for r in root]
            return {frozenset(i for i in range(n) if root[i] == r) for r in root}

        got = minhash.linked(sets, np.arange(n), percent)
        assert trees(got) == trees(links) and len(got) < n


def test_near_duplicates_drops_repeated_rows(spark):
    df = spark.createDataFrame([(1, "a b c d e f")] * 3 + [(2, "A b c d e f"), (3, "other"), (3, "texts"), (None, "x"), (None, "x")], "doc_id long, text string")
    got = sorted((str(r["doc_id"]), r["text"]) for r in minhash.near_duplicates(df).collect())
    assert got == [("1", "a b c d e f"), ("3", "other"), ("3", "texts"), ("None", "x"), ("None", "x")]


def brute_repeats(texts, size=20):
    seen, out = set(), {}
    for i, t in sorted(texts, key=lambda x: x[0]):
        w = WORD.findall(t or "")
        gone = [False] * len(w)
        for s in range(len(w) - size + 1):
            key = tuple(w[s : s + size])
            if key in seen:
                gone[s : s + size] = [True] * size
            seen.add(key)
        out[i] = (len(w), sum(gone), " ".join(x for x, g in zip(w, gone) if not g))
    return out


def test_substring_equals_brute_force(docs, texts, monkeypatch):
    want = brute_repeats(texts)
    assert sum(n for _, n, _ in want.values()) > 500
    for size in (4 << 20, 2000):  # 2000: many chunks and buckets
        monkeypatch.setattr(chunks, "CHUNK_BYTES", size)
        monkeypatch.setattr(chunks, "BUCKET_ENTRIES", size // 4)
        got = substring.remove_repeats(docs.withColumn("chunk", F.lit(9)))
        assert {r["doc_id"]: (r["n_words"], r["n_removed"], r["text"]) for r in got.collect()} == want


def test_substring_edges(spark):
    p = " ".join(f"w{i}" for i in range(20))
    df = spark.createDataFrame([(1, "  kept   as is "), (None, p), (5, p), (5, p), (6, None)], "doc_id long, text string").withColumn("entries", F.lit("x"))
    got = sorted((str(r["doc_id"]), r["text"], r["n_removed"]) for r in substring.remove_repeats(df, keep_clean=True).collect())
    assert got == [("1", "  kept   as is ", 0), ("5", "", 20), ("5", p, 0), ("6", None, 0), ("None", "", 20)]
    assert substring.remove_repeats(df.where("false")).count() == 0
    with pytest.raises(ValueError):
        substring.remove_repeats(df, size=10, block=6)


RULES = {
    "assign": (r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    "access": (r"AKIA[A-Z0-9]+", 0, 16),
    "hex": (r"[0-9a-f]+", 0, 32),
}


def test_secrets_equal_the_base_rules(spark):
    rng = random.Random(7)
    bits = ["token", "TOKEN", "Secret", "api_key", "apikey", "passw", "word", " ", "=", ":", '"', "'", "abcdefgh", "12345678", "AKIA", "ABCDEFGHIJKLMNOP", "0" * 31, "a" * 33, "é", "😀", "ghp_" + "x" * 36, "ſecret", "-----BEGIN RSA PRIVATE KEY-----", "\n", "Kelvin to\u212aen=abcdefgh1"]
    texts = [(i, "".join(rng.choice(bits) for _ in range(rng.randint(0, 12)))) for i in range(400)] + [(400, None), (401, ""), (402, "token=abcdefgh " * 50)]
    df = spark.createDataFrame(texts, "doc_id long, text string").withColumn("kinds", F.lit("x"))
    found = {r["doc_id"]: r["secrets"] for r in secrets.scan(df).collect()}
    for i, t in texts:
        want = sorted((m.start(), n, m.end(), kind) for n, (kind, (p, g, least)) in enumerate(RULES.items()) for m in re.finditer(p, t or "") if len(m.group(g)) >= least)
        assert [tuple(s) for s in found[i] if s["ord"] < 3] == want, t
    added = {s["kind"] for ss in found.values() for s in ss if s["ord"] >= 3}
    assert {"code_host", "private_key"} <= added
    clean = {r["doc_id"]: r["text"] for r in secrets.redact(df).collect()}
    for i, t in texts:
        assert (clean[i] == t) == (not found[i])
        for s in found[i]:
            assert t[s["start"] : s["end"]] not in clean[i] or len(t[s["start"] : s["end"]]) < 16
    assert secrets.scan(df.where("false")).count() == 0


KEY_LINES = ["MIIEpAIBAAKCAQEA" + "aB3/+dEf" * 6, "Zz9+" * 16, "Qw4rT5=="]


@pytest.mark.parametrize("head", ["", "Proc-Type: 4,ENCRYPTED\nDEK-Info: AES-256-CBC,0123456789ABCDEF0123456789ABCDEF\n\n"])
@pytest.mark.parametrize("end", ["-----END RSA PRIVATE KEY-----", ""])
@pytest.mark.parametrize("newline", ["\n", "\r\n", "\\n", " "])
def test_private_key_covers_the_body(head, end, newline):
    rule = next(r for r in secrets.ADDED if r.kind == "private_key")
    key = newline.join(["-----BEGIN RSA PRIVATE KEY-----", *filter(None, head.split("\n")), *KEY_LINES, end])
    if head and not end and newline in ("\\n", " "):
        pytest.skip("headers need lines")
    left = re.sub(rule.pattern, "[SECRET]", f"before {key}. After it.")
    assert left == "before [SECRET]. After it."


def test_redact_leaves_no_byte_of_a_private_key(spark):
    rows = [(i, "before\n" + "\n".join(["-----BEGIN PRIVATE KEY-----", *KEY_LINES, end]) + ". After") for i, end in enumerate(("-----END PRIVATE KEY-----", ""))]
    for r in secrets.redact(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        assert r["text"] == "before\n[SECRET]. After"


def test_trigram_queries_hold_for_every_match():
    import string

    samples = {"assign": "my API_KEY: 'abcdefgh9'", "access": "AKIA" + "Z" * 16, "private_key": "-----BEGIN EC PRIVATE KEY-----", "code_host": "gho_" + "a" * 36, "chat": "xoxp-" + "1" * 10, "cloud_key": "AIza" + "b" * 35, "web_token": "eyJ" + "a" * 9 + ".eyJ" + "b" * 9 + "." + "c" * 9, "payment": "sk_live_" + "d" * 16, "login_url": "https://u:pass@h"}
    for r in secrets.BASE + secrets.ADDED:
        query, text = secrets.trigram_query(r.pattern), samples.get(r.kind, "f" * 40).lower()
        assert bool(query) == (r.kind != "hex")
        assert re.search(r.pattern, samples.get(r.kind, "f" * 40))
        assert all(any(option <= {text[i : i + 3] for i in range(len(text))} for option in clause) for clause in query)
    assert string


def test_pretokens_and_bpe_equal_the_library():
    import public_tokenizers
    import tiktoken

    ranks = bpe.default_ranks()
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rng = random.Random(3)
    bits = ["a", " ", "  ", "\n", "'", "'s", "'re", "'ll", "é", "1", "²", "!", "ing", " the", "日本", "　", "aaaa", "😀", "́", "_", "<|endoftext|>"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randint(0, 30))) for _ in range(1500)] + ["", None, "ab" * 4000, "z" * 5000]
    ids, off = pretokens.Encoder(bpe.Merger(ranks).encode, cache=500).encode(pa.array(texts, pa.string()))
    for t, a, b in zip(texts, off[:-1], off[1:]):
        assert ids[a:b].tolist() == library.encode_ordinary(t or ""), t


def test_bpe_round_trip(docs, texts):
    out = {r["doc_id"]: (r["n"], bytes(r["decoded"])) for r in bpe.decode(bpe.encode(docs)).select("doc_id", F.size("ids").alias("n"), "decoded").collect()}
    assert all(out[i][1] == (t or "").encode() for i, t in texts) and out[0][0] >= 0
    assert bpe.decode(bpe.encode(docs.where("false"))).count() == 0


def test_rank_queue_gives_the_lowest_rank_then_the_leftmost():
    rng, q = random.Random(1), bpe.RankQueue()
    items = [(rng.randrange(60_000), rng.randrange(100)) for _ in range(3000)]
    for r, p in items:
        q.push(r, p)
    out = []
    while (x := q.pop()) is not None:
        out.append(x)
    assert out == sorted(items)


def test_packing(docs, texts):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(packing.default_tokenizer())
    long = docs.unionByName(docs.sparkSession.createDataFrame([(900, "many more words here " * 900), (901, "many more words here " * 900), (901, None)], "doc_id long, text string"))
    got = packing.pack(long).collect()
    by_seq = {}
    for r in got:
        by_seq.setdefault(r["sequence_id"], []).append(r)
    for rows in by_seq.values():
        at = 0
        for r in sorted(rows, key=lambda r: r["offset"]):
            assert r["offset"] == at and r["length"] > 0
            at += r["length"]
        assert at <= 1024
    total = sum(r["length"] for r in got)
    assert len(by_seq) <= -(-total // 1024) + 1
    for i, t in [*texts[:40], (900, "many more words here " * 900)]:
        ids = np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
        own = sorted((r for r in got if r["doc_id"] == i), key=lambda r: r["piece"])
        assert [r["piece"] for r in own] == list(range(len(own))) and sum(r["length"] for r in own) == len(ids)
        assert all(r["length"] == 1024 for r in own[1:])
        assert all(zlib.crc32(ids[r["start"] : r["start"] + r["length"]].tobytes()) == r["ids_crc32"] for r in own)
    assert packing.pack(docs.where("false")).count() == 0


def best_fit(length):
    out = packing.Bins(length, 1024)
    out.best_fit(list(range(len(length))))
    return out


def test_genetic_operators_keep_every_item_once():
    rng = random.Random(2)
    for _ in range(5):
        length = [rng.choice([rng.randint(1, 100), rng.randint(200, 700), 341, 342, 512]) for _ in range(300)]
        seed = best_fit(length)
        population = packing.first_population(seed, rng)
        for child in [*population, packing.crossover(population[0], population[1], rng), *packing.generations(population, 0, rng, 10)]:
            assert sorted(i for b in child.bins for i in b) == list(range(len(length)))
            assert all(sum(length[i] for i in b) == 1024 - r for b, r in zip(child.bins, child.room)) and min(child.room) >= 0
        assert min(len(p.bins) for p in packing.generations(population, 0, rng, 20)) <= len(seed.bins)


def test_islands_beat_best_fit_on_shards_above_the_bound(spark):
    rng, rows = random.Random(11), []
    for _ in range(6000):
        rows.append((len(rows), min(1023, max(1, int(rng.lognormvariate(5.9, 0.75))))))
    pieces = spark.createDataFrame(rows, "id long, length long")
    got = packing.evolved(pieces, 3, 1, 1024).collect()
    assert sorted(r["id"] for r in got) == list(range(len(rows)))
    saved = above = 0
    for shard in {r["shard"] for r in got}:
        own = [r for r in got if r["shard"] == shard]
        length = sorted((r["length"] for r in own), reverse=True)
        bins, plain, bound = Counter(r["bin"] for r in own), len(best_fit(length).bins), -(-sum(length) // 1024)
        for b in bins:
            fill = sum(r["length"] for r in own if r["bin"] == b)
            assert fill <= 1024 and all(r["fill"] == fill for r in own if r["bin"] == b)
        assert bound <= len(bins) <= plain
        above, saved = above + (plain > bound), saved + plain - len(bins)
    assert above and saved


def test_language_id(spark):
    rng = random.Random(4)
    sounds = {"aa": ["the", "ing", "and", "er"], "bb": ["und", "sch", "ein", "der"], "cc": ["eau", "que", "les", "oux"]}
    rows = []
    for i in range(240):
        lang = rng.choice(list(sounds))
        rows.append((i, " ".join("".join(rng.choice(sounds[lang]) for _ in range(rng.randint(1, 3))) for _ in range(12)), lang))
    rows += [(900, None, "aa"), (901, "", "aa"), (902, "12 !? 34", "bb"), (903, "the and " + "x" * 5000, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    out = langid.held_out(F.col("doc_id"), 3, 1)
    model = langid.learn(df.where(~out))
    got = {r["doc_id"]: r for r in langid.identify(df.withColumn("score", F.lit("x")), model).withColumn("h", out).collect()}
    assert all(got[i]["h"] == (zlib.crc32(str(i).encode()) % 3 == 1) for i, _, _ in rows)
    held = [i for i, _, _ in rows[:240] if got[i]["h"]]
    assert sum(got[i]["lang_pred"] == rows[i][2] for i in held) >= 0.95 * len(held)
    assert [(got[i]["lang_pred"], got[i]["score"]) for i in (900, 901, 902)] == [("und", 0.0)] * 3
    assert got[903]["lang_pred"] == "aa" and all(0 <= r["score"] <= 1 for r in got.values())
    assert langid.learn(df.where("lang = 'none'")) is None
    assert langid.identify(df.where("doc_id < 3"), None).where("lang_pred = 'und'").count() == 3
    assert langid.identify(df.where("false"), model).count() == 0


def test_language_id_learns_from_few_distinct_and_from_long_texts(spark):
    rows = [(lang, f"{word} {word}{chr(97 + i)}") for lang, word in (("aa", "morning"), ("bb", "abend")) for i in range(3)]
    df = spark.createDataFrame(rows, "lang string, text string").join(spark.range(20_000))
    df = df.select("lang", "text").unionByName(spark.createDataFrame([("cc", "jour " * 5000)], "lang string, text string"))
    assert langid.learn(df).langs == ["aa", "bb", "cc"]


def test_forward_sums_all_segmentations():
    finder = langid.Pieces(["▁a", "b", "▁ab", "ab", "a", "▁"])
    p = np.full((finder.n + 2, 1), 0.0)
    for i, piece in enumerate(finder.pieces):
        p[i] = {"▁a": 0.2, "b": 0.3, "▁ab": 0.1, "ab": 0.25, "a": 0.05, "▁": 0.07}[piece]
    p[finder.n + 1] = langid.UNKNOWN
    want = 0.1 + 0.2 * 0.3 + 0.07 * 0.25 + 0.07 * 0.05 * 0.3
    assert math.isclose(math.exp(langid.log_likelihoods(finder, p, ["▁ab"])[0, 0]), want, rel_tol=1e-9)


def test_language_id_of_long_runs_in_any_script(spark):
    runs = {"zh": "天地玄黄宇宙洪荒日月盈昃辰宿列张" * 5, "am": "ሀለሐመሠረሰሸቀበተቸኀነኘአከኸወዐዘዠየደጀገጠጨጰጸፀፈፐ" * 3, "th": "กขฃคฅฆงจฉชซฌญฎฏฐฑฒณดตถทธนบปผฝพฟภมยรลวศษสหฬอฮ" * 2}
    base = [("en", "the quick brown fox jumps over the lazy dog again"), ("de", "der schnelle braune fuchs springt über den faulen hund")] * 4
    for poison in ([], list(runs.items())):
        rows = [(i, t, lang) for i, (lang, t) in enumerate(base + poison)]
        model = langid.learn(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
        ask = spark.createDataFrame([(1, "the quick brown fox"), (2, "der braune hund"), *[(10 + i, t * 3) for i, t in enumerate(runs.values())]], "doc_id long, text string")
        got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in langid.identify(ask, model).collect()}
        assert all(0 <= s <= 1 for _, s in got.values()) and np.isfinite(model.p).all()
        assert (got[1][0], got[2][0]) == ("en", "de")
        if poison:
            assert [got[10 + i][0] for i in range(3)] == list(runs)


def segmentations(word, probability):
    if not word:
        return 1.0
    return sum(probability(word[:n]) * segmentations(word[n:], probability) for n in range(1, len(word) + 1))


def test_likelihood_is_the_sum_over_all_segmentations():
    rng = random.Random(9)
    pieces = ["▁", *{"".join(rng.choice("abc") for _ in range(rng.randint(1, 4))) for _ in range(30)}, "▁a", "▁ba"]
    finder = langid.Pieces(pieces)
    p = np.random.default_rng(1).random((finder.n + 2, 2)) * 0.2
    p[finder.n], p[finder.n + 1] = 0, langid.UNKNOWN
    place = {x: i for i, x in enumerate(finder.pieces)}
    words = ["▁" + "".join(rng.choice("abcz") for _ in range(rng.randint(0, 12))) for _ in range(60)]
    got = langid.log_likelihoods(finder, p, words)
    for w, row in zip(words, got):
        for c in range(2):
            want = segmentations(w, lambda s: p[place[s], c] if s in place else (langid.UNKNOWN if len(s) == 1 else 0.0))
            assert math.isclose(row[c], math.log(want), rel_tol=1e-9)


def test_expected_counts_of_long_words_equal_those_of_short_scaling(monkeypatch):
    texts = [("aa", "abcabcabcabcabcabc bca ab"), ("bb", "cbacbacbacba cab")] * 3
    pieces = ["▁", "a", "b", "c", "ab", "bc", "ca", "abc", "cba", "▁ab"]
    want = langid.fit(texts, pieces).p
    monkeypatch.setattr(langid, "SCALED", 3)
    assert np.allclose(langid.fit(texts, pieces).p, want, rtol=1e-9)


def test_lm(docs, texts, spark):
    flagged = docs.withColumns({"held": langid.held_out(F.col("doc_id"), 7, 2)}).withColumn("learn", ~F.col("held"))
    got = {r["doc_id"]: r for r in lm.score(flagged, "learn").collect()}
    count = Counter()
    for i, t in texts:
        if zlib.crc32(str(i).encode()) % 7 != 2:
            count.update([*WORD.findall(low(t)), "\0"])
    n, v = sum(count.values()), len(count)
    for i, t in texts:
        tokens = [*WORD.findall(low(t)), "\0"]
        r = got[i]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(tokens), sum(count[w] > 0 for w in tokens), n)
        assert math.isclose(r["base_score"], sum(math.log10((count[w] + 1) / (n + v + 1)) for w in tokens), rel_tol=1e-9)
        assert math.isfinite(r["score"]) and r["score"] < 0
    none = lm.score(flagged.withColumn("learn", F.lit(False)), "learn").collect()
    assert all(r["train_tokens"] == 0 and r["score"] == r["base_score"] for r in none)
    assert lm.score(flagged.where("false"), "learn").count() == 0


def lm_network(own=40, seed=3):
    rng = np.random.default_rng(seed)
    words = np.unique(rng.integers(0, 2**63, own).astype(np.uint64))
    vocabulary = lm.Vocabulary(words, np.arange(2, own + 2, dtype=np.int64), 5, 90_000, 900, np.full(lm.RARE, 300), np.full(lm.RARE, 30))
    net = lm.Network.fresh(vocabulary)
    net.r *= 8
    net.q *= 8
    return vocabulary, net


def test_lm_is_normalised(monkeypatch):
    vocabulary, net = lm_network()
    rows = [0, 7, lm.FREQUENT + 3, vocabulary.start]
    z = {i: net.normalisers(slice(i, i + 1))[0] for i in rows}
    every = np.arange(vocabulary.size)
    for one in rows:
        for two in (0, 3, vocabulary.start):
            scores = (net.c[0] * net.r[one] + net.c[1] * net.r[two]).astype(float) @ net.q.astype(float).T + net.bias
            assert math.isclose(np.log(np.exp(scores).sum()), z[one][two], rel_tol=1e-6)
            full = np.zeros((vocabulary.contexts, vocabulary.contexts))
            full[one] = z[one]
            p = np.exp(net.log_probability(every, np.full(vocabulary.size, one), np.full(vocabulary.size, two), full))
            assert math.isclose(p.sum(), 1.0, rel_tol=1e-5)


def test_lm_classes_of_words_and_contexts():
    vocabulary, _ = lm_network()
    k = len(vocabulary.words)
    assert vocabulary.classes(vocabulary.words).tolist() == list(range(k))
    other = np.array([1, 2, 257], np.uint64)
    assert vocabulary.classes(other).tolist() == [k + 2, k + 3, k + 2]
    assert sorted(vocabulary.context[:k]) == list(range(k)) and vocabulary.context[k:].min() >= lm.FREQUENT and vocabulary.context.max() < vocabulary.start
    token, one, two, off = vocabulary.stream(np.array([3, 5, 4]), np.array([0, 2, 2, 3]))
    c, s = vocabulary.context, vocabulary.start
    assert token.tolist() == [3, 5, k, k, 4, k] and off.tolist() == [0, 3, 4, 6]
    assert one.tolist() == [s, c[3], c[5], s, s, c[4]] and two.tolist() == [s, s, c[3], s, s, s]


def test_lm_learns_from_context_and_not_from_the_layout(spark):
    rng, rows = random.Random(12), []
    for i in range(700):
        at, text = rng.randrange(12), []
        for _ in range(80):
            at = (3 * at + 1 + (rng.random() < 0.2)) % 12  # a word says much about the next
            text.append(f"w{at}")
        rows.append((i, " ".join(text)))
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("held", langid.held_out(F.col("doc_id"), 7, 2)).withColumn("learn", ~F.col("held"))
    got = {r["doc_id"]: r for r in lm.score(df.repartition(5), "learn").collect()}
    again = {r["doc_id"]: r["score"] for r in lm.score(df.coalesce(1).orderBy(F.desc("doc_id")), "learn").collect()}
    assert all(math.isclose(again[i], r["score"], rel_tol=1e-9) for i, r in got.items())
    held = [r for r in got.values() if r["held"]]
    assert sum(r["score"] for r in held) > 0.93 * sum(r["base_score"] for r in held) and sum(r["score"] > r["base_score"] for r in held) > 0.95 * len(held)


def test_lm_sums_parts_in_steps(spark, monkeypatch):
    monkeypatch.setattr(lm, "PART_BYTES", 300)
    monkeypatch.setattr(lm, "FAN", 2)
    df = spark.createDataFrame([(i, f"alpha beta gamma delta {i % 7}") for i in range(60)], "doc_id long, text string").withColumn("learn", F.lit(True))
    assert all(math.isfinite(r["score"]) for r in lm.score(df, "learn").collect())


def test_vocabulary_grows_with_the_corpus():
    sizes = [lm.vocabulary_size(n) for n in (0, 10**6, 10**8, 10**10, 10**14)]
    assert sizes == [500, 1000, 10_000, 100_000, lm.MOST_WORDS]


def test_packed_integers_and_words():
    rng = np.random.default_rng(1)
    for n in (0, 1, 500):
        v = np.sort(rng.choice(2**32, n, replace=False)).astype(np.uint32)
        assert (chunks.unpack_sorted(chunks.pack_sorted(v)) == v).all()
        i = rng.integers(-(2**40), 2**40, n)
        assert (chunks.unpack_ints(chunks.pack_ints(i)) == i).all()
    col = pa.array(["a  B\n", None, "", "b a b"])
    h, first = arrays.words(col, lower=True)
    assert first.tolist() == [0, 2, 2, 2, 5] and h[0] == h[3] and h[1] == h[2] == h[4] and h[0] != h[1]
    assert arrays.kept_words(col, np.array([True, False, True, True, False])).to_pylist() == ["a", "", "", "b a"]
    assert hashlib
