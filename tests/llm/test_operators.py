"""Corpus operators against brute force, round trips and their defined edge cases."""

import hashlib
import itertools
import math
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tallyvane.llm import (
    buffers, chat_format, decontaminate, host_rules, language_id, near_dedup, queries, sharding, source_mix, token_counts, toxicity,
    url_filter,
)

WORDS = [a + b for a in ("ba", "ke", "li", "mo", "nu", "ra", "so", "ti") for b in ("da", "fe", "gi", "po", "xu", "ze")]


def prose(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


# buffers

def test_words_match_split():
    texts = ["Ab c\tAB", None, "", "  x ", "é é\nab", "ab" * 500, "a\x0bb"]
    for limit in (3, 1000):
        got, codes = [], {}
        for piece in buffers.pieces(pa.array(texts), limit):
            begin, end, first = buffers.words(piece)
            hashes = buffers.word_hashes(piece, begin, end, buffers.LOWER)
            for i in range(piece.last - piece.first):
                found = [bytes(piece.data[a:b]) for a, b in zip(begin[first[i]:first[i + 1]], end[first[i]:first[i + 1]])]
                got.append(found)
                for w, h in zip(found, hashes[first[i]:first[i + 1]]):
                    assert codes.setdefault(w.lower(), h) == h
        assert got == [(t or "").encode().split() for t in texts]
        assert len(set(codes.values())) == len(codes)


# 1

def test_template_round_trip():
    t = chat_format.Template()
    for text in ("", "␛", "␛␛<|im_end|>", "</s>[INST] ok [/INST]", "<<|im_sep|>>", "<s><s>␛", "plain"):
        escaped = t.escape(text)
        assert t.unescape(escaped) == text
        assert not any(c in escaped for c in t.controls)


def test_chat_masks(spark):
    rows = [(1, 0, "user", "hi <|im_end|>"), (1, 1, "assistant", " é😀 a "), (1, 2, "assistant", "</s>"), (2, 0, None, None),
            (3, 1, "assistant", "b"), (3, 1, "assistant", "b"), (None, 0, "assistant", "x" * 30_000)]
    df = spark.createDataFrame(rows, "conv_id bigint, turn int, role string, text string").withColumn("formatted", F.lit("clash"))
    out = {r["conv_id"]: r for r in chat_format.read_back(
        chat_format.format_chats(df, queries.tokenizer_file("byte_bpe_50k.json"))).collect()}
    assert {k: r["n_turns"] for k, r in out.items()} == {1: 3, 2: 1, 3: 2, None: 1}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert out[1]["loss_sha256"] == sha(" é😀 a </s>") and out[3]["loss_chars"] == 2 and out[None]["loss_chars"] == 30_000
    assert out[1]["turns_sha256"] == sha("user\nhi <|im_end|>\nassistant\n é😀 a \nassistant\n</s>\n")
    assert out[2]["turns_sha256"] == sha("\n\n") and out[2]["loss_sha256"] == sha("")
    assert chat_format.render(df.limit(0)).count() == 0


# 2

def test_block_max_search_is_exact():
    rng = random.Random(3)
    idf = np.array([rng.uniform(1, 5) for _ in range(40)])
    examples = [{t: rng.randint(1, 4) for t in rng.sample(range(40), rng.randint(1, 6))} for _ in range(300)]
    index = toxicity.BlockMaxIndex(40, idf, np.zeros(300, np.int8), list(range(300))).fill(examples)

    def dense(counts):
        v = np.zeros(40)
        terms, w = index.unit_vector(counts)
        v[terms] = w
        return v

    matrix = np.array([dense(e) for e in examples])
    for _ in range(50):
        query = {t: rng.randint(1, 3) for t in rng.sample(range(40), rng.randint(1, 5))}
        sims = matrix @ dense(query)
        want = [i for i in np.lexsort((np.arange(300), -np.round(sims, 12))) if sims[i] > 0][:10]
        assert [i for i, _ in index.nearest(query, 10)] == want


def test_blocks_are_left_out_and_the_nearest_still_found(monkeypatch):
    monkeypatch.setattr(toxicity, "DENSE_TERMS", 5)
    monkeypatch.setattr(toxicity, "BLOCK", 4)
    rng = random.Random(8)
    themes = [range(20 * i, 20 * i + 30) for i in range(6)]
    examples = [{t: rng.randint(1, 4) for t in rng.sample(themes[i % 6], rng.randint(1, 9))} for i in range(299)] + [{}]
    examples[7] = dict(examples[1])
    idf = np.array([rng.uniform(1, 5) for _ in range(140)])
    marked = np.array([rng.choice([0.0, 0.5, 1.0]) for _ in range(140)])
    index = toxicity.BlockMaxIndex(140, idf, np.zeros(300, np.int8), list(range(300)), 2.0, marked).fill(examples)
    matrix = np.zeros((300, 140))
    for row, example in zip(matrix, examples):
        terms, w = index.unit_vector(example)
        row[terms] = w
    asked = [{t: rng.randint(1, 3) for t in rng.sample(themes[i % 6], rng.randint(1, 8))} | ({~i: 2} if i % 3 else {}) for i in range(200)]
    asked += [examples[1], {}, {~5: 1}]
    for counts, near in zip(asked, index.nearest_all(asked, 10)):
        terms, w = index.unit_vector(counts)
        q = np.zeros(140)
        q[terms] = w
        sims = np.round(matrix @ q, 12)
        want = [i for i in np.lexsort((np.arange(300), -sims)) if sims[i] > 0][:10]
        assert [i for i, _, _ in near] == want
        assert [s for _, s, _ in near] == pytest.approx(sims[want])
        assert [v for _, _, v in near] == pytest.approx(((matrix * q) @ marked)[want])
    assert 0 < index.blocks_scored < 0.7 * index.blocks_met


def test_a_block_keeps_only_the_frequent_terms_it_holds(monkeypatch):
    monkeypatch.setattr(toxicity, "BLOCK", 4)
    examples = [{10 * (i // 4) + t: 1 + t for t in range(10)} | {40: 1} for i in range(16)] + [{}]
    index = toxicity.BlockMaxIndex(41, np.ones(41), np.zeros(17, np.int8), list(range(17))).fill(examples)
    made = index.prepared()
    assert [part.shape for part in made["dense"]] == [(11, 4)] * 4 + [(0, 4)]  # not 41 rows in each of five blocks
    near = index.nearest_all([(np.array([-3, 12, 40]), np.array([1, 2, 1])), {12: 2, -3: 1, 40: 1}, {}], 17)
    assert near[0] == near[1] and [i for i, _, _ in near[0]] == [4, 5, 6, 7, 0, 1, 2, 3, *range(8, 16)] and near[2] == []


def test_toxicity_counts_words_as_the_expression_finds_them(monkeypatch):
    monkeypatch.setattr(toxicity, "MEMO", 40)
    odd = "".join(map(chr, [*range(1, 0x3000), *range(0xD7F0, 0xD800), *range(0xE000, 0xE010), *range(0x10300, 0x10400), 0x1D400, 0x1F600, 0x10FFFF]))
    rng = random.Random(5)
    texts = ["", None, "  ", "Abc aBC abcd_abcde9abcdef İI ΟΣ ΟΣΑ x² ½ ٣ é e\u0301", odd, *[prose(rng, 60) for _ in range(20)]]
    words = {w for t in texts for w in toxicity.LETTERS.findall((t or "").lower())}
    vocabulary = {f: i for i, f in enumerate(sorted({f for w in words for f in toxicity.word_features(w)})) if i % 3}
    take = toxicity.Vectorizer({f: n for n, f in enumerate(vocabulary)})
    for text in texts:
        found = toxicity.LETTERS.findall((text or "").lower())
        assert toxicity.words_of(text) == found
        want = Counter(f for w in found for f in toxicity.word_features(w))
        terms, counts = take.counted(text)
        assert np.array_equal(terms, np.unique(terms))
        known = terms >= 0
        assert dict(zip(terms[known].tolist(), counts[known].tolist())) == {take.vocabulary[f]: n for f, n in want.items() if f in vocabulary}
        assert sorted(counts[~known].tolist()) == sorted(n for f, n in want.items() if f not in vocabulary)


def test_toxicity_sample_is_bounded(spark):
    rows = [(i % 900, int(i % 3 == 0)) for i in range(1200)] + [(None, 1), (5, None), (6, 7)]
    picked = toxicity.draw(spark.createDataFrame(rows, "key bigint, label int"), 100, 200).collect()
    assert len({r["key"] for r in picked}) == len(picked)
    parts = {(y, part): sum(r["label"] == y and r["part"] == part for r in picked) for y in (0, 1) for part in ("index", "calibration")}
    assert all(0.6 * n < parts[y, "index"] < 1.4 * n for y, n in ((0, 200), (1, 100)))
    assert toxicity.draw(spark.createDataFrame([], "key bigint, label int"), 3, 3).count() == 0


def test_toxicity_of_very_long_and_repeated_texts(spark):
    rng = random.Random(6)
    rows = [(i, prose(rng, 30) + (" vileword" if i % 4 == 0 else ""), int(i % 4 == 0)) for i in range(200)]
    sample = spark.createDataFrame([(t, y, i, "index" if i % 5 else "calibration") for i, t, y in rows], "text string, label int, name bigint, part string")
    long = prose(rng, 60_000)
    corpus = spark.createDataFrame([(t,) for _, t, _ in rows] + [(long,), (None,), ("",)], "text string")
    judge = toxicity.fit_sample(sample, corpus)
    n = sum("vileword" in t for _, t, _ in rows)
    assert judge.index.idf[judge.vocabulary["=vileword"]] == pytest.approx(math.log(203 / (1 + n)) + 1)  # two texts more than the rows, one is null
    asked = spark.createDataFrame([(long, 1), (long, 1), (long[:300] + " vileword", 2)], "text string, k int")
    got = toxicity.score(asked, judge).orderBy("k").collect()
    assert got[0]["score"] == got[1]["score"] < 0.3 <= got[2]["score"]
    few = toxicity.fit_sample(sample, corpus, max_bytes=8_000)
    assert 0 < len(few.index.names) < len(judge.index.names)


def test_toxicity_learns_and_handles_edges(spark):
    rng = random.Random(1)
    rows = [(prose(rng, 30) + (" vileword" if i % 4 == 0 else ""), int(i % 4 == 0), i) for i in range(400)]
    judge = toxicity.fit(spark.createDataFrame(rows, "text string, label int, name bigint"))
    asked = [("a VILEWORD!", 1), (prose(rng, 40), 2), (None, 3), ("", 4), ("", 4)]
    got = {r["k"]: r["score"] for r in toxicity.score(spark.createDataFrame(asked, "text string, k int").withColumn("score", F.lit("x")), judge).collect()}
    assert got[1] >= 0.3 > max(got[2], got[3], got[4])
    empty = toxicity.fit(spark.createDataFrame([], "text string, label int, name bigint"))
    assert [r["score"] for r in toxicity.score(spark.createDataFrame(asked, "text string, k int"), empty).collect()] == [0.0] * 5


def test_toxicity_indexes_every_example_over_all_its_terms(spark):
    rng = random.Random(4)
    rows = [(prose(rng, 30) + (" vileword" if i % 4 == 0 else "") + f" clean{i}", int(i % 4 == 0), i) for i in range(200)]
    judge = toxicity.fit(spark.createDataFrame(rows, "text string, label int, name bigint"))
    texts = {i: t for t, _, i in rows}
    assert len(judge.index.names) > 120
    assert set(judge.vocabulary) == {f for i in judge.index.names for w in texts[i].split() for f in toxicity.features(w)}
    clean = next(i for i in judge.index.names if i % 4)
    asked = spark.createDataFrame([(texts[clean], 1), (texts[clean] + " zzzz", 2)], "text string, k int")
    near = {r["k"]: r["evidence"][0] for r in toxicity.score(asked, judge).collect()}
    assert near[1]["name"] == near[2]["name"] == clean and near[1]["cosine"] == 1
    # a word that no example holds only makes the text longer, by "=zzzz" and "zzz*"
    counts = toxicity.Vectorizer(judge.vocabulary)(texts[clean])
    long = sum(((1 + math.log(c)) * judge.index.idf[t]) ** 2 for t, c in counts.items())
    assert near[2]["cosine"] == pytest.approx(math.sqrt(long / (long + 2 * judge.index.unseen ** 2)))


# 3

def test_url_filter(spark):
    rules = queries.RULES
    urls = ["http://a.net/x", "http://EXAMPLE.net/en/1", "http://a.net?x", "http://example.com/de/", "http://notexample.com/de/", None, "nothing",
            "http://www.bad.io/p/?utm_source=a#f", "https://bad.io:443/p", "https://bad.io/p?q=1"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id bigint, url string").withColumn("verdict", F.lit(1))
    listed = spark.createDataFrame([("http://bad.io/p",), (None,)], "url string")
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in url_filter.filter_urls(pages, listed, rules).collect()}
    assert got[0] == ("a.net", "/x", "net/", "block") and got[1][2:] == ("example.net/en/", "allow")
    assert got[2] == ("a.net", "", None, "allow") and got[3][2:] == ("example.com/de/", "block") and got[4][2:] == (None, "allow")
    assert got[5] == got[6] == ("", "", None, "allow")
    assert [got[i][3] for i in (7, 8, 9)] == ["block", "block", "allow"]
    assert url_filter.filter_urls(pages, listed.limit(0), rules).where("verdict = 'block'").count() == 2


# 4

def test_language_profiles(spark):
    rng = random.Random(5)
    make = lambda letters: "".join(rng.choice(letters) for _ in range(60))
    labelled = [(make("abcde "), "x") for _ in range(20)] + [(make("klmno "), "y") for _ in range(20)] + [(None, "y"), ("abc", None)]
    profiles = language_id.fit_profiles(spark.createDataFrame(labelled, "text string, lang string"), dims=512)
    docs = spark.createDataFrame([(1, make("abcde ")), (2, make("klmno ").upper()), (3, None), (4, "12 !?"), (5, "")], "doc_id int, text string")
    got = {r["doc_id"]: r["lang_pred"] for r in language_id.identify(docs.withColumn("score", F.lit("s")), profiles).collect()}
    assert got == {1: "x", 2: "y", 3: "und", 4: "und", 5: "und"}
    assert language_id.keep_identified(docs, profiles).count() == 2
    none = language_id.fit_profiles(spark.createDataFrame([], "text string, lang string"))
    assert {r["lang_pred"] for r in language_id.identify(docs, none).collect()} == {"und"}


def test_bundle_is_sum_of_bound_vectors():
    encoder = language_id.Encoder(64)
    grams, counts = language_id.trigrams("Abab, abX")
    want = sum(int(n) * encoder.bound(int(g)).astype(int) for g, n in zip(grams, counts))
    assert (encoder.bundle(grams, counts) == want).all()


# 5

def test_flow_beats_no_cheaper_assignment():
    flow = source_mix.min_cost_flow([10, 6], [[0], [0, 1]], [14, 4])
    assert sum(map(sum, flow)) == 18 and sum(r[1] for r in flow) == 4 and flow[0][1] == 0
    assert sum(flow[1]) in range(6, 9)  # second copies cost the same for either pattern; first copies go first
    targets = source_mix.capped_targets({"a": 10, "b": 1000, None: 10})
    assert targets == {"a": 30.0, None: 30.0, "b": 960.0}


def test_mix_edges(spark):
    rows = [(1, 5, ["a"]), (1, 5, ["a"]), (2, None, [None]), (3, 0, None), (4, 100, ["a", "b"]), (None, 7, ["b"])]
    df = spark.createDataFrame(rows, "doc_id bigint, size bigint, sources array<string>").withColumn("taken", F.lit("clash"))
    out = source_mix.mix(df).collect()
    assert len(out) == 6 and all(r["taken"] <= 3 * r["size"] for r in out)
    assert sorted(map(str, out)) == sorted(map(str, source_mix.mix(df).collect()))
    assert source_mix.mix(df.limit(0)).count() == 0


# 6

def test_shards(spark, documents):
    rng = random.Random(2)
    texts = [prose(rng, 5) for _ in range(150)] + [f"same {i // 3}" for i in range(60)] + ["hot"] * 90 + [None, None, "", ""]
    out = sharding.shard_documents(documents([(i // 2, t) for i, t in enumerate(texts)]).withColumn("shard", F.lit("x")), 7).collect()
    counts = [sum(r["shard"] == s for r in out) for s in range(7)]
    assert sum(counts) == len(texts) and max(counts) - min(counts) <= 1
    for s in range(7):
        assert sorted(r["slot"] for r in out if r["shard"] == s) == list(range(counts[s]))
    groups = {}
    for r in out:
        groups.setdefault(r["text_crc32"], set()).add(r["shard"])
    small = [g for t, g in groups.items() if t is not None]
    assert sum(len(g) > 1 for g in small) <= 3  # the hot text cannot fit a shard
    assert sharding.shard_documents(documents([]), 7).count() == 0


def test_shards_cut_only_what_no_shard_can_hold(spark, documents):
    # a shard takes 40 rows: 30 and 25 fit one, 100 needs three, pairs and triples stay whole
    texts = ["most"] * 100 + ["more"] * 30 + ["some"] * 25 + [f"pair {i // 2}" for i in range(20)] + [f"single {i}" for i in range(25)]
    out = sharding.shard_documents(documents(list(enumerate(texts))), 5).collect()
    places = {}
    for r in out:
        places.setdefault(texts[r["doc_id"]], set()).add(r["shard"])
    assert len(out) == 200 and all(sum(r["shard"] == s for r in out) == 40 for s in range(5))
    assert {t for t, at in places.items() if len(at) > 1} == {"most"} and len(places["most"]) == 3
    assert sharding.pack([(1, 600), (2, 3000), (3, 300)], [1000] * 4) == [
        (2, 0, 1000, 0), (2, 1000, 2000, 1), (2, 2000, 3000, 2), (1, 0, 600, 3), (3, 0, 300, 3)]


# 7

def brute_components(rows, k, threshold):
    def shingles(t):
        w = (t or "").encode().lower().split()
        return frozenset(tuple(w[i:i + min(k, len(w))]) for i in range(max(1, len(w) - k + 1))) if w else frozenset()

    sets = [shingles(t) for _, t in rows]
    label = list(range(len(rows)))
    for i, j in itertools.combinations(range(len(rows)), 2):
        both = len(sets[i] & sets[j])
        if both and 100 * both >= threshold * len(sets[i] | sets[j]):
            a, b = label[i], label[j]
            label = [a if x == b else x for x in label]
    least = {}
    for (doc, _), x in zip(rows, label):
        least[x] = min(least.get(x, doc), doc)
    return [(doc, len(s), least[x]) for (doc, _), x, s in zip(rows, label, sets)]


@pytest.mark.parametrize("k,threshold", [(3, 85), (5, 80)])
def test_near_duplicates_match_brute_force(spark, documents, k, threshold):
    rng = random.Random(7)
    rows = [(i, prose(rng, rng.randint(1, 120))) for i in range(120)]
    for i in range(120):
        words = rng.choice(rows)[1].split()
        for _ in range(rng.randint(0, 3)):
            words[rng.randrange(len(words))] = rng.choice(WORDS)
        rows.append((200 + i, " ".join(words).upper() if i % 5 else " ".join(words)))
    rows += [(900, None), (901, ""), (902, "a"), (903, "A"), (904, "a b"), (905, prose(rng, 20_000))]
    got = near_dedup.components(documents(rows).withColumn("component_id", F.lit("x")), k, threshold).collect()
    assert sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got) == sorted(brute_components(rows, k, threshold))
    kept = near_dedup.drop_near_duplicates(documents(rows + rows[:5]), k, threshold)
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted({c for _, n, c in brute_components(rows, k, threshold)})


def test_dense_region_in_blocks(spark, documents, monkeypatch):
    monkeypatch.setattr(near_dedup, "BLOCK_SHINGLES", 300)
    rng = random.Random(9)
    base = prose(rng, 80).split()
    rows = []
    for i in range(150):
        words = list(base)
        for _ in range(rng.randint(0, 8)):
            words[rng.randrange(80)] = rng.choice(WORDS)
        rows.append((i, " ".join(words)))
    got = near_dedup.components(documents(rows), 3, 85).collect()
    assert sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got) == sorted(brute_components(rows, 3, 85))
    assert near_dedup.components(documents([]), 3, 85).count() == 0


# 8

def test_host_rules(spark, documents):
    good, bad = " ".join(f"w{i}" for i in range(60)), "x y z " * 40
    rows = [(i, good, "en", "fine") for i in range(20)] + [(100 + i, bad if i else good, "en", "poor") for i in range(40)]
    rows += [(200, None, None, None), (201, "a#b\na#b\n\n \nc", None, None), (202, good, None, None)]
    out = {r["doc_id"]: r for r in host_rules.apply_host_rules(documents(rows).withColumn("kept", F.lit("x")), "source").collect()}
    assert out[0]["kept"] and not out[100]["kept"] and not out[100]["base_failed"] and out[202]["kept"]
    assert out[101]["n_repeat_words"] == 120 and out[200]["n_words"] == 0
    assert (out[201]["n_symbols"], out[201]["n_dup_lines"], out[201]["word_chars"]) == (2, 1, 7)
    assert host_rules.apply_host_rules(documents([]), "source").count() == 0


# 9

def test_token_counts(spark, documents):
    scores = {c: -8.0 for c in "▁abc"} | {"▁a": -3.0, "ab": -4.0, "▁ab": -4.5, "bc": -4.0, "abc": -5.0}

    def brute(word):
        best = [(0.0, 0)] + [(-1e18, 0)] * len(word)
        for end in range(1, len(word) + 1):
            n = len(word[end - 1].encode())
            best[end] = (best[end - 1][0] - 12.0 * n, best[end - 1][1] - n)
            for start in range(end):
                if word[start:end] in scores:
                    best[end] = max(best[end], (best[start][0] + scores[word[start:end]], best[start][1] - 1))
        return -best[-1][1]

    trie = token_counts.Trie(scores, 3)
    for n in range(6):
        for letters in itertools.product("abcé", repeat=n):
            assert trie.count("▁" + "".join(letters)) == brute("▁" + "".join(letters))
    assert trie.count("▁" + "abc" * 100) == brute("▁" + "abc" * 100)
    out = token_counts.count_tokens(documents([(1, None), (2, ""), (3, "a a b"), (3, "a a b")]).withColumn("n_tokens", F.lit("x")),
                                    queries.tokenizer_file("piece_bpe_32k.model")).collect()
    assert sorted((r["doc_id"], r["n_pretokens"], r["n_distinct_pretokens"]) for r in out) == [(1, 0, 0), (2, 0, 0), (3, 3, 2), (3, 3, 2)]


# 10

def test_edit_search():
    rng = random.Random(4)
    for _ in range(200):
        item = [rng.randint(0, 3) for _ in range(rng.randint(1, 9))]
        text = [rng.randint(0, 3) for _ in range(rng.randint(0, 14))]
        prev = list(range(len(item) + 1))
        best = prev[-1]
        for x in text:
            cur = [0]
            for i, y in enumerate(item, 1):
                cur.append(min(prev[i] + 1, cur[-1] + 1, prev[i - 1] + (x != y)))
            prev, best = cur, min(best, cur[-1])
        assert decontaminate.edit_search(item, text)[0] == best


def test_leaks(spark, documents):
    rng = random.Random(6)
    items = [(i, prose(rng, rng.randint(12, 50))) for i in range(40)] + [(98, None), (99, "two words")]
    rows, want = [], set()
    for i, text in items[:40]:
        words = text.split()
        for _ in range(int(0.2 * len(words))):
            words[rng.randrange(len(words))] = "zzz"
        rows.append((i, prose(rng, 200) + " " + " ".join(words).upper() + ", " + prose(rng, 30)))
        want.add((i, i))
    rows += [(500 + i, prose(rng, 300)) for i in range(40)] + [(600, None), (601, ""), (602, items[0][1])]
    bench = spark.createDataFrame(items, "item_id bigint, text string").withColumn("doc_id", F.lit(1))
    got = decontaminate.find_leaks(documents(rows), bench).collect()
    found = {(r["doc_id"], r["item_id"]) for r in got}
    assert found - {(602, 0)} <= want and len(found & want) >= 39 and (602, 0) in found
    assert {(r["doc_id"], r["item_id"]) for r in decontaminate.find_leaks(documents(rows), bench, items_per_block=7).collect()} >= {(602, 0)}
    kept = {r["doc_id"] for r in decontaminate.drop_contaminated(documents(rows), bench).collect()}
    assert kept == {r[0] for r in rows} - {d for d, _ in found}
    assert decontaminate.find_leaks(documents(rows), bench.limit(0)).count() == 0


def test_shards_draw_near_copies_together(spark, documents):
    # families of three texts with one opening; two of the three are a pair of equal texts
    start = "the quick brown fox number {} jumps over the lazy dog and runs through the wide green field until evening "
    texts = [start.format(f"x{i // 4}y") * 2 + ("same", "same", "other", "third")[i % 4] for i in range(4 * 150)]
    docs = documents(list(enumerate(texts + [f"text {i}" for i in range(1200)])))

    def together(rounds):
        out = sharding.shard_documents(docs, 3, rounds).collect()
        assert [sum(r["shard"] == s for r in out) for s in range(3)] == [600, 600, 600]
        place = {r["doc_id"]: r["shard"] for r in out}
        assert sum(place[4 * i] != place[4 * i + 1] for i in range(150)) <= 3
        return sum(len({place[4 * i + j] for j in range(4)}) == 1 for i in range(150))

    assert together(8) > together(0)
