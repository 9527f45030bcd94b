"""Operators over texts against plain versions, and the cases their docstrings define."""

import itertools
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from factloom.llm import decontamination, language, licenses, line_dedup, near_dedup, packing, tokens, toxicity
from factloom.llm import wordhash as H

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, key string, signature string"
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau".split()


def docs(spark, texts, ids=None, lang="en", source="s"):
    """Documents with extra columns whose names clash with inner ones."""
    ids = range(len(texts)) if ids is None else ids
    return spark.createDataFrame([(i, t, lang, source, len(t or ""), "k", "x") for i, t in zip(ids, texts)], DOCS)


def low(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def test_words_are_those_of_the_pattern():
    texts = ["", None, " a  B\tc", "x", "é É-É", "0" * 50 + " \x0b y\n", "end "] * 3
    for separators, pattern in ((H.BLANKS, r"[^\x20\x09-\x0D]+"), (H.NON_ALNUM, r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")):
        for limit in (1, 7, 1 << 20):
            counts = np.concatenate([w.counts() for w in H.words(pa.array(texts), separators, limit)])
            assert counts.tolist() == [len(re.findall(pattern, low(t))) for t in texts]
    hashes = next(H.words(pa.array(["Ab ab aB ba"]), H.BLANKS)).hash
    assert len(set(hashes.tolist())) == 2


def plain_components(texts, ids, size):
    sets = []
    for text in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", low(text))
        sets.append({tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))} if w else set())
    root = {i: i for i in ids if i is not None}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for (i, a), (j, b) in itertools.combinations([(i, s) for i, s in zip(ids, sets) if i is not None and s], 2):
        both = len(a & b)
        if 100 * both >= 80 * (len(a) + len(b) - both):
            x, y = find(i), find(j)
            root[max(x, y)] = min(x, y)
    return {i: find(i) for i in root}, [len(s) for s in sets]


def chains(seed=1):
    """Texts that drift away from each other by single words, copies, short and odd ones."""
    rng = random.Random(seed)
    texts = [None, "", "  \t", "one", "One", "one two", "one two three", "é é é é é", " ".join(WORDS * 40)]
    for _ in range(6):
        current = [rng.choice(WORDS) + str(rng.randrange(30)) for _ in range(rng.randrange(20, 90))]
        for _ in range(25):
            texts.append(" ".join(current))
            current = list(current)
            current[rng.randrange(len(current))] = "new" + str(rng.randrange(10**6))
        texts.append(texts[-1])
    return texts


@pytest.mark.parametrize("size", [4, 5])
def test_near_duplicates_equal_brute_force(spark, size):
    texts = chains()
    rows = near_dedup.near_duplicates(docs(spark, texts), shingle=size).collect()
    want, sizes = plain_components(texts, range(len(texts)), size)
    assert {r["doc_id"]: r["component_id"] for r in rows} == want
    assert {r["doc_id"]: r["n_shingles"] for r in rows} == dict(enumerate(sizes))
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in rows)


def test_near_duplicates_compare_what_is_left_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "BLOCK", 3)
    texts = chains(2)
    rows = near_dedup.near_duplicates(docs(spark, texts), shingle=4).collect()
    assert {r["doc_id"]: r["component_id"] for r in rows} == plain_components(texts, range(len(texts)), 4)[0]


def test_near_duplicates_with_repeated_and_missing_ids(spark):
    long = " ".join(WORDS)
    rows = near_dedup.near_duplicates(docs(spark, [long, long, long, None, "a b c d e f"], [5, 5, None, None, 7]), shingle=5).collect()
    assert sorted((r["doc_id"] or -1, r["component_id"] or -1, r["kept"]) for r in rows) == [(-1, -1, True), (-1, -1, True), (5, 5, True), (5, 5, True), (7, 7, True)]
    assert near_dedup.near_duplicates(docs(spark, [])).count() == 0


def test_lines_over_the_ratio_go(spark):
    texts = ["menu\nbody %d\n\n menu" % k for k in range(6)] + ["other"] * 4 + [None, ""]
    d = docs(spark, texts).unionByName(docs(spark, ["menu"] * 2, [50, 51], source=None))
    found = line_dedup.boilerplate(d, "source", "text", ratio=0.4, least_pages=5)
    assert [(r["n_pages"], r["host_pages"]) for r in found.collect()] == [(6, 12)]
    out = {r["doc_id"]: r for r in line_dedup.drop_lines(d, found, "source", "text").collect()}
    assert out[0]["text"] == "body 0\n" and out[0]["n_dropped"] == 2 and out[0]["n_lines"] == 4
    assert out[6]["text"] == "other" and out[10]["text"] is None and out[10]["n_lines"] == 0 and out[11]["text"] == ""
    assert out[50]["text"] == "menu" and out[0]["key"] == "k"
    none = line_dedup.boilerplate(docs(spark, []), "source", "text")
    assert none.count() == 0 and line_dedup.drop_lines(d, none, "source", "text").count() == d.count()


def test_lines_by_join_equal_lines_by_broadcast(spark, monkeypatch):
    d = docs(spark, ["menu\nbody %d" % k for k in range(8)])
    found = line_dedup.boilerplate(d, "source", "text")
    few = sorted(map(str, line_dedup.drop_lines(d, found, "source", "text").collect()))
    monkeypatch.setattr(line_dedup, "BROADCAST_LINES", 0)
    assert sorted(map(str, line_dedup.drop_lines(d, found, "source", "text").collect())) == few


def test_planted_items_are_found_and_clean_documents_are_not(spark):
    rng = random.Random(3)
    noise = lambda n: " ".join(rng.choice(WORDS) + str(rng.randrange(500)) for _ in range(n))
    items = [noise(n) for n in (40, 25, 12, 5, 3)]
    texts = [noise(60) for _ in range(30)]
    want = set()
    for k, item in enumerate(items):
        texts.append(f"{noise(20)} {item.upper()}, {noise(7)}")
        want.add((len(texts) - 1, k))
        texts.append(item)
        want.add((len(texts) - 1, k))
    words = items[0].split()
    texts.append(" ".join(words[:20] + ["inserted"] + words[20:]))
    want.add((len(texts) - 1, 0))
    texts.append(" ".join(words[:25]))  # 21 of 36 shingles: not enough
    texts += [None, "", items[0] + "\n" + noise(200) + " " + items[0]]
    want.add((len(texts) - 1, 0))
    table = spark.createDataFrame([(k, t, 1) for k, t in enumerate(items)] + [(90, None, 1), (91, "...", 1), (None, "a b", 1)], "item_id bigint, text string, key int")
    found = decontamination.contaminated(docs(spark, texts), table).collect()
    assert {(r["doc_id"], r["item_id"]) for r in found} == want
    by = {(r["doc_id"], r["item_id"]): r for r in found}
    assert by[len(texts) - 1, 0]["n_windows"] >= 2 and by[len(texts) - 1, 0]["first_word"] == 0 and by[31, 0]["similarity"] == 1.0
    assert decontamination.contaminated(docs(spark, texts), table.limit(0)).count() == 0
    assert decontamination.contaminated(docs(spark, []), table).count() == 0


def test_altered_copies_of_common_passages_are_found(spark):
    rng = random.Random(11)
    noise = lambda n: " ".join(f"w{rng.randrange(10**6)}" for _ in range(n))
    item = noise(40)
    texts = [f"{noise(10)} {item} {noise(10)}" for _ in range(150)]
    for k in range(6, 34):  # one word changed: 31 of 36 shingles are left
        words = item.split()
        words[k] = "changed"
        texts.append(f"{noise(30)} {' '.join(words)} {noise(30)}")
    table = spark.createDataFrame([(0, item)], "item_id bigint, text string")
    found = decontamination.contaminated(docs(spark, texts), table)
    assert {r["doc_id"] for r in found.collect()} == set(range(len(texts)))


def test_an_altered_passage_in_most_documents_is_found(spark):
    rng = random.Random(12)
    noise = lambda n: " ".join(f"w{rng.randrange(10**6)}" for _ in range(n))
    words = noise(50).split()
    items = spark.createDataFrame([(0, " ".join(words)), (1, noise(50))], "item_id bigint, text string")
    altered = " ".join(words[:25] + ["changed"] + words[26:])  # 41 of 46 shingles are left
    texts = [f"{noise(10)} {altered} {noise(10)}" for _ in range(180)] + [noise(70) for _ in range(20)]
    texts.append(" ".join(words[:20]))  # 16 of 46: not enough
    found = {r["doc_id"]: r for r in decontamination.contaminated(docs(spark, texts), items).collect()}
    assert set(found) == set(range(180)) and {r["item_id"] for r in found.values()} == {0}
    assert {(r["similarity"], r["first_word"], r["n_windows"]) for r in found.values()} == {(round(41 / 46, 6), 10, 1)}


def plain_licence(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low(text))
    places = {t.label: [i for i in range(len(words)) if tuple(words[i : i + len(t.words)]) == t.words] for t in licenses.PHRASES}
    labels, score = {k for k, v in places.items() if v}, 1.0 if any(places.values()) else 0.0
    for at in range(0, len(words), licenses.STRIDE):
        block = set(words[at : at + 2 * licenses.STRIDE])
        for t in licenses.NOTICES:
            shared = len(block & set(t.words))
            if shared >= t.need:
                labels.add(t.label)
                score = max(score, shared / len(set(t.words)))
    every = sorted(i for v in places.values() for i in v)
    base = ",".join(sorted(k for k, v in places.items() if v))
    return len(words), len(every), every[0] if every else None, every[-1] if every else None, base, ",".join(sorted(labels)), score


def test_licences_equal_brute_force(spark):
    rng = random.Random(4)
    vocabulary = sorted({w for t in licenses.PHRASES + licenses.NOTICES for w in t.words}) + WORDS
    texts = [None, "", "MIT", "mit license", "The MIT-License; cc by, CC-BY", "x " * 63 + "apache license", "x " * 64 + "Apache License " * 3]
    texts += [licenses.NOTICES[1].text, " ".join(licenses.NOTICES[6].text.split()[::-1])]
    texts += [" ".join(rng.choice(vocabulary) for _ in range(rng.randrange(300))) for _ in range(60)]
    texts += ["word " * 30_000 + "gnu general public license", "mit license"]
    rows = licenses.licences(docs(spark, texts, [0, *range(1, len(texts) - 1), 3])).collect()
    got = sorted((tuple(r) for r in rows), key=repr)
    ids = [0, *range(1, len(texts) - 1), 3]
    want = sorted(((i, *plain_licence(t)) for i, t in zip(ids, texts)), key=repr)
    assert [tuple(map(str, g)) for g in got] == [tuple(map(str, w)) for w in want]
    assert licenses.licences(docs(spark, [])).count() == 0


def test_token_counts_equal_the_public_tokenizer(spark):
    from tokenizers import Tokenizer, models, pre_tokenizers

    pieces = tokens.vocabulary()
    plain = Tokenizer(models.Unigram(pieces, unk_id=0, byte_fallback=True))
    plain.pre_tokenizer = pre_tokenizers.Metaspace(replacement=tokens.MARK, prepend_scheme="always", split=True)
    texts = ["", "  a", " ", "▁", "😀😀 x", "\n\n", "<0x41> <s>", "日本語テキスト", "á\u0301ß", "The quick brown fox", "x" * 5000] + chains()[3:60]
    rows = docs(spark, [None, *texts]).select("doc_id", tokens.token_counts(F.col("text"))["n_tokens"].alias("n")).collect()
    assert [r["n"] for r in sorted(rows)] == [0] + [len(x.ids) for x in plain.encode_batch(texts)]
    small = [("<unk>", 0.0), ("▁", -2.0), ("a", -1.0), ("b", -1.0), ("ab", -2.0), ("▁a", -3.0), ("ba", -2.0)]
    plain, own = Tokenizer(models.Unigram(small, unk_id=0, byte_fallback=False)), tokens.Counter(small)
    plain.pre_tokenizer = pre_tokenizers.Metaspace(replacement=tokens.MARK, prepend_scheme="always", split=True)
    for n in range(1, 6):
        for text in map("".join, itertools.product("abx ", repeat=n)):
            assert own.text(text)[0] == len(plain.encode(text).ids), text


def plain_bits(training, text):
    """Prediction by partial matching, straight from its definition."""
    counts = {}
    for t in training:
        data = bytes(3) + t.encode()
        for i in range(3, len(data)):
            for k in range(4):
                context = counts.setdefault(data[i - k : i], {})
                context[data[i]] = context.get(data[i], 0) + 1
    bits, data = 0.0, bytes(3) + text.encode()
    for i in range(3, len(data)):
        excluded = set()
        for k in (3, 2, 1, 0):
            seen = counts.get(data[i - k : i])
            if seen is None:
                excluded = set()
                continue
            left = {s: n for s, n in seen.items() if s not in excluded}
            size = sum(left.values()) + len(left)
            if left and data[i] in left:
                bits += np.log2(size / left[data[i]])
                break
            if left:
                bits += np.log2(size / len(left))
            excluded = set(seen)
        else:
            bits += np.log2(256 - len(counts[b""]))
    return bits


def test_code_lengths_equal_the_definition(spark):
    training = {"aa": ["the cat sat on the mat", "the dog"], "bb": ["le chat est là", "où est le chien é"]}
    rows = [(k, t, lang) for k, (lang, t) in enumerate((a, t) for a, ts in training.items() for t in ts)] + [(9, None, "aa"), (10, "zzz", None)]
    (model,) = language.train(spark.createDataFrame(rows, "doc_id bigint, text string, lang string"))
    assert model.languages == ["aa", "bb"]
    texts = ["the chat", "xyz", "", "là-bas où", "t", "ññ", "on the mat the cat"]
    offsets = np.cumsum([0] + [len(t.encode()) for t in texts])
    got = model.costs(np.frombuffer("".join(texts).encode(), np.uint8), offsets)
    want = [[plain_bits(training[x], t) for x in model.languages] for t in texts]
    assert np.allclose(got, want, rtol=1e-5)
    out = language.identify(docs(spark, ["the cat", "est là", None, "", "123 !", "ß"]).select("doc_id", "text"), "text", [model], "p").select("doc_id", "p").collect()
    assert [r["p"]["lang"] for r in sorted(out)][:5] == ["aa", "bb", "und", "und", "und"] and sorted(out)[5]["p"]["lang"] != "und"
    nothing = language.train(docs(spark, []).select("doc_id", "text", "lang"))
    assert language.identify(docs(spark, ["abc"]), "text", nothing).select("language.lang").first()[0] == "und"


def test_many_languages_in_groups_equal_one_table(spark):
    rng = np.random.default_rng(3)
    words = ["".join(chr(97 + c) for c in rng.integers(0, 26, 5)) for _ in range(140)]
    rows = [(k, f"{w} {words[(k + 1) % 140]} {w}", f"l{k:03}") for k, w in enumerate(words)]
    labelled = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    whole, parts = language.train(labelled), language.train(labelled, cells=12_000)
    assert len(whole) == 1 and len(whole[0].languages) == 140 and len(parts) > 2 and [x for m in parts for x in m.languages] == whole[0].languages
    texts = docs(spark, [*words[:20], "zzz", None, "1"]).select("doc_id", "text")
    got = [sorted(language.identify(texts, "text", models, "p").select("doc_id", "p.lang", "p.score").collect()) for models in (whole, parts)]
    assert [r[:2] for r in got[0]] == [r[:2] for r in got[1]] and np.allclose([r[2] for r in got[0]], [r[2] for r in got[1]])


def plain_segments(weights):
    """Maximal scoring segments by repeatedly taking the best (shortest, first) one and splitting there."""
    out = []

    def split(low, high):
        best = None
        for i in range(low, high):
            for j in range(i + 1, high + 1):
                s = sum(weights[i:j])
                if s > 0 and (best is None or s > best[0]):
                    best = (s, i, j)
        if best:
            out.append(best)
            split(low, best[1])
            split(best[2], high)

    split(0, len(weights))
    return sorted((a, b) for _, a, b in out)


def test_segments_equal_brute_force():
    rng = random.Random(5)
    for _ in range(150):
        weights = [rng.choice([-3, -2, -1.5, -1.25, 1, 2.125, 3.5, 4.0625]) + rng.random() / 1000 for _ in range(rng.randrange(14))]
        assert sorted((a, b) for _, a, b in toxicity.segments(np.array(weights))) == plain_segments(weights)


def test_toxic_passages_are_learned_and_found(spark):
    rng = random.Random(6)
    noise = lambda n: [rng.choice(WORDS) for _ in range(n)]
    texts, labels = [], []
    for k in range(200):
        words = noise(80)
        if k % 5 == 0:
            words[30:33] = ["vile", "awful", "vile"]
        texts.append(" ".join(words))
        labels.append((k, int(k % 5 == 0), "k"))
    table = spark.createDataFrame(labels + [(None, 1, "k"), (500, None, "k"), (3, 0, "k")], "doc_id bigint, toxic int, key string")
    model = toxicity.train(docs(spark, texts), table.filter("doc_id < 150 OR doc_id IS NULL"))
    probe = docs(spark, [*texts[150:], None, "", "VILE awful", " ".join(noise(20_000))])
    rows = probe.select("doc_id", toxicity.toxicity(F.col("text"), model).alias("t")).orderBy("doc_id").collect()
    assert [r["t"]["score"] >= 0.7 for r in rows] == [k % 5 == 0 for k in range(150, 200)] + [False, False, True, False]
    assert rows[0]["t"]["passages"][0]["start"] == 30 and rows[0]["t"]["passages"][0]["end"] == 33
    assert all(0 <= r["t"]["score"] <= 1 for r in rows)
    empty = toxicity.train(docs(spark, texts), table.limit(0))
    assert docs(spark, ["vile"]).select(toxicity.toxicity(F.col("text"), empty)["score"]).first()[0] == 0


def test_a_smaller_sample_leaves_toxicity_scores_where_they_were(spark):
    rng = random.Random(9)
    texts, labels = [], []
    for k in range(3000):
        words = [rng.choice(WORDS) + str(rng.randrange(20)) for _ in range(40)]
        if rng.random() < (0.8 if k % 10 == 0 else 0.1):  # the word stands in most toxic and in some clean texts
            words[20] = "vile"
        texts.append(" ".join(words))
        labels.append((k, int(k % 10 == 0)))
    table = spark.createDataFrame(labels, "doc_id bigint, toxic int")
    corpus, probe = docs(spark, texts), docs(spark, ["plain words", "some vile words here"])
    score = lambda most: [
        r[0] for r in probe.orderBy("doc_id").select(toxicity.toxicity(F.col("text"), toxicity.train(corpus, table, most_rows=most))["score"]).collect()]
    whole, part = score(10_000), score(300)
    log_odds = lambda p: np.log(p) - np.log1p(-np.array(p))
    assert np.abs(log_odds(part) - log_odds(whole)).max() < 0.6


def plain_pack(sizes, lengths, overhead):
    opened, used, out, left = [], [], [], sum(sizes)
    for size in sizes:
        fitting = [(c - u, -k) for k, (c, u) in enumerate(zip(opened, used)) if c - u >= size]
        if fitting:
            k = -min(fitting)[1]
        else:
            opened.append(min((x for x in lengths if x >= size), key=lambda x: ((x + overhead) / min(x, left), x)))
            used.append(0)
            k = len(opened) - 1
        out.append((k, used[k]))
        used[k] += size
        left -= size
    return out, [min(x for x in lengths if x >= u) for u in used]


def test_packing_equals_plain_best_fit(spark):
    rng = random.Random(7)
    for _ in range(60):
        lengths = sorted(rng.sample(range(4, 40), 3))
        sizes = sorted((rng.randrange(1, lengths[-1] + 1) for _ in range(rng.randrange(40))), reverse=True)
        bins, offsets, final = packing.pack(sizes, lengths, 2)
        _, want = plain_pack(sizes, lengths, 2)
        room = {}
        for size, b, offset in zip(sizes, bins, offsets):
            assert offset == room.get(b, 0)
            room[b] = offset + size
        assert sorted(final) == sorted(want) and all(room[b] <= final[b] for b in room)


def test_packing_keeps_every_word_once(spark):
    texts = [None, "", "a", "b " * 9000, "c " * 4096, "d " * 512] + ["e " * n for n in range(1, 300, 7)]
    d = docs(spark, texts + ["a"], [*range(len(texts)), 2])
    rows = packing.best_fit(d, "doc_id", packing.word_count(F.col("text")), shard_rows=10).collect()
    for k, text in enumerate(texts):
        copies = 2 if k == 2 else 1
        own = sorted((r["start"], r["length"]) for r in rows if r["doc_id"] == k)
        assert sum(n for _, n in own) == copies * len((text or "").split())
        assert copies == 2 or all(a[0] + a[1] == b[0] for a, b in zip(own, own[1:]))
    sequences = {}
    for r in rows:
        assert (r["sequence"] is None) == (r["length"] == 0)
        if r["sequence"]:
            sequences.setdefault(r["sequence"], []).append(r)
    for parts in sequences.values():
        parts.sort(key=lambda r: r["offset"])
        assert all(a["offset"] + a["length"] == b["offset"] for a, b in zip(parts, parts[1:])) and parts[0]["offset"] == 0
        filled, capacity = parts[-1]["offset"] + parts[-1]["length"], parts[0]["capacity"]
        assert filled <= capacity and capacity == min(x for x in packing.LENGTHS if x >= filled)
    assert packing.best_fit(docs(spark, []), "doc_id", packing.word_count(F.col("text"))).count() == 0


def test_only_a_to_z_are_folded_in_licences(spark):
    text = licenses.NOTICES[3].text.replace("work", "wor\u212a")
    (row,) = licenses.licences(docs(spark, [text])).collect()
    assert row["score"] == 12 / 13
