"""Spelling variants, conversation repair and phrase fingerprints against plain versions."""

import hashlib
import random
import zlib
from collections import Counter

import pytest

from factloom.llm import conversations, phrases, spelling

DOCS = "doc_id bigint, text string, word string, n long, edge string, part int"


# spelling variants ------------------------------------------------------------------------------------------------


def plain_words(rows):
    counts = Counter()
    for doc_id, text in rows:
        for run in spelling.RUN.findall((text or "").translate(spelling._LOWER)):
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 31 == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1 :]
            counts[run] += 1
    return {w: n for w, n in counts.items() if len(w) >= 7 and n >= 2}


def one_edit(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    short, long = sorted((a, b), key=len)
    return any(long[:i] + long[i + 1 :] == short for i in range(len(long)))


def plain_variants(counts):
    form, out = {}, {}
    for w, n in counts.items():
        near = sorted((v for v in counts if one_edit(w, v)), key=lambda v: (-counts[v], v))
        form[w] = near[0] if near and counts[near[0]] >= 10 * n else None
        out[w] = (n, len(near))
    rows = set()
    for w in counts:
        root = w
        while form[root]:
            root = form[root]
        rows.add((w, form[w], root, *out[w], counts[form[w]] if form[w] else None))
    return rows


def corpus(seed=5):
    rng = random.Random(seed)
    stems = ["".join(rng.choice("abcé") for _ in range(rng.randint(6, 9))) for _ in range(25)]
    rows = []
    for doc_id in range(60):
        out = []
        for _ in range(40):
            w = stems[min(int(rng.expovariate(0.4)), 24)]
            if rng.random() < 0.3:
                at = rng.randrange(len(w))
                w = w[:at] + rng.choice(["", "x", "ÿ", w[at] * 2]) + w[at + 1 :]
            out.append(w.upper() if rng.random() < 0.1 else w)
        rows.append((doc_id, " ".join(out)))
    return [*rows, (None, rows[0][1]), (7, None), (8, ""), (9, "... 123"), rows[3], (70, ("abcabca" * 4000 + " ") * 2 + "a" * 30_000 + " " + "a" * 30_000 + " " + "a" * 29_999)]


@pytest.mark.parametrize("shard_words, asked", [(20_000, 60_000), (15, 7)])
def test_variants_equal_the_plain_version(spark, shard_words, asked):
    rows = corpus()
    df = spark.createDataFrame([(k, t, "odd", 1, "first", 2) for k, t in rows], DOCS).repartition(3)
    counts = plain_words(rows)
    short = {w: n for w, n in counts.items() if len(w) < 100}
    got = spelling.variants(spelling.vocabulary(df), shard_words=shard_words, asked=asked).collect()
    assert len(got) == len(counts)
    got = {tuple(r[c] for c in ("word", "form", "root", "n", "n_near", "form_n")) for r in got}
    assert {r for r in got if len(r[0]) < 100} == plain_variants(short)
    assert any(r[1] for r in got)


def test_forms_are_followed_to_the_last(spark):
    words = [("abcdefg", 2), ("abcdefgh", 20), ("abcdefghi", 200), ("abcdefghij", 2000), ("zzzzzzz", 5)]
    got = {r["word"]: (r["form"], r["root"]) for r in spelling.variants(spark.createDataFrame(words, "word string, n long")).collect()}
    assert got["abcdefg"] == ("abcdefgh", "abcdefghij") and got["abcdefghij"] == (None, "abcdefghij") and got["zzzzzzz"] == (None, "zzzzzzz")


def test_ties_of_forms_go_to_the_first_word(spark):
    words = [("aaaaaaa", 2), ("aaaaaab", 20), ("aaaaaac", 20), ("aaaaaaé", 20)]
    got = {r["word"]: (r["form"], r["n_near"]) for r in spelling.variants(spark.createDataFrame(words, "word string, n long")).collect()}
    assert got["aaaaaaa"] == ("aaaaaab", 3) and got["aaaaaab"] == (None, 3)


def test_no_words(spark):
    empty = spark.createDataFrame([], DOCS)
    assert spelling.variants(spelling.vocabulary(empty)).collect() == []


@pytest.mark.parametrize("letters, size", [("ab", 120), ("abcÿ", 400), ("a", 12), ("abcdefghé", 1)])
def test_both_searches_find_every_pair_once(letters, size):
    rng = random.Random(size)
    words = sorted({"".join(rng.choice(letters) for _ in range(rng.randint(1, 9))) for _ in range(size)})
    index, pairs = spelling.Index(words), []
    for side in (1, 0):
        for query, number in zip(*index.near(words, side)):
            word, near = words[query], words[number]
            if side or near[: len(word) // 2] != word[: len(word) // 2]:
                pairs.append((word, near))
    assert len(pairs) == len(set(pairs))
    assert set(pairs) == {(a, b) for a in words for b in words if one_edit(a, b)}


# conversation repair ----------------------------------------------------------------------------------------------


def plain_repair(rows):
    """Report and text of a conversation's rows (turn, role, text) after damage; tries every edit with costs in layers."""
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
    seen, faults = set(), []
    for _, role, text in rows:
        bare = text.strip(" \t\n\x0b\x0c\r")
        faults.append("b" if not bare else "d" if (role, text) in seen else "t" if bare[-1] not in ".!?" else "")
        seen.add((role, text))
    after = {"": "su", "s": "u", "u": "a", "a": "u"}
    full = {"u": "user", "a": "assistant"}

    def better(layer, state, value):
        if state not in layer or value[:2] < layer[state][:2]:
            layer[state] = value
            return True

    def inserted(layer):
        changed = True
        while changed:
            changed = False
            for state, (cost, audit, lines) in list(layer.items()):
                for r in after[state].replace("s", ""):
                    changed |= bool(better(layer, r, (cost + 3, audit + "I", [*lines, full[r] + ":"])))
        return layer

    layer = inserted({"": (0, "", [])})
    for (_, role, text), fault in zip(rows, faults):
        then = {}
        for state, (cost, audit, lines) in layer.items():
            better(then, state, (cost + 4, audit + "D", lines))
            if fault not in ("b", "d"):
                more = 3 if fault == "t" else 0
                for r in after[state]:
                    if role[:1] == r:
                        better(then, r, (cost + more, audit + "K", [*lines, f"{role}:{text}"]))
                    if r != "s":
                        better(then, r, (cost + more + 3, audit + "R", [*lines, f"{full[r]}:{text}"]))
        layer = inserted(then)
    cost, audit, lines = min(layer[s] for s in ("", "a") if s in layer)
    turns, first = {r[0] for r in rows} - {None}, [r[1][:1] for r in rows]
    text = "\n".join(lines)
    return {
        "gaps": max(turns) - min(turns) + 1 - len(turns) if turns else 0, "blank": faults.count("b"), "duplicate": faults.count("d"), "truncated": faults.count("t"),
        "illegal": sum(a + b not in ("su", "ua", "au") for a, b in zip(first, first[1:])), "cost": cost, "audit": audit,
        "sha256": hashlib.sha256(text.encode()).hexdigest(),
    }, text


TALKS = "conv_id bigint, turn bigint, role string, text string, present boolean"


def talks(seed=3, conversations_=40, most=12):
    rng, rows = random.Random(seed), []
    for conv in range(conversations_):
        for turn in range(rng.randint(1, most)):
            role = rng.choice(["user", "assistant", "system", "tool", "", "usher"]) if rng.random() < 0.3 else ("user", "assistant")[turn % 2]
            text = rng.choice(["", " \t\n", "Yes.", "No", "Why? ", "Well!", f"Turn {turn}.", f"turn {turn}"])
            rows.append((conv if conv else None, rng.choice([turn, turn, turn, None, turn + 3]), role, text, rng.random() < 0.9))
    return rows


@pytest.mark.parametrize("long, piece", [(4096, 1024), (2, 3), (0, 1)])
def test_repair_equals_the_plain_version(spark, monkeypatch, long, piece):
    monkeypatch.setattr(conversations, "PIECE", piece)
    rows = talks()
    report, texts = conversations.repair(spark.createDataFrame(rows, TALKS).repartition(3), long=long)
    got = {r["conv_id"]: {k: v for k, v in r.asDict().items() if k != "conv_id"} for r in report.collect()}
    parts = {}
    for r in texts.orderBy("part").collect():
        parts.setdefault(r["conv_id"], []).append(r["repaired"])
    assert set(got) == {r[0] for r in rows}
    for conv in got:
        want, text = plain_repair([r[1:4] for r in rows if r[0] == conv and r[4]])
        assert got[conv] == want
        assert "\n".join(parts.get(conv, [""])) == text


def test_long_conversation_crosses_pieces_and_tasks(spark):
    rng = random.Random(9)
    rows = [(1, turn, rng.choice(["user", "assistant", "system"]), rng.choice(["Yes.", "No", f"Turn {turn}.", f"At {turn}!", ""]), True) for turn in range(5000)]
    report, _ = conversations.repair(spark.createDataFrame(rows, TALKS).repartition(5))
    (got,) = report.collect()
    want, _ = plain_repair([r[1:4] for r in rows])
    assert {k: got[k] for k in want} == want


def test_damage_and_nulls(spark):
    rows = [(c, t, r, x) for c in (1, None) for t in [*range(60), None] for r, x in [("user", "One. Two! Three?")]] + [(5, 1, None, None)]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    want = Counter()
    for c, t, r, x in rows:
        r, x = " " if r is None else r, " " if x is None else x
        f = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        if f:
            x = "" if f == 1 else x.translate({ord(k): None for k in ".!?"}) if f == 2 else x
            want[c, t, "user" if f == 4 else r, x] += 2 if f == 3 else 1
    found = conversations.damaged(df).filter("present").collect()
    assert Counter((r["conv_id"], r["turn"], r["role"], r["text"]) for r in found) == want


def test_no_conversations(spark):
    report, texts = conversations.repair(spark.createDataFrame([], TALKS))
    assert report.collect() == [] and texts.collect() == []


def test_all_rows_dropped(spark):
    report, _ = conversations.repair(spark.createDataFrame([(4, 1, None, None, False)], TALKS))
    (row,) = report.collect()
    assert (row["cost"], row["audit"], row["sha256"]) == (0, "", hashlib.sha256(b"").hexdigest())


# phrase fingerprints ----------------------------------------------------------------------------------------------


def plain_phrases(text):
    """The phrase set by its definition."""
    data, known, start = text.encode(), set(), 0
    for end in range(1, len(data) + 1):
        if data[start:end] not in known:
            known.add(data[start:end])
            start = end
    return known


def test_parse_learns_the_phrases():
    rng = random.Random(2)
    for size in (0, 1, 50, 3000):
        text = "".join(rng.choice("abcé ") for _ in range(size))
        parse = phrases.Parse()
        parse.feed(text.encode())
        assert len(parse.hashes) - 1 == len(plain_phrases(text)) == len(set(parse.hashes[1:]))
        halves = phrases.Parse()
        halves.feed(text[: size // 2].encode())
        halves.minima()
        halves.feed(text[size // 2 :].encode())
        assert halves.hashes == parse.hashes and halves.fingerprint() == parse.fingerprint()


def test_likeness_estimates_the_shared_phrases():
    rng = random.Random(4)
    words = ["".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(400)]
    left = " ".join(rng.choice(words) for _ in range(2000))
    for share in (0.0, 0.3, 0.7, 1.0):
        right = left[: int(len(left) * share)] + " ".join(rng.choice(words) for _ in range(int(2000 * (1 - share))))
        a, b = plain_phrases(left), plain_phrases(right)
        assert abs(phrases.likeness(phrases.fingerprint(left), phrases.fingerprint(right)) - len(a & b) / len(a | b)) < 0.15


@pytest.mark.parametrize("partitions", [1, 5])
def test_fingerprints_equal_the_plain_version(spark, partitions):
    rng = random.Random(6)
    text = lambda n: "".join(rng.choice("abcdé ñ\n") for _ in range(n))
    rows = [(k, text(rng.randint(0, 300))) for k in range(40)] + [(40, None), (41, ""), (42, "x"), (43, text(40_000)), (None, "no key"), (44, "same"), (44, "same")]
    rng.shuffle(rows)
    df = spark.createDataFrame([(k, t, "odd", 1, "first", 2) for k, t in rows], DOCS).repartition(partitions)
    got = {}
    for r in phrases.fingerprints(df).collect():
        got.setdefault(r["doc_id"], []).append(r)
    assert sum(map(len, got.values())) == len(rows)
    order = sorted(((k, t or "") for k, t in rows), key=lambda r: (r[0] is None, -(r[0] or 0)))
    for (key, own), (_, after) in zip(order, [*order[1:], order[0]]):
        cut = len(own) // 3
        edited = own[: len(own) - cut] + after[:cut]
        a, b, c = (phrases.fingerprint(x) for x in (own, edited, after))
        want = (len(own), hashlib.sha256(edited.encode()).hexdigest(), a, b, phrases.likeness(a, b), phrases.likeness(a, c))
        assert want in [tuple(r[1:]) for r in got[key]]


def test_lone_and_missing_documents(spark):
    (row,) = phrases.fingerprints(spark.createDataFrame([(1, "abcabc")], "doc_id bigint, text string")).collect()
    assert row["near_next"] == 1.0 and row["n_chars"] == 6 and row["edited_sha256"] == hashlib.sha256(b"abcaab").hexdigest()
    assert phrases.fingerprints(spark.createDataFrame([], "doc_id bigint, text string")).collect() == []
    assert phrases.likeness("", "") == 1.0 and phrases.likeness("", row["fingerprint"]) == 0.0
