"""Each operator against brute force on small tables, and its defined cases."""

from __future__ import annotations

import hashlib
import re
import textwrap
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

import corpus_pipeline
from dayrunner.llm import (
    bpe,
    components,
    exact_dedup,
    fuse,
    langid,
    licenses,
    minhash,
    mixing,
    partitions,
    pii,
    quality,
    spans,
)

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()


def prose(seed: int, n: int) -> list[str]:
    random = np.random.default_rng(seed)
    return [WORDS[k] + str(random.integers(40)) for k in random.integers(0, len(WORDS), n)]


def by_id(df, key="doc_id"):
    return {r[key]: r for r in df.collect()}


# --- filters and exact dedup -------------------------------------------------

@pytest.mark.parametrize("n", [0, 1, 2, 7, 100, 5000])
def test_fuse_filter_holds_its_keys_and_little_else(n):
    random = np.random.default_rng(n)
    keys = random.integers(0, 2**63, n).astype(np.uint64)
    built = fuse.build(keys)
    assert fuse.contains(keys, *built).all()
    others = random.integers(0, 2**63, 20_000).astype(np.uint64)
    assert fuse.contains(others, *built).mean() < 0.02


def test_exact_dedup_groups_across_and_within_batches(docs_of):
    texts = ["a  b", "a b", "c", "a\tb", "c ", "d", "a b", "e", "d", "f", "c"]
    docs = docs_of([(i, t, "en", "s") for i, t in enumerate(texts)])
    groups: dict[str, list[int]] = {}
    for i, t in enumerate(texts):
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", t), []).append(i)
    want = {i: (g[0], len(g), i == g[0], hashlib.sha256(norm.encode()).hexdigest()) for norm, g in groups.items() for i in g}
    got = {i: tuple(r)[1:] for i, r in by_id(exact_dedup.exact_dedup(docs)).items()}
    assert got == want
    kept = exact_dedup.keep_first(docs)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(g[0] for g in groups.values())


def test_exact_dedup_defined_cases(odd, none):
    rows = exact_dedup.exact_dedup(odd).collect()
    assert len(rows) == 11  # the repeated document is one
    assert sum(r["kept"] for r in rows) == exact_dedup.keep_first(odd).count() == 9
    empty = [r for r in rows if r["text_sha256"] == hashlib.sha256(b"").hexdigest()]
    assert {r["doc_id"] for r in empty} == {2, 3, None} and {r["keep_id"] for r in empty} == {2}
    assert exact_dedup.exact_dedup(none).count() == 0 and exact_dedup.keep_first(none).count() == 0


# --- components and near dedup -------------------------------------------------

@pytest.mark.parametrize("seed", [0, 1, 2])
def test_components_equal_union_find(spark, seed):
    random = np.random.default_rng(seed)
    edges = [(int(a), int(b)) for a, b in random.integers(0, 60, (45, 2))]
    edges += [(k, k + 1) for k in range(100, 140)] + [(200, k) for k in range(201, 230)]
    parent = {n: n for e in edges for n in e}

    def root(n):
        while parent[n] != n:
            n = parent[n]
        return n

    for a, b in edges:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    linked = {n for a, b in edges if a != b for n in (a, b)}
    got = {r["node"]: r["component"] for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {n: root(n) for n in linked}


def shingles(text, k):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    return {tuple(words[i:i + k]) for i in range(len(words) - k + 1)} or ({tuple(words)} if words else set())


@pytest.mark.parametrize("k", [2, 5])
def test_near_dedup_equals_all_pairs(docs_of, k):
    random = np.random.default_rng(5)
    texts = []
    for group in range(6):
        base = prose(group, 60)
        for _ in range(9):
            words = list(base)
            for at in random.integers(0, 60, random.integers(0, 7)):
                words[at] = f"new{random.integers(1000)}"
            texts.append(" ".join(words))
    texts += ["", "  ", "one", "ONE", "two words", "Two  Words", " ".join(prose(77, 30))]
    sets = [shingles(t, k) for t in texts]
    parent = list(range(len(texts)))

    def root(n):
        while parent[n] != n:
            n = parent[n]
        return n

    for a in range(len(texts)):
        for b in range(a):
            if sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    docs = docs_of([(i, t, "en", "s") for i, t in enumerate(texts)])
    got = by_id(minhash.near_dedup(docs, words=k))
    assert {i: (r["n_shingles"], r["component_id"], r["kept"]) for i, r in got.items()} == {
        i: (len(sets[i]), root(i), root(i) == i) for i in range(len(texts))}
    kept = minhash.keep_first(docs, words=k)
    assert kept.columns == docs.columns and kept.count() == len({root(i) for i in range(len(texts))})


def test_near_dedup_defined_cases(odd, none):
    rows = minhash.near_dedup(odd, words=2).collect()
    assert len(rows) == 12 and all(r["kept"] for r in rows)
    assert {r["doc_id"]: r["n_shingles"] for r in rows if r["doc_id"] in (2, 3, 4)} == {2: 0, 3: 0, 4: 0}
    assert minhash.near_dedup(none).count() == 0


# --- BPE -------------------------------------------------------------------------

@pytest.fixture(scope="module")
def coders():
    ranks = bpe.read_ranks(public_tokenizers.path(bpe.VOCABULARY))
    return bpe.Codec(ranks, public_tokenizers.PATTERN), tiktoken.Encoding(
        "own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_bpe_equals_the_library(coders):
    own, theirs = coders
    random = np.random.default_rng(4)
    letters = list("ab Z9é\n\t  ,.'s\x1c\x85 　日🙂ñ-")
    texts = ["".join(random.choice(letters, random.integers(0, 40))) for _ in range(3000)]
    texts += ["", " ", "ab" * 5000, "x" + " " * 900, "<|endoftext|>", "thnterble " * 300, "é" * 65, "q" * 64, "0" * 5000]
    assert own.encode_all(texts) == [theirs.encode_ordinary(t) for t in texts]
    assert all(own.merged(t.encode()) == own._merged_rows([t.encode()], 64)[0] for t in texts if 1 < len(t.encode()) <= 64)
    assert [own.decode(theirs.encode_ordinary(t)).decode() for t in texts] == texts


def test_bpe_over_documents(odd, none, coders):
    encoded = bpe.encode(odd)
    texts = sorted((r["doc_id"] or 0, r["text"] or "") for r in odd.collect())
    assert sorted((r["doc_id"] or 0, coders[0].decode(r["ids"]).decode()) for r in encoded.collect()) == texts
    assert sorted((r["doc_id"] or 0, r["text"]) for r in bpe.decode(encoded).collect()) == texts
    trip = [r for r in bpe.round_trip(odd).collect() if r["doc_id"] == 9][0]
    ids = coders[1].encode_ordinary("日本語 🙂 ñ")
    assert trip["n_tokens"] == len(ids)
    assert trip["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
    assert trip["decoded_sha256"] == hashlib.sha256("日本語 🙂 ñ".encode()).hexdigest()
    assert bpe.encode(none).count() == 0


# --- language and quality ---------------------------------------------------------

def labelled(docs_of):
    random = np.random.default_rng(2)
    parts = {"aa": ["thaw", "ing", "the", "sh"], "bb": ["éau", "que", "oui", "ç"], "cc": ["sch", "ung", "ß", "ein"]}
    rows = []
    for i in range(360):
        lang = list(parts)[i % 3]
        rows.append((i, " ".join("".join(random.choice(parts[lang], 3)) for _ in range(60)), lang, "s"))
    return docs_of(rows)


def test_language_is_told_on_held_out_documents(docs_of):
    docs = labelled(docs_of)
    network = langid.learn(docs)
    got = by_id(langid.predict(docs, network))
    held = [i for i, r in got.items() if r["held_out"]]
    assert 0 < len(held) < 180 and all(0 <= r["score"] <= 1 for r in got.values())
    assert np.mean([got[i]["lang_pred"] == ("aa", "bb", "cc")[i % 3] for i in held]) > 0.95


def test_language_defined_cases(docs_of, odd, none):
    network = langid.learn(labelled(docs_of))
    rows = langid.predict(odd, network).collect()
    assert len(rows) == 12
    assert {r["doc_id"] for r in rows if r["lang_pred"] == "und"} == {None, 2, 3, 4, 5, 8}
    assert sum(r["lang_pred"] == "und" for r in rows) == 6
    assert langid.learn(none) is None and langid.predict(none, None).count() == 0
    assert {r["lang_pred"] for r in langid.predict(odd, None).collect()} == {"und"}
    assert langid.keep_identified(odd).columns == odd.columns


def test_quality_is_told_on_held_out_documents(spark, docs_of):
    random = np.random.default_rng(1)
    rows, marks = [], []
    for i in range(600):
        words = prose(i, 80)
        good = i % 3 != 0
        rows.append((i, " ".join(words) if good else " ".join([w.upper() + random.choice(["!!", "***"]) for w in words]), "en", "s"))
        marks.append((i, int(good), 0))
    docs, labels = docs_of(rows), spark.createDataFrame(marks, "doc_id long, quality int, toxic int")
    got = by_id(quality.score(docs, quality.learn(docs, labels)))
    held = [i for i, r in got.items() if r["held_out"]]
    assert np.mean([got[i]["predicted"] == int(i % 3 != 0) for i in held]) > 0.97


def test_quality_defined_cases(spark, odd, none):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    rows = quality.score(odd, quality.learn(odd, labels)).collect()
    assert len(rows) == 12 and {r["score"] for r in rows} == {0.5}
    few = spark.createDataFrame([(i, i % 2, 0) for i in (1, 3, 6, 7)] + [(None, 1, 0), (9, None, 0)], "doc_id long, quality int, toxic int")
    assert all(0 <= r["score"] <= 1 for r in quality.score(odd, quality.learn(odd, few)).collect())
    assert quality.score(none, quality.learn(none, labels)).count() == 0


# --- mixing -------------------------------------------------------------------------

def test_mixing_meets_the_margins_and_the_portion(docs_of):
    random = np.random.default_rng(3)
    docs = docs_of([(i, "word " * int(random.integers(1, 60)), str(random.choice(["en", "de"], p=[0.8, 0.2])),
                     str(random.choice(["a", "b", "c"], p=[0.7, 0.2, 0.1]))) for i in range(3000)])
    rows = mixing.mix(docs).collect()
    total = sum(r["n_tokens"] for r in rows)
    expected = sum(r["n_tokens"] * r["probability"] for r in rows)
    assert abs(expected / total - mixing.PORTION) < 1e-6
    shares = Counter()
    for r in rows:
        shares[r["source"]] += r["n_tokens"]
    raised = {s: n**mixing.FLATTEN for s, n in shares.items()}
    if max(r["probability"] for r in rows) < 1:
        for s in shares:
            have = sum(r["n_tokens"] * r["probability"] for r in rows if r["source"] == s) / expected
            assert abs(have - raised[s] / sum(raised.values())) < 1e-3
    assert abs(sum(r["kept"] for r in rows) - sum(r["probability"] for r in rows)) < 150
    kept = mixing.keep_sampled(docs)
    assert kept.columns == docs.columns
    assert {r["doc_id"] for r in kept.collect()} == {r["doc_id"] for r in rows if r["kept"]}


def test_mixing_defined_cases(odd, none):
    rows = mixing.mix(odd).collect()
    assert len(rows) == 12 and all(0 <= r["probability"] <= 1 for r in rows)
    assert mixing.mix(none).count() == 0 and mixing.keep_sampled(none).count() == 0


# --- nearest neighbours -------------------------------------------------------------

def test_search_reaches_the_recall_and_exact_scores(spark):
    random = np.random.default_rng(8)
    centres = random.normal(size=(30, 16))
    vectors = np.concatenate([centres[random.integers(0, 30, 2500)] + 0.2 * random.normal(size=(2500, 16)),
                              np.tile(centres[0], (800, 1))]).astype(np.float32)
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "vec_id long, embedding array<float>")
    got: dict[int, list] = {}
    for r in partitions.search(rows).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    full, found = vectors.astype(float), []
    assert sorted(got) == list(range(0, 3300, 100))
    for q, near in got.items():
        d = np.sqrt(((full - full[q])**2).sum(axis=1))
        d[q] = np.inf
        order = np.lexsort((np.arange(len(d)), d))[:10]
        assert [r for r, *_ in near] == list(range(1, 11))
        assert all(abs(s - d[v]) < 1e-12 for _, v, s in near)
        found.append(len({v for _, v, _ in near} & set(order.tolist())) / 10)
    assert np.mean(found) >= 0.9


def test_search_defined_cases(spark):
    nan, inf = float("nan"), float("inf")
    odd = [(0, [1.0, 0.0]), (0, [1.0, 0.5]), (1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, None), (4, [nan, 1.0]), (5, [inf, 1.0]), (6, [None, 1.0]),
           (7, [1.0, 2.0, 3.0]), (None, [1.0, 1.0]), (100, [0.5, 0.5]), (8, [1.0, 0.0]), (9, [])]
    rows = spark.createDataFrame(odd, "vec_id long, embedding array<float>")
    got = [tuple(r)[:3] for r in partitions.search(rows).orderBy("query_id", "rank").collect()]
    assert got[:3] == [(0, 1, 1), (0, 2, 8), (0, 3, 100)] and {g[0] for g in got} == {0, 100}
    assert [g[2] for g in got if g[0] == 100] == [0, 0, 1, 8] or len([g for g in got if g[0] == 100]) == 4
    assert partitions.search(rows.limit(0)).count() == 0


# --- personal data ---------------------------------------------------------------------

BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def base_names(text):
    out = []
    for kind, pattern in BASE.items():
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m.group())
            luhn = sum(d if k % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d) for k, d in enumerate(map(int, reversed(digits)))) % 10 == 0
            if {"email": True, "ip": all(int(p[:4000]) <= 255 for p in m.group().split(".")) if kind == "ip" else True,
                    "card": 16 <= len(digits) <= 19 and luhn, "phone": 8 <= len(digits) <= 15}[kind]:
                out.append(f"{kind}:{m.start()}:{m.end()}")
    return out


def test_personal_data_base_spans_equal_brute_force(docs_of, odd):
    random = np.random.default_rng(9)
    letters = list("ab1234567890@.+-() _é🙂")
    texts = ["".join(random.choice(letters, random.integers(0, 60))) for _ in range(400)] + [
        "a@b.c_d@e.fg 1.2.3.4.5.6.7.8", "4111 1111 1111 1111, 4111-1111-1111-1111 4111111111111111", "x@y@z.w foo@bar.baz@qux.com",
        "é+1 (446) 555-8962 +12345678 +1 2-3 4 5 6 7 8(9)", "256.1.1.1 0001.2.3.4 1.2.3.400", "a" * 20_000 + "@b.c", "1.2.3." * 3000]
    docs = docs_of([(i, t, "en", "s") for i, t in enumerate(texts)])
    got = by_id(pii.digests(pii.find(docs)))
    for i, text in enumerate(texts):
        names = base_names(text)
        assert got[i]["base_sha256"] == hashlib.sha256(",".join(names).encode()).hexdigest(), text[:80]
        assert [got[i][f"n_{k}"] for k in BASE] == [sum(n.startswith(k) for n in names) for k in BASE]
    assert pii.digests(pii.find(odd)).count() == 12


def test_personal_data_addresses_with_zero_parts(docs_of):
    random = np.random.default_rng(10)
    texts = ["10.0.0.1", "0.0.0.0", "127.0.0.1", "1.2.3.00", "000256.1.1.1", "000255.1.1.1", "1.0.0.256", "1.2.3.0000", "8.8.8.8", "1..0.0.1"]
    texts += [".".join("".join(random.choice(list("00125"), random.integers(1, 5))) for _ in range(4)) for _ in range(200)]
    got = by_id(pii.digests(pii.find(docs_of([(i, f"host {t} up", "en", "s") for i, t in enumerate(texts)]))))
    for i, text in enumerate(texts):
        names = base_names(f"host {text} up")
        assert got[i]["base_sha256"] == hashlib.sha256(",".join(names).encode()).hexdigest(), text
        assert got[i]["n_ip"] == len(names)
    assert [got[i]["n_ip"] for i in range(10)] == [1, 1, 1, 1, 0, 1, 0, 1, 1, 0]


def test_personal_data_contexts_find_what_patterns_miss(docs_of, none):
    known = [(i, f"text here contact: user{i}@mail.example.com and more", "en", "s") for i in range(30)]
    unseen = [(100, "text here contact: user_at_mail99 and more", "en", "s"), (101, "the code user_at_mail99 again", "en", "s"),
              (102, "the number 20240101 is none", "en", "s")]
    got = by_id(pii.digests(pii.find(docs_of(known + unseen))))
    assert got[100]["spans"] == "email:19:33" and got[101]["spans"] == "email:9:23" and got[102]["spans"] == ""
    assert all(got[i]["n_email"] == 1 and got[i]["n_added"] == 0 for i in range(30))
    key = "0123456789abcdef" * 2
    assert by_id(pii.digests(pii.find(docs_of([(1, f"token {key}", "en", "s")]))))[1]["spans"] == "key:6:38"
    assert pii.find(none).count() == 0


def test_personal_data_of_a_text_with_100_000_identifiers(docs_of):
    words = [f"user{i}@mail.example.com" if i % 3 else f"10.{i % 256}.0.{i // 256 % 256}" for i in range(100_000)]
    names, at = {"email": [], "ip": []}, 0
    for i, word in enumerate(words):
        kind = "email" if i % 3 else "ip"
        names[kind].append(f"{kind}:{at}:{at + len(word)}")
        at += len(word) + 1
    got = by_id(pii.digests(pii.find(docs_of([(1, " ".join(words), "en", "s")]))))[1]
    assert (got["n_email"], got["n_ip"], got["n_card"], got["n_phone"]) == (66_666, 33_334, 0, 0)
    assert got["base_sha256"] == hashlib.sha256(",".join(names["email"] + names["ip"]).encode()).hexdigest()


@pytest.mark.parametrize("n", [0, 1, 31, 32, 33, 1024, 1025, 40_000])
def test_running_sums_of_any_length(spark, n):
    numbers = [k * 7 % 13 for k in range(n)]
    row = spark.createDataFrame([(numbers,)], "a array<int>").select(pii._running_sum(F.col("a")).alias("s")).first()
    assert row["s"] == list(np.cumsum(numbers))


def test_personal_data_contexts_find_malformed_phones_and_cards(docs_of):
    known = [(i, f"please phone: +49 30 555 {1000 + i} soon", "en", "s") for i in range(20)]
    known += [(100 + i, f"paid by card: {card} today", "en", "s") for i, card in enumerate(
        f"{k}{check}" for k in range(400000000000000, 400000000000020) for check in range(10) if base_names(f"{k}{check}"))]
    unseen = [(500, "please phone: 030-555-77 soon", "en", "s"), (501, "paid by card: 4000000000000003 today", "en", "s"),
              (502, "the order 4000000000000003 came", "en", "s"), (503, "part 777-888-99 is none", "en", "s")]
    got = by_id(pii.digests(pii.find(docs_of(known + unseen))))
    assert got[500]["spans"] == "phone:14:24" and got[500]["n_phone"] == 0
    assert got[501]["spans"] == "card:14:30" and got[502]["spans"] == "card:10:26" and got[501]["n_card"] == 0
    assert got[503]["spans"] == "" and got[0]["n_phone"] == 1 and got[100]["n_card"] == 1


# --- spans -----------------------------------------------------------------------------

def test_repeated_passages_go_but_for_the_first(docs_of):
    passage = ". ".join(" ".join(prose(k, 12)).capitalize() for k in range(900, 906)) + "."
    long_one = " ".join(prose(950, 70))
    texts = [f"{' '.join(prose(i, 30))}.\n{passage}\n{' '.join(prose(i + 500, 30))}." for i in range(4)]
    texts += [f"{' '.join(prose(i, 15))} {long_one} {' '.join(prose(i + 500, 15))}" for i in range(20, 23)]
    texts += [" ".join(prose(i, 120)) + "." for i in range(30, 40)] + [f"{passage} {passage}"]
    docs = docs_of([(i, t, "en", "s") for i, t in enumerate(texts)])
    got = by_id(spans.dedup_spans(docs))
    first = {}
    for i, text in enumerate(texts):
        found = spans.sentences(text)
        gone = set()
        for at, size, *_ in spans.runs(found, spans.LEAST_WORDS):
            key = tuple(" ".join(w) for *_, w in found[at:at + size])
            if first.setdefault(key, (i, at)) != (i, at):
                gone.update(range(at, at + size))
        assert got[i]["n_removed"] == len(gone)
        assert got[i]["removed_words"] == sum(len(found[k][2]) for k in gone)
    assert got[0]["text"] == texts[0] and got[0]["n_repeated"] > 0
    assert all(passage not in got[i]["text"] and got[i]["removed_words"] >= 60 for i in (1, 2, 3))
    assert all(got[i]["removed_words"] >= 40 for i in (5, 6)) and got[4]["text"] == texts[4]
    assert all(got[i]["text"] == texts[i] for i in range(7, 17))


def test_every_unpunctuated_passage_of_51_words_holds_a_common_run():
    def keys(words):
        return {(h1, h2) for *_, h1, h2 in spans.runs(spans.sentences(" ".join(words)), spans.LEAST_WORDS)}

    for k in range(1000):
        passage, around = prose(10_000 + k, 51), prose(20_000 + k, 120)
        assert keys(around[:30] + passage + around[30:60]) & keys(around[60:60 + k % 20] + passage + around[90:]), k
        passage[k % 49 + 1] += "."
        assert keys(around[:30] + passage + around[30:60]) & keys(around[60:60 + k % 20] + passage + around[90:]), k


def test_repeated_passages_of_scripts_without_spaces_go(docs_of):
    random = np.random.default_rng(12)

    def signs(low, high, n, stop=""):
        return "".join(chr(c) for c in random.integers(low, high, n)) + stop

    chinese = "".join(signs(0x4E00, 0x9FA5, 25, "\u3002") for _ in range(8))
    unbroken = signs(0x4E00, 0x9FA5, 102)
    thai = signs(0x0E01, 0x0E2F, 204)
    hindi = "".join(" ".join(signs(0x0915, 0x0939, 4) for _ in range(9)) + "\u0964" for _ in range(6))
    texts = [signs(0x4E00, 0x9FA5, 40) + p + signs(0x4E00, 0x9FA5, 40) for p in (chinese, unbroken, thai, hindi) for _ in range(3)]
    short = signs(0x4E00, 0x9FA5, 30)
    texts += [signs(0x4E00, 0x9FA5, 40) + short + signs(0x4E00, 0x9FA5, 40) for _ in range(2)]
    got = by_id(spans.dedup_spans(docs_of([(i, t, "zh", "s") for i, t in enumerate(texts)])))
    for i, text in enumerate(texts):
        if i % 3 == 0 or i >= 12:
            assert got[i]["text"] == text and got[i]["n_removed"] == 0
        else:
            assert got[i]["removed_words"] >= spans.LEAST_WORDS and len(got[i]["text"]) <= len(text) - 40
    assert all(chinese[30:-30] not in got[i]["text"] and got[i]["removed_words"] >= 90 for i in (1, 2))


def test_spans_defined_cases(odd, none):
    rows = spans.dedup_spans(odd).collect()
    assert len(rows) == 12
    assert sorted((r["doc_id"] or 0, r["text"]) for r in rows if r["doc_id"] != 6) == sorted(
        (r["doc_id"] or 0, r["text"] or "") for r in odd.collect() if r["doc_id"] != 6)
    assert spans.dedup_spans(none).count() == 0


# --- licences -----------------------------------------------------------------------------

def test_licences_are_named_and_others_left(docs_of, none):
    notices = {"mit": "Released under the MIT License.", "cc-by-nc": "Licensed under CC BY-NC 4.0.", "proprietary": "All rights reserved.",
               "gpl": "This work is licensed under the GNU General Public License, version 3.", "apache": "Licensed under the Apache License, Version 2.0."}
    rows = [(i, f"{' '.join(prose(i, 30))}.\n{n} {' '.join(prose(i + 50, 9))}.", "en", "s") for i, n in enumerate(notices.values())]
    rows += [(100 + i, f"This text is under review by {w}. The rights of {w} were discussed, all of them.", "en", "s") for i, w in enumerate(WORDS)]
    rows += [(200, None, "en", "s"), (201, "", "en", "s"), (None, "MIT License", "en", "s"), (0, rows[0][1], "en", "s")]
    got = licenses.scan(docs_of(rows)).collect()
    assert len(got) == len(rows)
    named = {r["doc_id"]: [s["family"] for s in r["licences"]] for r in got}
    assert [named[i] for i in range(5)] == [[f] for f in notices]
    assert all(not named[i] for i in named if i is not None and i >= 100)
    assert licenses.scan(none).count() == 0


def test_wrapped_notices_are_named_once(docs_of):
    bsd, mit = licenses.TEMPLATES["bsd"][0], licenses.TEMPLATES["mit"][2]
    rows, wanted = [], []
    for family, text in (("bsd", bsd), ("mit", mit)):
        for width, mark in ((70, ""), (55, " * "), (40, "# "), (20, "// "), (12, "")):
            lines = textwrap.wrap(text, width)
            rows.append((len(rows), "\n".join([" ".join(prose(len(rows), 9)) + ".", *[mark + x for x in lines], " ".join(prose(len(rows) + 50, 9))]), "en", "s"))
            wanted.append([family])
    rows += [(100 + i, "\n".join(" ".join(prose(i + 300 + k, 9)) for k in range(9)), "en", "s") for i in range(20)]
    got = by_id(licenses.scan(docs_of(rows)))
    assert [[s["family"] for s in got[i]["licences"]] for i in range(len(wanted))] == wanted
    assert all(got[i]["n_unknown"] == 0 for i in range(len(wanted)))
    assert all(not got[100 + i]["licences"] for i in range(20))


@pytest.mark.parametrize("counts", [{}, {"license": 9, "the": 5, "of": 5, "software": 2}])
def test_every_confirmable_window_has_an_anchor(counts):
    for _, text, held in licenses.anchors_by_template(counts):
        words = sorted(set(licenses.words_of(text)), key=lambda w: (w in held, w))
        least = int(np.ceil(licenses.CONFIRMED * len(words) - 1e-9))
        assert set(words[:least]) & set(held), text


def test_windows_equal_a_scan_of_all_positions(spark, docs_of):
    """Every window of every template's length, over numbered words, without anchors."""
    random = np.random.default_rng(21)
    texts = [(f, t) for f, held in licenses.TEMPLATES.items() for t in held]
    rows = []
    for i in range(60):
        parts = []
        for _ in range(random.integers(1, 4)):
            words = texts[random.integers(len(texts))][1].split()
            keep = [w for w in words if random.random() < random.choice([0.5, 0.75, 1.0])]
            parts += [*prose(int(random.integers(10_000)), int(random.integers(0, 12))), *keep]
        rows.append((i, "".join(w + random.choice([" ", "\n", "\n * ", ". ", "\n\n"], p=[0.7, 0.1, 0.1, 0.05, 0.05]) for w in parts), "en", "s"))
    got = licenses.confirmed(docs_of(rows)).collect()
    found = {(r["doc_id"], r["family"]) for r in got}
    want = set()
    for i, text, *_ in rows:
        words = licenses.words_of(text)
        for family, template in texts:
            held, long = set(licenses.words_of(template)), len(licenses.words_of(template))
            if any(len(held & set(words[p:p + long])) >= licenses.CONFIRMED * len(held) - 1e-9 for p in range(len(words))):
                want.add((i, family))
    assert found == want and len(want) > 40


def test_wide_and_long_notices_are_found(docs_of):
    """200 comment lines without words inside a notice, and paragraphs of thousands of signs around it."""
    lines = textwrap.wrap(licenses.TEMPLATES["isc"][0], 60)
    spaced = "\n".join([lines[0], *["# "] * 200, *lines[1:]])
    long = " ".join(prose(1, 900)) + " " + licenses.TEMPLATES["bsd"][0] + " " + " ".join(prose(2, 900))
    far = " ".join(prose(3, 40_000)) + "\nReleased under the MIT License. " + " ".join(prose(4, 20_000))
    got = by_id(licenses.scan(docs_of([(0, spaced, "en", "s"), (1, long, "en", "s"), (2, far, "en", "s"), (3, "under the software license " * 3_000, "en", "s")])))
    assert [[s["family"] for s in got[i]["licences"]] for i in range(3)] == [["isc"], ["bsd"], ["mit"]]
    assert got[3]["licences"] == []


def test_families_that_share_their_wording_are_told_apart(docs_of):
    wanted, rows = [], []
    for family in ("gpl", "lgpl", "agpl", "cc-by", "cc-by-sa", "cc-by-nc", "isc", "mit", "bsd", "epl"):
        for text in licenses.TEMPLATES[family][:1]:
            wanted.append(family)
            rows.append((len(rows), " ".join(prose(len(rows), 40)) + ".\n" + text + "\n" + " ".join(prose(len(rows) + 99, 40)), "en", "s"))
    got = by_id(licenses.scan(docs_of(rows)))
    assert [[s["family"] for s in got[i]["licences"]] for i in range(len(rows))] == [[f] for f in wanted]


def test_licences_defined_cases(odd):
    got = licenses.scan(odd).collect()
    assert len(got) == odd.count() and all(r["licences"] == [] for r in got)
    assert {r["n_paragraphs"] for r in got if r["doc_id"] in (2, 3, 4)} == {0}


def test_styles_drop_runs_of_characters_at_once(spark):
    """One match a run, not a character: texts of the sizes here made garbage that filled an executor."""
    texts = ["", "plain words", "A" * 10 + "b" * 29, "A" * 10 + "b" * 30, "12" + "é" * 37, "12" + "é" * 38, "*|" + "x" * 47, "*|" + "x" * 48, "😀\n\t*A9"]
    found = spark.createDataFrame([(t,) for t in texts], "text string").select(mixing.style(F.col("text")).alias("style"))
    assert "[^A-Z]++" in found._jdf.queryExecution().optimizedPlan().toString()
    def count(letters, t):
        return len(re.findall(f"[{letters}]", t))
    assert [r.style for r in found.collect()] == [
        "empty" if not t else "symbols" if count("*#$%&|!", t) * 25 > len(t) else "capitals" if count("A-Z", t) * 4 > len(t)
        else "figures" if count("0-9", t) * 20 > len(t) else "prose" for t in texts]
