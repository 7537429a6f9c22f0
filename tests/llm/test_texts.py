"""Phrases, context-tree scores and fill-in-middle against brute force, and their defined cases."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from dayrunner.llm import collocations, contexts, fim


def by_id(df):
    return {r["doc_id"]: r for r in df.collect()}


# --- phrases --------------------------------------------------------------------

def phrases_of(rows, least, cover, top):
    """The contract, written out over Python strings."""
    counts, totals = Counter(), Counter()
    for text, lang in rows:
        text, lang = (text or "").translate({c: c + 32 for c in range(65, 91)}), lang or "und"
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", text):
            words = re.findall(r"[^\x20\x09]+", piece)
            totals[lang] += len(words)
            counts.update((lang, tuple(words[i:i + k])) for k in range(1, 6) for i in range(len(words) - k + 1))
    counts = {k: n for k, n in counts.items() if n >= least}
    out = []
    for (lang, words), a in counts.items():
        k = len(words)
        if k == 1 or any(
            other == lang and len(longer) > k and 100 * n >= cover * a and any(longer[i:i + k] == words for i in range(len(longer) - k + 1))
            for (other, longer), n in counts.items()
        ):
            continue
        n = totals[lang]
        score, _, left, right = min(
            (1000 * a * n // (counts[lang, words[:c]] * counts[lang, words[c:]]), c, counts[lang, words[:c]], counts[lang, words[c:]]) for c in range(1, k))
        out.append((lang, " ".join(words), a, left, right, n, score))
    ranked = []
    for lang in {r[0] for r in out}:
        mine = sorted((r for r in out if r[0] == lang), key=lambda r: (-r[6], -r[2], r[1].encode()))
        ranked += [(lang, i, *r[1:]) for i, r in enumerate(mine[:top], 1)]
    return sorted(ranked)


def phrase_texts(seed, n):
    random = np.random.default_rng(seed)
    words = ["a", "B", "cé", "of", "the", "New", "york", "city", "x" * 40, "\x01"]
    glue = [" ", "  ", "\t", " \t ", ". ", ",", "\n", "\r\n", " ; ", "!"]
    out = []
    for i in range(n):
        text = "".join(
            (["New York City hall", "the  of the"][random.integers(2)] if random.random() < 0.3 else words[random.integers(len(words))])
            + glue[min(9, int(random.exponential(1.5)))] for _ in range(random.integers(0, 60)))
        out.append((i, text, ["en", "de", None][random.integers(3)], "s"))
    return out


@pytest.mark.parametrize("window", [1 << 20, 64])
@pytest.mark.parametrize(("least", "cover", "top"), [(5, 100, 2000), (20, 80, 10)])
def test_phrases_equal_brute_force(spark, docs_of, monkeypatch, window, least, cover, top):
    monkeypatch.setattr(collocations, "WINDOW_BYTES", window)
    texts = phrase_texts(least, 120)
    got = collocations.mine(docs_of(texts), least=least, cover_percent=cover, top=top)
    assert sorted(map(tuple, got.collect())) == phrases_of([(t, lang) for _, t, lang, _ in texts], least, cover, top)


def test_phrases_are_told_apart_if_all_fingerprints_meet(docs_of, monkeypatch):
    """Fingerprints only screen: with nearly all of them equal the result is the same."""
    monkeypatch.setattr(collocations, "mixed", lambda v: v % np.uint64(3))
    texts = phrase_texts(1, 60)
    got = collocations.mine(docs_of(texts), least=5)
    assert sorted(map(tuple, got.collect())) == phrases_of([(t, lang) for _, t, lang, _ in texts], 5, 100, 2000)


def test_windows_cover_every_phrase_start_once():
    raw = collocations.plain(["one two  three\tfour five. six seven", "eight, nine ten eleven"] * 20)
    for size in (1, 7, 30):
        collocations.WINDOW_BYTES, kept = size, collocations.WINDOW_BYTES
        try:
            found = [w[words.starts[i]:words.ends[i + 2]] for w, own in collocations.windows(raw, 5)
                     for words in [collocations.Words(w, own, 0)] for i in words.candidates(3, 3, None)]
        finally:
            collocations.WINDOW_BYTES = kept
        want = [b" ".join(p.split()[i:i + 3]) for p in raw.split(b"\n") for i in range(len(p.split()) - 2)]
        assert found == want


def test_phrases_defined_cases(odd, none):
    got = collocations.mine(odd, least=2, top=5).collect()
    assert {r["lang"] for r in got} == {"de", "en"}
    en = [r for r in got if r["lang"] == "en"]
    assert [r["rank"] for r in en] == list(range(1, len(en) + 1))
    assert any(r["phrase"].startswith("many words") and r["a"] > 19_000 for r in en)
    assert collocations.mine(none).collect() == []
    assert collocations.mine(odd, least=10**6).collect() == []


# --- context trees ----------------------------------------------------------------

def log_kt(zeros, ones):
    p, n = 0.0, [0, 0]
    for bit in [0] * zeros + [1] * ones:
        p += math.log((n[bit] + 0.5) / (sum(n) + 1))
        n[bit] += 1
    return p


def log_weighted(seen, context, depth, most):
    """Log probability that the tree below a context gives the bits seen: (bytes before, nearest first; bit)."""
    own = log_kt(sum(1 for _, b in seen if b == 0), sum(b for _, b in seen))
    if depth == most:
        return own
    below = sum(log_weighted([s for s in seen if s[0][depth] == c], context + (c,), depth + 1, most) for c in {s[0][depth] for s in seen})
    return math.log(0.5) + float(np.logaddexp(own, below))


def events(text, depth):
    """All (bytes before, byte) of a text and its end."""
    data = [255] * depth + list(text.lower().encode()) + [255]
    return [(tuple(data[i - k] for k in range(1, depth + 1)), data[i]) for i in range(depth, len(data))]


def brute_score(texts, text, depth):
    total = 0.0
    trained = [e for t in texts for e in events(t, depth)]
    for before, byte in events(text, depth):
        for bit in range(8):
            prefix = byte >> (8 - bit)
            seen = [(b, x >> (7 - bit) & 1) for b, x in trained if x >> (8 - bit) == prefix]
            total += log_weighted([*seen, (before, byte >> (7 - bit) & 1)], (), 0, depth) - log_weighted(seen, (), 0, depth)
    return total / math.log(10)


def taught(i):
    return i is not None and zlib.crc32(str(i).encode()) % 7 != 2


@pytest.mark.parametrize("depth", [2, 3, 4])
def test_scores_equal_context_trees_written_out(docs_of, depth, monkeypatch):
    monkeypatch.setattr(contexts, "BLOCK_BYTES", 12)
    monkeypatch.setattr(contexts, "PART_BYTES", 5)
    monkeypatch.setattr(contexts, "SOLVED_ROWS", 7)
    texts = ["abcab", "", "Abñ c", "zz", "ab ab", "abc", "q"] * 2
    got = by_id(contexts.score(docs_of([(i, t, "en", "s") for i, t in enumerate(texts)]), depth=depth))
    learned = [t for i, t in enumerate(texts) if taught(i)]
    assert 0 < len(learned) < len(texts)
    for i, t in enumerate(texts[:7]):
        assert got[i]["score"] == pytest.approx(brute_score(learned, t, depth), abs=1e-8)
        assert got[i]["held_out"] is not taught(i)


def test_byte_probabilities_add_up_to_one(spark):
    random = np.random.default_rng(3)
    depth = 3
    before = random.integers(97, 100, (40, depth))
    counts = Counter((*map(int, before[k]), int(x)) for k in random.integers(0, 40, 500) for x in random.integers(97, 110, 1))
    rows = [(sum(b << 8 * (depth - i) for i, b in enumerate((*c, x))), counts.get((*c, x), 0)) for c in {k[:depth] for k in counts} for x in range(256)]
    logs = contexts.probabilities(spark.createDataFrame(rows, "pair long, n long"), depth).collect()
    sums = Counter()
    for r in logs:
        sums[r["pair"] >> 8] += 10 ** r["log_p"]
    assert len(sums) > 20 and all(v == pytest.approx(1, abs=1e-9) for v in sums.values())


def test_base_scores_and_counts(docs_of, monkeypatch):
    monkeypatch.setattr(contexts, "BLOCK_BYTES", 200)
    monkeypatch.setattr(contexts, "PART_TEXTS", 3)
    random = np.random.default_rng(5)
    texts = [" ".join(f"W{k}" for k in random.zipf(1.5, random.integers(0, 30)) % 50) + "\x0b" for _ in range(60)]
    got = by_id(contexts.score(docs_of([(i, t, "en", "s") for i, t in enumerate(texts)])))
    tokens = {i: [*re.findall(r"[^\x20\x09-\x0D]+", t.lower()), None] for i, t in enumerate(texts)}
    counts = Counter(w for i, ws in tokens.items() if taught(i) for w in ws)
    n, v = sum(counts.values()), len(counts)
    for i, ws in tokens.items():
        assert (got[i]["n_tokens"], got[i]["n_known"], got[i]["train_tokens"]) == (len(ws), sum(counts[w] > 0 for w in ws), n)
        assert got[i]["base_score"] == pytest.approx(sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in ws), abs=1e-9)


def test_held_out_prose_is_cheaper_than_noise(docs_of):
    random = np.random.default_rng(7)
    words = ["".join(random.choice(list("aeiourstln"), 5)) for _ in range(40)]
    prose = [(i, " ".join(random.choice(words, 80)), "en", "s") for i in range(80)]
    noise = [(i, "".join(chr(c) for c in random.integers(33, 126, 480)), "en", "s") for i in range(1000, 1030)]
    got = by_id(contexts.score(docs_of(prose + noise)))
    held = [r for i, r in got.items() if i < 1000 and r["held_out"]]
    assert held and all(r["bits_per_byte"] < 1.8 for r in held)
    assert all(r["score"] > r["base_score"] * 1.2 for r in held)
    unseen = [r for i, r in got.items() if i >= 1000 and r["held_out"]]
    assert unseen and all(r["bits_per_byte"] > 4 for r in unseen)


def test_context_tree_defined_cases(odd, none, docs_of):
    rows = contexts.score(odd).collect()
    assert len(rows) == odd.count()
    assert all(math.isfinite(r["score"]) and r["score"] < 0 and r["base_score"] <= 0 for r in rows)
    assert all(r["held_out"] for r in rows if r["doc_id"] is None)
    assert {r["n_tokens"] for r in rows if r["doc_id"] in (2, 3, 4)} == {1}
    assert len({r["score"] for r in rows if r["doc_id"] in (2, 3)}) == 1
    assert contexts.score(none).collect() == []
    alone = contexts.score(docs_of([(None, "ab", "en", "s")])).collect()[0]
    assert (alone["train_tokens"], alone["n_known"], alone["base_score"]) == (0, 0, 0.0)
    assert alone["score"] == pytest.approx(3 * 8 * math.log10(0.5))


# --- fill in the middle -------------------------------------------------------------

@pytest.mark.parametrize("offsets", [
    [0], [0, 1, 2, 3, 9], list(range(0, 9000)), list(range(0, 200_000, 3)), [0, 65_535, 65_536, 131_072, 400_000],
    [*range(70_000, 75_000), *range(80_000, 140_000, 2)],
])
def test_boundary_set_selects(offsets):
    held = fim.BoundarySet(np.array(offsets, np.int64))
    assert len(held) == len(offsets)
    for k in {*range(0, len(offsets), max(1, len(offsets) // 500)), len(offsets) - 1}:
        assert held.select(k) == offsets[k]


def test_boundary_set_has_every_kind_of_container():
    held = fim.BoundarySet(np.array([*range(0, 60_000, 5), *range(70_000, 71_000), *range(140_000, 141_000, 7)], np.int64))
    assert [type(c) for c in held.containers] == [fim.BitmapContainer, fim.RunContainer, fim.ArrayContainer]


def filled_by_hand(i, text):
    text = text or ""
    tokens = re.findall(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+", text)
    h = hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[k:k + 8], 16) for k in (0, 8, 16, 24))
    n = len(tokens)
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 50:
        return n, "plain", None, None, text
    low, high = sorted((h1 % (n + 1), h2 % (n + 1)))
    a, b, c = "".join(tokens[:low]), "".join(tokens[low:high]), "".join(tokens[high:])
    if h4 % 100 < 80:
        return n, "spm", len(a), len(b), f"<S>{c}<P>{a}<M>{b}"
    return n, "psm", len(a), len(b), f"<P>{a}<S>{c}<M>{b}"


def test_fill_in_middle_equals_regular_expression(docs_of):
    random = np.random.default_rng(11)
    signs = list("ab🙂ñ \t\n\x0b\x0c\r\x1c\x85　") + ["<", "<P", "S>", "<M>", "M", ">"]
    texts = [(i, "".join(random.choice(signs, random.integers(0, 60))), "en", "s") for i in range(400)]
    texts += [(1000 + i, "<" * i + " a <S" + " <" * i, "en", "s") for i in range(40)]
    made = fim.fill_in_middle(docs_of(texts))
    got, back = by_id(made), by_id(fim.restore(made))
    for i, text, *_ in texts:
        assert tuple(got[i])[1:] == filled_by_hand(i, text)
        assert back[i]["text"] == text
    assert {r["form"] for r in got.values()} == {"plain", "psm", "spm"}


def test_fill_in_middle_defined_cases(odd, none):
    made = fim.fill_in_middle(odd)
    rows = made.collect()
    texts = Counter((r["doc_id"], r["text"] or "") for r in odd.collect())
    assert Counter((r["doc_id"], r["text"]) for r in fim.restore(made).collect()) == texts
    assert Counter(tuple(r)[1:] for r in rows) == Counter(filled_by_hand(r["doc_id"], r["text"]) for r in odd.collect())
    assert fim.fill_in_middle(none).collect() == [] and fim.digests(fim.fill_in_middle(none)).collect() == []
    every = fim.fill_in_middle(odd, seed=7, fim_percent=100, spm_percent=0)
    assert {r["form"] for r in every.collect() if r["output"]} == {"psm"}
    for markers in (("<P>", "<P>", "<M>"), ("<P>", "S>", "<M>"), ("<P", "<<S", "<M")):
        with pytest.raises(ValueError):
            fim.fill_in_middle(odd, markers=markers)
