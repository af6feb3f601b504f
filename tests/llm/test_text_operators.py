"""Packing, personal data, rules, language model and shards against brute-force versions."""

import collections
import hashlib
import math
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quernlog.llm import lm, packing, pii, rules, sstable, tokens

WORD = re.compile("[^\x20\x09-\x0d]+")


def encoder(name):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokens.tokenizer_path(name))
    t.encode_special_tokens = True
    return lambda text: t.encode(text, add_special_tokens=False).ids


ALPHABET = st.text(st.sampled_from("ab AZ.,'s!?-_0 19\n\t\r 　 é́ßİΣ中の<|endoftext|>$"), max_size=60)


@pytest.mark.parametrize(("name", "space_led"), [("byte_bpe_50k.json", True), ("word_bpe_49k.json", False)])
def test_ids_equal_those_of_the_whole_text(name, space_led):
    whole, mine = encoder(name), tokens.TextTokenizer(tokens.tokenizer_path(name), space_led, remembered=300)

    @settings(max_examples=300, deadline=None)
    @given(st.lists(ALPHABET, max_size=6))
    def check(texts):
        ids, offsets = mine.encode(pa.array(texts, pa.string()))
        assert [ids[a:b].tolist() for a, b in zip(offsets[:-1], offsets[1:], strict=True)] == [whole(t) for t in texts]

    check()


def test_a_tokenizer_remembers_what_the_caller_at_hand_allows():
    path = tokens.tokenizer_path("word_bpe_49k.json")
    for most in (200, 5_000, 300):
        assert tokens.text_tokenizer(path, space_led=False, remembered=most).remembered == most


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 300), min_size=1, max_size=80))
def test_packing_cuts_and_fills(lengths):
    pieces, n = packing.pack_lengths(np.array(lengths), 64, 1.0, 1 / 64)
    fill, parts = collections.defaultdict(list), collections.defaultdict(list)
    for d, start, length, s, at in pieces:
        assert 0 <= s < n and length > 0
        fill[s].append((at, length))
        parts[d].append((start, length))
    for rows, total in [*((v, None) for v in fill.values()), *((parts[d], x) for d, x in enumerate(lengths))]:
        end = 0
        for a, b in sorted(rows):
            assert a == end
            end += b
        assert end == total if total else end == 64 or end & (end - 1) == 0
    assert sum(64 - sum(x[1] for x in v) for v in fill.values() if (t := sum(x[1] for x in v)) & (t - 1)) == 0


def test_packing_balances_costs():
    rng = np.random.default_rng(0)
    lengths = rng.integers(1, 200, 2000)
    pieces, _ = packing.pack_lengths(lengths, 256, 1.0, 1 / 256)
    cost = collections.Counter()
    for _, _, n, s, _ in pieces:
        cost[s] += n + n * n / 256
    values = np.array([c for c in cost.values() if c > 200])
    assert values.std() / values.mean() < 0.1


def test_packing_query(edge, none, spark):
    whole = encoder("byte_bpe_50k.json")
    got = packing.pack_documents(edge, size=64).collect()
    want = collections.Counter()
    for r in edge.collect():
        want[r.doc_id, len(whole(r.text or "")) + 1] += 1
    whole_texts = collections.Counter((r.doc_id, r.doc_tokens) for r in got if r.start == 0)
    assert whole_texts == want
    for r in edge.where("doc_id = 3").collect():
        ids = np.array([*whole(r.text), 0], "<u4")
        for p in got:
            if p.doc_id == 3:
                assert p.ids_crc32 == zlib.crc32(ids[p.start : p.start + p.length].tobytes())
    assert packing.pack_documents(none).count() == 0


def base_spans(t):
    out = [(0, m.start(), m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [(1, m.start(), m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(p) <= 255 for p in m.group().split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        d = re.sub("[^0-9]", "", m.group())
        if 13 <= len(d) <= 19 and pii.luhn(d):
            out.append((2, m.start(), m.end()))
    out += [(3, m.start(), m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 9 <= len(re.sub("[^0-9]", "", m.group())) <= 15]
    return out


@settings(max_examples=500, deadline=None)
@given(st.text(st.sampled_from("0159 .-+@aB(é)%:/_"), max_size=50))
def test_anchors_find_what_patterns_find(text):
    assert [s for s in pii.spans_of(text, pii.anchors()) if s[0] < pii.BASE] == base_spans(text)


def test_pii_kinds_and_masks(docs_of, edge, none):
    text = "Mail jo.e+x@mail.example.com or call +1 (407) 555-7710, host 10.0.0.255 not 10.0.0.256; card 4539 1488 0343 6467; see https://example.org/a?b=1. IBAN: GB82 WEST 1234 5698 7654 32, token = \"deadbeef42\" at 12 High Street"
    row = pii.find_pii(docs_of([text])).first()
    assert (row.n_email, row.n_ip, row.n_card, row.n_phone) == (1, 1, 1, 1)
    assert {s.split(":")[0] for s in row.spans.split(",")} == set(pii.KINDS)
    assert row.base_sha256 == hashlib.sha256(pii.spans_text(base_spans(text)).encode()).hexdigest()
    masked = pii.mask_pii(docs_of([text, None, ""])).orderBy("doc_id").collect()
    assert "[EMAIL]" in masked[0].text and "4539" not in masked[0].text and "deadbeef42" not in masked[0].text and masked[0].n_chars == len(masked[0].text)
    assert masked[1].text is None and masked[2].text == ""
    assert pii.find_pii(edge).count() == edge.count() and pii.find_pii(none).count() == 0
    assert pii.mask_pii(edge).columns == edge.columns
    clean = "The year 1998 had 365 days, 24 hours each; version 3.0.1 cost $5."
    assert pii.mask_pii(docs_of([clean])).first().text == clean


@pytest.mark.parametrize(
    ("text", "account"),
    [
        ("IBAN: DE89 3704 0044 0532 0130 00 BIC: COBADEFFXXX", "DE89 3704 0044 0532 0130 00"), ("IBAN: DE89 3704 0044 0532 0130 00 Please pay", "DE89 3704 0044 0532 0130 00"), ("IBAN GB82 WEST 1234 5698 7654 32 2024", "GB82 WEST 1234 5698 7654 32"),
        ("IBAN: DE89370400440532013000 BIC", "DE89370400440532013000"), ("IBAN: NO93 8601 1117 947 DUE NOW", "NO93 8601 1117 947"), ("token=" + "a1" * 48 + " end", "a1" * 48),
    ],
)
def test_accounts_are_found_whole(text, account):
    assert [text[a:b] for k, a, b in pii.spans_of(text, pii.anchors()) if pii.KINDS[k] == "account"] == [account]
    assert account not in pii.masked(text, pii.spans_of(text, pii.anchors())) and "[ACCOUNT]" in pii.masked(text, pii.spans_of(text, pii.anchors()))


def rule_counts(t):
    w = WORD.findall(t)
    seen, windows, covered, dup = set(), collections.Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4)), set(), 0
    for i in range(len(w) - 4):
        if windows[tuple(w[i : i + 5])] > 1:
            covered |= set(range(i, i + 5))
    for line in t.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), dup, len(covered)


def test_rules(docs_of, edge, none, prose):
    texts = [*prose, "a b c d e a b c d e x", "p q r s t u v w x y\np q r s t u v w x y\n \n", "x x x x x x x x x x", "### $$$ |||" * 9, "ABC DEF " * 60 + "ghi", "tab\there\x0bthere"]
    got = {r.doc_id: r for r in rules.apply_rules(docs_of(texts)).collect()}
    for i, t in enumerate(texts):
        r, want = got[i], rule_counts(t)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (want[0] < 10 or 100 * want[4] > 20 * want[0]) and not (r.base_failed and r.kept)
    assert rules.apply_rules(edge).count() == edge.count() and rules.apply_rules(none).count() == 0
    odd = docs_of([*(f"plain words number {i} of the text and so on for a while until it is long enough to count for something here" for i in "abcdefghijklmnop"), "SHOUTED JUNK NUMBER ONE WITH ENOUGH WORDS TO COUNT FOR SOMETHING HERE AND THERE AND ELSEWHERE!! YES INDEED SO IT IS FOR THE WHOLE LENGTH OF THIS VERY LOUD LINE"])
    assert [r.doc_id for r in rules.apply_rules(odd).where("not kept and not base_failed").collect()] == [16]


def test_rules_reject_by_common_words_alone_and_hold_rare_languages_against_all(docs_of, monkeypatch):
    monkeypatch.setattr(rules, "LEAST_REFERENCE", 1000)
    english = lambda i: " ".join(["the cat of", f"n{i}", "and a dog to see that", f"w{i}", "is in it for us with", f"v{i}", "them"] * 8)
    german = lambda i: " ".join(["der hund und", f"n{i}", "die katze von dem haus ist", f"w{i}", "nicht mit das", f"v{i}", "zu den"] * 8)
    junk = " ".join(f"brelt{c}{d}ing quonder{d}{c}" for c in "abcdefghij" for d in "klmnop")
    texts = [*map(english, range(30)), *map(german, range(30)), german(99), junk, junk + " !!", english(5)]
    langs = ["en"] * 30 + ["de"] * 30 + ["en", "en", "xx", "yy"]
    monkeypatch.setattr(rules, "MOST_CLASS", 2.0)  # common words alone
    got = {r.doc_id: r for r in rules.apply_rules(docs_of([t.replace("  ", " ") + f" t{i}" for i, t in enumerate(texts)], langs=langs)).collect()}
    odd = {i for i, r in got.items() if r.n_words >= rules.LEAST_WORDS and r.common_distance > rules.MOST_COMMON}
    assert {60, 61} <= odd and not odd & set(range(60))
    assert got[62].common_distance > 0.2 and abs(got[62].common_distance - got[63].common_distance) > 0.05  # not held against itself


def test_language_model(spark, docs_of, edge, none, prose):
    texts = [*prose, None, "", "unseen zzz"]
    got = {r.doc_id: r for r in lm.score_texts(docs_of(texts)).collect()}
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    words = [[*WORD.findall((t or "").translate(low)), None] for t in texts]
    held = [zlib.crc32(str(i).encode()) % 7 == 2 for i in range(len(texts))]
    c = collections.Counter(w for ws, h in zip(words, held, strict=True) if not h for w in ws)
    n, v = sum(c.values()), len(c)
    for i, ws in enumerate(words):
        r = got[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[i], len(ws), sum(c[w] > 0 for w in ws), n)
        assert math.isclose(r.base_score, sum(math.log10((c[w] + 1) / (n + v + 1)) for w in ws), abs_tol=1e-6)
        assert math.isfinite(r.score) and r.score < 0
    repeated = lm.score_texts(edge).collect()
    assert len(repeated) == edge.count() and lm.score_texts(none).count() == 0
    assert len({(r.base_score, r.score) for r in repeated if r.doc_id == 10}) == 1


def test_windows_score_each_id_once():
    for n in (1, 2, 31, 32, 33, 56, 57, 80, 200):
        ids = np.arange(n)
        x, y, _, scored = lm.windows(ids, np.array([0, n]))
        assert sorted(y[scored]) == list(range(n))
        assert all(a == lm.START and b == 0 or a == b - 1 for a, b in zip(x[scored], y[scored], strict=True))


def test_attention_is_causal_normalised_and_has_right_gradients():
    rng = np.random.default_rng(0)
    parts = rng.dirichlet(np.ones(50), lm.PARTS)
    m = lm.Attention(rng.normal(size=(50, lm.WIDTH)), parts, rng)
    for k, w in m.p.items():
        m.p[k] = w.astype(np.float64)
    m.parts, m.mask = m.parts.astype(np.float64), m.mask.astype(np.float64)
    x = rng.integers(0, 50, (3, 32))
    total = sum(10 ** m.log10(x, np.full_like(x, t)) for t in range(50))
    assert np.allclose(total, 1, atol=1e-5)
    some = np.array([0, 5, 33, 95])
    assert np.allclose(m.log10(x, x, some), m.log10(x, x)[some])
    later = x.copy()
    later[:, 20:] = 7
    assert np.allclose(m.forward(x)[-1][:, :20], m.forward(later)[-1][:, :20])
    y = rng.integers(0, 50, (3, 32))
    loss = lambda: -m.log10(x, y).mean() * math.log(10)
    grads = m.step(x, y)
    for name in ("q", "k", "v", "w", "o", "bias", "pos"):
        at = tuple(rng.integers(0, s) for s in m.p[name].shape)
        old = m.p[name][at]
        m.p[name][at] = old + 1e-5
        up = loss()
        m.p[name][at] = old - 1e-5
        down = loss()
        m.p[name][at] = old
        assert math.isclose((up - down) / 2e-5, grads[name][at], rel_tol=1e-3, abs_tol=1e-7)


def test_spelling_is_a_distribution():
    rng = np.random.default_rng(3)
    ends = rng.random(lm.VOCABULARY) < 0.5
    ends[lm.START] = True
    x, y = rng.integers(0, 300, (40, 32)), rng.integers(0, 300, (40, 32))
    scored = rng.random((40, 32)) < 0.8
    spelling = lm.Spelling(*lm.spelling_keys(x, y, scored, ends), ends)
    every = np.arange(lm.VOCABULARY)
    for last in (lm.START, int(np.flatnonzero(~ends[:300])[0]), int(np.flatnonzero(ends)[0])):
        assert math.isclose(spelling.share(np.full(lm.VOCABULARY, last), every).sum(), 1, rel_tol=1e-6)
    last, after = int(np.flatnonzero(~ends[:300])[3]), 17
    own = scored & (x == last)
    go_on = ((y[scored & ~ends[x]] == after).sum() + 0.1) / ((scored & ~ends[x]).sum() + 0.1 * lm.VOCABULARY)
    assert math.isclose(spelling.share(np.array([last]), np.array([after]))[0], ((own & (y == after)).sum() + lm.SPELLING_WEIGHT * go_on) / (own.sum() + lm.SPELLING_WEIGHT), rel_tol=1e-6)


def test_scores_equal_a_direct_computation(docs_of, prose, monkeypatch):
    """Window by window, place by place, with ``forward``; the pairs that Spark counts are all that there are."""
    models, scorer = [], lm._scorer
    monkeypatch.setattr(lm, "_scorer", lambda model, *a: models.append(model) or scorer(model, *a))
    got = {r.doc_id: r.score for r in lm.score_texts(docs_of(prose)).collect()}
    m, whole = models[0], encoder("word_bpe_49k.json")
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    pairs = collections.Counter()
    for i, t in enumerate(prose):
        ids = [*whole(t.translate(low)), lm.END]
        last = [lm.START, *ids[:-1]]
        if zlib.crc32(str(i).encode()) % 7 != 2:
            pairs.update((a, b) for a, b in zip(last, ids, strict=True) if not m.spelling.ends[a])
        if i >= 12:
            continue
        total, done, step = 0.0, 0, lm.WINDOW - lm.OVERLAP
        while done < len(ids):
            first = 0 if done == 0 else done - lm.OVERLAP
            window = np.array([last[first : first + lm.WINDOW]])
            weights = m.forward(window)[-1][0]
            for k in range(done - first, window.shape[1]):
                total += math.log10(float(weights[k] @ m.shares(window[0, k : k + 1], np.array([ids[first + k]]))[0]))
            done = first + window.shape[1]
        assert step > 0 and math.isclose(got[i], total, rel_tol=1e-4)
    assert len(m.spelling.keys) - 1 == len(pairs) and m.spelling.counts.sum() == sum(pairs.values())


def test_model_beats_subword_shares():
    rng = np.random.default_rng(1)
    follow = rng.permutation(200)
    texts = []
    for _ in range(300):
        t = [int(rng.integers(0, 200))]
        for _ in range(40):
            t.append(int(follow[t[-1]]) if rng.random() < 0.8 else int(rng.integers(0, 200)))
        texts.append(np.array([*t, lm.END]))
    ids, offsets = np.concatenate(texts), np.cumsum([0, *map(len, texts)])
    counts = np.bincount(ids, minlength=lm.VOCABULARY).astype(float)
    m = lm.train_model(ids, offsets, counts)
    x, y, _, scored = lm.windows(ids, offsets)
    assert m.log10(x, y)[scored.ravel()].mean() > np.log10((counts + 0.1) / (counts.sum() + 0.1 * lm.VOCABULARY))[y[scored]].mean() + 0.1


def test_model_counts_all_training_texts(docs_of, prose, monkeypatch):
    models, scorer = [], lm._scorer
    monkeypatch.setattr(lm, "FIT_IDS", 100)
    monkeypatch.setattr(lm, "_scorer", lambda model, *a: models.append(model) or scorer(model, *a))
    assert lm.score_texts(docs_of(prose)).count() == len(prose)
    whole = encoder("word_bpe_49k.json")
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    train = [t for i, t in enumerate(prose) if zlib.crc32(str(i).encode()) % 7 != 2]
    n = sum(len(whole(t.translate(low))) + 1 for t in train)
    # An id that never occurs has 200 base shares in a cluster of n_k ids, which tells n_k.
    never = models[0].parts[lm.START].astype(float)
    assert math.isclose((200 * 0.1 / (n + 0.1 * lm.VOCABULARY) / never - 200).sum(), n, rel_tol=1e-3)


@pytest.mark.parametrize(("ids", "least", "most"), [(1000, 5, 300), (0, 100, 100)])
def test_model_learns_from_windows_of_few_long_texts(docs_of, monkeypatch, ids, least, most):
    trained = []
    monkeypatch.setattr(lm, "FIT_IDS", ids)
    monkeypatch.setattr(lm, "FIT_SHARE", 0.0, raising=False)
    monkeypatch.setattr(lm, "POOL", 100, raising=False)
    monkeypatch.setattr(lm.Attention, "train", lambda self, pools, windows, *a: trained.append((windows, sum(len(x) for x, _ in pools))))
    assert lm.score_texts(docs_of([" ".join(f"w{i % 997}" for i in range(20_000))])).count() == 1
    assert len(trained) == 1 and trained[0][0] == trained[0][1] and least <= trained[0][0] <= most


def test_spelling_finds_every_count():
    rng = np.random.default_rng(9)
    keys = np.unique(rng.integers(0, lm.VOCABULARY**2, 5000))
    counts = rng.integers(1, 100, len(keys))
    spelling = lm.Spelling(keys, counts, np.zeros(lm.VOCABULARY, bool))
    known = dict(zip(keys[keys // lm.VOCABULARY != lm.START].tolist(), counts[keys // lm.VOCABULARY != lm.START].tolist(), strict=True))
    asked = np.concatenate([keys, rng.integers(0, lm.VOCABULARY**2, 5000)])
    assert spelling.count(asked).tolist() == [known.get(k, 0) for k in asked.tolist()]


def test_model_does_nothing_twice(monkeypatch):
    """Spelling is asked once for each distinct pair, later windows work out no overlap, and few windows at once give what all give."""
    rng = np.random.default_rng(4)
    ends = np.ones(lm.VOCABULARY, bool)
    ends[:40] = False
    x, y = rng.integers(0, 60, (70, 32)), rng.integers(0, 60, (70, 32))
    scored = rng.random((70, 32)) < 0.8
    spelling = lm.Spelling(*lm.spelling_keys(x, y, scored, ends), ends)
    asked, count = [], lm.Spelling.count
    monkeypatch.setattr(lm.Spelling, "count", lambda self, keys: asked.extend(keys.tolist()) or count(self, keys))
    shares = spelling.share(x.ravel(), y.ravel())
    assert len(asked) == len(set(asked)) == len({(a, b) for a, b in zip(x.ravel().tolist(), y.ravel().tolist(), strict=True) if a < 40})
    assert shares.tolist() == [spelling.share(np.array([a]), np.array([b]))[0] for a, b in zip(x.ravel(), y.ravel(), strict=True)]
    m = lm.Attention(rng.normal(size=(lm.VOCABULARY, lm.WIDTH)), rng.dirichlet(np.ones(lm.VOCABULARY), lm.PARTS), rng, spelling)
    whole = m.log10(x, y).reshape(x.shape)
    assert np.allclose(m.log10(x, y, None, lm.OVERLAP, m.spelt(x, y)).reshape(70, -1), whole[:, lm.OVERLAP :], atol=1e-5)
    late = np.flatnonzero(scored[:, lm.OVERLAP :])
    for some in (late, late[::5]):
        assert np.allclose(m.log10(x, y, some, lm.OVERLAP), whole[:, lm.OVERLAP :].ravel()[some], atol=1e-5)
    monkeypatch.setattr(lm, "TOGETHER", 70)
    once = m.step(x, y, scored)
    monkeypatch.setattr(lm, "TOGETHER", 16)
    assert all(np.allclose(g, once[name], atol=1e-6) for name, g in m.step(x, y, scored, m.spelt(x, y)).items())


def test_pairs_are_counted_in_one_pass(prose, monkeypatch):
    """All counts come from one pass over the ids, whose rows together hold every pair."""
    ids = [np.array([*encoder("word_bpe_49k.json")(t), lm.END]) for t in prose]
    batches = pa.table({"ids": pa.array([i.astype("<u2").tobytes() for i in ids], pa.binary())}).to_batches(max_chunksize=50)
    direct = collections.Counter((a, b) for i in ids for a, b in zip([lm.START, *i[:-1].tolist()], i.tolist(), strict=True))
    for held in (1, 10**6):
        monkeypatch.setattr(lm, "PAIRS_HELD", held)
        rows = list(lm._pair_rows(lm._paired(iter(batches))))
        assert (len(rows) > 1) == (held == 1 and len(batches) > 1)
        got = collections.Counter()
        for keys, n in rows:
            got.update({(int(k) // lm.VOCABULARY, int(k) % lm.VOCABULARY): int(c) for k, c in zip(keys, n, strict=True)})
        assert got == direct
        assert all(len(k.as_py()) == 4 * len(keys) and len(c.as_py()) <= 2 * len(keys) for (keys, _), b in zip(rows, lm._paired(iter(batches)), strict=True) for k, c in zip(b.column("k"), b.column("n"), strict=True))
    keys, n = rows[0]
    assert lm._totals(lm.follow_counts(keys, n))[lm.START] == len(ids)
    cluster = np.arange(lm.VOCABULARY) % lm.PARTS
    parts = lm.part_counts(keys, n, cluster).reshape(lm.VOCABULARY, lm.PARTS)
    assert parts.sum() == sum(map(len, ids)) and parts[lm.END, 3] == sum(c for (a, b), c in direct.items() if b == lm.END and a % lm.PARTS == 3)


def test_weights_are_fitted_to_all_training_texts(spark, prose, monkeypatch):
    """Each id is a target once in the pass that gives the weights, whatever the sample; the mean counts each task by its ids."""
    ids = [np.array([*encoder("word_bpe_49k.json")(t), lm.END]) for t in prose]
    rows = [(i, i, x.astype("<u2").tobytes()) for i, x in enumerate(ids)]
    texts = spark.createDataFrame(rows, "doc_id long, key long, ids binary").repartition(3)
    monkeypatch.setattr(lm, "FIT_IDS", 100)
    refined, passes = lm.refined, []
    monkeypatch.setattr(lm, "refined", lambda texts, model, seed: passes.append((dict(model.p), refined(texts, model, seed))) or passes[0][1])
    model = lm.fitted(texts, lm.word_ends(tokens.tokenizer_path("word_bpe_49k.json")))
    start, (weights, learned) = passes[0]
    assert learned == sum(map(len, ids)) and all((model.p[n] == weights[n]).all() for n in weights)
    x, y, _, scored = lm.windows(np.concatenate(ids), np.concatenate([[0], np.cumsum([len(i) for i in ids])]))
    after = model.log10(x, y)[scored.ravel()].mean()
    model.p = start
    assert after > model.log10(x, y)[scored.ravel()].mean()


def test_shards(spark, tmp_path, edge, none, docs_of, prose):
    whole = encoder("word_bpe_49k.json")
    docs = edge.unionByName(docs_of(prose, [1000 - 3 * i for i in range(len(prose))]))
    path = f"file://{tmp_path}/shards"
    sstable.write_shards(docs, path, shard_bytes=200_000)
    rows = sorted(docs.collect(), key=lambda r: (r.doc_id is not None, r.doc_id or 0))
    ids = [np.array([*whole(r.text or ""), 2], "<u4") for r in rows]
    starts = np.cumsum([0, *map(len, ids)])
    got = sstable.digest_shards(spark, path).orderBy("start").collect()
    assert [(r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in got] == [(r.doc_id, int(s), len(i), zlib.crc32(i.tobytes())) for r, s, i in zip(rows, starts, ids, strict=False)]
    assert len({r.shard for r in got}) > 1
    back = sstable.read_shards(spark, path).orderBy("shard", "place").collect()
    assert [r.doc_id for r in back] == [r.doc_id for r in rows] and all(r.ids == i.tolist() for r, i in zip(back, ids, strict=True))
    found = sstable.lookup(spark, path, [10, 997, -5, None, 3]).collect()
    assert collections.Counter(r.doc_id for r in found) == collections.Counter([10, 10, 997, None, 3])
    ranges = sstable.key_ranges(spark, path)
    near = sstable.lookup(spark, path, [10, 997, -5, None, 3], ranges)
    assert sorted((r.doc_id is not None, r.doc_id or 0, r.ids) for r in near.collect()) == sorted((r.doc_id is not None, r.doc_id or 0, r.ids) for r in found)
    assert len(sstable.lookup(spark, path, [997], ranges).inputFiles()) == 1 < ranges.count()
    assert sstable.lookup(spark, path, [10**12], ranges).count() == 0 and sstable.lookup(spark, path, [], ranges).count() == 0
    sstable.write_shards(none, f"{path}0")
    assert sstable.digest_shards(spark, f"{path}0").count() == 0 and sstable.key_ranges(spark, f"{path}0").count() == 0


def test_shard_search_and_damage():
    w = sstable.ShardWriter(2)
    parts = [p for i in range(-50, 5000, 3) if (p := w.add(sstable.key_bytes(i), b"ab" * (i % 40 + 1), i % 40 + 1)) is not None]
    raw = b"".join(p + b"\n" for p in [*parts, *w.close()])
    r = sstable.ShardReader(raw)
    assert len(r.index) > 1
    for i in range(-60, 5010):
        assert [n for _, n in r.find(sstable.key_bytes(i))] == ([i % 40 + 1] if -50 <= i < 5000 and (i + 50) % 3 == 0 else [])
    keys = [sstable.key_bytes(i) for i in range(-50, 5000, 3)]
    assert r.may_hold(keys).all() and r.may_hold([sstable.key_bytes(i) for i in range(10**6, 10**6 + 3000)]).mean() < 0.05
    with pytest.raises(ValueError):
        sstable.ShardReader(raw[:-200] + bytes(200))
