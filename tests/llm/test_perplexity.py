import math
import re
import sys
from collections import Counter
from pathlib import Path

import numpy as np
import pytest

sys.path.insert(0, str(Path(__file__).parent))
from corpus import documents, frame  # noqa: E402

from thicket.llm import perplexity  # noqa: E402


def rules(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    hit = {j for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    failed = len(words) < 50 or 100 * len(hit) > 50 * len(words)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(hit), failed


def plain_model(counts, order):
    """Interpolated modified Kneser-Ney, by dictionaries."""
    levels = {order: dict(counts)}
    for n in range(order - 1, 0, -1):
        levels[n] = Counter(g[1:] for g in levels[n + 1])

    def discounts(c):
        n = [sum(v == k for v in c.values()) for k in (1, 2, 3, 4)]
        d = [0.0, 0.5, 1.0, 1.5]
        if n[0] and n[1]:
            y = n[0] / (n[0] + 2 * n[1])
            for k in (1, 2, 3):
                if n[k - 1]:
                    d[k] = min(max(k - (k + 1) * y * n[k] / n[k - 1], 0.0), float(k))
        return d

    steps = {n: discounts(c) for n, c in levels.items()}
    contexts = {n: {} for n in levels}
    for n, c in levels.items():
        for k, v in c.items():
            contexts[n].setdefault(k[:-1], []).append(v)

    def p(g):
        n = len(g)
        if n == 0:
            return 1 / 256
        d, after = steps[n], contexts[n].get(g[:-1])
        if not after:
            return p(g[1:])
        gamma = sum(d[min(v, 3)] for v in after) / sum(after)
        own = levels[n].get(g, 0)
        return (own - d[min(own, 3)] if own else 0) / sum(after) + gamma * p(g[1:])

    return p


def whole(texts, models, order):
    return perplexity.grams([(bytes(order - 1), t) for t in texts], models, order)


def padded_counts(texts, order):
    out = Counter()
    for t in texts:
        x = bytes(order - 1) + t
        for i in range(len(t)):
            out[x[i : i + order]] += 1
    return out


@pytest.mark.parametrize("order", [2, 3, 4])
def test_model(order):
    texts = [b"abracadabra abra", b"banana bandana", b"cab dab", b""]
    keys, _ = whole(texts, np.zeros(4, np.int64), order)
    found, count = np.unique(keys, return_counts=True)
    kn = perplexity.KneserNey(found, count, order)
    p = plain_model(padded_counts(texts, order), order)
    for t in (b"banana", b"xyz", b"cadabra", b"zab"):
        asked, _ = whole([t], np.zeros(1, np.int64), order)
        x = b"\0" * (order - 1) + t
        for i, u in enumerate(kn.units(asked).tolist()):
            assert abs(u * perplexity.UNIT - math.log(p(x[i : i + order]))) < 1e-3
    # probabilities after a context add up to 1
    every = np.array([(ord("a") << 8) | b for b in range(256)] if order == 2 else [], np.uint64)
    if len(every):
        assert abs(np.exp(kn.units(every) * perplexity.UNIT).sum() - 1) < 1e-2


def test_grams_keep_texts_apart():
    keys, at = whole([b"ab", b"", b"c"], np.array([1, 2, 3]), 3)
    assert at.tolist() == [0, 2, 2, 3]
    assert keys.tolist() == [1 << 40 | 0x61, 1 << 40 | 0x6162, 3 << 40 | 0x63]


def test_table():
    rng = np.random.default_rng(0)
    keys = np.unique(rng.integers(0, 1 << 50, 5000).astype(np.uint64))
    t = perplexity.Table(keys, np.arange(len(keys), dtype=np.int32))
    value, found = t.find(np.concatenate([keys, keys + np.uint64(1 << 60)]), -1)
    assert found[: len(keys)].all() and not found[len(keys) :].any() and (value[: len(keys)] == np.arange(len(keys))).all()
    assert not perplexity.Table(keys[:0], np.zeros(0, np.int32)).find(keys, 0)[1].any()


def test_rules(spark):
    rows = documents() + [(5000, "\n".join(["a b c d e"] * 30 + [" ", "x $% #", "x $% #"]), "en", None, 9), (5001, "the words " * 60, "en", None, 9)]
    got = {}
    for r in perplexity.judged(frame(spark, rows)).collect():
        got.setdefault(r.doc_id, []).append((r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed))
        assert not (r.base_failed and r.kept)
    want = {}
    for r in rows:
        want.setdefault(r[0], []).append(rules(r[1]))
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in want.items()}


def test_bands(spark):
    """Of a language's documents those of other letters are rejected, and the usual ones are not."""
    import random

    rng = random.Random(1)
    usual = lambda: " ".join(rng.choice(["the", "cat", "sat", "on", "mat", "dog", "ran", "far"]) + rng.choice("abcde") for _ in range(80))
    odd = " ".join("".join(rng.choice("QZXJ#@!0123456789") for _ in range(6)) for _ in range(80))
    rows = [(i, usual(), "en", None, 0) for i in range(60)] + [(99, odd, "en", None, 0)]
    kept = {r.doc_id: r.kept for r in perplexity.judged(frame(spark, rows)).collect()}
    assert not kept[99] and all(kept[i] for i in range(60))


def test_empty(spark):
    assert perplexity.judged(frame(spark, [])).collect() == []
    assert not perplexity.judged(frame(spark, [(1, None, None, None, None)])).first().kept


def test_parts(spark):
    """The model in parts gives what one model of all grams gives, however few parts are kept in memory."""
    docs = frame(spark, documents() + [(7000 + i, t, lang, None, 0) for i, (t, lang) in enumerate([("naïve café", "fr"), ("x" * 40, None), ("日本語の文", "ja")])])
    rows = [(r.text or "", r.lang) for r in docs.select("text", "lang").collect()]
    texts = [t.encode() for t, _ in rows]
    models = np.array([perplexity.language_code(x) | perplexity.half(t) for t, (_, x) in zip(texts, rows, strict=True)])
    keys, _ = whole(texts, models, 5)
    one = perplexity.KneserNey(*np.unique(keys, return_counts=True), 5)
    asked = np.concatenate([keys, whole([b"never seen before 0123"] * 2, models[:2], 5)[0], keys ^ np.uint64(1 << 40)])
    for held in (2_000_000, 1000, 0):
        kn = perplexity.model(docs, held=held)
        assert kn.order == 5 and (len(kn.held) < len(kn.parts)) == (held < 2_000_000)
        assert np.abs(kn.units(asked) - one.units(asked)).max() <= 5


def test_long_texts_in_pieces(monkeypatch):
    """A text cut into pieces counts and scores as a whole, whatever the size of pieces and rounds."""
    texts = [t.encode() for t in ("abcdefgh " * 30, "", "xy", "naïve " * 9, "a")]
    models = np.array([2, 4, 6, 8, 10])
    kn = perplexity.Parts("", 3, perplexity.KneserNey(*np.unique(whole(texts, models, 3)[0], return_counts=True), 3), 1, {})
    want, (keys, at) = perplexity._units(texts, models, kn), whole(texts, models, 3)
    units = kn.units(keys)
    assert want.tolist() == [units[a:b].sum() for a, b in zip(at, at[1:])]
    for size, step in ((1, 1), (7, 20), (50, 1)):
        monkeypatch.setattr(perplexity, "CHUNK_BYTES", size)
        monkeypatch.setattr(perplexity, "ROUND", step)
        assert perplexity._units(texts, models, kn).tolist() == want.tolist()
        got = np.concatenate([perplexity.grams(p, models[i], 3)[0] for i, p in perplexity.pieces_of(texts, 3)])
        assert got.tolist() == keys.tolist()


def test_judged_as_plain(spark):
    """Log perplexities, bands and verdicts against dictionary models of the other halves and sorted lists."""
    import random

    rng = random.Random(3)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 6))) for _ in range(60)]
    text = lambda k, own: " ".join(rng.choice(own) for _ in range(k))
    rows = [(i, text(rng.randint(50, 90), words), ["en", None][i % 3 == 0], None, 0) for i in range(40)]
    rows += [(100 + i, text(60, ["".join(rng.choice("QZ#@019") for _ in range(5)) for _ in range(60)]), "en", None, 0) for i in range(2)] + [(200, text(20, words), "en", None, 0), (300, None, "de", None, 0)]
    levels = {}
    for lang in {r[2] for r in rows}:
        texts = {r[0]: (r[1] or "").encode() for r in rows if r[2] == lang}
        p = [plain_model(padded_counts([t for t in texts.values() if perplexity.half(t) == h], 3), 3) for h in (0, 1)]
        for i, t in texts.items():
            x = bytes(2) + t
            n = rules(t.decode())[0]
            if n:
                levels[i] = -sum(math.log(p[1 - perplexity.half(t)](x[k : k + 3])) for k in range(len(t))) / n
    want = {}
    for lang in {r[2] for r in rows}:
        good = [levels[r[0]] for r in rows if r[2] == lang and r[1] and not rules(r[1])[5]]
        if good:
            q1, q3 = np.percentile(good, (25, 75))
            spread = max(q3 - q1, perplexity.LEAST_SPREAD)
            want[lang] = (q1 - perplexity.BELOW * spread, q3 + perplexity.ABOVE * spread)
    got = {r.doc_id: r for r in perplexity.judged(frame(spark, rows), order=3).collect()}
    for i, t, lang, *_ in rows:
        if i in levels:
            assert abs(got[i].log_perplexity - levels[i]) < 0.02
        if lang in want:
            assert abs(got[i].low - want[lang][0]) < 0.1 and abs(got[i].high - want[lang][1]) < 0.1
        inside = i in levels and lang in want and want[lang][0] <= levels[i] <= want[lang][1]
        assert got[i].kept == (not rules(t)[5] and inside)
    assert not got[100].kept and sum(r.kept for r in got.values()) >= 38
