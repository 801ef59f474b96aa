"""The models against plain versions: the corrected risk and its gradient, scores, expectation-maximisation."""

import math
import random
import unicodedata

import numpy as np
import pytest

from recordloom.llm import language_id, toxicity


def plain_risk(w, x, positive, prior, width):
    """The non-negative risk with logistic losses, and whether its unlabelled part is cut at zero."""
    f = np.array([w[-1] + sum(w[j] for j in row) for row in x])
    loss = lambda z: np.logaddexp(0, -z)
    p, u = f[positive], f[~positive]
    negative = loss(-u).mean() - prior * loss(-p).mean()
    return prior * loss(p).mean() + negative, negative


def test_first_step_follows_the_plain_gradient():
    """Adam's first step is the sign of the gradient; it must be that of the plain risk by finite differences, turned round
    where the unlabelled part is negative."""
    rng = np.random.default_rng(1)
    for prior, spread in ((0.1, 0.3), (0.5, 0.9)):
        width = 6
        positive = np.arange(40) < 15
        x = [np.flatnonzero(rng.random(width) < (spread if y else 0.2)) for y in positive]
        rows = toxicity.Rows(x, width)
        start = np.zeros(width + 1)
        start[-1] = np.log(prior / (1 - prior))
        risk, negative = plain_risk(start, x, positive, prior, width)
        slope = np.zeros(width + 1)
        for j in range(width + 1):
            up, down = start.copy(), start.copy()
            up[j] += 1e-5
            down[j] -= 1e-5
            a, b = plain_risk(up, x, positive, prior, width), plain_risk(down, x, positive, prior, width)
            slope[j] = (a[0] - b[0]) / 2e-5 if negative >= 0 else -(a[1] - b[1]) / 2e-5
        after = toxicity.nnpu(rows, positive, prior, width, steps=2, decay=0)  # the rate of the second step is zero
        clear = np.abs(slope) > 1e-4
        moved = after - start
        for j in np.flatnonzero(clear):
            if j == width or slope[j] < 0:  # weights can't go below zero
                assert np.sign(moved[j]) == -np.sign(slope[j])
            else:
                assert after[j] == 0


def test_fit_lowers_the_plain_risk():
    rng = np.random.default_rng(2)
    positive = np.arange(200) < 60
    hidden = positive | (rng.random(200) < 0.2)  # some of the unlabelled are positive
    x = [np.flatnonzero(np.concatenate([rng.random(3) < (0.8 if y else 0.05), rng.random(4) < 0.3])) for y in hidden]
    w = toxicity.nnpu(toxicity.Rows(x, 7), positive, 0.3, 7)
    start = np.zeros(8)
    start[-1] = np.log(0.3 / 0.7)
    assert plain_risk(w, x, positive, 0.3, 7)[0] < plain_risk(start, x, positive, 0.3, 7)[0]
    f = np.array([w[-1] + sum(w[j] for j in row) for row in x])
    assert f[hidden].mean() > f[~hidden].mean() + 1 and min(w[:3]) > max(w[3:7])


def test_cut_has_the_least_plain_risk():
    rng = np.random.default_rng(3)
    f = np.round(rng.normal(size=120), 2)
    positive = rng.random(120) < 0.4
    cut = toxicity.threshold(f, positive, 0.2)

    def risk(c):
        p, u = f[positive] >= c, f[~positive] >= c
        return 0.2 * (1 - p.mean()) + max(0, u.mean() - 0.2 * p.mean())

    assert risk(cut) == pytest.approx(min(risk(c) for c in f))


def test_scores_equal_a_plain_scorer():
    rng = random.Random(4)
    words = ["".join(rng.choices("abcdefg", k=rng.randint(2, 8))) for _ in range(200)]
    names = sorted({f for w in words[:60] for f in toxicity.word_features(w)})
    model = [("", [-1.0, 0.5, -0.25]), *((f, [rng.random() - 0.3 for _ in range(3)]) for f in rng.sample(names, 150))]
    weight = dict(model)
    scorer = toxicity.Scorer(model)
    for _ in range(50):
        text = " ".join(rng.choices(words, k=rng.randint(0, 30))) + rng.choice(["", "!", " 12", "\n"])
        seen = {w for w in "".join(c if c.isalpha() else " " for c in text.lower()).split()}
        sums = list(weight[""])
        for w in seen:
            marked = f"<{w}>"
            own = {f"={w}"} | {marked[i : i + n] for n in (4, 5) for i in range(len(marked) - n + 1)}
            for f in own:
                if f in weight:
                    sums = [a + b for a, b in zip(sums, weight[f])]
        assert scorer.score(text) == pytest.approx(sum(1 / (1 + math.exp(-s)) for s in sums) / 3)


def plain_words(text):
    """Runs of letters and marks that have a letter."""
    out, now = [], ""
    for c in text + " ":
        if unicodedata.category(c)[0] in "LM":
            now += c
        elif now:
            out += [now] if any(unicodedata.category(x)[0] == "L" for x in now) else []
            now = ""
    return out


def plain_mixture(like):
    """Language and share of one document, from log-likelihoods by word and language."""
    n, m = len(like), len(like[0])
    top = [max(row) for row in like]
    e = [[max(math.exp(v - t), 1e-30) for v in row] for row, t in zip(like, top)]

    def em(share, rounds):
        for _ in range(rounds):
            sums = [0.0] * m
            for row in e:
                total = sum(a * b for a, b in zip(row, share))
                for j in range(m):
                    sums[j] += row[j] * share[j] / total
            share = [s / n for s in sums]
        return share, sum(math.log(sum(a * b for a, b in zip(row, share))) for row in e)

    alone = [sum(row[j] for row in like) for j in range(m)]
    best = max(range(m), key=lambda j: alone[j])
    height, score, chosen = alone[best] - sum(top), 1.0, {best}
    full, _ = em([1 / m] * m, language_id.ROUNDS)
    while len(chosen) < m:
        more = chosen | {max((j for j in range(m) if j not in chosen), key=lambda j: full[j])}
        share = [full[j] + 0.01 if j in more else 0.0 for j in range(m)]
        share, now = em([s / sum(share) for s in share], language_id.ROUNDS // 2)
        if now - height <= language_id.PENALTY * math.log(n + 1):
            break
        chosen, height = more, now
        best = max(range(m), key=lambda j: share[j])
        score = share[best]
    return best, score


def test_mixture_equals_plain_expectation_maximisation():
    rng = np.random.default_rng(5)
    sizes = rng.integers(1, 40, 60)
    like = []
    for n in sizes:
        mix = rng.dirichlet([0.4, 0.4, 0.4])
        own = rng.choice(3, n, p=mix)
        like.append(-rng.uniform(20, 30, (n, 3)) + np.eye(3)[own] * rng.uniform(0, 12, (n, 1)))
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    best, score = language_id.mixture(np.concatenate(like), starts)
    for rows, b, s in zip(like, best, score):
        want = plain_mixture(rows.tolist())
        assert b == want[0] and s == pytest.approx(want[1], rel=1e-6)
    assert (score < 1).sum() > 10 and (score == 1).sum() > 10


def test_words_and_trigrams_equal_plain(texts):
    for text in (t or "" for t in texts):
        bucket, starts, owner = language_id.trigrams([text])
        words = plain_words(text.lower())
        assert len(starts) == len(words) and len(bucket) == sum(map(len, words))
        if words:
            alone = [language_id.trigrams([w])[0] for w in words]
            assert np.array_equal(np.concatenate(alone), bucket)


def test_identify_equals_plain(texts):
    langs, rng = ["aa", "bb", "cc"], np.random.default_rng(6)
    logs = np.log(rng.dirichlet(np.full(language_id.BUCKETS, 0.05), 3).T + 1e-9).astype(np.float32)
    found, scores = language_id.identify(texts, langs, logs)
    for text, lang, score in zip(texts, found, scores):
        words = plain_words((text or "").lower())
        if not words:
            assert (lang, score) == (language_id.UNKNOWN, 0.0)
            continue
        like = [logs[language_id.trigrams([w])[0]].astype(np.float32).sum(0).astype(float).tolist() for w in words]
        best, share = plain_mixture(like)
        assert lang == langs[best] and score == pytest.approx(share, abs=1e-3)
