"""The two classifiers' training rules, step by step in plain numpy."""
import numpy as np
import pyarrow as pa


def test_pu_steps_follow_the_clipped_risk():
    from ledgerscope.llm import hashed, op7_toxicity as o
    draw = np.random.default_rng(1)
    used = np.array([5, 9, 77, 1000, 4242])
    text = lambda p: used[draw.random(5) < p]
    rows = [(k, 1, text([.9, .8, .3, .3, .2])) for k in range(12)] + [(k, 0, text([.5, .3, .5, .4, .4])) for k in range(30)]
    prior, rate, batch, epochs = 0.6, 0.5, 10, 6
    weights, bias = o.fit(rows, prior, epochs=epochs, rate=rate, l1=1e-3, batch=batch, least_texts=1)

    x = np.array([[1.0 * (u in r[2]) for u in used] + [1.0] for r in rows])
    pos, unl = x[:12], x[12:]
    loss = lambda m, w, sign: np.logaddexp(0, -sign * (m @ w)).mean()
    w, n, against = np.r_[np.zeros(5), np.log(prior / (1 - prior))], np.full(6, 1e-6), 0
    order = np.random.default_rng(7)
    for _ in range(epochs):
        up, pp = order.permutation(30), order.permutation(12)
        for k in range(3):
            p, u = pos[np.take(pp, range(k * 4, k * 4 + 4), mode="wrap")], unl[up[k * batch:(k + 1) * batch]]
            negative = lambda v: loss(u, v, -1) - prior * loss(p, v, -1)
            clipped = negative(w) < 0
            against += clipped
            f = (lambda v: -negative(v)) if clipped else (lambda v: prior * loss(p, v, 1) + negative(v))
            g = np.array([(f(w + d) - f(w - d)) / 2e-6 for d in np.eye(6) * 1e-6])
            n += g * g
            w = w - rate / np.sqrt(n) * g
            w[:-1] = np.sign(w[:-1]) * np.maximum(0, np.abs(w[:-1]) - (rate / np.sqrt(n))[:-1] * 1e-3)
    assert against > 0, "the case must meet a negative estimate"
    assert np.allclose(weights[used], w[:-1], atol=2e-3) and abs(bias - w[-1]) < 2e-3
    assert not np.delete(weights, used).any() and len(weights) == hashed.DIMS


def test_ftrl_equals_a_dense_loop():
    from ledgerscope.llm import hashed, op8_quality as o
    draw = np.random.default_rng(2)
    used = np.array([3, 50, 51, 9000])
    rows = []
    for k in range(40):
        at = np.flatnonzero(draw.random(4) < 0.6)
        rows.append((k, int(draw.random() < 0.3 + 0.4 * (0 in at)), used[at].astype("<u4"), draw.random(len(at)).astype("<f4") * 3))
    alpha, beta, l1, l2, epochs = 0.3, 1.0, 0.02, 0.1, 3
    weights, bias = o.fit(rows, alpha, beta, l1, l2, epochs)
    z, n, order = [0.0] * 5, [0.0] * 5, np.random.default_rng(8)

    def weight(i):
        limit = l1 if i < 4 else 0.0
        return 0.0 if abs(z[i]) <= limit else -(z[i] - np.sign(z[i]) * limit) / ((beta + np.sqrt(n[i])) / alpha + l2)

    for _ in range(epochs):
        for k in order.permutation(len(rows)):
            _, label, idx, val = rows[k]
            x = {int(np.flatnonzero(used == i)[0]): float(v) for i, v in zip(idx, val)} | {4: 1.0}
            p = 1 / (1 + np.exp(-sum(v * weight(i) for i, v in x.items())))
            now = {i: weight(i) for i in x}
            for i, v in x.items():
                g = (p - label) * v
                sigma = (np.sqrt(n[i] + g * g) - np.sqrt(n[i])) / alpha
                z[i] += g - sigma * now[i]
                n[i] += g * g
    assert np.allclose(weights[used], [weight(i) for i in range(4)], atol=1e-6) and abs(bias - weight(4)) < 1e-9
    assert not np.delete(weights, used).any() and len(weights) == hashed.DIMS


def test_scores_are_sparse_dot_products():
    from ledgerscope.llm import hashed, op7_toxicity, op8_quality
    draw = np.random.default_rng(3)
    weights = draw.normal(size=hashed.DIMS).astype(np.float32)
    texts = pa.array(["a b b a c", "", None, "One two THREE 4 four, four!", "x " * 50])
    for o in (op8_quality, op7_toxicity):
        for group in hashed.word_groups(texts):
            features = list(o.extract(*group))
            got = o.scorer(weights, 0.25)(*group)
            for (idx, val), score in zip(features, got):
                if o is op7_toxicity:  # a word's features count once for each different word
                    continue
                assert abs(score - hashed.sigmoid(weights[idx] @ val + 0.25)) < 1e-6
            if o is op7_toxicity:
                for text, score in zip(texts.to_pylist(), got):
                    words = set((text or "").split())
                    assert abs(score - hashed.sigmoid(sum(weights[list(o.word_features(w))].sum() if o.word_features(w) else 0.0 for w in words) + 0.25)) < 1e-5
