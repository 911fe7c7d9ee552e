"""Training steps against numeric differences, decoding against enumeration, joined windows against a loop."""

import itertools

import numpy as np

from gneiss.llm import pii, quality, toxicity


def test_attention_fit_steps_against_the_numeric_gradient():
    rng = np.random.default_rng(0)
    begin = np.array([0, 3, 4, 9, 11])
    x, labels = rng.normal(size=(11, 5)), np.array([1.0, 0.0, 0.0, 1.0])
    start, decay, rate = quality.AttentionModel(5, hidden=4, gate=3), 1e-2, 1e-4
    start.mean, start.scale = x.mean(0), x.std(0) + 1e-6
    weight = np.where(labels == 1, 0.5 / labels.mean(), 0.5 / (1 - labels.mean())) / len(labels)

    def loss(p):
        model = quality.AttentionModel(5, hidden=4, gate=3)
        model.mean, model.scale, model.p = start.mean, start.scale, p
        y = model.score(x, begin)
        return -(weight * (labels * np.log(y) + (1 - labels) * np.log(1 - y))).sum() + decay / 2 * sum((v**2).sum() for v in p.values())

    # The first step of Adam goes by the sign of each component.
    moved = quality.AttentionModel(5, hidden=4, gate=3).fit(x, begin, labels, steps=1, rate=rate, decay=decay).p
    checked = 0
    for k, v in start.p.items():
        for at in np.ndindex(v.shape):
            near = [{n: w.copy() for n, w in start.p.items()} for _ in range(2)]
            near[0][k][at] += 1e-5
            near[1][k][at] -= 1e-5
            g = (loss(near[0]) - loss(near[1])) / 2e-5
            if abs(g) > 1e-6:
                assert np.isclose(v[at] - moved[k][at], np.sign(g) * rate, rtol=1e-2), (k, at)
                checked += 1
    assert checked > 50


def test_toxicity_fit_ends_where_its_objective_is_flat():
    rng = np.random.default_rng(1)
    width, decay, penalty = 6, 0.01, 0.7
    bags = [np.flatnonzero(rng.random(width) < 0.5) for _ in range(20)]
    labels = (rng.random(20) < 0.4).astype(float)
    pairs = [(np.array([0, 2]), np.array([1, 2])), (np.array([3]), np.array([4, 5]))]
    weight = np.where(labels == 1, 0.5 / labels.mean(), 0.5 / (1 - labels.mean())) / len(labels)

    def loss(w, bias):
        z = np.array([bias + sum(w[k] for k in b) for b in bags])
        y = 1 / (1 + np.exp(-z))
        change = np.array([sum(w[k] for k in b) - sum(w[k] for k in a) for a, b in pairs])
        return -(weight * (labels * np.log(y) + (1 - labels) * np.log(1 - y))).sum() + penalty * (change**2).mean() + decay / width * (w**2).sum() / 2

    w, bias = toxicity.fit(bags, labels, pairs, width, penalty, decay, steps=6000, rate=0.01)
    for k in range(width + 1):
        e = np.zeros(width + 1)
        e[k] = 1e-5
        g = (loss(w + e[:width], bias + e[width]) - loss(w - e[:width], bias - e[width])) / 2e-5
        assert abs(g) < 2e-4, k
    loose = toxicity.fit(bags, labels, pairs, width, 0.0, decay, steps=3000, rate=0.01)[0]
    change = lambda v: sum(abs(v[b].sum() - v[a].sum()) for a, b in pairs)
    assert change(w) < 0.5 * change(loose)


def test_toxicity_scores_against_a_loop():
    from gneiss.llm import arrays

    texts = ["kind words here", "vile slur, vile", "", "Vile VILE vileness slurry"]
    offsets = np.concatenate(([0], np.cumsum([len(t.encode()) for t in texts])))
    data = np.frombuffer("".join(texts).encode(), "uint8")
    hashes, _, first = toxicity.features(data, offsets, arrays.Powers())
    own = [set(np.concatenate([h[i:j] for h in hashes]).tolist()) - {0} for i, j in zip(first[:-1], first[1:], strict=True)]
    keys = np.array(sorted(own[1] | own[0])[::2], "uint64")
    weights = np.random.default_rng(2).normal(size=len(keys))
    got = toxicity.ToxicityModel(keys, weights, 0.3).score(data, offsets, arrays.Powers())
    want = [1 / (1 + np.exp(-(0.3 + sum(w for k, w in zip(keys.tolist(), weights, strict=True) if k in s)))) for s in own]
    assert np.allclose(got, want)


def test_best_path_is_the_best_of_all():
    rng = np.random.default_rng(3)
    model = pii.BiLstmCrf()
    for n in (1, 2, 4):
        for _ in range(5):
            model.p["T"] = rng.normal(size=(pii.TAGS, pii.TAGS))
            e = rng.normal(size=(n, pii.TAGS)) * 2
            trans = model.p["T"] + model.mask
            worth = lambda y: model.mask[0][y[0]] + e[0][y[0]] + sum(trans[a, b] + e[t + 1][b] for t, (a, b) in enumerate(itertools.pairwise(y)))  # noqa: E731,B023
            assert tuple(model.best_path(e)) == max(itertools.product(range(pii.TAGS), repeat=n), key=worth)


def test_windows_are_joined_as_a_loop_would():
    model = pii.BiLstmCrf()
    rng = np.random.default_rng(4)
    for k in model.p:
        model.p[k] = rng.normal(0, 0.5, model.p[k].shape)
    texts = ["x" * 40 + "1" + "y" * 150 + "@" + "z" * 30 + "7" * 60, "a1", "no trigger", "9" * 300, "q" * 500 + "5" + "q" * 500 + "6"]
    got = pii.model_spans(texts, model)
    for text, spans in zip(texts, got, strict=True):
        ids, want = pii._char_ids(text), []
        triggers = pii._triggers(text)
        starts = pii.windows(ids, triggers).tolist() if len(triggers) else []
        read = {s: model.emissions(pii._cut(ids, np.array([s])))[0] for s in starts}
        covered = sorted({c for s in starts for c in range(s, min(s + pii.WINDOW, len(ids)))})
        stretches, at = [], None
        for c in covered:
            # Windows that only touch do not overlap: a stretch ends there.
            apart = at is None or c != at + 1 or not any(s < c < s + pii.WINDOW for s in starts)
            if apart:
                stretches.append([])
            stretches[-1].append(c)
            at = c
        for stretch in stretches:
            e = []
            for c in stretch:
                depth = {s: min(c - s, s + pii.WINDOW - 1 - c) for s in starts if s <= c < s + pii.WINDOW}
                e.append(read[max(depth, key=lambda s: (depth[s], -s))][c - max(depth, key=lambda s: (depth[s], -s))])
            want += pii._spans_of(model.best_path(np.array(e)), stretch[0], triggers)
        assert spans == want
