import random

import numpy as np

from plumbline.llm.suffix_dedup import first_windows


def brute(contexts, order, length):
    windows = sorted((order[i][:-1], order[i][-1] + s, i, s) for i, c in enumerate(contexts) for s in range(len(c) - length + 1))
    seen, out = set(), [np.zeros(max(0, len(c) - length + 1), bool) for c in contexts]
    for _, _, i, s in windows:
        w = contexts[i][s : s + length]
        out[i][s] = w in seen
        seen.add(w)
    return out


def test_difference_cover_order_against_brute_force():
    rng = random.Random(3)
    for trial in range(12):
        base = [bytes(rng.choice(b"ab " if trial % 3 else b"abcdefgh") for _ in range(400)) for _ in range(3)]
        contexts, order = [], []
        for d in range(rng.randint(1, 30)):
            text = bytearray(rng.choice(base))
            if rng.random() < 0.7:
                text[rng.randrange(len(text))] = 120
            at = rng.randrange(200)
            contexts.append(bytes(text[at : at + rng.randint(100, 168)]))
            order.append((rng.randrange(4), 0, d * 1000))
        if trial % 4 == 0:
            contexts = [(b"xyz" * 100)[: len(c)] for c in contexts]
        got = first_windows(contexts, order, 100)
        assert all((a == b).all() for a, b in zip(got, brute(contexts, order, 100), strict=True))
