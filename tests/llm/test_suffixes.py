import numpy as np
import pytest

from lexiloom.llm import suffixes


def shared(a, b, breaks):
    n = 0
    while n < min(len(a), len(b)) and a[n] == b[n] and a[n] > breaks:
        n += 1
    return n


@pytest.mark.parametrize("letters,recurse", [(2, 4096), (4, 4096), (200, 4096), (3, 0), (2, 3)])
def test_against_sorted_suffixes(monkeypatch, letters, recurse):
    monkeypatch.setattr(suffixes, "RECURSE", recurse)
    rng = np.random.default_rng(letters + recurse)
    for n in [0, 1, 2, 3, 5, 17, 100, 400] * 6:
        text = np.append(rng.integers(1, letters + 1, n), 0)
        if n > 50 and rng.random() < 0.5:
            text[10:40] = 1  # a long run
        plain = text.tolist()
        order = suffixes.suffix_array(text)
        assert order.tolist() == sorted(range(len(plain)), key=lambda i: plain[i:])
        for breaks in (0, 1):
            got = suffixes.permuted_prefixes(text, order, breaks)
            want = [0] * len(plain)
            for a, b in zip(order, order[1:]):
                want[b] = shared(plain[a:], plain[b:], breaks)
            assert got.tolist() == want
