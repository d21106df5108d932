from itertools import combinations

import numpy as np

from quillon.llm import packing


def test_search_empties_all_bins_it_can():
    sizes = [1040] * 60 + [544] * 60 + [528] * 60 + [480] * 120
    bins = packing.best_fit(sizes, 2048)
    assert len(bins) == 110 and len(packing.local_search(bins, sizes, 2048)) == 90


def test_search_ends_where_no_exchange_helps():
    sizes = [int(x) for x in np.random.default_rng(0).integers(300, 1100, 300)]
    bins = packing.local_search(packing.best_fit(sizes, 2048), sizes, 2048)
    assert sorted(i for b in bins for i in b) == list(range(300)) and len(bins) > packing._lower_bound(sizes, 2048)
    held = [[sizes[i] for i in b] for b in bins]
    for a in held:
        for b in held:
            if a is not b:
                one, two = [(x,) for x in a], list(combinations(a, 2))
                mine, pairs = [(x,) for x in b], list(combinations(b, 2))
                trades = [(x, y) for xs, ys in ((one, [(), *mine, *pairs]), (two, mine)) for x in xs for y in ys]
                grown = [d for x, y in trades if 0 < (d := sum(x) - sum(y)) <= 2048 - sum(b)]
                assert all(d <= sum(a) - sum(b) for d in grown)
