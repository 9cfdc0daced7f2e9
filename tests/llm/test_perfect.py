import numpy as np
import pytest

from kerbline.llm.perfect import PerfectHash


@pytest.mark.parametrize("n", [0, 1, 2, 3, 63, 64, 65, 1000, 50_000])
def test_every_key_has_a_slot_of_its_own(n):
    rng = np.random.default_rng(n)
    keys = rng.permutation(np.unique(rng.integers(0, 2**64 if n % 2 else 4 * n + 9, n, dtype=np.uint64)))
    table = PerfectHash.from_bytes(PerfectHash(keys).to_bytes())
    assert sorted(table.slots(keys)) == list(range(len(keys)))
    stored = keys[table.in_order(keys)]
    assert (stored[table.find(keys, stored)] == keys).all()
    others = np.setdiff1d(rng.integers(0, 2**64, 2000, dtype=np.uint64), keys)
    assert (table.find(others, stored) == -1).all()


def test_what_never_stands_alone_is_kept_as_a_list(monkeypatch):
    monkeypatch.setattr("kerbline.llm.perfect.LEVELS", 1)
    keys = np.arange(5000, dtype=np.uint64)
    table = PerfectHash(keys)
    assert len(table.rest) > 1000 and sorted(table.slots(keys)) == list(range(5000))
    with pytest.raises(ValueError):
        PerfectHash(np.array([7, 7], np.uint64))
