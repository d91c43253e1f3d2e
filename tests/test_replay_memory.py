"""The processor of replay buffers alone: large micro-batches in any order, out in bounded frames."""

import numpy as np
import pandas as pd
import pytest

from weirflow.plans import inputs
from weirflow.streaming import replay


class Kept:
    def __init__(self):
        self.value = None

    def getValueState(self, *_):
        return self

    def exists(self):
        return self.value is not None

    def get(self):
        return self.value

    def update(self, value):
        self.value = value


@pytest.mark.parametrize("batch", [200_000, 30_000, 700])
def test_reads_of_a_key(batch):
    n = min(200_000, batch * 5)
    rng, p, got, held, want = np.random.default_rng(5), replay._Slots(["x", "s"]), [], {}, []
    p.init(Kept())
    for a in range(0, n, batch):
        rows = []
        for t in range(a, min(n, a + batch)):
            if t % 3:
                rows.append((t, -1, t % 8, t / 2, None if t % 5 == 0 else f"s{t}"))
                held[t % 8] = rows[-1]
            for k, slot in enumerate(rng.integers(0, 9, 2).tolist()):
                rows.append((t, k, slot, -1.0, "other"))
                if slot in held:
                    want.append((t, k, held[slot][0], *held[slot][3:]))
        df = pd.DataFrame(rows, columns=["t", "k", "slot", "v0", "v1"]).sample(frac=1, random_state=1)
        frames = list(p.handleInputRows(("k",), (df.iloc[b : b + 10_000] for b in range(0, len(df), 10_000)), None))
        assert max(map(len, frames)) <= 1 << 16
        got += [tuple(None if v != v else v for v in r) for f in frames for r in f.itertuples(index=False, name=None)]
    assert got == want
    with pytest.raises(ValueError, match="comes after"):
        list(p.handleInputRows(("k",), iter([df.head(5)]), None))


def test_micro_batches_are_bounded():
    assert inputs.AHEAD <= 1 << 20
