"""The bound by which pairs of one pivot are left out never leaves out a similar pair."""

import numpy as np
import pyarrow as pa

from tessera.llm.neardup import BITMAP, PIVOT, SIMILARITY, _meet, _similar


def test_bound_keeps_every_similar_pair():
    rng = np.random.default_rng(5)
    base = rng.integers(1, 1 << 62, 100)
    spare = rng.integers(1, 1 << 62, 40)
    sets = [np.unique(np.r_[rng.choice(base, 100 - int(k), replace=False), rng.choice(spare, int(k), replace=False)]) for k in rng.integers(0, 25, 90)]
    weights = [(1 + s % 3 + (rng.random(len(s)) < 0.05)).astype(np.int32) for s in sets]
    lists = lambda x, t: pa.array([list(map(int, v)) for v in x], pa.list_(t))
    n = len(sets)

    def judged(a, b):
        """Of pairs sorted by a, each a being the leader of its pairs."""
        rows = []
        for lead in np.unique(a).tolist():
            rows += [(lead, None, lead), *[(lead, int(f), int(f)) for f in b[a == lead]]]
        whose = [r[2] for r in rows]
        cols = {"lead": pa.array([r[0] for r in rows]), "slice": pa.array(np.zeros(len(rows), np.int32)), "follow": pa.array([r[1] for r in rows], pa.int64()), "codes": lists([sets[i] for i in whose], pa.int64()), "weights": lists([weights[i] for i in whose], pa.int32()), "lead_fame": pa.array(np.zeros(len(rows), np.int64)), "follow_fame": pa.array(np.zeros(len(rows), np.int64))}
        batches = pa.table(cols).to_batches(max_chunksize=37)
        return pa.Table.from_batches(list(_similar(iter(batches), SIMILARITY, True))).combine_chunks().to_batches()[0]

    x, y = np.triu_indices(n, 1)
    similar = {(int(a), int(b)) for a, b, ok in zip(x, y, judged(x, y).column("linked").to_pylist()) if ok}
    m = judged(np.zeros(n, np.int64), np.arange(n))
    size, common = m.column("b_size").to_numpy(), m.column("common").to_numpy()
    bits = np.array(m.column("b_bits").to_pylist())
    over = size - common - np.bitwise_count(bits.view(np.uint64)).sum(1, dtype=np.int64)
    pivot = dict(zip(PIVOT, [np.zeros(n, np.int64), size * (SIMILARITY / (1 + SIMILARITY)), common, over, *[bits[:, i] for i in range(BITMAP)]]))
    block = np.arange(n) % 3
    got = set()
    batches = []
    for i in range(3):
        for j in range(i, 3):
            rows = np.flatnonzero((block == i) | (block == j))
            cols = {"band": np.zeros(len(rows), np.int64), "i": np.full(len(rows), i, np.int32), "j": np.full(len(rows), j, np.int32), "block": block[rows].astype(np.int32), "rep": rows, "class": rows} | {c: v[rows] for c, v in pivot.items()}
            batches.append(pa.table(cols | {"sig": lists(np.zeros((len(rows), 8)), pa.int64())}))
    batches = pa.concat_tables(batches).combine_chunks().to_batches(max_chunksize=17)
    for out in _meet(iter(batches), 128, SIMILARITY):
        pairs = list(zip(out.column("a").to_pylist(), out.column("b").to_pylist()))
        assert not got & set(pairs)
        got |= set(pairs)
    assert similar and similar <= got
    assert len(got) < n * (n - 1) // 2
