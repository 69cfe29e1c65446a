import numpy as np
import xxhash

from collatio.llm import simhash

A = " ".join(f"word{i}" for i in range(200))


def brute(texts):
    def fp(text):
        words = (text or "").encode().lower().split()
        grams = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([b" ".join(words)] if words else [])
        hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
        return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))

    return [fp(t) for t in texts]


def groups(ids, fps):
    least = {i: i for i in range(len(fps))}
    for _ in fps:
        for i, x in enumerate(fps):
            least[i] = min(least[j] for j, y in enumerate(fps) if (x ^ y).bit_count() <= 2)
    best = {}
    for i, c in least.items():
        if ids[i] is not None:
            best[c] = min(best.get(c, ids[i]), ids[i])
    return [best.get(least[i]) for i in range(len(fps))]


def test_words_within_two_bits_share_an_index():
    golay = simhash.Golay()

    def keys(words):
        rows, index = golay.keys(words)
        out = [set() for _ in words]
        for r, k in zip(rows, index):
            out[r].add(int(k))
        return out

    words = np.random.default_rng(1).integers(0, 1 << 23, 40)
    own = keys(words)
    assert {len(k) for k in own} <= {1, 6}
    for a in range(23):
        for b in range(a + 1):
            flip = 1 << a | 1 << b
            assert all(x & y for x, y in zip(own, keys(words ^ flip)))


def test_every_pair_within_two_bits_shares_a_key():
    rng = np.random.default_rng(2)
    golay = simhash.Golay()
    x = rng.integers(0, 1 << 63, 300, dtype=np.uint64) * np.uint64(2)
    y = x ^ (np.uint64(1) << rng.integers(0, 64, 300, dtype=np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, 300, dtype=np.uint64))
    sets = []
    for fps in (x, y):
        rows, keys = simhash.golay_keys(fps, golay)
        out = [set() for _ in fps]
        for r, k in zip(rows, keys):
            out[r].add(int(k))
        sets.append(out)
    assert all(a & b for a, b in zip(*sets))


def test_against_brute_force_with_edge_cases(spark):
    texts = [A, A.upper(), A + " tail", A.replace("word7 ", "other "), None, "", " \t\n", "one", "one two", "one two", "ünï cödé ÄÖ", "x " * 60000]
    ids = [5, 3, None, 9, 12, 11, 20, 21, 22, 22, 30, 31]
    rows = [(i, t, "clash", 0) for i, t in zip(ids, texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, fingerprint string, component_id int")
    fps = brute(texts)
    expected = sorted(zip(ids, (f"{f:016x}" for f in fps), groups(ids, fps)), key=str)
    for hot in (64, 1):
        got = simhash.near_duplicates(df, hot=hot).collect()
        assert sorted((tuple(r) for r in got), key=str) == expected


def test_hot_keys_give_the_same_groups(spark):
    rng = np.random.default_rng(3)
    base = rng.integers(0, 1 << 62, 3).tolist()
    fps = sorted({b ^ (1 << int(i)) ^ (1 << int(j)) for b in base for i, j in rng.integers(0, 64, (40, 2))})
    signed = [(f - (1 << 64) if f >> 63 else f,) for f in fps]
    df = spark.createDataFrame(signed, "fp long")
    ends = []
    for hot in (10_000, 1):
        edges = simhash.near_edges(df, hot).collect()
        assert all(((e.a ^ e.b) & (2**64 - 1)).bit_count() <= 2 for e in edges)
        ends.append(dict(map(tuple, simhash.components(simhash.near_edges(df, hot)).collect())))
    assert ends[0] == ends[1]


def test_empty_table(spark):
    out = simhash.near_duplicates(spark.createDataFrame([], "doc_id long, text string"))
    assert out.columns == ["doc_id", "fingerprint", "component_id"] and out.count() == 0


def test_ids_of_any_type(spark):
    from collatio.llm import copies, simhash

    rows = [("b", "one two three four five six"), ("a", "one two three four five six"), ("c", "nothing alike in here at all"), (None, "one two three four five six")]
    df = spark.createDataFrame(rows, "doc_id string, text string")
    for found in (simhash.near_duplicates(df), copies.near_copies(df)):
        assert sorted((r.doc_id or "", r.component_id) for r in found.collect()) == [("", "a"), ("a", "a"), ("b", "a"), ("c", "c")]
