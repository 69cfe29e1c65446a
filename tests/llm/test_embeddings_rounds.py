import numpy as np

from collatio.llm import embeddings


def test_isolated_pairs_are_found_in_a_large_group(spark):
    """Pairs at cosine 0.935 that no crowd completes: few passes of small windows show only some at once."""
    rng = np.random.default_rng(4)
    base = rng.standard_normal((600, 64))
    base /= np.linalg.norm(base, axis=1, keepdims=True)
    other = rng.standard_normal(base.shape)
    other -= (other * base).sum(axis=1, keepdims=True) * base
    other /= np.linalg.norm(other, axis=1, keepdims=True)
    mates = 0.935 * base + np.sqrt(1 - 0.935**2) * other
    rows = [(i, v.tolist(), "x") for i, v in enumerate(np.concatenate([base, mates]))]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label string")
    p = embeddings.Passes(passes=4, window=4, enough=50)
    assert embeddings.needed(p, 50) == 4 and embeddings.needed(p, 1200) > 4
    distinct = embeddings.classes(df, "vec_id", "embedding", "label")
    once = embeddings.window_pairs(distinct, p).count()
    got = {r.vec_id: r.component_id for r in embeddings.near_duplicates(df, passes=p).collect()}
    found = sum(got[i + 600] == i for i in range(600))
    assert once < 560 and found >= 590, (once, found)
