"""SimHash near-duplicates, found through Golay-code fuzzy hashing.

A 64-bit fingerprint is cut into three segments of 22, 21 and 21 bits, each read as a 23-bit
word of the perfect binary Golay code. The codewords within distance 4 of a word are its
indices: one where the word lies within 2 of a codeword, six where it lies at 3. Any two words
at distance 2 or less have an index in common (tests check this for all error patterns), so two
fingerprints that differ in at most 2 bits agree in some segment exactly (three segments, two
errors) and share an index in the next segment. The key is that pair: exact segment and index
of the following one. Candidates meet by an equi-join on the key and are verified by XOR.

Fingerprints are made distinct first, so exact copies never meet each other. A key that more
than ``hot`` distinct fingerprints share is not joined with itself: each of its fingerprints
emits the 65 words within one bit, and fingerprints are linked to the least fingerprint with
the same word. Two fingerprints within 2 bits always have such a word between them, so the way
is exact for components and grows linearly with the key's size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from collatio.llm._common import byte_texts, cut, slices
from collatio.llm._graph import components

GENERATOR = 0xC75  # x^11+x^10+x^6+x^5+x^4+x^2+1 generates the (23, 12) Golay code
WIDTHS = (22, 21, 21)
SHINGLE = 3
#: Golay indices find at most two differing bits.
MAX_BITS = 2
#: Shingles that are unpacked to bits at once.
STEP = 1 << 16


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """SimHash of a text: bit set where over half of its shingles' XXH64 have it; no words: 0."""
    words = text.lower().split()  # bytes.lower() folds A-Z only
    if not words:
        return 0
    if len(words) <= shingle:
        grams = [b" ".join(words)]
    else:
        grams = list(map(b" ".join, zip(*(words[i:] for i in range(shingle)))))
    digest = xxhash.xxh64_intdigest
    return of_hashes(np.fromiter((digest(g, 42) for g in grams), np.uint64, len(grams)))


def of_hashes(hashes: np.ndarray) -> int:
    """The SimHash of shingle hashes; none: 0."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), STEP):
        ones += np.unpackbits(hashes[at : at + STEP].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    bits = 2 * ones > len(hashes)
    return int.from_bytes(np.packbits(bits).tobytes(), "big")


def _signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """``(id, fp)``, fp as a signed long; null text counts as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                fps = np.array([fingerprint(t, shingle) for t in byte_texts(part, "text")], np.uint64)
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(_signed(fps))], names=["id", "fp"])

    source = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return source.mapInArrow(run, f"id {source.schema['id'].dataType.simpleString()}, fp long")


class Golay:
    """Indices (12 bits) of the codewords within distance 4 of 23-bit words, by syndrome."""

    def __init__(self) -> None:
        self.syndromes = np.array([self._rest(1 << i) for i in range(23)], np.int64)
        patterns = [0] + [1 << a for a in range(23)] + [1 << a | 1 << b for a in range(23) for b in range(a)]
        patterns += [1 << a | 1 << b | 1 << c for a in range(23) for b in range(a) for c in range(b)]
        self.leader = np.zeros(2048, np.int64)
        self.leader[[self._rest(p) for p in patterns]] = patterns
        messages = np.arange(4096, dtype=np.int64) << 11
        codewords = messages | np.array([self._rest(int(m)) for m in messages], np.int64)
        sevens = codewords[np.bitwise_count(codewords) == 7]
        # five codewords of weight 7 cover any three positions (a Steiner system); the leader's weight tells
        self.around = np.zeros((2048, 5), np.int64)
        self.six = np.bitwise_count(self.leader) == 3
        for s in np.flatnonzero(self.six):
            self.around[s] = sevens[(sevens & self.leader[s]) == self.leader[s]]

    @staticmethod
    def _rest(word: int) -> int:
        for i in range(22, 10, -1):
            if word >> i & 1:
                word ^= GENERATOR << (i - 11)
        return word

    def keys(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """``(row, index)``: each row's one or six indices."""
        s = np.zeros(len(words), np.int64)
        for i in range(23):
            s ^= np.where(words >> i & 1, self.syndromes[i], 0)
        nearest = words ^ self.leader[s]
        rows = np.flatnonzero(self.six[s])
        more = nearest[rows, None] ^ self.around[s[rows]]
        return np.concatenate([np.arange(len(words)), np.repeat(rows, 5)]), np.concatenate([nearest, more.ravel()]) >> 11


def golay_keys(fps: np.ndarray, golay: Golay) -> tuple[np.ndarray, np.ndarray]:
    """``(row, key)`` of unsigned fingerprints: segment number, that segment, an index of the next."""
    cuts, at = [], 64
    for width in WIDTHS:
        at -= width
        cuts.append((fps >> np.uint64(at) & np.uint64((1 << width) - 1)).astype(np.int64))
    rows, keys = [], []
    for i, exact in enumerate(cuts):
        r, index = golay.keys(cuts[(i + 1) % 3])
        rows.append(r)
        keys.append(i << 36 | exact[r] << 12 | index)
    return np.concatenate(rows), np.concatenate(keys)


def _keyed(distinct: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        golay = Golay()
        for batch in batches:
            fps = batch.column("fp").to_numpy()
            rows, keys = golay_keys(fps.view(np.uint64), golay)
            yield pa.RecordBatch.from_arrays([pa.array(fps[rows]), pa.array(keys)], names=["fp", "key"])

    return distinct.select("fp").mapInArrow(run, "fp long, key long")


def near_edges(distinct: DataFrame, hot: int = 64) -> DataFrame:
    """Edges ``(a, b)`` between the distinct fingerprints ``distinct(fp)``, all within MAX_BITS.

    Every pair within the distance is joined by an edge, or by a path over the least
    fingerprint around a shared word where a key has over ``hot`` fingerprints.
    """
    keyed = cut(_keyed(distinct))
    sizes = keyed.groupBy("key").count().where("count > 1")
    met = keyed.join(sizes, "key")
    few, many = met.where(F.col("count") <= hot), met.where(F.col("count") > hot)
    left, right = few.select("key", F.col("fp").alias("a")), few.select("key", F.col("fp").alias("b"))
    near = (F.col("a") < F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= MAX_BITS)
    pairs = left.join(right, "key").where(near).select("a", "b")
    flips = F.array(*(F.lit(np.int64(np.uint64(1 << i).view(np.int64)).item()) for i in range(64)), F.lit(0).cast("long"))
    balls = many.select("fp").distinct().select("fp", F.explode(flips).alias("flip")).select(
        "fp", F.col("fp").bitwiseXOR(F.col("flip")).alias("word"),
    )
    hubs = balls.groupBy("word").agg(F.min("fp").alias("hub"))
    stars = balls.join(hubs, "word").where("fp <> hub").select(F.col("fp").alias("a"), F.col("hub").alias("b"))
    return pairs.union(stars).distinct()


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", hot: int = 64, shingle: int = SHINGLE) -> DataFrame:
    """One row per row of ``df``: ``(id, fingerprint, component_id)``.

    Ids keep their type, which must have an order. ``component_id`` is the least id reachable over links of at most MAX_BITS differing bits,
    the row's own included. Null text counts as empty; texts without words have fingerprint 0 and
    link like any other. A null id takes part in links but names no component (a component of
    null ids only has component null); repeated rows are returned as often as they come. Columns
    other than id and text are neither read nor returned.
    """
    docs = cut(fingerprints(df, id_col, text_col, shingle))
    classes = cut(docs.groupBy("fp").agg(F.min("id").alias("rep")))
    linked = components(near_edges(classes, hot)).select(F.col("node").alias("fp"), "component")
    named = classes.join(linked, "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    least = named.groupBy("component").agg(F.min("rep").alias("component_id"))
    lookup = named.join(least, "component").select("fp", "component_id")
    return docs.join(lookup, "fp").select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
