"""The other operators against brute-force versions, round trips and held-out accuracy, with edge cases."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from collatio.llm import chat, contextmix, embeddings, language, mixing, pieces, quality, urls

WORD = re.compile(r"[^\x20\x09-\x0D]+")
TEXTS = ["one two three four five six\none two three four five six\nlast # line", "", None, " \t\n", "single", "ünï çö " * 30, "a b " * 4000, "same line\nsame line\nsame line", "x y z w v " * 3 + "é▁ \x00"]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i if i != 4 else None, t, "en" if i % 2 else None, None if i == 3 else f"s{i % 3}", 7, i) for i, t in enumerate(TEXTS)] + [(0, TEXTS[0], "en", "s0", 7, 9)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_words int, taken long")


# ---- quality


def brute_quality(text):
    words = WORD.findall(text or "")
    windows = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    hit = set()
    for i in range(len(words) - 4):
        if windows[tuple(words[i : i + 5])] > 1:
            hit |= set(range(i, i + 5))
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        dup += bool(WORD.search(line)) and line in seen
        seen.add(line)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), dup, len(hit)


def test_quality(docs):
    got = quality.quality(docs).collect()
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    assert sorted(tuple(r[n] for n in names) for r in got) == sorted([brute_quality(t) for t in TEXTS] + [brute_quality(TEXTS[0])])
    for r in got:
        assert r.base_failed == (r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words) and not (r.kept and r.base_failed)
    assert quality.quality(docs.limit(0)).count() == 0


def test_repeat_coverage():
    rng = random.Random(0)
    texts = [" ".join(rng.choices("abc", k=rng.randint(0, 40))).encode() for _ in range(60)]
    got = quality.measure(texts, quality.Rules())
    for i, t in enumerate(texts):
        words = t.decode().split()
        for n in (5, 7, 10):
            seen, cover = set(), set()
            for p in range(len(words) - n + 1):
                g = tuple(words[p : p + n])
                cover |= set(range(p, p + n)) if g in seen else set()
                seen.add(g)
            assert got[f"dup_chars_{n}"][i] == sum(len(words[p]) for p in cover)


# ---- mixing


def test_schedule():
    for total, blocks in ((1, [1]), (7, [3, 4]), (100, [1, 60, 39])):
        bits = max(1, (total - 1).bit_length())
        first, every = 0, []
        for b in blocks:
            cells = np.arange(first, first + b)
            slots = mixing.reversed_bits(cells, bits)
            rank = mixing.earlier(slots, bits, np.int64(first + b)) - mixing.earlier(slots, bits, np.int64(first))
            assert list(rank) == [int((slots < s).sum()) for s in slots]
            every += slots.tolist()
            first += b
        assert len(set(every)) == total


def brute_targets(totals, weights, most):
    out, left, free = {}, sum(totals.values()), dict(weights)
    while free:
        unit = left / sum(free.values())
        over = [s for s in free if unit * free[s] > most * totals[s]]
        if not over:
            return out | {s: unit * free[s] for s in free}
        for s in over:
            out[s] = most * totals[s]
            left -= out[s]
            del free[s]
    return out


def test_mix(spark, docs):
    rng = random.Random(1)
    rows = [(i, " ".join(["w"] * rng.randint(0, 60)), "big" if i % 3 else rng.choice(["tiny", None, "mid"])) for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    mix = mixing.Mix(block_words=16)
    got = {r.doc_id: r for r in mixing.mix_sources(df, mix=mix).collect()}
    again = {r.doc_id: r for r in mixing.mix_sources(df.repartition(7), mix=mix).collect()}
    assert got == again and len(got) == 400
    totals = Counter()
    for i, t, s in rows:
        totals[s] += len(t.split())
    order = sorted(totals, key=lambda s: (s is None, s or ""))
    want = brute_targets(dict(totals), {s: (1, 2, 3)[k % 3] for k, s in enumerate(order)}, 3)
    taken = Counter()
    for i, t, s in rows:
        r = got[i]
        assert r.size == len(t.split()) and r.source_size == totals[s] and abs(r.target - want[s]) < 1e-6 and 0 <= r.taken <= 3 * r.size
        taken[s] += r.taken
    assert all(abs(taken[s] - want[s]) <= 1 for s in totals)
    assert all((r.first_slot is None) == (r.taken == 0) == (r.n_parts == 0) for r in got.values())
    odd = mixing.mix_sources(docs).collect()
    assert len(odd) == len(TEXTS) + 1 and sum(r.taken for r in odd) > 0
    assert mixing.mix_sources(docs.limit(0)).count() == 0


def test_the_schedule_reaches_the_result(spark, monkeypatch):
    """Other slots give another result, and every slot of the schedule is filled once."""
    df = spark.createDataFrame([(i, " ".join(["w"] * (5 + i % 40)), f"s{i % 3}") for i in range(200)], "doc_id long, text string, source string")
    mix = mixing.Mix(block_words=16)
    got = {r.doc_id: r for r in mixing.mix_sources(df, mix=mix).collect()}
    # slots in the order of the sources instead
    monkeypatch.setattr(mixing, "reversed_bits", lambda m, bits: m.copy())
    monkeypatch.setattr(mixing, "earlier", lambda slots, bits, bound: np.minimum(slots, bound))
    other = {r.doc_id: r for r in mixing.mix_sources(df, mix=mix).collect()}
    assert all(got[i].taken == other[i].taken for i in got)
    assert sum(got[i].first_slot != other[i].first_slot for i in got if got[i].taken) > 100 and sum(got[i].slots_hash != other[i].slots_hash for i in got) > 100


def test_pieces_fill_the_slots_in_order(spark):
    df = spark.createDataFrame([(i, " ".join(f"w{j}" for j in range(5 + i % 40)), f"s{i % 3}") for i in range(120)] + [(7, "same text here", "s0")] * 50 + [(None, "same text here", None)] * 9, "doc_id long, text string, source string")
    mix = mixing.Mix(block_words=16)
    docs = mixing.measured(df, "doc_id", "text", "source")
    aimed = mixing.shares(docs, mix)
    rows = mixing.pieces(docs, aimed, mix).collect()
    per = Counter()
    for r in rows:
        per[r.slot] += r.words
    quota = {r.sid: r.quota for r in aimed.collect()}
    assert sum(per.values()) == sum(quota.values()) and set(per.values()) <= {16} | {q % 16 for q in quota.values()}
    assert sum(n != 16 for n in per.values()) <= len(quota)
    out = mixing.mixed_documents(df.withColumn("copy", df.doc_id).withColumn("mix_slot", df.doc_id), mix=mix)
    assert out.columns == ["doc_id", "text", "source", "copy", "mix_slot", "mix_cut"]
    got = out.collect()
    assert [r.mix_slot for r in got] == sorted(r.mix_slot for r in got)
    assert sum(len(r.text.split()) for r in got) == sum(quota.values()) and sum(r.mix_cut for r in got) <= len(quota)
    full = {(r.doc_id, r.source): r.text for r in df.collect()}
    assert all(full[r.doc_id, r.source].startswith(r.text) and (r.text == full[r.doc_id, r.source]) != r.mix_cut for r in got)
    assert mixing.mixed_documents(df.limit(0)).count() == 0


def test_equal_rows_are_one_class(spark):
    """A third of all rows are the same: one class, whose copies come back, each at most thrice taken."""
    df = spark.createDataFrame([(None, "a b c", "hot")] * 300 + [(i, f"x{i} y", "s") for i in range(600)], "doc_id long, text string, source string")
    assert mixing.measured(df, "doc_id", "text", "source").count() == 601
    got = mixing.mix_sources(df, mix=mixing.Mix(block_words=8)).collect()
    assert len(got) == 900 and sum(r.doc_id is None for r in got) == 300 and all(0 <= r.taken <= 3 * r.size for r in got)


# ---- language


def test_language(spark, docs):
    rng = random.Random(2)
    langs = {"aa": ["the", "thing", "and", "other"], "bb": ["und", "schön", "nicht", "größe"], "cc": ["été", "dans", "leurs", "façon"]}
    rows = [(i, " ".join(rng.choices(langs[k], k=rng.randint(3, 60))), k) for i, k in ((i, rng.choice(sorted(langs))) for i in range(300))]
    rows += [(900, " ".join(langs["aa"] * 30 + langs["bb"] * 10), None), (901, "12 34 !!", "aa"), (902, None, "bb")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r.doc_id: r for r in language.identify(df).collect()}
    held = [i for i, t, k in rows[:300] if zlib.crc32(str(i).encode()) % 3 == 1]
    assert held and all(got[i].held_out for i in held) and sum(got[i].lang_pred == rows[i][2] for i in held) >= 0.98 * len(held)
    assert abs(got[900].score - 0.75) < 0.05 and [x.lang for x in got[900].languages] == ["aa", "bb"]
    assert (got[901].lang_pred, got[902].lang_pred, got[901].score) == ("und", "und", 0.0)
    assert language.identify(docs).count() == len(TEXTS) + 1
    assert [r.lang_pred for r in language.identify(df.where("doc_id = 900")).collect()] == ["und"]
    assert language.identify(docs.limit(0)).count() == 0


def brute_mixture(text, logs, s):
    """Mixtures of every set of languages, largest shares first, by plain EM over words."""
    words = [w for w in (language.letters(x.encode()) for x in WORD.findall(text)) if w]
    langs = len(logs)

    def likelihood(word):
        bucket, _ = language.grams([word], s)
        ll = [sum(float(row[b]) for b in bucket) / len(s.lengths) for row in logs]
        return [max(math.exp(x - max(ll)), s.floor) for x in ll]

    rows = [likelihood(w) for w in words]

    def em(share, rounds):
        for _ in range(rounds):
            post = [[a * b for a, b in zip(r, share)] for r in rows]
            share = [sum(p[i] / sum(p) for p in post) / len(rows) for i in range(langs)]
        return share, sum(math.log(sum(a * b for a, b in zip(r, share))) for r in rows)

    cost = s.penalty * 0.5 * math.log(len(rows))
    share, fit = em([1 / langs] * langs, s.rounds)
    best, value = share, fit - cost * (langs - 1)
    order = sorted(range(langs), key=lambda i: -share[i])
    for m in range(1, langs):
        begin = [max(share[i], 1e-12) if i in order[:m] else 0.0 for i in range(langs)]
        got, reached = em([x / sum(begin) for x in begin], s.rounds if m > 1 else 0)
        if reached - cost * (m - 1) > value:
            best, value = got, reached - cost * (m - 1)
    return best


def test_mixture_against_plain_em():
    rng = random.Random(12)
    s = language.Settings(rounds=8)
    vocab = [["".join(rng.choices("abcdeäλ"[k : k + 4], k=rng.randint(2, 7))) for _ in range(40)] for k in range(4)]
    counts = np.full((4, s.buckets), s.smoothing)
    for k, own in enumerate(vocab):
        bucket, _ = language.grams(own, s)
        np.add.at(counts[k], bucket, 5.0)
    logs = np.log(counts / counts.sum(axis=1, keepdims=True)).astype(np.float32)
    texts = [" ".join(w for k, n in enumerate(mix) for w in rng.choices(vocab[k], k=n)) for mix in ((30, 0, 0, 0), (20, 20, 0, 0), (10, 12, 14, 0), (9, 9, 9, 9), (0, 0, 1, 0), (40, 2, 0, 1))]
    share, above = language.infer([t.encode() for t in texts], logs, s)
    sizes = []
    for text, row in zip(texts, share):
        want = brute_mixture(text, logs, s)
        assert [bool(x > 1e-6) for x in row] == [x > 1e-6 for x in want] and max(abs(a - b) for a, b in zip(row, want)) < 0.02
        sizes.append(int((row > 1e-6).sum()))
    assert sizes[0] == 1 and max(sizes) == 4 and (above > 0).all()
    assert language.infer(["1 2 !".encode(), b""], logs, s)[1].tolist() == [0.0, 0.0]


# ---- chat


def test_chat_round_trip(spark):
    rows = [(1, 0, "user", "</s>[INST] ok [/INST]"), (1, 1, "assistant", "<\\s>[\\\\/INST]</s>"), (2, 0, "system", None), (2, 1, "user", "a\nb"), (2, 2, "assistant", "ü"), (3, 0, "assistant", "alone"), (4, 0, None, ""), (4, 0, None, ""), (None, 5, "[INST]", "<s>")]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "conv_id long, turn long, role string, text string, formatted string")
    got = {r.conv_id: r for r in chat.digest(chat.format_chats(df)).collect()}
    assert {k: r.valid for k, r in got.items()} == {1: True, 2: True, 3: False, 4: False, None: False}
    for conv in got:
        turns = sorted((r[1:] for r in rows if r[0] == conv), key=lambda t: t[0])
        said = "".join(f"{r or ''}\n{t or ''}\n" for _, r, t in turns)
        loss = "".join(t or "" for _, r, t in turns if r == "assistant")
        assert got[conv].turns_sha256 == hashlib.sha256(said.encode()).hexdigest() and got[conv].n_turns == len(turns)
        assert got[conv].loss_sha256 == hashlib.sha256(loss.encode()).hexdigest() and got[conv].loss_chars == len(loss)
    assert chat.format_chats(df.limit(0)).count() == 0


# ---- urls


def test_urls(spark):
    pages = [(1, "http://WWW.Example.com/en/x?q"), (2, "https://a.net/es/"), (3, "https://a.net"), (4, None), (5, "no scheme"), (6, "ftp://bad.org/x#y"), (6, "ftp://bad.org/z"), (None, "http://a.net/fr/1")]
    df = spark.createDataFrame([(*p, "h") for p in pages], "page_id long, url string, host string")
    labels = spark.createDataFrame([(6, 0, 1)] * 60 + [(2, 1, 0)] * 60 + [(3, None, None)], "doc_id long, quality int, toxic int")
    got = sorted((tuple(r)[:5] for r in urls.filter_urls(df, labels).collect()), key=str)
    assert (1, "www.example.com", "/en/x", "www.example.com/en/", "allow") in got and (2, "a.net", "/es/", "net/es/", "block") in got
    assert (3, "a.net", "", None, "allow") in got and (6, "bad.org", "/x", None, "block") in got and (5, "", "", None, "allow") in got and len(got) == len(pages)
    none = urls.filter_urls(df, labels.limit(0)).collect()
    assert len(none) == len(pages) and urls.filter_urls(df.limit(0), labels).count() == 0


def test_registered_domains_and_empty_hosts(spark):
    """Bad hosts of one registered domain do not taint their neighbours under the same public suffix."""
    rows = [(i, f"http://h{i}.bad.co.uk/x") for i in range(45)] + [(100 + i, f"http://www.good{i}.co.uk:80/") for i in range(5)] + [(200, None), (201, "nothing"), (202, "http://9.9.9.9:4/"), (203, "http:///p")]
    pages = spark.createDataFrame(rows, "page_id long, url string")
    labels = spark.createDataFrame([(i, 0, 1) for i in range(45)] + [(100 + i, 1, 0) for i in range(5)] * 20 + [(200, 0, 1)] * 40, "doc_id long, quality int, toxic int")
    got = {r.page_id: r for r in urls.filter_urls(pages, labels).collect()}
    assert all(got[100 + i].verdict == "allow" for i in range(5)) and all(got[i].verdict == "block" for i in range(45))
    assert all((got[i].verdict, got[i].n_labelled, got[i].bad_bound) == ("allow", None, None) for i in (200, 201, 203)) and got[202].n_labelled == 0
    names = spark.createDataFrame([("a.b.co.uk:8080",), ("b.co.uk",), ("co.uk",), ("x.y.com",), ("localhost",), ("10.0.0.1:80",), ("",)], "h string")
    assert [tuple(r) for r in names.select(*urls.levels(names.h)).collect()] == [("b.co.uk", "co.uk"), ("b.co.uk", "co.uk"), ("co.uk", "co.uk"), ("y.com", "com"), ("localhost", "localhost"), ("10.0.0.1", ""), ("", "")]


# ---- embeddings


def test_embeddings(spark):
    rng = np.random.default_rng(4)
    base = rng.standard_normal((60, 16))
    rows, k = [], 0
    for i, b in enumerate(base):
        for _ in range(1 if i < 40 else 12 if i < 59 else 700):
            rows.append((k, (b + rng.standard_normal(16) * 0.12).astype(np.float32).tolist(), i % 3))
            k += 1
    rows += [(k, rows[0][1], rows[0][2]), (k + 1, None, 1), (k + 2, [0.0] * 16, 1), (k + 3, [float("nan")] * 16, 1), (k + 4, rows[0][1], None), (k + 5, [None] * 16, 0), (k + 6, [], 0)]
    df = spark.createDataFrame([(*r, 0) for r in rows], "vec_id long, embedding array<float>, label int, n_links int")
    got = {r.vec_id: r for r in embeddings.near_duplicates(df, passes=embeddings.Passes(block=64, tile=100)).collect()}
    good = [r for r in rows if r[0] <= k]
    x = np.array([r[1] for r in good], float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    lab = np.array([r[2] for r in good])
    near = (x @ x.T >= 0.93) & (lab[:, None] == lab)
    np.fill_diagonal(near, False)
    links = near.sum(axis=1)
    found = np.array([got[r[0]].n_links for r in good])
    assert (found <= links).all() and found.sum() >= 0.97 * links.sum()
    least = np.arange(len(good))
    for _ in range(len(good)):
        new = np.minimum(least, np.where(near, least, len(good)).min(axis=1))
        if (new == least).all():
            break
        least = new
    same = np.array([got[r[0]].component_id for r in good]) == least
    assert same.mean() >= 0.97
    for i in range(k + 1, k + 7):
        assert (got[i].n_links, got[i].component_id, got[i].kept) == (0, i, True)
    assert embeddings.near_duplicates(df.limit(0)).count() == 0


def test_huge_and_tiny_components(spark):
    """Squares of these components over- or underflow; their cosines do not."""
    rows = [(0, [1e-200, 2e-200, 0.0]), (1, [2e-200, 1e-200, 0.0]), (2, [0.0, 0.0, 1e200]), (3, [0.0, 0.0, 2e200]), (4, [0.0, 0.0, 5e-324]), (5, [1.0, -1.0, 0.0]), (6, [0.0, 0.0, -1.0])]
    df = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<double>, label int")
    got = {r.vec_id: (r.n_links, r.component_id) for r in embeddings.near_duplicates(df).collect()}
    assert got == {0: (0, 0), 1: (0, 1), 2: (2, 2), 3: (2, 2), 4: (2, 2), 5: (0, 5), 6: (0, 6)}


def test_recall_in_a_large_group():
    """Planted pairs just over the threshold among 200,000 vectors of one label, by the passes of that size."""
    rng = np.random.default_rng(8)
    p, n, pairs = embeddings.Passes(), 200_000, 300
    x = rng.standard_normal((n, 64)).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    other = rng.standard_normal((pairs, 64))
    other -= (other * x[:pairs]).sum(axis=1, keepdims=True) * x[:pairs]
    other /= np.linalg.norm(other, axis=1, keepdims=True)
    x[n - pairs :] = 0.935 * x[:pairs] + math.sqrt(1 - 0.935**2) * other
    found = np.zeros(pairs, bool)
    weights = np.int64(1) << np.arange(62, -1, -1, dtype=np.int64)
    for number in range(embeddings.needed(p, n)):
        sig = ((x @ embeddings.planes(p, number, 64).astype(np.float32) > 0) * weights).sum(axis=1)
        rank = np.empty(n, np.int64)
        rank[np.argsort(sig, kind="stable")] = np.arange(n)
        found |= np.abs(rank[:pairs] - rank[n - pairs :]) <= p.window
    assert found.mean() >= 0.99


# ---- scoring


class PlainCoder:
    """The model of op3 one decision at a time, on dictionaries of counts; it is given the learnt weights and map."""

    def __init__(self, texts, learnt, s, classes, mixer):
        self.s, self.mixer, self.classes = s, mixer, classes
        self.texts = [[*(w + b" " for w in (t or "").encode().lower().split()), contextmix.END] for t in texts]
        self.hash = {w: int(contextmix.hashed([w])[0]) for t in self.texts for w in t}
        self.learnt = learnt
        self.words, self.tree, self.cells = Counter(), Counter(), Counter()
        self.of = []
        for t in self.texts:
            fit = [sum(classes.logs[k][self.hash[w] % s.buckets] for w in t) + classes.shares[k] for k in range(s.classes)]
            self.of.append(max(range(s.classes), key=lambda k: (fit[k], -k)))
        for t, known, k in zip(self.texts, learnt, self.of):
            for w in t if known else ():
                self.words[w] += 1
                bits = "".join(f"{b:08b}" for b in w)
                for d in range(len(bits) + 1):
                    self.tree[k, bits[:d]] += 1
        for w, n in self.words.items():
            for d, (bit, cells) in enumerate(self.decisions(w)):
                for c in cells:
                    self.cells[c, bit] += n
        self.contexts = {}
        for t, known in zip(self.texts, learnt):
            for context, passage, _ in self.segments(t):
                if context and known:
                    self.contexts.setdefault(context, Counter())[passage] += 1
        self.met = Counter(c for t in self.texts for c, _, _ in self.segments(t))

    def decisions(self, word):
        bits = contextmix.Bits([word], self.s)
        return [(int(b), tuple(int(x) for x in bits.cells[:, i])) for i, b in enumerate(bits.bit)]

    def cost(self, word, k):
        s, total = self.s, 0.0
        bits = "".join(f"{b:08b}" for b in word)

        def odds(own, every):
            return math.log((own + contextmix.DELTA) / (max(every - own, 0) + contextmix.DELTA))

        def level(n):
            return sum(n >= x for x in contextmix.LEVELS)

        def sure(own, every):
            return own <= 0 or own >= every

        n = len(contextmix.LEVELS) + 1
        for d, (bit, cells) in enumerate(self.decisions(word)):
            x = [round(min(12, max(-12, math.log((self.cells[c, 1] + 0.2) / (self.cells[c, 0] + 0.2)))) * 10) / 10 * (1 if bit else -1) for c in cells]
            every, own = (sum(self.tree[j, bits[:e]] for j in range(s.classes)) for e in (d, d + 1))
            every_k, own_k = (self.tree[k, bits[:e]] for e in (d, d + 1))
            x += [odds(own, every), odds(own_k, every_k) if every_k else 0.0]
            gate = ((level(every) * n + level(every_k)) * 2 + sure(own, every)) * 2 + sure(own_k, every_k)
            mix = sum(a * float(w) for a, w in zip(x, self.mixer.weights[gate]))
            mix = max(-contextmix.CLIP, min(contextmix.CLIP, round(mix * contextmix.FINE) / contextmix.FINE))
            at = min(abs(mix) * contextmix.KNOTS / contextmix.CLIP, contextmix.KNOTS - 1e-3)
            row, low = self.mixer.map[gate], int(at)
            curve = float(row[low]) + (float(row[low + 1]) - float(row[low])) * (at - low)
            refined = (mix + (curve if mix > 0 else -curve if mix < 0 else 0.0)) / 2
            total += math.log1p(math.exp(-refined))
        return total

    def segments(self, text):
        mask = (1 << 64) - 1

        def mix(x):
            x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 & mask
            x = (x ^ x >> 27) * 0x94D049BB133111EB & mask
            return x ^ x >> 31

        h = [self.hash[w] for w in text]
        context = [mix(h[i - 1] + mix(h[i - 2] + mix(h[i - 3]) & mask) & mask) if i >= 3 else 0 for i in range(len(h))]
        starts = [i for i in range(len(h)) if i == 0 or i == 3 or (i > 3 and context[i] % self.s.spacing == 0)]
        out = []
        for a, b in zip(starts, [*starts[1:], len(h)]):
            passage = sum(mix(h[i] + (i - a) * 0x9E3779B97F4A7C15 & mask) for i in range(a, b)) & mask
            out.append((context[a] | 1 if a else 0, passage, text[a:b]))
        return out

    def score(self, i, prior):
        """Log10 probability of a text: classes by every word, passages by every anchor."""
        s = self.s
        gates, total = list(prior), 0.0
        weights, good, tried, latest = list(contextmix.OWN_WEIGHTS), 0.0, 0.0, 0.0
        own, before = Counter(), Counter()
        parts = self.segments(self.texts[i])
        likely = {c: max(n.items(), key=lambda x: (x[1], x[0] - (1 << 64) if x[0] >> 63 else x[0])) for c, n in self.contexts.items() if self.met[c] > 1}
        for c, p, _ in parts if self.learnt[i] else ():
            own[c] += 1
            own[c, p] += 1
        for c, p, words in parts:
            cost = 0.0
            for w in words:  # word by word: the classes' posterior
                p_k = [g * math.exp(-self.cost(w, k)) for k, g in enumerate(gates)]
                cost -= math.log(sum(p_k))
                gates = [x / sum(p_k) for x in p_k]
            gates = [(1 - s.share) * g + s.share * q for g, q in zip(gates, prior)]
            if c in likely:
                top, n = likely[c]
                n_top = n - own[c, top] + before[c, top]
                n_all = sum(self.contexts[c].values()) - own[c] + before[c]
                hit = p == top
                if n_top > 0:
                    x = [math.log((n_top + 0.4) / (n_all - n_top + 0.4)), math.log((good + 0.4) / (tried - good + 0.4)), latest]
                    odds = max(-contextmix.CLIP, min(contextmix.CLIP, sum(a * b for a, b in zip(x, weights))))
                    cost = math.log1p(math.exp(-odds)) if hit else math.log1p(math.exp(odds)) + cost
                    step = s.own_rate * (hit - 1 / (1 + math.exp(-odds))) / (1 + sum(a * a for a in x))
                    weights = [w + step * a for w, a in zip(weights, x)]
                    good, tried, latest = 0.9 * good + hit, 0.9 * tried + 1, 2 * hit - 1
            before[c] += 1
            before[c, p] += 1
            total += cost
        return -total / math.log(10)


@pytest.fixture(scope="module")
def scored(spark):
    rng = random.Random(5)
    vocab = [["".join(rng.choices("abcdefgh" if k else "ghijklm", k=rng.randint(2, 8))) for _ in range(300)] for k in range(2)]
    rows = [(i, " ".join(rng.choices(vocab[i % 2], [1 / (j + 1) for j in range(300)], k=rng.randint(0, 400)))) for i in range(200)]
    rows += [(300 + i, rows[i][1]) for i in range(8, 40, 2)] + [(400, " ".join(["aa bb cc dd ee"] * 60)), (1000, None), (None, "ab cd"), (1001, "Zz zZ é▁"), (1002, "x" * 3000)]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "doc_id long, text string, score string")
    s = contextmix.Settings(cells=(12, 14, 16), classes=3, seeds=60, sample=800, spacing=8, part=150)
    return rows, df, s, contextmix.score(df, settings=s).collect()


def test_context_mixing(spark, docs, scored):
    rows, df, s, got = scored
    train = [t or "" for i, t in rows if i is not None and zlib.crc32(str(i).encode()) % 5 != 1]
    c = Counter(w for t in train for w in [*t.lower().split(), "\n"])
    n, v = sum(c.values()), len(c)
    by = {r.doc_id: r for r in got}
    for i, t in rows:
        words = [*(t or "").lower().split(), "\n"]
        assert by[i].n_tokens == len(words) and by[i].n_known == sum(c[w] > 0 for w in words) and by[i].train_tokens == n
        assert math.isclose(by[i].base_score, sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in words), rel_tol=1e-9)
        assert by[i].score < 0
    held = [r for r in got if r.held_out and r.n_tokens > 50]
    assert held and sum(r.bits_per_byte for r in held) / len(held) < 3
    # a text that comes twice is told from one that comes once, learnt from or not
    twice = [by[300 + i].bits_per_byte for i in range(8, 40, 2) if by[i].n_tokens > 50 and zlib.crc32(str(i).encode()) % 5 != 1]
    once = [by[i].bits_per_byte for i in range(40, 200) if by[i].n_tokens > 50]
    assert max(twice) < min(once) / 2
    joined = {r.doc_id: r for r in contextmix.score(df, settings=contextmix.Settings(**(s.__dict__ | {"broadcast_words": 0}))).collect()}
    assert all(math.isclose(joined[i].base_score, by[i].base_score, rel_tol=1e-9) and math.isclose(joined[i].score, by[i].score, rel_tol=1e-9) and joined[i].n_known == by[i].n_known for i in by)
    other = {r.doc_id: r for r in contextmix.score(df.repartition(5), settings=s).collect()}
    assert all(math.isclose(other[i].score, by[i].score, rel_tol=1e-6) for i in by)
    assert len(contextmix.score(docs).collect()) == len(TEXTS) + 1 and contextmix.score(docs.limit(0)).count() == 0


def test_score_against_a_plain_coder(spark, scored, monkeypatch):
    """Every text's score, bit by bit and word by word from dictionaries of counts."""
    rows, df, s, got = scored
    held = {}
    fit, learn = contextmix.fit_classes, contextmix.learn
    monkeypatch.setattr(contextmix, "fit_classes", lambda *a: held.setdefault("classes", fit(*a)))
    monkeypatch.setattr(contextmix, "learn", lambda *a: held.setdefault("mixer", learn(*a)))
    again = {r.doc_id: r for r in contextmix.score(df, settings=s).collect()}
    learnt = [i is not None and zlib.crc32(str(i).encode()) % 5 != 1 for i, _ in rows]
    coder = PlainCoder([t for _, t in rows], learnt, s, held["classes"], held["mixer"])
    share = Counter()
    for t, known, k in zip(coder.texts, learnt, coder.of):
        share[k] += len(t) * known
    prior = [(share[k] + 1) / (sum(share.values()) + s.classes) for k in range(s.classes)]
    some = [j for j, (i, t) in enumerate(rows) if i is None or i >= 300 or i % 9 == 0]
    for j in some:
        want = coder.score(j, prior)
        # half-precision class costs, single-precision sums
        assert math.isclose(again[rows[j][0]].score, want, rel_tol=4e-3, abs_tol=0.05), (rows[j][0], again[rows[j][0]].score, want)


def test_word_order_counts(spark):
    """Passages are contexts across words: the words of a known text in another order cost more."""
    rng = random.Random(9)
    texts = [" ".join(f"w{rng.randrange(400)}" for _ in range(120)) for _ in range(60)]
    held = next(i for i in range(100, 200) if zlib.crc32(str(i).encode()) % 5 == 1)
    known = next(i for i in range(60) if zlib.crc32(str(i).encode()) % 5 != 1)
    mixed = texts[known].split()
    rng.shuffle(mixed)
    rows = [*enumerate(texts), (held, texts[known]), (held + 1000, " ".join(mixed))]
    got = {r.doc_id: r for r in contextmix.score(spark.createDataFrame(rows, "doc_id long, text string"), settings=contextmix.Settings(cells=(10, 12, 12), classes=2, seeds=30, sample=300)).collect()}
    assert got[held].bits_per_byte < 0.7 * got[held + 1000].bits_per_byte


def test_probabilities_add_up():
    """Whatever was learnt, a decision's two outcomes have probabilities that add up to 1."""
    rng = np.random.default_rng(6)
    n = 2000
    mixer = contextmix.Mixer(np.zeros(1, np.int8), rng.normal(0.3, 1, (contextmix.GATES, contextmix.INPUTS)).astype(np.float32), np.sort(rng.uniform(0, 14, (contextmix.GATES, contextmix.KNOTS + 1)), axis=1).astype(np.float32))
    mixer.map[:, 0] = 0
    mixer.table()
    odds = rng.normal(0, 3, (contextmix.INPUTS, n)).astype(np.float32)
    gate = rng.integers(0, contextmix.GATES, n).astype(np.int16)
    assert np.allclose(np.exp(-mixer.cost(odds, gate)) + np.exp(-mixer.cost(-odds, gate)), 1, atol=1e-6)


def test_totals_across_partitions():
    """Counts of shared prefixes by brute force, in chunks, and over the borders of partitions."""
    rng = random.Random(3)
    words = sorted({bytes(rng.choices(b"ab\x03z", k=rng.randint(1, 9))) + b" " for _ in range(400)} | {contextmix.END})
    counts = np.array([[rng.randint(0, 3) for _ in range(3)] for _ in words], float)
    bits = ["".join(f"{b:08b}" for b in w) for w in words]
    whole = contextmix.Ordered(words, counts, contextmix.Edge.none(3))
    rows, begin = whole.chunk(0, len(words))
    for i in rng.sample(range(len(words)), 25):
        for d in range(len(bits[i]) + 1):
            assert np.allclose(rows[begin[i] + d], sum(counts[j] for j in range(len(words)) if bits[j][:d] == bits[i][:d]))
        assert np.allclose(whole.single(i), rows[begin[i] : begin[i] + len(bits[i]) + 1])
    for a, b in ((0, 50), (50, 51), (51, 200), (200, len(words))):
        got, _ = whole.chunk(a, b)
        assert np.allclose(got, rows[begin[a] : begin[b] if b < len(words) else None])


# ---- pieces


def test_samples_round_trip(spark, docs):
    got = pieces.sample_encodings(docs).collect()
    assert all(r.round_trip for r in got)
    seen = {}
    for r in got:
        seen.setdefault((r.doc_id, r.sample), []).append(r)
    assert {r.sample for r in got if r.doc_id == 0} == {1, 2, 3, 4}
    assert [(r.n_tokens, r.log_prob, r.log_inclusion) for r in got if r.doc_id == 1] == [(0, 0.0, 0.0)]
    assert len({tuple(r.ids) for r in got if r.doc_id == 0}) == 4
    again = {(r.doc_id, r.sample): r.ids for r in pieces.sample_encodings(docs.repartition(5)).where("doc_id is not null").collect()}
    assert all(again[r.doc_id, r.sample] == r.ids for r in got if r.doc_id is not None)
    assert pieces.sample_encodings(docs.limit(0)).count() == 0
    plain = pieces.encode(docs.where("doc_id = 5"))
    assert pieces.decode(plain.withColumnRenamed("ids", "ids")).first().text == TEXTS[5]


def test_samples_follow_the_lattice():
    """On a short text: probabilities are those of brute-force enumeration, first draws follow them,
    and inclusion scores estimate how often a segmentation is drawn."""
    v, s = pieces.vocabulary(), pieces.Sampling(samples=2)
    ids = {p: i for i, p in enumerate(v.pieces) if p and i > 258}
    text = b" the"

    def cuts(t):
        return [[]] if not t else [[t[:n], *rest] for n in range(1, len(t) + 1) if t[:n] in ids for rest in cuts(t[n:])]

    every = cuts(text)
    weight = np.array([math.exp(s.alpha * sum(v.weight[ids[p]] for p in c)) for c in every])
    p = dict(zip((tuple(ids[x] for x in c) for c in every), weight / weight.sum()))
    n = 4000
    lattice, rounds, after = pieces.Encoder(v, s)(["the"] * n, np.arange(n, dtype=np.uint64))
    first, both = Counter(), Counter()
    for texts, path in rounds:
        tokens, counts = pieces.token_ids(path, lattice, v)
        ends = np.cumsum(counts)
        for i, (a, b) in enumerate(zip(ends - counts, ends)):
            seg = tuple(tokens[a:b].tolist())
            assert math.isclose(path.log_prob[i], math.log(p[seg]), rel_tol=1e-6, abs_tol=1e-9)
            both[seg] += 1
            first[seg] += texts is rounds[0][0]
    for seg, q in p.items():
        assert abs(first[seg] / n - q) < 0.04
        others = sum(p[o] / (1 - p[o]) * q for o in p if o != seg)
        assert abs(both[seg] / n - (q + others)) < 0.04


def test_long_words_and_slices():
    """A word is one lattice however long, and neither slices nor what a worker saw before change a text's samples."""
    v, s = pieces.vocabulary(), pieces.Sampling()
    rng = random.Random(2)
    texts = ["https://" + "".join(rng.choices("abcde/", k=300)), "the thing " * 50, "x" * 5000, " " * 40 + "end", "été 漢字 \n\n tail  ", "the thing is the thing"]
    keys = np.arange(len(texts), dtype=np.uint64) + np.uint64(5)

    def ids(encoder, some):
        lattice, rounds, after = encoder([texts[i] for i in some], keys[some])
        out = {}
        for r, (at, path) in enumerate(rounds):
            tokens, counts = pieces.token_ids(path, lattice, v)
            ends = np.cumsum(counts)
            for i, a, b in zip(at, ends - counts, ends):
                out[int(some[i]), r] = tokens[a:b].tolist()
            assert pieces.Decoder(v)(tokens, counts) == [texts[some[i]].encode() for i in at]
        return out

    together = ids(pieces.Encoder(v, s), np.arange(len(texts)))
    encoder, apart = pieces.Encoder(v, s), {}
    for i in (3, 1, 0, 5, 2, 4):
        apart |= ids(encoder, np.array([i]))
    assert together == apart
    assert len(re.findall(pieces.UNIT, " " + texts[0])) == 1
