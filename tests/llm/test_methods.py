"""Operators that SQL cannot express, against plain Python."""

import random
import zlib
from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidemark.llm import decontaminate, jaccard, langid, packing, secrets, tokencount, urlfilter
from tidemark.llm.components import components
from tidemark.llm.queries import QUERIES, tokenizer_file
from tidemark.llm.text import utf8

BPE, UNIGRAM = tokenizer_file("byte_bpe_50k.json"), tokenizer_file("piece_bpe_32k.model")


def copies(seed, groups=12, size=120):
    """Texts in groups of copies with few, some and many edits, a line that all share, and short texts."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 6)))
    shared = " ".join(word() for _ in range(12))
    texts = []
    for g in range(groups):
        base = [word() for _ in range(size)]
        for _ in range(rng.choice([1, 2, 6, 25])):
            own = list(base)
            for _ in range(rng.choice([0, 0, 1, 2, 3, 4, 6, 20])):
                own[rng.randrange(size)] = word()
            texts.append(" ".join([*own, shared]))
    return [*texts, "one two", "One TWO", "one", "", None, "one two three", "one two three four"]


@pytest.mark.parametrize("seed,words,percent,cheap", [(1, 3, 90, 8), (2, 3, 90, 0), (3, 5, 80, 1), (4, 2, 50, 0)])
@pytest.mark.parametrize("compare", [0.25, 100.0])
def test_jaccard_components(spark, seed, words, percent, cheap, compare):
    texts = copies(seed)
    rule = jaccard.JaccardRule(words=words, at_least=percent, cheap=cheap, compare=compare)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.jaccard_join(docs, rule).collect()}
    sets = []
    for t in texts:
        w = (t or "").lower().split()
        sets.append({tuple(w[i : i + words]) for i in range(len(w) - words + 1)} if len(w) >= words else {tuple(w)} - {()})
    root = list(range(len(sets)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in combinations(range(len(sets)), 2):
        if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
            x, y = sorted((find(a), find(b)))
            root[y] = x
    assert got == {i: (len(s), find(i)) for i, s in enumerate(sets)}


def test_jaccard_takes_the_k_of_least_cost(spark):
    rule = jaccard.JaccardRule()
    doublings = [2, 4, 8, 16, 32]
    rng = random.Random(5)
    held, sets, label = [], {}, {}
    for i in range(80):
        n = rng.randint(1, 120)
        common = rng.randint(rule.least(n), n)
        longest = common - rule.least(n) + min(32, rule.least(n))
        tokens = sorted(rng.sample(range(1000), longest), reverse=True)
        label[i] = rng.choice([0, 0, 1, i])
        sets[i] = (n, common, tokens)
        held += [(i, n, common, rank, token, label[i]) for rank, token in enumerate(tokens)]
    pairs = [p for p in combinations(range(80), 2) if label[p[0]] != label[p[1]] and rng.random() < 0.05 * (p[0] % 4)]
    rows = spark.createDataFrame(held, "node long, n long, common long, rank long, token long, label long")
    rows = rows.join(jaccard._others(rows, rule), ["token", "label"])
    got = {r.node: r.k for r in jaccard._own_k(rows, spark.createDataFrame(pairs, "a long, b long"), rule).collect()}

    def prefix(i, k):
        n, common, tokens = sets[i]
        return set(tokens[: max(0, common - rule.least(n) + k)])

    def cost(i, k):
        read = sum(len(prefix(i, k) & prefix(j, k)) for j in sets if label[j] != label[i])
        return read + min(sum(i in p for p in pairs), read / k) * sets[i][0] * rule.compare

    want = {}
    for i in sets:
        if any(i in p for p in pairs):
            want[i] = min([2] + [k for k in doublings[1:] if k <= rule.least(sets[i][0])], key=lambda k: cost(i, k))
    assert got == {i: k for i, k in want.items() if k > 2}
    assert 2 in want.values() and len(set(want.values())) > 2


def test_components_of_a_chain_and_a_star(spark):
    chain = [(i, i + 1) for i in range(0, 60)]
    star = [(100, i) for i in range(101, 160)]
    got = dict(map(tuple, components(spark.createDataFrame(chain + star, "a long, b long")).collect()))
    assert got == {i: 0 for i in range(61)} | {i: 100 for i in range(100, 160)}


def test_leaks_tolerate_substitutions(spark):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    items = [[word() for _ in range(rng.randint(20, 60))] for _ in range(30)]
    docs, want = [], set()
    for d in range(200):
        text = [word() for _ in range(rng.randint(0, 200))]
        if d % 4 == 0:
            item = list(items[d % 30])
            for k in rng.sample(range(len(item)), len(item) // 10):
                item[k] = word()
            text[len(text) // 2 : len(text) // 2] = item
            want.add((d, d % 30))
        elif d % 4 == 1:  # too little to tell
            text += items[d % 30][:9]
        docs.append((d, " ".join(text).upper() if d % 8 == 0 else ", ".join(text)))
    docs = spark.createDataFrame(docs, "doc_id long, text string")
    bench = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(items)], "item_id long, text string")
    for rule in (decontaminate.SeedRule(), decontaminate.SeedRule(block_bytes=500)):
        found = decontaminate.leaks(docs, bench, rule).collect()
        assert {(r.doc_id, r.item_id) for r in found} == want
        assert all(r.n_equal >= 12 and r.n_equal >= 0.8 * r.n_words for r in found)
    kept = {r.doc_id for r in decontaminate.decontaminate(docs, bench).collect()}
    assert kept == set(range(200)) - {d for d, _ in want}


def test_leaks_are_those_of_the_definition():
    """Every hit diagonal against all its stretches: short items, and long ones with an exact run inside."""
    rng = random.Random(9)
    rule = decontaminate.SeedRule()
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(7))

    def changed(item, places):
        return [word() if k in places else w for k, w in enumerate(item)]

    cases = [([f"item{k}" for k in range(16)], {4, 8, 12}, True)]
    for n in (*range(15, 21), 60, 200):
        for rate in (0.1, 0.15, 0.2):
            for _ in range(12):
                item = [word() for _ in range(n)]
                cases.append((item, {k for k in range(n) if rng.random() < rate}, None))
    for _ in range(8):
        item = [word() for _ in range(200)]  # the whole is 76 to 79 % equal, 14 words inside are exact
        at = rng.randrange(20, 160)
        loose = [k for k in range(200) if not at <= k < at + 14]
        cases.append((item, set(rng.sample(loose, rng.randint(42, 48))), True))
    found_short = 0
    for item, places, sure in cases:
        text = changed(item, places)
        index = decontaminate.SeedIndex.of([7], [" ".join(item)], rule.masks)
        found = decontaminate.find_leaks(pa.array([" ".join(["before", *text, "after"])]), index, rule)
        equal = [k not in places for k in range(len(item))]
        hit = any(
            all(equal[k + j] for j, used in enumerate(mask) if used == "1")
            for mask in rule.masks
            for k in range(len(item) - rule.span + 1)
        )
        total = np.concatenate([[0], np.cumsum(equal)])
        least = min(rule.least, -(-len(item) * 9 // 10))
        stretches = [
            (e - s, s, int(total[e] - total[s]))
            for s in range(len(item))
            for e in range(s + 1, len(item) + 1)
            if equal[s] and equal[e - 1] and total[e] - total[s] >= least and 5 * (total[e] - total[s]) >= 4 * (e - s)
        ]
        any_will_do = any(
            total[e] - total[s] >= least and 5 * (total[e] - total[s]) >= 4 * (e - s)
            for s in range(len(item))
            for e in range(s + 1, len(item) + 1)
        )
        assert bool(stretches) == any_will_do
        assert bool(found) == bool(stretches and hit) and (found or not sure)
        if found:
            (_, _, start, n_words, n_equal), longest = found[0], max(stretches)[0]
            assert n_words == longest and (n_words, start - 1, n_equal) in stretches
            found_short += len(item) <= 20
    assert found_short > 100


def unigram(pieces, bytes_known):
    from tokenizers import Tokenizer, models, normalizers, pre_tokenizers

    t = Tokenizer(models.Unigram(pieces, unk_id=0, byte_fallback=bytes_known))
    t.normalizer = normalizers.Sequence([normalizers.Prepend("▁"), normalizers.Replace(" ", "▁")])
    t.pre_tokenizer = pre_tokenizers.Metaspace(prepend_scheme="never", split=True)
    return t


def test_token_counts_of_a_file(spark):
    tokenizer = unigram(tokencount.sentencepiece_pieces(UNIGRAM), True)
    texts = ["a  b", " x ", "日本語 ☃☃ é\n\nq", "", "\x00\x01", "<0x0A><unk> </s>", "a" * 30, "Der Öl-Preis steigt wieder.", " "]
    docs = spark.createDataFrame(list(enumerate([*texts, None])), "doc_id long, text string")
    got = {r.doc_id: r.n_tokens for r in tokencount.count_tokens(docs, UNIGRAM).collect()}
    assert got == {i: len(tokenizer.encode(t).ids) for i, t in enumerate(texts)} | {len(texts): 0}


def test_token_counts_break_ties_like_the_tokenizer():
    rng = random.Random(1)
    names = {"".join(rng.choice("abc") for _ in range(rng.randint(1, 4))) for _ in range(50)} | {"▁", "▁a", "▁ab"}
    pieces = [("<unk>", 0.0)] + [(p, -float(rng.randint(1, 4))) for p in sorted(names)]
    tokenizer, machine = unigram(pieces, False), tokencount.CountViterbi(pieces)
    for _ in range(2000):
        text = "".join(rng.choice("abcdé ") for _ in range(rng.randint(1, 14)))
        want = len(tokenizer.encode(text).ids)
        assert sum(machine.count("▁" + w)[0] for w in text.split(" ")) == want


_ALPHABET = [*"ab '!strevlmd\n\t.,12२é日 　—", "'s", "'re", " '", "'ll", "  ", "<|endoftext|>"]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.lists(st.sampled_from(_ALPHABET), max_size=25).map("".join), max_size=6))
def test_token_ids(texts):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(BPE)
    tokenizer.encode_special_tokens = True
    ids, begins = packing.token_ids(pa.array(texts, pa.string()), BPE)
    got = [ids[a:b].tolist() for a, b in zip(begins[:-1], begins[1:])]
    assert got == [tokenizer.encode(t, add_special_tokens=False).ids for t in texts]


def test_packing_takes_the_tokenizer_as_it_is(spark):
    """Added tokens, and letters and numbers that are newer than Python's tables."""
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(BPE)
    rng = random.Random(6)
    end = "<|endoftext|>"
    texts = [f"stop {end} go", f"{end}{end}", f"a  {end}  's", "<|endof", "text|>", f"<{end}>", "", None]
    signs = [end, "a", "'s", " ", "  ", "'", "1", "\n", "!", "\U0001c89a", "\ua7da", "\U000105c0", "\U00010d40", "\u0378"]
    texts += ["".join(rng.choice(signs) for _ in range(rng.randint(1, 14))) for _ in range(1500)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: (r.doc_tokens, r.ids_crc32) for r in packing.pack(docs, BPE).collect()}
    for i, t in enumerate(texts):
        ids = np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 1], "<u4")
        assert got[i] == (len(ids), zlib.crc32(ids.tobytes())), repr(t)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 40), min_size=16, max_size=16))
def test_columns_hold_the_demand(demand):
    demand = np.array(demand)
    found = packing.generate_columns(demand)
    size = np.arange(1, 17)
    assert sum([p * n for p, n in found], np.zeros(16, int)).tolist() == demand.tolist()
    assert all(p @ size <= 16 and n > 0 for p, n in found)


def test_columns_reach_the_bound():
    demand = np.zeros(16, np.int64)
    demand[[5, 9, 4, 10]] = 3000  # 6 + 10 and 5 + 11 fill a sequence
    assert sum(n for _, n in packing.generate_columns(demand)) == 6000


def test_packing_query(spark, sf):
    from tokenizers import Tokenizer

    out = QUERIES["op5_packing"](spark, sf).toPandas()
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    tokenizer = Tokenizer.from_file(BPE)
    tokenizer.encode_special_tokens = True
    rows = out.sort_values(["doc_id", "start"]).groupby("doc_id")
    assert set(rows.groups) == set(docs)
    for doc, own in rows:
        ids = np.array([*tokenizer.encode(docs[doc], add_special_tokens=False).ids, 1], "<u4")
        at = 0
        for r in own.itertuples():
            assert r.start == at and r.doc_tokens == len(ids)
            assert r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
            at += r.length
        assert at == len(ids)
    for _, own in out.sort_values("offset").groupby("sequence_id"):
        assert own.offset.tolist() == [0, *np.cumsum(own.length)[:-1]] and own.length.sum() <= 2048


def test_shift_and_matches_globs():
    import re

    rng = random.Random(2)
    globs = ["".join(rng.choice("ab?*") for _ in range(rng.randint(0, 9))) for _ in range(60)]
    texts = ["".join(rng.choice("ab") for _ in range(rng.randint(0, 12))) for _ in range(200)]
    data, offsets = utf8(pa.array(texts))
    got = urlfilter.ShiftAnd(globs).matches(data, offsets)
    for k, glob in enumerate(globs):
        pattern = re.compile(glob.replace("?", ".").replace("*", ".*"))
        assert got[:, k].tolist() == [bool(pattern.fullmatch(t)) for t in texts], glob


def test_entropy_spans(spark):
    rng = random.Random(4)
    alphabet = {c.name: c.alphabet for c in secrets.CLASSES}
    table = {c.name: secrets.weights(c.window) for c in secrets.CLASSES}
    base = secrets.CLASSES[1]
    strings = ["".join(rng.choice(alphabet[base.name][: rng.randint(6, 66)]) for _ in range(rng.randint(20, 70))) for _ in range(60)]
    strings = [s + "7q" for s in strings]
    docs = spark.createDataFrame([(i, f"see ({s}) there") for i, s in enumerate(strings)], "doc_id long, text string")
    got = {
        r.doc_id: [(s.start, s.stop) for s in r.spans if s.kind == base.name] for r in secrets.scan_secrets(docs).collect()
    }
    import re

    for i, s in enumerate(strings):
        hot = set()
        if not any(re.search(a, s) for a in secrets.ALLOWED):
            for k in range(len(s) - base.window + 1):
                w = s[k : k + base.window]
                if sum(table[base.name][w.count(c)] for c in set(w)) <= secrets.most(base.window, base.bits):
                    hot.add(k)
        runs = []
        for k in sorted(hot):
            if runs and runs[-1][1] == k - 1:
                runs[-1][1] = k
            else:
                runs.append([k, k])
        assert got[i] == [(5 + a, 5 + b + base.window) for a, b in runs]


def test_network_slopes():
    rng = np.random.default_rng(0)
    net = langid.ByteNetwork(4, ["a", "b", "c"], 1)
    for name in net.NAMES:
        setattr(net, name, getattr(net, name).astype(float))
    data, labels = rng.integers(0, 256, (7, 5)).astype(np.uint8), np.array([0, 1, 2, 0, 1])
    _, slope = net.gradients(data, labels)
    for name in net.NAMES:
        weights = getattr(net, name)
        at = np.unravel_index(np.argmax(np.abs(slope[name])), weights.shape)
        weights[at] += 1e-3
        up = net.gradients(data, labels)[0]
        weights[at] -= 2e-3
        down = net.gradients(data, labels)[0]
        weights[at] += 1e-3
        assert slope[name][at] == pytest.approx((up - down) / 2e-3, rel=1e-2)


def test_languages_of_held_out_texts(spark):
    sf = "/root/testdata/sf0.01"
    found = QUERIES["op1_language_id"](spark, sf)
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang")
    right = found.filter("held_out").join(docs, "doc_id").agg(F.avg((F.col("lang_pred") == F.col("lang")).cast("int")))
    assert right.first()[0] >= 0.97
