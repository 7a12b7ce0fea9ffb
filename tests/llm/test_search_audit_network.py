"""Ranked search, the filter audit and the quality network against plain Python."""

import math
import re
from collections import Counter
from itertools import permutations

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidemark.llm import audit, convnet, langid, ranked, text


def test_long_words_with_equal_sums_differ():
    def word(a, b):
        return "".join(b if bin(i).count("1") % 2 else a for i in range(1024))

    data = np.frombuffer((word("a", "b") + word("b", "a") + word("a", "b")).encode(), np.uint8)
    h = text.span_hashes(data, np.array([0, 1024, 2048]), np.array([1024, 2048, 3072]))
    assert h[0] == h[2] != h[1]


# ---------------------------------------------------------------- search


@pytest.mark.parametrize("seed", range(6))
def test_interval_search_equals_full_scores(seed):
    rng = np.random.default_rng(seed)
    docs, terms = int(rng.integers(1, 400)), int(rng.integers(1, 30))
    cell = np.flatnonzero(rng.random(docs * terms) < rng.choice([0.02, 0.3, 0.9]))
    doc, term = cell // terms, cell % terms
    impact = rng.integers(0, 5 if seed % 2 else 10**9, len(cell))
    index = ranked.Postings(doc, term, impact, docs)
    for wanted in (np.arange(terms), np.arange(0, terms, 3)):
        scores = np.bincount(doc, np.where(np.isin(term, wanted), impact, 0), docs).astype(int)
        best = sorted(((-s, d) for d, s in enumerate(scores.tolist()) if s > 0))[:10]
        for wide in (4, 1024):
            d, s = ranked.search(index, wanted, 10, 1, wide)
            assert sorted(zip((-s).tolist(), d.tolist()))[:10] == best


def plain_search(docs, items):
    def terms(t):
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
        return re.findall(r"[0-9a-z\x80-\U0010ffff]+", low)

    read = [(i, Counter(terms(t))) for i, t in docs if terms(t)]
    n_docs, total = len(read), sum(sum(c.values()) for _, c in read)
    df = Counter(t for _, c in read for t in c)
    out = []
    for item, t in items:
        rows = []
        for i, c in read:
            m = 10 + (90 * sum(c.values()) * n_docs) // total
            score = sum(
                math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[w] + 1))) * ((10**9 * c[w]) // (1000 * c[w] + 8 * m))
                for w in set(terms(t)) if w in c
            )
            if score > 0:
                rows.append((-score, i is None, i or 0, i))
        out += [(item, k + 1, r[3], -r[0]) for k, r in enumerate(sorted(rows)[:10])]
    return sorted(map(str, out))


def test_search_in_small_blocks(spark):
    rng = np.random.default_rng(5)
    words = ["Aa", "bb", "c9", "d", "eé", "f", "g", "h", "日本", "j_k"]
    docs = [(i % 70, " ".join(rng.choice(words, rng.integers(0, 30)))) for i in range(90)]
    docs += [(None, "aa bb c9"), (500, None), (501, "--- ..."), (502, "aa BB c9"), (503, "aa bb c9")]
    items = [(1, "aa bb, c9!"), (1, "aa bb, c9!"), (2, "f g aa zzz"), (3, None), (4, "zzz"), (None, "Eé 日本 j")]
    d = spark.createDataFrame([(*r, "x", 1) for r in docs], "doc_id long, text string, score string, rank int").repartition(5)
    b = spark.createDataFrame(items, "item_id long, text string")
    for rule in (ranked.SearchRule(), ranked.SearchRule(postings=40, item_bytes=20, wide=4)):
        got = ranked.search_documents(d, b, rule).select("item_id", "rank", "doc_id", "score").collect()
        assert sorted(str(tuple(r)) for r in got) == plain_search(docs, items)


# ---------------------------------------------------------------- audit


def plain_audit(rows, labels):
    good = {i for i, q, t in labels if q == 1}
    toxic = {i for i, q, t in labels if t == 1}
    least = {}
    for i, t, _ in rows:
        if i is not None:
            least[t or ""] = min(i, least.get(t or "", i))
    fails = []
    for i, t, part in rows:
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        f = ""
        f += "A" if len(w) < 200 else ""
        f += "B" if 100 * len(set(w)) < 50 * len(w) else ""
        f += "C" if 100 * sum("A" <= c <= "Z" for c in t) > 2 * len(t) else ""
        f += "D" if set(t) & set("#$%&*|") else ""
        f += "E" if i is not None and i > least[t] else ""
        fails.append((part or "", f, i in good, i in toxic))
    out = set()
    for part in {f[0] for f in fails}:
        own = [f for f in fails if f[0] == part]
        for order in permutations("ABCDE"):
            for k, x in enumerate(order):
                gone = lambda f: any(y in f for y in order[:k])  # noqa: B023, E731
                here = [f for f in own if x in f[1] and not gone(f[1])]
                out.add((
                    part, "".join(order), k + 1,
                    sum(x not in f[1] and not gone(f[1]) for f in own), len(here),
                    sum(x in f[1] and gone(f[1]) for f in own), sum(f[1] == x for f in own),
                    sum(f[2] for f in here), sum(f[3] for f in here), sum(120 // len(f[1]) for f in own if x in f[1]),
                ))
    return out


def test_audit_retracts(spark, tmp_path):
    """Smaller ids come in later files, so that counts are taken back; the result is that of one batch."""
    rng = np.random.default_rng(8)
    texts = [" ".join(rng.choice(list("abcdefgh"), 250)), " ".join(f"w{i}" for i in range(250)), "SHORT #1", "", None, "x" * 70_000]
    texts += [" ".join(f"v{i * k}" for i in range(210)) + " | A" for k in range(1, 4)]
    rows = [(int(300 - 2 * k + rng.integers(0, 5)), texts[rng.integers(0, len(texts))], f"p{k % 3}") for k in range(150)]
    rows += [(None, texts[1], None), (None, texts[1], ""), (rows[-1][0], rows[-1][1], "p9"), (7, texts[1], "p1"), (7, texts[1], "p1")]
    labels = [(i, i % 2, i % 3 == 0) for i in range(300)] + [(4, 1, 1), (None, 1, 1)]
    table = spark.createDataFrame([(*r, "clash") for r in rows], "doc_id long, text string, source string, mask string")
    for k in range(6):
        part = spark.createDataFrame([(*r, "clash") for r in rows[k * 26 : (k + 1) * 26]], table.schema).coalesce(1)
        part.write.mode("append").parquet(f"{tmp_path}/many")
    table.coalesce(1).write.parquet(f"{tmp_path}/one")
    lab = spark.createDataFrame([(i, q, int(t)) for i, q, t in labels], "doc_id long, quality int, toxic int")
    want = plain_audit(rows, labels)
    for name, batches in (("many", 6), ("many", 2), ("one", 4)):
        stream = audit.document_stream(spark, f"{tmp_path}/{name}", batches)
        got = audit.audit_filters(stream, lab, slots=4)
        assert {tuple(r) for r in got.collect()} == want and got.count() == len(want)
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    assert "RocksDB" not in before


def test_audit_of_nothing(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, source string").write.parquet(f"{tmp_path}/docs")
    lab = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert audit.audit_filters(audit.document_stream(spark, f"{tmp_path}/docs"), lab, 8).collect() == []


# ---------------------------------------------------------------- quality network

SMALL = convnet.QualityRule(embed=3, width=4, filters=5, hidden=4, chunk=16, lanes=3)


def plain_score(network, raw):
    rule = network.rule
    stride = rule.chunk - rule.width + 1
    chunks = [raw[a : a + rule.chunk] for a in range(0, max(len(raw) - rule.width + 1, 1), stride)]
    values = []
    for c in chunks:
        c = c + bytes(rule.chunk - len(c))
        best = [
            max(
                float(np.concatenate([network.table[x] for x in c[i : i + rule.width]]) @ network.filter[:, f])
                for i in range(rule.chunk - rule.width + 1)
            )
            + network.filter_bias[f]
            for f in range(rule.filters)
        ]
        values.append(np.maximum(np.maximum(best, 0) @ network.mixed + network.mixed_bias, 0))
    joint = np.concatenate([np.max(values, axis=0), np.mean(values, axis=0)])
    return 1 / (1 + math.exp(-(joint @ network.out + network.out_bias[0] + network.prior)))


def test_network_scores_whole_texts():
    network = convnet.ByteConvolution(SMALL)
    network.prior = 0.3
    rng = np.random.default_rng(2)
    texts = ["", "a", "abcd", "x" * 16, "y" * 17] + ["".join(rng.choice(list("ab é日"), n)) for n in (13, 29, 30, 200)]
    got = network.score(pa.array([*texts, None]))
    for t, s in zip([*texts, ""], got):
        assert s == pytest.approx(plain_score(network, t.encode()), abs=2e-5)
    assert network.score(pa.array([], pa.string())).tolist() == []


def test_network_slope():
    network = convnet.ByteConvolution(SMALL)
    for name in network.NAMES:
        setattr(network, name, getattr(network, name).astype(float))
    rng = np.random.default_rng(4)
    data = rng.integers(97, 101, (7, 16)).astype(np.uint8)
    starts, labels = np.array([0, 1, 4]), np.array([1, 0, 1])
    _, slope = network.gradients(data, starts, labels)
    for name in network.NAMES:
        value = getattr(network, name)
        for at in [tuple(rng.integers(0, n) for n in value.shape) for _ in range(6)] + ([(98, 1)] if name == "table" else []):
            kept = value[at]
            losses = []
            for move in (1e-5, -1e-5):
                value[at] = kept + move
                losses.append(network.gradients(data, starts, labels)[0])
            value[at] = kept
            assert slope[name][at] == pytest.approx((losses[0] - losses[1]) / 2e-5, abs=2e-6)


def test_network_held_out(spark):
    folder = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    held_out = F.crc32(F.col("doc_id").cast("string")) % 4 == 2
    network = convnet.fit_quality(docs.filter(~held_out), labels.filter(~held_out), convnet.QualityRule(steps=150))
    rows = convnet.score_quality(docs.filter(held_out), network).join(labels, "doc_id").collect()
    right = [(r.quality, (r.score >= 0.7) == (r.quality == 1)) for r in rows]
    assert np.mean([ok for q, ok in right if q == 1]) > 0.95 and np.mean([ok for q, ok in right if q == 0]) > 0.75


# ---------------------------------------------------------------- language network


def test_language_network_against_a_loop():
    rule = langid.LanguageRule(hidden=3, segment=7, lanes=2)
    network = langid.ByteNetwork(3, ["x", "y"], 1)
    gate = lambda v: 0.5 + 0.5 * langid.squash(v / 2)

    def states(raw, way):
        h, out = np.zeros(3), []
        for byte in raw:
            e, u = network.table[way][:, byte], network.state[way] @ h
            z, r = gate(e[:3] + u[:3]), gate(e[3:6] + u[3:6])
            n = langid.squash(e[6:] + r * (u[6:] + network.bias[way][:, 0]))
            h = (1 - z) * n + z * h
            out.append(h)
        return out

    texts = ["", "a", "abcdefg", "hello é world, this is long", "x" * 15]
    got = network.pooled(pa.array(texts), rule)
    for t, p in zip(texts, got):
        raw, total = t.encode(), np.zeros(2)
        for k in range(0, len(raw), rule.segment):
            piece = raw[k : k + rule.segment]
            for a, b in zip(states(piece, 0), states(piece[::-1], 1)[::-1]):
                s = network.out @ np.concatenate([a, b]) + network.out_bias[:, 0]
                total += np.exp(s) / np.exp(s).sum()
        assert p == pytest.approx(total / max(len(raw), 1), abs=1e-4)
