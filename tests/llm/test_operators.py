"""Corpus operators against brute force, on rows with nulls, empty and long texts, copies and clashing columns."""

from __future__ import annotations

import base64
import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from dendrospark.llm import decontaminate, hmm, language, packing, sharding, simhash, suffixdedup, topk, toxicity, warc
from dendrospark.llm.common import scratch

RNG = random.Random(4)
WORDS = ["".join(RNG.choice("abcdefghij") for _ in range(RNG.randint(2, 8))) for _ in range(900)]
EXTRA = ", t string, n long, k string, h long, c long, size string, shard string, joined string, row long, symbols string"


def para(n):
    return " ".join(RNG.choice(WORDS) for _ in range(n))


PASSAGES = [para(110) for _ in range(2)]


@pytest.fixture(scope="module")
def texts():
    out = []
    for i in range(30):
        out.append((i, para(RNG.randint(0, 90)) + " " + PASSAGES[i % 2][RNG.randint(0, 40) : RNG.randint(440, 600)] + "é" + para(40)))
    out += [(30, out[3][1]), (31, None), (32, ""), (33, "a" * 3000), (34, "ab" * 700), (35, PASSAGES[0] + PASSAGES[1] + PASSAGES[0]), (36, "ß" * 300), (37, "a" * 399), (38, " \n "), (39, out[4][1].upper())]
    out += [(5, out[5][1]), (None, out[6][1]), (None, "idle words"), (40, para(4000))]
    return out


@pytest.fixture(scope="module")
def docs(spark, texts):
    rows = [(i, t, None if j % 5 == 0 else f"s{j % 3}", "en", 1, *["x" if s.endswith("string") else 7 for s in EXTRA.strip(", ").split(", ")]) for j, (i, t) in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, n_chars long" + EXTRA)


def lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


# 1 ------------------------------------------------------------------------------------------


@pytest.mark.parametrize("targets", [None, {"s0": 5.0, "s1": 1.0}, {"s0": 0.0, "s1": 2.0, "s2": 1.0, None: 1.0}])
def test_packing_round_trip(docs, texts, targets):
    P = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    path = P.path("byte_bpe_50k.json")
    model = Tokenizer.from_file(path)
    model.encode_special_tokens = True
    want = Counter(tuple(model.encode(t or "", add_special_tokens=False).ids + [0]) for _, t in texts)
    rows = packing.pack(docs, path, targets, sequence=64, window_sequences=4).collect()
    places = {}
    for r in rows:
        ids = np.frombuffer(bytes(r.ids), dtype="<u4")
        assert len(ids) == r.length and zlib.crc32(bytes(r.ids)) == r.ids_crc32 and 0 < r.offset + r.length <= 64
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for i, own in places.items():
        at = 0
        for offset, n in sorted(own):
            assert offset == at
            at += n
        assert at == 64 or i == max(places)
    whole = Counter()
    by_doc = {}
    for r in rows:
        by_doc.setdefault((r.doc_id, r.queue, r.doc_tokens), []).append(r)
    assert sum(r.length for r in rows) == sum(len(k) * n for k, n in want.items())
    for own in by_doc.values():
        if sum(r.length for r in own) == own[0].doc_tokens:
            whole[tuple(int(x) for r in sorted(own, key=lambda r: r.start) for x in np.frombuffer(bytes(r.ids), dtype="<u4"))] += 1
    assert not whole - want and sum(whole.values()) >= len(texts) - 4
    served = Counter()
    for r in rows:
        if r.window == 0:
            served[r.queue] += r.length
    assert abs(sum(served.values()) - 256) <= len(served)


def test_packing_of_nothing(docs):
    P = pytest.importorskip("public_tokenizers")
    assert packing.pack(docs.limit(0), P.path("byte_bpe_50k.json")).count() == 0



# 2 ------------------------------------------------------------------------------------------


def covered(texts, n=400):
    raw = [(t or "").encode() for _, t in texts]
    seen = Counter(b[j : j + n] for b in raw for j in range(len(b) - n + 1))
    out = []
    for b in raw:
        gone = np.zeros(len(b) + 1, dtype=np.int8)
        for j in range(len(b) - n + 1):
            if seen[b[j : j + n]] > 1:
                gone[j : j + n] = 1
        out.append((len(b), int(gone.sum()), int((np.diff(np.append(0, gone)) == 1).sum()), hashlib.sha256(bytes(x for x, g in zip(b, gone) if not g)).hexdigest()))
    return sorted(out)


@pytest.mark.parametrize("hot, part", [(10_000, 1 << 20), (3, 1500)])
def test_suffix_dedup(docs, texts, monkeypatch, hot, part):
    monkeypatch.setattr(suffixdedup, "HOT", hot)
    monkeypatch.setattr(suffixdedup, "HASH_BYTES", part)
    got = sorted((r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffixdedup.deduplicated(docs).collect())
    assert got == covered(texts)


def test_suffix_array():
    for _ in range(150):
        text = np.array([RNG.randint(0, RNG.choice([2, 4, 256])) for _ in range(RNG.randint(1, 50))] + [0], dtype=np.int16)
        order = suffixdedup.suffix_array(text, 100).tolist()
        plain = text.tolist()
        assert order == sorted(range(len(plain)), key=lambda i: plain[i:])
        shared = suffixdedup.common_prefixes(text, np.array(order), 100)
        for r in range(1, len(order)):
            a, b = plain[order[r - 1] :], plain[order[r] :]
            assert shared[r] == next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))


# 3 ------------------------------------------------------------------------------------------


def brute_fingerprint(text):
    import xxhash

    w = re.findall(r"[^\x20\x09-\x0D]+", lower(text))
    shingles = [" ".join(w[i : i + 4]) for i in range(max(1, len(w) - 3))] if w else []
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash(spark, texts):
    near = [(i, t if t is None else t + (" tail" if i and i % 3 == 0 else "")) for i, t in texts if i is not None]
    near += [(100 + i, para(60) if i == 0 else near[40][1][: 8000 - i]) for i in range(8)]
    got = simhash.near_duplicates(spark.createDataFrame(near, "doc_id long, text string")).collect()
    fps = [brute_fingerprint(t) for _, t in near]
    assert sorted((r.doc_id, r.fingerprint) for r in got) == sorted((i, f"{f:016x}") for (i, _), f in zip(near, fps))
    root = list(range(len(near)))
    for _ in near:
        for i in range(len(near)):
            for j in range(len(near)):
                if (fps[i] ^ fps[j]).bit_count() <= 4:
                    root[i] = min(root[i], root[j], key=lambda x: near[x][0])
    assert sorted((r.doc_id, r.component_id) for r in got) == sorted((near[i][0], near[root[i]][0]) for i in range(len(near)))


def test_forest_joins_what_is_near():
    base = RNG.getrandbits(64)
    fps = np.unique(np.array([base ^ sum(1 << RNG.randrange(64) for _ in range(RNG.randint(0, 3))) for _ in range(80)] + [RNG.getrandbits(64) for _ in range(20)], dtype=np.uint64))
    group = {int(x): int(x) for x in fps}

    def find(x):
        while group[x] != x:
            x = group[x]
        return x

    for a, b in simhash.forest(fps, 4):
        assert (a ^ b).bit_count() <= 4
        group[find(a)] = find(b)
    for a in group:
        for b in group:
            assert (a ^ b).bit_count() > 4 or find(a) == find(b)


# 4, 8 ---------------------------------------------------------------------------------------


def test_toxicity(spark):
    rude = ["blockhead", "dimwit", "numbskull"]
    rows = [(i, para(25) + (" " + " ".join(RNG.sample(rude, 2)) if i % 4 == 0 else ""), int(i % 4 == 0)) for i in range(1500)]
    data = spark.createDataFrame(rows + [(9000, None, None), (9001, "", None), (9002, "blokhead dimmwit numbskul " + para(20), None)], "doc_id long, text string, toxic int")
    model = toxicity.fit(data.select("doc_id", "text"), data.select("doc_id", "toxic"), F.col("doc_id") % 5 != 0)
    got = {r.doc_id: r for r in toxicity.scored(data.select("doc_id", "text"), model, "doc_id").collect()}
    held = [i for i in range(1500) if i % 5 == 0]
    assert sum(got[i].predicted == (i % 4 == 0) for i in held) >= 0.9 * len(held)
    assert got[9000].score == got[9001].score and got[9002].score > 0.7
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in got.values())
    empty = toxicity.fit(data.limit(0).select("doc_id", "text"), data.limit(0).select("doc_id", "toxic"))
    assert toxicity.scored(data.select("doc_id", "text"), empty, "doc_id").count() == data.count()


def test_language(spark):
    ends = {"aa": "ing", "bb": "heit"}
    rows = [(i, lang, " ".join(w + end for w in RNG.sample(WORDS, 40))) for i, (lang, end) in enumerate(list(ends.items()) * 60)]
    odd = [(900, None, None), (901, "aa", "12 34 !"), (902, None, ""), (903, None, " ".join(["xing"] * 700))]
    data = spark.createDataFrame(rows + odd, "doc_id long, lang string, text string")
    field = language.fit(data, F.col("doc_id") % 3 != 0)
    got = {r.doc_id: r for r in language.identify(data, field, "doc_id").collect()}
    assert sum(got[i].lang_pred == lang for i, lang, _ in rows) >= 0.97 * len(rows)
    assert [got[i].lang_pred for i in (900, 901, 902, 903)] == ["und", "und", "und", "aa"]
    mixed = " ".join([w + "ing" for w in WORDS[:20]] + [w + "heit" for w in WORDS[20:40]]).split()
    emit = np.array([field.weights[language.features(w)].sum(axis=0) for w in mixed])[None]
    path = language.marginals(emit, field.start, field.moves, np.array([40]))[0].argmax(axis=1)
    assert (path[:18] == 0).all() and (path[22:] == 1).all()
    assert language.identify(data, language.fit(data.limit(0)), "doc_id").where("lang_pred <> 'und'").count() == 0


# 5 ------------------------------------------------------------------------------------------


def test_top_k(spark):
    rows = [(i, [RNG.gauss(0, 0.3) for _ in range(20)]) for i in range(120)]
    rows += [(200, rows[50][1]), (201, rows[50][1]), (50, rows[50][1]), (202, None), (203, [1.0, None]), (204, [float("nan")] * 20), (205, [1.0, 2.0]), (None, [0.5] * 20), (206, [])]
    data = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    vectors = data.select("vec_id", topk.quantized(F.col("embedding")).alias("v"))
    good = [(i, [math.floor(256 * x) for x in v]) for i, v in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    want = []
    for i, q in good:
        if i is not None and i % 50 == 0:
            s = sorted(((-sum(a * b for a, b in zip(q, v)), j is None, j) for j, v in good if j != i), key=lambda x: (x[0], x[1], x[2] or 0))
            want += [(i, r + 1, j, -x) for r, (x, _, j) in enumerate(s[:5])]
    got = [tuple(r) for r in topk.top_k(vectors, F.col("vec_id") % 50 == 0, 5).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert topk.top_k(vectors.limit(0), F.col("vec_id") % 50 == 0, 5).count() == 0


# 6 ------------------------------------------------------------------------------------------


@pytest.mark.parametrize("rows", [200_000, 0])
def test_contamination(spark, docs, texts, monkeypatch, rows):
    monkeypatch.setattr(decontaminate, "BROADCAST_ROWS", rows)
    items = [("a", " ".join(PASSAGES[0].split()[5:30])), ("b", "IDLE, words"), ("c", None), ("d", "..."), ("e", " ".join(["ab"] * 12)), ("a", PASSAGES[1][:90]), ("f", "a")]
    table = spark.createDataFrame(items, "item_id string, text string")
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t))
    windows = {}
    for i, t in items:
        w = words(t)
        for s in range(max(0, len(w) - 10) + 1) if w else ():
            windows.setdefault(tuple(w[s : s + 10]), set()).add(i)
    want = []
    for i, t in texts:
        w, hit, names = words(t), set(), set()
        for win, own in windows.items():
            for s in range(len(w) - len(win) + 1):
                if tuple(w[s : s + len(win)]) == win:
                    hit |= set(range(s, s + len(win)))
                    names |= own
        want.append((i, len(w), len(hit), len(names), hashlib.sha256(",".join(sorted(names)).encode()).hexdigest(), bool(hit)))
    got = [tuple(r) for r in decontaminate.contamination(docs, table).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert decontaminate.contamination(docs, table.limit(0)).where("contaminated").count() == 0
    assert decontaminate.contamination(docs.limit(0), table).count() == 0


# 7 ------------------------------------------------------------------------------------------


def test_language_model(docs, texts):
    got = hmm.language_model_scores(docs, F.col("doc_id") % 4 != 1, rounds=1, states=3).collect()
    tokens = [[*re.findall(r"[^\x20\x09-\x0D]+", lower(t)), None] for _, t in texts]
    train = [i is not None and i % 4 != 1 for i, _ in texts]
    c = Counter(w for ws, use in zip(tokens, train) if use for w in ws)
    n, v = sum(c.values()), len(c)
    want = sorted((len(ws), sum(c[w] > 0 for w in ws), round(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in ws), 6), not use) for ws, use in zip(tokens, train))
    assert sorted((r.n_tokens, r.n_known, round(r.base_score, 6), r.held_out) for r in got) == want
    assert {r.train_tokens for r in got} == {n} and all(r.score < 0 for r in got)
    assert hmm.language_model_scores(docs, F.lit(False), rounds=1, states=2).where("n_known > 0").count() == 0


def test_forward_is_the_sum_over_paths():
    rng = np.random.default_rng(1)
    model = hmm.Model(rng.dirichlet([1] * 2), rng.dirichlet([1] * 2, 2), rng.dirichlet([1] * 4, 2).T)
    seq = [0, 3, 1, 2]
    total = 0.0
    for path in np.ndindex(*[2] * 4):
        p = model.start[path[0]] * model.emit[seq[0], path[0]]
        for a, b, x in zip(path, path[1:], seq[1:]):
            p *= model.moves[a, b] * model.emit[x, b]
        total += p
    assert hmm.forward(model, [np.array(seq, dtype="<u2").tobytes()])[0] == pytest.approx(math.log10(total))


# 9, 10 --------------------------------------------------------------------------------------


@pytest.mark.parametrize("few", [None, 0])
def test_warc(spark, few):
    """Digests sent to every task, and attached by page; one page of megabytes among small ones; every record of its own id, found by its index."""
    import gzip

    odd = "WARC/1.1\r\n\r\nContent-Length: 3\r\n\r\n"
    rows = [(1, "u", "x"), (2, None, "x"), (3, "a\r\nb", None), (4, "u", ""), (None, "u", "x"), (5, "u", odd), (5, "u", odd), (None, "u", "é" * 5000), (6, "u", "long " * 900_000)]
    rows += [(100 + i, "u", f"page {i % 40}") for i in range(200)] + [(None, "u", "none"), (None, "u", "none"), (2, "u", "x"), (2, "u", "x")]
    table = spark.createDataFrame([(*r, "z", 1) for r in rows], "page_id long, url string, html string, digest string, row int").repartition(2)
    path = scratch(spark, "warc")
    index = warc.write_warc(warc.resolve(table, few=few), path, file_bytes=30_000).collect()
    got = [tuple(r)[:1] + tuple(r)[2:] for r in warc.resolved_headers(warc.read_warc(spark, path)).collect()]
    want = []
    for i, _, t in rows:
        body = (t or "").encode()
        top = max((j for j, _, u in rows if (u or "").encode() == body and j is not None), default=None)
        want.append((i, len(body), base64.b32encode(hashlib.sha1(body).digest()).decode(), "response" if i == top else "revisit", None if i == top else top))
    assert sorted(got, key=str) == sorted(want, key=str)
    assert len({r.record_id for r in index}) == len(rows)
    folder = path.removeprefix("file:")
    for r in index:
        with open(f"{folder}/{r.file}", "rb") as f:
            f.seek(r.offset)
            data = gzip.decompress(f.read(r.length))
        assert f"WARC-Record-ID: {r.record_id}".encode() in data and data.endswith(b"\r\n\r\n")
    assert 3 <= len({r.file for r in index}) <= 16
    path = scratch(spark, "warc")
    warc.write_warc(warc.resolve(table.limit(0)), path)
    assert warc.resolved_headers(warc.read_warc(spark, path)).count() == 0


def test_sharding(docs, texts):
    size = F.octet_length(F.coalesce("text", F.lit(""))) + 16
    got = sharding.histogram_shards(docs, F.col("text"), size, 4).collect()
    assert len(got) == len(texts)
    shards = {}
    for r in got:
        shards.setdefault(r.shard, []).append(r)
    for own in shards.values():
        assert sorted(r.slot for r in own) == list(range(len(own)))
    total, largest = sum(r["size"] for r in got), max(r["size"] for r in got)
    assert all(abs(sum(r["size"] for r in own) - total / 4) <= largest for own in shards.values())
    assert sharding.histogram_shards(docs.limit(0), F.col("text"), size, 4).count() == 0


def test_replaced_texts(docs, texts):
    """Rows keep their columns; what stays of a text is what deduplicated() keeps."""
    want = sorted((r.doc_id is None, r.doc_id or 0, r.kept or "") for r in suffixdedup.deduplicated(docs).collect())
    got = suffixdedup.replaced(docs).select("doc_id", "text", "source", "changed").collect()
    assert sorted((r.doc_id is None, r.doc_id or 0, r.text or "") for r in got) == want
