import hashlib
import random
import zlib
from collections import Counter, defaultdict

import brute
import numpy as np
import pytest
from pyspark.sql import functions as F

from palimpsest.llm import chat, components, exact_dedup, licenses, mixing, near_dedup, packing, quality, sharding, substring_dedup, suffix_dedup
from palimpsest.llm.queries import tokenizer_path


def pairs(df):
    return [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]


# --- mixing ---------------------------------------------------------------


def test_targets_share_the_excess(spark):
    sizes = spark.createDataFrame([("a", 100), ("b", 1000), ("c", 10), (None, 0)], "source string, source_size bigint")
    got = {r["source"]: r["target"] for r in mixing.source_targets(sizes).collect()}
    size, weight = {"a": 100, "b": 1000, "c": 10, None: 0}, {"a": 3, "b": 1, "c": 2, None: 3}
    want, open_ = {}, set(size)
    left = 1.5 * sum(size.values())
    while True:  # share by weight, cap, share the excess again
        level = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if level * weight[s] > 2 * size[s]}
        if not full:
            break
        for s in full:
            want[s] = 2.0 * size[s]
            left -= want[s]
        open_ -= full
    want.update({s: level * weight[s] for s in open_})
    assert got == pytest.approx(want)
    assert sum(got.values()) == pytest.approx(1.5 * 1110)


def test_mix_odd_rows(odd, none):
    sized, sources = mixing.rates(odd)
    rows = mixing.copies(sized, sources).collect()
    assert len(rows) == odd.count() and all(0 <= r["_copies"] <= 2 for r in rows)
    mixed = mixing.mix(odd)
    assert mixed.columns == odd.columns
    assert mixed.count() == sum(r["_copies"] for r in rows)
    assert sorted(map(str, mixed.collect())) == sorted(map(str, mixing.mix(odd).collect()))
    assert mixing.mix(none).count() == 0


def test_mix_comes_near_targets(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    sized, sources = mixing.rates(docs)
    taken = mixing.copies(sized, sources).groupBy("source").agg(F.sum(F.col("size") * F.col("_copies")).alias("taken"))
    for r in taken.join(sources, "source").collect():
        assert abs(r["taken"] - r["target"]) <= 0.15 * r["target"] + 200


# --- exact dedup ------------------------------------------------------------


@pytest.mark.parametrize("budget", [48 << 20, 300])
def test_exact_report(odd, none, budget, monkeypatch):
    monkeypatch.setattr(exact_dedup, "BUDGET", budget)
    groups = defaultdict(list)
    for d, t in pairs(odd):
        groups[t or ""].append(d)
    best = {t: max((d for d in ids if d is not None), default=None) for t, ids in groups.items()}
    want = Counter((d, best[t or ""], len(groups[t or ""]), d == best[t or ""], hashlib.sha256((t or "").encode()).hexdigest()) for d, t in pairs(odd))
    assert Counter(map(tuple, exact_dedup.report(odd).collect())) == want
    one = exact_dedup.keep_one(odd)
    assert one.columns == odd.columns and dict(one.dtypes) == dict(odd.dtypes)
    assert sorted((r["text"], str(r["doc_id"])) for r in one.collect()) == sorted((t, str(d)) for t, d in best.items())
    assert exact_dedup.report(none).count() == 0 and exact_dedup.keep_one(none).count() == 0


def test_trie_spills_and_splits():
    trie, kept = exact_dedup.Trie(), {}
    rng = random.Random(5)
    for i in range(3000):
        key = bytes(rng.choice(b"abc") for _ in range(rng.randrange(9)))
        trie.insert(key, [i], lambda a, b: a + b)
        kept.setdefault(key, []).append(i)
    assert dict(trie.items()) == kept
    heavy = dict(trie.spill())
    assert len({k[0] for k in heavy}) == 1 and {**dict(trie.items()), **heavy} == kept


# --- near dedup -------------------------------------------------------------


def test_signature_estimates_overlap():
    rng = np.random.default_rng(3)
    base = rng.integers(0, 2**63, 600, dtype=np.uint64)
    a, b = base[:500], base[100:]
    slots = 78
    got = []
    for shift in range(60):
        x = near_dedup.mix(np.concatenate([a, b]) + np.uint64(shift * 7919))
        s = near_dedup.signatures(x, np.array([500, 500]), slots)
        got.append((s[0] == s[1]).mean())
    assert np.mean(got) == pytest.approx(400 / 600, abs=0.02)
    whole = near_dedup.signatures(a, np.array([500]), slots)
    halves = np.minimum(near_dedup.signatures(a[:200], np.array([200]), slots), near_dedup.signatures(a[200:], np.array([300]), slots))
    assert (whole == halves).all()
    ranks = near_dedup.signatures(a[:1], np.array([1]), slots)[0] >> np.uint64(32)
    assert sorted(ranks.tolist()) == list(range(slots))  # one shingle reaches each slot at its own rank


def test_near_odd_rows(odd, none):
    root = brute.near_groups(pairs(odd))
    want = Counter()
    for d, t in pairs(odd):
        low = root.get(d)
        want[(d, len(brute.shingle_set(t)), low, d == low)] += 1
    assert Counter(map(tuple, near_dedup.groups(odd).collect())) == want
    assert near_dedup.groups(none).count() == 0
    kept = near_dedup.keep_one(odd)
    assert kept.columns == odd.columns
    assert Counter(r["doc_id"] for r in kept.collect()) == Counter(d for d, _ in pairs(odd) if d is None or root[d] == d)


@pytest.mark.parametrize("block", [256, 4])
def test_near_groups_of_close_texts(spark, block, monkeypatch):
    """Families of edited copies around the threshold, against all pairs."""
    monkeypatch.setattr(near_dedup, "_BLOCK", block)
    rng = random.Random(block)
    rows = []
    for family in range(6):
        base = [f"t{rng.randrange(400)}" for _ in range(120)]
        for _ in range(25):
            w = list(base)
            for _ in range(rng.randrange(1, 7)):
                w[rng.randrange(120)] = f"n{rng.randrange(10**6)}"
            rows.append((len(rows), " ".join(w)))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {r["doc_id"]: r["component_id"] for r in near_dedup.groups(docs).collect()}
    assert got == brute.near_groups(rows)


def test_components_of_paths_and_stars(spark):
    rng = random.Random(1)
    links = [(i, i + 1) for i in range(200)] + [(1000, 1000 + i) for i in range(1, 300)] + [(5000 + rng.randrange(80), 5000 + rng.randrange(80)) for _ in range(60)]
    got = {r["node"]: r["label"] for r in components.components(spark.createDataFrame(links, "a bigint, b bigint").repartition(7)).collect()}
    root = {x: x for pair in links for x in pair if pair[0] != pair[1]}
    for _ in range(300):
        for a, b in links:
            if a != b:
                root[a] = root[b] = min(root[a], root[b])
    assert got == root


# --- sharding ---------------------------------------------------------------


@pytest.mark.parametrize("shards", [8, 3])
def test_shards(odd, none, shards):
    rows = sharding.interleave(odd, shards).collect()
    got = Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in rows)
    assert got == Counter((d, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for d, t in pairs(odd))
    counts = Counter(r["shard"] for r in rows)
    assert max(counts.values()) - min(counts.get(s, 0) for s in range(shards)) <= 1
    for s in counts:
        assert sorted(r["slot"] for r in rows if r["shard"] == s) == list(range(counts[s]))
    assert sharding.interleave(none, shards).count() == 0


def test_shards_match_mixture(spark):
    docs = spark.range(4000).select(F.col("id").alias("doc_id"), F.lit("t").alias("text"), F.when(F.col("id") % 10 < 6, "big").when(F.col("id") % 10 < 9, "mid").otherwise(None).alias("source"))
    rows = sharding.interleave(docs, 8).groupBy("shard", "source").count().collect()
    for r in rows:
        assert abs(r["count"] - {"big": 300, "mid": 150, None: 50}[r["source"]]) <= 1


# --- substring and suffix dedup ----------------------------------------------


def planted(seed, n=60):
    rng = random.Random(seed)
    shared = [" ".join(f"s{rng.randrange(10**6)}" for _ in range(rng.randrange(12, 40))) for _ in range(5)]
    rows = []
    for i in range(n):
        own = [" ".join(f"v{rng.randrange(300)}" for _ in range(rng.randrange(1, 60))) for _ in range(rng.randrange(1, 5))]
        parts = own + [rng.choice(shared) for _ in range(rng.randrange(3))] + ([own[0]] if rng.random() < 0.3 else [])
        rng.shuffle(parts)
        rows.append((rng.randrange(n), "  ".join(parts)))
    return rows


@pytest.mark.parametrize("hot", [5000, 3])
def test_word_repeats(spark, odd, none, hot, monkeypatch):
    from palimpsest.llm import repeats

    monkeypatch.setattr(repeats, "HOT", hot)
    rows = pairs(odd) + planted(4)
    cut, gone = brute.word_repeats(rows, 13)
    want = Counter((d, len(w), len(g), " ".join(x for i, x in enumerate(w) if i not in g)) for (d, _), w, g in zip(rows, cut, gone))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = substring_dedup.remove_repeats(docs).withColumn("kept_text", F.col("kept_text").cast("string"))
    assert Counter(map(tuple, got.collect())) == want
    assert substring_dedup.remove_repeats(none).count() == 0


@pytest.mark.parametrize("hot", [5000, 3])
def test_byte_repeats(spark, odd, none, hot, monkeypatch):
    from palimpsest.llm import repeats

    monkeypatch.setattr(repeats, "HOT", hot)
    rows = [(d, t) for d, t in pairs(odd) if len(t or "") < 5000] + planted(9)
    data = [(d, (t or "").encode()) for d, t in rows]
    want = Counter()
    for (d, b), mask in zip(data, brute.byte_repeats(data, 100)):
        spans = sum(1 for i, m in enumerate(mask) if m and not (i and mask[i - 1]))
        want[(d, len(b), sum(mask), spans, bytes(x for x, m in zip(b, mask) if not m))] += 1
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = Counter((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"])) for r in suffix_dedup.remove_repeats(docs).collect())
    assert got == want
    assert suffix_dedup.remove_repeats(none).count() == 0


def test_slices_of_long_texts(spark, monkeypatch):
    from palimpsest.llm import repeats

    monkeypatch.setattr(repeats, "_SLICE", 50)
    rows = planted(2, 30)
    data = [(d, t.encode()) for d, t in rows]
    want = Counter((d, sum(m)) for (d, _), m in zip(data, brute.byte_repeats(data, 100)))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert Counter((r["doc_id"], r["n_removed"]) for r in suffix_dedup.remove_repeats(docs).collect()) == want


# --- packing ------------------------------------------------------------------


def test_chunks_tokenize_like_whole_texts(spark):
    from tokenizers import Tokenizer

    texts = [r[0] for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").collect()]
    texts += ["a\tb\n\nc  d", "", "  ", None, "it's <|endoftext|>x<|startoftext|> e\u0301 \u0301x \u00a0 y", "I'LL 12 's"]
    tokenizer = Tokenizer.from_file(tokenizer_path())
    whole = [np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 0], "<u4").tobytes() for t in texts]
    few = packing.WordIds(tokenizer_path(), 50)
    assert [few.of([t])[0] for t in texts] == whole
    assert packing.WordIds(tokenizer_path()).of(texts) == whole


def test_pack_odd_rows(odd, none):
    packed = packing.pack(odd, tokenizer_path(), ids=True).collect()
    by = defaultdict(list)
    for r in packed:
        by[r["sequence_id"]].append(r)
    for rows in by.values():  # gapless and within capacity
        at = 0
        for r in sorted(rows, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 2048
    assert len(by) == -(-sum(r["length"] for r in packed) // 2048)  # none fewer would do
    words = packing.WordIds(tokenizer_path())
    want = Counter()
    for d, t in pairs(odd):
        ids = np.frombuffer(words.of([t])[0], "<u4")
        for piece, start in enumerate(range(0, len(ids), 2048)):
            part = ids[start : start + 2048]
            want[(d, piece, start, len(part), zlib.crc32(part.tobytes()))] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in packed) == want
    assert packing.pack(none, tokenizer_path()).count() == 0


def test_sequences_join_pieces(odd):
    packed = packing.pack(odd, tokenizer_path(), ids=True)
    joined = packing.sequences(packed).collect()
    assert sum(len(r["ids"]) for r in joined) == packed.agg(F.sum("length")).first()[0]


def test_fullest_finds_best_sum():
    rng = random.Random(2)
    for _ in range(60):
        counts = {rng.randrange(1, 40): rng.randrange(1, 4) for _ in range(6)}
        room = rng.randrange(1, 120)
        reach = {0}
        for x, n in counts.items():
            for _ in range(n):
                reach |= {s + x for s in reach if s + x <= room}
        chosen = packing.fullest(counts, room)
        assert sum(x * n for x, n in chosen) == max(reach)
        assert all(n <= counts[x] for x, n in chosen)


# --- quality, licenses, chat ----------------------------------------------------


def test_quality_odd_rows(odd, none):
    rows = quality.report(odd).collect()
    assert len(rows) == odd.count()
    want = Counter()
    for d, t in pairs(odd):
        w, lines = brute.words(t), [x for x in (t or "").split("\n") if brute.words(x)]
        seen, hit = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4)), set()
        for i in range(len(w) - 4):
            if seen[tuple(w[i : i + 5])] > 1:
                hit.update(range(i, i + 5))
        want[(d, len(w), sum(map(len, w)), sum((t or "").count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(hit), len(w) < 10 or 100 * len(hit) > 20 * len(w))] += 1
    assert Counter((r["doc_id"], r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) for r in rows) == want
    assert not any(r["kept"] for r in rows if r["base_failed"])
    assert quality.keep(odd).columns == odd.columns and quality.keep(none).count() == 0


def test_quality_tells_prose_from_noise(spark):
    prose = " ".join(f"the river{chr(97 + i)} near old walls of town{chr(97 + i)} ran deep and many birds{chr(97 + i)} came there late in may{chr(97 + i)}." for i in range(20))
    shout = " ".join(f"BUY{chr(65 + i % 26)}{chr(65 + i // 26)} NOW!!" for i in range(80))
    marks = " ".join(f"of{chr(97 + i % 26)}{chr(97 + i // 26)}### the&&&" for i in range(80))
    docs = spark.createDataFrame([(1, prose), (2, shout), (3, marks)], "doc_id bigint, text string")
    assert [r["doc_id"] for r in quality.keep(docs).collect()] == [1]


def test_license_scan(spark, odd, none):
    texts = {
        1: "Licensed under the Apache License, Version 2.0 (the license)",
        2: "SPDX-License-Identifier: GPL-2.0-only",
        3: "released under the terms of the GNU Lesser General Public License version 3",
        4: "GNU General Public License. MIT license; CC BY 4.0 and mit License",
        5: "mit dem Hund und cc by",
        6: "nothing here",
        7: "Mozilla Public License 2.0",
    }
    rows = {r["doc_id"]: r for r in licenses.scan(spark.createDataFrame(list(texts.items()), "doc_id bigint, text string")).collect()}
    assert (rows[1]["base_labels"], rows[1]["n_base"], rows[1]["first_word"], rows[1]["score"]) == ("apache", 1, 3, 0.9)
    assert (rows[2]["labels"], rows[2]["n_base"], rows[2]["score"]) == ("gpl", 0, 1.0)
    assert rows[3]["labels"] == "lgpl"  # the longer name holds the shorter one
    assert (rows[4]["base_labels"], rows[4]["n_base"], rows[4]["first_word"], rows[4]["last_word"]) == ("cc-by,gpl,mit", 4, 0, 11)
    assert (rows[5]["labels"], rows[5]["first_word"]) == ("cc-by", 4)
    assert (rows[6]["labels"], rows[6]["first_word"], rows[6]["score"]) == ("", None, 0.0)
    assert rows[7]["labels"] == "mpl" and rows[7]["score"] == 0.8
    assert licenses.scan(odd).count() == odd.count() and licenses.scan(none).count() == 0
    assert {r["doc_id"]: r["base_labels"] for r in licenses.scan(odd).collect()}[11] == "apache,mit"


def test_many_detections_stay_linear(spark):
    text = "Licensed under the MIT License. GNU GPL version 3, see the Apache License 2.0. " * 3000
    row = licenses.scan(spark.createDataFrame([(1, text)], "doc_id bigint, text string")).first()
    assert row["n_base"] == 6000 and row["labels"] == "apache,gpl,mit"


def test_layouts_become_turns(spark):
    import json

    user, answer = "hi \\# <there>", "yes"
    records = [
        {"prompt": user, "completion": answer},
        {"response": answer, "prompt": user},
        {"instruction": "hi \\#", "input": "<there>", "output": answer},
        {"instruction": user, "input": "", "output": answer},
        {"instruction": user, "output": answer},
        {"question": user, "answer": answer},
        {"messages": [{"role": "user", "content": user}, {"role": "assistant", "content": answer}]},
        {"conversations": [{"from": "human", "value": user}, {"value": answer, "from": "gpt"}]},
        {"what": "else"},
    ]
    df = spark.createDataFrame([(i, json.dumps(r)) for i, r in enumerate(records)] + [(99, None), (98, "not json")], "conv_id bigint, record string")
    known, unknown = chat.canonical(df)
    got = {r["conv_id"]: [tuple(t) for t in r["turns"]] for r in known.collect()}
    plain = [("user", user), ("assistant", answer)]
    assert got == {**{i: plain for i in range(8)}, 2: [("user", "hi \\#\n<there>"), ("assistant", answer)]}
    assert sorted(r["conv_id"] for r in unknown.collect()) == [8, 98, 99]


def test_chat_round_trip(spark):
    rng = random.Random(8)
    bits = ["\\", "#", "<", "### ", ": ", "</turn>\n", "h", "l", "c", "\n", "é", "\U0001f600", "a b", "\\h", "\\\\"]
    rows = []
    for conv in range(40):
        for turn in range(rng.randrange(1, 9)):
            text = None if rng.random() < 0.1 else "".join(rng.choice(bits) for _ in range(rng.randrange(12)))
            rows.append((conv, turn, rng.choice(["user", "assistant", None, "a: b", "\\#"]), text))
    rows += [(None, 0, "user", "x"), (500, None, "assistant", ""), (501, 1, "assistant", "twice"), (501, 1, "assistant", "twice")]
    rows += [(600, i, "assistant" if i % 2 else "user", f"t{i}") for i in range(700)]
    df = spark.createDataFrame(rows, "conv_id bigint, turn int, role string, text string")
    want = defaultdict(list)
    for conv, turn, role, text in rows:
        want[conv].append((-1 if turn is None else turn, role or "", text or ""))
    back = {r["conv_id"]: r for r in chat.read_back(chat.formatted(df)).collect()}
    assert set(back) == set(want)
    for conv, turns in want.items():
        turns.sort()
        assert [tuple(t) for t in back[conv]["turns"]] == [(role, text) for _, role, text in turns]
        assert back[conv]["loss_text"] == "".join(text for _, role, text in turns if role == "assistant")
    assert chat.formatted(df.filter("false")).count() == 0
