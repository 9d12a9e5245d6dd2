"""Each operator against a brute-force version on small inputs with awkward rows."""

import hashlib
import re
import time
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from barflow.llm import chat, decontaminate, near_dedup, quality_crf, quality_rules, substring_dedup, token_counts, token_shards, toxicity, unigram
from barflow.llm.common import Scratch

P = pytest.importorskip("public_tokenizers")
LONG = " ".join(f"w{i % 97}x{i % 89}" for i in range(3000))
TEXTS = [None, "", "   \n\t ", "one", "one two", "a a a a a a", "it's <|endoftext|> ΣΑΣ é 漢字 😀 \x1c x\x85y\n\nq", LONG, LONG + " tail", LONG,
         "Alpha beta gamma delta " * 30, "alpha BETA gamma delta " * 30, "| # * x\n| # * x\n" * 5, "▁ under  score"]
SCHEMA = "doc_id long, text string, extra string, _row string"


def docs(spark, texts=TEXTS):
    return spark.createDataFrame([(i, t, "e", "r") for i, t in enumerate(texts)], SCHEMA)


def by_id(df):
    return {r.doc_id: r for r in df.collect()}


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


def test_quality_rules(spark):
    got = by_id(quality_rules.quality_rules_query(docs(spark)))
    for i, t in enumerate(TEXTS):
        w, lines, dup, seen = words(t), (t or "").split("\n"), 0, set()
        tri = Counter(zip(w, w[1:], w[2:]))
        cover = {p + k for p in range(len(w) - 2) if tri[tuple(w[p : p + 3])] > 1 for k in range(3)}
        for x in lines:
            if words(x):
                dup += x in seen
                seen.add(x)
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (
            len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t or ""), dup, len(cover))
        assert r.base_failed == (len(w) < 50 or 100 * len(cover) > 50 * len(w)) and not (r.kept and r.base_failed)
    assert quality_rules.quality_rules_query(docs(spark, [])).count() == 0
    assert quality_rules.keep_documents(docs(spark)).columns == docs(spark).columns


def norm(t):
    low = (t or "").translate({i: i + 32 for i in range(65, 91)})
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def test_decontaminate(spark):
    bench = [(1, " ".join(f"b{i}" for i in range(20))), (2, "Alpha, beta GAMMA delta"), (3, None), (4, "!!"), (5, "one"), (6, "one")]
    b = spark.createDataFrame(bench, "item_id long, text string")
    texts = TEXTS + ["x " * 5 + " ".join(f"B{i}" for i in range(3, 18)) + " y" * 300, "b1 b2 b3"]
    got = by_id(decontaminate.decontaminate_query(docs(spark, texts), b))
    for i, t in enumerate(texts):
        w, hit, items = norm(t), set(), set()
        for item, text in bench:
            v = norm(text)
            for s in range(max(len(v) - 13, 0) + 1 if v else 0):
                g = v[s : s + 13]
                for p in range(len(w) - len(g) + 1):
                    if w[p : p + len(g)] == g:
                        hit |= set(range(p, p + len(g)))
                        items.add(str(item))
        r = got[i]
        assert (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) == (
            len(w), len(hit), len(items), hashlib.sha256(",".join(sorted(items)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w)), i
    kept = decontaminate.remove_documents(docs(spark, texts), b)
    assert kept.columns == docs(spark).columns and {r.doc_id for r in kept.collect()} == {i for i in got if not got[i].contaminated}
    plan = kept._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan


def test_near_dedup(spark):
    base = [f"t{i}" for i in range(200)]
    texts = TEXTS + [" ".join(base), " ".join(base[:-9]), " ".join(base[9:] + ["z"]), " ".join(base[60:])]
    for k in (2, 5):
        got = by_id(near_dedup.near_duplicates(docs(spark, texts), k=k))
        sets = [near_dedup._shingles(near_dedup.words_of(t or ""), k) for t in texts]
        comp = list(range(len(texts)))
        for i, a in enumerate(sets):
            for j in range(i):
                if a and sets[j] and 100 * len(a & sets[j]) >= 80 * len(a | sets[j]):
                    old, new = max(comp[i], comp[j]), min(comp[i], comp[j])
                    comp = [new if c == old else c for c in comp]
        assert [(got[i].n_shingles, got[i].component_id, got[i].kept) for i in range(len(texts))] == [(len(sets[i]), comp[i], comp[i] == i) for i in range(len(texts))]
    assert near_dedup.near_duplicates(docs(spark, []), k=2).count() == 0


def test_near_dedup_judges_each_text_of_a_doc_id(spark):
    a, b, c, d = ([f"{x}{i}" for i in range(100)] for x in "abcd")
    rows = [(5, a), (5, b), (7, [*a, "more"]), (3, [*b, "more"]), (9, c), (9, d), (11, [*c, "more"]), (12, [*d, "more"]), (13, c), (9, c), (2, ["alone"])]
    rows = [(i, " ".join(t), str(n), "r") for n, (i, t) in enumerate(rows)]
    docs = spark.createDataFrame([*rows, (9, None, "11", "r"), (None, " ".join(a), "12", "r")], SCHEMA)
    got = near_dedup.near_duplicates(docs, k=2).collect()
    component = {5: 3, 7: 3, 3: 3, 9: 9, 11: 9, 12: 9, 13: 9, 2: 2, None: None}
    assert len(got) == 13 and all(r.component_id == component[r.doc_id] for r in got)
    assert all(r.kept == (r.doc_id is None or r.doc_id == r.component_id) for r in got)
    assert sorted(r.n_shingles for r in got if r.doc_id == 9) == [0, 99, 99, 99]
    kept = near_dedup.keep_one(docs, k=2)
    assert kept.columns == docs.columns
    # of b the first is in doc_id 3, so only that text of doc_id 5 goes
    assert sorted(int(r.extra) for r in kept.collect()) == [0, 3, 4, 5, 9, 10, 11, 12]


def test_signature_buckets_hold_every_pair_within_reach(spark):
    rng = np.random.default_rng(0)
    x = rng.integers(0, 256, (200, near_dedup.POSITIONS)).astype(np.uint8)
    y = x.copy()
    for r in y:
        at = rng.choice(near_dedup.POSITIONS, near_dedup.REACH, replace=False)
        r[at] ^= 1
    nodes = spark.createDataFrame([(i, s.tobytes()) for i, s in enumerate(np.concatenate((x, y)))], "id long, sig binary")
    keys = near_dedup.bucket_keys(nodes)
    met = keys.alias("a").join(keys.alias("b"), "key").filter("a.id + 200 = b.id").select("a.id").distinct()
    assert met.count() == 200


def shuffled(spark):
    """Bytes that local tasks have written for shuffles so far."""
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    time.sleep(0.5)
    return spark.sparkContext._jsc.sc().statusStore().executorList(True).apply(0).totalShuffleWrite()


def test_a_bucket_compares_its_large_family_with_others_only(spark, monkeypatch):
    rng, tie, cost = np.random.default_rng(1), near_dedup.tied_families, []

    def changed(x, places):
        x = x.copy()
        x[places] ^= 1
        return x

    def measured(*args):
        before = shuffled(spark)
        out = tie(*args)
        cost.append(shuffled(spark) - before)
        return out

    monkeypatch.setattr(near_dedup, "tied_families", measured)
    monkeypatch.setattr(near_dedup, "BLOCK", 8)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for n in (512, 1024):
            base = rng.integers(0, 256, near_dedup.POSITIONS).astype(np.uint8)
            sigs = [changed(base, rng.choice(128, 12, replace=False)) for _ in range(n)]
            # within reach of few of the family; far from it, but of the same first chunk; and a copy of that
            sigs.append(changed(sigs[7], 40 + rng.choice(88, 42, replace=False)))
            far = np.concatenate((base[:8], rng.integers(0, 256, 120).astype(np.uint8)))
            sigs += [far, changed(far, 60 + np.arange(40)), np.concatenate((base[:8], rng.integers(0, 256, 120).astype(np.uint8)))]
            x = np.array(sigs)
            forest = near_dedup.Forest()
            for i in range(len(x)):
                for j in np.flatnonzero((x[i] != x).sum(axis=1) <= near_dedup.REACH).tolist():
                    forest.join(i, j)
            nodes = spark.createDataFrame([(i, 100, s.tobytes()) for i, s in enumerate(sigs)], "id long, n long, sig binary")
            got = {r.id: r.comp for r in near_dedup.families(nodes, 80, Scratch(spark)).collect()}
            assert {i: got.get(i, i) for i in range(len(x))} == {i: forest.top(i) for i in range(len(x))}
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    # twice the family: twice the rows that move, not four times
    assert cost[1] < 2.2 * cost[0], cost


def test_bytes_of_signatures_that_differ_are_counted(spark):
    rows = [(0,), (1,), (-1,), (-(1 << 63),), (0x0100F00000800010,), (0x7F00000000000000,)]
    got = spark.createDataFrame(rows, "x long").select("x", near_dedup._told_apart(F.col("x")).alias("d")).collect()
    assert [r.d for r in got] == [sum(b > 0 for b in r.x.to_bytes(8, "little", signed=True)) for r in got]


def test_links_between_is_a_spanning_forest():
    rng = np.random.default_rng(3)
    base = [f"q{i}" for i in range(60)]
    texts = [" ".join(w if rng.random() > rng.choice([0, 0.02, 0.06]) else f"x{rng.integers(9)}" for w in base) for _ in range(80)] + ["", "q1"]
    sets = [near_dedup._shingles(near_dedup.words_of(t), 2) for t in texts]
    hit = {(i, j) for i in range(len(sets)) for j in range(len(sets)) if i != j and sets[i] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])}

    def comps(pairs):
        f = near_dedup.Forest()
        return [f.join(a, b) for a, b in pairs], [f.top(i) for i in range(len(texts))]

    got = near_dedup.links_between(texts, None, 2, 80)
    joined, top = comps(got)
    assert all(joined) and set(got) <= hit and top == comps(hit)[1]
    got = near_dedup.links_between(texts[:30], texts[30:], 2, 80)
    joined, top = comps(got)
    assert all(joined) and set(got) <= hit and top == comps({(a, b) for a, b in hit if a < 30 <= b})[1]


def test_substring_dedup(spark):
    run = " ".join(f"r{i}" for i in range(25))
    texts = TEXTS + ["lead " + run + " end", run + " other", "same " * 60, "same " * 45, run + " " + run]
    got = by_id(substring_dedup.substring_dedup_query(docs(spark, texts)))
    seen = set()
    for i, t in enumerate(texts):
        w, gone = words(t), set()
        for s in range(len(w) - 19):
            g = tuple(w[s : s + 20])
            if g in seen:
                gone |= set(range(s, s + 20))
            seen.add(g)
        kept = " ".join(x for p, x in enumerate(w) if p not in gone)
        assert (got[i].n_words, got[i].n_removed, got[i].kept_sha256) == (len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()), i
    assert substring_dedup.remove_repeats(docs(spark, texts)).columns == docs(spark).columns


def brute_cut(rows):
    """Counter of (doc_id, n_words, n_removed, digest): each row cut by its own text, places compared by (id, start)."""
    first, split = {}, [(-(2**63) if i is None else i, i, words(t)) for i, t in rows]
    for k, _, w in split:
        for s in range(len(w) - 19):
            g = tuple(w[s : s + 20])
            first[g] = min(first.get(g, (k, s)), (k, s))
    out = Counter()
    for k, i, w in split:
        gone = {s + x for s in range(len(w) - 19) if first[tuple(w[s : s + 20])] < (k, s) for x in range(20)}
        kept = " ".join(x for p, x in enumerate(w) if p not in gone)
        out[i, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()] += 1
    return out


def test_texts_of_one_doc_id_are_told_apart(spark, monkeypatch):
    """Thousands of texts without an id, and ids with several texts; buckets reached in one step and in two."""
    rng = np.random.default_rng(8)
    run = [f"r{i}" for i in range(60)]
    rows = [(7, " ".join(run[:25])), (7, " ".join(f"q{i}" for i in range(40))), (1, " ".join(f"q{i}" for i in range(22))), (7, " ".join(run[:25]))]
    for i in range(3000):
        at = int(rng.integers(0, 40))
        middle = run[at : at + 20 + i % 3] if i % 7 == 0 else [f"m{i}"] * (i % 4)
        rows.append((None if i % 3 else int(rng.integers(0, 40)), " ".join([f"a{i}"] * (i % 5) + middle + [f"z{i}"] * 25)))
    d = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    want = brute_cut(rows)
    for routes, flush in ((256, 600_000), (2, 500)):
        monkeypatch.setattr(substring_dedup, "ROUTES", routes)
        monkeypatch.setattr(substring_dedup, "FLUSH", flush)
        assert Counter(map(tuple, substring_dedup.substring_dedup_query(d).collect())) == want


def test_every_window_holds_a_span():
    rng = np.random.default_rng(1)
    for alphabet in (1, 2, 50):
        w = rng.integers(1, alphabet + 1, 600).astype(np.uint64)
        lo, hi, name = substring_dedup.spans(w, np.array([400, 200]))
        again = substring_dedup.spans(np.concatenate((w[:400], w[:400])), np.array([400, 400]))
        assert len(lo) == len(name)
        half = again[0] < 400  # equal texts have equal symbols at equal places
        assert np.array_equal(again[0][half], again[0][~half] - 400) and np.array_equal(again[2][half], again[2][~half])
        covered = substring_dedup._covered(lo, hi, 600, 20)
        assert covered[np.r_[0:381, 400:581]].all()


def test_tokenizers(spark):
    from tokenizers import Tokenizer

    plain = [t or "" for t in TEXTS]
    tok = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    got = by_id(token_counts.token_count_query(docs(spark), P.path("byte_bpe_50k.json")))
    assert [got[i].n_tokens for i in range(len(plain))] == [len(e.ids) for e in tok.encode_batch(plain, add_special_tokens=False)]
    tok = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    ids = [np.array([*e.ids, 1], "<u4") for e in tok.encode_batch(plain, add_special_tokens=False)]
    got = by_id(token_shards.token_shard_query(docs(spark), P.path("word_bpe_49k.json")))
    start = np.cumsum([0, *map(len, ids)])
    assert [(got[i].start, got[i].n_tokens, got[i].ids_crc32) for i in range(len(ids))] == [(start[i], len(x), zlib.crc32(x.tobytes())) for i, x in enumerate(ids)]


def test_wavelet_matrix():
    ids = np.random.default_rng(0).integers(0, 700, 3000).astype(np.uint16)
    _, _, m = token_shards.open_shard(token_shards.shard_bytes([7], [3000], ids))
    assert (m.decode() == ids).all() and [m.access(i) for i in range(0, 3000, 37)] == ids[::37].tolist()
    for v in (0, 5, 699, 70000):
        assert m.positions(v) == np.flatnonzero(ids == v).tolist() and m.rank(v, 1500) == int((ids[:1500] == v).sum())


def test_token_shards_equal_the_library_on_every_character():
    import random

    from tokenizers import Tokenizer

    rnd, every = random.Random(2), [chr(i) for i in range(0x10000) if not 0xD800 <= i < 0xE000]
    mixed = [chr(i) for i in range(0x180)] + list("漢字😀ΣσÅ") + ["<|endoftext|>", " the "]
    texts = every + [f"x {c} y" for c in every] + ["".join(rnd.choice(mixed) for _ in range(rnd.randrange(1, 30))) for _ in range(3000)]
    with open(P.path("word_bpe_49k.json"), "rb") as f:
        source = f.read()
    want = [np.array(e.ids, "<u2").tobytes() for e in Tokenizer.from_buffer(source).encode_batch(texts, add_special_tokens=False)]
    assert list(token_shards.encode_texts(source, texts)) == want


def best_total(score, unknown, text):
    """The best segmentation's sum of scores, by trying every piece at every place."""
    marked = "▁" + text.replace(" ", "▁") if text else ""
    best, most = [0.0] + [None] * len(marked), max(map(len, score))
    for i in range(len(marked)):
        for j in range(i + 1, min(len(marked), i + most) + 1):
            s = score.get(marked[i:j], unknown if j == i + 1 else None)
            if s is not None and (best[j] is None or best[i] + s > best[j]):
                best[j] = best[i] + s
    return best[-1]


def test_unigram(spark):
    import random

    from sentencepiece import sentencepiece_model_pb2 as pb

    with open(P.path("piece_bpe_32k.model"), "rb") as f:
        data = f.read()
    proto = pb.ModelProto()
    proto.ParseFromString(data)
    score = {p.piece: p.score for p in proto.pieces if p.type == 1}
    by_id_, as_byte = [p.score for p in proto.pieces], {i: int(p.piece[1:-1], 16) for i, p in enumerate(proto.pieces) if p.type == 6}
    c, rnd = unigram.codec(data), random.Random(5)
    texts = ["hello world", "a  b", "a   b", "漢字😀x\ny", "the thinking", "", " ", "   x", "\x1c"]
    for k in range(300):
        texts.append((" " * rnd.randrange(40) if k % 3 else "") + "".join(rnd.choice("ab  \t\n  theE漢字é😀.,") for _ in range(rnd.randrange(40))))
    for t in texts:
        ids = c.encode(t).tolist()
        unknown = bytes(as_byte[i] for i in ids if i in as_byte).decode()
        total = sum(by_id_[i] for i in ids if i not in as_byte) + (min(score.values()) - 10) * len(unknown)
        assert abs(total - best_total(score, min(score.values()) - 10, t)) < 1e-3 and c.decode(ids_array(ids)) == t, t
    out = by_id(unigram.unigram_query(docs(spark), P.path("piece_bpe_32k.model")))
    assert len(out) == len(TEXTS) and all(r.round_trip for r in out.values())
    for i, t in enumerate(TEXTS):
        assert out[i].ids == c.encode(t or "").tolist() and out[i].n_tokens == len(out[i].ids)
        assert out[i].ids_crc32 == zlib.crc32(np.array(out[i].ids, "<u4").tobytes())
    assert unigram.unigram_query(docs(spark, []), P.path("piece_bpe_32k.model")).count() == 0


def test_unigram_pieces_of_several_words():
    """A model may have pieces that reach over a word's end: then texts are not parted at markers."""
    scores = {"▁": -5.0, "a": -3.0, "b": -3.0, "▁a": -4.0, "a▁b": -1.0, "▁b": -3.5}
    pieces = list(scores)
    m = unigram.Model(pieces, unigram.Trie.build([p.encode() for p in pieces]), list(range(len(pieces))), list(scores.values()), list(range(100, 356)), -50.0)
    units = m.unit_pattern().findall("▁a▁b▁b")
    assert sum(scores[pieces[i]] for u in units for i in m.segment(u)) == best_total(scores, -50.0, "a b b")


def ids_array(ids):
    return np.array(ids, "<i4")


def test_chat(spark):
    rows = [(1, 0, 1, "message", "user", "hi <|im_end|>"), (1, 1, 2, "message", "assistant", "dr"), (1, 1, 3, "delta", None, "aft"), (1, 1, 4, "regenerate", "assistant", "new"),
            (1, 1, 5, "delta", None, " \\ text"), (1, 0, 6, "edit", "user", "hello <|x"), (2, 0, 1, "message", None, None)]
    e = spark.createDataFrame(rows, "conv_id long, msg long, seq long, kind string, role string, text string")
    got = {r.conv_id: r for r in chat.parse(chat.render(chat.fold(e))).collect()}
    assert [(t.role, t.text) for t in got[1].turns] == [("user", "hello <|x"), ("assistant", "new \\ text")] and got[1].loss_texts == ["new \\ text"]
    assert [(t.role, t.text) for t in got[2].turns] == [("", "")]
    empty = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    r = chat.chat_query(spark, empty).collect()
    assert [(x.conv_id, x.n_turns, x.loss_chars) for x in r] == [(-1, 2, 34)]


def test_classifiers_learn_and_score_everything(spark):
    import random

    rnd, rows, labels = random.Random(0), [], []
    for i in range(400):
        bad, tox = i % 4 == 0, i % 3 == 0
        w = [rnd.choice("red green blue tree house river cloud stone light wind".split()) for _ in range(60)]
        if tox:
            for _ in range(4):
                w[rnd.randrange(60)] = rnd.choice(["zorgulous", "blastoidy"])
        if bad:
            w = [x.upper() + "$$$" for x in w]
        rows.append((i, "\n".join(" ".join(w[k : k + 12]) for k in range(0, 60, 12))))
        labels.append((i, int(not bad), int(tox)))
    d = spark.createDataFrame(rows + [(1000, None), (1001, "")], "doc_id long, text string")
    y = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    for f, name, col in ((quality_crf.quality_query, "quality", 1), (toxicity.toxicity_query, "toxic", 2)):
        got = by_id(f(d, y))
        assert len(got) == 402 and all(0 <= r.score <= 1 for r in got.values())
        held = [i for i in range(400) if got[i].held_out]
        assert held and sum(got[i].predicted == labels[i][col] for i in held) / len(held) > 0.9, name


def test_forward_backward_equals_all_label_paths():
    from itertools import product

    rng = np.random.default_rng(4)
    counts = np.array([3, 1, 0, 5, 4, 2])
    n = int(counts.sum())
    emit, trans = rng.normal(size=(n, 2)), rng.normal(size=(2, 2))
    good, pairs, logz = quality_crf.forward_backward(emit, trans, quality_crf.Chains(counts))
    want, want_pairs, total, at = np.zeros(n), np.zeros((2, 2)), 0.0, 0
    for k in counts.tolist():
        paths = list(product((0, 1), repeat=k))
        weight = np.array([np.exp(sum(emit[at + i, s] for i, s in enumerate(p)) + sum(trans[a, b] for a, b in zip(p, p[1:]))) for p in paths])
        total += np.log(weight.sum()) if k else 0.0
        for p, w in zip(paths, weight / weight.sum()):
            for i, s in enumerate(p):
                want[at + i] += w * s
            for a, b in zip(p, p[1:]):
                want_pairs[a, b] += w
        at += k
    assert np.allclose(good, want) and np.allclose(pairs, want_pairs) and np.isclose(logz, total)


def test_document_means_weigh_lines_by_length():
    model = quality_crf.Model(np.random.default_rng(1).normal(size=3 * quality_crf.BASE + 1), np.array([[0.5, -0.2], [0.1, 0.4]]), None)
    texts = [t or "" for t in TEXTS] + ["one line\n\nanother longer line here\n### $$$"]
    got = model.document_means(texts)
    for t, g in zip(texts, got):
        x, size, counts = quality_crf.line_features([t])
        if not len(x):
            assert np.isnan(g)
            continue
        good, _, _ = quality_crf.forward_backward(np.column_stack([np.zeros(len(x)), x @ model.weights]), model.trans, quality_crf.Chains(counts))
        m = np.clip((good * [len(ln.encode()) for ln in t.split("\n") if ln]).sum() / sum(len(ln.encode()) for ln in t.split("\n") if ln), 1e-4, 1 - 1e-4)
        assert np.isclose(g, np.log(m / (1 - m)))


def test_toxicity_windows_cover_the_text():
    rng = np.random.default_rng(0)
    for text in ("one two three four five six seven", "one", "a b", "漢字仮名交文" * 50, "abcdefghij" * 30, "é漢" * 70, "x " * 5 + "สวัสดี" * 30 + " y z", "one\u00a0two" * 20):
        got, words = toxicity.windows(text), text.encode().split()
        for w in words:
            if len(w) <= toxicity.LONG:
                assert any(w in g.split() for g in got)
            else:  # every stretch of 16 bytes that starts at a character lies in a window
                for at in rng.integers(0, len(w) - 16, 30).tolist():
                    if w[at] & 0xC0 != 0x80:
                        assert any(w[at : at + 16] in g for g in got), (text, at)
    assert toxicity.windows("a b c d e f") == [b" a b c ", b" c d e ", b" e f "]
    assert toxicity.windows("") == [] == toxicity.windows(" \n ")


def test_toxicity_hits_equal_plain_compression(spark):
    import zstandard

    model = toxicity.Model(b"the river and a zorgulous house by the river", b"the river and a stone house by the river", np.zeros(13))

    def length(content, w):
        d = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        return len(zstandard.ZstdCompressor(level=toxicity.LEVEL, dict_data=d, write_content_size=False, write_dict_id=False).compress(w))

    texts = [*TEXTS, "a zorgulous stone house zorgulous river and more", "by the zorgulous, zorgulous river"]
    got = {r.doc_id: r for r in toxicity._counts(docs(spark, texts), model).collect()}
    for i, t in enumerate(texts):
        w = toxicity.windows(t or "")
        apart = [length(model.ordinary, x) - length(model.toxic, x) for x in w]
        assert got[i].n == len(w) and got[i].hits == [sum(a >= x for a in apart) for x in toxicity.THRESHOLDS]
    assert got[len(texts) - 1].hits[2] > 0


def test_toxicity_finds_what_stands_late_in_long_runs(spark):
    import random

    rnd, rows, labels = random.Random(1), [], []
    signs = [chr(0x4E00 + 7 * i) for i in range(300)]
    for i in range(400):
        w = "".join(rnd.choice(signs) for _ in range(90))
        if i % 3 == 0:  # beyond the first 64 bytes
            at = rnd.randrange(40, 90)
            w = w[:at] + "魑魅魍魎" + w[at:]
        rows.append((i, w))
        labels.append((i, 1, int(i % 3 == 0)))
    d = spark.createDataFrame(rows, "doc_id long, text string")
    got = by_id(toxicity.toxicity_query(d, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")))
    held = [i for i in range(400) if got[i].held_out]
    assert sum(got[i].predicted == labels[i][2] for i in held) / len(held) > 0.9


def test_classifiers_on_awkward_rows(spark):
    rows = [(i, t, "e", 0.5, "s") for i, t in enumerate(TEXTS)] + [(None, "one two", "e", 0.5, "s"), (3, "one", "f", 0.5, "s"), (3, "one", "f", 0.5, "s"), (8, "another text", "e", 0.5, "s")]
    d = spark.createDataFrame(rows, "doc_id long, text string, extra string, score double, held_out string")
    labels = [(i, i % 2, i % 2) for i in range(len(TEXTS))] + [(None, 1, 1), (3, None, None), (3, 0, 0)]
    y = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    for f in (quality_crf.quality_query, toxicity.toxicity_query):
        for frame in (d, d.limit(0)):
            for marks in (y, y.limit(0), y.filter("toxic = 1")):
                got = f(frame, marks).collect()
                assert len(got) == frame.count() and all(0 <= r.score <= 1 for r in got)
    out = toxicity.score_documents(d, toxicity.Model())
    assert sorted(out.columns) == sorted([*d.columns, "toxic_windows"]) and out.count() == len(rows)


AWKWARD = [(i, t, "e") for i, t in enumerate(TEXTS)] + [
    (None, "one two", "e"), (None, LONG, "e"), (3, "one", "f"), (3, "one", "f"), (8, "another text " + LONG, "e"), (7, LONG, "e"), (5, None, "e"), (-4, LONG + " tail", "e"),
    (20, " ".join(f"b{i}" for i in range(20)) + " and so on", "e"), (20, " ".join(f"b{i}" for i in range(20)) + " and so on", "e")]
CLASHES = ["extra", "n_words", "kept", "hits", "hit", "w", "items", "ids", "_row", "failed", "_t", "row", "pos", "doc", "score", "base_failed", "size", "h", "decoded"]


def awkward(spark, rows=AWKWARD):
    d = spark.createDataFrame(rows, "doc_id long, text string, extra string")
    for c in CLASHES[1:]:
        d = d.withColumn(c, d["extra"])
    return d


def test_awkward_rows_equal_sql(spark):
    import duckdb
    import pandas as pd

    from barflow.llm import sql

    bench = [(1, " ".join(f"b{i}" for i in range(20))), (2, None), (3, ""), (None, "one two"), (5, "one two")]
    b = spark.createDataFrame(bench, "item_id long, text string")
    for rows in (AWKWARD, []):
        d, con = awkward(spark, rows), duckdb.connect()
        con.register("documents", pd.DataFrame(rows, columns=["doc_id", "text", "extra"]).astype({"doc_id": "Int64", "text": "string", "extra": "string"}))
        con.register("benchmark", pd.DataFrame([x for x in bench if x[0] is not None], columns=["item_id", "text"]).astype({"item_id": "int64", "text": "string"}))
        for name, f in {
            "op2_quality_rules": lambda: quality_rules.quality_rules_query(d),
            "op8_decontaminate": lambda: decontaminate.decontaminate_query(d, b.filter("item_id is not null")),
            "op9_substring_dedup": lambda: substring_dedup.substring_dedup_query(d),
        }.items():
            got, cur = f(), con.execute(sql.oracle_sql()[name])
            names = [c[0] for c in cur.description]
            want = sorted((tuple(r[names.index(c)] for c in got.columns) for r in cur.fetchall()), key=str)
            assert sorted(map(tuple, got.collect()), key=str) == want, name
            if rows and name != "op9_substring_dedup":
                assert len(want) == len(rows)
    assert decontaminate.decontaminate_query(awkward(spark), b).count() == len(AWKWARD)


def test_awkward_rows_keep_their_columns(spark):
    d = awkward(spark)
    b = spark.createDataFrame([(1, " ".join(f"b{i}" for i in range(20)))], "item_id long, text string")
    for f, n in ((quality_rules.keep_documents, None), (near_dedup.keep_one, None), (substring_dedup.remove_repeats, len(AWKWARD)),
                 (lambda x: decontaminate.remove_documents(x, b), len(AWKWARD) - 2), (lambda x: decontaminate.remove_spans(x, b), len(AWKWARD))):
        out = f(d).collect()
        assert not out or list(out[0].asDict()) == d.columns
        assert n is None or len(out) == n
        assert all(r[c] in ("e", "f") for r in out for c in CLASHES)
        assert f(awkward(spark, [])).columns == d.columns and f(awkward(spark, [])).count() == 0


def test_awkward_rows_through_the_tokenizers(spark):
    from tokenizers import Tokenizer

    plain = [(i, t or "") for i, t, _ in AWKWARD]
    tok = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    got = Counter((r.doc_id, r.n_bytes, r.n_tokens) for r in token_counts.token_count_query(awkward(spark), P.path("byte_bpe_50k.json")).collect())
    assert got == Counter((i, len(t.encode()), len(tok.encode(t, add_special_tokens=False).ids)) for i, t in plain)
    tok, at, want = Tokenizer.from_file(P.path("word_bpe_49k.json")), 0, Counter()
    for i, t in sorted(plain, key=lambda x: (x[0] is not None, x[0] or 0, x[1].encode())):
        ids = np.array([*tok.encode(t, add_special_tokens=False).ids, 1], "<u4")
        want[i, at, len(ids), zlib.crc32(ids.tobytes())] += 1
        at += len(ids)
    assert Counter((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in token_shards.token_shard_query(awkward(spark), P.path("word_bpe_49k.json")).collect()) == want
    model = P.path("piece_bpe_32k.model")
    both = unigram.decode_documents(unigram.encode_documents(awkward(spark), model), model).collect()
    assert Counter((r.doc_id, r.decoded) for r in both) == Counter((i, t.replace("▁", " ")) for i, t in plain)
    out = unigram.unigram_query(awkward(spark), model).collect()
    assert Counter((r.doc_id, r.n_tokens) for r in out) == Counter((r.doc_id, r.n_tokens) for r in both)
    for f in (token_counts.token_count_query, unigram.unigram_query):
        assert f(awkward(spark, []), model if f is unigram.unigram_query else P.path("byte_bpe_50k.json")).count() == 0
    assert token_shards.token_shard_query(awkward(spark, []), P.path("word_bpe_49k.json")).count() == 0


def test_awkward_conversations(spark):
    rows = [(1, 0, "user", None, "x"), (1, 0, "user", None, "x"), (1, None, None, "no turn", "x"), (None, 1, "assistant", LONG, "x"), (2, 5, "assistant", "a\\<|im_end|>\n<|x", "x"), (2, 5, "user", "", "x")]
    c = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, seq string")
    got = {r.conv_id: r for r in chat.chat_query(spark, c).collect()}
    assert {k: r.n_turns for k, r in got.items()} == {1: 3, None: 1, 2: 2, -1: 2}
    assert got[None].loss_sha256 == hashlib.sha256(LONG.encode()).hexdigest() and got[2].loss_chars == len("a\\<|im_end|>\n<|x")


def test_pipeline_equals_brute_force_stage_by_stage(spark, tmp_path):
    import duckdb
    import pandas as pd

    from barflow.llm import sql

    rnd = np.random.default_rng(0)
    vocabulary = [f"wo{i}" for i in range(900)] + ["the", "and", "of"] * 100
    texts = [" ".join(rnd.choice(vocabulary, 120)) for _ in range(30)]
    passage = " ".join(rnd.choice(vocabulary, 60))
    texts += [texts[0], texts[1] + " the end", "too short", "### $$$ " * 60, None, texts[4][: len(texts[4]) // 2] + " " + texts[5], "  " + texts[6].upper().lower() + "\n"]
    texts += [" ".join(rnd.choice(vocabulary, 80)) + "\n" + passage + " " + " ".join(rnd.choice(vocabulary, 50)) for _ in range(4)]
    bench = [(1, texts[2]), (2, " ".join(texts[7].split()[30:50])), (3, None)]
    columns = ["doc_id", "text", "lang", "source", "n_chars"]
    table = [(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)]
    spark.createDataFrame(table, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))

    con = duckdb.connect()
    con.register("documents", pd.DataFrame(table, columns=columns).astype({"text": "string"}))
    cur = con.execute(sql.oracle_sql()["op2_quality_rules"])
    at = [c[0] for c in cur.description]
    kept = {r[at.index("doc_id")]: texts[r[at.index("doc_id")]] for r in cur.fetchall() if r[at.index("kept")]}
    # one of each group of near copies
    sets, comp = {i: near_dedup._shingles(near_dedup.words_of(t), 5) for i, t in kept.items()}, {i: i for i in kept}
    for i in sorted(kept):
        for j in kept:
            if i != j and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                old, new = max(comp[i], comp[j]), min(comp[i], comp[j])
                comp = {k: new if c == old else c for k, c in comp.items()}
    kept = {i: t for i, t in kept.items() if comp[i] == i}
    # no stretch that occurs earlier
    seen, cut = set(), {}
    for i in sorted(kept):
        w, gone = words(kept[i]), set()
        for k in range(len(w) - 19):
            g = tuple(w[k : k + 20])
            if g in seen:
                gone |= set(range(k, k + 20))
            seen.add(g)
        cut[i] = " ".join(x for k, x in enumerate(w) if k not in gone) if gone else kept[i]
    # no contaminated document
    marks = [norm(t) for _, t in bench if t]
    windows = {tuple(m[k : k + 13]) for m in marks for k in range(max(len(m) - 12, 1))}
    for i in list(cut):
        w = norm(cut[i])
        hit = {p + q for p in range(len(w)) for q in range(13) if tuple(w[p : p + 13]) in windows}
        if hit and 20 * len(hit) >= len(w):
            del cut[i]

    c = unigram.codec(open(P.path("piece_bpe_32k.model"), "rb").read())
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert set(got) == set(cut) and len(cut) < 36 and any(t != kept[i] for i, t in cut.items())
    assert all(got[i].ids == c.encode(t).tolist() and c.decode(np.array(got[i].ids)) == t for i, t in cut.items())
