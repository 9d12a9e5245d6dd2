"""Source divergence, mixing and conversation repair against brute force on small, awkward tables."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

import pytest

from barflow.llm import divergence, mixing, prefix, repair

DOCS = "doc_id long, text string, lang string, source string, item string, _uid string"


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


def awkward(n=120):
    rng = random.Random(5)
    vocabulary = ["alpha", "Beta", "GAMMA", "été", "ÉTÉ", "naïve", "x1y", "漢字", "delta", "rare"]
    rows = [(None, None, None, None, "e", "u"), (None, "", "", "", "e", "u"), (7, "  \n\t", "en", "b", "e", "u"), (8, "1 2 3 --", "xx", "only", "e", "u")]
    for i in range(n):
        text = " ".join(rng.choices(vocabulary, weights=range(10, 0, -1), k=rng.choice([1, 3, 9, 40])))
        rows.append((rng.choice([i, None, 3]), text, rng.choice(["en", "en", "de", None]), rng.choice(["a", "a", "a", "b", "é", None]), "e", "u"))
    return rows + rows[5:25]


def brute_divergence(rows, least, top):
    data = [(lang or "", source or "", re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate({i: i + 32 for i in range(65, 91)})))
            for _, text, lang, source, *_ in rows]
    in_docs, counts = defaultdict(Counter), defaultdict(Counter)
    for lang, source, w in data:
        in_docs[lang].update(set(w))
        counts[lang, source].update(w)
    out = []
    for lang in {d[0] for d in data}:
        kept = [t for t, n in in_docs[lang].items() if n >= least]
        v, sources = len(kept), sorted(s for k, s in counts if k == lang)

        def share(n):
            total = sum(n[t] for t in kept)
            return {t: 1 + 1000000000 * (n[t] + 2) // (total + 2 * v) for t in kept}

        f = lambda p, q: (p - q) * (p - q) // (p + q)
        whole = Counter()
        for s in sources:
            whole.update(counts[lang, s])
        p, q = {s: share(counts[lang, s]) for s in sources}, share(whole)
        for s in sources:
            pairs = [(-sum(f(p[s][t], p[o][t]) for t in kept), o) for o in sources if o != s]
            best = [(-f(p[s][t], q[t]), t) for t in kept if counts[lang, s][t] and p[s][t] > q[t]]
            for part, found in (("pair", pairs), ("term", best)):
                found = sorted(found, key=lambda x: (x[0], x[1].encode()))[: None if part == "pair" else top]
                out += [(lang, s, part, item, -value, i + 1) for i, (value, item) in enumerate(found)]
    return sorted(out)


@pytest.mark.parametrize("width", [8, 1 << 10])
def test_divergence(spark, monkeypatch, width):
    """A sketch of 8 cells drops next to nothing, one of 1,024 nearly all rare terms; the result is the same."""
    monkeypatch.setattr(divergence, "FLUSH", 6)
    rows = awkward()
    docs = spark.createDataFrame(rows, DOCS).repartition(3)
    got = divergence.divergence(docs, 10, 3, width, 2)
    assert got.dtypes == [("lang", "string"), ("source", "string"), ("part", "string"), ("item", "string"), ("value", "bigint"), ("rank", "int")]
    assert sorted(tuple(r) for r in got.collect()) == brute_divergence(rows, 10, 3)
    assert divergence.divergence_query(spark.createDataFrame([], DOCS)).count() == 0


def test_sketch_never_underestimates(spark):
    rows = [(i, " ".join(f"{c}w" for c in "abcdefghij"[: i % 10 + 1]), "en", "s", "e", "u") for i in range(60)]
    docs = spark.createDataFrame(rows, DOCS).repartition(4)
    bits = divergence.sketch(docs, least=10, width=1 << 12, depth=3)
    found = [f"{c}w".encode() for c in "abcdefghij"] + [b"unseen"]
    n = [sum(1 for i in range(60) if i % 10 >= k) for k in range(10)] + [0]
    assert divergence.may_be_kept(bits, "en", found).tolist() == [x >= 10 for x in n]
    assert not divergence.may_be_kept(bits, "de", found).any()
    assert divergence.sketch(docs, least=300, width=64, depth=2).sum() == 0  # wider cells than a byte


def brute_targets(sizes, weights, share, epochs):
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: Fraction(weights[i % len(weights)]) for i, s in enumerate(names)}
    left, out, open_ = share * sum(sizes.values()), {}, set(names)
    while open_:
        level = left / sum(w[s] for s in open_)
        full = {s for s in open_ if level * w[s] >= epochs * sizes[s]}
        if not full:
            return out | {s: level * w[s] for s in open_}
        out |= {s: Fraction(epochs * sizes[s]) for s in full}
        left -= sum(epochs * sizes[s] for s in full)
        open_ -= full
    return out


def test_mixing(spark):
    rows = awkward()
    docs = spark.createDataFrame(rows, DOCS)
    got = mixing.mixing_query(docs).collect()
    sizes = defaultdict(int)
    for r in rows:
        sizes[r[3]] += len(words(r[1]))
    goal = brute_targets(sizes, (5, 2, 1), Fraction(3, 2), 2)
    assert len(got) == len(rows) and Counter((r.doc_id, r.size) for r in got) == Counter((r[0], len(words(r[1]))) for r in rows)
    taken = defaultdict(int)
    for r in got:
        assert 0 <= r.taken <= 2 * r.size
        taken[r.source_size, round(r.target, 6)] += r.taken
    assert taken == {(sizes[s], round(float(goal[s]), 6)): int(goal[s]) for s in sizes}
    again = mixing.mixing_query(docs.repartition(5)).collect()
    assert Counter(map(tuple, got)) == Counter(map(tuple, again))
    assert mixing.mixing_query(spark.createDataFrame([], DOCS)).count() == 0


def test_mixed_documents(spark):
    rows = awkward()
    docs = spark.createDataFrame(rows, DOCS)
    out = mixing.mix_documents(docs, weights=(1, 3), share=Fraction(2), epochs=3, seed=4)
    assert out.columns == docs.columns
    sizes, mixed = defaultdict(int), defaultdict(int)
    for r in rows:
        sizes[r[3]] += len(words(r[1]))
    texts = {r[1] for r in rows}
    cuts = 0
    for r in out.collect():
        mixed[r.source] += len(words(r.text))
        cuts += r.text not in texts
    goal = brute_targets(sizes, (1, 3), Fraction(2), 3)
    assert {s: mixed[s] for s in sizes} == {s: int(goal[s]) for s in sizes} and cuts <= len(sizes)


def test_targets_level_off(spark):
    for sizes in ({"a": 1, "b": 1000, "c": 1}, {"a": 5}, {"a": 0, "b": 0}, {chr(97 + i): 7**i % 1000 for i in range(20)}):
        table = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
        got = {r.source: r.target for r in mixing.targets(table).collect()}
        want = brute_targets(sizes, (5, 2, 1), Fraction(3, 2), 2)
        assert got == pytest.approx({s: float(x) for s, x in want.items()})


def test_prefix_sums_split_one_key_over_partitions(spark, tmp_path):
    rng = random.Random(1)
    rows = [(i, "hot" if i % 3 else rng.choice([None, "x", "y"]), rng.randrange(20), rng.randrange(9)) for i in range(900)]
    spark.createDataFrame(rows, "u long, k string, o long, v long").write.parquet(f"{tmp_path}/t")
    df = prefix.prefix_sums(spark.read.parquet(f"{tmp_path}/t"), ["k"], ["o", "u"], {"before": "v"}, rows=50)
    so_far, got = defaultdict(int), {r.u: r.before for r in df.collect()}
    for u, k, o, v in sorted(rows, key=lambda r: (r[2], r[0])):
        assert got.pop(u) == so_far[k]
        so_far[k] += v
    assert not got


KEEP = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (3, "u"): 2, (2, "a"): 3}


def brute_audit(codes):
    """The least (cost, initials) of what is left, from the last row on."""
    step, role = [2, 2, 3, 2], "uuau"
    best = {0: (0, ""), 3: (0, "")}
    for q, to in ((2, 3), (1, 2)):
        best[q] = (best[to][0] + 2, "I" + best[to][1])
    for code in reversed(codes):
        here = {}
        for q in range(4):
            ways = [(best[q][0] + 3, "D" + best[q][1])]
            if code not in "bd":
                more = code.isupper()
                for edit, cost, to in (("K", 0, KEEP.get((q, code.lower()))), ("R", 2, step[q])):
                    if to is not None:
                        ways.append((best[to][0] + cost + more, edit + best[to][1]))
            here[q] = min(ways)
        for _ in range(3):  # insertions: no list of three helps
            here = {q: min(here[q], (here[step[q]][0] + 2, "I" + here[step[q]][1])) for q in range(4)}
        best = here
    return best[0] + (role,)


def test_dial_finds_the_least_audit():
    rng = random.Random(2)
    for n in range(40):
        for _ in range(12):
            codes = "".join(rng.choice(repair.CODES) for _ in range(n))
            dist = repair.distances(codes)
            audit, q = repair.walk(codes, dist, 0)
            assert (dist[0], audit + repair._tail(q)) == brute_audit(codes)[:2], codes


def brute_repair(rows, damage):
    """conv_id -> the contract's columns, row by row."""
    out = {}
    for conv in {r[0] for r in rows}:
        own = []
        for c, turn, role, text, *_ in rows:
            if c != conv:
                continue
            s = lambda x: " " if x is None else str(x)
            h = zlib.crc32(f"{s(c)}:{s(turn)}".encode()) % 20 if damage else 9
            role, text = s(role), s(text)
            text = "" if h == 1 else re.sub("[.!?]", "", text) if h == 2 else text
            own += [(turn, "user" if h == 4 else role, text)] * (0 if h == 0 else 2 if h == 3 else 1)
        own.sort(key=lambda r: ((r[0] is not None, r[0] or 0), r[1].encode(), r[2][: repair.HEAD].encode(), hashlib.sha256(r[2].encode()).hexdigest()))
        seen, codes, n = set(), "", Counter()
        for _, role, text in own:
            bare = text.rstrip(" \t\n\v\f\r")
            kind = role[:1] if role[:1] in ("s", "u", "a") else "x"
            code = "b" if not bare else "d" if (role, text) in seen else kind if bare[-1] in ".!?" else kind.upper()
            seen.add((role, text))
            codes += code
            n[code if code in "bd" else "t" if code.isupper() else ""] += 1
        cost, audit, _ = brute_audit(codes)
        lines, q, i = [], 0, 0
        for e in audit:
            role = ["user", "user", "assistant", "user"][q]
            if e in "IR":
                lines.append(f"{role}:" + (own[i][2] if e == "R" else ""))
                q = [2, 2, 3, 2][q]
            elif e == "K":
                lines.append(f"{own[i][1]}:{own[i][2]}")
                q = KEEP[q, own[i][1][:1]]
            i += e != "I"
        turns = {t for t, *_ in own if t is not None}
        illegal = sum(x[1][:1] + y[1][:1] not in ("su", "ua", "au") for x, y in zip(own, own[1:]))
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        out[conv] = (gaps, n["b"], n["d"], n["t"], illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()), lines
    return out


TALK = "conv_id long, turn long, role string, text string, _idx string, _conv string"


def talks(n=60):
    rng = random.Random(3)
    rows = [(None, None, None, None), (None, 1, "user", "a."), (5, None, "user", "ok?"), (5, None, "user", "ok?"), (6, 2**60, "assistant", " \n"), (6, 0, "", "é!")]
    for c in range(10, 10 + n):
        for t in range(rng.randrange(1, 12)):
            text = rng.choice(["Hi.", "Yes!", "No", "", "x. \n", "漢字?", "long " * 30 + ".", "long " * 30 + "b."])
            rows.append((c, t + rng.choice([0, 0, 0, 3]), rng.choice(["system", "user", "user", "assistant", "tool", "User"]), text))
    return [(*r, "e", "c") for r in rows]


@pytest.mark.parametrize("chunk", [2, 10_000])
def test_repair(spark, monkeypatch, chunk):
    monkeypatch.setattr(repair, "CHUNK", chunk)
    rows = talks()
    table = spark.createDataFrame(rows, TALK)
    for damage, run in ((True, repair.repair_query), (False, repair.audit)):
        got = run(table)
        assert got.columns == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
        assert {r[0]: tuple(r)[1:] for r in got.collect()} == {c: x for c, (x, _) in brute_repair(rows, damage).items()}
    messages = defaultdict(dict)
    for r in repair.repair(table).collect():
        messages[r.conv_id][r.pos] = f"{r.role}:{r.text}"
    assert {c: [m[i] for i in range(len(m))] for c, m in messages.items()} == {c: x for c, (_, x) in brute_repair(rows, False).items() if x}
    assert repair.repair_query(spark.createDataFrame([], TALK)).count() == 0
