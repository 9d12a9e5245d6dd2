"""Near-duplicate detection: MinHash signatures under a multi-index Hamming join.

A text is the set of its word shingles. Its signature has ``POSITIONS`` places of 8 bits,
each the low bits of a minimum over the set; two sets differ in a share of places of
about one minus their similarity. Documents whose signatures differ in at most ``REACH``
places are candidates (for a similarity of 0.8, 25.5 places differ on average, and more
than 45 with a chance of about 1 in 100,000).

The join is by pigeonhole: a signature is split into 23 chunks. Two that differ in at
most 45 places have a chunk in which they differ in one place at most, so they agree on
it with that place left out. Each chunk is filed once per place left out, 128 keys in
all: every pair within reach shares a bucket.

Links, not pairs, are the aim, so texts with equal word sequences are one node, and pairs
are never listed:

1. families. Each bucket has ``LEADERS`` leaders (the first by a hash); a member within reach
   of one joins its family. One bit of each place goes along in the buckets: bits that differ
   are places that differ, so most pairs are told apart there.
2. where a bucket's other members are still of several families, those outside its largest
   family are compared with all members of other families (the largest is never compared with
   itself) and yield the families that they tie together. A bucket of N with m such members
   costs N x m comparisons at most.
3. links. Two nodes within reach are of one family now. Each family is dealt to blocks of
   about ``BLOCK_BYTES`` of text; a task holds two blocks, compares all their full shingle
   sets (by the words, not by hashes), and yields a spanning forest of the links; a family
   of one block, as nearly all are, is settled there.

Components are found by alternating large-star and small-star rounds, each written to the
shared folder. Joins are sort-merge joins on evenly dealt keys, with hubs left to the
adaptive skew split; nothing is collected, and superseded tables are deleted.

Edge cases: null, empty and wordless texts have an empty set, no links, and are their own
component; a text with fewer words than a shingle is one shingle; rows that share a
``doc_id`` are judged each by its own text: ``near_duplicates`` gives a component to a
``doc_id``, so it joins what any of its texts is linked with, while ``keep_one`` follows the
texts alone and removes the rows that are near copies, not others of their ``doc_id`` (rows
equal in ``doc_id`` and text stay or go together); a null ``doc_id`` is linked with nothing
and has a null component; empty tables work; extra columns of any
name are kept by ``keep_one``; ``near_duplicates`` reads ``doc_id`` and ``text`` only.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import MAX_BROADCAST_IDS, Scratch, only_ids
from .hashing import GOLD, WordHash, hash_words, mix
from .pretokens import chunks

POSITIONS, REACH, CHUNKS = 128, 45, 23
_CUTS = np.linspace(0, POSITIONS, CHUNKS + 1).astype(int)
_CHUNK_OF = np.repeat(np.arange(CHUNKS), np.diff(_CUTS))
#: Leaders of a bucket: with these all others are compared first.
LEADERS = 2
#: Members of a bucket's block, about: those that one row meets at a time.
BLOCK = 512
#: Text of a family's block, about: bytes, and nodes.
BLOCK_BYTES, BLOCK_NODES = 1 << 19, 512
#: Cells of a table of shingles (float32) when sets are compared.
CELLS = 1 << 22


def _seeds(n: int, salt: int) -> np.ndarray:
    return mix(np.arange(1, n + 1, dtype=np.uint64) * GOLD + np.uint64(salt)) | np.uint64(1)


def words_of(text: str) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+`` with A-Z lower-cased (bytes methods touch ASCII only)."""
    return text.encode().lower().split()


def shingle_hashes(words: np.ndarray, lengths: np.ndarray, k: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each document."""
    n = len(words)
    acc = np.zeros(max(n - k + 1, 0), np.uint64)
    for j in range(k):
        acc = mix(acc + words[j : n - k + 1 + j] * (GOLD + np.uint64(2 * j)))
    out, at = [], 0
    for m in lengths.tolist():
        if m >= k:
            out.append(np.unique(acc[at : at + m - k + 1]))
        elif m:
            whole = mix(np.array([m], np.uint64))
            for j in range(m):
                whole = mix(whole + words[at + j : at + j + 1] * (GOLD + np.uint64(2 * j)))
            out.append(whole)
        else:
            out.append(np.zeros(0, np.uint64))
        at += m
    return out


def signature(shingles: np.ndarray) -> np.ndarray:
    """``POSITIONS`` bytes: low bits of the minima under as many hash functions."""
    a, b = _seeds(POSITIONS, 1)[:, None], _seeds(POSITIONS, 2)[:, None]
    low = np.full(POSITIONS, ~np.uint64(0))
    for at in range(0, len(shingles), 4096):  # keeps the table small for long texts
        x = shingles[None, at : at + 4096] * a + b
        low = np.minimum(low, (x ^ (x >> np.uint64(31))).min(axis=1))
    return (mix(low) >> np.uint64(56)).astype(np.uint8)


def _texts(docs: DataFrame) -> DataFrame:
    """doc_id, t (hash of the text, which tells apart the rows of one doc_id), text (not null)."""
    text = F.coalesce("text", F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("t"), text.alias("text"))


def signatures(docs: DataFrame, k: int) -> DataFrame:
    """doc_id, t, n (set size), size (bytes of its words), h (digest of the word sequence), sig (null for an empty set)."""

    def emit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        memo = WordHash()
        for df in batches:
            texts, rows = df["text"].tolist(), []
            for a, b in chunks(texts):
                split = [words_of(t) for t in texts[a:b]]
                for w, s in zip(split, shingle_hashes(*hash_words(split, memo), k)):
                    whole = b" ".join(w)
                    digest = hashlib.blake2b(whole, digest_size=16).digest()
                    rows.append((len(s), len(whole), digest, signature(s).tobytes() if len(s) else None))
            yield df[["doc_id", "t"]].assign(**dict(zip(("n", "size", "h", "sig"), zip(*rows) if rows else [()] * 4)))

    return _texts(docs).mapInPandas(emit, "doc_id long, t long, n long, size long, h binary, sig binary")


def bucket_keys(nodes: DataFrame) -> DataFrame:
    """key, place, id: one row for each node and place of its signature left out."""
    table = mix(np.arange(POSITIONS * 256, dtype=np.uint64) + GOLD).reshape(POSITIONS, 256)
    salt = _seeds(POSITIONS, 3)

    def emit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        place = np.arange(POSITIONS)
        for df in batches:
            for at in range(0, len(df), 2000):
                part = df.iloc[at : at + 2000]
                sig = np.frombuffer(b"".join(part["sig"]), np.uint8).reshape(-1, POSITIONS)
                each = table[place, sig]
                rest = np.add.reduceat(each, _CUTS[:-1], axis=1)[:, _CHUNK_OF] - each
                key = mix(rest * GOLD + salt).view(np.int64)
                ids = np.repeat(part["id"].to_numpy(), POSITIONS)
                yield pd.DataFrame({"key": key.ravel(), "place": np.tile(place, len(part)), "id": ids})

    return nodes.select("id", "sig").mapInPandas(emit, "key long, place short, id long")


_LONGS = [f"s{i}" for i in range(POSITIONS // 8)]


def _packed(nodes: DataFrame) -> DataFrame:
    """id, n, one bit of each place (b0, b1), and the signature as longs."""

    def emit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in batches:
            sig = np.frombuffer(b"".join(df["sig"]), np.uint8).reshape(-1, POSITIONS)
            bits = np.packbits(sig & 1, axis=1).view("<i8")
            longs = np.concatenate((bits, sig.view("<i8")), axis=1)
            yield pd.concat([df[["id", "n"]], pd.DataFrame(longs, columns=["b0", "b1", *_LONGS], index=df.index)], axis=1)

    columns = ", ".join(f"{c} long" for c in ("id", "n", "b0", "b1", *_LONGS))
    return nodes.select("id", "n", "sig").mapInPandas(emit, columns)


def _told_apart(x: Column) -> Column:
    """Bytes of a long (an exclusive or) that are not zero."""
    low = x.bitwiseOR(F.shiftrightunsigned(x, 4)).bitwiseAND(F.lit(0x0F0F0F0F0F0F0F0F))
    return F.bit_count((low + F.lit(0x0F0F0F0F0F0F0F0F)).bitwiseAND(F.lit(0x1010101010101010)))


def _sum(parts: list[Column]) -> Column:
    total = parts[0]
    for p in parts[1:]:
        total = total + p
    return total


def _xor(a: str, b: str, columns) -> list[Column]:
    return [F.col(a + c).bitwiseXOR(F.col(b + c)) for c in columns]


def _may_link(a: str, b: str, percent: int) -> Column:
    """Set sizes allow the similarity, and the places' bits do not tell more than ``REACH`` places apart."""
    fits = 100 * F.least(a + "n", b + "n") >= percent * F.greatest(a + "n", b + "n")
    return fits & (_sum([F.bit_count(x) for x in _xor(a, b, ("b0", "b1"))]) <= REACH)


def _within_reach(a: str, b: str, percent: int) -> Column:
    return _may_link(a, b, percent) & (_sum([_told_apart(x) for x in _xor(a, b, _LONGS)]) <= REACH)


def _prefixed(df: DataFrame, prefix: str, columns) -> list[Column]:
    """Columns under a prefix, not null: conditions on them compile to short code."""
    return [F.coalesce(df[c], F.lit(0).cast("long")).alias(prefix + c) for c in columns]


def _few(df: DataFrame) -> DataFrame:
    """``df`` (longs), to be broadcast up to a checked size."""
    return F.broadcast(df) if df.count() * len(df.columns) <= MAX_BROADCAST_IDS else df


class Forest(dict):
    """Disjoint sets, by the least member; ``join`` says whether two were apart."""

    def top(self, x):
        while (up := self.get(x, x)) != x:
            self[x] = self.get(up, up)
            x = up
        return x

    def join(self, x, y) -> bool:
        x, y = self.top(x), self.top(y)
        if x != y:
            self[max(x, y)] = min(x, y)
        return x != y


def _against(blocks: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Each block (keys, block, of) beside each other block of its key once, the other's columns suffixed with 2.

    Block i meets the next half of a circle of blocks, so every block has as many partners.
    """
    half = F.expr("of div 2")
    i = blocks.filter("of > 1").withColumn("d", F.explode(F.sequence(F.lit(1).cast("long"), half)))
    i = i.filter("not (2 * d = of and block >= d)").withColumn("block2", F.col("block") + F.col("d"))
    i = i.withColumn("block2", F.when(F.col("block2") >= F.col("of"), F.col("block2") - F.col("of")).otherwise(F.col("block2")))
    j = blocks.filter("of > 1").select(*keys, F.col("block").alias("block2"), *[F.col(c).alias(c + "2") for c in columns])
    return i.join(j, [*keys, "block2"]).select(*columns, *[c + "2" for c in columns])


def tied_families(filed: DataFrame, packed: DataFrame, percent: int, keep: Scratch) -> DataFrame:
    """a, b: families tied by two members of one bucket within reach, enough to join all that are.

    ``filed`` has key, id, fam. A bucket's largest family is not compared with itself: its other
    members meet the whole bucket, dealt to blocks of about ``BLOCK`` members, and each other once.
    """
    each = filed.groupBy("key", "fam").agg(F.count("*").alias("c"))
    top = F.max_by("fam", F.struct("c", "fam")).alias("top")
    mixed = each.groupBy("key").agg(top, F.ceil(F.sum("c") / BLOCK).alias("of"), F.count("*").alias("fams")).filter("fams > 1")
    mixed = keep.write(mixed.select(F.col("key").alias("in_key"), "top", "of"), "mixed")

    whole = ("n", "b0", "b1", *_LONGS)
    others = filed.join(_few(mixed), (F.col("key") == F.col("in_key")) & (F.col("fam") != F.col("top"))).drop("in_key").join(packed, "id")
    others = others.select("key", F.explode(F.sequence(F.lit(0).cast("long"), F.col("of") - 1)).alias("block"), "top", *_prefixed(others, "o", ("id", "fam", *whole)))
    large = mixed.filter("of > 1").select(F.col("in_key").alias("key"), "of")
    members = filed.join(_few(large), "key", "left").join(packed, "id")
    block = F.pmod(F.xxhash64("id"), F.coalesce("of", F.lit(1).cast("long"))).alias("block")
    members = members.select("key", block, *_prefixed(members, "m", ("id", "fam", *whole)))

    apart = (F.col("ofam") != F.col("mfam")) & ((F.col("mfam") == F.col("top")) | (F.col("mid") > F.col("oid")))
    same = [others[c] == members[c] for c in ("key", "block")]
    met = others.join(members, [*same, apart & _within_reach("o", "m", percent)])
    out = keep.write(met.select(F.least("ofam", "mfam").alias("a"), F.greatest("ofam", "mfam").alias("b")).distinct(), "ties")
    keep.drop(mixed)
    return out


def families(nodes: DataFrame, percent: int, keep: Scratch) -> DataFrame:
    """id, comp of the nodes that are in a family of several: nodes within reach are in one."""
    packed = keep.write(_packed(nodes), "packed")
    order = Window.partitionBy("key").orderBy(F.xxhash64("id"), "id")
    filed = bucket_keys(nodes).select("key", "id", F.row_number().over(order).alias("r"), F.lead("id").over(order).alias("_n"))
    filed = filed.filter("r > 1 or _n is not null").drop("_n")
    told = keep.write(filed.join(packed.select("id", "n", "b0", "b1"), "id"), "buckets")

    few = ("n", "b0", "b1")
    lead = told.filter(F.col("r") <= LEADERS).select(F.col("key").alias("lead_key"), F.col("id").alias("lead"), F.col("r").alias("lead_r"), *_prefixed(told, "l", few))
    member = told.filter("r > 1").select("key", "id", "r", *_prefixed(told, "m", few))
    pairs = member.join(lead, (F.col("key") == F.col("lead_key")) & (F.col("lead_r") < F.col("r")) & _may_link("m", "l", percent))
    left = packed.select("id", *_prefixed(packed, "x", _LONGS))
    right = packed.select(F.col("id").alias("lead"), *_prefixed(packed, "y", _LONGS))
    near = pairs.select("id", "lead").distinct().join(left, "id").join(right, "lead")
    near = near.filter(_sum([_told_apart(x) for x in _xor("x", "y", _LONGS)]) <= REACH)
    found = components(near.select(F.col("id").alias("a"), F.col("lead").alias("b")), keep)

    rest = told.filter(F.col("r") > LEADERS).select("key", "id").join(_few(found), "id", "left")
    rest = keep.write(rest.select("key", "id", F.coalesce("comp", "id").alias("fam")), "rest")
    ties = tied_families(rest, packed, percent, keep)
    if ties.head(1):
        found = _followed(found, components(ties, keep), keep)
    keep.drop(told, packed, rest, ties)
    return found


def _followed(first: DataFrame, then: DataFrame, keep: Scratch) -> DataFrame:
    """id, comp: components ``first``, whose names ``then`` joins further."""
    on = then.select(F.col("id").alias("comp"), F.col("comp").alias("now"))
    moved = first.join(on, "comp", "left").select("id", F.coalesce("now", "comp").alias("comp"))
    out = keep.write(moved.unionByName(then.join(first.select("id"), "id", "left_anti")), "families")
    keep.drop(first, then)
    return out


def _shingles(words: list[bytes], k: int) -> set:
    if len(words) < k:
        return {tuple(words)} if words else set()
    return set(zip(*(words[i:] for i in range(k))))


def links_between(left: list[str], right: list[str] | None, k: int, percent: int) -> list[tuple[int, int]]:
    """A spanning forest of the links between ``left`` and ``right`` (or within ``left``), by full sets.

    Pairs are indexes into left + right. Intersections are counted for all pairs at once, as
    products of tables of which shingle is in which set.
    """
    sets = [_shingles(words_of(t), k) for t in [*left, *(right or [])]]
    n, m = len(sets), len(left) if right is not None else 0
    size = np.fromiter(map(len, sets), np.int64, n)
    times = Counter(x for s in sets for x in s)
    code = {x: c for c, x in enumerate(x for x, f in times.items() if f > 1)}
    each = [np.fromiter((code[x] for x in s if x in code), np.int64) for s in sets]
    row, col = np.repeat(np.arange(n), [len(e) for e in each]), np.concatenate([*each, np.zeros(0, np.int64)])
    order = np.argsort(col, kind="stable")
    row, col = row[order], col[order]
    a, b = (slice(0, m), slice(m, n)) if right is not None else (slice(0, n), slice(0, n))
    both = np.zeros((a.stop - a.start, b.stop - b.start), np.float32)
    wide = max(1, CELLS // max(n, 1))
    for at in range(0, len(code), wide):
        lo, hi = np.searchsorted(col, (at, at + wide))
        table = np.zeros((n, min(wide, len(code) - at)), np.float32)
        table[row[lo:hi], col[lo:hi] - at] = 1
        both += table[a] @ table[b].T
    both = both.astype(np.int64)
    linked = (both > 0) & (100 * both >= percent * (size[a][:, None] + size[b][None, :] - both))
    # breadth first, each node once
    open_, out = np.ones(n, bool), []
    for start in range(m if right is not None else n):
        todo, open_[start] = [start] if open_[start] else [], False
        while todo:
            u = todo.pop()
            if right is None:
                near = np.flatnonzero(linked[u] & open_)
            elif u < m:
                near = m + np.flatnonzero(linked[u] & open_[m:])
            else:
                near = np.flatnonzero(linked[:, u - m] & open_[:m])
            open_[near] = False
            todo += near.tolist()
            out += [(u, v) for v in near.tolist()]
    return out


def confirmed_links(docs: DataFrame, nodes: DataFrame, fams: DataFrame, k: int, percent: int, keep: Scratch) -> DataFrame:
    """a, b, settled: links between nodes of one family, confirmed on full shingle sets, enough to join all that are linked.

    Settled: the family was compared in one task, and a is a node's component (its least node b).
    """
    home = nodes.select("id", "doc_id", "t", "size").join(_few(fams), "id")
    count = F.greatest(F.sum("size") / BLOCK_BYTES, F.count("*") / BLOCK_NODES)
    of = keep.write(home.groupBy("comp").agg(F.greatest(F.ceil(count), F.lit(1)).cast("long").alias("of")), "of")
    home = keep.write(home.join(_few(of), "comp").select("id", "doc_id", "t", "comp", "of", F.pmod(F.xxhash64("id"), "of").alias("block")), "home")
    texts = _texts(docs).join(_few(home), ["doc_id", "t"])
    blocks = keep.write(texts.groupBy("comp", "block", "of").agg(F.collect_list("id").alias("ids"), F.collect_list("text").alias("texts")), "texts")

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in batches:
            two, out = "ids2" in df, []
            for r in df.to_dict("records"):
                # a row may stand twice in the documents: each node once
                sides = [dict(zip(r[f"ids{s}"].tolist(), r[f"texts{s}"])) for s in ("", *["2"] * two)]
                ids = [i for s in sides for i in s]
                pairs = links_between(list(sides[0].values()), list(sides[1].values()) if two else None, k, percent)
                if two or r["of"] > 1:
                    out += [(ids[u], ids[v], False) for u, v in pairs]
                else:
                    forest = Forest()
                    for u, v in pairs:
                        forest.join(ids[u], ids[v])
                    out += [(i, forest.top(i), True) for i in {ids[u] for p in pairs for u in p}]
            yield pd.DataFrame(out, columns=["a", "b", "settled"]).astype({"a": "int64", "b": "int64", "settled": bool})

    form = "a long, b long, settled boolean"
    inside = blocks.select("of", "ids", "texts").mapInPandas(compare, form)
    across = _against(blocks, ["comp"], ["ids", "texts"]).mapInPandas(compare, form)
    out = keep.write(inside.unionByName(across), "links")
    keep.drop(of, home, blocks)
    return out


def components(edges: DataFrame, keep: Scratch) -> DataFrame:
    """id, comp (least id reachable) of every id in edges (a, b)."""

    def star(e: DataFrame, large: bool) -> DataFrame:
        """Large: hang greater neighbours on the least one; small: the lesser ones and the node."""
        sides = e.select(F.col("a").alias("u"), F.col("b").alias("v"))
        if large:
            sides = sides.unionByName(e.select(F.col("b").alias("u"), F.col("a").alias("v")))
        else:
            sides = sides.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        least = sides.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("m", "u").alias("m"))
        out = sides.join(least, "u")
        if large:
            out = out.filter("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
        else:
            out = out.select(F.explode(F.array("u", "v")).alias("a"), F.col("m").alias("b"))
        out = out.filter("a <> b")
        out = keep.write(out if large else out.distinct(), "edges")
        keep.drop(e)
        return out

    def mark(e: DataFrame):
        return e.agg(F.count("*"), F.expr("bit_xor(xxhash64(a, b))")).first()

    e = keep.write(edges.select("a", "b").filter("a <> b").distinct(), "edges")
    seen = mark(e)
    while seen[0]:
        e = star(star(e, True), False)
        now = mark(e)
        if now == seen:
            break
        seen = now
    comp = e.groupBy("a").agg(F.min("b").alias("comp")).select(F.col("a").alias("id"), "comp")
    tops = e.select(F.col("b").alias("id")).distinct().withColumn("comp", F.col("id"))
    out = keep.write(comp.unionByName(tops.join(comp.select("id"), "id", "left_anti")), "components")
    keep.drop(e)
    return out


def _grouped(docs: DataFrame, k: int, percent: int, tied: bool) -> tuple[DataFrame, DataFrame]:
    """Signatures, and doc_id, t, first for each row that can be linked.

    ``first`` is the least (doc_id, t) of the row's component. ``tied``: texts that share a
    doc_id are of one component.
    """
    keep = Scratch(docs.sparkSession)
    sigs = keep.write(signatures(docs, k), "signatures")
    full = sigs.filter("doc_id is not null and n > 0")
    # a node is a word sequence, numbered apart from doc_ids: one doc_id may have several
    own = F.min(F.struct("doc_id", "t", "n", "size", "sig")).alias("own")
    nodes = full.groupBy("h").agg(own, F.count("*").alias("rows")).select(F.monotonically_increasing_id().alias("id"), "h", "rows", "own.*")
    nodes = keep.write(nodes, "nodes")
    links = confirmed_links(docs, nodes, families(nodes, percent, keep), k, percent, keep)
    settled, links = links.filter("settled").select(F.col("a").alias("id"), F.col("b").alias("comp")), links.filter("not settled").select("a", "b")
    if tied:
        several = full.groupBy("doc_id").agg(F.min("h").alias("a"), F.max("h").alias("z")).filter("a < z").select("doc_id")
        several = keep.write(several, "several")
        if several.head(1):
            ids = only_ids(full.select("doc_id", "h"), several, "doc_id").join(nodes.select("h", "id"), "h")
            ids = keep.write(ids.groupBy("doc_id", "id").count(), "shared")
            least = ids.groupBy("doc_id").agg(F.min("id").alias("a"))
            links = links.unionByName(ids.join(least, "doc_id").select("a", F.col("id").alias("b")))
            links, settled = links.unionByName(settled.select(F.col("id").alias("a"), F.col("comp").alias("b"))), settled.limit(0)
    comp = settled.unionByName(components(links, keep)) if links.head(1) else settled
    linked = nodes.select("id", "h", F.struct("doc_id", "t").alias("own")).join(comp, "id")
    least = linked.groupBy("comp").agg(F.min("own").alias("first"))
    linked = linked.join(least, "comp").select("h", "first")
    copied = nodes.filter("rows > 1").join(comp.select("id"), "id", "left_anti").select("h", F.struct("doc_id", "t").alias("first"))
    first = keep.write(linked.unionByName(copied), "first")
    grouped = full.select("doc_id", "t", "h").join(_few(first), "h", "left")
    return sigs, grouped.select("doc_id", "t", F.coalesce("first", F.struct("doc_id", "t")).alias("first"))


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for each row of ``docs``."""
    sigs, grouped = _grouped(docs, k, percent, tied=True)
    groups = grouped.groupBy("doc_id").agg(F.min("first.doc_id").alias("component_id"))
    out = sigs.join(groups, "doc_id", "left").withColumn("component_id", F.coalesce("component_id", "doc_id"))
    kept = F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True))
    return out.select("doc_id", F.col("n").alias("n_shingles"), "component_id", kept.alias("kept"))


def keep_one(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` without the rows whose text is not the first of its group of near copies."""
    _, grouped = _grouped(docs, k, percent, tied=False)
    gone = grouped.filter(F.struct("doc_id", "t") != F.col("first")).select(F.col("doc_id").alias("_id"), F.col("t").alias("_t"))
    gone = Scratch(docs.sparkSession).write(gone.distinct(), "gone")
    at = (docs["doc_id"].cast("long") == gone["_id"]) & (F.xxhash64(F.coalesce(docs["text"], F.lit(""))) == gone["_t"])
    return docs.join(_few(gone), at, "left_anti")


def near_dedup_query(docs: DataFrame) -> DataFrame:
    return near_duplicates(docs.select("doc_id", "text"), k=2)
