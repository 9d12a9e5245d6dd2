"""Repairing conversation structure: Dial's shortest paths over small whole costs.

A conversation's rows are turned into a sequence of roles ``(s?(ua)+)?`` (system, user,
assistant, by their initials) by the cheapest edits: Keep a row (0), Rerole it to user or
assistant (2), Delete it (3; the only way for a blank or a repeated row), Insert an empty
user or assistant message anywhere (2); a truncated row that stays adds 1. Of equally cheap
lists of edits the one whose initials are least in ASCII is taken: the audit.

The graph has a node for each (rows done, what the roles so far allow); the four states
are: nothing yet, after a system message, after a user's, after an assistant's. Each of the
four edits leaves a node by one arc at most, so the audit fixes everything else. Distances
to the end are found backwards with Dial's queue (one bucket a distance, few open at a time);
an arc is tight where it costs what the distances differ by, and the walk from the start
that takes the least initial among tight arcs is the audit.

No conversation is held whole anywhere. Rows are numbered by prefix sums over a range-sorted table, and
each ``CHUNK`` rows become one string of codes (a letter a row). A conversation of one chunk
is solved at once. In a longer one each chunk is summed up by the 4 x 4 least costs
from state to state; these are composed from the end, which gives each chunk the distances
at its end; then the four possible walks through each chunk are composed from the start.
Texts travel once: rows and edits of a conversation meet in one sorted stream, which
digests or emits the repaired messages one after the other.

Edge cases: null role, text, conv_id or turn reads as one space where text is asked for; rows
with a null ``conv_id`` are one conversation; null turns come first; rows of one turn are
ordered by role, by the first ``HEAD`` characters of their text and by its digest; a
conversation without rows has an empty audit; other roles can be reroled or deleted only;
an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WHITE, materialize, only_ids, parallelism
from .prefix import prefix_sums

#: Rows whose codes one task holds at a time.
CHUNK = 10_000
#: Characters of a text that rows of one turn are ordered by.
HEAD = 64
_FAR = 1 << 60
#: Role that an inserted or reroled message gets in each state, and the state after it.
_NEXT = (2, 2, 3, 2)
_ROLE = ("user", "user", "assistant", "user")
#: State after keeping a row of each role, where that is allowed.
_KEEP = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (3, "u"): 2, (2, "a"): 3}
#: Distances to the end after the last row: only the empty list and pairs are complete.
_DONE = (0, 4, 2, 0)
#: Codes of rows: blank, duplicate, and each role (x: any other) whole and, as a capital, truncated.
CODES = "bdsuaxSUAX"


def _arcs(code: str) -> list[tuple[str, int, int, int, int]]:
    """edit, rows done by it, state, next state, cost of the arcs at a row of a code."""
    out = [("I", 0, q, _NEXT[q], 2) for q in range(4)] + [("D", 1, q, q, 3) for q in range(4)]
    if code not in "bd":
        more = int(code.isupper())
        out += [("K", 1, q, to, more) for (q, role), to in _KEEP.items() if role == code.lower()]
        out += [("R", 1, q, _NEXT[q], 2 + more) for q in range(4)]
    return sorted(out)


_FORWARD = {c: [[(edit, step, to, cost) for edit, step, q, to, cost in _arcs(c) if q == s] for s in range(4)] for c in CODES}
_BACK = {c: [[(q, cost) for _, step, q, to, cost in _arcs(c) if step and to == s] for s in range(4)] for c in CODES}
_BEFORE_INSERT = [[q for q in range(4) if _NEXT[q] == s] for s in range(4)]


def distances(codes: str, end: tuple[int, ...] = _DONE) -> list[int]:
    """Least cost from each node (4 * rows done + state) to the end, which state q reaches at ``end[q]``."""
    n = len(codes)
    dist = [_FAR] * (4 * (n + 1))
    base = min(end)
    reach = max([x for x in end if x < _FAR], default=0) - base
    m = max(reach, 3) + 1  # no arc and no start is further away than this: buckets can go round
    buckets: list[list[int]] = [[] for _ in range(m)]
    left = 0
    for q, x in enumerate(end):
        if x < _FAR:
            dist[4 * n + q] = x
            buckets[(x - base) % m].append(4 * n + q)
            left += 1
    d = base
    while left:
        bucket = buckets[(d - base) % m]
        while bucket:
            node = bucket.pop()
            left -= 1
            if dist[node] != d:
                continue  # reached for less meanwhile
            i, q = node >> 2, node & 3
            steps = [(4 * i + p, d + 2) for p in _BEFORE_INSERT[q]]
            if i:
                steps += [(4 * (i - 1) + p, d + cost) for p, cost in _BACK[codes[i - 1]][q]]
            for to, x in steps:
                if x < dist[to]:
                    dist[to] = x
                    buckets[(x - base) % m].append(to)
                    left += 1
        d += 1
    return dist


def walk(codes: str, dist: list[int], state: int) -> tuple[str, int]:
    """The least initials along tight arcs from ``state`` until all rows are done, and the state then."""
    out, i, q = [], 0, state
    while i < len(codes):
        here = dist[4 * i + q]
        edit, step, to = next((e, s, t) for e, s, t, cost in _FORWARD[codes[i]][q] if here == cost + dist[4 * (i + s) + t])
        out.append(edit)
        i, q = i + step, to
    return "".join(out), q


def _tail(state: int) -> str:
    """What completes a list of roles that ends in ``state``."""
    return "I" * (_DONE[state] // 2)


def _whole(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Audit and cost of conversations of one chunk."""
    for df in batches:
        out = []
        for codes in df["codes"]:
            dist = distances(codes)
            audit, q = walk(codes, dist, 0)
            out.append((audit + _tail(q), dist[0]))
        yield df.assign(audit=[a for a, _ in out], cost=[c for _, c in out])


def _summaries(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """costs: of each chunk, least cost from state p at its start to state q at its end, at 4 * q + p."""
    for df in batches:
        ends = [tuple(0 if p == q else _FAR for p in range(4)) for q in range(4)]
        costs = [[x for end in ends for x in distances(codes, end)[:4]] for codes in df["codes"]]
        yield pd.DataFrame({"_conv": df["_conv"], "_chunk": df["_chunk"], "costs": costs})


def _from_the_end(pdf: pd.DataFrame) -> pd.DataFrame:
    """Distances at the end of each chunk of a conversation, and of the whole from its start."""
    pdf = pdf.sort_values("_chunk")
    ends, end = [], list(_DONE)
    for costs in reversed(pdf["costs"].tolist()):
        ends.append(end)
        end = [min(int(costs[4 * q + p]) + end[q] for q in range(4)) for p in range(4)]
    return pd.DataFrame({"_conv": pdf["_conv"], "_chunk": pdf["_chunk"], "end": ends[::-1], "cost": end[0]})


def _walks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The four walks through each chunk, by the state at its start."""
    for df in batches:
        found = []
        for codes, end in zip(df["codes"], df["end"]):
            dist = distances(codes, tuple(int(x) for x in end))
            found.append([walk(codes, dist, q) for q in range(4)])
        df = df.drop(columns="end")
        yield df.assign(audits=[[a for a, _ in f] for f in found], exits=[[q for _, q in f] for f in found])


def _from_the_start(pdf: pd.DataFrame) -> pd.DataFrame:
    """The state that each chunk starts in, and what completes the list after the last one."""
    pdf = pdf.sort_values("_chunk")
    starts, q = [], 0
    for exits in pdf["exits"]:
        starts.append(q)
        q = int(exits[q])
    tails = [""] * (len(starts) - 1) + [_tail(q)]
    return pd.DataFrame({"_conv": pdf["_conv"], "_chunk": pdf["_chunk"], "start": starts, "tail": tails})


def _solved(chunks: DataFrame) -> DataFrame:
    """_conv, _chunk, codes, audit, cost (of the whole conversation) of a stored table of chunks."""
    solved = "_conv string, _chunk long, codes string, audit string, cost long"
    ids = chunks.filter("_chunk > 0").select("_conv").distinct()
    short = only_ids(chunks, ids, "_conv", without=True).mapInPandas(_whole, solved)
    if not ids.head(1):
        return short
    long = only_ids(chunks, ids, "_conv")
    sums = long.mapInPandas(_summaries, "_conv string, _chunk long, costs array<long>")
    ends = sums.groupBy("_conv").applyInPandas(_from_the_end, "_conv string, _chunk long, end array<long>, cost long")
    walks = long.join(ends, ["_conv", "_chunk"]).mapInPandas(
        _walks, "_conv string, _chunk long, codes string, cost long, audits array<string>, exits array<int>"
    )
    walks = materialize(walks, "walks")
    starts = walks.select("_conv", "_chunk", "exits").groupBy("_conv").applyInPandas(_from_the_start, "_conv string, _chunk long, start int, tail string")
    audit = F.concat(F.element_at("audits", F.col("start") + 1), "tail")
    return short.unionByName(walks.join(starts, ["_conv", "_chunk"]).select("_conv", "_chunk", "codes", audit.alias("audit"), "cost"))


class _Conversation:
    """One conversation while its stream passes: its rows' faults, its edits, its digest."""

    def __init__(self, key: str):
        self.key, self.q, self.cost, self.audit, self.pos = key, 0, 0, [], 0
        self.blank = self.duplicate = self.truncated = self.illegal = 0
        self.least = self.most = None
        self.turns, self.before = 0, None
        self.codes, self.edits, self.sha = iter(""), iter(""), hashlib.sha256()

    def chunk(self, codes: str, audit: str, cost: int) -> Iterator[tuple]:
        yield from self.rest()
        self.codes, self.edits, self.cost = iter(codes), iter(audit), cost
        self.audit.append(audit)

    def message(self, edit: str, role: str, text: str) -> tuple:
        self.sha.update(("\n" * (self.pos > 0) + f"{role}:{text}").encode())
        self.pos += 1
        return self.key, self.pos - 1, role, text, edit

    def inserted(self) -> tuple:
        q, self.q = self.q, _NEXT[self.q]
        return self.message("I", _ROLE[q], "")

    def row(self, turn: int | None, role: str, text: str) -> Iterator[tuple]:
        if self.before is not None and self.before + role[:1] not in ("su", "ua", "au"):
            self.illegal += 1
        self.before = role[:1]
        if turn is not None:
            self.turns += turn != self.most
            self.least, self.most = turn if self.least is None else self.least, turn
        code = next(self.codes)
        self.blank += code == "b"
        self.duplicate += code == "d"
        self.truncated += code.isupper()
        edit = next(self.edits)
        while edit == "I":
            yield self.inserted()
            edit = next(self.edits)
        if edit == "K":
            self.q = _KEEP[self.q, role[:1]]
            yield self.message("K", role, text)
        elif edit == "R":
            q, self.q = self.q, _NEXT[self.q]
            yield self.message("R", _ROLE[q], text)

    def rest(self) -> Iterator[tuple]:
        for _ in self.edits:  # insertions after the last row
            yield self.inserted()

    def report(self) -> tuple:
        gaps = 0 if self.most is None else self.most - self.least + 1 - self.turns
        faults = self.blank, self.duplicate, self.truncated, self.illegal
        return self.key, gaps, *faults, self.cost, "".join(self.audit), self.sha.hexdigest()


_REPORT = "_conv string, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
_MESSAGES = "_conv string, pos long, role string, text string, edit string"


def _stream(reports: bool):
    """Reads conversations one record after the other; yields a report each, or the messages."""
    columns = [x.split()[0] for x in (_REPORT if reports else _MESSAGES).split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now = None
        for df in batches:
            out: list[tuple] = []
            for key, chunk, idx, has, number, a, b in df.itertuples(index=False, name=None):
                if now is None or now.key != key:
                    if now is not None:
                        out.extend(now.rest() if not reports else ())
                        if reports:
                            list(now.rest())
                            out.append(now.report())
                    now = _Conversation(key)
                if chunk < 0:
                    continue
                made = now.chunk(a, b, number) if idx < 0 else now.row(number if has else None, a, b)
                made = list(made)
                if not reports:
                    out.extend(made)
            yield pd.DataFrame(out, columns=columns)
        if now is not None:
            last = list(now.rest())
            yield pd.DataFrame([now.report()] if reports else last, columns=columns)

    return run


def damaged(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text of ``rows`` damaged by a hash of ``conv_id:turn``, a fifth of them each in its way."""
    key = F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")])
    role, text = (F.coalesce(c, F.lit(" ")) for c in ("role", "text"))
    d = rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), (F.crc32(key.cast("binary")) % 20).alias("_h")).filter("_h <> 0")
    text = F.when(F.col("_h") == 1, "").when(F.col("_h") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    times = F.when(F.col("_h") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    d = d.select("conv_id", "turn", F.when(F.col("_h") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), F.explode(times).alias("_copy"))
    return d.drop("_copy")


def _coded(numbered: DataFrame) -> DataFrame:
    """_conv, _idx, code of each row."""
    bare = F.rtrim(F.col("_text"), F.lit(" " + WHITE))
    initial = F.substring("_role", 1, 1)
    role = F.when(initial.isin("s", "u", "a"), initial).otherwise("x")
    rows = numbered.select(
        "_conv", "_idx", "_role", "_digest", (bare == "").alias("blank"), F.substring(bare, -1, 1).isin(".", "!", "?").alias("ended"), role.alias("role"),
    )
    # a text said a thousand times is one row of this table, and its rows are only looked up in it
    said = rows.filter("not blank").groupBy("_conv", "_role", "_digest").agg(F.min("_idx").alias("first"), F.count(F.lit(1)).alias("n"))
    j = rows.join(said.filter("n > 1").drop("n"), ["_conv", "_role", "_digest"], "left")
    code = F.when(F.col("blank"), "b").when(F.col("_idx") > F.col("first"), "d").when(F.col("ended"), F.col("role")).otherwise(F.upper("role"))
    return j.select("_conv", "_idx", code.alias("code"))


def _repaired(rows: DataFrame, conversations: DataFrame, reports: bool) -> DataFrame:
    """Runs the whole job; ``conversations`` names those to report on, also without rows."""
    spark = rows.sparkSession
    key = F.coalesce(F.concat(F.lit("v"), F.col("conv_id").cast("string")), F.lit("n")).alias("_conv")
    role, text = (F.coalesce(c, F.lit(" ")) for c in ("role", "text"))
    kept = rows.select(key, F.col("turn").cast("long").alias("_turn"), role.alias("_role"), text.alias("_text"))
    kept = kept.withColumns({"_head": F.substring("_text", 1, HEAD), "_digest": F.sha2(F.col("_text").cast("binary"), 256), "_uid": F.monotonically_increasing_id()})
    kept = materialize(kept.withColumn("_one", F.lit(1)), "kept")
    numbered = prefix_sums(kept, ["_conv"], ["_turn", "_role", "_head", "_digest", "_uid"], {"_idx": "_one"})
    numbered = materialize(numbered.select("_conv", "_idx", "_turn", "_role", "_text", "_digest"), "numbered")
    letters = F.transform(F.array_sort(F.collect_list(F.struct("_idx", "code"))), lambda x: x["code"])
    chunk = F.floor(F.col("_idx") / CHUNK).alias("_chunk")
    chunks = _coded(numbered).groupBy("_conv", chunk).agg(F.array_join(letters, "").alias("codes"))
    solved = _solved(materialize(chunks, "chunks"))
    nothing, yes = F.lit(-1).cast("long"), F.lit(True)
    records = numbered.select(
        "_conv", chunk, "_idx", F.col("_turn").isNotNull().alias("has"), F.coalesce("_turn", F.lit(0).cast("long")).alias("number"),
        F.col("_role").alias("a"), F.col("_text").alias("b"),
    )
    records = records.unionByName(solved.select("_conv", "_chunk", nothing.alias("_idx"), yes.alias("has"), F.col("cost").alias("number"), F.col("codes").alias("a"), F.col("audit").alias("b")))
    names = conversations.select(key).distinct()
    records = records.unionByName(names.select("_conv", nothing.alias("_chunk"), nothing.alias("_idx"), yes.alias("has"), nothing.alias("number"), F.lit("").alias("a"), F.lit("").alias("b")))
    n = parallelism(spark, numbered.count(), 500_000)
    stream = records.repartition(n, "_conv").sortWithinPartitions("_conv", "_chunk", "_idx")
    out = stream.mapInPandas(_stream(reports), _REPORT if reports else _MESSAGES)
    back = F.when(F.col("_conv").startswith("v"), F.substring("_conv", 2, 1 << 30)).cast(rows.schema["conv_id"].dataType)
    return out.select(back.alias("conv_id"), *[c for c in out.columns if c != "_conv"])


def audit(rows: DataFrame) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256 of every conversation of ``rows``."""
    return _repaired(rows, rows, True)


def repair(rows: DataFrame) -> DataFrame:
    """conv_id, pos, role, text, edit (K, R or I): the messages of every conversation after the cheapest edits."""
    return _repaired(rows, rows, False)


def repair_query(conversations: DataFrame) -> DataFrame:
    """The audit of damaged conversations, of every conversation that there was."""
    return _repaired(damaged(conversations), conversations, True)
