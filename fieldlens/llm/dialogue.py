"""Repair of conversation structure by bidirectional Dijkstra over the lattice of edits.

A conversation is its rows in order of turn (nulls first; equal turns by role and text); an empty role has no initial and
is never legal. A node of the lattice is
(rows read, state of the grammar `(s?(ua)+)?` over role initials). Edits are Keep (0), Rerole to user or assistant (2),
Delete (3, required for blank and duplicate rows) and Insert of an empty user or assistant turn (2); a truncated row that
stays adds 1. From a given state the letters K, R, D, I name one path each, since the state decides the new role.

A search runs from both ends at once until no cheaper or equal crossing can follow, and takes the least audit of all
crossings with the least cost. Paths between the same two nodes that cost the same are never prefixes of each other
(the longer one would have further inserts), so least audits of parts make least audits of wholes. That also joins the
segments into which a long conversation is cut: each is searched from every state to every state, and the results are
put together in a tree, so that no task holds a long conversation.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from heapq import heappop, heappush

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.rank import positions
from .common import scratch

SPACE = " \t\n\x0b\x0c\r"
#: Costs of the edits.
REROLE, DELETE, INSERT, CUT_SHORT = 2, 3, 2, 1
#: States of the grammar: nothing yet, after the system turn, after a user turn, after an assistant turn.
BEGIN, SYSTEM, USER, ASSISTANT = range(4)
STATES = (BEGIN, SYSTEM, USER, ASSISTANT)
FINAL = (BEGIN, ASSISTANT)
#: The turn that may be made in a state, as the state that it leads to, and the role of such a turn.
MADE = (USER, USER, ASSISTANT, USER)
ROLE = {USER: "user", ASSISTANT: "assistant"}
#: States that a row's initial may be kept in, with the state that follows.
KEPT = {"s": {BEGIN: SYSTEM}, "u": {BEGIN: USER, SYSTEM: USER, ASSISTANT: USER}, "a": {USER: ASSISTANT}}
LEGAL = {"su", "ua", "au"}

FAULTS = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"


def damage(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv, turn, role, text, lost): rows damaged by crc32(`conv:turn`) % 20, nulls in that text, role and text being one space.

    0 loses the row (it stays as a name of its conversation), 1 empties its text, 2 removes its `[.!?]`, 3 repeats it, and
    4 makes its role user.
    """
    word = lambda c: F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(word(conv), F.lit(":"), word(turn))) % 20
    body = F.when(kind == 1, "").when(kind == 2, F.regexp_replace(word(text), "[.!?]", "")).otherwise(word(text))
    out = rows.select(
        F.col(f"`{conv}`").alias(conv), F.col(f"`{turn}`").alias(turn), F.when(kind == 4, "user").otherwise(word(role)).alias(role), body.alias(text), (kind == 0).alias("lost"), kind.alias("_kind")
    )
    return out.withColumn("_kind", F.explode(F.array_repeat(F.lit(1), F.when(F.col("_kind") == 3, 2).otherwise(1)))).drop("_kind")


def is_blank(text: Column) -> Column:
    return F.rtrim(text, F.lit(SPACE)) == ""


def is_truncated(text: Column) -> Column:
    return ~F.right(F.rtrim(text, F.lit(SPACE)), F.lit(1)).isin(".", "!", "?")


class Lattice:
    """Rows as (initial, must go, cut short); nodes are (rows read, state)."""

    def __init__(self, rows: list[tuple[str, bool, bool]]):
        self.rows = rows

    def ahead(self, i: int, s: int) -> Iterator[tuple[int, str, int, int]]:
        """(cost, letter, rows read, state) of each edit at a node."""
        yield INSERT, "I", i, MADE[s]
        if i < len(self.rows):
            initial, gone, short = self.rows[i]
            yield DELETE, "D", i + 1, s
            if not gone:
                yield REROLE + CUT_SHORT * short, "R", i + 1, MADE[s]
                if (to := KEPT.get(initial, {}).get(s)) is not None:
                    yield CUT_SHORT * short, "K", i + 1, to

    def back(self, i: int, s: int) -> Iterator[tuple[int, str, int, int]]:
        """The edits that lead to a node, with the nodes that they come from."""
        for before in STATES:
            for at in (i, i - 1):
                if at >= 0:
                    for cost, letter, to, state in self.ahead(at, before):
                        if (to, state) == (i, s):
                            yield cost, letter, at, before

    def best(self, start: int, ends: tuple[int, ...]) -> tuple[int, str] | None:
        """The least (cost, audit) from before the first row in state start to after the last in one of ends.

        Nodes of equal cost are settled in the order in which rows are read on that side: only a Keep is free, so
        all equal-cost ways into a node are known when it is settled.
        """
        n = len(self.rows)
        found: list[dict] = [{(0, start): (0, "")}, {(n, s): (0, "") for s in ends}]
        heaps: list[list] = [[(0, 0, 0, start)], [(0, 0, n, s) for s in ends]]
        settled: tuple[set, set] = (set(), set())
        best: tuple[int, str] | None = (0, "") if n == 0 and start in ends else None

        def top(side: int) -> float:
            heap = heaps[side]
            while heap and heap[0][2:] in settled[side]:
                heappop(heap)
            return heap[0][0] if heap else float("inf")

        while True:
            low = top(0), top(1)
            if min(low) == float("inf") or (best is not None and sum(low) > best[0]):
                return best
            side = int(low[1] < low[0])
            _, _, i, s = heappop(heaps[side])
            settled[side].add((i, s))
            cost, audit = found[side][i, s]
            for more, letter, to, state in self.back(i, s) if side else self.ahead(i, s):
                node, label = (to, state), (cost + more, letter + audit if side else audit + letter)
                if node not in settled[side] and label < found[side].get(node, (float("inf"), "")):
                    found[side][node] = label
                    heappush(heaps[side], (label[0], n - to if side else to, to, state))
                    if (other := found[1 - side].get(node)) is not None:
                        halves = (other, label) if side else (label, other)
                        whole = (label[0] + other[0], halves[0][1] + halves[1][1])
                        best = whole if best is None else min(best, whole)


def apply_audit(audit: str, rows: list[tuple[str, str]], state: int = BEGIN) -> list[tuple[str, str, str]]:
    """(letter, role, text) of the repaired turns; rows are (role, text)."""
    out, at = [], 0
    for letter in audit:
        if letter != "I":
            role, text = rows[at]
            at += 1
        if letter == "D":
            continue
        if letter == "K":
            state = KEPT[role[:1]][state]
        else:
            state = MADE[state]
            role, text = ROLE[state], "" if letter == "I" else text
        out.append((letter, role, text))
    return out


def _first_faults(rows: list[dict]) -> tuple[dict[str, int], list[tuple[str, bool, bool]]]:
    """Counts of each row's first fault and the lattice's rows; a row's `dup` is taken where it is known already."""
    count, codes, seen = {"blank": 0, "duplicate": 0, "truncated": 0}, [], set()
    for r in rows:
        dup = r["dup"] if "dup" in r else (r["role"], r["text"]) in seen
        seen.add((r["role"], r["text"]))
        fault = "blank" if r["blank"] else "duplicate" if dup else "truncated" if r["cut"] else None
        if fault:
            count[fault] += 1
        codes.append((r["role"][:1], fault in ("blank", "duplicate"), fault == "truncated"))
    return count, codes


def _whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Conversations that fit one row each."""
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            part = batch.slice(at, 256)
            out: dict[str, list] = {k: [] for k in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "turns")}
            for rows in part.column("rows").to_pylist():
                turns = [r["turn"] for r in rows if r["turn"] is not None]
                out["gaps"].append(max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0)
                count, codes = _first_faults(rows)
                for k, v in count.items():
                    out[k].append(v)
                out["illegal"].append(sum(a[0] + b[0] not in LEGAL for a, b in zip(codes, codes[1:])))
                cost, audit = Lattice(codes).best(BEGIN, FINAL)
                out["cost"].append(cost)
                out["audit"].append(audit)
                turns = apply_audit(audit, [(r["role"], r["text"]) for r in rows])
                out["turns"].append([{"letter": x, "role": r, "text": t} for x, r, t in turns])
            kinds = [pa.int64()] * 6 + [pa.string(), pa.list_(pa.struct([("letter", pa.string()), ("role", pa.string()), ("text", pa.string())]))]
            cols = [pa.array(v, k) for v, k in zip(out.values(), kinds)]
            yield pa.RecordBatch.from_arrays([part.column("conv"), *cols], names=["conv", *out])


def _searched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Segments as (conv, part, paths): the least cost and audit from each state to each state."""
    for batch in batches:
        for at in range(0, batch.num_rows, 64):
            part = batch.slice(at, 64)
            paths = []
            for rows in part.column("codes").to_pylist():
                lattice = Lattice([(r["initial"], r["gone"], r["short"]) for r in rows])
                paths.append([p for s in STATES for e in STATES if (p := _path(s, e, lattice.best(s, (e,)))) is not None])
            yield _parts(part.column("conv"), part.column("part"), paths)


def _path(start: int, end: int, found: tuple[int, str] | None) -> dict | None:
    return None if found is None else {"start": start, "end": end, "cost": found[0], "audit": found[1]}


PATH = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("cost", pa.int64()), ("audit", pa.string())])
PATHS = "part long, paths array<struct<start:int,end:int,cost:long,audit:string>>"


def _parts(conv: pa.Array, part: pa.Array, paths: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([conv, part, pa.array(paths, pa.list_(PATH))], names=["conv", "part", "paths"])


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Neighbouring parts put together: paths meet in each state, and the least sums stay."""
    for batch in batches:
        for at in range(batch.num_rows):
            row = batch.slice(at, 1)
            whole = None
            for parts in row.column("parts").to_pylist()[0]:
                mine = {(p["start"], p["end"]): (p["cost"], p["audit"]) for p in parts["paths"]}
                if whole is None:
                    whole = mine
                    continue
                grown: dict[tuple[int, int], tuple[int, str]] = {}
                for (s, mid), (cost, audit) in whole.items():
                    for e in STATES:
                        if (rest := mine.get((mid, e))) is not None and cost + rest[0] <= grown.get((s, e), (cost + rest[0],))[0]:
                            label = cost + rest[0], audit + rest[1]
                            grown[s, e] = min(grown.get((s, e), label), label)
                whole = grown
            yield _parts(row.column("conv"), row.column("part"), [[_path(s, e, v) for (s, e), v in whole.items()]])


def _letters(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Audits of long conversations as (conv, pos, letters, before, odd): what each row's letters are (inserts before it, its
    own, and after the last row the inserts there), how many turns the repaired conversation has before, and whether it
    has an odd number, which a leading system turn makes."""
    for batch in batches:
        for at in range(batch.num_rows):
            audit = batch.column("audit")[at].as_py()
            odd, before, pos, begin, out = (len(audit) - audit.count("D")) % 2 == 1, 0, 0, 0, []
            last = max((i for i, x in enumerate(audit) if x != "I"), default=-1)
            for i, letter in enumerate(audit):
                if letter != "I":
                    own = audit[begin:] if i == last else audit[begin : i + 1]
                    out.append((pos, own, before, odd))
                    before += len(own) - own.count("D")
                    pos, begin = pos + 1, i + 1
                if out and (len(out) == 4096 or i == len(audit) - 1):
                    cols = [pa.array(v, k) for v, k in zip(zip(*out), (pa.int64(), pa.string(), pa.int64(), pa.bool_()))]
                    conv = batch.column("conv").take(pa.array([at] * len(out)))
                    yield pa.RecordBatch.from_arrays([conv, *cols], names=["conv", "pos", "letters", "before", "odd"])
                    out = []


def _state(before: int, odd: bool) -> int:
    """The state after so many repaired turns."""
    if before == 0:
        return BEGIN
    if odd:
        return SYSTEM if before == 1 else USER if before % 2 == 0 else ASSISTANT
    return USER if before % 2 else ASSISTANT


def _edited(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of long conversations with the turns that they become."""
    for batch in batches:
        turns = []
        for r in batch.select(["role", "text", "letters", "before", "odd"]).to_pylist():
            made = apply_audit(r["letters"], [(r["role"], r["text"])], _state(r["before"], r["odd"]))
            turns.append([{"letter": x, "role": a, "text": t} for x, a, t in made])
        kind = pa.list_(pa.struct([("letter", pa.string()), ("role", pa.string()), ("text", pa.string())]))
        yield pa.RecordBatch.from_arrays([batch.column("conv"), batch.column("pos"), pa.array(turns, kind)], names=["conv", "pos", "turns"])


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(conv, sha) of turns that come in order: one pass that holds no rows."""
    now, digest, first = None, None, True
    for batch in batches:
        done: list[tuple[pa.Array, str]] = []
        conv, turns = batch.column("conv"), batch.column("turns").to_pylist()
        keys = conv.to_pylist()
        for i, key in enumerate(keys):
            if digest is None or key != now[1]:
                if digest is not None:
                    done.append((now[0], digest.hexdigest()))
                now, digest, first = (conv.slice(i, 1), key), hashlib.sha256(), True
            for t in turns[i]:
                digest.update(("" if first else "\n").encode() + f"{t['role']}:{t['text']}".encode("utf-8", "surrogatepass"))
                first = False
        for key, sha in done:
            yield pa.RecordBatch.from_arrays([key, pa.array([sha])], names=["conv", "sha"])
    if digest is not None:
        yield pa.RecordBatch.from_arrays([now[0], pa.array([digest.hexdigest()])], names=["conv", "sha"])


class Repair:
    """The repair of all conversations of `rows`, which may have a boolean `lost`: such rows only name their conversation.

    `summary()` has a row for each conversation, `turns()` a row for each repaired turn. Null roles and texts count as one
    space, a null conversation is one too, extra columns are left out, no rows give no rows, and rows that repeat are
    duplicates. A conversation of more than `long_rows` rows or `long_bytes` bytes is numbered by bounds of its turns, cut
    into segments of `segment` rows, and put together `fan` parts at a time; of it, only its audit is ever in one place,
    and its digest, which SHA-256 takes in order, is one task's stream.
    """

    def __init__(self, rows: DataFrame, conv="conv_id", turn="turn", role="role", text="text", long_rows=2000, long_bytes=8 << 20, segment=256, fan=64):
        lost = F.col("lost") if "lost" in rows.columns else F.lit(False)
        word = lambda c: F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(" "))
        self.name, self.segment, self.fan = conv, segment, fan
        self.rows = rows.select(F.col(f"`{conv}`").alias("conv"), F.col(f"`{turn}`").cast("long").alias("turn"), word(role).alias("role"), word(text).alias("text"), F.coalesce(lost, F.lit(False)).alias("lost"))
        here = F.when(~F.col("lost"), F.octet_length("text"))
        sizes = self.rows.groupBy("conv").agg(F.count(here).alias("n"), F.sum(here).alias("bytes")).filter((F.col("n") > long_rows) | (F.col("bytes") > long_bytes))
        self.long = scratch(sizes.select(F.col("conv").alias("l_conv"), "n"), "conv-long")
        self.most = self.long.agg(F.max("n")).first()[0] or 0
        self._short = self._long = None

    def _chosen(self, how: str) -> DataFrame:
        return self.rows.join(self.long, F.col("conv").eqNullSafe(F.col("l_conv")), how)

    def short(self) -> DataFrame:
        """(conv, faults, audit, turns) of the conversations that one row holds."""
        if self._short is None:
            row = F.struct(F.col("turn").isNotNull().alias("known"), "turn", "role", "text", is_blank(F.col("text")).alias("blank"), is_truncated(F.col("text")).alias("cut"))
            some = self._chosen("left_anti") if self.most else self.rows
            whole = some.groupBy("conv").agg(F.array_sort(F.collect_list(F.when(~F.col("lost"), row))).alias("rows"))
            kind = whole.schema["conv"].dataType.simpleString()
            self._short = whole.mapInArrow(_whole, f"conv {kind}, {FAULTS}, turns array<struct<letter:string,role:string,text:string>>")
        return self._short

    def long_parts(self) -> tuple[DataFrame, DataFrame]:
        """(summary, turns by row) of the long conversations."""
        if self._long is None:
            rows = self._chosen("left_semi").filter(~F.col("lost")).withColumn("known", F.col("turn").isNotNull())
            placed = positions(rows, ["conv"], [F.col("known"), F.col("turn"), F.col("role"), F.col("text")], "pos")
            digest = F.sha2(F.concat_ws(":", F.length("role").cast("string"), "role", "text"), 256)
            placed = scratch(placed.select("conv", (F.col("pos") - 1).alias("pos"), "turn", "role", "text", digest.alias("digest")), "conv-rows")
            first = placed.groupBy(F.col("conv").alias("f_conv"), F.col("digest").alias("f_digest")).agg(F.min("pos").alias("first"))
            fault = F.when(is_blank(F.col("text")), "blank").when(F.col("pos") > F.col("first"), "duplicate").when(is_truncated(F.col("text")), "truncated")
            judged = placed.join(first, F.col("conv").eqNullSafe(F.col("f_conv")) & (F.col("digest") == F.col("f_digest")))
            judged = scratch(judged.select("conv", "pos", "turn", "role", F.substring("role", 1, 1).alias("initial"), fault.alias("fault")), "conv-faults")
            kind = judged.schema["conv"].dataType.simpleString()
            code = F.struct("pos", "initial", F.coalesce(F.col("fault").isin("blank", "duplicate"), F.lit(False)).alias("gone"), F.coalesce(F.col("fault") == "truncated", F.lit(False)).alias("short"))
            codes = judged.groupBy("conv", F.expr(f"pos div {self.segment}").alias("part")).agg(F.array_sort(F.collect_list(code)).alias("codes"))
            parts, left = scratch(codes.mapInArrow(_searched, f"conv {kind}, {PATHS}"), "conv-paths"), -(-self.most // self.segment)
            while left > 1:
                near = parts.groupBy("conv", F.expr(f"part div {self.fan}").alias("part")).agg(F.array_sort(F.collect_list(F.struct(F.col("part").alias("p"), "paths"))).alias("parts"))
                parts, left = scratch(near.mapInArrow(_joined, f"conv {kind}, {PATHS}"), "conv-paths"), -(-left // self.fan)
            ends = F.filter("paths", lambda p: (p["start"] == BEGIN) & p["end"].isin(*FINAL))
            best = parts.select("conv", F.array_min(F.transform(ends, lambda p: F.struct(p["cost"].alias("cost"), p["audit"].alias("audit")))).alias("b"))
            best = scratch(best.select("conv", "b.cost", "b.audit"), "conv-audits")
            letters = best.mapInArrow(_letters, f"conv {kind}, pos long, letters string, before long, odd boolean").withColumnsRenamed({"conv": "e_conv", "pos": "e_pos"})
            edited = placed.join(letters, F.col("conv").eqNullSafe(F.col("e_conv")) & (F.col("pos") == F.col("e_pos")))
            turns = scratch(edited.mapInArrow(_edited, f"conv {kind}, pos long, turns array<struct<letter:string,role:string,text:string>>"), "conv-turns")
            self._long = self._long_summary(judged, best, turns, kind), turns
        return self._long

    def _long_summary(self, judged: DataFrame, best: DataFrame, turns: DataFrame, kind: str) -> DataFrame:
        of = lambda k: F.count(F.when(F.col("fault") == k, 1)).alias(k)
        counts = judged.groupBy("conv").agg(of("blank"), of("duplicate"), of("truncated"))
        each = judged.dropna(subset=["turn"]).groupBy("conv", "turn").agg(F.lit(1).alias("one"))
        gaps = each.groupBy("conv").agg((F.max("turn") - F.min("turn") + 1 - F.count("one")).alias("gaps"))
        # neighbours meet where the later one stands: each row also goes to the place after it
        pair = judged.select("conv", F.explode(F.array(F.struct("pos", F.lit(1).alias("side"), "initial"), F.struct((F.col("pos") + 1).alias("pos"), F.lit(0).alias("side"), "initial"))).alias("x"))
        met = pair.groupBy("conv", "x.pos").agg(F.count("*").alias("n"), F.max(F.when(F.col("x.side") == 0, F.col("x.initial"))).alias("a"), F.max(F.when(F.col("x.side") == 1, F.col("x.initial"))).alias("b"))
        illegal = met.filter(F.col("n") == 2).groupBy("conv").agg(F.count(F.when(~F.concat("a", "b").isin(*sorted(LEGAL)), 1)).alias("illegal"))
        shas = turns.repartition("conv").sortWithinPartitions("conv", "pos").mapInArrow(_hashed, f"conv {kind}, sha string")
        out = best
        for other in (counts, gaps, illegal, shas):
            other = other.withColumnRenamed("conv", "o_conv")
            out = out.join(other, F.col("conv").eqNullSafe(F.col("o_conv")), "left").drop("o_conv")
        return out.na.fill(0, ["gaps", "illegal"])

    def summary(self) -> DataFrame:
        """(conv, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256)."""
        names = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit")
        line = F.transform("turns", lambda t: F.concat(t["role"], F.lit(":"), t["text"]))
        out = self.short().select("conv", *names, F.sha2(F.array_join(line, "\n"), 256).alias("repaired_sha256"))
        if self.most:
            out = out.unionByName(self.long_parts()[0].select("conv", *names, F.col("sha").alias("repaired_sha256")))
        return out.withColumnRenamed("conv", self.name)

    def turns(self) -> DataFrame:
        """(conv, pos, place, letter, role, text): the repaired turns in order of pos and place."""
        out = self.short().select("conv", F.lit(0).cast("long").alias("pos"), "turns")
        if self.most:
            out = out.unionByName(self.long_parts()[1].select("conv", "pos", "turns"))
        out = out.select("conv", "pos", F.posexplode("turns").alias("place", "t")).select("conv", "pos", "place", "t.letter", "t.role", "t.text")
        return out.withColumnRenamed("conv", self.name)
