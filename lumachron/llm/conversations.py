"""Conversation structure repair: the cheapest edits that give turns the roles (system?)(user assistant)+ or nothing.

Rows of a conversation in order are kept (K), given another role (R, user or assistant), deleted (D), or get an empty turn
inserted before them or at the end (I). Blank rows and rows seen earlier must go. A dynamic programme over rows and
role states finds the least cost; of equally cheap audits, the string of edits, the least by ASCII wins. Audits are
persistent: linked nodes that share their prefixes, each with its binary-lifting ancestors and a rolling hash, so a tie is
decided by a search for the longest common prefix; what hashes call equal is verified along the links.

Conversations are cut into pieces: ranges of the sorted rows, and in them runs of at most MOST_PIECE rows. A piece of a longer
conversation gives costs and ranks of its audits from each role state to each, and these few numbers are composed, so a
conversation of any length is worked on in many tasks, and no task holds more than a piece. All of this needs no texts but two
hashes of them; in the end, texts and audits meet once in the order of their conversation and are edited as they stream by.

Rows go by turn (nulls first), role, and then a hash of the text; a null conv_id is a conversation, repeated rows are rows. Roles go by their
first letter: s, u and a are known, rows of other roles are never kept as they are. Null and empty texts are blank. Only conv_id,
turn, role and text are read, so other columns may have any name. Empty tables give empty results.
"""

from __future__ import annotations

import hashlib
from collections import deque
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumachron.operators.blocks import same

from .jaccard_join import broadcast_if_few, text_key
from .shared import written

#: Rows of a piece, and rows of a range of the sorted rows, more or less.
MOST_PIECE, ROWS_A_RANGE = 4096, 100_000
WORDY, ENDED = r"[^\x20\x09-\x0D]", r"[.!?][\x20\x09-\x0D]*\z"
ORDER = ["conv_id", "turn", "role", "x", "y"]
#: Role states: nothing yet, after a system turn, after a user turn, after an assistant turn.
NOTHING, SYSTEM, USER, ASSISTANT = range(4)
AFTER_INSERT = (USER, USER, ASSISTANT, USER)
KEPT = {(NOTHING, "s"): SYSTEM, (NOTHING, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): ASSISTANT, (ASSISTANT, "u"): USER}
ROLES = {USER: "user", ASSISTANT: "assistant"}
#: Inserts that end a conversation in a state, if it isn't ended.
ENDING = ("", "II", "I", "")
REROLE, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1
PRIME, BASE = (1 << 61) - 1, 1_000_003


class Audits:
    """Strings of edits as linked nodes; 0 is the empty one."""

    def __init__(self) -> None:
        self.edit, self.depth, self.hash, self.up = [""], [0], [0], [()]

    def add(self, node: int, edit: str) -> int:
        lifted = [node]
        while len(self.up[lifted[-1]]) >= len(lifted):  # the 2^k-th ancestor's own 2^k-th ancestor
            lifted.append(self.up[lifted[-1]][len(lifted) - 1])
        self.edit.append(edit)
        self.depth.append(self.depth[node] + 1)
        self.hash.append((self.hash[node] * BASE + ord(edit)) % PRIME)
        self.up.append(tuple(lifted))
        return len(self.edit) - 1

    def lifted(self, node: int, depth: int) -> int:
        while self.depth[node] > depth:
            node = self.up[node][(self.depth[node] - depth).bit_length() - 1]
        return node

    def alike(self, a: int, b: int) -> bool:
        """Whether two nodes of one depth spell the same, along the links, up to the node they share."""
        while a != b:
            if self.edit[a] != self.edit[b]:
                return False
            a, b = self.up[a][0], self.up[b][0]
        return True

    def less(self, a: int, b: int) -> bool:
        depth = min(self.depth[a], self.depth[b])
        x, y = self.lifted(a, depth), self.lifted(b, depth)
        if self.hash[x] == self.hash[y]:
            return self.depth[a] < self.depth[b] if self.alike(x, y) else self.text(a) < self.text(b)
        for k in range(len(self.up[x]) - 1, -1, -1):
            if k < len(self.up[x]) and self.hash[self.up[x][k]] != self.hash[self.up[y][k]]:
                x, y = self.up[x][k], self.up[y][k]
        if not self.alike(self.up[x][0], self.up[y][0]):  # two prefixes of one hash
            return self.text(a) < self.text(b)
        return self.edit[x] < self.edit[y]

    def text(self, node: int) -> str:
        out = []
        while node:
            out.append(self.edit[node])
            node = self.up[node][0]
        return "".join(reversed(out))


States = dict[int, tuple[int, int]]  #: state: cost, audit


def offer(audits: Audits, states: States, state: int, cost: int, node: int, edit: str) -> None:
    """The audit of node and edit, if it is cheaper in a state, or as cheap and less."""
    held = states.get(state)
    if held is None or cost < held[0]:
        states[state] = cost, audits.add(node, edit)
    elif cost == held[0] and audits.less(new := audits.add(node, edit), held[1]):
        states[state] = cost, new


def with_inserts(audits: Audits, states: States) -> States:
    """States after up to two inserts; more would come back to a state."""
    found, last = dict(states), states
    for _ in range(2):
        new: States = {}
        for state, (cost, node) in last.items():
            offer(audits, new, AFTER_INSERT[state], cost + INSERT, node, "I")
        for state, (cost, node) in new.items():
            held = found.get(state)
            if held is None or cost < held[0] or (cost == held[0] and audits.less(node, held[1])):
                found[state] = cost, node
        last = new
    return found


def walked(audits: Audits, start: int, rows: list[tuple[str, bool, bool]]) -> States:
    """The best audit to each state from a start, over rows (initial of the role, must go, truncated)."""
    states: States = {start: (0, 0)}
    for initial, goes, truncated in rows:
        new: States = {}
        for state, (cost, node) in with_inserts(audits, states).items():
            offer(audits, new, state, cost + DELETE, node, "D")
            if not goes:
                kept = KEPT.get((state, initial))
                if kept is not None:
                    offer(audits, new, kept, cost + TRUNCATED * truncated, node, "K")
                offer(audits, new, AFTER_INSERT[state], cost + REROLE + TRUNCATED * truncated, node, "R")
        states = new
    return states


def repaired_whole(rows: list[tuple[str, bool, bool]]) -> tuple[int, str]:
    """Cost and audit of a whole conversation."""
    audits = Audits()
    states = with_inserts(audits, walked(audits, NOTHING, rows))
    cost, node = states.get(NOTHING, states.get(ASSISTANT))
    if ASSISTANT in states:
        other, end = states[ASSISTANT]
        if other < cost or (other == cost and audits.less(end, node)):
            cost, node = other, end
    return cost, audits.text(node)


def transfers(rows: list[tuple[str, bool, bool]]) -> list[dict]:
    """start, end, cost, rank, audit for each two states: ranks order the audits of a piece, equal ones alike."""
    out = []
    for start in (NOTHING, SYSTEM, USER, ASSISTANT):
        audits = Audits()
        out += [{"start": start, "end": end, "cost": cost, "audit": audits.text(node)} for end, (cost, node) in walked(audits, start, rows).items()]
    rank = {a: k for k, a in enumerate(sorted({x["audit"] for x in out}))}
    return [x | {"rank": rank[x["audit"]]} for x in out]


def composed(pieces: list[list[dict]]) -> tuple[int, list[tuple[int, int]], str]:
    """Cost, start and end state of each piece, and the inserts at the end, of the best way through pieces in order.

    Audits to the states so far are known by their order alone: one of a piece more is as its former state's place and the
    piece's rank, so a tie needs no strings. Two audits of as many rows differ first at a row, so concatenating keeps their order.
    """
    best, ways = {NOTHING: (0, 0)}, []
    for piece in pieces:
        new: dict[int, tuple[int, tuple[int, int], int]] = {}
        for t in piece:
            if t["start"] in best:
                cost, place = best[t["start"]]
                found = cost + t["cost"], (place, t["rank"]), t["start"]
                if t["end"] not in new or found[:2] < new[t["end"]][:2]:
                    new[t["end"]] = found
        order = {p: k for k, p in enumerate(sorted({x[1] for x in new.values()}))}
        best = {end: (cost, order[place]) for end, (cost, place, _) in new.items()}
        ways.append({end: start for end, (_, _, start) in new.items()})
    cost, _, end = min((cost + INSERT * len(ENDING[s]), place, s) for s, (cost, place) in best.items())
    tail, chain = ENDING[end], []
    for way in reversed(ways):
        chain.append((way[end], end))
        end = way[end]
    return cost, chain[::-1], tail


def damaged(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text with faults put in by crc32 of `conv_id:turn` modulo 20: 0 drops a row, 1 empties its text,
    2 takes its marks out, 3 repeats it, 4 makes it the user's. Nulls count as one space."""
    spaced = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(spaced("conv_id"), F.lit(":"), spaced("turn")).cast("binary")) % 20
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), spaced("role").alias("role"), spaced("text").alias("text"), kind.alias("kind"))
    rows = rows.where("kind <> 0").withColumn("copy", F.explode(F.sequence(F.lit(1), F.when(F.col("kind") == 3, 2).otherwise(1))))
    return rows.select("conv_id", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"))


def keyed(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text of rows, and x, y, hashes of the text; roles and texts that are null are empty."""
    rows = rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), *[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("role", "text")])
    return rows.select("*", *text_key())


def ordered_turns(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, x, y, blank, truncated, first_turn, block: rows of `keyed` without texts, in ranges of their order, sorted; written.

    first_turn holds the first turn with the same role and text, where there are several.
    """
    narrow = rows.select(*ORDER, (~F.col("text").rlike(WORDY)).alias("blank"), (~F.col("text").rlike(ENDED)).alias("truncated"))
    again = narrow.where("not blank").groupBy("conv_id", "role", "x", "y").agg(F.min(F.struct(F.col("turn").isNotNull().alias("known"), "turn")).alias("first_turn"), F.count("*").alias("n")).where("n > 1").drop("n")
    marked = same(narrow, again, ["conv_id", "role", "x", "y"], "left")
    spark = rows.sparkSession
    ranges = max(spark.sparkContext.defaultParallelism, -(-rows.count() // ROWS_A_RANGE))
    return written(marked.repartitionByRange(ranges, *ORDER).sortWithinPartitions(*ORDER).withColumn("block", F.spark_partition_id()), "turns")


class Piece:
    """A run of a conversation's rows, and what it adds up to."""

    def __init__(self, key: tuple, first: tuple) -> None:
        self.key, self.first, self.rows = key, first, []
        self.initials: list[str] = []
        self.turns: list[int | None] = []
        self.counts = [0, 0, 0]

    def add(self, turn: int | None, role: str, blank: bool, again: bool, truncated: bool) -> None:
        fault = 0 if blank else 1 if again else 2 if truncated else None
        if fault is not None:
            self.counts[fault] += 1
        self.rows.append((role[:1], fault in (0, 1), fault == 2))
        self.initials.append(role[:1])
        self.turns.append(turn)

    def out(self, long: bool) -> dict:
        known = [t for t in self.turns if t is not None]
        cost, audit = (None, None) if long else repaired_whole(self.rows)
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(self.initials, self.initials[1:]))
        counts = dict(zip(("blank", "duplicate", "truncated"), self.counts))
        ends = {"first_initial": self.initials[0], "last_initial": self.initials[-1], "first_turn": self.turns[0], "last_turn": self.turns[-1]}
        span = {"turns": len(set(known)), "least_turn": min(known, default=None), "greatest_turn": max(known, default=None)}
        return dict(zip(("conv_id", "block", "chunk"), self.key)) | dict(zip(ORDER[1:], self.first)) | counts | ends | span | {"illegal": illegal, "cost": cost, "audit": audit, "ways": transfers(self.rows) if long else None}


PIECE = "conv_id long, block int, chunk int, turn long, role string, x long, y long, blank long, duplicate long, truncated long, first_initial string, last_initial string, first_turn long, last_turn long, turns long, least_turn long, greatest_turn long, illegal long, cost long, audit string, ways array<struct<start: int, end: int, cost: long, audit: string, rank: int>>"
KINDS = {"int": pa.int32(), "long": pa.int64(), "string": pa.string()}
WAYS = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("cost", pa.int64()), ("audit", pa.string()), ("rank", pa.int32())]))
PIECE_FIELDS = pa.schema([(f.split(" ")[0], KINDS[f.split(" ")[1]]) for f in PIECE.split(", ways")[0].split(", ")] + [("ways", WAYS)])


def in_pieces(most: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Makes pieces, in long conversations of at most so many rows, of rows (conv_id, block, turn, role, x, y, blank, truncated, first_turn, long) in
    their order."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        piece, last, done, was_long = None, None, [], False
        for batch in batches:
            for conv, block, turn, role, x, y, blank, truncated, first, long in zip(*(c.to_pylist() for c in batch.columns)):
                new = piece is None or (conv, block) != piece.key[:2]
                if new or (long and len(piece.rows) >= most):
                    if piece is not None:
                        done.append(piece.out(was_long))
                    piece, was_long = Piece((conv, block, 0 if new else piece.key[2] + 1), (turn, role, x, y)), long
                # equal rows lie side by side, but a border of two ranges may part them
                earlier = first is not None and (first["turn"] != turn or (conv, turn, role, x, y) == last)
                piece.add(turn, role, blank, earlier, truncated)
                last = conv, turn, role, x, y
            if len(done) >= 1000:
                yield pa.RecordBatch.from_pylist(done, PIECE_FIELDS)
                done = []
        if piece is not None:
            done.append(piece.out(was_long))
        if done:
            yield pa.RecordBatch.from_pylist(done, PIECE_FIELDS)

    return cut


def pieces_of(turns: DataFrame, most: int) -> DataFrame:
    """The pieces of ordered turns with their faults and audits; ways, in place of an audit, in conversations of several pieces; written."""
    by_block = turns.groupBy("conv_id", "block").agg(F.count("*").alias("n"))
    several = by_block.groupBy("conv_id").agg(F.count("*").alias("blocks"), F.max("n").alias("n")).where((F.col("blocks") > 1) | (F.col("n") > most)).select("conv_id", F.lit(True).alias("long"))
    several = broadcast_if_few(written(several, "several"))
    marked = same(turns, several, ["conv_id"], "left").select("conv_id", "block", "turn", "role", "x", "y", "blank", "truncated", "first_turn", F.coalesce("long", F.lit(False)).alias("long"))
    sorted_ = marked.repartition("conv_id", "block").sortWithinPartitions("conv_id", "block", "turn", "role", "x", "y")
    return written(sorted_.mapInArrow(in_pieces(most), PIECE), "pieces")


JOINED = "conv_id long, block int, chunk int, start int, end int, tail string, cost long, illegal long, turns long"


def joined_pieces(pieces: DataFrame) -> DataFrame:
    """Of the pieces of each long conversation the way through them, and what their borders add to its counts. A group has as many rows as a
    conversation has pieces, of a few numbers each."""

    def join(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        own = rows.sort_by([("block", "ascending"), ("chunk", "ascending")]).to_pylist()
        cost, chain, tail = composed([r["ways"] for r in own])
        out = []
        for k, (r, (start, end)) in enumerate(zip(own, chain)):
            before = own[k - 1] if k else None
            illegal = before is not None and before["last_initial"] + r["first_initial"] not in ("su", "ua", "au")
            shared = before is not None and before["last_turn"] is not None and before["last_turn"] == r["first_turn"]
            last = k == len(own) - 1
            out.append({"conv_id": r["conv_id"], "block": r["block"], "chunk": r["chunk"], "start": start, "end": end, "tail": tail if last else "", "cost": cost if last else 0, "illegal": int(illegal), "turns": -int(shared)})
        return pa.Table.from_pylist(out, pa.schema([(f.split(" ")[0], KINDS[f.split(" ")[1]]) for f in JOINED.split(", ")]))

    ways = F.transform("ways", lambda w: F.struct(w["start"].alias("start"), w["end"].alias("end"), w["cost"].alias("cost"), w["rank"].alias("rank")))
    narrow = pieces.where(F.col("ways").isNotNull()).select("conv_id", "block", "chunk", "first_initial", "last_initial", "first_turn", "last_turn", ways.alias("ways"))
    return narrow.groupBy("conv_id").applyInArrow(join, JOINED)


def audited(rows: DataFrame, most: int = MOST_PIECE) -> DataFrame:
    """Pieces (conv_id, block, chunk, turn, role, x, y of their first row, counts) with cost and audit chosen, of rows of `keyed`. Costs and counts
    of a conversation's pieces add up to its own. Written."""
    pieces = pieces_of(ordered_turns(rows), most)
    ways = joined_pieces(pieces)
    ways = ways.select(*[F.col(c).alias(f"j_{c}") for c in ways.columns])
    on = pieces["conv_id"].eqNullSafe(F.col("j_conv_id")) & (pieces["block"] == F.col("j_block")) & (pieces["chunk"] == F.col("j_chunk"))
    chosen = F.filter("ways", lambda w: (w["start"] == F.col("j_start")) & (w["end"] == F.col("j_end")))[0]["audit"]
    long = F.col("j_tail").isNotNull()
    counts = ["blank", "duplicate", "truncated", "least_turn", "greatest_turn"]
    more = lambda c: (F.col(c) + F.coalesce(F.col(f"j_{c}"), F.lit(0))).alias(c)
    audit = F.when(long, F.concat(chosen, F.col("j_tail"))).otherwise(F.col("audit")).alias("audit")
    cost = F.coalesce(F.col("j_cost"), F.col("cost")).alias("cost")
    return written(pieces.join(ways, on, "left").select(*ORDER, "block", "chunk", *counts, more("turns"), more("illegal"), cost, audit), "audited")


def edited(rows: DataFrame, audits: DataFrame) -> DataFrame:
    """conv_id, edit, turn, role, text: the edits of each conversation with what they leave, deleted rows as they were and edit D, in order.

    Texts are shuffled once, to their conversation, with the audits of its pieces, each before its first row; sorting spills,
    and a conversation of any length streams by. Its rows come in order within one partition.
    """

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv: tuple | None = None
        state, queue, at = NOTHING, deque(), 0
        out: list[list] = [[], [], [], [], []]

        def put(*row: object) -> None:
            for column, value in zip(out, row):
                column.append(value)

        def next_edit() -> str | None:
            nonlocal at
            while queue and at >= len(queue[0]):
                queue.popleft()
                at = 0
            if not queue:
                return None
            at += 1
            return queue[0][at - 1]

        def insert() -> None:
            nonlocal state
            state = AFTER_INSERT[state]
            put(conv[0], "I", None, ROLES[state], "")

        def finish() -> None:
            nonlocal state, at
            while conv is not None and next_edit() is not None:  # inserts at the end
                insert()
            state, at = NOTHING, 0
            queue.clear()

        def flushed() -> pa.RecordBatch:
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string()]
            batch = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds)], ["conv_id", "edit", "turn", "role", "text"])
            for c in out:
                c.clear()
            return batch

        for batch in batches:
            for own, turn, role, text, audit in zip(*(c.to_pylist() for c in batch.columns)):
                if conv is None or own != conv[0]:
                    finish()
                    conv = (own,)
                if audit is not None:
                    queue.append(audit)
                    continue
                edit = next_edit()
                while edit == "I":
                    insert()
                    edit = next_edit()
                if edit == "R":
                    state = AFTER_INSERT[state]
                    role = ROLES[state]
                elif edit == "K":
                    state = KEPT[(state, role[:1])]
                put(own, edit, turn, role, text)
            if out[0]:
                yield flushed()
        finish()
        if out[0]:
            yield flushed()

    none = lambda kind: F.lit(None).cast(kind)
    texts = rows.select(*ORDER, F.lit(1).alias("kind"), none("int").alias("block"), none("int").alias("chunk"), "text", none("string").alias("audit"))
    both = texts.union(audits.select(*ORDER, F.lit(0).alias("kind"), "block", "chunk", none("string").alias("text"), "audit"))
    together = both.repartition("conv_id").sortWithinPartitions(*ORDER, "kind", "block", "chunk")
    return together.select("conv_id", "turn", "role", "text", "audit").mapInArrow(apply, "conv_id long, edit string, turn long, role string, text string")


def digests(edits: DataFrame) -> DataFrame:
    """conv_id, audit, repaired_sha256 of the rows of `edited`, as they stream by in order: the hash of `role:text` of all that is left, newline-joined."""

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, audit, sha, some = None, [], hashlib.sha256(), False

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([conv[0]], pa.int64()), pa.array(["".join(audit)]), pa.array([sha.hexdigest()])], ["conv_id", "audit", "repaired_sha256"])

        for batch in batches:
            done = []
            for own, edit, role, text in zip(*(c.to_pylist() for c in batch.columns)):
                if conv is None or own != conv[0]:
                    if conv is not None:
                        done.append(out())
                    conv, audit, sha, some = (own,), [], hashlib.sha256(), False
                audit.append(edit)
                if edit != "D":
                    sha.update(f"{chr(10) if some else ''}{role}:{text}".encode("utf-8", "surrogatepass"))
                    some = True
            if done:
                yield pa.Table.from_batches(done).combine_chunks().to_batches()[0]
        if conv is not None:
            yield out()

    return edits.select("conv_id", "edit", "role", "text").mapInArrow(digest, "conv_id long, audit string, repaired_sha256 string")


def repaired(conversations: DataFrame) -> DataFrame:
    """conv_id, edit, turn, role, text: the repaired turns in order, with the deleted ones (edit D)."""
    rows = keyed(conversations)
    return edited(rows, audited(rows))


def repair_report(conversations: DataFrame, rows: DataFrame, most_piece: int = MOST_PIECE) -> DataFrame:
    """Per conv_id of conversations, for its rows (which may all be gone): gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256."""
    rows = keyed(rows)
    audits = audited(rows, most_piece)
    told = digests(edited(rows, audits))
    counts = ["blank", "duplicate", "truncated", "illegal", "cost"]
    zero = F.lit(0).cast("long")
    every = conversations.select(F.col("conv_id").cast("long").alias("conv_id")).distinct()
    every = every.select("conv_id", *[zero.alias(c) for c in counts], zero.alias("turns"), F.lit(None).cast("long").alias("least_turn"), F.lit(None).cast("long").alias("greatest_turn"))
    all_ = every.union(audits.select(*every.columns)).groupBy("conv_id").agg(*[F.sum(c).alias(c) for c in [*counts, "turns"]], F.min("least_turn").alias("a"), F.max("greatest_turn").alias("z"))
    gaps = F.coalesce(F.col("z") - F.col("a") + 1 - F.col("turns"), zero).alias("gaps")
    nothing = hashlib.sha256(b"").hexdigest()
    return same(all_, told, ["conv_id"], "left").select("conv_id", gaps, *counts, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(nothing)).alias("repaired_sha256"))
