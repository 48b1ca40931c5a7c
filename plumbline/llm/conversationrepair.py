"""Repair of the structure of conversations by cheapest edits (operator 12).

Every row of a conversation is kept, given another role or deleted, and rows without text may be inserted, so that the roles
begin with a system row at most and go on in turns of user and assistant. The edits are a path through a directed graph
without cycles: its nodes are (row, role reached), its edges the edits. A path's weight is one integer: the high digits hold
the cost, and below stand the letters of its edits, three bits each, the first letter highest and zeros after the last. The
integers' order is the order by cost and then by letters, so an ordinary minimum at each node decides everything, ties
included. Of two paths to the same node neither's letters begin the other's at equal cost (the rest could only be
inserted rows, which cost), so the minimum at a node stands whatever follows.

Rows of a conversation come sorted to one task, which holds four paths, no rows: each path has its weight, its letters and
the running SHA-256 of its repaired text. After BLOCK rows the letters are set down and the paths' order among each other
stands for them in the next block's integers, so these do not grow with the conversation. The digest of a whole conversation
is one sequence by definition, so one task streams it; what is compared with other rows (repeated texts) is dealt by text.

Order of rows: turn (nulls first), then role and text; equal rows are adjacent. The initial of a role is its first character; a row
whose initial is not s, u or a, the empty role included, cannot be kept as it is. Null roles and texts are one space, as is a
null turn where the damage is dealt; null conversation ids are one conversation. Repeated rows are duplicates of each other.
Texts of any length are hashed whole, other columns are not looked at, and an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumbline.session import ship, table

BLANKS = " \t\n\x0b\x0c\r"
#: Edit letters by digit, in ASCII order; 0 is the padding at the end.
LETTERS = "\0DIKR"
DELETE, INSERT, KEEP, REROLE = 1, 2, 3, 4
COSTS = {DELETE: 4, INSERT: 3, KEEP: 0, REROLE: 3}
TRUNCATED_COST = 3
BLANK_FAULT, DUPLICATE_FAULT, TRUNCATED_FAULT = 1, 2, 3
#: Roles reached: nothing yet, system, user, assistant; what may follow each; roles of new rows.
START, SYSTEM, USER, ASSISTANT = range(4)
FOLLOWS = {START: (SYSTEM, USER), SYSTEM: (USER,), USER: (ASSISTANT,), ASSISTANT: (USER,)}
INITIALS = {"s": SYSTEM, "u": USER, "a": ASSISTANT}
NAMES = {USER: "user", ASSISTANT: "assistant"}
#: Ways to go on from a role by inserted rows: a third insertion would come back to the same role at a cost.
INSERTED = {s: [(), *[(x,) for x in FOLLOWS[s] if x in NAMES], *[(x, y) for x in FOLLOWS[s] if x in NAMES for y in FOLLOWS[x]]] for s in FOLLOWS}
BLOCK = 64
DIGITS = 3 * BLOCK + 2
BITS = 3


def damage(conversations: DataFrame) -> DataFrame:
    """Rows damaged by the checksum of their place: one in twenty each is gone (marked, not removed), loses its text, its
    sentence ends, is repeated, or becomes the user's."""
    spelled = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(spelled("conv_id"), F.lit(":"), spelled("turn"))) % 20
    rows = conversations.select("conv_id", F.col("turn").cast("long").alias("turn"), spelled("role").alias("role"), spelled("text").alias("text"), kind.alias("kind"))
    text = F.when(F.col("kind").isin(0, 1), "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("kind") == 4, "user").otherwise(F.col("role"))
    times = F.when(F.col("kind") == 3, 2).otherwise(1)
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), (F.col("kind") == 0).alias("gone"), F.explode(F.array_repeat(F.lit(1), times)).alias("time")).drop("time")


def faults(rows: DataFrame) -> DataFrame:
    """`rows` (conv_id, turn, role, text, gone) with `fault`, the first that holds: 1 blank, 2 role and text seen earlier,
    3 no sentence end, 0 none; and `seen`, how many rows of the same role and text come before."""
    earlier = Window.partitionBy("conv_id", "gone", "role", F.sha2("text", 256)).orderBy(F.col("turn").asc_nulls_first())
    stripped = F.rtrim(F.col("text"), F.lit(BLANKS))
    marked = rows.withColumn("seen", F.row_number().over(earlier) - 1)
    fault = F.when(stripped == "", BLANK_FAULT).when(F.col("seen") > 0, DUPLICATE_FAULT).when(~F.substring(stripped, -1, 1).isin(".", "!", "?"), TRUNCATED_FAULT).otherwise(0)
    return marked.withColumn("fault", fault)


def in_order(rows: DataFrame) -> DataFrame:
    """The rows of each conversation in one partition, sorted; rows that are gone only show that their conversation exists."""
    order = [F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), "role", "text", "seen"]
    return faults(rows).repartition("conv_id").sortWithinPartitions(*order).select("conv_id", "turn", "role", "text", "gone", "fault")


class Path:
    """The best path to a node: weight, letters of this block so far, digest of the repaired rows, what was set down."""

    __slots__ = ("digest", "down", "used", "weight")

    def __init__(self, weight: int, used: int, digest, down):
        self.weight, self.used, self.digest, self.down = weight, used, digest, down


LOW = BITS * DIGITS
HIGH = LOW + 2
PLACES = [LOW - BITS * (k + 1) for k in range(DIGITS)]
#: Weight of each letter at each place, its cost included.
WEIGHTS = {e: [(COSTS[e] << HIGH) + (e << p) for p in PLACES] for e in COSTS}
ADDED = TRUNCATED_COST << HIGH


class Repair:
    """The cheapest edits of one conversation, fed row by row."""

    def __init__(self):
        self.paths = {START: Path(0, 0, hashlib.sha256(), None)}
        self.cost = 0
        self.rows = 0

    def row(self, role: str, text: bytes, fault: int) -> None:
        if self.rows and self.rows % BLOCK == 0:
            self.set_down()
        self.rows += 1
        initial = INITIALS.get(role[:1])
        best: dict[int, tuple] = {}
        for state, path in self.paths.items():
            for extra in INSERTED[state]:
                weight, used, at = path.weight, path.used, state
                for x in extra:
                    weight, used, at = weight + WEIGHTS[INSERT][used], used + 1, x
                ways = [(DELETE, at)]
                if fault not in (BLANK_FAULT, DUPLICATE_FAULT):
                    if initial in FOLLOWS[at]:
                        ways.append((KEEP, initial))
                    ways += [(REROLE, x) for x in FOLLOWS[at] if x in NAMES]
                for edit, to in ways:
                    total = weight + WEIGHTS[edit][used] + (ADDED if fault == TRUNCATED_FAULT and edit != DELETE else 0)
                    if to not in best or total < best[to][0]:
                        best[to] = total, used + 1, state, extra, edit
        self.paths = {to: self.extended(to, role, text, *way) for to, way in best.items()}

    def extended(self, to: int, role: str, text: bytes, weight: int, used: int, state: int, extra: tuple, edit: int) -> Path:
        path = self.paths[state]
        digest = path.digest
        if extra or edit != DELETE:
            digest = self.inserted(digest.copy(), state, extra)
        if edit != DELETE:
            digest.update(b"%s%s:" % (b"\n" if extra or state != START else b"", (role if edit == KEEP else NAMES[to]).encode()))
            digest.update(text)
        return Path(weight, used, digest, path.down)

    @staticmethod
    def inserted(digest, state: int, extra: tuple):
        for x in extra:
            digest.update(b"%s%s:" % (b"\n" if state != START else b"", NAMES[x].encode()))
            state = x
        return digest

    def set_down(self) -> None:
        """Costs go into self.cost as far as all paths share them, and letters go out of the integers; the paths' order stays."""
        least = min(p.weight >> HIGH for p in self.paths.values())
        order = sorted({p.weight & ((1 << HIGH) - 1) for p in self.paths.values()})
        for p in self.paths.values():
            p.down = (p.down, self.letters(p))
            p.weight = ((p.weight >> HIGH) - least << HIGH) + (order.index(p.weight & ((1 << HIGH) - 1)) << LOW)
            p.used = 0
        self.cost += least

    @staticmethod
    def letters(path: Path) -> str:
        return "".join(LETTERS[path.weight >> p & 7] for p in PLACES[: path.used])

    def end(self) -> tuple[int, str, str]:
        """(cost, letters, SHA-256 of the repaired conversation)."""
        if self.rows and self.rows % BLOCK == 0:
            self.set_down()
        best = None
        for state, path in self.paths.items():
            for extra in INSERTED[state]:
                weight, used = path.weight, path.used
                for _ in extra:
                    weight, used = weight + WEIGHTS[INSERT][used], used + 1
                if (extra[-1] if extra else state) in (START, ASSISTANT) and (best is None or weight < best[0]):
                    best = weight, used, state, extra
        weight, used, state, extra = best
        path = self.paths[state]
        found, down = [self.letters(Path(weight, used, None, None))], path.down
        while down:
            found.append(down[1])
            down = down[0]
        return self.cost + (weight >> HIGH), "".join(reversed(found)), self.inserted(path.digest.copy(), state, extra).hexdigest()


class Summary:
    """What the result says of one conversation."""

    LEGAL = ("su", "ua", "au")

    def __init__(self, key):
        self.key, self.repair = key, Repair()
        self.faults = [0, 0, 0, 0]
        self.illegal = self.turns = 0
        self.first = self.last = self.initial = None

    def row(self, turn: int | None, role: str, text: str, fault: int) -> None:
        if turn is not None and turn != self.last:
            self.turns += 1
            self.first, self.last = turn if self.first is None else self.first, turn
        self.faults[fault] += 1
        if self.initial is not None and self.initial + role[:1] not in self.LEGAL:
            self.illegal += 1
        self.initial = role[:1]
        self.repair.row(role, text.encode(), fault)

    def result(self) -> tuple:
        gaps = self.last - self.first + 1 - self.turns if self.turns else 0
        return (self.key, gaps, *self.faults[1:], self.illegal, *self.repair.end())


COLUMNS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def runs(batches) -> Iterator[tuple[bool, tuple]]:
    """The rows of sorted batches, each with whether its conversation is another than the one before."""
    before, began = None, False
    for batch in batches:
        for values in zip(*batch.columns):
            row = tuple(v.as_py() for v in values)
            yield not began or row[0] != before, row
            before, began = row[0], True


def repair(rows: DataFrame) -> DataFrame:
    """One row a conversation of `rows` (conv_id, turn, role, text, gone): its faults, the cost and letters of its cheapest
    edits, and the SHA-256 of the repaired conversation."""
    ship(rows.sparkSession)
    kind = rows.schema["conv_id"].dataType
    schema = f"conv_id {kind.simpleString()}, gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string, repaired_sha256 string"

    def run(batches):
        key_type, done, now = None, [], None

        def batch():
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done), [key_type, *[pa.int64()] * 6, pa.string(), pa.string()])], ["conv_id", *COLUMNS])

        def typed():
            nonlocal key_type
            for b in batches:
                key_type = b.schema.field("conv_id").type
                yield b

        for new, (key, turn, role, text, gone, fault) in runs(typed()):
            if new:
                if now:
                    done.append(now.result())
                    if len(done) == 1000:
                        yield batch()
                        done = []
                now = Summary(key)
            if not gone:
                now.row(turn, role, text, fault)
        if now:
            done.append(now.result())
        if done:
            yield batch()

    return in_order(rows).mapInArrow(run, schema)


def repaired(rows: DataFrame) -> DataFrame:
    """The repaired conversations: (conv_id, place, edit, turn, role, text), deleted rows left out, inserted ones without a turn.
    The letters of `repair` come first in each conversation's run of rows and are carried out as the rows go by."""
    ship(rows.sparkSession)
    kind = rows.schema["conv_id"].dataType.simpleString()
    plans = repair(rows).select("conv_id", F.lit(True).alias("plan"), F.lit(None).cast("bigint").alias("turn"), F.lit("").alias("role"), F.col("audit").alias("text"), F.lit(0).alias("seen"))
    marked = faults(rows).where(~F.col("gone")).select("conv_id", F.lit(False).alias("plan"), "turn", "role", "text", "seen")
    order = [F.col("conv_id").asc_nulls_first(), F.col("plan").desc(), F.col("turn").asc_nulls_first(), "role", "text", "seen"]
    both = plans.unionByName(marked).repartition("conv_id").sortWithinPartitions(*order).drop("seen")

    def run(batches):
        letters, at, place, state = "", 0, 0, START
        key_type = None

        def steps():
            nonlocal letters, at, place, state, key_type
            key = None

            def typed():
                nonlocal key_type
                for b in batches:
                    key_type = b.schema.field("conv_id").type
                    yield b

            def insertions():
                nonlocal at, place, state
                while at < len(letters) and letters[at] == "I":
                    state = ASSISTANT if state == USER else USER
                    at, place = at + 1, place + 1
                    yield key, place, "I", None, NAMES[state], ""

            for new, (k, plan, turn, role, text) in runs(typed()):
                if new:
                    yield from insertions()
                    key, letters, at, place, state = k, text, 0, 0, START
                if plan:
                    continue
                yield from insertions()
                edit, at = letters[at], at + 1
                if edit != "D":
                    state = INITIALS[role[:1]] if edit == "K" else ASSISTANT if state == USER else USER
                    place += 1
                    yield key, place, edit, turn, role if edit == "K" else NAMES[state], text
            yield from insertions()

        held = []
        types = lambda: [key_type, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string()]
        for row in steps():
            held.append(row)
            if len(held) == 500:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), types())], ["conv_id", "place", "edit", "turn", "role", "text"])
                held = []
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), types())], ["conv_id", "place", "edit", "turn", "role", "text"])

    return both.mapInArrow(run, f"conv_id {kind}, place bigint, edit string, turn bigint, role string, text string")


def op12_conversations(spark, sf_dir):
    return repair(damage(table(spark, sf_dir, "conversations")))


OP12_SQL = r"""
WITH RECURSIVE spelled AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
       xor(list_reduce(list_prepend(4294967295::UBIGINT, list_transform(string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), ''), lambda c: ascii(c)::UBIGINT)),
           lambda h, b: list_reduce(list_prepend(xor(h, b), range(8)::UBIGINT[]), lambda x, i: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)), 4294967295) % 20 AS kind FROM conversations),
damaged AS (SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role, CASE WHEN kind = 1 THEN '' WHEN kind = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
            FROM spelled, (SELECT unnest([1, 2]) AS time) WHERE kind <> 0 AND (time = 1 OR kind = 3)),
counted AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST) AS same FROM damaged),
numbered AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, same) AS i,
             rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS solid FROM counted),
rows AS (SELECT conv_id, turn, i, role, text, left(role, 1) AS initial,
         CASE WHEN solid = '' THEN 1 WHEN same > 1 THEN 2 WHEN right(solid, 1) NOT IN ('.', '!', '?') THEN 3 ELSE 0 END AS fault,
         lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) AS before FROM numbered),
gap(state, inserted, reached, added, lines) AS (VALUES ('', '', '', 0, ''), ('s', '', 's', 0, ''), ('u', '', 'u', 0, ''), ('a', '', 'a', 0, ''),
    ('', 'I', 'u', 3, 'user:'), ('s', 'I', 'u', 3, chr(10) || 'user:'), ('u', 'I', 'a', 3, chr(10) || 'assistant:'), ('a', 'I', 'u', 3, chr(10) || 'user:'),
    ('', 'II', 'a', 6, 'user:' || chr(10) || 'assistant:'), ('s', 'II', 'a', 6, chr(10) || 'user:' || chr(10) || 'assistant:')),
follows(reached, role_to) AS (VALUES ('', 's'), ('', 'u'), ('s', 'u'), ('u', 'a'), ('a', 'u')),
path(conv_id, i, state, k) AS (
    SELECT DISTINCT conv_id, 0::BIGINT, '', {'cost': 0::BIGINT, 'audit': '', 'lines': ''} FROM conversations
    UNION ALL
    SELECT conv_id, i, state, min(k) FROM (
        SELECT p.conv_id, r.i, e.role_to AS state, {'cost': p.k.cost + g.added + e.cost, 'audit': p.k.audit || g.inserted || e.letter,
            'lines': p.k.lines || g.lines || CASE WHEN e.letter = 'D' THEN '' ELSE CASE WHEN p.k.lines || g.lines = '' THEN '' ELSE chr(10) END
                || CASE WHEN e.letter = 'K' THEN r.role WHEN e.role_to = 'u' THEN 'user' ELSE 'assistant' END || ':' || r.text END} AS k
        FROM path p JOIN rows r ON r.conv_id IS NOT DISTINCT FROM p.conv_id AND r.i = p.i + 1 JOIN gap g ON g.state = p.state
        JOIN (SELECT x.reached, x.reached AS role_to, 'D' AS letter, 4 AS cost, 0 AS f, '' AS initial FROM (SELECT DISTINCT state AS reached FROM gap) x
              UNION ALL SELECT reached, role_to, 'K', CASE f WHEN 3 THEN 3 ELSE 0 END, f, role_to FROM follows, (SELECT unnest([0, 3]) AS f)
              UNION ALL SELECT reached, role_to, 'R', CASE f WHEN 3 THEN 6 ELSE 3 END, f, '' FROM follows, (SELECT unnest([0, 3]) AS f) WHERE role_to <> 's') e
          ON e.reached = g.reached AND (e.letter = 'D' OR e.f = r.fault) AND (e.letter <> 'K' OR e.initial = r.initial)) GROUP BY conv_id, i, state),
ends AS (SELECT p.conv_id, min({'cost': p.k.cost + g.added, 'audit': p.k.audit || g.inserted, 'lines': p.k.lines || g.lines}) AS k
         FROM path p JOIN gap g ON g.state = p.state AND g.reached IN ('', 'a')
         JOIN (SELECT c.conv_id, count(r.i) AS n FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN rows r ON r.conv_id IS NOT DISTINCT FROM c.conv_id GROUP BY 1) l ON l.conv_id IS NOT DISTINCT FROM p.conv_id AND l.n = p.i
         GROUP BY p.conv_id),
counts AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (WHERE fault = 1) AS blank, count(*) FILTER (WHERE fault = 2) AS duplicate,
                  count(*) FILTER (WHERE fault = 3) AS truncated, count(*) FILTER (WHERE i > 1 AND before || initial NOT IN ('su', 'ua', 'au')) AS illegal FROM rows GROUP BY conv_id)
SELECT e.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
       e.k.cost AS cost, e.k.audit AS audit, sha256(e.k.lines) AS repaired_sha256
FROM ends e LEFT JOIN counts c ON c.conv_id IS NOT DISTINCT FROM e.conv_id
"""
