"""Operator 11: repair of conversations whose turns are missing, blank, repeated, cut off or of the wrong role.

Rows of a conversation are put in order, their faults found, and the row of role initials is parsed by an error-correcting
Earley parser (``earley.py``) that keeps, reroles, deletes and inserts turns at the least cost.

A conversation may be of any length.  Rows are dealt by ranges of (conversation, turn, ...), so a long one spreads over many
tasks, and only letters and row numbers go there, never texts.  A task parses the conversations that lie wholly in it; of those
at its two ends, and of those longer than ``piece_rows``, it gives pieces with their costs from every state of the
parse to every other.  A second pass finds the states between the pieces and a third their edits.  Repeated rows are
found by a count of 128-bit hashes, aggregated before its shuffle.

Nulls and edge cases: a null conv_id is a conversation of its own; turns come in ascending order, nulls first, rows of one
turn by role, then by the hash of their text; rows alike stand side by side and all but the first are duplicates; a null
text is blank; a role that is null, empty or of another initial than s, u, a fits nowhere and is reroled or deleted; an
empty table gives no rows; other columns are ignored.  A conversation without rows after the damage has cost 0.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lineupkit.llm.earley import ROLES, Fold, Grammar, matrix, parse, repair
from lineupkit.llm.line_dedup import BLANKS
from lineupkit.llm.workers import bound_batches
from lineupkit.runtime import stash, table

NAMES = {"u": "user", "a": "assistant"}
_PIECES = "conv_id long, part int, piece int, ids array<long>, tokens string, audit string, roles string, costs array<int>"


def _bare(text: Column) -> Column:
    return F.btrim(text, F.lit(BLANKS))


def _edits(tokens: str, ids: list[int], audit: str) -> tuple[list[int | None], str]:
    """Row numbers and letters by edit: an insert has none."""
    out, letters, k = [], [], 0
    for edit in audit:
        if edit == "I":
            out.append(None)
            letters.append("++")
        else:
            out.append(ids[k])
            letters.append(tokens[2 * k : 2 * k + 2])
            k += 1
    return out, "".join(letters)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int32(), pa.int32(), pa.list_(pa.int64()), pa.string(), pa.string(), pa.string(), pa.list_(pa.int32())]
    names = [x.split(" ")[0] for x in _PIECES.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], names=names)


def _pieces(grammar: Grammar, piece_rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        now, ids, tokens, open_, number, out, size = object(), [], [], True, 0, [], 0

        def flush(whole: bool) -> None:
            nonlocal number, size
            if not ids:
                return
            letters = "".join(tokens)
            if whole:
                _, audit, roles = repair(letters, grammar)
                by_edit, by_letter = _edits(letters, ids, audit)
                out.append((now, part, number, by_edit, by_letter, audit, roles, None))
            else:
                out.append((now, part, number, list(ids), letters, None, None, matrix(letters, grammar)))
            number, size = number + 1, size + len(ids)
            ids.clear()
            tokens.clear()

        first = True
        for batch in batches:
            for conv, row, token in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "id", "token")), strict=True):
                if first or conv != now:
                    flush(whole=not open_)
                    # What comes first may have begun in the task before.
                    now, open_, first = conv, first, False
                elif len(ids) >= piece_rows:
                    open_ = True
                    flush(whole=False)
                ids.append(row)
                tokens.append(token)
            if size >= 4096:
                yield _batch(out)
                out, size = [], 0
        flush(whole=False)  # may go on in the next task
        if out:
            yield _batch(out)

    return run


def _ways(grammar: Grammar):
    """The states between the pieces of every conversation."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, fold, keys, first = None, Fold(grammar), [], True

        def ended() -> pa.RecordBatch:
            rows = [(*k, *e) for k, e in zip(keys, fold.entries(), strict=True)]
            return pa.RecordBatch.from_arrays([pa.array(x, pa.int32()) for x in zip(*rows, strict=True)], names=["part", "piece", "entry", "exit"])

        for batch in batches:
            for conv, part, piece, costs in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "part", "piece", "costs")), strict=True):
                if not first and conv != now:
                    yield ended()
                    fold, keys = Fold(grammar), []
                now, first = conv, False
                fold.add(costs)
                keys.append((part, piece))
        if keys:
            yield ended()

    return run


def _traced(grammar: Grammar):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                entry = grammar.states[r["entry"]]
                if r["exit"] < 0:
                    _, audit, roles = repair(r["tokens"], grammar, entry)
                else:
                    _, audit, roles = parse(r["tokens"], grammar, entry, closing=False)[grammar.states[r["exit"]]]
                ids, letters = _edits(r["tokens"], r["ids"], audit)
                out.append((r["conv_id"], r["part"], r["piece"], ids, letters, audit, roles, None))
            yield _batch(out)

    return run


def repair_conversations(rows: DataFrame, grammar: Grammar = ROLES, piece_rows: int = 2_000, tasks: int | None = None) -> DataFrame:
    """One row an edit, of (conv_id, turn, role, text) rows.

    (conv_id, part, piece, place) is the order; ``edit`` is K, R, D or I; ``cost`` its cost; ``role`` and ``text`` are those after the
    repair (of a deleted row its own); ``initial`` and ``fault`` are the row's before it (null for an insert).
    """
    spark = rows.sparkSession
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    bare = _bare(text)
    fault = F.when(bare == "", "b").when(~F.right(bare, F.lit(1)).isin(".", "!", "?"), "t").otherwise(".")
    first = F.substring(role, 1, 1)
    known = rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text"))
    known = known.select(
        "*", F.monotonically_increasing_id().alias("id"), F.when(first.isin("s", "u", "a"), first).otherwise("?").alias("initial"), fault.alias("fault"),
        F.xxhash64("role", "text").alias("ha_"), F.xxhash64(F.lit("second"), "role", "text").alias("hb_"),
    )
    # Numbers are fixed by being written: all that follows reads them back.
    known = stash(known, "turns")
    light = known.drop("text")
    # Rows of one role and text in one conversation: all but the first in order.
    same = light.groupBy("conv_id", "ha_", "hb_").agg(F.count("*").alias("n_"), F.min(F.struct("turn", "id")).alias("first_")).where("n_ > 1")
    same = same.select(F.col("conv_id").alias("c_"), F.col("ha_").alias("a_"), F.col("hb_").alias("b_"), F.col("first_.id").alias("kept_"))
    on = light["conv_id"].eqNullSafe(F.col("c_")) & (F.col("ha_") == F.col("a_")) & (F.col("hb_") == F.col("b_"))
    repeated = F.col("kept_").isNotNull() & (F.col("kept_") != F.col("id"))
    token = F.concat("initial", F.when(F.col("fault") == "b", "b").when(repeated, "d").otherwise(F.col("fault")))
    coded = light.join(same, on, "left").select("conv_id", "turn", "role", "ha_", "id", token.alias("token"))
    order = ["conv_id", "turn", "role", "ha_", "id"]
    tasks = tasks or int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = coded.repartitionByRange(tasks, *order).sortWithinPartitions(*order).select("conv_id", "id", "token")
    pieces = stash(dealt.mapInArrow(_pieces(grammar, piece_rows), _PIECES), "pieces")
    cut = pieces.where("audit IS NULL")
    between = cut.select("conv_id", "part", "piece", "costs").repartition("conv_id").sortWithinPartitions("conv_id", "part", "piece")
    ways = between.mapInArrow(_ways(grammar), "part int, piece int, entry int, exit int")
    traced = cut.join(ways, ["part", "piece"]).mapInArrow(_traced(grammar), _PIECES)
    solved = pieces.where("audit IS NOT NULL").unionByName(traced)
    letter = lambda c, k: F.substring(c, k, F.lit(1))
    edits = solved.select("conv_id", "part", "piece", "audit", "roles", "tokens", F.posexplode("ids").alias("place", "id"))
    edits = edits.select(
        "conv_id", "part", "piece", "place", "id", letter(F.col("audit"), F.col("place") + 1).alias("edit"),
        letter(F.col("roles"), F.col("place") + 1).alias("to_"), letter(F.col("tokens"), F.col("place") * 2 + 2).alias("fault"),
    )
    new = F.when(F.col("to_") == "u", NAMES["u"]).when(F.col("to_") == "a", NAMES["a"])
    cost = F.when(F.col("edit") == "D", grammar.delete).when(F.col("edit") == "I", grammar.insert).when(F.col("edit") == "R", grammar.rerole).otherwise(0)
    cost = cost + F.when((F.col("fault") == "t") & (F.col("edit") != "D"), grammar.truncated).otherwise(0)
    own = ["conv_id", "part", "piece", "place", "edit", cost.cast("long").alias("cost")]
    held = edits.where("id IS NOT NULL").withColumnRenamed("conv_id", "c_").join(known.drop("fault"), "id")
    held = held.select(*own, "turn", F.when(F.col("edit") == "R", new).otherwise(F.col("role")).alias("role"), "text", "initial", "fault")
    none = lambda kind, n: F.lit(None).cast(kind).alias(n)
    put = edits.where("id IS NULL").select(*own, none("long", "turn"), new.alias("role"), F.lit("").alias("text"), none("string", "initial"), none("string", "fault"))
    return held.unionByName(put)


_DIGEST = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


class _Sum:
    """Digest of one conversation, row by row; only its audit grows."""

    def __init__(self) -> None:
        self.turns, self.low, self.high, self.last, self.before = 0, None, None, None, None
        self.faults, self.illegal, self.cost, self.audit, self.text, self.any = {"b": 0, "d": 0, "t": 0}, 0, 0, [], hashlib.sha256(), False

    def add(self, edit, cost, turn, role, text, initial, fault) -> None:
        self.cost += cost
        self.audit.append(edit)
        if edit != "I":
            if turn is not None:
                self.turns += turn != self.last
                self.low, self.high, self.last = turn if self.low is None else self.low, turn, turn
            if fault in self.faults:
                self.faults[fault] += 1
            self.illegal += self.before is not None and self.before + initial not in ("su", "ua", "au")
            self.before = initial
        if edit != "D":
            self.text.update((("\n" if self.any else "") + f"{role}:{text}").encode())
            self.any = True

    def row(self) -> tuple:
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.turns
        return gaps, *(self.faults[k] for k in "bdt"), self.illegal, self.cost, "".join(self.audit), self.text.hexdigest()


def digests(edits: DataFrame) -> DataFrame:
    """One row a conversation.  A sha256 is one sequence: the rows of a conversation stream through one task in order, none is held."""
    columns = ["conv_id", "edit", "cost", "turn", "role", "text", "initial", "fault"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, now, total, first = [], None, _Sum(), True
        kinds = [pa.int64()] * 7 + [pa.string()] * 2
        names = [x.split(" ")[0] for x in _DIGEST.split(", ")]
        batch_of = lambda: pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], kind) for k, kind in enumerate(kinds)], names=names)
        for batch in batches:
            for conv, *rest in zip(*(batch.column(c).to_pylist() for c in columns), strict=True):
                if first or conv != now:
                    if not first:
                        out.append((now, *total.row()))
                    now, total, first = conv, _Sum(), False
                total.add(*rest)
            if len(out) >= 1024:
                yield batch_of()
                out = []
        if not first:
            out.append((now, *total.row()))
        if out:
            yield batch_of()

    bound_batches(edits.sparkSession)
    order = ["conv_id", "part", "piece", "place"]
    return edits.repartition("conv_id").sortWithinPartitions(*order).select(*columns).mapInArrow(run, _DIGEST)


def damaged(conversations: DataFrame) -> DataFrame:
    """The contract's damage, by a hash of conversation and turn."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat_ws(":", space("conv_id"), space("turn"))) % 20
    rows = conversations.select("conv_id", "turn", space("role").alias("role"), space("text").alias("text"), kind.alias("kind_")).where("kind_ <> 0")
    text = F.when(F.col("kind_") == 1, "").when(F.col("kind_") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("kind_") == 4, "user").otherwise(F.col("role"))
    times = F.when(F.col("kind_") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(times).alias("copy_")).drop("copy_")


def op11_earley_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations, damaged and repaired."""
    rows = table(spark, sf_dir, "conversations")
    found = digests(repair_conversations(damaged(rows))).withColumnRenamed("conv_id", "c_")
    every = rows.select(F.col("conv_id").cast("long").alias("conv_id")).distinct()
    sums = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    joined = every.join(found, every["conv_id"].eqNullSafe(F.col("c_")), "left")
    empty = hashlib.sha256(b"").hexdigest()
    return joined.select("conv_id", *[F.coalesce(n, F.lit(0)).cast("long").alias(n) for n in sums], F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(empty)).alias("repaired_sha256"))


def _sql() -> str:
    """The same repair as a recursion over rows: the least (cost, audit) of every state, six digits of cost before the audit."""
    none = "'999999'"
    plus = lambda x, c, e: f"CASE WHEN {x} = {none} THEN {x} ELSE lpad(CAST(CAST(left({x}, 6) AS INT) + {c} AS VARCHAR), 6, '0') || substr({x}, 7) || '{e}' END"
    can = lambda test, x: f"CASE WHEN {test} THEN {x} ELSE {none} END"
    # Before a row: inserts.  n nothing, s system, u user, a reply.
    user = f"least(u, {plus('n', 3, 'I')}, {plus('s', 3, 'I')}, {plus('a', 3, 'I')})"
    reply = f"least(a, {plus('u1', 3, 'I')})"
    open_ = "fault NOT IN ('b', 'd')"
    cut = "(CASE WHEN fault = 't' THEN 3 ELSE 0 END)"
    begin = "least(n, s, a1)"
    step = f"""
      {plus('n', 4, 'D')} AS n,
      least({plus('s', 4, 'D')}, {can(f"{open_} AND initial = 's'", plus('n', cut, 'K'))}) AS s,
      least({plus('u1', 4, 'D')}, {can(f"{open_} AND initial = 'u'", plus(begin, cut, 'K'))}, {can(open_, plus(begin, f'3 + {cut}', 'R'))}) AS u,
      least({plus('a1', 4, 'D')}, {can(f"{open_} AND initial = 'a'", plus('u1', cut, 'K'))}, {can(open_, plus('u1', f'3 + {cut}', 'R'))}) AS a"""
    # DuckDB has no crc32: the polynomial's table, then byte by byte.
    table = "list_transform(range(256), lambda x: list_reduce(list_concat([x], range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END))"
    key = "coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ')"
    crc = f"xor(list_reduce(list_concat([4294967295], list_transform(string_split({key}, ''), lambda ch: CAST(ascii(ch) AS BIGINT))), lambda c, b: xor(t[CAST(xor(c, b) & 255 AS INT) + 1], c >> 8)), 4294967295)"
    return f"""
WITH RECURSIVE tab AS (SELECT {table} AS t),
k0 AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {crc} % 20 AS kind FROM conversations CROSS JOIN tab),
dm AS (SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
         CASE WHEN kind = 1 THEN '' WHEN kind = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
         unnest(CASE WHEN kind = 3 THEN [1, 2] ELSE [1] END) AS copy FROM k0 WHERE kind <> 0),
ln AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS k,
         row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) > 1 AS seen,
         trim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS bare, left(role, 1) AS initial FROM dm),
rw AS (SELECT *, CASE WHEN bare = '' THEN 'b' WHEN seen THEN 'd' WHEN right(bare, 1) NOT IN ('.', '!', '?') THEN 't' ELSE '.' END AS fault,
         lag(initial) OVER (PARTITION BY conv_id ORDER BY k) || initial NOT IN ('su', 'ua', 'au') AS wrong FROM ln),
ends AS (SELECT conv_id, max(k) AS last FROM rw GROUP BY conv_id),
dp AS (
  SELECT conv_id, CAST(0 AS BIGINT) AS k, '000000' AS n, {none} AS s, {none} AS u, {none} AS a FROM ends
  UNION ALL
  SELECT conv_id, k, {step} FROM (
    SELECT *, {reply} AS a1 FROM (SELECT d.conv_id, r.k, r.initial, r.fault, n, s, a, {user} AS u1 FROM dp d JOIN rw r ON r.conv_id IS NOT DISTINCT FROM d.conv_id AND r.k = d.k + 1))),
fin AS (SELECT conv_id, least(n, a1) AS best FROM (SELECT *, {reply} AS a1 FROM (
    SELECT d.conv_id, n, a, {user} AS u1 FROM dp d JOIN ends e ON e.conv_id IS NOT DISTINCT FROM d.conv_id AND e.last = d.k))),
au AS (SELECT conv_id, substr(best, 7) AS audit, CAST(left(best, 6) AS BIGINT) AS cost, unnest(string_split(substr(best, 7), '')) AS edit, generate_subscripts(string_split(substr(best, 7), ''), 1) AS p FROM fin),
ed AS (SELECT *, count(*) FILTER (edit <> 'I') OVER w AS k, count(*) FILTER (edit <> 'D') OVER w AS out_k FROM au WINDOW w AS (PARTITION BY conv_id ORDER BY p)),
tx AS (SELECT e.*, r.role, r.text, bool_or(e.edit = 'K' AND r.initial = 's') OVER (PARTITION BY e.conv_id) AS sys FROM ed e LEFT JOIN rw r ON r.conv_id IS NOT DISTINCT FROM e.conv_id AND r.k = e.k AND e.edit <> 'I'),
rp AS (SELECT conv_id, any_value(audit) AS audit, any_value(cost) AS cost, sha256(coalesce(string_agg(
         CASE WHEN edit = 'K' THEN role WHEN (out_k - sys::INT) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || coalesce(text, ''), chr(10) ORDER BY p) FILTER (edit <> 'D'), '')) AS h
       FROM tx GROUP BY conv_id),
sm AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'b') AS blank, count(*) FILTER (fault = 'd') AS duplicate,
         count(*) FILTER (fault = 't') AS truncated, count(*) FILTER (wrong) AS illegal FROM rw GROUP BY conv_id)
SELECT c.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
       coalesce(illegal, 0) AS illegal, coalesce(cost, 0) AS cost, coalesce(audit, '') AS audit, coalesce(h, sha256('')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c
LEFT JOIN sm ON sm.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN rp ON rp.conv_id IS NOT DISTINCT FROM c.conv_id"""


OP11_SQL = _sql()
