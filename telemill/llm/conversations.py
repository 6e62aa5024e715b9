"""Cheapest repair of conversations, found once per suffix that conversations share.

A conversation is written as a signature, one letter per row for role and fault. Conversations (cut into blocks of rows when
long) are sorted by their reversed signatures, so that those with the same end stand next to each other: walking
them builds an automaton with shared suffixes, and every node of it gets, for each state of the role grammar, the cost of
the cheapest way to the end and its audit, once for all conversations that pass there.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from telemill.llm.ordering import numbered
from telemill.llm.tables import small, stored

BLOCK = 64  # rows of a conversation that are looked at together
WAYS_SENT = 20_000  # distinct signatures whose ways, one or two kilobytes each, are sent to all executors at most
HOME, BEFORE, BEHIND, ORIGINAL = range(4)  # what a row is to a block: its own, the one before it, the one behind it, a text's first place
FOLD = 16  # blocks whose costs are joined in one step
SPACE = " \t\n\x0b\x0c\r"

# states of the role grammar (s?(ua)+)?: nothing yet, after s, after u, after a; the role that comes next where one is made up
NEXT = {0: "u", 1: "u", 2: "a", 3: "u"}
AFTER = {"s": 1, "u": 2, "a": 3}
ROLES = {"u": "user", "a": "assistant"}
REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5  # costs

Best = tuple[int, str] | None  # cheapest cost to the end and its audit, if there is a way


def _plus(cost: int, letter: str, rest: Best) -> Best:
    return None if rest is None else (rest[0] + cost, letter + rest[1])


def _least(*ways: Best) -> Best:
    return min((w for w in ways if w is not None), default=None)


def _inserted(plain: list[Best]) -> list[Best]:
    """The same with rows inserted in front where that is cheaper or first in order."""
    user, assistant = _least(plain[2], _plus(INSERT, "I", plain[3])), _least(plain[3], _plus(INSERT, "I", plain[2]))
    return [_least(plain[0], _plus(INSERT, "I", user)), _least(plain[1], _plus(INSERT, "I", user)), user, assistant]


def _node(letter: str, rest: list[Best]) -> list[Best]:
    """Cheapest ways from a row on, per grammar state, given those from the row behind it."""
    ways = [_plus(DELETE, "D", r) for r in rest]
    if letter != "d":
        role, extra = letter.lower(), TRUNCATED if letter.isupper() else 0
        for state, made in NEXT.items():
            ways[state] = _least(ways[state], _plus(REROLE + extra, "R", rest[AFTER[made]]))
            if role == made or (role == "s" and state == 0):
                ways[state] = _least(ways[state], _plus(extra, "K", rest[AFTER[role]]))
    return _inserted(ways)


def _ending(mark: str) -> list[Best]:
    """Ways to the end of the conversation (``.``), or to the end of a block in a given state."""
    if mark == ".":
        return [(0, ""), (2 * INSERT, "II"), (INSERT, "I"), (0, "")]
    return [(0, "") if state == int(mark) else None for state in NEXT]


def _walked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Best ways of reversed signatures that come in order: only nodes behind the longest end shared with the one before are new."""
    before, nodes = "", []
    for batch in batches:
        items, out = batch.column(0).to_pylist(), []
        for item in items:
            shared = next((k for k, (a, b) in enumerate(zip(before, item, strict=False)) if a != b), min(len(before), len(item)))
            del nodes[shared:]
            for letter in item[shared:]:
                nodes.append(_node(letter, nodes[-1]) if nodes else _ending(letter))
            before = item
            out.append([None if w is None else {"cost": w[0], "audit": w[1], "exits": ""} for w in nodes[-1]])
        yield pa.RecordBatch.from_arrays([pa.array(items, pa.string()), pa.array(out, ARROW_WAYS)], ["item", "ways"])


WAYS = "array<struct<cost:bigint,audit:string,exits:string>>"  # per state at the start; null where there is no way
ARROW_WAYS = pa.list_(pa.struct([("cost", pa.int64()), ("audit", pa.string()), ("exits", pa.string())]))
AUTOMATON = f"item string, ways {WAYS}"


def key_of(conv: str) -> Column:
    """A conversation's id as text that is never null."""
    return F.coalesce(F.concat(F.lit("="), F.col(f"`{conv}`").cast("string")), F.lit(""))


def _rows(rows: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    said = rows.select(
        key_of(conv).alias("c"), F.col(f"`{turn}`").alias("turn"),
        F.coalesce(F.col(f"`{role}`"), F.lit(" ")).alias("role"), F.coalesce(F.col(f"`{text}`"), F.lit(" ")).alias("text"),
    )
    said = said.withColumn("same", F.unhex(F.sha2("text", 256)))
    placed = numbered(said, "c", ["turn", "role", "same"], "turns")
    return placed.withColumnRenamed("_pos", "pos").withColumn("block", F.expr(f"pos div {BLOCK}"))


def _signatures(rows: DataFrame) -> DataFrame:
    """One row per block: its signature, what is wrong in it, and whether it is the conversation's last."""
    body = F.rtrim("text", F.lit(SPACE))
    first = F.substring("role", 1, 1)
    slim = rows.select(
        "c", "block", "pos", "role", "same", "turn", F.when(first.isin("s", "u", "a"), first).otherwise("x").alias("initial"),
        (body == "").alias("blank"), (~F.substring(body, -1, 1).isin(".", "!", "?")).alias("cut"),
    )
    seen = slim.where("not blank").groupBy("c", "role", "same").agg(F.min("pos").alias("pos"))
    seen = seen.select("c", "pos", F.expr(f"pos div {BLOCK}").alias("block"), F.lit(ORIGINAL).alias("kind"))
    # a block's last row is also known to the next block, and its first row tells the block before that it is not the last
    inside = F.pmod("pos", F.lit(BLOCK))
    copies = F.array(*[F.struct((F.col("block") + step).alias("block"), F.lit(kind).alias("kind")) for step, kind in ((0, HOME), (1, BEFORE), (-1, BEHIND))])
    wanted = F.filter(
        copies, lambda x: (x["kind"] == HOME) | ((x["kind"] == BEFORE) & (inside == BLOCK - 1)) | ((x["kind"] == BEHIND) & (inside == 0) & (x["block"] >= 0))
    )
    dealt = slim.withColumn("x", F.explode(wanted)).drop("block", "role", "same").select("*", "x.*").drop("x")
    row = F.struct("pos", "turn", "initial", "blank", "cut")
    of = lambda kind, what: F.when(F.col("kind") == kind, what)
    blocks = dealt.unionByName(seen, allowMissingColumns=True).groupBy("c", "block").agg(
        F.array_sort(F.collect_list(of(HOME, row))).alias("rows"), F.collect_set(of(ORIGINAL, F.col("pos"))).alias("originals"),
        F.collect_list(of(BEFORE, row)).alias("before"), F.max(F.col("kind") == BEHIND).alias("more"),
    ).where(F.size("rows") > 0)
    again = lambda r: ~r["blank"] & ~F.array_contains("originals", r["pos"])
    blocks = blocks.withColumn("chain", F.concat("before", "rows")).withColumn("rows", F.transform("rows", lambda r: r.withField("again", again(r))))
    pairs = F.when(F.size("chain") > 1, F.sequence(F.lit(1), F.size("chain") - 1)).otherwise(F.array().cast("array<int>"))
    at = lambda k: F.element_at("chain", k)
    illegal = F.filter(pairs, lambda k: ~F.concat(at(k)["initial"], at(k + 1)["initial"]).isin("su", "ua", "au"))
    steps = F.filter(pairs, lambda k: ~at(k)["turn"].eqNullSafe(at(k + 1)["turn"]) & at(k + 1)["turn"].isNotNull())
    begins = F.when((F.size("before") == 0) & at(1)["turn"].isNotNull(), 1).otherwise(0)
    broken = lambda r: ~r["blank"] & ~r["again"] & r["cut"]
    letter = lambda r: F.when(r["blank"] | r["again"], "d").when(r["cut"], F.upper(r["initial"])).otherwise(r["initial"])
    count = lambda test: F.size(F.filter("rows", test)).cast("bigint")
    return blocks.select(
        "c", "block", "more", F.reverse(F.array_join(F.transform("rows", letter), "")).alias("signature"),
        count(lambda r: r["blank"]).alias("blank"), count(lambda r: r["again"]).alias("duplicate"), count(broken).alias("truncated"),
        F.size(illegal).cast("bigint").alias("illegal"), (F.size(steps) + begins).cast("bigint").alias("steps"),
        F.array_min(F.transform("rows", lambda r: r["turn"])).alias("low"), F.array_max(F.transform("rows", lambda r: r["turn"])).alias("high"),
    )


def _automaton(blocks: DataFrame) -> DataFrame:
    """``(signature, more, ends)``: for every distinct signature its ways, one list per state at its end (one list for a last block)."""
    marks = F.when(F.col("more"), F.array(*[F.lit(str(s)) for s in NEXT])).otherwise(F.array(F.lit(".")))
    items = blocks.select("signature", "more").distinct().select(F.explode(F.transform(marks, lambda m: F.concat(m, "signature"))).alias("item"))
    ways = items.repartitionByRange("item").sortWithinPartitions("item").mapInArrow(_walked, AUTOMATON)
    mark = F.substring("item", 1, 1)
    ends = F.transform(F.array_sort(F.collect_list(F.struct(mark.alias("mark"), "ways"))), lambda x: x["ways"])
    return ways.groupBy(F.expr("substring(item, 2)").alias("signature"), (mark != ".").alias("more")).agg(ends.alias("ends"))


def _joined(left: list[list[dict | None]], right: list[list[dict | None]]) -> list[list[dict | None]]:
    """Ways through one stretch and then another, per state at the end and at the start."""
    out = []
    for ends in right:
        ways = []
        for state in NEXT:
            found = [
                (a["cost"] + b["cost"], a["audit"] + b["audit"], a["exits"] + str(between) + b["exits"])
                for between in NEXT
                if (a := left[between][state]) is not None and (b := ends[between]) is not None
            ]
            ways.append(dict(zip(("cost", "audit", "exits"), min(found), strict=True)) if found else None)
        out.append(ways)
    return out


def _folded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for parts in batch.column("parts").to_pylist():
            ends = parts[-1]["ends"]
            for part in reversed(parts[:-1]):
                ends = _joined(part["ends"], ends)
            out.append(ends)
        yield pa.RecordBatch.from_arrays([batch.column("c"), batch.column("k"), pa.array(out, pa.list_(ARROW_WAYS))], ["c", "k", "ends"])


def _exits(blocks: DataFrame) -> DataFrame:
    """``(c, block, entry, exit)`` on the cheapest way through conversations of several blocks, joined sixteen stretches at a time."""
    parts, kind = blocks.select("c", F.col("block").alias("k"), "ends"), f"c string, k bigint, ends array<{WAYS}>"
    whole = None
    while True:
        listed = F.array_sort(F.collect_list(F.struct("k", "ends")))
        parts = stored(parts.groupBy("c", F.expr(f"k div {FOLD}").alias("k")).agg(listed.alias("parts")).mapInArrow(_folded, kind), "stretches")
        going = parts.where("k > 0").select("c").distinct()
        # a conversation is done when its last stretch is its first: only then it has one list of ways
        done = parts.where((F.col("k") == 0) & (F.size("ends") == 1)).select("c", F.col("ends")[0][0]["exits"].alias("exits"))
        whole = done if whole is None else whole.unionByName(done)
        if going.isEmpty():
            break
        parts = parts.join(going, "c", "left_semi")
    path = F.split("exits", "")
    steps = F.arrays_zip(F.concat(F.array(F.lit("0")), path).alias("entry"), F.concat(path, F.array(F.lit("0"))).alias("exit"))
    return whole.select("c", F.posexplode(steps).alias("block", "x")).select(
        "c", F.col("block").cast("bigint").alias("block"), F.col("x.entry").cast("int").alias("entry"), F.col("x.exit").cast("int").alias("exit")
    )


def _said(audit: str, state: int, rows: list[dict]) -> list[dict]:
    """What is left of a block's rows after its edits."""
    out, at = [], 0
    for edit in audit:
        row = {"role": "", "text": ""} if edit == "I" else rows[at]
        at += edit != "I"
        if edit != "D":
            made = NEXT[state] if edit != "K" else row["role"][0]
            out.append({"role": row["role"] if edit == "K" else ROLES[made], "text": row["text"]})
            state = AFTER[made]
    return out


def _edited(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind = pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())]))
    for batch in batches:
        for k in range(batch.num_rows):  # a block's texts may be long: one block at a time
            one = batch.slice(k, 1)
            found = _said(one.column("audit")[0].as_py(), one.column("entry")[0].as_py(), one.column("rows")[0].as_py())
            kept = [c for c in one.schema.names if c != "rows"]
            yield pa.RecordBatch.from_arrays([*[one.column(c) for c in kept], pa.array([found], kind)], [*kept, "turns"])


def repaired(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Repair every conversation at the least cost; one row per block of up to 64 of its rows.

    ``(c, conv, block, alone, turns, cost, audit, blank, duplicate, truncated, illegal, steps, low, high)``: ``turns`` lists the
    (role, text) that are left of the block, ``audit`` the edits that led there; ``steps`` counts the distinct turns that begin in the block,
    ``low`` and ``high`` bound them, and ``alone`` says that the conversation has no other block.

    Rows go by ``turn``, nulls first, equal turns by role and a hash of the text; null roles and texts count as one blank, a null id is a
    conversation of its own, and other columns, whatever their names, are not looked at. A row's fault is the first of blank, duplicate (role and text
    stood earlier in the conversation) and truncated (its last character other than white space is none of ``.!?``). Blank and
    duplicate rows are deleted (2); others are kept (0), given the role user or assistant (1) or deleted, truncated ones that stay
    cost 5 more; empty rows may be inserted (5). The initials of the roles that stay follow ``(s?(ua)+)?``; among equal costs
    the first audit in ASCII order is taken. Conversations of any length are cut into blocks; no rows give no conversation.
    """
    said = _rows(rows, conv, turn, role, text)
    blocks = stored(_signatures(said), "signatures")
    blocks = stored(blocks.join(small(_automaton(blocks), WAYS_SENT), ["signature", "more"]).drop("signature"), "ways")
    alone = blocks.where("block = 0 and not more").withColumn("entry", F.lit(0)).withColumn("exit", F.lit(0)).withColumn("alone", F.lit(True))
    several = blocks.where("block > 0 or more")
    edits = alone
    if not several.isEmpty():
        edits = alone.unionByName(several.join(_exits(several), ["c", "block"]).withColumn("alone", F.lit(False)))
    way = F.get(F.get("ends", F.col("exit")), F.col("entry"))
    edits = edits.withColumns({"cost": way["cost"], "audit": way["audit"]}).drop("ends", "exit", "more")
    texts = said.groupBy("c", "block").agg(F.array_sort(F.collect_list(F.struct("pos", "role", "text"))).alias("rows"))
    texts = texts.join(edits, ["c", "block"])
    turns = StructType.fromDDL("turns array<struct<role:string,text:string>>")
    kind = StructType([*[f for f in texts.schema.fields if f.name != "rows"], *turns.fields])
    named = F.when(F.col("c") != "", F.expr("substring(c, 2)")).cast(rows.select(F.col(f"`{conv}`")).schema[0].dataType)
    return texts.mapInArrow(_edited, kind).withColumn("conv", named)


FOUND = ["blank", "duplicate", "truncated", "illegal", "cost"]
NUMBERS = (*FOUND, "steps", "low", "high")
SUMMED = "c string, " + ", ".join(f"{n} bigint" for n in NUMBERS) + ", audit string, repaired_sha256 string"
ARROW_SUMMED = pa.schema([("c", pa.string()), *[(n, pa.int64()) for n in NUMBERS], ("audit", pa.string()), ("repaired_sha256", pa.string())])


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Conversations' totals, audits and hashes from blocks that come in order; a conversation's text is never held whole."""
    now, sums, audit, digest, any_yet = None, [], [], sha256(), False

    def closed() -> pa.RecordBatch:
        row = dict(zip(ARROW_SUMMED.names, (now, *sums, "".join(audit), digest.hexdigest()), strict=True))
        return pa.RecordBatch.from_pylist([row], schema=ARROW_SUMMED)

    for batch in batches:
        for k in range(batch.num_rows):  # texts may be long: one block at a time
            row = batch.slice(k, 1).to_pylist()[0]
            if row["c"] != now:
                if now is not None:
                    yield closed()
                now, sums, audit, digest, any_yet = row["c"], [0] * (len(FOUND) + 1) + [None, None], [], sha256(), False
            for n, name in enumerate((*FOUND, "steps")):
                sums[n] += row[name]
            for n, (name, of) in enumerate((("low", min), ("high", max)), len(FOUND) + 1):
                sums[n] = of([x for x in (sums[n], row[name]) if x is not None], default=None)
            audit.append(row["audit"])
            if row["many"]:
                digest.update((("\n" if any_yet else "") + row["said"]).encode())
                any_yet = True
    if now is not None:
        yield closed()


def digests(rows: DataFrame, conversations: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One row per id of ``conversations`` with what :func:`repaired` found in ``rows`` of it.

    ``gaps`` counts whole turns that are missing between the first and the last; ``repaired_sha256`` is of ``role:text`` lines
    joined by newlines. Ids without rows have zeros, an empty audit and the hash of the empty text.
    """
    line = F.transform("turns", lambda t: F.concat(t["role"], F.lit(":"), t["text"]))
    blocks = repaired(rows, conv, turn, role, text)
    blocks = blocks.select("c", "block", "alone", *FOUND, "steps", "low", "high", "audit", F.size("turns").alias("many"), F.array_join(line, "\n").alias("said"))
    blocks = stored(blocks, "repaired")
    single = blocks.where("alone").select("c", *FOUND, "steps", F.col("low").cast("bigint"), F.col("high").cast("bigint"), "audit", F.sha2("said", 256).alias("repaired_sha256"))
    several = blocks.where("not alone").withColumn("low", F.col("low").cast("bigint")).withColumn("high", F.col("high").cast("bigint"))
    several = several.repartition("c").sortWithinPartitions("c", "block").mapInArrow(_hashed, SUMMED)
    found = single.unionByName(several).withColumn("gaps", F.coalesce(F.col("high") - F.col("low") + 1 - F.col("steps"), F.lit(0)).cast("bigint"))
    every = conversations.select(F.col(f"`{conv}`").alias(conv), key_of(conv).alias("c")).distinct()
    zero = [F.coalesce(n, F.lit(0)).cast("bigint").alias(n) for n in ("gaps", *FOUND)]
    return every.join(found, "c", "left").select(
        conv, *zero, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256")
    )
