"""Table updates: hash gates, slot fill, revisions, upserts, and the sequential merge of order rows."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string

from ..functions import fields, rules
from ..functions.dates import norm_date
from ..functions.identity import CONTEXT, IDENTITY, ROW_FIELDS, base_key, chat_scope, complete_identity, has_payload, norm_phone, row_context_key, row_hash
from ..functions.text import any_filled, chat_hash, filled, norm_text
from .distinct import sorted_stream


def new_chats(incoming: DataFrame, existing: DataFrame, text: str = "chat_text", seq: str = "seq") -> DataFrame:
    """The gate of chats: those whose hash is not stored yet, the first of each hash."""
    hashed = incoming.withColumn("chat_hash", chat_hash(F.col(text)))
    first = hashed.groupBy("chat_hash").agg(F.min_by(F.struct(*[c for c in hashed.columns if c != "chat_hash"]), seq).alias("x")).select("chat_hash", "x.*")
    return first.join(existing.select("chat_hash"), "chat_hash", "left_anti")


def number_repeats(rows: DataFrame, seq: str, scope: Column) -> DataFrame:
    """Adds base_key, occurrence (from 1) and row_hash, so that a row that is said twice is stored twice and stays the same on replay."""
    keyed = rows.withColumn("base_key", base_key())
    keyed = keyed.withColumn("occurrence", F.row_number().over(Window.partitionBy(scope, "base_key").orderBy(seq)))
    return keyed.withColumn("row_hash", row_hash(F.col("base_key"), F.col("occurrence"), chat_scope(scope)))


def insert_absent(table: DataFrame, rows: DataFrame, key: str = "row_hash") -> DataFrame:
    """table and the rows whose key it lacks."""
    return table.unionByName(rows.dropDuplicates([key]).join(table.select(key), key, "left_anti"), allowMissingColumns=True)


def upsert(table: DataFrame, rows: DataFrame, key: list[str]) -> DataFrame:
    """Rows replace the table's rows of their keys."""
    return table.join(rows.select(*key).distinct(), key, "left_anti").unionByName(rows, allowMissingColumns=True)


def replace_scope(table: DataFrame, rows: DataFrame, scope: str) -> DataFrame:
    """All of the table's rows of the scopes that rows have give way to rows."""
    return upsert(table, rows, [scope])


def union_first_wins(first: DataFrame, second: DataFrame, key: str) -> DataFrame:
    """Both, and of each key the first table's row."""
    return first.unionByName(second.join(first.select(key), key, "left_anti"))


def fill_slots(table: DataFrame, incoming: DataFrame, key: str, seq: str = "seq") -> DataFrame:
    """The complete incoming units of a key that are new to it go into its open rows, one after the other (distinct.fill_outcomes has the
    rules); a row's own values stay. Returns the table with what was filled, and `filled_from`, the incoming row's seq."""
    from .distinct import FILLED, fill_outcomes

    given = fill_outcomes(table, incoming, key, seq).where(F.col("outcome") == FILLED)
    given = given.select(F.col(key).alias("_in_key"), F.col("slot").alias("_in_slot"), "filled_from", *(F.col(c).alias(f"_in_{c}") for c in ROW_FIELDS))
    done = table.join(given, (F.col(key) == F.col("_in_key")) & (F.col(seq).cast("long") == F.col("_in_slot")), "left")
    done = done.withColumns({c: rules.fill_or_overwrite(F.col(c), F.coalesce(f"_in_{c}", F.lit("")), F.lit(False)) for c in ROW_FIELDS})
    done = done.withColumn("status_unit", F.when(F.col("filled_from").isNotNull(), rules.status(*map(F.col, ROW_FIELDS))).otherwise(F.col("status_unit")))
    return done.select(*table.columns, "filled_from")


def exact_duplicates(incoming: DataFrame, existing: DataFrame) -> DataFrame:
    """Incoming rows that no stored row equals in all eight fields, compared by letters and digits, phones by their country code too."""
    keys = [f"_k{i}" for i in range(len(ROW_FIELDS))]
    with_keys = lambda df: df.withColumns({k: (norm_phone if c == "kontak_driver" else norm_text)(F.col(c)) for k, c in zip(keys, ROW_FIELDS)})
    return with_keys(incoming).join(with_keys(existing).select(*keys).distinct(), keys, "left_anti").drop(*keys)


#: What the merge kernel returns: the table's rows and those that were inserted, with what became of them (kept, updated, inserted).
MERGED = "scope string, origin string, seq long, " + ", ".join(f"{c} string" for c in ROW_FIELDS) + ", status_unit string, outcome string, row_hash string"
#: Rows of finished scopes that go out together, at least.
MERGED_BATCH = 4096
#: Context scores: from which a stored row can be what an incoming row repeats (with a date only, if it is no more), takes it in, is
#: found by its position, and gives way to a revision.
REPEATS, FITS, IN_PLACE, GIVES_WAY = 2, 3, 5, 7
#: What a context field adds where both rows say the same, and what it costs where they differ.
WEIGHTS = {"tgl_muat": (3, 3), "tgl_ro": (2, 2), "pickup": (2, 3), "tujuan": (2, 3), "type_truck": (1, 2)}


def chat_hints(text: Column) -> dict[str, Column]:
    """What a chat's text says of how its rows are to be merged: whether it is a revision, which of its loading segments are marked as
    one, the segments' identities, the quantity declared, and the old plate and phone that it names."""
    from ..plans.parse import marked_segments, segment_identities

    old = fields.old_anchors(text)
    return {
        "revision": F.coalesce(text.rlike(fields.REVISION), F.lit(False)), "marked": marked_segments(text), "segments": segment_identities(text), "declared": fields.declared_units(text),
        "old_plate": F.coalesce(old["no_plat"], F.lit("")), "old_phone": F.coalesce(old["kontak_driver"], F.lit("")),
    }


class Unit:
    """A row in the merge: its values, by field whether it is blank and the form in which it is compared, and the days of the two dates."""

    __slots__ = ("seq", "raw", "norm", "blank", "days", "said", "status", "touched", "changed", "base")

    def __init__(self, row: dict):
        self.seq, self.said, self.status = row["seq"], row["said_status"], row["status_unit"]
        self.raw = {c: row[c] for c in ROW_FIELDS}
        self.norm, self.blank, self.days, self.base = dict(zip(ROW_FIELDS, row["norm"])), dict(zip(ROW_FIELDS, row["blank"])), dict(zip(("tgl_ro", "tgl_muat"), row["days"])), row["base_key"]
        self.touched = self.changed = False

    def has(self, fields_) -> bool:
        return not all(self.blank[c] for c in fields_)

    def lacks(self) -> int:
        return sum(self.blank[c] for c in IDENTITY)

    def state(self) -> str:
        if self.said:
            return self.said
        n = len(ROW_FIELDS) - sum(self.blank.values())
        return "ASSIGNED" if n == len(ROW_FIELDS) else "PARTIAL" if n >= 3 else "UNASSIGNED"

    def open(self) -> bool:
        return self.state() != "ASSIGNED"

    def likeness(self, other: Unit) -> int:
        """The context score of two rows; fields that either leaves blank count nothing."""
        total = 0
        for c, (gain, loss) in WEIGHTS.items():
            if not self.blank[c] and not other.blank[c]:
                mine, theirs = (u.days[c] if c in u.days else u.norm[c] for u in (self, other))
                total += gain if mine == theirs else -loss
        return total

    def differs(self, other: Unit) -> bool:
        """Both say something in an identity field, and not the same."""
        return any(self.norm[c] and other.norm[c] and self.norm[c] != other.norm[c] for c in IDENTITY)

    def take(self, other: Unit, overwrite: bool) -> bool:
        """Blanks take the other's values; with overwrite, all that differ do. A row that changed is done with for this save."""
        given = [c for c in ROW_FIELDS if not other.blank[c] and (self.blank[c] or (overwrite and self.norm[c] != other.norm[c]))]
        for c in given:
            self.raw[c], self.norm[c], self.blank[c] = other.raw[c].strip(), other.norm[c], False
            if c in self.days:
                self.days[c] = other.days[c]
        if given:
            self.touched = self.changed = True
            self.said = ""
            self.status = self.said = self.state()
        return bool(given)


def _revise(stored: list[Unit], x: Unit, hints: dict, segment: int | None) -> bool | None:
    """A revision's own ways to its row: the old plate or phone that it names, then its segment's place among the rows of its context.
    None: neither leads anywhere."""
    named = [u for u in stored if not u.touched and ((hints["old_plate"] and u.norm["no_plat"] == hints["old_plate"]) or (hints["old_phone"] and u.norm["kontak_driver"] == hints["old_phone"]))]
    if x.has(WEIGHTS):
        named = [u for u in named if u.likeness(x) >= FITS]
    if len(named) == 1:
        return named[0].take(x, True)
    if segment is not None:
        there = [u for u in stored if u.likeness(x) >= IN_PLACE]
        if hints["declared"]:
            there = there[-hints["declared"] :]
        if 0 <= segment < len(there):
            return there[segment].take(x, True)
    return None


def place_unit(stored: list[Unit], x: Unit, hints: dict, segment: int | None = None) -> bool:
    """Merges an incoming row with an identity into one stored row, if one is fit: the row that it repeats; else, of the fit rows, that
    with its plate, then (revisions only) its driver and phone, then one that lacks what it brings or gives way; of equals the likest, then
    the emptiest, then the first. False: it is none of theirs."""
    revision = hints["revision"]
    if not x.has(IDENTITY):
        return False
    if revision and (done := _revise(stored, x, hints, segment)) is not None:
        return done
    scores = [u.likeness(x) for u in stored]
    dated = x.has(("tgl_ro", "tgl_muat"))
    said = [c for c in IDENTITY if x.norm[c]]
    for u, s in zip(stored, scores):
        if s >= REPEATS + (not dated) and said and all(u.norm[c] == x.norm[c] for c in said):
            u.touched = True
            return True
    gives_way = [u for u, s in zip(stored, scores) if revision and not u.touched and s >= GIVES_WAY and u.state() == "ASSIGNED" and u.differs(x)]
    best = None
    for u, s in zip(stored, scores):
        if u.touched or s < FITS:
            continue
        if x.norm["no_plat"] and u.norm["no_plat"] == x.norm["no_plat"]:
            rank = 3 if revision or u.open() else 0
        elif revision and x.norm["driver"] and x.norm["kontak_driver"] and all(u.norm[c] == x.norm[c] for c in ("driver", "kontak_driver")):
            rank = 2
        elif gives_way == [u]:
            rank = 1
        else:
            rank = int(u.open() and (any(x.norm[c] and u.blank[c] for c in IDENTITY) or (revision and u.differs(x))))
        if rank and (best is None or (rank, 10 * s + u.lacks()) > best[0]):
            best = ((rank, 10 * s + u.lacks()), u)
    return best is not None and best[1].take(x, revision)


def hold_placeholder(stored: list[Unit], x: Unit) -> bool:
    """An incoming row without identity stands for an open slot of its context that lacks something, if there is one."""
    fit = [(10 * u.likeness(x) + u.lacks(), -k, u) for k, u in enumerate(stored) if not u.touched and u.open() and u.lacks() and u.likeness(x) >= FITS]
    if x.has(IDENTITY) or not fit:
        return False
    max(fit, key=lambda f: f[:2])[2].touched = True
    return True


def _segment(x: Unit, hints: dict) -> int | None:
    """The one segment that shares the most of a row's identity."""
    shared = [sum(bool(x.norm[c]) and x.norm[c] == s[c] for c in IDENTITY) for s in hints["segments"] or ()]
    top = max(shared, default=0)
    return shared.index(top) if top and shared.count(top) == 1 else None


def merge_scope(stored: list[Unit], incoming: list[tuple[int, Unit]], hints: dict, hashes: set[str], chat_scope: str) -> list[tuple[Unit, str]]:
    """The rows that are to be inserted, with their hashes, after each incoming row (numbered from 0 within its chat), one after the other,
    has gone into the stored rows."""
    from hashlib import sha256

    out, times, revised = [], {}, set()
    for number, x in incoming:
        if not x.has(ROW_FIELDS):
            continue
        if hints["revision"] and hints["marked"]:
            segment = number if (s := _segment(x, hints)) is None else s
            if segment in hints["marked"] and segment not in revised and place_unit(stored, x, hints, segment):
                revised.add(segment)
            continue
        if place_unit(stored, x, hints) or hold_placeholder(stored, x):
            continue
        if x.has(IDENTITY) and any(u.norm == x.norm for u in stored):
            continue
        times[x.base] = times.get(x.base, 0) + 1
        h = sha256(f"{chat_scope}|{x.base}|occ:{times[x.base]}".encode()).hexdigest()
        if h not in hashes:
            hashes.add(h)
            x.status = x.status or x.state()
            out.append((x, h))
    return out


def _compared(rows: DataFrame, origin: str) -> DataFrame:
    """The kernel's columns: values, and the forms that they are compared in."""
    form = {c: norm_phone if c == "kontak_driver" else norm_text for c in ROW_FIELDS}
    norm, blanks = F.array(*(form[c](F.col(c)) for c in ROW_FIELDS)), F.array(*(~filled(F.col(c)) for c in ROW_FIELDS))
    days = F.array(*(F.when(filled(F.col(c)), norm_date(F.col(c))) for c in ("tgl_ro", "tgl_muat")))
    said = F.coalesce("status_unit", F.lit(""))
    return rows.select(
        "scope", F.lit(origin).alias("origin"), F.col("seq").cast("long").alias("seq"), *(F.coalesce(c, F.lit("")).alias(c) for c in ROW_FIELDS), said.alias("status_unit"), rules.known_status(said).alias("said_status"),
        norm.alias("norm"), blanks.alias("blank"), days.alias("days"), base_key().alias("base_key"), (F.col("row_hash") if "row_hash" in rows.columns else F.lit(None).cast("string")).alias("row_hash"),
    )


def smart_merge(table: DataFrame, incoming: DataFrame, chats: DataFrame | None = None) -> DataFrame:
    """Saves incoming rows into the stored rows of their scope, one after the other; later rows see what earlier ones changed.

    table, incoming: scope string (rows of different scopes never meet: a session, a customer), seq long (the order), ROW_FIELDS,
    status_unit and, in the table, row_hash if it has one. chats: scope, chat_text, the chat that a scope's incoming rows come from;
    without it they revise nothing. A stored row changes at most once a call. Rows without payload are left out. An inserted row gets
    its hash from the occurrence's number among the incoming rows, so that a replay inserts nothing twice.

    Which row takes an incoming one depends on all before it, so a kernel runs a scope at a time over a stream of sorted rows: it holds one
    scope's rows. See save_chat() for one chat against a table of any size.
    """
    rows = _compared(table, "stored").unionByName(_compared(incoming, "incoming"))
    hints = chat_hints(F.col("chat_text"))
    plain = {"revision": False, "marked": None, "segments": None, "declared": 0, "old_plate": "", "old_phone": ""}
    if chats is not None:
        told = chats.groupBy("scope").agg(F.min("chat_text").alias("chat_text")).select("scope", F.struct(*(c.alias(n) for n, c in hints.items())).alias("hints"))
        rows = rows.join(told, "scope", "left")
    ordered = sorted_stream(rows.withColumn("late", F.col("origin") == "incoming"), ["scope"], ["late", "seq"])

    schema = to_arrow_schema(_parse_datatype_string(MERGED))
    lists = {"norm": len(ROW_FIELDS), "blank": len(ROW_FIELDS), "days": 2}

    def values(batch: pa.RecordBatch) -> dict[str, list]:
        """The columns as Python values; lists of one length are cut from the array of all their values."""
        out = {n: batch.column(i).to_pylist() for i, n in enumerate(batch.schema.names) if n not in lists and n != "hints"}
        for n, k in lists.items():
            flat = batch.column(n).flatten().to_pylist()
            out[n] = [flat[i : i + k] for i in range(0, len(flat), k)]
        return out

    def made(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    def run(batches):
        key, stored, new, hashes, stored_hashes, told, begun = None, [], [], set(), [], plain, False
        done: list[tuple] = []  # rows of finished scopes: a batch a scope would be many small ones

        def finish():
            added = merge_scope(stored, list(enumerate(new)), told, hashes, key or "global")
            told_of = lambda u, origin, outcome, h: (key, origin, u.seq, *(u.raw[c] for c in ROW_FIELDS), u.status, outcome, h)
            done.extend(told_of(u, "stored", "updated" if u.changed else "kept", h) for u, h in zip(stored, stored_hashes))
            done.extend(told_of(u, "incoming", "inserted", h) for u, h in added)

        for batch in batches:
            columns = values(batch)
            hinted = batch.column("hints") if "hints" in batch.schema.names else None
            for i, cells in enumerate(zip(*columns.values())):
                row = dict(zip(columns, cells))
                if not begun or row["scope"] != key:
                    if begun:
                        finish()
                        if len(done) >= MERGED_BATCH:
                            yield made(done)
                            done.clear()
                    begun, key, stored, new, hashes, stored_hashes = True, row["scope"], [], [], set(), []
                    told = (hinted[i].as_py() if hinted is not None else None) or plain
                if row["origin"] == "stored":
                    stored.append(Unit(row)), stored_hashes.append(row["row_hash"]), hashes.add(row["row_hash"])
                else:
                    new.append(Unit(row))
        if begun:
            finish()
        if done:
            yield made(done)

    return ordered.mapInArrow(run, MERGED)


def save_chat(table: DataFrame, incoming: DataFrame, raw_chat_id: str, chat_text: str, most: int = 10_000) -> DataFrame:
    """The save of one chat's rows (some hundreds; more than `most` is an error) into a table of any size: smart_merge() over those stored
    rows that can have to do with the chat, the others as they are. No scope column is needed.

    A stored row can if it agrees with an incoming one in a context field other than the type (no score reaches 2 without), also once
    other incoming rows have filled its blanks; if it holds the plate or phone that a revision names; if neither it nor an
    incoming row of its plate has a context; or if its hash can meet an incoming row's, that is, if it comes from the chat.
    """
    new = incoming.withColumn("scope", F.lit(raw_chat_id))
    form = {"tgl_muat": norm_date, "tgl_ro": norm_date, "pickup": norm_text, "tujuan": norm_text}
    bare = any_filled(*(F.col(c) for c in form))
    said = new.select(*(F.collect_set(F.when(filled(F.col(c)), f(F.col(c)))).alias(c) for c, f in form.items()), F.count("*").alias("n"), F.collect_set(F.when(~bare, norm_text(F.col("no_plat")))).alias("bare")).first()
    if said["n"] > most:
        raise ValueError(f"a chat of {said['n']} rows; at most {most}")
    spark = table.sparkSession
    chat = spark.createDataFrame([(raw_chat_id, chat_text)], "scope string, chat_text string")
    old = chat.select(fields.old_anchors(F.col("chat_text")).alias("x")).select("x.*").first()
    near = F.lit(False)
    for c, f in form.items():
        if said[c]:
            near = near | (filled(F.col(c)) & f(F.col(c)).isin(*said[c]))
    for c, f in (("no_plat", norm_text), ("kontak_driver", norm_phone)):
        if old[c]:
            near = near | (f(F.col(c)) == old[c])
    if said["bare"]:  # rows without context may be exact duplicates of such rows
        near = near | (~bare & norm_text(F.col("no_plat")).isin(*said["bare"]))
    if "raw_chat_id" in table.columns:
        near = near | (F.col("raw_chat_id") == raw_chat_id)
    marked = table.withColumn("_near", F.coalesce(near, F.lit(False))).withColumn("scope", F.lit(raw_chat_id))
    merged = smart_merge(marked.where("_near"), new, chat)
    rest = marked.where("not _near")
    hashes = F.col("row_hash") if "row_hash" in table.columns else F.lit(None).cast("string")
    rest = rest.select("scope", F.lit("stored").alias("origin"), F.col("seq").cast("long").alias("seq"), *(F.coalesce(c, F.lit("")).alias(c) for c in ROW_FIELDS), F.coalesce("status_unit", F.lit("")).alias("status_unit"), F.lit("kept").alias("outcome"), hashes.alias("row_hash"))
    return merged.unionByName(rest)


def last_revision(revisions: DataFrame, key: str, seq: str, columns: tuple[str, ...]) -> DataFrame:
    """Of each key and column, the last filled value."""
    return revisions.groupBy(key).agg(*(F.max_by(c, F.when(filled(F.col(c)), F.col(seq))).alias(c) for c in columns))


def update_where_given(table: DataFrame, updates: DataFrame, key: str, numbers: tuple[str, ...], texts: tuple[str, ...]) -> DataFrame:
    """Columns take updates that say something: positive numbers, filled texts."""
    new = updates.select(key, *(F.col(c).alias(f"_{c}") for c in (*numbers, *texts)))
    joined = table.join(new, key, "left")
    return joined.select(*(F.when(F.col(f"_{c}") > 0, F.col(f"_{c}")).otherwise(F.col(c)).alias(c) if c in numbers else F.when(filled(F.col(f"_{c}")), F.col(f"_{c}")).otherwise(F.col(c)).alias(c) if c in texts else F.col(c) for c in table.columns))


def context_of(rows: DataFrame) -> DataFrame:
    """Normalised phones beside the context key, for reports."""
    return rows.withColumns({"context_key": row_context_key(), "phone": norm_phone(F.col("kontak_driver"))}).select("context_key", "phone", *CONTEXT)
