"""The store: tables as logs of row versions, committed batch by batch, by any number of writers.

A commit writes the changed rows of every table under ``<table>/attempt=<name>`` and then one record,
which all tables of the batch appear with. Records are numbered, and each is created only if its number
is free. A writer that finds its number taken reads what came in between: if that changed none of the
rows it wrote, and no table it named as read, it takes the next number; else it merges again on top.
A batch is told by its writer and its number. Running it again replaces what it wrote at its place,
or does nothing once that has been folded.

Every file has an entry in its record: how many rows, the least and greatest hash of their keys, and a
Bloom filter of one hash, in the record itself or beside the data if the file is big. Lookups open only
the files that may hold a wanted key. Batches gather on level 0; ``settle`` folds them into level 1 and,
where a level has outgrown its size, one slice of its key hashes into the slices below it on the next
one. So the number of files that a lookup considers, and what one commit rewrites, follow the logarithm
of the history and not its length.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from opslake import schemas, session
from opslake.commits import SNAPSHOT, Log

#: Batches on level 0 that are folded together; rows of a file on a level; how much bigger a level is than the one above.
FOLD_AFTER, FILE_ROWS, FAN = 8, 1 << 20, 3
#: Bits of the Bloom filter per key, and rows up to which it is kept in the record.
BITS_PER_KEY, INLINE_ROWS = 16, 1 << 14
#: Tables of a commit that are written at the same time.
WRITERS = 4
_INDEX = "file string, slice_bits int, slice int, bits int, word int, mask bigint"


@dataclass(frozen=True)
class Commit:
    batch: int
    attempt: str
    tables: frozenset
    writer: str = ""
    place: int = 0
    base: bool = False


@dataclass
class State:
    """The sum of the records up to ``version``."""

    version: int = 0
    commits: dict[str, Commit] = field(default_factory=dict)
    files: dict[str, list[dict]] = field(default_factory=dict)
    folded: dict[str, int] = field(default_factory=dict)
    gone: list[dict] = field(default_factory=list)

    def add(self, record: dict) -> None:
        self.version = record["version"]
        if "expired" in record:
            self.gone = [f for f in self.gone if f["since"] > record["expired"]]
            return
        dropped, replaced = set(record["drop"]), set(record["replaces"])
        for table, files in self.files.items():
            old = [f for f in files if f["path"] in dropped or f["attempt"] in replaced]
            if old:
                self.gone += [{"path": f["path"], "table": table, "since": self.version} for f in old]
                self.files[table] = [f for f in files if f["path"] not in dropped and f["attempt"] not in replaced]
        for writer, batch in record["folds"]:
            self.folded[writer] = max(batch, self.folded.get(writer, batch))
        for table, files in record["add"].items():
            self.files.setdefault(table, []).extend(files)
        self.commits[record["attempt"]] = Commit(record["batch"], record["attempt"], frozenset(record["tables"]), record["writer"], record["place"], record["base"])
        # A commit is listed until it has been replaced or others hold its rows.
        held = {f["attempt"] for files in self.files.values() for f in files}
        over = replaced | set(record["emptied"])
        self.commits = {a: c for a, c in self.commits.items() if a not in over and (a in held or not c.base)}

    def to_json(self) -> dict:
        commits = [{**vars(c), "tables": sorted(c.tables)} for c in self.commits.values()]
        return {"version": self.version, "commits": commits, "files": self.files, "folded": self.folded, "gone": self.gone}

    @staticmethod
    def of_json(held: dict) -> State:
        commits = {c["attempt"]: Commit(**{**c, "tables": frozenset(c["tables"])}) for c in held["commits"]}
        files = {table: list(files) for table, files in held["files"].items()}
        return State(held["version"], commits, files, dict(held["folded"]), list(held["gone"]))

    def before(self, place: int) -> State:
        """Without the batches at a place or later, but for those that have been folded."""
        late = {a for a, c in self.commits.items() if c.place >= place and not c.base}
        commits = {a: c for a, c in self.commits.items() if a not in late}
        return State(self.version, commits, {t: [f for f in files if f["attempt"] not in late] for t, files in self.files.items()}, self.folded, self.gone)

    def listed(self) -> list[Commit]:
        return sorted(self.commits.values(), key=lambda c: (c.place, c.attempt))

    def of(self, writer: str, batch: int) -> Commit | None:
        return next((c for c in self.commits.values() if not c.base and (c.writer, c.batch) == (writer, batch)), None)


class Store:
    def __init__(self, spark: SparkSession, root: str, state: State | None = None, file_rows: int = FILE_ROWS):
        self.spark = spark
        self.root = root.rstrip("/")
        self.file_rows = file_rows
        self._fixed = state
        self._commits = Log(spark, f"{self.root}/_commits")

    # What is there

    def _state(self) -> State:
        if self._fixed is not None:
            return self._fixed
        records, sums = self._commits.names()
        state = State.of_json(self._commits.record(sums[-1], ".sum")) if sums else State()
        for number in records:
            if number > state.version:
                state.add(self._commits.record(number))
        return state

    def snapshot(self) -> Store:
        """The store as it is now, whatever is committed later."""
        return self._view(self._state())

    def before(self, batch: int, writer: str = "") -> Store:
        """The store as it was before a batch: what the batch merges into, also when it runs again."""
        state = self._state()
        own = state.of(writer, batch)
        return self._view(state.before(own.place) if own else state)

    def _view(self, state: State) -> Store:
        view = Store(self.spark, self.root, state, self.file_rows)
        view._commits = self._commits
        return view

    def committed(self) -> list[Commit]:
        """The commits that hold rows, in the order of their places; a folded one counts as the last batch it holds."""
        return self._state().listed()

    def last_batch(self, writer: str = "") -> int:
        state = self._state()
        return max((c.batch for c in state.commits.values() if c.writer == writer and not c.base), default=state.folded.get(writer, 0))

    def _read(self, table: str, files: list[dict], state: State) -> DataFrame:
        """Rows of the files with ``batch`` and ``place``, by which versions are in order."""
        _, schema = schemas.TABLES[table]
        if not files:
            return self.spark.createDataFrame([], f"{schema}, batch bigint, place bigint")
        rows = (
            self.spark.read.schema(f"{schema}, held_batch bigint, held_place bigint, attempt string, slice int")
            .option("basePath", f"{self.root}/{table}").parquet(*[f"{self.root}/{f['path']}" for f in files])
        )
        # a row for each commit that has not been folded
        named = [(c.attempt, c.batch, c.place) for a in sorted({f["attempt"] for f in files}) if not (c := state.commits[a]).base]
        where = self.spark.createDataFrame(named, "attempt string, of_batch bigint, of_place bigint")
        rows = rows.join(F.broadcast(where), "attempt", "left")
        values = [c for c in rows.columns if c not in ("attempt", "slice", "held_batch", "held_place", "of_batch", "of_place")]
        return rows.select(
            *values, F.coalesce("held_batch", "of_batch").alias("batch"), F.coalesce("held_place", "of_place").alias("place")
        )

    def log(self, table: str) -> DataFrame:
        """All row versions of a table that have not been folded, and the last ones of the others, with their ``batch``."""
        state = self._state()
        return self._read(table, state.files.get(table, []), state).drop("place")

    @staticmethod
    def _last(table: str, log: DataFrame, keep: bool = False) -> DataFrame:
        keys, _ = schemas.TABLES[table]
        values = [c for c in log.columns if c not in keys]
        # versions meet before they are sorted: what a task sorts is then bounded by the exchange and not by its files
        last = log.repartition(*keys).groupBy(*keys).agg(F.max_by(F.struct(*values), F.col("place")).alias("v")).select(*keys, "v.*")
        return last.select(*log.columns) if keep else last.select(*[c for c in log.columns if c not in ("batch", "place")])

    def current(self, table: str) -> DataFrame:
        """The last version of each row."""
        state = self._state()
        return self._last(table, self._read(table, state.files.get(table, []), state))

    # Lookups

    def _hashed(self, table: str, rows: DataFrame) -> DataFrame:
        """Distinct keys with the hash that slices go by and the one of the Bloom filters."""
        keys, schema = schemas.lookup_keys(table), schemas.TABLES[table][1]
        types = {f.name: f.dataType for f in self.spark.createDataFrame([], schema).schema}
        keyed = rows.select(*[F.col(k).cast(types[k]).alias(k) for k in keys]).distinct()
        return keyed.withColumns({"h": F.xxhash64(*keys), "g": F.xxhash64(F.lit("bloom"), *keys)})

    def files_for(self, table: str, rows: DataFrame) -> list[dict]:
        """The entries of the files that may hold a key of ``rows``."""
        files = self._state().files.get(table, [])
        return self._holding(table, files, session.cut(self._hashed(table, rows))) if files else []

    def _holding(self, table: str, files: list[dict], wanted: DataFrame) -> list[dict]:
        """Those of ``files`` that may hold one of the hashed keys."""
        reach = wanted.agg(F.min("h").alias("low"), F.max("h").alias("high")).first()
        if reach.low is None:
            return []
        files = [f for f in files if f["low"] <= reach.high and f["high"] >= reach.low]
        kinds = sorted({(f["slice_bits"], f["bits"]) for f in files})
        if not kinds:
            return []
        asked = wanted.select("h", "g", F.explode(F.array(*[F.struct(F.lit(s).alias("slice_bits"), F.lit(b).alias("bits")) for s, b in kinds])).alias("k"))
        asked = asked.select("h", "g", "k.*").select(
            "slice_bits", "bits", _slice(F.col("h"), F.col("slice_bits")).alias("slice"), *_bit(F.col("g"), F.col("bits"))
        ).distinct()
        found = self._index(table, files).join(asked, ["slice_bits", "slice", "bits", "word"]).filter(F.col("mask").bitwiseAND(F.col("bit")) != 0)
        names = {r.file for r in found.select("file").distinct().collect()}
        return [f for f in files if f["path"] in names]

    def _index(self, table: str, files: list[dict]) -> DataFrame:
        inline = [(f["path"], f["slice_bits"], f["slice"], f["bits"], w, m) for f in files if f["words"] is not None for w, m in f["words"]]
        index = self.spark.createDataFrame(inline, _INDEX)
        beside = sorted({f["attempt"] for f in files if f["words"] is None})
        if beside:
            paths = [f"{self.root}/{table}-index/attempt={a}" for a in beside]
            index = index.unionByName(self.spark.read.schema(_INDEX).parquet(*paths))
        return index

    def touched(self, table: str, rows: DataFrame) -> DataFrame:
        """The last versions of the rows whose keys, or lookup keys, occur in ``rows``: what a merge has to read."""
        keys = schemas.lookup_keys(table)
        view = self if self._fixed is not None else self.snapshot()
        files = view._fixed.files.get(table, [])
        if not files:
            return self._last(table, view._read(table, [], view._fixed))
        wanted = session.cut(view._hashed(table, rows))  # ``rows`` may be costly, and are asked for twice
        log = view._read(table, view._holding(table, files, wanted), view._fixed)
        return self._last(table, log.join(wanted.select(*keys), keys, "left_semi"))

    # Commits

    def commit(self, batch: int, tables: dict[str, DataFrame], writer: str = "") -> bool:
        """Commit rows that do not depend on what is stored."""
        return self.transact(writer, batch, lambda past: tables, blind=True)

    def transact(
        self, writer: str, batch: int, build: Callable[[Store], dict[str, DataFrame]], reads: tuple[str, ...] = (),
        blind: bool = False,
    ) -> bool:
        """Commit what ``build(past)`` makes of the store before the batch.

        ``build`` runs again if another writer changed a row that it wrote, or a table of ``reads``, in the
        meantime; not if ``blind``. Returns False, and changes nothing, if the batch has been folded.
        """
        if self._fixed is not None:
            raise ValueError("a snapshot can't be written to")
        while True:
            state = self._state()
            own = state.of(writer, batch)
            if own is None and batch <= state.folded.get(writer, batch - 1):
                return False
            tables = build(self._view(state.before(own.place) if own else state))
            attempt = f"{time.time_ns():020d}-{uuid.uuid4().hex[:8]}"
            with ThreadPoolExecutor(WRITERS) as pool:  # tables are small and many: write some at once
                written = list(pool.map(lambda name: (name, self._write(name, tables[name], attempt)), tables))
            added = {name: files for name, files in written if files}
            while True:
                record = {
                    "version": state.version + 1, "writer": writer, "batch": batch, "attempt": attempt, "base": False,
                    "place": own.place if own else state.version + 1, "tables": sorted(tables), "add": added, "drop": [],
                    "replaces": [own.attempt] if own else [], "folds": [], "emptied": [],
                }
                if self._append(state, record):
                    return True
                newer = self._state()
                again = newer.of(writer, batch)
                changed = (again and again.attempt) != (own and own.attempt) or batch <= newer.folded.get(writer, batch - 1)
                if changed or not blind and self._clash(state, newer, added, reads):
                    break  # what was written stays unnamed; a later sweep of the folder may delete it
                state = newer

    def _append(self, state: State, record: dict) -> bool:
        if not self._commits.append(record["version"], record):
            return False
        if record["version"] % SNAPSHOT == 0:
            state = State.of_json(state.to_json())
            state.add(record)
            self._commits.append(record["version"], state.to_json(), ".sum")
        return True

    def _clash(self, old: State, new: State, added: dict[str, list[dict]], reads: tuple[str, ...]) -> bool:
        """Whether commits since ``old`` changed a row that was written now, or one of the tables read."""
        came = [c for a, c in new.commits.items() if a not in old.commits and not c.base]
        if any(t in reads for c in came for t in c.tables):
            return True
        late = {c.attempt for c in came}
        for table, files in added.items():
            keys, _ = schemas.TABLES[table]
            theirs = [f for f in new.files.get(table, []) if f["attempt"] in late]
            theirs = [f for f in theirs if any(f["low"] <= m["high"] and f["high"] >= m["low"] for m in files)]
            if theirs:
                read = lambda some: self.spark.read.schema(schemas.TABLES[table][1]).parquet(*[f"{self.root}/{f['path']}" for f in some]).select(*keys)  # noqa: B023, E731
                if not read(files).join(read(theirs), keys, "left_semi").isEmpty():
                    return True
        return False

    def _write(self, table: str, df: DataFrame, attempt: str, level: int = 0, slice_bits: int = 0, most: int = 0) -> list[dict]:
        """Write the rows of an attempt, on a level in files by slice, and their index; the entries of its files.

        On a level ``most`` bounds the rows. A slice of more than ``FILE_ROWS`` is cut by the next bits of its
        hashes into several files, each of which a task of its own sorts.
        """
        (order, schema), keys = schemas.TABLES[table], schemas.lookup_keys(table)
        columns = self.spark.createDataFrame([], schema).columns
        seen = Observation()
        path = f"{self.root}/{table}/attempt={attempt}"
        parts = 1 << FAN if slice_bits else 1
        if level:
            h = F.xxhash64(*keys)
            counted = df.select(*columns, F.col("batch").alias("held_batch"), F.col("place").alias("held_place"), _slice(h, F.lit(slice_bits)).alias("slice"))
            if table in schemas.LOOKED_UP_BY:  # one lookup key may hold a large part of a slice
                counted = counted.hint("rebalance", F.col("slice"))
            else:
                deep = (most // (parts * FILE_ROWS)).bit_length()
                parts <<= deep
                counted = counted.repartitionById(parts, _slice(h, F.lit(slice_bits + deep)).bitwiseAND(F.lit(parts - 1)))
            counted = counted.sortWithinPartitions("slice", *order)
            counted.observe(seen, F.count(F.lit(1)).alias("n")).write.partitionBy("slice").parquet(path)
        else:
            # files of a good size, one for a small batch
            even = df.select(*columns).hint("rebalance")
            even.observe(seen, F.count(F.lit(1)).alias("n")).write.parquet(f"{path}/slice=0")
        n = seen.get["n"]
        if not n:
            return []
        bits = max(10, min(30, (BITS_PER_KEY * n // parts).bit_length()))
        rows = self.spark.read.schema(f"{schema}, attempt string, slice int").option("basePath", f"{self.root}/{table}").parquet(path)
        short = F.concat(F.lit(f"{table}/attempt="), F.substring_index(F.col("_metadata.file_path"), f"/{table}/attempt=", -1))
        rows = rows.select(short.alias("file"), "slice", F.xxhash64(*keys).alias("h"), F.xxhash64(F.lit("bloom"), *keys).alias("g"))
        words = rows.select("file", "slice", "h", *_bit(F.col("g"), F.lit(bits))).groupBy("file", "slice", "word").agg(
            F.bit_or("bit").alias("mask"), F.count(F.lit(1)).alias("rows"), F.min("h").alias("low"), F.max("h").alias("high")
        )
        inline = n <= INLINE_ROWS
        pairs = F.collect_list(F.struct("word", "mask"))
        if not inline:
            beside = f"{self.root}/{table}-index/attempt={attempt}"
            words = words.withColumns({"slice_bits": F.lit(slice_bits), "bits": F.lit(bits)})
            words.repartitionByRange("file", "word").sortWithinPartitions("file", "word").write.parquet(beside)
            words, pairs = self.spark.read.parquet(beside), F.lit(None)
        found = words.groupBy("file", "slice").agg(F.sum("rows").alias("rows"), F.min("low").alias("low"), F.max("high").alias("high"), pairs.alias("words"))
        out = []
        for r in found.collect():
            out.append({
                "path": r.file, "attempt": attempt, "level": level, "slice_bits": slice_bits, "slice": r["slice"], "bits": bits, "rows": r.rows,
                "low": r.low, "high": r.high, "words": [[w.word, w.mask] for w in r.words] if inline else None,
            })
        return sorted(out, key=lambda f: f["path"])

    # Folding

    def settle(self) -> int:
        """Fold what has gathered; returns how many folds were committed."""
        done = 0
        while self._fold_once():
            done += 1
        return done

    def _fold_once(self) -> bool:
        state = self._state()
        fresh = [c for c in state.listed() if not c.base]
        if len(fresh) >= 2 * FOLD_AFTER:
            return self._fold(state, fresh[:-FOLD_AFTER])
        for table, files in state.files.items():
            for level in sorted({f["level"] for f in files if f["level"]}):
                own = [f for f in files if f["level"] == level]
                if sum(f["rows"] for f in own) > self.file_rows << (FAN * (level - 1)):
                    biggest = max({f["slice"] for f in own}, key=lambda s: (sum(f["rows"] for f in own if f["slice"] == s), -s))
                    return self._fold_level(state, table, level, biggest)
        return False

    def _fold(self, state: State, commits: list[Commit]) -> bool:
        """Fold whole commits into level 1 of every table."""
        attempts = {c.attempt for c in commits}
        work = {}
        for table, files in state.files.items():
            fresh = [f for f in files if f["attempt"] in attempts]
            if fresh:
                work[table] = (fresh + [f for f in files if f["level"] == 1], 1, 0)
        last = max(commits, key=lambda c: c.place)
        return self._swap(state, work, last, commits)

    def _fold_level(self, state: State, table: str, level: int, slice_: int) -> bool:
        """Fold one slice of a level into the slices of the next level that divide it."""
        files = state.files[table]
        mine = [f for f in files if f["level"] == level and f["slice"] == slice_]
        below = [f for f in files if f["level"] == level + 1 and f["slice"] >> FAN == slice_]
        holder = max((state.commits[f["attempt"]] for f in mine + below), key=lambda c: c.place)
        return self._swap(state, {table: (mine + below, level + 1, FAN * level)}, holder, [])

    def _swap(self, state: State, work: dict[str, tuple[list[dict], int, int]], name: Commit, folded: list[Commit]) -> bool:
        """Commit the last versions of the rows in some files in place of those files."""
        attempt = f"{time.time_ns():020d}-{uuid.uuid4().hex[:8]}"
        added = {}
        for table, (files, level, slice_bits) in work.items():
            rows = self._last(table, self._read(table, files, state), keep=True)
            added[table] = self._write(table, rows, attempt, level, slice_bits, sum(f["rows"] for f in files))
        drop = sorted(f["path"] for files, _, _ in work.values() for f in files)
        while True:
            record = {
                "version": state.version + 1, "writer": name.writer, "batch": name.batch, "attempt": attempt, "base": True, "place": name.place,
                "tables": sorted(work), "add": added, "drop": drop, "replaces": [],
                "folds": [[c.writer, c.batch] for c in folded], "emptied": [c.attempt for c in folded],
            }
            if self._append(state, record):
                return True
            state = self._state()
            there = {f["path"] for files in state.files.values() for f in files}
            if not there.issuperset(drop) or any(c.attempt not in state.commits for c in folded):
                return False  # another writer folded or replaced some of it; the next fold starts from there

    def compact(self) -> int:
        """Fold all batches but the last one of each writer.

        Those stay as they are, so that they can run again. Returns the batch that what was folded counts
        as, 0 if there is nothing to fold.
        """
        state = self._state()
        fresh = [c for c in state.listed() if not c.base]
        last = {c.writer: c.attempt for c in fresh}
        folded = [c for c in fresh if c.attempt != last[c.writer]]
        if len(state.listed()) < 3 or not folded or not self._fold(state, folded):
            return 0
        return max(folded, key=lambda c: c.place).batch

    def expire(self, keep: int = 0) -> int:
        """Delete the files and records that only readers of older than the last ``keep`` versions need.

        Returns how many batches are not listed any more.
        """
        state = self._state()
        upto = state.version - keep
        records = [n for n in self._commits.names()[0] if n <= upto]
        old = [f for f in state.gone if f["since"] <= upto]
        ran = [r for n in records if "expired" not in (r := self._commits.record(n))]
        if not old and not ran:
            return 0
        while not self._commits.append(state.version + 1, mark := {"version": state.version + 1, "expired": upto}):
            state = self._state()
        state = State.of_json(state.to_json())
        state.add(mark)
        self._commits.append(state.version, state.to_json(), ".sum")  # from here on nobody reads what goes now
        for n in records:
            self._commits.delete(f"{self.root}/_commits/{n:020d}.json")
        live = {f["attempt"] for files in state.files.values() for f in files}
        for f in old:
            self._commits.delete(f"{self.root}/{f['path']}")
        for table, attempt in {(f["table"], f["path"].split("attempt=")[1].split("/")[0]) for f in old}:
            if attempt not in live:
                for folder in (table, f"{table}-index"):
                    self._commits.delete(f"{self.root}/{folder}/attempt={attempt}")
        return len({(r["writer"], r["batch"]) for r in ran} - {(c.writer, c.batch) for c in state.commits.values()})


def _slice(h: Column, bits: Column) -> Column:
    """The first ``bits`` bits of a hash, from the least."""
    shifted = h.bitwiseXOR(F.lit(-(1 << 63)))
    return F.when(bits == 0, 0).otherwise(F.call_function("shiftrightunsigned", shifted, (F.lit(64) - bits).cast("int"))).cast("int")


def _bit(g: Column, bits: Column) -> tuple[Column, Column]:
    """Word and bit of a Bloom filter of 2^``bits`` bits."""
    at = F.call_function("shiftrightunsigned", g, (F.lit(64) - bits).cast("int"))
    word = F.call_function("shiftright", at, F.lit(6)).cast("int").alias("word")
    return word, F.call_function("shiftleft", F.lit(1).cast("bigint"), at.bitwiseAND(F.lit(63)).cast("int")).alias("bit")
