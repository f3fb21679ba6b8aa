"""Deduplicating new batches against all history.

A 256-bit hash is a set of 12 tokens: its segments, three per 64-bit word (22, 21 and 21 bits), each with its place.
Two hashes within 10 bits differ in at most 10 segments, so they share at least 2 of 12 tokens.  All hashes of an index
order their tokens in one way, rare before frequent, so the 11 rarest tokens of both hold a shared one: these prefixes
are all that is stored and all that is looked up.

A posting has 18 bytes: token, id, and the four words folded into 48 bits, which tell nearly all strangers under a token
apart, since folding never adds to a distance.  Postings travel and lie in blocks of one part (by token) each, as columns of
bytes, not as rows, with the steps between sorted tokens in place of the tokens.  One task holds the postings of one part, finds the pairs under each token, and only these few pairs
fetch the whole hashes for the exact check.

The index is a folder: the frequent tokens, fixed when it is founded, and one generation of postings and hashes per load.
A load reads only the parts of its own tokens and appends what it accepts.  Rejected rows never enter the index.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mediaframe.session import delete_path, stage, staged_path, unstage

BITS = 256
MAX_DISTANCE = 10
#: Lowest bit and width of the segments of a word.
_FIELDS = ((0, 22), (22, 21), (43, 21))
SEGMENTS, _PLACE = 12, 22
PREFIX = SEGMENTS - (SEGMENTS - MAX_DISTANCE) + 1
#: Rows under one token from which they are not compared all with all; near rows from which one row stands for them.
HOT_ROWS = 1000
#: Open pairs (of 16 bytes) from which on one task decides them in order.
FEW_ROWS = 500_000
#: Tokens in more than one of so many rows are frequent; there are at most 12 times as many of them.
_FREQUENT = 1000
#: Rows whose postings are made at once, and postings in a part of an index whose size is known.
_AT_ONCE, PART_POSTINGS = 100_000, 1_500_000
_POSTING, _FOLD = 18, 6
_BLOCKS, _PAIRS = "part int, data binary", "a bigint, b bigint, old boolean"
_Arrays = Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]


def _words(hashes: pa.Array) -> np.ndarray:
    """The words of hashes of 32 bytes, one row each."""
    at = np.frombuffer(hashes.buffers()[1], np.int32)[hashes.offset : hashes.offset + len(hashes) + 1]
    return np.frombuffer(hashes.buffers()[2], np.uint8)[at[0] : at[-1]].view("<u8").reshape(-1, 4)


def _tokens(words: np.ndarray) -> np.ndarray:
    """The 12 tokens of each row, by place: place and bits of a segment in one number."""
    fields = [(w, low, width) for w in range(4) for low, width in _FIELDS]
    out = [(words[:, w] >> np.uint64(low) & np.uint64((1 << width) - 1)).astype(np.uint32) for w, low, width in fields]
    return np.stack([bits + np.uint32(i << _PLACE) for i, bits in enumerate(out)])


def _folded(words: np.ndarray) -> np.ndarray:
    """All bits in one word of 48 bits; turned, so that equal words do not cancel each other."""
    out = words[:, 0].copy()
    for i in (1, 2, 3):
        turn = np.uint64(17 * i)
        out ^= words[:, i] << turn | words[:, i] >> np.uint64(64) - turn
    return (out ^ out >> np.uint64(48)) & np.uint64((1 << 48) - 1)


def _close(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b) <= MAX_DISTANCE


def _collected(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(ids, words) of many rows at once."""
    held, n = [], 0
    for batch in batches:
        if batch.num_rows:
            held.append((batch["id"].to_numpy(), _words(batch["hash"]).copy()))
            n += batch.num_rows
        if n >= _AT_ONCE:
            yield tuple(map(np.concatenate, zip(*held)))
            held, n = [], 0
    if n:
        yield tuple(map(np.concatenate, zip(*held)))


def _count_tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(token, n) of the tokens that are frequent among rows read at once: one that is frequent in all is so somewhere."""
    for _, words in _collected(batches):
        token, n = np.unique(_tokens(words), return_counts=True)
        much = (n > 1) & (n * _FREQUENT > len(words))
        yield pa.RecordBatch.from_pydict({"token": token[much].astype(np.int64), "n": n[much].astype(np.int64)})


def _packer(order: list[tuple[int, int]], parts: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Postings of (id, hash) in blocks of one part.  The last token by (number of rows, token) is left out."""
    order = sorted(order)
    frequent = np.array([t for t, _ in order], np.uint32)
    counts = np.array([n for _, n in order], np.int64)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, words in _collected(batches):
            tokens, n = _tokens(words), len(ids)
            score = np.zeros(tokens.shape, np.int64) + np.arange(SEGMENTS)[:, None]
            if len(frequent):
                at = np.searchsorted(frequent, tokens).clip(max=len(frequent) - 1)
                score += np.where(frequent[at] == tokens, counts[at], 0) * SEGMENTS
            stays = np.ones(tokens.shape, bool)
            stays[score.argmax(0), np.arange(n)] = False
            place, row = np.nonzero(stays)
            key = tokens[place, row]
            part = (key * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(40)) % np.uint64(parts)
            line = np.lexsort((key, part)) if parts > 1 << 15 else np.argsort(part << np.uint64(32) | key)
            part, key, row = part[line], key[line], row[line]
            ends = [*np.flatnonzero(np.diff(part)) + 1, len(key)]
            step = np.diff(key, prepend=key[:1])
            step[[0, *ends[:-1]]] = key[[0, *ends[:-1]]]  # each block begins anew
            bytes_ = np.empty((len(key), _POSTING), np.uint8)
            bytes_[:, :4] = step.view(np.uint8).reshape(-1, 4)
            bytes_[:, 4:12] = ids[row].view(np.uint8).reshape(-1, 8)
            bytes_[:, 12:] = _folded(words)[row].view(np.uint8).reshape(-1, 8)[:, :_FOLD]
            cuts = list(zip([0, *ends[:-1]], ends))
            data = pa.array([bytes_[i:j].T.tobytes() for i, j in cuts], pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array([int(part[i]) for i, _ in cuts], pa.int32()), data], ["part", "data"])

    return pack


def _unpacked(blocks: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    key, ids, fold = [], [], []
    for block in blocks:
        at = np.frombuffer(block, np.uint8).reshape(_POSTING, -1)
        key.append(np.ascontiguousarray(at[:4].T).view(np.uint32).ravel().cumsum(dtype=np.uint32))
        ids.append(np.ascontiguousarray(at[4:12].T).view(np.int64).ravel())
        folded = np.zeros((at.shape[1], 8), np.uint8)
        folded[:, :_FOLD] = at[12:].T
        fold.append(folded.view(np.uint64).ravel())
    return np.concatenate(key), np.concatenate(ids), np.concatenate(fold)


def _small(end: np.ndarray, fold: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places of the close pairs among neighbours up to the ends of their groups."""
    at, d = np.arange(len(end)), 0
    while len(at):
        d += 1
        at = at[at + d < end[at]]
        hit = at[_close(fold[at], fold[at + d])]
        yield hit, hit + d


def _large(ids: np.ndarray, fold: np.ndarray, new: np.ndarray, hot_rows: int, cross: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places of the close pairs in one large group.

    Where more than ``hot_rows`` rows are close to one, only their pairs with that one come out, and all later rows come
    out as pairs with themselves: not all of their pairs are known."""
    rows = np.flatnonzero(new)
    for h in np.flatnonzero(~new):
        hit = rows[_close(fold[rows], fold[h])]
        yield np.full(len(hit), h), hit
    rows = rows[np.argsort(ids[rows], kind="stable")]
    bits = fold[rows]
    for i in range(0 if cross else len(rows) - 1):
        hit = rows[i + 1 :][_close(bits[i + 1 :], bits[i])]
        yield np.full(len(hit), rows[i]), hit
        if len(hit) > hot_rows:
            yield rows[i + 1 :], rows[i + 1 :]
            return


def _pairs(key: np.ndarray, ids: np.ndarray, fold: np.ndarray, new: np.ndarray, hot_rows: int, cross: bool) -> _Arrays:
    """(a, b, old) of close rows under the same token, b a new one and a an old one or a smaller new one."""
    line = np.sort(key.astype(np.uint64) << np.uint64(32) | np.arange(len(key), dtype=np.uint64))
    key, line = line >> np.uint64(32), line & np.uint64(0xFFFFFFFF)
    begin = np.concatenate([[0], np.flatnonzero(key[1:] != key[:-1]) + 1])
    size = np.diff(np.append(begin, len(key)))

    def told(i: np.ndarray, j: np.ndarray) -> _Arrays:
        i, j = np.where(new[i], j, i), np.where(new[i], i, j)  # the old one of two first
        i, j = i[new[j]], j[new[j]]
        old = ~new[i]
        i, j, old = (x[old] for x in (i, j, old)) if cross else (i, j, old)
        a, b = ids[i], ids[j]
        if len(a):
            yield np.where(old, a, np.minimum(a, b)), np.where(old, b, np.maximum(a, b)), old

    held = (size > 1) & (size <= hot_rows)
    at = line[np.repeat(held, size)]
    end = np.repeat(np.cumsum(size[held]), size[held])
    for i, j in _small(end, fold[at]):
        yield from told(at[i], at[j])
    for g in np.flatnonzero(size > max(hot_rows, 1)):
        at = line[begin[g] : begin[g] + size[g]]
        for i, j in _large(ids[at], fold[at], new[at], hot_rows, cross):
            yield from told(at[i], at[j])


def _matcher(hot_rows: int, cross: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The pairs of the blocks of one part."""

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks, new = [], []
        for batch in batches:
            for data, fresh in zip(batch["data"], batch["fresh"].to_pylist()):
                blocks.append(data.as_py())
                new.append(np.full(len(blocks[-1]) // _POSTING, fresh))
        if not any(n[0] for n in new):
            return
        postings = _unpacked(blocks)
        blocks.clear()
        out, n = [], 0
        for found in _pairs(*postings, np.concatenate(new), hot_rows, cross):
            out.append(found)
            n += len(found[0])
            if n >= _AT_ONCE:
                yield pa.RecordBatch.from_arrays([np.concatenate(x) for x in zip(*out)], ["a", "b", "old"])
                out, n = [], 0
        if out:
            yield pa.RecordBatch.from_arrays([np.concatenate(x) for x in zip(*out)], ["a", "b", "old"])

    return match


def _truly_near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The exact check: first the length filter is implied, since the distance is at least the difference of set bits."""
    for batch in batches:
        if batch.num_rows:
            near = np.bitwise_count(_words(batch["x"]) ^ _words(batch["y"])).sum(1) <= MAX_DISTANCE
            yield batch.select(["a", "b", "old"]).filter(pa.array(near))


def _in_order(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, waits) of the rows that are rejected or cannot be decided yet, the smallest id first.

    A row paired with itself may have other pairs: it can be rejected, but not accepted."""
    held = [(x["a"].to_numpy(), x["b"].to_numpy()) for x in batches if x.num_rows]
    if not held:
        return
    a, b = map(np.concatenate, zip(*held))
    lost, waits = set(), set(a[a == b].tolist())
    line = np.argsort(b, kind="stable")
    a, b = a[line], b[line]
    ends = [*np.flatnonzero(np.diff(b)) + 1, len(b)]
    others = a.tolist()
    for i, j in zip([0, *ends[:-1]], ends):
        row = int(b[i])
        before = [x for x in others[i:j] if x != row and x not in lost]
        if any(x not in waits for x in before):
            lost.add(row)
            waits.discard(row)
        elif before:
            waits.add(row)
    ids = np.array([*lost, *waits], np.int64)
    yield pa.RecordBatch.from_arrays([ids, np.arange(len(ids)) >= len(lost)], ["id", "waits"])


def _valid(rows: DataFrame) -> DataFrame:
    return rows.filter("hash is not null and length(hash) = 32 and id is not null")


def _representatives(valid: DataFrame) -> DataFrame:
    """One row per load and distinct hash, under its smallest id, and the number of its copies."""
    return valid.groupBy("load", "hash").agg(F.min("id").alias("id"), F.count("*").alias("copies"))


def _ids(column: str | Column) -> Callable[[DataFrame], DataFrame]:
    return lambda rows: rows.select((F.col(column) if isinstance(column, str) else column).alias("id")).distinct()


def _without(rows: DataFrame, ids: DataFrame, column: str) -> DataFrame:
    return rows.join(ids.select(F.col("id").alias(column)), column, "left_anti")


class HashIndex:
    """Inverted index of the accepted hashes in a folder; opening a path again continues with what it holds.

    ``ingest`` takes one batch.  A batch that fails before the end of its append leaves the index as it was, since only
    finished generations are read.  ``parts`` is fixed when the folder is founded; a part is held by one task, so an index
    that is to grow large needs one part for each ``PART_POSTINGS`` postings, 11 of each row."""

    def __init__(
        self, spark: SparkSession, path: str | None = None, parts: int = 16, hot_rows: int = HOT_ROWS, few_rows: int = FEW_ROWS
    ):
        self.spark, self.few_rows = spark, few_rows
        self.path = path or staged_path(spark, "hash-index")
        self.parts, self.hot_rows = parts, hot_rows
        for name in self._folders():
            if m := re.fullmatch(r"order-(\d+)-(\d+)", name):
                self.parts, self.hot_rows = int(m[1]), int(m[2])

    def _files(self):
        jvm = self.spark.sparkContext._jvm
        at = jvm.org.apache.hadoop.fs.Path(self.path)
        return jvm.org.apache.hadoop.fs.Path, at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), at

    def _folders(self) -> list[str]:
        """Finished folders of the index: those in which a write has left its mark."""
        path, fs, at = self._files()
        if not fs.exists(at):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(at)]
        return sorted(n for n in names if fs.exists(path(f"{self.path}/{n}/_SUCCESS")))

    @property
    def _order_path(self) -> str:
        return f"{self.path}/order-{self.parts}-{self.hot_rows}"

    def _generations(self) -> list[str]:
        return [n for n in self._folders() if n.startswith("gen=")]

    def found(self, reps: DataFrame) -> None:
        """Fix the order of the tokens by the frequent ones of the first rows, unless the folder has one already.

        All others are rarer, by their number.  Later rows are ordered in the same way: that keeps results exact and only
        affects the length of lists."""
        if self._order_path.rsplit("/", 1)[1] not in self._folders():
            counts = reps.select("id", "hash").mapInArrow(_count_tokens, "token bigint, n bigint")
            counts = counts.groupBy("token").agg(F.sum("n").alias("n")).filter(F.col("n") * _FREQUENT > reps.count())
            counts.coalesce(1).write.mode("overwrite").parquet(self._order_path)

    def keyed(self, reps: DataFrame) -> DataFrame:
        """(part, data): the postings of the prefixes in blocks of one part each."""
        order = self.spark.read.schema("token bigint, n bigint").parquet(self._order_path)
        order = [(r.token, r.n) for r in order.collect()]  # at most 12 times _FREQUENT
        return reps.select("id", "hash").mapInArrow(_packer(order, self.parts), _BLOCKS)

    def postings(self, parts: list[int] | None = None) -> DataFrame | None:
        """The blocks of postings, of the given parts only; None if there are none yet."""
        gens = self._generations()
        if not gens:
            return None
        reader = self.spark.read.schema("data binary, part int").option("basePath", self.path)
        rows = reader.parquet(*[f"{self.path}/{g}" for g in gens])
        return rows if parts is None or len(parts) == self.parts else rows.filter(F.col("part").isin(parts))

    def hashes(self) -> DataFrame | None:
        """(id, hash) of all accepted rows."""
        paths = [f"{self.path}/hashes-{g.split('=')[1]}" for g in self._generations()]
        return self.spark.read.schema("id bigint, hash binary").parquet(*paths) if paths else None

    def touched(self, blocks: DataFrame) -> list[int]:
        """The parts of the blocks; at most ``parts`` numbers."""
        return sorted(r[0] for r in blocks.select("part").distinct().collect())

    def append(self, accepted: DataFrame) -> None:
        """Add the hashes and postings of the accepted rows as one more generation."""
        number = f"{1 + max((int(g.split('=')[1]) for g in self._generations()), default=-1):08d}"
        accepted.select("id", "hash").write.mode("overwrite").parquet(f"{self.path}/hashes-{number}")
        accepted = self.spark.read.schema("id bigint, hash binary").parquet(f"{self.path}/hashes-{number}")
        blocks = self.keyed(accepted).repartitionById(self.parts, F.col("part"))
        blocks.write.mode("overwrite").partitionBy("part").parquet(f"{self.path}/gen={number}")

    def drop(self) -> None:
        delete_path(self.spark, self.path)

    def _near(self, new: DataFrame, rows: DataFrame, held: DataFrame | None, held_rows: DataFrame | None, cross: bool = False) -> tuple[DataFrame, DataFrame]:
        """Pairs (a, b, old) within 10 bits, and the ids of those rows of which not all pairs are known.

        With ``cross`` only pairs with a held row."""
        blocks = new.withColumn("fresh", F.lit(True))
        if held is not None:
            blocks = blocks.union(held.select("part", "data", F.lit(False)))
        blocks = blocks.repartitionById(self.parts, F.col("part")).select("data", "fresh")
        met = stage(blocks.mapInArrow(_matcher(self.hot_rows, cross), _PAIRS).distinct(), "pairs")
        pairs, rows = met.filter("a <> b"), rows.select("id", "hash")
        rows = rows if held_rows is None else rows.union(held_rows.select("id", "hash"))
        wanted = pairs.select("a").union(pairs.select("b")).distinct().withColumnRenamed("a", "id")
        words = stage(rows.join(wanted, "id", "left_semi"), "words")
        both = pairs.join(words.select(F.col("id").alias("a"), F.col("hash").alias("x")), "a")
        both = both.join(words.select(F.col("id").alias("b"), F.col("hash").alias("y")), "b").select("a", "b", "old", "x", "y")
        near = stage(both.mapInArrow(_truly_near, _PAIRS), "near")
        loose = stage(_ids("a")(met.filter("a = b")), "loose")
        unstage(met)
        unstage(words)
        return near, loose

    def _resolve(self, near: DataFrame, loose: DataFrame) -> tuple[list[DataFrame], DataFrame]:
        """Rejected ids, and those that wait for another round: first come, first kept.

        Steps over all open pairs: a row without an earlier near row is accepted, rows near it are rejected.  The last few
        pairs are decided in order by one task."""
        gone = [stage(_ids("b")(near.filter("old")), "gone")]
        open_ = _without(_without(near.filter("not old").select("a", "b"), gone[0], "a"), gone[0], "b")
        open_ = stage(open_, "open")
        loose = stage(_without(loose, gone[0], "id"), "loose")
        while open_.count() + loose.count() > self.few_rows:
            free = _without(open_, _ids("b")(open_).union(loose), "a")
            lost = stage(_ids("b")(free), "gone")
            if not lost.count():
                waits = stage(_ids("b")(open_).union(loose).distinct(), "waits")
                unstage(open_)
                return gone, waits
            gone.append(lost)
            spent, open_ = open_, stage(_without(_without(open_, lost, "a"), lost, "b"), "open")
            unstage(spent)
            loose = stage(_without(loose, lost, "id"), "loose")
        last = open_.union(loose.select("id", F.col("id").alias("b"))).coalesce(1)
        last = stage(last.mapInArrow(_in_order, "id bigint, waits boolean"), "last")
        unstage(open_)
        return [*gone, last.filter("not waits").select("id")], last.filter("waits").select("id")

    def decide(self, reps: DataFrame, append: bool = True) -> DataFrame:
        """(id, kept) of the rejected rows of one load, given as (id, hash) without copies; accepted ones join the index."""
        rows, all_near, gone, first_waits = reps, [], None, None
        new = self.keyed(reps)
        held = self.postings(self.touched(new) if reps.count() <= self.parts else None) if self._generations() else None
        held_rows = self.hashes() if held is not None else None
        while True:
            near, loose = self._near(new, rows, held, held_rows)
            lost, waits = self._resolve(near, loose)
            all_near.append(near)
            for ids in lost:
                gone = ids if gone is None else gone.union(ids)
            if not waits.count():
                break
            first_waits = first_waits or waits
            rows = stage(reps.join(waits, "id", "left_semi"), "waiting")
            new, held, held_rows = self.keyed(rows), None, None
        if first_waits is not None:  # rows accepted late may be near rows rejected before
            late = stage(_without(reps.join(first_waits, "id", "left_semi"), gone, "id"), "late")
            lost_rows = stage(reps.join(gone, "id", "left_semi"), "lost")
            all_near.append(self._near(self.keyed(lost_rows), lost_rows, self.keyed(late), late, cross=True)[0])
        near = all_near[0]
        for more in all_near[1:]:
            near = near.union(more)
        out = stage(_without(near, gone, "a").groupBy(F.col("b").alias("id")).agg(F.min("a").alias("kept")), "kept")
        if append:
            self.append(_without(reps.select("id", "hash"), gone, "id"))
        for ids in all_near:
            unstage(ids)
        return out

    def ingest(self, batch: DataFrame) -> DataFrame:
        """(kept_id, dup_id) of the rejected rows of one batch, given as (id, hash); accepted ones join the index.

        Rows without a hash of 32 bytes are skipped.  Within the batch rows are taken in the order of their ids, which
        have to be greater than those of the batches before."""
        valid = _valid(batch.select("id", "hash", F.lit(0).alias("load")))
        reps = stage(_representatives(valid), "batch")
        self.found(reps)
        out = stage(_decisions(valid, reps, self.decide(reps)), "duplicates")
        unstage(reps)
        return out


def _decisions(valid: DataFrame, reps: DataFrame, kept: DataFrame) -> DataFrame:
    """(kept_id, dup_id): rejected rows, and copies, which follow the row of their hash."""
    twins = reps.filter("copies > 1").select("load", "hash", "id").join(kept, "id", "left")
    twins = valid.select("load", "hash", F.col("id").alias("dup_id")).join(twins, ["load", "hash"]).filter("dup_id <> id")
    out = twins.select(F.coalesce("kept", "id").alias("kept_id"), "dup_id")
    return kept.select(F.col("kept").alias("kept_id"), F.col("id").alias("dup_id")).union(out)


def loads_of(sizes: dict[int, int], growth: int = 3) -> list[int]:
    """The last batch of each load.  Consecutive batches make one load until it outgrows ``growth`` times all loads before it.

    A backlog of any number of batches is thus read in logarithmically many loads, and no index row more often than
    that; a batch on its own is a load."""
    ends, before, load = [], 0, 0
    for b in sorted(sizes):
        load += sizes[b]
        if load > growth * before:
            ends.append(b)
            before, load = before + load, 0
    if load:
        ends.append(max(sizes))
    return ends


def dedup_batches(
    rows: DataFrame, key: str = "hash_id", hash_: str = "hash", batch: str = "batch_no", index: HashIndex | None = None
) -> DataFrame:
    """(kept_id, dup_id): batches are ingested in order; one row per rejected row with the smallest accepted id within
    10 bits.

    Ids rise with the batch, so consecutive batches that make one load (see ``loads_of``) give the same rows as one
    after the other.  Null, short and long hashes are skipped, exact copies count as repeats, rows without a batch
    number come first, other columns are not read, and an empty input gives an empty result.  The numbers of batches
    and their sizes are read to the driver, never their rows."""
    spark = rows.sparkSession
    own = index is None
    number = F.coalesce(F.col(batch).cast("bigint"), F.lit(-1)).alias("b")
    valid = _valid(rows.select(F.col(key).alias("id"), F.col(hash_).alias("hash"), number))
    sizes = {r.b: r["count"] for r in valid.groupBy("b").count().collect()}
    ends = loads_of(sizes)
    if not ends:
        return valid.select(F.col("id").alias("kept_id"), F.col("id").alias("dup_id")).limit(0)
    index = index or HashIndex(spark, parts=max(16, -(-PREFIX * sum(sizes.values()) // PART_POSTINGS)))
    load = F.lit(len(ends) - 1)
    for i in reversed(range(len(ends) - 1)):
        load = F.when(F.col("b") <= ends[i], i).otherwise(load)
    valid = valid.select("id", "hash", load.alias("load"))
    prepared = stage(_representatives(valid), "loads", by="load")
    index.found(prepared.filter("load = 0"))
    kept = None
    for i in range(len(ends)):
        told = index.decide(prepared.filter(F.col("load") == i), append=not own or i + 1 < len(ends))  # nobody reads the last of an own index
        kept = told if kept is None else kept.union(told)
    if own:
        index.drop()
    return _decisions(valid, prepared, kept)
